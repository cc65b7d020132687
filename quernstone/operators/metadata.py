"""Metadata tables: repositories, files and symbols, in the same generations as the search documents that follow from them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rank import placed
from ..functions.text import language_of
from ..schema import FILES, REPOSITORIES, SYMBOLS, positive_id
from ..sources.symbols import symbols_of
from . import changes
from .generations import GenerationStore, Source

SCHEMAS = {"repositories": REPOSITORIES, "files": FILES, "symbols": SYMBOLS}


class RepositoryConflict(ValueError):
    """A repository that is registered already, by its URL or its folder."""


class Metadata:
    """The three tables. A commit takes rows out and adds others, and readers see all of it or none."""

    def __init__(self, spark: SparkSession, root: str, store: GenerationStore | None = None):
        self.spark, self.store = spark, store or GenerationStore(spark, root)

    def read(self, table: str) -> DataFrame:
        if not self.store.reader().has(table):
            return self.spark.createDataFrame([], SCHEMAS[table])
        return self.store.read(table)

    def located(self, table: str) -> DataFrame:
        """The rows with the segment that they lie in."""
        reader = self.store.reader()
        return reader.located(table) if reader.has(table) else self.read(table).withColumn("segment", F.lit(None).cast("string"))

    def taken(self, rows: DataFrame) -> DataFrame:
        """(segment, key) of located rows, to be taken out."""
        return rows.select("segment", F.col("id").alias("key"))

    def commit(self, **tables: DataFrame) -> str:
        """Whole tables in place of those there are."""
        if unknown := set(tables) - set(SCHEMAS):
            raise ValueError(f"no tables {sorted(unknown)}")
        self.store.resume()
        return self.store.publish({name: self.typed(df, name) for name, df in tables.items()}, purpose="metadata")

    def add(self, tables: dict[str, Source], dead: dict[str, DataFrame] | None = None, **more) -> str:
        """Add rows to tables and take rows out of them."""
        self.store.resume()
        return self.store.publish(tables, appended=tables, dead=dead, purpose="metadata", **more)

    def typed(self, df: DataFrame, table: str) -> DataFrame:
        """The table's columns and types; a column that is not there is null."""
        schema = self.spark.createDataFrame([], SCHEMAS[table]).schema
        return df.select(*((F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema))

    def next_id(self, table: str) -> int:
        return (self.read(table).agg(F.max("id")).first()[0] or 0) + 1

    def register(self, name: str, clone_url: str, branch: str, commit: str, files: DataFrame) -> int:
        """A new repository and its files (path, language, content_hash); its id. A URL that is registered is a RepositoryConflict."""
        known = self.read("repositories")
        if not known.where(F.col("clone_url") == clone_url).isEmpty():
            raise RepositoryConflict("the repository has already been added")
        repository_id, first = self.next_id("repositories"), self.next_id("files")
        now = F.current_timestamp()
        row = self.spark.createDataFrame([(repository_id, name, clone_url, branch, commit)], "id int, name string, clone_url string, default_branch string, last_indexed_commit string").withColumns({"created_at": now, "updated_at": now})
        rows = numbered(files, first, "path").withColumns({"repository_id": F.lit(repository_id), "last_indexed_commit": F.lit(commit), "created_at": now, "updated_at": now})
        self.add({"repositories": self.typed(row, "repositories"), "files": self.typed(rows, "files")})
        return repository_id

    def repository(self, repository_id: int) -> dict:
        found = self.read("repositories").where(F.col("id") == positive_id(repository_id)).collect()
        if not found:
            raise ValueError(f"repository {repository_id} does not exist")
        return found[0].asDict()

    def replace_symbols(self, repository_id: int, symbols: DataFrame) -> int:
        """All symbols of a repository (file_id and the symbol's fields) in place of those it had; how many there are now."""
        self.repository(repository_id)
        rows = numbered(symbols, self.next_id("symbols"), "file_id", "start_line", "qualified_name").withColumns({"repository_id": F.lit(repository_id), "created_at": F.current_timestamp()})
        name = self.add({"symbols": self.typed(rows, "symbols")}, {"symbols": self.taken(self.located("symbols").where(F.col("repository_id") == repository_id))})
        return dict(self.store.manifest(name)["tables"]["symbols"])[name]

    def merge(self, repository_id: int, feed: DataFrame, present: DataFrame, commit: str) -> tuple[dict[str, Source], dict[str, DataFrame], DataFrame]:
        """What a change set does to a repository's rows: new rows by table, rows taken out by table, and the classified changes.

        present: (path, content_hash, text) of the changed paths' regular files as they are now. A path's row is replaced and keeps its id; a path that is gone loses its row; symbols go with
        their file's row and are parsed anew; the repository's row says which commit it has.
        """
        own = F.col("repository_id") == repository_id
        files = self.located("files").where(own)
        affected = changes.affected_paths(feed)
        told = changes.classify(feed, files, present)
        now, there = F.current_timestamp(), present.where(language_of(F.col("path")).isNotNull())
        old = files.join(F.broadcast(affected) if changes.are_few(affected) else affected, "path", "left_semi")
        written = told.where(~F.col("action").isin("delete", "ignore")).select("path").distinct()
        fresh = there.join(written, "path", "left_semi").join(old.select("path", F.col("id").alias("old_id"), "created_at"), "path", "left")
        added = numbered(fresh.where("old_id IS NULL").select("path"), self.next_id("files"), "path").select("path", F.col("id").alias("new_id"))
        rows = fresh.join(added, "path", "left").withColumns({
            "id": F.coalesce("old_id", "new_id"), "repository_id": F.lit(repository_id), "language": language_of(F.col("path")), "last_indexed_commit": F.lit(commit),
            "created_at": F.coalesce("created_at", now), "updated_at": now,
        })
        repository = self.located("repositories").where(F.col("id") == repository_id)
        moved = repository.withColumns({"last_indexed_commit": F.lit(commit), "updated_at": now})
        first = self.next_id("symbols")

        def parsed(own_table: Callable[[str], DataFrame]) -> DataFrame:
            python = own_table("files").where(F.col("language") == "python").select(F.col("id").alias("file_id"), "path").join(present, "path").where("text IS NOT NULL").select("file_id", "text")
            found = numbered(symbols_of(python), first, "file_id", "start_line", "qualified_name")
            return self.typed(found.withColumns({"repository_id": F.lit(repository_id), "created_at": now}), "symbols")

        gone = old.select(F.col("id").alias("file_id")).distinct()
        dead = {"repositories": self.taken(repository), "files": self.taken(old), "symbols": self.taken(self.located("symbols").where(own).join(gone, "file_id", "left_semi"))}
        return {"repositories": self.typed(moved, "repositories"), "files": self.typed(rows, "files"), "symbols": parsed}, dead, told


def numbered(df: DataFrame, first: int, *order: str) -> DataFrame:
    """The rows with an id from ``first`` on, in an order."""
    rows = placed(df.withColumn("_all", F.lit(0)), "_all", F.col(order[0]), *order[1:])
    return rows.withColumn("id", (F.col("place") + (first - 1)).cast("int")).drop("place", "_all")


def repository_symbols(symbols: DataFrame, files: DataFrame, repository_id: int) -> DataFrame:
    """A repository's symbols with their files' path and language, in order of id."""
    own = symbols.where(F.col("repository_id") == repository_id)
    return own.join(files.select(F.col("id").alias("file_id"), "path", "language"), "file_id").orderBy("id")
