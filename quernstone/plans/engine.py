"""The engine: indexing, publication, search, synchronisation and evaluation over one store."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark import inheritable_thread_target
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import analyse, embedding_text, is_test_path, rerank_text
from ..functions.vector import is_valid
from ..operators import blocks, changes, evaluation, fusion, jobs, lexical, locking, quantised, segments, semantic
from ..operators.cache import FencedCache, SearchService, check_request
from ..operators.generations import GenerationStore, Source
from ..operators.hits import IncompleteSearchError, checked
from ..operators.metadata import Metadata
from ..schema import CHANGES
from ..sources.symbols import symbols_of

KEYS = ["repository", "path", "start_line"]
#: What an evaluation's case names.
IDENTITY = ["repository", "qualified_name"]
#: Up to so many hits of a batch (about 100 bytes each) are broadcast to the documents; beyond it they meet by a shuffle.
BROADCAST_HITS = 200_000
#: The hits of up to so many queries are fetched by the driver (a depth of 40 in two branches: some 5 MB).
LOCAL_QUERIES = 1024


def hashing_embedder(dims: int, kind: str = "float") -> Callable[[Column], Column]:
    """A column function: the text's words hashed to ``dims`` slots, with unit length, as numbers of a kind. Deterministic, needs no model."""

    def held(value: Column, body: Callable[[Column], Column]) -> Column:
        """body(value), with the value computed once: a lambda's variable is, while an expression in a lambda is computed for each element."""
        return F.get(F.transform(F.array(value), body), F.lit(0))

    def ends(slots: Column) -> Column:
        """Of sorted slots, each with the number of those up to its last place."""
        marked = F.transform(slots, lambda s, k: F.when(F.coalesce(F.get(slots, k + 1) != s, F.lit(True)), F.struct(s.alias("s"), (k + 1).alias("k"))))
        return F.filter(marked, lambda e: e.isNotNull())

    def counts(ends_: Column) -> Column:
        return F.map_from_entries(F.transform(ends_, lambda e, k: F.struct(e["s"], (e["k"] - F.coalesce(F.get(ends_, k - 1)["k"], F.lit(0))).cast("double"))))

    def unit(c: Column) -> Column:
        norm = F.sqrt(F.aggregate(F.map_values(c), F.lit(0.0), lambda acc, x: acc + x * x))
        return held(norm, lambda n: F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda k: F.coalesce(F.try_element_at(c, k.cast("int")) / n, F.lit(0.0)).cast(kind)))

    def embed(text: Column) -> Column:
        slots = F.transform(analyse(text), lambda w: F.pmod(F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("long"), F.lit(dims)).cast("int"))
        return held(F.array_sort(slots), lambda s: held(ends(s), lambda e: held(counts(e), unit)))

    return embed


class Engine:
    """Search over generations of symbol documents.

    A generation is a manifest of immutable segments. A segment holds new documents, their postings in blocks, and what they add to document frequencies and
    field totals, beside rows of the metadata that they follow from; what a commit takes out is written down as keys, and is subtracted from the sums. So a sync writes what
    has changed, a query batch reads its terms' blocks and no text but that of its hits, and metadata and documents change at one moment.
    Segments of like size are merged as they come together. Whatever writes holds the corpus lock, resumes a publication that was stopped, and only then derives what it publishes.

    ``coordination``: a folder that all writers share, on a file system with locks; by default the root, where that is local.
    ``embedder`` and ``reranker``: column functions of a text, and of a query and a document; ``models`` makes them of models.
    ``code_bytes``: with it vectors are also stored as codes of so many bytes, and vector search reads these and the full vectors of what can be an answer alone (``quantised``); it is exact with and without.
    """

    def __init__(self, spark: SparkSession, root: str, dims: int = 384, embedder: Callable[[Column], Column] | None = None, weight: float = fusion.DEFAULT_WEIGHT, coordination: str | None = None, code_bytes: int | None = None, reranker: Callable[[Column, Column], Column] | None = None):
        self.spark, self.dims, self.weight, self.code_bytes = spark, dims, fusion.check_weight(weight), code_bytes
        self.store, self.cache = GenerationStore(spark, root), FencedCache()
        if coordination is None and self.store.folder.local is None:
            raise ValueError("give a folder for locks and journals beside a store that is not local")
        self.coordination = coordination or str(self.store.folder.local)
        self.metadata, self.journal = Metadata(spark, root, self.store), jobs.Journal(self.coordination)
        self.embed = embedder or hashing_embedder(dims)
        self.rerank_score = reranker or fusion.overlap_score
        self._fields: tuple[str | None, dict] = (None, {})
        self.service = SearchService(self._retrieve, self.cache)

    # -- indexing

    @contextmanager
    def _writing(self, repository_id: int | None) -> Iterator[dict]:
        """The publication that was pending, as it was under the locks; it is finished, or abandoned, by now."""
        with locking.writer(self.coordination, repository_id, True, self.store.pending):
            pending = self.store.pending() or {}
            self.store.resume(self.cache.rotate, repository_id)
            yield pending

    def documents(self, symbols: DataFrame, files: DataFrame, repositories: DataFrame) -> DataFrame:
        """Search documents from the metadata tables."""
        rows = symbols.alias("s").join(files.alias("f"), F.col("s.file_id") == F.col("f.id")).join(repositories.alias("r"), F.col("s.repository_id") == F.col("r.id"))
        rows = rows.select(F.col("s.id").alias("symbol_id"), "s.repository_id", "s.file_id", F.col("r.name").alias("repository"), "f.language", "f.path", is_test_path(F.col("f.path")).alias("is_test"), "s.name", "s.qualified_name", "s.kind", "s.start_line", "s.end_line", "s.code")
        text = embedding_text(F.col("qualified_name"), F.col("kind"), F.col("repository"), F.col("path"), F.col("language"), F.col("code"))
        return rows.withColumn("embedding", self.embed(text))

    def _search_tables(self, docs: Source, gone: DataFrame | None = None) -> dict[str, Source]:
        """The documents and what follows from them, once they are written; ``gone``: documents whose share of the sums is taken back."""
        fields = list(lexical.BOOSTS)
        totals = lambda df: lexical.field_totals(lexical.field_tokens(df, fields))
        frequencies = lambda df: lexical.document_frequencies(lexical.document_postings(df, fields))
        sums = lambda of, *by: (lambda own: of(own("docs")) if gone is None else lexical.less(of(own("docs")), of(gone), *by))

        def posted(own: Callable[[str], DataFrame]) -> DataFrame:
            new = own("docs")
            return blocks.build(new, new.count(), fields)

        stats = sums(totals, "field")
        return {"docs": docs, **self._codes(gone is not None), "postings": posted, "frequencies": sums(frequencies, "field", "term"), "stats": lambda own: stats(own).coalesce(1)}

    def _codes(self, part: bool) -> dict[str, Source]:
        """Codes of new documents: by a codebook of their own, which is stored too, or, for a part of a corpus, by the one there is."""
        if not self.code_bytes:
            return {}
        reader, made = self.store.reader(), {}
        if part and reader.has("codebook"):
            return {"codes": lambda own: quantised.encode(own("docs"), quantised.codebook_of(reader.rows("codebook")), flag_col="is_test")}

        def book(own: Callable[[str], DataFrame]) -> DataFrame:
            made["book"] = quantised.fit(own("docs"), self.dims, self.code_bytes)
            return quantised.codebook_rows(self.spark, made["book"])

        return {"codebook": book, "codes": lambda own: quantised.encode(own("docs"), made["book"], flag_col="is_test")}

    def _publish(self, docs: DataFrame, expected: int | None, repository_id: int | None, fail_at: str | None = None) -> str:
        """All search documents anew; metadata stay."""
        return self.store.publish(self._search_tables(docs), {"docs": expected} if expected is not None else None, self.cache.rotate, fail_at, repository_id, purpose="documents")

    def _change(self, taken: DataFrame, fresh: Source, repository_id: int, fail_at: str | None, more: dict[str, Source] | None = None, dead: dict[str, DataFrame] | None = None, **how) -> str:
        """Documents ``taken`` (as located) out and ``fresh`` ones added, with other tables' rows, as one segment."""
        keys = taken.select("segment", F.col("symbol_id").alias("key"))
        tables = {**(more or {}), **self._search_tables(fresh, taken.drop("segment"))}
        name = self.store.publish(tables, how.pop("counts", None), self.cache.rotate, fail_at, repository_id, appended=[t for t in tables if t != "codebook"], dead={"docs": keys, **(dead or {})}, purpose="documents", **how)
        self._merge()
        return name

    def _located(self) -> DataFrame | None:
        """The documents with their segments; None if no documents have been published."""
        reader = self.store.reader()
        return reader.located("docs") if reader.has("docs") else None

    def _published(self) -> DataFrame:
        docs = self._located()
        if docs is None:
            raise FileNotFoundError("no documents have been published")
        return docs

    def index(self, docs: DataFrame, expected: int | None = None, fail_at: str | None = None, repository_id: int | None = None) -> str:
        """Publish a generation of these documents."""
        with self._writing(repository_id):
            return self._publish(docs, expected, repository_id, fail_at)

    def _replace(self, repository_id: int, fresh: DataFrame, fail_at: str | None = None) -> str:
        docs = self._located()
        if docs is None:
            return self._publish(fresh, fresh.count(), repository_id, fail_at)
        return self._change(docs.where(F.col("repository_id") == repository_id), fresh, repository_id, fail_at, counts={"docs": fresh.count()})

    def reindex_repository(self, repository_id: int, fresh: DataFrame, fail_at: str | None = None) -> str:
        """Replace one repository's documents, which are counted beforehand; the others stay where they are."""
        with self._writing(repository_id):
            return self._replace(repository_id, fresh, fail_at)

    def _replaced(self, docs: DataFrame, repository_id: int, paths: DataFrame, fresh: DataFrame | None = None) -> DataFrame:
        """The located documents that a change takes out: the repository's at these paths, and those whose ids come again."""
        paths = paths.select(F.col("path").alias("_path")).distinct()
        few = F.broadcast(paths) if changes.are_few(paths) else paths
        out = docs.join(few, (F.col("repository_id") == repository_id) & (F.col("path") == F.col("_path")), "left_semi")
        if fresh is None:
            return out
        return out.unionByName(docs.join(fresh.select("symbol_id").distinct(), "symbol_id", "left_semi").select(*out.columns)).dropDuplicates(["segment", "symbol_id"])

    def sync(self, repository_id: int, feed: DataFrame, fresh: DataFrame, fail_at: str | None = None, batch: tuple[str, int] | None = None) -> str | None:
        """Apply a change set as a new segment; an empty one changes nothing.

        ``batch``: a stream's name and the number of its batch. It is committed with the change, and a batch that has been, or an earlier one, changes nothing.
        """
        if feed.isEmpty():
            return None
        if not changes.repeated_paths(feed).isEmpty():
            raise ValueError("a change set names a path twice")
        with self._writing(repository_id):
            if batch and self.store.manifest()["marks"].get(f"batch {batch[0]}", -1) >= batch[1]:
                return None
            marks = {f"batch {batch[0]}": batch[1]} if batch else None
            return self._change(self._replaced(self._published(), repository_id, changes.affected_paths(feed), fresh), fresh, repository_id, fail_at, marks=marks)

    def synchronise(self, repository_id: int, head: Callable[[], tuple[str, str]], affected: Callable[[str, str], list[str]], fresh: Callable[[list[str]], DataFrame], fail_at: str | None = None) -> dict:
        """Bring a repository's documents to its head under a journal: a sync that was begun and did not end is replayed first, with the paths it was begun with.

        ``fresh`` gives the documents of paths as they are now. The job is committed with the change, so that one that had been is not applied again.
        """
        with self._writing(repository_id):

            def apply(job: dict) -> None:
                if self._is_done(repository_id, job):
                    return
                paths = self.spark.createDataFrame([(p,) for p in job["affected_paths"]], "path string")
                new = fresh(job["affected_paths"])
                self._change(self._replaced(self._published(), repository_id, paths, new), new, repository_id, fail_at, marks={f"sync {repository_id}": job["id"]})

            return jobs.run_sync(self.journal, repository_id, head, affected, apply)

    def _is_done(self, repository_id: int, job: dict) -> bool:
        return self.store.manifest()["marks"].get(f"sync {repository_id}") == job["id"]

    def follow(self, repository_id: int, head: Callable[[], str], feed: Callable[[str, str], list[tuple[int, str, str | None, str]]], present: Callable[[list[str]], DataFrame], fail_at: str | None = None) -> dict:
        """Bring a registered repository to its head: files, symbols, documents and the commit that it is at change in one commit.

        head: the commit to reach. feed: the change records (ordinal, status, old path, path) between two commits. present: (path, content_hash, text) of those of some paths that are regular
        files now; text is null where a source cannot be read. Returns the report with its counters; at the head already, nothing is done. A follow that was
        stopped is replayed with the records that it was begun with, unless its commit has been made.
        """
        with self._writing(repository_id):
            job = self.journal.pending("sync", repository_id)
            old = self.metadata.repository(repository_id)["last_indexed_commit"]
            if job is None:
                new = head()
                if new == old:
                    return {"changed": False, "old_commit": old, "target_commit": new, **dict.fromkeys(changes.COUNTERS, 0)}
                records = [tuple(r) for r in feed(old, new)]
                paths = [r[3] for r in records]
                if len(set(paths)) != len(paths):
                    raise ValueError("a change set names a path twice")
                job = self.journal.begin("sync", repository_id, old_commit=old, target_commit=new, records=records, affected_paths=sorted({p for r in records for p in (r[2], r[3]) if p}))
            if not self._is_done(repository_id, job):
                self._follow(repository_id, job, present, fail_at)
            stats = self.store.manifest()["marks"][f"stats {repository_id}"]
            self.journal.finish("sync", repository_id)
            return {"changed": True, "old_commit": job["old_commit"], "target_commit": job["target_commit"], **stats}

    def _follow(self, repository_id: int, job: dict, present: Callable[[list[str]], DataFrame], fail_at: str | None) -> None:
        records = self.spark.createDataFrame([tuple(r) for r in job["records"]], CHANGES)
        more, dead, told = self.metadata.merge(repository_id, records, present(job["affected_paths"]), job["target_commit"])
        stats = changes.counters(told).first().asDict()
        marks = {f"sync {repository_id}": job["id"], f"stats {repository_id}": stats}

        def documents(own: Callable[[str], DataFrame]) -> DataFrame:
            return self.documents(own("symbols"), own("files"), own("repositories"))

        docs = self._located()
        if docs is None:
            self.store.publish({**more, **self._search_tables(documents)}, None, self.cache.rotate, fail_at, repository_id, appended=more, dead=dead, marks=marks, purpose="documents")
            return
        paths = self.spark.createDataFrame([(p,) for p in job["affected_paths"]], "path string")
        self._change(self._replaced(docs, repository_id, paths), documents, repository_id, fail_at, more, dead, marks=marks)

    def _merge(self) -> str | None:
        """Merge the segments that are due; a commit of its own, which changes no answer."""
        reader = self.store.reader()
        names = segments.to_merge(reader.manifest)
        if not names:
            return None
        of = lambda table: reader.rows(table, names)
        have = [t for t in reader.manifest["tables"] if any(s in names for s, _ in reader.manifest["tables"][t])]
        tables: dict[str, Source] = {t: of(t) for t in have if t not in ("docs", "postings")}  # codes are those of the one codebook
        if "docs" in have:
            search = self._search_tables(of("docs"))
            tables |= {"docs": search["docs"], "postings": search["postings"]}
        dead = {t: df for t in reader.manifest["dead_in"] if (df := reader.dead_elsewhere(t, names)) is not None}
        return self.store.publish(tables, None, None, merged=names, dead=dead, purpose="merger")

    def merge(self) -> str | None:
        """Merge the segments that are due; the new generation's name, if any were."""
        with self._writing(None):
            return self._merge()

    def replace_symbols(self, repository_id: int, texts: DataFrame) -> dict:
        """Parse a repository's Python sources (file_id, text; null where there is no regular file) in place of all symbols it has.

        The job stays pending until ``publish_repository`` has published them; meanwhile a repeated call returns its report.
        """
        with self._writing(repository_id):
            if self.journal.pending("sync", repository_id):
                raise RuntimeError("the repository's pending synchronization is to be finished first")
            if job := self.journal.pending("full", repository_id):
                if not job.get("stats"):
                    raise RuntimeError("the repository's pending publication is to be finished first")
                return {**job["stats"], "publication_pending": True, "resumed": True}
            files = self.metadata.read("files").where(F.col("repository_id") == repository_id)
            python = files.where(F.col("language") == "python").select(F.col("id").alias("file_id")).join(texts, "file_id").where("text IS NOT NULL")
            parsed, total = python.count(), files.count()
            n = self.metadata.replace_symbols(repository_id, symbols_of(python))
            stats = {"repository_id": repository_id, "parsed_files": parsed, "skipped_files": total - parsed, "symbols_indexed": n}
            self.journal.begin("full", repository_id, stats=stats)
            return {**stats, "publication_pending": True, "resumed": False}

    def publish_repository(self, repository_id: int, fail_at: str | None = None) -> dict:
        """Publish a repository's symbols beside the other repositories' documents, and end its pending job; a stopped publication is resumed."""
        with self._writing(repository_id) as pending:
            if self.journal.pending("sync", repository_id):
                raise RuntimeError("the repository's pending synchronization is to be finished first")
            job = self.journal.begin("full", repository_id)
            resumed = pending.get("repository_id") == repository_id and pending.get("purpose") == "documents" and pending["phase"] != "building"
            if not resumed:
                own = F.col("repository_id") == repository_id
                self._replace(repository_id, self.documents(self.metadata.read("symbols").where(own), self.metadata.read("files"), self.metadata.read("repositories")), fail_at)
            self.journal.finish("full", repository_id)
            return {**(job.get("stats") or {}), "index": self.store.current(), "resumed": resumed}

    def identity(self) -> tuple[str, str, str | None, int]:
        """What is published: store, generation, its identity, and how many documents it has."""
        name = self.store.current()
        if name is None:
            raise FileNotFoundError("no generation has been published")
        return self.store.folder.uri, name, self.store.identity(name), self.store.read("docs", name).count()

    @staticmethod
    def parse(files: DataFrame) -> DataFrame:
        """Symbols of Python source texts (file_id, text)."""
        return symbols_of(files)

    # -- search

    def _about(self, reader: segments.Reader, name: str) -> dict[str, tuple[int, float]]:
        """A generation's field statistics, a row a field; they do not change."""
        if self._fields[0] != name:
            self._fields = (name, blocks.about(lexical.stats_of(reader.rows("stats"))))
        return self._fields[1]

    def lexical(self, queries: DataFrame, limit: int, generation: str | None = None) -> DataFrame:
        """The best by BM25, with their keys: documents are read for the answers alone."""
        reader = self.store.reader(generation)
        points, dead = blocks.stored(reader)
        best = blocks.search(points, dead, lexical.stats_of(reader.rows("stats")), reader.rows("frequencies"), queries, limit)
        few = limit * queries.limit(BROADCAST_HITS + 1).count() <= BROADCAST_HITS
        return self._keyed(reader, best, few)

    @staticmethod
    def _keyed(reader: segments.Reader, hits: DataFrame, few: bool) -> DataFrame:
        docs = reader.rows("docs").select(F.col("symbol_id").cast("long").alias("id"), *KEYS)
        return docs.join(F.broadcast(hits) if few else hits, "id")

    def semantic(self, queries: DataFrame, limit: int, generation: str | None = None) -> DataFrame:
        reader = self.store.reader(generation)
        asked = queries.select("query_id", "intent", self.embed(F.col("query")).alias("embedding")).where(is_valid(F.col("embedding"), self.dims))
        few = limit * queries.limit(BROADCAST_HITS + 1).count() <= BROADCAST_HITS
        return self._keyed(reader, self._nearest(reader, asked, limit), few)

    def _nearest(self, reader: segments.Reader, asked: DataFrame, limit: int, n: int | None = None) -> DataFrame:
        if reader.has("codes"):
            return quantised.search(reader.rows("codes"), quantised.codebook_of(reader.rows("codebook")), reader.rows("docs"), asked, limit, flag_col="is_test")
        return semantic.search(reader.rows("docs"), asked, limit, self.dims, "symbol_id", filtered="is_test", n=n)

    def _hits(self, queries: DataFrame, depth: int, name: str) -> tuple[DataFrame, bool]:
        """Both branches' hits over one generation, a query's together, and whether they are few. Those of up to LOCAL_QUERIES queries are fetched, the branches side by side, so that what follows plans over few local rows."""
        asked = queries.select("query_id", "intent", analyse(F.col("query")).alias("words"), self.embed(F.col("query")).alias("embedding")).limit(LOCAL_QUERIES + 1).toArrow()
        columns = ["query_id", "lexical", *KEYS, "id", "score", "rank"]
        if len(asked) > LOCAL_QUERIES:
            sides = [hits.withColumn("lexical", F.lit(of_words)).select(*columns) for hits, of_words in ((self.lexical(queries, depth, name), True), (self.semantic(queries, depth, name), False))]
            return sides[0].unionByName(sides[1]).repartition("query_id"), False
        reader, kind = self.store.reader(name), queries.schema["query_id"].dataType
        counts = [(q, t, n, i) for q, i, words in zip(*(asked.column(c).to_pylist() for c in ("query_id", "intent", "words")), strict=True) for t, n in sorted(Counter(words).items())]
        terms = pa.table(dict(zip(("query_id", "term", "times", "intent"), map(list, zip(*counts, strict=True)) if counts else [[]] * 4, strict=True)))
        vectors = self.spark.createDataFrame(asked.select(["query_id", "intent", "embedding"])).where(is_valid(F.col("embedding"), self.dims))

        def by_words() -> pa.Table:
            points, dead = blocks.stored(reader)
            return blocks.one_pass(points, dead, self._about(reader, name), reader.rows("frequencies"), terms, depth, kind).toArrow()

        def by_vector() -> pa.Table:
            # a matrix product, whatever their number
            return self._nearest(reader, vectors, depth, max(len(asked), semantic.MATRIX_QUERIES)).toArrow()

        with ThreadPoolExecutor(2) as pool:
            # what is missing or broken is raised by ``result``
            found = [f.result() for f in [pool.submit(inheritable_thread_target(self.spark)(work)) for work in (by_words, by_vector)]]
        schema = pa.schema([("query_id", found[0].schema.field("query_id").type), ("id", pa.int64()), ("score", pa.float64()), ("rank", pa.int32())])
        rows = pa.concat_tables([t.select(schema.names).cast(schema).append_column("lexical", pa.array([of_words] * len(t), pa.bool_())) for t, of_words in zip(found, (True, False), strict=True)])
        if not len(rows):
            return self.spark.createDataFrame([], T.StructType([queries.schema["query_id"], *T.StructType.fromDDL("lexical boolean, repository string, path string, start_line int, id bigint, score double, rank int")])), True
        return self._keyed(reader, self.spark.createDataFrame(rows), True).select(*columns).repartition(1), True

    def hybrid(self, queries: DataFrame, limit: int = 10, weight: float | None = None) -> DataFrame:
        """Fused hits of a batch (query_id, query, intent): both branches read the one generation that is current now."""
        name = self.store.current()
        if name is None:
            raise FileNotFoundError("no generation has been published")
        hits, few = self._hits(queries, fusion.depth(limit), name)
        fused = fusion.fused_hits(hits, KEYS, self.weight if weight is None else weight, limit).drop(*KEYS)
        few = few or limit * queries.limit(BROADCAST_HITS + 1).count() <= BROADCAST_HITS
        # the wide columns only for the rows that are returned
        docs = self.store.read("docs", name).drop("embedding").withColumn("id", F.col("symbol_id").cast("long")).drop("symbol_id")
        return docs.join(F.broadcast(fused) if few else fused, "id")

    def batch(self, queries: list[str]) -> DataFrame:
        from ..functions.text import query_has_test_intent

        return self.spark.createDataFrame([(k, q, query_has_test_intent(q)) for k, q in enumerate(queries)], "query_id int, query string, intent boolean")

    def _retrieve(self, query: str, limit: int) -> list[dict]:
        if self.spark.conf.get("spark.sql.files.ignoreMissingFiles") == "true" or self.spark.conf.get("spark.sql.files.ignoreCorruptFiles") == "true":
            raise IncompleteSearchError("missing or corrupt files are ignored in this session, so that an answer may lack some")
        try:
            rows = self.hybrid(self.batch([query]), limit).orderBy("rank").drop("query_id", "id", "rank", "file_id", "repository_id").collect()
        except (PySparkException, Py4JJavaError, FileNotFoundError) as e:
            raise IncompleteSearchError("a part of the published generation did not answer") from e
        out = [r.asDict() for r in rows]
        return [{**r, **hit} for r, hit in zip(out, checked(out), strict=True)]

    def search(self, query: str, limit: int = 10) -> dict:
        """One query through the cache; the envelope says how it was answered."""
        check_request(query, limit)
        rows, outcome = self.service.search(query, limit)
        return {"query": query, "limit": limit, "count": len(rows), "cache_hit": outcome == "hit", "cache_coalesced": outcome == "coalesced", "results": rows}

    def reranked(self, queries: DataFrame, limit: int = 10) -> DataFrame:
        rows = self.hybrid(queries, fusion.rerank_depth(limit)).join(queries.select("query_id", "query"), "query_id")
        document = rerank_text(F.col("repository"), F.col("path"), F.col("qualified_name"), F.col("kind"), F.col("code"))
        return fusion.rerank(rows, self.rerank_score(F.col("query"), document), limit)

    # -- evaluation

    def _cases(self, cases: list[tuple[str, str, str]]) -> tuple[DataFrame, DataFrame]:
        if not cases:
            raise ValueError("there are no cases")
        expected = self.spark.createDataFrame([(k, r, e) for k, (r, _, e) in enumerate(cases)], "query_id int, repository string, qualified_name string")
        return self.batch([q for _, q, _ in cases]), expected

    def _named(self, hits: DataFrame) -> DataFrame:
        """Hits of one branch with the identity that cases name."""
        docs = self.store.read().select(F.col("symbol_id").alias("id"), "qualified_name")
        return hits.join(docs, "id").select("query_id", "repository", "qualified_name", F.col("rank").cast("long").alias("rank"))

    def ranks(self, cases: list[tuple[str, str, str]]) -> DataFrame:
        """The first rank at which the hybrid search gives what each (repository, query, qualified name) case expects."""
        queries, expected = self._cases(cases)
        hits = evaluation.checked_results(self.hybrid(queries, 10).select("query_id", "repository", "qualified_name", "rank"), IDENTITY)
        return evaluation.first_rank(hits, expected, IDENTITY)

    def evaluate(self, cases: list[tuple[str, str, str]]) -> DataFrame:
        """Recall and reciprocal rank of the hybrid search."""
        return evaluation.metrics(self.ranks(cases))

    def compare(self, cases: list[tuple[str, str, str]]) -> DataFrame:
        """The same of the four methods, by method."""
        queries, expected = self._cases(cases)
        fused = self.hybrid(queries, 10).select("query_id", *IDENTITY, "rank")
        again = self.reranked(queries, 10).select("query_id", *IDENTITY, F.col("final_rank").alias("rank"))
        methods = {"bm25": self._named(self.lexical(queries, 10)), "semantic": self._named(self.semantic(queries, 10)), "hybrid": fused, "reranked": again}
        return evaluation.by_method({k: v.withColumn("rank", F.col("rank").cast("long")) for k, v in methods.items()}, expected, IDENTITY)

    def diagnose(self, cases: list[tuple[str, str, str]], depth: int = 50, found: int = 10, shown: int = 5) -> DataFrame:
        """Cases that the hybrid search does not answer in its first ``found`` results: the expected symbol's rank in each branch, to ``depth``, and the hybrid search's first ``shown``."""
        queries, expected = self._cases(cases)
        hybrid = self.hybrid(queries, depth).select("query_id", *IDENTITY, "rank")
        out = evaluation.diagnosis({"bm25": self._named(self.lexical(queries, depth)), "semantic": self._named(self.semantic(queries, depth)), "hybrid": hybrid}, expected, IDENTITY, depth, found)
        tops = hybrid.where(F.col("rank") <= shown).groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", *IDENTITY))), lambda x: F.concat_ws(" ", x["repository"], x["qualified_name"])).alias("top"))
        return out.join(tops, "query_id", "left")

    def recommend(self, cases: list[tuple[str, str, str]]) -> DataFrame:
        """The semantic weight that serves these cases best, of ``evaluation.WEIGHTS``, with its metrics: retrieved once, fused once a weight."""
        queries, expected = self._cases(cases)
        name = self.store.current()
        hits, _ = self._hits(queries, fusion.depth(10), name)
        named = self.store.read("docs", name).select(F.col("symbol_id").cast("long").alias("id"), F.col("repository").alias("_repository"), "qualified_name")
        fused = {w: fusion.fused_hits(hits, KEYS, w, 10).select("query_id", "repository", "id", "rank") for w in evaluation.WEIGHTS}
        return evaluation.recommended({w: df.join(named, "id").select("query_id", "repository", "qualified_name", "rank") for w, df in fused.items()}, expected, IDENTITY)
