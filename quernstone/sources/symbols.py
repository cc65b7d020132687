"""Python symbols as a table function: classes, methods and functions with their exact source."""

from __future__ import annotations

import ast
import io
import re
import tokenize

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FIELDS = "name string, qualified_name string, kind string, start_line int, end_line int, code string"


def read_source(data: bytes) -> str:
    """Text by the declared encoding or byte-order mark; invalid bytes raise, line ends become newlines."""
    encoding, _ = tokenize.detect_encoding(io.BytesIO(data).readline)
    return io.TextIOWrapper(io.BytesIO(data), encoding, errors="strict", newline=None).read()


#: Where the parser ends a line; a form feed and the separators of Unicode do not.
_LINE = re.compile(r"[^\r\n]*(?:\r\n|\r|\n|\Z)")


def _slice(lines: list[str], node: ast.AST) -> str:
    """The node's own text; ``lines`` keep their ends."""
    first, last = node.lineno - 1, node.end_lineno - 1
    part = lines[first : last + 1]
    part[-1] = part[-1].encode()[: node.end_col_offset].decode()
    part[0] = part[0].encode()[node.col_offset :].decode()
    return "".join(part)


def _by_indent(text: str) -> list[tuple]:
    """Symbols of a text that does not parse: headers by indentation."""
    lines, out = text.split("\n"), []
    stack: list[tuple[int, str, str]] = []
    for k, line in enumerate(lines):
        m = re.match(r"(\s*)(?:(class)|(?:async\s+)?def)\s+([A-Za-z_]\w*)\s*[(:]", line)
        if not m:
            continue
        indent = len(m[1].expandtabs())
        end = k
        for j in range(k + 1, len(lines)):
            if lines[j].strip():
                if len(lines[j]) - len(lines[j].lstrip()) <= indent:
                    break
                end = j
        while stack and stack[-1][0] >= indent:
            stack.pop()
        kind = "class" if m[2] else "method" if stack and stack[-1][1] == "class" else "function"
        qualified = f"{stack[-1][2]}.{m[3]}" if kind == "method" else m[3]
        stack.append((indent, kind, m[3]))
        out.append((m[3], qualified, kind, k + 1, end + 1, "\n".join([lines[k].lstrip(), *lines[k + 1 : end + 1]])))
    return out


def parse_symbols(text: str) -> list[tuple]:
    """(name, qualified name, kind, first line, last line, code), parents before children, in source order."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return _by_indent(text)
    lines, out = _LINE.findall(text), []
    stack: list[tuple[ast.AST, str | None, bool]] = [(tree, None, False)]
    while stack:
        node, owner, in_function = stack.pop()
        if isinstance(node, ast.ClassDef):
            out.append((node.name, node.name, "class", node.lineno, node.end_lineno, _slice(lines, node)))
            owner, in_function = node.name, False
        elif isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            method = owner is not None and not in_function
            out.append((node.name, f"{owner}.{node.name}" if method else node.name, "method" if method else "function", node.lineno, node.end_lineno, _slice(lines, node)))
            in_function = True
        stack += [(child, owner, in_function) for child in reversed(list(ast.iter_child_nodes(node)))]
    return sorted(out, key=lambda s: s[3]) if out else out


def symbols_of(files: DataFrame, text: str = "text", keys: tuple[str, ...] = ("file_id",)) -> DataFrame:
    """(*keys, symbol fields) of every source text; Arrow batches in, Arrow batches out."""
    import pyspark.sql.types as T

    kept = files.select(*keys, text)
    schema = T.StructType([*(kept.schema[k] for k in keys), *T.StructType.fromDDL(FIELDS)])

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for batch in batches:
            at, rows = [], []
            for k, source in enumerate(batch.column(len(keys)).to_pylist()):
                found = parse_symbols(source) if source else []
                at += [k] * len(found)
                rows += found
            if rows:
                own = [c.cast(f.type) for c, f in zip((batch.column(i).take(pa.array(at)) for i in range(len(keys))), arrow, strict=False)]
                yield pa.RecordBatch.from_arrays([*own, *(pa.array(c, arrow.field(len(keys) + i).type) for i, c in enumerate(zip(*rows, strict=True)))], schema=arrow)

    return kept.mapInArrow(run, schema)


def audit(files: DataFrame, content: str = "content", path: str = "path") -> DataFrame:
    """(path, issue) of each source: unreadable, recovered or clean."""

    @F.arrow_udf("string")
    def issue(data):
        out = []
        for b in data.to_pylist():
            if b is None:
                out.append("unavailable_or_excluded")
                continue
            try:
                text = read_source(b)
            except (SyntaxError, UnicodeError, LookupError):
                out.append("source_read_error")
                continue
            try:
                ast.parse(text)
                out.append("clean")
            except (SyntaxError, ValueError, RecursionError, MemoryError):
                out.append("grammar_recovery")
        return pa.array(out, pa.string())

    return files.select(path, issue(F.col(content)).alias("issue"))


def read_sources(files: DataFrame, content: str = "content", keys: tuple[str, ...] = ("path",)) -> DataFrame:
    """(*keys, text, error) of source bytes, by their declared encoding; text is null where they cannot be read, and error says why."""

    @F.arrow_udf("struct<text:string,error:string>")
    def read(data):
        texts, errors = [], []
        for b in data.to_pylist():
            try:
                texts.append(None if b is None else read_source(b))
                errors.append("no content" if b is None else None)
            except (SyntaxError, UnicodeError):
                texts.append(None)
                errors.append("cannot be decoded")
        return pa.StructArray.from_arrays([pa.array(texts, pa.string()), pa.array(errors, pa.string())], ["text", "error"])

    return files.select(*keys, read(F.col(content)).alias("r")).select(*keys, "r.text", "r.error")


def parse_counts(files: DataFrame, symbols: DataFrame, by: str = "repository_id", key: str = "file_id") -> DataFrame:
    """By repository: parsed_files (Python with a text), skipped_files (all others) and symbols_indexed."""
    parsed = (F.col("language") == "python") & F.col("text").isNotNull()
    found = symbols.groupBy(key).agg(F.count("*").alias("_n"))
    rows = files.join(found, key, "left")
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    good = F.coalesce(parsed, F.lit(False))
    return rows.groupBy(by).agg(n(good).alias("parsed_files"), n(~good).alias("skipped_files"), n(F.when(good, F.col("_n"))).alias("symbols_indexed"))
