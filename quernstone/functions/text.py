"""Text derivations as column expressions: no Python runs for any of them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Extensions that are discovered, and their languages.
LANGUAGES = {
    ".py": "python", ".js": "javascript", ".jsx": "javascript", ".ts": "typescript", ".tsx": "typescript", ".java": "java", ".go": "go", ".rs": "rust",
    ".c": "c", ".h": "c", ".cpp": "cpp", ".cc": "cpp", ".hpp": "cpp", ".cs": "csharp", ".rb": "ruby", ".php": "php", ".swift": "swift",
    ".kt": "kotlin", ".kts": "kotlin", ".scala": "scala", ".sh": "shell", ".sql": "sql",
}

WORDS = r"[\p{L}\p{N}_]+"
#: Words as a search analyser breaks them: dots and quotes between letters, and separators between digits, join.
CODE_WORDS = r"[\p{L}\p{N}_]+(?:(?:(?<=\p{L})[.'’](?=\p{L})|(?<=\p{N})[.,'](?=\p{N}))[\p{L}\p{N}_]+)*"
#: Where a line ends; two characters count once.
LINE_BREAK = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"
SPACE = r"(?U)\s+"
PREVIEW_LINES = 40


def analyse(text: Column, pattern: str = WORDS) -> Column:
    """Lower-case words in order; null gives none."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(pattern), F.lit(0))


def language_of(path: Column) -> Column:
    """Language by the last suffix of the file's name; null if it is not one that is discovered."""
    suffix = F.lower(F.regexp_extract(path, r"[^/](\.[^./]*)$", 1))
    table = F.create_map(*(F.lit(x) for pair in LANGUAGES.items() for x in pair))
    return table[suffix]


def is_test_path(path: Column) -> Column:
    p = F.lower(F.translate(path, "\\", "/"))
    name = F.substring_index(p, "/", -1)
    return p.startswith("test/") | p.startswith("tests/") | p.contains("/test/") | p.contains("/tests/") | name.startswith("test_") | name.endswith("_test.py")


def has_test_intent(query: Column) -> Column:
    """Any of the test terms as a substring; all but one of them hold "test"."""
    q = F.lower(query)
    return q.contains("test") | q.contains("sanity check")


def query_has_test_intent(query: str) -> bool:
    q = query.lower()
    return "test" in q or "sanity check" in q


def lines(text: Column) -> Column:
    """Lines without their ends; an end at the end opens no further line."""
    split = F.split(F.coalesce(text, F.lit("")), LINE_BREAK)
    return F.when(F.element_at(split, -1) == "", F.slice(split, 1, F.size(split) - 1)).otherwise(split)


def preview(text: Column, n: int = PREVIEW_LINES) -> Column:
    return F.concat_ws("\n", F.slice(lines(text), 1, n))


#: The labels of a symbol's lines in what is embedded, and of those in what is reranked.
EMBEDDED = ("Symbol: ", "Type: ", "Signature: ", "Repository: ", "File: ", "Language: ", "Implementation:")
RERANKED = ("Repository: ", "File: ", "Symbol: ", "Type: ")
UNKNOWN_LANGUAGE = "unknown"


def embedding_text(name: Column, kind: Column, repository: Column, path: Column, language: Column, code: Column) -> Column:
    """What is embedded for a symbol: labelled lines, then the first lines of its code."""
    first = F.trim(F.coalesce(F.get(lines(code), 0), F.lit("")))
    values = (name, kind, first, repository, path, F.coalesce(language, F.lit(UNKNOWN_LANGUAGE)))
    return F.concat_ws("\n", *(F.concat(F.lit(label), value) for label, value in zip(EMBEDDED, values, strict=False)), F.lit(""), F.lit(EMBEDDED[-1]), preview(code))


def rerank_text(repository: Column, path: Column, name: Column, kind: Column, code: Column) -> Column:
    return F.concat_ws("\n", *(F.concat(F.lit(label), value) for label, value in zip(RERANKED, (repository, path, name, kind), strict=True)), F.lit(""), preview(code))


def is_query(text: Column, most: int = 4096) -> Column:
    """1 to ``most`` characters, not all white space."""
    return F.coalesce(F.length(text).between(1, most) & text.rlike(r"(?U)\S"), F.lit(False))


def cache_digest(query: Column, limit: Column) -> Column:
    """SHA-256 of the query, lower-cased with single spaces, and the limit."""
    return F.sha2(F.concat(F.lower(F.trim(F.regexp_replace(query, SPACE, " "))), F.lit(":"), limit.cast("string")), 256)


_REPO_URL = r"^(?i:https?://(?:www\.)?github\.com)/([A-Za-z0-9_-]+)/([A-Za-z0-9_.-]+?)(?:\.git)?/?$"


def repository_of(url: Column) -> tuple[Column, Column]:
    """(owner, name) of a repository's URL, both null if it is not an accepted one."""
    owner, name = F.regexp_extract(url, _REPO_URL, 1), F.regexp_extract(url, _REPO_URL, 2)
    good = url.rlike(_REPO_URL) & ~url.rlike(r"\n") & ~name.isin("", ".", "..") & ~F.lower(name).isin(".git")
    return F.when(good, owner), F.when(good, name)


def is_safe_path(path: Column) -> Column:
    """The part of path safety that needs no file system: relative, not empty, no parent or .git component."""
    parts = F.split(path, "/")
    return (path != "") & ~path.startswith("/") & ~F.exists(parts, lambda p: p.isin("..", ".git"))


def is_generation_name(name: Column, legacy: str) -> Column:
    """The name of a managed generation of the ``legacy`` index."""
    return name.rlike(rf"^\Q{legacy}_generation_\E[0-9a-f]{{32}}\z")
