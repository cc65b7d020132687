"""Sources, change sets, generations, cache and the engine over a small repository."""

import os
import subprocess
import threading

import pytest
from pyspark.sql import functions as F

from quernstone.operators import changes
from quernstone.operators.cache import FencedCache, SearchService, decode, digest, encode
from quernstone.operators.generations import GenerationStore
from quernstone.operators.hits import IncompleteSearchError
from quernstone.plans.engine import Engine
from quernstone.schema import positive_id
from quernstone.sources import repository, symbols, traces
from quernstone.streaming.sync import change_stream, run_sync

SOURCE = """import io


class Shelf:
    size = 3

    def put(self, book):
        key = lambda b: b.title

        def sort_key(b):
            return key(b)

        return sorted([book], key=sort_key)

    class Label:
        def text(self):
            return "x"

    async def take(self):
        return None


async def lend(shelf):
    class Slip:
        def sign(self):
            pass
    return Slip
"""


def test_symbols_in_preorder():
    found = [(q, k, a, b) for _, q, k, a, b, _ in symbols.parse_symbols(SOURCE)]
    assert found == [
        ("Shelf", "class", 4, 20), ("Shelf.put", "method", 7, 13), ("sort_key", "function", 10, 11), ("Label", "class", 15, 17), ("Label.text", "method", 16, 17),
        ("Shelf.take", "method", 19, 20), ("lend", "function", 23, 27), ("Slip", "class", 24, 26), ("Slip.sign", "method", 25, 26),
    ]
    deep = "total = (" + " * ".join(f"x{k}" for k in range(4000)) + ")\nasync def wait():\n    return total\n"
    assert [(s[1], s[3], s[4], s[5]) for s in symbols.parse_symbols(deep)] == [("wait", 2, 3, "async def wait():\n    return total")]
    assert [s[1] for s in symbols.parse_symbols("class Box:\n    def open(self):\n        return [1,\n\ndef shut(:\n    pass\n")] == ["Box", "Box.open", "shut"]


def test_line_ends_of_all_kinds():
    """A lone carriage return ends a line for the parser, and so it does for the code that is cut out."""
    for end in ("\n", "\r\n", "\r"):
        text = end.join(["x = 1", "def f():", "    return 'é'", "", "class C:", "    def g(self): return 2", ""])
        assert [(s[1], s[3], s[4], s[5].replace(end, "|")) for s in symbols.parse_symbols(text)] == [("f", 2, 3, "def f():|    return 'é'"), ("C", 5, 6, "class C:|    def g(self): return 2"), ("C.g", 6, 6, "def g(self): return 2")]
    assert [s[5] for s in symbols.parse_symbols("s = 'a\x0cb'\x0c\ndef f():\n    pass\n")] == ["def f():\n    pass"]


def test_sources_are_decoded_strictly():
    assert "café" in symbols.read_source(b"# -*- coding: latin-1 -*-\nx = 'caf\xe9'\n")
    assert symbols.read_source(b"\xef\xbb\xbfx = 1\r\ny = 2\r\n") == "x = 1\ny = 2\n"
    for bad in (b"x = '\xff'\n", b"# coding: nothing\n", b"\xef\xbb\xbf# coding: latin-1\n"):
        with pytest.raises((SyntaxError, UnicodeError)):
            symbols.read_source(bad)


def test_symbols_as_a_table(spark):
    df = spark.createDataFrame([(1, SOURCE), (2, None), (3, "x = 1")], "file_id int, text string")
    rows = symbols.symbols_of(df).collect()
    assert len(rows) == 9 and {r["file_id"] for r in rows} == {1} and rows[0]["code"].startswith("class Shelf:")
    data = spark.createDataFrame([("a", bytearray(b"x = 1")), ("b", bytearray(b"def (")), ("c", bytearray(b"'\xff'")), ("d", None)], "path string, content binary")
    assert {r["path"]: r["issue"] for r in symbols.audit(data).collect()} == {"a": "clean", "b": "grammar_recovery", "c": "source_read_error", "d": "unavailable_or_excluded"}


def test_diff_records():
    listing = "".join(f"{x}\0" for x in ("T", "docs/a b.md", "R087", "lib/é.py", "lib/e\t2.py", "D", "line\nend.go", "C055", "x.rs", "y.rs", "A", " z.py"))
    assert changes.parse_diff(listing) == [(0, "T", None, "docs/a b.md"), (1, "R", "lib/é.py", "lib/e\t2.py"), (2, "D", None, "line\nend.go"), (3, "A", None, "y.rs"), (4, "A", None, " z.py")]
    assert changes.parse_diff("A\tone.py\n  \nC090\tone.py\ttwo.py\nR100\told.go\tnew.go\nT\tlink\n", nul=False) == [(0, "A", None, "one.py"), (1, "A", None, "two.py"), (2, "R", "old.go", "new.go"), (3, "T", None, "link")]
    assert changes.parse_diff("") == [] == changes.parse_diff("\n", nul=False)
    for bad in ("A\0x.py", "C100\0from.py\0", "D\0\0", "X\0x.py\0", "R\0a\0b\0", "R1x\0a\0b\0", "A\tx.py\0"):
        with pytest.raises(ValueError):
            changes.parse_diff(bad)
    for bad in ("A\tx.py\ty.py", "R100\tx.py", "M x.py", "A\t"):
        with pytest.raises(ValueError):
            changes.parse_diff(bad, nul=False)


def test_classification(spark):
    feed = spark.createDataFrame([(0, "A", None, "new.py"), (1, "M", None, "old.py"), (2, "D", None, "gone.txt"), (3, "R", "was.py", "now.py"), (4, "M", None, "x.txt"), (5, "T", None, "link.py"), (6, "A", None, "old2.py")], "ordinal int, status string, old_path string, path string")
    files = spark.createDataFrame([("old.py",), ("link.py",), ("old2.py",)], "path string")
    there = spark.createDataFrame([("new.py",), ("old.py",), ("now.py",), ("old2.py",)], "path string")
    rows = changes.classify(feed, files, there)
    assert [r["action"] for r in rows.orderBy("ordinal").collect()] == ["add", "modify", "delete", "rename", "ignore", "delete", "replace"]
    c = changes.counters(rows).first()
    assert (c["files_added"], c["files_modified"], c["files_deleted"], c["files_renamed"], c["files_parsed"]) == (1, 1, 2, 1, 4)
    assert [r["path"] for r in changes.affected_paths(feed).collect()] == sorted({"new.py", "old.py", "gone.txt", "was.py", "now.py", "x.txt", "link.py", "old2.py"})
    assert changes.repeated_paths(feed.union(feed)).count() == 7


def test_discovery_and_change_feed(spark, tmp_path):
    root = tmp_path / "tree"
    (root / ".git").mkdir(parents=True)
    (root / "pkg" / ".git").mkdir(parents=True)
    (root / "safe.py").write_text("x = 1")
    (root / "pkg" / "B.TS").write_text("let x")
    (root / "pkg" / ".git" / "hook.py").write_text("no")
    (root / "readme.md").write_text("no")
    (root / "link.py").symlink_to(root / "safe.py")
    (root / "far").symlink_to(tmp_path)
    rows = {r["path"]: (r["language"], len(r["content_hash"])) for r in repository.discover(spark, str(root)).collect()}
    assert rows == {"safe.py": ("python", 64), "pkg/B.TS": ("typescript", 64)}
    assert repository.is_safe_file(str(root), "safe.py") and not any(repository.is_safe_file(str(root), p) for p in ("link.py", "../tree/safe.py", "/etc/hosts", "", ".git", "far/x"))

    repo = tmp_path / "repo"
    git = lambda *a: subprocess.run(["git", "-C", str(repo), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    repo.mkdir()
    git("init", "-q")
    (repo / "a.py").write_text("x = 1\n" * 20)
    (repo / "b.py").write_text("y = 1\n")
    git("add", ".")
    git("commit", "-qm", "1")
    old = repository.head(str(repo))
    os.rename(repo / "a.py", repo / "c d.py")
    (repo / "b.py").unlink()
    git("add", "-A")
    git("commit", "-qm", "2")
    feed = repository.change_feed(spark, str(repo), old, repository.head(str(repo))).collect()
    assert {(r["status"], r["old_path"], r["path"]) for r in feed} == {("R", "a.py", "c d.py"), ("D", None, "b.py")}
    with pytest.raises(FileExistsError):
        repository.clone(str(repo), str(tmp_path / "clones"), "o", "r") and repository.clone(str(repo), str(tmp_path / "clones"), "o", "r")
    with pytest.raises(ValueError):
        repository.clone("x", str(tmp_path), "..", "r")


@pytest.mark.parametrize("at", ["built", "ready", "switched", "published"])
def test_a_stopped_publication_is_resumed_and_the_next_one_is_its_own(spark, tmp_path, at):
    from quernstone.operators.generations import PublicationPending

    store, rotated = GenerationStore(spark, str(tmp_path / "s")), []
    rotate = lambda: rotated.append(1)
    one = store.publish({"docs": spark.range(3)}, {"docs": 3})
    with pytest.raises(InterruptedError):
        store.publish({"docs": spark.range(5)}, fail_at=at, repository_id=4)
    switched = at in ("switched", "published")
    assert store.read().count() == (5 if switched else 3)
    if at != "built":
        with pytest.raises(PublicationPending):
            store.publish({"docs": spark.range(7)})
    with pytest.raises(PublicationPending):
        store.resume(repository_id=5)
    two = store.resume(rotate, 4)
    assert (two is None) == (at == "built") and store.pending() is None and store.resume(rotate) is None
    assert store.read().count() == (3 if at == "built" else 5) and rotated == ([] if at == "built" else [1])
    three = store.publish({"docs": spark.range(7)}, after=rotate)
    assert store.current() == three and store.read().count() == 7 and len(rotated) == (1 if at == "built" else 2)
    states = {k: v["state"] for k, v in store.lifecycle().items()}
    assert states[three] == "published" and states[one] == "retired" and sorted(states.values()) == sorted(["published", "retired", "abandoned" if at == "built" else "retired"])
    with pytest.raises(RuntimeError):
        store.publish({"docs": spark.range(5)}, {"docs": 6})


def test_a_changed_or_foreign_generation_is_not_published(spark, tmp_path):
    store = GenerationStore(spark, str(tmp_path / "s"))
    store.publish({"docs": spark.range(3)})
    with pytest.raises(InterruptedError):
        store.publish({"docs": spark.range(5)}, fail_at="ready")
    name = store.pending()["name"]
    identity = store.folder.read(f"{name}/identity.json")
    store.folder.write(f"{name}/identity.json", {"uuid": "another"})
    with pytest.raises(RuntimeError, match="recorded"):
        store.resume()
    store.folder.write(f"{name}/identity.json", identity)
    spark.range(1).write.mode("append").parquet(store.folder.at(name, "docs"))
    with pytest.raises(RuntimeError, match="changed"):
        store.resume()
    assert store.read().count() == 3


def test_a_store_on_another_file_system(spark, tmp_path):
    """The same store by a path that only Hadoop's file systems reach."""
    from quernstone.plans.engine import Engine

    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.far.link./in", f"file://{tmp_path}")
    store = GenerationStore(spark, "viewfs://far/in/store")
    assert store.current() is None and store.folder.folders() == []
    with pytest.raises(InterruptedError):
        store.publish({"docs": spark.range(5)}, fail_at="switched")
    name = store.resume()
    assert store.current() == name and store.read().count() == 5 and store.folder.folders() == [name] and store.lifecycle()[name]["state"] == "published"
    store.folder.delete(name)
    with pytest.raises(FileNotFoundError):
        store.current()
    with pytest.raises(ValueError):
        Engine(spark, "viewfs://far/in/engine")


def test_cache_is_fenced():
    now = [0.0]
    cache = FencedCache(clock=lambda: now[0])
    rows = [{"a": 1, "b": [0.5, None]}]
    _, token = cache.read("Q  x", 10)
    assert cache.fill("q X", 10, token, rows) and cache.read(" q x ", 10)[0] == rows and cache.read("q x", 9)[0] is None
    cache.rotate()
    assert cache.read("q x", 10)[0] is None and not cache.fill("q x", 10, token, rows)
    _, token = cache.read("q", 10)
    assert not cache.fill("q", 10, token, [{"a": float("nan")}]) and not cache.fill("q", 1, token, rows * 2)
    assert cache.fill("q", 10, token, rows)
    now[0] = 301
    assert cache.read("q", 10)[0] is None
    for bad in ('[{"a": 1, "a": 2}]', "[{}, {}]", '[{"a": NaN}]', '[{"a": 1e999}]', "{}", "[1]", '[{"a":' + "[" * 20 + "]" * 20 + "}]"):
        with pytest.raises(ValueError):
            decode(bad, 1)
    assert decode(encode(rows, 1), 1) == rows and len(digest("a", 1)) == 64


def test_equal_queries_share_one_retrieval():
    began, go, calls = threading.Event(), threading.Event(), []

    def retrieve(query, limit):
        calls.append(query)
        began.set()
        go.wait(5)
        return [{"q": query}]

    service = SearchService(retrieve, FencedCache(), wait=5)
    out = []
    first = threading.Thread(target=lambda: out.append(service.search("q", 1)[1]))
    first.start()
    began.wait(5)
    rest = [threading.Thread(target=lambda: out.append(service.search("q", 1)[1])) for _ in range(5)]
    for t in rest:
        t.start()
    import time

    time.sleep(0.2)
    go.set()
    for t in [first, *rest]:
        t.join()
    assert len(calls) == 1 and sorted(out) == ["coalesced"] * 5 + ["retrieved"]
    assert service.search("q", 1)[1] == "hit" and service.search("q", 1, bypass=True)[1] == "bypass"
    for bad in (("", 1), ("  ", 1), ("x" * 4097, 1), ("q", 0), ("q", 101), ("q", True)):
        with pytest.raises(ValueError):
            service.search(*bad)


def test_ingestion_refuses_what_is_there_and_follows_the_remote(spark, tmp_path):
    from quernstone.operators.metadata import Metadata, RepositoryConflict

    origin = tmp_path / "origin"
    git = lambda *a: subprocess.run(["git", "-C", str(origin), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    origin.mkdir()
    git("init", "-q", "-b", "trunk")
    (origin / "a.py").write_text("x = 1\n")
    git("add", ".")
    git("commit", "-qm", "1")
    metadata, root, url = Metadata(spark, str(tmp_path / "m")), str(tmp_path / "clones"), "https://github.com/some-one/tool.git"
    out = repository.ingest(metadata, url, root, f"file://{origin}")
    assert (out["repository_id"], out["owner"], out["name"], out["branch"], out["source_files_discovered"]) == (1, "some-one", "tool", "trunk", 1)
    assert [(r["path"], r["language"]) for r in metadata.read("files").collect()] == [("a.py", "python")]
    for again in (url, "https://github.com/some-one/tool"):
        with pytest.raises(RepositoryConflict):
            repository.ingest(metadata, again, root, f"file://{origin}")
    for bad in ("https://example.com/o/r", "https://github.com/o", "https://github.com/o/..git", url + "\n"):
        with pytest.raises(ValueError):
            repository.ingest(metadata, bad, root)
    (tmp_path / "clones" / "linked").symlink_to(tmp_path)
    with pytest.raises(ValueError):
        repository.is_taken(root, "linked", "x")
    with pytest.raises(ValueError):
        repository.clone(f"file://{origin}", root, "linked", "x")
    (tmp_path / "clones" / "plain").write_text("")
    for bad in (("plain", "x"), ("a/b", "x"), ("..", "x"), ("o", "."), ("o", ""), ("o", "a\\b")):
        with pytest.raises(ValueError):
            repository.is_taken(root, *bad)
    assert repository.is_taken(root, "some-one", "tool") and not repository.is_taken(root, "some-one", "other") and not repository.is_taken(str(tmp_path / "none"), "a", "b")
    with pytest.raises(subprocess.CalledProcessError):
        repository.ingest(metadata, "https://github.com/some-one/gone", root, f"file://{tmp_path}/nothing")
    assert not (tmp_path / "clones" / "some-one" / "gone").exists()
    (origin / "b.py").write_text("y = 1\n")
    git("add", ".")
    git("commit", "-qm", "2")
    new = repository.remote_head(out["local_path"], "trunk")
    assert new != out["commit"] and [(r["status"], r["path"]) for r in repository.change_feed(spark, out["local_path"], out["commit"], new).collect()] == [("A", "b.py")]


def test_ids():
    assert positive_id(7) == 7
    for bad in (0, -1, 2**31, True, "1", 1.0):
        with pytest.raises(ValueError):
            positive_id(bad)


def test_engine_end_to_end(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "e"), dims=32)
    files = spark.createDataFrame([(1, 1, "pkg/core.py", "python"), (2, 1, "tests/test_core.py", "python")], "id int, repository_id int, path string, language string")
    repos = spark.createDataFrame([(1, "demo"), (2, "other")], "id int, name string")
    syms = spark.createDataFrame(
        [(1, 1, 1, "open_socket", "open_socket", "function", 1, 2, "def open_socket():\n    return socket"), (2, 1, 1, "close", "Conn.close", "method", 4, 5, "def close(self):\n    socket.close()"), (3, 1, 2, "test_open", "test_open", "function", 1, 2, "def test_open():\n    open_socket()")],
        "id int, repository_id int, file_id int, name string, qualified_name string, kind string, start_line int, end_line int, code string",
    )
    docs = engine.documents(syms, files, repos)
    engine.index(docs, 3)
    out = engine.search("open_socket", 5)
    names = [r["qualified_name"] for r in out["results"]]
    assert names[0] == "open_socket" and "test_open" not in names and out["cache_hit"] is False
    assert engine.search(" OPEN_socket ", 5)["cache_hit"] is True
    assert "test_open" in [r["qualified_name"] for r in engine.search("test open_socket", 5)["results"]]
    m = engine.evaluate([("demo", "open_socket", "open_socket"), ("demo", "close", "Conn.close"), ("demo", "nothing", "no")]).first()
    assert m["cases"] == 3 and m["recall_10"] == round(2 / 3, 6)
    assert engine.reranked(engine.batch(["close socket"]), 2).orderBy("final_rank").first()["qualified_name"] == "Conn.close"
    feed = spark.createDataFrame([(0, "D", None, "tests/test_core.py")], "ordinal int, status string, old_path string, path string")
    engine.sync(1, feed, docs.limit(0))
    assert engine.store.read().count() == 2 and engine.search("open_socket", 5)["cache_hit"] is False
    cases = [("demo", "open_socket", "open_socket"), ("demo", "close", "Conn.close"), ("demo", "test open_socket", "gone")]
    rows = {r["method"]: r["recall_10"] for r in engine.compare(cases).collect()}
    assert set(rows) == {"bm25", "semantic", "hybrid", "reranked"} and rows["hybrid"] == round(2 / 3, 6)
    missed = engine.diagnose(cases).collect()
    assert [(r["qualified_name"], r["hybrid_rank"], len(r["top"])) for r in missed] == [("gone", None, 2)]
    best = engine.recommend(cases[:2]).collect()
    assert len(best) == 1 and best[0]["recall_10"] == 1.0 and best[0]["cases"] == 2 and 0.5 <= best[0]["weight"] <= 1.0
    from quernstone.operators import evaluation

    assert evaluation.recall_gate(engine.ranks(cases), 2 / 3) and not evaluation.recall_gate(engine.ranks(cases), 0.67)
    assert evaluation.release_gate([("quality", lambda: True), ("rows", lambda: None)], engine.identity)["checks"] == ["quality", "rows"]
    for checks in ([("no", lambda: False)], [("no", lambda: 1 / 0)], [("moves", lambda: engine.reindex_repository(1, docs.limit(1)))]):
        with pytest.raises(evaluation.GateFailed):
            evaluation.release_gate(checks, engine.identity)
    spark.conf.set("spark.sql.files.ignoreMissingFiles", "true")
    try:
        with pytest.raises(IncompleteSearchError):
            engine.search("never asked", 5)
    finally:
        spark.conf.unset("spark.sql.files.ignoreMissingFiles")
    engine.store.folder.delete(f"{engine.store.current()}/postings")
    with pytest.raises(IncompleteSearchError):
        engine.search("never asked either", 5)
    with pytest.raises(ValueError):
        engine.sync(1, feed.union(feed), docs.limit(0))


def test_a_stopped_sync_loses_nothing(spark, tmp_path):
    """A sync that is stopped at any point is replayed, and another repository waits for it."""
    from quernstone.operators.generations import PublicationPending
    from quernstone.operators.locking import WriterBusy, writer

    schema = "symbol_id int, repository_id int, file_id int, repository string, language string, path string, is_test boolean, name string, qualified_name string, kind string, start_line int, end_line int, code string, embedding array<float>"
    row = lambda k, repo, path: (k, repo, 1, f"r{repo}", "python", path, False, f"f{k}", f"f{k}", "function", 1, 2, f"def f{k}(): pass", [1.0, float(k)])
    frame = lambda *rows: spark.createDataFrame(rows, schema)
    engine = Engine(spark, str(tmp_path / "e"), dims=2)
    engine.index(frame(row(1, 1, "a.py"), row(2, 1, "b.py"), row(3, 2, "a.py")), 3)
    paths = []
    fresh = lambda p: paths.append(p) or frame(row(4, 1, "a.py"))
    for at in ("built", "ready", "switched", "published"):
        with pytest.raises(InterruptedError):
            engine.synchronise(1, lambda: ("one", "two"), lambda *c: ["a.py"], fresh, at)
        if at != "built":
            with pytest.raises((PublicationPending, WriterBusy)):
                engine.sync(2, spark.createDataFrame([(0, "D", None, "a.py")], "ordinal int, status string, old_path string, path string"), frame().limit(0))
        report = engine.synchronise(1, lambda: ("one", "three"), lambda *c: ["other.py"], fresh)
        assert report == {"changed": True, "paths": 1, "target_commit": "two"} and paths[-1] == ["a.py"]
        assert {(r["symbol_id"], r["path"]) for r in engine.store.read().collect()} == {(4, "a.py"), (2, "b.py"), (3, "a.py")}
    with writer(engine.coordination, 1, True), pytest.raises(WriterBusy):
        engine.index(frame(row(1, 1, "a.py")))
    assert engine.synchronise(1, lambda: ("x", "x"), None, None) == {"changed": False, "paths": 0}


def test_symbols_are_replaced_and_published_as_one_job(spark, tmp_path):
    from quernstone.operators.metadata import RepositoryConflict

    engine = Engine(spark, str(tmp_path / "e"), dims=8)
    found = spark.createDataFrame([("a.py", "python", "h1"), ("b.go", "go", "h2"), ("c.py", "python", "h3")], "path string, language string, content_hash string")
    assert [engine.metadata.register(n, f"https://github.com/o/{n}", "main", "c0", found) for n in ("one", "two")] == [1, 2]
    with pytest.raises(RepositoryConflict):
        engine.metadata.register("one", "https://github.com/o/one", "main", "c0", found)
    files = {(r["repository_id"], r["path"]): r["id"] for r in engine.metadata.read("files").collect()}
    assert sorted(files.values()) == list(range(1, 7))
    texts = spark.createDataFrame([(files[1, "a.py"], "def f():\n    pass\nclass C:\n    def g(self): pass\n"), (files[1, "b.go"], "func f() {}"), (files[1, "c.py"], None)], "file_id int, text string")
    report = engine.replace_symbols(1, texts)
    assert report == {"repository_id": 1, "parsed_files": 1, "skipped_files": 2, "symbols_indexed": 3, "publication_pending": True, "resumed": False}
    assert engine.replace_symbols(1, texts.limit(0)) == {**report, "resumed": True}
    with pytest.raises(InterruptedError):
        engine.publish_repository(1, "ready")
    out = engine.publish_repository(1)
    assert out["resumed"] and out["symbols_indexed"] == 3 and engine.store.read().count() == 3 and engine.journal.pending("full", 1) is None
    engine.replace_symbols(2, spark.createDataFrame([(files[2, "a.py"], "def h(): pass")], "file_id int, text string"))
    assert not engine.publish_repository(2)["resumed"] and {r["repository"] for r in engine.store.read().select("repository").collect()} == {"one", "two"}
    assert sorted(r["id"] for r in engine.metadata.read("symbols").collect()) == [1, 2, 3, 4]
    engine.replace_symbols(1, texts.limit(0))
    engine.publish_repository(1)
    assert [r["name"] for r in engine.store.read().collect()] == ["h"] and engine.metadata.read("symbols").count() == 1
    with pytest.raises(ValueError):
        engine.metadata.replace_symbols(9, texts)


def test_change_stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "1.json").write_text('{"ordinal": 0, "status": "M", "path": "a.py"}\n{"ordinal": 1, "status": "D", "path": "b.py"}\n')
    seen = {}
    run_sync(change_stream(spark, str(folder)), lambda df, k: seen.update({k: df.count()}), str(tmp_path / "ck")).awaitTermination()
    (folder / "2.json").write_text('{"ordinal": 0, "status": "A", "path": "c.py"}\n')
    run_sync(change_stream(spark, str(folder)), lambda df, k: seen.update({k: df.count()}), str(tmp_path / "ck")).awaitTermination()
    assert seen == {0: 2, 1: 1}


def capture(flows, address="10.0.0.5", between="IP", noise=True):
    """Lines of (port, time, requests) flows: each request is acknowledged after 1 ms and answered after the given ones."""
    lines = []
    for port, at, asked in flows:
        for sent, size, after, answer in asked:
            t = at + sent
            lines += [(t, f"{t:.6f} {between} {address}.{port} > 10.0.0.9.9200: Flags [P.], seq 1, length {size}"), (t + 0.001, f"{t + 0.001:.6f} {between} 10.0.0.9.9200 > {address}.{port}: Flags [.], ack 1, length 0")]
            lines.append((t + after, f"{t + after:.6f} {between} 10.0.0.9.9200 > {address}.{port}: Flags [P.], seq 1, length {answer}"))
    text = [x for _, x in sorted(lines)]
    return [(x,) for x in (["tcpdump: listening", *text, "1.0 ARP, Request who-has 10.0.0.9", "x IP a > b: Flags [P], length 3"] if noise else text)]


def test_trace_blocks(spark):
    from quernstone.sources.traces import Workload

    once = [(40_000 + k, 10.0 + k, [(0, 64, 0.002 + k / 1000, 512)]) for k in range(6)]
    twice = [(50_000 + k, 30.0 + k, [(0, 300, 0.010, 9_000), (0.020 + k / 1000, 64, 0.004, 512)]) for k in range(6)]
    flows = traces.measured(traces.packets(spark.createDataFrame(capture(once + twice), "line string")))
    work = Workload(9200, 64, 512, 5_000)
    rows = traces.block_means(traces.checked(flows, work), 2, 1, 2).orderBy("connection", "block").collect()
    assert [tuple(r) for r in rows] == [("fresh", 1, 2, 1.0, 3.5, None), ("fresh", 2, 2, 1.0, 6.5, None), ("reused", 1, 2, 1.0, 4.0, 11.5), ("reused", 2, 2, 1.0, 4.0, 14.5)]
    short = traces.measured(traces.packets(spark.createDataFrame(capture(once[:5] + twice), "line string")))
    for bad in (traces.block_means(short, 2, 1, 2), traces.checked(flows, Workload(9200, 64, 513)), traces.checked(flows, Workload(9200, 64, 512, 9_001))):
        with pytest.raises(Exception, match="blocks in full|not complete|missing"):
            bad.collect()
    with pytest.raises(ValueError):
        traces.in_blocks(flows, 0, 1)


def test_traces_of_two_sides_are_paired(spark):
    flows = [(40_000 + k, 10.0 + k, [(0, 64, 0.002, 512)]) for k in range(4)]
    inside = [(60_000 + k, 900.0 + k, [(0, 64, 0.0005, 512)]) for k in range(4)]
    side = lambda f, **how: traces.measured(traces.packets(spark.createDataFrame(capture(f, **how), "line string")))
    rows = traces.compared(side(flows), side(inside, address="172.18.0.3", between="eth0  In  IP"), 2, 0, 2).orderBy("block").collect()
    assert [(r["block"], r["flows"], r["host_response_ms"], r["inner_response_ms"]) for r in rows] == [(1, 2, 2.0, 0.5), (2, 2, 2.0, 0.5)]
    for other in (inside[:3], [*inside[:3], (60_003, 903.0, [(0, 64, 0.0005, 513)])]):
        with pytest.raises(Exception, match="differ|blocks"):
            traces.compared(side(flows), side(other), 2, 0).collect()


def test_entry_imports_without_the_subpackage(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    import shutil

    for name in ("quernstone", "__spark_entry__.py"):
        src = os.path.join(root, name)
        (shutil.copytree if os.path.isdir(src) else shutil.copy)(src, tmp_path / name, **({"ignore": shutil.ignore_patterns("llm", "__pycache__")} if os.path.isdir(src) else {}))
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 60 and not any(n.startswith('op') for n in q)"
    subprocess.run([os.sys.executable, "-c", code], check=True, cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)})


def test_window_outcomes(spark):
    from quernstone.streaming.sync import windowed_outcomes

    df = spark.createDataFrame([("2024-01-01 00:10:00", "hit", 1.0), ("2024-01-01 00:50:00", "hit", 3.0), ("2024-01-01 01:10:00", "hit", 5.0)], "ts string, event_type string, value double").withColumn("ts", F.to_timestamp("ts"))
    assert sorted((r["n"], r["mean"]) for r in windowed_outcomes(df).collect()) == [(1, 5.0), (2, 2.0)]


def test_hits_are_checked_whole():
    from quernstone.operators.hits import InvalidSearchResponseError, checked, score_of

    good = {"repository": "r", "path": "p", "name": "n", "qualified_name": "q", "kind": "k", "code": "c", "start_line": 1, "end_line": 2}
    assert checked([good])[0] == {"score": 0.0, **good, "language": None, "is_test": False}
    for key, bad in (("path", None), ("start_line", True), ("start_line", 0), ("end_line", "2"), ("end_line", 0), ("language", []), ("is_test", 1), ("score", "1.0"), ("score", True), ("score", float("nan")), ("score", 10**400)):
        with pytest.raises(InvalidSearchResponseError):
            checked([good, {**good, key: bad}])
    assert [score_of(x) for x in (None, 0, -1.5, 2)] == [0.0, 0.0, -1.5, 2.0]


def test_writers_exclude_each_other(tmp_path):
    from quernstone.operators.locking import WriterBusy, writer

    root = str(tmp_path)
    with writer(root, 1), writer(root, 2):
        for args in ((1,), (3, True)):
            with pytest.raises(WriterBusy), writer(root, *args):
                pass
    with writer(root, 1, True), pytest.raises(WriterBusy), writer(root, 2):
        pass
    (tmp_path / "publication.json").write_text('{"repository_id": 1}')
    with writer(root, 1, True):
        pass
    for args in ((1,), (2, True)):
        with pytest.raises(WriterBusy), writer(root, *args):
            pass


def test_a_sync_is_replayed_until_it_ends(tmp_path):
    from quernstone.operators import jobs

    journal, applied = jobs.Journal(str(tmp_path)), []

    def fail(job):
        raise OSError("stopped")

    with pytest.raises(OSError):
        jobs.run_sync(journal, 1, lambda: ("a", "b"), lambda *c: ["y", "x", "x"], fail)
    assert jobs.inspect(journal)["jobs"] == [{"kind": "sync", "repository_id": 1, "paths": 2, "blocked": None}]
    out = jobs.run_sync(journal, 1, lambda: ("a", "c"), lambda *c: ["z"], applied.append)
    assert out == {"changed": True, "paths": 2, "target_commit": "b"} and applied[0]["affected_paths"] == ["x", "y"]
    assert jobs.run_sync(journal, 1, lambda: ("b", "b"), None, None) == {"changed": False, "paths": 0} and jobs.inspect(journal)["jobs"] == []
    journal.begin("full", 2)
    with pytest.raises(RuntimeError):
        journal.begin("sync", 2, affected_paths=[])
    assert jobs.inspect(journal, {"phase": "ready", "repository_id": 1})["jobs"][0]["blocked"] == "a publication is pending"


def test_retention_deletes_only_what_was_reviewed(spark, tmp_path):
    import datetime as dt

    from quernstone.operators import generations, retention

    store = GenerationStore(spark, str(tmp_path / "s"))
    names = [store.publish({"docs": spark.range(k)}) for k in range(1, 5)]
    soon, later = dt.datetime.now(dt.timezone.utc), dt.datetime.now(dt.timezone.utc) + dt.timedelta(hours=25)
    assert retention.plan(store, soon)["candidates"] == []
    plan = retention.plan(store, later)
    assert [c["name"] for c in plan["candidates"]] == [names[0]]
    with pytest.raises(retention.RetentionBlocked):
        retention.apply(store, plan, later)
    bad = {**plan, "candidates": [{**plan["candidates"][0], "uuid": "x"}]}
    reasons = {r["name"]: r["reasons"] for r in generations.protections(retention.inventory(store), F.lit(later), store.legacy).collect()}
    assert reasons[names[0]] == [] and reasons[names[1]] == ["retained published generation"] and reasons[names[3]] == ["active index", "referenced by an alias", "lifecycle state published", "inactive timestamp unknown"]
    with pytest.raises(retention.RetentionBlocked):
        retention.apply(store, bad, later, quiesced=True)
    assert retention.apply(store, plan, later, quiesced=True)["deleted"] == [names[0]]
    assert retention.apply(store, plan, later, quiesced=True)["already_absent"] == [names[0]]
    assert store.current() == names[-1] and store.read().count() == 4 and store.lifecycle()[names[0]]["state"] == "deleted"
    with pytest.raises(ValueError):
        retention.plan(store, later, 0, 2)
