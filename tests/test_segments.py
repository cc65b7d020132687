"""Segments, their merger, stored blocks, and syncs that follow a repository in one commit."""

import os
import random

import pytest
from pyspark.sql import functions as F

from quernstone.operators import blocks, lexical, segments
from quernstone.plans.engine import Engine

DOC = "symbol_id int, repository_id int, file_id int, repository string, language string, path string, is_test boolean, name string, qualified_name string, kind string, start_line int, end_line int, code string, embedding array<float>"
WORDS = [f"word{k}" for k in range(60)]


def document(rng, k, repo, path, words=30):
    name = rng.choice(WORDS)
    code = " ".join(WORDS[min(int(rng.expovariate(0.1)), 59)] for _ in range(rng.randrange(1, words)))
    return (k, repo, 1, f"r{repo}", "python", path, path.startswith("tests/"), name, f"C.{name}", "function", k, k + 1, code, [rng.random(), rng.random()])


def frame(spark, rows):
    return spark.createDataFrame(rows, DOC)


def size_of(folder):
    return sum(os.path.getsize(os.path.join(d, n)) for d, _, names in os.walk(folder) for n in names)


def hits(df):
    return sorted((r["query_id"], r["rank"], r["id"], r["score"]) for r in df.collect())


QUESTIONS = ["word1 word7 word50", "word0", "word3 word3 word40 test", "c word59", "nothing here"]


def assert_same_answers(spark, engine, tmp_path, rows):
    """Searches over the engine's segments give what one generation of the same rows gives."""
    whole = Engine(spark, str(tmp_path / f"whole{random.random()}"), dims=2)
    whole.index(frame(spark, rows))
    q = engine.batch(QUESTIONS)
    assert hits(engine.lexical(q, 7)) == hits(whole.lexical(q, 7))
    assert sorted(map(tuple, engine.store.read("frequencies").select("field", "term", "df").collect())) == sorted(map(tuple, whole.store.read("frequencies").select("field", "term", "df").collect()))
    assert sorted(map(tuple, lexical.stats_of(engine.store.read("stats")).collect())) == sorted(map(tuple, lexical.stats_of(whole.store.read("stats")).collect()))
    assert {r["symbol_id"] for r in engine.store.read().collect()} == {r[0] for r in rows}
    flat = hits(lexical.search(frame(spark, rows), q, 7, is_test="is_test", intent="intent"))
    assert hits(engine.lexical(q, 7)) == [(a, b, c, pytest.approx(d, abs=2e-6)) for a, b, c, d in flat]


def feed(spark, *rows):
    return spark.createDataFrame(rows, "ordinal int, status string, old_path string, path string")


def test_a_sync_writes_its_own_segment_and_answers_as_a_rebuild_would(spark, tmp_path):
    rng = random.Random(1)
    rows = [document(rng, k, 1 + k % 2, f"{'tests/' if k % 9 == 0 else ''}f{k // 6}.py", 120) for k in range(1, 800)]
    engine = Engine(spark, str(tmp_path / "e"), dims=2)
    base = engine.index(frame(spark, rows), len(rows))
    root = tmp_path / "e"
    before = size_of(root / base)
    path = rows[20][5]
    fresh = [document(rng, 5000, rows[20][1], path), document(rng, rows[700][0], 2, "moved.py")]
    name = engine.sync(rows[20][1], feed(spark, (0, "M", None, path)), frame(spark, fresh))
    rows = [r for r in rows if not (r[5] == path and r[1] == rows[20][1]) and r[0] != fresh[1][0]] + fresh
    written = size_of(root / name)
    assert size_of(root / base) == before and written < before / 4
    manifest = engine.store.manifest()
    assert [s for s, _ in manifest["tables"]["docs"]] == [base, name] and manifest["dead"]["docs"][base] >= 2
    assert_same_answers(spark, engine, tmp_path, rows)
    engine.sync(1, feed(spark, (0, "D", None, path), (1, "A", None, "new.py")), frame(spark, [document(rng, 6000, 1, "new.py")]))
    rows = [r for r in rows if not (r[1] == 1 and r[5] == path)] + [document(random.Random(0), 6000, 1, "new.py")]
    assert {r["symbol_id"] for r in engine.store.read().collect()} == {r[0] for r in rows}


def test_merged_segments_answer_alike(spark, tmp_path):
    rng = random.Random(2)
    rows = {k: document(rng, k, 1, f"f{k}.py") for k in range(1, 120)}
    engine = Engine(spark, str(tmp_path / "e"), dims=2)
    engine.index(frame(spark, list(rows.values())))
    names = set()
    for turn in range(7):
        key = 10 + turn
        fresh = document(rng, 200 + turn, 1, f"f{key}.py")
        engine.sync(1, feed(spark, (0, "M", None, f"f{key}.py")), frame(spark, [fresh]))
        del rows[key]
        rows[fresh[0]] = fresh
        names.add(len(engine.store.manifest()["tables"]["docs"]))
    manifest = engine.store.manifest()
    assert max(names) <= 1 + 2 * segments.FAN and len(manifest["tables"]["docs"]) < 8
    assert sum(n for _, n in manifest["tables"]["docs"]) - sum(manifest["dead"]["docs"].values()) == len(rows)
    assert_same_answers(spark, engine, tmp_path, list(rows.values()))
    # what is mostly taken out is rewritten
    engine.reindex_repository(1, frame(spark, [document(rng, 900, 1, "only.py")]))
    assert [r["symbol_id"] for r in engine.store.read().collect()] == [900]
    assert engine.merge() is None and sum(engine.store.manifest()["dead"].get("docs", {}).values()) == 0


def test_manifests_follow_their_commits():
    m = segments.following(segments.empty(), "s1", {"docs": 10, "postings": 5, "files": 3}, {})
    m = segments.following(m, "s2", {"docs": 2, "postings": 1}, {"docs": {"s1": 4}}, appended=("docs", "postings"), marks={"a": 1})
    assert m["tables"] == {"docs": [["s1", 10], ["s2", 2]], "postings": [["s1", 5], ["s2", 1]], "files": [["s1", 3]]} and m["dead"] == {"docs": {"s1": 4}} and m["marks"] == {"a": 1}
    m3 = segments.following(m, "s3", {"docs": 1, "postings": 1}, {"docs": {"s1": 1, "s2": 1}}, appended=("docs", "postings"))
    assert m3["dead"] == {"docs": {"s1": 5, "s2": 1}} and m3["dead_in"] == {"docs": ["s2", "s3"]} and segments.members(m3) == {"s1", "s2", "s3"}
    merged = segments.following(m3, "s4", {"docs": 2, "postings": 2}, {"docs": {"s1": 5}}, merged=("s2", "s3"))
    assert merged["tables"]["docs"] == [["s1", 10], ["s4", 2]] and merged["tables"]["files"] == [["s1", 3]] and merged["dead"] == {"docs": {"s1": 5}} and merged["dead_in"] == {"docs": ["s4"]} and merged["marks"] == {"a": 1}
    whole = segments.following(merged, "s5", {"docs": 7, "postings": 7}, {})
    assert whole["tables"]["docs"] == [["s5", 7]] and whole["dead"] == {} and whole["tables"]["files"] == [["s1", 3]]
    assert segments.to_merge(whole, 4) == [] and segments.to_merge(m3, 2) != []


@pytest.mark.parametrize("many", [10**9, 0])
def test_blocks_answer_as_all_postings_do(spark, monkeypatch, many):
    monkeypatch.setattr(blocks, "BLOCK", 8)
    monkeypatch.setattr(blocks, "SHARD_DOCS", 100)
    rng = random.Random(3)
    rows = [document(rng, k, 1, f"{'tests/' if k % 5 == 0 else ''}f{k % 40}.py", 60) for k in range(1, 450)]
    docs = frame(spark, rows)
    fields = list(lexical.BOOSTS)
    points = blocks.build(docs, len(rows), fields).withColumn("segment", F.lit(0))
    assert points.where("size(ids) > 8").isEmpty() and points.select("shard").distinct().count() > 3
    tokens = lexical.field_tokens(docs, fields)
    stats, df = lexical.field_stats(tokens), lexical.document_frequencies(lexical.postings(tokens))
    q = spark.createDataFrame([(k, " ".join(rng.choice(WORDS) for _ in range(rng.randrange(1, 6))), k % 2 == 0) for k in range(30)], "query_id int, query string, intent boolean")
    for limit in (5, 200):
        want = hits(lexical.search(docs, q, limit, is_test="is_test", intent="intent"))
        for rows_a_pass in (10**6, 100):
            got = hits(blocks.search(points, None, stats, df, q, limit, many=many, pass_rows=rows_a_pass))
            assert [g[:3] for g in got] == [w[:3] for w in want] and [g[3] for g in got] == pytest.approx([w[3] for w in want], abs=2e-6)
    gone = spark.createDataFrame([(0, k) for k in range(1, 100)], "segment int, id long").withColumn("shard", blocks.shard(F.col("id"), blocks.shards_of(len(rows))))
    got = hits(blocks.search(points, gone, stats, df, q, 5, many=many))
    want = lexical.search(docs, q, 10_000, is_test="is_test", intent="intent").where("id >= 100").drop("rank")
    assert [g[:3] for g in got] == [w[:3] for w in hits(lexical.top(want, 5))]


def test_lexical_search_reads_documents_only_for_its_answers(spark, tmp_path):
    rng = random.Random(4)
    engine = Engine(spark, str(tmp_path / "e"), dims=2)
    engine.index(frame(spark, [document(rng, k, 1, f"f{k}.py") for k in range(1, 60)]))
    plan = engine.lexical(engine.batch(QUESTIONS), 5)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and "tokens" not in plan


SOURCES = {"a.py": "def f():\n    return 1\n\nclass C:\n    def g(self):\n        return f()\n", "b.py": "def h(): pass\n", "c.go": "func x() {}", "notes.txt": "no source"}


class Tree:
    """A working tree with commits, without git."""

    def __init__(self, spark, files):
        self.spark, self.files, self.commit, self.log = spark, dict(files), "c0", []

    def change(self, commit, records, **files):
        for _, status, old, path in records:
            self.files.pop(old or path, None)
        self.files |= {k.replace("__", "."): v for k, v in files.items()}
        self.commit, self.log = commit, records

    def head(self):
        return self.commit

    def feed(self, old, new):
        return self.log

    def present(self, paths):
        rows = [(p, f"hash {self.files[p]}", self.files[p]) for p in paths if p in self.files]
        return self.spark.createDataFrame(rows, "path string, content_hash string, text string")

    def discovered(self):
        return self.spark.createDataFrame([(p, "go" if p.endswith("go") else "python", f"hash {t}") for p, t in self.files.items() if not p.endswith("txt")], "path string, language string, content_hash string")


def started(spark, root):
    engine, tree = Engine(spark, str(root), dims=4), Tree(spark, SOURCES)
    for name in ("one", "two"):
        engine.metadata.register(name, f"https://github.com/o/{name}", "main", "c0", tree.discovered())
    for k in (1, 2):
        files = engine.metadata.read("files").where(F.col("repository_id") == k)
        engine.replace_symbols(k, files.join(tree.present(list(SOURCES)), "path").select(F.col("id").alias("file_id"), "text"))
        engine.publish_repository(k)
    return engine, tree


def state(engine, repository_id):
    own = F.col("repository_id") == repository_id
    files = {(r["path"], r["content_hash"], r["last_indexed_commit"]) for r in engine.metadata.read("files").where(own).collect()}
    symbols = {(r["qualified_name"], r["start_line"]) for r in engine.metadata.read("symbols").where(own).collect()}
    docs = {(r["path"], r["qualified_name"]) for r in engine.store.read().where(own).collect()}
    ids = [r["id"] for r in engine.metadata.read("symbols").collect()]
    assert len(set(ids)) == len(ids) and {r["symbol_id"] for r in engine.store.read().collect()} == set(ids)
    return files, symbols, docs, engine.metadata.repository(repository_id)["last_indexed_commit"]


RECORDS = [(0, "M", None, "a.py"), (1, "D", None, "b.py"), (2, "A", None, "d.py"), (3, "R", "c.go", "e.py"), (4, "M", None, "notes.txt")]
CHANGED = {"a__py": "def f2(): pass\n", "d__py": "class D: pass\n", "e__py": "def moved(): pass\n", "notes__txt": "still none"}
COUNTS = {"files_added": 1, "files_modified": 1, "files_deleted": 1, "files_renamed": 1, "files_parsed": 3}


def follow(engine, tree, fail_at=None):
    return engine.follow(1, tree.head, tree.feed, tree.present, fail_at)


def expected(old_files):
    files = {("a.py", "hash def f2(): pass\n", "c1"), ("d.py", "hash class D: pass\n", "c1"), ("e.py", "hash def moved(): pass\n", "c1")}
    return files, {("f2", 1), ("D", 1), ("moved", 1)}, {("a.py", "f2"), ("d.py", "D"), ("e.py", "moved")}, "c1"


@pytest.mark.parametrize("at", [None, "built", "ready", "switched", "published"])
def test_a_repository_is_followed_in_one_commit(spark, tmp_path, at):
    engine, tree = started(spark, tmp_path / "e")
    other, kept = state(engine, 2), {r["path"]: r["id"] for r in engine.metadata.read("files").where("repository_id = 1").collect()}
    assert follow(engine, tree)["changed"] is False
    before = state(engine, 1)
    tree.change("c1", RECORDS, **CHANGED)
    if at:
        with pytest.raises(InterruptedError):
            follow(engine, tree, at)
        # readers see all of the old state or all of the new one
        assert state(engine, 1) == (before if at in ("built", "ready") else expected(before))
        tree.commit, tree.log = "c2", [(0, "D", None, "d.py")]  # the head goes on; the replay is of what was begun
    out = follow(engine, tree)
    assert out == {"changed": True, "old_commit": "c0", "target_commit": "c1", **COUNTS}
    assert state(engine, 1) == expected(before) and state(engine, 2) == other
    assert {r["path"]: r["id"] for r in engine.metadata.read("files").where("repository_id = 1").collect()}["a.py"] == kept["a.py"]
    assert engine.search("f2", 5)["results"][0]["qualified_name"] == "f2" and engine.search("moved", 5)["results"][0]["path"] == "e.py"
    if at:
        del tree.files["d.py"]
        out = follow(engine, tree)
        assert (out["target_commit"], out["files_deleted"]) == ("c2", 1)
    again = follow(engine, tree)
    assert again["changed"] is False and engine.journal.pending("sync", 1) is None


def test_a_file_that_is_none_any_more_goes_and_repeated_paths_are_refused(spark, tmp_path):
    engine, tree = started(spark, tmp_path / "e")
    tree.change("c1", [(0, "T", None, "a.py")])
    out = follow(engine, tree)
    assert (out["files_deleted"], out["files_modified"]) == (1, 0) and {p for p, *_ in state(engine, 1)[0]} == {"b.py", "c.go"}
    tree.change("c2", [(0, "M", None, "b.py"), (1, "D", None, "b.py")])
    with pytest.raises(ValueError):
        follow(engine, tree)
    with pytest.raises(ValueError):
        engine.follow(9, tree.head, tree.feed, tree.present)


def test_a_replayed_batch_publishes_nothing(spark, tmp_path):
    rng = random.Random(6)
    engine = Engine(spark, str(tmp_path / "e"), dims=2)
    engine.index(frame(spark, [document(rng, k, 1, f"f{k}.py") for k in range(1, 9)]))
    change, fresh = feed(spark, (0, "M", None, "f1.py")), frame(spark, [document(rng, 50, 1, "f1.py")])
    name = engine.sync(1, change, fresh, batch=("changes", 3))
    assert name and engine.sync(1, change, fresh, batch=("changes", 3)) is None and engine.sync(1, change, fresh, batch=("changes", 2)) is None
    with pytest.raises(InterruptedError):
        engine.sync(1, change, frame(spark, [document(rng, 51, 1, "f1.py")]), "ready", batch=("changes", 4))
    assert engine.sync(1, change, fresh, batch=("changes", 4)) is None  # it had been prepared, and its own replay has published it
    assert 51 in {r["symbol_id"] for r in engine.store.read().collect()} and engine.sync(1, change, fresh, batch=("other", 0))


def test_segments_that_a_manifest_reads_are_retained(spark, tmp_path):
    import datetime as dt

    from quernstone.operators import retention

    rng = random.Random(7)
    engine = Engine(spark, str(tmp_path / "e"), dims=2)
    base = engine.index(frame(spark, [document(rng, k, 1, f"f{k}.py") for k in range(1, 60)]))
    for k in range(3):
        engine.sync(1, feed(spark, (0, "M", None, f"f{k + 1}.py")), frame(spark, [document(rng, 70 + k, 1, f"f{k + 1}.py")]))
    later = dt.datetime.now(dt.timezone.utc) + dt.timedelta(hours=30)
    plan = retention.plan(engine.store, later, keep=1)
    assert base in segments.members(engine.store.manifest()) and base not in {c["name"] for c in plan["candidates"]}
    retention.apply(engine.store, plan, later, quiesced=True)
    assert engine.store.read().count() == 59 and engine.lexical(engine.batch(["word1"]), 3).count() > 0


def test_a_stream_publishes_each_batch_once(spark, tmp_path):
    from quernstone.streaming.sync import change_stream, publish_stream

    rng = random.Random(8)
    engine = Engine(spark, str(tmp_path / "e"), dims=2)
    engine.index(frame(spark, [document(rng, k, 1, f"f{k}.py") for k in range(1, 6)]))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text('{"ordinal": 0, "status": "M", "path": "f1.py"}\n{"ordinal": 1, "status": "D", "path": "f2.py"}\n')
    asked = []

    def fresh(df):
        asked.append(df.count())
        return frame(spark, [document(random.Random(1), 100, 1, "f1.py")])

    def run(checkpoint):
        publish_stream(change_stream(spark, str(tmp_path / "in")), engine, 1, fresh, "feed", str(tmp_path / checkpoint)).awaitTermination()
        return engine.store.current()

    name = run("one")
    assert {r["symbol_id"] for r in engine.store.read().collect()} == {100, 3, 4, 5}
    assert run("two") == name and asked == [2, 2]  # the stream has lost its checkpoint and sends its first batch again
    assert run("one") == name
