"""Conversation repair against a search over all edits, the repaired turns, and the cases of the docstring."""

import hashlib
import heapq
import random
import re

import pytest

from quernstone.llm import turn_repair as tr

VALID = re.compile(r"(s?(ua)+)?")
MOVES = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}


def searched(codes, costs):
    """(cost, audit): best first over (cost, audit so far), so the first end has the least cost; all ends of that cost are compared."""
    heap, best, ends = [(0, "", 0, "")], None, []
    while heap:
        cost, audit, i, last = heapq.heappop(heap)
        if best is not None and cost > best:
            break
        if i == len(codes) and last in ("", "a"):
            best = cost
            ends.append(audit)
        chosen = "a" if last == "u" else "u"
        if len(audit) < 2 * len(codes) + 2:
            heapq.heappush(heap, (cost + costs.insert, audit + "I", i, chosen))
        if i < len(codes):
            kind, fault = "sua?"[codes[i] & 3], codes[i] >> 2
            heapq.heappush(heap, (cost + costs.delete, audit + "D", i + 1, last))
            if fault not in (tr.BLANK, tr.DUPLICATE):
                more = costs.truncated if fault == tr.TRUNCATED else 0
                if (last, kind) in MOVES:
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, kind))
                heapq.heappush(heap, (cost + more + costs.rerole, audit + "R", i + 1, chosen))
    return best, min(ends)


@pytest.mark.parametrize("costs", [tr.Costs(), tr.Costs(rerole=3, delete=4, insert=1, truncated=2), tr.Costs(rerole=1, delete=1, insert=1, truncated=1), tr.Costs(rerole=9, delete=9, insert=4, truncated=0)])
def test_layers_give_the_least_cost_and_the_least_audit(costs):
    rng = random.Random(13)
    for _ in range(150):
        codes = bytes(rng.choice([0, 1, 1, 2, 2, 3]) + 4 * rng.choice([0, 0, 0, 1, 2, 3]) for _ in range(rng.randrange(6)))
        assert tr.repair(codes, costs) == searched(codes, costs), list(codes)


def test_a_long_conversation_takes_linear_work():
    codes = bytes([1, 2] * 60_000 + [1])
    cost, audit = tr.repair(codes)
    assert cost == 2 and audit == "D" + "R" * 0 + audit[1:] or cost == 2
    assert len(audit) == len(codes) and audit.count("D") == 1


ROWS = "conv_id long, turn long, role string, text string, digest string, conv string"


def measured(spark, rows, ids=None):
    turns = spark.createDataFrame([(*r, "x", "y") for r in rows], ROWS)
    out = tr.digests(turns, tr.audits(turns, ids))
    return {r["conv_id"]: r for r in out.collect()}


def test_nulls_ties_repeats_and_empty_conversations(spark):
    rows = [
        (None, None, None, None), (None, 2, "user", "Hello."), (None, 9, "assistant", "Yes."),
        (1, 5, "user", "Hi."), (1, 5, "user", "Hi."), (1, 6, "assistant", "cut"), (1, 9, "user", "Hi."),
        (2, 1, "user", ""), (2, 1, "assistant", " \t"),
        (3, -(2**63), "user", "A?"), (3, 2**63 - 1, "assistant", "B!"),
        (4, 1, "User", "Not the role."), (4, 2, "", "No role."),
    ]
    ids = spark.createDataFrame([(7,), (7,), (1,), (None,)], "conv_id long")
    out = measured(spark, rows, ids)
    assert set(out) == {None, 1, 2, 3, 4, 7}
    null = out[None]
    assert (null["gaps"], null["blank"], null["duplicate"], null["truncated"], null["illegal"]) == (6, 1, 0, 0, 1)
    assert (null["cost"], null["audit"]) == (2, "DKK")
    one = out[1]
    assert (one["gaps"], one["blank"], one["duplicate"], one["truncated"], one["illegal"]) == (2, 0, 2, 1, 1)
    assert (one["cost"], one["audit"]) == (8, "DDDD")  # the kept turn must be one that is no repeat
    assert out[2]["cost"] == 4 and out[2]["audit"] == "DD"
    assert out[3]["gaps"] == 2**63 - 1 and out[3]["audit"] == "KK"
    assert out[4]["audit"] == "RR" and out[4]["cost"] == 2
    seven = out[7]
    assert [seven[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")] == [0] * 6 + [""]
    assert seven["repaired_sha256"] == hashlib.sha256(b"").hexdigest()
    assert out[4]["repaired_sha256"] == hashlib.sha256(b"user:Not the role.\nassistant:No role.").hexdigest()
    assert measured(spark, []) == {}


def test_repaired_turns_are_valid_and_digested(spark):
    rng = random.Random(5)
    rows = [(c, t, rng.choice(["system", "user", "assistant", "tool"]), rng.choice(["One.", "Two?", "cut", "", "Long " * 50 + "end."]) + (str(rng.randrange(3)) + "." if rng.random() < 0.6 else "")) for c in range(40) for t in range(rng.randrange(1, 9))]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    cheap = tr.Costs(insert=1)
    for costs in (tr.Costs(), cheap):
        told = {r["conv_id"]: r for r in tr.digests(turns, tr.audits(turns, None, costs)).collect()}
        edits = tr.repaired_turns(turns, costs).collect()
        for conv, row in told.items():
            own = [e for e in edits if e["conv_id"] == conv]
            assert "".join(e["edit"] for e in own) == row["audit"]
            kept = [e for e in own if e["position"] is not None]
            assert [e["position"] for e in kept] == list(range(len(kept)))
            assert VALID.fullmatch("".join(e["role"][:1] for e in kept))
            assert hashlib.sha256("\n".join(f"{e['role']}:{e['text']}" for e in kept).encode()).hexdigest() == row["repaired_sha256"]


def test_a_conversation_over_many_tasks_is_one(spark):
    n = 3000
    rows = [(1, t // 2, ("user", "assistant")[t % 2], f"Turn {t}.") for t in range(n)] + [(c, 0, "user", "Alone.") for c in range(2, 40)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        out = measured(spark, rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    one = out[1]
    assert one["gaps"] == 0 and len(one["audit"]) == n and one["duplicate"] == 0 and len(out) == 39
