import json
import os

import pytest

from rippleframe.streaming import gates

BASE = {"check_id": "c1", "readable": True, "missing": False, "steps": 3, "files": 2, "plan_hash": "h", "p_failed": 0.0, "novelty": 0.0}


def play(*changes):
    state, out = None, []
    for c in changes:
        state, allowed, _ = gates.gate_step(state, BASE | c)
        out.append(allowed)
    return out


@pytest.mark.parametrize("steps, rounds", [(4, 1), (10, 2), (20, 3), (22, 4)])
def test_rounds_by_complexity(steps, rounds):
    assert play(*[{"check_id": f"c{k}", "steps": steps} for k in range(rounds)]) == [False] * (rounds - 1) + [True]


def test_gate_rules():
    none = {"check_id": ""}
    assert play(none, none, none) == [False, False, True]
    assert play({"missing": True}, {}) == [False, True]
    same = {"steps": 8}
    assert play(same, same, same | {"check_id": "c2"}) == [False, False, True]
    assert play(same, same | {"check_id": "c2", "plan_hash": "other"}, same | {"check_id": "c3", "plan_hash": "other"}) == [False, False, True]
    assert play({"readable": False}) == [True]
    assert gates.rounds_needed(3, 0.5, 0.6) == 3 and gates.rounds_needed(30, 0.9, 0.9) == 4


def run(stream, path, spark, mode="append"):
    q = stream.writeStream.format("memory").queryName(path).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(path).collect()


def source(spark, tmp_path, rows, schema):
    (tmp_path / "in").mkdir()
    for k, part in enumerate(rows):
        f = tmp_path / "in" / f"{k}.json"
        f.write_text("\n".join(json.dumps(x) for x in part))
        os.utime(f, (1_700_000_000 + k, 1_700_000_000 + k))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(f"file://{tmp_path}/in")


def test_gate_stream_keeps_state_between_batches(spark, tmp_path):
    schema = "session string, seq long, check_id string, readable boolean, missing boolean, steps int, files int, plan_hash string, p_failed double, novelty double"
    first = BASE | {"session": "s", "seq": 1, "steps": 8}
    got = run(gates.gate(source(spark, tmp_path, [[first], [first | {"seq": 2, "check_id": "c2"}]], schema)), "gate_out", spark)
    assert sorted((r["seq"], r["allowed"], r["attempts"]) for r in got) == [(1, False, 1), (2, True, 2)]


def edit(file, hour, day=1):
    return {"project": "p", "file": file, "ts": f"2024-01-{day:02d}T{hour:02d}:00:00Z"}


def test_edits_fire_from_two_files_on(spark, tmp_path):
    batches = [[edit("a", 1)], [edit("a", 1)], [edit("b", 2)], [edit("b", 2)]]
    got = run(gates.edited_files(source(spark, tmp_path, batches, "project string, file string, ts timestamp")), "edits_out", spark)
    assert [(r["project"], r["n"], r["files"]) for r in got] == [("p", 2, ["a", "b"])]


def test_edits_expire(spark, tmp_path):
    """Files leave a day after their last edit, late edits do not count, and state shrinks again."""
    batches = [[edit("a", 1), edit("b", 2)], [edit("c", 12, 3)], [edit("late", 1, 1)], [edit("d", 13, 3)], [edit("e", 0, 9)], [{"project": "q", "file": "x", "ts": "2024-01-20T00:00:00Z"}], [{"project": "q", "file": "x", "ts": "2024-01-21T00:00:00Z"}]]
    stream = gates.edited_files(source(spark, tmp_path, batches, "project string, file string, ts timestamp"))
    q = stream.writeStream.format("memory").queryName("expiring").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.table("expiring").collect()
    assert [(r["n"], r["files"]) for r in got] == [(2, ["a", "b"]), (2, ["c", "d"])]
    # Only q is left: p has no file that is younger than a day.
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] == 1


def test_corrections_by_id(spark, tmp_path):
    at = lambda d, h=0: f"2024-01-{d:02d}T{h:02d}:00:00Z"
    checks = [[{"id": "a", "ts": at(1)}, {"id": "b", "ts": at(1)}, {"id": "a", "ts": at(1, 1)}], [{"id": "z", "ts": at(20)}], [{"id": "y", "ts": at(21)}]]
    outcomes = [[{"id": "a", "ts": at(2), "outcome": "clean"}, {"id": "a", "ts": at(2, 1), "outcome": "failed"}, {"id": "b", "ts": at(9), "outcome": "rework"}], [{"id": "z", "ts": at(20, 1), "outcome": "clean"}], [{"id": "none", "ts": at(30), "outcome": "clean"}]]
    (tmp_path / "c").mkdir()
    (tmp_path / "o").mkdir()
    c = source(spark, tmp_path / "c", checks, "id string, ts timestamp")
    o = source(spark, tmp_path / "o", outcomes, "id string, ts timestamp, outcome string")
    got = sorted((r["id"], r["outcome"]) for r in run(gates.corrected(c, o), "corrected_out", spark))
    # The first outcome of a counts, once; that of b came after seven days; y is still open.
    assert got == [("a", "clean"), ("b", None), ("z", "clean")]


def test_churn_decays(spark, tmp_path):
    rows = [[{"ts": "2024-01-01T00:30:00Z", "file": "a"}, {"ts": "2024-01-02T01:10:00Z", "file": "a"}, {"ts": "2024-01-04T00:00:00Z", "file": "b"}]]
    got = run(gates.decayed_churn(source(spark, tmp_path, rows, "ts timestamp, file string"), 2), "churn_out", spark, "complete")
    assert sorted((r["end"].day, r["file"], r["n"]) for r in got) == [(2, "a", 1), (3, "a", 2), (4, "a", 1), (5, "b", 1), (6, "b", 1)]


def test_sliding_windows(spark, tmp_path):
    rows = [[{"ts": "2024-01-01T00:30:00Z", "kind": "e"}, {"ts": "2024-01-01T01:10:00Z", "kind": "e"}]]
    got = run(gates.sliding_counts(source(spark, tmp_path, rows, "ts timestamp, kind string"), "2 hours"), "windows_out", spark, "complete")
    assert max(r["n"] for r in got) == 2 and len(got) == 3


def test_bounded_log(spark):
    rows = spark.createDataFrame([("a", k, k) for k in range(7)] + [("b", k, k) for k in range(3)], "p string, ts long, event_id long")
    got = gates.bounded_log(rows, "p", most=5, keep=2)
    assert sorted((r["p"], r["ts"]) for r in got.collect()) == [("a", 5), ("a", 6), ("b", 0), ("b", 1), ("b", 2)]
