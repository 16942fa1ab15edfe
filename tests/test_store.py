import json

from rippleframe.sources.store import Store, overlaid, parse_plans, price, tool_calls


def test_history_is_appended_checked_and_trimmed(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/p")
    assert s.history().count() == 0
    checks = spark.createDataFrame([("p", f"c{k:03d}", f"2024-01-01T00:{k // 60:02d}:{k % 60:02d}Z", ["a"]) for k in range(70)], "project string, id string, timestamp string, comodMisses array<string>")
    s.append_checks(checks)
    assert s.history().count() == 50 and s.history().selectExpr("min(id)").first()[0] == "c020"
    outcomes = spark.createDataFrame([("p", "c069", "2024-01-02T00:00:00Z", "clean"), ("p", "bogus", "2024-01-02T00:00:00Z", "clean")], "project string, id string, timestamp string, outcome string")
    assert s.record_outcomes(outcomes) == 1
    assert s.history().filter("type = 'outcome'").count() == 1
    few = spark.createDataFrame([("p", "c069", "2024-01-03T00:00:00Z", 1), ("p", "c068", "2024-01-03T00:00:00Z", 2)], "project string, id string, timestamp string, passes int")
    assert s.record_reflections(few) == 1 and s.history().filter("type = 'reflection'").count() == 1
    s.save(spark.createDataFrame([("keep",)], "note string"), "knowledge")
    s.clear_history()
    assert s.history().count() == 0 and s.load("knowledge", "note string").count() == 1


def test_bad_lines_are_left_out(spark, tmp_path):
    (tmp_path / "history").mkdir()
    (tmp_path / "history" / "x.json").write_text('{"id": "a", "project": "p", "timestamp": "2024"}\nnot json\n{"id": "b", "type": "outcome", "project": "p", "timestamp": "2025"}\n')
    got = {r["id"]: r["type"] for r in Store(spark, f"file://{tmp_path}").history().collect()}
    assert got == {"a": "check", "b": "outcome"}


def test_weights_and_thresholds(spark, tmp_path):
    s, base = Store(spark, f"file://{tmp_path}"), {"structural": 0.5, "comod": 0.35}
    assert tuple(s.weights("p", base).first()) == (0.5, 0.35)
    s.save(spark.createDataFrame([("*", 0.4, 0.6), ("p", 0.1, 0.9)], "project string, structural double, comod double"), "weights")
    assert tuple(s.weights("p", base).first()) == (0.1, 0.9) and tuple(s.weights("q", base).first()) == (0.4, 0.6)
    over = overlaid({"a": 1.0, "b": 2.0}, spark.createDataFrame([(0.0, 3.0)], "a double, b double"))
    assert tuple(over.first()) == (1.0, 3.0)


def test_plans(spark):
    full = {"objective": "o", "filesToRead": ["r"], "filesToModify": ["m"], "steps": [{"id": "1", "description": "do"}], "expectedOutcome": "ignored"}
    plain = {"objective": "o", "steps": ["a", "b"]}
    texts = spark.createDataFrame([(1, json.dumps(full)), (2, json.dumps(plain)), (3, "{}"), (4, '{"objective": "x"}')], "id int, text string")
    got = {r["id"]: r for r in parse_plans(texts).collect()}
    assert got[1]["steps"] == ["do"] and got[1]["filesToModify"] == ["m"] and got[1]["problem"] is None
    assert got[2]["steps"] == ["a", "b"] and got[2]["filesToCreate"] == [] and got[2]["problem"] is None
    assert got[3]["problem"] == "no objective" and got[4]["problem"] == "no steps"


def test_traces_and_costs(spark):
    line = lambda tool, **x: json.dumps({"timestamp": "2024-01-01T00:00:00Z", "message": {"content": [{"type": "tool_use", "name": tool, "input": x}, {"type": "text"}]}})
    text = "\n".join([line("Read", file_path="a.go"), "junk", line("Edit", path="b.go")])
    assert sorted((r["tool"], r["file"]) for r in tool_calls(spark.createDataFrame([("s", text)], "id string, text string")).collect()) == [("Edit", "b.go"), ("Read", "a.go")]
    cost = price(spark.createDataFrame([("x", 1_000_000, 0), ("y", 0, 1_000_000)], "model string, input long, output long"), {"x": (3.0, 15.0)}, (1.0, 5.0))
    assert sorted(r["cost"] for r in cost.collect()) == [3.0, 5.0]
