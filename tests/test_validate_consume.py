import json

from pyspark.sql import functions as F

from folioflow.operators import consume, telemetry, validate


def test_recovery(spark):
    rows = ['{"a": 1}', 'Here: {"a": 1} bye', '{"a": 1} tail', '{"a": 1} {"b": 2}', "[1,2]", '{"a": [1,}', "", None, "  ", "{'a': 1}"]
    df = spark.createDataFrame([(r,) for r in rows], "t string")
    assert [r[0] for r in df.select(validate.recovery("t")).collect()] == ["strict", "extracted", "extracted", "invalid", "strict", "invalid", "invalid", "invalid", "invalid", "invalid"]


def test_mcq_rules_in_order(spark):
    o = ["a", "b", "c", "d"]
    rows = [("q", o, " a "), (" ", o, "a"), ("q", o[:3], "a"), ("q", None, "a"), ("q", ["a", None, "c", "d"], "a"), ("q", ["a", " ", "c", "d"], "a"), ("q", ["a", "A", "c", "d"], "a"), ("q", o, None), ("q", o, "A")]
    df = spark.createDataFrame(rows, "question string, options array<string>, answer string")
    assert [r[0] for r in df.select(validate.mcq_reason()).collect()] == [
        None, "missing or empty question", "expected exactly 4 options", "expected exactly 4 options", "non-string option", "empty option", "duplicate choices", "missing answer", "answer does not match any option",
    ]


def test_mind_maps():
    good = {"topic": "t", "branches": [{"label": "a"}, {"label": "b", "children": [{"label": "c", "children": []}]}]}
    want = {"topic": "t", "branches": [{"label": "a", "children": []}, {"label": "b", "children": [{"label": "c", "children": []}]}]}
    assert json.loads(validate.normal_mind_map("x " + json.dumps(good))) == want
    for bad in ({"topic": 1, "branches": []}, {"topic": "t"}, {"topic": "t", "branches": [{"label": " "}]}, {"topic": "t", "branches": [{"label": "a", "children": None}]}, {"topic": "t", "branches": ["a"]}):
        assert validate.normal_mind_map(json.dumps(bad)) is None
    assert validate.normal_mind_map(None) is None and validate.normal_mind_map("") is None and validate.normal_mind_map("[" * 100_000) is None


def test_verdicts(spark):
    item = {"question": "q", "options": list("abcd"), "answer": "a"}
    rows = [(1, "MultipleChoiceQuiz", "ok", "stop", json.dumps({"items": [item, {}]})), (2, "MultipleChoiceQuiz", "ok", "LENGTH", json.dumps({"items": [item]})), (3, "EssayQuiz", "ok", None, '{"items": []}'), (4, "EssayQuiz", "ok", None, "nothing"),
            (5, "CompletionQuiz", "ok", None, json.dumps({"items": [{"sentence": "s", "answer": "Word"}, {"sentence": "s", "answer": "absent"}]})), (6, "Summary", "ok", None, '{"summary": "s", "key_points": []}'), (7, "MindMap", "ok", None, "{}"), (8, "EssayQuiz", "ok", None, " "), (9, "EssayQuiz", "error", None, None)]
    replies = spark.createDataFrame([(i, u, s, f, t, "seg") for i, u, s, f, t in rows], "reply_id long, unit_type string, status string, finish_reason string, text string, segment_id string")
    segs = spark.createDataFrame([("seg", "h", "a WORD here")], "id string, heading string, text string")
    got = {r.reply_id: (r.accepted, r.rejected, r.verdict) for r in validate.verdicts(replies, segs).collect()}
    assert got == {1: (1, 1, "ok"), 2: (0, 1, "rejected"), 3: (0, 0, "skipped"), 4: (0, 1, "rejected"), 5: (1, 1, "ok"), 6: (1, 0, "ok"), 7: (0, 1, "rejected"), 8: (0, 0, "skipped")}


def test_grades(spark):
    rows = [("MultipleChoiceQuiz", "A", "A"), ("MultipleChoiceQuiz", "A", "a"), ("CompletionQuiz", "Word ", "word"), ("CompletionQuiz", "x", None), ("EssayQuiz", "x", "x"), ("MultipleChoiceQuiz", " ", " ")]
    df = spark.createDataFrame(rows, "k string, a string, g string").withColumn("correct", consume.correct("k", "a", "g"))
    assert [r.correct for r in df.collect()] == [True, False, True, False, None, False]
    s = spark.createDataFrame([("x", True)] * 4 + [("x", False)] + [("y", True), ("y", False)] + [("z", None)] + [("v", False)], "k string, correct boolean")
    assert {r.k: (r.percent, r.tier) for r in consume.scores(s, ["k"]).collect()} == {"x": (80, "Excellent"), "y": (50, "Good job"), "z": (None, None), "v": (0, "Keep practicing")}


def test_telemetry(spark):
    assert [r[0] for r in spark.range(5).select(telemetry.backoff_ms(F.col("id").cast("int"))).collect()] == [550, 900, 1600, 3000, 3000]
    rows = [("a", float(i)) for i in range(70)] + [("b", None), ("b", 2.0), (None, 1.0)]
    got = {r.k: (r.n, r.median, r.p90) for r in telemetry.stage_summary(spark.createDataFrame(rows, "k string, v double"), ["k"], "v").collect()}
    assert got == {"a": (70, 34.5, 63.0), "b": (1, 2.0, 2.0), None: (1, 1.0, 1.0)}
