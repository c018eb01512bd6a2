import datetime as dt

from folioflow.operators import catalog

T = dt.datetime(2025, 1, 1)
FILES = "id string, worksheet_id string, identity_key string, extension string, created_at timestamp"
CHUNKS = "id string, worksheet_id string, file_id string, position int, heading string, text string"


def test_reuse_takes_the_earliest_source_of_another_worksheet(spark):
    files = spark.createDataFrame([("s1", "w1", "k", "pdf", T), ("s2", "w2", "k", "PDF", T), ("t", "w3", "k", "doc", T), ("n", "w3", None, None, T), ("u", "w3", "z", "pdf", T), ("same", "w1", "k", "x", T)], FILES)
    chunks = spark.createDataFrame([("a", "w1", "s1", 5, None, "A"), ("b", "w1", "s1", 6, "h", "B"), ("c", "w2", "s2", 2, None, "C"), ("d", "w3", "old", 4, None, "D")], CHUNKS)
    got = sorted((r.file_id, r.source_file_id, r.text, r.position) for r in catalog.reuse(files, chunks).collect())
    assert got == [("same", "s2", "C", 7), ("t", "s2", "C", 5)]
    assert sorted(r.id for r in catalog.unchunked(files, chunks).collect()) == ["n", "same", "t", "u"]
    assert {r.worksheet_id: (r.file_count, r.file_extensions) for r in catalog.extensions(files).collect()} == {"w1": (2, "PDF, X"), "w2": (1, "PDF"), "w3": (3, "DOC, PDF")}


def test_status_and_deletion(spark):
    ws = spark.createDataFrame([("a", "running", None), ("b", "odd", "e"), ("c", None, None), ("d", "failed", None)], "id string, pipeline_status string, pipeline_error string")
    assert {r.id: (r.pipeline_status, r.changed) for r in catalog.change_status(ws, ["running"], "cancelled").collect()} == {"a": ("cancelled", True), "b": ("odd", False), "c": (None, False), "d": ("failed", False)}
    assert {r.id: (r.state, r.terminal, r.error) for r in catalog.status(ws).collect()} == {"a": ("running", False, None), "b": ("failed", True, "e"), "c": ("failed", True, ""), "d": ("failed", True, "")}
    arts = spark.createDataFrame([("1", "a", "Summary"), ("2", "a", "MindMap"), ("3", "b", "Summary"), ("4", "a", None)], "id string, worksheet_id string, artifact_type string")
    keys = spark.createDataFrame([("a",), ("a",)], "worksheet_id string")
    assert sorted(r.id for r in catalog.delete_artifacts(arts, keys, ["Summary"]).collect()) == ["2", "3", "4"]
    assert catalog.delete_artifacts(arts, keys, []).count() == 4
    left = catalog.delete_worksheets(ws.where("id = 'a'"), (ws, "id"), (arts, "worksheet_id"))
    assert [x.count() for x in left] == [3, 1]
    assert [catalog.page_size(n) for n in (None, 0, 7, 1000)] == [20, 1, 7, 100]


def test_sample_is_bounded_and_repeats(spark):
    arts = spark.createDataFrame([(str(i), "w" if i % 3 else "v", "Summary") for i in range(30)], "id string, worksheet_id string, artifact_type string")
    first, again = ([r.id for r in catalog.sample(arts, "Summary", 4, 9).orderBy("id").collect()] for _ in range(2))
    assert first == again and len(first) == 8
    assert catalog.sample(arts, "Summary", 0).count() == 2 and catalog.sample(arts, "Summary", None).count() == 30
