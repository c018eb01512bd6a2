import pytest
from pyspark.sql import functions as F

from folioflow.plans.engine import Engine, Stopped
from folioflow.session import checkpoint_dir
from folioflow.sources import files
from folioflow.sources.files import NoParser
from folioflow.sources.store import SCHEMAS, Store
from folioflow.streaming import ingest


def test_pipeline_end_to_end(spark, tmp_path):
    prose = "The quick brown fox jumps over the lazy dog while seventeen small birds watch from above. " * 30
    (tmp_path / "a.md").write_text(f"# One\n{prose}\n# Two\n{prose}\n")
    (tmp_path / "b.txt").write_text(prose)
    engine = Engine(spark, str(tmp_path / "store"))
    w = engine.create_worksheet("  ", [str(tmp_path / "a.md"), str(tmp_path / "b.txt")])
    engine.ingest(w)
    segs = engine.segments(w).collect()
    assert [s.position for s in segs] == list(range(len(segs))) and {s.heading for s in segs} == {"One", "Two", None}
    told = {r.artifact_type: (r.units, r.backend_errors) for r in engine.generate(w).collect()}
    assert told == {t: (len(segs), 0) for t in ("MultipleChoiceQuiz", "EssayQuiz", "CompletionQuiz")} | {"Summary": (1, 0), "MindMap": (1, 0)}
    row = engine.worksheet(w).first()
    assert row.name == "Untitled Worksheet" and row.pipeline_status == "done" and row.artifact_counts["Summary"] == 1
    assert engine.units(w).where("not skip").count() == 0
    engine.ingest(w)
    assert engine.segments(w).count() == len(segs)
    quiz = engine.questions(w, "MultipleChoiceQuiz", 2)
    result = engine.grade(quiz, quiz.select("id", F.col("answer").alias("given"))).first()
    assert (result.graded, result.percent, result.tier) == (2, 100, "Excellent")
    before = engine.store.read("artifacts").count()
    engine.regenerate(w, ["Summary"])
    assert engine.store.read("artifacts").count() == before
    other = engine.create_worksheet("again", [str(tmp_path / "b.txt")])
    engine.ingest(other)
    assert engine.segments(other).select("text").first().text == segs[-1].text
    class Down:
        def reply(self, request):
            return {"text": None, "finish_reason": None, "error": "no", "error_class": "rejected"}

    failing = Engine(spark, str(tmp_path / "store"), backend=Down())
    with pytest.raises(RuntimeError):
        failing.generate(other)
    assert engine.status(other).first().state == "failed"
    engine.delete(w)
    assert engine.worksheets().count() == 1 and engine.segments(w).count() == 0
    with pytest.raises(KeyError):
        engine.delete(w)


def test_jobs_are_stopped_resumed_and_fail_loudly(spark, tmp_path):
    prose = "The quick brown fox jumps over the lazy dog while seventeen small birds watch from above. " * 30
    (tmp_path / "a.txt").write_text(prose)
    (tmp_path / "scan.pdf").write_bytes(b"%PDF")
    engine = Engine(spark, str(tmp_path / "store"))
    w = engine.create_worksheet("x", [str(tmp_path / "a.txt")])
    before = engine.worksheet(w).first().updated_at
    engine.ingest(w)
    assert engine.worksheet(w).first().updated_at > before
    assert engine.stop(w) and engine.status(w).first().state == "cancelled" and not engine.stop(w)
    assert engine.resume(w) == "cancelled" and engine.store.read("artifacts").count() == 0

    slow, checks = Engine(spark, str(tmp_path / "store")), []

    def check(i):
        """The worksheet is stopped before its fourth wave."""
        checks.append(i)
        if len(checks) > 3:
            slow.stop(i)
        Engine._check(slow, i)

    slow._check = check
    slow._set(w, ["cancelled"], "idle")
    with pytest.raises(Stopped):
        slow.generate(w, wave=1)
    kept = slow.store.read("artifacts").count()
    assert kept > 0 and slow.status(w).first().state == "cancelled"
    engine._set(w, ["cancelled"], "running")  # as a process that ended left it
    assert engine.resume_stale() == [w] and engine.status(w).first().state == "done"
    done = {r.artifact_type: r for r in engine.progress(w).collect()}
    assert engine.store.read("artifacts").count() > kept and all(r.complete and not r.generating for r in done.values())
    scanned = engine.create_worksheet("pdf", [str(tmp_path / "scan.pdf")])
    with pytest.raises(NoParser):
        engine.run(scanned)
    row = engine.status(scanned).first()
    assert row.state == "failed" and "pdf" in row.error
    empty = engine.create_worksheet("none", [])
    with pytest.raises(ValueError):
        engine.run(empty)
    engine._set(w, ["done"], "running")
    with pytest.raises(RuntimeError):
        engine.regenerate(w, ["Summary"])
    engine._live.add(w)
    assert not engine.run(w)


def test_files_are_read_by_path_or_by_folder(spark, tmp_path, monkeypatch):
    for name, text in (("a.md", "# A\nbody"), ("b.txt", "plain"), ("other.txt", "not asked for")):
        (tmp_path / name).write_text(text)
    asked = files.metadata(spark, [str(tmp_path / "a.md"), str(tmp_path / "b.txt")]).withColumn("id", F.col("name"))
    by_path = sorted(map(tuple, files.read_blocks(spark, asked).collect()), key=str)
    monkeypatch.setattr(files, "PATHS", 1)
    assert by_path == sorted(map(tuple, files.read_blocks(spark, asked).collect()), key=str) and {r[0] for r in by_path} == {"a.md", "b.txt"}
    assert files.read_blocks(spark, asked.limit(0)).count() == 0


def test_store_appends_files_and_never_overwrites(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    row = spark.createDataFrame([("a", "w", "w", 0, None, "t", None)], SCHEMAS["chunks"])
    store.append("chunks", row)
    first = {p.name for p in (tmp_path / "chunks" / "v1").glob("*.parquet")}
    store.append("chunks", row)
    assert store.read("chunks").count() == 2 and first < {p.name for p in (tmp_path / "chunks" / "v1").glob("*.parquet")}
    (tmp_path / "chunks" / "v2").mkdir()  # a write that failed
    assert store.read("chunks").count() == 2
    store.write("chunks", store.read("chunks").limit(1))
    assert (tmp_path / "chunks" / "v3" / "_SUCCESS").exists() and store.read("chunks").count() == 1


def test_a_cluster_must_name_its_checkpoint_folder():
    class Context:
        master = "spark://host:7077"
        getConf = staticmethod(dict)
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext, conf = Context(), {}

    with pytest.raises(RuntimeError):
        checkpoint_dir(Session())


def test_stream_goes_on_where_it_stopped(spark, tmp_path):
    schema = "id string, v int"
    source, target, state = (str(tmp_path / n) for n in ("t.parquet", "out", "state"))
    spark.createDataFrame([("a", 1), ("a", 1), ("b", 2)], schema).write.parquet(source)
    ingest.ingest(ingest.source(spark, str(tmp_path), "t"), target, state, "id")
    spark.createDataFrame([("b", 9), ("c", 3)], schema).write.mode("append").parquet(source)
    ingest.ingest(ingest.source(spark, str(tmp_path), "t"), target, state, "id")
    rows = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(target).collect()
    assert sorted((r.id, r.v) for r in rows) == [("a", 1), ("b", 2), ("c", 3)]
