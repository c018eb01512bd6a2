"""The whole pipeline over a store: worksheets of files into segments, units, artifacts, and back out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.functions import text as tx
from folioflow.operators import blocks, catalog, consume, generate, segments, selection
from folioflow.session import cut, ship
from folioflow.sources import files as sources
from folioflow.sources.store import Store


def _id(*parts: str) -> F.Column:
    """A repeatable id from the natural key."""
    return F.substring(F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(p).cast("string"), F.lit("")) for p in parts]), 256), 1, 26)


#: Units of a wave: what a failure may lose.
WAVE = 10_000


class Stopped(Exception):
    """The job was cancelled."""


class Engine:
    """Every method reads the store's tables, computes with the operators, and writes back what changed."""

    def __init__(self, spark: SparkSession, folder: str, backend: generate.Backend | None = None, parser: sources.Parser | None = None, params: generate.Params = generate.Params()):
        ship(spark)
        self.spark, self.store, self.backend, self.parser, self.params = spark, Store(spark, folder), backend, parser, params
        self._live: set[str] = set()

    def create_worksheet(self, name: str, paths: list[str]) -> str:
        """A new worksheet over files; a blank name becomes ``Untitled Worksheet``. Returns its id."""
        one = self.spark.range(1).select(catalog.clean_name(F.lit(name)).alias("name"), F.current_timestamp().alias("created_at"))
        one = cut(one.withColumn("id", _id("name", "created_at")))
        row = one.first()
        self.store.append("worksheets", one.select("id", "name", "created_at", F.col("created_at").alias("updated_at"), F.lit("idle").alias("pipeline_status"), F.lit(None).cast("string").alias("pipeline_error")))
        if paths:
            found = sources.require_supported(sources.metadata(self.spark, paths)).withColumn("worksheet_id", F.lit(row.id)).withColumn("created_at", F.current_timestamp())
            # the check of extensions runs with the write, since it feeds a column of it
            self.store.append("files", found.withColumn("id", _id("worksheet_id", "path")).where("parser is not null"))
        return row.id

    def run(self, worksheet_id: str, types: list[str] | None = None, concurrency: int = 8) -> bool:
        """Ingest and generate as one job; False, and nothing done, if the worksheet has a live one.

        The state is running meanwhile, then done, or failed with the error, which is raised again. A job that was stopped stays
        cancelled, whatever it was just finishing.
        """
        state = self._state(worksheet_id)
        if state == "running" and worksheet_id in self._live:
            return False
        self._live.add(worksheet_id)
        self._set(worksheet_id, list(catalog.STATES), "running")
        try:
            self.ingest(worksheet_id)
            self._check(worksheet_id)
            self.generate(worksheet_id, types, concurrency)
        except Stopped:
            pass
        except Exception as error:
            self._set(worksheet_id, ["running"], "failed", str(error) or type(error).__name__)
            raise
        finally:
            self._live.discard(worksheet_id)
        return True

    def stop(self, worksheet_id: str) -> bool:
        """Cancel what runs or waits; a running job ends before its next wave. False if there was nothing to stop."""
        hit = self._state(worksheet_id) in ("running", "idle")
        self._set(worksheet_id, ["running", "idle"], "cancelled")
        return hit

    def resume(self, worksheet_id: str) -> str:
        """Go on with a worksheet that is neither done, failed nor cancelled, and return its state; what is stored is not made again."""
        if self._state(worksheet_id) in ("running", "idle"):
            self.run(worksheet_id)
        return self._state(worksheet_id)

    def resume_stale(self) -> list[str]:
        """Go on with all worksheets that an earlier process left running; their ids."""
        ids = [r.id for r in catalog.stale(self.store.read("worksheets")).collect() if r.id not in self._live]
        for one in ids:
            self.run(one)
        return ids

    def ingest(self, worksheet_id: str) -> None:
        """Segments of the worksheet's files that have none yet: copies of the same file elsewhere, else parsed.

        A worksheet without files is an error, and so is a file that needs a parser where there is none.
        """
        files, chunks = self.store.read("files"), self.store.read("chunks")
        own = files.where(F.col("worksheet_id") == worksheet_id)
        if own.isEmpty():
            raise ValueError("the worksheet has no files")
        copies = cut(catalog.reuse(files, chunks).where(F.col("worksheet_id") == worksheet_id).select("worksheet_id", "file_id", "position", "heading", "text"))
        present = chunks.select("worksheet_id", "file_id", "position").unionByName(copies.select("worksheet_id", "file_id", "position"))
        pending = catalog.unchunked(own, present).select("id", "path", "extension", "worksheet_id", "created_at").withColumn("parser", blocks.parser_of("extension"))
        made = segments.segment(sources.read_blocks(self.spark, cut(pending), self.parser))
        numbered = segments.number(made, own, present).select("worksheet_id", "file_id", "position", "heading", "text")
        new = copies.unionByName(numbered).withColumn("created_at", F.current_timestamp())
        self.store.append("chunks", cut(new.withColumn("id", _id("worksheet_id", "file_id", "position"))))
        self._touch(worksheet_id)

    def segments(self, worksheet_id: str) -> DataFrame:
        return self.store.read("chunks").where(F.col("worksheet_id") == worksheet_id).orderBy("position", "id")

    def units(self, worksheet_id: str) -> DataFrame:
        """All units of the worksheet, with contexts; done ones are marked ``skip``."""
        chunks = self.store.read("chunks").where(F.col("worksheet_id") == worksheet_id)
        artifacts = self.store.read("artifacts").where(F.col("worksheet_id") == worksheet_id)
        contexts = chunks.select(F.col("id").alias("segment_id"), tx.section_context("heading", "text").alias("context"))
        quiz = selection.quiz_units(chunks, artifacts).join(contexts, "segment_id")
        merged = selection.merged_units(selection.usable(chunks), artifacts).withColumnRenamed("source", "segment_id")
        columns = ["worksheet_id", "artifact_type", "type_index", "segment_id", "context", "seed_offset", "skip"]
        return quiz.select(*columns).unionByName(merged.select(*columns))

    def generate(self, worksheet_id: str, types: list[str] | None = None, concurrency: int = 8, wave: int = WAVE) -> DataFrame:
        """Run the units that are not done, store the accepted artifacts, and return the telemetry by type.

        Units run in waves, and what a wave made is stored before the next one, so that a job that fails or is stopped keeps it. Fails,
        and marks the worksheet failed, if every unit that ran met a backend error, or if there are no usable segments.
        """
        self._set(worksheet_id, list(catalog.STATES), "running")
        try:
            selection.require_usable(self.segments(worksheet_id))
            units = self.units(worksheet_id)
            if types is not None:
                units = units.where(F.col("artifact_type").isin(*types))
            requests = cut(generate.requests(units, None, self.params))
            waves = max(1, -(-requests.count() // wave))
            turn = F.pmod(F.xxhash64("artifact_type", "segment_id"), F.lit(waves))
            told = None
            for n in range(waves):
                self._check(worksheet_id)
                of_wave = requests.where(turn == n)
                replies = cut(generate.run(of_wave, self.backend, concurrency))
                made = generate.artifacts(replies, of_wave.select("segment_id", "context").dropDuplicates(["segment_id"]))
                made = made.withColumn("id", _id("worksheet_id", "artifact_type", "source", "ordinal")).withColumn("created_at", F.current_timestamp())
                self.store.append("artifacts", cut(made.join(self.store.read("artifacts").select("id"), "id", "left_anti")))
                one = generate.telemetry_of(replies)
                told = one if told is None else told.unionByName(one)
            sums = [F.sum(c).alias(c) for c in told.columns if c != "artifact_type"]
            told = cut(told.groupBy("artifact_type").agg(*sums))
            total = told.agg(F.sum("units").alias("units"), F.sum("backend_errors").alias("errors")).first()
            if total.units and total.units == total.errors:
                raise RuntimeError("every unit met a backend error")
        except Stopped:
            raise
        except Exception as error:
            self._set(worksheet_id, ["running"], "failed", str(error) or type(error).__name__)
            raise
        self._set(worksheet_id, ["running"], "done")
        return told

    def regenerate(self, worksheet_id: str, types: list[str]) -> DataFrame:
        """Delete the artifacts of these types and make them anew; refused while a job runs."""
        if not types:
            raise ValueError("no types to regenerate")
        if self._state(worksheet_id) == "running":
            raise RuntimeError("the worksheet is running")
        keys = self.spark.createDataFrame([(worksheet_id,)], "worksheet_id string")
        self.store.write("artifacts", cut(catalog.delete_artifacts(self.store.read("artifacts"), keys, types)))
        return self.generate(worksheet_id, types)

    def progress(self, worksheet_id: str) -> DataFrame:
        """artifact_type, done, total, complete, generating of the worksheet's units."""
        rows = catalog.progress(self.units(worksheet_id)).withColumn("state", F.lit(self._state(worksheet_id)))
        return rows.select("artifact_type", "done", "total", "complete", consume.generating("state", "done", "total").alias("generating"))

    def artifacts(self, worksheet_id: str, artifact_type: str, n: int | None = None, seed: int = 1) -> DataFrame:
        return catalog.sample(self.store.read("artifacts").where(F.col("worksheet_id") == worksheet_id), artifact_type, n, seed)

    def questions(self, worksheet_id: str, artifact_type: str, n: int | None = 10, seed: int = 1) -> DataFrame:
        return consume.questions(self.artifacts(worksheet_id, artifact_type, n, seed))

    def grade(self, questions: DataFrame, given: DataFrame) -> DataFrame:
        """One row: graded, correct, percent, tier of answers (id, given) to questions."""
        rows = questions.join(given.select("id", "given"), "id", "left")
        return consume.scores(rows.select("artifact_type", consume.correct("artifact_type", "answer", "given").alias("correct")).withColumn("all", F.lit(1)), ["all"]).drop("all")

    def worksheets(self, number: int = 1, per_page: int | None = None) -> DataFrame:
        return catalog.page(self.store.read("worksheets"), self.store.read("files"), self.store.read("artifacts"), number, per_page)

    def worksheet(self, worksheet_id: str) -> DataFrame:
        """One row: the worksheet with its files' extensions and counts of artifacts by type (a map)."""
        one = self.store.read("worksheets").where(F.col("id") == worksheet_id)
        mine = F.col("worksheet_id") == worksheet_id
        counts = catalog.artifact_counts(self.store.read("artifacts").where(mine)).groupBy("worksheet_id").agg(F.map_from_entries(F.collect_list(F.struct("artifact_type", "n"))).alias("artifact_counts"))
        rows = one.withColumnRenamed("id", "worksheet_id").join(catalog.extensions(self.store.read("files").where(mine)), "worksheet_id", "left").join(counts, "worksheet_id", "left")
        return rows.withColumn("artifact_counts", F.coalesce("artifact_counts", F.create_map().cast("map<string,bigint>")))

    def status(self, worksheet_id: str) -> DataFrame:
        return catalog.status(self.store.read("worksheets").where(F.col("id") == worksheet_id))

    def delete(self, worksheet_id: str) -> None:
        """Delete a worksheet with all that belongs to it; an unknown id is an error."""
        worksheets = self.store.read("worksheets")
        gone = worksheets.where(F.col("id") == worksheet_id)
        if gone.isEmpty():
            raise KeyError(worksheet_id)
        names = [("artifacts", "worksheet_id"), ("chunks", "worksheet_id"), ("files", "worksheet_id"), ("worksheets", "id")]
        for (name, _), rows in zip(names, catalog.delete_worksheets(gone, *[(self.store.read(n), c) for n, c in names])):
            self.store.write(name, cut(rows))

    def _state(self, worksheet_id: str) -> str:
        """The state; an unknown worksheet is an error."""
        row = self.status(worksheet_id).first()
        if row is None:
            raise KeyError(worksheet_id)
        return row.state

    def _check(self, worksheet_id: str) -> None:
        if self._state(worksheet_id) == "cancelled":
            raise Stopped(worksheet_id)

    def _touch(self, worksheet_id: str) -> None:
        """Note the time of a change."""
        self._change(F.col("id") == worksheet_id, {})

    def _set(self, worksheet_id: str, allowed: list[str], to: str, error: str | None = None) -> None:
        hit = (F.col("id") == worksheet_id) & F.col("pipeline_status").isin(*allowed)
        self._change(hit, {"pipeline_error": F.lit(error), "pipeline_status": F.lit(to)})

    def _change(self, hit: F.Column, values: dict[str, F.Column]) -> None:
        rows = self.store.read("worksheets").withColumn("__hit", hit)
        for name, value in {"updated_at": F.current_timestamp(), **values}.items():
            rows = rows.withColumn(name, F.when(F.col("__hit"), value).otherwise(F.col(name)))
        self.store.write("worksheets", cut(rows.drop("__hit")))
