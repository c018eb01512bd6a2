"""Listings, counts and state of worksheets, files, segments and artifacts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions import ranks, text as tx
from folioflow.operators.selection import QUIZ_TYPES

PAGE_DEFAULT, PAGE_MOST = 20, 100
STATES = ("idle", "running", "done", "failed", "cancelled")


def unchunked(files: DataFrame, segments: DataFrame) -> DataFrame:
    """Files that have no segment in their worksheet."""
    return files.join(segments.select(F.col("file_id").alias("id"), "worksheet_id"), ["id", "worksheet_id"], "left_anti")


def next_position(worksheets: DataFrame, segments: DataFrame) -> DataFrame:
    """worksheet_id, next_position: one after the last, 0 without segments."""
    last = segments.groupBy("worksheet_id").agg(F.max("position").alias("last"))
    return worksheets.select(F.col("id").alias("worksheet_id")).join(last, "worksheet_id", "left").select("worksheet_id", (F.coalesce("last", F.lit(-1)) + 1).alias("next_position"))


def reuse(files: DataFrame, segments: DataFrame) -> DataFrame:
    """worksheet_id, file_id, source_file_id, source_position, heading, text, position: segments to copy.

    A file without segments and with an identity takes those of the same file in another worksheet: the source whose first
    segment comes earliest, the smallest id of equals. Positions go on after the worksheet's last.
    """
    pending = unchunked(files, segments).where("identity_key is not null").select("id", "worksheet_id", "identity_key", "created_at")
    firsts = segments.groupBy("file_id", "worksheet_id").agg(F.min("position").alias("first"), F.count("*").alias("n"))
    sources = files.where("identity_key is not null").select(F.col("id").alias("source_file_id"), "identity_key").join(
        firsts.select(F.col("file_id").alias("source_file_id"), F.col("worksheet_id").alias("source_worksheet"), "first", "n"), "source_file_id"
    )
    pick = F.min_by(F.struct("source_file_id", "source_worksheet", "n"), F.struct("first", "source_file_id", "source_worksheet"))
    chosen = pending.join(sources, "identity_key").where("source_worksheet <> worksheet_id").groupBy("id", "worksheet_id", "created_at").agg(pick.alias("s")).select(F.col("id").alias("file_id"), "worksheet_id", "created_at", "s.*")
    order = Window.partitionBy("worksheet_id").orderBy("created_at", "file_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = chosen.withColumn("before", F.coalesce(F.sum("n").over(order), F.lit(0)))
    last = segments.groupBy("worksheet_id").agg(F.max("position").alias("last"))
    rows = segments.select(F.col("file_id").alias("source_file_id"), F.col("worksheet_id").alias("source_worksheet"), F.col("position").alias("source_position"), "heading", "text", F.col("id").alias("source_id"))
    ranked = ranks.rank(rows.join(placed, ["source_file_id", "source_worksheet"]), ["worksheet_id", "file_id"], "source_position", "nth", ["source_id"])
    joined = ranked.join(last, "worksheet_id", "left")
    position = (F.coalesce("last", F.lit(-1)) + F.col("before") + F.col("nth")).cast("int")
    return joined.select("worksheet_id", "file_id", "source_file_id", "source_position", "heading", "text", position.alias("position"))


def extensions(files: DataFrame) -> DataFrame:
    """worksheet_id, file_count, file_extensions (upper case, distinct, sorted, joined by a comma and space)."""
    names = F.array_join(F.sort_array(F.collect_set(F.upper("extension"))), ", ")
    return files.groupBy("worksheet_id").agg(F.count("*").alias("file_count"), names.alias("file_extensions"))


def quiz_counts(artifacts: DataFrame) -> DataFrame:
    """worksheet_id, artifact_type, n of the quiz types."""
    return artifacts.where(F.col("artifact_type").isin(*QUIZ_TYPES)).groupBy("worksheet_id", "artifact_type").agg(F.count("*").alias("n"))


def artifact_counts(artifacts: DataFrame) -> DataFrame:
    return artifacts.groupBy("worksheet_id", "artifact_type").agg(F.count("*").alias("n"))


def page_size(per_page: int | None) -> int:
    return min(max(per_page if per_page is not None else PAGE_DEFAULT, 1), PAGE_MOST)


def page(worksheets: DataFrame, files: DataFrame, artifacts: DataFrame, number: int = 1, per_page: int | None = None) -> DataFrame:
    """One page of worksheets, newest first, with file count, extensions and quiz counts (0 and empty where none)."""
    size = page_size(per_page)
    ids = worksheets.select("id", "name", "created_at", "pipeline_status").orderBy(F.col("created_at").desc(), "id").offset((max(number, 1) - 1) * size).limit(size)
    keys = ids.select(F.col("id").alias("worksheet_id"))
    own_files = extensions(files.join(F.broadcast(keys), "worksheet_id", "left_semi"))
    counts = quiz_counts(artifacts.join(F.broadcast(keys), "worksheet_id", "left_semi")).groupBy("worksheet_id").pivot("artifact_type", list(QUIZ_TYPES)).sum("n")
    rows = ids.withColumnRenamed("id", "worksheet_id").join(own_files, "worksheet_id", "left").join(counts, "worksheet_id", "left")
    return rows.select(
        "worksheet_id", "name", "created_at", "pipeline_status", F.coalesce("file_count", F.lit(0)).alias("file_count"), F.coalesce("file_extensions", F.lit("")).alias("file_extensions"),
        *[F.coalesce(t, F.lit(0)).alias(c) for t, c in zip(QUIZ_TYPES, ("multiple_choice", "essay", "completion"))],
    )


def pages(worksheets: DataFrame, per_page: int | None = None) -> DataFrame:
    """total, per_page, total_pages."""
    size = page_size(per_page)
    return worksheets.agg(F.count("*").alias("total")).select("total", F.lit(size).alias("per_page"), F.ceil(F.col("total") / size).cast("long").alias("total_pages"))


def search(rows: DataFrame, text: str) -> DataFrame:
    """Rows whose name contains the trimmed text, without regard to case; a blank text keeps all."""
    wanted = text.strip().lower()
    return rows.where(F.contains(F.lower("name"), F.lit(wanted))) if wanted else rows


def clean_name(name: Column | str) -> Column:
    """Trimmed, ``Untitled Worksheet`` where nothing is left."""
    return F.coalesce(tx.blank_to_null(name), F.lit("Untitled Worksheet"))


def delete_worksheets(gone: DataFrame, *tables: tuple[DataFrame, str]) -> list[DataFrame]:
    """Each table without the rows of the worksheets in ``gone`` (id); (table, its worksheet column)."""
    keys = gone.select(F.col("id").alias("__gone")).dropDuplicates()
    return [t.join(keys, F.col(c) == F.col("__gone"), "left_anti") for t, c in tables]


def delete_artifacts(artifacts: DataFrame, worksheet_ids: DataFrame, types: list[str]) -> DataFrame:
    """Artifacts without those of the worksheets (worksheet_id) and types; no types delete nothing."""
    if not types:
        return artifacts
    doomed = worksheet_ids.select("worksheet_id").dropDuplicates().withColumn("__doomed", F.lit(True))
    marked = artifacts.join(doomed, "worksheet_id", "left")
    return marked.where(~(F.coalesce("__doomed", F.lit(False)) & F.coalesce(F.col("artifact_type").isin(*types), F.lit(False)))).drop("__doomed")


def change_status(worksheets: DataFrame, allowed: list[str], to: str) -> DataFrame:
    """id, pipeline_status, changed: the compare-and-set of the state, where it is one of ``allowed``."""
    fits = F.coalesce(F.col("pipeline_status").isin(*allowed), F.lit(False))
    return worksheets.select("id", F.when(fits, F.lit(to)).otherwise(F.col("pipeline_status")).alias("pipeline_status"), fits.alias("changed"))


def status(worksheets: DataFrame) -> DataFrame:
    """id, state (unknown ones are failed), terminal, and the error of failed ones."""
    known = F.when(F.col("pipeline_status").isin(*STATES), F.col("pipeline_status")).otherwise("failed")
    return worksheets.select("id", known.alias("state"), known.isin("done", "failed", "cancelled").alias("terminal"), F.when(known == "failed", F.coalesce("pipeline_error", F.lit(""))).alias("error"))


def stale(worksheets: DataFrame) -> DataFrame:
    """Worksheets left running, to be resumed."""
    return worksheets.where(F.col("pipeline_status") == "running").select("id")


def progress(units: DataFrame) -> DataFrame:
    """worksheet_id, artifact_type, done, total, complete; ``skip`` marks a done unit."""
    rows = units.groupBy("worksheet_id", "artifact_type").agg(F.count_if("skip").alias("done"), F.count("*").alias("total"))
    return rows.withColumn("complete", (F.col("total") > 0) & (F.col("done") == F.col("total")))


def sample(artifacts: DataFrame, artifact_type: str, n: int | None, seed: int = 1) -> DataFrame:
    """At most max(n, 1) random artifacts of a type per worksheet; all of them without n.

    The draw is by a seeded hash of the id, so that it repeats; the rank limit is applied before the shuffle.
    """
    rows = artifacts.where(F.col("artifact_type") == artifact_type)
    if n is None:
        return rows
    order = Window.partitionBy("worksheet_id").orderBy(F.xxhash64(F.lit(seed), "id"), "id")
    return rows.withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= max(n, 1)).drop("__r")
