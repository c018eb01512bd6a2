"""What a reader of artifacts computes: questions, grades, labels, trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.functions import text as tx

EXCELLENT, GOOD = 80, 50


def correct(kind: Column | str, answer: Column | str, given: Column | str) -> Column:
    """Whether a given answer is right: choices as they are, completions trimmed and without case; null for essays.

    A missing or blank answer to a question that can be graded is wrong.
    """
    k = F.col(kind) if isinstance(kind, str) else kind
    a, g = (F.col(c) if isinstance(c, str) else c for c in (answer, given))
    there = tx.blank_to_null(g).isNotNull()
    choice = F.coalesce(there & (g == a), F.lit(False))
    filled = F.coalesce(there & (F.lower(tx.trim(g)) == F.lower(tx.trim(a))), F.lit(False))
    return F.when(k == "MultipleChoiceQuiz", choice).when(k == "CompletionQuiz", filled)


def scores(graded: DataFrame, keys: list[str]) -> DataFrame:
    """``keys``, graded, correct, percent (rounded half up), tier; percent and tier are null if nothing could be graded."""
    rows = graded.groupBy(*keys).agg(F.count("correct").alias("graded"), F.count_if("correct").alias("correct"))
    percent = F.when(F.col("graded") > 0, F.floor(100.0 * F.col("correct") / F.col("graded") + 0.5).cast("long"))
    tier = F.when(percent.isNull(), F.lit(None)).when(percent >= EXCELLENT, "Excellent").when(percent >= GOOD, "Good job").otherwise("Keep practicing")
    return rows.withColumn("percent", percent).withColumn("tier", tier)


# What a count of artifacts is called in listings.
COUNT_NAMES = {"MCQ": "multiple_choice", "essay": "essay", "fill": "completion"}


def count_label(counts: dict[str, str] = COUNT_NAMES) -> Column:
    """Counts that are not 0 with their names, joined by a middle dot: {name: column}; a dash where all are 0."""
    parts = F.array(*[F.when(F.coalesce(F.col(c), F.lit(0)) > 0, F.concat(F.col(c).cast("string"), F.lit(f" {name}"))) for name, c in counts.items()])
    shown = F.array_join(F.filter(parts, lambda p: p.isNotNull()), " · ")
    return F.when(shown == "", F.lit("—")).otherwise(shown)


def file_label(count: Column | str, extensions: Column | str) -> Column:
    """How many files there are, and their extensions if any: "3 files · MD, PDF"."""
    n, e = (F.col(c) if isinstance(c, str) else c for c in (count, extensions))
    files = F.concat(n.cast("string"), F.when(n == 1, " file").otherwise(" files"))
    return F.when(F.coalesce(e, F.lit("")) == "", files).otherwise(F.concat(files, F.lit(" · "), e))


def questions(artifacts: DataFrame) -> DataFrame:
    """id, artifact_type, question, answer, options of quiz artifacts that hold one item as an object.

    The sentence of a completion stands as its question; options are null where there are none.
    """
    from folioflow.operators.validate import recovered, string_field

    rows = artifacts.where(F.col("artifact_type").isin("MultipleChoiceQuiz", "EssayQuiz", "CompletionQuiz")).select("id", "artifact_type", recovered("content").alias("v"))
    question = F.coalesce(string_field("v", "question"), string_field("v", "sentence"))
    return rows.select("id", "artifact_type", question.alias("question"), F.coalesce(string_field("v", "answer"), string_field("v", "model_answer")).alias("answer"), F.try_variant_get("v", "$.options", "array<string>").alias("options")).where("question is not null")


def tree(adjacency: DataFrame) -> DataFrame:
    """record_id, path, parent_path, depth, label of the nodes of mind maps, labels escaped for HTML, blank ones ``Untitled``.

    ``adjacency`` is that of ``nested.shred``; depth counts from the branches of the map.
    """
    nodes = adjacency.where((F.col("kind") == "object") & (F.col("node") != "$")).select("record_id", F.col("node").alias("path"), F.col("owner").alias("parent_path"))
    labels = adjacency.where((F.col("label") == "label") & (F.col("kind") == "string")).select("record_id", F.col("parent").alias("path"), F.col("scalar").alias("label"))
    joined = nodes.join(labels, ["record_id", "path"])
    depth = F.size(F.split("path", r"\.")) - 1
    return joined.select("record_id", "path", "parent_path", depth.alias("depth"), tx.escape_html(F.coalesce(tx.blank_to_null("label"), F.lit("Untitled"))).alias("label"))


def generating(status: Column | str, done: Column | str, total: Column | str, ingesting: Column | None = None) -> Column:
    """Whether a type is still being made: running, and either ingesting or not all done."""
    s, d, t = (F.col(c) if isinstance(c, str) else c for c in (status, done, total))
    return (s == "running") & ((ingesting if ingesting is not None else F.lit(False)) | (d < t))
