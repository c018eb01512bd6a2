"""Which segments reach generation: filters, samples, term scores, topics and the covering selection."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions import ranks, text as tx
from folioflow.session import cut

MIN_WORDS, LEAD, SAMPLE, COVER_BUDGET = 10, 800, 48, 8000
# Headings and opening words of front matter, matched as substrings in lower case.
HEADING_MARKERS = (
    "table of contents", "contents", "preface", "foreword", "acknowledg", "about this book", "about the author", "about the textbook",
    "how to use", "welcome to", "index", "colophon",
)
TEXT_MARKERS = ("copyright", "©", "creative commons", "licensed under", "all rights reserved", "library of congress", "isbn")
QUIZ_TYPES = ("MultipleChoiceQuiz", "EssayQuiz", "CompletionQuiz")
ALL_TYPES = (*QUIZ_TYPES, "Summary", "MindMap")


def _any_of(c: Column, markers: tuple[str, ...]) -> Column:
    hit = F.lit(False)
    for m in markers:
        hit = hit | F.contains(c, F.lit(m))
    return hit


def is_degenerate() -> Column:
    """Fewer than ten words with a letter; null and blank texts too. A text is read up to its tenth word."""
    return ~tx.has_words("text", MIN_WORDS)


def is_front_matter() -> Column:
    """A heading or an opening (800 characters) that marks front matter; null counts as empty."""
    heading = F.lower(F.coalesce("heading", F.lit("")))
    lead = F.lower(F.substring(F.coalesce("text", F.lit("")), 1, LEAD))
    return _any_of(heading, HEADING_MARKERS) | _any_of(lead, TEXT_MARKERS)


def usable(segments: DataFrame) -> DataFrame:
    """Segments that are neither degenerate nor front matter."""
    return segments.where(~is_degenerate() & ~is_front_matter())


class NoSegments(ValueError):
    """There are no segments at all."""


class NoUsableSegments(ValueError):
    """There are segments, but all are degenerate or front matter."""


def require_usable(segments: DataFrame) -> DataFrame:
    """``usable(segments)``; ``NoSegments`` or ``NoUsableSegments`` where there are none."""
    rows = usable(segments)
    if rows.isEmpty():
        raise NoSegments() if segments.isEmpty() else NoUsableSegments()
    return rows


def stride_sample(segments: DataFrame, cap: int = SAMPLE) -> DataFrame:
    """All of a worksheet's segments up to ``cap``, beyond that the ones at floor(i * n / cap), with their index and n."""
    ranked = ranks.rank(segments, ["worksheet_id"], "position", "__rank", ["id"])
    counts = segments.groupBy("worksheet_id").agg(F.count("*").alias("total"))
    joined = ranked.join(counts, "worksheet_id").withColumn("index", F.col("__rank") - 1).drop("__rank")
    # index = floor(i * n / cap) for the i that it names; a double, as the sampling rule has it.
    i = F.ceil(F.col("index") / (F.col("total") / F.lit(float(cap)))).cast("long")
    near = [F.floor((i + d) * (F.col("total") / F.lit(float(cap)))) for d in (-1, 0, 1)]
    named = F.lit(False)
    for d, at in zip((-1, 0, 1), near):
        named = named | ((at == F.col("index")) & (i + d >= 0) & (i + d < cap))
    return joined.where((F.col("total") <= cap) | named)


def quiz_units(segments: DataFrame, artifacts: DataFrame, cap: int = SAMPLE) -> DataFrame:
    """worksheet_id, segment_id, artifact_type, type_index, seed_offset, skip: sampled segments times quiz types.

    A unit whose (type, segment) already has an artifact is marked to be skipped.
    """
    sampled = stride_sample(usable(segments), cap)
    types = F.explode(F.array(*[F.struct(F.lit(t).alias("artifact_type"), F.lit(i).alias("type_index")) for i, t in enumerate(QUIZ_TYPES)]))
    units = sampled.select("worksheet_id", F.col("id").alias("segment_id"), (F.col("position") + 17).cast("long").alias("seed_offset"), types.alias("t")).select("worksheet_id", "segment_id", "seed_offset", "t.*")
    done = artifacts.select("worksheet_id", "artifact_type", F.col("source").alias("segment_id"), F.lit(True).alias("done")).dropDuplicates()
    return units.join(done, ["worksheet_id", "artifact_type", "segment_id"], "left").withColumn("skip", F.coalesce("done", F.lit(False))).drop("done")


def term_counts(segments: DataFrame) -> DataFrame:
    """worksheet_id, id, term, n over heading and text, in_text: whether the text has it."""
    def of(column: str, in_text: bool) -> DataFrame:
        return segments.select("worksheet_id", "id", F.explode(tx.terms(column)).alias("term"), F.lit(in_text).alias("in_text"))

    return of("text", True).unionByName(of("heading", False)).groupBy("worksheet_id", "id", "term").agg(F.count("*").alias("n"), F.max("in_text").alias("in_text"))


def term_scores(segments: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """worksheet_id, term, score: count times ln(segments / segments with the term), not below 0."""
    counts = term_counts(segments) if counts is None else counts
    sizes = segments.groupBy("worksheet_id").agg(F.count("*").alias("segments"))
    per_term = counts.groupBy("worksheet_id", "term").agg(F.sum("n").alias("n"), F.count("*").alias("df"))
    idf = F.greatest(F.log(F.col("segments") / F.col("df")), F.lit(0.0))
    return per_term.join(sizes, "worksheet_id").select("worksheet_id", "term", (F.col("n") * idf).alias("score"))


def member_scores(segments: DataFrame, counts: DataFrame | None = None, scores: DataFrame | None = None) -> DataFrame:
    """worksheet_id, id, position, score: the scores of a segment's distinct text terms added up; 0 without terms."""
    counts = term_counts(segments) if counts is None else counts
    scores = term_scores(segments, counts) if scores is None else scores
    sums = counts.where("in_text").join(scores, ["worksheet_id", "term"]).groupBy("worksheet_id", "id").agg(F.sum("score").alias("score"))
    return segments.select("worksheet_id", "id", "position").join(sums, ["worksheet_id", "id"], "left").na.fill(0.0, ["score"])


def topics(segments: DataFrame, scores: DataFrame | None = None) -> DataFrame:
    """Segments with topic (numbered from 0 within the worksheet) and label.

    A heading that is not blank opens a topic, others join the one before; a leading run without heading
    is labelled with the worksheet's best term (the smallest of equals), or ``General``.
    """
    opens = tx.blank_to_null("heading").isNotNull()
    numbered = ranks.running_sum(segments, ["worksheet_id"], "position", F.when(opens, 1).otherwise(0).cast("long"), "__topic", ["id"])
    labels = numbered.where(opens).select("worksheet_id", "__topic", tx.blank_to_null("heading").alias("label"))
    scores = term_scores(segments) if scores is None else scores
    best = scores.groupBy("worksheet_id").agg(F.min_by("term", F.struct(-F.round("score", 9), F.col("term"))).alias("best"))
    leading = numbered.where("__topic = 0").select("worksheet_id").dropDuplicates().withColumn("leading", F.lit(1))
    joined = numbered.join(labels, ["worksheet_id", "__topic"], "left").join(best, "worksheet_id", "left").join(leading, "worksheet_id", "left")
    first = F.when(F.col("leading").isNull(), 1).otherwise(0)
    return joined.withColumn("label", F.coalesce("label", "best", F.lit("General"))).withColumn("topic", F.col("__topic") - first).drop("__topic", "best", "leading")


def _scored(segments: DataFrame) -> DataFrame:
    """worksheet_id, id, position, topic, label, score, tokens, context of usable segments, written once to the shared folder.

    The segments are written before, and the scores of terms, so that texts are filtered and split into terms once for each.
    """
    kept = cut(segments.select("worksheet_id", "id", "position", "heading", "text"))
    counts = term_counts(kept)
    scores = cut(term_scores(kept, counts))
    members = member_scores(kept, counts, scores).select("worksheet_id", "id", F.round("score", 9).alias("score"))
    joined = topics(kept, scores).join(members, ["worksheet_id", "id"])
    return cut(joined.select("worksheet_id", "id", "position", "topic", "label", "score", tx.approximate_tokens("text").alias("tokens"), tx.section_context("heading", "text").alias("context")))


def picked(order: list[dict], budget: int) -> list[str]:
    """The ids taken from candidates in the order of rank and topic; a topic whose candidate does not fit is closed."""
    spent, closed, out = 0, set(), []
    for x in order:
        if x["topic"] in closed:
            continue
        if out and spent + x["tokens"] > budget:
            closed.add(x["topic"])
        else:
            spent += x["tokens"]
            out.append(x["id"])
    return out


def _cover(base: DataFrame, budget: int) -> DataFrame:
    """The rows of ``base`` (as ``_scored``) that the selection takes."""
    @F.pandas_udf("array<string>")
    def take(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda order: picked(order, budget))

    narrow = base.drop("context")
    in_topic = Window.partitionBy("worksheet_id", "topic").orderBy(F.col("score").desc(), "position", "id")
    ranked = narrow.withColumn("rank", F.row_number().over(in_topic)).where(F.col("rank") <= budget)
    ranked = ranked.withColumn("spent", F.sum("tokens").over(in_topic.rowsBetween(Window.unboundedPreceding, 0))).where((F.col("spent") <= budget) | (F.col("rank") == 1))
    same = Window.partitionBy("worksheet_id", "tokens").orderBy("topic")
    heads = ranked.where("rank = 1").withColumn("nth", F.row_number().over(same)).where((F.col("nth") * F.col("tokens") <= budget) | (F.col("topic") == 0))
    matter = ranked.join(heads.select("worksheet_id", "topic"), ["worksheet_id", "topic"], "left_semi")
    lists = matter.groupBy("worksheet_id").agg(F.array_sort(F.collect_list(F.struct("rank", "topic", "tokens", "id"))).alias("order"))
    return base.join(lists.select("worksheet_id", F.explode(take("order")).alias("id")), ["worksheet_id", "id"], "left_semi")


def covering(segments: DataFrame, budget: int = COVER_BUDGET) -> DataFrame:
    """worksheet_id, id, position, topic, label, score, tokens of the selected usable segments.

    Round robin over the topics, each giving its best segment left, until the budget is spent; a topic whose next
    segment does not fit is closed; the very first pick is always taken. The fold sees no more than can
    matter: of each topic the best segments that fit the budget together, and of equally long
    topic heads the first budget/length; it is linear in them.
    """
    return _cover(_scored(segments), budget).drop("context")


def merged_units(segments: DataFrame, artifacts: DataFrame, budget: int = COVER_BUDGET) -> DataFrame:
    """worksheet_id, artifact_type, type_index, source, context, seed_offset, skip of the Summary and MindMap units."""
    base = _scored(segments)
    grouped = _cover(base, budget).groupBy("worksheet_id").agg(F.array_sort(F.collect_list(F.struct("position", "id", "context"))).alias("s"))
    names = base.select("worksheet_id", "topic", "label").dropDuplicates().groupBy("worksheet_id").agg(F.array_sort(F.collect_list(F.struct("topic", "label"))).alias("t"))
    joined = grouped.join(names, "worksheet_id").select(
        "worksheet_id", F.array_join(F.transform("s", lambda x: x["id"]), ",").alias("source"), F.array_join(F.transform("s", lambda x: x["context"]), "\n\n").alias("body"),
        F.array_join(F.transform("t", lambda x: x["label"]), "; ").alias("labels"),
    )
    two = F.explode(F.array(
        F.struct(F.lit("Summary").alias("artifact_type"), F.lit(3).alias("type_index"), F.lit(0).cast("long").alias("seed_offset"), F.col("body").alias("context")),
        F.struct(F.lit("MindMap").alias("artifact_type"), F.lit(4).alias("type_index"), F.lit(1).cast("long").alias("seed_offset"), F.concat(F.lit("Major topics: "), "labels", F.lit("\n\n"), "body").alias("context")),
    ))
    units = joined.select("worksheet_id", "source", two.alias("u")).select("worksheet_id", "source", "u.*")
    done = artifacts.select("worksheet_id", "artifact_type").dropDuplicates().withColumn("done", F.lit(True))
    return units.join(done, ["worksheet_id", "artifact_type"], "left").withColumn("skip", F.coalesce("done", F.lit(False))).drop("done")
