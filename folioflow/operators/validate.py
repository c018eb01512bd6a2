"""Recovery of JSON from replies, and the checks that an item must pass to be kept."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.functions import text as tx

OUTER = r"(?s)\{.*\}"


def strict(text: Column) -> Column:
    """The one JSON value that a text consists of, as VARIANT; null for none, several, or anything after it.

    The parser ignores what follows a value, hence the brackets around the text.
    """
    values = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))), "$", "array<variant>")
    return F.when(F.size(values) == 1, F.get(values, F.lit(0)))


def _outer(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, OUTER, 0), F.lit(""))


def recovered(text: Column | str) -> Column:
    """The JSON of a reply as VARIANT: the trimmed text, else what lies between the first and last brace; else null."""
    t = tx.trim(text)
    return F.coalesce(strict(t), strict(_outer(t)))


def recovery(text: Column | str) -> Column:
    """strict, extracted or invalid; null and blank texts are invalid."""
    t = tx.trim(F.coalesce(text, F.lit("")))
    return F.when(strict(t).isNotNull(), "strict").when(strict(_outer(t)).isNotNull(), "extracted").otherwise("invalid")


def is_truncated(finish_reason: Column | str) -> Column:
    return F.coalesce(F.lower(finish_reason) == "length", F.lit(False))


# Fixed values in the rules below: the wording of each reason.
def mcq_reason(question: str = "question", options: str = "options", answer: str = "answer") -> Column:
    """Why a multiple-choice item is rejected, by the first rule that it breaks; null if it is accepted.

    Question, exactly four options, none null or empty, no two alike without regard to case, an answer, and
    that the trimmed answer is one of the trimmed options, with regard to case.
    """
    opts = F.transform(F.col(options), lambda o: tx.trim(o))
    a = tx.blank_to_null(answer)
    return (
        F.when(tx.blank_to_null(question).isNull(), "missing or empty question")
        .when(F.coalesce(F.size(options), F.lit(-1)) != 4, "expected exactly 4 options")
        .when(F.exists(options, lambda o: o.isNull()), "non-string option")
        .when(F.exists(opts, lambda o: o == ""), "empty option")
        .when(F.size(F.array_distinct(F.transform(opts, lambda o: F.lower(o)))) != 4, "duplicate choices")
        .when(a.isNull(), "missing answer")
        .when(~F.array_contains(opts, F.coalesce(a, F.lit(""))), "answer does not match any option")
    )


def essay_reason(question: str = "question") -> Column:
    return F.when(F.col(question).isNull(), "missing question").when(tx.blank_to_null(question).isNull(), "empty question")


def completion_reason(context: str = "context", sentence: str = "sentence", answer: str = "answer") -> Column:
    """Null if both strings are there and the answer occurs in the context, without regard to case."""
    return (
        F.when(F.col(sentence).isNull(), "missing sentence").when(F.col(answer).isNull(), "missing answer")
        .when(tx.blank_to_null(sentence).isNull() | tx.blank_to_null(answer).isNull(), "empty sentence or answer")
        .when(~F.contains(F.lower(F.coalesce(context, F.lit(""))), F.lower(tx.trim(answer))), "answer not found in source")
    )


def items(replies: DataFrame, field: str = "items") -> DataFrame:
    """reply_id, unit_type, segment_id, ordinal, item (VARIANT): the elements of the item array of each reply.

    A reply that is truncated, has no JSON or no such array gives no rows; an empty array none either.
    """
    parsed = replies.where(~is_truncated("finish_reason")).select("reply_id", "unit_type", "segment_id", recovered("text").alias("v"))
    listed = parsed.select("reply_id", "unit_type", "segment_id", F.try_variant_get("v", f"$.{field}", "array<variant>").alias("list"))
    return listed.select("reply_id", "unit_type", "segment_id", F.posexplode("list").alias("ordinal", "item"))


def string_field(item: Column | str, key: str) -> Column:
    """A string field of a VARIANT object; null where it is absent or of another type."""
    value = F.try_variant_get(item, f"$.{key}", "variant")
    return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(item, f"$.{key}", "string"))


def completion_items(replies: DataFrame, segments: DataFrame) -> DataFrame:
    """reply_id, ordinal, reason of the items of CompletionQuiz replies, against their segment with its heading."""
    contexts = segments.select(F.col("id").alias("segment_id"), tx.section_context("heading", "text").alias("context"))
    rows = items(replies.where(F.col("unit_type") == "CompletionQuiz")).select("reply_id", "segment_id", "ordinal", string_field("item", "sentence").alias("sentence"), string_field("item", "answer").alias("answer"))
    return rows.join(contexts, "segment_id", "left").select("reply_id", "ordinal", completion_reason().alias("reason"))


def essay_items(replies: DataFrame) -> DataFrame:
    rows = items(replies.where(F.col("unit_type") == "EssayQuiz")).select("reply_id", "ordinal", string_field("item", "question").alias("question"))
    return rows.select("reply_id", "ordinal", essay_reason().alias("reason"))


def reply_mcq_items(replies: DataFrame) -> DataFrame:
    rows = items(replies.where(F.col("unit_type") == "MultipleChoiceQuiz")).select(
        "reply_id", "ordinal", string_field("item", "question").alias("question"), F.try_variant_get("item", "$.options", "array<string>").alias("options"), string_field("item", "answer").alias("answer")
    )
    return rows.select("reply_id", "ordinal", mcq_reason().alias("reason"))


def summaries(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, valid (summary string and key_points array), displayable (also a title, and only strings as points)."""
    v = rows.select(F.col(id_col).alias("id"), recovered(text_col).alias("v"))
    points = F.try_variant_get("v", "$.key_points", "array<variant>")
    valid = string_field("v", "summary").isNotNull() & points.isNotNull()
    shown = valid & string_field("v", "title").isNotNull() & F.coalesce(F.forall(points, lambda p: F.schema_of_variant(p) == "STRING"), F.lit(False))
    return v.select("id", F.coalesce(valid, F.lit(False)).alias("valid"), F.coalesce(shown, F.lit(False)).alias("displayable"))


def _normal_node(node) -> dict | None:
    """A branch with a label and normal children; absent children become an empty list."""
    done: dict[int, dict] = {}
    stack = [(node, False)]
    while stack:
        n, ready = stack.pop()
        if not ready:
            if not isinstance(n, dict) or not isinstance(n.get("label"), str) or not n["label"].strip() or not isinstance(n.get("children", []), list):
                return None
            stack.append((n, True))
            stack.extend((c, False) for c in n.get("children", []))
        else:
            done[id(n)] = {"label": n["label"], "children": [done[id(c)] for c in n.get("children", [])]}
    return done[id(node)]


def normal_mind_map(text: str | None) -> str | None:
    """The canonical JSON of a mind map, or None if its topic, a label or a list of children is not right."""
    if not text:
        return None
    body = text.strip()
    for candidate in (body, body[body.find("{") : body.rfind("}") + 1]):
        try:
            value = json.loads(candidate)
            break
        except (ValueError, RecursionError):
            value = None
    if not isinstance(value, dict) or not isinstance(value.get("topic"), str) or not isinstance(value.get("branches"), list):
        return None
    branches = [_normal_node(b) for b in value["branches"]]
    if any(b is None for b in branches):
        return None
    try:
        return json.dumps({"topic": value["topic"], "branches": branches}, ensure_ascii=True)
    except RecursionError:
        return None


def mind_maps(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, map (canonical JSON, null if rejected). The rewrite is recursive, hence a pandas function."""
    @F.pandas_udf("string")
    def normal(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(normal_mind_map)

    return rows.select(F.col(id_col).alias("id"), normal(F.col(text_col)).alias("map"))


def rejection_reasons(replies: DataFrame, segments: DataFrame) -> DataFrame:
    """unit_type, reason, n of the rejected items, and of whole replies: ``truncated``, ``no readable JSON``, ``missing item array``."""
    ok = replies.where((F.col("status") == "ok") & tx.blank_to_null("text").isNotNull())
    kinds = ok.select("reply_id", "unit_type")
    of_items = completion_items(ok, segments).unionByName(essay_items(ok)).unionByName(reply_mcq_items(ok)).where("reason is not null").join(kinds, "reply_id")
    v = recovered("text")
    listed = F.try_variant_get(v, "$.items", "array<variant>").isNotNull()
    whole = F.when(is_truncated("finish_reason"), "truncated").when(v.isNull(), "no readable JSON").when(~F.coalesce(listed, F.lit(False)), "missing item array")
    of_replies = ok.where(~F.col("unit_type").isin("Summary", "MindMap")).select("unit_type", whole.alias("reason")).where("reason is not null")
    return of_items.select("unit_type", "reason").unionByName(of_replies).groupBy("unit_type", "reason").agg(F.count("*").alias("n"))


def verdicts(replies: DataFrame, segments: DataFrame) -> DataFrame:
    """reply_id, unit_type, accepted, rejected, verdict: ok, rejected or skipped, one row per reply with status ok.

    Quiz replies are judged by their items; a readable reply with an empty array is skipped, as is a blank one; one without
    readable array is rejected. Summaries and mind maps are one item each.
    """
    ok = replies.where((F.col("status") == "ok"))
    blank = tx.blank_to_null("text").isNull()
    reasons = completion_items(ok, segments).unionByName(essay_items(ok)).unionByName(reply_mcq_items(ok))
    per_reply = reasons.groupBy("reply_id").agg(F.count_if(F.col("reason").isNull()).alias("good"), F.count_if(F.col("reason").isNotNull()).alias("bad"))
    summed = summaries(ok.where(F.col("unit_type") == "Summary"), "reply_id", "text").select(F.col("id").alias("reply_id"), F.col("valid").alias("whole"))
    mapped = mind_maps(ok.where(F.col("unit_type") == "MindMap"), "reply_id", "text").select(F.col("id").alias("reply_id"), F.col("map").isNotNull().alias("whole"))
    wholes = summed.unionByName(mapped)
    has_list = F.try_variant_get(recovered("text"), "$.items", "array<variant>").isNotNull()
    rows = ok.select("reply_id", "unit_type", blank.alias("blank"), is_truncated("finish_reason").alias("cut"), F.coalesce(has_list, F.lit(False)).alias("has_list"))
    joined = rows.join(per_reply, "reply_id", "left").join(wholes, "reply_id", "left")
    merged = F.col("unit_type").isin("Summary", "MindMap")
    accepted = F.when(F.col("blank") | F.col("cut"), 0).when(merged, F.coalesce(F.col("whole"), F.lit(False)).cast("int")).otherwise(F.coalesce("good", F.lit(0)))
    rejected = F.when(F.col("blank"), 0).when(F.col("cut"), 1).when(merged, 1 - F.coalesce(F.col("whole"), F.lit(False)).cast("int")).when(~F.col("has_list"), 1).otherwise(F.coalesce("bad", F.lit(0)))
    counted = joined.select("reply_id", "unit_type", accepted.cast("long").alias("accepted"), rejected.cast("long").alias("rejected"))
    return counted.withColumn("verdict", F.when((F.col("accepted") == 0) & (F.col("rejected") == 0), "skipped").when(F.col("accepted") == 0, "rejected").otherwise("ok"))
