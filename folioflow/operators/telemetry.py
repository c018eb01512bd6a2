"""Aggregates over the stage logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RETRYABLE = ("rate_limited", "network", "server")
ATTEMPTS = 3


def latest(rows: DataFrame, key: str) -> DataFrame:
    """Each record's last delivery by arrived_at."""
    columns = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*columns), F.coalesce("arrived_at", F.lit("1970-01-01").cast("timestamp"))).alias("__r")).select(key, "__r.*")


def error_class(message: Column | str) -> Column:
    """rate_limited, network, server, rejected, invalid, or other; null for no error."""
    m = F.lower(message)
    return (
        F.when(m.isNull(), F.lit(None)).when(m.startswith("rate limited"), "rate_limited").when(m.startswith("network error"), "network")
        .when(m.startswith("provider server error"), "server").when(m.startswith("request rejected"), "rejected").when(m.startswith("invalid provider response"), "invalid").otherwise("other")
    )


def asks_without_schema(message: Column | str) -> Column:
    """Whether an error says that the provider takes no schema, so that the request is to be made again without; null is none."""
    m = F.lower(F.coalesce(message, F.lit("")))
    return F.contains(m, F.lit("response_format")) | F.contains(m, F.lit("json_schema")) | F.contains(m, F.lit("structured output"))


def backoff_ms(attempt: Column | str) -> Column:
    """700 * 2^min(n, 3) / 2 + 200 milliseconds."""
    n = F.col(attempt) if isinstance(attempt, str) else attempt
    return (F.lit(350) * F.pow(F.lit(2.0), F.least(n, F.lit(3))) + 200).cast("long")


def exact_ranks(rows: DataFrame, keys: list[str], value: str, shares: dict[str, str]) -> DataFrame:
    """Per group exact order statistics: {column: SQL expression of the 0-based rank from n}.

    Equal values are counted first, so that the running sum goes over distinct values only; null values are left out.
    """
    counted = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("__c"))
    upto = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys)
    reach = counted.withColumn("__r", F.sum("__c").over(upto)).withColumn("n", F.sum("__c").over(whole))
    holds = lambda rank: (F.col("__r") > F.expr(rank)) & (F.col("__r") - F.col("__c") <= F.expr(rank))
    return reach.groupBy(*keys).agg(*[F.max(F.when(holds(rank), F.col(value))).alias(name) for name, rank in shares.items()])


def stage_summary(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """n, mean, median, min, max, total and p90 (the element at floor(0.9 n)) of a column per group."""
    v = rows.withColumn("__v", F.col(value).cast("double")).where("__v is not null and not isnan(__v)")
    plain = v.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("__v").alias("mean"), F.min("__v").alias("minimum"), F.max("__v").alias("maximum"), F.sum("__v").alias("total"))
    ranks = exact_ranks(v, keys, "__v", {"low": "floor((n - 1) / 2)", "high": "floor(n / 2)", "p90": "floor(0.9 * n)"})
    ranks = ranks.select(*keys, ((F.col("low") + F.col("high")) / 2).alias("median"), "p90")
    on = None
    for k in keys:
        on = F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) if on is None else on & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    return plain.alias("a").join(ranks.alias("b"), on).select(*[F.col(f"a.{k}").alias(k) for k in keys], "n", "mean", "median", "minimum", "maximum", "total", "p90")


def transport(replies: DataFrame) -> DataFrame:
    """Per provider: records, replies, their share, retryable errors, time spent."""
    rows = replies.withColumn("class", error_class("error"))
    return rows.groupBy("provider").agg(
        F.count("*").alias("records"), F.count_if(F.col("status") == "ok").alias("replies"), F.count_if(F.col("class").isin(*RETRYABLE)).alias("retryable"),
        (F.count_if(F.col("status") == "ok") / F.count("*")).alias("reply_share"), F.sum("elapsed_ms").alias("elapsed_ms"),
    )


def errors(replies: DataFrame) -> DataFrame:
    """error_class, attempt, n, retryable."""
    rows = replies.where(F.col("status") == "error").groupBy(error_class("error").alias("error_class"), "attempt").agg(F.count("*").alias("n"))
    return rows.withColumn("retryable", F.coalesce(F.col("error_class").isin(*RETRYABLE), F.lit(False)))


def acceptance(verdicts: DataFrame, records: DataFrame) -> DataFrame:
    """Per unit_type: records, replies, accepted, rejected and skipped ones, and the share accepted of replies and of records.

    ``verdicts`` has a row (reply_id, unit_type, verdict) per reply with text, ``records`` (unit_type) per response record.
    """
    judged = verdicts.groupBy("unit_type").agg(
        F.count("*").alias("replies"), F.count_if(F.col("verdict") == "ok").alias("accepted"), F.count_if(F.col("verdict") == "rejected").alias("rejected"), F.count_if(F.col("verdict") == "skipped").alias("skipped")
    )
    joined = records.groupBy("unit_type").agg(F.count("*").alias("records")).join(judged, "unit_type", "left").na.fill(0, ["replies", "accepted", "rejected", "skipped"])
    return joined.withColumns({"accepted_of_replies": F.try_divide("accepted", "replies"), "accepted_of_records": F.try_divide("accepted", "records")})


def latency(records: DataFrame) -> DataFrame:
    """Per status (ok or error): n, mean, median, minimum, maximum, total and p90 of elapsed_ms; negative and null times are left out."""
    return stage_summary(records.where("elapsed_ms >= 0"), ["status"], "elapsed_ms")


def attempts(records: DataFrame) -> DataFrame:
    """attempt, n."""
    return records.groupBy("attempt").agg(F.count("*").alias("n"))


def accepted_questions(verdicts: DataFrame) -> DataFrame:
    """Per unit_type: accepted units, their questions, and questions per unit; types without accepted units have no row."""
    ok = verdicts.where("verdict = 'ok'")
    return ok.groupBy("unit_type").agg(F.count("*").alias("units"), F.sum("accepted").alias("questions"), F.avg("accepted").alias("per_unit"))


def questions_per_unit(items: DataFrame) -> DataFrame:
    """Per worksheet: units with items, items, and items per unit."""
    units = items.groupBy("worksheet_id", "reply_id").agg(F.count("*").alias("n"))
    return units.groupBy("worksheet_id").agg(F.count("*").alias("units"), F.sum("n").alias("questions"), F.avg("n").alias("per_unit"))


def token_rates(tokenization: DataFrame) -> DataFrame:
    """Per file: tokens, calls, tokens per call and per second as ratios of sums; null where the divisor is 0."""
    sums = tokenization.groupBy("file_id").agg(F.sum("tokens").alias("tokens"), F.sum("calls").alias("calls"), F.sum("duration_ms").alias("duration_ms"))
    return sums.select("file_id", "tokens", "calls", F.try_divide("tokens", "calls").alias("tokens_per_call"), F.try_divide(F.col("tokens") * 1000.0, F.col("duration_ms")).alias("tokens_per_second"))
