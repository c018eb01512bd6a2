"""Registered queries of the operators in this package."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from folioflow.llm import mixing, packing, qa_defects, quantiles, reading_level, scan_noise, truncation
from folioflow.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return qa_defects.defects(table(spark, folder, "mcq_items"), table(spark, folder, "replies"))


def p1_profile(spark: SparkSession, folder: str) -> DataFrame:
    return qa_defects.profile(table(spark, folder, "mcq_items"), table(spark, folder, "replies"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return truncation.found(table(spark, folder, "replies"))


def p3_rates(spark: SparkSession, folder: str) -> DataFrame:
    return truncation.rates(table(spark, folder, "replies"))


def p3_limits(spark: SparkSession, folder: str) -> DataFrame:
    return truncation.limits(table(spark, folder, "replies"))


def p3_evidence(spark: SparkSession, folder: str) -> DataFrame:
    """What the censoring posterior and the nesting each decide."""
    return truncation.ablation(table(spark, folder, "replies"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return scan_noise.found(table(spark, folder, "chunks"))


def p4_repaired(spark: SparkSession, folder: str) -> DataFrame:
    return scan_noise.repaired(table(spark, folder, "chunks"))


PERCENTILES = [0.01, 0.05, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99]


def _daily(spark: SparkSession, folder: str) -> DataFrame:
    return quantiles.daily_sketches(table(spark, folder, "metrics_ingestion"), table(spark, folder, "metrics_tokenization"))


def p5_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    keys = ["metric", "group_name"]
    return quantiles.percentiles(quantiles.merge(_daily(spark, folder), keys), keys, PERCENTILES)


def p5_daily(spark: SparkSession, folder: str) -> DataFrame:
    keys = ["metric", "group_name", "day"]
    return quantiles.percentiles(quantiles.merge(_daily(spark, folder), keys), keys, PERCENTILES)


def p5_counts(spark: SparkSession, folder: str) -> DataFrame:
    merged = quantiles.merge(_daily(spark, folder), ["metric", "group_name"])
    return merged.select("metric", "group_name", "n", "low", "high")


def p5_errors(spark: SparkSession, folder: str) -> DataFrame:
    """The true rank errors of ``p5_percentiles`` against the bounds that it reports."""
    values = quantiles.logged_values(table(spark, folder, "metrics_ingestion"), table(spark, folder, "metrics_tokenization"))
    return quantiles.rank_errors(p5_percentiles(spark, folder), values, ["metric", "group_name"], "value", PERCENTILES)


def p5_bounds(spark: SparkSession, folder: str) -> DataFrame:
    return p5_errors(spark, folder).select("metric", "group_name", "n", "within")


def p6_containers(spark: SparkSession, folder: str) -> DataFrame:
    return packing.containers(table(spark, folder, "documents"), table(spark, folder, "pack_limits"))


def p6_fill(spark: SparkSession, folder: str) -> DataFrame:
    return packing.fill(p6_containers(spark, folder), table(spark, folder, "pack_limits"))


def p6_bounds(spark: SparkSession, folder: str) -> DataFrame:
    return packing.bounds(p6_containers(spark, folder), table(spark, folder, "pack_limits"))


def p7_mixture(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mixture(table(spark, folder, "documents"), table(spark, folder, "source_targets"))


def p7_shares(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.shares(table(spark, folder, "documents"), table(spark, folder, "source_targets"))


def p7_supply_mixture(spark: SparkSession, folder: str) -> DataFrame:
    """A mixture as large as the listed sources: tempered weights, as near to the targets as the repeats allow."""
    return mixing.mixture(table(spark, folder, "documents"), table(spark, folder, "source_targets"), size="supply")


def p7_supply_shares(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.shares(table(spark, folder, "documents"), table(spark, folder, "source_targets"), size="supply")


def p7_entropy_mixture(spark: SparkSession, folder: str) -> DataFrame:
    """Own shares tempered to the entropy of the targets, as large as the repeats allow."""
    return mixing.mixture(table(spark, folder, "documents"), table(spark, folder, "source_targets"), by="entropy")


def p7_entropy_shares(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.shares(table(spark, folder, "documents"), table(spark, folder, "source_targets"), by="entropy")


def p7_bounds(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.bounds(p7_shares(spark, folder))


def p7_supply_bounds(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.bounds(p7_supply_shares(spark, folder))


def p7_entropy_bounds(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.bounds(p7_entropy_shares(spark, folder))


def p7_temperature(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.temperature(table(spark, folder, "documents"), table(spark, folder, "source_targets"))


def p8_levels(spark: SparkSession, folder: str) -> DataFrame:
    return reading_level.levels(table(spark, folder, "documents"), table(spark, folder, "level_labels"))


def p8_profile(spark: SparkSession, folder: str) -> DataFrame:
    return reading_level.profile(table(spark, folder, "documents"), table(spark, folder, "level_labels"))


def p8_accuracy(spark: SparkSession, folder: str) -> DataFrame:
    """How near the estimates come to ratings that the model has not seen."""
    return reading_level.accuracy(table(spark, folder, "documents"), table(spark, folder, "level_labels"))


QUERIES: dict[str, Query] = {
    "p1_found": p1_found,
    "p1_profile": p1_profile,
    "p3_found": p3_found,
    "p3_rates": p3_rates,
    "p3_limits": p3_limits,
    "p3_evidence": p3_evidence,
    "p4_found": p4_found,
    "p4_repaired": p4_repaired,
    "p5_percentiles": p5_percentiles,
    "p5_daily": p5_daily,
    "p5_counts": p5_counts,
    "p5_errors": p5_errors,
    "p5_bounds": p5_bounds,
    "p6_containers": p6_containers,
    "p6_fill": p6_fill,
    "p6_bounds": p6_bounds,
    "p7_mixture": p7_mixture,
    "p7_shares": p7_shares,
    "p7_supply_mixture": p7_supply_mixture,
    "p7_supply_shares": p7_supply_shares,
    "p7_entropy_mixture": p7_entropy_mixture,
    "p7_entropy_shares": p7_entropy_shares,
    "p7_bounds": p7_bounds,
    "p7_supply_bounds": p7_supply_bounds,
    "p7_entropy_bounds": p7_entropy_bounds,
    "p7_temperature": p7_temperature,
    "p8_levels": p8_levels,
    "p8_profile": p8_profile,
    "p8_accuracy": p8_accuracy,
}

_VALUES = r"""
        WITH reads AS (
            SELECT *, row_number() OVER (PARTITION BY read_id ORDER BY arrived_at DESC NULLS LAST) AS r FROM metrics_ingestion
        ), rates AS (
            SELECT *, row_number() OVER (PARTITION BY read_id ORDER BY arrived_at DESC NULLS LAST) AS r FROM metrics_tokenization
        ), v AS (
            SELECT 'duration_ms' AS metric,
                   CASE WHEN regexp_replace(regexp_replace(coalesce(extension, ''), '^[\s.*]+', ''), '\s+$', '') = '' THEN 'unknown'
                        ELSE lower(regexp_replace(regexp_replace(coalesce(extension, ''), '^[\s.*]+', ''), '\s+$', '')) END AS group_name,
                   CAST(duration_ms AS DOUBLE) AS x
            FROM reads WHERE r = 1 AND duration_ms >= 0
            UNION ALL
            SELECT 'tokens_per_sec', 'all', tokens_per_sec FROM rates
            WHERE r = 1 AND tokens_per_sec >= 0 AND isfinite(tokens_per_sec)
        )
    """
# What must hold of every mixture, whatever its draw.
_MIXTURE_HOLDS = "SELECT DISTINCT source, true AS within_repeats, true AS as_planned, true AS targets_met FROM source_targets WHERE source IS NOT NULL"

ORACLES: dict[str, str] = {
    "p6_bounds": """
        SELECT limit_name, (SELECT count(*) FROM documents) AS documents, 0 AS overfull, 0 AS repeated, 0 AS needless
        FROM (SELECT DISTINCT limit_name FROM pack_limits WHERE capacity_tokens > 0)
    """,
    "p7_bounds": _MIXTURE_HOLDS,
    "p7_supply_bounds": _MIXTURE_HOLDS,
    "p7_entropy_bounds": _MIXTURE_HOLDS,
    "p5_counts": _VALUES + "SELECT metric, group_name, count(*) AS n, min(x) AS low, max(x) AS high FROM v GROUP BY ALL",
    "p5_bounds": _VALUES + "SELECT metric, group_name, count(*) AS n, true AS within FROM v GROUP BY ALL",
}
