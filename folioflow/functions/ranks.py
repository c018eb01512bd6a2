"""Ranks and running sums within groups of any size.

A window over a group puts all its rows into one task. Here an integer order column is cut into blocks:
the blocks' totals are aggregated first, a window adds them up (a few rows per group), and the rows are only
ordered within their block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 4096


def _blocks(df: DataFrame, keys: list[str], order: str, amount: Column, block: int) -> DataFrame:
    before = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    sums = df.groupBy(*keys, "__block").agg(F.sum(amount).alias("__sum"))
    return sums.select(*keys, "__block", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__before"))


def running_sum(df: DataFrame, keys: list[str], order: str, amount: Column, name: str, ties: list[str] | None = None, block: int = BLOCK) -> DataFrame:
    """``df`` with the sum of ``amount`` over the rows of its group up to and with its own.

    ``order`` is an integer column; ``ties`` order rows that are equal in it. Null orders come first.
    """
    ties = ties or []
    marked = df.withColumn("__block", F.coalesce(F.floor(F.col(order) / block), F.lit(-(1 << 40)))).withColumn("__amount", amount)
    sums = _blocks(marked, keys, order, F.col("__amount"), block)
    within = Window.partitionBy(*keys, "__block").orderBy(order, *ties).rowsBetween(Window.unboundedPreceding, 0)
    joined = marked.withColumn("__own", F.sum("__amount").over(within)).join(_null_safe(sums, keys), _on(marked, sums, keys), "inner")
    return joined.withColumn(name, F.col("__own") + F.col("__before")).drop("__block", "__amount", "__own", "__before", "__b", *[f"__k{i}" for i in range(len(keys))])


def _null_safe(sums: DataFrame, keys: list[str]) -> DataFrame:
    return sums.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__block").alias("__b"), "__before")


def _on(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    on = F.col("__block") == F.col("__b")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    return on


def rank(df: DataFrame, keys: list[str], order: str, name: str, ties: list[str] | None = None, block: int = BLOCK) -> DataFrame:
    """``df`` with the row number, from 1, of each row in its group."""
    return running_sum(df, keys, order, F.lit(1).cast("long"), name, ties, block)
