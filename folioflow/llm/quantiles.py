"""Mergeable percentile sketches of numeric columns per group.

A sketch is a hierarchy of compactors: values of level h stand for 2^h values each. A level beyond its
capacity is sorted, every other value (from a random one of the first two) moves up, the rest is dropped.
Sketches merge level by level. Each compaction at level h moves any rank by at most 2^h, up or down with
equal chance, so that with S the sum of 4^h over all compactions the rank error exceeds
sqrt(2 S ln(2/delta)) with probability delta at most; S travels with the sketch and gives the bound of each
answer, however the sketch was put together.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Capacity of the top compactor, how capacities shrink downwards, the least capacity.
K, SHRINK, LEAST = 1024, 2 / 3, 16
DELTA = 0.01
SKETCH = "n long, low double, high double, spread double, levels array<array<double>>"
_ARROW = [("n", pa.int64()), ("low", pa.float64()), ("high", pa.float64()), ("spread", pa.float64()), ("levels", pa.list_(pa.list_(pa.float64())))]


class Sketch:
    """The state of one group; ``levels[h]`` is an array of values of weight 2^h."""

    def __init__(self, seed: int, k: int = K):
        self.k, self.rng = k, np.random.default_rng(seed)
        self.n, self.low, self.high, self.spread = 0, math.inf, -math.inf, 0.0
        self.levels: list[np.ndarray] = [np.empty(0)]

    def add(self, values: np.ndarray) -> None:
        if len(values):
            self.n += len(values)
            self.low, self.high = min(self.low, float(values.min())), max(self.high, float(values.max()))
            self.levels[0] = np.concatenate([self.levels[0], values])
            self.compact()

    def merge(self, n: int, low: float, high: float, spread: float, levels) -> None:
        if not n:
            return
        self.n, self.spread = self.n + n, self.spread + spread
        self.low, self.high = min(self.low, low), max(self.high, high)
        while len(self.levels) < len(levels):
            self.levels.append(np.empty(0))
        for h, values in enumerate(levels):
            if len(values):
                self.levels[h] = np.concatenate([self.levels[h], np.asarray(values, dtype=float)])
        self.compact()

    def capacity(self, level: int) -> int:
        return max(LEAST, int(self.k * SHRINK ** (len(self.levels) - 1 - level)))

    def compact(self) -> None:
        level = 0
        while level < len(self.levels):
            values = self.levels[level]
            if len(values) > self.capacity(level):
                if level + 1 == len(self.levels):
                    self.levels.append(np.empty(0))
                values = np.sort(values)
                even = len(values) - len(values) % 2
                start = int(self.rng.integers(2))
                self.levels[level + 1] = np.concatenate([self.levels[level + 1], values[start:even:2]])
                self.levels[level] = values[even:]
                self.spread += 4.0**level
            level += 1

    def row(self) -> tuple:
        return self.n, self.low, self.high, self.spread, [v.tolist() for v in self.levels]


def quantiles_of(n: int, low: float, high: float, levels, at: list[float]) -> list[float]:
    """The values at the given shares of the ranks; the ends are exact."""
    values = np.concatenate([np.asarray(v, dtype=float) for v in levels] or [np.empty(0)])
    weights = np.concatenate([np.full(len(v), 2.0**h) for h, v in enumerate(levels)] or [np.empty(0)])
    order = np.argsort(values, kind="stable")
    values, reach = values[order], np.cumsum(weights[order])
    out = []
    for p in at:
        if p <= 0 or p >= 1:
            out.append(low if p <= 0 else high)
        else:
            out.append(float(values[min(np.searchsorted(reach, p * reach[-1], side="left"), len(values) - 1)]))
    return out


def rank_error(n: int, spread: float, delta: float = DELTA) -> float:
    """The rank error, as a share of n, that is exceeded with probability ``delta`` at most."""
    return math.sqrt(2 * spread * math.log(2 / delta)) / n if n else 0.0


def _seed(*parts) -> int:
    return zlib.crc32(repr(parts).encode())


def sketches(rows: DataFrame, keys: list[str], value: str, k: int = K) -> DataFrame:
    """One sketch per task and group: ``keys``, task, and the fields of ``SKETCH``.

    Values are numbers; null, NaN and infinite values are left out. Each task keeps only the sketches
    of its groups, so that no values are shuffled.
    """
    v = F.col(value).cast("double")
    narrow = rows.select(*keys, v.alias("__v")).where(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(math.inf)))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.schema.fields[:-1]) + f", task int, {SKETCH}"
    width = len(keys)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, Sketch] = {}
        task = TaskContext.get().partitionId() if TaskContext.get() else 0
        types = None
        for batch in batches:
            types = batch.schema
            frame = batch.to_pandas()
            for key, values in frame.groupby(list(frame.columns[:width]), dropna=False, sort=False)[frame.columns[width]]:
                key = tuple(None if x is None or x is pd.NaT or x != x else x for x in key)
                if key not in held:
                    held[key] = Sketch(_seed(task, key), k)
                held[key].add(values.to_numpy(dtype=float))
        if types is not None and held:
            columns = [pa.array([key[i] for key in held], types.field(i).type) for i in range(width)]
            fields = list(zip(*(s.row() for s in held.values())))
            arrays = [*columns, pa.array([task] * len(held), pa.int32()), *(pa.array(f, t) for f, (_, t) in zip(fields, _ARROW))]
            yield pa.RecordBatch.from_arrays(arrays, names=[*types.names[:width], "task", *(n for n, _ in _ARROW)])

    return narrow.mapInArrow(build, schema)


def merge(parts: DataFrame, keys: list[str], k: int = K, fan: int = 32) -> DataFrame:
    """The merged sketch of each group. Two steps, so that a group of very many parts is no single task.

    ``parts`` are sketches of tasks, days, files or of anything else over other values. A task reads its groups one
    after another from sorted rows and holds one sketch at a time.
    """
    plain = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.schema.fields if f.name in keys)
    schema = (plain + ", " if plain else "") + SKETCH
    width, fields = len(keys), [n for n, _ in _ARROW]

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, total, done, types = None, None, [], None

        def flush() -> pa.RecordBatch:
            columns = [pa.array([r[0][i] for r in done], types[i]) for i in range(width)]
            rows = [pa.array([r[1][j] for r in done], t) for j, (_, t) in enumerate(_ARROW)]
            return pa.RecordBatch.from_arrays([*columns, *rows], names=[*keys, *fields])

        for batch in batches:
            types = [f.type for f in batch.schema][:width]
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                own = row[: width + 1]
                if total is None or own != key:
                    if total is not None:
                        done.append((key[:width], total.row()))
                    key, total = own, Sketch(_seed(own, *row[width + 1 : width + 5]), k)
                total.merge(*row[width + 1 :])
            if len(done) >= 512:
                yield flush()
                done = []
        if total is not None:
            done.append((key[:width], total.row()))
            yield flush()

    def step(rows: DataFrame, salt) -> DataFrame:
        salted = rows.select(*keys, salt.alias("__salt"), *fields)
        order = [*keys, "__salt"]
        return salted.repartition(*order).sortWithinPartitions(*order, "n", "low", "high", "spread").mapInArrow(together, schema)

    first = step(parts, (F.abs(F.xxhash64("n", "low", "high", "spread")) % fan).cast("int"))
    return step(first, F.lit(0))


def percentiles(merged: DataFrame, keys: list[str], at: list[float], delta: float = DELTA) -> DataFrame:
    """``keys``, n, low, high, one column per percentile (p50, p99_9), and the rank-error bound."""
    names = ["p" + f"{p * 100:g}".replace(".", "_") for p in at]
    plain = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in merged.schema.fields if f.name in keys)
    schema = plain + "n long, low double, high double, " + ", ".join(f"{n} double" for n in names) + ", rank_error double"

    def answer(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            q = [quantiles_of(r.n, r.low, r.high, r.levels, at) for r in f.itertuples(index=False)]
            out = f[[*keys, "n", "low", "high"]].copy()
            for i, name in enumerate(names):
                out[name] = [x[i] for x in q]
            out["rank_error"] = [rank_error(r.n, r.spread, delta) for r in f.itertuples(index=False)]
            yield out

    return merged.mapInPandas(answer, schema)


# ---- the log tables -------------------------------------------------------------------------------


def _delivered_once(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The latest delivery of each read_id; rows without read_id stay."""
    last = F.max_by(F.struct(*columns), F.coalesce(F.col("arrived_at"), F.lit("1970-01-01").cast("timestamp")))
    with_id = rows.where("read_id is not null").groupBy("read_id").agg(last.alias("r")).select("r.*")
    return with_id.unionByName(rows.where("read_id is null").select(*columns))


def extension_of(column: str = "extension") -> F.Column:
    """Extensions in one spelling: lower case, without dot and space; blank and null are ``unknown``."""
    bare = F.lower(F.regexp_replace(F.coalesce(F.col(column), F.lit("")), r"^[\s.*]+|\s+$", ""))
    return F.when(bare == "", F.lit("unknown")).otherwise(bare)


def logged_values(ingestion: DataFrame, tokenization: DataFrame) -> DataFrame:
    """metric, group_name, day, value: duration_ms per extension, tokens_per_sec over all files, each read once.

    Negative durations and rates are impossible and left out; the day is that of logged_at, null where it is null.
    """
    reads = _delivered_once(ingestion, ["extension", "duration_ms", "logged_at"]).where("duration_ms >= 0").select(
        F.lit("duration_ms").alias("metric"), extension_of().alias("group_name"), F.to_date("logged_at").cast("string").alias("day"), F.col("duration_ms").cast("double").alias("value")
    )
    rates = _delivered_once(tokenization, ["tokens_per_sec", "logged_at"]).where("tokens_per_sec >= 0").select(
        F.lit("tokens_per_sec").alias("metric"), F.lit("all").alias("group_name"), F.to_date("logged_at").cast("string").alias("day"), F.col("tokens_per_sec").cast("double").alias("value")
    )
    return reads.unionByName(rates)


def daily_sketches(ingestion: DataFrame, tokenization: DataFrame, k: int = K) -> DataFrame:
    """Sketches by metric, group and day of ``logged_values``; null and non-finite values are left out."""
    return sketches(logged_values(ingestion, tokenization), ["metric", "group_name", "day"], "value", k)


def rank_errors(estimates: DataFrame, values: DataFrame, keys: list[str], value: str, at: list[float]) -> DataFrame:
    """``keys``, n, worst_error, bound, within: the greatest true rank error of a group's percentiles, counted over all values, against its bound.

    ``estimates`` is that of ``percentiles``. All values of a group are counted in one grouping with partial sums; values equal to an
    estimate take all ranks between those below and those up to it.
    """
    names = ["p" + f"{p * 100:g}".replace(".", "_") for p in at]
    v = F.col(value).cast("double")
    rows = values.where(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(math.inf))).select(*keys, v.alias("__v")).join(estimates.drop("n", "low", "high"), keys)
    counts = [c for name in names for c in (F.count_if(F.col("__v") < F.col(name)).alias(f"below_{name}"), F.count_if(F.col("__v") <= F.col(name)).alias(f"upto_{name}"))]
    counted = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.max("rank_error").alias("bound"), *counts)
    errors = [F.greatest(F.lit(0.0), F.lit(p) - F.col(f"upto_{name}") / F.col("n"), F.col(f"below_{name}") / F.col("n") - F.lit(p)) for p, name in zip(at, names)]
    worst = F.greatest(*errors) if len(errors) > 1 else errors[0]
    # A rank is whole: of few values no estimate can be nearer than one of them.
    return counted.withColumn("worst_error", worst).select(*keys, "n", "worst_error", "bound", (F.col("worst_error") <= F.col("bound") + 1 / F.col("n")).alias("within"))
