import datetime as dt
import math

import numpy as np

from folioflow.llm import quantiles as qt

INGEST = "read_id long, extension string, duration_ms long, logged_at timestamp, arrived_at timestamp"
TOKENS = "read_id long, tokens_per_sec double, logged_at timestamp, arrived_at timestamp"
D, LATE = dt.datetime(2025, 1, 1), dt.datetime(2025, 1, 9)


def worst_rank_error(values, sketch):
    values, at = np.sort(values), [i / 50 for i in range(1, 50)]
    found = qt.quantiles_of(sketch.n, sketch.low, sketch.high, sketch.levels, at)
    low, high = np.searchsorted(values, found, "left"), np.searchsorted(values, found, "right")
    return max(max(0, a / len(values) - p, p - b / len(values)) for a, b, p in zip(low, high, at))


def test_sketches_stay_within_the_bound_however_they_are_merged():
    rng = np.random.default_rng(1)
    for values in (rng.lognormal(6, 2, 200_000), np.arange(100_000.0), np.repeat([1.0, 2.0, 9.0], 30_000)):
        parts = np.array_split(rng.permutation(values), 37)
        sketches = []
        for i, p in enumerate(parts):
            s = qt.Sketch(i)
            for chunk in np.array_split(p, 3):
                s.add(chunk)
            sketches.append(s)
        while len(sketches) > 1:
            a, b = sketches.pop(0), sketches.pop(0)
            a.merge(*b.row())
            sketches.append(a)
        s = sketches[0]
        bound = qt.rank_error(s.n, s.spread)
        assert s.n == len(values) and sum(len(v) * 2**h for h, v in enumerate(s.levels)) == s.n
        assert bound < 0.02 and worst_rank_error(values, s) <= bound
        assert sum(map(len, s.levels)) < 6 * qt.K
        assert (s.low, s.high) == (values.min(), values.max())


def test_small_groups_are_exact():
    s = qt.Sketch(0)
    s.add(np.array([3.0, 1.0, 2.0]))
    assert qt.quantiles_of(*[s.n, s.low, s.high, s.levels], [0, 0.3, 0.5, 0.9, 1]) == [1.0, 1.0, 2.0, 3.0, 3.0] and qt.rank_error(3, s.spread) == 0.0
    assert qt.rank_error(0, 0.0) == 0.0


def test_days_combine_into_the_whole(spark):
    rng = np.random.default_rng(2)
    values = rng.lognormal(5, 1, 60_000).astype(int)
    rows = [(i, [" PDF", "pdf", ".pdf "][i % 3], int(v), D + dt.timedelta(days=i % 7), D) for i, v in enumerate(values)]
    rows += [(5, "pdf", int(values[5]), D, LATE), (10**6, "pdf", -4, D, D), (10**6 + 1, "pdf", None, D, D), (10**6 + 2, None, 7, None, None), (10**6 + 3, " ", 8, D, D), (None, "md", 1, D, D), (None, "md", 1, D, D)]
    rates = [(1, 5.0, D, D), (1, 6.0, D, LATE), (2, float("nan"), D, D), (3, float("inf"), D, D), (4, None, D, D)]
    daily = qt.daily_sketches(spark.createDataFrame(rows, INGEST).repartition(5), spark.createDataFrame(rates, TOKENS))
    keys = ["metric", "group_name"]
    whole = {(r.metric, r.group_name): r for r in qt.percentiles(qt.merge(daily, keys), keys, [0.5, 0.999]).collect()}
    assert {k: r.n for k, r in whole.items()} == {("duration_ms", "pdf"): 60_000, ("duration_ms", "unknown"): 2, ("duration_ms", "md"): 2, ("tokens_per_sec", "all"): 1}
    assert whole[("tokens_per_sec", "all")].p50 == 6.0
    r = whole[("duration_ms", "pdf")]
    rank = (values <= r.p50).mean()
    assert (values < r.p50).mean() - r.rank_error <= 0.5 <= rank + r.rank_error and 0 < r.rank_error < 0.02 and r.p99_9 <= r.high
    days = qt.merge(daily, [*keys, "day"])
    again = {(r.metric, r.group_name): r.n for r in qt.merge(days, keys).collect()}
    assert again == {k: r.n for k, r in whole.items()}
    assert qt.merge(daily.limit(0), keys).count() == 0
    assert math.isinf(qt.Sketch(0).low)


def test_rank_errors_are_those_of_sorted_values(spark):
    rng = np.random.default_rng(4)
    given = {"a": rng.lognormal(3, 1, 5000), "b": np.repeat([1.0, 5.0], 300), "c": np.array([2.0])}
    values = spark.createDataFrame([(g, float(x)) for g, xs in given.items() for x in xs] + [("a", None), ("a", math.nan), ("b", math.inf)], "g string, x double")
    at = [0.1, 0.5, 0.9]
    rows = [(g, len(xs), 0.0, 0.0, float(np.quantile(xs, 0.13)), float(np.quantile(xs, 0.5)), float(np.quantile(xs, 0.9)), 0.01) for g, xs in given.items()]
    estimates = spark.createDataFrame(rows, "g string, n long, low double, high double, p10 double, p50 double, p90 double, rank_error double")
    got = {r.g: r for r in qt.rank_errors(estimates, values, ["g"], "x", at).collect()}
    assert {g: r.n for g, r in got.items()} == {g: len(xs) for g, xs in given.items()}
    assert abs(got["a"].worst_error - 0.03) < 0.001 and not got["a"].within and got["b"].worst_error == 0 and got["b"].within and got["c"].within
    assert qt.rank_errors(estimates, values.limit(0), ["g"], "x", at).count() == 0
