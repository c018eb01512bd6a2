"""Mixtures of sources by target shares of tokens, with a limit on repeats.

Temperature mixing: token shares are raised to an exponent and normalised, and the exponent is found by bisection. Two families of
weights use it. ``targets`` raises the ratio of target to own share: at 1 the weights are the targets, at 0 the own shares; the
exponent is the largest that keeps every source within its repeats at the wanted size, and without a wanted size the largest size is
taken at which it is 1, so that the targets hold exactly. ``entropy`` raises the own shares themselves: the exponent is that at
which their entropy is that of the targets (how flat the mixture is to be, whatever the single targets), or the nearest that keeps every source within its repeats.
Each source's budget is then realised as whole passes and a prefix of a random permutation of blocks
of its documents, so that only sums of blocks are ordered, never all documents of a source.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioflow.llm.tokens import RANKS, sized
from folioflow.session import cut

#: Documents per block, about; a source's blocks are what is ordered.
BLOCK = 20_000
STEPS = 60


def entropy(shares: list[float]) -> float:
    return -sum(p * math.log(p) for p in shares if p > 0)


def tempered(shares: list[float], exponent: float) -> list[float]:
    """Shares raised to an exponent and normalised; a share of 0 stays 0."""
    raised = [math.exp(exponent * math.log(p)) if p > 0 else 0.0 for p in shares]
    total = sum(raised)
    return [r / total if total else 0.0 for r in raised]


def exponent_for_entropy(shares: list[float], wanted: float) -> float:
    """The exponent in [0, 16] at which the tempered shares have the wanted entropy, or the nearest end."""
    low, high = 0.0, 16.0  # entropy falls with the exponent
    for _ in range(STEPS):
        mid = (low + high) / 2
        low, high = (mid, high) if entropy(tempered(shares, mid)) > wanted else (low, mid)
    return (low + high) / 2


def _last_fitting(fits, good: float, wanted: float) -> float:
    """The exponent nearest to ``wanted`` that fits, bisected from ``good``, which does."""
    if fits(wanted):
        return wanted
    for _ in range(STEPS):
        mid = (good + wanted) / 2
        good, wanted = (mid, wanted) if fits(mid) else (good, mid)
    return good


def plan(sources: list[tuple[str, float, int, int]], size: int | None = None, by: str = "targets") -> tuple[float, dict[str, tuple[float, float]]]:
    """(exponent, {source: (weight, token budget)}) for (source, target share, max repeats, tokens).

    Sources without tokens, share or repeats get no weight; the other targets are then scaled up to 1. A wanted size beyond
    all repeats together is cut to them, one beyond what any exponent can give to what the own shares give.
    """
    can = [(s, share, repeats, tokens) for s, share, repeats, tokens in sources if share > 0 and repeats > 0 and tokens > 0]
    if not can:
        return 1.0, {}
    supply = [repeats * tokens for _, _, repeats, tokens in can]
    target = tempered([share for _, share, _, _ in can], 1.0)
    own = tempered([float(tokens) for *_, tokens in can], 1.0)

    if by == "entropy":
        weights, good = (lambda x: tempered(own, x)), 1.0
        best = exponent_for_entropy(own, entropy(target))
    else:
        gives = tempered([float(c) for c in supply], 1.0)
        weights, good, best = (lambda x: tempered([g * math.exp(x * math.log(t / g)) for t, g in zip(target, gives)], 1.0)), 0.0, 1.0

    def most(exponent: float) -> float:
        """The largest size at which no source is used beyond its repeats."""
        return min(c / w for c, w in zip(supply, weights(exponent)))

    wanted = most(best) if size is None else min(float(size), float(sum(supply)))
    if by == "entropy":
        wanted = min(wanted, most(good))
    exponent = _last_fitting(lambda x: most(x) >= wanted * (1 - 1e-12), good, best)
    return exponent, {s: (w, min(w * wanted, float(c))) for (s, *_), c, w in zip(can, supply, weights(exponent))}


def _wanted(size: int | str | None, sources: list[tuple[str, float, int, int]]) -> int | None:
    """The size in tokens; ``supply`` is that of all documents of the listed sources, once each."""
    return sum(tokens for _, _, _, tokens in sources) if size == "supply" else size


def _sized(documents: DataFrame, path: str) -> DataFrame:
    return cut(sized(documents, "doc_id", "text", ["source"], path))


def _listed(sizes: DataFrame, targets: DataFrame) -> list[tuple[str, float, int, int]]:
    """(source, share, repeats, tokens) of the sources in ``targets``; as many rows as that table has."""
    totals = sizes.groupBy("source").agg(F.sum("tokens").alias("tokens"))
    one = targets.groupBy("source").agg(F.max("target_share").alias("share"), F.max("max_repeats").alias("repeats")).where("source is not null")
    rows = one.join(totals, "source", "left").collect()
    return sorted((r.source, float(r.share or 0), int(r.repeats or 0), int(r.tokens or 0)) for r in rows)


def _uses(sizes: DataFrame, budgets: dict[str, tuple[float, float]], sources: list[tuple[str, float, int, int]], seed: int) -> DataFrame:
    """doc_id, source, tokens, uses of the documents with at least one use."""
    spark = sizes.sparkSession
    have = {s: tokens for s, _, _, tokens in sources}
    rows = [(s, int(b // have[s]), float(b - (b // have[s]) * have[s])) for s, (_, b) in budgets.items()]
    wanted = spark.createDataFrame(rows, "source string, passes long, rest double")
    n = sizes.count()
    blocks = max(16, -(-n // BLOCK))
    mark = F.pmod(F.xxhash64(F.lit(seed), "doc_id", "tokens"), F.lit(blocks))
    marked = sizes.join(F.broadcast(wanted), "source").withColumn("block", mark)
    earlier = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = marked.groupBy("source", "block").agg(F.sum("tokens").alias("in_block")).withColumn("before", F.coalesce(F.sum("in_block").over(earlier), F.lit(0)))
    placed = marked.join(sums, ["source", "block"])
    inside = F.col("before") + F.col("in_block") <= F.col("rest")
    edge = ~inside & (F.col("before") < F.col("rest"))
    order = Window.partitionBy("source", "block").orderBy(F.xxhash64(F.lit(seed + 1), "doc_id", "tokens"), "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    columns = ["doc_id", "source", "tokens"]
    plain = placed.where(~edge).select(*columns, (F.col("passes") + F.when(inside, 1).otherwise(0)).alias("uses"))
    # The one block at the edge of each budget: the document that crosses it is taken if that comes nearer.
    at_edge = placed.where(edge).withColumn("sum", F.coalesce(F.sum("tokens").over(order), F.lit(0)))
    crossing = at_edge.select(*columns, (F.col("passes") + F.when(F.col("before") + F.col("sum") + F.col("tokens") / 2 <= F.col("rest"), 1).otherwise(0)).alias("uses"))
    return plain.unionByName(crossing).where("uses > 0")


def mixture(documents: DataFrame, targets: DataFrame, size: int | str | None = None, seed: int = 7, path: str = RANKS, by: str = "targets") -> DataFrame:
    """doc_id, source, use, tokens, position: one row per use of a document.

    Positions in [0, 1) put the uses into one order in which every source is spread evenly and each pass is
    finished before the next. Documents of unlisted or null sources are not used; texts without tokens are used
    like others. An empty table or no feasible target gives no rows.
    """
    sizes = _sized(documents, path)
    sources = _listed(sizes, targets)
    _, budgets = plan(sources, _wanted(size, sources), by)
    uses = _uses(sizes, budgets, sources, seed)
    rows = uses.withColumn("use", F.explode(F.sequence(F.lit(0), (F.col("uses") - 1).cast("int"))))
    chance = F.pmod(F.xxhash64(F.lit(seed + 2), "doc_id", "use"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return rows.select("doc_id", "source", "use", "tokens", ((F.col("use") + chance) / F.col("uses")).alias("position"))


def shares(documents: DataFrame, targets: DataFrame, size: int | str | None = None, seed: int = 7, path: str = RANKS, by: str = "targets") -> DataFrame:
    """Per listed source: target, own, tempered and actual share, tokens there and used, most uses of a document, and the exponent."""
    sizes = _sized(documents, path)
    sources = _listed(sizes, targets)
    exponent, budgets = plan(sources, _wanted(size, sources), by)
    used = _uses(sizes, budgets, sources, seed).groupBy("source").agg(F.sum(F.col("tokens") * F.col("uses")).alias("tokens_used"), F.max("uses").alias("most_uses"), F.count("*").alias("documents_used"))
    spark = documents.sparkSession
    there = float(max(sum(tokens for *_, tokens in sources), 1))
    rows = [(s, share, repeats, tokens, tokens / there, budgets.get(s, (0.0, 0.0))[0], budgets.get(s, (0.0, 0.0))[1]) for s, share, repeats, tokens in sources]
    listed = spark.createDataFrame(rows, "source string, target_share double, max_repeats int, tokens_there long, own_share double, tempered_share double, budget double")
    joined = cut(listed.join(used, "source", "left").na.fill(0, ["tokens_used", "most_uses", "documents_used"]))
    total = joined.agg(F.sum("tokens_used").alias("n")).first().n or 0
    return joined.withColumn("actual_share", F.col("tokens_used") / F.lit(float(max(total, 1)))).withColumn("exponent", F.lit(exponent))


def bounds(report: DataFrame) -> DataFrame:
    """source, within_repeats, as_planned, targets_met: what must hold of a report of ``shares``, whatever its rows.

    As planned: each actual share is within 0.01 of the tempered one. Targets met: where the exponent is 1, as in a
    mixture of the largest size that the targets allow, tempered shares are the targets (of the sources that have any tokens).
    """
    can = (F.col("target_share") > 0) & (F.col("max_repeats") > 0) & (F.col("tokens_there") > 0)
    feasible = report.agg(F.sum(F.when(can, F.col("target_share"))).alias("n")).first().n or 1.0
    near = F.abs(F.col("actual_share") - F.col("tempered_share")) <= 0.01
    met = (F.abs(F.col("exponent") - 1) > 1e-9) | ~can | (F.abs(F.col("tempered_share") - F.col("target_share") / F.lit(feasible)) <= 1e-6)
    return report.select("source", (F.col("most_uses") <= F.col("max_repeats")).alias("within_repeats"), near.alias("as_planned"), met.alias("targets_met"))


def temperature(documents: DataFrame, targets: DataFrame, path: str = RANKS) -> DataFrame:
    """Per listed source: its share of the tokens there, and that share tempered to the entropy of the targets."""
    sizes = _sized(documents, path)
    sources = _listed(sizes, targets)
    there = [t for *_, t in sources]
    own = [t / max(sum(there), 1) for t in there]
    exponent = exponent_for_entropy(own, entropy(tempered([s for _, s, _, _ in sources], 1.0)))
    rows = [(s, share, p, q, exponent) for (s, share, _, _), p, q in zip(sources, own, tempered(own, exponent))]  # as many as ``targets`` has
    return documents.sparkSession.createDataFrame(rows, "source string, target_share double, own_share double, tempered_share double, exponent double")
