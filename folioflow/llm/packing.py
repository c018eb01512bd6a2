"""Texts into containers of fixed capacity, planned on the histogram of lengths.

The plan is best-fit decreasing over counts: all items of one length and all containers with the same
space left are handled at once. Its input is the histogram, with at most ``capacity`` rows, and the plan of L lengths has at most
L (1 + 3 log2 capacity) slots, however many documents there are: only the last slot of a length can split a group of
containers, into three, so that there are never more than 3 L groups; and a group that takes items of a length is left with less
than that length and with less than half its space, so that it takes items at most log2 capacity times. That bounds what the
driver sees. Documents then take the planned slots by joining on their rank within their length.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioflow.llm.tokens import RANKS, sized
from folioflow.session import cut

#: Items ranked by one task at most, about.
RANKED_TOGETHER = 250_000
#: Slots of a plan that is broadcast (about 40 MB).
BROADCAST = 500_000


def plan(histogram: Iterable[tuple[int, int]], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """(slots, containers) for a histogram of (length, count), lengths 1..capacity.

    A slot (length, rank_from, rank_to, first container, items per container) places the items of a length
    with ranks in [rank_from, rank_to): rank r goes to first + (r - rank_from) // items.
    """
    open_: dict[int, list[tuple[int, int]]] = {}
    spaces: list[int] = []
    slots: list[tuple[int, int, int, int, int]] = []
    made = 0

    def keep(space: int, first: int, count: int) -> None:
        if space and count:
            if space not in open_:
                bisect.insort(spaces, space)
                open_[space] = []
            open_[space].append((first, count))

    for length, left in sorted(histogram, reverse=True):
        rank = 0
        while left:
            at = bisect.bisect_left(spaces, length)
            if at == len(spaces):
                each = capacity // length
                bins = -(-left // each)
                first, space, made = made, capacity, made + bins
            else:
                space = spaces[at]
                each = space // length
                first, bins = open_[space].pop()
                if not open_[space]:
                    del open_[space]
                    spaces.pop(at)
                need = -(-left // each)
                if need < bins:
                    keep(space, first + need, bins - need)
                    bins = need
            placed = min(left, bins * each)
            slots.append((length, rank, rank + placed, first, each))
            whole, rest = divmod(placed, each)
            keep(space - each * length, first, whole)
            if rest:
                keep(space - rest * length, first + whole, 1)
            rank, left = rank + placed, left - placed
    return slots, made


def containers(documents: DataFrame, limits: DataFrame, path: str = RANKS) -> DataFrame:
    """limit_name, container_id, doc_id, piece, token_from, tokens: every document in each capacity.

    A text longer than the capacity is cut into full pieces, which fill containers of their own (``full-``),
    and one rest, which is packed like a whole text (``mix-``). Texts without tokens take no space and are
    spread over the containers (``mix-0`` if there is none). Null ids are packed as one more document each. Limits with null or
    non-positive capacity give no rows.
    """
    spark = documents.sparkSession
    sizes = cut(sized(documents, "doc_id", "text", path=path))
    caps = [(r.limit_name, r.capacity_tokens) for r in limits.where("capacity_tokens > 0").select("limit_name", "capacity_tokens").dropDuplicates().collect()]
    if not caps:
        return spark.createDataFrame([], "limit_name string, container_id string, doc_id long, piece int, token_from long, tokens long")
    wanted = spark.createDataFrame(caps, "limit_name string, capacity long")
    each = sizes.select("doc_id", "tokens", F.explode(F.array(*[F.struct(F.lit(n).alias("limit_name"), F.lit(int(c)).cast("long").alias("capacity")) for n, c in caps])).alias("l"))
    each = each.select("doc_id", "tokens", "l.*").withColumn("full", (F.col("tokens") / F.col("capacity")).cast("long")).withColumn("rest", F.col("tokens") % F.col("capacity"))
    full = each.where("full > 0").select("limit_name", "doc_id", "capacity", F.explode(F.sequence(F.lit(0), (F.col("full") - 1).cast("int"))).alias("piece"))
    full = full.select("limit_name", F.concat(F.lit("full-"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit("-"), "piece").alias("container_id"), "doc_id", "piece", (F.col("piece") * F.col("capacity")).alias("token_from"), F.col("capacity").alias("tokens"))
    rests = each.where("rest > 0").select("limit_name", "capacity", "doc_id", F.col("full").cast("int").alias("piece"), F.col("rest").alias("length"))
    counts = rests.groupBy("limit_name", "capacity", "length").agg(F.count("*").alias("n")).collect()  # at most the sum of the capacities
    slots, made = [], {}
    for name, capacity in caps:
        rows, made[name] = plan([(r.length, r.n) for r in counts if (r.limit_name, r.capacity) == (name, capacity)], capacity)
        slots += [(name, *r) for r in rows]
    buckets = max(16, -(-max((r.n for r in counts), default=1) // RANKED_TOGETHER))
    # Rank within a length, also of a length that holds a third of all rows: count per bucket, then rank within the bucket.
    marked = rests.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)))
    before = Window.partitionBy("limit_name", "length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = marked.groupBy("limit_name", "length", "bucket").agg(F.count("*").alias("n")).select("limit_name", "length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("limit_name", "length", "bucket").orderBy("doc_id", "piece")
    ranked = marked.withColumn("within", F.row_number().over(within) - 1).join(offsets, ["limit_name", "length", "bucket"]).withColumn("rank", F.col("offset") + F.col("within"))
    planned = spark.createDataFrame(slots, "limit_name string, length long, rank_from long, rank_to long, first long, each long")
    # Bounded by the capacities (see above); of capacities so large that the plan itself is, the join is left to Spark.
    taken = ranked.join(F.broadcast(planned) if len(slots) <= BROADCAST else planned, ["limit_name", "length"]).where("rank >= rank_from and rank < rank_to")
    mixed = taken.select(
        "limit_name", F.concat(F.lit("mix-"), (F.col("first") + F.floor((F.col("rank") - F.col("rank_from")) / F.col("each"))).cast("string")).alias("container_id"),
        "doc_id", "piece", (F.col("piece") * F.col("capacity")).alias("token_from"), F.col("length").alias("tokens"),
    )
    n_made = F.element_at(F.create_map(*[x for name, n in made.items() for x in (F.lit(name), F.lit(max(n, 1)).cast("long"))]), F.col("limit_name"))
    none = each.where("tokens = 0").select("limit_name", F.concat(F.lit("mix-"), F.pmod(F.xxhash64("doc_id"), n_made).cast("string")).alias("container_id"), "doc_id", F.lit(0).alias("piece"), F.lit(0).cast("long").alias("token_from"), F.lit(0).cast("long").alias("tokens"))
    return mixed.unionByName(full).unionByName(none)


def fill(assigned: DataFrame, limits: DataFrame) -> DataFrame:
    """Per limit: containers, tokens, the share of their space that is used, and how many texts were split."""
    used = assigned.groupBy("limit_name", "container_id").agg(F.sum("tokens").alias("tokens"))
    total = used.groupBy("limit_name").agg(F.count("*").alias("containers"), F.sum("tokens").alias("tokens"), F.max("tokens").alias("fullest"))
    split = assigned.where("piece > 0").groupBy("limit_name").agg(F.count_distinct("doc_id").alias("texts_split"))
    joined = total.join(split, "limit_name", "left").na.fill(0, ["texts_split"]).join(limits.select("limit_name", "capacity_tokens").dropDuplicates(["limit_name"]), "limit_name")
    return joined.withColumn("used_share", F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")))


def bounds(assigned: DataFrame, limits: DataFrame) -> DataFrame:
    """limit_name, documents (distinct ones assigned), overfull (containers beyond the capacity), repeated (pieces assigned twice),
    needless (texts split though they fit)."""
    caps = limits.where("capacity_tokens > 0").select("limit_name", "capacity_tokens").dropDuplicates(["limit_name"])
    boxes = assigned.groupBy("limit_name", "container_id").agg(F.sum("tokens").alias("tokens")).join(caps, "limit_name")
    over = boxes.groupBy("limit_name").agg(F.count_if(F.col("tokens") > F.col("capacity_tokens")).alias("overfull"))
    texts = assigned.groupBy("limit_name", "doc_id").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("pieces"), F.count_distinct("piece").alias("distinct")).join(caps, "limit_name")
    told = texts.groupBy("limit_name").agg(
        F.count("*").alias("documents"), F.sum(F.col("pieces") - F.col("distinct")).alias("repeated"), F.count_if((F.col("pieces") > 1) & (F.col("tokens") <= F.col("capacity_tokens"))).alias("needless")
    )
    return told.join(over, "limit_name").select("limit_name", "documents", "overfull", "repeated", "needless")
