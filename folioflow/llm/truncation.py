"""Replies whose text, or a value carried in it, stops before its end.

Three kinds of evidence are combined as log odds: the nesting left open (a pushdown parser), the ending
word of each unfinished value (``endings``), and the censoring posterior of the length. For the last,
the lengths of all texts and of all values, ended or not, are taken as log-normal per source and field, in
characters and in bytes, right-censored at candidate limits, and fitted by maximum likelihood with EM over a
histogram; at a limit the posterior compares the mass censored there with complete texts of just that length.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.llm import endings, markup
from folioflow.session import cut, spread

_ENDING = pa.struct([("field", pa.string()), ("length", pa.int32()), ("octets", pa.int32()), ("token", pa.string()), ("kind", pa.string()), ("multi", pa.bool_()), ("single", pa.bool_())])
_ENDED = pa.struct([("field", pa.string()), ("length", pa.int32()), ("octets", pa.int32())])
_ROWS = pa.schema([
    ("row", pa.string()), ("id", pa.int64()), ("arrived", pa.timestamp("us", "UTC")), ("source", pa.string()), ("finish", pa.string()),
    ("length", pa.int32()), ("octets", pa.int32()), ("left_open", pa.bool_()), ("shape", pa.string()),
    ("endings", pa.list_(_ENDING)), ("ended", pa.list_(_ENDED)), ("token", pa.string()), ("inner", pa.int64()), ("final", pa.int64()),
])
ROWS = (
    "row string, id long, arrived timestamp, source string, finish string, length int, octets int, left_open boolean, shape string, "
    "endings array<struct<field:string,length:int,octets:int,token:string,kind:string,multi:boolean,single:boolean>>, "
    "ended array<struct<field:string,length:int,octets:int>>, token string, inner long, final long"
)
#: Log odds that a value without final mark is cut, before its ending is seen: after whole sentences, and else.
PRIOR_MULTI, PRIOR_SINGLE = -1.0, -2.5
#: How much a final sentence mark or bracket, and a payload closed as it should be, speak for completeness: a cut at any place
#: of a text falls behind a mark about once in 90, and leaves closed nesting about once in 3,000 characters. What open nesting says.
STOP_LLR, CLOSED_LLR, OPEN_LLR = -4.5, -8.0, 8.0
#: The most that a length may say.
LENGTH_CAP = 7.0
#: The most that the finish reason may say; what it says is measured on the replies left open.
SAID_CAP = 1.0
#: A candidate limit holds at least so many values, and so many times what lengths nearby hold (templates make some
#: lengths frequent); shorter ones are words and labels, whose lengths repeat anyway.
LIMIT_COUNT, LIMIT_RATIO, NEARBY, LIMIT_LEAST = 6, 5.0, 25, 40
#: Limits that are broadcast at most (about 20 MB).
BROADCAST = 200_000
#: The field name of whole texts.
WHOLE = ""


def _octets(text: str) -> int:
    return len(text) if text.isascii() else len(text.encode("utf-8", "replace"))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, arrived, sources, finishes, texts = (c.to_pylist() for c in batch.columns)
        out: dict[str, list] = {f.name: [] for f in _ROWS}
        prose: list[str] = []
        for i, at, source, finish, text in zip(ids, arrived, sources, finishes, texts):
            left_open, values = markup.carried(text)
            unended, ended = [], []
            for field, value in values:
                prose.append(value)
                kind, token = endings.ending(value)
                field = field.encode("utf-8", "replace").decode() if not field.isascii() else field
                if kind in ("stop", "closed") and field != "prose":
                    ended.append({"field": field, "length": len(value), "octets": _octets(value)})
                    continue
                inside = value[:-2]
                multi = ". " in inside or "? " in inside or "! " in inside or ".\n" in inside
                unended.append({"field": field, "length": len(value), "octets": _octets(value), "token": token, "kind": kind, "multi": multi, "single": " " not in value.strip()})
            shape = "json" if not (len(values) == 1 and values[0][0] == "prose") else "prose"
            for name, x in zip(
                ("row", "id", "arrived", "source", "finish", "length", "octets", "left_open", "shape", "endings", "ended", "token", "inner", "final"),
                ("reply", i, at, source, finish, len(text), _octets(text), left_open, shape, unended, ended, None, None, None),
            ):
                out[name].append(x)
        yield pa.RecordBatch.from_pydict(out, schema=_ROWS)
        counts = endings.count_tokens(prose)
        n = len(counts)
        blank = {f.name: pa.nulls(n, f.type) for f in _ROWS}
        blank |= {"row": pa.array(["token"] * n), "token": pa.array(list(counts)), "inner": pa.array([c[0] for c in counts.values()], pa.int64()), "final": pa.array([c[1] for c in counts.values()], pa.int64())}
        yield pa.RecordBatch.from_pydict(blank, schema=_ROWS)


def _phi(z: float) -> float:
    return 0.5 * math.erfc(-z / math.sqrt(2))


def fit_censored(
    lengths: list[float], counts: list[float], limits: list[tuple[float, float]], rounds: int = 40, usual: list[float] | None = None
) -> tuple[float, float, list[float]]:
    """(mu, sigma, posterior of being censored per limit) of log-normal lengths by EM.

    ``limits`` are (length, count) not contained in ``lengths``. A value at a limit is censored with the
    posterior 1 - expected complete values of that length / values seen there; its share enters the
    likelihood as S(limit), the rest as a density. ``usual`` are counts that complete values may well reach at the
    limits (from lengths nearby); the larger of both is expected.
    """
    usual = usual or [0.0] * len(limits)
    logs = [math.log(max(x, 1.0)) for x in lengths]
    total = sum(counts)
    if total < 2:
        return 0.0, 1.0, [0.5 if n else 0.0 for _, n in limits]
    mu = sum(x * n for x, n in zip(logs, counts)) / total
    sigma = max(0.05, math.sqrt(sum((x - mu) ** 2 * n for x, n in zip(logs, counts)) / total))
    s1, s2 = sum(x * n for x, n in zip(logs, counts)), sum(x * x * n for x, n in zip(logs, counts))
    posts = [0.5] * len(limits)
    for _ in range(rounds):
        t1, t2, n_all = s1, s2, total
        whole = total + sum(n for _, n in limits)
        for k, (limit, n) in enumerate(limits):
            low, high = (math.log(max(limit - 0.5, 0.5)) - mu) / sigma, (math.log(limit + 0.5) - mu) / sigma
            posts[k] = max(0.0, 1 - max(whole * (_phi(high) - _phi(low)), usual[k]) / n)
            x = math.log(limit)
            z = (x - mu) / sigma
            tail = max(_phi(-z), 1e-9)
            hazard = math.exp(-z * z / 2) / math.sqrt(2 * math.pi) / tail
            m1 = mu + sigma * hazard
            m2 = mu * mu + 2 * mu * sigma * hazard + sigma * sigma * (1 + z * hazard)
            p = posts[k]
            t1 += n * (p * m1 + (1 - p) * x)
            t2 += n * (p * m2 + (1 - p) * x * x)
            n_all += n
        mu, sigma = t1 / n_all, max(0.05, math.sqrt(max(t2 / n_all - (t1 / n_all) ** 2, 1e-6)))
    return mu, sigma, posts


_KEYS = ["source", "field", "unit"]
_LIMITS = "source string, field string, unit string, length long, n long, posterior double, mu double, sigma double"


def _fit(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    at_limit = rows[rows.limit]
    rest = rows[~rows.limit]
    mu, sigma, posts = fit_censored(rest.length.tolist(), rest.n.tolist(), list(zip(at_limit.length.tolist(), at_limit.n.tolist())), usual=at_limit.usual.tolist())
    return pd.DataFrame({
        "source": key[0], "field": key[1], "unit": key[2], "length": at_limit.length.astype("int64").tolist(), "n": at_limit.n.astype("int64").tolist(),
        "posterior": posts, "mu": mu, "sigma": sigma,
    })


def censoring(lengths: DataFrame) -> DataFrame:
    """Candidate limits of each source, field and unit with their censoring posterior.

    ``lengths`` has source, field, length (characters) and octets (bytes), a row for each text or value. Lengths are counted exactly, on
    the executors; limits are lengths that stand out from those nearby; all other lengths enter the fit
    in 64 bins per factor e, so that one fit reads at most about 1,400 rows however many values
    there are. Only keys with a candidate are fitted.
    """
    pairs = lengths.where("length > 0").groupBy("source", "field", "length", "octets").agg(F.count("*").alias("n"))
    units = F.explode(F.array(F.struct(F.lit("chars").alias("unit"), F.col("length").alias("length")), F.struct(F.lit("bytes").alias("unit"), F.col("octets").alias("length"))))
    counted = pairs.select("source", "field", units.alias("u"), "n").groupBy("source", "field", "u.unit", "u.length").agg(F.sum("n").alias("n"))
    near = Window.partitionBy(*_KEYS).orderBy("length").rangeBetween(-NEARBY, NEARBY)
    expected = (F.sum("n").over(near) - F.col("n")) / (2 * NEARBY)
    marked = counted.withColumn("usual", LIMIT_RATIO * expected)
    marked = marked.withColumn("limit", (F.col("n") >= LIMIT_COUNT) & (F.col("n") > F.col("usual")) & (F.col("length") >= LIMIT_LEAST))
    marked = marked.withColumn("any", F.max("limit").over(Window.partitionBy(*_KEYS))).where("any")
    bin_ = F.when(F.col("limit"), -F.col("length")).otherwise(F.floor(F.log("length") * 64))
    binned = marked.groupBy(*_KEYS, "limit", bin_.alias("bin")).agg(
        (F.sum(F.col("length") * F.col("n")) / F.sum("n")).alias("length"), F.sum("n").cast("double").alias("n"), F.sum("usual").alias("usual")
    )
    return binned.select(*_KEYS, "limit", "length", "n", "usual").groupBy(*_KEYS).applyInPandas(_fit, _LIMITS)


def evidence(replies: DataFrame) -> DataFrame:
    """Parsed replies and word counts, written once to the shared folder and read by all later steps.

    Needs reply_id, provider, finish_reason, status, text, arrived_at. Only status ``ok`` with a text that is not blank
    is read; the parse runs before redelivered copies are removed, since only narrow rows follow it.
    """
    rows = replies.where((F.lower("status") == "ok") & F.col("text").rlike(r"\S")).select(
        F.col("reply_id").cast("long"), F.col("arrived_at").cast("timestamp"), F.coalesce(F.col("provider"), F.lit("")).alias("source"),
        F.lower(F.trim(F.coalesce("finish_reason", F.lit("")))).alias("finish"), "text"
    )
    return cut(spread(rows).mapInArrow(_read, ROWS))


def _latest(rows: DataFrame) -> DataFrame:
    columns = ["source", "finish", "length", "octets", "left_open", "shape", "endings", "ended"]
    one = rows.where("row = 'reply'").groupBy("id").agg(F.max_by(F.struct(*columns), F.coalesce("arrived", F.lit("1970-01-01").cast("timestamp"))).alias("r"))
    return cut(one.select("id", "r.*"))  # read by six branches


def _lengths(replies: DataFrame) -> DataFrame:
    """source, field, length, octets of all texts (field ``WHOLE``) and all values carried in JSON."""
    texts = F.array(F.struct(F.lit(WHOLE).alias("field"), "length", "octets"))
    narrow = F.transform(F.filter("endings", lambda e: e["field"] != "prose"), lambda e: F.struct(e["field"].alias("field"), e["length"].alias("length"), e["octets"].alias("octets")))
    return replies.select("source", F.explode(F.concat(texts, narrow, "ended")).alias("v")).select("source", "v.*")


def _held(limits_: DataFrame) -> DataFrame:
    """The limits as unit, source, field, at, odds, to be joined to values; broadcast if there are few, as a count of them tells."""
    p = F.least(F.greatest("posterior", F.lit(0.0)), F.lit(0.9999))
    odds = F.least(F.greatest(F.log((p + 1e-4) / (1 - p)), F.lit(0.0)), F.lit(LENGTH_CAP))
    held = limits_.select("unit", "source", "field", F.col("length").cast("int").alias("at"), odds.alias("odds")).where("odds > 0")
    return F.broadcast(held) if limits_.count() <= BROADCAST else held


def _by_length(rows: DataFrame, held: DataFrame) -> DataFrame:
    """``rows`` (source, field, length, octets and others) with ``by_length``: the log odds of its length in characters or bytes, 0 at no limit."""
    for unit, measured in (("chars", "length"), ("bytes", "octets")):
        of_unit = held.where(F.col("unit") == unit).select("source", "field", F.col("at").alias(measured), F.col("odds").alias(unit))
        rows = rows.join(of_unit, ["source", "field", measured], "left")
    return rows.withColumn("by_length", F.greatest(F.coalesce("chars", F.lit(0.0)), F.coalesce("bytes", F.lit(0.0)))).drop("chars", "bytes")


def judged(rows: DataFrame) -> DataFrame:
    """One row per reply: id, source, length, left_open, log_odds, field and last token of the value most likely cut, cut.

    ``at_limit``, ``without_length`` and ``without_nesting`` tell what the evidence does: whether its length alone makes the
    text or a value more likely cut than not, and the verdict without the lengths, and without the nesting.
    """
    replies = _latest(rows)
    ends = replies.select("id", "source", F.explode("endings").alias("e")).select("id", "source", "e.*")
    asked = ends.where("token <> '' and kind in ('word', 'marked', 'hanging')").groupBy("token").agg(F.count_if(~F.col("multi")).alias("ends"), F.count("*").alias("unmarked"))
    table = endings.token_table(rows.where("row = 'token'").select("token", "inner", "final"), asked)
    held = _held(cut(censoring(_lengths(replies))))
    ended = _by_length(replies.select("id", "source", F.explode("ended").alias("e")).select("id", "source", "e.*"), held).where("by_length > 0")

    llr = F.coalesce(F.when(F.col("single"), F.col("word_llr")).otherwise(F.col("cut_llr")), F.lit(0.0))
    prior = F.when(F.col("multi"), PRIOR_MULTI).otherwise(PRIOR_SINGLE)
    odds = (
        F.when(F.col("kind").isin("stop", "closed"), STOP_LLR).when(F.col("kind") == "open", 3.0)
        .when(F.col("kind") == "hanging", 2.5 + prior + llr).when(F.col("kind") == "marked", 2.0 + prior + llr).otherwise(prior + llr)
    )
    scored = _by_length(ends, held).join(table.select("token", "cut_llr", "word_llr"), "token", "left").select("id", "field", "token", odds.alias("odds"), "by_length")
    # Of the values that ended only those at a limit can count.
    scored = scored.unionByName(ended.select("id", "field", F.lit("").alias("token"), F.lit(STOP_LLR).alias("odds"), "by_length"))
    worst = scored.groupBy("id").agg(
        F.max(F.when(F.col("field") == "prose", F.col("odds"))).alias("prose_odds"),
        F.max(F.when(F.col("field") != "prose", F.col("odds") + F.col("by_length"))).alias("value_odds"),
        F.max(F.col("odds")).alias("plain_odds"), F.max("by_length").alias("value_length"),
        F.max_by(F.struct("field", "token"), F.col("odds") + F.col("by_length")).alias("at"),
    )
    whole_open, whole_n = replies.agg(F.count_if("left_open"), F.count("*")).first()
    said = replies.groupBy("finish").agg(F.count_if("left_open").alias("open"), F.count("*").alias("n"))
    ratio = F.log((F.col("open") + 1) / F.lit(whole_open + 2.0)) - F.log((F.col("n") - F.col("open") + 1) / F.lit(whole_n - whole_open + 2.0))
    said = said.select("finish", F.least(F.greatest(ratio, F.lit(-SAID_CAP)), F.lit(SAID_CAP)).alias("said"))
    texts = _by_length(replies.select("id", "source", "finish", "length", "octets", "left_open", "shape", F.lit(WHOLE).alias("field")), held)
    joined = texts.withColumnRenamed("by_length", "text_length").drop("field").join(worst, "id", "left").join(said, "finish", "left")
    by_text, low = F.coalesce("text_length", F.lit(0.0)), F.lit(-20.0)

    def verdict(lengths: bool, nesting: bool) -> Column:
        """Log odds of the text and of its worst value: the larger."""
        add = by_text if lengths else F.lit(0.0)
        closed = F.lit(CLOSED_LLR) if nesting else F.lit(PRIOR_SINGLE)
        text = F.when(F.col("shape") == "prose", F.coalesce("prose_odds", F.lit(STOP_LLR)) + add).otherwise(closed + add)
        text = F.when(F.col("left_open"), OPEN_LLR + add).otherwise(text) if nesting else text
        return F.greatest(text, F.coalesce(F.col("value_odds" if lengths else "plain_odds"), low)) + F.coalesce("said", F.lit(0.0))

    log_odds = verdict(True, True)
    return joined.select(
        "id", "source", "length", "left_open", log_odds.alias("log_odds"), F.col("at.field").alias("field"), F.col("at.token").alias("token"), (log_odds > 0).alias("cut"),
        (F.greatest(by_text, F.coalesce("value_length", F.lit(0.0))) > 0).alias("at_limit"), (verdict(False, True) > 0).alias("without_length"),
        (verdict(True, False) > 0).alias("without_nesting"), (verdict(False, False) > 0).alias("without_both"),
    )


def found(replies: DataFrame) -> DataFrame:
    """The ids of the replies that stop early, once each. Blank texts and empty tables give none."""
    return judged(evidence(replies)).where("cut").select(F.col("id").alias("reply_id"))


def rates(replies: DataFrame) -> DataFrame:
    """Per source: replies with status ok (blank ones too), how many are cut, and the share."""
    total = replies.where(F.lower("status") == "ok").groupBy(F.coalesce("provider", F.lit("")).alias("source")).agg(F.count_distinct("reply_id").alias("replies"))
    cuts = judged(evidence(replies)).where("cut").groupBy("source").agg(F.count("*").alias("cut"))
    both = total.join(cuts, "source", "left").na.fill(0, ["cut"])
    return both.withColumn("share", F.col("cut") / F.col("replies"))


def ablation(replies: DataFrame) -> DataFrame:
    """Per source: replies cut, at a limit, cut by the lengths only, and cut if lengths, nesting or both were not looked at."""
    rows = judged(evidence(replies))
    return rows.groupBy("source").agg(
        F.count_if("cut").alias("cut"), F.count_if("at_limit").alias("at_limit"), F.count_if(F.col("cut") & ~F.col("without_length")).alias("only_by_length"),
        F.count_if("without_length").alias("without_length"), F.count_if("without_nesting").alias("without_nesting"), F.count_if("without_both").alias("without_both"),
    )


def limits(replies: DataFrame) -> DataFrame:
    """The candidate limits of each source's texts (field ``WHOLE``) and values with unit, count, posterior and fitted parameters."""
    return censoring(_lengths(_latest(evidence(replies))))
