"""Blocks into segments: sentences, packing under a token target, hard windows, merging of small pieces."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions import ranks, text as tx
from folioflow.session import cut

TARGET, MAXIMUM, MINIMUM = 1100, 1800, 150
# Abbreviations whose full stop ends no sentence.
ABBREVIATIONS = ("a.m.", "dr.", "e.g.", "etc.", "i.e.", "mr.", "mrs.", "ms.", "no.", "p.m.", "prof.", "u.s.a.", "u.s.", "vs.")
# The characters that count as white space at the ends of lines and sentences.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_STOP = re.compile(r"[.!?](?=[ \t\n\r\f]|$)")
_TAIL = re.compile(r"[A-Za-z0-9.]*\.$")


def sentences_of(text: str) -> list[str]:
    """Sentences of a text; a line's unfinished end goes on in the next line. Only a line feed ends a line."""
    out: list[str] = []
    carried: list[str] = []
    for line in (s.strip(WHITE) for s in text.split("\n")):
        start = 0
        for m in _STOP.finditer(line):
            at, end = m.start(), m.end()
            if m[0] == ".":
                around = line[at - 1 : at] + line[end : end + 1]
                if "." in around or "…" in around or _TAIL.search(line[:end])[0].lower() in ABBREVIATIONS:
                    continue
            piece = line[start:end].strip(WHITE)
            if piece:
                out.append(" ".join([*carried, piece]))
                carried = []
            start = end
        rest = line[start:].strip(WHITE)
        if rest:
            carried.append(rest)
    if carried:
        out.append(" ".join(carried))
    return out


def sentences(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, ordinal, sentence. Null and blank texts have none."""
    @F.pandas_udf("array<string>")
    def split(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(sentences_of)

    rows = texts.where(tx.blank_to_null(text_col).isNotNull())
    return rows.select(F.col(id_col).alias("id"), F.posexplode(split(F.col(text_col))).alias("ordinal", "sentence"))


def pieces(blocks: DataFrame) -> DataFrame:
    """id, ordinal, part, kind, text, tokens: trimmed bodies, those beyond the target as sentences; headings as they are."""
    @F.pandas_udf("array<string>")
    def split(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(sentences_of)

    trimmed = blocks.withColumn("text", tx.trim("text")).where((F.col("kind") == "heading") | (F.col("text") != "")).withColumn("long", (F.col("kind") == "body") & (tx.byte_tokens("text") > TARGET))
    whole = trimmed.where("not long").select("id", "ordinal", F.lit(0).alias("part"), "kind", "text")
    split_ = trimmed.where("long").select("id", "ordinal", F.posexplode(split(F.col("text"))).alias("part", "text"), "kind").select("id", "ordinal", "part", "kind", "text")
    return whole.unionByName(split_).withColumn("tokens", F.when(F.col("kind") == "heading", 0).otherwise(tx.byte_tokens("text")).cast("long"))


_PACK = f"""
    aggregate(pieces,
        named_struct('done', cast(array() as array<struct<heading:string,tokens:bigint,parts:array<struct<ordinal:int,part:int>>>>), 'heading', cast(null as string), 'tokens', 0L, 'parts', cast(array() as array<struct<ordinal:int,part:int>>)),
        (s, x) -> CASE
            WHEN x.kind = 'heading' THEN named_struct(
                'done', IF(size(s.parts) > 0, array_append(s.done, named_struct('heading', s.heading, 'tokens', s.tokens, 'parts', s.parts)), s.done),
                'heading', nullif(x.title, ''), 'tokens', 0L, 'parts', cast(array() as array<struct<ordinal:int,part:int>>))
            WHEN s.tokens > 0 AND s.tokens + x.tokens > {TARGET} THEN named_struct(
                'done', array_append(s.done, named_struct('heading', s.heading, 'tokens', s.tokens, 'parts', s.parts)),
                'heading', s.heading, 'tokens', x.tokens, 'parts', array(x.at))
            ELSE named_struct('done', s.done, 'heading', s.heading, 'tokens', s.tokens + x.tokens, 'parts', array_append(s.parts, x.at)) END,
        s -> IF(size(s.parts) > 0, array_append(s.done, named_struct('heading', s.heading, 'tokens', s.tokens, 'parts', s.parts)), s.done))
"""

_MERGE = f"""
    aggregate(drafts, cast(array() as array<struct<heading:string,tokens:bigint,parts:array<struct<nth:bigint,section:bigint,draft:int,window:int>>>>), (m, x) -> CASE
        WHEN size(m) > 0 AND element_at(m, -1).tokens + x.tokens <= {MAXIMUM} AND (element_at(m, -1).tokens < {MINIMUM} OR x.tokens < {MINIMUM})
        THEN array_append(slice(m, 1, size(m) - 1), named_struct('heading', coalesce(element_at(m, -1).heading, x.heading), 'tokens', element_at(m, -1).tokens + x.tokens, 'parts', array_append(element_at(m, -1).parts, x.at)))
        ELSE array_append(m, named_struct('heading', x.heading, 'tokens', x.tokens, 'parts', array(x.at))) END)
"""


def pack(pieces_: DataFrame) -> DataFrame:
    """id, section, draft, heading, text, tokens: pieces of a section joined by spaces up to the target.

    A heading starts a section, and sections do not depend on one another, so that the fold runs per section and a
    file of any number of sections is no single task. It sees numbers only; texts are joined back by their place.
    A heading without body is lost, a section that is split repeats its heading.
    """
    opens = F.when(F.col("kind") == "heading", 1).otherwise(0).cast("long")
    title = F.when(F.col("kind") == "heading", F.col("text"))
    narrow = pieces_.select("id", "ordinal", "part", "kind", title.alias("title"), "tokens")
    placed = ranks.running_sum(narrow, ["id"], "ordinal", opens, "section", ["part"]).withColumn("at", F.struct("ordinal", "part"))
    lists = placed.groupBy("id", "section").agg(F.array_sort(F.collect_list(F.struct("at", "kind", "title", "tokens"))).alias("pieces"))
    drafts = lists.select("id", "section", F.posexplode(F.expr(_PACK)).alias("draft", "d")).select("id", "section", "draft", "d.heading", "d.tokens", F.explode("d.parts").alias("at"))
    texts = drafts.select("*", "at.*").join(pieces_.select("id", "ordinal", "part", "text"), ["id", "ordinal", "part"])
    joined = texts.groupBy("id", "section", "draft").agg(F.first("heading").alias("heading"), F.first("tokens").alias("tokens"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda s: s["text"]), " ").alias("text"))
    return joined.select("id", "section", "draft", "heading", tx.trim("text").alias("text"), "tokens").where("text <> ''")


def byte_windows(text: str, width: int) -> list[str]:
    """Pieces of at most ``width`` bytes of UTF-8 that are cut between characters."""
    raw = text.encode("utf-8", "replace")
    out, start = [], 0
    while start < len(raw):
        end = min(start + width, len(raw))
        while end < len(raw) and end > start and raw[end] & 0xC0 == 0x80:
            end -= 1
        out.append(raw[start:end].decode())
        start = end
    return out


def windows(drafts: DataFrame) -> DataFrame:
    """Drafts beyond the maximum cut into windows of 4 * maximum bytes, blank ones dropped; others unchanged."""
    @F.pandas_udf("array<string>")
    def slices(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda text: byte_windows(text, 4 * MAXIMUM))

    fits = drafts.where(F.col("tokens") <= MAXIMUM).withColumn("window", F.lit(0))
    long_ = drafts.where(F.col("tokens") > MAXIMUM).select("id", "section", "draft", "heading", F.posexplode(slices(F.col("text"))).alias("window", "text")).withColumn("tokens", tx.byte_tokens("text")).where(tx.blank_to_null("text").isNotNull())
    return fits.unionByName(long_.select(*fits.columns))


def merge_small(drafts: DataFrame) -> DataFrame:
    """id, segment, heading, text, tokens: drafts below the minimum joined to a neighbour by a line break, up to the maximum.

    Two neighbours of at least the minimum never merge, whatever was merged before them, so that the fold runs
    per run of drafts between such pairs.
    """
    order = Window.partitionBy("id").orderBy("section", "draft", "window")
    narrow = drafts.select("id", "section", "draft", "window", "heading", "tokens").withColumn("before", F.lag("tokens").over(order)).withColumn("nth", F.row_number().over(order))
    apart = F.when((F.col("before") >= MINIMUM) & (F.col("tokens") >= MINIMUM), 1).otherwise(0).cast("long")
    runs = ranks.running_sum(narrow.withColumn("nth", F.col("nth").cast("long")), ["id"], "nth", apart, "run")
    at = F.struct("nth", "section", "draft", "window").alias("at")
    lists = runs.groupBy("id", "run").agg(F.array_sort(F.collect_list(F.struct(at, "heading", "tokens"))).alias("drafts"))
    merged = lists.select("id", "run", F.posexplode(F.expr(_MERGE)).alias("piece", "m")).select("id", "run", "piece", "m.heading", "m.tokens", F.explode("m.parts").alias("at")).select("*", "at.*")
    texts = merged.drop("at").join(drafts.select("id", "section", "draft", "window", "text"), ["id", "section", "draft", "window"])
    grouped = texts.groupBy("id", "run", "piece").agg(
        F.first("heading").alias("heading"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", "text"))), lambda s: s["text"]), "\n").alias("text"), F.first("tokens").alias("tokens"), F.min("nth").alias("first")
    )
    return ranks.rank(grouped, ["id"], "first", "segment").select("id", (F.col("segment") - 1).cast("int").alias("segment"), "heading", "text", "tokens")


def segment(blocks: DataFrame) -> DataFrame:
    """Blocks (id, ordinal, kind, text) into segments (id, segment, heading, text, tokens).

    Pieces and drafts are each read several times, hence written once to the shared folder.
    """
    return merge_small(cut(windows(pack(cut(pieces(blocks))))))


def number(segments: DataFrame, files: DataFrame, existing: DataFrame) -> DataFrame:
    """Segments of files with position in their worksheet: after the existing ones, by file (created_at, id), then segment."""
    start = existing.groupBy("worksheet_id").agg(F.max("position").alias("last"))
    order = Window.partitionBy("worksheet_id").orderBy("created_at", "file_id")
    counts = segments.groupBy(F.col("id").alias("file_id")).agg(F.count("*").alias("n"))
    placed = files.select(F.col("id").alias("file_id"), "worksheet_id", "created_at").join(counts, "file_id")
    before = placed.withColumn("before", F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("file_id", "worksheet_id", "before")
    joined = segments.withColumnRenamed("id", "file_id").join(before, "file_id").join(start, "worksheet_id", "left")
    position = (F.coalesce(F.col("last"), F.lit(-1)) + 1 + F.col("before") + F.col("segment")).cast("int")
    return joined.select("worksheet_id", "file_id", position.alias("position"), tx.blank_to_null("heading").alias("heading"), "text", "tokens")


def bounds(segments: DataFrame) -> DataFrame:
    """id, characters, within: the characters of each file's segments without white space, and whether none is beyond the maximum.

    Whatever way texts are cut and joined, no other character may be lost or made.
    """
    bare = F.regexp_replace("text", r"[\s\p{Z}]+", "")
    return segments.groupBy("id").agg(F.sum(F.length(bare)).alias("characters"), (F.max("tokens") <= MAXIMUM).alias("within"))


def numbering(numbered: DataFrame, existing: DataFrame) -> DataFrame:
    """worksheet_id, follows, gapless: whether the positions of new segments begin after the existing ones, and leave out and repeat none."""
    last = existing.groupBy("worksheet_id").agg(F.max("position").alias("last"))
    rows = numbered.groupBy("worksheet_id").agg(F.min("position").alias("low"), F.max("position").alias("high"), F.count("*").alias("n"), F.count_distinct("position").alias("distinct"))
    joined = rows.join(last, "worksheet_id", "left")
    follows = F.col("low") == F.coalesce("last", F.lit(-1)) + 1
    gapless = (F.col("n") == F.col("distinct")) & (F.col("high") - F.col("low") + 1 == F.col("n"))
    return joined.select("worksheet_id", follows.alias("follows"), gapless.alias("gapless"))


def totals(segments: DataFrame) -> DataFrame:
    """id, segments, tokens, mean tokens per segment of each file (id, tokens)."""
    rows = segments.groupBy("id").agg(F.count("*").alias("segments"), F.sum("tokens").alias("tokens"))
    return rows.withColumn("tokens_per_segment", F.col("tokens") / F.col("segments"))
