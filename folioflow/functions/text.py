"""Column expressions on text; every expression is built in, so that it stays inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space at either end, Unicode spaces included.
EDGES = r"^[\s\p{Z}]+|[\s\p{Z}]+$"


def trim(c: Column | str) -> Column:
    """Without white space of any kind at both ends; null stays null."""
    return F.regexp_replace(c, EDGES, "")


def blank_to_null(c: Column | str) -> Column:
    """Trimmed, or null where nothing is left."""
    t = trim(c)
    return F.when(t != "", t)


def byte_tokens(c: Column | str) -> Column:
    """The default token count: bytes divided by 4, rounded down; null counts 0."""
    return F.coalesce(F.floor(F.octet_length(c) / 4), F.lit(0)).cast("long")


def approximate_tokens(c: Column | str) -> Column:
    """The same, at least 1."""
    return F.greatest(byte_tokens(c), F.lit(1).cast("long"))


def meaningful_words(c: Column | str) -> Column:
    """How many words separated by white space hold a letter: one pass over the text, no array of words."""
    return F.regexp_count(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")), F.lit(r"[^\s\p{Z}]*?\p{L}[^\s\p{Z}]*"))


def has_words(c: Column | str, n: int) -> Column:
    """Whether ``meaningful_words`` is at least ``n``, without reading on after the n-th; possessive, so that no word counts twice."""
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")).rlike(rf"\A(?:[^\p{{L}}]*+\p{{L}}[^\s\p{{Z}}]*+){{{n}}}")


def section_context(heading: Column | str, text: Column | str) -> Column:
    """``[Section: heading]`` and a line break before the text where there is a heading."""
    h = F.col(heading) if isinstance(heading, str) else heading
    t = F.coalesce(text, F.lit(""))
    return F.when(h.isNotNull(), F.concat(F.lit("[Section: "), h, F.lit("]\n"), t)).otherwise(t)


def terms(c: Column | str) -> Column:
    """Terms of a text: runs of letters and digits of at least 3 bytes, in lower case."""
    runs = F.split(F.coalesce(c, F.lit("")), r"[^\p{L}\p{N}]+")
    return F.transform(F.filter(runs, lambda w: F.octet_length(w) >= 3), lambda w: F.lower(w))


def last_dot(c: Column | str) -> Column:
    """What follows the last dot of a name, in lower case; null without one."""
    found = F.regexp_extract(c, r"\.([^./\\]+)$", 1)
    return F.when(found != "", F.lower(found))


def label(c: Column | str) -> Column:
    """A name that is safe for a file: other characters become ``_``; empty becomes ``unnamed``."""
    safe = F.regexp_replace(F.coalesce(c, F.lit("")), r"[^A-Za-z0-9_-]", "_")
    return F.when(safe == "", F.lit("unnamed")).otherwise(safe)


def escape_html(c: Column | str) -> Column:
    out = F.col(c) if isinstance(c, str) else c
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(char), F.lit(entity))
    return out


def first_filled(*columns: Column | str) -> Column:
    """The first of the columns that is not blank, as it is; null if all are."""
    return F.coalesce(*[F.when(blank_to_null(c).isNotNull(), F.col(c) if isinstance(c, str) else c) for c in columns])


def strip_fence(c: Column | str) -> Column:
    """Trimmed; a text that begins with a code fence loses it, the word ``json`` after it, and fences at the end."""
    t = trim(c)
    inner = trim(F.regexp_replace(trim(F.regexp_replace(t, r"^```(?:json)*", "")), r"(?:```)+$", ""))
    return F.when(t.startswith("```"), inner).otherwise(t)


# Units of sizes, each 1024 of the one before.
SIZE_UNITS = ("Bytes", "KB", "MB", "GB", "TB", "PB", "EB", "ZB", "YB")


def format_bytes(c: Column | str) -> Column:
    """1024-based size with at most two decimals and no space ("1.5KB"); 0, negative and null give "0B"."""
    size = F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(0)).cast("double")
    units = F.array(*[F.lit(u) for u in SIZE_UNITS])
    power = F.least(F.floor(F.log(F.greatest(size, F.lit(1.0))) / F.log(F.lit(1024.0)) + 1e-12), F.lit(len(SIZE_UNITS) - 1)).cast("int")
    scaled = F.format_string("%.2f", size / F.pow(F.lit(1024.0), power))
    shown = F.regexp_replace(F.regexp_replace(scaled, r"0+$", ""), r"\.$", "")
    return F.when(size <= 0, F.lit("0B")).otherwise(F.concat(shown, F.element_at(units, power + 1)))


def compact_stamp(c: Column | str) -> Column:
    """A UTC time for names of files, sortable and without colons: ``20260830T143205.123Z``."""
    return F.date_format(c, "yyyyMMdd'T'HHmmss.SSS'Z'")


def readable_stamp(c: Column | str) -> Column:
    """A UTC time for records (RFC 3339); the fraction has as many digits as it needs, none if it is 0."""
    whole, part = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss"), F.regexp_replace(F.date_format(c, "SSSSSS"), "0+$", "")
    return F.concat(whole, F.when(part == "", "").otherwise(F.concat(F.lit("."), part)), F.lit("Z"))


def format_clock(seconds: Column) -> Column:
    """HHMMSS with hours up to 99; null and negative seconds count 0."""
    s = F.greatest(F.coalesce(seconds, F.lit(0)), F.lit(0)).cast("long")
    two = lambda x: F.lpad(x.cast("long").cast("string"), 2, "0")
    return F.concat(two(F.least(F.floor(s / 3600), F.lit(99))), two(F.floor(s % 3600 / 60)), two(s % 60))
