"""From files to typed blocks: dispatch, markdown, tables, the need for character recognition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.functions import text as tx

# Extensions by parser.
DOCUMENT = ("pdf", "jpg", "jpeg", "png", "gif", "bmp", "tif", "tiff", "webp", "svg")
PLAIN = ("txt", "md", "csv")
OFFICE = ("pptx", "docx", "ppt", "doc")
NEEDS_RECOGNITION = ("Scanned", "NoText", "Garbled", "VectorText")
RECOGNITION_SHARE = 0.5
SEPARATOR = "\x1f"


def parser_of(extension: Column | str) -> Column:
    """document, markdown, text or office by extension, without regard to case; null if unsupported."""
    e = F.lower(extension)
    return F.when(e.isin(*DOCUMENT), "document").when(e == "md", "markdown").when(e.isin(*PLAIN), "text").when(e.isin(*OFFICE), "office")


def identity_key(path: Column | str, size: Column | str, modified_ns: Column | str) -> Column:
    """Path, size and time of change joined by the unit separator; null if any is null."""
    parts = [F.col(c) if isinstance(c, str) else c for c in (path, size, modified_ns)]
    known = parts[0].isNotNull() & parts[1].isNotNull() & parts[2].isNotNull()
    return F.when(known, F.concat_ws(SEPARATOR, *[p.cast("string") for p in parts]))


def identity_parts(files: DataFrame) -> DataFrame:
    """id, path_part, size_part, modified_ns of identity_key; null parts for a null key."""
    p = F.split("identity_key", SEPARATOR)
    return files.select("id", F.get(p, F.lit(0)).alias("path_part"), F.try_to_number(F.get(p, F.lit(1)), F.lit("999999999999999999")).cast("long").alias("size_part"), F.try_to_number(F.get(p, F.lit(2)), F.lit("999999999999999999999")).cast("long").alias("modified_ns"))


def markdown_blocks(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, ordinal, kind (heading or body), level, text: the blocks of each markdown text.

    A line of one to six ``#`` and a space is a heading (leading white space is allowed, closing ``#`` are
    dropped); the lines between, each with its line break, are a body; blank bodies are dropped. Null
    and blank texts have no blocks.

    All of a text's blocks are made within its row: the places of its headings are found once and the lines between them are
    sliced out, so that nothing is shuffled and the work is linear in the lines.
    """
    body = F.regexp_replace(F.regexp_replace(F.col(text_col), "\r\n", "\n"), r"\n$", "")
    lines = texts.where(tx.blank_to_null(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.split(body, "\n").alias("lines"))
    marked = lines.withColumn("levels", F.transform("lines", lambda s: F.length(F.regexp_extract(s, r"^[\s\p{Z}]*(#{1,6}) ", 1))))
    headed = marked.withColumn("heads", F.expr("concat(array(-1), filter(sequence(0, size(lines) - 1), i -> levels[i] > 0))"))
    blocks = headed.select("id", F.posexplode(F.expr(r"""
        filter(flatten(transform(heads, (h, k) -> array(
            named_struct('level', IF(h < 0, 0, levels[h]), 'text', IF(h < 0, NULL, lines[h])),
            named_struct('level', 0, 'text', IF(coalesce(get(heads, k + 1), size(lines)) = h + 1, NULL,
                concat(array_join(slice(lines, h + 2, coalesce(get(heads, k + 1), size(lines)) - h - 1), '\n'), '\n')))))),
            b -> b.level > 0 OR b.text RLIKE '[^\\s\\p{Z}]')
    """)).alias("ordinal", "b")).select("id", "ordinal", "b.*")
    title = tx.trim(F.regexp_replace(F.regexp_replace("text", r"^[\s\p{Z}]*#{1,6}", ""), r"#+[\s\p{Z}]*$", ""))
    is_heading = F.col("level") > 0
    return blocks.select("id", "ordinal", F.when(is_heading, "heading").otherwise("body").alias("kind"), F.when(is_heading, F.col("level")).alias("level"), F.when(is_heading, title).otherwise(F.col("text")).alias("text"))


def plain_blocks(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A text file as one body block, unchanged; blank ones have none."""
    rows = texts.where(tx.blank_to_null(text_col).isNotNull())
    return rows.select(F.col(id_col).alias("id"), F.lit(0).alias("ordinal"), F.lit("body").alias("kind"), F.lit(None).cast("int").alias("level"), F.col(text_col).alias("text"))


def histogram(blocks: DataFrame) -> DataFrame:
    """id, bodies, headings."""
    return blocks.groupBy("id").agg(F.count_if(F.col("kind") == "body").alias("bodies"), F.count_if(F.col("kind") == "heading").alias("headings"))


def render_row(cells: Column) -> Column:
    """Cells trimmed, empty ones dropped, joined by tabs."""
    return F.array_join(F.filter(F.transform(cells, tx.trim), lambda c: c != ""), "\t")


def layout_block(block: Column) -> Column:
    """A struct kind, level, text of a layout block (kind, text, level, lines, rows); null for figures, rules and blanks.

    Headings are trimmed and their level is 1 without, 6 at most; a table gives a line per row that is not blank.
    """
    kind, level, text = block["kind"], block["level"], block["text"]
    table = F.concat_ws("", F.transform(F.filter(F.transform(block["rows"], render_row), lambda r: r != ""), lambda r: F.concat(r, F.lit("\n"))))
    other = F.coalesce(text, F.array_join(block["lines"], "\n"))
    body = F.when(kind == "table", table).otherwise(other)
    heading = F.struct(F.lit("heading").alias("kind"), F.least(F.coalesce(level, F.lit(1)), F.lit(6)).alias("level"), tx.trim(other).alias("text"))
    plain = F.struct(F.lit("body").alias("kind"), F.lit(None).cast("int").alias("level"), body.alias("text"))
    return F.when(kind.isin("figure", "rule"), F.lit(None)).when(tx.blank_to_null(F.when(kind == "heading", other).otherwise(body)).isNull(), F.lit(None)).when(kind == "heading", heading).otherwise(plain)


def page_blocks(pages: DataFrame) -> DataFrame:
    """id, ordinal, kind, level, text of pages (id, layout, markdown, text): the layout's blocks, else the markdown's, else the raw text.

    A source that yields no block gives way to the next; a page of which all are empty or null has none.
    """
    given = pages.select("id", F.filter(F.transform("layout", layout_block), lambda b: b.isNotNull()).alias("made"), "markdown", "text")
    laid = given.where(F.size("made") > 0).select("id", F.posexplode("made").alias("ordinal", "b")).select("id", "ordinal", "b.kind", F.col("b.level").cast("int").alias("level"), "b.text")
    rest = given.where(F.coalesce(F.size("made"), F.lit(0)) <= 0).select("id", "markdown", "text")
    # A markdown that is not blank has a block, its own or a body.
    marked = markdown_blocks(rest, "id", "markdown")
    raw = plain_blocks(rest.where(tx.blank_to_null("markdown").isNull()), "id", "text")
    return laid.unionByName(marked).unionByName(raw)


def table_lines(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, rows, rendered: the tab-separated lines of a text as table rows."""
    lines = F.filter(F.split(text_col, "\n"), lambda s: F.contains(s, F.lit("\t")))
    rows = F.filter(F.transform(lines, lambda s: render_row(F.split(s, "\t"))), lambda r: r != "")
    return texts.select(F.col(id_col).alias("id"), F.size(rows).alias("rows"), F.array_join(F.transform(rows, lambda r: F.concat(r, F.lit("\n"))), "").alias("rendered")).where("rows > 0")


def recognition_needed(pages: DataFrame) -> DataFrame:
    """file_id, share, needed: the share of pages whose reasons ask for recognition, and whether it is at least half."""
    asks = F.arrays_overlap("reasons", F.array(*[F.lit(r) for r in NEEDS_RECOGNITION]))
    share = pages.groupBy("file_id").agg(F.avg(F.coalesce(asks, F.lit(False)).cast("double")).alias("share"))
    return share.withColumn("needed", F.col("share") >= RECOGNITION_SHARE)


def recognition_of_files(files: DataFrame, pages: DataFrame) -> DataFrame:
    """file_id, needed: as ``recognition_needed``; a file that could not be probed has no pages, and is recognised, so that nothing is lost."""
    known = recognition_needed(pages).select("file_id", "needed")
    return files.select(F.col("id").alias("file_id")).join(known, "file_id", "left").withColumn("needed", F.coalesce("needed", F.lit(True)))


def page_reasons(segments: DataFrame) -> DataFrame:
    """file_id, reasons: what a stored segment says about its page (no text, few words, marks of a scan)."""
    text = F.coalesce("text", F.lit(""))
    reasons = F.array_compact(F.array(
        F.when(tx.blank_to_null(text).isNull(), F.lit("NoText")), F.when(tx.meaningful_words("text") < 10, F.lit("Sparse")),
        F.when(text.rlike(r"\p{L}[-\x{2010}\x{00AC}\x{00AD}]\n\p{Ll}"), F.lit("Scanned")),
    ))
    return segments.select("file_id", reasons.alias("reasons"))
