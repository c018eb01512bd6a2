"""Registered queries of the core operators, with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.functions import text as tx
from folioflow.operators import blocks, catalog, consume, generate, nested, segments, selection, telemetry, validate
from folioflow.session import spread
from folioflow.sources.tables import table
from folioflow.streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with its SQL if it can be put in SQL."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _once(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table without its redelivered rows, where the copies are equal."""
    return table(spark, folder, name).dropDuplicates()


def _replies(spark: SparkSession, folder: str) -> DataFrame:
    return telemetry.latest(table(spark, folder, "replies"), "reply_id")


def _items(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "mcq_items").dropDuplicates(["item_id"])


# Pieces of SQL that several checks share.
TRIM = r"regexp_replace({}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"
CHUNKS = "c AS (SELECT DISTINCT * FROM chunks)"
ARTIFACTS = "a AS (SELECT DISTINCT * FROM artifacts)"
REPLIES = "r AS (SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY reply_id ORDER BY arrived_at DESC) AS rn FROM replies) WHERE rn = 1)"
ITEMS = "i AS (SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY ordinal) AS rn FROM mcq_items) WHERE rn = 1)"
_WORDS = r"len(list_filter(regexp_split_to_array(" + TRIM.format("coalesce(text, '')") + r", '[\s\p{Z}]+'), lambda w: regexp_matches(w, '\p{L}')))"
_HEADING_HIT = " OR ".join(f"contains(lower(coalesce(heading, '')), '{m}')" for m in selection.HEADING_MARKERS)
_TEXT_HIT = " OR ".join(f"contains(lower(substring(coalesce(text, ''), 1, 800)), '{m}')" for m in selection.TEXT_MARKERS)
USABLE = f"u AS (SELECT * FROM c WHERE {_WORDS} >= 10 AND NOT ({_HEADING_HIT} OR {_TEXT_HIT}))"
QUIZ = "('MultipleChoiceQuiz', 'EssayQuiz', 'CompletionQuiz')"
TERMS = r"""t AS (
    SELECT worksheet_id, id, lower(w) AS term, in_text FROM (
        SELECT worksheet_id, id, unnest(regexp_split_to_array(coalesce(text, ''), '[^\p{L}\p{N}]+')) AS w, true AS in_text FROM u
        UNION ALL SELECT worksheet_id, id, unnest(regexp_split_to_array(coalesce(heading, ''), '[^\p{L}\p{N}]+')), false FROM u
    ) WHERE strlen(w) >= 3
), s AS (
    SELECT t.worksheet_id, term, count(*) * greatest(ln(any_value(n.n) / count(DISTINCT t.id)), 0.0) AS score
    FROM t JOIN (SELECT worksheet_id, count(*)::DOUBLE AS n FROM u GROUP BY 1) n USING (worksheet_id) GROUP BY 1, 2
)"""
MEMBERS = """m AS (
    SELECT u.worksheet_id, u.id, u.position, coalesce(x.score, 0.0) AS score
    FROM u LEFT JOIN (SELECT d.worksheet_id, d.id, sum(s.score) AS score FROM (SELECT DISTINCT worksheet_id, id, term FROM t WHERE in_text) d JOIN s USING (worksheet_id, term) GROUP BY 1, 2) x USING (worksheet_id, id)
)"""


# ---- files and blocks ------------------------------------------------------------------------------


@query(f"""
    SELECT id, CASE WHEN lower(extension) IN {blocks.DOCUMENT} THEN 'document' WHEN lower(extension) = 'md' THEN 'markdown'
        WHEN lower(extension) IN {blocks.PLAIN} THEN 'text' WHEN lower(extension) IN {blocks.OFFICE} THEN 'office' END AS parser
    FROM (SELECT DISTINCT * FROM files)
""")
def extension_dispatch(spark: SparkSession, folder: str) -> DataFrame:
    return _once(spark, folder, "files").select("id", blocks.parser_of("extension").alias("parser"))


@query(r"""
    SELECT id, nullif(lower(regexp_extract(name, '\.([^./\\]+)$', 1)), '') AS name_extension, split_part(identity_key, chr(31), 1) AS path_part,
        TRY_CAST(nullif(split_part(identity_key, chr(31), 2), '') AS BIGINT) AS size_part, TRY_CAST(nullif(split_part(identity_key, chr(31), 3), '') AS BIGINT) AS modified_ns,
        (path || chr(31) || size || chr(31) || split_part(identity_key, chr(31), 3)) = identity_key AS key_holds
    FROM (SELECT DISTINCT * FROM files)
""")
def file_identity(spark: SparkSession, folder: str) -> DataFrame:
    files = _once(spark, folder, "files")
    joined = files.join(blocks.identity_parts(files), "id")
    holds = blocks.identity_key("path", "size", "modified_ns") == F.col("identity_key")
    return joined.select("id", tx.last_dot("name").alias("name_extension"), "path_part", "size_part", "modified_ns", holds.alias("key_holds"))


@query(r"""
    WITH l AS (
        SELECT doc_id, unnest(string_split(regexp_replace(replace(text, chr(13) || chr(10), chr(10)), '\n$', ''), chr(10))) AS line, generate_subscripts(string_split(regexp_replace(replace(text, chr(13) || chr(10), chr(10)), '\n$', ''), chr(10)), 1) AS pos
        FROM documents WHERE regexp_matches(text, '[^\s\p{Z}]')
    ), k AS (SELECT *, length(regexp_extract(line, '^[\s\p{Z}]*(#{1,6}) ', 1)) AS level FROM l),
    g AS (SELECT *, sum(CASE WHEN level > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) * 2 + CASE WHEN level > 0 THEN 0 ELSE 1 END AS island FROM k),
    b AS (SELECT doc_id, island, max(level) AS level, string_agg(line || chr(10), '' ORDER BY pos) AS body, max(line) AS line FROM g GROUP BY 1, 2)
    SELECT doc_id AS id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY island) - 1 AS INTEGER) AS ordinal, CASE WHEN level > 0 THEN 'heading' ELSE 'body' END AS kind,
        CASE WHEN level > 0 THEN CAST(level AS INTEGER) END AS level,
        CASE WHEN level > 0 THEN regexp_replace(regexp_replace(regexp_replace(line, '^[\s\p{Z}]*#{1,6}', ''), '#+[\s\p{Z}]*$', ''), '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') ELSE body END AS text
    FROM b WHERE level > 0 OR regexp_matches(body, '[^\s\p{Z}]')
""")
def markdown_blocks(spark: SparkSession, folder: str) -> DataFrame:
    return blocks.markdown_blocks(spread(table(spark, folder, "documents").select("doc_id", "text")), "doc_id", "text")


@query(r"""SELECT doc_id AS id, 0 AS ordinal, 'body' AS kind, CAST(NULL AS INTEGER) AS level, text FROM documents WHERE regexp_matches(text, '[^\s\p{Z}]')""")
def plain_blocks(spark: SparkSession, folder: str) -> DataFrame:
    return blocks.plain_blocks(table(spark, folder, "documents"), "doc_id", "text")


@query(r"""
    WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents WHERE regexp_matches(text, '[^\s\p{Z}]')),
    k AS (SELECT doc_id, regexp_matches(line, '^[\s\p{Z}]*#{1,6} ') AS head, line FROM l)
    SELECT doc_id AS id, CAST(sum(CASE WHEN head THEN 1 ELSE 0 END) AS BIGINT) AS headings FROM k GROUP BY 1
""")
def heading_histogram(spark: SparkSession, folder: str) -> DataFrame:
    return blocks.histogram(markdown_blocks(spark, folder)).select("id", "headings")


@query(r"""
    WITH l AS (SELECT doc_id, unnest(string_split(regexp_replace(replace(text, chr(13) || chr(10), chr(10)), '\n$', ''), chr(10))) AS line, generate_subscripts(string_split(regexp_replace(replace(text, chr(13) || chr(10), chr(10)), '\n$', ''), chr(10)), 1) AS pos FROM documents WHERE regexp_matches(text, '[^\s\p{Z}]')),
    k AS (SELECT *, regexp_matches(line, '^[\s\p{Z}]*#{1,6} ') AS head FROM l), g AS (SELECT *, sum(head::INTEGER) OVER (PARTITION BY doc_id ORDER BY pos) AS section FROM k),
    b AS (SELECT doc_id, section, bool_or(NOT head AND regexp_matches(line, '[^\s\p{Z}]')) AS body, bool_or(head) AS head FROM g GROUP BY 1, 2)
    SELECT doc_id AS id, count(*) FILTER (body) AS bodies, count(*) FILTER (head) AS headings FROM b GROUP BY 1
""")
def block_histogram(spark: SparkSession, folder: str) -> DataFrame:
    """Blocks of each text by kind."""
    return blocks.histogram(markdown_blocks(spark, folder))


@query(f"""
    WITH {CHUNKS}, l AS (SELECT id, list_filter(list_transform(list_filter(string_split(text, chr(10)), lambda s: contains(s, chr(9))),
        lambda s: array_to_string(list_filter(list_transform(string_split(s, chr(9)), lambda x: {TRIM.format('x')}), lambda x: x <> ''), chr(9))), lambda x: x <> '') AS rows FROM c)
    SELECT id, CAST(len(rows) AS INTEGER) AS rows, array_to_string(list_transform(rows, lambda x: x || chr(10)), '') AS rendered FROM l WHERE len(rows) > 0
""")
def table_render(spark: SparkSession, folder: str) -> DataFrame:
    return blocks.table_lines(_once(spark, folder, "chunks"), "id", "text")


@query(f"""
    WITH {CHUNKS}, p AS (SELECT file_id, NOT regexp_matches(coalesce(text, ''), '[^\\s\\p{{Z}}]') OR regexp_matches(coalesce(text, ''), '\\p{{L}}[-\\x{{2010}}\\x{{00AC}}\\x{{00AD}}]\\n\\p{{Ll}}') AS asks FROM c)
    SELECT file_id, round(avg(asks::INTEGER), 9) AS share, avg(asks::INTEGER) >= 0.5 AS needed FROM p GROUP BY 1
""")
def recognition_gate(spark: SparkSession, folder: str) -> DataFrame:
    pages = blocks.page_reasons(_once(spark, folder, "chunks"))
    return blocks.recognition_needed(pages).withColumn("share", F.round("share", 9))


_ROWS_OF = f"""list_filter(list_transform(list_filter(string_split(text, chr(10)), lambda s: contains(s, chr(9))),
        lambda s: array_to_string(list_filter(list_transform(string_split(s, chr(9)), lambda x: {TRIM.format('x')}), lambda x: x <> ''), chr(9))), lambda x: x <> '')"""


@query(f"""
    WITH {CHUNKS}, p AS (SELECT id, text, {TRIM.format("coalesce(heading, '')")} AS head, coalesce({_ROWS_OF}, []) AS lines FROM c),
    q AS (SELECT *, len(lines) > 0 AS laid, len(lines) = 0 AND head <> '' AS marked FROM p)
    SELECT id, 0 AS ordinal, 'heading' AS kind, CASE WHEN laid THEN 6 ELSE 1 END AS level, CASE WHEN laid THEN head ELSE replace(head, chr(10), ' ') END AS text FROM q WHERE head <> '' AND (laid OR marked)
    UNION ALL SELECT id, CASE WHEN head <> '' THEN 1 ELSE 0 END, 'body', NULL, array_to_string(list_transform(lines, lambda x: x || chr(10)), '') FROM q WHERE laid
    UNION ALL SELECT id, CASE WHEN marked THEN 1 ELSE 0 END, 'body', NULL, CASE WHEN marked THEN text || chr(10) ELSE text END FROM q WHERE NOT laid AND regexp_matches(text, '[^\\s\\p{{Z}}]')
""")
def page_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks as pages: those with rows of a table have a layout, others with a heading a markdown, the rest only text.

    A text that itself holds a markdown heading or ends a line differently is left as it stands in the raw text.
    """
    chunks = _once(spark, folder, "chunks")
    lines = F.filter(F.split("text", "\n"), lambda s: F.contains(s, F.lit("\t")))
    none = {"level": F.lit(None).cast("int"), "text": F.lit(None).cast("string"), "lines": F.lit(None).cast("array<string>"), "rows": F.lit(None).cast("array<array<string>>")}

    def block(kind: str, **given) -> F.Column:
        return F.struct(F.lit(kind).alias("kind"), *[given.get(n, c).alias(n) for n, c in none.items()])

    rows = F.transform(lines, lambda s: F.split(s, "\t"))
    full = F.exists(rows, lambda r: blocks.render_row(r) != "")
    layout = F.when(full, F.array(block("figure"), block("heading", level=F.lit(9), text=F.coalesce("heading", F.lit(""))), block("table", rows=rows)))
    marked = F.when(~F.coalesce(full, F.lit(False)) & tx.blank_to_null("heading").isNotNull(), F.concat(F.lit("# "), F.replace(tx.trim("heading"), F.lit("\n"), F.lit(" ")), F.lit("\n"), F.coalesce("text", F.lit("")), F.lit("\n")))
    return blocks.page_blocks(chunks.select("id", layout.alias("layout"), marked.alias("markdown"), "text"))


@query(f"SELECT id, {TRIM.format('name')} AS name, CASE WHEN {TRIM.format('name')} = '' THEN 'Untitled Worksheet' ELSE coalesce({TRIM.format('name')}, 'Untitled Worksheet') END AS shown, CASE WHEN regexp_replace(coalesce(name, ''), '[^A-Za-z0-9_-]', '_', 'g') = '' THEN 'unnamed' ELSE regexp_replace(coalesce(name, ''), '[^A-Za-z0-9_-]', '_', 'g') END AS label FROM worksheets")
def worksheet_names(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "worksheets").select("id", tx.trim("name").alias("name"), catalog.clean_name("name").alias("shown"), tx.label("name").alias("label"))


# ---- segments and selection ------------------------------------------------------------------------


@query(f"WITH {CHUNKS} SELECT id, coalesce(strlen(text) // 4, 0) AS tokens, greatest(coalesce(strlen(text) // 4, 0), 1) AS approximate FROM c")
def token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return _once(spark, folder, "chunks").select("id", tx.byte_tokens("text").alias("tokens"), tx.approximate_tokens("text").alias("approximate"))


_ABBREVIATIONS = "(" + ", ".join(f"'{a}'" for a in segments.ABBREVIATIONS) + ")"


@query(f"""
    WITH {CHUNKS}, j AS (SELECT id, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: {TRIM.format('x')}), lambda x: x <> ''), ' ') AS t FROM c),
    w AS (SELECT id, unnest(regexp_extract_all(t, '[^ \\t\\r\\f]+|[ \\t\\r\\f]')) AS w, generate_subscripts(regexp_extract_all(t, '[^ \\t\\r\\f]+|[ \\t\\r\\f]'), 1) AS i FROM j),
    e AS (SELECT *, regexp_matches(w, '[.!?]$') AND NOT (ends_with(w, '.') AND (regexp_matches(w, '[.…]\\.$') OR lower(regexp_extract(w, '[A-Za-z0-9.]*$')) IN {_ABBREVIATIONS})) AS ends FROM w),
    g AS (SELECT *, coalesce(sum(ends::INTEGER) OVER (PARTITION BY id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM e),
    x AS (SELECT id, s, {TRIM.format("string_agg(w, '' ORDER BY i)")} AS sentence FROM g GROUP BY 1, 2)
    SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY s) - 1 AS INTEGER) AS ordinal, sentence FROM x WHERE sentence <> ''
""")
def sentences(spark: SparkSession, folder: str) -> DataFrame:
    return segments.sentences(_once(spark, folder, "chunks"), "id", "text")


@query()
def document_segments(spark: SparkSession, folder: str) -> DataFrame:
    return segments.segment(markdown_blocks(spark, folder))


@query()
def numbered_segments(spark: SparkSession, folder: str) -> DataFrame:
    """The chunks of each file packed anew and numbered after the worksheet's last position."""
    chunks = _once(spark, folder, "chunks")
    made = chunks.select(F.col("file_id").alias("id"), (F.col("position") * 2).alias("ordinal"), F.lit("heading").alias("kind"), tx.blank_to_null("heading").alias("text")).where("text is not null")
    bodies = chunks.select(F.col("file_id").alias("id"), (F.col("position") * 2 + 1).alias("ordinal"), F.lit("body").alias("kind"), "text").where("text is not null")
    return segments.number(segments.segment(made.unionByName(bodies)), _once(spark, folder, "files"), chunks)


@query(r"""
    WITH l AS (SELECT doc_id, unnest(string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10))) AS line FROM documents WHERE regexp_matches(text, '[^\s\p{Z}]')),
    b AS (SELECT doc_id, sum(length(regexp_replace(line, '[\s\p{Z}]', '', 'g'))) AS n FROM l WHERE NOT regexp_matches(line, '^[\s\p{Z}]*#{1,6} ') GROUP BY 1)
    SELECT doc_id AS id, CAST(n AS BIGINT) AS characters, true AS within FROM b WHERE n > 0
""")
def document_segment_bounds(spark: SparkSession, folder: str) -> DataFrame:
    """What must hold of the segments of documents: all characters are there, none is too long."""
    return segments.bounds(document_segments(spark, folder))


@query(f"WITH {CHUNKS} SELECT file_id AS id, CAST(sum(length(regexp_replace(text, '[\\s\\p{{Z}}]', '', 'g'))) AS BIGINT) AS characters, true AS within FROM c WHERE regexp_matches(text, '[^\\s\\p{{Z}}]') GROUP BY 1")
def numbered_segment_bounds(spark: SparkSession, folder: str) -> DataFrame:
    return segments.bounds(numbered_segments(spark, folder).withColumnRenamed("file_id", "id"))


@query(f"WITH {CHUNKS} SELECT DISTINCT worksheet_id, true AS follows, true AS gapless FROM c WHERE regexp_matches(text, '[^\\s\\p{{Z}}]')")
def numbering_bounds(spark: SparkSession, folder: str) -> DataFrame:
    """What must hold of the positions of new segments in their worksheets."""
    return segments.numbering(numbered_segments(spark, folder), _once(spark, folder, "chunks"))


@query(f"WITH {CHUNKS}, t AS (SELECT file_id AS id, CAST(coalesce(strlen(text) // 4, 0) AS BIGINT) AS n FROM c) SELECT id, count(*) AS segments, CAST(sum(n) AS BIGINT) AS tokens, round(sum(n) / count(*), 9) AS tokens_per_segment FROM t GROUP BY 1")
def segment_totals(spark: SparkSession, folder: str) -> DataFrame:
    """Segments and tokens of each file."""
    rows = _once(spark, folder, "chunks").select(F.col("file_id").alias("id"), tx.byte_tokens("text").alias("tokens"))
    return segments.totals(rows).withColumn("tokens_per_segment", F.round("tokens_per_segment", 9))


@query(f"WITH {CHUNKS} SELECT id, CAST({_WORDS} AS INTEGER) AS words, {_WORDS} < 10 AS degenerate FROM c")
def degenerate_segments(spark: SparkSession, folder: str) -> DataFrame:
    return _once(spark, folder, "chunks").select("id", tx.meaningful_words("text").alias("words"), selection.is_degenerate().alias("degenerate"))


@query(f"WITH {CHUNKS} SELECT id, ({_HEADING_HIT} OR {_TEXT_HIT}) AS front_matter FROM c")
def front_matter(spark: SparkSession, folder: str) -> DataFrame:
    return _once(spark, folder, "chunks").select("id", selection.is_front_matter().alias("front_matter"))


def _usable(spark: SparkSession, folder: str) -> DataFrame:
    return selection.usable(_once(spark, folder, "chunks"))


@query(f"WITH {CHUNKS}, {USABLE} SELECT id, worksheet_id, position FROM u")
def usable_segments(spark: SparkSession, folder: str) -> DataFrame:
    return _usable(spark, folder).select("id", "worksheet_id", "position")


STRIDE = """n AS (SELECT *, row_number() OVER (PARTITION BY worksheet_id ORDER BY position, id) - 1 AS index, count(*) OVER (PARTITION BY worksheet_id) AS total FROM u),
    w AS (SELECT worksheet_id, id, position, index, total FROM n WHERE total <= 48 OR index IN (SELECT CAST(floor(i * (n.total / 48.0::DOUBLE)) AS BIGINT) FROM range(48) x(i)))"""


@query(f"WITH {CHUNKS}, {USABLE}, {STRIDE} SELECT worksheet_id, id, index, total FROM w")
def stride_sample(spark: SparkSession, folder: str) -> DataFrame:
    return selection.stride_sample(_usable(spark, folder)).select("worksheet_id", "id", "index", "total")


@query(f"WITH {CHUNKS} SELECT id, CASE WHEN heading IS NOT NULL THEN '[Section: ' || heading || ']' || chr(10) || coalesce(text, '') ELSE coalesce(text, '') END AS context FROM c")
def section_context(spark: SparkSession, folder: str) -> DataFrame:
    return _once(spark, folder, "chunks").select("id", tx.section_context("heading", "text").alias("context"))


@query(f"""
    WITH {CHUNKS}, {ARTIFACTS}, {USABLE}, {STRIDE}, d AS (SELECT DISTINCT worksheet_id, artifact_type, source FROM a)
    SELECT w.worksheet_id, w.id AS segment_id, CAST(w.position + 17 AS BIGINT) AS seed_offset, t.artifact_type, t.type_index, d.source IS NOT NULL AS skip
    FROM w CROSS JOIN (VALUES ('MultipleChoiceQuiz', 0), ('EssayQuiz', 1), ('CompletionQuiz', 2)) t(artifact_type, type_index)
    LEFT JOIN d ON d.worksheet_id = w.worksheet_id AND d.artifact_type = t.artifact_type AND d.source = w.id
""")
def quiz_units(spark: SparkSession, folder: str) -> DataFrame:
    return selection.quiz_units(_once(spark, folder, "chunks"), _once(spark, folder, "artifacts"))


@query(f"WITH {CHUNKS}, {USABLE}, {TERMS} SELECT worksheet_id, term, round(score, 6) AS score FROM s")
def term_scores(spark: SparkSession, folder: str) -> DataFrame:
    return selection.term_scores(_usable(spark, folder)).withColumn("score", F.round("score", 6))


@query(f"WITH {CHUNKS}, {USABLE}, {TERMS}, {MEMBERS} SELECT worksheet_id, id, position, round(score, 6) AS score FROM m")
def member_scores(spark: SparkSession, folder: str) -> DataFrame:
    return selection.member_scores(_usable(spark, folder)).withColumn("score", F.round("score", 6))


HEAD = f"nullif({TRIM.format('heading')}, '')"


TOPICS = f"""best AS (SELECT worksheet_id, arg_min(term, (-round(score, 9), term)) AS best FROM s GROUP BY 1),
    o AS (SELECT *, {HEAD} AS own, sum(CASE WHEN {HEAD} IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY worksheet_id ORDER BY position, id ROWS UNBOUNDED PRECEDING) AS t FROM u),
    z AS (SELECT *, min(t) OVER (PARTITION BY worksheet_id) AS t0, first_value(own) OVER (PARTITION BY worksheet_id, t ORDER BY position, id) AS label FROM o),
    p AS (SELECT z.worksheet_id, z.id, z.position, z.heading, z.text, CAST(t - CASE WHEN t0 = 0 THEN 0 ELSE 1 END AS BIGINT) AS topic, coalesce(label, best, 'General') AS label FROM z LEFT JOIN best USING (worksheet_id))"""
# The round robin over topics, one candidate after the other.
COVER = f"""k AS (
        SELECT p.*, m.score, greatest(CAST(coalesce(strlen(text) // 4, 0) AS BIGINT), 1) AS tokens,
            row_number() OVER (PARTITION BY p.worksheet_id, topic ORDER BY round(m.score, 9) DESC, p.position, p.id) AS rank FROM p JOIN m ON m.worksheet_id = p.worksheet_id AND m.id = p.id
    ), ordered AS (SELECT worksheet_id, id, topic, tokens, row_number() OVER (PARTITION BY worksheet_id ORDER BY rank, topic) AS nth FROM k),
    f AS (
        SELECT DISTINCT worksheet_id, CAST(0 AS BIGINT) AS nth, CAST(NULL AS VARCHAR) AS id, CAST(0 AS BIGINT) AS spent, false AS taken, 0 AS n, CAST([] AS BIGINT[]) AS closed FROM ordered
        UNION ALL
        SELECT worksheet_id, nth, id, CASE WHEN take THEN spent + tokens ELSE spent END, take, CASE WHEN take THEN n + 1 ELSE n END, CASE WHEN take OR list_contains(closed, topic) THEN closed ELSE list_append(closed, topic) END
        FROM (SELECT o.*, f.spent, f.n, f.closed, NOT list_contains(f.closed, o.topic) AND (f.n = 0 OR f.spent + o.tokens <= {selection.COVER_BUDGET}) AS take FROM f JOIN ordered o ON o.worksheet_id = f.worksheet_id AND o.nth = f.nth + 1)
    ), covered AS (SELECT k.* FROM k JOIN f ON f.worksheet_id = k.worksheet_id AND f.id = k.id WHERE f.taken)"""


@query(f"WITH {CHUNKS}, {USABLE}, {TERMS}, {TOPICS} SELECT worksheet_id, id, topic, label FROM p")
def topics(spark: SparkSession, folder: str) -> DataFrame:
    return selection.topics(_usable(spark, folder)).select("worksheet_id", "id", "topic", "label")


@query(f"WITH RECURSIVE {CHUNKS}, {USABLE}, {TERMS}, {MEMBERS}, {TOPICS}, {COVER} SELECT worksheet_id, id, position, topic, label, tokens FROM covered")
def covering_segments(spark: SparkSession, folder: str) -> DataFrame:
    return selection.covering(_usable(spark, folder)).select("worksheet_id", "id", "position", "topic", "label", "tokens")


@query(f"""
    WITH RECURSIVE {CHUNKS}, {ARTIFACTS}, {USABLE}, {TERMS}, {MEMBERS}, {TOPICS}, {COVER},
    body AS (SELECT worksheet_id, string_agg(id, ',' ORDER BY position, id) AS source, string_agg(CASE WHEN heading IS NOT NULL THEN '[Section: ' || heading || ']' || chr(10) || coalesce(text, '') ELSE coalesce(text, '') END, chr(10) || chr(10) ORDER BY position, id) AS body FROM covered GROUP BY 1),
    names AS (SELECT worksheet_id, string_agg(label, '; ' ORDER BY topic) AS labels FROM (SELECT DISTINCT worksheet_id, topic, label FROM p) GROUP BY 1),
    x AS (SELECT worksheet_id, source, 'Summary' AS artifact_type, 3 AS type_index, CAST(0 AS BIGINT) AS seed_offset, body AS context FROM body
        UNION ALL SELECT b.worksheet_id, source, 'MindMap', 4, 1, 'Major topics: ' || labels || chr(10) || chr(10) || body FROM body b JOIN names n ON n.worksheet_id = b.worksheet_id)
    SELECT x.*, EXISTS (SELECT 1 FROM a WHERE a.worksheet_id = x.worksheet_id AND a.artifact_type = x.artifact_type) AS skip FROM x
""")
def merged_units(spark: SparkSession, folder: str) -> DataFrame:
    return selection.merged_units(_usable(spark, folder), _once(spark, folder, "artifacts"))


# ---- generation ------------------------------------------------------------------------------------


def _requests(spark: SparkSession, folder: str) -> DataFrame:
    contexts = section_context(spark, folder).withColumnRenamed("id", "segment_id")
    quiz = generate.requests(quiz_units(spark, folder), contexts)
    merged = generate.requests(merged_units(spark, folder).withColumnRenamed("source", "segment_id"))
    return quiz.unionByName(merged.select(*quiz.columns))


@query(f"""
    WITH {CHUNKS}, {ARTIFACTS}, {USABLE}, {STRIDE}, d AS (SELECT DISTINCT worksheet_id, artifact_type, source FROM a)
    SELECT t.artifact_type, count(*) AS requests, CAST(sum(1234 + w.position + 17) AS BIGINT) AS seeds, CAST(0.7 AS DOUBLE) AS temperature, 2048 AS max_tokens
    FROM w CROSS JOIN (VALUES ('MultipleChoiceQuiz'), ('EssayQuiz'), ('CompletionQuiz')) t(artifact_type)
    LEFT JOIN d ON d.worksheet_id = w.worksheet_id AND d.artifact_type = t.artifact_type AND d.source = w.id WHERE d.source IS NULL GROUP BY 1
""")
def quiz_requests(spark: SparkSession, folder: str) -> DataFrame:
    rows = _requests(spark, folder).where(F.col("artifact_type").isin(*selection.QUIZ_TYPES))
    return rows.groupBy("artifact_type").agg(F.count("*").alias("requests"), F.sum("seed").alias("seeds"), F.max("temperature").alias("temperature"), F.max("max_tokens").alias("max_tokens"))


@query()
def generated_artifacts(spark: SparkSession, folder: str) -> DataFrame:
    """All pending units run through the offline backend and validated."""
    requests = _requests(spark, folder)
    contexts = requests.select("segment_id", "context").dropDuplicates(["segment_id"])
    return generate.artifacts(generate.run(requests), contexts)


@query()
def generation_telemetry(spark: SparkSession, folder: str) -> DataFrame:
    return generate.telemetry_of(generate.run(_requests(spark, folder)))


@query(f"""
    WITH {CHUNKS}, {ARTIFACTS}, {USABLE}, {STRIDE}, d AS (SELECT DISTINCT worksheet_id, artifact_type, source FROM a)
    SELECT w.worksheet_id, t.artifact_type, count(d.source) AS done, count(*) AS total, count(d.source) = count(*) AS complete
    FROM w CROSS JOIN (VALUES ('MultipleChoiceQuiz'), ('EssayQuiz'), ('CompletionQuiz')) t(artifact_type)
    LEFT JOIN d ON d.worksheet_id = w.worksheet_id AND d.artifact_type = t.artifact_type AND d.source = w.id GROUP BY 1, 2
""")
def type_progress(spark: SparkSession, folder: str) -> DataFrame:
    return catalog.progress(quiz_units(spark, folder))


# ---- catalog ---------------------------------------------------------------------------------------


@query(f"WITH {CHUNKS} SELECT id, worksheet_id FROM (SELECT DISTINCT * FROM files) f WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.file_id = f.id AND c.worksheet_id = f.worksheet_id)")
def unchunked_files(spark: SparkSession, folder: str) -> DataFrame:
    return catalog.unchunked(_once(spark, folder, "files"), _once(spark, folder, "chunks")).select("id", "worksheet_id")


@query(f"WITH {CHUNKS} SELECT w.id AS worksheet_id, coalesce(max(position), -1) + 1 AS next_position FROM worksheets w LEFT JOIN c ON c.worksheet_id = w.id GROUP BY 1")
def next_position(spark: SparkSession, folder: str) -> DataFrame:
    return catalog.next_position(table(spark, folder, "worksheets"), _once(spark, folder, "chunks"))


@query(f"""
    WITH {CHUNKS}, f AS (SELECT DISTINCT * FROM files),
    p AS (SELECT * FROM f WHERE identity_key IS NOT NULL AND NOT EXISTS (SELECT 1 FROM c WHERE c.file_id = f.id AND c.worksheet_id = f.worksheet_id)),
    s AS (SELECT c.file_id, c.worksheet_id, f.identity_key, min(position) AS first, count(*) AS n FROM c JOIN f ON f.id = c.file_id WHERE f.identity_key IS NOT NULL GROUP BY 1, 2, 3),
    k AS (SELECT p.id, p.worksheet_id, p.created_at, s.file_id, s.worksheet_id AS sw, s.n, row_number() OVER (PARTITION BY p.id, p.worksheet_id ORDER BY s.first, s.file_id, s.worksheet_id) AS r
          FROM p JOIN s ON s.identity_key = p.identity_key AND s.worksheet_id <> p.worksheet_id),
    o AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY worksheet_id ORDER BY created_at, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM k WHERE r = 1),
    l AS (SELECT worksheet_id, max(position) AS last FROM c GROUP BY 1)
    SELECT o.worksheet_id, o.id AS file_id, o.file_id AS source_file_id, c.position AS source_position,
        CAST(coalesce(l.last, -1) + o.before + row_number() OVER (PARTITION BY o.worksheet_id, o.id ORDER BY c.position, c.id) AS INTEGER) AS position
    FROM o JOIN c ON c.file_id = o.file_id AND c.worksheet_id = o.sw LEFT JOIN l ON l.worksheet_id = o.worksheet_id
""")
def identity_reuse(spark: SparkSession, folder: str) -> DataFrame:
    rows = catalog.reuse(_once(spark, folder, "files"), _once(spark, folder, "chunks"))
    return rows.select("worksheet_id", "file_id", "source_file_id", "source_position", "position")


@query("SELECT worksheet_id, count(*) AS file_count, array_to_string(list_sort(list_distinct(list(upper(extension)))), ', ') AS file_extensions FROM (SELECT DISTINCT * FROM files) GROUP BY 1")
def extension_lists(spark: SparkSession, folder: str) -> DataFrame:
    return catalog.extensions(_once(spark, folder, "files"))


@query(f"WITH {ARTIFACTS} SELECT worksheet_id, artifact_type, count(*) AS n FROM a WHERE artifact_type IN {QUIZ} GROUP BY 1, 2")
def quiz_counts(spark: SparkSession, folder: str) -> DataFrame:
    return catalog.quiz_counts(_once(spark, folder, "artifacts"))


@query(f"WITH {ARTIFACTS} SELECT worksheet_id, artifact_type, count(*) AS n FROM a GROUP BY 1, 2")
def artifact_counts(spark: SparkSession, folder: str) -> DataFrame:
    return catalog.artifact_counts(_once(spark, folder, "artifacts"))


PAGE = f"""
    WITH {ARTIFACTS}, p AS (SELECT id, name, created_at, pipeline_status FROM worksheets ORDER BY created_at DESC, id LIMIT 20 OFFSET 20),
    f AS (SELECT worksheet_id, count(*) AS n, array_to_string(list_sort(list_distinct(list(upper(extension)))), ', ') AS e FROM (SELECT DISTINCT * FROM files) GROUP BY 1),
    q AS (SELECT worksheet_id, count(*) FILTER (artifact_type = 'MultipleChoiceQuiz') AS m, count(*) FILTER (artifact_type = 'EssayQuiz') AS e, count(*) FILTER (artifact_type = 'CompletionQuiz') AS c FROM a GROUP BY 1),
    w AS (SELECT p.id AS worksheet_id, name, created_at, pipeline_status, coalesce(f.n, 0) AS file_count, coalesce(f.e, '') AS file_extensions,
        coalesce(q.m, 0) AS multiple_choice, coalesce(q.e, 0) AS essay, coalesce(q.c, 0) AS completion FROM p LEFT JOIN f ON f.worksheet_id = p.id LEFT JOIN q ON q.worksheet_id = p.id)
"""


def _page(spark: SparkSession, folder: str) -> DataFrame:
    return catalog.page(table(spark, folder, "worksheets"), _once(spark, folder, "files"), _once(spark, folder, "artifacts"), number=2)


@query(PAGE + "SELECT * FROM w")
def worksheet_page(spark: SparkSession, folder: str) -> DataFrame:
    return _page(spark, folder)


@query(PAGE + """, l AS (SELECT *, concat_ws(' · ', CASE WHEN multiple_choice > 0 THEN multiple_choice || ' MCQ' END, CASE WHEN essay > 0 THEN essay || ' essay' END, CASE WHEN completion > 0 THEN completion || ' fill' END) AS shown FROM w)
    SELECT worksheet_id, CASE WHEN shown = '' THEN '—' ELSE shown END AS label, file_count || CASE WHEN file_count = 1 THEN ' file' ELSE ' files' END || CASE WHEN file_extensions = '' THEN '' ELSE ' · ' || file_extensions END AS files
    FROM l WHERE contains(lower(name), 'notes')""")
def worksheet_search(spark: SparkSession, folder: str) -> DataFrame:
    rows = catalog.search(_page(spark, folder), " Notes ")
    return rows.select("worksheet_id", consume.count_label().alias("label"), consume.file_label("file_count", "file_extensions").alias("files"))


@query("SELECT count(*) AS total, 20 AS per_page, CAST(ceil(count(*) / 20.0) AS BIGINT) AS total_pages FROM worksheets")
def worksheet_pages(spark: SparkSession, folder: str) -> DataFrame:
    return catalog.pages(table(spark, folder, "worksheets"))


@query(f"""
    WITH {CHUNKS}, {ARTIFACTS}, k AS (SELECT id FROM worksheets WHERE pipeline_status IS DISTINCT FROM 'failed'), g AS (SELECT id FROM worksheets WHERE pipeline_status = 'failed')
    SELECT 'worksheets' AS name, count(*) AS n FROM worksheets WHERE id NOT IN (SELECT id FROM g)
    UNION ALL SELECT 'files', count(*) FROM (SELECT DISTINCT * FROM files) WHERE worksheet_id NOT IN (SELECT id FROM g)
    UNION ALL SELECT 'chunks', count(*) FROM c WHERE worksheet_id NOT IN (SELECT id FROM g)
    UNION ALL SELECT 'artifacts', count(*) FROM a WHERE worksheet_id NOT IN (SELECT id FROM g)
""")
def cascade_delete(spark: SparkSession, folder: str) -> DataFrame:
    worksheets = table(spark, folder, "worksheets")
    names = ("files", "chunks", "artifacts")
    left = catalog.delete_worksheets(worksheets.where("pipeline_status = 'failed'"), (worksheets, "id"), *[(_once(spark, folder, n), "worksheet_id") for n in names])
    out = None
    for name, rows in zip(("worksheets", *names), left):
        one = rows.groupBy().agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query(f"WITH {ARTIFACTS} SELECT artifact_type, count(*) AS n FROM a WHERE NOT (artifact_type IN ('Summary', 'MindMap') AND worksheet_id IN (SELECT id FROM worksheets WHERE pipeline_status = 'done')) GROUP BY 1")
def delete_by_type(spark: SparkSession, folder: str) -> DataFrame:
    done = table(spark, folder, "worksheets").where("pipeline_status = 'done'").select(F.col("id").alias("worksheet_id"))
    return catalog.delete_artifacts(_once(spark, folder, "artifacts"), done, ["Summary", "MindMap"]).groupBy("artifact_type").agg(F.count("*").alias("n"))


@query("SELECT id, CASE WHEN coalesce(pipeline_status IN ('running', 'idle'), false) THEN 'cancelled' ELSE pipeline_status END AS pipeline_status, coalesce(pipeline_status IN ('running', 'idle'), false) AS changed FROM worksheets")
def change_status(spark: SparkSession, folder: str) -> DataFrame:
    return catalog.change_status(table(spark, folder, "worksheets"), ["running", "idle"], "cancelled")


@query("""
    WITH s AS (SELECT *, CASE WHEN pipeline_status IN ('idle', 'running', 'done', 'failed', 'cancelled') THEN pipeline_status ELSE 'failed' END AS state FROM worksheets)
    SELECT id, state, state IN ('done', 'failed', 'cancelled') AS terminal, CASE WHEN state = 'failed' THEN coalesce(pipeline_error, '') END AS error FROM s
""")
def worksheet_status(spark: SparkSession, folder: str) -> DataFrame:
    return catalog.status(table(spark, folder, "worksheets"))


@query("SELECT id FROM worksheets WHERE pipeline_status = 'running'")
def stale_worksheets(spark: SparkSession, folder: str) -> DataFrame:
    return catalog.stale(table(spark, folder, "worksheets"))


@query(f"WITH {ARTIFACTS} SELECT worksheet_id, least(count(*), 10) AS n FROM a WHERE artifact_type = 'MultipleChoiceQuiz' GROUP BY 1")
def sampled_quiz_sizes(spark: SparkSession, folder: str) -> DataFrame:
    """How many artifacts a random quiz of ten has per worksheet; which ones is the draw's."""
    return catalog.sample(_once(spark, folder, "artifacts"), "MultipleChoiceQuiz", 10).groupBy("worksheet_id").agg(F.count("*").alias("n"))


# ---- replies and items -----------------------------------------------------------------------------


@query(f"""
    WITH {REPLIES}, x AS (SELECT *, CASE WHEN field_source = 'content' THEN text END AS content, CASE WHEN field_source = 'reasoning' THEN text END AS reasoning, CASE WHEN field_source = 'reasoning_content' THEN text END AS reasoning_content FROM r WHERE status = 'ok')
    SELECT reply_id, coalesce(CASE WHEN regexp_matches(content, '[^\\s\\p{{Z}}]') THEN content END, CASE WHEN regexp_matches(reasoning, '[^\\s\\p{{Z}}]') THEN reasoning END, CASE WHEN regexp_matches(reasoning_content, '[^\\s\\p{{Z}}]') THEN reasoning_content END) AS text FROM x
""")
def effective_text(spark: SparkSession, folder: str) -> DataFrame:
    rows = _replies(spark, folder).where("status = 'ok'")
    fields = [F.when(F.col("field_source") == f, F.col("text")) for f in ("content", "reasoning", "reasoning_content")]
    return rows.select("reply_id", tx.first_filled(*fields).alias("text"))


@query(f"""
    WITH {REPLIES}, t AS (SELECT reply_id, {TRIM.format('text')} AS t FROM r WHERE status = 'ok')
    SELECT reply_id, md5(CASE WHEN starts_with(t, '```') THEN {TRIM.format("regexp_replace(regexp_replace(regexp_replace(t, '^```(?:json)*', ''), '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g'), '(?:```)+$', '')")} ELSE t END) AS stripped FROM t
""")
def strip_fence(spark: SparkSession, folder: str) -> DataFrame:
    return _replies(spark, folder).where("status = 'ok'").select("reply_id", F.md5(tx.strip_fence("text").cast("binary")).alias("stripped"))


RECOVERED = f"""{REPLIES}, b AS (SELECT *, {TRIM.format("coalesce(text, '')")} AS t FROM r WHERE status = 'ok'),
    v AS (SELECT *, CASE WHEN t <> '' AND json_valid(t) AND NOT regexp_matches(t, ',\\s*[\\]}}]') THEN t WHEN NOT regexp_matches(t, ',\\s*[\\]}}]') AND json_valid(nullif(regexp_extract(t, '(?s)\\{{.*\\}}'), '')) THEN regexp_extract(t, '(?s)\\{{.*\\}}') END AS j FROM b),
    e AS (SELECT reply_id, segment_id, unit_type, unnest(from_json(json_extract(j::JSON, '$.items'), '["JSON"]')) AS item, generate_subscripts(from_json(json_extract(j::JSON, '$.items'), '["JSON"]'), 1) - 1 AS ordinal
          FROM v WHERE j IS NOT NULL AND lower(coalesce(finish_reason, '')) <> 'length' AND json_type(j::JSON, '$.items') = 'ARRAY')"""


@query(f"WITH {RECOVERED} SELECT reply_id, CASE WHEN j IS NULL THEN 'invalid' WHEN json_valid(t) THEN 'strict' ELSE 'extracted' END AS recovery FROM v")
def json_recovery(spark: SparkSession, folder: str) -> DataFrame:
    rows = _replies(spark, folder).where("status = 'ok'")
    return rows.select("reply_id", validate.recovery("text").alias("recovery"))


_OPTIONS = f"list_transform(options, lambda o: {TRIM.format('o')})"
_ANSWER = f"nullif({TRIM.format('answer')}, '')"


@query(f"""
    WITH {ITEMS} SELECT item_id, CASE
        WHEN question IS NULL OR {TRIM.format('question')} = '' THEN 'missing or empty question' WHEN coalesce(len(options), -1) <> 4 THEN 'expected exactly 4 options'
        WHEN len(list_filter(options, lambda o: o IS NULL)) > 0 THEN 'non-string option' WHEN len(list_filter({_OPTIONS}, lambda o: o = '')) > 0 THEN 'empty option'
        WHEN len(list_distinct(list_transform({_OPTIONS}, lambda o: lower(o)))) <> 4 THEN 'duplicate choices' WHEN {_ANSWER} IS NULL THEN 'missing answer'
        WHEN NOT list_contains({_OPTIONS}, {_ANSWER}) THEN 'answer does not match any option' END AS reason FROM i
""")
def mcq_validation(spark: SparkSession, folder: str) -> DataFrame:
    return _items(spark, folder).select("item_id", validate.mcq_reason().alias("reason"))


@query(f"""
    WITH {RECOVERED}, {CHUNKS}, x AS (SELECT e.*, CASE WHEN json_type(item, '$.sentence') = 'VARCHAR' THEN item->>'$.sentence' END AS sentence, CASE WHEN json_type(item, '$.answer') = 'VARCHAR' THEN item->>'$.answer' END AS answer,
        CASE WHEN heading IS NOT NULL THEN '[Section: ' || heading || ']' || chr(10) || coalesce(text, '') ELSE coalesce(text, '') END AS context FROM e LEFT JOIN c ON c.id = e.segment_id WHERE unit_type = 'CompletionQuiz')
    SELECT reply_id, CAST(ordinal AS INTEGER) AS ordinal, CASE WHEN sentence IS NULL THEN 'missing sentence' WHEN answer IS NULL THEN 'missing answer' WHEN {TRIM.format('sentence')} = '' OR {TRIM.format('answer')} = '' THEN 'empty sentence or answer'
        WHEN NOT contains(lower(context), lower({TRIM.format('answer')})) THEN 'answer not found in source' END AS reason FROM x
""")
def completion_validation(spark: SparkSession, folder: str) -> DataFrame:
    return validate.completion_items(_replies(spark, folder), _once(spark, folder, "chunks"))


@query(f"""
    WITH {RECOVERED}, x AS (SELECT *, CASE WHEN json_type(item, '$.question') = 'VARCHAR' THEN item->>'$.question' END AS question FROM e WHERE unit_type = 'EssayQuiz')
    SELECT reply_id, CAST(ordinal AS INTEGER) AS ordinal, CASE WHEN question IS NULL THEN 'missing question' WHEN {TRIM.format('question')} = '' THEN 'empty question' END AS reason FROM x
""")
def essay_validation(spark: SparkSession, folder: str) -> DataFrame:
    return validate.essay_items(_replies(spark, folder))


VERDICTS = f"""{RECOVERED}, {CHUNKS},
    y AS (SELECT e.*, CASE WHEN json_type(item, '$.question') = 'VARCHAR' THEN item->>'$.question' END AS question, CASE WHEN json_type(item, '$.sentence') = 'VARCHAR' THEN item->>'$.sentence' END AS sentence,
        CASE WHEN json_type(item, '$.answer') = 'VARCHAR' THEN item->>'$.answer' END AS answer, CASE WHEN json_type(item, '$.options') = 'ARRAY' THEN from_json(json_extract(item, '$.options'), '["VARCHAR"]') END AS options,
        CASE WHEN heading IS NOT NULL THEN '[Section: ' || heading || ']' || chr(10) || coalesce(text, '') ELSE coalesce(text, '') END AS context FROM e LEFT JOIN c ON c.id = e.segment_id),
    reasons AS (SELECT reply_id, unit_type, CASE unit_type
        WHEN 'EssayQuiz' THEN CASE WHEN question IS NULL THEN 'missing question' WHEN {TRIM.format('question')} = '' THEN 'empty question' END
        WHEN 'CompletionQuiz' THEN CASE WHEN sentence IS NULL THEN 'missing sentence' WHEN answer IS NULL THEN 'missing answer' WHEN {TRIM.format('sentence')} = '' OR {TRIM.format('answer')} = '' THEN 'empty sentence or answer'
            WHEN NOT contains(lower(context), lower({TRIM.format('answer')})) THEN 'answer not found in source' END
        ELSE CASE WHEN question IS NULL OR {TRIM.format('question')} = '' THEN 'missing or empty question' WHEN coalesce(len(options), -1) <> 4 THEN 'expected exactly 4 options'
            WHEN len(list_filter(options, lambda o: o IS NULL)) > 0 THEN 'non-string option' WHEN len(list_filter({_OPTIONS}, lambda o: o = '')) > 0 THEN 'empty option'
            WHEN len(list_distinct(list_transform({_OPTIONS}, lambda o: lower(o)))) <> 4 THEN 'duplicate choices' WHEN {_ANSWER} IS NULL THEN 'missing answer' WHEN NOT list_contains({_OPTIONS}, {_ANSWER}) THEN 'answer does not match any option' END
        END AS reason FROM y WHERE unit_type IN {QUIZ}),
    counted AS (SELECT reply_id, count(*) FILTER (reason IS NULL) AS good, count(*) FILTER (reason IS NOT NULL) AS bad FROM reasons GROUP BY 1),
    node AS (SELECT v.reply_id, jt.type AS type, jt.value::JSON AS x FROM v, json_tree(v.j) jt WHERE unit_type = 'MindMap' AND j IS NOT NULL AND regexp_matches(jt.fullkey, '^\\$\\.branches(\\[\\d+\\]\\.children)*\\[\\d+\\]$')),
    wrong AS (SELECT DISTINCT reply_id FROM node WHERE type <> 'OBJECT' OR coalesce(json_type(x, '$.label') <> 'VARCHAR', true) OR {TRIM.format("(x->>'$.label')")} = '' OR coalesce(json_type(x, '$.children'), 'ARRAY') <> 'ARRAY'),
    q AS (SELECT v.reply_id, unit_type, t = '' AS blank, lower(coalesce(finish_reason, '')) = 'length' AS cut, coalesce(json_type(j::JSON, '$.items') = 'ARRAY', false) AS listed, unit_type IN ('Summary', 'MindMap') AS merged, j IS NULL AS unread,
        CASE unit_type WHEN 'Summary' THEN coalesce(json_type(j::JSON, '$.summary') = 'VARCHAR' AND json_type(j::JSON, '$.key_points') = 'ARRAY', false)
            WHEN 'MindMap' THEN coalesce(json_type(j::JSON, '$.topic') = 'VARCHAR' AND json_type(j::JSON, '$.branches') = 'ARRAY' AND v.reply_id NOT IN (SELECT reply_id FROM wrong), false) END AS whole,
        coalesce(good, 0) AS good, coalesce(bad, 0) AS bad FROM v LEFT JOIN counted ON counted.reply_id = v.reply_id),
    n AS (SELECT reply_id, unit_type, CASE WHEN blank OR cut THEN 0 WHEN merged THEN whole::INTEGER ELSE good END AS accepted, CASE WHEN blank THEN 0 WHEN cut THEN 1 WHEN merged THEN 1 - whole::INTEGER WHEN NOT listed THEN 1 ELSE bad END AS rejected FROM q),
    verdicts AS (SELECT *, CASE WHEN accepted = 0 AND rejected = 0 THEN 'skipped' WHEN accepted = 0 THEN 'rejected' ELSE 'ok' END AS verdict FROM n)"""


@query(f"WITH {VERDICTS} SELECT * FROM verdicts")
def reply_verdicts(spark: SparkSession, folder: str) -> DataFrame:
    return validate.verdicts(_replies(spark, folder), _once(spark, folder, "chunks"))


@query(f"""
    WITH {VERDICTS}, t2 AS (SELECT unit_type, count(*) AS records FROM r GROUP BY 1),
    j2 AS (SELECT unit_type, count(*) AS replies, count(*) FILTER (verdict = 'ok') AS accepted, count(*) FILTER (verdict = 'rejected') AS rejected, count(*) FILTER (verdict = 'skipped') AS skipped FROM verdicts GROUP BY 1)
    SELECT t2.unit_type, records, coalesce(replies, 0) AS replies, coalesce(accepted, 0) AS accepted, coalesce(rejected, 0) AS rejected, coalesce(skipped, 0) AS skipped,
        round(accepted / nullif(replies, 0), 9) AS accepted_of_replies, round(coalesce(accepted, 0) / records, 9) AS accepted_of_records FROM t2 LEFT JOIN j2 USING (unit_type)
""")
def acceptance_rates(spark: SparkSession, folder: str) -> DataFrame:
    """Verdicts by type, and the share accepted of replies and of all response records."""
    rows = telemetry.acceptance(reply_verdicts(spark, folder), _replies(spark, folder))
    return rows.withColumn("accepted_of_replies", F.round("accepted_of_replies", 9)).withColumn("accepted_of_records", F.round("accepted_of_records", 9))


@query(f"""
    WITH {VERDICTS}, x AS (SELECT unit_type, reason FROM reasons WHERE reason IS NOT NULL
        UNION ALL SELECT unit_type, CASE WHEN cut THEN 'truncated' WHEN unread THEN 'no readable JSON' ELSE 'missing item array' END FROM q WHERE NOT blank AND NOT merged AND (cut OR unread OR NOT listed))
    SELECT unit_type, reason, count(*) AS n FROM x GROUP BY 1, 2
""")
def rejection_histogram(spark: SparkSession, folder: str) -> DataFrame:
    return validate.rejection_reasons(_replies(spark, folder), _once(spark, folder, "chunks"))


@query(f"WITH {VERDICTS} SELECT unit_type, count(*) AS units, CAST(sum(accepted) AS BIGINT) AS questions, round(avg(accepted), 9) AS per_unit FROM verdicts WHERE verdict = 'ok' GROUP BY 1")
def accepted_questions(spark: SparkSession, folder: str) -> DataFrame:
    """Questions per accepted unit, by type."""
    return telemetry.accepted_questions(reply_verdicts(spark, folder)).withColumn("per_unit", F.round("per_unit", 9))


@query(r"""
    WITH a AS (SELECT DISTINCT * FROM artifacts), v AS (SELECT id, CASE WHEN json_valid(content) THEN content::JSON END AS v FROM a WHERE artifact_type = 'Summary' AND json_valid(content))
    SELECT id, coalesce(json_type(v, '$.summary') = 'VARCHAR' AND json_type(v, '$.key_points') = 'ARRAY', false) AS valid,
        coalesce(json_type(v, '$.summary') = 'VARCHAR' AND json_type(v, '$.key_points') = 'ARRAY' AND json_type(v, '$.title') = 'VARCHAR'
            AND len(list_filter(from_json(json_extract(v, '$.key_points'), '["JSON"]'), lambda p: json_type(p) <> 'VARCHAR')) = 0, false) AS displayable FROM v
""")
def summary_validation(spark: SparkSession, folder: str) -> DataFrame:
    rows = _once(spark, folder, "artifacts").where((F.col("artifact_type") == "Summary") & F.try_parse_json("content").isNotNull())
    strict = rows.select("id", F.to_json(F.try_parse_json("content")).alias("content"))
    return validate.summaries(strict, "id", "content")


# The outermost value of each artifact's content: opened once if it is a JSON string, without what stands around it; and its tree.
NODES = f"""raw AS (SELECT DISTINCT id AS record_id, content FROM artifacts WHERE content IS NOT NULL),
    once AS (SELECT record_id, {TRIM.format("replace(content, chr(65279), '')")} AS t FROM raw),
    opened AS (SELECT record_id, CASE WHEN starts_with(t, '"') THEN CASE WHEN json_valid(t) THEN {TRIM.format("(t::JSON->>'$')")} END ELSE t END AS t FROM once),
    outer_ AS (SELECT record_id, CASE WHEN json_valid(t) AND json_type(t) IN ('OBJECT', 'ARRAY') THEN t
        WHEN regexp_matches(t, '^[^{{\\[]*\\[\\s*[A-Za-z.]') THEN regexp_extract(t, '(?s)\\{{.*\\}}') ELSE regexp_extract(t, '(?s)[\\[{{].*[\\]}}]') END AS j FROM opened),
    value AS (SELECT record_id, j FROM outer_ WHERE json_valid(j) AND NOT regexp_matches(j, ',\\s*[\\]}}]')),
    tree AS (SELECT record_id, jt.id AS i, jt.parent AS up, jt.key AS key, lower(jt.type) AS type, jt.value::JSON AS x, regexp_replace(jt.fullkey, '\\."([^"]*)"', '.\\1', 'g') AS node FROM value, json_tree(value.j) jt),
    nodes AS (SELECT *, CASE WHEN node <> '$' THEN CAST(row_number() OVER (PARTITION BY record_id, up ORDER BY i) - 1 AS INTEGER) END AS ordinal,
        CASE WHEN node <> '$' THEN regexp_replace(regexp_replace(node, '(\\[\\d+\\])+$', ''), '\\.[^.]*$', '') END AS owner FROM tree)"""


@query()
def mind_map_validation(spark: SparkSession, folder: str) -> DataFrame:
    return validate.mind_maps(_once(spark, folder, "artifacts").where(F.col("artifact_type") == "MindMap"), "id", "content")


@query(f"""
    WITH {ARTIFACTS}, m AS (SELECT id, {TRIM.format("coalesce(content, '')")} AS t FROM a WHERE artifact_type = 'MindMap'),
    v AS (SELECT id, CASE WHEN json_valid(t) THEN t WHEN json_valid(nullif(regexp_extract(t, '(?s)\\{{.*\\}}'), '')) THEN regexp_extract(t, '(?s)\\{{.*\\}}') END AS j FROM m),
    w AS (SELECT id, CASE WHEN NOT regexp_matches(j, ',\\s*[\\]}}]') THEN j END AS j FROM v),
    node AS (SELECT w.id AS id, jt.type AS type, jt.value::JSON AS x FROM w, json_tree(w.j) jt WHERE j IS NOT NULL AND regexp_matches(jt.fullkey, '^\\$\\.branches(\\[\\d+\\]\\.children)*\\[\\d+\\]$')),
    n AS (SELECT id, count(*) AS nodes, count(*) FILTER (type <> 'OBJECT' OR coalesce(json_type(x, '$.label') <> 'VARCHAR', true) OR {TRIM.format("(x->>'$.label')")} = '' OR coalesce(json_type(x, '$.children'), 'ARRAY') <> 'ARRAY') AS bad FROM node GROUP BY 1),
    k AS (SELECT w.id, coalesce(json_type(j::JSON, '$.topic') = 'VARCHAR' AND json_type(j::JSON, '$.branches') = 'ARRAY' AND coalesce(bad, 0) = 0, false) AS valid, coalesce(nodes, 0) AS nodes FROM w LEFT JOIN n ON n.id = w.id)
    SELECT id, valid, CASE WHEN valid THEN nodes END AS nodes FROM k
""")
def mind_map_nodes(spark: SparkSession, folder: str) -> DataFrame:
    """Which mind maps are valid, and how many nodes their normal form has."""
    maps = mind_map_validation(spark, folder)
    nodes = F.regexp_count("map", F.lit(r'\{"label": ')).cast("long")
    return maps.select("id", F.col("map").isNotNull().alias("valid"), nodes.alias("nodes"))


@query(f"""
    WITH {NODES.replace("WHERE content IS NOT NULL", "WHERE content IS NOT NULL AND artifact_type = 'MindMap'")}, l AS (SELECT *, CASE WHEN json_type(x, '$.label') = 'VARCHAR' THEN x->>'$.label' END AS label FROM nodes WHERE type = 'object' AND node <> '$')
    SELECT record_id, node AS path, owner AS parent_path, CAST(length(node) - length(replace(node, '.', '')) AS INTEGER) AS depth,
        replace(replace(replace(replace(CASE WHEN {TRIM.format('label')} = '' THEN 'Untitled' ELSE {TRIM.format('label')} END, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS label FROM l WHERE label IS NOT NULL
""")
def mind_map_tree(spark: SparkSession, folder: str) -> DataFrame:
    maps = _once(spark, folder, "artifacts").where(F.col("artifact_type") == "MindMap")
    return consume.tree(nested.shred(maps, "id", "content"))


@query(f"""
    WITH {ARTIFACTS}, b AS (SELECT id, artifact_type, {TRIM.format("coalesce(content, '')")} AS t FROM a WHERE artifact_type IN {QUIZ}),
    v AS (SELECT *, CASE WHEN json_valid(t) AND NOT regexp_matches(t, ',\\s*[\\]}}]') THEN t WHEN NOT regexp_matches(t, ',\\s*[\\]}}]') AND json_valid(nullif(regexp_extract(t, '(?s)\\{{.*\\}}'), '')) THEN regexp_extract(t, '(?s)\\{{.*\\}}') END AS j FROM b),
    f AS (SELECT id, artifact_type, j::JSON AS j FROM v WHERE j IS NOT NULL),
    g AS (SELECT *, CASE WHEN json_type(j, '$.question') = 'VARCHAR' THEN j->>'$.question' WHEN json_type(j, '$.sentence') = 'VARCHAR' THEN j->>'$.sentence' END AS question FROM f)
    SELECT id, artifact_type, question, CASE WHEN json_type(j, '$.answer') = 'VARCHAR' THEN j->>'$.answer' WHEN json_type(j, '$.model_answer') = 'VARCHAR' THEN j->>'$.model_answer' END AS answer,
        CASE WHEN json_type(j, '$.options') = 'ARRAY' THEN from_json(json_extract(j, '$.options'), '["VARCHAR"]') END AS options FROM g WHERE question IS NOT NULL
""")
def quiz_questions(spark: SparkSession, folder: str) -> DataFrame:
    return consume.questions(_once(spark, folder, "artifacts"))


GRADES = f"""{ITEMS}, g AS (SELECT worksheet_id, item_id, CASE WHEN len(options) > 0 THEN options[1 + item_id % len(options)] END AS given, answer FROM i WHERE answer IS NOT NULL),
    h AS (SELECT *, coalesce(given = answer AND regexp_matches(given, '[^\\s\\p{{Z}}]'), false) AS correct FROM g)"""


def _graded(spark: SparkSession, folder: str) -> DataFrame:
    given = F.when(F.size("options") > 0, F.expr("element_at(options, cast(1 + item_id % size(options) as int))"))
    rows = _items(spark, folder).where("answer is not null").withColumn("given", given)
    return rows.select("worksheet_id", "item_id", consume.correct(F.lit("MultipleChoiceQuiz"), "answer", "given").alias("correct"))


@query(f"WITH {GRADES} SELECT worksheet_id, item_id, correct FROM h")
def graded_items(spark: SparkSession, folder: str) -> DataFrame:
    return _graded(spark, folder)


@query(f"""
    WITH {GRADES}, s AS (SELECT worksheet_id, count(*) AS graded, count(*) FILTER (correct) AS correct FROM h GROUP BY 1), p AS (SELECT *, CAST(floor(100.0 * correct / graded + 0.5) AS BIGINT) AS percent FROM s)
    SELECT *, CASE WHEN percent >= 80 THEN 'Excellent' WHEN percent >= 50 THEN 'Good job' ELSE 'Keep practicing' END AS tier FROM p
""")
def quiz_scores(spark: SparkSession, folder: str) -> DataFrame:
    return consume.scores(_graded(spark, folder), ["worksheet_id"])


@query("""
    WITH s AS (SELECT id, CAST(greatest(coalesce(size, 0), 0) AS DOUBLE) AS b FROM (SELECT DISTINCT * FROM files)),
    p AS (SELECT *, CAST(floor(ln(greatest(b, 1.0)) / ln(1024.0) + 1e-12) AS INTEGER) AS p FROM s)
    SELECT id, CASE WHEN b <= 0 THEN '0B' ELSE regexp_replace(regexp_replace(printf('%.2f', b / pow(1024.0, p)), '0+$', ''), '\\.$', '') || (['Bytes', 'KB', 'MB', 'GB', 'TB', 'PB', 'EB', 'ZB', 'YB'])[p + 1] END AS shown FROM p
""")
def file_sizes(spark: SparkSession, folder: str) -> DataFrame:
    return _once(spark, folder, "files").select("id", tx.format_bytes("size").alias("shown"))


@query(f"""
    WITH {REPLIES}, s AS (SELECT reply_id, greatest(coalesce(elapsed_ms // 1000, 0), 0) AS s FROM r)
    SELECT reply_id, lpad(least(s // 3600, 99)::VARCHAR, 2, '0') || lpad((s % 3600 // 60)::VARCHAR, 2, '0') || lpad((s % 60)::VARCHAR, 2, '0') AS clock FROM s
""")
def reply_clocks(spark: SparkSession, folder: str) -> DataFrame:
    return _replies(spark, folder).select("reply_id", tx.format_clock(F.expr("elapsed_ms div 1000")).alias("clock"))


# ---- telemetry -------------------------------------------------------------------------------------


@query("""
    WITH m AS (SELECT *, row_number() OVER (PARTITION BY read_id ORDER BY arrived_at DESC) AS rn FROM metrics_ingestion),
    v AS (SELECT worksheet_id, CAST(duration_ms AS DOUBLE) AS x FROM m WHERE rn = 1 AND duration_ms >= 0),
    o AS (SELECT *, row_number() OVER (PARTITION BY worksheet_id ORDER BY x) - 1 AS k, count(*) OVER (PARTITION BY worksheet_id) AS n FROM v)
    SELECT worksheet_id, count(*) AS n, round(avg(x), 6) AS mean, min(x) AS minimum, max(x) AS maximum, sum(x) AS total,
        (max(CASE WHEN k = (n - 1) // 2 THEN x END) + max(CASE WHEN k = n // 2 THEN x END)) / 2 AS median, max(CASE WHEN k = floor(0.9 * n) THEN x END) AS p90 FROM o GROUP BY 1
""")
def ingestion_summary(spark: SparkSession, folder: str) -> DataFrame:
    rows = telemetry.latest(table(spark, folder, "metrics_ingestion"), "read_id").where("duration_ms >= 0")
    return telemetry.stage_summary(rows, ["worksheet_id"], "duration_ms").withColumn("mean", F.round("mean", 6))


@query("""
    WITH m AS (SELECT *, row_number() OVER (PARTITION BY read_id ORDER BY arrived_at DESC) AS rn FROM metrics_tokenization)
    SELECT file_id, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(sum(calls) AS BIGINT) AS calls, round(CASE WHEN sum(calls) <> 0 THEN sum(tokens) / sum(calls) END, 6) AS tokens_per_call,
        round(CASE WHEN sum(duration_ms) <> 0 THEN sum(tokens) * 1000.0 / sum(duration_ms) END, 6) AS tokens_per_second FROM m WHERE rn = 1 GROUP BY 1
""")
def token_rates(spark: SparkSession, folder: str) -> DataFrame:
    rows = telemetry.latest(table(spark, folder, "metrics_tokenization"), "read_id")
    return telemetry.token_rates(rows).withColumn("tokens_per_call", F.round("tokens_per_call", 6)).withColumn("tokens_per_second", F.round("tokens_per_second", 6))


_CLASS = "CASE WHEN error IS NULL THEN NULL WHEN starts_with(lower(error), 'rate limited') THEN 'rate_limited' WHEN starts_with(lower(error), 'network error') THEN 'network' WHEN starts_with(lower(error), 'provider server error') THEN 'server' WHEN starts_with(lower(error), 'request rejected') THEN 'rejected' WHEN starts_with(lower(error), 'invalid provider response') THEN 'invalid' ELSE 'other' END"


@query(f"""
    WITH {REPLIES} SELECT provider, count(*) AS records, count(*) FILTER (status = 'ok') AS replies, count(*) FILTER ({_CLASS} IN ('rate_limited', 'network', 'server')) AS retryable,
        round(count(*) FILTER (status = 'ok') / count(*), 9) AS reply_share, CAST(sum(elapsed_ms) AS BIGINT) AS elapsed_ms FROM r GROUP BY 1
""")
def transport_rates(spark: SparkSession, folder: str) -> DataFrame:
    return telemetry.transport(_replies(spark, folder)).withColumn("reply_share", F.round("reply_share", 9))


@query(f"WITH {REPLIES} SELECT {_CLASS} AS error_class, attempt, count(*) AS n, coalesce({_CLASS} IN ('rate_limited', 'network', 'server'), false) AS retryable FROM r WHERE status = 'error' GROUP BY 1, 2, 4")
def error_histogram(spark: SparkSession, folder: str) -> DataFrame:
    return telemetry.errors(_replies(spark, folder))


@query(f"""
    WITH {REPLIES}, v AS (SELECT status, CAST(elapsed_ms AS DOUBLE) AS x FROM r WHERE elapsed_ms >= 0),
    o AS (SELECT *, row_number() OVER (PARTITION BY status ORDER BY x) - 1 AS k, count(*) OVER (PARTITION BY status) AS n FROM v)
    SELECT status, count(*) AS n, round(avg(x), 6) AS mean, min(x) AS minimum, max(x) AS maximum, sum(x) AS total,
        (max(CASE WHEN k = (n - 1) // 2 THEN x END) + max(CASE WHEN k = n // 2 THEN x END)) / 2 AS median, max(CASE WHEN k = floor(0.9 * n) THEN x END) AS p90 FROM o GROUP BY 1
""")
def reply_latency(spark: SparkSession, folder: str) -> DataFrame:
    """Latency of replies and of errors."""
    return telemetry.latency(_replies(spark, folder)).withColumn("mean", F.round("mean", 6))


@query(f"""
    WITH {REPLIES}, m AS (SELECT provider, contains(lower(error), 'response_format') OR contains(lower(error), 'json_schema') OR contains(lower(error), 'structured output') AS schemaless FROM r WHERE status = 'error')
    SELECT provider, count(*) AS errors, count(*) FILTER (schemaless) AS schemaless FROM m GROUP BY 1
""")
def schema_refusals(spark: SparkSession, folder: str) -> DataFrame:
    """Errors of each provider, and those that ask for a request without schema."""
    rows = _replies(spark, folder).where("status = 'error'")
    return rows.groupBy("provider").agg(F.count("*").alias("errors"), F.count_if(telemetry.asks_without_schema("error")).alias("schemaless"))


@query(f"WITH {REPLIES} SELECT attempt, count(*) AS n FROM r GROUP BY 1")
def attempt_histogram(spark: SparkSession, folder: str) -> DataFrame:
    return telemetry.attempts(_replies(spark, folder))


@query(f"WITH {REPLIES} SELECT reply_id, CAST(350 * pow(2, least(attempt, 3)) + 200 AS BIGINT) AS pause_ms FROM r")
def backoff_schedule(spark: SparkSession, folder: str) -> DataFrame:
    return _replies(spark, folder).select("reply_id", telemetry.backoff_ms("attempt").alias("pause_ms"))


@query(f"""
    WITH {ITEMS}, u AS (SELECT worksheet_id, reply_id, count(*) AS n FROM i GROUP BY 1, 2)
    SELECT worksheet_id, count(*) AS units, CAST(sum(n) AS BIGINT) AS questions, round(avg(n), 9) AS per_unit FROM u GROUP BY 1
""")
def questions_per_unit(spark: SparkSession, folder: str) -> DataFrame:
    return telemetry.questions_per_unit(_items(spark, folder)).withColumn("per_unit", F.round("per_unit", 9))


@query(f"""
    WITH {REPLIES} SELECT reply_id, strftime(logged_at, '%Y%m%dT%H%M%S.%g') || 'Z' AS stamp,
        strftime(logged_at, '%Y-%m-%dT%H:%M:%S') || regexp_replace(regexp_replace('.' || strftime(logged_at, '%f'), '0+$', ''), '^\\.$', '') || 'Z' AS readable FROM r
""")
def compact_stamps(spark: SparkSession, folder: str) -> DataFrame:
    return _replies(spark, folder).select("reply_id", tx.compact_stamp("logged_at").alias("stamp"), tx.readable_stamp("logged_at").alias("readable"))


# ---- streaming -------------------------------------------------------------------------------------


@query(f"WITH {CHUNKS} SELECT worksheet_id, count(*) AS segments, CAST(sum(coalesce(strlen(text) // 4, 0)) AS BIGINT) AS tokens FROM c GROUP BY 1")
def streamed_segments(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks taken in as a stream, once per id, then counted."""
    stored = ingest.ingest_available(spark, folder, "chunks", "id")
    return stored.groupBy("worksheet_id").agg(F.count("*").alias("segments"), F.sum(tx.byte_tokens("text")).alias("tokens"))


@query("""
    SELECT date_trunc('hour', logged_at) AS hour, count(DISTINCT read_id) AS reads FROM metrics_ingestion WHERE logged_at IS NOT NULL GROUP BY 1
""")
def hourly_reads(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct reads per hour from a stream with watermark, all late rows within it."""
    return ingest.hourly_counts(spark, folder, "metrics_ingestion", "read_id", "logged_at")


# ---- nested records --------------------------------------------------------------------------------


def _artifact_nodes(spark: SparkSession, folder: str) -> DataFrame:
    return nested.shred(table(spark, folder, "artifacts"), "id", "content")


@query(f"WITH {NODES} SELECT record_id AS artifact_id, owner AS parent_path, node AS child_path FROM nodes WHERE type = 'object' AND node <> '$'")
def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return nested.object_links(_artifact_nodes(spark, folder)).withColumnRenamed("record_id", "artifact_id")


@query(f"""
    WITH {NODES} SELECT record_id, node, CASE WHEN node = '$' THEN NULL WHEN ends_with(node, ']') THEN regexp_replace(node, '\\[\\d+\\]$', '') ELSE regexp_replace(node, '\\.[^.]*$', '') END AS parent, owner,
        nullif(regexp_extract(regexp_replace(node, '(\\[\\d+\\])+$', ''), '\\.([^.]*)$', 1), '') AS label,
        ordinal, CASE WHEN type IN ('object', 'array', 'boolean', 'null') THEN type WHEN type = 'varchar' THEN 'string' ELSE 'number' END AS kind,
        CASE WHEN type NOT IN ('object', 'array', 'null') THEN x->>'$' END AS scalar FROM nodes
""")
def p2_nodes(spark: SparkSession, folder: str) -> DataFrame:
    return _artifact_nodes(spark, folder)


@query(f"""
    WITH {NODES}, o AS (SELECT record_id, regexp_replace(node, '\\[\\d+\\]', '', 'g') AS entity FROM nodes WHERE type = 'object')
    SELECT entity, count(*) AS objects, count(DISTINCT record_id) AS records FROM o GROUP BY 1
""")
def p2_entity_catalog(spark: SparkSession, folder: str) -> DataFrame:
    return nested.entity_catalog(_artifact_nodes(spark, folder))


@query()
def p2_entities(spark: SparkSession, folder: str) -> DataFrame:
    """A row per object of any entity, the outermost ones too, with its scalars."""
    return nested.entities(nested.shred(table(spark, folder, "artifacts"), "id", "content", places=True))


@query()
def p2_mindmap_tree(spark: SparkSession, folder: str) -> DataFrame:
    """The nodes of mind maps under all their keys, each linked to the node or map that holds it."""
    return nested.tree_table(nested.shred(table(spark, folder, "artifacts"), "id", "content", places=True))


_FIELD = "CASE WHEN json_type(x, '$.{0}') NOT IN ('OBJECT', 'ARRAY', 'NULL') THEN x->>'$.{0}' END AS field_{0}"


@query(f"""
    WITH {NODES} SELECT record_id, node AS path, owner AS parent_path, ordinal AS position, {_FIELD.format('score')}, {_FIELD.format('descriptor')}
    FROM nodes WHERE type = 'object' AND regexp_replace(node, '\\[\\d+\\]', '', 'g') = '$.rubric.levels'
""")
def p2_rubric_levels(spark: SparkSession, folder: str) -> DataFrame:
    return nested.entity_table(_artifact_nodes(spark, folder), "$.rubric.levels", ["score", "descriptor"])


@query(f"""
    WITH {NODES} SELECT record_id, node AS path, owner AS parent_path, ordinal AS position, {_FIELD.format('label')}, {_FIELD.format('weight')}
    FROM nodes WHERE type = 'object' AND regexp_matches(node, '\\.children(\\[\\d+\\])*$')
""")
def p2_mindmap_children(spark: SparkSession, folder: str) -> DataFrame:
    return nested.entity_table(_artifact_nodes(spark, folder), "children", ["label", "weight"], recursive=True)
