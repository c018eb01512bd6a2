import random

from pyspark.sql import functions as F

from folioflow.functions import ranks, text as tx


def one(spark, column, schema, *values):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], schema).select(column).collect()]


def test_trim_takes_unicode_spaces(spark):
    assert one(spark, tx.trim("s"), "s string", "  a b ", None, "", "\n\t") == ["a b", None, "", ""]
    assert one(spark, tx.blank_to_null("s"), "s string", " ", "x ", None) == [None, "x", None]


def test_tokens_terms_and_words(spark):
    assert one(spark, tx.byte_tokens("s"), "s string", "abcdefg", "", None, "éé") == [1, 0, 0, 1]
    assert one(spark, tx.approximate_tokens("s"), "s string", "", None) == [1, 1]
    assert one(spark, tx.terms("s"), "s string", "An éS x2y, THE-end", None) == [["és", "x2y", "the", "end"], []]
    assert one(spark, tx.meaningful_words("s"), "s string", "a 1 b2 --", "  ", None) == [2, 0, 0]


def test_has_words_agrees_with_the_count(spark):
    rng = random.Random(5)
    texts = [None, ""] + ["".join(rng.choice("aé1- \n\u00a0") for _ in range(rng.randrange(60))) for _ in range(400)] + ["1 " * 200_000, "a1" * 100_000, "w " * 100_000]
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    for n in (1, 3, 10):
        assert df.where(tx.has_words("s", n) != (tx.meaningful_words("s") >= n)).count() == 0


def test_formats(spark):
    assert one(spark, tx.format_bytes("n"), "n long", 0, None, 1, 1024, 1536, 1048576, 1234567, 2**60 * 3) == ["0B", "0B", "1Bytes", "1KB", "1.5KB", "1MB", "1.18MB", "3EB"]
    assert one(spark, tx.compact_stamp(F.col("s").cast("timestamp")), "s string", "2026-08-30 14:32:05.1239", None) == ["20260830T143205.123Z", None]
    assert one(spark, tx.readable_stamp(F.col("s").cast("timestamp")), "s string", "2026-08-30 14:32:05.120", "2026-08-30 14:32:05", None) == ["2026-08-30T14:32:05.12Z", "2026-08-30T14:32:05Z", None]
    assert one(spark, tx.format_clock(F.col("n")), "n long", 0, 61, 3599, 400_000, -5, None) == ["000000", "000101", "005959", "990640", "000000", "000000"]
    assert one(spark, tx.label("s"), "s string", "a b/c", "", None) == ["a_b_c", "unnamed", "unnamed"]
    assert one(spark, tx.escape_html("s"), "s string", '<a href="x">&', None) == ["&lt;a href=&quot;x&quot;&gt;&amp;", None]
    assert one(spark, tx.strip_fence("s"), "s string", '```json\n{"a":1}\n```', "plain ", None) == ['{"a":1}', "plain", None]
    assert one(spark, tx.section_context(F.col("s"), F.lit("t")), "s string", "h", None) == ["[Section: h]\nt", "t"]
    assert one(spark, tx.last_dot("s"), "s string", "a.b.PDF", "none", None) == ["pdf", None, None]


def test_first_filled_and_fences(spark):
    rows = [("c", "r", "x"), (" ", "r ", "x"), (None, "", "x"), (None, None, " "), ("", "r", None)]
    df = spark.createDataFrame(rows, "content string, reasoning string, reasoning_content string")
    assert [r[0] for r in df.select(tx.first_filled("content", "reasoning", "reasoning_content")).collect()] == ["c", "r ", "x", None, "r"]
    assert one(spark, tx.strip_fence("s"), "s string", "```\n{}\n``````", "```json json```", "a ```b```", "``` ```") == ["{}", "json", "a ```b```", ""]


def test_ranks_over_blocks_equal_a_window(spark):
    rows = [("a", i % 50, i) for i in range(300)] + [("b", None, 1), (None, 3, 1), (None, 3, 2)]
    df = spark.createDataFrame(rows, "k string, o int, id int")
    got = {(r.k, r.id): r.n for r in ranks.rank(df, ["k"], "o", "n", ["id"], block=7).collect()}
    want = {}
    for k in {r[0] for r in rows}:
        for n, r in enumerate(sorted((r for r in rows if r[0] == k), key=lambda r: (r[1] is not None, r[1] or 0, r[2])), 1):
            want[(k, r[2])] = n
    assert got == want
    assert ranks.rank(df.limit(0), ["k"], "o", "n").count() == 0
