import random

from folioflow.operators import blocks, segments
from pyspark.sql import functions as F


def md(spark, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    return [(r.id, r.kind, r.level, r.text) for r in blocks.markdown_blocks(df, "id", "text").orderBy("id", "ordinal").collect()]


def test_markdown(spark):
    text = "intro\n\n  ## Head ##\nbody one\nbody two\n####### seven\n#nospace\n# Last"
    assert md(spark, text, " ", None, "") == [
        (0, "body", None, "intro\n\n"), (0, "heading", 2, "Head"), (0, "body", None, "body one\nbody two\n####### seven\n#nospace\n"), (0, "heading", 1, "Last"),
    ]


def test_layout_and_recognition(spark):
    schema = "kind string, text string, level int, lines array<string>, rows array<array<string>>"
    rows = [("heading", " T ", 9, None, None), ("heading", "T", None, None, None), ("figure", "x", None, None, None), ("table", None, None, None, [[" a", "", "b"], [" "]]), ("text", None, None, ["p", "q"], None), ("text", " ", None, None, None)]
    df = spark.createDataFrame(rows, schema)
    got = [r.b and (r.b.kind, r.b.level, r.b.text) for r in df.select(blocks.layout_block(F.struct(*df.columns)).alias("b")).collect()]
    assert got == [("heading", 6, "T"), ("heading", 1, "T"), None, ("body", None, "a\tb\n"), ("body", None, "p\nq"), None]
    pages = spark.createDataFrame([("f", ["Scanned"])] * 5 + [("f", ["Images"])] * 3 + [("g", ["Sparse"])] * 2 + [("h", None)], "file_id string, reasons array<string>")
    assert {r.file_id: (r.share, r.needed) for r in blocks.recognition_needed(pages).collect()} == {"f": (0.625, True), "g": (0.0, False), "h": (0.0, False)}


def test_dispatch_and_identity(spark):
    df = spark.createDataFrame([("PDF",), ("md",), ("csv",), ("DocX",), ("exe",), (None,)], "e string")
    assert [r[0] for r in df.select(blocks.parser_of("e")).collect()] == ["document", "markdown", "text", "office", None, None]
    f = spark.createDataFrame([("p", 3, 9), (None, 3, 9)], "path string, size long, at long")
    assert [r[0] for r in f.select(blocks.identity_key("path", "size", "at")).collect()] == ["p\x1f3\x1f9", None]


def test_sentences():
    s = segments.sentences_of
    assert s("One. Two!\nThree goes\non here. tail") == ["One.", "Two!", "Three goes on here.", "tail"]
    assert s("Pi is 3.14 now. Wait... no. Dr. Who e.g. this one. (Yes.) End?") == ["Pi is 3.14 now.", "Wait... no. Dr. Who e.g. this one.", "(Yes.) End?"]
    assert s("") == [] and s("\n  \n") == []
    # only a line feed ends a line, and the other marks of lines are text
    assert s("a\x0bb. c\x1cd\re. f\u2028g\r\nh") == ["a\x0bb.", "c\x1cd\re.", "f\u2028g h"]


def test_windows_are_measured_in_bytes():
    for text in ("я" * 9000, "a€" * 5000, "x" * 7200, "", "😀" * 4000):
        made = segments.byte_windows(text, 7200)
        assert "".join(made) == text and all(0 < len(p.encode()) <= 7200 for p in made) and all(len(p.encode()) > 7196 for p in made[:-1])


def test_pages_fall_back_from_layout_to_markdown_to_text(spark):
    block = "struct<kind:string,text:string,level:int,lines:array<string>,rows:array<array<string>>>"
    figure, head = ("figure", "x", None, None, None), ("heading", "H", 2, None, None)
    rows = [(1, [figure, head], "# M", "raw"), (2, [figure], "# M\nbody", "raw"), (3, None, " ", "raw"), (4, [], None, " "), (5, None, None, None)]
    df = spark.createDataFrame(rows, f"id int, layout array<{block}>, markdown string, text string")
    got = sorted((r.id, r.ordinal, r.kind, r.level, r.text) for r in blocks.page_blocks(df).collect())
    assert got == [(1, 0, "heading", 2, "H"), (2, 0, "heading", 1, "M"), (2, 1, "body", None, "body\n"), (3, 0, "body", None, "raw")]
    files = spark.createDataFrame([("f",), ("g",)], "id string")
    pages = spark.createDataFrame([("f", ["Sparse"])], "file_id string, reasons array<string>")
    assert {tuple(r) for r in blocks.recognition_of_files(files, pages).collect()} == {("f", False), ("g", True)}


def test_a_text_of_many_lines_is_no_quadratic_work(spark):
    text = "\n".join(f"# h{i}\nline {i}" if i % 50 == 0 else f"line {i}" for i in range(100_000))
    df = spark.createDataFrame([(1, text)], "id int, text string")
    assert blocks.markdown_blocks(df, "id", "text").count() == 4000


def brute_segments(items):
    drafts, heading, text, tokens = [], None, "", 0

    def flush():
        if text.strip():
            drafts.append([heading, text.strip(), tokens])

    for kind, body in items:
        if kind == "heading":
            flush()
            heading, text, tokens = body.strip() or None, "", 0
            continue
        body = body.strip()
        if not body:
            continue
        parts = segments.sentences_of(body) if len(body.encode()) // 4 > segments.TARGET else [body]
        for p in parts:
            n = len(p.encode()) // 4
            if tokens > 0 and tokens + n > segments.TARGET:
                flush()
                text, tokens = "", 0
            text, tokens = (text + " " + p if text else p), tokens + n
    flush()
    cut = []
    for h, t, n in drafts:
        if n <= segments.MAXIMUM:
            cut.append([h, t, n])
        else:
            piece = ""
            for c in t + "\0":
                if c == "\0" or len((piece + c).encode()) > 4 * segments.MAXIMUM:
                    cut.append([h, piece, len(piece.encode()) // 4])
                    piece = ""
                piece += c
    out = []
    for h, t, n in cut:
        if out and out[-1][2] + n <= segments.MAXIMUM and (out[-1][2] < segments.MINIMUM or n < segments.MINIMUM):
            out[-1] = [out[-1][0] if out[-1][0] is not None else h, out[-1][1] + "\n" + t, out[-1][2] + n]
        else:
            out.append([h, t, n])
    return [tuple(x) for x in out]


def test_segments_against_brute_force(spark):
    rng = random.Random(3)
    files, rows = {}, []
    for i in range(25):
        items = []
        for _ in range(rng.randrange(12)):
            if rng.random() < 0.3:
                items.append(("heading", rng.choice([" A ", "", "Béta"])))
            else:
                sentence = "x" * rng.choice([3, 60, 900]) + rng.choice([".", "", "é!"])
                items.append(("body", " ".join([sentence] * rng.choice([0, 1, 3, 40]))))
        items.append(("body", rng.choice(["y", "я", "a€"]) * rng.choice([0, 5, 9_000])))
        files[i] = items
        rows += [(i, n, kind, text) for n, (kind, text) in enumerate(items)]
    df = spark.createDataFrame(rows, "id int, ordinal int, kind string, text string")
    got = {}
    for r in segments.segment(df).orderBy("id", "segment").collect():
        got.setdefault(r.id, []).append((r.heading, r.text, r.tokens))
    assert got == {i: b for i, items in files.items() if (b := brute_segments(items))}
    assert segments.segment(df.limit(0)).count() == 0
    held = {r.id: (r.characters, r.within) for r in segments.bounds(segments.segment(df)).collect()}
    assert held == {i: (sum(len("".join(t.split())) for k, t in items if k == "body"), True) for i, items in files.items() if brute_segments(items)}
