import json
import math
import random

from folioflow.llm import endings, markup, truncation as tr

SCHEMA = "reply_id long, provider string, status string, finish_reason string, text string, arrived_at timestamp, length int"


def test_scanner_agrees_with_the_strict_parser_and_reads_loose_json():
    rng = random.Random(2)

    def make(d):
        r = rng.random()
        if d > 3 or r < 0.4:
            return rng.choice(["a", 'q"uo\\te', "é\n", "", 1, None, True])
        return {rng.choice("xyz"): make(d + 1) for _ in range(rng.randrange(4))} if r < 0.7 else [make(d + 1) for _ in range(rng.randrange(4))]

    for _ in range(300):
        value = {"k": make(0)}
        text = json.dumps(value, ensure_ascii=rng.random() < 0.5)
        left_open, _, end = markup.scan(text, 0)
        assert (left_open, end) == (False, len(text))
        cut = rng.randrange(1, len(text))
        assert markup.scan(text[:cut], 0)[0], text[:cut]
    assert markup.scan("{'a': 'l'été est là', b: \"x\",}", 0)[:2] == (False, [("a", "l'été est là"), ("b", "x")])


def test_carried_values():
    assert markup.carried('```json\n{"a": "b"}\n```') == (False, [("a", "b")])
    assert markup.carried('Here:\n{"a": "b"}\nMore?') == (False, [("a", "b"), ("after", "More?")])
    assert markup.carried('{"a": "b')[0] and markup.carried('```json\n{"a": ["b"\n```')[0]
    assert markup.carried("plain [sic] text") == (False, [("prose", "plain [sic] text")])
    assert markup.carried(" ") == (False, [])


def test_ending_kinds():
    for text, kind in (("The end.", "stop"), ("The end", "word"), ("because the", "hanging"), ("so that,", "open"), ("cut in the mid...", "marked"), ("cut [truncated]", "marked"), ("Done :)", "closed"), ("A, B, D", "closed"), ("Key: 1-c 2-a 3-d", "closed"), ("-", "closed"), ("“Yes”", "closed"), ("order 95…?", "stop")):
        assert endings.ending(text)[0] == kind, text


def test_censored_fit_finds_parameters_and_posterior():
    rng = random.Random(1)
    true = [math.exp(rng.gauss(6.5, 0.6)) for _ in range(20_000)]
    limit = 900
    seen = [round(min(x, limit)) for x in true]
    counts = {}
    for x in seen:
        counts[x] = counts.get(x, 0) + 1
    at = counts.pop(limit)
    mu, sigma, (p,) = tr.fit_censored(list(counts), list(counts.values()), [(limit, at)])
    assert abs(mu - 6.5) < 0.02 and abs(sigma - 0.6) < 0.02 and p > 0.99
    assert tr.fit_censored([], [], [])[:2] == (0.0, 1.0)


def test_found_on_planted_cuts(spark):
    rng = random.Random(7)
    nouns = ["river", "mountain", "village", "harvest", "reservoir", "boundary", "question", "measurement"]
    rows, planted = [], set()
    for i in range(1500):
        sentences = [f"The {rng.choice(nouns)} follows the {rng.choice(nouns)} because it is {rng.choice(['heavy', 'light', 'round'])}." for _ in range(rng.randrange(2, 12))]
        body = " ".join(sentences)
        if i % 3 == 0:
            text = json.dumps({"items": [{"question": f"What is the {rng.choice(nouns)}?", "explanation": body}]})
        else:
            text = body if i % 10 else body[:-1]
        if i % 15 == 4:
            text, _ = text[: rng.randrange(len(text) // 3, len(text) - 12)], planted.add(i)
            if text[-1] in ".}] ":
                text = text.rstrip(".}] ") + " beca"
        elif i % 15 == 9 and text[0] == "{":
            keep = body[: rng.randrange(20, len(body) - 30)].rstrip(" .")
            text, _ = json.dumps({"items": [{"explanation": keep[: keep.rfind(" ")] + " the"}]}), planted.add(i)
        rows.append((i, "p" if i % 2 else None, "ok", "stop", text, None, 1))
        if i % 50 == 0:
            rows.append(rows[-1])
    rows += [(5001, "p", "error", None, "The riv", None, 1), (5002, "p", "ok", "length", " ", None, 1), (5003, "p", "ok", "length", None, None, 1)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = [r.reply_id for r in tr.found(df).collect()]
    assert len(got) == len(set(got))
    hit, wrong = len(planted & set(got)) / len(planted), len(set(got) - planted)
    assert hit > 0.95 and wrong <= 0.02 * 1500, (hit, wrong)
    by = {r.source: r for r in tr.rates(df).collect()}
    assert sum(r["cut"] for r in by.values()) == len(got) and all(0 <= r.share <= 1 for r in by.values())


def test_limits_and_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert tr.found(df).count() == 0 and tr.rates(df).count() == 0
    assert tr.ablation(df).count() == 0 and tr.limits(df).count() == 0
    lengths = spark.createDataFrame([("s", "", 700, 700)] * 60 + [("s", "", 300 + 3 * i, 302 + 3 * i) for i in range(200)], "source string, field string, length int, octets int")
    assert {(r.unit, r.length, r.n) for r in tr.censoring(lengths).collect()} == {("chars", 700, 60), ("bytes", 700, 60)}


def _sentences(rng, n):
    nouns = ["river", "mountain", "village", "harvest", "reservoir", "boundary", "question", "measurement"]
    return " ".join(f"The {rng.choice(nouns)} {rng.choice(['follows', 'precedes', 'meets'])} the {rng.choice(nouns)} {rng.choice(['again', 'at last', 'in the north'])}." for _ in range(n))


def test_cuts_that_only_the_length_tells(spark):
    """Texts and values cut at a limit that end on a full stop or a whole word, in characters and in bytes; complete ones of the same kinds stay."""
    rng = random.Random(11)
    rows, planted = [], set()

    for i in range(1600):
        source = "abc"[i % 3]
        whole = _sentences(rng, rng.randrange(3, 30))
        if source == "a" and len(whole) > 800:  # a provider that stores 800 characters, here always up to a full stop
            text, _ = _sentences(rng, 40)[:799] + ".", planted.add(i)
        elif source == "b":  # a field of 300 bytes in a payload that is closed
            cut = len(whole) > 300
            value = whole if not cut else whole.replace("north", "nörth").encode()[:299].decode("utf-8", "ignore")
            if cut:
                value += "." * (300 - len(value.encode()))
                planted.add(i)
            text = json.dumps({"items": [{"question": "Which one?", "explanation": value, "answer": _sentences(rng, 2)}]}, ensure_ascii=False)
        else:
            text = whole
        rows.append((i, source, "ok", "stop", text, None, 1))
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = {r.reply_id for r in tr.found(df).collect()}
    assert len(planted) > 300 and len(got & planted) / len(planted) > 0.97 and len(got - planted) < 10, (len(planted), len(got & planted), len(got - planted))
    told = {r.source: r for r in tr.ablation(df).collect()}
    assert told["a"].only_by_length > 100 and told["b"].only_by_length > 100 and told["c"].only_by_length == 0
    assert {(r.source, r.field, r.unit, r.length) for r in tr.limits(df).where("posterior > 0.95").collect()} >= {("a", "", "chars", 800), ("b", "explanation", "bytes", 300)}


def test_tokens_longer_than_any_word_do_not_merge():
    a, b = "x" * 70 + "a", "x" * 70 + "b"
    assert endings.core(a) != endings.core(b) and endings.core("\ud800") == "?"


def test_payload_after_a_long_lead_in_or_a_remark_and_deep_nesting():
    lead = "These are the questions that you asked for, with their answers. " * 6
    assert markup.carried(lead + '{"a": ["b') == (True, []) and markup.carried(lead + '{"a": "b"}') == (False, [("a", "b")])
    assert markup.carried("[Note] As you wished:\n" + '{"a": "b", "c": {') == (True, [("a", "b")])
    assert markup.carried("  [Note] As you wished:\n" + '{"a": "b"}') == (False, [("a", "b")])
    for prose in (lead + "See [12], {x} and [sic].", lead + "The set {x: x > 0} is open.", "[Note] Nothing else [3, 4] here."):
        assert markup.carried(prose) == (False, [("prose", prose)])
    deep = '{"a": "b", "c": ' + "[" * 50_000
    assert markup.carried(deep) == (True, [("a", "b")]) and markup.carried(deep + "]" * 50_000 + "}") == (False, [("a", "b")])
