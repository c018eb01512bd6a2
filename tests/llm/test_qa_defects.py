import random
import time

from folioflow.llm import language, pushdown, qa_defects as qa

ITEM = "item_id long, reply_id long, question string, options array<string>, answer string, explanation string, created_at string"
REPLY = "reply_id long, refusal string, text string"


def test_refusals_in_four_languages_and_what_is_none():
    for text in ("I'm sorry, but I can't help with that.", "Unfortunately I must decline to create this.", "As an AI assistant, I am unable to write that.", "Declined for policy reasons.", "No answer will be generated for this passage.",
                 "This topic goes against the usage guidelines, so no answer is given.", "That is something I'd rather not write about; could we pick another section?", "Es tut mir leid, aber ich kann auf diese Bitte keine Antwort geben.",
                 "Als KI-Assistent kann ich zu diesem Abschnitt nichts schreiben.", "Je suis désolé, mais je ne peux pas répondre.", "Malheureusement, il m'est impossible de rédiger ce contenu.", "Lo siento, pero no puedo redactar eso.", "No estoy en condiciones de atender ese contenido."):
        assert qa.is_refusal(text), text
    for text in ("It cannot be determined from the text", "A model of this kind cannot answer the question on its own, so the ice melts.", "Consequently, the term cannot be separated from it.", "The model remains stable.", "", None, "La terre ne tourne pas vite."):
        assert not qa.is_refusal(text), text


def test_empty_answers():
    for a in (None, "", " ", "​", "\xa0\n", "-", "—", "...", "?", "[]", "____", "xxx", "n/a", "N/A", "TBD", "todo", "<answer>", "[answer]", "(no answer)", "(blank)", "keine Angabe", "sin respuesta", "pas de réponse", "null", "n.d."):
        assert qa.is_empty(a, ["a"]), a
    for a in ("No", "0", "B", "the answer", "None"):
        assert not qa.is_empty(a, ["None", a]), a
    assert qa.is_empty("None", ["a"])


def test_copies():
    q = "What does the author conclude about the marginal likelihood ratio?"
    for text in (q, q.upper(), f"**{q}**", f"({q})", f"Q: {q}", f"1. {q}", q.rstrip("?"), f"{q} {q}", "What does the author conclude about the marginal ratio?", "What  does the conclude about the marginal likelihood ratio??"):
        assert qa.is_copy(text, q), text
    for text in (f"{q} It bounds the prior weight.", f"{q} 33", "the likelihood ratio", "The author concludes that the marginal likelihood ratio rises.", ""):
        assert not qa.is_copy(text, q), text


def brute_tile(a, q):
    free_a, free_q = [1] * len(a), [1] * len(q)
    while True:
        best = None
        for i in range(len(a)):
            for j in range(len(q)):
                n = 0
                while i + n < len(a) and j + n < len(q) and free_a[i + n] and free_q[j + n] and a[i + n] == q[j + n]:
                    n += 1
                if n and (best is None or n > best[0]):
                    best = (n, i, j)
        if best is None:
            return free_a.count(0), free_q.count(0)
        for k in range(best[0]):
            free_a[best[1] + k] = free_q[best[2] + k] = 0


def test_tiling_against_brute_force():
    rng = random.Random(4)
    for _ in range(300):
        a, q = ([rng.choice("abcd") for _ in range(rng.randrange(9))] for _ in range(2))
        n_a, n_q = qa.tile(a, q)
        assert n_a == n_q == brute_tile(a, q)[0]


def test_long_and_repetitive_texts_are_tiled_quickly():
    rng = random.Random(3)
    words = [f"w{rng.randrange(900)}" for _ in range(6000)]
    shuffled = words[:]
    rng.shuffle(shuffled)
    began = time.perf_counter()
    assert qa.tile(shuffled, words) == (6000, 6000)
    assert qa.tile(["a"] * 6000, ["a"] * 6000) == (6000, 6000) and qa.tile(["a", "b"] * 3000, ["b", "a"] * 3000, 2)[0] >= 5998
    blocks = words[3000:] + words[:3000]
    assert qa.tile(blocks, words, 8)[0] > 5900 and qa.tile(shuffled, words, 8)[0] < 100
    assert time.perf_counter() - began < 5
    assert qa.tile([], words) == qa.tile(words, []) == (0, 0) and qa.tile(list("abcx"), list("xabc"), 2) == (3, 3)


def test_open_nesting():
    for text, found in (
        ("a (b [c]", ["("]), ("see (a (b) and", ["("]), ("It is (see the map.", ["("]), ("[a (b] c", []), ("```py\nprint(1)", ["```"]), ("```\n(x\n``` done", []),
        ('He said "the river', ['"']), ('"Yes", he said.', []), ('a 5" pipe and a 6" pipe', []), ("«a", ["«"]), ("„a", ["„"]), ("„a“ and “b” and »c«", []), ("the **most", ["**"]), ("the **most** and 2**3", []),
        ("<b>bold", ["<b>"]), ("<b>x</b><br> y <p>z, i < 3 and List<String>", []), ("on [0, 1) and (0, ∞]", []), ("a) first b) second", []), ("fine :) or :( then", []),
        ("`f(` is code", []), ("1. one\n2.", ["item"]), ("- one\n- two", []), ("", []),
    ):
        assert pushdown.left_open(text) == found, text


def test_structure_left_open_counts_whatever_stands_last():
    for text in ("see (a (b) and", 'He said "the river.', "```py\nprint(1)", "It is (see the map.", "First point.\n1. one\n2."):
        end = qa._end_of(text, [])
        assert end and end["base"] > 0, text
    assert qa._end_of("It is (see the map).", []) is None and qa._end_of('He said "no".', []) is None
    assert qa._end_of("f(x", ["f(x", "g(x"])["base"] < 0


def test_language_of_short_texts():
    texts = ["the map of the river is on the wall and it is not what they say"] * 30 + ["la carte de la rivière est sur le mur et elle ne dit pas ce que les autres voient"] * 30
    model = language.log_model(dict(language.count_languages(texts)))
    s = language.scores(language.words_of("la carte de la rivière"), model)
    assert max(range(len(s)), key=s.__getitem__) == language.LANGS.index("fr")
    assert language.foreign_script("Сначала да") == 1.0 and language.foreign_script("42") == 0.0


def corpus():
    rng = random.Random(11)
    nouns, rows = ["river", "mountain", "village", "harvest", "reservoir", "boundary"], []
    for i in range(400):
        a, b = rng.sample(nouns, 2)
        options = [f"It separates the {a} from the {b}", f"Only the {b} determines the {a}", f"the {a}", f"the {b}"]
        rows.append((i, i, f"What does the author say about the {a} and the {b}?", options, options[i % 4], f"This is why the {a} follows the {b} every day. We can see the {a}{'.' if i % 5 else ''}", "x"))
    return rows


def test_found_end_to_end(spark):
    rows = corpus()
    q, o = "What does the author say about the river and the village?", ["It separates the river from the village", "the river", "the village", "the harvest"]
    e = "This is why the river follows the village every day."
    bad = {
        1001: ("truncated_answer", (q, o, "It separates the river from the vill", e)), 1002: ("truncated_answer", (q, o, "the river", "This is why the river follows the")),
        1003: ("empty_answer", (q, o, "n/a", e)), 1004: ("refusal", (q, o, " ", "I cannot provide that.")), 1005: ("copied_question", (q, o, q, e)),
        1006: ("wrong_language", (q, o, "the river", "Сначала падает температура, потом давление.")), 1007: ("refusal", (q, o, None, None)), 1008: ("wrong_language", (q, o, "the river", "Das ist nicht der Fluss, und die Ernte ist auch nicht dabei.")),
    }
    good = {2001: (q, o, "B", e), 2002: (q, None, "the river", None), 2003: (q, o, "the river", ""), 2004: (f"{q}", o, f"{q} the river", e), 2005: ("Which reply turns down a request politely?", ["I cannot provide that."], "I cannot provide that.", e), 2006: ("Which Spanish word means 'river'?", ["río"], "río", e)}
    for i, (_, r) in bad.items():
        rows.append((i, i, *r, "x"))
    for i, r in good.items():
        rows += [(i, i, *r, "x")] * 2
    items = spark.createDataFrame(rows, ITEM).repartition(3)
    replies = spark.createDataFrame([(1007, "I'm sorry, I cannot help with that.", ""), (2001, "false", ""), (2002, None, ""), (2003, "none", "")], REPLY)
    got = {r.item_id: r.defect_type for r in qa.defects(items, replies).collect()}
    assert got == {i: kind for i, (kind, _) in bad.items()}


def test_empty_tables_and_long_texts(spark):
    items, replies = spark.createDataFrame([], ITEM), spark.createDataFrame([], REPLY)
    assert qa.defects(items, replies).count() == 0
    long = spark.createDataFrame([(None, None, None, None, "x " * 50_000 + "end.", None, None), (1, None, "q " * 9000, [None], "(" * 9000, "y" * 100_000, None)], ITEM)
    qa.defects(long, replies).collect()
