import random

from folioflow.llm import scan_noise as sn

SCHEMA = "id string, heading string, text string, position int, field string"


def trie_of(words):
    trie = {}
    for w in words:
        node = trie
        for ch in w:
            node = node.setdefault(ch, {})
        node[""] = True
    return trie


def brute(word, candidate, edits=True):
    """Least cost by dynamic programming over both words, with confusions as edits of cost 1."""
    n, m = len(word), len(candidate)
    d = [[99] * (m + 1) for _ in range(n + 1)]
    d[0][0] = 0
    for i in range(n + 1):
        for j in range(m + 1):
            if d[i][j] == 99:
                continue
            if i < n and j < m:
                d[i + 1][j + 1] = min(d[i + 1][j + 1], d[i][j] + (0 if word[i] == candidate[j] else sn.EDITED if edits else 99))
            if i < n and edits:
                d[i + 1][j] = min(d[i + 1][j], d[i][j] + sn.EDITED)
            if j < m and edits:
                d[i][j + 1] = min(d[i][j + 1], d[i][j] + sn.EDITED)
            for read, printed in sn.CONFUSIONS:
                if word.startswith(read, i) and candidate.startswith(printed, j):
                    a, b = i + len(read), j + len(printed)
                    d[a][b] = min(d[a][b], d[i][j] + sn.CONFUSED)
    return d[n][m]


def test_automaton_finds_all_candidates():
    rng = random.Random(6)
    letters = "rnmiclduhe1oe0"
    words = {"".join(rng.choice(letters) for _ in range(rng.randrange(2, 6))) for _ in range(500)}
    trie = trie_of(words)
    for _ in range(200):
        q = "".join(rng.choice(letters) for _ in range(rng.randrange(2, 6)))
        got = {w: c for w, c, _ in sn.candidates(q, trie)}
        want = {w: c for w in words if w != q and (c := brute(q, w)) <= sn.BOUND}
        assert got == want, q
    assert ("thermal", 1, True) in sn.candidates("therrnal", trie_of(["thermal"]))
    assert ("small", 2, True) in sn.candidates("srna1l", trie_of(["small", "smell"]))


def test_page_numbers_in_headings():
    for h in ("Limits ..... 75", "Notes | 133", "1.3 market\n79", "65   Lecture 7: phase", "Preface\nix"):
        assert sn.heading_page(h), h
    for h in ("1.3 market", "Exercise 12: dice", "Lecture 7: answer", "Chapter 3", "", "12"):
        assert not sn.heading_page(h), h


def kinds(text):
    return {(i, k) for i, k, _, certain in sn.furniture(text) if certain}


def test_furniture_lines():
    body = ["The river follows the village because it is heavy and", "the harvest of the year depends on what the mountain", "gives to the people who live in the valley below it."]
    def put(line, at=1):
        return "\n".join(body[:at] + [line] + body[at:])
    for line in ("— 160 —", "- 67 -", "[39]", "82/249", "p. 47", "Page 88 of 191", "Seite 169", "ix", "141"):
        assert kinds(put(line)) == {(1, "number")}, line
    assert kinds(put("COMPUTING 11    61")) == {(1, "both")} and kinds(put("132    14. Foundations of rivers")) == {(1, "both")}
    assert kinds(put("PHYSICS 10")) == {(1, "hard")} and kinds(put("Unit 15 notes · Bases : roche")) == {(1, "hard")}
    assert kinds(put("Foundations of rivers")) == {(1, "head")}
    assert kinds("\n".join(body)) == set()
    assert kinds("The total is:\n138\nThe river is long.") == set() and kinds("a\t1\t2\nb\t3\t4") == set()
    assert kinds("Key idea\nThe river is long.") == set() and kinds("one line 12") == set()


def corpus(rng, n):
    nouns = ["thermal", "reservoir", "modern", "village", "climate", "document", "harvest", "measurement", "culture", "information"]
    rows = []
    for i in range(n):
        sentences = [f"The {rng.choice(nouns)} {rng.choice(nouns)} of the {rng.choice(nouns)} is well-known and remains {rng.choice(nouns)}." for _ in range(6)]
        words, lines, line = " ".join(sentences).split(), [], ""
        for w in words:
            if len(line) + 1 + len(w) > 60:
                lines.append(line)
                line = w
            else:
                line = f"{line} {w}".strip()
        rows.append([f"c{i}", f"Part {i % 7}: {rng.choice(nouns)}", "\n".join([*lines, line]), i, "clash"])
    return rows


def test_found_and_repaired_on_planted_noise(spark):
    rng = random.Random(9)
    rows, want, clean = corpus(rng, 240), set(), {}
    for k, r in enumerate(rows):
        clean[r[0]] = " ".join(r[2].split())
        lines = r[2].split("\n")
        if k % 6 == 1:
            w = next(w for w in lines[2].split() if len(w) > 6 and w.isalpha())
            lines[2] = lines[2].replace(w, w[:3] + "-\n" + w[3:], 1)
            want.add((r[0], "text", "hyphen_break"))
        elif k % 6 == 2:
            bad = {"thermal": "therrnal", "reservoir": "rescrvoir", "modern": "rnodern", "village": "vi11age", "climate": "clirnate", "document": "docurnent", "harvest": "harvesf", "measurement": "measurernent", "culture": "cu1ture", "information": "inforrnation"}
            w = next(w for w in " ".join(lines).split() if w in bad)
            lines = "\n".join(lines).replace(w, bad[w], 1).split("\n")
            want.add((r[0], "text", "char_error"))
        elif k % 6 == 3:
            lines.insert(2, f"— {k} —")
            want.add((r[0], "text", "page_number"))
        elif k % 6 == 4:
            lines.insert(2, f"GEOGRAPHY 4    {k}")
            want |= {(r[0], "text", "page_number"), (r[0], "text", "running_head")}
        elif k % 12 == 5:
            r[1] += f" ..... {k}"
            want.add((r[0], "heading", "page_number"))
        r[2] = "\n".join(lines)
    rows = [tuple(r) for r in rows] + [tuple(rows[1]), ("none", None, None, 1, "x"), ("blank", " ", "", 1, "x")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = {tuple(r) for r in sn.found(df).collect()}
    assert got == want, (got - want, want - got)
    fixed = {r.chunk_id: (r.heading, r.text) for r in sn.repaired(df).collect()}
    assert len(fixed) == 242 and fixed["none"] == (None, None)
    wrong = [c for c in clean if " ".join(fixed[c][1].split()) != clean[c]]
    assert not wrong, [(fixed[c][1], clean[c]) for c in wrong[:2]]
    assert all("\n" not in fixed[c][1] for c in clean) and not any("....." in fixed[c][0] for c in clean)


def test_hyphens_of_the_wording_stay(spark):
    rows = corpus(random.Random(3), 60)
    for r in rows[:20]:
        r[2] = r[2].replace("well-known", "well-\nknown").replace("The ", "The pre- and post-war ", 1)
    df = spark.createDataFrame([tuple(r) for r in rows], SCHEMA)
    assert [tuple(r) for r in sn.found(df).where("noise_kind = 'hyphen_break'").collect()] == []
    assert sn.found(df.limit(0)).count() == 0 and sn.repaired(df.limit(0)).count() == 0


def test_a_long_rare_word_is_looked_up_whatever_else_its_shard_holds(spark):
    counts = [("wasserdarnm", 1, 0), ("wasserdamm", 3, 0), ("zollbeamter", 4, 0), ("zollbearnter", 1, 0), ("mauer", 3, 0), ("rnauer", 1, 0), ("kuhstall", 2, 0), ("kuhsta11", 1, 0)]
    vocab = spark.createDataFrame(counts, "word string, n long, joins long")
    pairs = {(r.wrong, r.right) for r in sn.misread(vocab).collect()}
    others = [(f"{w[0]}{'x' * (len(r) - 2)}{w[-1]}", 90, 0) for w, r in (("wasserdarnm", "wasserdamm"), ("zollbearnter", "zollbeamter"))]
    crowded = {(r.wrong, r.right) for r in sn.misread(vocab.unionByName(spark.createDataFrame(others, vocab.schema))).collect()}
    assert pairs == crowded and {("wasserdarnm", "wasserdamm"), ("zollbearnter", "zollbeamter")} <= pairs


def test_confusions_leave_the_skeleton_and_are_read_back():
    rng = random.Random(8)
    letters = "rnmiclduhewvybg"
    for read, printed in sn.CONFUSIONS:
        assert sn.skeleton(f"x{read}x") == sn.skeleton(f"x{printed}x"), (read, printed)
    for _ in range(3000):
        right = "".join(rng.choice(letters) for _ in range(rng.randrange(2, 9)))
        wrong = right
        for _ in range(rng.randrange(1, 3)):
            read, printed = rng.choice(sn.CONFUSIONS)
            at = wrong.find(printed, rng.randrange(len(wrong)))
            if at >= 0:
                wrong = wrong[:at] + read + wrong[at + len(printed):]
        least = brute(wrong, right, edits=False)
        assert sn.reads(wrong, right) == (least if least <= 2 else None), (wrong, right)
    assert sn.reads("river", "riser") is None and sn.reads("riv", "river") is None and sn.reads("x" * 3000 + "rn", "x" * 3000 + "m") == 1


def test_words_of_any_length_and_misread_at_both_ends_are_found(spark):
    rng = random.Random(4)
    stems = ["".join(rng.choice("adefgkmoprstu") for _ in range(8)) for _ in range(300)]
    long_ = "rechtsschutzversicherungsgesellschaftsangestelltenverband"
    giant = "".join(rng.choice("aeost") for _ in range(20_000))
    counts = [(f"m{s}m", 90, 0) for s in stems] + [(f"rn{s}rn", 1, 0) for s in stems]
    counts += [(long_, 12, 0), (long_.replace("m", "rn").replace("chaft", "chaff"), 1, 0), (long_.replace("verb", "vcrb"), 1, 0), (giant + "m", 9, 0), (giant + "rn", 1, 0), (giant + "x", 9, 0)]
    found = {(r.wrong, r.right) for r in sn.misread(spark.createDataFrame(counts, "word string, n long, joins long").repartition(3)).collect()}
    assert {(f"rn{s}rn", f"m{s}m") for s in stems} <= found
    assert (long_.replace("verb", "vcrb"), long_) in found and (giant + "rn", giant + "m") in found and all(a != giant + "x" and b != giant + "x" for a, b in found)
    assert sn.words_of(giant) == [giant] and sn.breaks_of(f"the {giant}-\nend")[0][2:] == (giant, "end")


def test_long_lines_and_numbers_of_many_digits_are_furniture_too():
    body = ["The river follows the village because it is heavy and", "the harvest of the year depends on what the mountain", "gives to the people who live in the valley below it."]
    head = "Foundations of the long history of rivers and of the many mountains and villages along them, with remarks on the harvest"
    assert kinds("\n".join([body[0], f"{head}    161", *body[1:]])) == {(1, "both")}
    assert kinds("\n".join([body[0], head.upper(), *body[1:]])) == {(1, "hard")}
    for line in ("— 16012 —", "Page 10234 of 20000", "12345/23456"):
        assert kinds("\n".join([body[0], line, *body[1:]])) == {(1, "number")}, line
