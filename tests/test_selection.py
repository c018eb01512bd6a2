import math
import random

import pytest

from folioflow.operators import selection as se

SCHEMA = "worksheet_id string, id string, position int, heading string, text string"


def make(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_filters(spark):
    prose = "one two three four five six seven eight nine ten"
    rows = [("w", "ok", 0, "Indeed", prose), ("w", "short", 1, None, "1 2 3 4 5 6 7 8 9 10 11"), ("w", "blank", 2, "x", " "), ("w", "null", 3, None, None),
            ("w", "index", 4, "Indexing", prose), ("w", "isbn", 5, None, "ISBN 1 " + prose), ("w", "late", 6, None, prose + " " + "z" * 800 + " isbn")]
    assert sorted(r.id for r in se.usable(make(spark, rows)).collect()) == ["late", "ok"]


def test_stride(spark):
    for n in (1, 47, 48, 49, 95, 96, 97, 1000):
        rows = [("w", f"{i:05}", i // 2, None, "t") for i in range(n)]
        got = sorted(r["index"] for r in se.stride_sample(make(spark, rows)).select("index").collect())
        assert got == (list(range(n)) if n <= 48 else [int(i * (n / 48.0)) for i in range(48)]), n


def test_topics(spark):
    rows = [("w", "a", 0, None, "alpha beta beta"), ("w", "b", 1, " ", "beta"), ("w", "c", 2, "H", "gamma"), ("w", "d", 3, None, "x"), ("w", "e", 4, "H", "x"), ("v", "f", 0, "V", ""), ("v", "g", 1, None, None)]
    got = {r.id: (r.topic, r.label) for r in se.topics(make(spark, rows)).collect()}
    assert got == {"a": (0, "beta"), "b": (0, "beta"), "c": (1, "H"), "d": (1, "H"), "e": (2, "H"), "f": (0, "V"), "g": (0, "V")}


def brute_cover(rows, scores, budget):
    topics, spent, picked = [], 0, []
    for r in sorted(rows, key=lambda r: (r[2], r[1])):
        if r[3] and r[3].strip() or not topics:
            topics.append([])
        topics[-1].append(r)
    queues = [sorted(t, key=lambda r: (-round(scores[r[1]], 9), r[2], r[1])) for t in topics]
    while True:
        moved = False
        for q in queues:
            if q:
                cost = max(len(q[0][4].encode()) // 4, 1)
                if spent + cost > budget and picked:
                    continue
                spent += cost
                picked.append(q.pop(0)[1])
                moved = True
        if not moved:
            return sorted(picked)


def test_covering_against_brute_force(spark):
    rng = random.Random(8)
    rows, want, words = [], {}, ["alpha", "beta", "gamma", "delta", "epsilon", "zeta"]
    for w in range(40):
        n = rng.randrange(1, 25)
        rows += [(f"w{w}", f"{w}-{i:02}", i, rng.choice([None, None, "H", ""]), " ".join(rng.choices(words, k=rng.randrange(1, 40)))) for i in range(n)]
    df = make(spark, rows)
    scores = {r.id: r.score for r in se.member_scores(df).collect()}
    for w in range(40):
        own = [r for r in rows if r[0] == f"w{w}"]
        want[f"w{w}"] = brute_cover(own, scores, 120)
    got = {}
    for r in se.covering(df, 120).collect():
        got.setdefault(r.worksheet_id, []).append(r.id)
    assert {k: sorted(v) for k, v in got.items()} == want


def test_scores_by_hand(spark):
    df = make(spark, [("w", "a", 0, "beta", "alpha alpha"), ("w", "b", 1, None, "alpha beta")])
    assert {r.term: round(r.score, 9) for r in se.term_scores(df).collect()} == {"alpha": 0.0, "beta": 0.0}
    df = make(spark, [("w", "a", 0, None, "alpha alpha"), ("w", "b", 1, None, "beta")])
    assert {r.id: round(r.score, 9) for r in se.member_scores(df).collect()} == {"a": round(2 * math.log(2), 9), "b": round(math.log(2), 9)}
    assert se.merged_units(df.limit(0), spark.createDataFrame([], "worksheet_id string, artifact_type string, source string")).count() == 0


def test_emptiness_is_told_apart(spark):
    none, poor = make(spark, []), make(spark, [("w", "short", 1, None, "1 2 3")])
    with pytest.raises(se.NoSegments):
        se.require_usable(none)
    with pytest.raises(se.NoUsableSegments):
        se.require_usable(poor)
