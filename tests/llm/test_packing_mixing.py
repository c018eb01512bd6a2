import math
import random
from collections import Counter, defaultdict

import pytest

from folioflow.llm import mixing, packing, tokens

DOCS = "doc_id long, text string, source string, tokens string"


def test_plan_is_complete_and_tight():
    rng = random.Random(5)
    for _ in range(60):
        capacity = rng.randrange(5, 200)
        histogram = Counter(rng.randrange(1, capacity + 1) for _ in range(rng.randrange(1, 400)))
        slots, made = packing.plan(histogram.items(), capacity)
        space, seen = defaultdict(int), Counter()
        for length, lo, hi, first, each in slots:
            for r in range(lo, hi):
                space[first + (r - lo) // each] += length
                seen[(length, r)] += 1
        assert max(space.values()) <= capacity and set(space) == set(range(made))
        assert set(seen.values()) == {1} and Counter(k for k, _ in seen) == histogram
        # best-fit decreasing one by one
        bins = []
        for length in sorted(histogram.elements(), reverse=True):
            fits = [b for b in range(len(bins)) if bins[b] >= length]
            if fits:
                bins[min(fits, key=lambda b: bins[b])] -= length
            else:
                bins.append(capacity - length)
        assert made <= math.ceil(1.03 * len(bins)) + 1
        assert len(slots) <= len(histogram) * (1 + 3 * math.log2(capacity))
    assert packing.plan([], 10) == ([], 0)


def documents(spark, n=300, hot=0.4):
    rng = random.Random(3)
    words = "river mountain village harvest reservoir boundary measurement of the and".split()
    rows = []
    for i in range(n):
        k = 40 if rng.random() < hot else rng.randrange(1, 900)
        rows.append((i, " ".join(rng.choices(words, k=k)) if k != 40 else "river " * 40, f"s{i % 4}", "clash"))
    return rows + [(n, "", "s0", "x"), (n + 1, None, None, "x"), (n + 2, " ", "s9", "x")]


def test_containers(spark):
    rows = documents(spark)
    docs = spark.createDataFrame(rows, DOCS).repartition(4)
    limits = spark.createDataFrame([("a", 128), ("b", 700), ("bad", None), ("zero", 0), ("a", 128)], "limit_name string, capacity_tokens int")
    got = packing.containers(docs, limits).collect()
    enc = tokens.encoder()
    sizes = {i: len(enc.encode_ordinary(t or "")) for i, t, *_ in rows}
    for name, capacity in (("a", 128), ("b", 700)):
        mine = [r for r in got if r.limit_name == name]
        fill, pieces = Counter(), defaultdict(list)
        for r in mine:
            fill[r.container_id] += r.tokens
            pieces[r.doc_id].append((r.piece, r.token_from, r.tokens))
        assert max(fill.values()) <= capacity and set(pieces) == set(sizes)
        for doc, parts in pieces.items():
            parts.sort()
            assert sum(p[2] for p in parts) == sizes[doc] and [p[0] for p in parts] == list(range(len(parts)))
            assert len(parts) == 1 or sizes[doc] > capacity
            assert [p[1] for p in parts] == [p[0] * capacity for p in parts]
        assert sum(fill.values()) / (len(fill) * capacity) > 0.95
    report = {r.limit_name: r for r in packing.fill(packing.containers(docs, limits), limits).collect()}
    assert set(report) == {"a", "b"} and report["b"].fullest <= 700
    held = packing.bounds(packing.containers(docs, limits), limits).collect()
    assert {tuple(r) for r in held} == {("a", len(rows), 0, 0, 0), ("b", len(rows), 0, 0, 0)}
    assert packing.containers(docs.limit(0), limits).count() == 0 and packing.containers(docs, limits.where("false")).count() == 0


def test_exponents():
    p = [0.5, 0.3, 0.2]
    assert mixing.tempered(p, 1.0) == pytest.approx(p) and mixing.tempered(p, 0.0) == pytest.approx([1 / 3] * 3)
    for wanted in (0.4, 0.8, mixing.entropy(p), 1.05):
        assert mixing.entropy(mixing.tempered(p, mixing.exponent_for_entropy(p, wanted))) == pytest.approx(wanted, abs=1e-6)
    sources = [("a", 0.5, 1, 1000), ("b", 0.5, 3, 100), ("none", 0.2, 2, 0), ("off", 0.0, 2, 50)]
    exponent, plan = mixing.plan(sources)
    assert exponent == 1.0 and plan == {"a": (0.5, 300.0), "b": (0.5, 300.0)}
    exponent, plan = mixing.plan(sources, 1200)
    assert 0 < exponent < 1 and sum(b for _, b in plan.values()) == pytest.approx(1200, rel=1e-6) and plan["b"][1] <= 300.0001 and plan["a"][1] <= 1000
    assert mixing.plan([]) == (1.0, {})
    # own shares tempered to the entropy of the targets, and as far as the repeats allow
    flat = [("a", 0.5, 9, 1000), ("b", 0.3, 9, 100), ("c", 0.2, 9, 300)]
    exponent, plan = mixing.plan(flat, 500, "entropy")
    got = [w for w, _ in plan.values()]
    assert 0 < exponent < 1 and mixing.entropy(got) == pytest.approx(mixing.entropy([0.5, 0.3, 0.2]), abs=1e-6) and got[0] > got[2] > got[1]
    tight, plan = mixing.plan([(s, t, 2, n) for s, t, _, n in flat], 2000, "entropy")
    assert exponent < tight < 1 and plan["b"][1] == pytest.approx(200, rel=1e-6) and sum(b for _, b in plan.values()) == pytest.approx(2000, rel=1e-6)
    assert mixing.plan([(s, t, 1, n) for s, t, _, n in flat], 10**6, "entropy")[0] == pytest.approx(1.0)


def test_mixture(spark):
    docs = spark.createDataFrame(documents(spark, 1200), DOCS).repartition(4)
    targets = spark.createDataFrame([("s0", 0.1, 2), ("s1", 0.6, 3), ("s2", 0.2, 2), ("s3", None, 1), ("absent", 0.1, 5), (None, 0.5, 1)], "source string, target_share double, max_repeats int")
    uses = mixing.mixture(docs, targets).collect()
    repeats = Counter((r.source, r.doc_id) for r in uses)
    most = {"s0": 2, "s1": 3, "s2": 2}
    assert all(n <= most[s] for (s, _), n in repeats.items()) and {s for s, _ in repeats} == set(most)
    assert all(0 <= r.position < 1 for r in uses) and len({(r.doc_id, r.use) for r in uses}) == len(uses)
    total = sum(r.tokens for r in uses)
    for s, share in (("s0", 1 / 9), ("s1", 6 / 9), ("s2", 2 / 9)):
        assert sum(r.tokens for r in uses if r.source == s) / total == pytest.approx(share, abs=0.01)
    report = {r.source: r for r in mixing.shares(docs, targets).collect()}
    assert set(report) == {"s0", "s1", "s2", "s3", "absent"} and report["absent"].tokens_used == 0 and report["s1"].most_uses == 3 and report["s1"].actual_share == pytest.approx(6 / 9, abs=0.01)
    more = {r.source: r for r in mixing.shares(docs, targets, size=10**9).collect()}
    assert all(more[s].most_uses == most[s] for s in most) and more["s1"].exponent < 1
    assert mixing.mixture(docs.limit(0), targets).count() == 0 and mixing.shares(docs.limit(0), targets).count() == 5
    assert mixing.temperature(docs, targets).count() == 5
    for report in (mixing.shares(docs, targets), mixing.shares(docs, targets, by="entropy"), mixing.shares(docs, targets, "supply", by="entropy"), mixing.shares(docs.limit(0), targets)):
        assert all(r.within_repeats and r.targets_met for r in mixing.bounds(report).collect())
    flat = {r.source: r for r in mixing.shares(docs, targets, by="entropy").collect()}
    assert all(r.actual_share == pytest.approx(r.tempered_share, abs=0.01) for r in flat.values()) and flat["s1"].exponent != 1
    assert mixing.mixture(docs, targets, by="entropy").agg({"tokens": "sum"}).first()[0] == sum(r.tokens_used for r in flat.values())


def test_mixture_of_the_size_of_the_supply(spark):
    docs = spark.createDataFrame(documents(spark, 1200), DOCS).repartition(4)
    targets = spark.createDataFrame([("s0", 0.1, 2), ("s1", 0.6, 3), ("s2", 0.3, 2)], "source string, target_share double, max_repeats int")
    whole = {r.source: r for r in mixing.shares(docs, targets, size="supply").collect()}
    exact = {r.source: r for r in mixing.shares(docs, targets).collect()}
    there = sum(r.tokens_there for r in whole.values())
    assert sum(r.tokens_used for r in whole.values()) == pytest.approx(there, rel=0.02)
    assert all(whole[s].most_uses <= n for s, n in (("s0", 2), ("s1", 3), ("s2", 2))) and 0 < whole["s0"].exponent <= 1 == exact["s0"].exponent
    assert sum(r.tokens for r in mixing.mixture(docs, targets, size="supply").collect()) == sum(r.tokens_used for r in whole.values())
