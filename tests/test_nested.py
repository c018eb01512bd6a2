import json
import random

from folioflow.operators import nested

SCHEMA = "id string, content string, node string, kind string"


def links(spark, rows):
    df = spark.createDataFrame([(i, c, "clash", "clash") for i, c in rows], SCHEMA)
    return sorted(tuple(r) for r in nested.object_links(nested.shred(df, "id", "content")).collect())


def brute(record, value):
    out = []

    def go(v, path, around):
        if isinstance(v, dict):
            if path != "$":
                out.append((record, around, path))
            for k, x in v.items():
                go(x, f"{path}.{k}", path)
        elif isinstance(v, list):
            for i, x in enumerate(v):
                go(x, f"{path}[{i}]", around)

    go(value, "$", "$")
    return out


def test_surroundings_strings_and_incomplete_values(spark):
    inner = {"a": [{"b": 1}, {"b": None}], "c": {"d": {}}}
    want = [("$", "$.a[0]"), ("$", "$.a[1]"), ("$", "$.c"), ("$.c", "$.c.d")]
    text = json.dumps(inner)
    good = {"plain": text, "fence": f"```json\n{text}\n```", "bom": "﻿" + text, "lead": f"Here [sic] it is:\n{text}\nMore?", "twice": json.dumps(text)}
    bad = {"cut": text[:-1], "cut2": json.dumps(text)[:-9], "blank": " ", "none": None, "scalar": "3", "null": "null"}
    rows = list((good | bad).items()) + [("plain", text)]
    assert links(spark, rows) == sorted((k, p, c) for k in good for p, c in want)


def test_arrays_of_arrays_and_strings_stay_closed(spark):
    text = json.dumps([[{"x": "{\"no\": {}}"}], {"y": [[{"z": {}}]]}])
    assert links(spark, [("1", text)]) == [("1", "$", "$[0][0]"), ("1", "$", "$[1]"), ("1", "$[1]", "$[1].y[0][0]"), ("1", "$[1].y[0][0]", "$[1].y[0][0].z")]


def test_random_values_against_brute_force(spark):
    rng = random.Random(5)

    def make(depth):
        r = rng.random()
        if depth > 4 or r < 0.3:
            return rng.choice([None, 1, 2.5, True, "é\ud800", "", "x"])
        if r < 0.65:
            return {rng.choice("abcdef"): make(depth + 1) for _ in range(rng.randrange(4))}
        return [make(depth + 1) for _ in range(rng.randrange(4))]

    values = {str(i): {"root": make(0)} for i in range(200)}
    want = sorted(x for k, v in values.items() for x in brute(k, v))
    assert links(spark, [(k, json.dumps(v)) for k, v in values.items()]) == want


def test_entity_tables(spark):
    tree = {"topic": "t", "branches": [], "children": [{"label": "a", "children": [{"label": "b", "weight": 2}, {"children": None}]}]}
    df = spark.createDataFrame([("m", json.dumps(tree))], "id string, content string")
    adjacency = nested.shred(df, "id", "content")
    rows = {r.path: (r.parent_path, r.position, r.field_label, r.field_weight) for r in nested.entity_table(adjacency, "children", ["label", "weight"], recursive=True).collect()}
    assert rows == {
        "$.children[0]": ("$", 0, "a", None),
        "$.children[0].children[0]": ("$.children[0]", 0, "b", "2"),
        "$.children[0].children[1]": ("$.children[0]", 1, None, None),
    }
    top = nested.entity_table(adjacency, "$.children", ["label"]).collect()
    assert [(r.path, r.field_label) for r in top] == [("$.children[0]", "a")]


def test_empty_and_long(spark):
    assert links(spark, []) == []
    deep = "[" * 100_000 + "]" * 100_000
    wide = json.dumps({"a": [{"b": "x" * 1000}] * 3000})
    assert len(links(spark, [("deep", deep), ("wide", wide)])) == 3000


def test_all_objects_have_a_row_with_their_fields(spark):
    tree = {"topic": "t", "branches": [{"label": "a", "nodes": [{"label": "b", "weight": 2, "subtopics": ["s", {"label": "c"}]}]}], "meta": {"usage": {"n": 1, "m": None}, "tags": [["x"], {}]}}
    odd = [{"a.b": {"x": 1}, "a": {"b": {"x": 2}}, "t": ["p"], "t[0]": "q"}, 7]
    df = spark.createDataFrame([("m", json.dumps(tree)), ("m", json.dumps(tree)), ("o", json.dumps(odd)), ("cut", "{")], "id string, content string")
    adjacency = nested.shred(df, "id", "content", places=True)
    rows = sorted(((r.record_id, r.entity, r.path, r.parent_path, r.position, r.fields) for r in nested.entities(adjacency).collect()), key=str)
    assert rows == sorted([
        ("m", "$", "$", None, None, {"topic": "t"}),
        ("m", "$.tree", "$.branches[0]", "$", 0, {"label": "a"}),
        ("m", "$.tree", "$.branches[0].nodes[0]", "$.branches[0]", 0, {"label": "b", "weight": "2", "subtopics[0]": "s"}),
        ("m", "$.tree", "$.branches[0].nodes[0].subtopics[1]", "$.branches[0].nodes[0]", 1, {"label": "c"}),
        ("m", "$.meta", "$.meta", "$", 2, {"tags[0][0]": "x"}),
        ("m", "$.meta.usage", "$.meta.usage", "$.meta", 0, {"n": "1", "m": None}),
        ("m", "$.meta.tags", "$.meta.tags[1]", "$.meta", 1, {}),
        ("o", "$", "$", None, None, {"[1]": "7"}),
        ("o", "$", "$[0]", "$", 0, {"t[0]": '["p","q"]'}),
        ("o", "$.a.b", "$[0].a.b", "$[0]", 0, {"x": "1"}),
        ("o", "$.a", "$[0].a", "$[0]", 1, {}),
        ("o", "$.a.b", "$[0].a.b", "$[0].a", 0, {"x": "2"}),
    ], key=str)
    nodes = {r.path: (r.parent_path, r.field_label, r.field_weight) for r in nested.tree_table(adjacency).collect()}
    assert nodes == {"$.branches[0]": ("$", "a", None), "$.branches[0].nodes[0]": ("$.branches[0]", "b", "2"), "$.branches[0].nodes[0].subtopics[1]": ("$.branches[0].nodes[0]", "c", None)}
