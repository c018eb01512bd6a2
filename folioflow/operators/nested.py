"""Shredding of nested JSON records into an adjacency table, and entity tables from it.

The adjacency table has one row per JSON value: its node (a path), its parent, the nearest object
around it, its label, its ordinal and, for leaves, its scalar. Every other result here is a filter or
one grouping of that table, so that content is parsed once and only narrow rows are shuffled.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ADJACENCY = "record_id string, node string, parent string, owner string, label string, ordinal int, kind string, scalar string"
_FIELDS = ("record_id", "node", "parent", "owner", "label", "ordinal", "kind", "scalar")
_ARROW = pa.schema([(f, pa.int32() if f == "ordinal" else pa.string()) for f in _FIELDS])
_PLACED = _ARROW.append(pa.field("place", pa.int32()))
_OPEN = re.compile(r"[\[{]")
_DECODER = json.JSONDecoder(strict=False)
_FLUSH = 50_000
# The keys under which the nodes of a tree hold further nodes.
TREE = ("branches", "children", "nodes", "subtopics")


def outermost(content: str | None):
    """The outermost JSON object or array of ``content``, or None.

    Text around the value (fences, a byte order mark, a lead-in) is skipped; a value stored as a JSON
    string is opened once. A value that is not closed yields None, also when it holds closed ones.
    An opening bracket of the prose before the value ("[sic]") is passed over.
    """
    if not content:
        return None
    text = content.strip(" \t\r\n﻿\xa0")
    if text.startswith('"'):
        try:
            inner, _ = _DECODER.raw_decode(text)
        except (ValueError, RecursionError):
            return None
        return None if not isinstance(inner, str) or inner.lstrip().startswith('"') else outermost(inner)
    at = _OPEN.search(text)
    while at:
        try:
            return _DECODER.raw_decode(text, at.start())[0]
        except RecursionError:
            return None
        except json.JSONDecodeError as broken:
            if text[at.start()] == "{" or broken.pos >= len(text) or not _prose_bracket(text, at.start()):
                return None
            at = _OPEN.search(text, at.start() + 1)
    return None


def _prose_bracket(text: str, start: int) -> bool:
    """Whether the ``[`` at ``start`` opens a remark in a sentence and no JSON array."""
    after = text[start + 1 : start + 40].lstrip()
    return bool(after) and after[0] not in '"[{-]' and not re.match(r"\d+\s*[,\]]|(true|false|null)\b", after)


def _walk(record_id, value, out: dict[str, list]) -> None:
    """Append the adjacency rows of one value, without recursion.

    Where ``out`` has ``place``, objects are numbered in it (the outermost value is 0); other values have the number of the
    object around them, which tells objects apart whose keys with dots or brackets spell the same path.
    """
    stack = [("$", None, None, None, None, 0, value)]
    objects, placed = 0, out.get("place")
    while stack:
        node, parent, owner, label, ordinal, place, v = stack.pop()
        if isinstance(v, dict):
            kind, scalar = "object", None
            if parent is not None:
                objects += 1
                place = objects
            stack.extend((f"{node}.{k}", node, node, k, i, place, x) for i, (k, x) in enumerate(v.items()))
        elif isinstance(v, list):
            kind, scalar = "array", None
            around = node if parent is None else owner
            stack.extend((f"{node}[{i}]", node, around, label, i, place, x) for i, x in enumerate(v))
        elif v is None:
            kind, scalar = "null", None
        elif isinstance(v, str):
            kind, scalar = "string", v.encode("utf-8", "replace").decode()
        elif isinstance(v, bool):
            kind, scalar = "boolean", "true" if v else "false"
        else:
            kind, scalar = "number", json.dumps(v)
        for field, x in zip(_FIELDS, (record_id, node, parent, owner, label, ordinal, kind, scalar)):
            out[field].append(x)
        if placed is not None:
            placed.append(place)


def _clean(names: list) -> list:
    return [x if x is None or x.isascii() else x.encode("utf-8", "replace").decode() for x in names]


def _shred(batches: Iterator[pa.RecordBatch], schema: pa.Schema = _ARROW) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: dict[str, list] = {f: [] for f in schema.names}
        for record_id, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            value = outermost(content)
            if value is not None:
                _walk(record_id, value, out)
            if len(out["node"]) > _FLUSH:
                yield _batch(out, schema)
                out = {f: [] for f in schema.names}
        yield _batch(out, schema)


def _shred_placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _shred(batches, _PLACED)


def _batch(out: dict[str, list], schema: pa.Schema) -> pa.RecordBatch:
    for field in ("node", "parent", "owner", "label"):
        out[field] = _clean(out[field])
    return pa.RecordBatch.from_pydict(out, schema=schema)


def shred(records: DataFrame, id_col: str, content_col: str, places: bool = False) -> DataFrame:
    """The adjacency table (``ADJACENCY``) of the JSON in ``content_col``.

    Equal copies of a record count once. Null, blank, unreadable and incomplete content, a bare
    scalar, and nesting beyond the JSON parser's stack (thousands of levels) give no rows. Of a key
    that an object repeats, the last value counts. Other columns of ``records`` are not read. With ``places`` there is
    the column ``place`` too, as ``entities`` needs it.
    """
    narrow = records.select(F.col(id_col).cast("string").alias("record_id"), F.col(content_col).cast("string").alias("content"))
    return narrow.where(F.col("content").isNotNull()).dropDuplicates().mapInArrow(
        _shred_placed if places else _shred, ADJACENCY + ", place int" if places else ADJACENCY
    )


def object_links(adjacency: DataFrame) -> DataFrame:
    """One row per nested object: the record, the nearest object around it (or ``$``), its path.

    The outermost value itself is no row; an object inside arrays alone has ``$`` as parent.
    """
    nested = adjacency.where((F.col("kind") == "object") & (F.col("node") != "$"))
    return nested.select("record_id", F.col("owner").alias("parent_path"), F.col("node").alias("child_path"))


def entity_of(path) -> F.Column:
    """The entity that a path belongs to: the path without array positions, ``$.options`` for ``$.options[2]``."""
    return F.regexp_replace(path, r"\[\d+\]", "")


def entity_table(adjacency: DataFrame, entity: str, columns: list[str], recursive: bool = False) -> DataFrame:
    """The flat table of one entity: record, path, parent path, position and the named scalars.

    ``entity`` is a path without positions (``$.options``), or with ``recursive`` only its last label, so that
    all levels of a tree come out as one table with parent links. Object nodes and their scalar
    children meet on (record, object) in one grouping, which pivots the scalars into ``columns``; a
    field that is absent or null is null. Objects without any of the columns stay. Empty in, empty out.
    """
    kind, node = F.col("kind"), F.col("node")
    is_object = (kind == "object") & (node != "$")
    mine = F.col("label") == entity if recursive else entity_of(node) == entity
    own = is_object & mine
    leaf = ~kind.isin("object", "array") & F.col("label").isin(columns) & (F.col("parent") == F.col("owner"))
    around = F.regexp_extract(entity_of(F.col("owner")), r"([^.]*)$", 1) == entity if recursive else entity_of(F.col("owner")) == entity
    rows = adjacency.where(own | (leaf & around)).select(
        "record_id",
        F.when(own, node).otherwise(F.col("owner")).alias("path"),
        F.when(own, F.col("owner")).alias("parent_path"),
        F.when(own, F.col("ordinal")).alias("position"),
        F.when(~own, F.col("label")).alias("field"),
        "scalar",
        own.alias("is_node"),
    )
    grouped = rows.groupBy("record_id", "path").agg(
        F.max("parent_path").alias("parent_path"),
        F.max("position").alias("position"),
        *[F.max(F.when(F.col("field") == c, F.col("scalar"))).alias(f"field_{c}") for c in columns],
        F.max("is_node").alias("is_node"),
    )
    return grouped.where("is_node").drop("is_node")


def tree_entity_of(path) -> F.Column:
    """``entity_of``, but with each run of ``TREE`` keys as one ``.tree``, so that all levels of a tree are one entity."""
    return F.regexp_replace(entity_of(path), rf"(?:\.(?:{'|'.join(TREE)})(?=\.|$))+", ".tree")


def entities(adjacency: DataFrame) -> DataFrame:
    """The flat tables of all entities in one: a row per object, with all its scalars in the map ``fields``.

    ``adjacency`` has ``place``. Object nodes and their scalar children meet on (record, object) in one grouping. A field's
    key is its path from the object (``label``, ``tags[0]`` for a scalar in an array); null is a null value, an absent
    field no key. Two scalars whose keys spell the same path share a field, as a JSON array of both. The
    outermost value is a row too (entity ``$``, no parent), so that each parent_path has its row.
    """
    is_own = (F.col("kind") == "object") | F.col("parent").isNull()
    leaf = ~F.col("kind").isin("object", "array") & F.col("parent").isNotNull()
    name = F.regexp_replace(F.expr("substring(node, length(owner) + 1)"), r"^\.", "")
    rows = adjacency.where(is_own | leaf).select(
        "record_id",
        F.when(is_own, F.col("node")).otherwise(F.col("owner")).alias("path"),
        "place",
        F.when(is_own, F.length("owner")).alias("parent_size"),
        F.when(is_own, F.col("ordinal")).alias("position"),
        F.when(leaf, F.struct(name.alias("field"), "scalar")).alias("entry"),
    )
    grouped = rows.groupBy("record_id", "path", "place").agg(
        F.max("parent_size").alias("parent_size"), F.max("position").alias("position"), F.collect_list("entry").alias("entries")
    )
    parent = F.expr("substring(path, 1, parent_size)")  # a path begins with its parent's: only the length is shuffled
    names, once = F.col("entries.field"), F.array_distinct("entries.field")

    def value(field: F.Column) -> F.Column:
        same = F.transform(F.filter("entries", lambda e: e["field"] == field), lambda e: e["scalar"])
        return F.when(F.size(same) == 1, same[0]).otherwise(F.to_json(F.array_sort(same)))

    fields = F.when(F.size(names) == F.size(once), F.map_from_entries("entries")).otherwise(F.map_from_arrays(once, F.transform(once, value)))
    return grouped.select("record_id", tree_entity_of(F.col("path")).alias("entity"), "path", parent.alias("parent_path"), "position", fields.alias("fields"))


def tree_table(adjacency: DataFrame) -> DataFrame:
    """The nodes of trees under all ``TREE`` keys: path, parent path, position, label, weight, and all fields."""
    nodes = entities(adjacency).where(F.col("entity").endswith(".tree"))
    return nodes.select("record_id", "path", "parent_path", "position", F.col("fields")["label"].alias("field_label"), F.col("fields")["weight"].alias("field_weight"), "fields")


def entity_catalog(adjacency: DataFrame) -> DataFrame:
    """How many objects each entity has, and in how many records; one row per entity path."""
    objects = adjacency.where(F.col("kind") == "object")
    per_record = objects.groupBy(entity_of(F.col("node")).alias("entity"), "record_id").agg(F.count("*").alias("n"))
    return per_record.groupBy("entity").agg(F.sum("n").alias("objects"), F.count("*").alias("records"))
