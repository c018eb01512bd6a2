"""Sizes of texts in tokens of a public byte-pair vocabulary."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.session import spread

#: Where the vocabulary's ranks lie on every machine; a parameter, the file is not part of this package.
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the splitting pattern that belongs to that vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
_encoders: dict[str, object] = {}


def encoder(path: str = RANKS):
    """The encoder of the vocabulary at ``path``, loaded once per Python worker."""
    if path not in _encoders:
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _encoders[path] = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


def sized(documents: DataFrame, id_col: str, text_col: str, keep: list[str] | None = None, path: str = RANKS) -> DataFrame:
    """``id_col``, the columns in ``keep``, and ``tokens`` of each text; null and empty texts have 0.

    The text is read by one narrow scan and dropped at once; only the counts go on.
    """
    keep = keep or []
    narrow = documents.select(id_col, *keep, F.col(text_col).cast("string").alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.schema.fields[:-1]) + ", tokens long"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            sizes = pa.array([len(enc.encode_ordinary(t)) if t else 0 for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], sizes], names=[*batch.schema.names[:-1], "tokens"])

    return spread(narrow).mapInArrow(count, schema)
