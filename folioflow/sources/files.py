"""Files on disk or in an object store as rows of blocks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.functions import text as tx
from folioflow.operators import blocks

#: Files that are read by their paths at most.
PATHS = 10_000
BLOCK_ROWS = "id string, ordinal int, kind string, level int, text string"
#: (bytes, extension) -> [(kind, level, text)]
Parser = Callable[[bytes, str], list[tuple[str, int | None, str]]]


def metadata(spark: SparkSession, paths: list[str]) -> DataFrame:
    """path, name, extension, size, modified_ns, identity_key, parser of files; their content is not read.

    Times are in microseconds here, so that the last three digits of modified_ns are 0.
    """
    rows = spark.read.format("binaryFile").load(paths).select("path", F.col("length").alias("size"), (F.unix_micros("modificationTime") * 1000).alias("modified_ns"))
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    named = rows.withColumn("name", name).withColumn("extension", tx.last_dot("name"))
    return named.withColumn("identity_key", blocks.identity_key("path", "size", "modified_ns")).withColumn("parser", blocks.parser_of("extension"))


def require_supported(files: DataFrame) -> DataFrame:
    """``files``; running it fails at a file whose extension no parser takes."""
    checked = F.when(F.col("parser").isNull(), F.raise_error(F.concat(F.lit("Unsupported file extension: "), F.coalesce("extension", F.lit("none"))))).otherwise(F.col("parser"))
    return files.withColumn("parser", checked.cast("string"))


class NoParser(ValueError):
    """A file needs a parser and none is given."""


def read_blocks(spark: SparkSession, files: DataFrame, parser: Parser | None = None) -> DataFrame:
    """Blocks (id, ordinal, kind, level, text) of files (id, path, extension, parser).

    Text and markdown are read whole and parsed by column expressions. Documents and office files need a
    ``parser``, which is called on the executors file by file; without one, ``NoParser`` is raised where there is such a file, so that
    none is left out unseen. Up to ``PATHS`` files are read by their paths, which then pass through the driver; of more, their folders are
    read, so that only the distinct folders do, and the files that are not asked for drop out in a join.
    """
    if parser is None:
        needs = files.where("parser in ('document', 'office')").select("extension").first()
        if needs:
            raise NoParser(f"no parser for files of extension {needs.extension}")
    place = F.col("path") if files.count() <= PATHS else F.regexp_replace("path", r"/[^/]*$", "")
    places = [r.place for r in files.select(place.alias("place")).dropDuplicates().toLocalIterator()]
    if not places:
        return spark.createDataFrame([], BLOCK_ROWS)
    content = spark.read.format("binaryFile").load(places).select("path", "content").join(files.select("id", "path", "parser", "extension"), "path")
    texts = content.select("id", "parser", F.decode("content", "UTF-8").alias("text"))
    out = blocks.markdown_blocks(texts.where("parser = 'markdown'"), "id", "text").unionByName(blocks.plain_blocks(texts.where("parser = 'text'"), "id", "text"))
    if parser is None:
        return out

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for f in frame.itertuples(index=False):
                found = parser(f.content, f.extension)
                if found:
                    kinds, levels, bodies = zip(*found)
                    yield pd.DataFrame({"id": f.id, "ordinal": range(len(found)), "kind": kinds, "level": pd.array(levels, dtype="Int32"), "text": bodies})

    other = content.where("parser in ('document', 'office')").select("id", "extension", "content")
    return out.unionByName(other.mapInPandas(parse, BLOCK_ROWS))
