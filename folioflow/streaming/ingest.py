"""Taking in tables as streams: resumable, once per key, with watermarks for late rows."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.session import checkpoint_dir


def work_folder(spark: SparkSession) -> str:
    """A new folder under the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"


def source(spark: SparkSession, folder: str, name: str, files_per_trigger: int = 64) -> DataFrame:
    """``{folder}/{name}.parquet`` as a stream: the files of that folder, or the one file."""
    path = f"{folder}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", str(files_per_trigger))
    local = path.removeprefix("file://")
    if os.path.isfile(local):
        return reader.option("pathGlobFilter", f"{name}.parquet").parquet(folder)
    return reader.parquet(path)


#: Parts of a target by hash of the key.
PARTS = 16


def ingest(stream: DataFrame, target: str, state: str, key: str) -> None:
    """Append what the stream has now to ``target`` (parquet), each key once over all runs, and stop.

    The target is kept in parts by a hash of the key, and a batch drops keys that are stored: it is compared with the keys of the parts
    that it touches only, and a batch that is run again after a failure with those of other batches, then overwrites its own folders, so
    that nothing is stored twice. ``state`` keeps the stream's offsets, from which the next run goes on.
    """
    spark = stream.sparkSession
    schema = stream.schema
    part = F.pmod(F.xxhash64(key), F.lit(PARTS)).cast("int")

    def store(batch: DataFrame, number: int) -> None:
        once = batch.dropDuplicates([key]).withColumn("part", part)
        if number:
            touched = [r.part for r in once.select("part").distinct().collect()]  # at most PARTS
            earlier = spark.read.schema(f"`{key}` {schema[key].dataType.simpleString()}, part int, batch long").parquet(target)
            earlier = earlier.where(F.col("part").isin(*touched) & (F.col("batch") < number)).select(key, "part")
            once = once.join(earlier, [key, "part"], "left_anti")
        once.withColumn("batch", F.lit(number).cast("long")).select(*schema.names, "part", "batch").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part", "batch").parquet(target)

    stream.writeStream.foreachBatch(store).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()


def ingest_available(spark: SparkSession, folder: str, name: str, key: str) -> DataFrame:
    """A table taken in as a stream into the shared folder, and read back; an empty table reads back empty."""
    where = work_folder(spark)
    stream = source(spark, folder, name)
    ingest(stream, f"{where}/data", f"{where}/state", key)
    return spark.read.schema(stream.schema).option("recursiveFileLookup", "true").parquet(f"{where}/data")


def hourly_counts(spark: SparkSession, folder: str, name: str, key: str, time: str, late: str = "400 days") -> DataFrame:
    """hour, reads: distinct keys per hour, redelivered rows dropped within the watermark.

    A key's state is kept for ``late`` after its time, and so bounded by what arrives in that span. It is wide here since the logs of a whole year
    come as one backlog in no order; where rows come within a day of their time, "1 day" holds a day's keys. Null times are left out.
    """
    where = work_folder(spark)
    stream = source(spark, folder, name).where(F.col(time).isNotNull()).select(key, F.col(time).cast("timestamp").alias("__t"))
    once = stream.withWatermark("__t", late).dropDuplicatesWithinWatermark([key, "__t"])

    def store(batch: DataFrame, number: int) -> None:
        batch.groupBy(F.date_trunc("hour", "__t").alias("hour")).agg(F.count("*").alias("reads")).write.mode("overwrite").parquet(f"{where}/data/batch={number}")

    once.writeStream.outputMode("append").foreachBatch(store).option("checkpointLocation", f"{where}/state").trigger(availableNow=True).start().awaitTermination()
    parts = spark.read.schema("hour timestamp, reads long").option("recursiveFileLookup", "true").parquet(f"{where}/data")
    return parts.groupBy("hour").agg(F.sum("reads").alias("reads")).select(F.col("hour").cast("timestamp_ntz").alias("hour"), "reads")
