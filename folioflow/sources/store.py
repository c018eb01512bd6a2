"""Tables in one folder, replaced as a whole by writing a new version beside the old one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SCHEMAS = {
    "worksheets": "id string, name string, created_at timestamp, updated_at timestamp, pipeline_status string, pipeline_error string",
    "files": "id string, worksheet_id string, path string, name string, extension string, size long, identity_key string, created_at timestamp",
    "chunks": "id string, worksheet_id string, file_id string, position int, heading string, text string, created_at timestamp",
    "artifacts": "id string, worksheet_id string, artifact_type string, source string, content string, created_at timestamp",
}


class Store:
    """Rows are appended as files to a table's present version; a change of rows writes the next version beside it.

    A version counts once its first write has succeeded; readers take the last that counts. A version is only written where none is,
    so that of two writers that change a table at once the second fails instead of overwriting the first.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _versions(self, name: str) -> tuple[list[int], int]:
        """The versions that count, and the last number that is taken, also by a failed write."""
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return [], 0
        found = {int(s.getPath().getName().removeprefix("v")): s.getPath() for s in fs.listStatus(path)}
        return sorted(n for n, p in found.items() if fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))), max(found, default=0)

    def _names(self, name: str) -> list[str]:
        return self.spark.createDataFrame([], SCHEMAS[name]).columns

    def read(self, name: str) -> DataFrame:
        done, _ = self._versions(name)
        if not done:
            return self.spark.createDataFrame([], SCHEMAS[name])
        return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.folder}/{name}/v{done[-1]}")

    def write(self, name: str, rows: DataFrame) -> None:
        """Replace a table; ``rows`` may be made from its present version."""
        _, taken = self._versions(name)
        rows.select(*self._names(name)).write.mode("errorifexists").parquet(f"{self.folder}/{name}/v{taken + 1}")

    def append(self, name: str, rows: DataFrame) -> None:
        """Add rows; what is there is not written again. ``rows`` must not be made from the table itself."""
        done, taken = self._versions(name)
        if not done:
            return self.write(name, rows)
        rows.select(*self._names(name)).write.mode("append").parquet(f"{self.folder}/{name}/v{done[-1]}")
