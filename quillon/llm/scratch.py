"""Tables written in the shared folder that the cluster names.

A long job is cut by writing a narrow table as Parquet and reading it back:
the plan behind it ends there, and an executor that is lost later costs one
partition of a scan and no recomputation. ``spark.checkpoint.dir`` names the
folder. Where it is unset (tests, a laptop) a temporary folder is set, and only
for a local master.
"""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Bytes of wide rows that Python gets at once, about.
BATCH_BYTES = 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as a URI without a slash at its end."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="quillon-"))
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


class Scratch:
    """The tables of one run of one operator, each in a folder of its own."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self._n = 0
        path = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        self._fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.deleteOnExit(path)

    def path(self, name: str) -> str:
        self._n += 1
        return f"{self.root}/{self._n:02d}-{name}"

    def save(self, df: DataFrame, name: str, batch_rows: int | None = None) -> DataFrame:
        """``df`` written and read again, with its own schema. ``batch_rows``: rows that Python gets at once here, where rows are wide; then a batch ends at BATCH_BYTES too."""
        path, keys = self.path(name), ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch")
        before = [self.spark.conf.get(key) for key in keys]
        if batch_rows:
            self.spark.conf.set(keys[0], min(batch_rows, int(before[0])) if int(before[0]) > 0 else batch_rows)
            self.spark.conf.set(keys[1], BATCH_BYTES)
        try:
            df.write.parquet(path)
        finally:
            for key, value in zip(keys, before, strict=True):
                self.spark.conf.set(key, value)
        return self.spark.read.schema(df.schema).parquet(path)

    def release(self) -> None:
        """Lets go of the shuffle files behind saved tables, which Spark removes once the driver's garbage is collected."""
        gc.collect()
        self.spark._jvm.System.gc()

    def drop(self, *tables: DataFrame) -> None:
        """Deletes tables that no later plan reads."""
        for df in tables:
            for file in df.inputFiles()[:1]:
                folder = file.rsplit("/", 1)[0]
                self._fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(folder), True)
