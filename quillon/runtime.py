"""Session and scratch-space helpers shared by all operators."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def build_session(app: str = "quillon", cpus: int | str = "*", **conf: str) -> SparkSession:
    """A local session with the settings the engine is tested with."""
    base = {
        "spark.master": f"local[{cpus}]",
        "spark.app.name": app,
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.driver.memory": "8g",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    session = SparkSession.builder.config(map=base | conf).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


def scratch_root(spark: SparkSession) -> str:
    """The shared folder the cluster names in spark.checkpoint.dir.

    Where that is unset and the master is local (tests, a laptop) a folder below the temp folder is chosen, recorded in the
    session, and deleted when the process ends. A cluster without it is an error: its executors share no local folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors reach")
        folder = os.path.join(tempfile.gettempdir(), f"quillon-scratch-{uuid.uuid4().hex[:12]}")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        root = f"file://{folder}"
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


class Scratch:
    """Written tables that cut lineage: each is Parquet in the shared scratch folder, so lost executors lose nothing."""

    made: list[str] = []  # roots of this process

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.root = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self.made.append(self.root)
        self._n = 0

    @classmethod
    def sweep(cls, spark: SparkSession) -> None:
        """Delete every scratch table of this process. Results that were returned and not yet written read them: call last."""
        while cls.made:
            delete(spark, cls.made.pop())

    def path(self, label: str) -> str:
        """A new path below this scratch folder."""
        self._n += 1
        return f"{self.root}/{self._n:03d}-{label}"

    def table(self, df: DataFrame, label: str) -> DataFrame:
        """Write df once and return a DataFrame that reads it back."""
        path = self.path(label)
        schema = df.schema
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(schema).parquet(path)
        out.scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that no later step reads."""
        for table in tables:
            if table is not None and getattr(table, "scratch_path", None):
                delete(self.spark, table.scratch_path)


def _file_system(spark: SparkSession, path: str) -> tuple:
    """The file system that a path names, and the path on it."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder."""
    fs, target = _file_system(spark, path)
    fs.delete(target, True)


def exists(spark: SparkSession, path: str) -> bool:
    fs, target = _file_system(spark, path)
    return fs.exists(target)


def rename(spark: SparkSession, path: str, to: str) -> None:
    """Move a file or folder within one file system; folders above the new place are made."""
    fs, target = _file_system(spark, path)
    place = _file_system(spark, to)[1]
    fs.mkdirs(place.getParent())
    if not fs.rename(target, place):
        raise OSError(f"cannot rename {path} to {to}")


def small_batches(spark: SparkSession, most: int = 2000, size: int = 2 << 20, read: int = 512) -> None:
    """Lower the session's batches, for operators on whole texts, as an executor holds some batches for each task.

    Arrow batches get `most` rows and about `size` bytes at most (a row may be larger), in Spark's memory and in a worker's;
    what is read of Parquet at once gets `read` rows. Lower settings stay.
    """
    for key, usual, bound in (
        ("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", most),
        ("spark.sql.execution.arrow.maxBytesPerBatch", "64m", size),
        ("spark.sql.parquet.columnarReaderBatchSize", "4096", read),
    ):
        held = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key, usual))
        if not 0 < held <= bound:
            spark.conf.set(key, str(bound))


def running_sum(rows: DataFrame, keys: list, value, name: str) -> DataFrame:
    """rows with the sum of `value` over all rows that sort before theirs by `keys`, as column `name` (long).

    Rows are range-partitioned and written once; each range sums its own rows on top of what the ranges before it hold, so
    no task orders everything and only a number per range is ordered in one place.
    """
    n = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = rows.withColumn("_value", value).repartitionByRange(n, *keys).withColumn("_part", F.spark_partition_id())
    ranged = Scratch(rows.sparkSession, "running").table(ranged, "ranged")
    sums = ranged.groupBy("_part").agg(F.sum("_value").alias("_sum"))
    above = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("_part", F.coalesce(F.sum("_sum").over(above), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_part").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.withColumn("_inside", F.coalesce(F.sum("_value").over(inside), F.lit(0)))
    total = (F.col("_inside") + F.col("_before")).cast("long").alias(name)
    return placed.join(F.broadcast(offsets), "_part").select(*rows.columns, total)


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One of the Parquet tables below sf_dir."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
