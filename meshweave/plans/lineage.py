"""Cutting lineage through tables in the folder that all executors share."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only where it is unset and one machine runs all (tests)."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        return conf.rstrip("/")
    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get().rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="meshweave-shared-")
    spark.sparkContext.setCheckpointDir(made)
    return made


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/meshweave/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str = "cut") -> DataFrame:
    """Write ``df`` once and return the written table.

    A lost executor costs only the tasks that it ran: later stages read files, not its memory.
    Unlike an RDD checkpoint the table keeps column pruning and exact size statistics, so that the
    planner itself decides from the true size whether a side may be broadcast.
    """
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._meshweave_path = path
    return out


def discard(df: DataFrame | None) -> None:
    """Delete a table made by :func:`materialize` that no later plan reads."""
    path = getattr(df, "_meshweave_path", None)
    if path:
        spark = df.sparkSession
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that nothing refers to any more."""
    gc.collect()
    spark._jvm.System.gc()


def buckets(rows: int) -> int:
    """How many buckets a table of so many rows gets: up to half a million rows in each."""
    return 1 + rows // 500_000


class Bucketed:
    """A written table in buckets by a key: joins and groupings by the key shuffle the other side only. Rows can be added."""

    def __init__(self, spark: SparkSession, key: str, n: int, tag: str):
        self.spark, self.key, self.n = spark, key, n
        self.path, self.name = new_path(spark, tag), f"meshweave_{uuid.uuid4().hex}"

    def add(self, df: DataFrame, dealt: bool = False) -> Bucketed:
        """``dealt``: the rows stand by the key already, as after a join or grouping by it."""
        df = df if dealt else df.repartition(self.n, self.key)
        df.write.format("parquet").bucketBy(self.n, self.key).option("path", self.path).mode("append").saveAsTable(self.name)
        return self

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def done(self) -> DataFrame:
        """The table, without its name in the catalog."""
        out = self.read()
        out._meshweave_path = self.path
        self.spark.sql(f"DROP TABLE {self.name}")
        return out


def bucketed(df: DataFrame, key: str, n: int, tag: str, dealt: bool = False) -> DataFrame:
    """Like :func:`materialize`, in ``n`` buckets by the key."""
    return Bucketed(df.sparkSession, key, n, tag).add(df, dealt).done()
