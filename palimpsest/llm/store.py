"""Where the operators keep what they write: one fresh folder under the cluster's shared checkpoint folder."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import DataFrame, SparkSession

LOCAL_DEFAULT = "/tmp/checkpoints"


def shared_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; only where it is unset (tests on one machine) a local default."""
    set_to = spark.conf.get("spark.checkpoint.dir", None)
    if set_to:
        return set_to.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return LOCAL_DEFAULT


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores in front as it takes to differ from df's columns (in any case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def refuse(df: DataFrame, *names: str) -> None:
    """ValueError if df has a column of one of the names that a result is about to take."""
    taken = {c.lower() for c in df.columns}
    for name in names:
        if name.lower() in taken:
            raise ValueError(f"the input already has a column {name!r}")


class Store:
    """Tables and files of one run of one operator.

    ``write`` cuts the lineage: the table is computed once, and a lost executor costs a re-read, not a
    recomputation. ``drop`` frees a table that no later plan reads.
    """

    def __init__(self, spark: SparkSession, name: str, frugal: bool = False):
        """frugal: free the shuffle files of each table's plan as soon as it is written."""
        self.spark, self.frugal = spark, frugal
        self.names: list[str] = []
        self.root = f"{shared_root(spark)}/palimpsest/{name}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        self.names.append(name)
        df.write.mode("error").option("compression", "zstd").parquet(path)
        if self.frugal:
            self.reclaim()
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        self.names = [n for n in self.names if n != name]
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path(name))
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def close(self, *but: str) -> None:
        """Delete all tables of this run, except those named (which a result still reads)."""
        for name in [n for n in self.names if n not in but]:
            self.drop(name)

    def reclaim(self) -> None:
        """Let Spark's cleaner remove the shuffle files of plans that are no longer referenced."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()
