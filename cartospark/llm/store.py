"""Cut lineage with tables in the folder that driver and executors share.

The folder is the one the session names in ``spark.checkpoint.dir``; only where that is unset and Spark runs in
the driver's own process, a folder of the driver's is taken.  Tables are ordinary Parquet, written by Spark's commit
protocol, so a lost executor costs its running tasks and nothing that was written.
"""

from __future__ import annotations

import gc
import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if context not in _own:
        _own[context] = tempfile.mkdtemp(prefix="cartospark-")
    return _own[context]


_own: WeakKeyDictionary = WeakKeyDictionary()


def free_names(taken: list[str], *names: str) -> list[str]:
    """The names after so many underscores that none of the columns is called like one of them."""
    used, mark = {c.lower() for c in taken}, "__"
    while any(mark + n in used for n in names):
        mark += "_"
    return [mark + n for n in names]


class Scratch:
    """Tables of one operator run; drop() frees those that nothing reads any more."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def keep(self, df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
        df.write.mode("overwrite").option("compression", compression).parquet(self.path(name))
        self.sweep()
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def sweep(self) -> None:
        """Lets Spark delete the shuffle files of what has ended, which else stay until the driver happens to collect its garbage."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def drop(self, *names: str) -> None:
        jvm = self.spark.sparkContext._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.path(name))
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
