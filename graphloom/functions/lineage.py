"""Tables in the folder that the driver and all executors share, which end a plan's lineage.

A written table is read again with its size known and without any of its plan
or constraints, so that rounds of joins stay as cheap to plan as the first,
and a lost executor costs no more than what came after it.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Where it is unset, a local master gets a temporary folder and any other
    one a folder of the warehouse, which a cluster shares by definition.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if spark.sparkContext.master.startswith("local"):
            root = tempfile.mkdtemp(prefix="graphloom-")
        else:
            root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_staging"
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


class Staged:
    """A written table: ``df`` reads it, ``drop`` deletes its files, which else go at the session's end."""

    def __init__(self, df: DataFrame, tag: str):
        self.spark = df.sparkSession
        self.path = f"{shared_root(self.spark)}/staged-{tag}-{uuid.uuid4().hex}"
        df.write.parquet(self.path)
        self._on_fs(lambda fs, path: fs.deleteOnExit(path))
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def _on_fs(self, act) -> None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        act(path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path)

    def drop(self) -> None:
        self._on_fs(lambda fs, path: fs.delete(path, True))


def cut(df: DataFrame) -> DataFrame:
    """``df`` read from a table in the shared folder."""
    return Staged(df, "cut").df
