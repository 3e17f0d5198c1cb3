"""A dense index over a global order without a single-task sort."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from graphloom.functions.lineage import cut


def with_index(df: DataFrame, by: list[str], name: str) -> DataFrame:
    """``df`` with ``name``: 0, 1, ... in the order of ``by``. Ranges are sorted apart and shifted by what stands before."""
    ranged = cut(df.repartitionByRange(*by).withColumn("_range", F.spark_partition_id()))
    # one row for each range
    sizes = ranged.groupBy("_range").count()
    before = sizes.select("_range", (F.sum("count").over(Window.orderBy("_range")) - F.col("count")).alias("_before"))
    nth = F.row_number().over(Window.partitionBy("_range").orderBy(*by))
    return ranged.withColumn("_nth", nth).join(F.broadcast(before), "_range").withColumn(name, F.col("_before") + F.col("_nth") - 1).drop("_range", "_before", "_nth")
