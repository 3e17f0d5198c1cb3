"""Intermediate tables in the folder that the driver and all executors share.

Every job that reads a value twice (counts, then rows that depend on them)
first writes it here: the two readings then agree even if executors are lost
between them, and lineage ends at a file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from graphloom.functions.lineage import Staged, shared_root  # noqa: F401


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def packed(docs: DataFrame, names: list[str] | None = None) -> Column:
    """Columns (all by default) as one struct, so that no name of theirs meets one of an operator's."""
    names = docs.columns if names is None else names
    return (F.struct(*[F.col(quoted(c)) for c in names]) if names else F.struct(F.lit(0).alias("_none"))).alias("_doc")


def unpacked(names: list[str]) -> list[Column]:
    return [F.col("_doc").getField(c).alias(c) for c in names]


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
