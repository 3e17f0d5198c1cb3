"""Joins that no hot key can send to a single task."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from graphloom.llm.staging import shuffle_width

#: A key counts as heavy with over 1/HEAVY_SHARE of the rows, or a quarter of a shuffle partition's share if that is less.
HEAVY_SHARE = 1000


def heavy_bound(rows: DataFrame, total: int) -> int:
    """Rows beyond which a key is heavy. Fewer than ``total`` / bound keys are, so their number follows the partitions' and not the rows'."""
    return max(total // max(HEAVY_SHARE, 4 * shuffle_width(rows.sparkSession)), 1)


def join_to_unique(rows: DataFrame, total: int, lookup: DataFrame, key: list[str], weight: str, how: str = "inner") -> DataFrame:
    """``rows`` joined to ``lookup``, which holds each key once, in ``weight`` its number of rows, and only values of bounded size.

    Heavy keys are so few that they are broadcast whatever the input's size.
    All other keys go through a shuffle in which none of them stands out.
    """
    heavy = F.col(weight) > heavy_bound(rows, total)
    marks = F.broadcast(lookup.filter(heavy).select(*key, F.lit(True).alias("_heavy")))
    hot = rows.join(F.broadcast(lookup.filter(heavy)), key, "inner")
    cold = rows.join(marks, key, "left_anti").join(lookup.filter(~heavy), key, how)
    return hot.unionByName(cold)


def join_to_wide(rows: DataFrame, total: int, lookup: DataFrame, key: list[str], weight: str) -> DataFrame:
    """``rows`` joined to ``lookup``, where the lookup's values are whole texts, or a key has several rows there.

    A heavy key's rows are dealt over so many salts, and its lookup rows are
    repeated for each of them; only the heavy keys and their numbers of salts
    are broadcast, never a text.
    """
    salts = F.ceil(F.col(weight) / heavy_bound(rows, total)).cast("int")
    heavy = lookup.filter(salts > 1).select(*key, salts.alias("_salts")).distinct()
    place = F.pmod(F.monotonically_increasing_id(), F.coalesce("_salts", F.lit(1))).cast("int")
    dealt = rows.join(F.broadcast(heavy), key, "left").withColumn("_salt", place).drop("_salts")
    repeated = lookup.withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    return dealt.join(repeated, [*key, "_salt"]).drop("_salt")
