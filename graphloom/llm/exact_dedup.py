"""Exact dedup: a tree merge of digest runs.

Each input partition is a run of (digest, best row, count). In each round the
runs r with the same r // FAN_IN are merged into one, FAN_IN at a time: they
are dealt by digest, each task sorts what it gets by digest and goes through
it once, and of equal digests the smallest (or largest) identifier and the sum
of the counts are kept. Spark does that as a sort-based aggregate, since a
struct is what is kept, before and after each exchange: what a partition sends
is sorted and merged already. Rounds follow the logarithm of the number of
partitions to the base FAN_IN, until one run is left. Equal counts as verified
where SHA-256, XXH64 and length of the text all agree, at every level; the
texts themselves are not compared. Only DataFrame operations are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from graphloom.llm.skew import join_to_unique
from graphloom.llm.staging import Staged, packed, unpacked

FAN_IN = 4
#: What stands for a text: two digests and the length. Equal in all three counts as verified equal.
KEY = ["_digest", "_check", "_length"]


def _signatures(docs: DataFrame, id_col: str, text: Column) -> DataFrame:
    """Narrow rows: identifier, run, row number and the text's signature."""
    text = F.coalesce(text, F.lit(""))
    return docs.select(
        F.col(id_col).alias("_id"),
        F.monotonically_increasing_id().alias("_row"),
        F.spark_partition_id().alias("_run"),
        F.unhex(F.sha2(text, 256)).alias("_digest"),
        F.xxhash64(text).alias("_check"),
        F.octet_length(text).alias("_length"),
    )


def _merge(runs: DataFrame, best, fan_in: int) -> DataFrame:
    return runs.groupBy(*KEY, F.floor(F.col("_run") / fan_in).cast("int").alias("_run")).agg(
        best("_best").alias("_best"), F.sum("_n").alias("_n")
    )


def keepers(signatures: DataFrame, keep: str, fan_in: int = FAN_IN) -> DataFrame:
    """One row for each distinct text: KEY, ``_best`` (struct of identifier and row) and ``_n``."""
    best = {"largest": F.max, "smallest": F.min}[keep]
    runs = signatures.select(*KEY, "_run", F.struct("_id", "_row").alias("_best"), F.lit(1).cast("long").alias("_n"))
    count, levels = (signatures.agg(F.max("_run")).first()[0] or 0) + 1, 1
    while fan_in**levels < count:
        levels += 1
    for _ in range(levels):
        runs = _merge(runs, best, fan_in)
    return runs.drop("_run")


def exact_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", normalise=None, keep: str = "smallest", fan_in: int = FAN_IN) -> DataFrame:
    """One row for each row of ``docs``: id, keep_id, group_size, kept, text_sha256.

    ``normalise`` maps the text column to the one compared (None: unchanged).
    A null text counts as empty. Of equal texts the row with the ``keep``
    ("smallest" or "largest") identifier stays; a null identifier sorts first.
    Exactly one row of a group is kept, also among rows that repeat the same
    identifier. Other columns of ``docs`` are not read, so their names do not
    matter. An empty table gives an empty one.
    """
    text = normalise(F.col(text_col)) if normalise else F.col(text_col)
    rows = Staged(_signatures(docs, id_col, text), "digests")
    best = Staged(keepers(rows.df, keep, fan_in), "kept")
    joined = join_to_unique(rows.df, rows.df.count(), best.df, KEY, "_n")
    return joined.select(
        F.col("_id").alias(id_col),
        F.col("_best._id").alias("keep_id"),
        F.col("_n").alias("group_size"),
        (F.col("_row") == F.col("_best._row")).alias("kept"),
        F.lower(F.hex("_digest")).alias("text_sha256"),
    )


def drop_exact_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", normalise=None, keep: str = "smallest", fan_in: int = FAN_IN) -> DataFrame:
    """The rows of ``docs``, one for each distinct text, with all their columns.

    Which one stays is as in ``exact_duplicates``. Rows that repeat a kept
    identifier and its text count as one, chosen by the hash of all columns.
    """
    text = normalise(F.col(text_col)) if normalise else F.col(text_col)
    plain = F.coalesce(text, F.lit(""))
    rows = Staged(_signatures(docs, id_col, text), "digests")
    best = Staged(keepers(rows.df, keep, fan_in).select(F.col("_best._id").alias("_id"), *KEY), "kept")
    # one string key of identifier and signature, the same for join and window: one shuffle of the texts
    key = F.concat_ws(":", F.hex("_digest"), "_check", "_length", F.coalesce(F.concat(F.lit("="), F.col("_id").cast("string")), F.lit("null"))).alias("_key")
    marked = docs.select(packed(docs), F.col(id_col).alias("_id"), F.unhex(F.sha2(plain, 256)).alias("_digest"), F.xxhash64(plain).alias("_check"), F.octet_length(plain).alias("_length"))
    found = marked.select("_doc", key).join(best.df.select(key), "_key", "left_semi")
    order = Window.partitionBy("_key").orderBy(F.xxhash64("_doc"))
    return found.withColumn("_nth", F.row_number().over(order)).filter("_nth = 1").select(*unpacked(docs.columns))
