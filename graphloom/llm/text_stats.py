"""Hashed sampling of labelled rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

CHANCES = 1 << 20


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, bound: int, *, id_col: str = "doc_id", text_col: str = "text", seed: int = 11) -> DataFrame:
    """(_id, _text, _label) of about ``bound`` documents at most that have a label of 0 or 1, chosen by the hash of the identifier.

    A document labelled more than once counts with its largest label. Rows
    without identifier take no part, nor do those with another label. Of rows
    that repeat an identifier the least text counts, once. The chosen
    identifiers, some bytes each and about ``bound`` of them, are broadcast, so
    texts stay where they are read.
    """
    said = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("_id")).agg(F.max(F.col(label_col)).cast("int").alias("_label"))
    share = min(1.0, bound / max(1, said.count()))
    chosen = said.filter(F.pmod(F.xxhash64(F.lit(seed), "_id"), F.lit(CHANCES)) < share * CHANCES)
    return once(docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text")).join(F.broadcast(chosen), "_id"), "_label")


def once(sample: DataFrame, label: str) -> DataFrame:
    """(_id, _text, ``label``): of rows that repeat an identifier one, with the least text."""
    return sample.groupBy("_id").agg(F.min("_text").alias("_text"), F.max(label).alias(label))
