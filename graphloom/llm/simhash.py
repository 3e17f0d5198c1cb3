"""SimHash near-dedup with pigeonring filtering.

A text's fingerprint has 64 bits, each set if it is set in over half of the
hashes of the text's word shingles. Two fingerprints link if they differ in at
most ``max_distance`` bits.

Candidates come from the pigeonring principle. Cut the 64 bits into m segments
on a ring. If two fingerprints differ in at most d bits, then from some
segment on every chain of l consecutive segments differs in at most
floor(l * d / m) bits. With m = d + 2 (for d up to 3) these budgets are 0 for
the first segment and 1 for the first two and three, so candidates agree in
the first segment and differ in one bit at most in the two that follow. Such
pairs are found by equality: one of the two has a 0 where they differ, and
emits its chain once as it is and once with each single 0 set. The chains'
keys have 38 to 48 bits, so hardly any false candidate reaches the full check.

Equal fingerprints count once, so a text with any number of copies adds one
row; and at most sum(C(64, i), i <= d) fingerprints are within d bits of one.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from xxhash import xxh64_intdigest

from graphloom.functions.ship import ship
from graphloom.llm.components import connected_components
from graphloom.llm.skew import join_to_unique
from graphloom.llm.staging import Staged, packed, unpacked

BITS = 64
SEED = 42
_BLOCK = 1 << 16


def _ones(hashes: Iterator[int]) -> tuple[np.ndarray, int]:
    """How often each bit (highest first) is set, and the number of hashes; in blocks, so memory is bounded."""
    ones, total = np.zeros(BITS, dtype=np.int64), 0
    while len(block := np.fromiter(islice(hashes, _BLOCK), dtype=">u8")):
        ones += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        total += len(block)
    return ones, total


def fingerprint(text: str | None, shingle: int, seed: int = SEED) -> int:
    """The fingerprint as a signed 64-bit integer; 0 for a text without words."""
    words = (text or "").encode("utf-8", "replace").lower().split()  # of bytes: A-Z and the six ASCII spaces only
    if len(words) < shingle:
        shingles = iter([b" ".join(words)] if words else [])
    else:
        shingles = map(b" ".join, zip(*[islice(words, i, None) for i in range(shingle)]))
    ones, total = _ones(map(xxh64_intdigest, shingles, repeat(seed)))
    value = int.from_bytes(np.packbits(2 * ones > total).tobytes(), "big")
    return value - (1 << BITS) if value >> (BITS - 1) else value


def signature(text: Column) -> Column:
    """The text's SHA-256; a null text counts as empty."""
    return F.unhex(F.sha2(F.coalesce(text.cast("string"), F.lit("")), 256))


def fingerprints(docs: DataFrame, shingle: int, *, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, signed: bool = False) -> DataFrame:
    """(_id, _fp), and ``_sig`` if ``signed``, for each row of ``docs``."""
    more = ["_sig"] if signed else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(x.as_py(), shingle, seed) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64()), *batch.columns[2:]], ["_id", "_fp", *more])

    ship(docs.sparkSession)
    source = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"), *[signature(F.col(text_col)).alias(c) for c in more])
    kind = source.schema["_id"].dataType.simpleString()
    return source.mapInArrow(run, f"_id {kind}, _fp long" + ", _sig binary" * signed)


def ring(max_distance: int) -> tuple[list[tuple[int, int, int]], int]:
    """For each start: (bits to rotate left, bits that agree, bits with one difference at most); the segments' number."""
    if not 1 <= max_distance <= 3:
        raise ValueError("max_distance must be 1, 2 or 3: budgets of longer chains exceed one bit beyond that")
    m = max_distance + 2
    cuts = [round(i * BITS / m) for i in range(m + 1)]
    widths = [b - a for a, b in zip(cuts, cuts[1:])]
    return [(cuts[i], widths[i], widths[(i + 1) % m] + widths[(i + 2) % m]) for i in range(m)], m


def _chains(fps: DataFrame, max_distance: int) -> DataFrame:
    """(_fp, _start, _key, _width): each start's chain as a number."""
    starts, _ = ring(max_distance)
    rotated = lambda n: F.col("_fp") if n == 0 else F.shiftleft("_fp", n).bitwiseOR(F.shiftrightunsigned("_fp", BITS - n))
    rows = [F.struct(F.lit(i).alias("_start"), F.shiftrightunsigned(rotated(n), BITS - same - near).alias("_key"), F.lit(near).alias("_width")) for i, (n, same, near) in enumerate(starts)]
    return fps.select("_fp", F.inline(F.array(*rows)))


def links(fps: DataFrame, max_distance: int) -> DataFrame:
    """All pairs (u, v) of the distinct fingerprints ``_fp`` that differ in 1 to ``max_distance`` bits; a pair may repeat."""
    chains = _chains(fps, max_distance)
    # -1: the chain as it is
    flips = F.expr("filter(sequence(-1, _width - 1), b -> b < 0 OR (shiftright(_key, b) & 1L) = 0L)")
    probes = chains.select("_fp", "_start", "_key", F.explode(flips).alias("_bit")).select(
        F.col("_fp").alias("u"), "_start", F.expr("CASE WHEN _bit < 0 THEN _key ELSE _key | shiftleft(1L, _bit) END").alias("_key"), (F.col("_bit") < 0).alias("_plain")
    )
    index = chains.select(F.col("_fp").alias("v"), "_start", "_key")
    near = F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= max_distance
    # merged, not broadcast: an estimate before the chains are made says nothing of their size
    return probes.join(index.hint("merge"), ["_start", "_key"]).filter((F.col("u") != F.col("v")) & near & (~F.col("_plain") | (F.col("u") < F.col("v")))).select("u", "v")


def near_duplicate_groups(docs: DataFrame, *, shingle: int = 5, max_distance: int = 3, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED) -> DataFrame:
    """One row for each row of ``docs``: id, fingerprint (16 hex digits), component_id.

    ``component_id`` is the smallest identifier that links lead to, the row's
    own included; a null identifier gets its group's one (null if the group
    has no other). Texts are cut at ASCII white space after lower-casing A-Z;
    a text with fewer words than ``shingle`` has one shingle of all of them.
    Null and empty texts, and those of white space, have fingerprint 0 and
    link like any other. Equal rows stay and get the same values. Other
    columns are not read. An empty table gives an empty one.
    """
    joined = _members(fingerprints(docs, shingle, id_col=id_col, text_col=text_col, seed=seed), max_distance)
    return joined.select(F.col("_id").alias(id_col), F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"), F.col("_component").alias("component_id"))


def _members(found: DataFrame, max_distance: int) -> DataFrame:
    """``found`` (_id, _fp and others) with ``_root``, the group, and ``_component``, its least identifier."""
    rows = Staged(found, "fingerprints")
    each = Staged(rows.df.groupBy("_fp").agg(F.min("_id").alias("_least"), F.count("*").alias("_n")), "distinct")
    joined_up = connected_components(links(each.df.select("_fp"), max_distance), gather=True)
    members = each.df.join(joined_up, each.df._fp == joined_up.node, "left").select("_fp", "_least", "_n", F.coalesce("component", "_fp").alias("_root"))
    members = Staged(members, "members")
    least = members.df.groupBy("_root").agg(F.min("_least").alias("_component"), F.count("*").alias("_k"))
    least = Staged(least, "roots")
    named = join_to_unique(members.df, max(1, members.df.count()), least.df, ["_root"], "_k")
    named = Staged(named.select("_fp", "_n", "_root", "_component"), "named")
    return join_to_unique(rows.df, rows.df.count(), named.df, ["_fp"], "_n")


def drop_near_duplicates(docs: DataFrame, *, shingle: int = 5, max_distance: int = 3, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED) -> DataFrame:
    """One row of ``docs`` for each near-duplicate group, that of the smallest identifier, with all its columns.

    Rows without an identifier go if their group has a row with one. Of rows
    that repeat the smallest identifier, or that all have none, the one with
    the least SHA-256 of the text stays, and of equal ones the first by the
    hash of all columns.
    """
    found = fingerprints(docs, shingle, id_col=id_col, text_col=text_col, seed=seed, signed=True)
    return keep_one(docs, _members(found, max_distance), id_col, text_col)


def keep_one(docs: DataFrame, members: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` for each ``_root`` of ``members`` (_id, _sig, _root).

    A row is known by its identifier and its text's digest: rows that share
    both are of one group, rows that share the identifier alone, null or not,
    may be of several. Rows with an identifier come before those without, then
    the smallest identifier, then the least digest stays; of rows that share
    both, the first by the hash of all columns. Null and empty texts have one
    digest. Columns may have any names; an empty table gives an empty one.
    """
    # one string key, the same for join and window: one shuffle of the texts
    key = F.concat_ws(":", F.hex("_sig"), F.coalesce(F.concat(F.lit("="), F.col("_id").cast("string")), F.lit("null"))).alias("_key")
    best = members.groupBy("_root").agg(F.min(F.struct(F.col("_id").isNull().alias("_none"), "_id", "_sig")).alias("_best"))
    kept = best.select("_best._id", "_best._sig").select(key)
    marked = docs.select(packed(docs), F.col(id_col).alias("_id"), signature(F.col(text_col)).alias("_sig"))
    found = marked.select("_doc", key).join(kept, "_key", "left_semi")
    order = Window.partitionBy("_key").orderBy(F.xxhash64("_doc"))
    return found.withColumn("_nth", F.row_number().over(order)).filter("_nth = 1").select(*unpacked(docs.columns))
