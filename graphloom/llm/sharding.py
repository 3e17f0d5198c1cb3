"""Uniform shuffle into shards of exact size through a communication matrix.

1. Permute locally: each input partition is sorted by a random key, and its
   rows get their rank in that order.
2. Draw how many rows each partition sends to each shard: a matrix with the
   partitions' counts as row sums and the shards' exact sizes as column sums,
   by sequential multivariate hypergeometric draws. The rank alone then tells
   a row's shard.
3. Exchange, and permute again within the shard for its slot.

A shard's slots are cut into ranges by a second random key, so that no task
has to hold a whole shard: a range's first slot is the number of rows in the
ranges before it.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from graphloom.llm.staging import Staged, packed, quoted, shuffle_width, unpacked

_RANK_BITS = 33  # of monotonically_increasing_id
ROWS_A_RANGE = 10_000
#: Counts of the matrix up to which it is broadcast (32 MB); a larger one is joined by partition.
MATRIX_BROADCAST = 4_000_000


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """How many of ``draws`` from ``good`` and ``bad`` rows are good; exact at any size."""
    if draws == 0 or good == 0:
        return 0
    if bad == 0:
        return draws
    if good < 10**9 and bad < 10**9:
        return int(rng.hypergeometric(good, bad, draws))
    # by inversion around the mode; the tails left out have under 1e-30 of the mass
    low, high = max(0, draws - bad), min(good, draws)
    mean = draws * good / (good + bad)
    spread = 12 * (mean * (bad / (good + bad))) ** 0.5 + 24
    k = np.arange(max(low, int(mean - spread)), min(high, int(mean + spread)) + 1, dtype=np.float64)
    steps = np.log(good - k[:-1]) + np.log(draws - k[:-1]) - np.log(k[:-1] + 1) - np.log(bad - draws + k[:-1] + 1)
    logs = np.concatenate([[0.0], np.cumsum(steps)])
    mass = np.cumsum(np.exp(logs - logs.max()))
    return int(k[np.searchsorted(mass, rng.random() * mass[-1], side="right")])


def communication_matrix(rows: list[int], sizes: list[int], seed: int) -> np.ndarray:
    """counts[i, j]: how many rows partition i sends to shard j, uniform given both margins."""
    rng = np.random.default_rng(seed)
    left = list(sizes)
    out = np.zeros((len(rows), len(sizes)), dtype=np.int64)
    for i, n in enumerate(rows):
        rest = sum(left)
        for j, room in enumerate(left):
            rest -= room
            out[i, j] = got = hypergeometric(rng, room, rest, n)
            left[j] -= got
            n -= got
    return out


def even_sizes(total: int, shards: int) -> list[int]:
    return [total // shards + (j < total % shards) for j in range(shards)]


def shard_uniformly(docs: DataFrame, shards: int, *, seed: int = 17) -> DataFrame:
    """``docs`` with ``shard`` (0 to shards - 1) and ``slot`` (its place there, gapless from 0).

    Each assignment of rows to slots is as likely as any other; shard sizes
    differ by one row at most, larger ones first. All rows stay, repeated ones
    and nulls in any column included; content does not matter. With fewer rows
    than shards some stay empty, an empty table gives an empty one. The matrix
    has one row for each input partition and lives on the driver: partitions
    times shards counts, whatever the number of rows. Columns ``shard`` and
    ``slot`` of the input are replaced.
    """
    spark = docs.sparkSession
    names = [c for c in docs.columns if c.lower() not in ("shard", "slot")]
    shuffled = docs.select(packed(docs, names), F.xxhash64(F.lit(seed), F.monotonically_increasing_id()).alias("_key")).sortWithinPartitions("_key")
    rows = Staged(shuffled.select("_doc", F.monotonically_increasing_id().alias("_place")), "permuted")
    block, rank = F.shiftright("_place", _RANK_BITS), F.col("_place").bitwiseAND((1 << _RANK_BITS) - 1)
    counts = sorted((r[0], r[1]) for r in rows.df.groupBy(block.alias("b")).count().collect())
    total = sum(n for _, n in counts)
    matrix = communication_matrix([n for _, n in counts], even_sizes(total, shards), seed)
    ends = spark.createDataFrame([(b, [int(x) for x in np.cumsum(matrix[i])]) for i, (b, _) in enumerate(counts)], "_block long, _ends array<long>")
    ranges = max(1, -(-shuffle_width(spark) * 8 // shards), -(-total // (shards * ROWS_A_RANGE)))
    dealt = (
        rows.df.withColumn("_block", block)
        .join(F.broadcast(ends) if matrix.size <= MATRIX_BROADCAST else ends, "_block")
        .select("_doc", "_place", F.size(F.filter("_ends", lambda e: e <= rank)).alias("shard"), F.xxhash64(F.lit(seed + 1), F.col("_place")).alias("_key"))
        .withColumn("_range", F.pmod(F.shiftright("_key", 20), F.lit(ranges)).cast("int"))
    )
    sizes = dealt.groupBy("shard", "_range").count()
    before = Window.partitionBy("shard").orderBy("_range")
    firsts = Staged(sizes.select("shard", "_range", (F.sum("count").over(before) - F.col("count")).alias("_first")), "ranges")
    nth = F.row_number().over(Window.partitionBy("shard", "_range").orderBy("_key", "_place"))
    placed = dealt.withColumn("_nth", nth).join(firsts.df, ["shard", "_range"])
    return placed.select(*unpacked(names), "shard", (F.col("_first") + F.col("_nth") - 1).alias("slot"))
