"""Nearest neighbours by multi-index hashing of learned binary codes.

Vectors of length 1 are rotated by a learned
rotation that makes their signs keep most of the angles (iterative
quantisation), and cut to one bit a dimension. The codes are split into
substrings and each block of rows indexes every substring's values. Two codes
within Hamming radius r agree in at least one of m substrings up to r // m
bits, so probing each substring's values within that radius retrieves every
code within r; the full radius is then checked, and the vectors left are
ranked by exact cosine. The radius is the smallest that keeps the wanted
recall on a sample searched by brute force; queries that find too few rows
within it are searched again with a larger one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from graphloom.functions.ship import ship
from graphloom.llm.staging import Staged

SUBSTRING_BITS = 8
#: Numbers of an index block: 32 MB, held twice by the task that has it.
INDEX_NUMBERS = 1 << 22
#: Queries whose cosines with a block are computed at a time, and how far rounding may move one.
QUERIES_AT_ONCE, LEVEL = 64, 1e-9
_NEAR = [np.array([v for v in range(1 << SUBSTRING_BITS) if v.bit_count() <= r], dtype=np.uint8) for r in range(SUBSTRING_BITS + 1)]


@dataclass
class Codes:
    rotation: np.ndarray  # dimensions x bits
    radius: int

    @property
    def substrings(self) -> int:
        return self.rotation.shape[1] // SUBSTRING_BITS

    def encode(self, vectors: np.ndarray) -> np.ndarray:
        """One row of bytes, the substrings, for each vector."""
        unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
        return np.packbits(unit @ self.rotation > 0, axis=1)


def cosines(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Cosines in double precision, summed row by row: equal rows give equal values wherever they stand."""
    dot = (rows * query).sum(axis=1)
    return dot / (np.sqrt((rows * rows).sum(axis=1)) * np.sqrt((query * query).sum()))


def learn_rotation(unit: np.ndarray, bits: int, rounds: int = 30, seed: int = 3) -> np.ndarray:
    """A rotation by iterative quantisation: alternately take signs, then the rotation that fits them best."""
    d = unit.shape[1]
    rng = np.random.default_rng(seed)
    parts = []
    for _ in range(0, bits, d):
        turn = np.linalg.qr(rng.standard_normal((d, d)))[0]
        for _ in range(rounds):
            signs = np.where(unit @ turn > 0, 1.0, -1.0)
            left, _, right = np.linalg.svd(unit.T @ signs)
            turn = left @ right
        parts.append(turn)
    return np.concatenate(parts, axis=1)[:, :bits]


def fit(vectors: np.ndarray, *, bits: int | None = None, k: int = 5, recall: float = 0.99, probes: int = 200) -> Codes:
    """Codes learnt from a sample of valid vectors; the radius is what ``probes`` of them, drawn at random, need for ``recall`` at ``k``."""
    d = vectors.shape[1]
    bits = bits or -(-max(2 * d, 64) // SUBSTRING_BITS) * SUBSTRING_BITS
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    rotation = learn_rotation(unit, bits)
    codes = Codes(rotation, bits)
    if len(vectors) > k + 1:
        packed = codes.encode(vectors)
        needed = []
        for q in np.random.default_rng(11).permutation(len(vectors))[:probes]:
            near = np.argsort(-(unit @ unit[q]), kind="stable")
            near = near[near != q][:k]
            needed += np.bitwise_count(packed[near] ^ packed[q]).sum(axis=1).tolist()
        # the sample is thinner than the table, so its neighbours are farther: a safe side
        codes.radius = int(np.quantile(needed, recall, method="higher"))
    return codes


class BlockIndex:
    """The multi-index of one block of rows: for each substring the rows by value."""

    def __init__(self, codes: Codes, ids: np.ndarray, vectors: np.ndarray):
        self.codes, self.ids, self.vectors = codes, ids, vectors
        self.unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
        self.packed = codes.encode(vectors)
        size = 1 << SUBSTRING_BITS
        self.rows = [np.argsort(self.packed[:, j], kind="stable") for j in range(codes.substrings)]
        self.starts = [np.concatenate([[0], np.cumsum(np.bincount(self.packed[:, j], minlength=size))]) for j in range(codes.substrings)]

    def probed(self, code: np.ndarray) -> np.ndarray:
        """Which rows the pigeonhole probes of ``code`` retrieve: all within the radius, and others."""
        radius, m = self.codes.radius, self.codes.substrings
        seen = np.zeros(len(self.ids), dtype=bool)
        # with r = m * a + b, one of the first b + 1 substrings is within a or one of the others within a - 1
        a, b = divmod(radius, m)
        for j in range(m):
            reach = a if j <= b else a - 1
            if reach < 0:
                continue
            values = _NEAR[min(reach, SUBSTRING_BITS)] ^ code[j]
            if 8 * len(values) > 1 << SUBSTRING_BITS:  # most lists would be read: mark by value instead
                wanted = np.zeros(1 << SUBSTRING_BITS, dtype=bool)
                wanted[values] = True
                seen |= wanted[self.packed[:, j]]
            else:
                starts, rows = self.starts[j], self.rows[j]
                for value in values.tolist():
                    seen[rows[starts[value] : starts[value + 1]]] = True
            if seen.all():
                break
        return seen

    def within(self, code: np.ndarray) -> np.ndarray:
        """The rows whose code is within the radius of ``code``: pigeonhole probes, then the full check."""
        found = np.flatnonzero(self.probed(code))
        return found[np.bitwise_count(self.packed[found] ^ code).sum(axis=1) <= self.codes.radius]

    def nearest(self, query_ids: np.ndarray, queries: np.ndarray, k: int) -> list[tuple[int, int, float]]:
        """(query, row, score) of the ``k`` nearest rows within the radius of each query.

        Matrix products give the cosines but for the last digits; whatever is
        level with the k-th by them is then ranked by ``cosines``.
        """
        out = []
        codes = self.codes.encode(queries)
        for at in range(0, len(queries), QUERIES_AT_ONCE):
            some = queries[at : at + QUERIES_AT_ONCE]
            rough = self.unit @ (some / np.linalg.norm(some, axis=1, keepdims=True)).T
            for i, query_id in enumerate(query_ids[at : at + QUERIES_AT_ONCE].tolist()):
                found = self.within(codes[at + i])
                found = found[self.ids[found] != query_id]
                if len(found) > k:
                    score = rough[found, i]
                    found = found[score >= np.partition(score, len(score) - k)[len(score) - k] - LEVEL]
                score = cosines(self.vectors[found], some[i])
                best = np.lexsort((self.ids[found], -score))[:k]
                out += [(query_id, int(self.ids[found[j]]), float(score[j])) for j in best]
        return out


def valid_vectors(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(_id, _v): rows with an identifier and a finite, non-zero vector, in double precision; the dimension is the most frequent one."""
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    good = F.col("_id").isNotNull() & F.col("_v").isNotNull() & F.coalesce(F.forall("_v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False)) & F.exists("_v", lambda x: x != 0)
    rows = table.select(F.col(id_col).cast("long").alias("_id"), v.alias("_v")).filter(good)
    sizes = rows.groupBy(F.size("_v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.filter(F.size("_v") == (sizes["n"] if sizes else 0))


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(flat.flatten(), dtype=np.float64).reshape(len(flat), -1)


def search(table: DataFrame, is_query, *, k: int = 5, recall: float = 0.99, id_col: str = "vec_id", vector_col: str = "embedding", sample: int = 20_000, sample_numbers: int = 1 << 21) -> DataFrame:
    """The ``k`` nearest rows found for each query row: query_id, rank (from 1), vec_id, score.

    ``is_query`` is a condition on ``id_col``. Nearness is the cosine of the
    original vectors in double precision; ties go to the smaller identifier.
    Rows whose vector is null, zero or holds null or non-finite components
    take no part, nor do those of another dimension than most. Identifiers are
    taken as unique; of rows that repeat one the least vector counts. Fewer than ``k`` other rows
    give as many results; a query that finds fewer although there are more is
    searched again, its radius doubled each time, at last to the whole code.
    The codes are learnt from about ``sample`` rows and ``sample_numbers``
    numbers at most, chosen by the hash of the identifier; every row is indexed.

    Rows are dealt into index blocks by the hash of their identifier. Each
    block is written to one task, once, with all queries after it: the task
    builds the block's index and lets the queries stream past. So it holds a
    block and a batch of queries, whatever their numbers, and gives at most
    ``k`` rows for each query, which are then merged. Popular vectors are
    spread like any others.
    """
    spark = ship(table.sparkSession)
    schema = "query_id long, rank int, vec_id long, score double"
    rows = Staged(valid_vectors(table, id_col, vector_col).groupBy("_id").agg(F.min("_v").alias("_v")), "vectors")
    total = rows.df.count()
    if not total:
        return spark.createDataFrame([], schema)
    dimension = len(rows.df.first()["_v"])
    share = min(1.0, min(sample, sample_numbers // dimension) / total)
    hashed = F.xxhash64(F.lit(23), "_id")
    got = rows.df.filter(F.pmod(hashed, F.lit(1 << 20)) < share * (1 << 20)).toArrow() if total > 1 else rows.df.toArrow()
    vectors = _matrix(got.column("_v"))[np.argsort(got.column("_id").to_numpy())]
    codes = fit(vectors if len(vectors) else _matrix(rows.df.limit(1).toArrow().column("_v")), k=k, recall=recall)
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    index_blocks = max(1, -(-total * dimension // INDEX_NUMBERS), min(width, total // 2_000))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

    def ranked(queries: DataFrame, codes: Codes) -> DataFrame:
        shared = spark.sparkContext.broadcast(codes)
        index = rows.df.select(F.pmod(hashed, F.lit(index_blocks)).cast("int").alias("_b"), F.lit(False).alias("_asks"), "_id", "_v")
        asked = queries.select(F.explode(F.sequence(F.lit(0), F.lit(index_blocks - 1))).alias("_b"), F.lit(True).alias("_asks"), "_id", "_v")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block, held, index = -1, [], None
            for batch in batches:
                if not batch.num_rows:
                    continue
                b, asks = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
                ids, vectors = batch.column(2).to_numpy(), _matrix(batch.column(3))
                cuts = np.flatnonzero((np.diff(b) != 0) | (np.diff(asks.astype(np.int8)) != 0)) + 1
                out: list[tuple[int, int, float]] = []
                for part in np.split(np.arange(len(b)), cuts):
                    if b[part[0]] != block:
                        block, held, index = b[part[0]], [], None
                    if not asks[part[0]]:
                        held.append((ids[part], vectors[part]))
                        continue
                    if held:
                        index, held = BlockIndex(shared.value, *map(np.concatenate, zip(*held))), []
                    if index:
                        out += index.nearest(ids[part], vectors[part], k)
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], ["query_id", "vec_id", "score"])

        # each block's rows, then its queries
        dealt = index.unionByName(asked).repartition(index_blocks, "_b").sortWithinPartitions("_b", "_asks")
        found = dealt.mapInArrow(run, "query_id long, vec_id long, score double")
        return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    queries, whole = rows.df.filter(is_query(F.col("_id"))), codes.rotation.shape[1]
    done = spark.createDataFrame([], schema)
    while True:
        found = Staged(ranked(queries, codes), "found").df
        full = found.groupBy("query_id").count().filter(F.col("count") >= min(k, total - 1)).select(F.col("query_id").alias("_id"))
        short = Staged(queries.join(full, "_id", "left_anti"), "short")
        if codes.radius >= whole or short.df.isEmpty():
            return done.unionByName(found)
        done = done.unionByName(found.join(full.withColumnRenamed("_id", "query_id"), "query_id", "left_semi"))
        queries, codes = short.df, replace(codes, radius=min(whole, max(2 * codes.radius, codes.substrings)))
