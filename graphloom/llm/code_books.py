"""Vector codes of one byte a part: product quantisation in integers, with partial-distance search.

A vector becomes integers and is cut into parts; a part's code is the nearest
entry of the part's codebook. Codebooks start as the parts of the smallest
identifiers and are refined by rounds of assignment and averaging, in integers
throughout, so that results do not depend on how rows are dealt out.

The search for the nearest entry takes dimensions in descending variance of
the codebook. All pairs of a row and an entry that are still open are one flat
array; each dimension adds its squares, and a mask drops the pairs whose sum
strictly exceeds the best complete distance that their row has so far. That
best one is the complete distance of the entry which looked nearest, first
after two dimensions and then again at each of RETRIES.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from graphloom.functions.ship import ship
from graphloom.llm.skew import join_to_unique
from graphloom.llm.staging import Staged

#: Rows whose pairs with all entries are held at a time.
AT_ONCE = 256
#: After how many dimensions the best complete distance is looked for again.
RETRIES = (2, 4, 8)
_LARGEST = (1 << 63) - 1


def search_order(book: np.ndarray) -> np.ndarray:
    """Dimensions by descending variance of the entries, exactly; ties in order."""
    spread = [len(book) * sum(x * x for x in column) - sum(column) ** 2 for column in book.T.tolist()]
    return np.array(sorted(range(len(spread)), key=lambda i: (-spread[i], i)), dtype=np.int64)


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    apart = a - b
    return apart * apart


def nearest(rows: np.ndarray, book: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Each row's nearest entry, its squared distance, and the number of terms added; of equal distances the lowest entry."""
    found, distances, terms = np.zeros(len(rows), dtype=np.int64), np.zeros(len(rows), dtype=np.int64), 0
    if not book.shape[1]:
        return found, distances, terms
    most = max(int(np.abs(rows).max(initial=0)), int(np.abs(book).max(initial=0)))
    kind = np.int32 if 4 * most * most * book.shape[1] < 1 << 31 else np.int64
    columns, book = np.ascontiguousarray(book.T[order], dtype=kind), book.astype(kind)
    for at in range(0, len(rows), AT_ONCE):
        some = rows[at : at + AT_ONCE].astype(kind)
        across = np.ascontiguousarray(some.T[order])
        row, entry = np.repeat(np.arange(len(some)), len(book)), np.tile(np.arange(len(book)), len(some))
        total, best = np.zeros(len(row), dtype=kind), None
        for i, (x, y) in enumerate(zip(across, columns), 1):
            # the first dimensions meet all entries, so they need no lists
            total += _squares(x[:, None], y[None, :]).ravel() if best is None else _squares(x[row], y[entry])
            terms += len(total)
            if i in RETRIES or i == len(columns):
                starts = np.searchsorted(row, np.arange(len(some)))
                least = np.minimum.reduceat(total, starts)
                first = np.flatnonzero(total == least[row])
                first = first[np.searchsorted(row[first], np.arange(len(some)))]
                whole = _squares(some, book[entry[first]]).sum(axis=1, dtype=kind)
                best = whole if best is None else np.minimum(best, whole)
            if best is not None:
                open_ = total <= best[row]
                row, entry, total = row[open_], entry[open_], total[open_]
        # the rows' pairs stand in the order of entries, and the best complete one is among them
        starts = np.searchsorted(row, np.arange(len(some)))
        least = np.minimum.reduceat(total, starts)
        level = np.flatnonzero(total == least[row])
        level = level[np.searchsorted(row[level], np.arange(len(some)))]
        found[at : at + AT_ONCE], distances[at : at + AT_ONCE] = entry[level], total[level]
    return found, distances, terms


class CodeBooks:
    """The entries of each part: ``books[p]`` has a row for each entry."""

    def __init__(self, books: list[np.ndarray]):
        self.books = books
        self.orders = [search_order(b) for b in books]
        self.cuts = np.cumsum([0, *(b.shape[1] for b in books)])

    def assign(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(codes, squared distances), a column for each part."""
        found = [nearest(vectors[:, a:b], book, order)[:2] for a, b, book, order in zip(self.cuts, self.cuts[1:], self.books, self.orders)]
        return np.stack([x for x, _ in found], axis=1), np.stack([x for _, x in found], axis=1)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        """The vectors, in integers, that codes stand for."""
        return np.concatenate([book[codes[:, p]] for p, book in enumerate(self.books)], axis=1)

    def digest(self) -> str:
        """SHA-256 of all components by part, entry and position, joined by commas."""
        return hashlib.sha256(",".join(str(x) for book in self.books for x in book.ravel().tolist()).encode()).hexdigest()


def component_limit(dimension: int) -> int:
    """Integers are cut off at plus and minus this, so that a vector's squared distance stays under 2**60."""
    return max(1, int((1 << 60) ** 0.5 / 2 / max(1, dimension) ** 0.5))


def integer_vectors(table: DataFrame, scale: int, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(_id, _label, _v): floor(scale * x) of each component, of rows with a finite vector of the most frequent dimension."""
    finite = F.coalesce(F.forall("_x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    rows = table.select(F.col(id_col).alias("_id"), F.col(label_col).alias("_label"), F.col(vector_col).cast("array<double>").alias("_x")).filter(finite)
    sizes = rows.groupBy(F.size("_x").alias("n")).count().orderBy(F.desc("count"), "n").first()
    dimension = sizes["n"] if sizes else 0
    most = float(component_limit(dimension))
    whole = F.transform("_x", lambda x: F.floor(F.greatest(F.least(x * scale, F.lit(most)), F.lit(-most))).cast("long"))
    return rows.filter(F.size("_x") == dimension).select("_id", "_label", whole.alias("_v"))


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(flat.flatten(), dtype=np.int64).reshape(len(flat), -1 if len(flat) and len(flat.flatten()) else 0)


def _first_books(rows: DataFrame, parts: int, entries: int) -> CodeBooks:
    start = rows.orderBy(F.col("_id").asc_nulls_last(), "_v").limit(entries).select("_id", "_v").collect()
    matrix = np.array([r["_v"] for r in start], dtype=np.int64).reshape(len(start), -1 if start and start[0]["_v"] else 0)
    return CodeBooks(np.array_split(matrix, parts, axis=1))


def _refined(rows: DataFrame, now: CodeBooks) -> CodeBooks:
    """One round: each entry becomes the floored mean of what is assigned to it; an unused one stays."""
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(now)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a task's sums, of fixed size
        held = shared.value
        sums = [np.zeros_like(b) for b in held.books]
        counts = [np.zeros(len(b), dtype=np.int64) for b in held.books]
        for batch in batches:
            vectors = _matrix(batch.column(0))
            codes, _ = held.assign(vectors)
            for p, (a, b) in enumerate(zip(held.cuts, held.cuts[1:])):
                np.add.at(sums[p], codes[:, p], vectors[:, a:b])
                counts[p] += np.bincount(codes[:, p], minlength=len(counts[p]))
        used = [(p, e, int(counts[p][e]), sums[p][e].tolist()) for p in range(len(sums)) for e in np.flatnonzero(counts[p]).tolist()]
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in used], t) for i, t in enumerate(kinds)], ["part", "entry", "n", "sums"])

    found = rows.select("_v").mapInArrow(run, "part int, entry int, n long, sums array<long>")
    width = max(b.shape[1] for b in now.books)
    summed = found.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.get("sums", F.lit(i))) for i in range(width)]).alias("sums"))
    books = [b.copy() for b in now.books]
    for r in summed.collect():  # a row for each entry at most
        book = books[r["part"]]
        book[r["entry"]] = [x // r["n"] for x in r["sums"][: book.shape[1]]]
    shared.unpersist()
    return CodeBooks(books)


def fit(rows: DataFrame, parts: int, entries: int, rounds: int) -> CodeBooks:
    """The codebooks after ``rounds`` over all of ``rows`` (_id, _v)."""
    ship(rows.sparkSession)
    books = _first_books(rows, parts, entries)
    if len(books.books[0]) and books.cuts[-1]:
        for _ in range(rounds):
            books = _refined(rows, books)
    return books


def encode(rows: DataFrame, books: CodeBooks) -> DataFrame:
    """(_id, _label, code, error) for each of ``rows``: two hex digits a part (more beyond 256 entries), and the squared distance."""
    shared = ship(rows.sparkSession).sparkContext.broadcast(books)
    digits = max(2, len(f"{max(1, len(books.books[0])) - 1:x}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, distances = shared.value.assign(_matrix(batch.column(2)))
            text = ["".join(f"{c:0{digits}x}" for c in row) for row in codes.tolist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string()), pa.array(distances.sum(axis=1), pa.int64())], ["_id", "_label", "code", "error"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.select("_id", "_label", "_v").mapInArrow(run, f"_id {kinds['_id']}, _label {kinds['_label']}, code string, error long")


def _total(errors: Column) -> Column:
    return F.least(F.sum(errors.cast("decimal(19,0)")), F.lit(_LARGEST).cast("decimal(38,0)")).cast("long")


def compress(table: DataFrame, *, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row for each row of ``table`` with a usable vector: id, code, error, label_error, codebooks_sha256.

    Rows whose vector is null or holds null or non-finite components take no
    part, nor do those of another dimension than most (of equally frequent
    ones the smallest). A dimension that ``parts`` does not divide gives the
    first parts one more component. Fewer rows than ``entries`` give as many
    entries. The first entries are those of the smallest identifiers, null
    ones last, of rows that repeat one the smaller vector first; repeated rows
    stay and get the same values. Components beyond ``component_limit`` count
    as that limit. ``label_error`` is the sum of the errors of the rows of the
    same label, null being one, and stops at the largest long. An empty table
    gives an empty one. Other columns are not read.

    What is broadcast and what reaches the driver are the codebooks: entries
    times dimension numbers. A task sums what it assigns before the shuffle.
    """
    rows = Staged(integer_vectors(table, scale, id_col, vector_col, label_col), "integers")
    books = fit(rows.df, parts, entries, rounds)
    coded = Staged(encode(rows.df, books).withColumn("_key", F.struct("_label")), "codes")
    rows.drop()
    sums = Staged(coded.df.groupBy("_key").agg(_total(F.col("error")).alias("label_error"), F.count("*").alias("_n")), "label-errors")
    found = join_to_unique(coded.df, max(1, coded.df.count()), sums.df, ["_key"], "_n")
    return found.select(F.col("_id").alias(id_col), "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))
