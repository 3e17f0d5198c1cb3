"""Groups of spelling variants: words that differ by one inserted, deleted or replaced character.

Each word gives an integer key for itself and one for each single deletion,
made of polynomial hashes of its prefix and its suffix, so that no shorter
string is ever built. Two words differ by a replacement at some place if they
have the same key for the deletion there; one is the other with a deletion if
its own key is that deletion's. Keys are dealt out by their leading bits and
sorted, neighbours of equal key are paired, and pairs are verified on the
strings, so a collision costs time only.

What shares a key is bounded by the alphabet: all words with a hole at one
place, or all with one character more than a word. So no key is hot, and the
pairs of a key are links that count.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from graphloom.functions.ship import ship
from graphloom.llm.staging import Staged, shuffle_width

_RUN = re.compile("[A-Za-zÀ-ÿ]+")
#: Distinct words that a task holds before it passes their counts on.
HELD = 1 << 17
_BASE = 0x9E3779B97F4A7C15
#: What a key is of: a deletion with its place, the word itself, a deletion without.
REPLACED, ITSELF, DELETED = 0, 1, 2
_KEY = "_key long, _id long, _role int, _pos int"


def runs(text: str | None) -> Counter:
    """How often each maximal run of letters occurs, A-Z in lower case."""
    # of bytes: A-Z only
    return Counter(_RUN.findall((text or "").encode("utf-8", "replace").lower().decode()))


def slipped(run: str, start: int, every: int) -> str:
    """``run``, without the character that its CRC-32 (continued from ``start``) names if ``every`` divides that."""
    h = crc32(run.encode(), start)
    if h % every:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def _turned(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def deletion_keys(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, index of the word, role, place) for all of ``words``, none of them empty.

    With T the running sum of x[j] * B**j over all characters, a word from s to
    e without place i hashes to (T[i] - T[s]) / B**s + (T[e] - T[i + 1]) / B**(s + 1),
    modulo 2**64, where an odd B has an inverse. Of equal characters in a row
    only the last one's deletion counts as a shorter word.
    """
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    points = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32)
    n = len(points)
    up, down = np.full(n + 1, _BASE, dtype=np.uint64), np.full(n + 2, pow(_BASE, -1, 1 << 64), dtype=np.uint64)
    up[0] = down[0] = 1
    up, down = np.cumprod(up), np.cumprod(down)
    total = np.concatenate([[np.uint64(0)], np.cumsum(_turned(points.astype(np.uint64) + np.uint64(1)) * up[:n], dtype=np.uint64)])
    ends = np.cumsum(sizes)
    starts = ends - sizes
    of = np.repeat(np.arange(len(words)), sizes)
    at = np.arange(n)
    s, e = starts[of], ends[of]
    cut = (total[at] - total[s]) * down[s] + (total[e] - total[at + 1]) * down[s + 1]
    place, size = (at - s).astype(np.uint64), sizes[of].astype(np.uint64)
    whole = (total[ends] - total[starts]) * down[starts]
    shorter = (at + 1 == e) | (points != np.append(points[1:], 0))
    keys = np.concatenate(
        [
            _turned(cut ^ _turned(place * np.uint64(2) + np.uint64(1)) ^ _turned(size << np.uint64(32))),
            _turned(whole ^ _turned((sizes.astype(np.uint64) + np.uint64(1)) << np.uint64(33))),
            _turned(cut[shorter] ^ _turned(size[shorter] << np.uint64(33))),
        ]
    )
    roles = np.repeat(np.array([REPLACED, ITSELF, DELETED], dtype=np.int32), [n, len(words), int(shorter.sum())])
    places = np.concatenate([at - s, np.zeros(len(words), dtype=np.int64), (at - s)[shorter]])
    return keys.view(np.int64), np.concatenate([of, np.arange(len(words)), of[shorter]]), roles, places.astype(np.int32)


def word_counts(docs: DataFrame, *, every: int, min_length: int, min_count: int, id_col: str, text_col: str) -> DataFrame:
    """(word, n): what occurs ``min_count`` times or more in all texts, with ``min_length`` characters or more."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
            held.clear()
            return out

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                start = crc32(f"{doc_id}:".encode())
                for word, n in runs(text.as_py()).items():
                    if len(word) >= min_length:  # a deletion makes no word longer
                        held[slipped(word, start, every)] += n
                if len(held) >= HELD:
                    yield flush()
        yield flush()

    source = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.col(text_col).cast("string"))
    counted = source.mapInArrow(run, "word string, n long").filter(F.char_length("word") >= min_length)
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


def keyed(words: DataFrame) -> DataFrame:
    """(_key, _id, _role, _pos) of each of ``words`` (_id, word)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            if texts:
                keys, of, roles, places = deletion_keys(texts)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (keys, ids[of], roles, places)], ["_key", "_id", "_role", "_pos"])

    return words.select("_id", "word").mapInArrow(run, _KEY)


def _paired(key: np.ndarray, ids: np.ndarray, role: np.ndarray, pos: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(u, v, role, pos) of the rows, whole runs of equal keys in the order of role and place."""
    out = []
    bounds = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a < 2:
            continue
        who, what, where = ids[a:b].tolist(), role[a:b].tolist(), pos[a:b].tolist()
        for i in range(b - a):
            for j in range(i + 1, b - a):
                if what[i] == what[j] == REPLACED and where[i] == where[j]:
                    out.append((who[i], who[j], REPLACED, where[i]))
                elif what[i] == ITSELF and what[j] == DELETED:
                    out.append((who[i], who[j], DELETED, where[j]))
                elif what[i] == what[j] == DELETED:
                    break  # only deletions follow: they pair with words, not with one another
    return out


def candidates(words: DataFrame) -> DataFrame:
    """(u, v, role, pos): pairs of ``words`` (_id, word) with equal keys, each near pair once; v is the longer one."""
    width = shuffle_width(words.sparkSession)
    bits = max(1, (4 * width - 1).bit_length())
    dealt = keyed(words).repartition(width, F.shiftrightunsigned("_key", 64 - bits)).sortWithinPartitions("_key", "_role", "_pos")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, dtype=t) for t in (np.int64, np.int64, np.int32, np.int32)]

        def pairs(columns: list[np.ndarray]) -> pa.RecordBatch:
            found = _paired(*columns)
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.int32()))], ["u", "v", "role", "pos"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held = [np.concatenate([x, c.to_numpy()]) for x, c in zip(held, batch.columns)]
            # the last key's run may go on in the next batch
            done = int(np.searchsorted(held[0], held[0][-1]))
            yield pairs([x[:done] for x in held])
            held = [x[done:] for x in held]
        yield pairs(held)

    return dealt.mapInArrow(run, "u long, v long, role int, pos int")


def _without(word: Column, pos: Column) -> Column:
    return F.concat(F.substring(word, F.lit(1), pos), F.substring(word, pos + 2, F.char_length(word)))


def links(words: DataFrame) -> DataFrame:
    """(_u, _v, u, v): all near pairs of ``words`` (_id, word), verified on the strings; numbers and words, each pair once."""
    pairs = Staged(candidates(words), "spelling-pairs")
    side = lambda c: words.select(F.col("_id").alias(f"_{c}"), F.col("word").alias(c), F.col("n").alias(f"n_{c}"))
    both = pairs.df.select(F.col("u").alias("_u"), F.col("v").alias("_v"), "role", "pos").join(side("u"), "_u").join(side("v"), "_v")
    u, v, pos = F.col("u"), F.col("v"), F.col("pos")
    replaced = (F.col("role") == REPLACED) & (F.char_length(u) == F.char_length(v)) & (u != v) & (_without(u, pos) == _without(v, pos))
    deleted = (F.col("role") == DELETED) & (u == _without(v, pos))
    return both.filter(replaced | deleted).drop("role", "pos")


def _roots(forms: DataFrame, most: int, factor: float) -> DataFrame:
    """(_id, _to) of ``forms`` (_id, _to) with _to the last of the forms: each round doubles the steps.

    A form is ``factor`` times as frequent as its word or more, so a chain has
    at most log(most) / log(factor) steps.
    """
    rounds = max(0, math.ceil(math.log2(max(1.0, math.log(max(1, most)) / math.log(factor)))))
    now = Staged(forms, "forms")
    for _ in range(rounds):
        onward = now.df.select(F.col("_id").alias("_to"), F.col("_to").alias("_on"))
        after = Staged(now.df.join(onward, "_to", "left").select("_id", F.coalesce("_on", "_to").alias("_to")), "forms")
        now.drop()
        now = after
    return now.df


def spelling_groups(docs: DataFrame, *, every: int = 199, min_length: int = 6, min_count: int = 5, factor: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each frequent word: word, form, root, n, n_near, form_n.

    Words are the maximal runs of ``[A-Za-z\\u00C0-\\u00FF]`` in the whole texts,
    A-Z in lower case; one in ``every`` loses a character, chosen by the CRC-32
    of ``<identifier>:<run>``. Those of ``min_length`` characters and
    ``min_count`` occurrences stay. Two are near if one insertion, deletion or
    replacement makes them equal. The form is the near word of largest n, of
    several the first in code-point order, if it occurs ``factor`` times as
    often or more, else null; root is where forms lead in the end, the word
    itself if it has none.

    A null text has no words. A row without identifier counts as one with an
    empty identifier. Repeated rows count each. Other columns are not read. No
    words give an empty table. ``factor`` must be over 1.
    """
    if factor <= 1:
        raise ValueError("factor must be over 1: forms could lead in circles")
    counted = word_counts(docs, every=every, min_length=min_length, min_count=min_count, id_col=id_col, text_col=text_col)
    words = Staged(counted.withColumn("_id", F.monotonically_increasing_id()), "words")
    near = Staged(links(words.df), "near")
    both = F.explode(F.array(*[F.struct(F.col(f"_{a}").alias("_id"), F.struct((-F.col(f"n_{b}")).alias("n"), F.col(b).alias("word"), F.col(f"_{b}").alias("id")).alias("near")) for a, b in ("uv", "vu")]))
    best = near.df.select(both.alias("x")).select("x.*").groupBy("_id").agg(F.count("*").alias("n_near"), F.min("near").alias("near"))
    named = words.df.join(best, "_id", "left")
    fits = -F.col("near.n") >= factor * F.col("n")
    named = named.select("_id", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), *[F.when(fits, c).alias(name) for c, name in ((F.col("near.word"), "form"), (-F.col("near.n"), "form_n"), (F.col("near.id"), "_to"))])
    found = Staged(named, "spelling")
    most = found.df.agg(F.max("n")).first()[0] or 0
    roots = _roots(found.df.filter("_to IS NOT NULL").select("_id", "_to"), most, factor)
    last = roots.join(words.df.select(F.col("_id").alias("_to"), F.col("word").alias("root")), "_to").select("_id", "root")
    return found.df.drop("_to").join(last, "_id", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
