"""Groups of texts whose shingle sets are similar: an exact set-similarity join.

A text stands for its set of distinct shingles; texts of equal sets are one
node. If two sets of sizes n and m have Jaccard similarity ``t`` or more, then
in any one order of all shingles they share one of the first
n - ceil(t * n) + 1 of the one and of the first m - ceil(t * m) + 1 of the
other (prefix filter). The order used here puts rare shingles first, so that
what a template or a passage contributes comes last and hardly ever meets.
Any order gives all pairs: the counts that it rests on only save work.

With ``max_distance``, SimHash finds pairs first: its operator's fingerprints,
linked by its pigeonring filter, name pairs that are verified and joined up, so
that the exact check that follows need not compare what they connect.

Nodes that share a prefix shingle form a bucket. In a first round all members
are compared with the bucket's least one. A bucket whose members are then all
of one component is done; in any other one every pair of members of different
components is a candidate, in blocks, whatever its size. So each pair of
similarity ``t`` is either verified or joined up through verified ones, and
nothing is capped.

Candidates are pruned without a text before the sets of their whole texts are
compared: by lengths and places, and by fingerprints. A fingerprint has SEGMENTS
words of 64 bits; each shingle of the set flips one of its bits. Two of them
differ in at most as many bits as the sets differ in shingles, and that is at
most (1 - t) / (1 + t) of the sizes' sum if the similarity is ``t``. So pigeonring
filtering loses nothing: going round the segments from some start, the first
one and the first two must keep within their proportional budgets; then the
full Hamming check follows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import blake2b
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from xxhash import xxh64_intdigest

from graphloom.functions.ship import ship
from graphloom.llm.components import connected_components
from graphloom.llm.simhash import fingerprints, links as linked, signature
from graphloom.llm.skew import join_to_unique, join_to_wide
from graphloom.llm.staging import Staged

#: Counting: shingles go by the first bits of their hashes to so many parts, and are told apart by 32 more.
PARTS_LOG = 9
_DROP = np.uint64(64 - PARTS_LOG - 32)
#: Shingles counted in one place, about: 16 MB.
GROUP = 1 << 22
#: Bits of a part's map of repeated shingles, and the shingles of a part whose counts are known to all tasks.
MAP_LOG, KNOWN = 18, 2048
_CHUNK = 1 << 20
#: Words of 64 bits of a fingerprint.
SEGMENTS = 8
#: Members of a block, of which each pair is compared with each other in one place.
BLOCK = 256
_SLACK = 1e-9
_TURN = np.random.default_rng(9).integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").lower().split()  # of bytes: A-Z and the six ASCII spaces only


def shingle_set(text: str | None, shingle: int) -> set[bytes]:
    words = words_of(text)
    return {b" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))}


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """The distinct shingles' 64-bit hashes, ascending; a text of fewer words has one shingle."""
    words = words_of(text)
    if len(words) < shingle:
        return np.array([xxh64_intdigest(b" ".join(words), 43)], dtype=np.uint64)
    each = np.fromiter(map(xxh64_intdigest, words), dtype=np.uint64, count=len(words))
    size = len(words) - shingle + 1
    mixed = np.zeros(size, dtype=np.uint64)
    for i in range(shingle):
        mixed = (mixed ^ (mixed >> np.uint64(31))) * _TURN[0] + each[i : i + size] * _TURN[1]
    mixed ^= mixed >> np.uint64(29)
    mixed *= _TURN[2]
    return np.unique(mixed ^ (mixed >> np.uint64(32)))


def fingerprint(hashes: np.ndarray) -> np.ndarray:
    """A bit for each of 64 * SEGMENTS classes of hashes: whether an odd number of ``hashes`` fall into it."""
    odd = np.bincount((hashes >> np.uint64(5)).astype(np.int64) % (64 * SEGMENTS), minlength=64 * SEGMENTS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def prefix_length(size: int, similarity: float) -> int:
    return size - math.ceil(similarity * size - _SLACK) + 1


class Rarity:
    """What all tasks know of the shingles' counts: a map of those that may repeat, and the counts of frequent ones."""

    def __init__(self, found: pa.Table, cut_log: int):
        self.map = np.zeros((1 << PARTS_LOG, 1 << MAP_LOG >> 3), dtype=np.uint8)
        keys, counts = [np.zeros(0, dtype=np.uint64)], [np.zeros(0, dtype=np.uint32)]
        width = 1 << (MAP_LOG - cut_log) >> 3
        for group, *blobs in zip(*found.columns):
            part, piece = divmod(group.as_py(), 1 << cut_log)
            bits, key, count = (np.frombuffer(x.as_buffer(), dtype=kind) for x, kind in zip(blobs, (np.uint8, np.uint32, np.uint32)))
            self.map[part, piece * width : (piece + 1) * width] = bits
            keys.append((np.uint64(part) << np.uint64(32)) | key)
            counts.append(count)
        self.keys, self.counts = np.concatenate(keys), np.concatenate(counts)
        order = np.argsort(self.keys)
        self.keys, self.counts = self.keys[order], self.counts[order]

    def prefix(self, hashes: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
        """The hashes of the prefix that may be in other sets too, and their places."""
        key = hashes >> _DROP
        known = np.zeros(len(hashes), dtype=np.uint32)
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            known = np.where(self.keys[at] == key, self.counts[at], 0)
        first = np.argsort(known, kind="stable")[: prefix_length(len(hashes), similarity)]
        key = key[first]
        bit = (key & np.uint64((1 << MAP_LOG) - 1)).astype(np.int64)
        may = (self.map[(key >> np.uint64(32)).astype(np.int64), bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1
        return hashes[first[may]], np.flatnonzero(may)


def cut_log_for(shingles: int) -> int:
    """Into how many pieces, as a power of two, each part's map is cut, so that a group to be counted holds about GROUP shingles."""
    return min(max(0, (shingles >> PARTS_LOG) // GROUP).bit_length(), 11)


def rarity(source: DataFrame, shingle: int, total: int) -> Rarity:
    """Of all texts' shingles, ``total`` of them. Its size is fixed; with more shingles it tells fewer of them apart, which costs time only."""
    cut_log = cut_log_for(total)
    inner = MAP_LOG - cut_log  # bits of a group's piece of the map
    place = lambda keys: keys & np.uint64((1 << MAP_LOG) - 1)

    def cut(keys: list[np.ndarray]) -> pa.RecordBatch:
        every = np.concatenate(keys)
        group = ((every >> np.uint64(32)) << np.uint64(cut_log)) | (place(every) >> np.uint64(inner))
        order = np.argsort(group)
        groups, starts = np.unique(group[order], return_index=True)
        blobs = [x.tobytes() for x in np.split(every[order].astype(np.uint32), starts[1:])]
        return pa.RecordBatch.from_arrays([pa.array(groups.astype(np.int32)), pa.array(blobs, pa.binary())], ["_group", "_blob"])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for text in batch.column(0):
                held.append(shingle_hashes(text.as_py(), shingle) >> _DROP)
                size += len(held[-1])
                if size >= _CHUNK:
                    yield cut(held)
                    held, size = [], 0
        if held:
            yield cut(held)

    def tally(table: pa.Table) -> pa.Table:
        keys, counts = np.unique(np.concatenate([np.frombuffer(x.as_py(), dtype=np.uint32) for x in table.column("_blob")]), return_counts=True)
        repeated = np.zeros(1 << inner, dtype=np.uint8)
        repeated[keys[counts > 1] & np.uint32((1 << inner) - 1)] = 1
        top = np.argsort(-counts, kind="stable")[: KNOWN >> cut_log]
        top = np.sort(top[counts[top] > 2])
        values = [[table.column("_group")[0].as_py()], [np.packbits(repeated, bitorder="little").tobytes()], [keys[top].tobytes()], [counts[top].astype(np.uint32).tobytes()]]
        return pa.table([pa.array(v, t) for v, t in zip(values, [pa.int32(), pa.binary(), pa.binary(), pa.binary()])], names=["_group", "_map", "_keys", "_counts"])

    dealt = source.select("_text").mapInArrow(deal, "_group int, _blob binary")
    return Rarity(dealt.groupBy("_group").applyInArrow(tally, "_group int, _map binary, _keys binary, _counts binary").toArrow(), cut_log)


def _possible(similarity: float) -> Column:
    """Whether sets of sizes ``_su`` and ``_sv`` that share places ``_pu`` and ``_pv`` and nothing before can reach ``similarity``."""
    shared = F.least(F.col("_su") - F.col("_pu"), F.col("_sv") - F.col("_pv"))
    return (shared * (1 + similarity) + 1e-6 >= similarity * (F.col("_su") + F.col("_sv"))) & (F.least("_su", "_sv") + 1e-6 >= similarity * F.greatest("_su", "_sv"))


def _near(similarity: float) -> Column:
    """Whether the fingerprints ``_fu`` and ``_fv`` are near enough for ``similarity``: pigeonring chains, then the whole distance."""
    budget = F.floor((F.col("_su") + F.col("_sv")) * ((1 - similarity) / (1 + similarity)) + 1e-6)
    apart = [F.bit_count(F.get("_fu", F.lit(i)).bitwiseXOR(F.get("_fv", F.lit(i)))) for i in range(SEGMENTS)]
    chains = F.lit(False)
    for i in range(SEGMENTS):
        first, second = apart[i], apart[(i + 1) % SEGMENTS]
        chains |= (first * SEGMENTS <= budget) & ((first + second) * SEGMENTS <= 2 * budget)
    return chains & (sum(apart[1:], apart[0]) <= budget)


def _verified(pairs: DataFrame, nodes: DataFrame, source: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The (u, v) of ``pairs`` whose texts' shingle sets have at least Jaccard ``similarity``. Only texts in a pair are fetched."""
    degrees = Staged(pairs.select(F.explode(F.array("u", "v")).alias("_n")).groupBy("_n").agg(F.count("*").alias("_k")).join(nodes.select("_n", "_sig"), "_n"), "degrees")
    fetched = source.select("_sig", "_text").join(degrees.df, "_sig").groupBy("_n", "_k").agg(F.min("_text").alias("_text"))
    texts = Staged(fetched, "texts")
    side = lambda c: texts.df.select(F.col("_n").alias(c), "_k", F.col("_text").alias(f"_{c}"))
    total = max(1, pairs.count())
    half = join_to_wide(pairs, total, side("u"), ["u"], "_k").drop("_k")
    both = join_to_wide(half, total, side("v"), ["v"], "_k")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, x = None, set()
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                batch = whole.slice(at, 64)
                keep = []
                for n, a, b in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3)):
                    if n != last:
                        last, x = n, shingle_set(a.as_py(), shingle)
                    y = shingle_set(b.as_py(), shingle)
                    both = len(x & y)
                    keep.append(both >= similarity * (len(x) + len(y) - both))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["u", "v"]).filter(pa.array(keep, pa.bool_()))

    links = Staged(both.select("u", "v", "_u", "_v").mapInArrow(run, "u long, v long"), "links")
    for x in (degrees, texts):
        x.drop()
    return links.df


def _side(alias: str, n, size, pos) -> list[Column]:
    return [F.col(n).alias(alias), F.col(size).alias(f"_s{alias}"), F.col(pos).alias(f"_p{alias}")]


def _pairs(met: DataFrame) -> DataFrame:
    return met.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def simhash_pairs(docs: DataFrame, nodes: DataFrame, *, shingle: int, max_distance: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(u, v): of ``nodes`` (_n, _sig) with equal fingerprints each and the least one; of fingerprints that differ in up to ``max_distance`` bits the least ones."""
    prints = fingerprints(docs, shingle, id_col=id_col, text_col=text_col, signed=True).select("_sig", "_fp").distinct()
    each = Staged(nodes.select("_n", "_sig").join(prints, "_sig").select("_n", "_fp"), "fingerprints")
    heads = Staged(each.df.groupBy("_fp").agg(F.min("_n").alias("_head"), F.count("*").alias("_k")), "least")
    equal = join_to_unique(each.df, max(1, each.df.count()), heads.df, ["_fp"], "_k").filter("_n <> _head").select(F.col("_n").alias("u"), F.col("_head").alias("v"))
    near = Staged(linked(heads.df.select("_fp"), max_distance), "near")
    side = lambda c: heads.df.select(F.col("_fp").alias(c), F.col("_head").alias(f"_{c}"))
    return equal.unionByName(near.df.join(side("u"), "u").join(side("v"), "v").select(F.col("_u").alias("u"), F.col("_v").alias("v")))


def members(docs: DataFrame, *, shingle: int, similarity: float, max_distance: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_id, _sig, _root, _component, _k) for each row of ``docs``: its text's SHA-256, its group, the group's least identifier and rows."""
    ship(docs.sparkSession)
    text = F.col(text_col).cast("string")
    source = docs.select(F.col(id_col).alias("_id"), signature(text).alias("_sig"), text.alias("_text"))
    kind = source.schema["_id"].dataType.simpleString()

    for seed in count():

        def run(batches: Iterator[pa.RecordBatch], seed=seed) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                each = [shingle_hashes(x.as_py(), shingle) for x in batch.column(2)]
                found = [x.tobytes() for x in each]
                sizes = pa.array([len(x) for x in each], pa.int32())
                prints = pa.array([fingerprint(x) for x in each], pa.list_(pa.int64()))
                sets = [blake2b(x, digest_size=16, salt=seed.to_bytes(8)).digest() for x in found]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sets, pa.binary()), pa.array([int.from_bytes(x[:8], signed=True) for x in sets], pa.int64()), sizes, prints], ["_id", "_sig", "_set", "_n", "_size", "_print"])

        rows = Staged(source.mapInArrow(run, f"_id {kind}, _sig binary, _set binary, _n long, _size int, _print array<long>"), "sets")
        nodes = Staged(rows.df.groupBy("_n", "_set").agg(F.min("_id").alias("_least"), F.min("_sig").alias("_sig"), F.min("_print").alias("_print"), F.count("*").alias("_copies")), "nodes")
        # numbers of 64 bits for sets: of another digest if two sets ever get the same one
        if nodes.df.groupBy("_n").count().filter("count > 1").isEmpty():
            break
        rows.drop()
        nodes.drop()

    known = docs.sparkSession.sparkContext.broadcast(rarity(source, shingle, rows.df.agg(F.sum("_size")).first()[0] or 0))

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                out: list[list[np.ndarray]] = [[], [], [], []]
                for t in whole.column(0).slice(at, 256):
                    hashes = shingle_hashes(t.as_py(), shingle)
                    n = int.from_bytes(blake2b(hashes.tobytes(), digest_size=16, salt=seed.to_bytes(8)).digest()[:8], signed=True)
                    tokens, places = known.value.prefix(hashes, similarity)
                    for x, y in zip(out, (tokens.view(np.int64), np.full(len(tokens), n, dtype=np.int64), np.full(len(tokens), len(hashes), dtype=np.int32), places.astype(np.int32))):
                        x.append(y)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], ["_token", "_n", "_size", "_pos"])

    tokens = Staged(source.select("_text").mapInArrow(prefixes, "_token long, _n long, _size int, _pos int"), "tokens")
    heads = tokens.df.groupBy("_token").agg(F.min(F.struct("_n", "_size", "_pos")).alias("_head"), F.max("_n").alias("_last"), F.count("*").alias("_k")).filter("_head._n <> _last").drop("_last")
    heads = Staged(heads, "heads")
    shared = Staged(join_to_unique(tokens.df, max(1, tokens.df.count()), heads.df, ["_token"], "_k"), "shared")
    tokens.drop()
    faced = shared.df.filter("_n <> _head._n").select(*_side("u", "_n", "_size", "_pos"), *_side("v", "_head._n", "_head._size", "_head._pos"))
    tried = faced.filter(_possible(similarity)).select("u", "v")
    if max_distance is not None:
        tried = tried.unionByName(simhash_pairs(docs, nodes.df, shingle=shingle, max_distance=max_distance, id_col=id_col, text_col=text_col))
    first = Staged(_pairs(tried), "pairs")
    links = _verified(first.df, nodes.df, source, shingle, similarity)
    now = Staged(connected_components(links, gather=True), "now")

    placed = shared.df.drop("_head", "_k").join(now.df.withColumnRenamed("node", "_n"), "_n", "left").withColumn("component", F.coalesce("component", "_n"))
    placed = Staged(placed, "placed")
    mixed = placed.df.groupBy("_token").agg(F.min("component").alias("_lo"), F.max("component").alias("_hi"), F.count("*").alias("_k")).filter("_lo <> _hi").drop("_lo", "_hi")
    mixed = Staged(mixed, "mixed")
    crowded = Staged(join_to_unique(placed.df, max(1, placed.df.count()), mixed.df, ["_token"], "_k").withColumn("_blocks", F.ceil(F.col("_k") / BLOCK).cast("int")), "crowded")
    # a set's fingerprint goes to each of its prefix shingles that are left; a set is no hot key
    open_ = Staged(crowded.df.join(nodes.df.select("_n", "_print"), "_n"), "open")
    left = open_.df.select("_token", F.col("component").alias("_cu"), F.col("_print").alias("_fu"), *_side("u", "_n", "_size", "_pos"), F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_block"))
    right = open_.df.select("_token", F.col("component").alias("_cv"), F.col("_print").alias("_fv"), *_side("v", "_n", "_size", "_pos"), F.pmod(F.xxhash64("_n"), F.col("_blocks")).cast("int").alias("_block"))
    met = left.join(right, ["_token", "_block"]).filter((F.col("u") < F.col("v")) & (F.col("_cu") != F.col("_cv")) & _possible(similarity) & _near(similarity))
    second = Staged(_pairs(met).join(first.df, ["u", "v"], "left_anti"), "pairs")
    links = links.unionByName(_verified(second.df, nodes.df, source, shingle, similarity))
    found = connected_components(links, gather=True)

    named = Staged(nodes.df.join(found, nodes.df._n == found.node, "left").select("_n", "_least", "_copies", F.coalesce("component", "_n").alias("_root")), "members")
    roots = Staged(named.df.groupBy("_root").agg(F.min("_least").alias("_component"), F.count("*").alias("_w"), F.sum("_copies").alias("_k")), "roots")
    rooted = Staged(join_to_unique(named.df.drop("_least"), max(1, named.df.count()), roots.df, ["_root"], "_w").drop("_w"), "named")
    for x in (heads, shared, first, now, placed, mixed, crowded, open_, second, named, roots):
        x.drop()
    return join_to_unique(rows.df.select("_id", "_sig", "_n"), max(1, rows.df.count()), rooted.df, ["_n"], "_copies").select("_id", "_sig", "_root", "_component", "_k")


def similar_groups(docs: DataFrame, *, shingle: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: id, component_id.

    Texts link if their sets of shingles have at least Jaccard ``similarity``.
    ``component_id`` is the smallest identifier of the row's group. Null, empty
    and blank texts have equal sets and form one group. Texts are compared
    whole, however long: a task holds the shingle sets of two at a time. Equal
    rows stay and get equal values; a null identifier gets its group's least
    one; an empty table gives an empty one; other columns are not read.
    """
    found = members(docs, shingle=shingle, similarity=similarity, id_col=id_col, text_col=text_col)
    return found.select(F.col("_id").alias(id_col), F.col("_component").alias("component_id"))
