"""MinHash near-dedup with b-bit signatures.

A text stands for its set of distinct word shingles; texts of equal sets are
one node. HASHES permutations give a set's minima. ROWS minima at a time make
a band; sets of equal bands are candidates. With 42 bands of 6, sets of
Jaccard similarity 0.85 have no band in common in 2 of 10**9 cases.

BITS low bits of each minimum are kept as the signature, in planes of 64-bit
words. Two signatures agree in a share m of their places that is
J + (1 - J) / 2**BITS on average, since different minima agree by chance; so
J is estimated by (m - 2**-BITS) / (1 - 2**-BITS), with bit counts only. A
candidate whose estimate falls short of the wanted similarity by over SLACK
standard deviations is dropped. So is one whose fingerprints show that the sets
differ in too many shingles (``set_join.fingerprint``, a bound that always
holds). Any other is confirmed on the full sets.

First every member of a band's bucket is paired with the bucket's least one.
Buckets whose members are then of one component are done; in the others all
pairs of different components are compared, by signatures and in blocks. So
no bucket is capped, and no link that has a common band is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b
from itertools import chain, count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from graphloom.functions.ship import ship
from graphloom.llm.components import connected_components
from graphloom.llm.set_join import BLOCK, _near, fingerprint, shingle_hashes, shingle_set, words_of
from graphloom.llm.simhash import signature
from graphloom.llm.skew import join_to_unique, join_to_wide
from graphloom.llm.staging import Staged

ROWS, BANDS, BITS = 6, 42, 2
HASHES = ROWS * BANDS
#: 64-bit words of each bit's plane.
WORDS = -(-HASHES // 64)
#: Standard deviations that an estimate may fall short.
SLACK = 6
#: Shingles that meet all permutations at a time.
AT_ONCE = 1024

_draw = np.random.default_rng(20240229)
_FLIP = _draw.integers(0, 1 << 32, HASHES, dtype=np.uint32)
_TIMES = _draw.integers(0, 1 << 31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_MIX = np.uint64(0xD6E8FEB86659FD93)


def minima(hashes: np.ndarray) -> np.ndarray:
    """The least value of a set of 64-bit ``hashes`` under each permutation."""
    least = np.full(HASHES, 0xFFFFFFFF, dtype=np.uint32)
    folded = (hashes ^ (hashes >> np.uint64(32))).astype(np.uint32)
    for at in range(0, len(folded), AT_ONCE):
        turned = folded[at : at + AT_ONCE, None] ^ _FLIP
        turned *= _TIMES
        np.minimum(least, turned.min(axis=0), out=least)
    return least


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    x = (x ^ (x >> np.uint64(29))) * _MIX
    return x ^ (x >> np.uint64(32))


def packed_bits(least: np.ndarray) -> np.ndarray:
    """The signature of some minima: BITS planes of WORDS 64-bit words, places beyond HASHES are 0."""
    low = _mixed(least.astype(np.uint64))  # so that a bit depends on all of a minimum's
    planes = np.zeros((BITS, 64 * WORDS), dtype=np.uint8)
    for i in range(BITS):
        planes[i, :HASHES] = (low >> np.uint64(i)) & np.uint64(1)
    return np.packbits(planes, axis=1).view(np.int64).ravel()


def band_keys(least: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band."""
    keys = np.arange(1, BANDS + 1, dtype=np.uint64)
    for column in least.astype(np.uint64).reshape(BANDS, ROWS).T:
        keys = _mixed(keys * _MIX + column)
    return keys.view(np.int64)


def agreements(a: str, b: str) -> Column:
    """At how many of HASHES places the signatures ``a`` and ``b`` agree."""
    apart = [[F.get(a, F.lit(p * WORDS + w)).bitwiseXOR(F.get(b, F.lit(p * WORDS + w))) for p in range(BITS)] for w in range(WORDS)]
    differ = []
    for planes in apart:
        either = planes[0]
        for x in planes[1:]:
            either = either.bitwiseOR(x)
        differ.append(F.bit_count(either))
    return F.lit(HASHES) - sum(differ[1:], differ[0])


def estimate(matches: Column) -> Column:
    """The similarity that ``matches`` of the HASHES places speak for, chance matches taken out."""
    chance = 2.0**-BITS
    return (matches / HASHES - chance) / (1 - chance)


def least_estimate(similarity: float) -> float:
    """The estimate that sets of ``similarity`` fall short of in one of about 10**9 cases (SLACK standard deviations)."""
    chance = 2.0**-BITS
    share = similarity + (1 - similarity) * chance
    return similarity - SLACK * (share * (1 - share) / HASHES) ** 0.5 / (1 - chance)


def _likely(percent: int) -> Column:
    """Whether signatures ``_bu`` and ``_bv``, sizes ``_su`` and ``_sv`` and fingerprints ``_fu`` and ``_fv`` leave a similarity of ``percent`` possible."""
    sizes = 100 * F.least("_su", "_sv") >= percent * F.greatest("_su", "_sv")
    return sizes & (estimate(agreements("_bu", "_bv")) >= least_estimate(percent / 100)) & _near(percent / 100)


def _side(alias: str) -> list[Column]:
    return [F.col("_n").alias(alias), F.col("_size").alias(f"_s{alias}"), F.col("_bits").alias(f"_b{alias}"), F.col("_print").alias(f"_f{alias}")]


def _likely_pairs(sizes: np.ndarray, bits: np.ndarray, prints: np.ndarray, open_: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """What ``_likely`` says of the pairs of rows marked in ``open_``, in NumPy."""
    u, v = np.nonzero(open_ & (100 * np.minimum(sizes[:, None], sizes) >= percent * np.maximum(sizes[:, None], sizes)))
    chance = 2.0**-BITS
    agree = (least_estimate(percent / 100) * (1 - chance) + chance) * HASHES
    apart = bits[u] ^ bits[v]
    apart = np.bitwise_count(np.bitwise_or.reduce(apart.reshape(len(u), BITS, WORDS), axis=1)).sum(axis=1, dtype=np.int64)
    near = HASHES - apart >= agree - 1e-9
    u, v = u[near], v[near]
    similarity = percent / 100
    budget = np.floor((sizes[u] + sizes[v]) * ((1 - similarity) / (1 + similarity)) + 1e-6)
    near = np.bitwise_count(prints[u] ^ prints[v]).sum(axis=1, dtype=np.int64) <= budget
    return u[near], v[near]


def _wide(column: pa.Array) -> np.ndarray:
    # unsigned: bits of negative numbers would be counted in their absolute values
    return column.flatten().to_numpy().view(np.uint64).reshape(len(column), -1)


def _compared(open_: DataFrame, percent: int) -> DataFrame:
    """(u, v): likely pairs of different components among the members of each bucket of ``open_``.

    A bucket of many members is cut into blocks of about BLOCK, and each pair
    of its blocks is compared for itself, so that a task holds two blocks at a
    time whatever the bucket's size. A pair is given by the first bucket only of
    those that it shares: all of them hold two components, so all are here.
    """
    own = F.pmod(F.xxhash64("_n"), F.col("_blocks")).cast("int")
    dealt = open_.withColumn("_own", own).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    key = [F.col("_token"), F.least("_own", "_other").alias("_i"), F.greatest("_own", "_other").alias("_j")]
    dealt = dealt.select(*key, "_own", "_n", "component", "_size", "_bits", "_print", "_bands").repartition("_token", "_i", "_j").sortWithinPartitions("_token", "_i", "_j")

    def pairs(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        own, n, component, size = (batch.column(i).to_numpy() for i in (3, 4, 5, 6))
        open_ = np.triu(component[:, None] != component, 1)
        if batch.column(1)[0] != batch.column(2)[0]:
            open_ &= own[:, None] != own
        u, v = _likely_pairs(size, _wide(batch.column(7)), _wide(batch.column(8)), open_, percent)
        bands = _wide(batch.column(9)).view(np.int64)
        first = (bands[u] == bands[v]).argmax(axis=1)
        own_first = bands[u, first] == batch.column(0).to_numpy()[u]
        u, v = u[own_first], v[own_first]
        return np.minimum(n[u], n[v]), np.maximum(n[u], n[v])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in chain(batches, [None]):
            whole = batch if held is None else held if batch is None else pa.concat_batches([held, batch])
            if whole is None or not whole.num_rows:
                continue
            keys = [whole.column(i).to_numpy() for i in range(3)]
            cuts = np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in keys])) + 1
            # the last key's rows may go on in the next batch
            ends = [*cuts.tolist(), *([whole.num_rows] if batch is None else [])]
            found = [pairs(whole.slice(a, b - a)) for a, b in zip([0, *ends], ends) if b - a > 1]
            held = whole.slice(ends[-1] if ends else 0)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found)], ["u", "v"])

    return dealt.mapInArrow(run, "u long, v long")


def _confirmed(pairs: DataFrame, nodes: DataFrame, source: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The (u, v) of ``pairs`` whose texts' full sets are similar. Only texts in a pair are fetched, one of each node."""
    degrees = Staged(pairs.select(F.explode(F.array("u", "v")).alias("_n")).groupBy("_n").agg(F.count("*").alias("_k")).join(nodes.select("_n", "_sig"), "_n"), "degrees")
    # merged, not broadcast: the texts of pairs are a share of all texts at any size
    texts = Staged(source.select("_sig", "_text").join(degrees.df.hint("merge"), "_sig").groupBy("_n", "_k").agg(F.min("_text").alias("_text")), "texts")
    side = lambda c: texts.df.select(F.col("_n").alias(c), "_k", F.col("_text").alias(f"_{c}"))
    total = max(1, pairs.count())
    half = join_to_wide(pairs, total, side("u"), ["u"], "_k").drop("_k")
    both = join_to_wide(half, total, side("v"), ["v"], "_k")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, x = None, set()
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                batch, keep = whole.slice(at, 64), []
                for n, a, b in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3)):
                    if n != last:
                        last, x = n, shingle_set(a.as_py(), shingle)
                    y = shingle_set(b.as_py(), shingle)
                    shared = len(x & y)
                    keep.append(100 * shared >= percent * (len(x) + len(y) - shared))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["u", "v"]).filter(pa.array(keep, pa.bool_()))

    found = Staged(both.select("u", "v", "_u", "_v").mapInArrow(run, "u long, v long"), "links")
    for x in (degrees, texts):
        x.drop()
    return found.df


def _nodes(source: DataFrame, shingle: int, kind: str) -> tuple[Staged, Staged]:
    """Each row with its set's number, and each set once with its signature and bands; sets without a word have neither."""
    for seed in count():

        def run(batches: Iterator[pa.RecordBatch], seed=seed) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                numbers, digests, sizes, bits, prints, bands = [], [], [], [], [], []
                for text in batch.column(2):
                    text = text.as_py()
                    hashes = shingle_hashes(text, shingle) if words_of(text) else np.zeros(0, dtype=np.uint64)
                    least = minima(hashes)
                    digests.append(blake2b(hashes.tobytes(), digest_size=16, salt=seed.to_bytes(8)).digest())
                    numbers.append(int.from_bytes(digests[-1][:8], signed=True))
                    sizes.append(len(hashes))
                    bits.append(packed_bits(least))
                    prints.append(fingerprint(hashes))
                    bands.append(band_keys(least))
                made = [pa.array(x, t) for x, t in ((digests, pa.binary()), (numbers, pa.int64()), (sizes, pa.int64()), (bits, pa.list_(pa.int64())), (prints, pa.list_(pa.int64())), (bands, pa.list_(pa.int64())))]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], ["_id", "_sig", "_set", "_n", "_size", "_bits", "_print", "_bands"])

        rows = Staged(source.mapInArrow(run, f"_id {kind}, _sig binary, _set binary, _n long, _size long, _bits array<long>, _print array<long>, _bands array<long>"), "minhash")
        each = rows.df.filter("_size > 0").groupBy("_n", "_set", "_size").agg(F.min("_id").alias("_least"), F.min("_sig").alias("_sig"), F.min("_bits").alias("_bits"), F.min("_print").alias("_print"), F.min("_bands").alias("_bands"), F.count("*").alias("_copies"))
        nodes = Staged(each, "nodes")
        # numbers of 64 bits for sets: of another digest if two sets ever get the same one
        if nodes.df.groupBy("_n").count().filter("count > 1").isEmpty():
            return rows, nodes
        rows.drop()
        nodes.drop()


def _links(nodes: DataFrame, source: DataFrame, shingle: int, percent: int) -> DataFrame:
    """(u, v): confirmed pairs of similar nodes, enough of them to join up all that are similar."""
    # a set too small for a different one to be as similar needs no band
    large = nodes.filter(100 * F.col("_size") >= percent * (F.col("_size") + 1))
    tokens = Staged(large.select("_n", "_size", F.explode("_bands").alias("_token")), "bands")
    heads = tokens.df.groupBy("_token").agg(F.min(F.struct("_n", "_size")).alias("_head"), F.max("_n").alias("_last"), F.count("*").alias("_k")).filter("_head._n <> _last").drop("_last")
    heads = Staged(heads, "heads")
    shared = Staged(join_to_unique(tokens.df, max(1, tokens.df.count()), heads.df, ["_token"], "_k"), "shared")
    tokens.drop()

    sized = 100 * F.least("_size", "_head._size") >= percent * F.greatest("_size", "_head._size")
    met = Staged(shared.df.filter((F.col("_n") != F.col("_head._n")) & sized).select(F.col("_head._n").alias("u"), F.col("_n").alias("v")).distinct(), "met")
    heads_of = Staged(met.df.groupBy("u").agg(F.count("*").alias("_k")).join(nodes.select(*_side("u")), "u"), "head-bits")
    first = join_to_unique(met.df, max(1, met.df.count()), heads_of.df, ["u"], "_k").drop("_k").join(nodes.select(*_side("v")), "v").filter(_likely(percent)).select("u", "v")
    first = Staged(first, "pairs")
    links = _confirmed(first.df, nodes, source, shingle, percent)
    now = Staged(connected_components(links), "now")

    placed = shared.df.drop("_head", "_k").join(now.df.withColumnRenamed("node", "_n"), "_n", "left").withColumn("component", F.coalesce("component", "_n"))
    placed = Staged(placed, "placed")
    mixed = placed.df.groupBy("_token").agg(F.min("component").alias("_lo"), F.max("component").alias("_hi"), F.count("*").alias("_k")).filter("_lo <> _hi").drop("_lo", "_hi")
    mixed = Staged(mixed, "mixed")
    crowded = join_to_unique(placed.df, max(1, placed.df.count()), mixed.df, ["_token"], "_k").withColumn("_blocks", F.ceil(F.col("_k") / BLOCK).cast("int"))
    open_ = Staged(crowded.join(nodes.select("_n", "_bits", "_print", "_bands"), "_n"), "open")
    again = Staged(_compared(open_.df, percent), "again")
    second = Staged(again.df.join(first.df, ["u", "v"], "left_anti"), "pairs")
    links = links.unionByName(_confirmed(second.df, nodes, source, shingle, percent))
    for x in (heads, shared, met, heads_of, first, now, placed, mixed, open_, again, second):
        x.drop()
    return links


def near_duplicates(docs: DataFrame, *, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: id, n_shingles, component_id, kept.

    Words are cut at ASCII white space after lower-casing A-Z; a text's set
    holds its distinct shingles of ``shingle`` words, a text with fewer words
    has one of all of them. Texts link if their sets have a Jaccard similarity
    of ``percent`` hundredths or more. ``component_id`` is the smallest
    identifier that links lead to, the row's own included; the row that has it
    is ``kept``. Null and empty texts and those of white space have an empty
    set and link with nothing, not even one another. A null identifier gets
    its group's one, null if there is none, and is not kept. Equal rows stay
    and get the same values. Texts are read whole. Other columns are not read.
    An empty table gives an empty one.
    """
    if not 50 <= percent <= 100:
        raise ValueError("percent must be from 50 to 100: the bands are made for high similarities")
    ship(docs.sparkSession)
    text = F.col(text_col).cast("string")
    source = docs.select(F.col(id_col).alias("_id"), signature(text).alias("_sig"), text.alias("_text"))
    rows, nodes = _nodes(source, shingle, source.schema["_id"].dataType.simpleString())
    found = connected_components(_links(nodes.df, source, shingle, percent))
    named = Staged(nodes.df.join(found, nodes.df._n == found.node, "left").select("_n", "_least", "_copies", F.coalesce("component", "_n").alias("_root")), "members")
    roots = Staged(named.df.groupBy("_root").agg(F.min("_least").alias("_component"), F.count("*").alias("_w")), "roots")
    rooted = Staged(join_to_unique(named.df.drop("_least"), max(1, named.df.count()), roots.df, ["_root"], "_w").select("_n", "_component", "_copies"), "named")
    for x in (nodes, named, roots):
        x.drop()
    total = max(1, rows.df.count())
    full = join_to_unique(rows.df.filter("_size > 0").select("_id", "_n", "_size"), total, rooted.df, ["_n"], "_copies")
    every = full.select("_id", "_size", "_component").unionByName(rows.df.filter("_size = 0").select("_id", "_size", F.col("_id").alias("_component")))
    return every.select(F.col("_id").alias(id_col), F.col("_size").alias("n_shingles"), F.col("_component").alias("component_id"), F.coalesce(F.col("_id") == F.col("_component"), F.lit(False)).alias("kept"))
