"""Connected components by alternating star contraction, in DataFrame operations only; few links, where wanted, in one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from graphloom.functions.ship import ship
from graphloom.llm.skew import join_to_unique
from graphloom.llm.staging import Staged


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _star(pairs: DataFrame, tag: str) -> tuple[DataFrame, Staged, Staged]:
    """The (u, v) pairs with ``_m``, the least partner of u; the tables to drop when that is read."""
    links = Staged(pairs, tag + "-pairs")
    total = links.df.count()
    least = Staged(links.df.groupBy("u").agg(F.min("v").alias("_m"), F.count("*").alias("_n")), tag + "-least")
    joined = join_to_unique(links.df, total, least.df, ["u"], "_n")
    return joined, links, least


def _round(edges: Staged) -> Staged:
    """A large-star step, then a small-star step."""
    joined, *used = _star(_both_ways(edges.df), "large")
    larger = joined.filter("v > u").select(F.col("v").alias("u"), F.least("u", "_m").alias("v"))
    large = Staged(larger.filter("u <> v").distinct(), "large")
    for x in used:
        x.drop()
    ordered = large.df.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    joined, *used = _star(ordered, "small")
    smaller = joined.select(F.col("v").alias("u"), F.col("_m").alias("v")).unionByName(joined.select("u", F.col("_m").alias("v")))
    small = Staged(smaller.filter("u <> v").distinct(), "small")
    for x in [*used, large]:
        x.drop()
    return small


def _digest(df: DataFrame) -> tuple:
    # decimal sum: 64-bit hashes must not overflow
    return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


#: Links up to which one task may handle them all: two arrays of 8 MB.
IN_ONE_TASK = 1 << 20


def _least_labels(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node of its component), by labels that are passed on along links and from the labels' own nodes."""
    nodes, place = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = place[: len(u)], place[len(u) :]
    label = np.arange(len(nodes))
    while True:
        after = label.copy()
        least = np.minimum(label[a], label[b])
        for at in (a, b, label[a], label[b]):
            np.minimum.at(after, at, least)
        after = after[after]
        if (after == label).all():
            return nodes, nodes[label]
        label = after


def _gathered(links: DataFrame) -> DataFrame:
    ship(links.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)), *((x.column(0).to_numpy(), x.column(1).to_numpy()) for x in batches)]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in _least_labels(*(np.concatenate(x) for x in zip(*parts)))], ["node", "component"])

    return links.repartition(1).mapInArrow(run, "node long, component long")


def connected_components(edges: DataFrame, *, gather: bool = False) -> DataFrame:
    """One row (node, component) for each node of ``edges`` (u, v of one orderable type).

    ``component`` is the least node that can be reached, the node itself
    included. Self-links and repeated links are allowed, links with a null end
    are ignored, an empty table gives an empty one. The number of rounds grows
    with the logarithm of the largest component; a node of very high degree is
    handled by ``join_to_unique``. With ``gather`` (of nodes of type long)
    distinct links up to IN_ONE_TASK, counted first, are handled by one task,
    which gives the same.
    """
    # written once: what finds the links may be costly
    known = edges.filter("u IS NOT NULL AND v IS NOT NULL")
    given = Staged(known.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "given")
    if gather and given.df.count() <= IN_ONE_TASK:
        found = Staged(_gathered(given.df), "components")
        given.drop()
        return found.df
    nodes = Staged(given.df.select(F.explode(F.array("u", "v")).alias("node")).distinct(), "nodes")
    now = Staged(given.df.filter("u <> v"), "edges")
    given.drop()
    state = _digest(now.df)
    while state[0]:
        after = _round(now)
        now.drop()
        now, before, state = after, state, _digest(after.df)
        if state == before:
            break
    # now a set of stars: each node but a least one has a single link, to the least
    return nodes.df.join(now.df, nodes.df.node == now.df.u, "left").select("node", F.coalesce("v", "node").alias("component"))
