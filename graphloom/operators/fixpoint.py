"""Reachability and components of a graph of any size, by rounds of joins.

Nodes are numbered by a hash of their names, which no two of them share; so
numbers are in random order whatever the names say, and edges are numbered
without a join. Each round is written to the shared folder, which ends its
lineage, and the round before is deleted: a lost executor costs a round at most.

* Labels (``_least_that_reaches``) are passed on along edges and from a label's own
  node, so that what a label covers about doubles in a round.
* Weak components hook each node to its least neighbour and contract.
* Strong components are searched forward and backward from all nodes at once.
  Each node gets the least node that leads to it and the least that it leads
  to. Where both are one node, that is its component; edges between nodes that
  do not agree in both are cut, as no cycle runs along them. With numbers in
  random order, what leads to a node within its part is halved by a round on
  average, as a pivot of quicksort does, so rounds follow the logarithm of
  the number of nodes, chains included. Before each search, trees that hang
  from a node without a way in, or out, are trimmed off whole, by doubling.

What is left of a graph goes to one linear kernel once it has at most
LOCAL_ROWS edges; parts of a larger one that are as small go to kernels in
groups of that size. Before any rounds a graph is split into its weakly
connected parts (``weak_parts``), and small ones go to kernels at once. A key with over a thousandth of the rows is joined by a
broadcast of its one partner; there are fewer than a thousand such keys.

Rounds of labels follow the logarithm of a path's length on chains, rings and
trees, and where the nodes beside a path are few; a graph that is both deep
and wide may take more, at worst as many as its longest shortest path.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import count
from operator import or_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from graphloom.functions.lineage import Staged, cut
from graphloom.functions.ship import ship
from graphloom.operators import kernels

#: Edges that one task may hold in a kernel: under a megabyte.
LOCAL_ROWS = 5_000
#: A key of over 1/HEAVY_SHARE of the rows is heavy.
HEAVY_SHARE = 1000
#: The label of what is reached, below every number's hash but one in 2**64.
_REACHED = -(1 << 63)
_PAIRS_AT_ONCE = 1 << 16
#: Edges of neighbouring sources that one task joins up at a time when a graph is split into parts.
CHUNK_ROWS = 100_000
#: Paths are shortened by rounds where more links than that, and than one task may hold, lie on paths.
PATH_ROWS = 1_000


def fits_one_task(*tables: DataFrame, times: int = 1) -> bool:
    """Whether the rows of all ``tables`` are LOCAL_ROWS, or ``times`` as many, at most."""
    left = LOCAL_ROWS * times
    for table in tables:
        # the count stops at what does not fit any more
        left -= table.limit(left + 1).count()
        if left < 0:
            return False
    return True


def _staged(df: DataFrame) -> Staged:
    return Staged(df, "round")


class Numbers:
    """The nodes' names (name, n) and how any of them is numbered."""

    def __init__(self, names: DataFrame):
        """``names`` (name) may repeat."""
        for self.seed in count():
            self.table = _staged(names.select("name", self.of("name")).distinct())
            # another hash if two names ever share a number
            if self.table.df.groupBy("n").count().filter("count > 1").isEmpty():
                return
            self.table.drop()

    def of(self, name: str | Column, alias: str = "n") -> Column:
        return F.xxhash64(F.lit(self.seed), F.col(name) if isinstance(name, str) else name).alias(alias)

    def links(self, edges: DataFrame) -> DataFrame:
        """(a, b): the distinct edges (src, dst) in numbers."""
        return edges.select(self.of("src", "a"), self.of("dst", "b")).distinct()

    def named(self, labels: DataFrame) -> DataFrame:
        """(node, label) of every name: the least name of those whose numbers have the same label; a number without label is alone."""
        placed = _staged(self.table.df.join(labels.select(F.col("node").alias("n"), "label"), "n", "left").select("name", F.coalesce("label", "n").alias("label")))
        least = _staged(placed.df.groupBy("label").agg(F.min("name").alias("_least")))
        return looked_up(placed.df, "label", least.df).select(F.col("name").alias("node"), F.col("_least").alias("label"))


def _ends(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("name"))


def looked_up(rows: DataFrame, key: str, table: DataFrame, total: int | None = None) -> DataFrame:
    """``rows`` (``total``, or counted) joined to ``table``, which has each ``key`` once: heavy keys by a broadcast of their partners."""
    total = rows.count() if total is None else total
    weights = rows.groupBy(key).count().filter(F.col("count") > max(total // HEAVY_SHARE, 100)).select(key)
    heavy = F.broadcast(table.join(F.broadcast(weights), key, "left_semi"))
    return rows.join(heavy, key).unionByName(rows.join(heavy.select(key), key, "left_anti").join(table, key))


def _kernel(rows: DataFrame, kernel: Callable, names: list[str]) -> DataFrame:
    """``kernel`` over all numbers (a, b) of ``rows`` in one task; the columns ``names`` as it gives them."""
    ship(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = [], []
        for batch in batches:
            a += batch.column(0).to_pylist()
            b += batch.column(1).to_pylist()
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in kernel(a, b)], names)

    return rows.select("a", "b").repartition(1).mapInArrow(run, ", ".join(f"{x} long" for x in names))


def _strong_of_parts(links: DataFrame, bins: int) -> DataFrame:
    """(node, label) of ``links`` (a, b, part), whose parts are small: a kernel for each of ``bins`` groups of parts."""
    ship(links.sparkSession)

    def run(rows: pa.Table) -> pa.Table:
        found = kernels.strong_labels(rows.column("a").to_pylist(), rows.column("b").to_pylist())
        return pa.table([pa.array(x, pa.int64()) for x in found], names=["node", "label"])

    return links.groupBy(F.pmod("part", F.lit(bins)).alias("bin")).applyInArrow(run, "node long, label long")


# weakly connected parts


def whole_groups(batches: Iterator[pa.RecordBatch], key: str, size: int, longest: int | None = None) -> Iterator[pa.Table]:
    """Tables of about ``size`` rows of ``batches``, which are sorted by ``key``, cut where it changes; within a key only beyond ``longest`` rows."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key)
        begin = pc.index(keys, keys[-1]).as_py()
        split = begin > 0 or bool(held) and held[-1].column(key)[-1] != keys[0]
        if rows + begin >= size and split or longest is not None and rows >= longest:
            if begin:
                held.append(batch.slice(0, begin))
            yield pa.Table.from_batches(held)
            held, rows, batch = [], 0, batch.slice(begin)
        held.append(batch)
        rows += batch.num_rows
    if held:
        yield pa.Table.from_batches(held)


def weak_parts(edges: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """``edges`` (src, dst and others) with ``part``, a number of their weakly connected part; and (part) of those of over LOCAL_ROWS edges, None if there are none.

    Names that stand near one another are mostly linked to one another, as files
    of a folder are. So edges are sorted into ranges of their sources, each task
    joins up what lies within its range, and only what leads out of a range is
    joined up by rounds of contraction. Where nothing is near, all is left to
    those. Parts may share a number, and are then one.
    """
    ship(edges.sparkSession)
    chunk = CHUNK_ROWS
    names = [*edges.columns, "root", "_out"]

    def joined_up(rows: pa.Table) -> pa.Table:
        src, dst = (rows.column(c).combine_chunks() for c in ("src", "dst"))
        known = pc.unique(pa.concat_arrays([src, dst]))
        s, d = (pc.index_in(x, known).to_numpy(zero_copy_only=False) for x in (src, dst))
        inside = pc.and_(pc.greater_equal(dst, src[0]), pc.less_equal(dst, src[-1])).to_numpy(zero_copy_only=False)
        label = kernels.least_labels(len(known), s[inside], d[inside])
        return rows.append_column("root", known.take(pa.array(label[s]))).append_column("_out", pa.array(~inside))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = root = None
        for rows in whole_groups(batches, "src", chunk, 4 * chunk):
            # a source with very many edges goes on from the table before
            going_on = pc.equal(rows.column("src"), last) if last is not None else pa.array(np.zeros(rows.num_rows, dtype=bool))
            head, rows = rows.filter(going_on), rows.filter(pc.invert(going_on))
            if head.num_rows:
                yield from head.append_column("root", pa.array([root] * head.num_rows, head.schema.field("src").type)).append_column("_out", pa.array([True] * head.num_rows)).select(names).to_batches()
            if rows.num_rows:
                rows = joined_up(rows)
                last, root = rows.column("src")[-1], rows.column("root")[-1].as_py()
                yield from rows.select(names).to_batches()

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in edges.schema)
    ranged = edges.repartitionByRange("src").sortWithinPartitions("src")
    near = _staged(ranged.mapInArrow(run, f"{fields}, root string, _out boolean")).df
    number = F.xxhash64("root")
    out = near.filter("_out").select("root", "dst").distinct()
    if out.isEmpty():
        rows = near.withColumn("part", number).drop("root", "_out")
    else:
        out = _staged(out).df
        to = out.select("dst").distinct()
        of = near.select(F.col("src").alias("dst"), "root").unionByName(near.filter("NOT _out").select("dst", "root"))
        of = of.join(to, "dst", "left_semi").distinct().withColumnRenamed("root", "_to")
        ends = _staged(to.join(of, "dst", "left").select("dst", F.coalesce("_to", "dst").alias("_to")))
        across = looked_up(out, "dst", ends.df).select(number.alias("a"), F.xxhash64("_to").alias("b")).filter("a <> b").distinct()
        labels = _staged(_contracted(_staged(across)))
        at = labels.df.select(F.col("node").alias("_n"), F.col("label").alias("_label"))
        rows = near.withColumn("_n", number).join(at, "_n", "left").withColumn("part", F.coalesce("_label", "_n")).drop("root", "_out", "_n", "_label")
    large = _staged(rows.groupBy("part").count().filter(F.col("count") > LOCAL_ROWS).select("part")).df
    return rows, None if large.isEmpty() else large


def in_parts(rows: DataFrame, large: DataFrame | None, kernel: Callable[[pa.Table], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``kernel`` over ``rows`` (part and others) but those of ``large`` parts: several whole parts of about LOCAL_ROWS rows at a time."""
    size = max(1, LOCAL_ROWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for parts in whole_groups(batches, "part", size):
            yield from kernel(parts)

    return _small(rows, large).repartition("part").sortWithinPartitions("part").mapInArrow(run, schema)


def _small(rows: DataFrame, large: DataFrame | None) -> DataFrame:
    # one row of at least LOCAL_ROWS edges each, so few
    return rows if large is None else rows.join(F.broadcast(large), "part", "left_anti")


def of_parts(rows: DataFrame, parts: DataFrame) -> DataFrame:
    """The ``rows`` of ``parts``, without that column."""
    return rows.join(F.broadcast(parts), "part", "left_semi").drop("part")


# labels


def _least_that_reaches(labels: DataFrame, links: DataFrame) -> Staged:
    """Labels (node, label) after each node took the least label of all nodes that ``links`` (a, b) lead to it from.

    Each label but ``_REACHED`` is a node that leads to its holder. So what that
    node is labelled leads there too, and is passed on as well. Further columns
    of ``labels`` are passed on with the labels, the least value of each.
    """
    now = _staged(labels)
    size, total = now.df.count(), links.count()
    values = [c for c in labels.columns if c != "node"]
    while True:
        along = looked_up(links, "a", now.df.withColumnRenamed("node", "a"), total).select(F.col("b").alias("node"), *values)
        open_ = now.df.filter((F.col("label") != _REACHED) & (F.col("label") != F.col("node"))).select("node", "label")
        named = now.df.select(F.col("node").alias("label"), *[F.col(c).alias(f"_{c}") for c in values])
        jumps = looked_up(open_, "label", named, size).select("node", *[F.col(f"_{c}").alias(c) for c in values])
        better = along.unionByName(jumps).groupBy("node").agg(*[F.min(c).alias(f"_{c}") for c in values])
        changes = [F.coalesce(F.col(f"_{c}") < F.col(c), F.lit(False)) for c in values]
        after = _staged(now.df.join(better, "node", "left").select("node", *[F.least(c, F.coalesce(f"_{c}", c)).alias(c) for c in values], reduce(or_, changes).alias("_changed")))
        now.drop()
        now = after
        changed = not now.df.filter("_changed").isEmpty()
        now.df = now.df.drop("_changed")
        if not changed:
            return now


def _turned(links: DataFrame) -> DataFrame:
    return links.select(F.col("b").alias("a"), F.col("a").alias("b"))


def _nodes(links: DataFrame) -> DataFrame:
    return links.select(F.explode(F.array("a", "b")).alias("node")).distinct()


def _shortened(links: Staged, fixed: DataFrame | None = None) -> tuple[Staged, DataFrame | None]:
    """``links`` (a, b) with paths shortened to their last node; and (node, rep) of the nodes left out, None if there are few.

    A path is of nodes that have one way in and one way out, so all of it is on
    a cycle, or reached, where its last node is. Nodes of ``fixed`` (node) are
    on none. A node is left out in a round if a coin says so of it and not of
    the next, so about a quarter go at a time: all rounds together cost some
    four times the first. What fits one task is followed to its ends there, as a
    mark that comes late to a ring whose labels are settled goes on by one node
    in a round. A ring of its own may end as one node that leads to itself.
    """
    ends = F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i"), F.col("b").alias("to")), F.struct(F.col("b").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i"), F.lit(None).cast("long").alias("to")))
    inner = links.df.select(F.inline(ends)).groupBy("node").agg(F.sum("o").alias("o"), F.sum("i").alias("i"), F.min("to").alias("to")).filter("o = 1 AND i = 1 AND node <> to").select("node", "to")
    inner = _staged(inner if fixed is None else inner.join(fixed, "node", "left_anti"))
    left = _staged(inner.df.join(inner.df.select(F.col("node").alias("to")), "to", "left_semi").select("node", "to"))
    inner.drop()
    levels: list[Staged] = []
    most = max(PATH_ROWS, LOCAL_ROWS)
    for seed in count():
        if (rows := left.df.limit(most + 1).count()) <= most:
            break
        coin = lambda c: F.xxhash64(F.lit(seed), c) > 0  # noqa: B023, E731
        picked = coin("node") & ~coin("to")
        level = _staged(left.df.filter(picked))
        onward = level.df.select(F.col("node").alias("to"), F.col("to").alias("_on"))
        after = _staged(left.df.filter(~picked).join(onward, "to", "left").select("node", F.coalesce("_on", "to").alias("to")).filter("node <> to"))
        levels.append(level)
        left.drop()
        left = after
    if 0 < rows <= LOCAL_ROWS:
        levels.append(_staged(_kernel(left.df.toDF("a", "b"), kernels.ends_of_paths, ["node", "to"])))
    if not levels:
        return links, None
    known = levels.pop().df.toDF("node", "rep")
    for level in reversed(levels):
        on = known.withColumnRenamed("node", "to")
        known = known.unionByName(_staged(level.df.join(on, "to", "left").select("node", F.coalesce("rep", "to").alias("rep"))).df)
    known = _staged(known).df
    kept = links.df.join(known.select(F.col("node").alias("a")), "a", "left_anti")
    short = _staged(kept.join(known.withColumnRenamed("node", "b"), "b", "left").select("a", F.coalesce("rep", "b").alias("b")))
    links.drop()
    return short, known


def path_places(links: DataFrame) -> DataFrame:
    """(node, tail, dist) for ``links`` (node, to), each node once as ``to``, that close no ring: the last node each leads on to, and how many steps away it is.

    A path's nodes mostly stand near one another. So each task follows links within
    its range of nodes; what leads from range to range is followed by joins
    that double the distance, where only the last node in a range is a row.
    """
    ship(links.sparkSession)
    chunk = CHUNK_ROWS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_groups(batches, "node", chunk):
            node, to = (rows.column(c).to_numpy() for c in ("node", "to"))
            at, dist = kernels.last_of_paths(node, to)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (node, node[at], dist, to[at])], ["node", "tail", "dist", "on"])

    near = _staged(links.select("node", "to").repartitionByRange("node").sortWithinPartitions("node").mapInArrow(run, "node long, tail long, dist long, on long"))
    tails = near.df.filter("node = tail").select("tail", "on")
    hops = near.df.select(F.col("node").alias("on"), F.col("tail").alias("_tail"), (F.col("dist") + 1).alias("_more"))
    now = _staged(tails.join(hops, "on", "left").select("tail", F.coalesce("_tail", "tail").alias("at"), F.coalesce("_more", F.lit(0).cast("long")).alias("more")))
    while True:
        onward = now.df.filter("at <> tail").select(F.col("tail").alias("at"), F.col("at").alias("_at"), F.col("more").alias("_more"))
        if now.df.select("at").join(onward, "at", "left_semi").isEmpty():
            break
        after = _staged(now.df.join(onward, "at", "left").select("tail", F.coalesce("_at", "at").alias("at"), (F.col("more") + F.coalesce("_more", F.lit(0))).alias("more")))
        now.drop()
        now = after
    return _staged(looked_up(near.df.select("node", "tail", "dist"), "tail", now.df).select("node", F.col("at").alias("tail"), (F.col("dist") + F.col("more")).alias("dist"))).df


def _near_joined(edges: DataFrame, start: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``edges`` (src, dst) between origins, and (node, rep) of all other nodes with the origin of each, as far as ``start`` (node) may lead.

    Nodes are sorted into ranges of their names. Each task searches its range
    from the nodes of ``start`` and from those with a way in from elsewhere. All
    ways to a node lead through its origin, so it is reached where that is
    reached, or is of ``start``. An origin is one of the nodes that searches
    begin at, or one where ways from several origins meet. What no search of its
    range comes to is not reached.
    """
    ship(edges.sparkSession)
    chunk = CHUNK_ROWS
    names = ["a", "b", "edge"]
    edges = edges.filter("src IS NOT NULL AND dst IS NOT NULL")

    def table(a: pa.Array, b: pa.Array, edge: bool) -> list[pa.RecordBatch]:
        return pa.table([a, b, pa.array(np.full(len(a), edge))], names=names).to_batches()

    def joined(rows: pa.Table) -> tuple:
        key, to, ways = (rows.column(c).combine_chunks() for c in ("key", "to", "ways"))
        known = pc.unique(key)
        of, d = (pc.fill_null(pc.index_in(x, known), -1).to_numpy(zero_copy_only=False).astype(np.int64) for x in (key, to))
        ways, is_edge = ways.to_numpy(), pc.is_valid(to).to_numpy(zero_copy_only=False)
        inside = d >= 0
        s, t = of[inside], d[inside]
        # ways in that are not seen here come from elsewhere
        unseen = np.bincount(of[~is_edge], np.maximum(ways[~is_edge], 0), len(known)) - np.bincount(t, minlength=len(known))
        begun = np.zeros(len(known), dtype=bool)
        begun[of[ways < 0]] = True
        origin = np.array(kernels.origins(kernels.targets_of(len(known), s, t), np.flatnonzero(begun | (unseen > 0)).tolist()), dtype=np.int64)
        return key, to, known, of, d, is_edge, begun, origin

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = of_last = None
        for rows in whole_groups(batches, "key", chunk, 4 * chunk):
            # a node with very many edges goes on from the table before
            going_on = pc.equal(rows.column("key"), last) if last is not None else pa.array(np.zeros(rows.num_rows, dtype=bool))
            head, rows = rows.filter(going_on), rows.filter(pc.invert(going_on))
            if head.num_rows and of_last is not None:
                to = head.column("to").combine_chunks().drop_null()
                yield from table(pa.array([of_last] * len(to), pa.string()), to, True)
            if not rows.num_rows:
                continue
            key, to, known, of, d, is_edge, begun, origin = joined(rows)
            from_ = origin[of]
            # within one origin only what leads back to a start says anything
            told = is_edge & (from_ >= 0) & ((d < 0) | (from_ != origin[d]) | begun[d])
            yield from table(known.take(pa.array(from_[told])), to.filter(pa.array(told)), True)
            others = np.flatnonzero((origin >= 0) & (origin != np.arange(len(known))))
            yield from table(known.take(pa.array(others)), known.take(pa.array(origin[others])), False)
            last = key[-1]
            of_last = known[int(from_[-1])].as_py() if from_[-1] >= 0 else None

    none = F.lit(None).cast("string")
    rows = edges.select(F.col("src").alias("key"), F.col("dst").alias("to"), F.lit(0).cast("long").alias("ways"))
    into = edges.groupBy(F.col("dst").alias("key")).agg(F.count("*").alias("ways")).select("key", none.alias("to"), "ways")
    begun = start.filter("node IS NOT NULL").distinct().select(F.col("node").alias("key"), none.alias("to"), F.lit(-1).cast("long").alias("ways"))
    ranged = rows.unionByName(into).unionByName(begun).repartitionByRange("key")
    found = _staged(ranged.sortWithinPartitions("key", F.col("to").asc_nulls_first()).mapInArrow(run, "a string, b string, edge boolean")).df
    return found.filter("edge").select(F.col("a").alias("src"), F.col("b").alias("dst")), found.filter("NOT edge").select(F.col("a").alias("node"), F.col("b").alias("rep"))


def reachable(edges: DataFrame, start: DataFrame, reverse: bool = False) -> DataFrame:
    """(node): what at least one edge (src, dst) leads to from the nodes of ``start`` (node); with ``reverse``, what leads to them."""
    edges = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")) if reverse else edges.select("src", "dst")
    if fits_one_task(edges, start):
        return _reached_names(edges, start)
    short, known = _near_joined(edges, start)
    # what leads nowhere is looked up at the end
    onward = _staged(short.join(short.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst").distinct()).df
    if fits_one_task(onward, start):
        found = _reached_names(onward, start)
    else:
        found = _reached_by_rounds(onward, start)
    begun = _staged(found.unionByName(start.select("node")).distinct()).df
    ends = _staged(short.join(begun.withColumnRenamed("node", "src"), "src", "left_semi").select(F.col("dst").alias("node")).distinct()).df
    reps = ends.unionByName(start.select("node")).distinct().withColumnRenamed("node", "rep")
    return ends.unionByName(known.join(reps, "rep", "left_semi").select("node"))


def _reached_names(edges: DataFrame, start: DataFrame) -> DataFrame:
    """``reachable`` in one task."""
    ship(edges.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(batches, schema)
        starts = rows.filter(pc.is_null(rows.column("dst"))).column("src")
        names, (s, d) = kernels.numbered_names(rows.filter(pc.is_valid(rows.column("dst"))))
        begun = pc.index_in(pc.unique(starts), names).drop_null().to_pylist()
        yield pa.RecordBatch.from_arrays([names.take(pa.array(kernels.search(kernels.targets_of(len(names), s, d), begun), pa.int64()))], ["node"])

    schema = pa.schema([("src", pa.string()), ("dst", pa.string())])
    linked = edges.filter("src IS NOT NULL AND dst IS NOT NULL")
    return linked.unionByName(start.select(F.col("node").alias("src"), F.lit(None).cast("string").alias("dst"))).repartition(1).mapInArrow(run, "node string")


def _reached_by_rounds(edges: DataFrame, start: DataFrame) -> DataFrame:
    """``reachable`` in the weakly connected parts of ``start``, in numbers."""
    rows, _ = weak_parts(edges)
    ends = rows.select("part", F.explode(F.array("src", "dst")).alias("node"))
    edges = _staged(rows.join(ends.join(start.distinct(), "node", "left_semi").select("part").distinct(), "part", "left_semi").drop("part")).df
    numbers = Numbers(_ends(edges))
    links = _staged(numbers.links(edges))
    begun = start.select(numbers.of("node", "node")).distinct()
    known = None
    if not fits_one_task(links.df, begun):
        links, known = _shortened(links, begun)
    if fits_one_task(links.df, begun):
        found = _kernel(links.df.unionByName(begun.select(F.col("node").alias("a"), F.lit(None).cast("long").alias("b"))), kernels.reached, ["n"])
    else:
        marks = begun.withColumn("_mark", F.lit(_REACHED))
        labels = _nodes(links.df).join(marks, "node", "left").select("node", F.coalesce("_mark", "node").alias("label"))
        reached = _least_that_reaches(labels, links.df).df.filter(F.col("label") == _REACHED).select(F.col("node").alias("a"))
        found = links.df.join(reached, "a", "left_semi").select(F.col("b").alias("n")).distinct()
    if known is not None:
        found = _staged(found).df
        found = found.unionByName(known.join(found.withColumnRenamed("n", "rep"), "rep", "left_semi").select(F.col("node").alias("n")))
    return numbers.table.df.join(found, "n", "left_semi").select(F.col("name").alias("node"))


def first_that_reaches(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, start): for each of ``nodes`` (node, ord) the least ord of those that ``edges`` lead to it from, its own included."""
    numbers = Numbers(nodes.select(F.col("node").alias("name")))
    own = numbers.of("node", "node")
    links = _staged(numbers.links(edges))
    found = _least_that_reaches(nodes.select(own, own.alias("label"), F.col("ord").alias("start")), links.df)
    links.drop()
    return numbers.table.df.join(found.df.select(F.col("node").alias("n"), "start"), "n").select(F.col("name").alias("node"), "start")


def closure(edges: DataFrame) -> DataFrame:
    """All pairs (src, dst) that a path of one edge or more connects.

    Small weakly connected parts are searched in kernels, whose pairs are written nowhere before they are returned.
    """
    edges = edges.select("src", "dst")
    if fits_one_task(edges):
        return _closure_at_once(edges)
    rows, large = weak_parts(edges)
    pairs = in_parts(rows, large, _closure_of_parts, "src string, dst string")
    return pairs if large is None else pairs.unionByName(_closure_at_once(of_parts(rows, large)))


def _closure_of_parts(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    names, (s, d) = kernels.numbered_names(rows)
    out = [list(dict.fromkeys(x)) for x in kernels.targets_of(len(names), s, d)]
    a: list[int] = []
    b: list[int] = []
    for start in range(len(out)):
        ends = kernels.search(out, [start])
        b += ends
        a += [start] * len(ends)
        if len(a) >= _PAIRS_AT_ONCE or start == len(out) - 1:
            yield pa.RecordBatch.from_arrays([names.take(pa.array(x, pa.int64())) for x in (a, b)], ["src", "dst"])
            a, b = [], []


def _closure_at_once(edges: DataFrame) -> DataFrame:
    """``closure`` in numbers: by searches from a broadcast table, or by joins that double the distance."""
    numbers = Numbers(_ends(edges))
    steps = _staged(numbers.links(edges))
    if fits_one_task(steps.df):
        pairs = _closure_by_searches(steps.df)
    else:
        # new pairs, those at a distance over half of what is covered, are extended by all pairs: the distance doubles in each round
        new, seen = steps, steps
        while not new.df.isEmpty():
            onward = seen.df.select(F.col("a").alias("b"), F.col("b").alias("_next"))
            more = _staged(new.df.join(onward, "b").select("a", F.col("_next").alias("b")).distinct().join(seen.df, ["a", "b"], "left_anti"))
            both = _staged(seen.df.unionByName(more.df))
            for x in {new, seen} - {steps}:
                x.drop()
            new, seen = more, both
        pairs = seen.df
    named = lambda c, to: numbers.table.df.select(F.col("n").alias(c), F.col("name").alias(to))
    return pairs.join(named("a", "src"), "a").join(named("b", "dst"), "b").select("src", "dst")


def _closure_by_searches(steps: DataFrame) -> DataFrame:
    """``closure`` of at most LOCAL_ROWS edges, which are broadcast; every task searches from its share of the nodes."""
    spark = ship(steps.sparkSession)
    got = steps.toArrow()
    nodes, numbers = kernels.numbered(got.column("a").to_pylist(), got.column("b").to_pylist())
    shared = spark.sparkContext.broadcast((nodes, kernels.targets_of(len(nodes), *numbers)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every, out = shared.value
        taken = pa.array(every, pa.int64())
        a: list[int] = []
        b: list[int] = []

        def flush() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([taken.take(pa.array(x, pa.int64())) for x in (a, b)], ["a", "b"])
            a.clear()
            b.clear()
            return made

        for batch in batches:
            for start in batch.column(0).to_pylist():
                ends = kernels.search(out, [start])
                b.extend(ends)
                a.extend([start] * len(ends))
                if len(a) >= _PAIRS_AT_ONCE:
                    yield flush()
        yield flush()

    return spark.range(len(nodes)).mapInArrow(run, "a long, b long")


# weak components


def weak_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, label): the least node that edges, taken in both directions, connect a node of ``nodes`` (node) to."""
    numbers = Numbers(nodes.select(F.col("node").alias("name")))
    return numbers.named(_contracted(_staged(numbers.links(edges).filter("a <> b"))))


def _contracted(links: Staged) -> DataFrame:
    """(node, label) of the nodes of ``links``.

    Each node takes its least neighbour, if that is less, as the one it stands
    behind, and then three times whom that one stands behind: with numbers in
    random order most of them are at their tree's root by then. Links between
    those are what is left.
    """
    levels: list[Staged] = []
    while not links.df.isEmpty() and not fits_one_task(links.df):
        both = links.df.unionByName(_turned(links.df))
        up = _staged(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("_b")).select("node", F.least("node", "_b").alias("up")))
        for _ in range(3):
            onward = up.df.select(F.col("node").alias("up"), F.col("up").alias("_on"))
            after = _staged(looked_up(up.df, "up", onward).select("node", F.col("_on").alias("up")))
            up.drop()
            up = after
        levels.append(up)
        half = looked_up(links.df, "a", up.df.withColumnRenamed("node", "a")).select(F.col("up").alias("a"), "b")
        whole = looked_up(half, "b", up.df.withColumnRenamed("node", "b")).select("a", F.col("up").alias("b"))
        after = _staged(whole.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        links.drop()
        links = after
    labels = _staged(_kernel(links.df, kernels.weak_labels, ["node", "label"]))
    for up in reversed(levels):
        placed = looked_up(up.df, "up", _every(up.df, labels.df)).select("node", "label")
        after = _staged(placed)
        labels.drop()
        labels = after
    return labels.df


def _every(up: DataFrame, labels: DataFrame) -> DataFrame:
    """(up, label) of each root of ``up``: its label, or itself where no link was left."""
    return up.select("up").distinct().join(labels.withColumnRenamed("node", "up"), "up", "left").select("up", F.coalesce("label", "up").alias("label"))


# strong components


def _trimmed(links: Staged) -> tuple[Staged, bool]:
    """``links`` (a, b) without trees that hang from a node with no way in; and whether there was any such node.

    A node with a single way in has all its ancestors on one path. If that path
    starts at a node without a way in, none of them is on a cycle. Whom a node
    hangs from is followed at twice the distance in each round, until a round
    finds no further node to trim.
    """
    into = links.df.groupBy(F.col("b").alias("node")).agg(F.count("*").alias("_k"), F.min("a").alias("_a"))
    out = links.df.select(F.col("a").alias("node")).distinct()
    known = out.join(into, "node", "full_outer").select("node", F.when(F.col("_k") == 1, F.col("_a")).alias("up"), F.col("_k").isNull().alias("dead"))
    now, dead = _staged(known), 0
    size = now.df.count()
    while (found := now.df.filter("dead").count()) > dead:
        dead = found
        above = now.df.select(F.col("node").alias("up"), F.col("up").alias("_on"), F.col("dead").alias("_dead"))
        hung = now.df.filter("up IS NOT NULL AND NOT dead")
        rest = now.df.filter("up IS NULL OR dead")
        after = _staged(looked_up(hung, "up", above, size).select("node", F.col("_on").alias("up"), F.col("_dead").alias("dead")).unionByName(rest))
        now.drop()
        now = after
    if not dead:
        now.drop()
        return links, False
    gone = now.df.filter("dead").select(F.col("node").alias("a"))
    # a dead node's ways in come from dead nodes only
    left = _staged(links.df.join(gone, "a", "left_anti"))
    links.drop()
    now.drop()
    return left, True


def _found_strong(links: Staged) -> Iterator[DataFrame | None]:
    """Tables (node, label) of strong components, none of them twice, as they are found; first None if a cycle is certain before.

    Nodes that are in no table are components of their own.
    """
    told = False
    while not links.df.isEmpty():
        if fits_one_task(links.df):
            yield _kernel(links.df, kernels.strong_labels, ["node", "label"])
            return
        links, had_source = _trimmed(links)
        if links.df.isEmpty():
            return
        if not had_source and not told:
            # all have a way in, so going back never ends: there is a cycle
            told = True
            yield None
        turned, had_sink = _trimmed(_turned_staged(links))
        if turned.df.isEmpty():
            return
        if not had_sink and not told:
            told = True
            yield None
        links = _turned_staged(turned)
        if fits_one_task(links.df):
            continue
        own = _nodes(links.df).select("node", F.col("node").alias("label"))
        before = _least_that_reaches(own, links.df)
        behind = _least_that_reaches(own, _turned(links.df))
        cells = _staged(before.df.withColumnRenamed("label", "f").join(behind.df.withColumnRenamed("label", "g"), "node"))
        before.drop()
        behind.drop()
        yield cells.df.filter("f = g").select("node", F.col("f").alias("label"))
        open_ = cells.df.filter("f <> g").select("node", F.xxhash64("f", "g").alias("part"))
        source, target = open_.withColumnRenamed("node", "a"), open_.select(F.col("node").alias("b"), F.col("part").alias("_part"))
        half = looked_up(links.df, "a", source)
        left = _staged(looked_up(half, "b", target).filter("part = _part").select("a", "b", "part"))
        links.drop()
        # parts of the size of a kernel's are done at once
        sizes = left.df.groupBy("part").agg(F.count("*").alias("_k"))
        small = _staged(sizes.filter(F.col("_k") <= LOCAL_ROWS))
        done = small.df.agg(F.sum("_k")).first()[0] or 0
        if done:
            yield _strong_of_parts(left.df.join(small.df, "part", "left_semi"), -(-done // LOCAL_ROWS))
        links = _staged(left.df.join(small.df, "part", "left_anti").select("a", "b"))


def _turned_staged(links: Staged) -> Staged:
    """The same table with its columns' roles exchanged; nothing is written."""
    links.df = _turned(links.df)
    return links


def _strong_names(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    names, (s, d) = kernels.numbered_names(rows)
    text = names.to_pylist()
    found = [[text[i] for i in members] for _, members in kernels.strong(kernels.targets_of(len(text), s, d)) if len(members) > 1]
    yield pa.RecordBatch.from_arrays([pa.array([x for m in found for x in m], pa.string()), pa.array([x for m in found for x in [min(m)] * len(m)], pa.string())], ["node", "label"])


def strong_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, label): the least node of the strongly connected component of each of ``nodes`` (node)."""
    edges = edges.filter("src <> dst").select("src", "dst")
    if fits_one_task(edges):
        return _strong_at_once(nodes, edges)
    rows, large = weak_parts(edges)
    several = in_parts(rows, large, _strong_names, "node string, label string")
    if large is not None:
        left = _staged(of_parts(rows, large)).df
        several = several.unionByName(_strong_at_once(_ends(left).distinct().withColumnRenamed("name", "node"), left).filter("node <> label"))
        # a component's least node is no row of its own there
        several = several.unionByName(several.select(F.col("label").alias("node"), "label")).distinct()
    several = _staged(several).df
    return nodes.join(several, "node", "left").select("node", F.coalesce("label", "node").alias("label"))


def _strong_at_once(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``strong_components`` in numbers, by rounds beyond LOCAL_ROWS edges."""
    numbers = Numbers(nodes.select(F.col("node").alias("name")))
    links, known = _shortened(_staged(numbers.links(edges).filter("a <> b")))
    labels = nodes.sparkSession.createDataFrame([], "node long, label long")
    if known is not None:
        # rings of their own, each as one node
        labels = cut(links.df.filter("a = b").select(F.col("a").alias("node"), F.col("a").alias("label")))
        rings = labels
        links = _staged(links.df.filter("a <> b"))
    for found in _found_strong(links):
        if found is not None:
            labels = labels.unionByName(cut(found))
    if known is not None:
        several = labels.groupBy("label").count().filter("count > 1").select("label").unionByName(rings.select("label")).distinct()
        cyclic = _staged(labels.join(several, "label", "left_semi").select(F.col("node").alias("rep"), "label").distinct()).df
        labels = labels.unionByName(known.join(cyclic, "rep").select("node", "label"))
    return numbers.named(labels)


def on_a_cycle(edges: DataFrame) -> bool:
    """Whether there is a cycle. Trees are trimmed off first; it ends as soon as a cycle is certain or no edge is left."""
    if not edges.filter("src = dst").isEmpty():
        return True
    numbers = Numbers(_ends(edges))
    for found in _found_strong(_staged(numbers.links(edges))):
        if found is None or not found.filter("node <> label").isEmpty():
            return True
    return False
