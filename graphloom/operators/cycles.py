"""Strongly connected components and circular dependencies of a graph."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import replace
from itertools import accumulate, islice, takewhile

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from graphloom.functions.lineage import cut
from graphloom.functions.ship import ship
from graphloom.operators import fixpoint
from graphloom.operators.fixpoint import first_that_reaches, fits_one_task, in_parts, looked_up, of_parts, on_a_cycle, path_places, reachable, strong_components, weak_parts
from graphloom.operators.graph import Graph
from graphloom.operators.kernels import Component, numbered_names, strong
from graphloom.schema import CYCLES_SCHEMA

MAX_CYCLES = 1000
#: A search in exact order is one pass in linear time: one task takes so many times LOCAL_ROWS, some tens of MB.
SEARCH_TIMES = 50


def _numbered_edges(graph: Graph) -> DataFrame:
    """(a, pos, b): each edge by its ends' places in the graph's order."""
    places = graph.nodes.select(F.col("file_path").alias("dst"), F.col("ord").alias("b"))
    return looked_up(graph.edges.select(F.col("src_ord").alias("a"), "pos", "dst"), "dst", places).select("a", "pos", "b")


def _searched(graph: Graph, leading: bool) -> DataFrame:
    """(start, nth, ord, place): each node's place in its component, the components in search order within ``start``, the place that the search began from.

    A search from one place visits what no place before it leads to. So what
    has the same least place that leads to it is searched apart from all else;
    it is one task's work, in numbers. With ``leading``, nodes that lead to no
    component of several nodes are left out, and so are components of one: no
    search comes back from them, so the order of the others stays.
    """
    ship(graph.nodes.sparkSession)
    nodes = graph.nodes.select(F.col("file_path").alias("node"), "ord")
    edges = _numbered_edges(graph)
    bins = 1
    if fits_one_task(nodes, graph.edges, times=SEARCH_TIMES):
        # a search of all nodes in their order gives the same
        placed, inside = nodes.select(F.lit(0).alias("start"), "ord"), edges.withColumn("start", F.lit(0))
    else:
        ways = graph.edges
        if leading:
            labels = cut(strong_components(nodes.select("node"), graph.edges))
            several = labels.groupBy("label").count().filter("count > 1").select("label")
            lead = cut(reachable(graph.edges, labels.join(several, "label", "left_semi").select("node"), reverse=True))
            nodes = nodes.join(lead, "node", "left_semi")
            # what leads to such a node is one
            ways = ways.join(lead.withColumnRenamed("node", "dst"), "dst", "left_semi")
        placed = cut(first_that_reaches(nodes, ways).join(nodes, "node").select("start", "ord"))
        source, target = placed.select("start", F.col("ord").alias("a")), placed.select(F.col("start").alias("_start"), F.col("ord").alias("b"))
        inside = cut(looked_up(looked_up(edges, "a", source), "b", target).filter("start = _start").select("a", "pos", "b", "start"))
        bins = -(-max(1, placed.count()) // max(1, fixpoint.LOCAL_ROWS))
    bin_ = F.pmod(F.xxhash64("start"), F.lit(bins)).alias("bin")
    rows = placed.select(bin_, F.col("ord").alias("a"), F.lit(None).cast("long").alias("pos"), F.lit(None).cast("long").alias("b")).unionByName(inside.select(bin_, "a", "pos", "b"))

    def run(rows: pa.Table) -> pa.Table:
        alone = pc.is_null(rows.column("b"))
        ords, edges = rows.filter(alone).column("a").to_pylist(), rows.filter(pc.invert(alone))
        c = Component(zip(ords, ords), zip(*(edges.column(x).to_pylist() for x in ("a", "pos", "b"))))
        out: list[list[int]] = [[], [], [], []]
        for nth, (start, members) in enumerate(strong(c.out)):
            if len(members) > 1 or not leading:
                for x, values in zip(out, ([c.order[start]] * len(members), [nth] * len(members), c.named(members), range(len(members)))):
                    x += values
        return pa.table([pa.array(x, pa.int64()) for x in out], names=["start", "nth", "ord", "place"])

    return rows.groupBy("bin").applyInArrow(run, "start long, nth long, ord long, place long")


def _component(rows: pa.Table) -> Component:
    alone = pc.is_null(rows.column("to"))
    nodes, edges = rows.filter(alone), rows.filter(pc.invert(alone))
    return Component(zip(nodes.column("ord").to_pylist(), nodes.column("name").to_pylist()), zip(*(edges.column(c).to_pylist() for c in ("ord", "pos", "to"))))


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.table([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


_CHAINS = pa.schema([("chain", pa.list_(pa.string())), ("length", pa.int32()), ("rank", pa.list_(pa.int64()))])


def _whole(rows: pa.Table) -> Component:
    """The graph of ``rows`` (src, src_ord, pos, dst). A node without a row as source is a dead end, so its place among the others does not matter."""
    names, (s, d) = numbered_names(rows)
    ords = dict(zip(s.tolist(), rows.column("src_ord").to_pylist()))
    beyond = max(ords.values()) + 1
    ords = [ords.get(i, beyond + i) for i in range(len(names))]
    edges = [(ords[a], pos, ords[b]) for a, pos, b in zip(s.tolist(), rows.column("pos").to_pylist(), d.tolist()) if pos is not None]
    return Component(zip(ords, names.to_pylist()), edges)


def _within(graph: Graph, edges: DataFrame) -> Graph:
    """The graph of some of its parts' edges, with the nodes at their ends."""
    edges = cut(edges)
    ends = edges.select(F.explode(F.array("src", "dst")).alias("file_path")).distinct()
    return replace(graph, nodes=graph.nodes.join(ends, "file_path", "left_semi"), edges=edges).cut()


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


_MEMBERS = pa.schema([("members", pa.list_(pa.string())), ("rank", pa.list_(pa.int64()))])


def _components_of_parts(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    c = _whole(rows)
    yield _batch([(c.named(members), [c.order[start], i]) for i, (start, members) in enumerate(strong(c.out))], _MEMBERS)


def find_strong_components(graph: Graph) -> DataFrame:
    """(members, rank): every component in search order, members last discovered first; order by ``rank``."""
    if fits_one_task(graph.nodes, graph.edges):
        return _components_at_once(graph)
    # a row for each node besides: it has a place in the order, and may be without edges
    own = graph.nodes.select(F.col("file_path").alias("src"), F.col("file_path").alias("dst"), F.col("ord").alias("src_ord"), F.lit(None).cast("long").alias("pos"))
    rows, large = weak_parts(graph.edges.select("src", "dst", "src_ord", "pos").unionByName(own))
    found = in_parts(rows, large, _components_of_parts, "members array<string>, rank array<long>")
    if large is None:
        return found
    left = cut(of_parts(rows, large))
    nodes = left.filter("pos IS NULL").select(F.col("src").alias("file_path"), F.col("src_ord").alias("ord"))
    return found.unionByName(_components_at_once(replace(graph, nodes=nodes, edges=left.filter("pos IS NOT NULL"))))


def _components_at_once(graph: Graph) -> DataFrame:
    """``find_strong_components`` by one search, or by one for each starting place."""
    names = graph.nodes.select("ord", F.col("file_path").alias("name"))
    each = _searched(graph, leading=False).join(names, "ord")
    found = each.groupBy("start", "nth").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "name"))), lambda x: x["name"]).alias("members"))
    return found.select("members", F.array("start", "nth").alias("rank"))


def strong_component_labels(graph: Graph) -> DataFrame:
    """(file_path, component) as sets, in DataFrame operations only: the component's least path stands for it."""
    found = strong_components(graph.nodes.select(F.col("file_path").alias("node")), graph.edges)
    return found.select(F.col("node").alias("file_path"), F.col("label").alias("component"))


def self_loops(graph: Graph) -> DataFrame:
    return graph.edges.filter("src = dst").select(F.array("src", "src").alias("chain"), F.lit(1).alias("length"), F.array(F.lit(0).cast("long"), F.col("src_ord")).alias("rank"))


def _cycles_at_once(graph: Graph) -> DataFrame:
    """The chains of ``find_cycles`` but self-loops, of a graph that one task holds."""
    ship(graph.nodes.sparkSession)
    places = graph.nodes.select(F.col("file_path").alias("dst"), F.col("ord").alias("to"))
    nodes = graph.nodes.select("ord", F.col("file_path").alias("name"), F.lit(None).cast("long").alias("pos"), F.lit(None).cast("long").alias("to"))
    edges = graph.edges.join(places, "dst").select(F.col("src_ord").alias("ord"), F.lit(None).cast("string").alias("name"), "pos", "to")

    def run(rows: pa.Table) -> pa.Table:
        c = _component(rows)
        found = ((start, members, i) for i, (start, members) in enumerate(strong(c.out)) if len(members) > 1)
        return _table([(c.named(c.first_cycle(members[0], set(members))), len(members), [1, c.order[start], i]) for start, members, i in found], _CHAINS)

    return nodes.unionByName(edges).groupBy(F.lit(0).alias("all")).applyInArrow(run, CYCLES_SCHEMA)


def _chains_of_parts(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    c = _whole(rows)
    found = ((start, members, i) for i, (start, members) in enumerate(strong(c.out)) if len(members) > 1)
    yield _batch([(c.named(c.first_cycle(members[0], set(members))), len(members), [1, c.order[start], i]) for start, members, i in found], _CHAINS)


def find_cycles(graph: Graph) -> DataFrame:
    """(chain, length, rank): first the self-loops in node order, then one chain for each component of several nodes.

    ``length`` is the component's size, which its chain may fall short of.
    The order of a depth-first search decides which chain it is. Small weakly
    connected parts are searched whole, several in a task. Of a large one
    ``_searched`` finds where each component is left last, and then each
    component is searched for itself, in one task.
    """
    if fits_one_task(graph.nodes, graph.edges):
        return self_loops(graph).unionByName(_cycles_at_once(graph))
    # self-loops too: a component's chain may be one
    rows, large = weak_parts(graph.edges.select("src", "dst", "src_ord", "pos"))
    found = self_loops(graph).unionByName(in_parts(rows, large, _chains_of_parts, CYCLES_SCHEMA))
    if large is None:
        return found
    firsts = rows.join(F.broadcast(large), "part", "left_semi").groupBy("part").agg(F.min("src_ord").alias("node")).select("node")
    return found.unionByName(_cycles_of_large(_within(graph, of_parts(rows, large)), firsts))


def _hidden(edges: DataFrame, firsts: DataFrame) -> DataFrame:
    """(node, rep, back): nodes of ``edges`` (a, pos, b) that a search passes on its way to ``rep``, and how many steps before it.

    A node with one way in and one way out is on a path. Of each path three nodes
    are not hidden: the last one, which a search leaves it by; the least one,
    as a search may begin there; and the one before that, as a search may end
    there. So a search without hidden nodes visits the others in the same order,
    and what it discovers last is not hidden. ``firsts`` (node), one of each
    weakly connected part, are on no path, as a part may be a ring.
    """
    out = edges.groupBy(F.col("a").alias("node")).agg(F.count("*").alias("o"), F.min("b").alias("to"))
    into = edges.groupBy(F.col("b").alias("node")).agg(F.count("*").alias("i"))
    inner = cut(out.filter("o = 1 AND node <> to").join(into.filter("i = 1"), "node").join(F.broadcast(firsts), "node", "left_anti").select("node", "to"))
    placed = path_places(inner)
    least = placed.groupBy("tail").agg(F.min("node").alias("least"), F.min_by("dist", "node").alias("at"))
    before = inner.select(F.col("to").alias("least"), F.col("node").alias("before"))
    paths = cut(least.join(before, "least", "left"))
    rep = F.when(F.col("dist") > F.col("at") + 1, F.struct(F.col("before").alias("rep"), (F.col("dist") - F.col("at") - 1).alias("back")))
    rep = rep.when((F.col("dist") > 0) & (F.col("dist") < F.col("at")), F.struct(F.col("tail").alias("rep"), F.col("dist").alias("back")))
    return cut(looked_up(placed, "tail", paths).select("node", rep.alias("_r")).filter("_r IS NOT NULL").select("node", "_r.rep", "_r.back"))


def _without_ends(edges: DataFrame) -> DataFrame:
    """``edges`` (a, pos, b) in which a search finds the same cycles, in order: without nodes that lead nowhere and nodes that nothing leads to.

    Of the latter those stay that are the least to lead to some node, as only
    there a search that finds a cycle may begin.
    """
    while not fits_one_task(edges, times=SEARCH_TIMES):
        total = edges.count()
        ways = edges.filter("a <> b")
        sources = edges.join(ways.select(F.col("b").alias("a")).distinct(), "a", "left_anti")
        least = sources.filter("a <> b").groupBy("b").agg(F.min("a").alias("a")).select("a").distinct()
        gone = sources.select("a").distinct().join(least, "a", "left_anti")
        edges = cut(edges.join(ways.select(F.col("a").alias("b")).distinct(), "b", "left_semi").join(gone, "a", "left_anti").select("a", "pos", "b"))
        if edges.count() > total * 0.9:
            break
    return edges


#: Each node of a chain by its place there; ``length`` is the component's size.
_STEPS = "start long, nth long, length long, i long, node long"


def _steps(c: Component, first: int, members: set[int], passed: dict[int, int], start: int, nth: int) -> list[tuple]:
    """Rows of _STEPS of a component's first chain, with a step more for each of ``passed`` nodes on the way to one."""
    length = sum(1 + passed.get(c.order[x], 0) for x in members)
    chain = c.named(c.first_cycle(first, members))
    places = [0, *accumulate(1 + passed.get(x, 0) for x in chain[1:])]
    return [(start, nth, length, i, x) for i, x in zip(places, chain)]


def _steps_table(rows: list[tuple]) -> pa.Table:
    names = [x.split()[0] for x in _STEPS.split(", ")]
    return pa.table([pa.array(list(x), pa.int64()) for x in zip(*rows)] if rows else [pa.array([], pa.int64())] * len(names), names=names)


def _cycles_of_large(graph: Graph, firsts: DataFrame) -> DataFrame:
    """``find_cycles`` but self-loops of weakly connected parts beyond a kernel's size; ``firsts`` (node) is one place of each part.

    What is long is paths, whose nodes are searched for without being held: chains
    are found in numbers, without hidden nodes, which take their places by a join.
    """
    if fits_one_task(graph.nodes, graph.edges, times=SEARCH_TIMES):
        return _cycles_at_once(graph)
    edges = cut(_numbered_edges(graph))
    hidden = _hidden(edges, firsts)
    kept = edges.join(hidden.select(F.col("node").alias("a")), "a", "left_anti")
    to = hidden.select(F.col("node").alias("b"), "rep")
    short = _without_ends(cut(kept.join(to, "b", "left").select("a", "pos", F.coalesce("rep", "b").alias("b"))))
    passed = hidden.groupBy(F.col("rep").alias("a")).agg(F.count("*").alias("pos"))
    passed = passed.join(short.select("a").distinct(), "a", "left_semi").withColumn("b", F.lit(None).cast("long"))
    ship(short.sparkSession)

    def parts(rows: pa.Table) -> tuple[dict[int, int], list[tuple]]:
        alone = pc.is_null(rows.column("b"))
        nodes, edges = rows.filter(alone), rows.filter(pc.invert(alone))
        return dict(zip(nodes.column("a").to_pylist(), nodes.column("pos").to_pylist())), list(zip(*(edges.column(x).to_pylist() for x in ("a", "pos", "b"))))

    if fits_one_task(short, times=SEARCH_TIMES):

        def run(rows: pa.Table) -> pa.Table:
            known, ways = parts(rows)
            every = {x for a, _, b in ways for x in (a, b)}
            c = Component(zip(every, every), ways)
            return _steps_table([s for i, (start, members) in enumerate(strong(c.out)) if len(members) > 1 for s in _steps(c, members[0], set(members), known, c.order[start], i)])

        steps = short.unionByName(passed).groupBy(F.lit(0).alias("all")).applyInArrow(run, _STEPS)
    else:
        names = graph.nodes.select(F.col("ord").alias("a"), F.col("file_path").alias("src"))
        named = short.join(names, "a").join(names.toDF("b", "dst"), "b").select("src", "dst", F.col("a").alias("src_ord"), "pos")
        found = cut(_searched(_within(graph, named), leading=True))
        key = F.struct("start", "nth").alias("component")
        source, target = found.select(key, F.col("ord").alias("a")), found.select(F.struct("start", "nth").alias("_component"), F.col("ord").alias("b"))
        inside = looked_up(looked_up(short, "a", source), "b", target).filter("component = _component").select("component", "a", "pos", "b", F.lit(None).cast("long").alias("first"))
        first = found.filter("place = 0").select(key, F.col("ord").alias("first"), *[F.lit(None).cast("long").alias(x) for x in ("a", "pos", "b")])
        extra = passed.join(source, "a").select("component", "a", "pos", "b", F.lit(None).cast("long").alias("first"))

        def each(key: tuple, rows: pa.Table) -> pa.Table:
            first = pc.max(rows.column("first")).as_py()
            known, ways = parts(rows.filter(pc.is_null(rows.column("first"))))
            c = Component(((x, x) for x in {a for a, _, _ in ways}), ways)
            component = key[0].as_py()
            return _steps_table(_steps(c, c.place[first], set(range(len(c.order))), known, component["start"], component["nth"]))

        steps = inside.unionByName(first).unionByName(extra).groupBy("component").applyInArrow(each, _STEPS)
    steps = cut(steps)
    on_the_way = steps.filter("i > 0").withColumnRenamed("node", "rep").join(hidden, "rep").select("start", "nth", "length", (F.col("i") - F.col("back")).alias("i"), "node")
    names = graph.nodes.select(F.col("ord").alias("node"), F.col("file_path").alias("name"))
    rows = looked_up(steps.unionByName(on_the_way), "node", names).select("start", "nth", "length", "i", "name")

    def chain(key: tuple, rows: pa.Table) -> pa.Table:
        name = rows.column("name").take(pc.sort_indices(rows.column("i"))).combine_chunks()
        start, nth, length = (x.as_py() for x in key)
        whole = pa.ListArray.from_arrays(pa.array([0, len(name)], pa.int32()), name)
        return pa.table([whole, pa.array([length], pa.int32()), pa.array([[1, start, nth]], pa.list_(pa.int64()))], schema=_CHAINS)

    return rows.groupBy("start", "nth", "length").applyInArrow(chain, CYCLES_SCHEMA)


def normalise_cycle(chain: Column) -> Column:
    """The chain turned to start at its least element, and closed; one of at most one element stays."""
    closed = F.get(chain, F.lit(0)).eqNullSafe(F.get(chain, F.size(chain) - 1))
    body = F.when(closed, F.slice(chain, 1, F.greatest(F.size(chain) - 1, F.lit(1)))).otherwise(chain)
    at = F.array_position(body, F.array_min(body)).cast("int")
    turned = F.concat(F.slice(body, at, F.size(body)), F.slice(body, 1, at - 1), F.array(F.array_min(body)))
    return F.when(F.size(chain) <= 1, chain).otherwise(turned)


def deduplicate_cycles(cycles: DataFrame) -> DataFrame:
    """Of (chain, rank) with the same normalised chain, the one of lowest rank."""
    return cycles.withColumn("_key", normalise_cycle(F.col("chain"))).groupBy("_key").agg(F.min_by("chain", "rank").alias("chain"), F.min("rank").alias("rank")).drop("_key")


def _cyclic(c: Component) -> Iterator[Component]:
    """The strong components of ``c`` that hold a cycle, each for itself."""
    for _, members in strong(c.out):
        if len(members) > 1 or members[0] in c.out[members[0]]:
            inner = set(members)
            yield Component([(c.order[i], c.names[i]) for i in members], [(c.order[i], pos, c.order[to]) for i in members for pos, to in enumerate(c.out[i]) if to in inner])


def _strong_rows(graph: Graph) -> DataFrame:
    """(label, ord, name, pos, to): the nodes and inner edges of each strong component with a cycle."""
    ship(graph.nodes.sparkSession)
    nodes = graph.nodes.select(F.col("file_path").alias("node"), "ord")
    labels = cut(strong_components(nodes.select("node"), graph.edges).join(nodes, "node").select("label", "ord", F.col("node").alias("name")))
    source, target = labels.select("label", F.col("ord").alias("a")), labels.select(F.col("label").alias("_label"), F.col("ord").alias("b"))
    inside = cut(looked_up(looked_up(_numbered_edges(graph), "a", source), "b", target).filter("label = _label").select("label", F.col("a").alias("ord"), "pos", F.col("b").alias("to")))
    cyclic = inside.select("label").distinct()
    empty = lambda kind: F.lit(None).cast(kind)
    return cut(inside.withColumn("name", empty("string")).unionByName(labels.join(cyclic, "label", "left_semi").select("label", "ord", "name", empty("long").alias("pos"), empty("long").alias("to"))))


def find_all_simple_cycles(graph: Graph, max_cycles: int = MAX_CYCLES) -> DataFrame:
    """(chain, length, rank): every elementary cycle, ``length`` its number of steps.

    ``max_cycles`` bounds the hits before equal cycles are merged: a cycle of
    k nodes is hit k times, once from each. Hits count in the order of the
    starting node, then of target positions, over the whole graph.
    Each cycle lies in one strong component, which is one task's work; those of
    small weakly connected parts are found with all of their part. First
    each cycle is taken once, at its least node, and counted k times; a task
    stops where that exceeds the cap. Only if all tasks together exceed it,
    the single hits are enumerated, as many as the cap in each component. As
    each cycle taken is a hit from its least node, the first of them, as many as
    the cap, tell up to which starting node hits count: only parts with such
    nodes are searched for them.
    """
    rows, large = weak_parts(graph.edges.select("src", "dst", "src_ord", "pos"))
    large_rows = None if large is None else _strong_rows(_within(graph, of_parts(rows, large)))

    def once(c: Component) -> list[tuple]:
        taken, hits = [], 0
        for i, (start, chain) in enumerate((start, chain) for start in range(len(c.order)) for chain in c.cycles_through(start, start)):
            taken.append((c.named(chain), len(chain) - 1, [c.order[start], i]))
            hits += len(chain) - 1
            if hits > max_cycles:
                break
        return taken

    def taken(take, rows: DataFrame, large_rows: DataFrame | None) -> DataFrame:
        def of_small(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            for c in _cyclic(_whole(rows)):
                yield _batch(take(c), _CHAINS)

        found = in_parts(rows, large, of_small, CYCLES_SCHEMA)
        if large_rows is None:
            return found
        return found.unionByName(large_rows.groupBy("label").applyInArrow(lambda rows: _table(take(_component(rows)), _CHAINS), CYCLES_SCHEMA))

    found = cut(taken(once, rows, large_rows))
    if (found.agg(F.sum("length")).first()[0] or 0) <= max_cycles:
        return found
    known, last = found.select(F.col("rank")[0].alias("start")).orderBy("start").limit(max_cycles).agg(F.count("*"), F.max("start")).first()
    if known < max_cycles:
        last = None

    def each(c: Component) -> list[tuple]:
        starts = takewhile(lambda start: last is None or c.order[start] <= last, range(len(c.order)))
        hits = ((c.named(chain), len(chain) - 1, [c.order[start], i]) for start in starts for i, chain in enumerate(c.cycles_through(start)))
        return list(islice(hits, max_cycles))

    def begun(rows: DataFrame, key: str, place: str) -> DataFrame:
        return rows if last is None else rows.join(rows.filter(F.col(place) <= last).select(key).distinct(), key, "left_semi")

    hits = taken(each, begun(rows, "part", "src_ord"), None if large_rows is None else begun(large_rows, "label", "ord"))
    kept = deduplicate_cycles(hits.select("chain", "rank").orderBy("rank").limit(max_cycles))
    return kept.select("chain", (F.size("chain") - 1).alias("length"), "rank")


def find_cycles_involving_file(graph: Graph, path: str) -> DataFrame:
    """The cycles of ``find_cycles`` whose chain holds ``path``."""
    return find_cycles(graph).filter(F.array_contains(F.slice("chain", 1, F.size("chain") - 1), path))


def find_longest_cycle(graph: Graph) -> DataFrame:
    """The first of greatest ``length``; no row without cycles."""
    return find_cycles(graph).orderBy(F.desc("length"), "rank").limit(1)


def has_cycles(graph: Graph) -> bool:
    """Whether a self-loop or a component of several nodes exists; no component is labelled where there is none."""
    return on_a_cycle(graph.edges)
