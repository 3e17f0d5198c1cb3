import random
import time

import pytest
from pyspark.sql import functions as F

from graphloom.operators import cycles as C, fixpoint
from graphloom.operators.fixpoint import closure, strong_components, weak_components
from graphloom.operators.graph import Graph
from graphloom.operators.kernels import Component, origins, search, strong


def graph(spark, text):
    return Graph.from_edges(spark, [tuple(x) for x in text.split()])


def column(df, name="file_path"):
    return [r[name] for r in df.collect()]


GOLDEN = {
    "ab bc ca": ([("cabc", 3)], ["abca"]),
    "ab ba cd dc": ([("bab", 2), ("dcd", 2)], ["aba", "cdc"]),
    "ab ba bc cb": ([("cbc", 3)], ["aba", "bcb"]),
    "ab ba aa": ([("aa", 1), ("bab", 2)], ["aba", "aa"]),
    "ab bb ba": ([("bb", 1), ("bb", 2)], ["aba", "bb"]),
    "ab bc ca cd dc": ([("dcd", 4)], ["abca", "cdc"]),
    "ex xu ab bc ca xa": ([("cabc", 3)], ["abca"]),
    "ab ac bd cd": ([], []),
}


@pytest.mark.parametrize("edges", GOLDEN)
def test_golden_cycles(spark, edges):
    g = graph(spark, edges)
    chains, simple = GOLDEN[edges]
    assert [("".join(r.chain), r.length) for r in C.find_cycles(g).orderBy("rank").collect()] == chains
    assert ["".join(r.chain) for r in C.find_all_simple_cycles(g).orderBy("rank").collect()] == simple
    assert C.has_cycles(g) == bool(chains)


@pytest.mark.parametrize("edges", ["ab ba bc cb", "ex xu ab bc ca xa", "ab ac bd cd"])
def test_golden_cycles_by_rounds(spark, monkeypatch, edges):
    monkeypatch.setattr(fixpoint, "LOCAL_ROWS", 0)
    g = graph(spark, edges)
    chains, simple = GOLDEN[edges]
    assert [("".join(r.chain), r.length) for r in C.find_cycles(g).orderBy("rank").collect()] == chains
    assert ["".join(r.chain) for r in C.find_all_simple_cycles(g).orderBy("rank").collect()] == simple
    assert C.has_cycles(g) == bool(chains)


def test_complete_graph_and_cap(spark):
    g = graph(spark, " ".join(a + b for a in "abcd" for b in "abcd" if a != b))
    assert [("".join(r.chain), r.length) for r in C.find_cycles(g).collect()] == [("dabcd", 4)]
    assert C.find_all_simple_cycles(g).count() == 20
    pairs = Graph.from_edges(spark, [(a, b) for i in range(10) for a, b in ((f"a{i}", f"b{i}"), (f"b{i}", f"a{i}"))])
    assert C.find_all_simple_cycles(pairs, 5).count() == 3


def test_ring_of_101(spark, either_way):
    g = Graph.from_edges(spark, [(f"file{i}", f"file{(i + 1) % 101}") for i in range(101)]).cut()
    (found,) = C.find_cycles(g).collect()
    assert found.length == 101 and len(found.chain) == 102
    assert column(g.transitive_dependencies("file7")).__len__() == 101 and C.has_cycles(g)


def test_ring_of_101_in_time(spark):
    g = Graph.from_edges(spark, [(f"file{i}", f"file{(i + 1) % 101}") for i in range(101)]).cut()
    C.find_cycles(g).collect()
    began = time.time()
    assert C.find_cycles(g).count() == 1
    assert time.time() - began < 5  # of a shared machine; the bench has the figure


@pytest.fixture
def tables(monkeypatch):
    """The number of tables that rounds write, as one entry each; no part is left to a kernel."""
    monkeypatch.setattr(fixpoint, "LOCAL_ROWS", 0)
    written = []
    whole = fixpoint._staged
    monkeypatch.setattr(fixpoint, "_staged", lambda df: written.append(1) or whole(df))
    return written


def test_rounds_follow_the_logarithm(spark, tables):
    """Ascending chains: ten times the length takes some more tables, not ten times as many."""
    taken = {}
    for size in (10, 100, 1000):
        names = [f"{x:04}" for x in range(size)]
        g = Graph.from_edges(spark, list(zip(names, names[1:]))).cut()
        nodes = g.nodes.select(F.col("file_path").alias("node"))
        for what, ask, want in (
            ("strong", lambda: strong_components(nodes, g.edges).filter("node <> label").count(), 0),
            ("weak", lambda: weak_components(nodes, g.edges).select("label").distinct().count(), 1),
            ("reached", lambda: g.transitive_dependencies(names[0]).count(), size - 1),
            ("cycle", lambda: C.has_cycles(g), False),
        ):
            if size == 100 and what != "strong":
                continue
            tables.clear()
            assert ask() == want
            taken.setdefault(what, []).append(len(tables))
    assert taken.pop("strong")[2] < 25
    assert all(long - short < 35 for short, long in taken.values())


def test_rounds_of_a_ladder_and_a_ring(spark, tables):
    """No node has a single way in, so nothing but labels and parts gets forward."""
    names = [f"{x:03}" for x in range(60)]
    ladder = Graph.from_edges(spark, [(names[i], names[j]) for i in range(60) for j in (i + 1, i + 2) if j < 60]).cut()
    nodes = ladder.nodes.select(F.col("file_path").alias("node"))
    assert strong_components(nodes, ladder.edges).filter("node <> label").count() == 0 and len(tables) < 130
    ring = ladder.add_edges([(names[-1], names[0])]).cut()
    tables.clear()
    assert strong_components(nodes, ring.edges).select("label").distinct().count() == 1 and len(tables) < 60


def test_cycle_is_certain_without_labels(spark, tables, monkeypatch):
    monkeypatch.setattr(fixpoint, "_least_that_reaches", None)
    ring = [(f"r{i}", f"r{(i + 1) % 50}") for i in range(50)]
    assert C.has_cycles(Graph.from_edges(spark, [*ring, *((f"r{i}", f"leaf{i}") for i in range(50))]))
    tree = [(f"t{i}", f"t{2 * i + j}") for i in range(1, 60) for j in (0, 1)]
    assert not C.has_cycles(Graph.from_edges(spark, tree))


def by_kernel(edges):
    """Components in search order and chains of a graph, by the kernel over all of it."""
    names = list(dict.fromkeys(x for e in edges for x in e))
    place = {x: i for i, x in enumerate(names)}
    c = Component(enumerate(names), [(place[a], i, place[b]) for i, (a, b) in enumerate(dict.fromkeys(edges))])
    components = [[names[i] for i in members] for _, members in strong(c.out)]
    chains = []
    for members in (m for m in components if len(m) > 1):
        inner = [(a, b) for a, b in dict.fromkeys(edges) if a in members and b in members]
        own = [x for x in names if x in members]
        at = {x: i for i, x in enumerate(own)}
        part = Component(enumerate(own), [(at[a], i, at[b]) for i, (a, b) in enumerate(inner)])
        chains.append(part.named(part.first_cycle(at[members[0]], set(range(len(own))))))
    return components, chains


@pytest.mark.parametrize("seed", range(2))
def test_search_order_by_rounds_is_the_kernels(spark, monkeypatch, seed):
    """Weak components of several strong ones, some entered from many sides."""
    monkeypatch.setattr(fixpoint, "LOCAL_ROWS", 3 * seed)
    rng = random.Random(seed)
    names = [f"{i:03}" for i in range(90)]
    rng.shuffle(names)
    edges = []
    for at in range(0, 90, 6):
        part = names[at : at + 6]
        edges += [(rng.choice(part), rng.choice(part)) for _ in range(9)]
        edges += [(rng.choice(names[:at]), rng.choice(part)) for _ in range(3) if at]
    rng.shuffle(edges)
    g = Graph.from_edges(spark, edges).cut()
    components, chains = by_kernel(edges)
    assert sum(len(x) > 1 for x in components) > 5
    assert column(C.find_strong_components(g).orderBy("rank"), "members") == components
    loops = [[x, x] for x in dict.fromkeys(x for e in edges for x in e) if (x, x) in edges]
    assert column(C.find_cycles(g).orderBy("rank"), "chain") == loops + chains


def test_blocked_search_is_the_plain_one():
    rng = random.Random(12)

    def plain(out, start, path):
        for to in out[path[-1]]:
            if to == start:
                yield [*path, start]
            elif to not in path:
                yield from plain(out, start, [*path, to])

    for _ in range(200):
        n = rng.randint(1, 7)
        edges = list({(rng.randrange(n), rng.randrange(n)) for _ in range(rng.randint(1, 3 * n))})
        c = Component(enumerate(range(n)), [(a, i, b) for i, (a, b) in enumerate(edges)])
        for start in range(n):
            assert list(c.cycles_through(start)) == list(plain(c.out, start, [start]))
            assert list(c.cycles_through(start, start)) == [x for x in plain(c.out, start, [start]) if min(x) == start]
    # each dead end once: a plain search would take two to the 40th steps
    steps = [(2 * i, 0, 2 * i + 2) for i in range(40)] + [(2 * i, 1, 2 * i + 1) for i in range(40)] + [(2 * i + 1, 0, 2 * i + 2) for i in range(40)]
    dead = Component(enumerate(range(83)), [(82, 0, 0), (82, 1, 81), (81, 0, 82), *steps])
    assert list(dead.cycles_through(82)) == [[82, 81, 82]]


def test_cycles_of_complete_graphs_and_the_cap(spark):
    names = "abcdefgh"
    g = Graph.from_edges(spark, [(a, b) for a in names for b in names if a != b]).cut()
    assert C.find_all_simple_cycles(g, 10**6).count() == 16_064
    # one hit less: the last one, from the last node to itself
    small = Graph.from_edges(spark, [(a, b) for a in "abcd" for b in "abcd"]).cut()
    hits = 4 + 6 * 2 + 8 * 3 + 6 * 4
    ranked = lambda cap: ["".join(r.chain) for r in C.find_all_simple_cycles(small, cap).orderBy("rank").collect()]
    assert len(ranked(hits)) == 24 and ranked(hits - 1) == ranked(hits)[:-1]


def test_involving_and_longest(spark):
    g = graph(spark, "ab ba bc cb")
    assert C.find_cycles_involving_file(g, "a").count() == 0 and C.find_cycles_involving_file(g, "b").count() == 1
    long = graph(spark, "ab ba cd de ef fc")
    assert [r.length for r in C.find_longest_cycle(long).collect()] == [4]
    assert C.find_longest_cycle(graph(spark, "ab")).count() == 0


def test_lookups(spark):
    g = graph(spark, "ab ac ad bc ae ab")
    assert g.has_node("a") and not g.has_node("z") and g.has_edge("a", "b") and not g.has_edge("b", "a")
    assert column(g.ordered_nodes()) == list("abcde")
    assert [(r.src, r.dst) for r in g.ordered_edges().collect()] == [("a", "b"), ("a", "c"), ("a", "d"), ("a", "e"), ("b", "c")]
    assert column(g.dependencies("a")) == ["b", "c", "d", "e"] and column(g.dependents("c")) == ["a", "b"] and column(g.dependents("zz")) == []
    assert g.node_count() == 5 and g.edge_count() == 5
    (row,) = g.node("b").collect()
    assert row.dependencies == ["c"] and row.dependents == ["a"] and g.node("zz").count() == 0


def test_transitive(spark):
    g = graph(spark, "ab bc cd")
    assert sorted(column(g.transitive_dependencies("a"))) == ["b", "c", "d"] and sorted(column(g.transitive_dependents("d"))) == ["a", "b", "c"]
    assert sorted(column(graph(spark, "ab bc ca").transitive_dependencies("a"))) == ["a", "b", "c"]
    assert column(g.transitive_dependencies("zz")) == []


def test_changes(spark):
    g = graph(spark, "ab bc").with_root_dir("/r")
    less = g.remove_node("b")
    assert column(less.ordered_nodes()) == ["a", "c"] and less.edge_count() == 0 and less.root_dir == "/r"
    assert g.remove_edge("a", "b").node_count() == 3 and g.remove_edge("x", "y").edge_count() == 2
    more = g.add_edge("c", "c").add_node("z").add_node("a").add_edge("a", "b")
    assert column(more.ordered_nodes()) == ["a", "b", "c", "z"] and more.edge_count() == 3
    assert g.clear().node_count() == 0 and g.clear().root_dir == "/r"


def test_round_trip(spark, tmp_path):
    graph(spark, "ab bc").with_root_dir("/r").write(str(tmp_path / "g"))
    back = Graph.read(spark, str(tmp_path / "g"))
    assert back.root_dir == "/r" and column(back.ordered_nodes()) == ["a", "b", "c"] and back.edge_count() == 2


def test_degrees(spark):
    g = graph(spark, "ab ac ad bc ae bd cd").add_node("o")
    assert [(r.file, r["count"]) for r in g.top_dependencies(3).collect()] == [("a", 4), ("b", 2), ("c", 1)]
    assert [(r.file, r["count"]) for r in g.top_dependents(2).collect()] == [("d", 3), ("c", 2)]
    assert len(g.top_dependencies(100).collect()) == 6 and g.top_dependencies(0).count() == 0
    assert column(g.orphans()) == ["o"] and column(g.leaves()) == ["a"] and sorted(column(g.roots())) == ["d", "e"]
    looped = graph(spark, "aa")
    assert not column(looped.orphans()) + column(looped.leaves()) + column(looped.roots())


def brute(n, edges):
    reach = {(a, b) for a, b in edges}
    while True:
        more = {(a, d) for a, b in reach for c, d in edges if b == c} - reach
        if not more:
            return reach
        reach |= more


@pytest.fixture(params=["one task", "rounds"])
def either_way(request, monkeypatch):
    """Small graphs by the kernels, and by the rounds of joins that large ones take."""
    if request.param == "rounds":
        monkeypatch.setattr(fixpoint, "LOCAL_ROWS", 0)


def weak(edges):
    label = {x: x for e in edges for x in e}
    for _ in label:
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    return label


def test_random_graphs(spark, either_way):
    """Closure, components and cycles of many small graphs at once, as parts of one."""
    rng = random.Random(4)
    edges, expect_reach, expect_scc = [], set(), {}
    for g in range(25):
        n = rng.randint(2, 7)
        names = [f"{g:02}{c}" for c in "abcdefg"[:n]]
        own = {(rng.choice(names), rng.choice(names)) for _ in range(rng.randint(1, 2 * n))}
        edges += sorted(own)
        reach = brute(n, own)
        expect_reach |= reach
        for x in {x for e in own for x in e}:
            expect_scc[x] = min([x] + [y for a, y in reach if a == x and (y, x) in reach])
    big = Graph.from_edges(spark, edges)
    assert {(r.src, r.dst) for r in closure(big.edges).collect()} == expect_reach
    nodes = big.nodes.select(F.col("file_path").alias("node"))
    assert {r.node: r.label for r in strong_components(nodes, big.edges).collect()} == expect_scc
    assert {r.node: r.label for r in weak_components(nodes, big.edges).collect()} == weak(edges)
    for start in rng.sample(sorted(expect_scc), 3):
        assert set(column(big.transitive_dependencies(start))) == {b for a, b in expect_reach if a == start}
        assert set(column(big.transitive_dependents(start))) == {a for a, b in expect_reach if b == start}
    assert C.has_cycles(big)
    assert sorted(map(sorted, column(C.find_strong_components(big), "members"))) == sorted(sorted(k for k, v in expect_scc.items() if v == c) for c in set(expect_scc.values()))
    chains = C.find_all_simple_cycles(big, 10**6).collect()
    edge_set = set(edges)
    assert all((a, b) in edge_set for r in chains for a, b in zip(r.chain, r.chain[1:])) and len({tuple(r.chain) for r in chains}) == len(chains)


def test_deep_chain_and_ring():
    n = 200_000
    chain = Component([(i, f"n{i:06}") for i in range(n)], [(i, i, i + 1) for i in range(n - 1)])
    assert sum(1 for _ in strong(chain.out)) == n
    ring = Component([(i, f"n{i:06}") for i in range(n)], [(i, i, (i + 1) % n) for i in range(n)])
    ((_, members),) = strong(ring.out)
    assert len(ring.first_cycle(members[0], set(members))) == n + 1


def test_normalise(spark):
    df = spark.createDataFrame([(["c", "a", "b", "c"],), (["a"],), ([],), (["b", "b"],), (["b", "c", "a"],)], "chain array<string>")
    once = df.select(C.normalise_cycle(F.col("chain")).alias("chain"))
    assert column(once, "chain") == [["a", "b", "c", "a"], ["a"], [], ["b", "b"], ["a", "b", "c", "a"]]
    assert column(once.select(C.normalise_cycle(F.col("chain")).alias("chain")), "chain") == column(once, "chain")


def test_empty_graph(spark):
    g = Graph.empty(spark)
    assert C.find_cycles(g).count() == 0 and not C.has_cycles(g) and g.top_dependencies().count() == 0 and C.find_strong_components(g).count() == 0


def test_small_parts_take_no_rounds(spark, monkeypatch):
    """Many small parts of a graph that no task holds: the same results as of one task, without labels passed on by rounds."""
    rng = random.Random(9)
    edges = []
    for at in range(40):
        names = [f"{at // 2:02}{x}{at}" for x in "abcde"]
        edges += [(rng.choice(names), rng.choice(names)) for _ in range(7)]
    rng.shuffle(edges)
    g = Graph.from_edges(spark, edges).cut()
    nodes = g.nodes.select(F.col("file_path").alias("node"))
    start = edges[0][0]
    asked = [
        lambda: column(C.find_cycles(g).orderBy("rank"), "chain"),
        lambda: column(C.find_strong_components(g).orderBy("rank"), "members"),
        lambda: sorted(strong_components(nodes, g.edges).collect()),
        lambda: sorted(closure(g.edges).collect()),
        lambda: sorted(column(g.transitive_dependencies(start)) + column(g.transitive_dependents(start))),
    ]
    want = [ask() for ask in asked]
    monkeypatch.setattr(fixpoint, "LOCAL_ROWS", 20)
    monkeypatch.setattr(fixpoint, "CHUNK_ROWS", 15)
    monkeypatch.setattr(C, "SEARCH_TIMES", 1)
    monkeypatch.setattr(fixpoint, "_least_that_reaches", None)
    assert [ask() for ask in asked] == want


def test_parts_of_a_source_with_many_edges(spark, monkeypatch):
    """A source whose edges take several tables at once, and targets that are sources elsewhere."""
    monkeypatch.setattr(fixpoint, "CHUNK_ROWS", 3)
    edges = [("m", f"{x}{i}") for x in "az" for i in range(30)] + [(f"a{i}", f"b{i}") for i in range(30)] + [("c", "d"), ("y", "c"), ("e", "e")]
    rows, _ = fixpoint.weak_parts(spark.createDataFrame(edges, "src string, dst string"))
    label = weak(edges)
    parts = {(r.part, label[r.src]) for r in rows.collect()}
    assert len(parts) == len({a for a, _ in parts}) == len(set(label.values())) == 3


def test_long_paths_are_shortened(spark, monkeypatch):
    """Rings, chains both ways and a ring of its own, of 400 nodes in all: few tables of labels, the same results as of one task."""
    path = lambda x, n: [(f"{x}{i:03}", f"{x}{i + 1:03}") for i in range(n)]
    edges = path("r", 150) + [("r150", "r000"), ("r070", "c000")] + path("c", 120) + [(b, a) for a, b in path("d", 80)] + [("d000", "r010")]
    own = path("o", 50) + [("o050", "o000"), ("p", "q"), ("q", "p")]
    g = Graph.from_edges(spark, edges + own).cut()
    nodes = g.nodes.select(F.col("file_path").alias("node"))
    asked = [lambda: sorted(strong_components(nodes, g.edges).collect())]
    asked += [lambda x=x: sorted(column(g.transitive_dependencies(x))) for x in ("d080",)]
    asked += [lambda x=x: sorted(column(g.transitive_dependents(x))) for x in ("c050",)]
    want = [ask() for ask in asked]
    monkeypatch.setattr(fixpoint, "LOCAL_ROWS", 40)
    monkeypatch.setattr(fixpoint, "PATH_ROWS", 10)
    monkeypatch.setattr(fixpoint, "_least_that_reaches", None)
    assert [ask() for ask in asked] == want


def _trails(n: int, seed: int = 0) -> list[tuple[str, str]]:
    """A ring, a chain behind it, and nodes that point at a hub before it, by random names; with ``seed``, links across."""
    rng = random.Random(seed)
    names = [f"n{i:04d}" for i in range(4 * n)]
    if seed:
        rng.shuffle(names)
    ring, chain, spokes, others = (names[i * n : (i + 1) * n] for i in range(4))
    edges = [*zip(ring, [*ring[1:], ring[0]]), *zip(chain, chain[1:]), (ring[0], chain[0]), (spokes[0], ring[0])]
    edges += [(x, spokes[0]) for x in spokes[1:]] + [(x, chain[0]) for x in others]
    edges += [(rng.choice(names), rng.choice(names)) for _ in range(2 * min(seed, 5))]
    edges = list(dict.fromkeys(edges))
    if seed:
        rng.shuffle(edges)
    return edges


def test_paths_that_fit_one_task_are_left_out_whole(spark, monkeypatch):
    """A ring behind a chain, a ring of its own, and more links beside them than a task holds: labels pass no node of a path."""
    monkeypatch.setattr(fixpoint, "LOCAL_ROWS", 90)
    node = F.xxhash64
    ring, chain, own, ends = ([f"{x}{i:02}" for i in range(n)] for x, n in (("r", 40), ("c", 30), ("o", 15), ("e", 50)))
    pairs = [*zip(ring, [*ring[1:], ring[0]]), *zip(chain, [*chain[1:], ring[0]]), *zip(own, [*own[1:], own[0]]), *((chain[-1], x) for x in ends)]
    edges = spark.createDataFrame(pairs, "src string, dst string")
    links = fixpoint.Staged(edges.select(node("src").alias("a"), node("dst").alias("b")), "round")
    start = spark.createDataFrame([(chain[0],)], "node string").select(node("node").alias("node"))
    short, known = fixpoint._shortened(links, start)
    # ring[0] to itself by way of the ring's last node, the chain by way of its last but one to ring[0], the other ring as one node, the ends
    assert short.df.count() == 2 + 3 + 1 + 50 and known.count() == 38 + 27 + 14
    assert known.select("node").distinct().count() == 79 and known.join(known.select(F.col("node").alias("rep")), "rep").isEmpty()


def test_reach_along_near_names_takes_no_rounds(spark, tables, monkeypatch):
    """A ring, a chain and hubs of neighbouring names: each range is searched in a task, few tables are written and no path is shortened."""
    g = Graph.from_edges(spark, _trails(40)).cut()
    asked = [lambda: sorted(column(g.transitive_dependencies("n0085"))), lambda: sorted(column(g.transitive_dependents("n0075")))]
    want = [["n%04d" % i for i in range(81)], ["n%04d" % i for i in range(75)] + ["n%04d" % i for i in range(80, 160)]]
    monkeypatch.setattr(fixpoint, "LOCAL_ROWS", 40)
    monkeypatch.setattr(fixpoint, "CHUNK_ROWS", 20)
    monkeypatch.setattr(fixpoint, "_shortened", None)
    assert [ask() for ask in asked] == want and len(tables) <= 8


@pytest.mark.parametrize("local, chunk", [(0, 3), (12, 10)])
def test_reach_by_ranges_is_the_plain_search(spark, monkeypatch, local, chunk):
    """Several starts, one of them in no edge, repeated edges, self-loops and nodes whose edges take several tables."""
    rng = random.Random(local + chunk)
    names = [f"{i:02}" for i in range(60)]
    edges = [(rng.choice(names), rng.choice(names)) for _ in range(50)]
    edges += [(x, y) for x, y in zip(names, names[1:]) if rng.random() < 0.6] + [("30", x) for x in names[::3]] + [(x, "11") for x in names[20::5]] + edges[:9]
    starts = ["07", "44", "zz", "44", "30"]
    table, start = spark.createDataFrame(edges, "src string, dst string"), spark.createDataFrame([(x,) for x in starts], "node string")
    monkeypatch.setattr(fixpoint, "LOCAL_ROWS", local)
    monkeypatch.setattr(fixpoint, "CHUNK_ROWS", chunk)
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    held = spark.conf.get(batch)
    spark.conf.set(batch, "4")
    try:
        pairs = brute(60, set(edges))
        assert sorted(column(fixpoint.reachable(table, start), "node")) == sorted({b for a, b in pairs if a in starts})
        assert sorted(column(fixpoint.reachable(table, start, True), "node")) == sorted({a for a, b in pairs if b in starts})
    finally:
        spark.conf.set(batch, held)


def test_origins_are_found_where_ways_meet():
    rng = random.Random(6)
    for _ in range(300):
        n = rng.randint(1, 9)
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(rng.randint(1, 2 * n))]
        out = [[b for a, b in edges if a == x] for x in range(n)]
        starts = rng.sample(range(n), rng.randint(1, n))
        every = {*starts, *search(out, starts)}
        found = origins(out, starts)
        for x in range(n):
            # without a node's origin nothing else leads there
            assert (found[x] >= 0) == (x in every)
            if x in every and found[x] != x:
                less = [[b for b in ends if b != found[x]] for ends in out]
                assert x not in search(less, [s for s in starts if s != found[x]]) and x not in starts
        # meeting places that are too many: each node its own
        few = origins(out, starts, 1)
        assert few == found or few == [x if x in every else -1 for x in range(n)]


def test_chain_of_a_long_ring_takes_no_label_rounds(spark, monkeypatch):
    g = Graph.from_edges(spark, _trails(40)).cut()
    want = sorted((r["rank"][:2], r["chain"], r["length"]) for r in C.find_cycles(g).collect())
    monkeypatch.setattr(fixpoint, "LOCAL_ROWS", 30)
    monkeypatch.setattr(fixpoint, "CHUNK_ROWS", 7)
    monkeypatch.setattr(C, "SEARCH_TIMES", 1)
    monkeypatch.setattr(C, "first_that_reaches", None)
    assert sorted((r["rank"][:2], r["chain"], r["length"]) for r in C.find_cycles(g).collect()) == want
    assert [x[2] for x in want] == [40]


@pytest.mark.parametrize("seed", [1, 3])
def test_hidden_nodes_keep_the_search_order(spark, monkeypatch, seed):
    g = Graph.from_edges(spark, _trails(15, seed)).cut()
    found = lambda: [(r["chain"], r["length"]) for r in sorted(C.find_cycles(g).collect(), key=lambda r: r["rank"])]
    want = found()
    monkeypatch.setattr(fixpoint, "LOCAL_ROWS", 12)
    monkeypatch.setattr(fixpoint, "CHUNK_ROWS", 5)
    # the rest in one task, or by rounds
    monkeypatch.setattr(C, "SEARCH_TIMES", 8 if seed % 3 else 1)
    assert found() == want


def test_hits_are_searched_where_the_cap_ends_only(spark, monkeypatch):
    """Parts whose nodes come after the last start that counts are not searched for single hits."""
    monkeypatch.setattr(fixpoint, "LOCAL_ROWS", 8)
    g = Graph.from_edges(spark, [(f"n{i:02}{a}", f"n{i:02}{b}") for i in range(40) for a, b in ("ab", "bc", "ca", "ba")])
    read = []
    in_parts = C.in_parts
    monkeypatch.setattr(C, "in_parts", lambda rows, *more: read.append(rows.count()) or in_parts(rows, *more))
    found = [(r.chain, r.rank[0]) for r in C.find_all_simple_cycles(g, 7).orderBy("rank").collect()]
    # of each part 3 hits of the ring and 2 of the pair, from a: the ring, the pair; from b: the ring, the pair; from c: the ring
    assert [x for x, _ in found] == [["n00a", "n00b", "n00c", "n00a"], ["n00a", "n00b", "n00a"], ["n01a", "n01b", "n01c", "n01a"], ["n01a", "n01b", "n01a"]]
    assert read[0] == 160 and read[1] <= 16


def test_hits_of_large_parts_under_the_cap(spark, monkeypatch):
    """The same hits count where all parts are large ones."""
    g = Graph.from_edges(spark, [(f"n{i}{a}", f"n{i}{b}") for i in range(6) for a, b in ("ab", "bc", "ca", "ba")])
    asked = lambda cap: ["".join(r.chain) for r in C.find_all_simple_cycles(g, cap).orderBy("rank").collect()]
    want = asked(7)
    split, kept = C.weak_parts, C.deduplicate_cycles
    monkeypatch.setattr(C, "weak_parts", lambda edges: (split(edges)[0], split(edges)[0].select("part").distinct()))
    starts = []
    monkeypatch.setattr(C, "deduplicate_cycles", lambda hits: starts.extend(r.s for r in hits.select(F.col("rank")[0].alias("s")).collect()) or kept(hits))
    assert asked(7) == want == ["n0an0bn0cn0a", "n0an0bn0a", "n1an1bn1cn1a", "n1an1bn1a"]
    assert len(starts) == 7
