"""Registered graph queries over the whole ``events`` table, with DuckDB SQL for each.

Three graphs, in which each event is a node and gives at least one edge; a
node's place in the order is its event's number:

* ``linked``: an event leads to the one that ``props.k`` names in its hundred,
  and an ``error`` event to its successor there too. Components of up to a
  hundred nodes, with overlapping cycles.
* ``single``: the first of these edges only, so that each component has one
  cycle, whose exact chain SQL can find.
* ``trails``: all clicks on one ring, all views on one chain and all signups on
  one backwards, all errors and purchases pointing at a hub. Depth, a giant
  component and hubs that grow with the table.

The source corpus has one file for each node of ``single``, with an import for
each edge, so that parsing and resolving it must give that graph again.
Enumeration of elementary cycles is the feature that is exponential; in
``linked`` their number grows in proportion to the table.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from graphloom.functions.lineage import cut, shared_root
from graphloom.functions.ordering import with_index
from graphloom.functions.parse import imports_of, with_imports
from graphloom.functions.paths import basename, dirname, is_external, language_of, normalise, relative, should_ignore
from graphloom.operators import cycles as C, viewer as V
from graphloom.operators.fixpoint import closure, weak_components
from graphloom.operators.graph import Graph
from graphloom.operators.resolve import candidates, resolve_imports
from graphloom.plans import report as R
from graphloom.plans.analyze import AnalysisResult, analyze_sources, build_graph, graph_stats
from graphloom.plans.cases import ALIASES, ALIAS_CASES, ALIAS_FILES, BASE_URL, FILE_NAMES, FORMS, GIT_LINES, LISTED, PATHS, PATTERNS, SPECIFIERS, WALKED, values_sql
from graphloom.schema import DEFAULT_EXTENSIONS, DEFAULT_IGNORE_DIRS, EXTENSION_TO_LANGUAGE, AnalyzerOptions
from graphloom.sources.scan import default_ignore_patterns, gitignore_glob, is_listed_path, is_source_path, supported_extensions

#: Above the number of hits in any supplied table: the cap is tested by a query of its own.
MANY = 10_000_000
CAP = 60


def _name(number):
    return F.concat(F.lit("e"), F.lpad(number.cast("string"), 12, "0"))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(a, k, t): number, link and type of each event that has a number and a link."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "event_type", "props")
    return events.select(F.col("event_id").alias("a"), F.get_json_object("props", "$.k").cast("long").alias("k"), F.col("event_type").alias("t")).filter("a IS NOT NULL AND k IS NOT NULL")


def _graph(pairs: DataFrame, root: str = "/p") -> Graph:
    pairs = cut(pairs.distinct())
    edges = pairs.select(_name(F.col("a")).alias("src"), _name(F.col("b")).alias("dst"), F.col("a").alias("src_ord"), F.col("b").alias("pos"))
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("ord")).distinct().select(_name(F.col("ord")).alias("file_path"), "ord")
    return Graph(nodes, edges, root).cut()


def _hundred(a, n):
    return F.floor(a / 100) * 100 + n


def single(spark: SparkSession, sf_dir: str) -> Graph:
    return _graph(_events(spark, sf_dir).select("a", _hundred(F.col("a"), F.col("k")).alias("b")))


def linked(spark: SparkSession, sf_dir: str) -> Graph:
    ev = _events(spark, sf_dir)
    ways = F.array(_hundred(F.col("a"), F.col("k")), F.when(F.col("t") == "error", _hundred(F.col("a"), (F.col("a") + 1) % 100)))
    return _graph(ev.select("a", F.explode(ways).alias("b")).filter("b IS NOT NULL"))


def trails(spark: SparkSession, sf_dir: str) -> Graph:
    ev = cut(_events(spark, sf_dir).select("a", "t"))
    firsts = ev.groupBy().pivot("t", ["click", "view", "error"]).agg(F.min("a"))
    # the next and the one before of the same type: places by a distributed sort, then a join of neighbours
    placed = cut(with_index(ev, ["t", "a"], "i"))
    at = lambda step: placed.select("t", (F.col("i") - step).alias("i"), F.col("a").alias("b"))
    forward = placed.filter("t IN ('click', 'view')").join(at(1), ["t", "i"]).select("a", "b")
    backward = placed.filter("t = 'signup'").join(at(-1), ["t", "i"]).select("a", "b")
    last = ev.filter("t = 'click'").agg(F.max("a").alias("a")).filter("a IS NOT NULL")
    lone = F.broadcast(firsts)  # one row
    closing = last.crossJoin(lone).select("a", F.col("click").alias("b"))
    to_hub = ev.filter("t = 'error'").crossJoin(lone).select("a", F.when(F.col("a") == F.col("error"), F.col("click")).otherwise(F.col("error")).alias("b"))
    to_view = ev.filter("t = 'purchase'").crossJoin(lone).select("a", F.col("view").alias("b"))
    over = firsts.select(F.col("click").alias("a"), F.col("view").alias("b"))
    pairs = forward
    for x in (backward, closing, to_hub, to_view, over):
        pairs = pairs.unionByName(x)
    return _graph(pairs.filter("a IS NOT NULL AND b IS NOT NULL"))


def busiest(graph: Graph) -> str:
    """The source of most edges, the least name of equals."""
    row = graph.edges.groupBy("src").count().orderBy(F.desc("count"), "src").first()
    return row["src"] if row else ""


def _least_on_cycle(g: Graph) -> str:
    row = C.strong_component_labels(g).filter("file_path <> component").agg(F.min("component")).first()
    return row[0] or ""


def _of_type(g: Graph, spark: SparkSession, sf_dir: str, kind: str, last: bool) -> str:
    found = _events(spark, sf_dir).filter(F.col("t") == kind).agg((F.max if last else F.min)("a").alias("a")).select(_name(F.col("a"))).first()[0]
    return found or ""


def _one(df: DataFrame, value, name: str) -> DataFrame:
    return df.sparkSession.createDataFrame([(value,)], f"{name} {'boolean' if isinstance(value, bool) else 'long'}")


def source_corpus(graph: Graph) -> DataFrame:
    """(path, language, content) whose imports are the graph's edges."""
    line = F.concat(F.lit("import { x } from './"), F.col("dst"), F.lit("';"))
    lines = graph.edges.groupBy(F.col("src").alias("file_path")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", line.alias("t")))), lambda x: x["t"]), "\n").alias("content"))
    every = graph.nodes.join(lines, "file_path", "left")
    return every.select(_path(F.col("file_path")).alias("path"), F.lit("typescript").alias("language"), F.coalesce("content", F.lit("// no imports")).alias("content"))


def _path(name):
    return F.concat(F.lit("/p/b"), F.substring(name, 2, 10), F.lit("/"), name, F.lit(".ts"))


def _bare(path):
    return F.regexp_extract(path, r"(e\d+)\.ts$", 1)


def _cases(spark: SparkSession, sf_dir: str, values: list[str]) -> DataFrame:
    """(event_id, value): each event with the case that its number names."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id").filter("event_id IS NOT NULL")
    return events.select("event_id", F.element_at(F.array(*map(F.lit, values)), (F.col("event_id") % len(values) + 1).cast("int")).alias("value"))


def _chain(cycles: DataFrame) -> DataFrame:
    return cycles.select(F.array_join("chain", "->").alias("chain"), F.col("length").cast("long").alias("length"))


def _all_cycles(g: Graph) -> DataFrame:
    return C.find_all_simple_cycles(g, MANY)


def _records(g: Graph) -> DataFrame:
    return g.adjacency().select(F.col("file_path").alias("id"), "dependencies")


def _view(g: Graph) -> tuple[DataFrame, DataFrame, DataFrame]:
    found = cut(C.find_cycles(g))
    return V.view_nodes(_records(g), found), V.view_edges(_records(g), found), found


def _adjacency(g: Graph) -> DataFrame:
    return g.adjacency().select("file_path", F.array_join("dependencies", ",").alias("dependencies"), F.array_join("dependents", ",").alias("dependents"))


def _view_counts(g: Graph) -> DataFrame:
    nodes, edges, found = _view(g)
    return V.view_stats(*V.filter_elements(nodes, edges, "", only_cycles=True), found)


def _dimmed(g: Graph) -> DataFrame:
    nodes, edges, _ = _view(g)
    marked, lines = V.dim_elements(nodes, edges, "[0-4]$")
    return marked.select("id", "dimmed").unionByName(lines.select("id", "dimmed"))


def _highlighted(g: Graph) -> DataFrame:
    nodes, edges, _ = _view(g)
    x = busiest(g)
    near = g.edges.filter(F.col("src") == x).select(F.explode(F.array("src", "dst")).alias("id"))
    marked, lines = V.highlight_elements(nodes, edges, near, x)
    return marked.select("id", "highlighted", "selected").unionByName(lines.select("id", "highlighted", F.lit(False).alias("selected")))


def _rendered(g: Graph) -> DataFrame:
    return V.render_edges(_view(g)[1]).select("id", "source", "target", "inCycle")


def _uploaded(g: Graph) -> DataFrame:
    """Viewer documents, one for each hundred nodes, written as JSON and read back."""
    node = F.struct(F.col("file_path").alias("filePath"), "dependencies", "dependents")
    block = F.substring("file_path", 2, 10)
    docs = g.adjacency().groupBy(block.alias("block")).agg(F.map_from_entries(F.collect_list(F.struct("file_path", node.alias("n")))).alias("nodes"))
    texts = docs.select(F.to_json(F.struct("nodes", F.lit("/p").alias("rootDir"))).alias("text"))
    return V.node_records(V.load_documents(texts, "text")).select("id", F.array_join("dependencies", ",").alias("dependencies"))


def _listed(c: str):
    return F.array_join(F.transform(c, lambda x: F.concat(x["file"], F.lit(":"), x["count"].cast("string"))), ",").alias(c)


def _stats(g: Graph) -> DataFrame:
    return graph_stats(g, C.find_cycles(g)).select("totalFiles", "totalDependencies", "circularDependencies", _listed("topDependencies"), _listed("topDependents"))


def _analysis(g: Graph) -> AnalysisResult:
    sources = source_corpus(g)
    return analyze_sources(sources, sources.select("path"), "/p")


def _analysis_stats(g: Graph) -> DataFrame:
    row = _analysis(g).stats
    bare = lambda c: F.regexp_replace(_listed(c), r"/p/b\d+/(e\d+)\.ts", "$1").alias(c)
    return row.select("totalFiles", "totalDependencies", "circularDependencies", bare("topDependencies"), bare("topDependents"), (F.col("duration") >= 0).alias("timed"))


def _analysis_cycles(g: Graph) -> DataFrame:
    found = _analysis(g).cycles
    return _chain(found.withColumn("chain", F.transform("chain", _bare)))


def _result(g: Graph) -> AnalysisResult:
    """The graph as an analysis of files under /p."""
    full = lambda c: F.concat(F.lit("/p/"), F.col(c))
    moved = Graph(g.nodes.withColumn("file_path", full("file_path")), g.edges.withColumn("src", full("src")).withColumn("dst", full("dst")), "/p")
    cycles = cut(C.find_cycles(moved))
    errors = moved.nodes.filter("ord % 50 = 0").select(F.col("file_path").alias("file"), F.lit("unreadable").alias("error"))
    return AnalysisResult(moved, cycles, graph_stats(moved, cycles), errors, "/p")


def _unreadable(g: Graph) -> DataFrame:
    """The analysis' errors and edges where every fiftieth file cannot be read."""
    sources = source_corpus(g).withColumn("content", F.when(_bare(F.col("path")).substr(2, 12).cast("long") % 50 != 0, F.col("content")))
    result = analyze_sources(sources, sources.select("path"), "/p")
    errors = result.errors.select(_bare(F.col("file")).alias("file"), F.col("error").alias("what"))
    return errors.unionByName(result.graph.edges.select(_bare(F.col("src")).alias("file"), _bare(F.col("dst")).alias("what")))


def _report_rows(part: str) -> Callable[[Graph], DataFrame]:
    def made(g: Graph) -> DataFrame:
        table = R.report_tables(_result(g), "/p")[part]
        return table.select(F.to_json(F.struct(*table.columns)).alias("row"))

    return made


def _report_text(g: Graph) -> DataFrame:
    return R.text_lines(_result(g), "/p").withColumnRenamed("text", "line")


def _scc_sizes(g: Graph) -> DataFrame:
    sizes = C.strong_component_labels(g).groupBy("component").agg(F.count("*").alias("size"))
    return sizes.groupBy("size").agg(F.count("*").alias("n_components"))


def _stored(g: Graph) -> DataFrame:
    folder = f"{shared_root(g.nodes.sparkSession)}/stored-graph-{uuid.uuid4().hex}"
    g.write(folder)
    back = Graph.read(g.nodes.sparkSession, folder)
    return back.edges.select("src", "dst", "src_ord", "pos", F.lit(back.root_dir).alias("root"))


def _parsed(g: Graph) -> DataFrame:
    rows = imports_of(with_imports(source_corpus(g)))
    return rows.select(_bare(F.col("path")).alias("file"), F.col("idx").cast("long").alias("idx"), "source", F.array_join("specifiers", ",").alias("specifiers"), "type", F.col("line").cast("long").alias("line"))


def _resolved(g: Graph) -> DataFrame:
    sources = source_corpus(g)
    found = resolve_imports(imports_of(with_imports(sources)), sources.select("path"), "/p")
    return found.select(_bare(F.col("path")).alias("src"), _bare(F.col("resolved")).alias("dst"))


def _built(g: Graph) -> DataFrame:
    sources = source_corpus(g)
    graph, _ = build_graph(sources, sources.select("path"), "/p")
    return graph.edges.select(_bare(F.col("src")).alias("src"), _bare(F.col("dst")).alias("dst"))


def _emptied(g: Graph) -> DataFrame:
    bare = g.with_root_dir("/q").clear()
    return g.nodes.sparkSession.createDataFrame([(bare.node_count(), bare.edge_count(), bare.root_dir)], "nodes long, edges long, root string")


def _orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The linked graph with further nodes, a thousand times the customers' numbers: those that no event has are without edges."""
    g = linked(spark, sf_dir)
    more = spark.read.parquet(f"{sf_dir}/customer.parquet").select((F.col("c_custkey").cast("long") * 1000).alias("ord")).filter("ord IS NOT NULL")
    every = g.nodes.unionByName(more.select(_name(F.col("ord")).alias("file_path"), "ord")).distinct()
    return Graph(every, g.edges).orphans().select("file_path")


def _forms(kind: str) -> Callable[[SparkSession, str], DataFrame]:
    """Each event as a file of one of the forms of ``kind``, with its number and ``props.k`` in the text."""

    def made(spark: SparkSession, sf_dir: str) -> DataFrame:
        forms = FORMS[kind]
        table = spark.createDataFrame([(i, text, language) for i, (text, language, _) in enumerate(forms)], "i int, text string, language string")
        rows = _events(spark, sf_dir).withColumn("i", (F.col("a") % len(forms)).cast("int")).join(F.broadcast(table), "i")
        content = F.replace(F.col("text"), F.lit("{k}"), F.col("k").cast("string"))
        sources = rows.select(F.col("a").cast("string").alias("path"), "language", content.alias("content"))
        found = imports_of(with_imports(sources))
        return found.select(F.col("path").cast("long").alias("event_id"), F.col("idx").cast("long").alias("idx"), "source", F.array_join("specifiers", ",").alias("specifiers"), "type", F.col("line").cast("long").alias("line"))

    return made


_PROBES = 2 * len(DEFAULT_EXTENSIONS) + 3


def _probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event as a folder whose import is found by the probe that its number names; the next probe's file is there too."""
    j = F.col("a") % _PROBES
    source = F.when(j > _PROBES - 3, "./t.js").otherwise("./t")
    folder = F.concat(F.lit("/p/d"), F.col("a").cast("string"))
    rows = _events(spark, sf_dir).select("a", j.alias("j"), source.alias("source"), folder.alias("folder"))
    tried = rows.select("folder", F.posexplode(candidates(F.concat("folder", F.lit("/"), F.substring("source", 3, 9)), DEFAULT_EXTENSIONS)).alias("pos", "path"), "j")
    files = tried.filter("pos = j OR pos = j + 1").select("path")
    imports = rows.select(F.concat("folder", F.lit("/a.ts")).alias("path"), F.lit(0).alias("idx"), "source")
    return resolve_imports(imports, files, "/p").select("path", "resolved")


def _aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _cases(spark, sf_dir, [c[0] for c in ALIAS_CASES])
    imports = rows.select(F.concat(F.lit("/p/src/f"), F.col("event_id").cast("string"), F.lit(".ts")).alias("path"), F.lit(0).alias("idx"), F.col("value").alias("source"))
    files = spark.createDataFrame([(x,) for x in ALIAS_FILES], "path string")
    return resolve_imports(imports, files, "/p", AnalyzerOptions(path_aliases=ALIASES, base_url=BASE_URL)).select("path", "source", "resolved")


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("value")
    return _cases(spark, sf_dir, [c[0] for c in PATHS]).select("event_id", normalise(p).alias("normal"), dirname(normalise(p)).alias("folder"), basename(normalise(p)).alias("name"), relative(normalise(p), "/r/s").alias("rel"))


def _in_folders(spark: SparkSession, sf_dir: str, cases: list[tuple]) -> DataFrame:
    rows = _cases(spark, sf_dir, [c[0] for c in cases])
    return rows.select("event_id", F.concat(F.lit("/r/"), F.replace(F.col("value"), F.lit("{n}"), F.col("event_id").cast("string"))).alias("path"))


def _constants(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [("extension", i, x) for i, x in enumerate(DEFAULT_EXTENSIONS)] + [("folder", i, x) for i, x in enumerate(DEFAULT_IGNORE_DIRS)]
    rows += [("language " + k, 0, v) for k, v in EXTENSION_TO_LANGUAGE.items()] + [("glob", i, x) for i, x in enumerate(default_ignore_patterns())] + [("listed", i, x) for i, x in enumerate(supported_extensions())]
    return spark.createDataFrame(rows, "kind string, nth long, value string")


def _sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    records, _ = V.sample(spark)
    return records.select("id", F.array_join("dependencies", ",").alias("dependencies"), F.array_join("dependents", ",").alias("dependents"))


_ON_LINKED: dict[str, Callable[[Graph], DataFrame]] = {
    "nodes": lambda g: with_index(g.nodes, ["ord"], "nth").select("file_path", "nth"),
    "edges": lambda g: with_index(g.edges, ["src_ord", "pos"], "nth").select("src", "dst", "nth"),
    "node_count": lambda g: _one(g.nodes, g.node_count(), "n"),
    "edge_count": lambda g: _one(g.nodes, g.edge_count(), "n"),
    "adjacency": _adjacency,
    "node_record": lambda g: g.node(busiest(g)).select("file_path", F.array_join("dependencies", ",").alias("dependencies"), F.array_join("dependents", ",").alias("dependents")),
    "dependencies": lambda g: g.dependencies(busiest(g)).select("file_path"),
    "dependents": lambda g: g.dependents(busiest(g)).select("file_path"),
    "has_node": lambda g: _one(g.nodes, g.has_node(busiest(g)) and not g.has_node("nowhere"), "found"),
    "has_edge": lambda g: _one(g.nodes, g.has_edge(busiest(g), g.dependencies(busiest(g)).first()["file_path"]) and not g.has_edge("nowhere", busiest(g)), "found"),
    "top_dependencies": lambda g: g.top_dependencies(10),
    "top_dependents": lambda g: g.top_dependents(10),
    "leaves": lambda g: g.leaves().select("file_path"),
    "remove_node": lambda g: g.remove_node(busiest(g)).edges.select("src", "dst"),
    "remove_edge": lambda g: g.remove_edge(busiest(g), g.dependencies(busiest(g)).first()["file_path"]).edges.select("src", "dst"),
    "add_node": lambda g: g.add_node("zz").add_node(busiest(g)).nodes.select("file_path"),
    "add_edge": lambda g: g.add_edges([("new", busiest(g)), ("new", busiest(g)), ("alone", None)]).adjacency().select("file_path", F.array_join("dependencies", ",").alias("dependencies")),
    "cleared_graph": _emptied,
    "stored_graph": _stored,
    "transitive_dependencies": lambda g: g.transitive_dependencies(busiest(g)),
    "transitive_dependents": lambda g: g.transitive_dependents(_least_on_cycle(g)),
    "closure": lambda g: closure(g.edges),
    "wcc": lambda g: weak_components(g.nodes.select(F.col("file_path").alias("node")), g.edges),
    "scc": C.strong_component_labels,
    "scc_sizes": _scc_sizes,
    "scc_exact": lambda g: C.find_strong_components(g).select(F.array_join(F.array_sort("members"), ",").alias("members")),
    "self_loops": lambda g: C.self_loops(g).select(F.col("chain")[0].alias("file_path")),
    "cycle_lengths": lambda g: C.find_cycles(g).select(F.col("length").cast("long").alias("length")),
    "has_cycles": lambda g: _one(g.nodes, C.has_cycles(g), "found"),
    "simple_cycles": lambda g: _chain(_all_cycles(g)),
    "simple_cycles_capped": lambda g: _chain(C.find_all_simple_cycles(g, CAP)),
    "normalized_cycles": lambda g: _all_cycles(g).select(F.array_join(C.normalise_cycle(F.col("chain")), "->").alias("chain")),
    "viewer_upload": _uploaded,
    "stats": _stats,
}

_ON_SINGLE: dict[str, Callable[[Graph], DataFrame]] = {
    "cycle_chains": lambda g: _chain(C.find_cycles(g)),
    "cycles_involving_file": lambda g: _chain(C.find_cycles_involving_file(g, _least_on_cycle(g))),
    "longest_cycle": lambda g: _chain(C.find_longest_cycle(g)),
    "scc_members": lambda g: C.find_strong_components(g).filter(F.size("members") > 1).select(F.array_join("members", ",").alias("members")),
    "cycle_texts": lambda g: C.find_cycles(g).select(R.cycle_text(F.col("chain")).alias("text")),
    "parse_imports": _parsed,
    "resolve_imports": _resolved,
    "build_graph": _built,
    "analysis_stats": _analysis_stats,
    "analysis_cycles": _analysis_cycles,
    "analysis_errors": _unreadable,
    "report_nodes": _report_rows("nodes"),
    "report_edges": _report_rows("edges"),
    "report_cycles": _report_rows("cycles"),
    "report_errors": _report_rows("errors"),
    "report_text": _report_text,
    "viewer_nodes": lambda g: _view(g)[0],
    "viewer_edges": lambda g: _view(g)[1],
    "viewer_filter": lambda g: V.filter_elements(*_view(g)[:2], "*1?", only_cycles=False)[1].select("source", "target"),
    "viewer_pattern": lambda g: V.filter_elements(*_view(g)[:2], "E*07", only_cycles=True)[0].select("id"),
    "viewer_stats": _view_counts,
    "viewer_selected": lambda g: V.selected_node(_view(g)[0], busiest(g)),
    "viewer_dimmed": _dimmed,
    "viewer_highlighted": _highlighted,
    "viewer_rendered": _rendered,
    "viewer_names": lambda g: V.file_name(_view(g)[0].withColumn("id", _path(F.col("id")))).select("id", "name"),
}


def _on(graph: Callable[[SparkSession, str], Graph], f: Callable[[Graph], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: f(graph(spark, sf_dir))


def _reach(kind: str, last: bool, reverse: bool) -> Callable[[SparkSession, str], DataFrame]:
    def made(spark: SparkSession, sf_dir: str) -> DataFrame:
        g = trails(spark, sf_dir)
        x = _of_type(g, spark, sf_dir, kind, last)
        return g.transitive_dependents(x) if reverse else g.transitive_dependencies(x)

    return made


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = (
    {name: _on(linked, f) for name, f in _ON_LINKED.items()}
    | {name: _on(single, f) for name, f in _ON_SINGLE.items()}
    | {
        "trail_edges": _on(trails, lambda g: g.edges.select("src", "dst")),
        "roots": _on(trails, lambda g: g.roots().select("file_path")),
        "trail_hubs": _on(trails, lambda g: g.top_dependents(2)),
        "trail_dependencies": _reach("error", True, False),
        "trail_dependents": _reach("view", True, True),
        "trail_wcc": _on(trails, lambda g: weak_components(g.nodes.select(F.col("file_path").alias("node")), g.edges)),
        "trail_scc": _on(trails, C.strong_component_labels),
        "trail_cycle": _on(trails, lambda g: _chain(C.find_cycles(g))),
        "orphans": _orphans,
        "parse_static": _forms("static"),
        "parse_dynamic": _forms("dynamic"),
        "parse_require": _forms("require"),
        "parse_reexport": _forms("reexport"),
        "parse_other": _forms("other"),
        "parse_order": _forms("order"),
        "resolve_probes": _probes,
        "resolve_aliases": _aliases,
        "path_algebra": _paths,
        "discover": lambda s, d: _in_folders(s, d, WALKED).filter(is_source_path(F.col("path"), "/r", AnalyzerOptions(ignore_patterns=PATTERNS))).select("event_id"),
        "plain_lister": lambda s, d: _in_folders(s, d, LISTED).filter(is_listed_path(F.col("path"), "/r", [*default_ignore_patterns(), "**/skip"])).select("event_id"),
        "gitignore": lambda s, d: _cases(s, d, [x[0] for x in GIT_LINES]).select("event_id", gitignore_glob(F.col("value")).alias("pattern")).filter("pattern IS NOT NULL"),
        "constants": _constants,
        "viewer_sample": _sample,
        "is_external": lambda s, d: _cases(s, d, SPECIFIERS).select("event_id", is_external(F.col("value")).alias("external")),
        "language_of": lambda s, d: _cases(s, d, FILE_NAMES).select("event_id", language_of(F.col("value")).alias("language")),
        "ignore_filter": lambda s, d: _cases(s, d, [x[0] for x in WALKED]).filter(~should_ignore(F.concat(F.lit("/r/"), "value"), PATTERNS)).select("event_id"),
    }
)

# DuckDB SQL. The parts below are common table expressions; a query names those it needs.

_EV = """
ev AS (SELECT event_id AS a, CAST(json_extract_string(props, '$.k') AS bigint) AS k, event_type AS t FROM events WHERE event_id IS NOT NULL AND json_extract_string(props, '$.k') IS NOT NULL)"""
_ENDS = """,
nd AS (SELECT src AS id FROM eg UNION SELECT dst FROM eg),
x AS (SELECT src AS id FROM eg GROUP BY src ORDER BY count(*) DESC, src LIMIT 1)"""
_N = "'e' || lpad(({})::varchar, 12, '0')"
_LINK = _N.format("a // 100 * 100 + k")
_SINGLE = _EV + f""",
eg AS (SELECT DISTINCT {_N.format('a')} AS src, {_LINK} AS dst FROM ev)""" + _ENDS
_LINKED = _EV + f""",
eg AS (SELECT {_N.format('a')} AS src, {_LINK} AS dst FROM ev UNION SELECT {_N.format('a')}, {_N.format('a // 100 * 100 + (a + 1) % 100')} FROM ev WHERE t = 'error')""" + _ENDS
_TRAILS = _EV + f""",
f1 AS (SELECT min(a) FILTER (t = 'click') AS click, max(a) FILTER (t = 'click') AS click_end, min(a) FILTER (t = 'view') AS vw, min(a) FILTER (t = 'error') AS err FROM ev),
pr AS (SELECT a, lead(a) OVER (PARTITION BY t ORDER BY a) AS b FROM ev WHERE t IN ('click', 'view')
       UNION SELECT a, lag(a) OVER (ORDER BY a) FROM ev WHERE t = 'signup'
       UNION SELECT click_end, click FROM f1 UNION SELECT click, vw FROM f1
       UNION SELECT a, CASE WHEN a = err THEN click ELSE err END FROM ev, f1 WHERE t = 'error'
       UNION SELECT a, vw FROM ev, f1 WHERE t = 'purchase'),
eg AS (SELECT {_N.format('a')} AS src, {_N.format('b')} AS dst FROM pr WHERE a IS NOT NULL AND b IS NOT NULL)""" + _ENDS
_TC = ",\ntc AS (SELECT src, dst FROM eg UNION SELECT t.src, e.dst FROM tc t JOIN eg e ON e.src = t.dst)"
_FLAGS = ",\nflag AS (SELECT src AS id FROM tc WHERE src = dst)"
_SCC = _TC + """,
scc AS (SELECT nd.id AS file_path, least(nd.id, coalesce(m, nd.id)) AS component FROM nd LEFT JOIN (SELECT a.src AS id, min(a.dst) AS m FROM tc a JOIN tc b ON a.src = b.dst AND a.dst = b.src GROUP BY 1) p ON p.id = nd.id),
sz AS (SELECT component, count(*) AS size, string_agg(file_path, ',' ORDER BY file_path) AS members FROM scc GROUP BY component)"""
_LENGTHS = "SELECT 1::bigint AS length FROM eg WHERE src = dst UNION ALL SELECT size FROM sz WHERE size > 1"
_SC = """,
sc AS (SELECT src AS s, dst AS v, [src] AS p FROM eg WHERE dst >= src
       UNION ALL
       SELECT r.s, e.dst, list_append(r.p, r.v) FROM sc r JOIN eg e ON e.src = r.v
       WHERE r.v <> r.s AND e.dst >= r.s AND (e.dst = r.s OR NOT list_contains(list_append(r.p, r.v), e.dst)))"""
# hits of the first hundreds are enough for the cap, as they come first
_RAW = """,
sc AS (SELECT src AS s, dst AS v, [src] AS p FROM eg WHERE src < 'e000000000300'
       UNION ALL
       SELECT r.s, e.dst, list_append(r.p, r.v) FROM sc r JOIN eg e ON e.src = r.v
       WHERE r.v <> r.s AND (e.dst = r.s OR NOT list_contains(list_append(r.p, r.v), e.dst))),
hit AS (SELECT p, list_append(p, s) AS chain, list_position(p, list_min(p)) AS i FROM sc WHERE s = v ORDER BY list_append(p, s) LIMIT %d),
keyed AS (SELECT chain, list_concat(p[i:], p[:i - 1])::varchar AS k FROM hit)""" % CAP
_WCC = """,
un AS (SELECT src AS u, dst AS v FROM eg UNION SELECT dst, src FROM eg),
w AS (SELECT u, v FROM un UNION SELECT w.u, n.v FROM w JOIN un n ON n.u = w.v),
wc AS (SELECT id AS node, least(id, coalesce(m, id)) AS label FROM nd LEFT JOIN (SELECT u, min(v) AS m FROM w GROUP BY u) ON u = id)"""
# of a graph with one way on from each node: from a component's least node on to its cycle, then around it;
# the search enters the cycle there, and the chain starts at the node before that
_RINGS = _TC + _FLAGS + _WCC + """,
wk AS (SELECT DISTINCT label AS m, label AS v FROM wc UNION ALL SELECT wk.m, eg.dst FROM wk JOIN eg ON eg.src = wk.v WHERE wk.v NOT IN (SELECT id FROM flag)),
en AS (SELECT m, v AS entry FROM wk WHERE v IN (SELECT id FROM flag)),
rg AS (SELECT m, entry, entry AS v, 0 AS n FROM en UNION ALL SELECT m, entry, eg.dst, n + 1 FROM rg JOIN eg ON eg.src = rg.v WHERE eg.dst <> entry),
ring AS (SELECT m, count(*) AS size, max_by(v, n) AS last, string_agg(v, '->' ORDER BY n) AS steps, string_agg(v, ',' ORDER BY n DESC) AS members, list(v) AS all_of FROM rg GROUP BY m),
chains AS (SELECT 0 AS kind, src AS m, src || '->' || src AS chain, 1::bigint AS length, [src] AS all_of FROM eg WHERE src = dst
           UNION ALL SELECT 1, m, last || '->' || steps, size, all_of FROM ring WHERE size > 1)"""
_ON_RING = _RINGS + """,
cyc AS (SELECT unnest(all_of) AS id, m FROM ring),
fl AS (SELECT src || '->' || dst AS id, src, dst, EXISTS (SELECT 1 FROM cyc a JOIN cyc b ON a.m = b.m WHERE a.id = src AND b.id = dst) AS c FROM eg)"""
_ADJ = "(SELECT coalesce(string_agg(dst, ',' ORDER BY dst), '') FROM eg WHERE src = id)"
_ADJ_IN = "(SELECT coalesce(string_agg(src, ',' ORDER BY src), '') FROM eg WHERE dst = id)"
_TOP = "SELECT id AS file, count(e.{0}) AS count FROM nd LEFT JOIN eg e ON e.{0} = id GROUP BY id ORDER BY 2 DESC, 1 LIMIT 10"
# of an analysis: ties in the order of first mention, a file before its targets
_MENTION = "least(2 * substr(id, 2)::bigint, coalesce((SELECT min(2 * substr(src, 2)::bigint + 1) FROM eg WHERE dst = id), 1000000000000000))"
_TOP_MENTIONED = f"SELECT id AS file, count(e.{{0}}) AS count, {_MENTION} AS o FROM nd LEFT JOIN eg e ON e.{{0}} = id GROUP BY id ORDER BY 2 DESC, 3 LIMIT 10"
_FIRST_DEP = "(SELECT min(dst) FROM eg WHERE src = (SELECT id FROM x))"
_ON_CYCLE = "(SELECT min(component) FROM scc WHERE file_path <> component)"


def _single(body: str, *parts: str) -> str:
    return "WITH RECURSIVE" + _SINGLE + "".join(parts) + "\n" + body


def _linked(body: str, *parts: str) -> str:
    return "WITH RECURSIVE" + _LINKED + "".join(parts) + "\n" + body


def _trails(body: str) -> str:
    return "WITH RECURSIVE" + _TRAILS + "\n" + body


def _stats_sql(top: str = _TOP, order: str = "file", extra: str = "") -> str:
    listed = lambda c: f"(SELECT string_agg(file || ':' || count, ',' ORDER BY count DESC, {order}) FROM ({top.format(c)}))"
    return (
        'SELECT (SELECT count(*) FROM nd) AS "totalFiles", (SELECT count(*) FROM eg) AS "totalDependencies", '
        f'(SELECT count(*) FROM ({_LENGTHS})) AS "circularDependencies", {listed("src")} AS "topDependencies", {listed("dst")} AS "topDependents"{extra}'
    )


def _forms_sql(kind: str) -> str:
    rows = [(i, nth, source, ",".join(specifiers), type_, line) for i, (_, _, found) in enumerate(FORMS[kind]) for nth, (source, specifiers, type_, line) in enumerate(found)]
    body = values_sql(rows or [(-1, 0, "", "", "", 0)])
    return f"WITH {_EV.strip()}, want(i, idx, source, specifiers, type, line) AS (VALUES {body}) SELECT a AS event_id, idx::bigint AS idx, replace(source, '{{k}}', k::varchar) AS source, specifiers, type, line::bigint AS line FROM ev JOIN want ON i = a % {len(FORMS[kind])}"


def _cases_sql(rows: list, columns: str, where: str = "") -> str:
    """Each event with the stated results of its case."""
    names = ", ".join(x.split(" AS ")[0].strip() for x in columns.split(","))
    table = values_sql([(i, *r) for i, r in enumerate(rows)])
    return f"WITH want(i, {names}) AS (VALUES {table}) SELECT event_id, {names} FROM events JOIN want ON i = event_id % {len(rows)} WHERE event_id IS NOT NULL{where}"


def _kept_sql(rows: list, column: int) -> str:
    kept = ", ".join(str(i) for i, r in enumerate(rows) if r[column])
    return f"SELECT event_id FROM events WHERE event_id IS NOT NULL AND event_id % {len(rows)} IN ({kept})"


_TAIL = "[" + ", ".join(f"'{x}'" for x in ["", *DEFAULT_EXTENSIONS, *("/index" + x for x in DEFAULT_EXTENSIONS)]) + "]"
_TEXT = """
txt AS (SELECT row_number() OVER (ORDER BY kind, m) AS i, replace(chain, '->', ' → ') || ' → ' || split_part(chain, '->', 1) AS t, length FROM chains),
er AS (SELECT id, row_number() OVER (ORDER BY id) AS i, count(*) OVER () AS n FROM nd WHERE substr(id, 2)::bigint % 50 = 0),
ln AS (SELECT 0 AS part, 0 AS i, [ '', '📊 Analysis Results', '', 'Files analyzed: ' || (SELECT count(*) FROM nd), 'Dependencies: ' || (SELECT count(*) FROM eg), 'Circular dependencies: ' || (SELECT count(*) FROM txt), '', '❌ Found ' || (SELECT count(*) FROM txt) || ' circular dependency chains:', ''] AS l
       UNION ALL SELECT 1, i, ['  ' || i || '. ' || t, '     Files involved: ' || length] FROM txt
       UNION ALL SELECT 2, 0, ['', '', '⚠️  ' || (SELECT count(*) FROM er) || ' file(s) had parsing errors:', '']
       UNION ALL SELECT 3, i, ['  ' || id || ': unreadable'] FROM er WHERE i <= 5
       UNION ALL SELECT 4, 0, ['  ... and ' || (n - 5) || ' more'] FROM er WHERE i = 6)"""

ORACLE_SQL: dict[str, str] = {
    "nodes": _linked("SELECT id AS file_path, row_number() OVER (ORDER BY id) - 1 AS nth FROM nd"),
    "edges": _linked("SELECT src, dst, row_number() OVER (ORDER BY src, dst) - 1 AS nth FROM eg"),
    "node_count": _linked("SELECT count(*) AS n FROM nd"),
    "edge_count": _linked("SELECT count(*) AS n FROM eg"),
    "adjacency": _linked(f"SELECT id AS file_path, {_ADJ} AS dependencies, {_ADJ_IN} AS dependents FROM nd"),
    "node_record": _linked(f"SELECT id AS file_path, {_ADJ} AS dependencies, {_ADJ_IN} AS dependents FROM x"),
    "dependencies": _linked("SELECT dst AS file_path FROM eg WHERE src = (SELECT id FROM x)"),
    "dependents": _linked("SELECT src AS file_path FROM eg WHERE dst = (SELECT id FROM x)"),
    "has_node": _linked("SELECT count(*) > 0 AS found FROM nd WHERE id = (SELECT id FROM x)"),
    "has_edge": _linked(f"SELECT count(*) > 0 AS found FROM eg WHERE src = (SELECT id FROM x) AND dst = {_FIRST_DEP}"),
    "top_dependencies": _linked(_TOP.format("src")),
    "top_dependents": _linked(_TOP.format("dst")),
    "orphans": _linked(f"SELECT DISTINCT {_N.format('c_custkey::bigint * 1000')} AS file_path FROM customer WHERE c_custkey IS NOT NULL AND {_N.format('c_custkey::bigint * 1000')} NOT IN (SELECT id FROM nd)"),
    "leaves": _linked("SELECT id AS file_path FROM nd WHERE id IN (SELECT src FROM eg) AND id NOT IN (SELECT dst FROM eg)"),
    "roots": _trails("SELECT id AS file_path FROM nd WHERE id IN (SELECT dst FROM eg) AND id NOT IN (SELECT src FROM eg)"),
    "remove_node": _linked("SELECT src, dst FROM eg WHERE src <> (SELECT id FROM x) AND dst <> (SELECT id FROM x)"),
    "remove_edge": _linked(f"SELECT src, dst FROM eg WHERE NOT (src = (SELECT id FROM x) AND dst = {_FIRST_DEP})"),
    "add_node": _linked("SELECT id AS file_path FROM nd UNION ALL SELECT 'zz'"),
    "add_edge": _linked(f"SELECT id AS file_path, {_ADJ} AS dependencies FROM nd UNION ALL SELECT 'new', id FROM x UNION ALL SELECT 'alone', ''"),
    "cleared_graph": "SELECT 0::bigint AS nodes, 0::bigint AS edges, '/q' AS root",
    "stored_graph": _linked("SELECT src, dst, substr(src, 2)::bigint AS src_ord, substr(dst, 2)::bigint AS pos, '/p' AS root FROM eg"),
    "transitive_dependencies": _linked("SELECT dst AS file_path FROM tc WHERE src = (SELECT id FROM x)", _TC),
    "transitive_dependents": _linked(f"SELECT src AS file_path FROM tc WHERE dst = {_ON_CYCLE}", _SCC),
    "closure": _linked("SELECT src, dst FROM tc", _TC),
    "wcc": _linked("SELECT node, label FROM wc", _WCC),
    "scc": _linked("SELECT file_path, component FROM scc", _SCC),
    "scc_sizes": _linked("SELECT size, count(*) AS n_components FROM sz GROUP BY size", _SCC),
    "scc_exact": _linked("SELECT members FROM sz", _SCC),
    "self_loops": _linked("SELECT src AS file_path FROM eg WHERE src = dst"),
    "cycle_lengths": _linked(_LENGTHS, _SCC),
    "has_cycles": _linked("SELECT count(*) > 0 AS found FROM tc WHERE src = dst", _TC),
    "simple_cycles": _linked("SELECT array_to_string(list_append(p, s), '->') AS chain, len(p)::bigint AS length FROM sc WHERE s = v", _SC),
    "simple_cycles_capped": _linked("SELECT array_to_string(min(chain), '->') AS chain, (len(min(chain)) - 1)::bigint AS length FROM keyed GROUP BY k", _RAW),
    "normalized_cycles": _linked("SELECT array_to_string(list_append(p, s), '->') AS chain FROM sc WHERE s = v", _SC),
    "viewer_upload": _linked(f"SELECT id, {_ADJ} AS dependencies FROM nd"),
    "stats": _linked(_stats_sql(), _SCC),
    "cycle_chains": _single("SELECT chain, length FROM chains", _RINGS),
    "cycles_involving_file": _single("SELECT chain, length FROM chains WHERE list_contains(all_of, (SELECT min(v) FROM rg WHERE n > 0 OR m IN (SELECT m FROM ring WHERE size > 1)))", _RINGS),
    "longest_cycle": _single("SELECT chain, length FROM chains ORDER BY length DESC, kind, m LIMIT 1", _RINGS),
    "scc_members": _single("SELECT members FROM ring WHERE size > 1", _RINGS),
    "cycle_texts": _single("SELECT replace(chain, '->', ' → ') || ' → ' || split_part(chain, '->', 1) AS text FROM chains", _RINGS),
    "parse_imports": _single("SELECT src AS file, n - 1 AS idx, './' || dst AS source, 'x' AS specifiers, 'esm' AS type, n AS line FROM (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY dst) AS n FROM eg)"),
    # a target in another folder would not be found; all are in their source's one
    "resolve_imports": _single("SELECT src, dst FROM eg"),
    "build_graph": _single("SELECT src, dst FROM eg"),
    "analysis_stats": _single(_stats_sql(_TOP_MENTIONED, "o", ", true AS timed"), _SCC),
    "analysis_cycles": _single("SELECT chain, length FROM chains", _RINGS),
    "analysis_errors": _single("SELECT id AS file, 'the file cannot be read' AS what FROM nd WHERE substr(id, 2)::bigint % 50 = 0 UNION ALL SELECT src, dst FROM eg WHERE substr(src, 2)::bigint % 50 <> 0"),
    "report_nodes": _single("SELECT '{\"node\":\"' || id || '\"}' AS row FROM nd"),
    "report_edges": _single("SELECT '{\"from\":\"' || src || '\",\"to\":\"' || dst || '\"}' AS row FROM eg"),
    "report_cycles": _single("SELECT '{\"chain\":[\"' || replace(chain, '->', '\",\"') || '\"],\"length\":' || length || '}' AS row FROM chains", _RINGS),
    "report_errors": _single("SELECT '{\"file\":\"' || id || '\",\"error\":\"unreadable\"}' AS row FROM nd WHERE substr(id, 2)::bigint % 50 = 0"),
    "report_text": _single("SELECT row_number() OVER (ORDER BY part, i, j) - 1 AS nth, l[j] AS line FROM (SELECT part, i, l, unnest(range(1, len(l) + 1)) AS j FROM ln)", _RINGS, ",", _TEXT),
    "viewer_nodes": _single('SELECT id, id AS label, id IN (SELECT id FROM cyc) AS "inCycle" FROM nd', _ON_RING),
    "viewer_edges": _single('SELECT id, src AS source, dst AS target, c AS "inCycle" FROM fl', _ON_RING),
    "viewer_filter": _single("SELECT src AS source, dst AS target FROM eg WHERE src LIKE '%1_%' AND dst LIKE '%1_%'"),
    "viewer_pattern": _single("SELECT id FROM nd WHERE id IN (SELECT id FROM cyc) AND id LIKE '%e%07%'", _ON_RING),
    "viewer_stats": _single("SELECT (SELECT count(*) FROM cyc) AS nodes, (SELECT count(*) FROM eg WHERE src IN (SELECT id FROM cyc) AND dst IN (SELECT id FROM cyc)) AS edges, (SELECT count(*) FROM chains) AS cycles", _ON_RING),
    "viewer_selected": _single('SELECT id, id AS label, id IN (SELECT id FROM cyc) AS "inCycle" FROM x', _ON_RING),
    "viewer_dimmed": _single("SELECT id, right(id, 1) > '4' AS dimmed FROM nd UNION ALL SELECT src || '->' || dst, right(src, 1) > '4' AND right(dst, 1) > '4' FROM eg"),
    "viewer_highlighted": _single(
        "SELECT id, id IN (SELECT id FROM hl) AS highlighted, id = (SELECT id FROM x) AS selected FROM nd UNION ALL SELECT src || '->' || dst, src IN (SELECT id FROM hl) AND dst IN (SELECT id FROM hl), false FROM eg",
        ",\nhl AS (SELECT id FROM x UNION SELECT dst FROM eg WHERE src = (SELECT id FROM x))",
    ),
    "viewer_rendered": _single("SELECT 'edge-' || src || '-' || dst || '-' || (row_number() OVER (ORDER BY src, dst) - 1) AS id, src AS source, dst AS target, c AS \"inCycle\" FROM fl", _ON_RING),
    "viewer_names": _single("SELECT '/p/b' || substr(id, 2, 10) || '/' || id || '.ts' AS id, id || '.ts' AS name FROM nd"),
    "trail_edges": _trails("SELECT src, dst FROM eg"),
    "trail_hubs": _trails("SELECT dst AS file, count(*) AS count FROM eg GROUP BY dst ORDER BY 2 DESC, 1 LIMIT 2"),
    "trail_dependencies": _trails(f"SELECT {_N.format('a')} AS file_path FROM ev, f1 WHERE (t IN ('click', 'view') OR a = err) AND err < (SELECT max(a) FROM ev WHERE t = 'error')"),
    "trail_dependents": _trails(f"SELECT {_N.format('a')} AS file_path FROM ev WHERE t <> 'signup' AND a <> (SELECT max(a) FROM ev WHERE t = 'view')"),
    "trail_wcc": _trails(f"SELECT {_N.format('a')} AS node, {_N.format('min(a) OVER (PARTITION BY t = ' + "'signup')")} AS label FROM ev"),
    "trail_scc": _trails(f"SELECT {_N.format('a')} AS file_path, CASE WHEN t = 'click' THEN {_N.format('click')} ELSE {_N.format('a')} END AS component FROM ev, f1"),
    "trail_cycle": _trails(f"SELECT {_N.format('max(a)')} || '->' || string_agg({_N.format('a')}, '->' ORDER BY a) AS chain, count(*) AS length FROM ev WHERE t = 'click'"),
    **{f"parse_{kind}": _forms_sql(kind) for kind in FORMS},
    "resolve_probes": f"WITH {_EV.strip()} SELECT '/p/d' || a || '/a.ts' AS path, '/p/d' || a || '/t' || CASE a % {_PROBES} WHEN {_PROBES - 2} THEN '.ts' WHEN {_PROBES - 1} THEN '.tsx' ELSE ({_TAIL})[a % {_PROBES} + 1] END AS resolved FROM ev",
    "resolve_aliases": f"WITH want(i, source, resolved) AS (VALUES {values_sql([(i, *r) for i, r in enumerate(ALIAS_CASES)])}) SELECT '/p/src/f' || event_id || '.ts' AS path, source, resolved FROM events JOIN want ON i = event_id % {len(ALIAS_CASES)} WHERE resolved IS NOT NULL",
    "path_algebra": _cases_sql([r[1:] for r in PATHS], "normal, folder, name, rel"),
    "discover": _kept_sql(WALKED, 1),
    "plain_lister": _kept_sql(LISTED, 1),
    "gitignore": _cases_sql([(r[1],) for r in GIT_LINES], "pattern", " AND pattern IS NOT NULL"),
    "ignore_filter": _kept_sql(WALKED, 2),
    "is_external": "SELECT event_id, [false, false, true, true, false, false, true, true, true, true][event_id % 10 + 1] AS external FROM events",
    "language_of": "SELECT event_id, ['typescript', 'tsx', 'javascript', NULL, NULL, NULL, 'typescript', 'jsx', 'javascript', 'javascript', 'typescript'][event_id % 11 + 1] AS language FROM events",
    "constants": """SELECT 'extension' AS kind, generate_subscripts(x, 1) - 1 AS nth, unnest(x) AS value FROM (SELECT ['.ts', '.tsx', '.js', '.jsx', '.mjs', '.cjs', '.mts', '.cts'] AS x)
        UNION ALL SELECT 'folder', generate_subscripts(x, 1) - 1, unnest(x) FROM (SELECT ['node_modules', 'dist', 'build', '.git', 'coverage', '.next', '.nuxt'] AS x)
        UNION ALL SELECT 'listed', generate_subscripts(x, 1) - 1, unnest(x) FROM (SELECT ['ts', 'tsx', 'js', 'jsx'] AS x)
        UNION ALL SELECT 'glob', generate_subscripts(x, 1) - 1, unnest(x) FROM (SELECT ['**/node_modules/**', '**/.git/**', '**/dist/**', '**/build/**', '**/coverage/**', '**/*.d.ts'] AS x)
        UNION ALL SELECT 'language ' || unnest(['.ts', '.tsx', '.js', '.jsx', '.mjs', '.cjs', '.mts', '.cts']), 0, unnest(['typescript', 'tsx', 'javascript', 'jsx', 'javascript', 'javascript', 'typescript', 'typescript'])""",
    "viewer_sample": f"SELECT * FROM (VALUES {values_sql([(r['id'], ','.join(r['dependencies']), ','.join(r['dependents'])) for r in V.SAMPLE['nodes']])}) AS t(id, dependencies, dependents)",
}
