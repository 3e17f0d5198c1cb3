"""Reports of an analysis as text and as JSON, and the files that they are written to."""

from __future__ import annotations

import json
import posixpath
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from graphloom.functions.lineage import cut
from graphloom.functions.ordering import with_index
from graphloom.functions.paths import relative
from graphloom.plans.analyze import AnalysisResult

SHOWN_ERRORS = 5


def cycle_text(chain: Column) -> Column:
    """The chain's elements joined by arrows, and its first once more."""
    return F.concat(F.array_join(chain, " → "), F.lit(" → "), F.get(chain, F.lit(0)))


def report_tables(result: AnalysisResult, base: str) -> dict[str, DataFrame]:
    """The report's parts with paths relative to ``base``: cycles, nodes, edges, errors; statistics as they are."""
    path = lambda c: relative(F.col(c), base)
    return {
        "stats": result.stats,
        "cycles": result.cycles.orderBy("rank").select(F.transform("chain", lambda p: relative(p, base)).alias("chain"), "length"),
        "nodes": result.graph.ordered_nodes().select(path("file_path").alias("node")),
        "edges": result.graph.ordered_edges().select(path("src").alias("from"), path("dst").alias("to")),
        "errors": result.errors.orderBy("file").select(path("file").alias("file"), "error"),
    }


def _quoted(text: Column) -> Column:
    """A JSON string: quotes, backslashes and control characters escaped, all others as they are."""
    short = {"\\": "\\\\", '"': '\\"', "\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f"}
    for c in map(chr, range(32)):
        short.setdefault(c, f"\\u{ord(c):04x}")
    escaped = reduce(lambda t, kv: F.replace(t, F.lit(kv[0]), F.lit(kv[1])), short.items(), text)
    return F.concat(F.lit('"'), F.when(text.rlike(r'[\x00-\x1f"\\]'), escaped).otherwise(text), F.lit('"'))


def _object(depth: int, fields: dict[str, Column]) -> Column:
    """A JSON object indented by ``depth``, without what closes its line."""
    pad = " " * depth
    inner = [F.concat(F.lit(f'{pad}  "{name}": '), value) for name, value in fields.items()]
    return F.concat(F.lit(pad + "{\n"), F.concat_ws(",\n", *inner), F.lit("\n" + pad + "}"))


def _list(depth: int, items: Column) -> Column:
    pad = " " * depth
    return F.when(F.size(items) == 0, "[]").otherwise(F.concat(F.lit("[\n" + pad + "  "), F.array_join(items, ",\n" + pad + "  "), F.lit("\n" + pad + "]")))


def json_lines(result: AnalysisResult, base: str) -> DataFrame:
    """(part, nth, text): the report as one JSON text in that order, made by the executors.

    Parts are the statistics, then each of the four lists with what opens and
    closes it; a text may have several lines, and lists are indexed by ranges.
    """
    path = lambda c: _quoted(relative(F.col(c), base))
    key = lambda *c: F.array(*(F.col(x).cast("long") for x in c))
    none = F.lit("")
    listed = [
        result.cycles.select(F.lit(1).alias("part"), F.col("rank").alias("key"), none.alias("name"), _object(4, {"chain": _list(6, F.transform("chain", lambda p: _quoted(relative(p, base)))), "length": F.col("length").cast("string")}).alias("text")),
        result.graph.nodes.select(F.lit(3), key("ord"), none, F.concat(F.lit("      "), path("file_path"))),
        result.graph.edges.select(F.lit(5), key("src_ord", "pos"), none, _object(6, {"from": path("src"), "to": path("dst")})),
        result.errors.select(F.lit(7), F.array().cast("array<bigint>"), F.col("file"), _object(4, {"file": path("file"), "error": _quoted(F.col("error"))})),
    ]
    placed = cut(with_index(reduce(DataFrame.union, listed), ["part", "key", "name", "text"], "nth"))
    ends = {r["part"]: r["end"] for r in placed.groupBy("part").agg(F.max("nth").alias("end")).collect()}  # four rows at most
    last = reduce(lambda found, kv: found.when(F.col("part") == kv[0], F.col("nth") == kv[1]), ends.items(), F.when(F.lit(False), F.lit(False))).otherwise(False)
    items = placed.select("part", "nth", F.concat("text", F.when(last, "").otherwise(",")).alias("text"))

    stats = json.dumps(result.stats.first().asDict(recursive=True), indent=2, ensure_ascii=False).replace("\n", "\n  ")

    def open_(name: str, pad: int, part: int, close: str) -> str:
        return " " * pad + f'"{name}": [' + ("" if part in ends else "]" + close)

    frame = {0: ["{", f'  "stats": {stats},', open_("cycles", 2, 1, ",")], 2: ["  ],"] * (1 in ends), 4: ["    ],"] * (3 in ends), 6: ["    ]"] * (5 in ends), 8: ["  ]"] * (7 in ends) + ["}"]}
    frame[2] += ['  "graph": {', open_("nodes", 4, 3, ",")]
    frame[4].append(open_("edges", 4, 5, ""))
    frame[6] += ["  },", open_("errors", 2, 7, "")]
    rows = [(part, i, text) for part, texts in frame.items() for i, text in enumerate(texts)]
    return items.unionByName(result.stats.sparkSession.createDataFrame(rows, "part int, nth long, text string"))


def json_report(result: AnalysisResult, base: str) -> str:
    """The report as one JSON text, indented by two spaces; statistics keep absolute paths."""
    return "\n".join(r["text"] for r in json_lines(result, base).orderBy("part", "nth").collect())


def write_text(lines: DataFrame, by: list[str], folder: str) -> None:
    """``lines`` (text) in the order of ``by``, sorted and written by ranges: the files in the order of their names are the text."""
    lines.orderBy(*by).select("text").write.mode("overwrite").text(folder)


def empty_json_report(result: AnalysisResult) -> str:
    return json.dumps({"stats": result.stats.first().asDict(recursive=True), "cycles": [], "graph": {"nodes": [], "edges": []}, "errors": []}, separators=(",", ":"), ensure_ascii=False)


def viewer_json(result: AnalysisResult) -> str:
    """The document that the viewer loads: nodes by path with both lists, cycles, root and counts."""
    nodes = {r["file_path"]: {"filePath": r["file_path"], "dependencies": r["dependencies"], "dependents": r["dependents"]} for r in result.graph.adjacency().orderBy("ord").collect()}
    s = result.stats.first()
    cycles = [{"chain": r["chain"], "length": r["length"]} for r in result.cycles.orderBy("rank").collect()]
    return json.dumps({"nodes": nodes, "cycles": cycles, "rootDir": result.root_dir, "stats": {k: s[k] for k in ("totalFiles", "totalDependencies", "circularDependencies")}}, indent=2, ensure_ascii=False)


def write_report(result: AnalysisResult, base: str, folder: str) -> None:
    """The report's tables as JSON lines, and its two texts, written by the executors: for graphs that no driver holds."""
    write_text(text_lines(result, base), ["nth"], posixpath.join(folder, "text"))
    write_text(json_lines(result, base), ["part", "nth"], posixpath.join(folder, "json"))
    for name, df in report_tables(result, base).items():
        df.write.mode("overwrite").json(posixpath.join(folder, name))


# The report's lines.
_TITLE, _FILES, _EDGES, _CYCLES = "📊 Analysis Results", "Files analyzed: {}", "Dependencies: {}", "Circular dependencies: {}"
_NONE, _FOUND, _CHAIN, _SIZE = "✅ No circular dependencies found!", "❌ Found {} circular dependency chain{}:", "  {}. {}", "     Files involved: {}"
_ERRORS, _ERROR, _MORE = "⚠️  {} file(s) had parsing errors:", "  {}: {}", "  ... and {} more"


def text_lines(result: AnalysisResult, base: str) -> DataFrame:
    """(nth, text): the report's lines by number: counts, the numbered cycles, and at most SHOWN_ERRORS errors with the number of the others."""
    s = result.stats.first()
    spark = result.stats.sparkSession
    head = ["", _TITLE, "", _FILES.format(s["totalFiles"]), _EDGES.format(s["totalDependencies"]), _CYCLES.format(s["circularDependencies"]), ""]
    number = s["circularDependencies"]
    head += [_FOUND.format(number, "s" if number > 1 else ""), ""] if number else [_NONE]
    tail = [""]
    errors = result.errors.count()
    if errors:
        shown = result.errors.orderBy("file").limit(SHOWN_ERRORS).select(relative(F.col("file"), base), "error").collect()
        tail += ["", _ERRORS.format(errors), "", *(_ERROR.format(*e) for e in shown)]
        if errors > SHOWN_ERRORS:
            tail.append(_MORE.format(errors - SHOWN_ERRORS))
    rows = [*enumerate(head), *enumerate(tail, len(head) + 2 * number)]
    fixed = spark.createDataFrame(rows, "nth long, text string")
    if not number:
        return fixed
    i = F.col("_i")
    chain = cycle_text(F.transform("chain", lambda p: relative(p, base)))
    pair = F.array(
        F.struct((len(head) + 2 * i).alias("nth"), F.format_string(_CHAIN.format("%d", "%s"), i + 1, chain).alias("text")),
        F.struct((len(head) + 2 * i + 1).alias("nth"), F.format_string(_SIZE.format("%d"), "length").alias("text")),
    )
    return with_index(result.cycles, ["rank"], "_i").select(F.inline(pair)).unionByName(fixed)


def text_report(result: AnalysisResult, base: str) -> str:
    return "\n".join(r["text"] for r in text_lines(result, base).orderBy("nth").collect())
