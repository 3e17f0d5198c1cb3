"""The whole analysis: scan, parse, resolve, graph, cycles, statistics."""

from __future__ import annotations

import os.path
import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from graphloom.functions.lineage import cut
from graphloom.functions.ordering import with_index
from graphloom.functions.parse import imports_of, parse_file, with_imports
from graphloom.operators.cycles import find_cycles
from graphloom.operators.graph import Graph
from graphloom.operators.resolve import resolve_imports
from graphloom.schema import AnalyzerOptions
from graphloom.sources.scan import discover_files, list_all_files, read_sources


@dataclass(frozen=True)
class AnalysisResult:
    graph: Graph
    cycles: DataFrame  # chain, length, rank
    stats: DataFrame  # one row
    errors: DataFrame  # file, error
    root_dir: str


def build_graph(sources: DataFrame, files: DataFrame, root: str, options: AnalyzerOptions = AnalyzerOptions()) -> tuple[Graph, DataFrame]:
    """The graph of ``sources`` (path, language, content), with imports looked up in ``files`` (path); and the errors.

    A file is mentioned first, then its targets in the order of its imports;
    files follow each other in ascending order of their paths.
    """
    parsed = cut(with_imports(sources))
    resolved = resolve_imports(imports_of(parsed), files, root, options)
    own = parsed.select(F.col("path").alias("src"), F.lit(None).cast("string").alias("dst"), F.lit(-1).alias("idx"))
    mentions = own.unionByName(resolved.select(F.col("path").alias("src"), F.col("resolved").alias("dst"), "idx"))
    errors = parsed.select(F.col("path").alias("file"), F.explode("errors").alias("error"))
    # written once, as ranges are told by a sample of it
    return Graph.from_mentions(with_index(cut(mentions), ["src", "idx"], "seq"), root).cut(), errors


def graph_stats(graph: Graph, cycles: DataFrame, duration: int = 0, limit: int = 10) -> DataFrame:
    """One row: totalFiles, totalDependencies, circularDependencies, topDependencies, topDependents, duration."""
    count = lambda df, name: df.agg(F.count("*").alias(name))
    listed = lambda top, name: top.withColumn("_i", F.monotonically_increasing_id()).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "file", "count"))), lambda x: F.struct(x["file"].alias("file"), x["count"].alias("count"))).alias(name))
    # every side has one row
    return (
        count(graph.nodes, "totalFiles")
        .crossJoin(count(graph.edges, "totalDependencies"))
        .crossJoin(count(cycles, "circularDependencies"))
        .crossJoin(listed(graph.top_dependencies(limit), "topDependencies"))
        .crossJoin(listed(graph.top_dependents(limit), "topDependents"))
        .withColumn("duration", F.lit(duration).cast("long"))
    )


def analyze_sources(sources: DataFrame, files: DataFrame, root: str, options: AnalyzerOptions = AnalyzerOptions()) -> AnalysisResult:
    began = time.time()
    graph, errors = build_graph(sources, files, root, options)
    cycles = cut(find_cycles(graph))
    return AnalysisResult(graph, cycles, graph_stats(graph, cycles, int((time.time() - began) * 1000)), errors, root)


def analyze_directory(spark: SparkSession, path: str, options: AnalyzerOptions = AnalyzerOptions()) -> AnalysisResult:
    """The analysis of a directory; a missing one is an empty graph."""
    root = os.path.abspath(path)
    sources = read_sources(spark, discover_files(root, options))
    files = spark.createDataFrame([(p,) for p in list_all_files(root)], "path string")
    return analyze_sources(sources, files, root, options)


def analyze_file(path: str) -> list:
    """The imports of one file."""
    return parse_file(path)


def has_circular_dependencies(spark: SparkSession, path: str, options: AnalyzerOptions = AnalyzerOptions()) -> bool:
    return not analyze_directory(spark, path, options).cycles.isEmpty()
