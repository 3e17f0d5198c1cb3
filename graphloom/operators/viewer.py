"""The viewer's transforms: nodes and edges with cycle flags, and filters on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from graphloom.functions.paths import basename, matches_view_pattern
from graphloom.schema import VIEWER_SCHEMA


def load_documents(texts: DataFrame, column: str) -> DataFrame:
    """Rows of VIEWER_SCHEMA from a column of JSON texts; rows of nulls for texts that are no such document."""
    return texts.select(F.from_json(column, VIEWER_SCHEMA).alias("d")).select("d.*")


def load(spark: SparkSession, text: str) -> DataFrame:
    """One row of VIEWER_SCHEMA from a JSON text; ValueError if it is not such a document."""
    row = load_documents(spark.createDataFrame([(text,)], "text string"), "text")
    if row.filter("nodes IS NOT NULL").isEmpty():
        raise ValueError("Invalid JSON file")
    return row


def node_records(data: DataFrame) -> DataFrame:
    """(id, dependencies): the document's nodes by their keys."""
    return data.select(F.explode("nodes").alias("id", "n")).select("id", F.coalesce("n.dependencies", F.array().cast("array<string>")).alias("dependencies"))


def cycle_marks(cycles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From (chain): the distinct nodes of all chains, and the distinct steps, the one from the last back to the first included."""
    nodes = cycles.select(F.explode("chain").alias("id")).distinct()
    turned = F.concat(F.slice("chain", 2, F.size("chain")), F.slice("chain", 1, 1))
    steps = cycles.filter(F.size("chain") > 0).select(F.inline(F.arrays_zip(F.col("chain").alias("source"), turned.alias("target")))).toDF("source", "target").distinct()
    return nodes, steps


def view_nodes(records: DataFrame, cycles: DataFrame) -> DataFrame:
    """(id, label, inCycle) for each of ``records`` (id, dependencies)."""
    marked, _ = cycle_marks(cycles)
    return records.select("id").join(marked.withColumn("_in", F.lit(True)), "id", "left").select("id", F.col("id").alias("label"), F.coalesce("_in", F.lit(False)).alias("inCycle"))


def view_edges(records: DataFrame, cycles: DataFrame) -> DataFrame:
    """(id, source, target, inCycle): each step from a record to a dependency once."""
    _, steps = cycle_marks(cycles)
    pairs = records.select(F.col("id").alias("source"), F.explode("dependencies").alias("target")).distinct()
    flagged = pairs.join(steps.withColumn("_in", F.lit(True)), ["source", "target"], "left")
    return flagged.select(F.concat_ws("->", "source", "target").alias("id"), "source", "target", F.coalesce("_in", F.lit(False)).alias("inCycle"))


def filter_elements(nodes: DataFrame, edges: DataFrame, pattern: str = "", only_cycles: bool = False) -> tuple[DataFrame, DataFrame]:
    """The nodes that match, and the edges between them."""
    kept = nodes.filter(matches_view_pattern(F.col("id"), pattern))
    if only_cycles:
        kept = kept.filter("inCycle")
    inner = edges.join(kept.select(F.col("id").alias("source")), "source", "left_semi").join(kept.select(F.col("id").alias("target")), "target", "left_semi")
    return kept, inner.select("id", "source", "target", "inCycle")


def selected_node(nodes: DataFrame, node_id: str) -> DataFrame:
    """The unfiltered node of that id, or no row."""
    return nodes.filter(F.col("id") == node_id)


def view_stats(shown_nodes: DataFrame, shown_edges: DataFrame, cycles: DataFrame) -> DataFrame:
    """(nodes, edges, cycles): of the filtered elements, and of all cycles."""
    count = lambda df, name: df.agg(F.count("*").alias(name))
    return count(shown_nodes, "nodes").crossJoin(count(shown_edges, "edges")).crossJoin(count(cycles, "cycles"))  # one row each


def dim_elements(nodes: DataFrame, edges: DataFrame, pattern: str) -> tuple[DataFrame, DataFrame]:
    """``dimmed`` by a plain case-insensitive regular expression; an edge only if both ends are; a bad one dims nothing."""
    import re

    try:
        re.compile(pattern)
        valid = bool(pattern)
    except re.error:
        valid = False
    dimmed = ~F.col("id").rlike("(?i)" + pattern) if valid else F.lit(False)
    marked = nodes.withColumn("dimmed", dimmed)
    end = lambda side: marked.select(F.col("id").alias(side), F.col("dimmed").alias(f"_{side}"))
    both = edges.join(end("source"), "source", "left").join(end("target"), "target", "left")
    return marked, both.select("id", "source", "target", "inCycle", (F.coalesce("_source", F.lit(False)) & F.coalesce("_target", F.lit(False))).alias("dimmed"))


def highlight_elements(nodes: DataFrame, edges: DataFrame, chosen: DataFrame | list[str], selected: str | None = None) -> tuple[DataFrame, DataFrame]:
    """``highlighted`` nodes and edges between two of them, by a list or a table (id) of any size; ``selected`` marks one node."""
    if isinstance(chosen, list):
        chosen = nodes.sparkSession.createDataFrame([(x,) for x in chosen], "id string")
    marks = chosen.select("id").distinct()
    mark = lambda df, c: df.join(marks.select(F.col("id").alias(c), F.lit(True).alias(f"_{c}")), c, "left").withColumn(f"_{c}", F.coalesce(f"_{c}", F.lit(False)))
    marked = mark(nodes, "id").withColumnRenamed("_id", "highlighted").withColumn("selected", F.col("id").eqNullSafe(F.lit(selected)))
    lines = mark(mark(edges, "source"), "target").withColumn("highlighted", F.col("_source") & F.col("_target")).drop("_source", "_target")
    return marked.select(*nodes.columns, "highlighted", "selected"), lines.select(*edges.columns, "highlighted")


def file_name(nodes: DataFrame) -> DataFrame:
    """``nodes`` with ``name``, the last segment of the id."""
    return nodes.withColumn("name", basename(F.col("id")))


def render_edges(edges: DataFrame) -> DataFrame:
    """Edges with the renderer's ids ``edge-source-target-index``; the index follows source and target."""
    from graphloom.functions.ordering import with_index

    return with_index(edges, ["source", "target"], "_i").select(F.concat_ws("-", F.lit("edge"), "source", "target", F.col("_i").cast("string")).alias("id"), "source", "target", "inCycle")


# The sample that the viewer shows before anything is loaded.
SAMPLE = {
    "rootDir": "/project",
    "nodes": [
        {"id": "src/index.ts", "dependencies": ["src/app.ts", "src/utils/helpers.ts"], "dependents": []},
        {"id": "src/app.ts", "dependencies": ["src/components/Button.tsx", "src/services/api.ts"], "dependents": ["src/index.ts"]},
        {"id": "src/utils/helpers.ts", "dependencies": ["src/utils/constants.ts"], "dependents": ["src/index.ts", "src/components/Button.tsx"]},
        {"id": "src/utils/constants.ts", "dependencies": [], "dependents": ["src/utils/helpers.ts"]},
        {"id": "src/components/Button.tsx", "dependencies": ["src/utils/helpers.ts", "src/services/api.ts"], "dependents": ["src/app.ts"]},
        {"id": "src/services/api.ts", "dependencies": ["src/services/auth.ts"], "dependents": ["src/app.ts", "src/components/Button.tsx"]},
        {"id": "src/services/auth.ts", "dependencies": ["src/services/api.ts"], "dependents": ["src/services/api.ts"]},
    ],
    "cycles": [{"chain": ["src/services/api.ts", "src/services/auth.ts", "src/services/api.ts"], "length": 2}],
    "stats": {"totalFiles": 7, "totalDependencies": 9, "circularDependencies": 1},
}


def sample(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """The sample's records (id, dependencies, dependents) and cycles (chain, length), as they are stated."""
    records = spark.createDataFrame([(r["id"], r["dependencies"], r["dependents"]) for r in SAMPLE["nodes"]], "id string, dependencies array<string>, dependents array<string>")
    return records, spark.createDataFrame([(c["chain"], c["length"]) for c in SAMPLE["cycles"]], "chain array<string>, length int")
