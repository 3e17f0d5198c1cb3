"""The dependency graph: a table of nodes and a table of edges.

Order is data: ``nodes.ord`` and ``edges.pos`` rise with the first mention of a
node and of a source's target; they need not be dense. Graphs are values: what
changes one returns another.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession, functions as F

from graphloom.functions.lineage import cut
from graphloom.operators.fixpoint import reachable
from graphloom.schema import EDGES_SCHEMA, NODES_SCHEMA


@dataclass(frozen=True)
class Graph:
    nodes: DataFrame
    edges: DataFrame
    root_dir: str = ""

    # construction

    @staticmethod
    def empty(spark: SparkSession, root_dir: str = "") -> Graph:
        return Graph(spark.createDataFrame([], NODES_SCHEMA), spark.createDataFrame([], EDGES_SCHEMA), root_dir)

    @staticmethod
    def from_mentions(mentions: DataFrame, root_dir: str = "") -> Graph:
        """From rows (src, dst, seq) in the order of ``seq`` (unique): an edge, or only a node where ``dst`` is null."""
        both = F.array(F.struct(F.col("src").alias("p"), (F.col("seq") * 2).alias("o")), F.struct(F.col("dst").alias("p"), (F.col("seq") * 2 + 1).alias("o")))
        nodes = mentions.select(F.inline(both)).filter("p IS NOT NULL").groupBy(F.col("p").alias("file_path")).agg(F.min("o").alias("ord"))
        pairs = mentions.filter("dst IS NOT NULL").groupBy("src", "dst").agg(F.min("seq").alias("pos"))
        edges = pairs.join(nodes.select(F.col("file_path").alias("src"), F.col("ord").alias("src_ord")), "src")
        return Graph(nodes, edges.select("src", "dst", "src_ord", "pos"), root_dir)

    @staticmethod
    def from_edges(spark: SparkSession, edges: list[tuple[str, str]], root_dir: str = "") -> Graph:
        rows = [(a, b, i) for i, (a, b) in enumerate(edges)]
        return Graph.from_mentions(spark.createDataFrame(rows, "src string, dst string, seq long"), root_dir)

    def cut(self) -> Graph:
        """The same graph read from checkpoints, for many queries."""
        return replace(self, nodes=cut(self.nodes), edges=cut(self.edges))

    def _next(self) -> int:
        a = self.nodes.agg(F.max("ord")).first()[0]
        b = self.edges.agg(F.max("pos")).first()[0]
        return max(-1 if a is None else a, -1 if b is None else 2 * b + 1) // 2 + 1

    def add_edges(self, pairs: list[tuple[str, str | None]]) -> Graph:
        """With further edges (only a node where the target is None), in their order."""
        first = self._next()
        spark = self.nodes.sparkSession
        new = Graph.from_mentions(spark.createDataFrame([(a, b, first + i) for i, (a, b) in enumerate(pairs)], "src string, dst string, seq long"))
        nodes = self.nodes.unionByName(new.nodes).groupBy("file_path").agg(F.min("ord").alias("ord"))
        every = self.edges.select("src", "dst", "pos").unionByName(new.edges.select("src", "dst", "pos")).groupBy("src", "dst").agg(F.min("pos").alias("pos"))
        edges = every.join(nodes.select(F.col("file_path").alias("src"), F.col("ord").alias("src_ord")), "src")
        return replace(self, nodes=nodes, edges=edges.select("src", "dst", "src_ord", "pos"))

    def add_node(self, path: str) -> Graph:
        return self.add_edges([(path, None)])

    def add_edge(self, source: str, target: str) -> Graph:
        return self.add_edges([(source, target)])

    def remove_node(self, path: str) -> Graph:
        """Without the node and its edges; its neighbours stay."""
        return replace(self, nodes=self.nodes.filter(F.col("file_path") != path), edges=self.edges.filter((F.col("src") != path) & (F.col("dst") != path)))

    def remove_edge(self, source: str, target: str) -> Graph:
        return replace(self, edges=self.edges.filter((F.col("src") != source) | (F.col("dst") != target)))

    def clear(self) -> Graph:
        return Graph.empty(self.nodes.sparkSession, self.root_dir)

    def with_root_dir(self, root_dir: str) -> Graph:
        return replace(self, root_dir=root_dir)

    # storage

    def write(self, folder: str) -> None:
        self.nodes.write.mode("overwrite").parquet(f"{folder}/nodes")
        self.edges.write.mode("overwrite").parquet(f"{folder}/edges")
        self.nodes.sparkSession.createDataFrame([(self.root_dir,)], "root_dir string").write.mode("overwrite").json(f"{folder}/root")

    @staticmethod
    def read(spark: SparkSession, folder: str) -> Graph:
        root = spark.read.schema("root_dir string").json(f"{folder}/root").first()
        return Graph(spark.read.schema(NODES_SCHEMA).parquet(f"{folder}/nodes"), spark.read.schema(EDGES_SCHEMA).parquet(f"{folder}/edges"), root[0] if root and root[0] else "")

    # lookups

    def has_node(self, path: str) -> bool:
        return not self.nodes.filter(F.col("file_path") == path).isEmpty()

    def has_edge(self, source: str, target: str) -> bool:
        return not self.edges.filter((F.col("src") == source) & (F.col("dst") == target)).isEmpty()

    def ordered_nodes(self) -> DataFrame:
        return self.nodes.orderBy("ord")

    def ordered_edges(self) -> DataFrame:
        return self.edges.orderBy("src_ord", "pos")

    def node_count(self) -> int:
        return self.nodes.count()

    def edge_count(self) -> int:
        return self.edges.count()

    def dependencies(self, path: str) -> DataFrame:
        """(file_path, pos): direct targets in order; none for an unknown path."""
        return self.edges.filter(F.col("src") == path).select(F.col("dst").alias("file_path"), "pos").orderBy("pos")

    def dependents(self, path: str) -> DataFrame:
        return self.edges.filter(F.col("dst") == path).select(F.col("src").alias("file_path"), "pos").orderBy("pos")

    def adjacency(self) -> DataFrame:
        """(file_path, ord, dependencies, dependents): each node with its ordered lists."""
        gather = lambda key, value: self.edges.groupBy(F.col(key).alias("file_path")).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", value))), lambda x: x[value]).alias("dependencies" if key == "src" else "dependents"))
        none = F.array().cast("array<string>")
        both = self.nodes.join(gather("src", "dst"), "file_path", "left").join(gather("dst", "src"), "file_path", "left")
        return both.select("file_path", "ord", F.coalesce("dependencies", none).alias("dependencies"), F.coalesce("dependents", none).alias("dependents"))

    def node(self, path: str) -> DataFrame:
        """The row of ``adjacency`` of one path, or none."""
        return replace(self, nodes=self.nodes.filter(F.col("file_path") == path), edges=self.edges.filter((F.col("src") == path) | (F.col("dst") == path))).adjacency()

    def transitive_dependencies(self, path: str) -> DataFrame:
        """(file_path): all that one edge or more lead to; the path itself only if it is on a cycle."""
        return self._reached(path, False)

    def transitive_dependents(self, path: str) -> DataFrame:
        return self._reached(path, True)

    def _reached(self, path: str, reverse: bool) -> DataFrame:
        start = self.nodes.sparkSession.createDataFrame([(path,)], "node string")
        return reachable(self.edges, start, reverse).select(F.col("node").alias("file_path"))

    # degrees

    def degrees(self) -> DataFrame:
        """(file_path, ord, out, in) for every node."""
        out = self.edges.groupBy(F.col("src").alias("file_path")).agg(F.count("*").alias("out"))
        into = self.edges.groupBy(F.col("dst").alias("file_path")).agg(F.count("*").alias("in"))
        both = self.nodes.join(out, "file_path", "left").join(into, "file_path", "left")
        return both.select("file_path", "ord", F.coalesce("out", F.lit(0).cast("long")).alias("out"), F.coalesce("in", F.lit(0).cast("long")).alias("in"))

    def _top(self, key: str, limit: int) -> DataFrame:
        if limit < 0:
            raise ValueError("limit must not be negative")
        counts = self.edges.groupBy(F.col(key).alias("file_path")).agg(F.count("*").alias("count"))
        all_nodes = self.nodes.join(counts, "file_path", "left").withColumn("count", F.coalesce("count", F.lit(0).cast("long")))
        return all_nodes.orderBy(F.desc("count"), "ord").limit(limit).select(F.col("file_path").alias("file"), "count")

    def top_dependencies(self, limit: int = 10) -> DataFrame:
        """(file, count): most direct targets first, ties in node order, zeros included."""
        return self._top("src", limit)

    def top_dependents(self, limit: int = 10) -> DataFrame:
        return self._top("dst", limit)

    def _sources(self) -> DataFrame:
        return self.edges.select(F.col("src").alias("file_path"))

    def _targets(self) -> DataFrame:
        return self.edges.select(F.col("dst").alias("file_path"))

    def orphans(self) -> DataFrame:
        """Nodes without any edge."""
        return self.nodes.join(self._sources(), "file_path", "left_anti").join(self._targets(), "file_path", "left_anti")

    def leaves(self) -> DataFrame:
        """Nodes that depend on others and that none depends on."""
        return self.nodes.join(self._sources(), "file_path", "left_semi").join(self._targets(), "file_path", "left_anti")

    def roots(self) -> DataFrame:
        """Nodes that others depend on and that depend on none."""
        return self.nodes.join(self._targets(), "file_path", "left_semi").join(self._sources(), "file_path", "left_anti")
