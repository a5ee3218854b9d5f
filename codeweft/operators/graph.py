"""The graph as a value: two tables, and the simple operators on them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeweft.functions import last_segment
from codeweft.staging import staged


@dataclass(frozen=True)
class CodeGraph:
    """nodes and edges as codeweft.schema has them; edge ends are node_ids."""

    nodes: DataFrame
    edges: DataFrame

    def staged(self) -> CodeGraph:
        """The graph written once to the shared folder, for operators that read it several times."""
        return CodeGraph(staged(self.nodes, "nodes"), staged(self.edges, "edges"))

    def of_kind(self, kind: str) -> DataFrame:
        return self.edges.where(F.col("kind") == kind)

    def real_nodes(self) -> DataFrame:
        """Nodes with a qualified name that aren't External; a null kind is dropped, as <> does."""
        return self.nodes.where("kind <> 'External' AND qualified_name IS NOT NULL AND qualified_name <> ''")


def external_nodes(targets: DataFrame, nodes: DataFrame) -> DataFrame:
    """Placeholder nodes for the ids targets(target) that nodes lacks; no qualified name, named by the last segment."""
    unknown = targets.select(F.col("target").alias("node_id")).where("node_id <> ''").distinct().join(nodes.select("node_id"), "node_id", "left_anti")
    return unknown.select(
        F.lit("External").alias("kind"), last_segment("node_id").alias("name"), F.lit(None).cast("string").alias("qualified_name"), "node_id",
        F.lit("").alias("file_path"), F.lit("").alias("file_rel_path"), F.lit(0).alias("line_start"), F.lit(0).alias("line_end"),
        F.lit("").alias("language"), F.lit("").alias("file_hash"), F.lit(True).alias("external"),
    )


def file_subgraph(graph: CodeGraph, path: str) -> CodeGraph:
    """The real nodes of one file and all edges that leave them, CALLS included."""
    nodes = graph.real_nodes().where(F.col("file_rel_path") == path)
    return CodeGraph(nodes, graph.edges.join(nodes.select(F.col("node_id").alias("source")), "source", "left_semi").select("kind", "source", "target"))


def without_files(graph: CodeGraph, paths: DataFrame) -> CodeGraph:
    """The graph without the nodes of files paths(file_rel_path) and without the edges at either end of those."""
    gone = graph.nodes.join(paths, "file_rel_path", "left_semi").select("node_id").distinct()
    nodes = graph.nodes.join(paths.select("file_rel_path"), "file_rel_path", "left_anti").select(*graph.nodes.columns)
    edges = graph.edges.join(gone.withColumnRenamed("node_id", "source"), "source", "left_anti")
    edges = edges.join(gone.withColumnRenamed("node_id", "target"), "target", "left_anti")
    return CodeGraph(nodes, edges.select(*graph.edges.columns))


def kind_counts(nodes: DataFrame) -> DataFrame:
    """(kind, n) in one pass."""
    return nodes.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def stats(graph: CodeGraph) -> DataFrame:
    """One row: node_count and edge_count, External included."""
    n = graph.nodes.agg(F.count(F.lit(1)).alias("node_count"))
    return n.crossJoin(graph.edges.agg(F.count(F.lit(1)).alias("edge_count")))


def uncalled(graph: CodeGraph, kind: str = "Function", relation: str = "CALLS") -> DataFrame:
    """Nodes of a kind that no edge of the relation reaches."""
    called = graph.of_kind(relation).select(F.col("target").alias("node_id"))
    return graph.nodes.where(F.col("kind") == kind).join(called, "node_id", "left_anti")


def subclasses(graph: CodeGraph, base: str) -> DataFrame:
    """Nodes that inherit from or implement base, given by its raw name or its node id."""
    edges = graph.edges.where(F.col("kind").isin("INHERITS", "IMPLEMENTS") & ((F.col("target") == base) | (last_segment("target") == base)))
    return graph.nodes.join(edges.select(F.col("source").alias("node_id")), "node_id", "left_semi")
