"""The query tool: Cypher in, a dictionary of rows out, errors as messages."""

from __future__ import annotations

import os
from typing import Any

from pyspark.errors import PySparkException
from pyspark.sql import SparkSession

from codeweft.operators.graph import CodeGraph
from codeweft.operators.store import GraphStore
from codeweft.plans import cypher

STORE_FOLDER = ".codeweft/graph"


def _error(message: str) -> dict[str, Any]:
    return {"rows": [], "count": 0, "summary": message, "error": message}


def query_graph(graph: CodeGraph, text: str, params: dict[str, Any] | None = None, most_rows: int | None = None) -> dict[str, Any]:
    """rows, count and summary of a reading query; an error key, and no rows, where it can't be answered.

    All rows are returned, as one answer; give most_rows where the answer must stay
    small: count is that of all rows, and truncated says whether some are missing.
    """
    try:
        cypher.parse(text)
    except cypher.QueryError as e:
        return _error(str(e))
    if graph.nodes.isEmpty():
        return _error("the graph is empty: build it first")
    try:
        df = cypher.run(graph, text, params).persist()
        try:
            n = df.count()
            rows = [r.asDict(recursive=True) for r in (df if most_rows is None else df.limit(most_rows)).toLocalIterator()]
        finally:
            df.unpersist()
    except (cypher.QueryError, PySparkException) as e:
        return _error(f"the query failed: {str(e).splitlines()[0]}")
    answer = {"rows": rows, "count": n, "summary": f"Query returned {n} row(s)."}
    return answer if most_rows is None else answer | {"truncated": len(rows) < n}


def query_root(spark: SparkSession, text: str, root: str = ".") -> dict[str, Any]:
    """query_graph over the store of a source tree."""
    if not text or not text.strip():
        return _error("the query is empty")
    if not os.path.isdir(root):
        return _error(f"{root} is not a folder" if os.path.exists(root) else f"{root} does not exist")
    return query_graph(GraphStore(spark, f"file:{os.path.abspath(root)}/{STORE_FOLDER}").graph(), text)
