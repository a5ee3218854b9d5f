"""Files to rows: parsers run in Python workers over Arrow batches, their results are exploded into tables."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from codeweft import schema

#: Bytes of sources whose rows make one Arrow batch.
BATCH_BYTES = 4 << 20


def parse_files(files: DataFrame) -> DataFrame:
    """schema.PARSED of files(path, rel_path, language, file_hash, content), a row per file.

    Bytes that are no UTF-8 are replaced. A file that can't be parsed has its File
    symbol, what was found before the fault, and an error text.
    """
    kind = to_arrow_schema(schema.PARSED)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from codeweft.sources.parsers import parse

        rows, held = [], 0
        for b in batches:
            for path, rel, language, digest, content in zip(*(c.to_pylist() if k < 4 else c for k, c in enumerate(b.columns)), strict=True):
                text = content.as_py() or b""
                p = parse(text.decode("utf-8", "replace"), rel, language)
                rows.append({
                    "file_path": path, "file_rel_path": rel, "language": language, "file_hash": digest, "imports": list(p.imports.items()), "error": p.error,
                    "symbols": [dict(zip(schema.SYMBOL.names, s, strict=True)) for s in p.symbols],
                    "edges": [dict(zip(schema.EDGE.names, e, strict=True)) for e in p.edges],
                    "calls": [{"caller_qname": c, "raw_callee": r, "line": n, "file_rel_path": rel} for c, r, n in p.calls],
                })
                held += len(text)
                if held >= BATCH_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, kind)
                    rows, held = [], 0
        yield pa.RecordBatch.from_pylist(rows, kind)

    return files.select("path", "rel_path", "language", "file_hash", "content").mapInArrow(each, schema.PARSED)


def exploded(parsed: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, call sites, imports) of parsed files."""
    nodes = parsed.select("file_path", "file_rel_path", "language", "file_hash", F.explode("symbols").alias("s")).select(
        "s.kind", "s.name", "s.qualified_name", F.col("s.qualified_name").alias("node_id"), "file_path", "file_rel_path", "s.line_start", "s.line_end", "language", "file_hash", F.lit(False).alias("external"),
    )
    edges = parsed.select(F.explode("edges").alias("e")).select("e.*")
    calls = parsed.select(F.explode("calls").alias("c")).select("c.*")
    imports = parsed.select("file_rel_path", F.explode("imports").alias("local_name", "module"))
    return nodes, edges, calls, imports
