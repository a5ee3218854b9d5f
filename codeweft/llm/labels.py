"""Labelled samples of bounded size, for operators that are fitted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeweft.llm.common import bounded_ids


def fold(doc: str | Column, parts: int) -> Column:
    """crc32 of the id as text, modulo parts; null for a null id."""
    doc = F.col(doc) if isinstance(doc, str) else doc
    return F.pmod(F.crc32(doc.cast("string").cast("binary")), F.lit(parts))


def sampled(docs: DataFrame, labels: DataFrame, label: str, seen: Column, limit: int, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, text, y): at most limit labelled rows among those where seen holds.

    Only ids and labels are sampled by hash, at most limit of them, so the side
    that is broadcast is bounded. An id with several labels counts by its greatest.
    """
    known = labels.where(F.col(label).isNotNull() & F.col(doc).isNotNull() & seen)
    known = known.groupBy(F.col(doc).alias("_id")).agg(F.max(label).cast("int").alias("y"))
    chosen = bounded_ids(known, limit)
    own = docs.select(F.col(doc).alias("_doc"), F.col(text).alias("_text"))
    return own.join(F.broadcast(chosen), F.col("_doc") == F.col("_id")).select(F.col("_doc").alias(doc), F.col("_text").alias(text), "y")
