"""Benchmark decontamination: MinHash containment search, partitioned by size.

An item with n distinct shingles that a document contains to a share of at
least t lacks at most n - ceil(t n) of them there. So of any n - ceil(t n) + 1 of its
shingles one at least is in the document. Items are partitioned by size (powers
of two); the sketch of an item is its k smallest shingle hashes (bottom-k
MinHash), k being what the largest size of its partition needs. Documents that
hold none of an item's sketch can't contain it, however long they are, so the
search loses nothing.

The search looks at hashes of documents only and meets sketches only: it gives
candidate pairs. For these, and for no other document, the shingles themselves
are made and counted.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeweft.llm.common import discard, staged, words_of

SHINGLE, LEAST = 5, 0.8
#: Sketch rows broadcast at once, of a hash and an item's number; more are searched in as many blocks as it takes.
BLOCK = 1_000_000


def words(text: str) -> Column:
    """Lower-cased words of a text; null is empty."""
    return words_of(F.lower(F.coalesce(F.col(text), F.lit(""))))


def shingles(own: Column, n: int = SHINGLE) -> Column:
    """array<string>: the shingles of words (a column of its own), joined by one space, repeats left out."""
    runs = F.transform(F.sequence(F.lit(1), F.size(own) - (n - 1)), lambda i: F.array_join(F.slice(own, i, n), " "))
    return F.when(F.size(own) >= n, F.array_distinct(runs)).otherwise(F.array().cast("array<string>"))


def hashes(own: Column, n: int = SHINGLE) -> Column:
    """array<bigint>: a hash for each shingle, from the hashes of the words (a column of its own)."""
    runs = F.transform(F.sequence(F.lit(1), F.size(own) - (n - 1)), lambda i: F.xxhash64(F.slice(own, i, n)))
    return F.when(F.size(own) >= n, runs).otherwise(F.array().cast("array<bigint>"))


def hashed(rows: DataFrame, text: str, *keep: Column) -> DataFrame:
    """keep, and one row for each shingle of a text of rows: its hash h."""
    own = rows.select(*keep, F.transform(words(text), lambda w: F.xxhash64(w)).alias("_w"))
    return own.select(*own.columns[:-1], F.explode(hashes(F.col("_w"))).alias("h"))


def sketched(items: DataFrame, item: str = "item_id", text: str = "text", least: float = LEAST) -> DataFrame:
    """(item, n, size_class, h): the bottom-k sketch of each item, n being how many distinct shingles it has."""
    own = hashed(items, text, F.col(item)).distinct()
    whole = Window.partitionBy(item)
    sized = own.withColumns({"n": F.count(F.lit(1)).over(whole), "rank": F.row_number().over(whole.orderBy("h"))})
    sized = sized.withColumn("size_class", F.ceil(F.log2("n")).cast("int"))
    largest = F.pow(F.lit(2.0), F.col("size_class"))
    k = largest - F.ceil(F.round(largest * least, 6)) + 1
    return sized.where(F.col("rank") <= k).select(item, "n", "size_class", "h")


def candidates(docs: DataFrame, sketch: DataFrame, doc: str, item: str, text: str) -> DataFrame:
    """(doc, item), distinct: documents that hold a hash of an item's sketch(item, h); a result of staged().

    The sketches are broadcast in blocks of about BLOCK rows. With several blocks
    the documents' hashes are made once and written.
    """
    blocks = max(1, math.ceil(sketch.count() / BLOCK))
    held = hashed(docs, text, F.col(doc))
    if blocks > 1:
        held = staged(held, "held")
    found = None
    for b in range(blocks):
        block = sketch.select(item, "h") if blocks == 1 else sketch.where(F.pmod(F.xxhash64("h"), F.lit(blocks)) == b).select(item, "h")
        hits = held.join(F.broadcast(block), "h").select(doc, item)
        found = hits if found is None else found.unionByName(hits)
    out = staged(found.distinct(), "candidates")
    if blocks > 1:
        discard(held)
    return out


def contained(docs: DataFrame, items: DataFrame, doc: str = "doc_id", item: str = "item_id", text: str = "text", least: float = LEAST) -> DataFrame:
    """(doc, item, n_item, n_shared, containment): all pairs whose containment is at least least, once each.

    Items of fewer than SHINGLE words have no shingle and are never found. An id
    that comes with several texts, or several times, stands for the union of their
    shingles, on either side. Null and empty texts have none. A null doc or item
    id is an id like any other. Empty tables on either side give an empty result.
    """
    items = items.select(F.col(item).alias("_item"), F.col(text).alias("_text"))
    docs = docs.select(F.col(doc).alias("_doc"), F.col(text).alias("_text"))
    sketch = staged(sketched(items, "_item", "_text", least), "sketch")
    pairs = candidates(docs, sketch, "_doc", "_item", "_text")
    # the texts of candidates alone, and their shingles
    some = docs.join(pairs.select(F.col("_doc").alias("_d")).distinct(), F.col("_doc").eqNullSafe(F.col("_d")), "left_semi")
    some = some.select("_doc", words("_text").alias("_w")).select("_doc", shingles(F.col("_w")).alias("_s"))
    wanted = items.select("_item", words("_text").alias("_w")).select(F.col("_item").alias("_i"), shingles(F.col("_w")).alias("_t")).where(F.size("_t") > 0)
    named = pairs.select(F.col("_doc").alias("_d"), "_item")
    both = some.join(named, F.col("_doc").eqNullSafe(F.col("_d"))).join(wanted, F.col("_item").eqNullSafe(F.col("_i")))
    shared = both.select("_doc", "_item", F.explode(F.array_intersect("_s", "_t")).alias("shingle")).distinct()
    sizes = wanted.select("_i", F.explode("_t").alias("shingle")).distinct().groupBy("_i").agg(F.count(F.lit(1)).alias("n_item"))
    counted = shared.groupBy("_doc", "_item").agg(F.count(F.lit(1)).alias("n_shared")).join(sizes, F.col("_item").eqNullSafe(F.col("_i")))
    share = F.round(F.col("n_shared") / F.col("n_item"), 6)
    return counted.where(F.col("n_shared") >= least * F.col("n_item") - 1e-9).select(F.col("_doc").alias(doc), F.col("_item").alias(item), "n_item", "n_shared", share.alias("containment"))
