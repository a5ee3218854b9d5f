"""SimHash near-duplicates: fingerprints, multi-index hashing, connected components.

Fingerprints are made once per document and then only distinct ones go on, so
groups of exact copies weigh as one row. Two fingerprints of 64 bits that
differ in at most r bits differ, in one of m segments, in at most r // m bits.
So each fingerprint is filed under the value of each of its segments, and looks
up all values in a Hamming ball of that radius around its own; the join's
condition verifies the whole distance, so only true links leave it.

A group of many near copies shares its files, so its pairs are never listed. First
each look-up meets only two members of a file, its lowest and highest; what
they link becomes one class. Then classes meet, one row for each in a file: a class
lies in a Hamming ball around its root, and only where two balls come within
the radius are the members compared.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeweft.llm.common import looked_up, staged

BITS, RADIUS, SHINGLE, SEED = 64, 4, 4, 42
#: What making a look-up costs, in comparisons of fingerprints.
LOOKUP = 64
#: Shingles whose bits are counted at once.
CHUNK = 1 << 14


def fingerprint(text: bytes | None, shingle: int = SHINGLE, once: bool = False) -> int:
    """The fingerprint, as a signed 64-bit integer, of a text in UTF-8; 0 if it has no word. once: repeats of a shingle don't count."""
    words = (text or b"").lower().split()  # bytes: ASCII letters and ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) < shingle:
        spans = [(0, len(joined))]
    else:
        ends = list(accumulate(len(w) + 1 for w in words))
        spans = list(zip([0, *ends], [e - 1 for e in ends[shingle - 1 :]], strict=False))
    digest, total = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64)
    shingles = [joined[a:b] for a, b in spans] if not once else list({joined[a:b] for a, b in spans})
    for k in range(0, len(shingles), CHUNK):
        h = np.array([digest(x, SEED) for x in shingles[k : k + CHUNK]], "<u8")
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * total > len(shingles), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, doc: str = "doc_id", text: str = "text", shingle: int = SHINGLE, once: bool = False) -> DataFrame:
    """(doc, fp): one row per row of docs. A null text counts as empty; its fingerprint is 0."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [fingerprint(x.as_py(), shingle, once) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], names=[doc, "fp"])

    rows = docs.select(F.col(doc).cast("long").alias(doc), F.col(text).cast("binary").alias("t"))
    return rows.mapInArrow(each, f"`{doc}` long, fp long")


def segments(n: int, radius: int = RADIUS) -> list[tuple[int, int]]:
    """(lowest bit, width) of the segments that cost least for n fingerprints: look-ups and the comparisons they lead to.

    At most radius // 2 + 1 segments, so that every ball has a radius of 1 at least, but two in any case.
    """

    def plan(m: int) -> list[tuple[int, int]]:
        widths = [BITS // m + (i < BITS % m) for i in range(m)]
        return [(sum(widths[:i]), w) for i, w in enumerate(widths)]

    def cost(m: int) -> float:
        return sum(sum(comb(w, d) for d in range(radius // m + 1)) * (LOOKUP + n / 2.0**w) for _, w in plan(m))

    return plan(min(range(2, max(2, radius // 2 + 1) + 1), key=cost))


def ball(width: int, radius: int) -> list[int]:
    """All masks of at most radius bits of width."""
    return [sum(1 << b for b in bits) for d in range(radius + 1) for bits in combinations(range(width), d)]


def distance(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def filed(rooted: DataFrame, parts: list[tuple[int, int]]) -> DataFrame:
    """(part, key, *) of rooted(fp, ...): each fingerprint once for each segment, under the segment's value."""
    at = F.explode(F.array(*[F.struct(F.lit(i).alias("part"), F.shiftright("fp", low).bitwiseAND((1 << width) - 1).alias("key")) for i, (low, width) in enumerate(parts)]))
    return rooted.withColumn("at", at).select("at.part", "at.key", *rooted.columns)


def looked(rooted: DataFrame, parts: list[tuple[int, int]], radius: int) -> DataFrame:
    """(part, key, *) of rooted(fp, ...): each fingerprint once for each value in the Hamming ball around each of its segments."""
    masks = F.array(*[F.array(*[F.lit(m).cast("long") for m in ball(width, radius // len(parts))]) for _, width in parts])
    own = filed(rooted, parts)
    return own.withColumn("mask", F.explode(F.element_at(masks, F.col("part") + 1))).withColumn("key", F.col("key").bitwiseXOR(F.col("mask"))).drop("mask")


def leaders(rooted: DataFrame, parts: list[tuple[int, int]], radius: int) -> DataFrame:
    """(root, to, bits): each fingerprint of rooted(fp, root) with the first and last members of the files it looks up that differ in bits <= radius, of another root."""
    ends = filed(rooted, parts).groupBy("part", "key").agg(F.min("root").alias("low"), F.min_by("fp", "root").alias("low_fp"), F.max("root").alias("high"), F.max_by("fp", "root").alias("high_fp"))
    # files and look-ups are many times the rows of rooted, by whose size Spark would choose to broadcast them
    met = looked(rooted, parts, radius).join(ends.hint("merge"), ["part", "key"])
    met = met.where(((F.col("root") != F.col("low")) & (distance("fp", "low_fp") <= radius)) | ((F.col("root") != F.col("high")) & (distance("fp", "high_fp") <= radius)))
    met = met.select("fp", "root", F.explode(F.array(F.struct(F.col("low").alias("root"), F.col("low_fp").alias("fp")), F.struct(F.col("high").alias("root"), F.col("high_fp").alias("fp")))).alias("end"))
    return met.select("root", F.col("end.root").alias("to"), distance("fp", "end.fp").alias("bits")).where((F.col("root") != F.col("to")) & (F.col("bits") <= radius))


def pairs(rooted: DataFrame, parts: list[tuple[int, int]], radius: int) -> DataFrame:
    """(a, b), distinct: the roots that leaders() links."""
    return leaders(rooted, parts, radius).select(F.least("root", "to").alias("a"), F.greatest("root", "to").alias("b")).distinct()


def few(rooted: DataFrame, parts: list[tuple[int, int]], radius: int) -> DataFrame:
    """(a, b): of the pairs of leaders() three for each root at most: with the smallest, the greatest and the closest."""
    ends = leaders(rooted, parts, radius).groupBy("root").agg(F.min("to").alias("x"), F.max("to").alias("y"), F.min_by("to", "bits").alias("z"))
    each = ends.select("root", F.explode(F.array_distinct(F.array("x", "y", "z"))).alias("to"))
    return each.select(F.least("root", "to").alias("a"), F.greatest("root", "to").alias("b"))


def links(rooted: DataFrame, parts: list[tuple[int, int]], radius: int) -> DataFrame:
    """(a, b): all pairs of different roots of rooted(fp, root) that some fingerprints of theirs link; a root is one of its fingerprints."""
    reach = F.max(distance("fp", "root"))
    files = filed(rooted, parts).withColumnRenamed("fp", "b").withColumnRenamed("root", "b_root")
    looks = looked(rooted, parts, radius).withColumnRenamed("fp", "a").withColumnRenamed("root", "a_root")
    there = filed(rooted, parts).groupBy("part", "key", F.col("root").alias("b_root")).agg(reach.alias("b_reach"))
    here = looked(rooted, parts, radius).groupBy("part", "key", F.col("root").alias("a_root")).agg(reach.alias("a_reach"))
    close = (F.col("a_root") < F.col("b_root")) & (distance("a_root", "b_root") <= radius + F.col("a_reach") + F.col("b_reach"))
    met = staged(here.alias("h").join(there.hint("merge").alias("t"), (F.col("h.part") == F.col("t.part")) & (F.col("h.key") == F.col("t.key")) & close).select("h.part", "h.key", "a_root", "a_reach", "b_root", "b_reach"), "classes")
    # two fingerprints alone are linked if they are close at all
    alone = (F.col("a_reach") == 0) & (F.col("b_reach") == 0)
    half = looks.join(met.where(~alone), ["part", "key", "a_root"]).where(distance("a", "b_root") <= radius + F.col("b_reach"))
    both = half.join(files, ["part", "key", "b_root"]).where(distance("a", "b") <= radius)
    return met.where(alone).select(F.col("a_root").alias("a"), F.col("b_root").alias("b")).unionByName(both.select(F.col("a_root").alias("a"), F.col("b_root").alias("b"))).distinct()


def renamed(rooted: DataFrame, roots: DataFrame, key: str) -> DataFrame:
    """rooted(key, root) with each root replaced by its own in roots(node, root); a result of staged()."""
    to = roots.select(F.col("node").alias("root"), F.col("root").alias("to"))
    return staged(rooted.join(to, "root", "left").select(key, F.coalesce("to", "root").alias("root")), "roots")


def linked(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(fp, root): the components of the distinct fingerprints fps(fp) under links of at most radius bits, root being the smallest."""
    parts = segments(fps.count(), radius)
    rooted = fps.select("fp", F.col("fp").alias("root"))
    for found in (pairs, links):
        rooted = renamed(rooted, components(found(rooted, parts, radius)), "fp")
    return rooted


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of edges(a, b), a != b, root being the smallest of its component.

    Large-star and small-star steps (Kiveris and others, 2014) until every edge
    leads to a root; each is a sum by node and a join, so no neighbourhood is
    gathered in a task, and each round is written to the shared folder.
    """
    edges = staged(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), "edges")

    def tangled() -> bool:
        """Whether some node has two parents, or a parent and a child."""
        ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        return not ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 OR up + down > 1").isEmpty()

    while tangled():
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").unionByName(low.select("u", F.col("m").alias("v")))
        edges = staged(small.distinct(), "edges", instead_of=edges)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def named(rooted: DataFrame, least: DataFrame, key: str) -> DataFrame:
    """(key, n, component_id) of rooted(key, root): the smallest least of a root's keys in least(key, least, n)."""
    placed = staged(rooted.join(least, key), "placed")
    smallest = staged(placed.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("keys")), "smallest")
    return looked_up(placed.select(key, "n", "root"), smallest, "root", "keys").select(key, "n", "component_id")


def near_duplicates(docs: DataFrame, doc: str = "doc_id", text: str = "text", radius: int = RADIUS, shingle: int = SHINGLE, once: bool = False) -> DataFrame:
    """(doc, fp, component_id): one row per row of docs; the smallest doc id that links reach, itself included.

    Null and blank texts have fingerprint 0 and are linked like any other. Rows that
    repeat an id are linked each on its own. A null id counts for no component's
    smallest; a component of such rows alone has a null id. Ties don't matter: equal
    fingerprints are one node. An empty table gives an empty result.
    """
    marked = staged(fingerprints(docs, doc, text, shingle, once), "fingerprints")
    first = staged(marked.groupBy("fp").agg(F.min(doc).alias("least"), F.count(F.lit(1)).alias("n")), "distinct")
    components_of = staged(named(linked(first.select("fp"), radius), first, "fp"), "named")
    return looked_up(marked, components_of, "fp", "n").select(doc, "fp", "component_id")


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns."""
    found = near_duplicates(docs.select("doc_id", "text"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
