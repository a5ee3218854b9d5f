"""Substring dedup: Rabin-Karp hashes of all word windows, counted by hash, merged into removal intervals.

Each task hashes every window of its documents (a rolling polynomial modulo
2**64 over 64-bit word hashes) and sends, to the bucket that owns a hash
range, blocks of hashes by document: about 9 bytes for each window. Of the
documents of a block that share a window only the one with the smallest id goes
there: the others are known to lose it, and are sent to their own bucket. So
a passage in a third of all documents weighs one entry for each block. A bucket
finds the hashes whose window starts in several documents and returns, to the
documents other than the one with the smallest id, the hashes to remove. A
third step brings them together with the texts, marks the windows again and
merges them into maximal intervals. Buckets split the hash range and the
documents evenly; there are as many as the size of the texts asks for.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeweft.llm.common import staged

WINDOW = 50
#: Windows held by a task before their blocks are sent, and bytes of text that make a bucket.
FLUSH, BUCKET = 2_000_000, 48 << 20
#: Odd base of the polynomial and odd multiplier of the last mixing (fixed values).
BASE, MIX = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
WORD_SEED = 7


class Powers:
    """BASE ** i and BASE ** -i modulo 2**64, made as far as they are asked for."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            grow = lambda base: np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, base, np.uint64)]), dtype=np.uint64)
            self.up, self.down = grow(BASE), grow(pow(BASE, -1, 1 << 64))
        return self.up[:n], self.down[:n]


POWERS = Powers()


def window_hashes(words: list[bytes], window: int = WINDOW) -> np.ndarray:
    """uint64 hash of each window of words, in order; empty if there are fewer."""
    n = len(words) - window + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(w, WORD_SEED) for w in words], np.uint64)
    up, down = POWERS.get(len(words))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * up, dtype=np.uint64)])
    rolled = (sums[window:] - sums[:-window]) * down[:n]
    rolled ^= rolled >> np.uint64(32)
    rolled *= np.uint64(MIX)
    return rolled ^ (rolled >> np.uint64(29))


BLOCK = pa.schema([("bucket", pa.int32()), ("late", pa.bool_()), ("docs", pa.binary()), ("counts", pa.binary()), ("hashes", pa.binary())])
BLOCK_DDL = "bucket int, late boolean, docs binary, counts binary, hashes binary"


def blocks(owner: np.ndarray, ids: np.ndarray, hashes: np.ndarray, late: bool) -> list[tuple]:
    """Rows of BLOCK, one for each bucket that has some of the entries (id, hash): its ids, how many hashes each has, the hashes in that order."""
    order = np.lexsort((ids, owner))
    owner, ids, hashes = owner[order], ids[order], hashes[order]
    cuts = np.flatnonzero(np.diff(owner)) + 1
    rows = []
    for a, b in zip([0, *cuts], [*cuts, len(owner)], strict=True):
        if a < b:
            own, n = np.unique(ids[a:b], return_counts=True)
            rows.append((int(owner[a]), late, own.astype("<i8").tobytes(), n.astype("<u4").tobytes(), hashes[a:b].tobytes()))
    return rows


def table_of(rows: list[tuple]) -> pa.Table:
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [[]] * len(BLOCK), BLOCK.types, strict=True)], schema=BLOCK)


def unpacked(blocks: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(document id, hash) of all entries of some blocks."""
    joined = lambda name, kind: np.concatenate([np.frombuffer(x, kind) for x in blocks[name].to_pylist()] or [np.empty(0, kind)])
    return np.repeat(joined("docs", "<i8"), joined("counts", "<u4")), joined("hashes", "<u8")


def hash_bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)


def doc_bucket(ids: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of a document id; the same everywhere."""
    return hash_bucket(ids.astype(np.int64).view(np.uint64) * np.uint64(BASE), buckets)


def split(ids: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The entries in order of hash, then id, and which of them have a larger id than the first of their hash."""
    order = np.lexsort((ids, hashes))
    ids, hashes = ids[order], hashes[order]
    first = np.concatenate([[True], hashes[1:] != hashes[:-1]]) if len(hashes) else np.zeros(0, bool)
    return ids, hashes, ids > ids[np.flatnonzero(first)][np.cumsum(first) - 1]


def repeated(docs: DataFrame, doc: str, text: str, window: int, buckets: int) -> DataFrame:
    """Blocks, by the documents' bucket, of hashes that start in a document with a smaller id."""

    def sent(ids: list, held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        ids, hashes, late = split(np.repeat(np.array(ids, np.int64), list(map(len, held))), np.concatenate(held))
        rows = blocks(hash_bucket(hashes[~late], buckets), ids[~late], hashes[~late], False)
        yield from table_of(rows + blocks(doc_bucket(ids[late], buckets), ids[late], hashes[late], True)).to_batches()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, held, total = [], [], 0
        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                found = np.unique(window_hashes((t.as_py() or b"").split(), window)) if i is not None else ()
                if len(found):
                    ids.append(i), held.append(found)
                    total += len(found)
                if total >= FLUSH:
                    yield from sent(ids, held)
                    ids, held, total = [], [], 0
        if total:
            yield from sent(ids, held)

    def counted(own: pa.Table) -> pa.Table:
        mark = own["late"].to_pylist()
        ids, hashes, late = split(*unpacked(own.filter(pa.array([not x for x in mark]))))
        known, their = unpacked(own.filter(own["late"]))
        ids, hashes = np.concatenate([ids[late], known]), np.concatenate([hashes[late], their])
        return table_of(blocks(doc_bucket(ids, buckets), ids, hashes, True))

    source = docs.select(F.col(doc).cast("long"), F.col(text).cast("binary"))
    return source.mapInArrow(hashed, BLOCK_DDL).groupBy("bucket").applyInArrow(counted, BLOCK_DDL)


def cover(marked: np.ndarray, window: int) -> list[tuple[int, int]]:
    """Maximal intervals (start, end exclusive) of words under windows at these sorted starts."""
    out: list[tuple[int, int]] = []
    for s in marked.tolist():
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], s + window)
        else:
            out.append((s, s + window))
    return out


def remove_repeats(docs: DataFrame, doc: str = "doc_id", text: str = "text", window: int = WINDOW, keep_text: bool = True) -> DataFrame:
    """(doc, n_words, n_removed, intervals, kept_sha256[, kept]): one row per row of docs.

    A word goes if a window of window words over it also starts, word for word, in
    a document with a smaller id. intervals are the maximal runs of words removed;
    kept is the rest, joined by one space (left out unless keep_text). Null texts
    are empty. Rows with a null id neither lose words nor make others lose some;
    rows that repeat an id don't make each other lose any. Windows are compared by
    64-bit hashes: among n windows a false match of a given one has a chance of n / 2**64.
    """
    size = docs.agg(F.sum(F.octet_length(F.col(text).cast("string")))).first()[0] or 0
    buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / BUCKET))
    flagged = staged(repeated(docs, doc, text, window, buckets), "repeated")
    cells = pa.schema([("bucket", pa.int32()), ("doc", pa.int64()), ("size", pa.int64()), ("cell", pa.binary())])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze, row = pa.Codec("zstd", compression_level=1), 0
        for b in batches:
            ids = b.column(0).to_pylist()
            home = doc_bucket(np.array([row + k if i is None else i for k, i in enumerate(ids)], np.int64), buckets)  # those without an id are dealt in turn
            row += len(ids)
            texts = [t.as_py() or b"" for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([pa.array(home, pa.int32()), pa.array(ids, pa.int64()), pa.array(map(len, texts), pa.int64()), pa.array([squeeze.compress(t, asbytes=True) for t in texts], pa.binary())], schema=cells)

    def cleaned(own: pa.Table, marks: pa.Table) -> pa.Table:
        squeeze = pa.Codec("zstd")
        ids, hashes = unpacked(marks)
        order = np.argsort(ids, kind="stable")
        ids, hashes = ids[order], hashes[order]
        rows = []
        for i, size, cell in zip(*(own[c].to_pylist() for c in ("doc", "size", "cell")), strict=True):
            words = squeeze.decompress(cell, size, asbytes=True).split() if size else []
            spans: list[tuple[int, int]] = []
            n = len(words)
            if i is not None:
                bad = hashes[np.searchsorted(ids, i) : np.searchsorted(ids, i, "right")]
                if len(bad):
                    spans = cover(np.flatnonzero(np.isin(window_hashes(words, window), bad)), window)
                    for a, b in reversed(spans):
                        del words[a:b]
            kept = b" ".join(words)
            rows.append((i, n, n - len(words), [{"start": a, "end": b} for a, b in spans], hashlib.sha256(kept).hexdigest(), *([kept.decode()] if keep_text else [])))
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*rows, strict=True)) or [[]] * len(out), out, strict=True)], schema=out)

    span = pa.struct([("start", pa.int32()), ("end", pa.int32())])
    out = pa.schema([(doc, pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("intervals", pa.list_(span)), ("kept_sha256", pa.string()), *([("kept", pa.string())] if keep_text else [])])
    schema = f"`{doc}` long, n_words long, n_removed long, intervals array<struct<start:int,end:int>>, kept_sha256 string" + ", kept string" * keep_text
    texts = docs.select(F.col(doc).cast("long"), F.col(text).cast("binary")).mapInArrow(packed, "bucket int, doc long, size long, cell binary")
    return texts.groupBy("bucket").cogroup(flagged.groupBy("bucket")).applyInArrow(cleaned, schema)


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns."""
    return remove_repeats(docs, keep_text=False).select("doc_id", "n_words", "n_removed", "kept_sha256")
