"""Best-fit packing: repeat counts of length patterns by non-negative least squares.

Texts become token pieces once; the histogram of their lengths (its size is
bounded by the sequence length) is all that the driver sees. Lengths are put in
bins, patterns of a few lengths that fill a sequence are enumerated, and the
repeat counts that best explain the histogram are fitted by non-negative least
squares. Pieces are dealt to shards by a hash; every shard carries out its part
of the repeat counts, rounded, packs the residual pieces by best fit, largest
first, into what is still open, and opens new sequences only then. A shard
loses less than a sequence or so, and holds many hundred of them.
"""

from __future__ import annotations

import bisect
import json
import math
import re
import struct
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeweft.llm.common import staged

CAPACITY, END_ID = 4096, 1
#: Bins of piece lengths, and pieces of a pattern at most. A bin's length is its upper edge.
BINS, MOST_PIECES = 32, 4
#: Pieces up to this length are in no pattern: they fill what patterns leave open.
FILLER = CAPACITY // 8
#: Pieces of a shard, about.
SHARD = 20_000
#: Words whose ids a worker keeps: so many of the last, and as many from before that.
CACHE = 120_000

#: A text of Latin-1 characters without control characters is normalised by
#: lower-casing and cut by WORD just as the tokenizer does; any other text, and
#: one that spells a special token, goes through the tokenizer whole.
ODD = bytes([*range(9), *range(14, 32), *range(127, 160)])
LOWER = bytes(ord(chr(c).lower()) if ord(chr(c).lower()) < 256 else c for c in range(256))
LETTERS, NUMBERS = rb"a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff", rb"0-9\xb2\xb3\xb9\xbc-\xbe"
WORD = re.compile(rb"[%b]+|'(?:[stmd]|re|ve|ll)|[%b]|[^\x20\t-\r\xa0%b%b]+" % (LETTERS, NUMBERS, LETTERS, NUMBERS))

#: How a tokenizer must normalise and cut texts for WORD to do the same.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLITTER = {"type": "Sequence", "pretokenizers": [
    {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
]}


class Encoder:
    """Token ids of texts as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            own = json.load(f)
        #: whether texts may be cut into words before the tokenizer sees them
        self.by_words = own["normalizer"] == NORMALIZER and own["pre_tokenizer"] == SPLITTER and own["model"].get("end_of_word_suffix") == "</w>" and all(t["content"].startswith("<|") for t in own["added_tokens"])
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        # the last token of every word, and no other, ends with the mark of word ends
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def whole(self, text: str) -> bytes:
        return self._ids(text).tobytes()

    def _learn(self, words: list[bytes]) -> None:
        """Encodes words that are not remembered, all in one text, which is cut at the ends of words."""
        ids = self._ids(b" ".join(words).decode("latin-1"))
        stops = (np.flatnonzero(self.ends[ids]) + 1).tolist()
        if len(stops) == len(words):
            data, at = ids.tobytes(), 0
            for w, stop in zip(words, stops, strict=True):
                self.young[w] = data[at : 4 * stop]
                at = 4 * stop
        else:  # a vocabulary without such marks
            for w in words:
                self.young[w] = self.whole(w.decode("latin-1"))

    def encode(self, text: str) -> bytes:
        """As the tokenizer's; where it cuts words as WORD does, they are encoded apart from their text and remembered, as no merge crosses a word."""
        if not self.by_words:
            return self.whole(text)
        try:
            plain = text.encode("latin-1")
        except UnicodeEncodeError:
            return self.whole(text)
        if b"<|" in plain or len(plain.translate(None, ODD)) < len(plain):
            return self.whole(text)
        words = WORD.findall(plain.translate(LOWER))
        if len(self.young) >= CACHE:
            self.old, self.young = self.young, {}
        young, old = self.young, self.old
        new = [w for w in {*words} if w not in young]
        young.update({w: old[w] for w in new if w in old})
        fresh = [w for w in new if w not in young]
        if fresh:
            self._learn(fresh)
        return b"".join(map(young.__getitem__, words))


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Where an installed public tokenizer's file is; looked up on the machine that encodes."""
    import public_tokenizers

    return public_tokenizers.path(name)


def pieces(docs: DataFrame, doc: str = "doc_id", text: str = "text", capacity: int = CAPACITY, name: str = "word_bpe_49k.json", end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """(doc, piece, start, length, ids_crc32[, ids]): the token pieces of each row of docs, with its end token.

    Only texts longer than capacity are cut. A null text counts as empty: its one
    piece is the end token. Rows that repeat are packed each on its own.
    """
    names = [doc, "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, last = Encoder(tokenizer_path(name)), struct.pack("<I", end_id)
        for b in batches:
            cols: list[list] = [[] for _ in names]
            for i, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = encoder.encode(t.as_py() or "") + last
                for n, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    row = (i, n, at // 4, len(part) // 4, zlib.crc32(part), np.frombuffer(part, "<u4").astype(np.int64))
                    for c, v in zip(cols, row, strict=False):
                        c.append(v)
            kinds = [b.schema[0].type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=False)], names=names)

    rows = docs.select(F.col(doc).cast("long").alias(doc), F.col(text))
    return rows.mapInArrow(each, f"`{doc}` long, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * with_ids)


def bin_edges(capacity: int, bins: int) -> list[int]:
    """Upper edges of the bins, the last being capacity."""
    return sorted({math.ceil(capacity * (k + 1) / bins) for k in range(bins)})


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 2_000) -> np.ndarray:
    """x >= 0 of small |a x - b|, by accelerated projected gradient steps; each column of a is short."""
    gram, goal = a.T @ a, a.T @ b
    rate = 1 / max(np.linalg.norm(gram, 2), 1e-9)
    x = y = np.zeros(a.shape[1])
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(0, y - rate * (gram @ y - goal))
        t_new = (1 + math.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / t_new * (new - x)
        if np.abs(new - x).max() <= 1e-7 * max(1.0, new.max()):
            x = new
            break
        x, t = new, t_new
    return x


def fitted_patterns(histogram: dict[int, int], capacity: int = CAPACITY, bins: int = BINS, most: int = MOST_PIECES, filler: int = FILLER) -> list[tuple[tuple[int, ...], float]]:
    """(upper edges of a pattern's pieces, share of the histogram's pieces as repeats), most used first.

    Patterns hold pieces longer than filler and fill a sequence up to one bin; the
    repeats are fitted to the counts by bin, long bins weighing more.
    """
    edges = bin_edges(capacity, bins)
    counts = np.zeros(len(edges))
    for length, n in histogram.items():
        counts[bisect.bisect_left(edges, length)] += n
    total = counts.sum()
    if not total:
        return []
    step = edges[0]
    long = [i for i, e in enumerate(edges) if e > filler]
    patterns = [p for k in range(1, most + 1) for p in combinations_with_replacement(long, k) if capacity - step < sum(edges[i] for i in p) <= capacity]
    a = np.zeros((len(edges), len(patterns)))
    for j, p in enumerate(patterns):
        for i in p:
            a[i, j] += 1
    weight = np.sqrt(np.array(edges) / capacity)[:, None]
    x = nnls(a * weight, counts / total * weight[:, 0])
    return sorted(((tuple(edges[i] for i in p), float(v)) for p, v in zip(patterns, x, strict=True) if v > 1e-9), key=lambda z: (-z[1], z[0]))


def pack_shard(lengths: np.ndarray, patterns: list[tuple[tuple[int, ...], float]], capacity: int = CAPACITY, bins: int = BINS) -> tuple[np.ndarray, np.ndarray]:
    """(sequence number, offset) of each piece: patterns first, then best fit for the rest, longest first."""
    edges = bin_edges(capacity, bins)
    stock: dict[int, list[int]] = defaultdict(list)
    for i in np.argsort(-lengths, kind="stable").tolist():
        stock[edges[bisect.bisect_left(edges, int(lengths[i]))]].append(i)
    for v in stock.values():
        v.reverse()  # the longest of a bin is taken first
    sequence, offset, used = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), []

    def place(i: int, s: int) -> None:
        sequence[i], offset[i] = s, used[s]
        used[s] += int(lengths[i])

    for pattern, share in patterns:
        need = {e: pattern.count(e) for e in pattern}
        for _ in range(min([round(share * len(lengths)), *(len(stock[e]) // k for e, k in need.items())])):
            used.append(0)
            for e in pattern:
                place(stock[e].pop(), len(used) - 1)
    rest = sorted((i for v in stock.values() for i in v), key=lambda i: (-int(lengths[i]), i))
    room: list[list[int]] = [[] for _ in range(capacity + 1)]  # open sequences by what is free in them
    free = sorted({capacity - u for u in used if u < capacity})
    for s, u in enumerate(used):
        room[capacity - u].append(s)
    for i in rest:
        k = bisect.bisect_left(free, int(lengths[i]))
        if k < len(free):
            s = room[free[k]].pop()
            if not room[free[k]]:
                free.pop(k)
        else:
            used.append(0)
            s = len(used) - 1
        place(i, s)
        left = capacity - used[s]
        if left:
            if not room[left]:
                bisect.insort(free, left)
            room[left].append(s)
    return sequence, offset


def pack(cut: DataFrame, capacity: int = CAPACITY, shard: int = SHARD, key: str = "doc_id") -> DataFrame:
    """cut (rows with length, 1 to capacity, and ids_crc32) with sequence_id and offset: gapless from 0 in each sequence."""
    histogram = {r.length: r.n for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # capacity rows at most
    shards = max(1, round(sum(histogram.values()) / shard))
    patterns = fitted_patterns(histogram, capacity)
    names = [*cut.columns, "sequence_id", "offset"]

    def each(own: pa.Table) -> pa.Table:
        own = own.sort_by([(key, "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        sequence, offset = pack_shard(own["length"].to_numpy(), patterns, capacity)
        base = own["_shard"][0].as_py() << 32
        return own.append_column("sequence_id", pa.array(base + sequence)).append_column("offset", pa.array(offset)).select(names)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema) + ", sequence_id long, offset long"
    # the row's place breaks ties between repeated rows, so that none gathers in a shard
    dealt = cut.withColumn("_shard", F.pmod(F.xxhash64(F.col(key), "piece", "ids_crc32"), F.lit(shards)).cast("int"))
    return dealt.groupBy("_shard").applyInArrow(each, kinds)


def packed(docs: DataFrame, doc: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """(doc, piece, start, length, ids_crc32, sequence_id, offset) of all rows of docs."""
    return pack(staged(pieces(docs, doc, text, capacity), "pieces"), capacity, key=doc)


def sequences(docs: DataFrame, doc: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """(sequence_id, ids, docs): the packed sequences themselves, with the document of each token run in order."""
    cut = staged(pieces(docs, doc, text, capacity, with_ids=True), "pieces")
    runs = F.array_sort(F.collect_list(F.struct("offset", "ids", F.col(doc).alias("doc"))))  # capacity pieces at most
    grouped = pack(cut, capacity, key=doc).groupBy("sequence_id").agg(runs.alias("runs"))
    return grouped.select("sequence_id", F.flatten(F.transform("runs", lambda r: r["ids"])).alias("ids"), F.transform("runs", lambda r: r["doc"]).alias("docs"))


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns."""
    return packed(docs).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
