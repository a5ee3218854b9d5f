"""Toxicity: a weighted lexicon, matched by Aho-Corasick over folded text.

Texts are lower-cased and homoglyphs and digits inside words are folded to the
letters they stand for. The lexicon is the fixed list below and the stems that
set toxic training documents apart, each with its log-odds as weight; stems are
matched at the beginning of words, exceptions silence the matches inside them.
The weights of a text's matches are held against those that clean text of the
same length has by chance, over the whole text and over its densest passage;
how far they exceed them gives the score through a logistic curve fitted to the
same training rows.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from codeweft.llm.common import staged
from codeweft.llm.labels import fold, sampled

#: Words that are insults in themselves, whatever the labels say.
WORDS = "idiot moron stupid scum loser trash worthless pathetic disgusting clown imbecile dumbass bastard asshole bitch retard".split()
#: Phrases in which a lexicon word is harmless.
EXCEPTIONS = ["trash can", "trash bin", "clown fish", "circus clown", "scum layer", "pond scum", "sore loser award", "idiot proof", "fire retard"]
#: Letters of other scripts that look like Latin ones.
LOOKALIKE = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ѕ": "s", "ј": "j", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h",
    "α": "a", "ε": "e", "ο": "o", "ρ": "p", "ι": "i", "κ": "k", "ν": "v", "τ": "t", "υ": "u", "χ": "x", "ѵ": "v", "ԁ": "d", "ɡ": "g", "ʟ": "l",
}
#: Digits and signs that stand for letters inside a word.
LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i"}
#: Training rows at most; lengths of the stems that are tried, besides whole words of any length.
SAMPLE, LONGEST, SHORTEST = 8_000, 12, 3
#: A stem needs this share of toxic rows (and LEAST_ROWS of them), and this log-odds; the lexicon learns at most TERMS, those in most toxic rows.
SHARE, LEAST_ROWS, LEAST_ODDS, TERMS = 0.004, 4, 3.0, 200
#: Sum of weights, and of their squares, a word of clean text has by chance; the clean training rows are added to PRIOR_WORDS of such text.
CHANCE, PRIOR_WORDS = (3e-4, 1.2e-3), 100_000
#: Words of the shortest passage that is looked at on its own; standard deviations of chance that count as one unit; share by which its rate may be off.
PASSAGE, SPREAD, DOUBT = 50, 2.0, 0.5

ODD = re.compile("[" + "".join(LOOKALIKE) + "".join(map(re.escape, LEET)) + "]")
INSIDE = re.compile(r"(?<=[^\W\d_])[0134578@$!]+(?=[^\W\d_])|(?<![\w@$!])[0134578@$!](?=[^\W\d_]{2})")
WORD = re.compile(r"[^\W\d_]+(?:[’'-][^\W\d_]+)*")
TABLE = str.maketrans(LOOKALIKE)


def folded(text: str) -> str:
    """text in lower case with look-alikes and digits inside words turned into letters."""
    text = text.lower()
    if ODD.search(text):
        text = INSIDE.sub(lambda m: "".join(LEET[c] for c in m.group()), text.translate(TABLE))
    return text


def spaced(text: str) -> tuple[str, int]:
    """(the words of a folded text, each with one space on both sides, their number)."""
    words = WORD.findall(folded(text))
    return f" {' '.join(words)} ", len(words)


@dataclass
class Lexicon:
    """Stems with weights, exceptions, the curve of the score, and what clean text has by chance."""

    stems: dict[str, float]
    exceptions: list[str] = field(default_factory=lambda: list(EXCEPTIONS))
    curve: tuple[float, float] = (-3.0, 1.5)
    chance: tuple[float, float] = CHANCE

    def __post_init__(self) -> None:
        self.machine = ahocorasick.Automaton()
        for stem, w in self.stems.items():
            self.machine.add_word(f" {stem}", (w, len(stem) + 1))
        for phrase in self.exceptions:
            self.machine.add_word(f" {phrase}", (None, len(phrase) + 1))
        self.machine.make_automaton()

    def matches(self, text: str) -> tuple[list[tuple[int, float]], int]:
        """((number of the word it begins in, weight) of each match that counts, number of words)."""
        line, n = spaced(text)
        found = [(end - size + 1, end, w) for end, (w, size) in self.machine.iter(line)] if self.stems else []
        calm = [(a, b) for a, b, w in found if w is None]
        loud, at, word = [], 0, 0
        for a, b, w in sorted((x for x in found if x[2] is not None), key=lambda x: x[0]):
            if not any(x <= a and b <= y for x, y in calm):
                word, at = word + line.count(" ", at, a), a
                loud.append((word, w))
        return loud, n

    def hits(self, text: str) -> tuple[float, int, int]:
        """(sum of weights, number of matches that count, number of words)."""
        loud, n = self.matches(text)
        return sum(w for _, w in loud), len(loud), n

    def strength(self, text: str) -> float:
        """By how much the weights of the matches exceed those of chance, in units that grow slowly with the length and with what chance varies: the curve's variable.

        The greatest of the whole text's and its passages' (PASSAGE words, and
        doubled from there); a passage's weight is less by the logarithm of the
        number of places it could be in, so length alone doesn't make one.
        """
        loud, n = self.matches(text)
        sums = [0.0, *accumulate(w for _, w in loud)]
        mean, square = self.chance

        def excess(weight: float, words: float) -> float:
            return (weight - mean * words) / math.hypot(1 + math.log1p(words) / 4, SPREAD * math.sqrt(square * words), SPREAD * DOUBT * mean * words)

        best, size, starts = excess(sums[-1], n), PASSAGE, [at for at, _ in loud]
        while loud and size < n:
            weight = max(sums[bisect_left(starts, at + size)] - sums[k] for k, at in enumerate(starts))
            best = max(best, excess(weight - math.log(n / size), size))
            size *= 2
        return best

    def score(self, text: str | None) -> float:
        a, b = self.curve
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, a + b * self.strength(text or "")))))


def stem_counts(sample: DataFrame) -> DataFrame:
    """(stem, toxic, clean): rows of either label that hold a word beginning with the stem (a stem longer than LONGEST: the word itself); one row too for stem '' (all rows)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both: tuple[Counter, Counter] = (Counter(), Counter())
        for b in batches:
            for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words = set(WORD.findall(folded(t or "")))
                both[0 if y else 1].update({w[:k] for w in words for k in range(SHORTEST, min(len(w), LONGEST) + 1)} | {w for w in words if len(w) > LONGEST} | {""})
        stems = sorted({*both[0], *both[1]})
        yield pa.RecordBatch.from_pydict({"stem": stems, "toxic": [both[0][s] for s in stems], "clean": [both[1][s] for s in stems]}, pa.schema([("stem", pa.string()), ("toxic", pa.int64()), ("clean", pa.int64())]))

    return sample.select("text", "y").mapInArrow(count, "stem string, toxic long, clean long").groupBy("stem").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def odds(toxic: float, clean: float, all_toxic: float, all_clean: float) -> float:
    return math.log((toxic + 0.5) / (all_toxic + 1)) - math.log((clean + 0.5) / (all_clean + 1))


def choose(counts: list[tuple[str, int, int]], all_toxic: int, all_clean: int) -> dict[str, float]:
    """Stems with their weights, none beginning with another: of stems that extend one and keep nine tenths of its toxic rows, that of greatest odds."""
    strong = {s: (t, c, odds(t, c, all_toxic, all_clean)) for s, t, c in counts}
    strong = {s: x for s, x in strong.items() if x[2] >= LEAST_ODDS}
    chosen: dict[str, float] = {}
    for stem in sorted(strong, key=lambda s: (len(s), s)):
        if any(stem.startswith(x) for x in chosen):
            continue
        family = [s for s in strong if s.startswith(stem) and strong[s][0] >= 0.9 * strong[stem][0]]
        best = max(family, key=lambda s: (round(strong[s][2], 1), len(s), s))
        chosen[best] = round(strong[best][2], 4)
    return dict(sorted(chosen.items(), key=lambda x: (-strong[x[0]][0], x[0]))[:TERMS])


def fit(docs: DataFrame, labels: DataFrame, seen: Column, label: str = "toxic", doc: str = "doc_id", text: str = "text", limit: int = SAMPLE) -> Lexicon:
    """The lexicon learned from at most limit labelled rows; the fixed words alone if there are none of both labels.

    Of the stems that set toxic rows apart the 20 * TERMS in most toxic rows come to
    the driver, and TERMS of them at most are learned, besides the fixed words.
    """
    sample = staged(sampled(docs, labels, label, seen, limit, doc, text).select(F.col(text).alias("text"), "y"), "toxic")
    counts = staged(stem_counts(sample), "stems")
    whole = counts.where("stem = ''").first()
    fixed = {w: 4.0 for w in WORDS}
    if whole is None or not whole.toxic or not whole.clean:
        return Lexicon(fixed)
    least = max(LEAST_ROWS, SHARE * whole.toxic)
    worth = counts.where((F.col("stem") != "") & (F.col("toxic") >= least))
    rate = (F.col("toxic") + 0.5) / (whole.toxic + 1) / ((F.col("clean") + 0.5) / (whole.clean + 1))
    rows = worth.where(F.log(rate) >= LEAST_ODDS).orderBy(F.desc("toxic"), "stem").limit(20 * TERMS).collect()
    learned = choose([tuple(r) for r in rows], whole.toxic, whole.clean)
    stems = {w: v for w, v in fixed.items() if not any(w.startswith(s) for s in learned)} | learned
    loose = Lexicon(stems)

    def weights(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [loose.matches(t or "") for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_pydict({"w": pa.array([sum(w for _, w in m) for m, _ in found], pa.float64()), "w2": pa.array([sum(w * w for _, w in m) for m, _ in found], pa.float64()), "n": pa.array([n for _, n in found], pa.int64())})

    had = sample.where("y = 0").select("text").mapInArrow(weights, "w double, w2 double, n long").agg(F.sum("w"), F.sum("w2"), F.sum("n")).first()
    chance = tuple((x + c * PRIOR_WORDS) / (had[2] + PRIOR_WORDS) for x, c in zip(had[:2], CHANCE, strict=True))
    plain = Lexicon(stems, chance=chance)

    def strengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_pydict({"x": pa.array([plain.strength(t or "") for t in b.column(0).to_pylist()], pa.float64()), "y": b.column(1).cast(pa.int32())})

    points = sample.select("text", F.col("y").cast("int")).mapInArrow(strengths, "x double, y int").collect()  # limit rows at most
    return Lexicon(stems, curve=logistic(np.array([p.x for p in points]), np.array([p.y for p in points], float)), chance=chance)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.5, rounds: int = 50) -> tuple[float, float]:
    """(a, b) of 1 / (1 + exp(-a - b x)) by Newton's method, b shrunk by a ridge and not negative."""
    w = np.zeros(2)
    f = np.stack([np.ones_like(x), x], 1)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(f @ w, -30, 30)))
        grad = f.T @ (p - y) + ridge * np.array([1e-3, w[1]])
        hess = (f * (p * (1 - p) + 1e-9)[:, None]).T @ f + np.diag([1e-3, ridge])
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(max(w[1], 0.0))


def scored(docs: DataFrame, lexicon: Lexicon, text: str = "text", out: str = "score") -> DataFrame:
    """docs with the score of each text, 0 to 1. Null texts are scored as empty; a column of that name is replaced."""
    docs = docs.drop(out)
    stems, exceptions, curve, chance = lexicon.stems, lexicon.exceptions, lexicon.curve, lexicon.chance
    names = docs.columns

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Lexicon(stems, exceptions, curve, chance)
        at = names.index(text)
        for b in batches:
            scores = pa.array([own.score(t.as_py()) for t in b.column(at)], pa.float64())  # one text at a time
            yield pa.RecordBatch.from_arrays([*b.columns, scores], names=[*names, out])

    return docs.mapInArrow(each, StructType([*docs.schema.fields]).add(out, DoubleType()))


THRESHOLD, FOLDS, HELD = 0.3, 4, 2


def digest(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's columns: learned from rows whose fold is not HELD, every document scored.

    A null doc_id is in no fold: held_out is null.
    """
    lexicon = fit(docs, labels, fold("doc_id", FOLDS) != HELD)
    held = (fold("doc_id", FOLDS) == HELD).alias("held_out")
    rows = scored(docs.select("doc_id", "text"), lexicon)
    return rows.select("doc_id", held, F.round("score", 9).alias("score"), (F.round("score", 9) >= THRESHOLD).cast("int").alias("predicted"))
