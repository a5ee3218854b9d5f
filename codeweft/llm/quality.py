"""Quality classifier: a linear-chain conditional random field labels every line good or bad.

A line is described by its own shares of signs, capitals, repeats and the like
and by those of the lines before and after it. The chain is fitted on a bounded
sample of labelled documents: lines of good documents are good, those of bad
documents start as bad, and lines that the fitted chain finds ordinary are
relabelled once or twice. Forward-backward gives every line of every document
its probability to be good; the mean, weighted by the lines' lengths, is the
document's quality, brought to a probability by a logistic curve.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from codeweft.llm.labels import fold, sampled

#: Labelled documents used for fitting, with all their lines; the fit takes a document's lines as chains of this many that follow one another.
SAMPLE, CHAIN = 2_000, 64
#: A longer line is described by its pieces of this many characters, each a position of the chain.
PIECE = 2_000
SIGNS = re.compile(r"[#*$%&|<>@^~=+{}\[\]\\_/]")
#: Names of a line's own features, in order.
OWN = ["bias", "sign_some", "sign_many", "upper_some", "upper_many", "loud", "digit", "few_distinct", "very_few_distinct", "next_to_itself", "seen_before", "short", "long_words", "no_stop", "bars"]
#: Which of them are also looked at in the neighbouring lines.
NEAR = list(range(1, len(OWN)))
WIDTH = len(OWN) + 2 * len(NEAR)


def lines_of(text: str) -> list[str]:
    """Lines with a visible character; long ones in pieces."""
    return [line[k : k + PIECE] for line in text.split("\n") if line.strip() for k in range(0, len(line), PIECE)]


def describe(line: str, seen: set[str]) -> list[float]:
    """A line's own features; seen holds the lines before it."""
    n, words = len(line), line.split()
    m = max(1, len(words))
    signs, distinct = len(SIGNS.findall(line)) / n, len({*words}) / m
    letters = max(1, sum(map(str.isalpha, line)))
    upper, loud = sum(map(str.isupper, line)) / letters, (line.count("!") + line.count("?")) / m
    beside = sum(a == b for a, b in zip(words, words[1:], strict=False)) / m
    digits = sum(map(str.isdigit, line)) / n
    stops = (line.count(".") + line.count(",")) / m
    return [
        1.0, float(signs > 0.02), float(signs > 0.08), float(upper > 0.25), float(upper > 0.6), min(1.0, loud), min(1.0, 4 * digits),
        float(m > 5 and distinct < 0.55), float(m > 5 and distinct < 0.3), min(1.0, 2 * beside), float(line in seen), float(m < 4), float(n / m > 14), float(m > 12 and stops < 0.02), min(1.0, 2 * line.count("|") / m),
    ]


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(lines x WIDTH features, length of each line)."""
    lines, seen, rows = lines_of(text), set(), []
    for line in lines:
        rows.append(describe(line, seen))
        seen.add(line)
    own = np.array(rows, np.float64).reshape(len(rows), len(OWN))
    return with_neighbours(own), np.array([len(x) for x in lines], np.float64)


def with_neighbours(own: np.ndarray) -> np.ndarray:
    none = np.zeros((1, len(NEAR)))
    before, after = np.vstack([none, own[:-1, NEAR]]), np.vstack([own[1:, NEAR], none])
    return np.hstack([own, before[: len(own)], after[len(none) - 1 :][: len(own)]])


@dataclass
class Chain:
    """Weights of bad against good for the features, and scores of the four transitions [from][to]; 0 good, 1 bad."""

    weights: np.ndarray
    moves: np.ndarray
    curve: tuple[float, float] = (-4.0, 8.0)

    def marginals(self, x: np.ndarray) -> np.ndarray:
        """Probability of each line to be bad, by forward-backward."""
        n = len(x)
        u = x @ self.weights
        a, b = np.zeros((n, 2)), np.zeros((n, 2))
        (m00, m01), (m10, m11) = np.exp(self.moves).tolist()
        z = np.exp(np.clip(u, -30, 30)).tolist()
        f0, f1 = 1.0, z[0]
        for t in range(n):
            if t:
                f0, f1 = f0 * m00 + f1 * m10, (f0 * m01 + f1 * m11) * z[t]
            s = f0 + f1
            f0, f1 = f0 / s, f1 / s
            a[t] = f0, f1
        g0 = g1 = 1.0
        b[n - 1] = 1.0
        for t in range(n - 2, -1, -1):
            g0, g1 = m00 * g0 + m01 * z[t + 1] * g1, m10 * g0 + m11 * z[t + 1] * g1
            s = g0 + g1
            g0, g1 = g0 / s, g1 / s
            b[t] = g0, g1
        p = a * b
        return p[:, 1] / p.sum(1)

    def quality(self, text: str | None) -> float:
        """Length-weighted share of good lines; a text without lines is halfway."""
        x, lengths = features(text or "")
        if not len(x):
            return 0.5
        return float(((1 - self.marginals(x)) * lengths).sum() / lengths.sum())

    def score(self, text: str | None) -> float:
        a, b = self.curve
        return 1 / (1 + math.exp(-(a + b * self.quality(text))))


def fit_chain(docs: list[tuple[np.ndarray, np.ndarray]], rounds: int = 120, ridge: float = 1.0, start: Chain | None = None) -> Chain:
    """Maximum likelihood of line labels (0, 1), with a ridge, by Adam; documents are cut into chains of CHAIN lines at most."""
    docs = [(x[k : k + CHAIN], y[k : k + CHAIN]) for x, y in docs for k in range(0, len(y), CHAIN)]
    longest = max(len(y) for _, y in docs)
    n = len(docs)
    x, y, mask = np.zeros((n, longest, WIDTH), np.float32), np.zeros((n, longest), np.int64), np.zeros((n, longest), bool)
    for i, (f, labels) in enumerate(docs):
        x[i, : len(f)], y[i, : len(f)], mask[i, : len(f)] = f, labels, True
    theta = np.zeros(WIDTH + 4) if start is None else np.concatenate([start.weights, start.moves.ravel()])
    first, second = np.zeros(WIDTH + 4), np.zeros(WIDTH + 4)
    both = mask[:, 1:] & mask[:, :-1]
    pairs = np.array([[((y[:, :-1] == a) & (y[:, 1:] == b) & both).sum() for b in (0, 1)] for a in (0, 1)])
    for r in range(1, rounds + 1):
        w, moves = theta[:WIDTH], theta[WIDTH:].reshape(2, 2)
        u = np.where(mask, x @ w.astype(np.float32), 0.0).astype(np.float64)
        forward, back = np.zeros((n, longest, 2)), np.zeros((n, longest, 2))
        forward[:, 0, 1] = u[:, 0]
        for t in range(1, longest):
            step = np.logaddexp(forward[:, t - 1, :1] + moves[0], forward[:, t - 1, 1:] + moves[1])
            step[:, 1] += u[:, t]
            forward[:, t] = np.where(mask[:, t, None], step, forward[:, t - 1])
        whole = np.logaddexp(forward[:, -1, 0], forward[:, -1, 1])
        expected = np.zeros((2, 2))
        for t in range(longest - 1, 0, -1):
            ahead = back[:, t].copy()
            ahead[:, 1] += u[:, t]
            on = mask[:, t, None]
            joint = np.exp(forward[:, t - 1, :, None] + moves + ahead[:, None, :] - whole[:, None, None])
            expected += (joint * on[:, :, None]).sum(0)
            back[:, t - 1] = np.where(on, np.logaddexp(moves[:, 0] + ahead[:, :1], moves[:, 1] + ahead[:, 1:]), back[:, t])
        # past the end of a document forward repeats its last value and back is 0 there
        p = np.exp(forward[:, :, 1] + back[:, :, 1] - whole[:, None])
        gap = np.where(mask, y - p, 0.0)
        grad = np.concatenate([np.einsum("nt,ntf->f", gap, x) - ridge * w, (pairs - expected - ridge * moves).ravel()]) / max(1, mask.sum())
        first, second = 0.9 * first + 0.1 * grad, 0.99 * second + 0.01 * grad**2
        theta = theta + 0.15 * (first / (1 - 0.9**r)) / (np.sqrt(second / (1 - 0.99**r)) + 1e-8)
    return Chain(theta[:WIDTH].copy(), theta[WIDTH:].reshape(2, 2).copy())


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 60) -> tuple[float, float]:
    """(a, b) of 1 / (1 + exp(-a - b x)) by Newton's method with a small ridge."""
    f, w = np.stack([np.ones_like(x), x], 1), np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(f @ w, -30, 30)))
        hess = (f * (p * (1 - p) + 1e-9)[:, None]).T @ f + 0.05 * np.eye(2)
        step = np.linalg.solve(hess, f.T @ (p - y) + 0.05 * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def fit(docs: DataFrame, labels: DataFrame, seen: Column, label: str = "quality", doc: str = "doc_id", text: str = "text", limit: int = SAMPLE) -> Chain:
    """The chain of at most limit labelled rows where seen holds (label 1: good), fitted to all their lines; without both labels a chain that finds all lines good."""

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                lines, before, own = lines_of(t or ""), set(), []
                for line in lines:
                    own.append(describe(line, before))
                    before.add(line)
                own, sizes = np.array(own, np.float32), np.array([len(x) for x in lines], np.float32)
                yield pa.RecordBatch.from_pydict({"y": pa.array([y], pa.int32()), "own": [own.tobytes()], "sizes": [sizes.tobytes()]}, pa.schema([("y", pa.int32()), ("own", pa.binary()), ("sizes", pa.binary())]))

    rows = sampled(docs, labels, label, seen, limit, doc, text).select(text, "y").mapInArrow(described, "y int, own binary, sizes binary").collect()
    rows = sorted((r for r in rows if r.sizes), key=lambda r: (r.y, bytes(r.sizes), bytes(r.own)))  # limit rows at most, in a fixed order
    marks = np.array([int(r.y > 0) for r in rows])
    if not len(rows) or marks.min() == marks.max():
        return Chain(np.zeros(WIDTH), np.zeros((2, 2)), (4.0, 0.0))
    xs = [with_neighbours(np.frombuffer(r.own, np.float32).astype(np.float64).reshape(-1, len(OWN))) for r in rows]
    ys = [np.full(len(x), 1 - m) for x, m in zip(xs, marks, strict=True)]
    chain = fit_chain(list(zip(xs, ys, strict=True)))
    for _ in range(2):
        for i, m in enumerate(marks):
            if not m:  # in a bad document the lines that look ordinary are good, but for its worst
                p = chain.marginals(xs[i])
                ys[i] = ((p >= 0.5) | (p == p.max())).astype(np.int64)
        chain = fit_chain(list(zip(xs, ys, strict=True)), 60, start=chain)
    sizes = [np.frombuffer(r.sizes, np.float32).astype(np.float64) for r in rows]
    quality = np.array([float(((1 - chain.marginals(x)) * n).sum() / n.sum()) for x, n in zip(xs, sizes, strict=True)])
    return Chain(chain.weights, chain.moves, logistic(quality, marks.astype(float)))


def scored(docs: DataFrame, chain: Chain, text: str = "text", out: str = "score") -> DataFrame:
    """docs with the probability of each text to be good, 0 to 1. Null texts are scored as empty; a column of that name is replaced."""
    docs = docs.drop(out)
    names = docs.columns

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = names.index(text)
        for b in batches:
            scores = pa.array([chain.score(t.as_py()) for t in b.column(at)], pa.float64())
            yield pa.RecordBatch.from_arrays([*b.columns, scores], names=[*names, out])

    return docs.mapInArrow(each, StructType([*docs.schema.fields]).add(out, DoubleType()))


THRESHOLD, FOLDS, HELD = 0.3, 5, 0


def digest(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's columns: learned from rows whose fold is not HELD, every document scored.

    A null doc_id is in no fold: held_out is null.
    """
    chain = fit(docs, labels, fold("doc_id", FOLDS) != HELD)
    rows = scored(docs.select("doc_id", "text"), chain)
    held = (fold("doc_id", FOLDS) == HELD).alias("held_out")
    return rows.select("doc_id", held, F.round("score", 6).alias("score"), (F.round("score", 6) >= THRESHOLD).cast("int").alias("predicted"))
