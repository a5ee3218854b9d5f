"""Secret scans: base patterns, and formats inferred from labelled credentials.

Credentials that the base patterns name in a bounded sample of documents, and
examples of published key formats, are spelled in character classes and entered
into prefix trees. States whose futures agree within the Hoeffding bound are
merged (the ALERGIA scheme of Carrasco and Oncina, 1994), which leaves one
small probabilistic automaton for each label. Every candidate token of every
text is then scored by its likelihood under the best automaton against that of
ordinary words.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
import string
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

from codeweft.llm.common import bounded_ids, staged

#: The base patterns in their order; assign's second group has 6 characters at least.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ["assign", "access", "hex", "format"]
TOKEN = re.compile(r"[A-Za-z0-9+/_.=-]{16,}")
#: Documents sampled for labelled credentials and ordinary words; of these the values of each label that are fitted, and the words (their most frequent spellings).
SAMPLE_DOCS, SAMPLE_VALUES, SAMPLE_WORDS = 4_000, 400, 20_000
#: A longer run of characters isn't an ordinary word: it is in no language model, but still a candidate.
LONGEST_WORD = 40
#: Confidence of the merge test, and what a candidate needs: log-likelihood ratio in all and for each character.
ALPHA, LEAST_RATIO, LEAST_EACH = 0.05, 12.0, 0.6
SPAN = StructType([StructField("kind", StringType()), StructField("start", LongType()), StructField("end", LongType()), StructField("score", DoubleType()), StructField("text", StringType())])
CLASSES = str.maketrans({c: k for k, cs in {"d": string.digits, "h": "abcdef", "l": "ghijklmnopqrstuvwxyz", "H": "ABCDEF", "U": "GHIJKLMNOPQRSTUVWXYZ"}.items() for c in cs})
END = ""


def spelled(value: str) -> str:
    """value in character classes; signs stand for themselves."""
    return value.translate(CLASSES)


def examples(n: int = 60) -> dict[str, list[str]]:
    """Made-up keys of published formats, the same on every run."""
    r = random.Random(11)
    draw = lambda chars, k: "".join(r.choice(chars) for _ in range(k))
    word, upper = string.ascii_letters + string.digits, string.ascii_uppercase + string.digits
    return {
        "access": ["AKIA" + draw(upper, 16) for _ in range(n)],
        "hex": [draw("0123456789abcdef", k) for k in (32, 40, 64) for _ in range(n // 3)],
        "prefixed": [p + draw(word, 36) for p in ("ghp_", "gho_", "ghs_") for _ in range(n // 3)],
        "chat": [f"xoxb-{draw(string.digits, 11)}-{draw(string.digits, 11)}-{draw(word, 24)}" for _ in range(n)],
        "cloud": ["AIza" + draw(word + "-_", 35) for _ in range(n)],
        "web": [f"eyJ{draw(word, 33)}.eyJ{draw(word, 60)}.{draw(word + '-_', 43)}" for _ in range(n)],
        "base64": [draw(word + "+/", 40) for _ in range(n)],
    }


class Automaton:
    """A probabilistic automaton: counts by state and symbol, inferred by merging states of a prefix tree."""

    def __init__(self, values: list[str]) -> None:
        self.next: list[dict[str, int]] = [{}]
        self.seen: list[dict[str, int]] = [defaultdict(int)]
        for v in values:
            q = 0
            for c in v:
                self.seen[q][c] += 1
                if c not in self.next[q]:
                    self.next[q][c] = len(self.next)
                    self.next.append({})
                    self.seen.append(defaultdict(int))
                q = self.next[q][c]
            self.seen[q][END] += 1
        self._merge()

    def _differ(self, a: int, b: int) -> bool:
        """Whether some future of two states differs by more than chance."""
        stack = [(a, b)]
        while stack:
            a, b = stack.pop()
            na, nb = sum(self.seen[a].values()), sum(self.seen[b].values())
            bound = math.sqrt(0.5 * math.log(2 / ALPHA)) * (1 / math.sqrt(na) + 1 / math.sqrt(nb))
            for c in {*self.seen[a], *self.seen[b]}:
                if abs(self.seen[a].get(c, 0) / na - self.seen[b].get(c, 0) / nb) > bound:
                    return True
            if bound < 1:  # with fewer rows nothing below can differ
                stack += [(self.next[a][c], self.next[b][c]) for c in self.next[a] if c in self.next[b]]
        return False

    def _fold(self, a: int, b: int) -> None:
        """b's counts and futures added to a's; b is a tree that nothing else points into."""
        stack = [(a, b)]
        while stack:
            a, b = stack.pop()
            for c, n in self.seen[b].items():
                self.seen[a][c] += n
            for c, to in self.next[b].items():
                if c in self.next[a]:
                    stack.append((self.next[a][c], to))
                else:
                    self.next[a][c] = to

    def _merge(self) -> None:
        red = [0]
        while True:
            blue = [(q, c) for q in red for c in sorted(self.next[q]) if self.next[q][c] not in red]
            if not blue:
                break
            q, c = blue[0]
            b = self.next[q][c]
            for r in red:
                if not self._differ(r, b):
                    self.next[q][c] = r
                    self._fold(r, b)
                    break
            else:
                red.append(b)
        names = {q: i for i, q in enumerate(red)}
        self.next, self.seen = [{c: names[t] for c, t in self.next[q].items()} for q in red], [dict(self.seen[q]) for q in red]

    def log_likelihood(self, value: str, alphabet: int = 12) -> float:
        """Of a value in classes; a symbol not seen in a state has half a count there and leads back to the start."""
        q, total = 0, 0.0
        for c in [*value, END]:
            seen = self.seen[q]
            total += math.log((seen.get(c, 0) + 0.5) / (sum(seen.values()) + 0.5 * alphabet))
            q = self.next[q].get(c, 0)
        return total


class Words:
    """Ordinary words: a chain over character classes, each given the one before."""

    def __init__(self, words: list[str]) -> None:
        self.pairs: dict[str, dict[str, int]] = defaultdict(lambda: defaultdict(int))
        for w in words:
            for a, b in zip("^" + w, [*w, END], strict=True):
                self.pairs[a][b] += 1
        self.pairs = {a: dict(b) for a, b in self.pairs.items()}

    def log_likelihood(self, value: str, alphabet: int = 12) -> float:
        total = 0.0
        for a, b in zip("^" + value, [*value, END], strict=True):
            seen = self.pairs.get(a, {})
            total += math.log((seen.get(b, 0) + 0.5) / (sum(seen.values()) + 0.5 * alphabet))
        return total


class Formats:
    """Automata by label, and ordinary words to compare them with."""

    def __init__(self, automata: dict[str, Automaton], words: Words) -> None:
        self.automata, self.words = automata, words
        self.ratio = lru_cache(maxsize=50_000)(self._ratio)

    def __reduce__(self):
        return Formats, (self.automata, self.words)

    def _ratio(self, shape: str) -> float:
        return max((a.log_likelihood(shape) for a in self.automata.values()), default=-math.inf) - self.words.log_likelihood(shape)


def base_spans(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, value) of the base patterns, by kind."""
    found = []
    if "=" in text or ":" in text:
        found += [("assign", m.start(), m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [("access", m.start(), m.end(), m[0]) for m in ACCESS.finditer(text)]
    return found + [("hex", m.start(), m.end(), m[0]) for m in HEX.finditer(text)]


def fit(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> Formats:
    """Automata of the labels in at most SAMPLE_DOCS documents and of the published formats.

    An empty table leaves the published formats. At most SAMPLE_VALUES values a
    label and SAMPLE_WORDS words come to the driver.
    """
    chosen = bounded_ids(docs.select(F.col(doc).alias("_id")).where("_id is not null").distinct(), SAMPLE_DOCS)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[tuple[str, str]] = Counter()
        for b in batches:
            for t in b.column(0).to_pylist():
                own = base_spans(t or "")
                seen.update((k, spelled(v)) for k, _, _, v in own)
                # ordinary words: those that no base span touches
                rest, at = [], 0
                for _, x, y, _ in sorted(own, key=lambda z: z[1]):
                    rest.append((t or "")[at : max(at, x)])
                    at = max(at, y)
                rest.append((t or "")[at:])
                seen.update(("word", spelled(w)) for part in rest for w in part.split() if len(w) <= LONGEST_WORD)
        yield pa.RecordBatch.from_pydict({"kind": [k for k, _ in seen], "value": [v for _, v in seen], "n": [*seen.values()]}, pa.schema([("kind", pa.string()), ("value", pa.string()), ("n", pa.int64())]))

    sample = docs.join(F.broadcast(chosen), docs[doc] == chosen["_id"], "left_semi").select(text)
    counted = staged(sample.mapInArrow(label, "kind string, value string, n long").groupBy("kind", "value").agg(F.sum("n").alias("n")), "labelled")
    order = F.xxhash64("value")
    words = counted.where("kind = 'word'").orderBy(F.desc("n"), order).limit(SAMPLE_WORDS).collect()
    labelled = {k: counted.where(F.col("kind") == k).orderBy(order, "value").limit(SAMPLE_VALUES).collect() for k in KINDS[:3]}
    values = {k: [spelled(v) for v in vs] for k, vs in examples().items()}
    for k, rows in labelled.items():
        values.setdefault(k, []).extend(r.value for r in rows)
    plain = [r.value for r in words for _ in range(min(r.n, 50))] or ["lhlll", "hlh", "llh", "hllhlhl", "Ulhll."]
    return Formats({k: Automaton(v) for k, v in values.items()}, Words(plain))


def spans_of(text: str, formats: Formats) -> list[tuple[str, int, int, float, str]]:
    """All spans (kind, start, end, score, value), by start, then kind: base ones, and likely tokens that overlap none."""
    base = [(k, a, b, formats.ratio(spelled(v)), v) for k, a, b, v in base_spans(text)]
    more = []
    for m in TOKEN.finditer(text):
        a, b = m.span()
        value = m[0].rstrip(".=-")
        if any(a < y and x < b for _, x, y, *_ in base):
            continue
        ratio = formats.ratio(spelled(value))
        if ratio >= LEAST_RATIO and ratio >= LEAST_EACH * len(value):
            more.append(("format", a, a + len(value), ratio, value))
    return sorted(base + more, key=lambda s: (s[1], KINDS.index(s[0])))


def find_secrets(docs: DataFrame, formats: Formats, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, secrets): one row per row of docs; secrets is an array of spans (kind, start, end, score, text).

    Positions are code points, end exclusive. Null and empty texts have none.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [[dict(zip(SPAN.names, s, strict=True)) for s in spans_of(t.as_py() or "", formats)] for t in b.column(1)]
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("text", pa.string())]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, kind)], names=[doc, "secrets"])

    rows = docs.select(F.col(doc), F.col(text))
    return rows.mapInArrow(each, StructType([rows.schema[0], StructField("secrets", ArrayType(SPAN))]))


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns, and the greatest score of a document's spans."""
    found = find_secrets(docs, fit(docs))
    line = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    base = F.filter("secrets", lambda x: x["kind"] != "format")

    def number(kind: str):
        return F.size(F.filter("secrets", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id", *[number(k) for k in KINDS[:3]],
        F.sha2(F.concat_ws(",", F.transform(base, line)), 256).alias("base_sha256"),
        F.concat_ws(",", F.transform("secrets", line)).alias("spans"),
        F.round(F.array_max(F.transform("secrets", lambda x: x["score"])), 3).alias("top_score"),
    )
