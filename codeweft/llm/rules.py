"""Quality rules: base counts, and the distance of a document's histograms from its language's.

Everything is a column expression. A first pass gives each document its counts
(word and character classes, common words); it is written down, the references
are the means of these histograms over all sound documents of a language, and a second
pass over the small table compares each document with its reference by
Jensen-Shannon distance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeweft.llm.common import NOT_SPACE, staged, words_of

#: The most common words of each language with a reference.
COMMON = {
    "en": "the of and to in is that it was for on are with as be at by this from or an not have",
    "de": "der die das und in zu den von mit sich des auf für ist im dem nicht ein eine als auch",
    "fr": "de la le les et des en un une du que qui dans est pour par sur pas au avec il",
    "es": "de la que el en y a los se del las un por con no una su para es al lo",
}
#: Character classes, as the inside of a Java character class. The rest of the
#: visible characters, mostly small letters, are the last class of the histogram.
CLASSES = {
    "upper": r"A-Z", "digit": r"0-9", "stop": r".,;:'", "loud": r"!?",
    "symbol": r"#*$%&|<>@^~=+{}\[\]\\_/", "beyond": r"\x{80}-\x{10FFFF}",
}
#: Window of the repeated-words count, and its limits.
WINDOW, LEAST_WORDS, MOST_REPEATED = 8, 20, 30
#: The greatest Jensen-Shannon distance (square root of the divergence to base 2,
#: 0 to 1) that is kept: a + b / sqrt(draws), as the distance of a sample from its
#: source falls with the root of its size. Draws are characters or words.
MOST_CLASSES, MOST_WORDS = (0.12, 2.0), (0.06, 2.2)
#: Shorter documents are not compared: too few draws for a histogram.
LEAST_CHARS, LEAST_FOR_WORDS = 100, 60


def repeated_words(words: Column) -> Column:
    """array<long>: the hash of each window of WINDOW words, from the words' own hashes.

    words must be a column of its own, not an expression: it is used for each window.
    """
    windows = F.transform(F.sequence(F.lit(1), F.size(words) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(words, i, WINDOW)))
    return F.when(F.size(words) > WINDOW, windows).otherwise(F.array().cast("array<bigint>"))


def repeats(ranked: str) -> Column:
    """array<int>: in order, the places i of those in a column of structs (h, i), sorted, whose h is there twice or more."""
    own = F.col(ranked)

    def twin(x: Column, k: Column) -> Column:
        return F.coalesce(x["h"] == F.get(own, k - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get(own, k + 1)["h"], F.lit(False))

    return F.array_sort(F.transform(F.filter(own, twin), lambda x: x["i"]))


def union_length(starts: Column) -> Column:
    """Words under windows of WINDOW words at these sorted starts."""
    kind = "struct<end:bigint,n:bigint>"
    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")).cast(kind)

    def step(a: Column, x: Column) -> Column:
        end = x + WINDOW
        return F.struct(end.alias("end"), (a["n"] + end - F.greatest(a["end"], x)).alias("n")).cast(kind)

    return F.aggregate(starts, start, step, lambda a: a["n"])


def counts(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """docs with the base counts and two histograms: classes and common, arrays of long.

    A null text counts as empty. Common words are compared in lower case.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    tongue = F.lower(F.trim(F.coalesce(F.col(lang), F.lit(""))))
    known = F.lit(None).cast("array<string>")
    for k, v in COMMON.items():
        known = F.when(tongue == k, F.array(*[F.lit(w) for w in v.split()])).otherwise(known)
    every = sorted({w for v in COMMON.values() for w in v.split()})
    docs = docs.withColumns({"_words": words_of(body), "_lines": F.filter(F.split(body, "\n", -1), lambda x: F.regexp_like(x, F.lit(NOT_SPACE)))})
    words = F.col("_words")
    bare = F.split(F.lower(body), r"[\x20\x09-\x0D.,;:!?]+", -1)
    docs = docs.withColumns({
        "n_words": F.size(words).cast("long"),
        "word_chars": F.char_length(F.array_join(words, "")).cast("long"),
        "n_symbols": F.regexp_count(body, F.lit("[#*$%&|<>]")).cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "_hashes": F.transform(words, lambda w: F.xxhash64(w)),
        "_known": known,
        "_seen": F.filter(bare, lambda w: w.isin(every)),
        "classes": F.array(*[F.regexp_count(body, F.lit(f"[{c}]")).cast("long") for c in CLASSES.values()]),
        "reference": F.when(tongue.isin(list(COMMON)), tongue),
    })
    rest = F.greatest(F.col("word_chars") - F.aggregate("classes", F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0))
    docs = docs.withColumns({"classes": F.array_append("classes", rest), "_windows": repeated_words(F.col("_hashes"))})
    many = F.size("_windows") > F.size(F.array_distinct("_windows"))
    # a column that a lambda uses must be used outside too: else its expression moves into the lambda and is made for each element
    none = F.transform("_known", lambda k: F.lit(0).cast("long"))
    common = F.when(F.size("_seen") > 0, F.transform("_known", lambda k: F.size(F.filter(F.col("_seen"), lambda w: w == k)).cast("long"))).otherwise(none)
    docs = docs.withColumns({"_ranked": F.when(many, F.array_sort(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))), "common": common})
    docs = docs.withColumn("n_repeat_words", F.coalesce(union_length(repeats("_ranked")), F.lit(0)).cast("long"))
    rest = F.greatest(F.col("n_words") - F.aggregate("common", F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0))
    docs = docs.withColumn("common", F.array_append("common", rest))
    return docs.drop("_words", "_lines", "_windows", "_known", "_seen", "_ranked", "_hashes")


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "classes", "common", "reference"]


def failed() -> Column:
    """The base verdict, from the counts."""
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def references(counted: DataFrame) -> DataFrame:
    """(reference, r_classes, r_common): mean histograms of a language; one row for each key of COMMON at most.

    All documents that the base counts pass weigh the same, so a few very long ones don't set the reference.
    """
    def means(name: str, n: int) -> list[Column]:
        total = F.aggregate(name, F.lit(0).cast("long"), lambda s, x: s + x)
        return [F.avg(F.get(name, F.lit(i)) / F.when(total > 0, total)) for i in range(n)]

    longest = max(len(v.split()) for v in COMMON.values()) + 1
    sound = counted.where(F.col("reference").isNotNull() & ~failed())
    known = sound.groupBy("reference").agg(F.array(*means("classes", len(CLASSES) + 1)).alias("r_classes"), F.array(*means("common", longest)).alias("r_common"))
    return known.withColumn("r_common", F.filter("r_common", lambda x: x.isNotNull()))


def js_distance(a: Column, b: Column) -> Column:
    """Square root of the Jensen-Shannon divergence (base 2) of two histograms; null if one is empty or missing."""
    total = lambda h: F.aggregate(h, F.lit(0.0), lambda s, x: s + x)
    pairs = F.zip_with(a, b, lambda x, y: F.struct((x / total(a)).alias("p"), (y / total(b)).alias("q")))

    def part(p: Column, m: Column) -> Column:
        return F.when(p > 0, p * F.log2(p / m)).otherwise(0.0)

    terms = F.transform(pairs, lambda z: part(z["p"], (z["p"] + z["q"]) / 2) + part(z["q"], (z["p"] + z["q"]) / 2))
    whole = F.aggregate(terms, F.lit(0.0), lambda s, x: s + x) / 2
    return F.when((total(a) > 0) & (total(b) > 0), F.sqrt(F.greatest(whole, F.lit(0.0))))


def judge(docs: DataFrame, text: str = "text", lang: str = "lang", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns keep of docs with the base counts, base_failed, js_classes, js_common and kept.

    Documents of a language without reference, and those under the minimum
    lengths, are judged by the base counts alone; both distances are then null.
    References are broadcast: they have len(COMMON) rows at most.
    """
    counted = staged(counts(docs, text, lang).select(*keep, *COUNTS), "rules")
    judged = counted.join(F.broadcast(references(counted)), "reference", "left")
    judged = judged.withColumns({
        "base_failed": failed(),
        "js_classes": F.when(F.col("word_chars") >= LEAST_CHARS, F.round(js_distance(F.col("classes"), F.col("r_classes")), 6)),
        "js_common": F.when(F.col("n_words") >= LEAST_FOR_WORDS, F.round(js_distance(F.col("common"), F.col("r_common")), 6)),
    })
    def beyond(distance: str, draws: str, most: tuple[float, float]) -> Column:
        return F.coalesce(F.col(distance) > most[0] + most[1] / F.sqrt(draws), F.lit(False))

    far = beyond("js_classes", "word_chars", MOST_CLASSES) | beyond("js_common", "n_words", MOST_WORDS)
    return judged.withColumn("kept", ~F.col("base_failed") & ~far).drop("r_classes", "r_common", "reference")


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns for documents; judge() has the distances too."""
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return judge(docs.select("doc_id", "text", "lang")).select(*names)
