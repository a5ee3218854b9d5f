"""Personal data: patterns propose spans, checksums confirm them, context words move the score.

Everything is a column expression; no Python runs on the executors. Java's
split() on a pattern gives the gaps between the same leftmost matches that
regexp_extract_all() gives, so lengths of gaps and matches add up to positions, and
the ends of the gaps are what stands around a match. Running values go over blocks
of BLOCK elements, and then over the blocks, so no array grows element by element
through a long text, and the text is never searched for a position.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOCAL = "[A-Za-z0-9._%+-]"
#: The base patterns, in their fixed order. The look-behind and the possessive
#: repeats only spare backtracking over long runs; the matches are the same.
BASE = {
    "email": rf"(?:(?<!{LOCAL})|\G){LOCAL}++@[A-Za-z0-9-]++(\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Stricter shapes that a base match can have swallowed together with a
#: neighbouring number, and account numbers, which have no base pattern.
ADDED = {
    "card": r"(?<![0-9])(?:[0-9]{16,19}|[0-9]{4}(?:[\x20-][0-9]{4}){3})(?![0-9])",
    "phone": r"\+[0-9]{1,3}[\x20.-]?\(?[0-9]{2,4}\)?[\x20.-]?[0-9]{3,4}[\x20.-]?[0-9]{4}(?![0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])",
}
KINDS = ["email", "ip", "card", "phone", "iban"]
#: Words that speak for a kind when they stand within NEAR characters and no match of the same pattern lies between.
CONTEXT = {
    "email": "e-?mail|mail to|contact|write to|correo|courriel",
    "ip": r"\bip\b|address|server|host|adresse|direcci",
    "card": "card|visa|master|amex|credit|debit|karte|carte|tarjeta",
    "phone": "phone|call|tel|mobile|fax|anruf|appel|llam",
    "iban": "iban|account|bank|konto|compte|cuenta",
}
#: Words that speak against it: the number is named as something else.
AGAINST = r"\b(?:order|invoice|version|isbn|serial|ticket|sku)\b"
NEAR = 40
#: Elements of a block of running values, and characters of a chunk of a text that is put together anew.
BLOCK, CHUNK = 256, 8_192
#: A pattern alone, with a checksum, with a word for or against it; an added span needs KEEP.
PLAIN, CHECKED, NAMED, OTHER, KEEP = 0.5, 0.3, 0.2, -0.3, 0.5
SPAN = "struct<kind:string,start:int,end:int,score:double,base:boolean,text:string>"


def found(gaps: str, hits: str) -> Column:
    """array<struct<n, before, m, after>>: the matches m of a pattern, the length n of the gap before each, what stands before and after; the last has no match."""
    first = F.zip_with(gaps, hits, lambda g, m: F.struct(F.char_length(g).alias("n"), F.right(g, F.lit(NEAR)).alias("before"), m.alias("m")))
    return F.zip_with(first, F.slice(gaps, F.lit(2), F.size(gaps)), lambda x, g: F.struct(x["n"].alias("n"), x["before"].alias("before"), x["m"].alias("m"), F.left(g, F.lit(NEAR)).alias("after")))


def running(name: str, step: Callable[[Column, Column], Column], join: Callable[[Column, Column], Column], start: Column) -> Column:
    """array<int>: for each element of an array column, not empty, what step has made of all before it; join does the same for a block's result from start."""
    none = F.array().cast("array<int>")
    at = F.sequence(F.lit(0), F.floor((F.size(name) - 1) / BLOCK).cast("int"))
    blocks = F.transform(at, lambda k: F.slice(F.col(name), k * BLOCK + 1, F.lit(BLOCK)))
    begun = F.struct(start.alias("at"), none.alias("out"))
    totals = F.transform(at, lambda k: F.aggregate(F.slice(F.col(name), k * BLOCK + 1, F.lit(BLOCK)), start, step))
    carried = F.aggregate(totals, begun, lambda a, t: F.struct(join(a["at"], t).alias("at"), F.array_append(a["out"], a["at"]).alias("out")), lambda a: a["out"])
    own = lambda block, c: F.aggregate(block, F.struct(c.alias("at"), none.alias("out")), lambda a, x: F.struct(step(a["at"], x).alias("at"), F.array_append(a["out"], a["at"]).alias("out")), lambda a: a["out"])
    return F.flatten(F.zip_with(blocks, carried, own))


def located(name: str) -> Column:
    """array<struct<s int, e int, m, before, after>> of a column that found() made: the matches, with their positions in code points."""
    ends = running(name, lambda a, x: a + x["n"] + F.coalesce(F.char_length(x["m"]), F.lit(0)), lambda a, t: a + t, F.lit(0))
    spans = F.zip_with(name, ends, lambda x, at: F.struct((at + x["n"]).alias("s"), (at + x["n"] + F.char_length(x["m"])).alias("e"), x["m"].alias("m"), x["before"].alias("before"), x["after"].alias("after")))
    return F.filter(spans, lambda x: x["m"].isNotNull())


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def characters(value: Column) -> Column:
    """array<string> of the characters of a string that has some."""
    return F.transform(F.sequence(F.lit(1), F.char_length(value)), lambda i: F.substr(value, i, F.lit(1)))


def luhn(number: Column) -> Column:
    """Whether a string of digits has a right Luhn check digit."""
    figures = F.transform(characters(F.reverse(number)), lambda c: c.try_cast("int"))
    doubled = F.transform(figures, lambda d, i: F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + d) % 10 == 0


def mod97(account: Column) -> Column:
    """Whether an account number, spaces allowed, leaves 1 when divided by 97 as ISO 13616 says."""
    plain = F.replace(account, F.lit(" "), F.lit(""))
    turned = F.concat(F.substr(plain, F.lit(5)), F.substr(plain, F.lit(1), F.lit(4)))
    value = F.transform(characters(turned), lambda c: F.when(c.between("0", "9"), c.try_cast("int")).otherwise(F.ascii(c) - 55))
    rest = F.aggregate(value, F.lit(0), lambda a, v: F.when(v > 9, (a * 100 + v) % 97).otherwise((a * 10 + v) % 97))
    return F.char_length(plain).between(15, 34) & (rest == 1)


def valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        parts = F.transform(F.split(match, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
        return F.forall(parts, lambda p: (F.char_length(p) <= 3) & F.coalesce(p.try_cast("int") <= 255, F.lit(False)))
    if kind == "card":
        number = digits(match)
        return F.char_length(number).between(16, 19) & luhn(number)
    if kind == "phone":
        return F.char_length(digits(match)).between(8, 15)
    if kind == "iban":
        return mod97(match)
    return F.lit(True)


def scored(kind: str, span: Column, base: bool) -> Column:
    near = F.lower(F.concat(span["before"], span["m"], span["after"]))
    score = F.lit(PLAIN + (CHECKED if kind in ("card", "iban") else 0.0))
    score = score + F.when(F.regexp_like(near, F.lit(CONTEXT[kind])), NAMED).otherwise(0.0)
    score = score + F.when(F.regexp_like(near, F.lit(AGAINST)), OTHER).otherwise(0.0)
    return F.struct(
        F.lit(kind).alias("kind"), span["s"].alias("start"), span["e"].alias("end"),
        F.round(score, 3).alias("score"), F.lit(base).alias("base"), span["m"].alias("text"),
    ).cast(SPAN)


def find_pii(docs: DataFrame, text: str = "text", out: str = "pii") -> DataFrame:
    """docs with a column out: array of spans (kind, start, end, score, base, text), by kind, then start.

    Base spans are all kept, whatever their score. Spans of the stricter shapes
    follow where they overlap no base span and reach KEEP. Null and empty texts
    get an empty array. A text without digit and without @ is not searched.
    """
    body, none = F.coalesce(F.col(text), F.lit("")), F.array().cast(f"array<{SPAN}>")
    numbers = F.regexp_like(body, F.lit("[0-9]"))
    asks = {"email": F.contains(body, F.lit("@")), "ip": numbers, "card": numbers, "phone": numbers & F.contains(body, F.lit("+")), "iban": numbers}
    shapes = {f"_{out}_{'b' if base else 'a'}_{k}": (k, p, base) for base, named in ((True, BASE), (False, ADDED)) for k, p in named.items()}
    docs = docs.withColumns({f"{name}_g": F.when(asks[k], F.split(body, p, -1)) for name, (k, p, _) in shapes.items()} | {f"{name}_m": F.when(asks[k], F.regexp_extract_all(body, F.lit(p), F.lit(0))) for name, (k, p, _) in shapes.items()})
    docs = docs.withColumns({name: F.when(F.size(f"{name}_g") > 1, found(f"{name}_g", f"{name}_m")) for name in shapes})

    def spans(name: str, kind: str, base: bool) -> Column:
        own = F.filter(located(name), lambda x: valid(kind, x["m"]))
        return F.when(F.size(name) > 1, F.transform(own, lambda x: scored(kind, x, base))).otherwise(none)

    sides = {side: F.concat(*[spans(name, k, base) for name, (k, _, base) in shapes.items() if base == (side == "b")]) for side in "ba"}
    docs = docs.withColumns({f"_{out}_{side}": x for side, x in sides.items()}).drop(*shapes, *[f"{name}_{x}" for name in shapes for x in "gm"])
    b, a, line, back = F.col(f"_{out}_b"), F.col(f"_{out}_a"), f"_{out}_line", f"_{out}_back"
    # all by start, base spans first on a tie; an added one is clear if no base span before reaches it and none after begins in it
    both = F.array_sort(F.transform(F.concat(b, F.filter(a, lambda x: x["score"] >= KEEP)), lambda x: F.struct(x["start"].alias("s"), (~x["base"]).alias("added"), x.alias("x"))))
    docs = docs.withColumn(line, F.when(F.size(a) > 0, both)).withColumn(back, F.reverse(line))
    reach = running(line, lambda m, z: F.when(z["added"], m).otherwise(F.greatest(m, z["x"]["end"])), F.greatest, F.lit(0))
    ahead = running(back, lambda m, z: F.when(z["added"], m).otherwise(F.least(m, z["s"])), F.least, F.lit(2**31 - 1))
    judged = F.zip_with(F.zip_with(line, reach, lambda z, m: F.struct(z.alias("z"), m.alias("reach"))), F.reverse(ahead), lambda y, m: F.when(y["z"]["added"] & (y["reach"] <= y["z"]["s"]) & (m >= y["z"]["x"]["end"]), y["z"]["x"]))
    clear = F.when(F.size(line) > 0, F.array_compact(judged)).otherwise(none)
    order = {k: i for i, k in enumerate(KINDS)}
    rank = lambda x: F.concat(*[F.when(x["kind"] == k, F.lit(str(i))).otherwise("") for k, i in order.items()])
    merged = F.transform(
        F.array_sort(F.transform(F.concat(b, clear), lambda x: F.struct(rank(x).alias("k"), x["start"].alias("s"), x.alias("x")))),
        lambda z: z["x"],
    )
    return docs.withColumn(out, F.when(F.size(b) + F.size(a) == 0, none).otherwise(merged)).drop(f"_{out}_b", f"_{out}_a", line, back)


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with each span of personal data in text replaced by its kind in square brackets.

    Of spans that overlap, the one that begins first stands and the mark of the
    others is left out; all their characters go. A null text stays null.
    """
    docs = find_pii(docs, text, "_pii")
    body = F.col(text)
    ordered = F.array_sort(F.transform(F.col("_pii"), lambda x: F.struct(x["start"].alias("s"), x["end"].alias("e"), x["kind"].alias("k"))))
    # an element after the last span stands for the end of the text
    last = F.struct(F.char_length(body).alias("s"), F.char_length(body).alias("e"), F.lit(None).cast("string").alias("k"))
    some = F.size("_pii") > 0
    docs = docs.withColumns({"_pii_order": F.when(some, F.array_append(ordered, last)), "_pii_chunks": F.when(some, F.regexp_extract_all(body, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0)))})

    def between(a: Column, b: Column) -> Column:
        """The text from a to b, from its chunks."""
        chunks = F.col("_pii_chunks")
        part = lambda c: F.substring(F.get(chunks, c), F.greatest(a - c * CHUNK, F.lit(0)) + 1, F.least(b - c * CHUNK, F.lit(CHUNK)) - F.greatest(a - c * CHUNK, F.lit(0)))
        at = lambda x: F.floor(x / CHUNK).cast("int")
        return F.when(a < b, F.array_join(F.transform(F.sequence(at(a), at(b - 1)), part), "")).otherwise("")

    def piece(x: Column, at: Column) -> Column:
        mark = F.when((x["s"] >= at) & x["k"].isNotNull(), F.concat(F.lit("["), F.upper(x["k"]), F.lit("]"))).otherwise("")
        return F.concat(between(at, x["s"]), mark)

    reach = running("_pii_order", lambda m, x: F.greatest(m, x["e"]), F.greatest, F.lit(0))
    clean = F.array_join(F.zip_with("_pii_order", reach, piece), "")
    return docs.withColumn(text, F.when(some & (F.size("_pii_chunks") > 0), clean).otherwise(body)).drop("_pii", "_pii_order", "_pii_chunks")


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns from find_pii()'s: counts and hash of base spans, all spans as a string."""
    line = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    base = F.filter(F.col("pii"), lambda x: x["base"])

    def number(kind: str) -> Column:
        return F.size(F.filter(base, lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id", *[number(k) for k in BASE],
        F.sha2(F.concat_ws(",", F.transform(base, line)), 256).alias("base_sha256"),
        F.concat_ws(",", F.transform(F.col("pii"), line)).alias("spans"),
        F.round(F.aggregate(F.col("pii"), F.lit(0.0), lambda a, x: a + x["score"]), 3).alias("score_sum"),
    )
