"""The pipeline against a version of all its stages in plain Python, on whole small tables."""

import random
import re
import struct
import zlib

import corpus_pipeline
from codeweft.llm import packing, pii, toxicity
from codeweft.llm.labels import fold
from tests.llm.plain import toxic_score

SF = "/root/testdata/sf0.001"


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def singles(texts):
    """Ids that a group's smallest id keeps, by exact five-word Jaccard of all pairs."""
    sets, up = {i: shingles(t) for i, t in texts.items()}, {i: i for i in texts}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in texts:
        for b in texts:
            if a < b and (sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9):
                x, y = sorted((find(a), find(b)))
                up[y] = x
    return {i for i in texts if find(i) == i}


def test_near_copies_by_brute_force(spark):
    r = random.Random(2)
    draw = lambda n: [f"w{r.randrange(3000)}" for _ in range(n)]
    texts = {r_.doc_id: r_.text for r_ in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    base = [draw(r.randrange(20, 300)) for _ in range(12)]
    more = []
    for w in base:
        more += [w, w + draw(len(w) // 5), w + draw(len(w) // 3), draw(len(w) // 6) + w]  # far in bits, some over and some under 0.8
        for share in (40, 25, 12):
            more.append([f"z{r.random()}" if k % share == 5 else x for k, x in enumerate(w)])
    top = max(texts) + 1
    texts |= {top + k: " ".join(w) for k, w in enumerate(more)} | {top + 900: "", top + 901: " ", top + 902: "one two", top + 903: "One  two"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {x.doc_id for x in corpus_pipeline.near_duplicate_stage(spark, docs, SF).collect()} == singles(texts)
    assert corpus_pipeline.near_duplicate_stage(spark, docs.limit(0), SF).count() == 0


def leaks(text, items):
    own = lambda t: [w for w in re.split(r"[\x20\x09-\x0D]+", (t or "").lower()) if w]
    grams = lambda w: {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    held = grams(own(text))
    return any(g and len(g & held) >= 0.8 * len(g) - 1e-9 for g in map(grams, map(own, items)))


def masked(text):
    """text without personal data, span by span."""
    digits = lambda m: [int(c) for c in m if c.isdigit()]
    luhn = lambda d: sum(x if k % 2 == 0 else 2 * x - 9 * (x > 4) for k, x in enumerate(reversed(d))) % 10 == 0

    def mod97(m):
        m = m.replace(" ", "")
        return 15 <= len(m) <= 34 and int("".join(str(int(c, 36)) for c in m[4:] + m[:4])) % 97 == 1

    right = {
        "email": lambda m: True, "ip": lambda m: all(int(x) <= 255 for x in m.split(".")), "iban": mod97,
        "card": lambda m: 16 <= len(digits(m)) <= 19 and luhn(digits(m)), "phone": lambda m: 8 <= len(digits(m)) <= 15,
    }
    plain = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    base = [(m.start(), m.end(), k) for k, p in plain.items() for m in re.finditer(p, text) if right[k](m[0])]
    more = []
    for k, p in pii.ADDED.items():
        hits = list(re.finditer(p, text))
        for n, m in enumerate(hits):
            a, b = m.span()
            before, after = text[hits[n - 1].end() if n else 0 : a], text[b : hits[n + 1].start() if n + 1 < len(hits) else None]
            near = (before[-pii.NEAR :] + m[0] + after[: pii.NEAR]).lower()
            score = pii.PLAIN + (pii.CHECKED if k in ("card", "iban") else 0) + (pii.NAMED if re.search(pii.CONTEXT[k], near) else 0) + (pii.OTHER if re.search(pii.AGAINST, near) else 0)
            if right[k](m[0]) and round(score, 3) >= pii.KEEP and not any(a < y and x < b for x, y, _ in base):
                more.append((a, b, k))
    out, at = "", 0
    for a, b, k in sorted(base + more):
        out += text[at : max(a, at)] + (f"[{k.upper()}]" if a >= at else "")
        at = max(at, b)
    return out + text[at:]


def test_run_by_brute_force(spark):
    from tokenizers import Tokenizer

    read = lambda name: spark.read.parquet(f"{SF}/{name}.parquet")
    lexicon = toxicity.fit(read("documents"), read("labels"), fold("doc_id", toxicity.FOLDS) != toxicity.HELD)
    texts = {r.doc_id: r.text for r in read("documents").collect()}
    clean = {i: t for i, t in texts.items() if toxic_score(lexicon, t) < toxicity.THRESHOLD}
    single = singles(clean)
    items = [r.text for r in read("benchmark").collect()]
    left = {i: masked(clean[i]) for i in single if not leaks(clean[i], items)}
    assert len(left) < len(single) < len(clean) < len(texts) and any(left[i] != texts[i] for i in left)
    tok, want = Tokenizer.from_file(packing.tokenizer_path()), set()
    for i, t in left.items():
        ids = [*tok.encode(t, add_special_tokens=False).ids, 1]
        want |= {(i, k, at, len(p), zlib.crc32(struct.pack(f"<{len(p)}I", *p))) for k, at in enumerate(range(0, len(ids), 4096)) for p in [ids[at : at + 4096]]}
    rows = corpus_pipeline.run(spark, SF).collect()
    assert len(rows) == len(want) and {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows} == want
    ends = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= 4096 and len(ends) <= 1 + 1.2 * sum(ends.values()) / 4096


def test_stages_on_awkward_rows(spark):
    """Null and empty texts, null and repeated ids, columns whose names clash, an empty table: each stage keeps its columns and what it must."""
    kind = "doc_id long, text string, lang string, source string, n_chars long, score double, pii string, fp long, row long, body string, _toxicity int"
    long = " ".join(f"w{k}" for k in range(3_000))
    rows = [(1, None), (2, ""), (3, " \n"), (4, long), (5, long), (None, long), (None, None), (4, "another text of the same id, quite unlike the rest of them"), (2**60 + 1, "call +1 (269) 555-3296 now"), (2**60 + 3, "one")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), 0.5, "x", 1, 2, "b", 3) for i, t in rows], kind)
    benchmark = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").limit(1).collect()]
    leak = "before it " + benchmark[0] + " after it"
    docs = docs.unionByName(spark.createDataFrame([(i, t, "en", "s", 9, 0.5, "x", 1, 2, "b", 3) for i, t in ((7, leak), (None, leak), (2**60 + 3, "one"), (None, long))], kind))
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and stage(spark, docs.limit(0), SF).count() == 0, name
        kept[name] = sorted((r.doc_id or 0, r.text or "") for r in out.collect())
    every = sorted((r.doc_id or 0, r.text or "") for r in docs.collect())
    assert kept["toxicity"] == every and len(kept["pii"]) == len(every)
    # blank texts are copies of each other; of rows without an id one of each text stays, and a leak is found without an id
    assert [i for i, _ in kept["simhash_near_dedup"]] == [0, 0, 0, 1, 4, 4, 7, 2**60 + 1, 2**60 + 3]
    assert kept["benchmark_decontamination"] == [(i, t) for i, t in every if t != leak]
    assert (2**60 + 1, "call [PHONE] now") in kept["pii"]
    packed = corpus_pipeline.packing_stage(spark, docs, SF).collect()
    assert sorted((r.doc_id or 0) for r in packed if r.piece == 0) == [i for i, _ in every]
