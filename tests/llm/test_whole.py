"""Registered queries on whole small tables against SQL or plain versions, and rows that break careless operators."""

import re
import time
import zlib

import duckdb
import pytest

import __spark_entry__ as entry
from codeweft.llm import decontaminate, packing, pii, quality, rules, substrings, toxicity
from codeweft.llm.labels import fold
from tests.llm.plain import quality_score, toxic_score

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op2_decontamination", "op5_quality_rules", "op6_substring_dedup", "op9_warc", "secrets_base", "pii_base"])
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = entry.queries()[name](spark, SF)
    want = con.execute(entry.oracle_sql()[name])
    assert got.columns == [c[0] for c in want.description]
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())


@pytest.mark.parametrize("name,label,score,folds,held", [("op3_quality", "quality", quality_score, 5, 0), ("op10_toxicity", "toxic", toxic_score, 4, 2)])
def test_scores_by_brute_force(spark, name, label, score, folds, held):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = {"quality": quality, "toxic": toxicity}[label].fit(docs, labels, fold("doc_id", folds) != held)
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = entry.queries()[name](spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = score(model, texts[r.doc_id])
        assert abs(r.score - want) < 2e-6 and r.predicted == int(r.score >= 0.3) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % folds == held)
    # labels of the held-out fold, lang, source and ids play no part
    other = docs.selectExpr("doc_id", "text", "'xx' AS lang", "'s' AS source", "1.5 AS score", "doc_id AS y", "1 AS _id")
    turned = labels.withColumn(label, (1 - labels[label]).cast("int")).where(fold("doc_id", folds) == held).unionByName(labels.where(fold("doc_id", folds) != held))
    again = {"quality": quality, "toxic": toxicity}[label].digest(spark, other, turned).collect()
    assert {tuple(r) for r in again} == {tuple(r) for r in rows}


def test_ids_stay_whole_beside_a_null(spark):
    text = " ".join(f"w{k}" for k in range(120))
    rows = [(2**60 + 1, text), (None, text), (2**60 + 3, "x " + text), (None, None), (2**60 + 3, "x " + text), (5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    key = lambda r: (r[0] or 0, *r[1:])
    got = sorted(((r.doc_id, r.n_words, r.n_removed) for r in substrings.digest(docs).collect()), key=key)
    assert got == [(None, 0, 0), (None, 120, 0), (5, 0, 0), (2**60 + 1, 120, 0), (2**60 + 3, 121, 120), (2**60 + 3, 121, 120)]
    got = sorted((r.doc_id or 0, r.length > 1) for r in packing.digest(docs).collect())
    assert got == [(0, False), (0, True), (5, False), (2**60 + 1, True), (2**60 + 3, True), (2**60 + 3, True)]


def test_many_copies_of_a_window_are_sent_once_for_each_block(spark, monkeypatch):
    monkeypatch.setattr(substrings, "FLUSH", 500)
    monkeypatch.setattr(substrings, "BUCKET", 2_000)  # many buckets
    text = " ".join(f"w{k}" for k in range(90))
    docs = spark.createDataFrame([(i, f"{text} own{i} end") for i in range(60)], "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in substrings.remove_repeats(docs).collect()}
    assert len(got) == 60 and all(got[i].kept == (f"{text} own0 end" if not i else f"own{i} end") for i in got)


def test_repeated_ids_of_items_and_documents(spark):
    w = [f"w{k}" for k in range(80)]
    items = [(1, " ".join(w[:40])), (1, " ".join(w[:40])), (2, " ".join(w[:40])), (2, " ".join(w[40:])), (None, " ".join(w[:20])), (3, None), (3, "a b c d e"), (4, "too short")]
    docs = [(10, " ".join(w[:40])), (10, " ".join(w[36:])), (11, " ".join(w[:40])), (None, " ".join(w)), (12, "a b c d e"), (12, "a b c d e"), (13, None)]
    grams = lambda ts: {tuple(x[k : k + 5]) for t in ts for x in [(t or "").split()] for k in range(len(x) - 4)}
    want = set()
    for d in {i for i, _ in docs}:
        for b in {i for i, _ in items}:
            own, held = grams(t for i, t in items if i == b), grams(t for i, t in docs if i == d)
            if own and len(own & held) >= 0.8 * len(own):
                want.add((d, b, len(own), len(own & held), round(len(own & held) / len(own), 6)))
    got = decontaminate.contained(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want and (None, None, 16, 16, 1.0) in want


def test_only_candidates_are_verified(spark):
    """Documents that hold shingles of an item, but none of its sketch, are no candidates."""
    w = [f"w{k}" for k in range(100)]
    items = spark.createDataFrame([(1, " ".join(w))], "item_id long, text string")
    sketch = decontaminate.sketched(items).collect()
    assert [r.n for r in sketch] == [96] * 26 and {r.size_class for r in sketch} == {7}  # of 128 shingles 128 - 103 + 1 = 26 suffice
    docs = spark.createDataFrame([(k, " ".join(w[k : k + 5])) for k in range(96)], "doc_id long, text string")
    pairs = decontaminate.candidates(docs, decontaminate.sketched(items), "doc_id", "item_id", "text")
    assert pairs.count() == len(sketch) < 96


def test_very_long_texts_take_seconds(spark):
    numbers = " ".join(f"user{k}@mail.org +1 269 555 {k % 9000 + 1000}" for k in range(60_000))
    words = "ab cd ef gh " * 125_000
    docs = spark.createDataFrame([(1, numbers, "en"), (2, words, "en")], "doc_id long, text string, lang string").repartition(2).persist()
    docs.count()
    began = time.monotonic()
    got = {r.doc_id: r for r in pii.digest(pii.find_pii(docs.select("doc_id", "text"))).collect()}
    assert got[1].n_email == got[1].n_phone == 60_000 and got[2].n_email == 0
    assert got[1].spans.startswith("email:0:14,email:") and got[1].spans.count(",") == 119_999
    clean = {r.doc_id: r.text for r in pii.redact(docs.where("doc_id = 2").select("doc_id", "text")).collect()}
    assert clean[2] == words
    got = {r.doc_id: r for r in rules.digest(docs).collect()}
    assert (got[2].n_words, got[2].n_repeat_words, got[2].base_failed) == (500_000, 500_000, True) and got[1].n_words == 300_000
    assert time.monotonic() - began < 120
    docs.unpersist()


def test_redaction_of_many_spans(spark):
    text = "".join(f"a{k}@b.co, " for k in range(3_000)) + "end"
    [row] = pii.redact(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert row.text == re.sub(r"a[0-9]+@b\.co", "[EMAIL]", text)


def test_encoder_falls_back_to_the_tokenizer():
    from tokenizers import Tokenizer

    text = "Hello  World, it's 12 cafés\n"
    for name, by_words in (("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)):
        path = packing.tokenizer_path(name)
        own = packing.Encoder(path)
        assert own.by_words == by_words and list(memoryview(own.encode(text)).cast("I")) == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("module,label,name", [(quality, "quality", "held_out"), (toxicity, "toxic", "held_out")])
def test_scores_of_awkward_rows(spark, module, label, name):
    """Null ids and texts, repeated rows, clashing columns: one row out for each row in, without an id in no fold."""
    rows = [(None, "some words"), (None, None), (1, None), (1, None), (2, ""), (3, "word " * 5_000), (2**60 + 1, "a line\nand another")]
    docs = spark.createDataFrame([(i, t, 0.5, True, 1, 2) for i, t in rows], "doc_id long, text string, score double, held_out boolean, y int, _id int")
    labels = spark.createDataFrame([(1, None), (None, 1), (2, 1)], f"doc_id long, {label} int")
    got = module.digest(spark, docs, labels).collect()
    assert sorted((r.doc_id or 0) for r in got) == sorted((i or 0) for i, _ in rows)
    assert all((r[name] is None) == (r.doc_id is None) and 0 <= r.score <= 1 for r in got)


def test_files_of_hot_fingerprints(spark):
    """A third of all rows in one text, and a group of near fingerprints: each row once, with the smallest id."""
    from codeweft.llm import simhash

    words = [f"w{k}" for k in range(300)]
    rows = [(k, " ".join(words)) for k in range(100, 1_300)] + [(2_000 + k, " ".join(words[:k] + ["x"] + words[k:])) for k in range(0, 300, 3)] + [(5_000 + k, f"text {k} of its own " + " ".join(words[k % 250 : k % 250 + 9])) for k in range(2_000)]
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows) and {r.component_id for r in got if r.doc_id < 1_300} == {100}
    assert sum(r.component_id == 100 for r in got if 2_000 <= r.doc_id < 3_000) > 50
