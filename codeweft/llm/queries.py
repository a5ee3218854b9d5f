"""The registered queries of the corpus operators, one opN_<name> each, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from codeweft.llm import decontaminate, packing, pii, quality, rules, secrets, simhash, substrings, toxicity, warc
from codeweft.llm.common import table


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in documents: counts and hash of the base spans, all spans, the greatest score."""
    return secrets.digest(table(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, item_id, n_item, n_shared, containment): benchmark items that documents contain."""
    return decontaminate.contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, held_out, score, predicted): quality of documents, learned from labels outside the held-out fold."""
    return quality.digest(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in documents: counts and hash of the base spans, all spans, the sum of their scores."""
    return pii.digest(pii.find_pii(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts of documents, the base verdict and the whole one."""
    return rules.digest(table(spark, sf_dir, "documents"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256): documents without the 50-word windows of documents with smaller ids."""
    return substrings.digest(table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The token pieces of documents and their places in sequences of at most 4096 tokens."""
    return packing.digest(table(spark, sf_dir, "documents"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, fingerprint, component_id): documents linked by fingerprints of at most 4 differing bits."""
    return simhash.digest(table(spark, sf_dir, "documents"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of pages, written to ZIP-packaged archives and read back by ranges."""
    return warc.digest(table(spark, sf_dir, "pages"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, held_out, score, predicted): toxicity of documents, learned from labels outside the held-out fold."""
    return toxicity.digest(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def secrets_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op1_secrets that the base patterns decide, which SQL can express."""
    return op1_secrets(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256")


def pii_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op4_pii that the base patterns decide, which SQL can express."""
    return op4_pii(spark, sf_dir).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secrets": op1_secrets,
    "op2_decontamination": op2_decontamination,
    "op3_quality": op3_quality,
    "op4_pii": op4_pii,
    "op5_quality_rules": op5_quality_rules,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_packing": op7_packing,
    "op8_simhash": op8_simhash,
    "op9_warc": op9_warc,
    "op10_toxicity": op10_toxicity,
    "secrets_base": secrets_base,
    "pii_base": pii_base,
}

#: Base patterns as SQL has them; the second is the group that is looked at.
PII_SQL = {
    "email": ("[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+", 0, "true"),
    "ip": ("[0-9]+(\\.[0-9]+)(\\.[0-9]+)(\\.[0-9]+)", 0, "list_max(list_transform(string_split(v, '.'), lambda x: x::HUGEINT)) <= 255"),
    "card": ("[0-9]([\\x20-]?[0-9])+", 0, "length(d) BETWEEN 16 AND 19 AND list_sum(list_transform(range(length(d)), lambda i: CASE WHEN i % 2 = 0 THEN reverse(d)[i + 1]::INT WHEN reverse(d)[i + 1] > '4' THEN 2 * reverse(d)[i + 1]::INT - 9 ELSE 2 * reverse(d)[i + 1]::INT END)) % 10 = 0"),
    "phone": ("\\+[0-9][\\x20().0-9-]+[0-9]", 0, "length(d) BETWEEN 8 AND 15"),
}
SECRETS_SQL = {
    "assign": ("(?i:(password|passwd|secret|token|api_?key))[\"'']?\\x20*[:=]\\x20*[\"'']?([A-Za-z0-9+/_.=-]+)", 2, "length(v) >= 6"),
    "access": ("AKIA[A-Z0-9]+", 0, "length(v) >= 20"),
    "hex": ("[0-9a-f]+", 0, "length(v) >= 24"),
}


def spans_sql(patterns: dict[str, tuple[str, int, str]], order: str) -> str:
    """Counts and hash of the spans of base patterns: matches v between gaps g, their places the sums of lengths before."""
    parts = [
        f"""SELECT doc_id, {k} AS k, '{name}' AS kind, unnest(list_transform(range(1, len(m) + 1), lambda i: list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0))) AS s, unnest(list_transform(m, lambda x: length(x))) AS n, unnest(v) AS v
  FROM (SELECT doc_id, regexp_split_to_array(t, '{p}') AS g, regexp_extract_all(t, '{p}') AS m, regexp_extract_all(t, '{p}', {group}) AS v FROM d) WHERE len(m) > 0"""
        for k, (name, (p, group, _)) in enumerate(patterns.items())
    ]
    right = " OR ".join(f"(kind = '{name}' AND {test})" for name, (_, _, test) in patterns.items())
    counts = ", ".join(f"count(kind) FILTER (WHERE kind = '{name}') AS n_{name}" for name in patterns)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), every AS ({" UNION ALL ".join(parts)}),
kept AS (SELECT * FROM (SELECT *, regexp_replace(v, '[^0-9]', '', 'g') AS d FROM every) WHERE {right})
SELECT d.doc_id, {counts}, sha256(coalesce(string_agg(kind || ':' || s::BIGINT || ':' || (s + n)::BIGINT, ',' ORDER BY {order}), '')) AS base_sha256
FROM d LEFT JOIN kept USING (doc_id) GROUP BY d.doc_id
"""


ORACLES: dict[str, str] = {
    "op2_decontamination": """
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents
), d AS (
  SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM w
), v AS (
  SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM benchmark
), b AS (
  SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM v
), n AS (SELECT item_id, count(*) AS n_item FROM b GROUP BY item_id)
SELECT doc_id, item_id, n_item, count(*) AS n_shared, round(count(*) / n_item, 6) AS containment
FROM d JOIN b USING (s) JOIN n USING (item_id)
GROUP BY doc_id, item_id, n_item HAVING count(*) >= 0.8 * n_item - 1e-9
""",
    "op5_quality_rules": f"""
WITH lists AS (
  SELECT * FROM (VALUES {", ".join(f"('{k}', string_split('{v}', ' '))" for k, v in rules.COMMON.items())}) t (lang, known)
), d AS (
  SELECT doc_id, lower(trim(coalesce(lang, ''))) AS lang, coalesce(text, '') AS text,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l,
    regexp_split_to_array(lower(coalesce(text, '')), '[\\x20\\x09-\\x0D.,;:!?]+') AS bare
  FROM documents
), win AS (
  SELECT doc_id, unnest(range(1, len(w) - 6)) AS i, unnest(list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i + 7], ' '))) AS x FROM d
), twin AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, x) > 1
), rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM twin) GROUP BY doc_id
), c AS (
  SELECT d.doc_id, d.lang, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words,
    [{", ".join(f"length(text) - length(regexp_replace(text, '[{c}]', '', 'g'))" for c in (x.replace("'", "''") for x in rules.CLASSES.values()))}] AS tally,
    list_transform(known, lambda k: len(list_filter(bare, lambda x: x = k))) AS found
  FROM d LEFT JOIN rep USING (doc_id) LEFT JOIN lists USING (lang)
), h AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
    list_append(tally, greatest(word_chars - list_sum(tally), 0)) AS classes,
    list_append(found, greatest(n_words - list_sum(found), 0)) AS common
  FROM c
), shares AS (
  SELECT lang, 'classes' AS of, unnest(range(1, len(classes) + 1)) AS i, unnest(list_transform(classes, lambda x: x / list_sum(classes))) AS p FROM h WHERE common IS NOT NULL AND NOT base_failed AND list_sum(classes) > 0
  UNION ALL SELECT lang, 'common', unnest(range(1, len(common) + 1)), unnest(list_transform(common, lambda x: x / list_sum(common))) FROM h WHERE common IS NOT NULL AND NOT base_failed AND list_sum(common) > 0
), ref AS (SELECT lang, of, i, avg(p) AS q FROM shares GROUP BY ALL
), ratio AS (SELECT lang, of, i, q / sum(q) OVER (PARTITION BY lang, of) AS q FROM ref
), own AS (
  SELECT doc_id, lang, 'classes' AS of, unnest(range(1, len(classes) + 1)) AS i, unnest(list_transform(classes, lambda x: x / list_sum(classes))) AS p FROM h WHERE common IS NOT NULL AND word_chars >= {rules.LEAST_CHARS}
  UNION ALL SELECT doc_id, lang, 'common', unnest(range(1, len(common) + 1)), unnest(list_transform(common, lambda x: x / list_sum(common))) FROM h WHERE common IS NOT NULL AND n_words >= {rules.LEAST_FOR_WORDS}
), far AS (
  SELECT doc_id, of, round(sqrt(greatest(sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2, 0)), 6) AS js FROM own JOIN ratio USING (lang, of, i) GROUP BY doc_id, of
), pair AS (SELECT doc_id, max(js) FILTER (WHERE of = 'classes') AS a, max(js) FILTER (WHERE of = 'common') AS b FROM far GROUP BY doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT coalesce(a > {rules.MOST_CLASSES[0]} + {rules.MOST_CLASSES[1]} / sqrt(word_chars), false) AND NOT coalesce(b > {rules.MOST_WORDS[0]} + {rules.MOST_WORDS[1]} / sqrt(n_words), false) AS kept
FROM h LEFT JOIN pair USING (doc_id)
""",
    "pii_base": spans_sql(PII_SQL, "k, s"),
    "secrets_base": spans_sql(SECRETS_SQL, "s, k"),
    "op6_substring_dedup": """
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents
), win AS (
  SELECT doc_id, unnest(range(1, len(w) - 48)) AS i, unnest(list_transform(range(1, len(w) - 48), lambda i: array_to_string(w[i:i + 49], ' '))) AS x FROM d
), late AS (SELECT doc_id, i FROM win QUALIFY min(doc_id) OVER (PARTITION BY x) < doc_id
), gone AS (SELECT doc_id, list(DISTINCT p) AS p FROM (SELECT doc_id, unnest(range(i, i + 50)) AS p FROM late) GROUP BY doc_id
), word AS (SELECT doc_id, unnest(w) AS w, unnest(range(1, len(w) + 1)) AS i FROM d JOIN gone USING (doc_id)
), left_over AS (
  SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS kept FROM word ANTI JOIN (SELECT DISTINCT doc_id, unnest(p) AS i FROM gone) USING (doc_id, i) GROUP BY doc_id
)
SELECT doc_id, len(w) AS n_words, coalesce(len(p), 0) AS n_removed, sha256(CASE WHEN p IS NULL THEN array_to_string(w, ' ') ELSE coalesce(kept, '') END) AS kept_sha256
FROM d LEFT JOIN gone USING (doc_id) LEFT JOIN left_over USING (doc_id)
""",
    "op9_warc": """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS x, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages
)
SELECT page_id, octet_length(encode(h)) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + ((((strpos('0123456789abcdef', x[5 * i // 4 + 1]) - 1) * 16 + strpos('0123456789abcdef', x[5 * i // 4 + 2]) - 1) >> (3 - 5 * i % 4)) & 31)]), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM p
""",
}
