"""Registered queries of the graph operators over the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeweft import functions as fn
from codeweft import samples, streaming
from codeweft import testgraph as tg
from codeweft.operators import algorithms, graph, resolve, store, sync, traverse
from codeweft.plans import context, cypher
from codeweft.sources import changes, parse, tree
from codeweft.staging import fresh_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its name, with its SQL where there is one."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


#: The star graph in SQL.
STAR = """
WITH sym AS (
  SELECT 'Class' AS kind, 'C' || c_custkey AS name, 'crm/n' || c_nationkey || '.py' AS file, 'C' || c_custkey AS local, c_custkey AS key, 'c' AS t FROM customer
  UNION ALL SELECT 'Function', 'O' || o_orderkey, 'sales/' || strftime(o_orderdate, '%Y%m') || '.go', 'O' || o_orderkey, o_orderkey, 'o' FROM orders
  UNION ALL SELECT 'Function', p_name, 'cat/' || p_brand || '.ts', 'P' || p_partkey || '.' || p_name, p_partkey, 'p' FROM part
  UNION ALL SELECT 'Interface', 'S' || s_suppkey, 'supply/n' || s_nationkey || '.rs', 'S' || s_suppkey, s_suppkey, 's' FROM supplier
), s AS (SELECT *, file || '::' || local AS q FROM sym),
nodes AS (
  SELECT kind, name, q AS id, file FROM s
  UNION ALL SELECT DISTINCT 'File', string_split(file, '/')[-1], file, file FROM s
), calls AS (
  SELECT a.q AS source, b.q AS target FROM orders JOIN s a ON a.t = 'c' AND a.key = o_custkey JOIN s b ON b.t = 'o' AND b.key = o_orderkey
  UNION SELECT a.q, b.q FROM lineitem JOIN s a ON a.t = 'o' AND a.key = l_orderkey JOIN s b ON b.t = 'p' AND b.key = l_partkey
  UNION SELECT a.q, b.q FROM lineitem JOIN s a ON a.t = 'p' AND a.key = l_partkey JOIN s b ON b.t = 's' AND b.key = l_suppkey
)"""
SEED = "cat/Brand#1.ts"
SEEDS = ["cat/Brand#1.ts", "supply/n3.rs"]


def _up(seed: str, depth: int) -> str:
    """CTEs u1..ud of upstream callers by file, after STAR."""
    out, found, searched = [], [], [f"SELECT '{seed}' AS file"]
    frontier = f"SELECT '{seed}' AS file"
    for d in range(1, depth + 1):
        skip = " ".join(f"AND m.id NOT IN (SELECT id FROM u{k})" for k in range(1, d))
        out.append(f"u{d} AS (SELECT DISTINCT m.id, m.file, m.name, m.kind, {d} AS distance FROM calls JOIN nodes m ON m.id = source JOIN nodes t ON t.id = target WHERE t.file IN ({frontier}) AND m.file <> '{seed}' {skip})")
        frontier = f"SELECT file FROM u{d} WHERE file NOT IN (" + " UNION ".join(searched) + ")"
        searched.append(f"SELECT file FROM u{d}")
        found.append(f"SELECT * FROM u{d}")
    return ", " + ", ".join(out) + ", up AS (" + " UNION ALL ".join(found) + ")"


def _down(seed: str, depth: int) -> str:
    """CTE down after STAR, which must begin WITH RECURSIVE."""
    return f""", walk AS (
  SELECT id, 0 AS distance FROM nodes WHERE file = '{seed}'
  UNION SELECT target, distance + 1 FROM walk JOIN calls ON source = walk.id WHERE distance < {depth}
), down AS (SELECT n.id, n.file, n.name, n.kind, min(distance) AS distance FROM walk JOIN nodes n ON n.id = walk.id WHERE n.file <> '{seed}' GROUP BY ALL)"""


RECURSIVE = STAR.replace("WITH", "WITH RECURSIVE", 1)
IMPACT = "SELECT id AS qualified_name, file AS file_rel_path, name, kind, CAST(distance AS INTEGER) AS distance FROM "
COLS = ["qualified_name", "file_rel_path", "name", "kind", "distance"]


@query(STAR + _up(SEED, 3) + IMPACT + "up")
def upstream_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traverse.upstream(tg.staged_star(spark, sf_dir), [SEED], 3).select(*COLS)


@query(RECURSIVE + _down("crm/n3.py", 3) + IMPACT + "down")
def downstream_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traverse.downstream(tg.staged_star(spark, sf_dir), ["crm/n3.py"], 3).select(*COLS)


@query(RECURSIVE + f""", walk AS (
  SELECT id, 0 AS distance FROM nodes WHERE file = '{SEED}'
  UNION SELECT source, distance + 1 FROM walk JOIN calls ON target = walk.id WHERE distance < 3
) SELECT n.id AS qualified_name, n.file AS file_rel_path, n.name, n.kind, CAST(min(distance) AS INTEGER) AS distance FROM walk JOIN nodes n ON n.id = walk.id WHERE n.file <> '{SEED}' GROUP BY ALL""")
def upstream_by_symbol(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traverse.upstream_symbols(tg.staged_star(spark, sf_dir), [SEED], 3).select(*COLS)


def _full_sql() -> str:
    parts, body = [], RECURSIVE
    for k, seed in enumerate(SEEDS):
        up, down = _up(seed, 2), _down(seed, 2)
        for d in (1, 2):
            up = up.replace(f"u{d} ", f"u{k}_{d} ").replace(f"u{d})", f"u{k}_{d})")
        body += up.replace("up AS (", f"up{k} AS (") + down.replace("walk", f"walk{k}").replace("down AS", f"down{k} AS")
        parts += [f"SELECT *, 'upstream' AS direction, {k} AS s FROM up{k}", f"SELECT *, 'downstream', {k} FROM down{k}"]
    return body + ", every AS (" + " UNION ALL ".join(parts) + """)
SELECT id AS qualified_name, file AS file_rel_path, name, kind, CAST(distance AS INTEGER) AS distance, direction, 0.0::DOUBLE AS pagerank_score FROM every
QUALIFY row_number() OVER (PARTITION BY direction, id ORDER BY distance, s) = 1"""


@query(_full_sql())
def full_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traverse.full_impact(tg.staged_star(spark, sf_dir), SEEDS, 2).select(*COLS, "direction", "pagerank_score")


@query(_full_sql().replace("SELECT id AS qualified_name", ", r AS (SELECT id AS qualified_name", 1) + ") SELECT direction, qualified_name, '- [Hop ' || distance || '] `' || file_rel_path || '` → `' || qualified_name || '` (' || kind || ')' || chr(10) || '  Lines 1–9' AS line FROM r")
def markdown_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    impact = traverse.full_impact(tg.staged_star(spark, sf_dir), SEEDS, 2)
    return context.lines(impact).select("direction", "qualified_name", "line")


@query(RECURSIVE + """, walk AS (
  SELECT q AS id, 0 AS distance FROM s WHERE file = 'supply/n3.rs'
  UNION SELECT source, distance + 1 FROM walk JOIN calls ON target = walk.id WHERE distance < 5
) SELECT DISTINCT n.name, n.file AS file_rel_path, n.kind FROM walk JOIN nodes n ON n.id = walk.id WHERE distance > 0""")
def impacted_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traverse.impacted_symbols(tg.staged_star(spark, sf_dir), "supply/n3.rs")


@query(STAR + " SELECT kind, count(*) AS n FROM (SELECT kind FROM nodes UNION ALL SELECT DISTINCT 'External' || left(c_mktsegment, 0) FROM customer WHERE false UNION ALL SELECT 'External' FROM (SELECT DISTINCT c_mktsegment FROM customer)) GROUP BY kind")
def kind_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.kind_counts(tg.staged_star(spark, sf_dir).nodes)


@query(STAR + """ SELECT (SELECT count(*) FROM nodes) + (SELECT count(DISTINCT c_mktsegment) FROM customer) AS node_count,
 (SELECT count(*) FROM s) + (SELECT count(*) FROM calls) + (SELECT count(*) FROM customer) AS edge_count""")
def stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.stats(tg.staged_star(spark, sf_dir))


@query("SELECT DISTINCT c_mktsegment AS node_id, c_mktsegment AS name, '' AS file_rel_path, 0 AS line_start, true AS external FROM customer")
def external_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tg.staged_star(spark, sf_dir).nodes.where("kind = 'External'").select("node_id", "name", "file_rel_path", "line_start", "external")


@query("SELECT 'cat/' || p_brand || '.ts::P' || p_partkey || '.' || p_name AS node_id FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 49 AND l_orderkey IN (SELECT o_orderkey FROM orders))")
def zero_callers_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = tg.star_graph(spark, sf_dir, least_quantity=49)
    return graph.uncalled(g).where("file_rel_path LIKE 'cat/%'").select("node_id")


@query("SELECT 'crm/n' || c_nationkey || '.py::C' || c_custkey AS node_id, 'Class' AS kind FROM customer WHERE c_mktsegment = 'BUILDING'")
def subclasses_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.subclasses(tg.staged_star(spark, sf_dir), "BUILDING").select("node_id", "kind")


@query(STAR + f" SELECT 'CALLS' AS kind, source, target FROM calls WHERE source IN (SELECT id FROM nodes WHERE file = '{SEED}') UNION ALL SELECT 'CONTAINS', file, q FROM s WHERE file = '{SEED}'")
def edge_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.file_subgraph(tg.staged_star(spark, sf_dir), SEED).edges


@query(STAR + f""", gone AS (SELECT id FROM nodes WHERE file = '{SEED}') SELECT kind, count(*) AS n FROM (
  SELECT 'CALLS' AS kind FROM calls WHERE source NOT IN (SELECT id FROM gone) AND target NOT IN (SELECT id FROM gone)
  UNION ALL SELECT 'CONTAINS' FROM s WHERE file <> '{SEED}' UNION ALL SELECT 'INHERITS' FROM customer) GROUP BY kind""")
def purge_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = spark.createDataFrame([(SEED,)], "file_rel_path string")
    return graph.kind_counts(graph.without_files(tg.staged_star(spark, sf_dir), paths).edges)


# ---------------------------------------------------------------- files and changes

FILES = """
WITH f AS (
  SELECT CASE WHEN source = 'src3' THEN 'node_modules' ELSE source END || '/d' || doc_id || CASE lang WHEN 'en' THEN '.py' WHEN 'de' THEN '.h' WHEN 'fr' THEN '.TS' ELSE '.txt' END AS path, text, doc_id, lang, source FROM documents
), k AS (
  SELECT *, CASE lang WHEN 'en' THEN 'python' WHEN 'fr' THEN 'typescript' WHEN 'de' THEN CASE WHEN regexp_matches(left(text, 4096), 'class |namespace |template<|template <|public:|private:|protected:|::') THEN 'cpp' ELSE 'c' END END AS language
  FROM f WHERE lang IN ('en', 'de', 'fr') AND source <> 'src3' AND strlen(text) <= 1000000
)"""


@query(FILES + " SELECT path, language FROM k")
def scan_language_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.selected(tg.document_files(spark, sf_dir), rel="path").select("path", "language")


@query(FILES + " SELECT path, md5(text) AS file_hash, CAST(length(text) - length(replace(text, chr(10), '')) + 1 AS BIGINT) AS lines FROM k")
def file_hash_linecount(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = tree.selected(tg.document_files(spark, sf_dir), rel="path")
    return files.select("path", "file_hash", fn.line_count(F.col("content").cast("string")).cast("long").alias("lines"))


@query(FILES + " SELECT 'File' AS kind, string_split(path, '/')[-1] AS name, path AS qualified_name, CAST(length(text) - length(replace(text, chr(10), '')) + 1 AS INTEGER) AS line_end, language, md5(text) AS file_hash FROM k")
def extract_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files, parsed; being prose, they hold no other symbols."""
    files = tree.selected(tg.document_files(spark, sf_dir).withColumn("rel_path", F.col("path")))
    nodes = parse.exploded(parse.parse_files(files))[0]
    return nodes.select("kind", "name", "qualified_name", "line_end", "language", "file_hash")


def _cached(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    files = tree.selected(tg.document_files(spark, sf_dir), rel="path")
    number = F.regexp_extract("path", "d([0-9]+)", 1).cast("long")
    known = files.where(number % 3 != 0).select(F.lit("File").alias("kind"), F.col("path").alias("file_rel_path"), F.when(number % 3 == 1, F.col("file_hash")).otherwise(F.lit("")).alias("file_hash"))
    return tree.cache_split(files, known, "path")


@query(FILES + " SELECT path FROM k WHERE doc_id % 3 = 1")
def cache_hit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cached(spark, sf_dir)[0].select("path")


@query(FILES + " SELECT path FROM k WHERE doc_id % 3 <> 1")
def cache_miss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cached(spark, sf_dir)[1].select("path")


DELTA = """
WITH d AS (SELECT doc_id % 7 AS k, source || '/d' || doc_id || CASE lang WHEN 'es' THEN '.md' ELSE '.py' END AS p, lang <> 'es' AS a, 'new/d' || doc_id || CASE WHEN doc_id % 3 = 0 THEN '.md' ELSE '.go' END AS n, doc_id % 3 <> 0 AS b FROM documents),
delta AS (
  SELECT CASE k WHEN 0 THEN 'A' WHEN 1 THEN 'M' WHEN 2 THEN 'D' END AS status, NULL::VARCHAR AS old_path, p AS path FROM d WHERE k <= 2 AND a
  UNION ALL SELECT CASE WHEN a AND b THEN 'R' WHEN a THEN 'D' ELSE 'A' END, CASE WHEN a AND b THEN p END, CASE WHEN b THEN n ELSE p END FROM d WHERE k = 3 AND (a OR b)
)"""


@query(DELTA + " SELECT status, coalesce(old_path, '') AS old_path, path FROM delta")
def delta_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.decode(tg.document_changes(spark, sf_dir)).select("status", F.coalesce("old_path", F.lit("")).alias("old_path"), "path")


@query(DELTA + """ SELECT 'process' AS todo, path FROM delta WHERE status IN ('A', 'M', 'R')
 UNION SELECT 'purge', CASE WHEN status = 'R' THEN old_path ELSE path END FROM delta WHERE status IN ('M', 'D', 'R')""")
def delta_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    delta = changes.decode(tg.document_changes(spark, sf_dir))
    return changes.to_process(delta).select(F.lit("process").alias("todo"), "path").unionByName(changes.to_purge(delta).select(F.lit("purge").alias("todo"), "path"))


@query("SELECT page_id, url AS source, unnest(list_distinct(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1))) AS target FROM pages")
def page_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    hrefs = F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1))
    return tg.table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("source"), F.explode(F.array_distinct(hrefs)).alias("target"))


@query(STAR + " SELECT id AS qualified_name, file AS file, CASE WHEN contains(id, '::') THEN string_split(string_split(id, '::')[-1], '.')[-1] ELSE string_split(id, '/')[-1] END AS short, CASE kind WHEN 'Class' THEN 0 WHEN 'Interface' THEN 1 WHEN 'Function' THEN 2 WHEN 'Test' THEN 3 WHEN 'File' THEN 4 ELSE 99 END AS priority FROM nodes")
def short_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = tg.staged_star(spark, sf_dir).real_nodes()
    return nodes.select("qualified_name", fn.file_of("qualified_name").alias("file"), fn.short_name("qualified_name").alias("short"), fn.kind_priority("kind").alias("priority"))


# ---------------------------------------------------------------- call resolution

CALLS = STAR + """, site AS (
  SELECT DISTINCT o.q AS caller, o.file, CASE l_linenumber % 5 WHEN 0 THEN p.q WHEN 1 THEN 'obj.' || p.name WHEN 2 THEN p.name WHEN 3 THEN 'S' || l_suppkey ELSE 'cat.' || p.name END AS raw
  FROM lineitem JOIN s o ON o.t = 'o' AND o.key = l_orderkey JOIN s p ON p.t = 'p' AND p.key = l_partkey
), def AS (SELECT id, CASE WHEN contains(id, '::') THEN string_split(string_split(id, '::')[-1], '.')[-1] ELSE string_split(id, '/')[-1] END AS short, file FROM nodes),
imp AS (
  SELECT DISTINCT f.file, p_name AS local FROM s f, part WHERE f.t = 'o' AND CAST(f.file[7:10] AS INTEGER) % 2 = 0 AND p_brand = 'Brand#1'
), cut AS (SELECT *, CASE WHEN contains(raw, '.') AND NOT contains(raw, '::') THEN string_split(raw, '.')[2] END AS method FROM site),
hit AS (
  SELECT caller, cut.file, raw, 1 AS rule, id FROM cut JOIN def ON id = raw
  UNION ALL SELECT caller, cut.file, raw, 4, id FROM cut JOIN def ON short = method AND id <> caller QUALIFY row_number() OVER (PARTITION BY caller, cut.file, raw ORDER BY id) <= 3
  UNION ALL SELECT caller, cut.file, raw, 5, id FROM cut JOIN imp ON imp.file = cut.file AND local = raw JOIN def ON short = raw AND starts_with(id, 'cat/Brand#1') WHERE NOT contains(raw, '.')
  UNION ALL SELECT caller, cut.file, raw, 6, id FROM cut JOIN def ON short = raw AND def.file = cut.file WHERE NOT contains(raw, '.')
  UNION ALL SELECT caller, file, raw, CASE WHEN n = 1 THEN 7 ELSE 8 END, id FROM (
    SELECT caller, cut.file, raw, id, count(*) OVER (PARTITION BY caller, cut.file, raw) AS n, row_number() OVER (PARTITION BY caller, cut.file, raw ORDER BY id) AS r FROM cut JOIN def ON short = raw WHERE NOT contains(raw, '.')) WHERE r <= 5
), best AS (SELECT * FROM hit QUALIFY rule = min(rule) OVER (PARTITION BY caller, file, raw))"""
PICK = " SELECT caller AS caller_qname, raw, rule, id AS target FROM best"


def _calls(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return tg.star_calls(spark, sf_dir), tg.star_graph(spark, sf_dir).nodes, tg.star_imports(spark, sf_dir)


def _resolved(spark: SparkSession, sf_dir: str, *rules: int) -> DataFrame:
    return resolve.resolve(*_calls(spark, sf_dir), rules or resolve.RULES).select("caller_qname", "raw", "rule", "target")


@query(CALLS + PICK)
def resolve_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resolved(spark, sf_dir)


def _rule(name: str, *rules: int) -> None:
    def one(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _resolved(spark, sf_dir, *rules)

    one.__name__ = name
    query(f"{CALLS}{PICK} WHERE rule IN ({', '.join(map(str, rules))})")(one)


_rule("resolve_exact", resolve.EXACT)
_rule("resolve_fuzzy_cap3", resolve.FUZZY)
_rule("resolve_import", resolve.IMPORT_SCOPE, resolve.IMPORT_DOT, resolve.IMPORTED)
_rule("resolve_single", resolve.SINGLE)
_rule("resolve_ambiguous_cap5", resolve.AMBIGUOUS)


@query(CALLS + " SELECT DISTINCT 'CALLS' AS kind, caller AS source, id AS target FROM best")
def call_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.call_edges(*_calls(spark, sf_dir))


# ---------------------------------------------------------------- parsers, on samples in every language, one of each for every supplier


def _numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tg.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("n"))


def _parsed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    return parse.exploded(parse.parse_files(tree.selected(samples.sample_files(spark, _numbers(spark, sf_dir)))))


def _samples_sql(which: str, names: str) -> str:
    """The expected rows for every supplier, {N} replaced in all text columns."""
    cells = ", ".join(c if c.startswith("line") else f"replace({c}, '{{N}}', s_suppkey::VARCHAR) AS {c}" for c in names.split(", "))
    return f"SELECT {cells} FROM supplier, (VALUES {samples.values(which)}) t ({names})"


@query(_samples_sql("symbols", "language, kind, name, qualified_name, line_start, line_end"))
def parse_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parsed(spark, sf_dir)[0].select("language", "kind", "name", "qualified_name", "line_start", "line_end")


@query(_samples_sql("edges", "kind, source, target"))
def parse_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parsed(spark, sf_dir)[1].select("kind", "source", "target")


@query(_samples_sql("calls", "caller_qname, raw_callee, line, file_rel_path"))
def parse_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parsed(spark, sf_dir)[2].select("caller_qname", "raw_callee", "line", "file_rel_path")


@query(_samples_sql("imports", "file_rel_path, local_name, module"))
def parse_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parsed(spark, sf_dir)[3].select("file_rel_path", "local_name", "module")


# ---------------------------------------------------------------- store and sync


@query(STAR + f""", gone AS (SELECT id FROM nodes WHERE file = '{SEED}')
SELECT 'node ' || kind AS what, count(*) AS n FROM nodes WHERE file <> '{SEED}' GROUP BY kind
UNION ALL SELECT 'node External', count(DISTINCT c_mktsegment) FROM customer
UNION ALL SELECT 'edge CALLS', (SELECT count(*) FROM calls WHERE source NOT IN (SELECT id FROM gone) AND target NOT IN (SELECT id FROM gone)) + (SELECT count(*) FROM customer)
UNION ALL SELECT 'edge CONTAINS', count(*) FROM s WHERE file <> '{SEED}'
UNION ALL SELECT 'edge INHERITS', count(*) FROM customer""")
def store_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The star graph put into a store, a file deleted, calls added (twice, once with an empty end), and read back."""
    g, kept = tg.staged_star(spark, sf_dir), store.GraphStore(spark, fresh_path(spark, "store"))
    kept.put_files(g.nodes.where("kind <> 'External'"), g.edges)
    kept.delete_files([SEED])
    more = g.nodes.where("kind = 'Class'").select(F.lit("CALLS").alias("kind"), F.col("node_id").alias("source"), F.lit("billing.charge").alias("target"))
    kept.put_calls(more.unionByName(more).unionByName(more.withColumn("target", F.lit(""))))
    count = lambda df, side: df.groupBy(F.concat(F.lit(side), "kind").alias("what")).agg(F.count(F.lit(1)).alias("n"))
    return count(kept.table("nodes"), "node ").unionByName(count(kept.table("edges"), "edge "))


@query(STAR + f" SELECT id AS node_id, kind FROM nodes WHERE file = '{SEED}'")
def store_file_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file's nodes, read from a store."""
    g, kept = tg.staged_star(spark, sf_dir), store.GraphStore(spark, fresh_path(spark, "store"))
    kept.write(nodes=g.nodes, edges=g.edges)
    return graph.file_subgraph(kept.graph(), SEED).nodes.select("node_id", "kind")


#: Trees of three modules for every nation: tax{N}.py, cart{N}.py and page{N}.py, where cart calls tax and page calls cart.
MODULES = {
    "tax": "def rate{N}():\n    return 1\n",
    "cart": "from tax{N} import rate{N}\nclass Cart{N}(Base):\n    def total{N}(self):\n        return rate{N}()\n",
    "page": "def show{N}():\n    Cart{N}().total{N}()\n",
}
#: What a change makes of tax{N}.py.
CHANGED = "def rate{N}():\n    return other{N}()\n\ndef other{N}():\n    return show{N}()\n"


def _modules(spark: SparkSession, sf_dir: str, texts: dict[str, str]) -> DataFrame:
    """(path, content) of modules for every nation."""
    few = spark.createDataFrame([(f"n{{N}}/{k}{{N}}.py", v) for k, v in texts.items()], "path string, text string")  # a few rows
    named = lambda c: F.replace(F.col(c), F.lit("{N}"), F.col("n_nationkey").cast("string"))
    return tg.table(spark, sf_dir, "nation").crossJoin(F.broadcast(few)).select(named("path").alias("path"), named("text").cast("binary").alias("content"))


SYNCED = """
WITH k AS (SELECT 'n' || n_nationkey || '/' AS d, n_nationkey::VARCHAR AS n FROM nation)
SELECT kind, source, target FROM k, LATERAL (VALUES
  ('CONTAINS', d || 'tax' || n || '.py', d || 'tax' || n || '.py::rate' || n), ('CONTAINS', d || 'tax' || n || '.py', d || 'tax' || n || '.py::other' || n),
  ('CONTAINS', d || 'cart' || n || '.py', d || 'cart' || n || '.py::Cart' || n), ('CONTAINS', d || 'cart' || n || '.py::Cart' || n, d || 'cart' || n || '.py::Cart' || n || '.total' || n),
  ('IMPORTS', d || 'cart' || n || '.py', 'tax' || n), ('INHERITS', d || 'cart' || n || '.py::Cart' || n, 'Base'),
  ('CONTAINS', d || 'view' || n || '.py', d || 'view' || n || '.py::show' || n),
  ('CALLS', d || 'cart' || n || '.py::Cart' || n || '.total' || n, d || 'tax' || n || '.py::rate' || n),
  ('CALLS', d || 'tax' || n || '.py::rate' || n, d || 'tax' || n || '.py::other' || n), ('CALLS', d || 'tax' || n || '.py::other' || n, d || 'view' || n || '.py::show' || n),
  ('CALLS', d || 'view' || n || '.py::show' || n, d || 'cart' || n || '.py::Cart' || n), ('CALLS', d || 'view' || n || '.py::show' || n, d || 'cart' || n || '.py::Cart' || n || '.total' || n)
) t (kind, source, target)"""


def _synced(spark: SparkSession, sf_dir: str) -> tuple[store.GraphStore, sync.SyncResult, sync.SyncResult]:
    """A tree built, then changed: tax modules rewritten, pages renamed to views, a missing file named."""
    root, kept = fresh_path(spark, "tree"), store.GraphStore(spark, fresh_path(spark, "store"))
    tree.write_files(_modules(spark, sf_dir, MODULES), root)
    first = sync.build(spark, root, kept)
    tree.write_files(_modules(spark, sf_dir, {"tax": CHANGED, "view": MODULES["page"]}), root)
    n = F.col("n_nationkey")
    path = lambda name: F.concat(F.lit("n"), n, F.lit(f"/{name}"), n, F.lit(".py"))
    line = F.explode(F.array(F.concat(F.lit("M\t"), path("tax")), F.concat(F.lit("R100\t"), path("page"), F.lit("\t"), path("view")), F.concat(F.lit("A\t"), path("none"))))
    delta = changes.decode(tg.table(spark, sf_dir, "nation").select(line.alias("line")))
    return kept, first, sync.apply_changes(spark, root, kept, delta)


@query(SYNCED)
def sync_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _synced(spark, sf_dir)[0].table("edges").select("kind", "source", "target")


@query("""WITH k AS (SELECT count(*) AS n FROM nation) SELECT 'build' AS step, 3 * n AS parsed, 0 AS deleted, 0 AS skipped, 0 AS missing, 7 * n AS nodes FROM k
 UNION ALL SELECT 'change', 2 * n, n, 0, n, 5 * n FROM k""")
def sync_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, a, b = _synced(spark, sf_dir)
    rows = [(k, r.files_parsed, r.files_deleted, r.files_skipped_hash, r.files_missing, r.nodes_added) for k, r in (("build", a), ("change", b))]
    return spark.createDataFrame(rows, "step string, parsed long, deleted int, skipped int, missing int, nodes long")


# ---------------------------------------------------------------- streams


def _streamed(df: DataFrame, name: str) -> DataFrame:
    """All rows of a stream over what is there now, written to the shared folder and read again."""
    spark, out = df.sparkSession, fresh_path(df.sparkSession, name)
    q = df.writeStream.format("parquet").option("path", out).option("checkpointLocation", fresh_path(spark, f"{name}-state")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(out)


def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.readStream.schema(tg.table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/event[s].parquet")


@query("""WITH w AS (SELECT time_bucket(INTERVAL 1 hour, CAST(ts AS TIMESTAMP)) AS start, event_type, count(*) AS n FROM events GROUP BY ALL)
SELECT strftime(start, '%Y-%m-%d %H:%M') AS start, event_type, n FROM w WHERE start + INTERVAL 1 hour <= (SELECT max(CAST(ts AS TIMESTAMP)) - INTERVAL 10 minute FROM events)""")
def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the hours that the watermark has closed."""
    rows = _streamed(streaming.windowed_counts(_event_stream(spark, sf_dir)), "windows")
    return rows.select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n")


@query("SELECT event_id AS source, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS target FROM events QUALIFY target IS NOT NULL")
def stream_next_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _streamed(streaming.next_event_edges(_event_stream(spark, sf_dir)), "next")


# ---------------------------------------------------------------- rules of call resolution that the star calls don't reach


@query(STAR + """ SELECT DISTINCT o.q AS caller_qname, CASE l_linenumber % 3 WHEN 0 THEN 2 WHEN 1 THEN 3 ELSE 6 END AS rule, CASE WHEN l_linenumber % 3 = 2 THEN o.q ELSE p.q END AS target
FROM lineitem JOIN s o ON o.t = 'o' AND o.key = l_orderkey JOIN s p ON p.t = 'p' AND p.key = l_partkey""")
def resolve_through_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls through a bound module with either separator, and of a name of the caller's own file."""
    g = tg.staged_star(spark, sf_dir)
    sites, imports = tg.bound_calls(spark, sf_dir)
    return resolve.resolve(sites, g.nodes, imports).select("caller_qname", "rule", "target").distinct()


@query(STAR + " SELECT id AS q, string_split(id, '::')[1] AS file, string_split(string_split(id, '::')[-1], '.')[-1] AS last, CASE kind WHEN 'Class' THEN 0 WHEN 'Interface' THEN 1 WHEN 'Function' THEN 2 ELSE 4 END AS rank FROM nodes")
def sql_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The functions by their SQL names."""
    fn.register(spark)
    view = "codeweft_nodes"
    tg.staged_star(spark, sf_dir).real_nodes().createOrReplaceTempView(view)
    return spark.sql(f"SELECT qualified_name AS q, file_of(qualified_name) AS file, last_segment(qualified_name) AS last, kind_priority(kind) AS rank FROM {view}")


# ---------------------------------------------------------------- algorithms

NATIONS = """
WITH RECURSIVE e AS (
  SELECT 'N' || s_nationkey AS source, 'N' || c_nationkey AS target FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
  GROUP BY s_nationkey, c_nationkey HAVING count(*) >= 0.0017 * (SELECT count(*) FROM lineitem)
), n AS (SELECT 'N' || n_nationkey AS id FROM nation), o AS (SELECT source, count(*) AS out FROM e GROUP BY source)"""


#: The star graph's nodes and edges, as NATIONS names them.
STAR_EDGES = STAR + """, n AS (SELECT id FROM nodes UNION SELECT c_mktsegment FROM customer), e AS (
  SELECT source, target FROM calls UNION SELECT file, q FROM s UNION SELECT q, c_mktsegment FROM s JOIN customer ON t = 'c' AND key = c_custkey
), o AS (SELECT source, count(*) AS out FROM e GROUP BY source)"""


def _rank_sql(base: str = STAR_EDGES, rounds: int = 20) -> str:
    body = base + ", r0 AS (SELECT id, 1.0::DOUBLE / (SELECT count(*) FROM n) AS score FROM n)"
    for k in range(rounds):
        body += f""", r{k + 1} AS MATERIALIZED (SELECT n.id, 0.15 / (SELECT count(*) FROM n) + 0.85 * (coalesce(g.gain, 0) + (SELECT coalesce(sum(score), 0) FROM r{k} WHERE id NOT IN (SELECT source FROM e)) / (SELECT count(*) FROM n)) AS score
 FROM n LEFT JOIN (SELECT e.target, sum(r.score / o.out) AS gain FROM e JOIN r{k} r ON r.id = e.source JOIN o ON o.source = e.source GROUP BY e.target) g ON g.target = n.id)"""
    return body + f" SELECT id AS node_id, round(score * (SELECT count(*) FROM n), 6) AS score FROM r{rounds}"


def _ranked(g: graph.CodeGraph) -> DataFrame:
    """Scores as multiples of the mean."""
    n = g.nodes.select("node_id").distinct().count()
    return algorithms.pagerank(g).select("node_id", F.round(F.col("score") * n, 6).alias("score"))


@query(_rank_sql())
def pagerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(tg.staged_star(spark, sf_dir))


@query(_rank_sql(NATIONS))
def pagerank_cyclic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(tg.nation_graph(spark, sf_dir).staged())


@query(STAR_EDGES + """ SELECT id AS node_id, coalesce(i.n, 0) AS n_in, coalesce(x.n, 0) AS n_out FROM n
 LEFT JOIN (SELECT target, count(*) AS n FROM e GROUP BY target) i ON i.target = id LEFT JOIN (SELECT source, count(*) AS n FROM e GROUP BY source) x ON x.source = id""")
def degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return algorithms.degrees(tg.staged_star(spark, sf_dir))


@query()
def louvain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return algorithms.louvain(tg.staged_star(spark, sf_dir))


@query(_full_sql().replace("0.0::DOUBLE AS pagerank_score", "coalesce((SELECT count(*) FROM calls WHERE target = id), 0) / 1000.0 AS pagerank_score"))
def impact_with_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Impact with a score for each symbol: here a thousandth of its calls."""
    g = tg.staged_star(spark, sf_dir)
    ranks = g.of_kind("CALLS").groupBy(F.col("target").alias("node_id")).agg((F.count(F.lit(1)) / 1000.0).alias("score"))
    return traverse.full_impact(g, SEEDS, 2, ranks).select(*COLS, "direction", "pagerank_score")


def _report_sql() -> str:
    """The whole report of one seed, one hop up and down, with ranks."""
    up, down = _up(SEED, 1), _down(SEED, 1)
    order = "distance, CASE kind WHEN 'Class' THEN 0 WHEN 'Interface' THEN 1 WHEN 'Function' THEN 2 ELSE 4 END, id"
    entry = "'- [Hop ' || distance || '] `' || file || '` → `' || id || '` (' || kind || ')' || CASE WHEN k > 0 THEN ' · PageRank=' || printf('%.3f', k / 1000.0) ELSE '' END || chr(10) || '  Lines 1–9'"
    part = lambda name: f"(SELECT string_agg({entry}, chr(10) ORDER BY {order}) || chr(10) FROM (SELECT *, (SELECT count(*) FROM calls WHERE target = id) AS k FROM {name}))"
    return RECURSIVE + up + down + f""" SELECT '### Structural Context for `{SEED}`' || chr(10) || chr(10) || '**Changed Files:** `{SEED}`' || chr(10) || '**Traversal depth:** 1 hops' || chr(10) || chr(10)
 || '**Upstream Impact (Callers)** — ' || (SELECT count(*) FROM up) || ' component(s) call into the changed files:' || chr(10) || chr(10) || {part("up")} || chr(10)
 || '**Downstream Dependencies** — ' || (SELECT count(*) FROM down) || ' component(s) used by the changed files:' || chr(10) || chr(10) || {part("down")} AS report"""


@query(_report_sql())
def markdown_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of a file as one text."""
    g = tg.staged_star(spark, sf_dir)
    ranks = g.of_kind("CALLS").groupBy(F.col("target").alias("node_id")).agg((F.count(F.lit(1)) / 1000.0).alias("score"))
    return context.reported(traverse.full_impact(g, [SEED], 1, ranks), [SEED], 1)


# ---------------------------------------------------------------- Cypher


def _cypher(name: str, text: str, sql: str | None, /, **params: object) -> None:
    def one(spark: SparkSession, sf_dir: str) -> DataFrame:
        return cypher.run(tg.staged_star(spark, sf_dir), text, params)

    one.__name__ = f"cypher_{name}"
    one.__doc__ = text
    query(sql)(one)


_cypher("match_filter", "MATCH (n) WHERE n.kind = 'Function' RETURN n.name AS name, n.file_rel_path", STAR + """ SELECT name, file AS "n.file_rel_path" FROM nodes WHERE kind = 'Function'""")
_cypher("match_distinct", "MATCH (n:Function) WHERE n.kind <> 'File' OR n.name = 'x' RETURN DISTINCT n.file_rel_path AS file", STAR + " SELECT DISTINCT file FROM nodes WHERE kind = 'Function'")
_cypher("edge_match", "MATCH (a)-[:CALLS]->(b:Interface) RETURN a.name AS caller, b.name AS callee", STAR + " SELECT a.name AS caller, b.name AS callee FROM calls JOIN nodes a ON a.id = source JOIN nodes b ON b.id = target WHERE b.kind = 'Interface'")
_cypher("two_match_join", "MATCH (f {file_rel_path: $path})-[:CONTAINS]->(s) MATCH (c)-[:CALLS]->(s) RETURN DISTINCT c.qualified_name AS caller, s.name AS called", STAR + f" SELECT DISTINCT source AS caller, s.name AS called FROM s JOIN calls ON target = q WHERE file = '{SEED}'", path=SEED)
_cypher("count", "MATCH (n) WHERE n.kind = 'Class' OR n.kind = 'Interface' RETURN count(n) AS c", STAR + " SELECT count(*) AS c FROM nodes WHERE kind IN ('Class', 'Interface')")
_cypher("group_count", "MATCH (a)-[r:CALLS]->(b) RETURN b.kind AS kind, type(r) AS relation, count(*) AS n, count(DISTINCT a) AS callers, min(b.name) AS first", STAR + " SELECT b.kind, 'CALLS' AS relation, count(*) AS n, count(DISTINCT source) AS callers, min(b.name) AS first FROM calls JOIN nodes b ON b.id = target GROUP BY b.kind")
_cypher("walk", "MATCH (c:Class {name: 'C7'})-[:CALLS*1..3]->(x) RETURN DISTINCT x.qualified_name AS id, x.kind AS kind", RECURSIVE + """, walk AS (SELECT q AS id, 0 AS d FROM s WHERE name = 'C7' UNION SELECT target, d + 1 FROM walk JOIN calls ON source = walk.id WHERE d < 3)
 SELECT DISTINCT n.id, n.kind FROM walk JOIN nodes n ON n.id = walk.id WHERE d > 0""")
_cypher("walk_back", "MATCH (x)<-[:CALLS*2..2]-(c:Class) WHERE x.name = $name RETURN DISTINCT c.name AS name", STAR + " SELECT DISTINCT c.name FROM calls k JOIN calls l ON l.target = k.source JOIN nodes c ON c.id = l.source JOIN nodes x ON x.id = k.target WHERE x.name = 'red plate' AND c.kind = 'Class'", name="red plate")
_cypher("dead_code", "MATCH (n:Function) WHERE n.file_rel_path STARTS WITH 'sales/' AND NOT (n)-[:CALLS]->(:Function) RETURN n.name AS name", STAR + " SELECT name FROM nodes WHERE kind = 'Function' AND starts_with(file, 'sales/') AND id NOT IN (SELECT source FROM calls)")
_cypher("optional", "MATCH (p:Function {name: 'hot ring'}) OPTIONAL MATCH (o:Function)-[:CALLS]->(p) WHERE o.file_rel_path STARTS WITH 'sales/199801' RETURN p.qualified_name AS id, count(o) AS n", STAR + " SELECT p.q AS id, count(o.q) AS n FROM s p LEFT JOIN (calls JOIN s o ON o.q = source AND starts_with(o.file, 'sales/199801')) ON target = p.q WHERE p.name = 'hot ring' GROUP BY p.q")
_cypher("with_having", "MATCH (a)-[:CALLS]->(b) WITH b, count(a) AS n WHERE n >= 80 RETURN b.name AS name, n ORDER BY n DESC, name", STAR + " SELECT any_value(b.name) AS name, count(*) AS n FROM calls JOIN nodes b ON b.id = target GROUP BY b.id HAVING count(*) >= 80")
_cypher("union", "MATCH (n:Class) RETURN n.file_rel_path AS file UNION MATCH (n:Interface) RETURN n.file_rel_path AS file", STAR + " SELECT file FROM nodes WHERE kind = 'Class' UNION SELECT file FROM nodes WHERE kind = 'Interface'")
_cypher("unwind_in", "UNWIND $names AS wanted MATCH (n) WHERE n.name = wanted AND NOT n.file_rel_path IN ['cat/Brand#1.ts'] RETURN wanted, count(*) AS n", STAR + " SELECT name AS wanted, count(*) AS n FROM nodes WHERE name IN ('red plate', 'C5', 'nothing') AND file <> 'cat/Brand#1.ts' GROUP BY name", names=["red plate", "C5", "nothing"])
_cypher("case", "MATCH (n) WHERE n.name IS NOT NULL AND n.external = false RETURN CASE n.kind WHEN 'Class' THEN 'type' WHEN 'Interface' THEN 'type' ELSE toLower(n.kind) END AS sort, count(*) AS n", STAR + " SELECT CASE WHEN kind IN ('Class', 'Interface') THEN 'type' ELSE lower(kind) END AS sort, count(*) AS n FROM nodes GROUP BY 1")
_cypher("subclasses", "MATCH (child)-[:INHERITS]->(base) WHERE base.name = 'MACHINERY' RETURN child.name AS name, base.kind AS kind", "SELECT 'C' || c_custkey AS name, 'External' AS kind FROM customer WHERE c_mktsegment = 'MACHINERY'")
_cypher("exists_where", "MATCH (c:Class) WHERE EXISTS { (c)-[:CALLS]->(o) WHERE o.file_rel_path = 'sales/199801.go' } RETURN c.name AS name", STAR + " SELECT name FROM nodes WHERE kind = 'Class' AND id IN (SELECT source FROM calls JOIN nodes t ON t.id = target WHERE t.file = 'sales/199801.go')")
_cypher("walk_counts", "MATCH (c:Class {name: 'C7'})-[:CALLS*1..3]->(x) RETURN x.kind AS kind, count(*) AS n", STAR + """, a AS (SELECT target AS id FROM calls JOIN s ON q = source AND name = 'C7'), b AS (SELECT target AS id FROM a JOIN calls ON source = id), c AS (SELECT target AS id FROM b JOIN calls ON source = id)
 SELECT kind, count(*) AS n FROM (SELECT id FROM a UNION ALL SELECT id FROM b UNION ALL SELECT id FROM c) w JOIN nodes USING (id) GROUP BY kind""")
_cypher("pattern_or", "MATCH (n:Class) WHERE n.name = 'C5' OR (n)-[:CALLS]->({file_rel_path: 'sales/199801.go'}) RETURN n.name AS name", STAR + " SELECT name FROM nodes WHERE kind = 'Class' AND (name = 'C5' OR id IN (SELECT source FROM calls JOIN nodes t ON t.id = target WHERE t.file = 'sales/199801.go'))")
_cypher("arithmetic", "MATCH (n:Class) RETURN n.file_rel_path AS file, count(*) / 2 AS half, avg(DISTINCT size(n.name)) AS length", STAR + " SELECT file, count(*) // 2 AS half, avg(DISTINCT length(name)) AS length FROM nodes WHERE kind = 'Class' GROUP BY file")
