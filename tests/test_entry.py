import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = "/root/testdata/sf0.001"


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["upstream_files", "downstream_symbols", "resolve_all", "delta_decode", "cypher_walk", "cypher_optional", "file_hash_linecount", "parse_symbols", "parse_edges", "parse_calls", "parse_imports", "sync_edges", "store_roundtrip", "stream_windows", "stream_next_events", "markdown_report", "impact_with_ranks", "resolve_through_imports", "cypher_walk_counts", "cypher_pattern_or", "cypher_arithmetic", "pagerank_cyclic", "sql_functions"])
def test_queries_agree_with_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, SF)
    want = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(tuple, df.select(*[f"`{n}`" for n in names]).collect()), key=str) == sorted(want.fetchall(), key=str)


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_having_has_no_cap(spark):
    assert "LIMIT" not in entry.queries()["cypher_with_having"].__doc__
    test_queries_agree_with_sql(spark, "cypher_with_having")
