import pytest

from codeweft.plans import cypher
from tests.graphs import graph, shop


@pytest.fixture(scope="module")
def g(spark):
    return shop(spark).staged()


def ask(g, text, **params):
    df = cypher.run(g, text, params)
    return df.columns, sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize(
    "text,expected",
    [
        ("MATCH (end:Class) RETURN end.name AS type", [("Cart",)]),
        ("MATCH (a)-[r]->(b) WHERE type(r) = 'CALLS' AND b.name ENDS WITH 'up' RETURN a.name, b.name", [("Cart.total", "round_up"), ("rate", "round_up")]),
        ("MATCH (a)<-[:CALLS]-(b) RETURN b.name AS b", [("Cart.total",), ("Cart.total",), ("rate",), ("show",), ("show",), ("refresh",), ("refresh",)]),
        ("MATCH (a {name: 'rate'})-[:CALLS]-(b) RETURN b.name AS b", [("Cart.total",), ("round_up",)]),
        ("MATCH p = (a {name: 'Cart.total'})-[:CALLS*1..5]->(b) RETURN b.name AS b, length(p) AS n", [("rate", 1), ("round_up", 1), ("round_up", 2)]),
        ("MATCH (a {name: 'Cart.total'})-[:CALLS*]->(b) RETURN DISTINCT b.name AS b", [("rate",), ("round_up",)]),
        ("MATCH (a {name: 'refresh'})-[:CALLS*0..1]->(b) RETURN b.name AS b", [("refresh",), ("show",), ("Cart.add",)]),
        ("MATCH (n) WHERE NOT (n)<-[:CALLS]-() AND n.kind = 'Class' RETURN n.name AS n", [("Cart",)]),
        ("MATCH (n:Function) WHERE (n)-[:CALLS]->({name: 'rate'}) OR n.name = 'show' RETURN n.name AS n", [("Cart.total",), ("show",)]),
        ("MATCH (n:Function) WHERE NOT (n)-[:CALLS]->() OR (n)-[:CALLS]->({name: 'show'}) RETURN n.name AS n", [("round_up",), ("Cart.add",), ("refresh",)]),
        ("MATCH (n:Function) RETURN n.name AS n ORDER BY n DESC SKIP 1 LIMIT 1", [("round_up",)]),
        ("MATCH (n:File) OPTIONAL MATCH (n)-[:CONTAINS]->(m:Class) RETURN n.name AS n, m.name AS m", [("app.ts", None), ("cart.py", "Cart"), ("tax.py", None)]),
        ("MATCH (n) WITH n.kind AS kind, collect(n.name) AS names WHERE size(kind) = 4 RETURN kind, names[0] AS first", [("File", "app.ts")]),
        ("UNWIND [1, 2, 2] AS x RETURN x, count(*) AS n", [(1, 1), (2, 2)]),
        ("UNWIND [1, 1, 4] AS x RETURN avg(DISTINCT x) AS a, sum(DISTINCT x) AS s, avg(x) AS m", [(2.5, 5, 2.0)]),
        ("RETURN 1 + 2 * 3 AS x, 'a' + 'b' AS y, true XOR false AS z", [(7, "ab", True)]),
        ("RETURN 5 / 2 AS a, 5.0 / 2 AS b, -7 / 2 AS c", [(2, 2.5, -3)]),
        ("MATCH (n:Class) RETURN n.name AS x UNION ALL MATCH (n:Class) RETURN n.name AS x", [("Cart",), ("Cart",)]),
        ("MATCH (a)-[:CALLS]->(b), (b)-[:CALLS]->(c) RETURN a.name AS a, c.name AS c", [("Cart.total", "round_up"), ("show", "rate"), ("show", "round_up"), ("show", "show"), ("show", "Cart.add"), ("refresh", "Cart.total"), ("refresh", "refresh")]),
        ("MATCH (n) RETURN count(n) AS n, min(n.line_start) AS a, avg(n.line_end) AS b", [(10, 1, 29.1)]),
        ("MATCH (n) WHERE n.name =~ 'C.*t' RETURN n.name AS n", [("Cart",)]),
    ],
)
def test_queries(g, text, expected):
    assert ask(g, text)[1] == sorted(expected, key=str)


def test_unaliased_names(g):
    assert ask(g, "MATCH (n:Class) RETURN n.name, n.kind AS k")[0] == ["n.name", "k"]


def test_nulls_drop_out(spark):
    g = graph(spark, [("Function", None, "a::b", 1, 1), ("Function", "x", "a::x", 1, 1)], [])
    assert ask(g, "MATCH (n) WHERE n.name <> 'y' RETURN n.qualified_name AS q")[1] == [("a::x",)]


def test_walks_on_cycles(spark):
    g = graph(spark, [("Function", n, n, 1, 1) for n in "abc"], [("CALLS", "a", "b"), ("CALLS", "b", "a"), ("CALLS", "b", "c")])
    assert ask(g, "MATCH (x {name: 'a'})-[:CALLS*]->(y) RETURN DISTINCT y.name AS y")[1] == [("a",), ("b",), ("c",)]
    assert ask(g, "MATCH (x {name: 'a'})-[:CALLS*1..4]->(y) RETURN y.name AS y, count(*) AS n")[1] == [("a", 1), ("b", 1), ("c", 1)]


def test_every_walk_counts(spark):
    g = graph(spark, [("Function", n, n, 1, 1) for n in "abcd"], [("CALLS", "a", "b"), ("CALLS", "a", "c"), ("CALLS", "b", "c"), ("CALLS", "c", "d")])
    assert ask(g, "MATCH (x {name: 'a'})-[:CALLS*1..3]->(y) RETURN count(*) AS n")[1] == [(5,)]
    assert ask(g, "MATCH (x {name: 'a'})-[:CALLS*2..]->(y) RETURN y.name AS y")[1] == [("c",), ("d",), ("d",)]
    assert ask(g, "MATCH (x {name: 'a'})-[:CALLS*]->(y) RETURN count(DISTINCT y) AS n, max(y.name) AS last")[1] == [(3, "d")]
    assert ask(g, "MATCH (y) WHERE EXISTS { (y)-[:CALLS*2..3]->(d {name: 'd'}) } RETURN y.name AS y")[1] == [("a",), ("b",)]


@pytest.mark.parametrize("text", ["MATCH (n) DELETE n RETURN n", "MERGE (n) RETURN n", "MATCH (n) RETURN $x", "MATCH (n) RETURN n.name LIMIT -1", "MATCH (n) RETURN foo(n)", "RETURN 'unclosed", "MATCH (a)-[a]->(b) RETURN a UNION RETURN 1 AS x"])
def test_errors(g, text):
    with pytest.raises(cypher.QueryError):
        cypher.run(g, text)
