"""The pairs that the import rule makes: all of them, each once, in many tasks, and never shuffled."""

import pytest

from codeweft import schema
from codeweft.operators import resolve
from tests.graphs import graph


def made(spark):
    """30 callers of one imported name with 40 definitions; a caller in two files whose folders overlap, one that names a definition in full too."""
    names = [f"mod/d{k % 2}/x{k}.py::h" for k in range(40)] + [f"f{k}.py::c" for k in range(30)] + ["mod/d0/own.py::A.h"]
    g = graph(spark, [("Function", n.split(".")[-1].split("::")[-1], n, 1, 1) for n in names], [])
    calls = [(f"f{k}.py::c", "h", f"f{k}.py") for k in range(30)]
    calls += [("two::c", "h", "f0.py"), ("two::c", "h", "g.py"), ("two::c", "h", "k.py"), ("two::c", "h", "l.py")]  # mod, mod/d0, mod/d1 and no import
    calls += [("f1.py::c", "mod/d1/x1.py::h", "f1.py"), ("f1.py::c", "o.h", "f1.py"), ("g.py::e", "h", "g.py"), ("g.py::e", "mod/d1/x1.py::h", "g.py"), ("", "h", "f2.py")]
    sites = spark.createDataFrame([(c, raw, 1, f) for c, raw, f in calls], schema.CALL_SITE)
    bound = [(f"f{k}.py", "h", "mod") for k in range(30)] + [("g.py", "h", "mod.d0"), ("k.py", "h", "mod::d1")]
    return sites, g.nodes, spark.createDataFrame(bound, schema.IMPORT)


@pytest.mark.parametrize("share", [1, 7, 100, 4_000_000])
def test_all_pairs_whatever_the_shares(spark, monkeypatch, share):
    monkeypatch.setattr(resolve, "PAIRS_A_SHARE", share)
    monkeypatch.setattr(resolve, "PAIRS_A_TASK", 3 * share)
    args = made(spark)
    rows = [tuple(r) for r in resolve.resolve(*args).collect()]
    assert len(rows) == len(set(rows))
    got = [r for r in rows if r[3] == resolve.IMPORTED]
    d0, d1 = 21, 20
    assert len(got) == 30 * (d0 + d1) + (d0 + d1) + d0 + d1 + d0 + (d0 + d1)
    edges = [tuple(r) for r in resolve.call_edges(*args).collect()]
    assert len(edges) == len(set(edges))
    assert set(edges) == {("CALLS", r[0], r[4]) for r in rows if r[0] and r[4]}


def test_pairs_come_in_many_tasks_and_edges_are_not_shuffled(spark, monkeypatch):
    monkeypatch.setattr(resolve, "PAIRS_A_SHARE", 50)
    monkeypatch.setattr(resolve, "PAIRS_A_TASK", 100)
    args = made(spark)
    found = resolve.resolve(*args).where(f"rule = {resolve.IMPORTED}")
    assert sum(len(p) > 0 for p in found.rdd.glom().collect()) >= 6
    assert max(len(p) for p in found.rdd.glom().collect()) <= 700
    plan = resolve.call_edges(*args)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lstrip().startswith("Union")


def test_resolve_queries_make_no_edges(spark, monkeypatch):
    from codeweft import queries, testgraph

    def none(*_):
        raise AssertionError("edges aren't needed")

    monkeypatch.setattr(testgraph, "staged_star", none)
    assert "target" in queries.QUERIES["resolve_exact"](spark, "/root/testdata/sf0.001").columns


def test_only_what_the_asked_rules_need_is_made(spark, monkeypatch):
    args = made(spark)
    whole = sorted(map(tuple, resolve.resolve(*args).collect()))
    steps, staged = [], resolve.staged
    monkeypatch.setattr(resolve, "staged", lambda df, name: steps.append(name) or staged(df, name))
    for rule in (resolve.EXACT, resolve.IMPORTED):
        assert sorted(map(tuple, resolve.resolve(*args, (rule,)).collect())) == [r for r in whole if r[3] == rule]
    steps.clear()
    resolve.resolve(*args, (resolve.IMPORT_SCOPE, resolve.IMPORT_DOT, resolve.IMPORTED))
    assert "names" not in steps and "sizes" in steps


@pytest.mark.parametrize("row", [1, 7, 1_000])
def test_a_site_meets_arrays_of_definitions(spark, monkeypatch, row):
    args = made(spark)
    monkeypatch.setattr(resolve, "TARGETS_A_ROW", row)
    _, bound, imported = resolve.tried(*args)
    met = [(r.caller_qname, r.raw, r.folder, r.targets) for r in resolve.paired(bound, imported).collect()]
    want = sorted(map(tuple, bound.join(imported, ["raw", "folder"]).select("caller_qname", "raw", "folder", "target").collect()))
    assert sorted((*m[:3], t) for m in met for t in m[3]) == want
    assert len(met) < len(want)
    plan = resolve.resolve(*args)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode") < plan.index("Union")


def test_only_definitions_with_a_wanted_name_are_ranked(spark, monkeypatch):
    args, counts, staged = made(spark), {}, resolve.staged

    def counted(df, name):
        out = staged(df, name)
        counts[name] = out.count()
        return out

    monkeypatch.setattr(resolve, "staged", counted)
    resolve.resolve(*args)
    assert counts["definitions"] == 71 and counts["names"] == 1  # h, not c


def test_resolve_queries_write_no_nodes(spark, monkeypatch):
    from codeweft import queries, testgraph

    def none(*_):
        raise AssertionError("nodes needn't be written")

    monkeypatch.setattr(testgraph, "_once", none)
    assert "target" in queries.QUERIES["resolve_all"](spark, "/root/testdata/sf0.001").columns


def test_modules_meet_definitions_once_per_method(spark, monkeypatch):
    """Scope goes before dot, for every site of the module and method."""
    names = ["m::f", "m.f", "m.g", "x.py::c"]
    g = graph(spark, [("Function", "n", n, 1, 1) for n in names], [])
    calls = [(f"x.py::c{k}", f"a.{m}", 1, "x.py") for k in range(9) for m in "fgh"]
    args = spark.createDataFrame(calls, schema.CALL_SITE), g.nodes, spark.createDataFrame([("x.py", "a", "m")], schema.IMPORT)
    found, staged = {}, resolve.staged
    monkeypatch.setattr(resolve, "staged", lambda df, name: found.setdefault(name, staged(df, name)))
    rows = {(r.caller_qname, r.raw, r.rule, r.target) for r in resolve.resolve(*args, (resolve.IMPORT_SCOPE, resolve.IMPORT_DOT)).collect()}
    assert rows == {(f"x.py::c{k}", *way) for k in range(9) for way in (("a.f", 2, "m::f"), ("a.g", 3, "m.g"))}
    assert found["through"].count() == 2


def test_call_sites_are_written_between_shuffles(spark, monkeypatch):
    steps, staged = [], resolve.staged
    monkeypatch.setattr(resolve, "staged", lambda df, name: steps.append(name) or staged(df, name))
    rows = resolve.call_edges(*made(spark))
    assert [s for s in steps if s in ("prepared", "bound", "sites", "other")] == ["prepared", "bound", "sites", "other"]
    assert rows.count() == rows.distinct().count() > 0
