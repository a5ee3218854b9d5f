from codeweft import schema
from codeweft.operators import resolve
from tests.graphs import graph


def run(spark, calls, names, imports=()):
    g = graph(spark, [("Function", n.split(".")[-1].split("::")[-1], n, 1, 1) for n in names], [])
    sites = spark.createDataFrame([(c, raw, 1, c.split("::")[0]) for c, raw in calls], schema.CALL_SITE)
    rows = resolve.resolve(sites, g.nodes, spark.createDataFrame(list(imports), schema.IMPORT)).collect()
    out = {}
    for r in sorted(rows, key=lambda r: r.target):
        out.setdefault((r.caller_qname, r.raw), []).append((r.rule, r.target))
    return out


def test_rules_in_order(spark):
    names = ["a.py::f", "b.py::g", "b.py::C.m", "c.py::C.m", "d.py::C.m", "e.py::C.m", "mod/x.py::h", "z.py::h", "m::q", "m.r", "p.py::only"]
    calls = [("a.py::f", x) for x in ("b.py::g", "self.f", " obj.m ", "C::m", "h", "k.q", "k.r", "only", "nothing", "", "b.nothing")]
    calls += [("b.py::C.m", "x.m")]
    got = run(spark, calls, names, [("a.py", "h", "mod.x"), ("a.py", "k", "m")])
    assert got[("a.py::f", "b.py::g")] == [(resolve.EXACT, "b.py::g")]
    assert got[("a.py::f", "f")] == [(resolve.SAME_FILE, "a.py::f")]
    assert got[("a.py::f", "obj.m")] == [(resolve.FUZZY, t) for t in ("b.py::C.m", "c.py::C.m", "d.py::C.m")]
    assert got[("b.py::C.m", "x.m")] == [(resolve.FUZZY, t) for t in ("c.py::C.m", "d.py::C.m", "e.py::C.m")]
    assert [t for _, t in got[("a.py::f", "C::m")]] == ["b.py::C.m", "c.py::C.m", "d.py::C.m"]
    assert got[("a.py::f", "h")] == [(resolve.IMPORTED, "mod/x.py::h")]
    assert got[("a.py::f", "k.q")] == [(resolve.IMPORT_SCOPE, "m::q")]
    assert got[("a.py::f", "k.r")] == [(resolve.IMPORT_DOT, "m.r")]
    assert got[("a.py::f", "only")] == [(resolve.SINGLE, "p.py::only")]
    assert ("a.py::f", "nothing") not in got and ("a.py::f", "") not in got and ("a.py::f", "b.nothing") not in got


def test_ambiguous_names_are_capped(spark):
    got = run(spark, [("x.py::c", "f")], [f"m{k}.py::f" for k in range(8)])
    assert got[("x.py::c", "f")] == [(resolve.AMBIGUOUS, f"m{k}.py::f") for k in range(5)]


def test_same_file_means_the_same_path(spark):
    got = run(spark, [("a.c::x", "f")], ["a.c::f", "a.cpp::f"])
    assert got[("a.c::x", "f")] == [(resolve.SAME_FILE, "a.c::f")]
