import os
import subprocess

import pytest

from codeweft import streaming
from codeweft.operators import sync
from codeweft.operators.store import GraphStore
from codeweft.plans import server
from codeweft.sources import changes, tree
from tests.graphs import shop


def write(root, name, text):
    path = os.path.join(root, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(text)


def git(root, *args):
    subprocess.run(["git", "-c", "user.email=a@b.c", "-c", "user.name=x", *args], cwd=root, check=True, capture_output=True)


@pytest.fixture
def root(tmp_path):
    r = str(tmp_path / "src")
    write(r, "tax.py", "def rate():\n    pass\n")
    write(r, "cart.py", "from tax import rate\nclass Cart:\n    def total(self):\n        rate()\n")
    write(r, "node_modules/lib.js", "function a() {}")
    write(r, "README.md", "x")
    write(r, "page.py", "def show():\n    Cart().total()\n")
    git(r, "init", "-q")
    git(r, "add", ".")
    git(r, "commit", "-qm", "a")
    return r


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_build_sync_and_rebuild_agree(spark, root, tmp_path):
    store = GraphStore(spark, f"file:{tmp_path}/g")
    first = sync.build(spark, root, store)
    assert (first.files_parsed, first.files_skipped_hash, first.errors) == (3, 0, ())
    calls = {(s, t) for k, s, t in rows(store.table("edges")) if k == "CALLS"}
    assert ("cart.py::Cart.total", "tax.py::rate") in calls
    again = sync.build(spark, root, store)
    assert (again.files_parsed, again.files_skipped_hash) == (0, 3)
    write(root, "tax.py", "def rate():\n    other()\ndef other(): pass\n")
    write(root, "new.go", "package x\nfunc F() { rate() }\n")
    git(root, "add", "new.go")
    git(root, "mv", "page.py", "app.py")
    result = sync.sync(spark, root, store)
    assert (result.files_parsed, result.files_deleted, result.base_ref) == (3, 1, "HEAD")
    other = GraphStore(spark, f"file:{tmp_path}/h")
    sync.build(spark, root, other)
    assert rows(store.table("edges")) == rows(other.table("edges"))
    assert rows(store.table("nodes").drop("file_path")) == rows(other.table("nodes").drop("file_path"))
    assert store.has_file("README.md", "x") is False and store.has_file("tax.py", "") is False
    os.remove(os.path.join(root, "new.go"))
    gone = sync.apply_changes(spark, root, store, spark.createDataFrame([("M", None, "nothing.py"), ("D", None, "new.go")], "status string, old_path string, path string"))
    assert gone.errors == ("nothing.py: not found",) and gone.files_missing == 1 and "new.go::F" not in {r.node_id for r in store.all_nodes().collect()}


def test_change_stream(spark, root, tmp_path):
    store = GraphStore(spark, f"file:{tmp_path}/g")
    write(str(tmp_path / "feed"), "1.txt", "A\ttax.py\nA\tREADME.md\n")
    q = streaming.follow(streaming.change_lines(spark, str(tmp_path / "feed")), root, store, str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert q.exception() is None and {r.node_id for r in store.all_nodes().collect()} == {"tax.py", "tax.py::rate"}


def test_event_streams(spark, tmp_path):
    events = spark.createDataFrame([(1, "2024-01-01 00:00:00", 7, "a", 1.0), (2, "2024-01-01 00:10:00", 7, "a", 2.0), (3, "2024-01-01 05:00:00", 7, "b", 3.0), (4, "2024-01-01 05:00:00", 8, "b", 3.0)], "event_id long, ts string, user_id long, event_type string, value double")
    events = events.withColumn("ts", events["ts"].cast("timestamp"))
    events.coalesce(1).write.parquet(str(tmp_path / "ev"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "ev"))

    def run(df, name):
        q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None
        return rows(spark.table(name))

    assert run(streaming.next_event_edges(stream), "next_events") == [(1, 2), (2, 3)]
    assert [(r[1], r[2], r[3]) for r in run(streaming.windowed_counts(stream), "windows")] == [("a", 2, 3.0)]


def test_delete_put_and_clear(spark, tmp_path):
    store, g = GraphStore(spark, f"file:{tmp_path}/g"), shop(spark)
    store.put_files(g.nodes, g.edges.unionByName(spark.createDataFrame([("IMPORTS", "web/app.ts", "os"), ("CALLS", "elsewhere", "x")], "kind string, source string, target string")))
    nodes = {r.node_id: r for r in store.table("nodes").collect()}
    assert nodes["os"].kind == "External" and nodes["os"].qualified_name is None and "elsewhere" not in {r.source for r in store.table("edges").collect()}
    store.put_calls(spark.createDataFrame([("CALLS", "web/app.ts::refresh", "lib/tax.py::rate")] * 2 + [("CALLS", "", "x")], "kind string, source string, target string"))
    assert sum(r.kind == "CALLS" for r in store.table("edges").collect()) == 8
    store.delete_files(["lib/tax.py"])
    assert "lib/tax.py::rate" not in {r.target for r in store.table("edges").collect()} and store.all_nodes().count() == 7
    with store:
        store.clear()
    assert store.all_nodes().count() == 0 and store.table("edges").count() == 0
    assert not [n for n in os.listdir(tmp_path / "g") if n.startswith("v0000000") and n < "v00000004"]


def test_a_change_writes_only_its_buckets(spark, root, tmp_path):
    for k in range(30):
        write(root, f"more/m{k}.py", f"def f{k}():\n    f{k + 1}()\n")
    store, seen = GraphStore(spark, f"file:{tmp_path}/g", 64), []
    sync.build(spark, root, store, progress=lambda *x: seen.append(x))
    assert [s for s, *_ in seen] == ["discovering", "checking_cache", "extracting", "extracting", "resolving_calls", "resolving_calls"] and seen[0] == ("discovering", 33, 33)
    before = store._current()[2]
    write(root, "more/m7.py", "def f7():\n    f9()\n    rate()\n")
    result = sync.sync(spark, root, store)
    assert result.files_parsed == 0  # not added to git yet
    git(root, "add", ".")
    result = sync.sync(spark, root, store)
    after = store._current()[2]
    assert (result.files_parsed, result.files_skipped_hash) == (1, 29) and result.calls > 0
    write(root, "more/m9.py", "def f9():\n    pass\n")
    before = store._current()[2]
    changed = spark.createDataFrame([("M", None, "more/m9.py"), ("A", None, "no.py"), ("A", None, "big.py")], "status string, old_path string, path string")
    write(root, "big.py", "x = 1\n" * 200_000)
    result = sync.apply_changes(spark, root, store, changed)
    after = store._current()[2]
    assert (result.files_parsed, result.files_missing, result.files_too_large, result.errors) == (1, 1, 1, ("no.py: not found",))
    assert {tuple(r) for r in result.problems.collect()} == {("no.py", "not found"), ("big.py", "too large")}
    touched = {n: sum(after[n].get(b) != f for b, f in before[n].items()) for n in before}
    assert all(0 <= touched[n] <= 4 for n in touched) and touched["nodes"] == 1
    other = GraphStore(spark, f"file:{tmp_path}/h")
    sync.build(spark, root, other)
    assert rows(store.table("edges")) == rows(other.table("edges"))


def test_the_last_definition_of_a_name_counts(spark, tmp_path):
    write(str(tmp_path / "s"), "a.py", "def f():\n    pass\n\ndef f():\n    g()\n")
    store = GraphStore(spark, f"file:{tmp_path}/g")
    sync.build(spark, str(tmp_path / "s"), store)
    assert [(r.line_start, r.line_end) for r in store.all_nodes().where("name = 'f'").collect()] == [(4, 5)]


def test_not_a_repository(spark, tmp_path):
    with pytest.raises(changes.NotARepository):
        changes.diff_lines(str(tmp_path))


def test_decode(spark):
    lines = ["A\tsrc/new.py", "M\tsrc/auth.py", "D\tsrc/old.py", "R100\told/name.py\tnew/name.py", "R100\tsrc/code.py\tdocs/README.md", "R050\tdocs/notes.md\tsrc/new_module.py", "C100\ta.py\tb.py", "", "A", "R100\tx.py", "M\tREADME.md", "A\tnode_modules/a.js", "X\ta.py"]
    got = changes.decode(spark.createDataFrame([(x,) for x in lines], "line string"))
    assert sorted(map(tuple, got.collect()), key=str) == sorted([("A", None, "src/new.py"), ("M", None, "src/auth.py"), ("D", None, "src/old.py"), ("R", "old/name.py", "new/name.py"), ("D", None, "src/code.py"), ("A", None, "src/new_module.py")], key=str)


def test_scan(spark, tmp_path):
    r = str(tmp_path)
    for name, text in {"a.h": "class Foo { public: };", "b.h": "typedef struct {} x;", "big.py": "x" * 1_000_001, "ok.py": "x" * 1_000_000, "C.TS": "", "build/x.py": "1", "noext": "1"}.items():
        write(r, name, text)
    got = {(x.rel_path, x.language) for x in tree.selected(tree.read_tree(spark, r)).collect()}
    assert got == {("a.h", "cpp"), ("b.h", "c"), ("ok.py", "python"), ("C.TS", "typescript")}


def test_query_tool(spark, tmp_path):
    g = shop(spark)
    ok = server.query_graph(g, "MATCH (n) WHERE n.kind = 'Function' RETURN n.name")
    assert ok["count"] == len(ok["rows"]) == 6 and {"n.name": "show"} in ok["rows"] and ok["summary"] == "Query returned 6 row(s)."
    some = server.query_graph(g, "MATCH (n) WHERE n.kind = 'Function' RETURN n.name", most_rows=2)
    assert (some["count"], len(some["rows"]), some["truncated"]) == (6, 2, True)
    none = server.query_graph(g, "MATCH (n {name: 'nothing'}) RETURN n.name")
    assert none["count"] == 0 and "error" not in none
    for bad in ("", "  ", "MATCH (n)", "create (n) return n", "MATCH (n) SET n.x = 1 RETURN n", "MATCH (n) DETACH DELETE n", "MATCH (n) RETURN m.x", "MATCH (n RETURN n"):
        assert "error" in server.query_graph(g, bad)
    assert "error" in server.query_root(spark, "MATCH (n) RETURN n.name", str(tmp_path / "none"))
    assert "empty" in server.query_root(spark, "MATCH (n) RETURN n.name", str(tmp_path))["error"]
