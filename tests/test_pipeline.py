import json

import pytest

from symgraph import cli, pipeline
from symgraph.extract.java import parse
from symgraph.operators.ingest import GraphStore
from symgraph.schema import synthetic_usr
from symgraph.sources import triples
from symgraph.streaming.watch import watch

SOURCES = {
    "p/A.java": "package p; public class A { A(int a) {} static int s() { return 1; } private void k() {} public int m() { k(); return s(); } int m(int a) { return a; } int m(int a, int b) { return m(a); } }",
    "p/I.java": "package p;\ninterface I { void x(); int y(int a); }",
    "p/B.java": "package p;\nclass B extends A implements I { B() { super(1); } @Override public int m() { return super.m(2); } public void x() {} public int y(int a) { return a; } }",
    "p/Outer.java": "package p; class Outer { class Inner { void i() {} } interface Deep {} }",
    "q/C.java": "package q;\nimport p.*;\nimport p.B;\nclass C { void go() { new A(1); A.s(); helper(); this.helper(); missing(); } void helper() {} }",
    "q/L.java": "package q; class L { void go() { run(z -> { inner(() -> deep()); }); } void run(Object o) {} void inner(Object o) {} void deep() {} }",
    "q/Bad.java": "class Bad { void m( }",
    "D.java": "class D { void d() { foo(); } }",
    "notes.txt": "no source",
}


@pytest.fixture
def tree(tmp_path):
    for name, text in SOURCES.items():
        (tmp_path / "src" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "src" / name).write_text(text)
    return tmp_path


def test_synthetic_usr():
    assert synthetic_usr("p.A", "f.java", 1) == "java@02ef2304d66f2fdfef2087e7"
    assert synthetic_usr("p.A", "/src/p/A.java", 3) == "java@41aa5fdb1e4185c07c984bac"
    assert synthetic_usr("p.Base", "", 0) == "java@85cab29c1932e01c9e4139f4"


def test_one_visit_for_each_declaration():
    found = parse(SOURCES["p/Outer.java"], "Outer.java")
    assert [n["fqn"] for n in found.nodes] == ["p.Outer", "p.Outer.Inner", "p.Outer.Inner.i()", "p.Outer.Deep"]
    assert parse(SOURCES["q/Bad.java"], "x").errors and not parse(SOURCES["q/Bad.java"], "x").nodes
    assert parse("", "x").errors == [] and parse(b"\xff\xfe class", "x").errors


def test_index_a_tree_and_ask(spark, tree, capsys):
    source, store = str(tree / "src"), str(tree / "store")
    summary = pipeline.run(spark, source, store)
    assert (summary["files"], summary["parsed"], summary["failed"]) == (8, 8, 1)
    graph = GraphStore(spark, store)
    name = {r.usr: r.fqn for r in graph.read("nodes").collect()}
    edges = {(name[r.src], r.rel, name[r.dst]) for r in graph.read("edges").collect()}
    assert {
        ("p.B", "INHERITS_FROM", "p.A"), ("p.B", "IMPLEMENTS", "p.I"), ("p.B.m()", "OVERRIDES", "p.A.m()"), ("p.B.m()", "CALLS", "p.A.m(int)"),
        ("p.A.m()", "CALLS", "p.A.k()"), ("p.A.m()", "CALLS", "p.A.s()"), ("p.A.m(int, int)", "CALLS", "p.A.m(int)"), ("q.C.go()", "CALLS", "p.A.A(int)"), ("q.C.go()", "CALLS", "p.A.s()"), ("q.C.go()", "CALLS", "q.C.helper()"),
        ("p.A", "DEFINES", "p.A.m()"), ("p.Outer.Inner", "DEFINES", "p.Outer.Inner.i()"), ("q.L.go()", "CALLS", "q.L.run(Object)"), ("q.L.go()", "CALLS", "q.L.go()::lambda$0@L1"), ("q.L.go()::lambda$0@L1", "CALLS", "q.L.inner(Object)"),
        ("q.L.go()::lambda$1@L1", "CALLS", "q.L.deep()"),
    } <= edges
    assert {r.dst for r in graph.read("dangling").collect()} >= {"unresolved:this.missing", "unresolved:this.foo"}
    before = sorted(map(str, graph.read("edges").select("edge_id").collect()))
    again = pipeline.run(spark, source, store, only_changed=True)
    assert again["parsed"] == 1 and sorted(map(str, graph.read("edges").select("edge_id").collect())) == before  # the bad file is tried again
    assert cli.main(["ask", "--store", store, "stats"], spark) == 0
    assert {"label": "Class", "cnt": 9} in [json.loads(x) for x in capsys.readouterr().out.splitlines()]
    assert cli.main(["ask", "--store", store + "-none", "stats"], spark) == 1


def graph_rows(spark, store):
    graph = GraphStore(spark, str(store))
    return [sorted(map(str, graph.read(t).collect())) for t in ("nodes", "edges", "dangling", "symbols")]


def test_incremental_runs_equal_full_ones(spark, tmp_path):
    files = {
        "p/A.java": "package p; public class A { int run() { return 1; } }",
        "p/B.java": "package p; class B extends A { void b() { run(); } }",
        "p/C.java": "package p; class C { void c() { new B().b(); B.x(); } }",
        "p/D.java": "package p; class D extends B { void d() { run(); b(); } }",
    }

    def write(changes):
        for name, text in changes.items():
            path = tmp_path / "src" / name
            path.parent.mkdir(parents=True, exist_ok=True)
            if text is None:
                path.unlink()
            else:
                path.write_text(text)

    write(files)
    pipeline.run(spark, str(tmp_path / "src"), str(tmp_path / "store"))
    steps = [
        {"p/B.java": "package p;\nclass B extends A { void b() { run(); } static void x() {} }", "p/C.java": None},  # moved by a line, and another gone
        {"p/A.java": "package p; public class A { }", "q/E.java": "class Broken {", "p/C.java": files["p/C.java"]},
        {"q/E.java": "package q; class E extends p.D { void e() { super.d(); } }", "p/B.java": None},
    ]
    for k, changes in enumerate(steps):
        write(changes)
        summary = pipeline.run(spark, str(tmp_path / "src"), str(tmp_path / "store"), only_changed=True)
        assert summary["parsed"] <= 2
        pipeline.run(spark, str(tmp_path / "src"), str(tmp_path / f"full{k}"))
        assert graph_rows(spark, tmp_path / "store") == graph_rows(spark, tmp_path / f"full{k}")
    assert GraphStore(spark, str(tmp_path / "store")).read("errors").count() == 0


NODE = {"usr": "u1", "name": "f", "fqn": "f", "file": "a.cpp", "line": 1, "language": "cpp", "kind": "function", "parent_fqn": "A"}


def lines(*rows):
    return "".join((r if isinstance(r, str) else json.dumps(r)) + "\n" for r in rows)


def test_triples_merge_once_and_last_writer_wins(spark, tmp_path):
    edge = {"source_usr": "u1", "target_usr": "u2", "relationship": "CALLS", "file": "a.cpp", "line": 3}
    node = lambda **x: {"triple_type": "node", "node_label": "Function", "node_data": NODE | x}
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.jsonl").write_text(
        lines(node(), node(parent_fqn=None), node(usr="u2", name="g"), "", "{bad", {"triple_type": "edge", "edge_data": edge}, {"triple_type": "edge", "edge_data": edge}, {"triple_type": "edge", "edge_data": edge | {"target_usr": "gone"}}, node(usr="u3", line=-1), {"triple_type": "odd"})
    )
    rows, bad = triples.read(spark, str(tmp_path / "in"))
    assert rows.count() == 7 and bad.count() == 2
    store = GraphStore(spark, str(tmp_path / "store"))
    store.ingest(rows)
    first = [sorted(map(str, store.read(t).collect())) for t in ("nodes", "edges", "dangling", "quarantine")]
    store.ingest(rows)
    assert [sorted(map(str, store.read(t).collect())) for t in ("nodes", "edges")] == first[:2]
    assert {r.usr: r.parent_fqn for r in store.read("nodes").collect()} == {"u1": None, "u2": "A"}
    assert [(r.src, r.dst) for r in store.read("edges").collect()] == [("u1", "u2")]
    assert len(first[2]) == 1 and len(first[3]) == 1
    watch(spark, str(tmp_path / "in"), str(tmp_path / "live"), str(tmp_path / "check"), once=True).awaitTermination()
    assert GraphStore(spark, str(tmp_path / "live")).read("edges").count() == 1
    store.wipe()
    assert store.version() is None
