import pytest

from symgraph import pipeline
from symgraph.extract.cpp import parse
from symgraph.operators.ingest import GraphStore

HEADER = """#pragma once
namespace a { namespace b {
class Base { public: Base(); virtual ~Base() = default; virtual int run(const std::string& s, int n = 3) const = 0; static void stat(); };
template <typename T> class Box : public Base { T t; };
}}
"""
SOURCE = """#include "base.h"
using namespace a::b;
namespace a { namespace b {
struct Derived final : public Base, private other::Mixin {
  explicit Derived(int x) : Base(), v(x), w{1} { init(x); }
  int run(const std::string& s, int n) const override { helper(s); Base::stat(); this->go(); return v; }
  void go() { auto f = [this](int q) { helper(q); }; f(1); Base* p = new Base(); p->run("x", 2); Derived d(3); d.go(); }
  bool operator==(const Derived& o) const { return v == o.v; }
  void init(int x); void init(int x, int y);
  int v; std::unique_ptr<Base> base_;
};
static int helper(const std::string& s) { return s.size(); }
}}
void a::b::Derived::init(int x) { stat(); base_->run("y", 1); }
int main(int argc, char** argv) { Derived d(1); d.run("a", 1); return 0; }
"""


def names(found, **wanted):
    return [n["fqn"] for n in found.nodes if all(n[k] == v for k, v in wanted.items())]


def test_declarations_and_qualifiers():
    found = parse(HEADER, "base.h")
    assert names(found, label="Class") == ["a::b::Base", "a::b::Box"] and names(found, is_abstract=True) == ["a::b::Base"]
    assert [(n["fqn"], n["signature"], n["kind"], n["is_virtual"], n["is_pure_virtual"], n["is_static"], n["is_const"]) for n in found.nodes if n["label"] == "Function"] == [
        ("a::b::Base::Base", "", "constructor", False, False, False, False), ("a::b::Base::~Base", "", "function", True, False, False, False),
        ("a::b::Base::run", "const std::string &, int const", "function", True, True, False, True), ("a::b::Base::stat", "", "function", False, False, True, False),
    ]
    assert {n["namespace"] for n in found.nodes if n["label"] == "Class"} == {"a::b"} and not found.errors and not found.diagnostics
    found = parse(SOURCE, "x.cpp")
    assert names(found, kind="lambda") == ["a::b::Derived::lambda@L7"] and next(n["usr"] for n in found.nodes if n["kind"] == "lambda") == "lambda@x.cpp:7:24"
    assert names(found, label="Function", is_static=True) == ["a::b::helper"]
    assert len({n["usr"] for n in found.nodes if n["fqn"] == "a::b::Derived::init"}) == 2  # the definition is the declaration's, the overload another


@pytest.mark.parametrize("text", ["", "class", "class A {", "int f( {", "}}}", "template <", "namespace {", "a::", "operator", "struct S : {", "R\"(", "/*", "int x = [", "class A : B<C<D>> {}; }", "void f() { [", "~", "A::~", "f(", "x(1); y(2)", "enum class E { A, B };", "\xff"])
def test_broken_sources_give_diagnostics_at_most(text):
    found = parse(text, "x.cpp")
    assert not found.errors


def test_hostile_sources_are_read_in_linear_time():
    for text in ("class A { " * 3000, "template <" * 20000, "a<" * 20000, "f(" * 20000, "/*" * 50000, "operator" * 20000, "A::" * 50000):
        parse(text, "x.cpp")


def test_index_a_cpp_tree(spark, tmp_path):
    (tmp_path / "src/inc").mkdir(parents=True)
    (tmp_path / "src/inc/base.h").write_text(HEADER)
    (tmp_path / "src/x.CPP").write_text(SOURCE)
    summary = pipeline.run(spark, str(tmp_path / "src"), str(tmp_path / "store"))
    assert (summary["files"], summary["failed"]) == (2, 0)
    graph = GraphStore(spark, str(tmp_path / "store"))
    name = {r.usr: r.fqn for r in graph.read("nodes").collect()}
    edges = {(name[r.src].removeprefix("a::b::"), r.rel, name[r.dst].removeprefix("a::b::")) for r in graph.read("edges").collect()}
    assert {
        ("Box", "INHERITS_FROM", "Base"), ("Derived", "INHERITS_FROM", "Base"), ("Base", "DEFINES", "Base::run"), ("Derived", "DEFINES", "Derived::init"), ("Derived::run", "OVERRIDES", "Base::run"),
        ("Derived::run", "CALLS", "helper"), ("Derived::run", "CALLS", "Base::stat"), ("Derived::run", "CALLS", "Derived::go"), ("Derived::lambda@L7", "CALLS", "helper"), ("Derived::go", "CALLS", "Base::Base"),
        ("Derived::go", "CALLS", "Base::run"), ("Derived::go", "CALLS", "Derived::Derived"), ("Derived::go", "CALLS", "Derived::go"), ("Derived::Derived", "CALLS", "Derived::init"), ("Derived::init", "CALLS", "Base::stat"),
        ("Derived::init", "CALLS", "Base::run"), ("main", "CALLS", "Derived::Derived"), ("main", "CALLS", "Derived::run"), ("Derived::go", "VIRTUAL_DISPATCH", "Derived::run"),
    } <= edges
    assert not any(rel == "CALLS" and src == "Derived::go" and dst == "helper" for src, rel, dst in edges)  # that call is the lambda's
