"""Registered queries of extraction, triples, resolution and flags, each with its DuckDB SQL.

Sources, logs and build files are made of the test tables' rows, so what should
come out of them can be written down in SQL.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symgraph import pipeline
from symgraph.extract import cpp, java
from symgraph.functions import scalars
from symgraph.operators import flags, graph, incremental, ingest, paths, symbols
from symgraph.plans.catalogue import _trails_sql, query
from symgraph.sources import files as sources
from symgraph.sources import triples
from symgraph.storage import shared_dir, stored, stored_lines


def _java_usr(fqn: str, line: str, file: str = "file") -> str:
    return f"concat('java@', substring(sha256(concat({fqn}, '::', {file}, '::', CAST({line} AS string))), 1, 24))"


def _cpp_usr(fqn: str, signature: str | None = None) -> str:
    own = fqn if signature is None else f"concat({fqn}, '(', {signature}, ')::')"
    return f"concat('cpp@', substring(sha256({own}), 1, 24))"


# Java: a class for each customer; every tenth file is broken.

_JAVA_TEXT = """concat('package ', lower(c_mktsegment), '.of;\\nimport geo.*;\\nimport util.Base;\\n',
'/** @see C */ public class C', c_custkey, ' extends Base<Map<String, Integer>> implements Tag, geo.Mark', CASE WHEN c_custkey % 10 = 0 THEN '' ELSE ' {' END, '\\n',
'  static final int[] X = { 1, 2 }; String s = "class Q { }"; // class R {\\n',
'  C', c_custkey, '(int a, final String b) { super(a); }\\n',
'  @Override public int run(java.util.List<String> xs, int... more) throws E { helper(xs); this.helper(1); new Base<String>(1, f(2, 3)); a.other.call(); return 0; }\\n',
'  private static void helper(Object o) { }\\n',
'  abstract static class Inner { abstract void i(); interface Deep { int d(); default int e() { return 1; } } }\\n',
'  void l() { submit(x -> { go(x, 1); }); }\\n}\\n')"""
_JAVA_FILES = f"SELECT concat('src/C', c_custkey, '.java') AS path, 'java' AS language, encode({_JAVA_TEXT}, 'utf-8') AS content FROM {{customer}}"

_GOOD = """WITH good AS (SELECT c_custkey AS k, concat('src/C', c_custkey, '.java') AS file, concat(lower(c_mktsegment), '.of') AS pkg, concat(lower(c_mktsegment), '.of.C', c_custkey) AS c FROM customer WHERE c_custkey % 10 <> 0),
functions AS (
  SELECT *, concat('C', k) AS name, concat(c, '.C', k, '(int, String)') AS fqn, 6 AS line, 'constructor' AS kind, 'int, String' AS signature, c AS parent, false AS virt, false AS pure, false AS stat FROM good
  UNION ALL SELECT *, 'run', concat(c, '.run(List, int)'), 7, 'function', 'List, int', c, true, false, false FROM good
  UNION ALL SELECT *, 'helper', concat(c, '.helper(Object)'), 8, 'function', 'Object', c, false, false, true FROM good
  UNION ALL SELECT *, 'i', concat(c, '.Inner.i()'), 9, 'function', '', concat(c, '.Inner'), true, true, false FROM good
  UNION ALL SELECT *, 'd', concat(c, '.Inner.Deep.d()'), 9, 'function', '', concat(c, '.Inner.Deep'), true, true, false FROM good
  UNION ALL SELECT *, 'e', concat(c, '.Inner.Deep.e()'), 9, 'function', '', concat(c, '.Inner.Deep'), true, false, false FROM good
  UNION ALL SELECT *, 'l', concat(c, '.l()'), 10, 'function', '', c, true, false, false FROM good
), lambdas AS (SELECT *, 'lambda$0' AS name, concat(c, '.l()::lambda$0@L10') AS fqn, 10 AS line, 'lambda' AS kind, '' AS signature, c AS parent, false AS virt, false AS pure, false AS stat FROM good),
classes AS (
  SELECT *, concat('C', k) AS name, c AS fqn, 4 AS line, 'class' AS kind, false AS abst, pkg AS parent FROM good
  UNION ALL SELECT *, 'Inner', concat(c, '.Inner'), 9, 'class', true, c FROM good
  UNION ALL SELECT *, 'Deep', concat(c, '.Inner.Deep'), 9, 'interface', true, concat(c, '.Inner') FROM good
) """


def _java(g) -> dict[str, DataFrame]:
    return pipeline.queued_of(java.extract(g.sql(_JAVA_FILES.replace("sha256(", "sha2("))))


_FLAGS = ("is_abstract", "is_virtual", "is_pure_virtual", "is_static")


@query(
    _GOOD + f"""SELECT {_java_usr('fqn', 'line')} AS usr, 'Function' AS label, name, fqn, CAST(NULL AS string) AS namespace, file, line, kind, signature, parent AS parent_fqn, CAST(NULL AS boolean) AS is_abstract, virt AS is_virtual, pure AS is_pure_virtual, stat AS is_static FROM (SELECT * FROM functions UNION ALL SELECT * FROM lambdas)
UNION ALL SELECT {_java_usr('fqn', 'line')}, 'Class', name, fqn, pkg, file, line, kind, NULL, NULL, abst, NULL, NULL, NULL FROM classes""",
    prelude=False,
)
def java_nodes(g):
    return _java(g)["nodes"].select("usr", "label", "name", "fqn", "namespace", "file", "line", "kind", "signature", "parent_fqn", *_FLAGS)


@query(
    _GOOD + f"""SELECT {_java_usr('fqn', 'line')} AS usr, fqn, CASE WHEN kind = 'function' THEN 'method' ELSE kind END AS kind, signature, parent AS parent_fqn FROM functions
UNION ALL SELECT {_java_usr('fqn', 'line')}, fqn, kind, NULL, parent FROM classes""",
    prelude=False,
)
def java_symbols(g):
    return _java(g)["symbols"].select("usr", "fqn", "kind", "signature", "parent_fqn")


@query(
    _GOOD + f"""SELECT {_java_usr('c.fqn', 'c.line', 'c.file')} AS source_usr, 'DEFINES' AS relationship, {_java_usr('f.fqn', 'f.line', 'f.file')} AS target_usr, f.line FROM functions f JOIN classes c ON f.parent = c.fqn
UNION ALL SELECT {_java_usr("concat(c, '.l()')", '10')}, 'CALLS', {_java_usr('fqn', 'line')}, line FROM lambdas""",
    prelude=False,
)
def java_fixed_edges(g):
    return _java(g)["fixed"].select("source_usr", "relationship", "target_usr", "line")


_QUEUE_SQL = """SELECT {f} AS caller_fqn, '{kind}' AS kind, {q} AS qualifier, '{m}' AS member, {n} AS arguments_count, {new} AS is_constructor, {line} AS line, 'geo.*,util.Base' AS imports, pkg AS package FROM good"""


def _queue_sql(fqn: str, kind: str, qualifier: str, member: str, n: int, line: int, new: str = "false") -> str:
    return _QUEUE_SQL.format(f=fqn, kind=kind, q=qualifier, m=member, n=n, new=new, line=line)


@query(
    _GOOD + " UNION ALL ".join([
        _queue_sql("c", "INHERITS_FROM", "CAST(NULL AS string)", "geo.Base", 0, 4), _queue_sql("c", "IMPLEMENTS", "NULL", "geo.Tag", 0, 4), _queue_sql("c", "IMPLEMENTS", "NULL", "geo.Mark", 0, 4),
        _queue_sql("concat(c, '.C', k, '(int, String)')", "CALLS", "'super'", "super", 1, 6), _queue_sql("concat(c, '.run(List, int)')", "OVERRIDES", "'super'", "run", 2, 7), _queue_sql("concat(c, '.run(List, int)')", "CALLS", "NULL", "helper", 1, 7),
        _queue_sql("concat(c, '.run(List, int)')", "CALLS", "'this'", "helper", 1, 7), _queue_sql("concat(c, '.run(List, int)')", "CALLS", "NULL", "Base", 2, 7, "true"), _queue_sql("concat(c, '.run(List, int)')", "CALLS", "NULL", "f", 2, 7),
        _queue_sql("concat(c, '.run(List, int)')", "CALLS", "'a.other'", "call", 0, 7), _queue_sql("concat(c, '.l()')", "CALLS", "NULL", "submit", 1, 10), _queue_sql("concat(c, '.l()::lambda$0@L10')", "CALLS", "NULL", "go", 2, 10),
    ]), prelude=False,
)
def java_queued_calls(g):
    return _java(g)["calls"].select("caller_fqn", "kind", "qualifier", "member", "arguments_count", "is_constructor", "line", F.array_join("imports", ",").alias("imports"), "package")


@query("SELECT concat('src/C', c_custkey, '.java') AS file, c_custkey % 10 = 0 AS failed, CASE WHEN c_custkey % 10 = 0 THEN 0 ELSE 11 END AS n_nodes FROM customer", prelude=False)
def java_errors(g):
    return java.extract(g.sql(_JAVA_FILES)).select("file", (F.size("errors") > 0).alias("failed"), F.size("nodes").alias("n_nodes"))


@query("SELECT 'fatal' AS severity, count(*) AS n FROM customer WHERE c_custkey % 10 = 0", prelude=False)
def extraction_diagnostics(g):
    found = java.extract(g.sql(_JAVA_FILES)).select(F.explode("diagnostics").alias("d")).select("d.*")
    return ingest.diagnostics_histogram(found)


# Java resolution: chains of five classes; the first has ``shared``, the fifth overrides it.

_CHAIN_TEXT = """concat('package p;\\nclass K', c_custkey, CASE WHEN c_custkey % 5 = 1 THEN '' ELSE concat(' extends K', c_custkey - 1) END, ' {\\n K', c_custkey, '() { }\\n static void st(int a) { }\\n',
' void own() { shared(); this.own(); super.shared(); new K', c_custkey, '(); K', c_custkey, '.st(1); missing(); }\\n', CASE WHEN c_custkey % 5 = 1 THEN ' void shared() { }\\n' WHEN c_custkey % 5 = 0 THEN ' @Override void shared() { }\\n' ELSE '' END, '}\\n')"""
_CHAIN_FILES = f"SELECT concat('src/K', c_custkey, '.java') AS path, 'java' AS language, encode({_CHAIN_TEXT}, 'utf-8') AS content FROM {{customer}} WHERE c_custkey > 0"


def _chain_usr(k: str, tail: str, line: int) -> str:
    tail = tail.replace("#", f"', {k}, '")
    return _java_usr(f"concat('p.K', {k}, '{tail}')", str(line), f"concat('src/K', {k}, '.java')")


_CHAIN_SQL = f"""WITH k AS (SELECT c_custkey AS k, (c_custkey - 1) // 5 * 5 + 1 AS r, {_chain_usr('c_custkey', '.own()', 5)} AS own FROM customer WHERE c_custkey > 0)
SELECT own AS source_usr, 'CALLS' AS relationship, CASE WHEN k % 5 = 0 THEN {_chain_usr('k', '.shared()', 6)} ELSE {_chain_usr('r', '.shared()', 6)} END AS target_usr FROM k
UNION ALL SELECT own, 'CALLS', CASE WHEN k = r THEN 'unresolved:super.shared' ELSE {_chain_usr('r', '.shared()', 6)} END FROM k
UNION ALL SELECT own, 'CALLS', own FROM k
UNION ALL SELECT own, 'CALLS', {_chain_usr('k', '.K#()', 3)} FROM k
UNION ALL SELECT own, 'CALLS', {_chain_usr('k', '.st(int)', 4)} FROM k
UNION ALL SELECT own, 'CALLS', 'unresolved:this.missing' FROM k
UNION ALL SELECT {_chain_usr('k', '', 2)}, 'INHERITS_FROM', {_chain_usr('(k - 1)', '', 2)} FROM k WHERE k <> r
UNION ALL SELECT {_chain_usr('k', '.shared()', 6)}, 'OVERRIDES', {_chain_usr('r', '.shared()', 6)} FROM k WHERE k % 5 = 0"""


@query(_CHAIN_SQL, prelude=False)
def java_resolved_edges(g):
    found = pipeline.queued_of(java.extract(g.sql(_CHAIN_FILES)))
    return pipeline.resolve_queued(stored(found["calls"], "calls"), stored(found["symbols"], "symbols")).select("source_usr", "relationship", "target_usr")


@query(f"SELECT count(*) AS asked, count_if(target_usr NOT LIKE 'unresolved:%') AS resolved FROM ({_CHAIN_SQL}) WHERE relationship = 'CALLS'", prelude=False)
def resolved_counts(g):
    edges = java_resolved_edges(g).where("relationship = 'CALLS'")
    return edges.agg(F.count("*").alias("asked"), F.count_if(~F.startswith("target_usr", F.lit("unresolved:"))).alias("resolved"))


# C++: a class for each supplier, in a namespace for each nation.

_CPP_TEXT = """concat('#include "x.h"\\nnamespace n', s_nationkey, ' {\\nclass Base { public: virtual int run(int a) = 0; virtual ~Base(); static void st(); };\\ntemplate <class T> class S', s_suppkey, ' final : public Base, private std::vector<T> {\\npublic: explicit S', s_suppkey,
'(int a = 1) : Base(), x{a} { helper(a); }\\n  int run(int a) override { return helper(a); }\\n  static int helper(const std::map<int, T>& a) noexcept { return a; }\\n  void go() const { auto f = [&](int q) { helper(q); }; run(1); Base::st(); Base* b = make(); b->run(2); }\\n int x;\\n};\\n}\\nint n',
s_nationkey, '::S', s_suppkey, '::late(unsigned int x[], char** y) { this->go(); return 0; }\\nstatic void f', s_suppkey, '() { n', s_nationkey, '::S', s_suppkey, ' s(1); s.go(); }\\n')"""
_CPP_FILES = f"SELECT concat('src/S', s_suppkey, '.cpp') AS path, 'cpp' AS language, encode({_CPP_TEXT}, 'utf-8') AS content FROM {{supplier}}"
_CPP_GOOD = "WITH s AS (SELECT s_suppkey AS k, concat('src/S', s_suppkey, '.cpp') AS file, concat('n', s_nationkey) AS ns, concat('n', s_nationkey, '::Base') AS b, concat('n', s_nationkey, '::S', s_suppkey) AS c FROM supplier)"
_MAP = "const std::map<int, T> &"


def _cpp(g) -> dict[str, DataFrame]:
    return pipeline.queued_of(cpp.extract(g.sql(_CPP_FILES)))


def _cpp_row(label: str, kind: str, name: str, fqn: str, line: int, signature: str | None, parent: str | None, marks: str = "0000") -> str:
    quoted = "CAST(NULL AS string)" if signature is None else f"'{signature}'"
    bits = [f"{'true' if m == '1' else 'false'}" for m in marks]
    abstract, rest = ("NULL", bits) if label == "Function" else (bits[0], ["NULL"] * 4)
    namespace = "ns" if label == "Class" else "NULL"
    usr = _cpp_usr(fqn) if label == "Class" else f"concat('lambda@', file, ':{line}:30')" if kind == "lambda" else _cpp_usr(fqn, quoted)
    if name.startswith("'f'"):
        usr = f"concat('cpp@', substring(sha256(concat({fqn}, '()::', file)), 1, 24))"
    return f"SELECT {usr} AS usr, '{label}' AS label, '{kind}' AS kind, {name} AS name, {fqn} AS fqn, {namespace} AS namespace, file, {line} AS line, {quoted} AS signature, {parent or 'NULL'} AS parent_fqn, CAST({abstract} AS boolean) AS is_abstract, CAST({rest[0]} AS boolean) AS is_virtual, CAST({rest[1]} AS boolean) AS is_pure_virtual, CAST({rest[2]} AS boolean) AS is_static, CAST({rest[3]} AS boolean) AS is_const FROM s"


def _member(name: str) -> str:
    return f"concat(c, '::{name}')"


_CPP_NODES = " UNION ALL ".join([
    _cpp_row("Class", "class", "'Base'", "b", 3, None, None, "1000"), _cpp_row("Function", "function", "'run'", "concat(b, '::run')", 3, "int", "b", "1100"), _cpp_row("Function", "function", "'~Base'", "concat(b, '::~Base')", 3, "", "b", "1000"),
    _cpp_row("Function", "function", "'st'", "concat(b, '::st')", 3, "", "b", "0010"), _cpp_row("Class", "class", "concat('S', k)", "c", 4, None, None), _cpp_row("Function", "constructor", "concat('S', k)", "concat(c, '::S', k)", 5, "int", "c"),
    _cpp_row("Function", "function", "'run'", _member("run"), 6, "int", "c", "1000"), _cpp_row("Function", "function", "'helper'", _member("helper"), 7, _MAP, "c", "0010"), _cpp_row("Function", "function", "'go'", _member("go"), 8, "const", "c", "0001"),
    _cpp_row("Function", "lambda", "'lambda@L8'", _member("lambda@L8"), 8, None, "c"), _cpp_row("Function", "function", "'late'", _member("late"), 12, "unsigned int *, char **", "c"), _cpp_row("Function", "function", "'f' || k", "concat('f', k)", 13, "", None, "0010"),
])


@query(f"{_CPP_GOOD} {_CPP_NODES}", prelude=False)
def cpp_nodes(g):
    return _cpp(g)["nodes"].select("usr", "label", "kind", "name", "fqn", "namespace", "file", "line", "signature", "parent_fqn", "is_abstract", "is_virtual", "is_pure_virtual", "is_static", "is_const")


@query(f"{_CPP_GOOD} SELECT usr, fqn, kind, signature, line, CASE WHEN label = 'Class' THEN namespace ELSE parent_fqn END AS parent_fqn FROM ({_CPP_NODES}) WHERE kind <> 'lambda'", prelude=False)
def cpp_symbols(g):
    return _cpp(g)["symbols"].select("usr", "fqn", "kind", "signature", "line", "parent_fqn")


def _cpp_edge(source: str, rel: str, target: str, line: int) -> str:
    return f"SELECT {source} AS source_usr, '{rel}' AS relationship, {target} AS target_usr, {line} AS line FROM s"


_C = {name: _cpp_usr(_member(name), f"'{signature}'") for name, signature in (("run", "int"), ("helper", _MAP), ("go", "const"), ("late", "unsigned int *, char **"))}
_C |= {"new": _cpp_usr("concat(c, '::S', k)", "'int'"), "lambda": "concat('lambda@', file, ':8:30')", "f": "concat('cpp@', substring(sha256(concat('f', k, '()::', file)), 1, 24))"}
_B = {name: _cpp_usr(f"concat(b, '::{name}')", f"'{signature}'") for name, signature in (("run", "int"), ("st", ""), ("~Base", ""))}


@query(
    f"{_CPP_GOOD} " + " UNION ALL ".join([*(_cpp_edge(_cpp_usr("b"), "DEFINES", usr, 3) for usr in _B.values()), *(_cpp_edge(_cpp_usr("c"), "DEFINES", _C[m], line) for m, line in (("new", 5), ("run", 6), ("helper", 7), ("go", 8), ("late", 12)))]), prelude=False
)
def cpp_defines(g):
    return _cpp(g)["fixed"].select("source_usr", "relationship", "target_usr", "line")


@query(
    f"{_CPP_GOOD} " + " UNION ALL ".join([
        _cpp_edge(_cpp_usr("c"), "INHERITS_FROM", _cpp_usr("b"), 4), _cpp_edge(_C["run"], "OVERRIDES", _B["run"], 6), _cpp_edge(_C["new"], "CALLS", _C["helper"], 5), _cpp_edge(_C["run"], "CALLS", _C["helper"], 6), _cpp_edge(_C["lambda"], "CALLS", _C["helper"], 8),
        _cpp_edge(_C["go"], "CALLS", _C["run"], 8), _cpp_edge(_C["go"], "CALLS", _B["st"], 8), _cpp_edge(_C["go"], "CALLS", _B["run"], 8), _cpp_edge(_C["late"], "CALLS", _C["go"], 12), _cpp_edge(_C["f"], "CALLS", _C["new"], 13), _cpp_edge(_C["f"], "CALLS", _C["go"], 13),
    ]), prelude=False,
)
def cpp_resolved_edges(g):
    found = pipeline.queued_of(cpp.extract(g.sql(_CPP_FILES)))
    table = stored(found["symbols"].distinct(), "symbols").dropDuplicates(["usr"])
    return pipeline.resolve_queued(stored(found["calls"], "calls"), stored(table, "symbols")).select("source_usr", "relationship", "target_usr", "line")


# An incremental run: of sixty classes, the files of about half change and those of every fifth go.


@query(
    f"""WITH edges AS ({_CHAIN_SQL.replace('WHERE c_custkey > 0', 'WHERE c_custkey % 5 <> 3 AND c_custkey BETWEEN 1 AND 60')}), known AS (SELECT source_usr AS usr FROM edges UNION SELECT {_chain_usr('c_custkey', '', 2)} FROM customer WHERE c_custkey % 5 <> 3 AND c_custkey BETWEEN 1 AND 60
UNION SELECT {_chain_usr('c_custkey', '.K#()', 3)} FROM customer WHERE c_custkey % 5 <> 3 AND c_custkey BETWEEN 1 AND 60 UNION SELECT {_chain_usr('c_custkey', '.st(int)', 4)} FROM customer WHERE c_custkey % 5 <> 3 AND c_custkey BETWEEN 1 AND 60
UNION SELECT {_chain_usr('c_custkey', '.shared()', 6)} FROM customer WHERE c_custkey % 5 IN (0, 1) AND c_custkey BETWEEN 1 AND 60)
SELECT count(*) AS n_nodes FROM known""",
    prelude=False,
)
def incremental_nodes(g):
    files = stored(g.sql(_CHAIN_FILES).where("CAST(regexp_extract(path, '([0-9]+)', 1) AS int) <= 60"), "sources")
    store = f"{shared_dir(g.spark).rstrip('/')}/symgraph-index-{uuid.uuid4().hex}"
    changed = files.withColumn("content", F.concat(F.when(F.xxhash64("path") % 2 == 0, F.lit("// old\n").cast("binary")).otherwise(F.lit("").cast("binary")), "content"))
    pipeline.index(g.spark, changed, store, clean=True, derive="never")
    pipeline.index(g.spark, files.where("CAST(regexp_extract(path, '([0-9]+)', 1) AS int) % 5 <> 3"), store, only_changed=True, derive="never")
    return ingest.GraphStore(g.spark, store).read("nodes").agg(F.count("*").alias("n_nodes"))


# Triples as lines.


def _lines(g) -> str:
    nodes = g.nodes().select(F.to_json(F.struct(F.lit("node").alias("triple_type"), F.col("label").alias("node_label"), F.struct("usr", "name", "fqn", "namespace", "file", F.when(F.col("line") % 50 == 3, -1).otherwise(F.col("line")).alias("line"), "language", "kind", "signature", "parent_fqn", "is_static").alias("node_data"))).alias("value"))
    edges = g.raw_edges("INHERITS_FROM", "IMPLEMENTS", "DEFINES", "OVERRIDES").select(F.to_json(F.struct(F.lit("edge").alias("triple_type"), F.struct(F.col("src").alias("source_usr"), F.col("dst").alias("target_usr"), F.col("rel").alias("relationship"), "file", "line").alias("edge_data"))).alias("value"))
    odd = g.table("nation").select(F.explode(F.array(F.concat(F.lit("{bad "), F.col("n_name")), F.lit(""), F.lit("  "))).alias("value"))
    return stored_lines(nodes.unionByName(edges).unionByName(odd), "triples")


@query("SELECT usr, label, name, fqn, namespace, file, CASE WHEN line % 50 = 3 THEN -1 ELSE line END AS line, kind, signature, parent_fqn, is_static FROM g_nodes")
def triples_nodes(g):
    rows = triples.read(g.spark, _lines(g))[0].where("triple_type = 'node'")
    return rows.select(F.col("node_label").alias("label"), "node_data.*").select("usr", "label", "name", "fqn", "namespace", "file", "line", "kind", "signature", "parent_fqn", "is_static")


@query("SELECT src AS source_usr, rel AS relationship, dst AS target_usr, file, line FROM g_raw_edges WHERE rel IN ('INHERITS_FROM', 'OVERRIDES')")
def triples_edges(g):
    return triples.edges_of(triples.read(g.spark, _lines(g))[0], "INHERITS_FROM", "OVERRIDES").drop("shard", "seq")


@query("SELECT concat('{bad ', n_name) AS line FROM nation", prelude=False)
def triples_bad_lines(g):
    return triples.read(g.spark, _lines(g))[1].select("line")


@query("SELECT rel AS relationship, count(*) AS n FROM g_raw_edges WHERE rel NOT IN ('CALLS') GROUP BY 1")
def triples_written_again(g):
    path = stored_lines(g.spark.range(0).selectExpr("CAST(id AS string) AS value"), "copy")
    triples.write(triples.read(g.spark, _lines(g))[0], path)
    return triples.read(g.spark, path)[0].where("triple_type = 'edge'").groupBy(F.col("edge_data.relationship").alias("relationship")).agg(F.count("*").alias("n"))


@query("SELECT 'node' AS what, count(*) AS n FROM g_nodes WHERE line % 50 = 3")
def quarantine(g):
    rows = triples.read(g.spark, _lines(g))[0]
    return ingest.graph_of(rows)["quarantine"].groupBy("what").agg(F.count("*").alias("n"))


@query("SELECT src, rel, dst, file, line FROM g_edges WHERE rel <> 'CALLS' AND src IN (SELECT usr FROM g_nodes WHERE line % 50 <> 3) AND dst IN (SELECT usr FROM g_nodes WHERE line % 50 <> 3)")
def store_edges(g):
    rows = stored(triples.read(g.spark, _lines(g))[0], "triples")
    store = ingest.GraphStore(g.spark, f"{shared_dir(g.spark).rstrip('/')}/symgraph-store-{uuid.uuid4().hex}")
    store.ingest(rows.where("triple_type = 'node' OR edge_data.line % 2 = 0"))
    store.ingest(rows)  # again, and the rest
    return store.read("edges").select("src", "rel", "dst", "file", "line")


# Sources, hashes and scalars.

_NAMES = "SELECT concat('file:/src/', s_suppkey, CASE s_suppkey % 6 WHEN 0 THEN '.CPP' WHEN 1 THEN '.java' WHEN 2 THEN '.h' WHEN 3 THEN '.txt' WHEN 4 THEN '.Java' ELSE '.tar.cc' END) AS path, CAST('x' AS binary) AS content FROM {supplier}"


@query("SELECT replace(path, 'file:', '') AS path, CASE WHEN lower(path) LIKE '%.java' THEN 'java' ELSE 'cpp' END AS language FROM (" + _NAMES.replace("{supplier}", "supplier").replace("CAST('x' AS binary)", "1") + ") WHERE path NOT LIKE '%.txt'", prelude=False)
def source_discovery(g):
    return sources.sources_of(g.sql(_NAMES)).select("path", "language")


@query("SELECT concat('doc/', doc_id) AS filepath, coalesce(sha256(text), '') AS sha256 FROM documents", prelude=False)
def content_hashes(g):
    return incremental.content_hashes(g.table("documents").select(F.concat(F.lit("doc/"), "doc_id").alias("path"), F.col("text").cast("binary").alias("content")))


@query("SELECT usr, split_part(concat('/a/', file), '/', 3) AS base, CASE WHEN file LIKE '%1' THEN '.y' ELSE '.x' END AS ext FROM g_nodes")
def path_parts(g):
    path = F.concat(F.lit("/a/"), "file")
    return g.nodes().select("usr", scalars.base_name(path).alias("base"), scalars.extension(F.concat(path, F.when(F.endswith("file", F.lit("1")), ".Y").otherwise(".X"))).alias("ext"))


@query("SELECT count(*) AS n, true AS iso FROM region", prelude=False)
def utc_now(g):
    return g.table("region").select(scalars.utc_now().alias("now")).agg(F.count("*").alias("n"), F.bool_and(F.col("now").rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d\.\d{6}\+00:00$")).alias("iso"))


@query(_trails_sql("'P:1'", 2, False, "").replace("SELECT depth, path FROM walk ", ", few AS (SELECT path, depth AS d FROM walk ORDER BY depth, path LIMIT 100), steps AS (SELECT path AS chain, unnest(string_split(path, ' > ')) AS usr, unnest(range(d + 1)) AS depth FROM few) SELECT chain, CAST(depth AS int) AS depth, s.usr, name, fqn FROM steps s JOIN g_nodes n ON n.usr = s.usr"))
def call_traces(g):
    return paths.trace(g.nodes("part"), g.edges("CALLS"), "P:1", 2)


@query(
    _trails_sql("'P:1'", 1, False, "").replace(
        "SELECT depth, path FROM walk ",
        """, back AS (SELECT src AS usr, concat(src, ' > P:1') AS path FROM g_edges WHERE rel = 'CALLS' AND dst = 'P:1'), p AS (SELECT name, fqn FROM g_nodes WHERE usr = 'P:1'),
up AS (SELECT path, any_value(concat('  ', n.name, ' → ', p.name)) AS line FROM back JOIN g_nodes n USING (usr), p GROUP BY path ORDER BY path LIMIT 10),
down AS (SELECT path, any_value(concat('  ', p.name, ' → ', n.name)) AS line FROM walk JOIN g_nodes n ON n.usr = node, p GROUP BY path ORDER BY path LIMIT 10)
SELECT concat('=== Call Flow Narrative for ', p.fqn, ' ===\\n', '\\n', CASE WHEN (SELECT count(*) FROM up) = 0 THEN 'UPSTREAM: No callers found (entry point or unused)' ELSE concat('UPSTREAM (Who calls this?):\\n', (SELECT string_agg(line, '\\n' ORDER BY path) FROM up)) END, '\\n\\n',
CASE WHEN (SELECT count(*) FROM down) = 0 THEN 'DOWNSTREAM: No callees found (leaf function)' ELSE concat('DOWNSTREAM (What does this call?):\\n', (SELECT string_agg(line, '\\n' ORDER BY path) FROM down)) END) AS text FROM p""",
    ).replace("\\n", "\n")
)
def call_narrative(g):
    return g.spark.createDataFrame([(paths.narrative(g.nodes("part"), g.edges("CALLS"), "P:1", 1),)], "text string")


@query("SELECT usr, label, name, fqn, file, line FROM g_nodes WHERE usr IN (SELECT usr FROM (SELECT usr FROM g_nodes WHERE contains(lower(name), 'supplier#00000000') OR contains(lower(fqn), 'supplier#00000000') ORDER BY fqn, usr LIMIT 5)) ")
def search_any_field(g):
    return graph.search(g.nodes(), "SUPPLIER#00000000", 5).select("usr", "label", "name", "fqn", "file", "line")


# Resolution beside the registered rules.

_ASKED = "SELECT concat('n', n_nationkey) AS call_id, lower(n_name) AS name, concat('GEO.', r_name) AS context, 'none.*' AS imp FROM {nation} JOIN {region} ON n_regionkey = r_regionkey UNION ALL SELECT concat('s', s_suppkey), lower(s_name), NULL, CASE WHEN s_suppkey % 2 = 0 THEN 'SUP.*' END FROM {supplier} WHERE s_suppkey <= 40"


@query(
    ", calls AS (" + _ASKED.replace("{", "").replace("}", "") + """), found AS (
  SELECT call_id, 1 AS prio, fqn, usr FROM calls JOIN g_nodes ON fqn = calls.name
  UNION ALL SELECT call_id, 2, fqn, usr FROM calls JOIN g_nodes ON contains(lower(fqn), lower(concat(context, '.', calls.name))) WHERE context IS NOT NULL
  UNION ALL SELECT call_id, 3, fqn, usr FROM calls JOIN g_nodes ON parent_fqn = context AND contains(lower(fqn), lower(concat('.', calls.name)))
  UNION ALL SELECT call_id, 4, fqn, usr FROM calls JOIN g_nodes ON starts_with(lower(fqn), lower(concat(replace(imp, '.*', ''), '.', calls.name))) WHERE imp IS NOT NULL
  UNION ALL SELECT call_id, 5, fqn, usr FROM calls JOIN g_nodes ON ends_with(lower(fqn), lower(concat('.', calls.name)))
) SELECT call_id, usr, fqn FROM (SELECT *, row_number() OVER (PARTITION BY call_id ORDER BY prio, fqn, usr) AS k FROM found) WHERE k = 1"""
)
def resolve_names_compat(g):
    calls = g.sql(_ASKED).withColumn("imports", F.when(F.col("imp").isNotNull(), F.array("imp"))).drop("imp")
    return symbols.resolve_names(calls, g.symbols().drop("simple_name"), compat=True)


@query("SELECT call_id, usr FROM (SELECT p_partkey AS call_id, n.usr, row_number() OVER (PARTITION BY p_partkey ORDER BY n.fqn, n.usr) AS k FROM part JOIN g_nodes n ON n.parent_fqn = p_brand AND n.name = p_name) WHERE k = 1")
def resolve_method_any(g):
    calls = g.sql("SELECT p_partkey AS call_id, p_brand AS class_fqn, p_name AS name, CAST(NULL AS int) AS arguments FROM {part}")
    return symbols.resolve_methods(calls, g.symbols()).select("call_id", "usr")


@query("SELECT usr, fqn, kind FROM g_nodes WHERE parent_fqn = 'geo.ASIA' OR fqn = 'geo.ASIA' OR usr = 'S:1' OR (kind IN ('class', 'interface') AND language = 'cpp')")
def symbol_lookups(g):
    s = g.symbols()
    parts = [symbols.lookup_fqn(s, "geo.ASIA"), symbols.lookup_usr(s, "S:1"), symbols.all_classes(s, "cpp"), s.where("parent_fqn = 'geo.ASIA'")]
    return ingest.union_all(parts).select("usr", "fqn", "kind").distinct()


# Flags: a line of a log for each part, a makefile and a blueprint for each supplier.

_NDK = "concat('/ndk/r', p_size % 3)"
_TRIPLE = "concat(CASE p_size % 4 WHEN 0 THEN 'aarch64-linux-android' WHEN 1 THEN 'armv7a-linux-androideabi' WHEN 2 THEN 'i686-linux-android' ELSE 'x86_64-linux-android' END, CASE WHEN p_size % 5 = 0 THEN '' ELSE CAST(20 + p_size % 5 AS string) END)"
_TAIL = f"'/toolchains/llvm/bin/clang++ --target=', {_TRIPLE}, ' --sysroot=', {_NDK}, '/toolchains/sys -I/proj/inc', p_size, ' -I ', {_NDK}, '/stl -isystem /sys/inc -isystem ', {_NDK}, '/own -DPART=', p_partkey % 7, ' -D MFGR -std=c++', 14 + 3 * (p_size % 2), ' -fPIC -MD -MF d/x.d -Irel/../inc -c src/p', p_partkey % 50, '.cpp -o out/p', p_partkey, '.o'"
_LOG = f"SELECT p_partkey AS at, CASE WHEN p_partkey % 4 = 0 THEN concat('echo clang is here ', p_name) ELSE concat('[', p_partkey, '/9] PATH=/x ', {_NDK}, {_TAIL}) END AS line FROM {{part}}"
_WORDS = f"concat({_NDK}, {_TAIL})"


def _log(g) -> DataFrame:
    return g.sql(_LOG)


@query(f"SELECT p_partkey AS at, replace({_WORDS}, ' ', '|') AS words FROM part WHERE p_partkey % 4 <> 0", prelude=False)
def flag_commands(g):
    return flags.commands(_log(g)).select("at", F.array_join("words", "|").alias("words"))


@query("SELECT p_partkey AS at FROM part WHERE p_partkey % 4 <> 0", prelude=False)
def flag_lines(g):
    return sources.clang_lines(_log(g)).select("at")


_OPTION_ROWS = f"""SELECT * FROM (SELECT 'target' AS kind, {_TRIPLE} AS value FROM part WHERE p_partkey % 4 <> 0 UNION SELECT 'sysroot', concat({_NDK}, '/toolchains/sys') FROM part WHERE p_partkey % 4 <> 0 UNION SELECT 'include', concat('/proj/inc', p_size) FROM part WHERE p_partkey % 4 <> 0
UNION SELECT CASE WHEN {_NDK} = '/ndk/r0' THEN 'system' ELSE 'include' END, concat({_NDK}, '/stl') FROM part WHERE p_partkey % 4 <> 0 UNION SELECT 'include', 'rel/../inc' UNION SELECT 'system', '/sys/inc' UNION SELECT 'system', concat({_NDK}, '/own') FROM part WHERE p_partkey % 4 <> 0 AND p_size % 3 <> 0
UNION SELECT 'define', concat('PART=', p_partkey % 7) FROM part WHERE p_partkey % 4 <> 0 UNION SELECT 'define', 'MFGR' UNION SELECT 'standard', concat('c++', 14 + 3 * (p_size % 2)) FROM part WHERE p_partkey % 4 <> 0 UNION SELECT 'extra', '-fPIC' UNION SELECT 'root', '/ndk/r0')"""


@query(_OPTION_ROWS, prelude=False)
def flag_options(g):
    return flags.options(flags.commands(_log(g)))


@query(
    f"""WITH o AS ({_OPTION_ROWS}) SELECT '/ndk/r0' AS ndk_root, (SELECT min(value) FROM o WHERE kind = 'standard') AS cpp_standard, (SELECT string_agg(value, ',' ORDER BY value) FROM o WHERE kind = 'include') AS project, (SELECT string_agg(value, ',' ORDER BY value) FROM o WHERE kind = 'system') AS system,
(SELECT string_agg(value, ',' ORDER BY value) FROM o WHERE kind = 'define') AS defines, '-fPIC' AS extra, 'aarch64' AS target_arch, CAST(coalesce(nullif(regexp_extract((SELECT min(value) FROM o WHERE kind = 'target'), '([0-9]+)$', 1), ''), '21') AS int) AS api_level""",
    prelude=False,
)
def flag_configuration(g):
    joined = lambda c: F.array_join(c, ",")
    return flags.configuration(flags.options(flags.commands(_log(g)))).select(
        "ndk_root", "cpp_standard", joined("project_include_paths").alias("project"), joined("extra_system_includes").alias("system"), joined("defines").alias("defines"), joined("extra_compile_args").alias("extra"), "target_arch", "api_level"
    )


@query(f"SELECT {_TRIPLE} AS triple, CASE p_size % 4 WHEN 0 THEN 'aarch64' WHEN 1 THEN 'armv7a' WHEN 2 THEN 'i686' ELSE 'x86_64' END AS arch, CASE WHEN p_size % 5 = 0 THEN CASE WHEN p_size % 4 = 0 THEN 21 ELSE 21 END ELSE 20 + p_size % 5 END AS api FROM part", prelude=False)
def target_triples(g):
    rows = g.sql(f"SELECT {_TRIPLE} AS triple FROM {{part}}")
    return rows.select("triple", flags.target_arch("triple").alias("arch"), flags.api_level("triple").alias("api"))


_FIRST = "FROM (SELECT *, row_number() OVER (PARTITION BY p_partkey % 50 ORDER BY p_partkey) AS k FROM part WHERE p_partkey % 4 <> 0) WHERE k = 1"


@query(f"SELECT concat('/build/src/p', p_partkey % 50, '.cpp') AS file, '/build' AS directory, replace(regexp_replace({_WORDS}, ' -o [^ ]*', ''), ' ', '|') AS arguments {_FIRST}", prelude=False)
def compdb_entries(g):
    return flags.entries(_log(g), "/build").select("file", "directory", F.array_join("arguments", "|").alias("arguments"))


_LAST = _FIRST.replace("ORDER BY p_partkey)", "ORDER BY p_partkey DESC)")
_KEPT = "replace(regexp_replace(replace(replace(regexp_replace(regexp_replace({w}, '^[^ ]* ', ''), ' -o [^ ]*', ''), ' -MF d/x.d', ''), '-Irel/../inc', '-I/build/inc'), ' -c [^ ]*', ''), ' ', '|')"


@query(f"SELECT concat('/build/src/p', p_partkey % 50, '.cpp') AS file, {_KEPT.format(w=_WORDS)} AS arguments {_LAST}", prelude=False)
def compdb_arguments(g):
    return _database(g).select("file", F.array_join("arguments", "|").alias("arguments"))


def _database(g) -> DataFrame:
    found = flags.commands(_log(g)).select("at", F.lit("/build").alias("directory"), F.concat(F.lit("src/p"), F.col("at") % 50, F.lit(".cpp")).alias("file"), "words")
    as_text = found.select("at", "directory", "file", F.when(F.col("at") % 2 == 0, F.col("words")).alias("arguments"), F.when(F.col("at") % 2 != 0, F.array_join("words", " ")).alias("command"))
    return flags.database(as_text)


@query("SELECT count_if(m) AS matched, count_if(NOT m) AS unmatched FROM (SELECT s_suppkey % 80 IN (SELECT p_partkey % 50 FROM part WHERE p_partkey % 4 <> 0) AS m FROM supplier)", prelude=False)
def compdb_matches(g):
    files = g.sql("SELECT concat('/build/src/p', s_suppkey % 80, '.cpp') AS path FROM {supplier}")
    return flags.match_counts(flags.matched(files, _database(g)))


_ARCH = "CASE s_suppkey % 4 WHEN 0 THEN 'aarch64' WHEN 1 THEN 'armv7a' WHEN 2 THEN 'i686' ELSE 'x86_64' END"


def _configurations(g) -> DataFrame:
    return g.sql(f"SELECT s_suppkey AS id, concat('/ndk', s_suppkey) AS ndk_root, {_ARCH} AS target_arch, CAST(16 + s_suppkey % 10 AS int) AS api_level, 'c++20' AS cpp_standard, array(concat('/i', s_suppkey)) AS project_include_paths, array('/s') AS extra_system_includes, array('A=1') AS defines, array('-x') AS extra_compile_args FROM {{supplier}}")


@query(
    f"""SELECT s_suppkey AS id, concat('--target=', CASE s_suppkey % 4 WHEN 0 THEN 'aarch64-linux-android' WHEN 1 THEN 'armv7a-linux-androideabi' WHEN 2 THEN 'i686-linux-android' ELSE 'x86_64-linux-android' END, 16 + s_suppkey % 10, '|--sysroot=', r, '|-isystem|', r, '/usr/include|-isystem|', r, '/usr/include/',
CASE s_suppkey % 4 WHEN 0 THEN 'aarch64-linux-android' WHEN 1 THEN 'arm-linux-androideabi' WHEN 2 THEN 'i686-linux-android' ELSE 'x86_64-linux-android' END, '|-isystem|', r, '/usr/include/c++/v1|-std=c++20|-I|/i', s_suppkey, '|-isystem|/s|-DA=1|-x|-ferror-limit=0') AS arguments
FROM (SELECT s_suppkey, concat('/ndk', s_suppkey, '/toolchains/llvm/prebuilt/linux-x86_64/sysroot') AS r FROM supplier)""",
    prelude=False,
)
def ndk_arguments(g):
    return flags.arguments(_configurations(g)).select("id", F.array_join("arguments", "|").alias("arguments"))


@query("SELECT s_suppkey AS id, 'ndk_root is not a folder' AS fault FROM supplier WHERE s_suppkey % 3 = 0 UNION ALL SELECT s_suppkey, 'api_level is no number from 16' FROM supplier WHERE s_suppkey % 7 = 0", prelude=False)
def ndk_faults(g):
    rows = _configurations(g).withColumn("api_level", F.when(F.col("id") % 7 == 0, 15).otherwise(F.col("api_level")))
    return flags.faults(rows, lambda path: int(path.removeprefix("/ndk")) % 3 != 0)


_MAKE = "concat('LOCAL_PATH := $(call my-dir)\\nLOCAL_C_INCLUDES := $(LOCAL_PATH)/inc', s_suppkey, ' \\\\\\n  $(TOP)/top/', s_nationkey, ' $(UNKNOWN)/x\\nLOCAL_CFLAGS += -DNATION=', s_nationkey, ' -DQ=\\\\\"q\\\\\" -Wall -I$(LOCAL_PATH)/../up\\n')"


@query(
    """WITH s AS (SELECT concat('m', s_suppkey) AS file, s_suppkey AS k, s_nationkey AS n FROM supplier) SELECT file, 'include' AS kind, concat('/src/d', k, '/inc', k) AS value FROM s UNION ALL SELECT file, 'include', concat('/aosp/top/', n) FROM s UNION ALL SELECT file, 'include', '/src/up' FROM s
UNION ALL SELECT file, 'unresolved', '$(UNKNOWN)/x' FROM s UNION ALL SELECT file, 'define', concat('NATION=', n) FROM s UNION ALL SELECT file, 'define', 'Q=q' FROM s""",
    prelude=False,
)
def makefile_values(g):
    return flags.make_values(g.sql(f"SELECT concat('m', s_suppkey) AS file, concat('/src/d', s_suppkey) AS folder, {_MAKE} AS text FROM {{supplier}}"), "/aosp")


_BLUE = "concat('cc_library {\\n  include_dirs: [\"system/core/', s_nationkey, '\", \"own/', s_suppkey, '\"],\\n  cflags: [\"-DB=', s_suppkey, '\", \"-Wall\"],\\n}\\n')"


@query(
    """WITH s AS (SELECT concat('b', s_suppkey) AS file, s_suppkey AS k, s_nationkey AS n FROM supplier) SELECT file, 'include' AS kind, concat('/aosp/system/core/', n) AS value FROM s UNION ALL SELECT file, 'include', concat('/src/own/', k) FROM s UNION ALL SELECT file, 'define', concat('B=', k) FROM s""",
    prelude=False,
)
def blueprint_values(g):
    return flags.blueprint_values(g.sql(f"SELECT concat('b', s_suppkey) AS file, '/src' AS folder, {_BLUE} AS text FROM {{supplier}}"), "/aosp")
