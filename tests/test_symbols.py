import random
import sqlite3

from pyspark.sql import functions as F

from symgraph.operators import derive, symbols


def test_two_key_replace_equals_sqlite(spark):
    rng = random.Random(0)
    for case in range(4):
        rows = [(f"f{rng.randrange(5)}", f"u{rng.randrange(5)}", k) for k in range(14)]
        c = sqlite3.connect(":memory:")
        c.execute("CREATE TABLE s (fqn TEXT PRIMARY KEY, usr TEXT UNIQUE, seq INT)")
        c.executemany("INSERT OR REPLACE INTO s VALUES (?, ?, ?)", rows)
        schema = "fqn string, usr string, seq int"
        existing = symbols.register(None, spark.createDataFrame(rows[:7], schema))
        got = symbols.register(existing, spark.createDataFrame(rows[7:], schema)) if case % 2 else symbols.register(None, spark.createDataFrame(rows, schema))
        want = sorted(c.execute("SELECT * FROM s").fetchall())
        if case % 2:  # in two steps a row that is already gone cannot come back or delete
            c2 = sqlite3.connect(":memory:")
            c2.execute("CREATE TABLE s (fqn TEXT PRIMARY KEY, usr TEXT UNIQUE, seq INT)")
            c2.executemany("INSERT OR REPLACE INTO s VALUES (?, ?, ?)", rows[:7])
            kept = c2.execute("SELECT * FROM s").fetchall()
            c2.executemany("INSERT OR REPLACE INTO s VALUES (?, ?, ?)", rows[7:])
            assert sorted(map(tuple, existing.select("fqn", "usr", "seq").collect())) == sorted(kept)
            want = sorted(c2.execute("SELECT * FROM s").fetchall())
        assert sorted(map(tuple, got.select("fqn", "usr", "seq").collect())) == want


def most_joined(df):
    """The most rows that a join in the executed plan of a DataFrame has given."""
    plan, most = df._jdf.queryExecution(), 0
    plan.toRdd().count()
    nodes = [plan.executedPlan()]
    while nodes:
        node = nodes.pop()
        name = node.nodeName()
        if name.startswith("AdaptiveSparkPlan"):
            nodes.append(node.executedPlan())
        elif "QueryStage" in name:
            nodes.append(node.plan())
        children = node.children()
        nodes += [children.apply(k) for k in range(children.size())]
        if "Join" in name:
            most = max(most, node.metrics().apply("numOutputRows").value())
    return most


SYMBOLS = [
    ("p.A", "A", "class", None, "p"), ("p.A.get(int)", "g1", "method", "int", "p.A"), ("p.A.get()", "g0", "method", "", "p.A"), ("p.A.getAll(int)", "ga", "method", "int", "p.A"),
    ("p.A.A(int)", "c1", "constructor", "int", "p.A"), ("q.B", "B", "class", None, "q"), ("q.B.run()", "r", "method", "", "q.B"), ("java.lang.String", "S", "class", None, "java.lang"),
]


def table(spark):
    return spark.createDataFrame([(f, u, k, "f", 1, "java", s, p) for f, u, k, s, p in SYMBOLS], "fqn string, usr string, kind string, file string, line int, language string, signature string, parent_fqn string")


def test_methods_by_arity_and_as_patterns(spark):
    calls = spark.createDataFrame([(1, "p.A", "get", 0), (2, "p.A", "get", 1), (3, "p.A", "get", 5), (4, "p.A", "none", 0)], "call_id int, class_fqn string, name string, arguments int")
    got = {r.call_id: r.usr for r in symbols.resolve_methods(calls, table(spark)).collect()}
    assert got == {1: "g0", 2: "g1", 3: "g0"}
    loose = {r.call_id: r.usr for r in symbols.resolve_methods(calls, table(spark), compat=True).collect()}
    assert loose == {1: "g0", 2: "g1", 3: "g0"}


def many(spark, arguments):
    n = 2000  # four million pairs
    calls = spark.range(n).selectExpr("id AS call_id", "'p.A' AS class_fqn", "'get' AS name", f"cast({arguments} AS int) AS arguments")
    methods = spark.range(n).selectExpr("concat('p.A.get(', if(id % 2 = 0, '', 'int'), ')') AS fqn", "concat('u', id) AS usr", "'method' AS kind", "'f' AS file", "1 AS line", "'java' AS language", "if(id % 2 = 0, '', 'int') AS signature", "'p.A' AS parent_fqn")
    for compat in (False, True):
        found = symbols.resolve_methods(calls, methods, compat=compat)
        assert most_joined(found) <= n
        yield {(r.arguments, r.usr, r.n) for r in found.join(calls, "call_id").groupBy("arguments", "usr").agg(F.count("*").alias("n")).collect()}


def test_many_calls_of_one_name_are_not_paired_with_all_its_methods(spark):
    assert list(many(spark, "id % 2")) == [{(0, "u0", 1000), (1, "u1", 1000)}] * 2


def test_many_calls_with_unknown_arguments_are_not_paired_with_all_methods(spark):
    assert list(many(spark, "NULL")) == [{(None, "u0", 2000)}] * 2


def most_of(df, operator, metric):
    """The highest value of a metric of such operators in the executed plan of a DataFrame."""
    plan, most = df._jdf.queryExecution(), 0
    plan.toRdd().count()
    nodes = [plan.executedPlan()]
    while nodes:
        node = nodes.pop()
        name = node.nodeName()
        if name.startswith("AdaptiveSparkPlan"):
            nodes.append(node.executedPlan())
        elif "QueryStage" in name:
            nodes.append(node.plan())
        children = node.children()
        nodes += [children.apply(k) for k in range(children.size())]
        if operator in name and node.metrics().contains(metric):
            most = max(most, node.metrics().apply(metric).value())
    return most


def test_methods_of_classes_that_no_call_names_are_not_dealt(spark):
    n = 5000
    calls = spark.createDataFrame([(1, "p.A", "get", 0), (2, "p.A", "get", None)], "call_id int, class_fqn string, name string, arguments int")
    others = spark.range(n).selectExpr("concat('o.C', id, '.get()') AS fqn", "concat('o', id) AS usr", "'method' AS kind", "'f' AS file", "1 AS line", "'java' AS language", "'' AS signature", "concat('o.C', id) AS parent_fqn")
    for compat in (False, True):
        found = symbols.resolve_methods(calls, table(spark).unionByName(others), compat=compat)
        assert {r.call_id: r.usr for r in found.collect()} == {1: "g0", 2: "g0"}
        assert most_of(found, "Aggregate", "numOutputRows") < 100
        assert most_of(found, "Exchange", "shuffleRecordsWritten") < 100


def test_one_call_id_with_several_questions_has_one_answer(spark):
    calls = spark.createDataFrame([(1, "p.A", "get", 7), (1, "p.A", "get", 1), (2, "p.A", "get", None), (None, "p.A", "get", 0), (None, "q.B", "run", 0)], "call_id int, class_fqn string, name string, arguments int")
    got = {r.call_id: (r.usr, r.fqn) for r in symbols.resolve_methods(calls, table(spark)).collect()}
    assert got == {1: ("g1", "p.A.get(int)"), 2: ("g0", "p.A.get()"), None: ("g0", "p.A.get()")}


def test_calls_of_every_form(spark):
    cases = [
        (1, None, "get", 1, "p.A", False, "g1"), (2, "this", "get", 0, "p.A", False, "g0"), (3, "super", "get", 1, "q.B", False, "g1"), (4, "A", "get", 1, "q.B", False, "g1"), (5, None, "A", 1, "q.B", True, "c1"),
        (6, None, "get", 1, "q.B", False, "g1"), (7, "", "nothing", 0, "q.B", False, "unresolved:this.nothing"), (8, "x", "y", 0, "q.B", False, "unresolved:x.y"), (9, "q.B", "run", 0, "p.A", False, "r"), (10, "super", "run", 0, "q.B", False, "unresolved:super.run"),
    ]
    calls = spark.createDataFrame(
        [(i, q, m, n, "u", "f", c, c.split(".")[0], ["p.*"], "f", 1, new) for i, q, m, n, c, new, _ in cases],
        "call_id long, qualifier string, member string, arguments_count int, caller_usr string, caller_fqn string, class_fqn string, package string, imports array<string>, file string, line int, is_constructor boolean",
    )
    above = spark.createDataFrame([("q.B", "p.A", 1)], "class_fqn string, ancestor_fqn string, dist int")
    got = {r.call_id: (r.target, r.resolved) for r in symbols.resolve_calls(calls, table(spark), above).collect()}
    assert got == {i: (want, not want.startswith("unresolved")) for i, *_, want in cases}


def test_names_as_patterns(spark):
    calls = spark.createDataFrame([(1, "p.a.get(int)", None, None), (2, "get", "p.A", None), (3, "B", None, ["q.*"])], "call_id int, name string, context string, imports array<string>")
    got = {r.call_id: r.usr for r in symbols.resolve_names(calls, table(spark), compat=True).collect()}
    assert got == {2: "g0", 3: "B"}


def test_overrides_and_dispatch_examples(spark):
    tree = spark.createDataFrame([("B", "A")], "child string, parent string")
    methods = spark.createDataFrame([("A", "foo", "int x", "A::foo", 1), ("B", "foo", "int  x", "B::foo", 2), ("B", "bar", "", "B::bar", 3), ("A", "baz", "int", "A::baz", 4), ("B", "baz", "long", "B::baz", 5)], "class string, name string, signature string, usr string, seq int")
    assert [tuple(r) for r in derive.overrides(tree, methods).collect()] == [("B::foo", "A::foo")]
    calls = spark.createDataFrame([("T::init", "T::inner", "b", 9), ("T::init", "T::inner", "a", 5), ("T::init", "T::static", "a", 6)], "src string, dst string, file string, line int")
    over = spark.createDataFrame([("C::inner", "T::inner"), ("C::static", "T::static")], "src string, dst string")
    static = spark.createDataFrame([("T::static",)], "usr string")
    assert [tuple(r) for r in derive.virtual_dispatch(calls, over, static).collect()] == [("T::init", "C::inner", "a", 5)]
