from pyspark.sql import functions as F

from symgraph.functions import scalars
from symgraph.operators import graph, incremental, ingest
from symgraph.schema import valid_node
from symgraph.sources import files


def test_incremental_round(spark):
    cache = spark.createDataFrame([("a", "1", "t"), ("b", "2", "t"), ("gone", "3", "t")], "filepath string, sha256 string, last_parsed string")
    now = spark.createDataFrame([("a", "1"), ("b", "x"), ("c", "4"), ("d", "")], "filepath string, sha256 string")
    assert {r.filepath for r in incremental.changed(now, cache).collect()} == {"b", "c", "d"}
    kept = incremental.update(cache, incremental.changed(now, cache), incremental.removed(now, cache))
    assert sorted((r.filepath, r.sha256) for r in kept.collect()) == [("a", "1"), ("b", "x"), ("c", "4")]
    assert incremental.changed(now.where("sha256 <> ''"), kept).count() == 0


def test_last_writer_keeps_nulls(spark):
    rows = spark.createDataFrame([("k", "old", 1), ("k", None, 2), ("j", "x", 1)], "usr string, v string, seq int")
    assert sorted(map(tuple, ingest.last_writer(rows, ["usr"], ["seq"]).select("usr", "v").collect()), key=str) == sorted([("k", None), ("j", "x")], key=str)


def test_scalars(spark):
    row = spark.range(1).select(
        scalars.simple_name(F.lit("p.A.m(java.util.List, int)")).alias("a"), scalars.dotted_name(F.lit("p.A.m(int)")).alias("b"), scalars.scope_tail(F.lit("n::C::f")).alias("c"), scalars.package_of(F.lit("a.b.C")).alias("d"),
        scalars.arity(F.lit("int, long")).alias("e"), scalars.arity(F.lit(" ")).alias("f"), scalars.signatures_agree(F.lit("a,b"), F.lit("a, b")).alias("g"), scalars.signatures_agree(F.lit("a"), F.lit("b")).alias("h"),
        scalars.signatures_agree(F.lit(None).cast("string"), F.lit("b")).alias("i"), scalars.unresolved_usr(F.lit(""), F.lit("m")).alias("j"), scalars.short_number(F.lit(1500)).alias("k"), scalars.extension(F.lit("/x/A.JAVA")).alias("l"),
        scalars.base_name(F.lit("/x/y.c")).alias("m"), scalars.path_text(F.array(F.lit("x"), F.lit("y"))).alias("n"), scalars.element_id(F.lit("s"), F.lit("r"), F.lit("d")).alias("o"), scalars.namespace_or_global(F.lit(None).cast("string")).alias("p"),
    ).first()
    assert tuple(row) == ("m", "m", "f", "a.b", 2, 0, True, False, True, "unresolved:this.m", "1.5K", ".java", "y.c", "x → y", "s-r-d", "global")


def test_validation(spark):
    rows = spark.createDataFrame([("u", "n", "f", "x", 1, "java", "class"), ("u", "n", "f", "x", -1, "java", "class"), ("u", None, "f", "x", 1, "java", "class"), ("u", "n", "f", "x", 1, "go", "class")], "usr string, name string, fqn string, file string, line int, language string, kind string")
    assert rows.where(valid_node()).count() == 1


def test_json_elements(spark):
    nodes = spark.createDataFrame([("u", "n", "f", "x", 1, "java", "method", None, "p")], "usr string, name string, fqn string, file string, line int, language string, kind string, namespace string, parent_fqn string")
    edges = spark.createDataFrame([("u", "CALLS", "u", "x", 1)], "src string, rel string, dst string, file string, line int")
    got = sorted(r.element for r in graph.to_elements_json(nodes, edges).collect())
    assert '"id":"u-CALLS-u"' in got[1] + got[0] and any('"type":"Function"' in x and '"namespace":"global"' in x for x in got)


def test_line_sources(spark, tmp_path):
    (tmp_path / "log").mkdir()
    (tmp_path / "log/build.log").write_text("clang++ --target=x -c a.cpp\nld a.o\n")
    assert files.clang_lines(files.log_lines(spark, str(tmp_path / "log"))).count() == 1
    (tmp_path / "mk").mkdir()
    (tmp_path / "mk/Android.mk").write_text("A := x \\\n  y\nB := z\n")
    assert [r.line.split() for r in files.makefile_lines(spark, str(tmp_path / "mk")).where("line <> ''").collect()] == [["A", ":=", "x", "y"], ["B", ":=", "z"]]
    (tmp_path / "bp").mkdir()
    (tmp_path / "bp/Android.bp").write_text('cc {\n  include_dirs: [\n "a", "b"],\n cflags: ["-DX"],\n}')
    found = files.blueprint_values(spark, str(tmp_path / "bp"), "include_dirs", "cflags")
    assert sorted((r.property, r.value) for r in found.collect()) == [("cflags", "-DX"), ("include_dirs", "a"), ("include_dirs", "b")]


def test_short_numbers_round_the_exact_value(spark):
    from symgraph.functions.scalars import short_number

    shown = {0: "0", 999: "999", 1000: "1.0K", 1150: "1.1K", 1250: "1.3K", 2250: "2.3K", 6350: "6.3K", 1750: "1.8K", 999950: "1000.0K", 999949: "999.9K", 2250000: "2.3M", 1250000: "1.3M", 1000000: "1.0M", 1050: "1.1K", 8750: "8.8K"}
    got = spark.createDataFrame([(n,) for n in shown], "n long").select("n", short_number("n").alias("s")).collect()
    assert {r.n: r.s for r in got} == shown
