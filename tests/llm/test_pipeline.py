from pyspark.sql import types as T

import corpus_pipeline as pipeline
from symgraph.storage import stored
from tests.llm.test_decontaminate import brute as brute_hits
from tests.llm.test_shingle_sets import brute_components

DATA = "/root/testdata/sf0.001"


def test_stages_on_the_smallest_tables(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    toxic = {r.doc_id for r in spark.read.parquet(f"{DATA}/labels.parquet").where("toxic = 1").collect()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    for name, stage in pipeline.STAGES:
        before = docs.collect()
        docs = stored(stage(spark, docs, DATA), "test")
        after = docs.collect()
        if name != "packing":
            assert docs.columns == columns
        ids = {r.doc_id for r in after}
        if name == "toxicity":
            gone = [r.doc_id for r in before if r.doc_id not in ids]
            assert len(gone) <= 2 * len(toxic) + 20 and after != []
        elif name == "line_dedup":
            assert ids == {r.doc_id for r in before} and all(r.n_chars == len(r.text) for r in after)
        elif name == "simhash_near_dedup":
            first = {least for _, least in brute_components([(r.doc_id, r.text) for r in before])}
            assert ids == first and len(after) == len(ids)
        elif name == "decontamination":
            assert ids == {x[0] for x in brute_hits([(r.doc_id, r.text) for r in before], items) if not x[-1]}
        else:
            assert ids == {r.doc_id for r in before}


def test_odd_rows_pass(spark, tmp_path):
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("score", T.StringType())])
    rows = [(1, None, None, None, None, "a"), (2, "", "en", "s", 0, "b"), (None, "one text without an id " * 3, "en", "s", 1, "c"), (None, "another text without any id " * 3, "en", "s", 1, "c"), (5, "x" * 70000, None, "s", 1, None), (6, "the same words here", "en", "s", 1, "d"), (6, "the same words here", "en", "s", 1, "d")]
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "nothing of this stands there")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = pipeline.run(spark, str(tmp_path)).collect()
    ids = sorted((r.doc_id for r in got if r.piece == 0), key=str)
    assert ids == sorted([1, None, None, 5, 6], key=str)  # 1 and 2 are both without words
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "none/documents.parquet"))
    for name in ("labels", "benchmark"):
        spark.read.parquet(str(tmp_path / f"{name}.parquet")).limit(0).write.parquet(str(tmp_path / f"none/{name}.parquet"))
    assert pipeline.run(spark, str(tmp_path / "none")).collect() == []


def test_contaminated_rows_go_one_by_one(spark, tmp_path):
    bad = "a passage of the benchmark that is long enough to be one whole window of it"
    rows = [(None, bad, 1), (None, "a clean text without an id", 2), (7, "x " + bad, 3), (7, "another clean text", 4), (8, bad, 5), (8, bad, 6), (9, None, 7), (9, "", 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __own long")
    spark.createDataFrame([(1, bad)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert sorted(r["__own"] for r in pipeline.drop_contaminated(spark, docs, str(tmp_path)).collect()) == [2, 4, 7, 8]


def test_near_copies_of_shared_and_missing_ids(spark, tmp_path):
    words = [f"w{i}" for i in range(100)]
    text, near = " ".join(words), " ".join(words + ["more"])
    rows = [(None, text, 1), (7, near, 2), (7, text, 3), (7, text, 3), (9, near, 4), (None, "alone without an id", 5), (7, "a text of its own", 6), (None, None, 7), (3, "", 8), (3, " ", 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __key long")
    got = pipeline.drop_near_copies(spark, docs, str(tmp_path)).collect()
    assert [r["__key"] for r in got if r.text in (text, near)] in ([2], [3]) and sorted(r["__key"] for r in got if r.text not in (text, near)) == [5, 6, 8]
    again = pipeline.drop_near_copies(spark, docs.repartition(7), str(tmp_path)).collect()
    assert {(r.doc_id, r.text) for r in got} == {(r.doc_id, r.text) for r in again}


def test_toxic_rows_go_one_by_one(spark, tmp_path):
    clean, foul = "plain words of a text", "vileword vileword"
    rows = [(i, clean + f" {chr(97 + i % 26)}", "a") for i in range(60)] + [(i, foul + f" {chr(97 + i % 26)}", "a") for i in range(60, 90)] + [(None, foul, "b"), (None, clean, "c"), (1, foul, "d"), (200, None, "e"), (201, "", "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __toxicity string")
    spark.createDataFrame([(i, int(i >= 60)) for i in range(90) if i != 1], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = pipeline.drop_toxic(spark, docs, str(tmp_path)).collect()
    assert sorted(r["__toxicity"] for r in got) == ["a"] * 60 + ["c", "e", "f"]
