"""Corpus pipeline: toxicity, line dedup, near-dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before
has kept; all but the last return the columns of ``documents``, whatever they
are called.  An empty table gives an empty one in every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symgraph.llm import decontaminate, line_dedup, packing, shingle_sets, toxicity
from symgraph.llm.batches import bound_batches, fresh
from symgraph.llm.tokens import public_tokenizer
from symgraph.storage import stored

#: Documents that score this much or more are toxic.
TOXIC = 0.3
#: Documents whose sets of five-word shingles have this Jaccard similarity or more are near copies.
WORDS, SIMILARITY = 5, 0.8


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject; it learns from ``labels`` and counts characters over ``docs``.

    A null or empty text scores as one without words; rows of one text share a
    score, so they stay or go together, whatever their ids; a score just at the
    threshold rejects.
    """
    bound_batches(spark)
    score = fresh(docs, "toxicity")
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.with_scores(docs, model, "text", score).where(F.col(score) < TOXIC).drop(score)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the chunks of lines that stand in an earlier one; nulls and empty texts stay as they are, repeated rows are treated alike, and of documents with one chunk the smallest id keeps it."""
    bound_batches(spark)
    removed = fresh(docs, "removed")
    kept = line_dedup.remove_repeated(docs, removed=removed).drop(removed)
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return kept


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: that with the smallest id; of several, that of the text with the least MD5, and of repeated rows one.

    Texts without words (null, empty, blank) are one group.  Rows without an id
    stand behind all others.
    """
    bound_batches(spark)
    groups = shingle_sets.near_duplicates(docs, words=WORDS, similarity=SIMILARITY)
    first = groups.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "own")).alias("row"))
    row_key = lambda id_, own: F.md5(F.concat(F.coalesce(F.concat(id_.cast("string"), F.lit(" ")), F.lit("")), own))
    key = fresh(docs, "key")
    first = stored(first.select(row_key(F.col("row.doc_id"), F.col("row.own")).alias(key)), "kept")
    marked = docs.withColumn(key, row_key(F.col("doc_id"), shingle_sets.text_hash(F.col("text").cast("string"))))
    # both the join and the choice of one row are by the key, so the texts are sent once
    return marked.join(first, key).dropDuplicates([key]).select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of the benchmark. The text alone decides, so rows of one text go or stay together and other rows of an id are not touched; a null or empty text stays."""
    bound_batches(spark)
    text = shingle_sets.text_hash(F.col("text").cast("string"))
    found = decontaminate.find_contamination(docs.select(text.alias("key"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col="key")
    own, hit = fresh(docs, "own"), fresh(docs, "hit")
    bad = stored(found.where(F.size("hits") > 0).select(F.col("key").alias(hit)).distinct(), "contaminated")
    return docs.withColumn(own, text).join(bad, F.col(own) == F.col(hit), "left_anti").drop(own)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of 1024 tokens; a null or empty text is its end token, and every row, repeated or without an id, is packed."""
    bound_batches(spark)
    return packing.pack(docs, public_tokenizer(), capacity=1024, end=2)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("simhash_near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: The classifier and the tokenizer have no SQL; the tests hold the pipeline against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that the last stage returns, each stage written and read again on the way."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, f"stage-{name}")
    return docs
