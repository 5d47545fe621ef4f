"""The registered queries of this package: thin wrappers that apply an operator to whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symgraph.llm import decontaminate, embedding_dedup, html_density, line_dedup, packing, quality, secret_scan, simhash, token_counts, toxicity
from symgraph.llm.batches import bound_batches
from symgraph.llm.tokens import public_tokenizer
from symgraph.storage import new_path, stored


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(decontaminate.find_contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), window=10))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    end, folder = 50256, new_path(spark, "flat")
    order = stored(token_counts.write_flat_files(_table(spark, sf_dir, "documents"), public_tokenizer(), end, folder), "order")
    if order.isEmpty():  # no files to read
        return order.select("doc_id", F.lit(0).cast("long").alias("n_tokens"))
    files = token_counts.flat_files(spark, folder).join(order.select("stream").distinct(), "stream", "left_semi")
    return token_counts.document_token_counts(order, token_counts.read_flat_files(files), end)


def op3_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_density.extract(_table(spark, sf_dir, "pages"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizer(), capacity=1024, end=2)


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"), words=4, radius=4)


def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(_table(spark, sf_dir, "embeddings"), cosine=0.9, recall=0.99)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.remove_repeated(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels"), modulus=4, held_out=2)
    return toxicity.score_table(docs, model, modulus=4, held_out=2)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = quality.fit(docs, _table(spark, sf_dir, "labels"), modulus=5, held_out=0)
    return toxicity.score_table(docs, model, modulus=5, held_out=0)


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_secrets(_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_token_counts": op2_token_counts,
    "op3_html_main_text": op3_html_main_text,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_simhash_near_dedup": op5_simhash_near_dedup,
    "op6_embedding_near_dedup": op6_embedding_near_dedup,
    "op7_line_dedup": op7_line_dedup,
    "op8_toxicity": op8_toxicity,
    "op9_quality": op9_quality,
    "op10_secret_scan": op10_secret_scan,
}

#: DuckDB SQL for the queries that SQL can express.
ORACLE_SQL: dict[str, str] = {
    "op1_decontaminate": decontaminate.ORACLE_SQL,
}
