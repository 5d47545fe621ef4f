"""Source trees and line-based inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symgraph.functions.scalars import extension

# File name extensions by language; C++ comes first.
CPP_EXTENSIONS = (".c", ".cc", ".cpp", ".cxx", ".h", ".hpp", ".hxx")
JAVA_EXTENSIONS = (".java",)


def discover(spark: SparkSession, root: str, languages: tuple[str, ...] = ("cpp", "java")) -> DataFrame:
    """(path, language, content) of the sources below ``root``; extensions in any case. Columns not asked for are not read."""
    return sources_of(spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root), languages)


def sources_of(files: DataFrame, languages: tuple[str, ...] = ("cpp", "java")) -> DataFrame:
    """(path, language, content) of those of some files (path, content) that are sources."""
    kind = F.when(extension("path").isin(*CPP_EXTENSIONS), "cpp").when(extension("path").isin(*JAVA_EXTENSIONS), "java")
    plain = F.regexp_replace("path", "^file:/+", "/")
    return files.withColumn("language", kind).where(F.col("language").isin(*languages)).select(plain.alias("path"), "language", "content")


def log_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, at, line) of text files; ``at`` orders the lines."""
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("line"))


def clang_lines(lines: DataFrame) -> DataFrame:
    """Lines that hold a clang compile command."""
    is_command = F.col("line").rlike(r"clang(\+\+)?\S*\s") & F.col("line").rlike(r"--target=|--sysroot=|-c ")
    return lines.where(is_command)


def makefile_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line) of makefiles with continued lines joined."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.regexp_replace("value", r"\\[ \t]*\r?\n", " ").alias("text"))
    return whole.select("file", F.explode(F.split("text", r"\r?\n")).alias("line"))


def blueprint_values(spark: SparkSession, path: str, *properties: str) -> DataFrame:
    """(file, property, value) of string lists in blueprint files."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))
    blocks = [
        whole.select("file", F.lit(p).alias("property"), F.explode(F.regexp_extract_all("text", F.lit(rf"(?:^|\s){p}\s*:\s*\[([^\]]*)\]"), 1)).alias("block")) for p in properties
    ]
    every = blocks[0]
    for b in blocks[1:]:
        every = every.unionByName(b)
    return every.select("file", "property", F.explode(F.regexp_extract_all("block", F.lit('"([^"]+)"'), 1)).alias("value"))
