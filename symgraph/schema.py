"""Data model: nodes, edges, triples, symbols, hashes and calls."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the data model.
RELATIONSHIPS = ("CALLS", "INHERITS_FROM", "IMPLEMENTS", "DEFINES", "OVERRIDES", "VIRTUAL_DISPATCH")
CORE_RELATIONSHIPS = ("CALLS", "INHERITS_FROM", "DEFINES", "OVERRIDES")
NODE_KINDS = ("function", "class", "interface", "lambda", "constructor")
FUNCTION_KINDS = ("function", "method", "constructor", "lambda")
LANGUAGES = ("cpp", "java")

NODE = (
    "usr string, name string, fqn string, namespace string, file string, line int, language string, kind string, signature string, parent_fqn string, "
    "is_virtual boolean, is_pure_virtual boolean, is_static boolean, is_const boolean, is_abstract boolean"
)
EDGE = "source_usr string, target_usr string, relationship string, file string, line int"
TRIPLE = f"triple_type string, node_label string, node_data struct<{NODE.replace(' string', ':string').replace(' int', ':int').replace(' boolean', ':boolean')}>, edge_data struct<{EDGE.replace(' string', ':string').replace(' int', ':int')}>"
SYMBOL = "fqn string, usr string, kind string, file string, line int, language string, signature string, parent_fqn string"
FILE_HASH = "filepath string, sha256 string, last_parsed string"
CALL = (
    "call_id long, qualifier string, member string, arguments_count int, caller_usr string, caller_fqn string, class_fqn string, package string, "
    "imports array<string>, file string, line int, is_constructor boolean"
)


def synthetic_usr(fqn: str, file: str, line: int) -> str:
    return "java@" + hashlib.sha256(f"{fqn}::{file}::{line}".encode()).hexdigest()[:24]


def valid_node(prefix: str = "") -> Column:
    """Whether a node row keeps the model's rules; nulls in required fields break them."""
    c = lambda name: F.col(prefix + name)
    filled = c("usr").isNotNull() & c("name").isNotNull() & c("fqn").isNotNull() & c("file").isNotNull()
    return F.coalesce(filled & (c("line") >= 0) & c("language").isin(*LANGUAGES) & c("kind").isin(*NODE_KINDS), F.lit(False))


def valid_edge(prefix: str = "") -> Column:
    c = lambda name: F.col(prefix + name)
    filled = (F.length(c("source_usr")) > 0) & (F.length(c("target_usr")) > 0)
    return F.coalesce(filled & (F.coalesce(c("line"), F.lit(0)) >= 0) & c("relationship").isin(*RELATIONSHIPS), F.lit(False))


def split_valid(rows: DataFrame, rule: Column) -> tuple[DataFrame, DataFrame]:
    """The rows that keep a rule, and those that go to quarantine."""
    return rows.where(rule), rows.where(~rule)
