"""Listings, counts and searches over node and edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symgraph.functions.scalars import contains_ci, element_id, namespace_or_global, node_type
from symgraph.schema import CORE_RELATIONSHIPS

CARD = ("usr", "name", "fqn", "file", "line", "language", "kind")


def stats_nodes(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("label").agg(F.count("*").alias("cnt"))


def stats_edges(edges: DataFrame) -> DataFrame:
    return edges.groupBy("rel").agg(F.count("*").alias("cnt"))


def totals(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, classes, functions."""
    count = nodes.agg(F.count("*").alias("nodes"), F.count_if(F.col("label") == "Class").alias("classes"), F.count_if(F.col("label") == "Function").alias("functions"))
    both = count.select("nodes", "classes", "functions", F.lit(0).cast("long").alias("edges")).unionByName(
        edges.agg(F.count("*").alias("edges")).select(*(F.lit(0).cast("long").alias(c) for c in ("nodes", "classes", "functions")), "edges")
    )
    return both.agg(*(F.sum(c).alias(c) for c in ("nodes", "edges", "classes", "functions")))


def namespaces(nodes: DataFrame) -> DataFrame:
    classes = nodes.where("label = 'Class'")
    return classes.groupBy(namespace_or_global("namespace").alias("ns")).agg(F.count("*").alias("cnt")).orderBy(F.desc("cnt"), "ns")


def classes(nodes: DataFrame, namespace: str, limit: int = 200) -> DataFrame:
    """Classes of a namespace by name; '' and 'global' are those without one."""
    chosen = F.col("namespace").isNull() | (F.col("namespace") == "") if namespace in ("", "global") else F.col("namespace") == namespace
    return nodes.where((F.col("label") == "Class") & chosen).select(*CARD, "namespace").orderBy(F.asc_nulls_last("name"), "usr").limit(limit)


def methods(nodes: DataFrame, edges: DataFrame, class_usr: str) -> DataFrame:
    """Functions that a class defines, by line."""
    defined = edges.where((F.col("rel") == "DEFINES") & (F.col("src") == class_usr)).select(F.col("dst").alias("usr")).distinct()
    return nodes.where("label = 'Function'").join(defined, "usr").select(*CARD, "signature").orderBy(F.asc_nulls_last("line"), "usr")


def search(nodes: DataFrame, text: str, limit: int = 20) -> DataFrame:
    """Nodes with ``text`` in name or qualified name, whatever the case."""
    if len(text) < 2 or not 1 <= limit <= 100:
        raise ValueError("the text must have 2 characters at least, and the limit be from 1 to 100")
    return nodes.where(contains_ci("name", text) | contains_ci("fqn", text)).select(*CARD, "label").orderBy("fqn", "usr").limit(limit)


def node(nodes: DataFrame, usr: str) -> DataFrame:
    """The node of a usr: one row, or none."""
    return nodes.where(F.col("usr") == usr).select(*CARD, "label").orderBy("label").limit(1)


def inherits(nodes: DataFrame, edges: DataFrame, limit: int = 50) -> DataFrame:
    """Pairs of classes, child and parent, one step apart."""
    types = nodes.where("label = 'Class'")
    step = edges.where("rel = 'INHERITS_FROM'").select("src", "dst")
    child, parent = types.select(F.col("usr").alias("src"), F.col("fqn").alias("child")), types.select(F.col("usr").alias("dst"), F.col("fqn").alias("parent"))
    return step.join(child, "src").join(parent, "dst").select("child", "parent").orderBy("child", "parent").limit(limit)


def methods_by_class(nodes: DataFrame) -> DataFrame:
    """(parent_fqn, cnt, names): functions of each parent, names sorted in one text."""
    own = nodes.where("label = 'Function' AND parent_fqn IS NOT NULL")
    return own.groupBy("parent_fqn").agg(F.count("*").alias("cnt"), F.array_join(F.array_sort(F.collect_list("name")), ",").alias("names"))


def abstract_classes(functions: DataFrame) -> DataFrame:
    """(parent_fqn, is_abstract): a class with a pure virtual function is abstract."""
    return functions.where("parent_fqn IS NOT NULL").groupBy("parent_fqn").agg(F.bool_or("is_pure_virtual").alias("is_abstract"))


def visible_elements(nodes: DataFrame, edges: DataFrame, relationships: tuple[str, ...] = CORE_RELATIONSHIPS) -> DataFrame:
    """(id, source, rel, target): edges to draw between nodes that are there; parallel ones are one."""
    known = nodes.select("usr").distinct()
    shown = edges.where(F.col("rel").isin(*relationships)).select("src", "rel", "dst").distinct()
    shown = shown.join(known, shown["src"] == known["usr"], "left_semi").join(known, shown["dst"] == known["usr"], "left_semi")
    return shown.select(element_id("src", "rel", "dst").alias("id"), F.col("src").alias("source"), "rel", F.col("dst").alias("target"))


def node_elements(nodes: DataFrame) -> DataFrame:
    return nodes.select(F.col("usr").alias("id"), F.col("name").alias("label"), "fqn", "file", "line", "language", "kind", node_type("kind").alias("type"), namespace_or_global("namespace").alias("namespace"), "parent_fqn")


def to_elements_json(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(element): the JSON of each node and edge for a graph viewer."""
    of_nodes = node_elements(nodes).select(F.to_json(F.struct(F.struct("*").alias("data"))).alias("element"))
    data = F.struct(element_id("src", "rel", "dst").alias("id"), F.col("src").alias("source"), F.col("dst").alias("target"), "rel", "file", "line")
    return of_nodes.unionByName(edges.select(F.to_json(F.struct(data.alias("data"))).alias("element")))


def neighbourhood(edges: DataFrame, usr: str) -> DataFrame:
    """A node and the ends of its edges."""
    touching = edges.where((F.col("src") == usr) | (F.col("dst") == usr))
    return touching.select(F.explode(F.array("src", "dst")).alias("usr")).distinct()
