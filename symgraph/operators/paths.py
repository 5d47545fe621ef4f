"""Paths and reachability over edge tables.

Trails repeat no edge.  They are built level by level, one equi-join each, and
a limit stops the loop as soon as the shortest levels fill it: exact, as paths
are ordered by length first.  Reachability never enumerates paths: a ball is a
frontier joined with the edges, level by level, with lineage cut by reliable
checkpoints; an edge lies on a short path just if the end it is entered from is
near enough.  Frontiers are small beside the edges, so adaptive execution can
broadcast them; no size is assumed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symgraph.operators.ingest import union_all
from symgraph.storage import checkpointed

MOST_HOPS, MOST_DEPTH = 5, 10


def _check(n: int, most: int) -> None:
    if not 1 <= n <= most:
        raise ValueError(f"{n} is not from 1 to {most}")


def _flipped(edges: DataFrame) -> DataFrame:
    return edges.withColumns({"src": F.col("dst"), "dst": F.col("src")})


def trails(edges: DataFrame, seeds: DataFrame, depth: int, backwards: bool = False, limit: int | None = None) -> DataFrame:
    """(depth, path): nodes joined by ' > ', of every path of 1 to ``depth`` edges that starts, or backwards ends, at one of ``seeds`` (usr)."""
    _check(depth, MOST_DEPTH)
    step = (_flipped(edges) if backwards else edges).select(F.col("src").alias("here"), F.col("dst").alias("next"), "edge_id")
    first = step.join(seeds.select(F.col("usr").alias("here")).distinct(), "here")
    level = first.select(F.col("next").alias("here"), F.array("edge_id").alias("used"), F.array("here", "next").alias("nodes"))
    levels, found = [], 0
    for d in range(1, depth + 1):
        if d > 1:
            level = level.join(step, "here").where(~F.array_contains("used", F.col("edge_id")))
            level = level.select(F.col("next").alias("here"), F.array_append("used", F.col("edge_id")).alias("used"), F.array_append("nodes", F.col("next")).alias("nodes"))
        if limit is not None or d > 2:
            level = checkpointed(level)
        levels.append(level.select(F.lit(d).alias("depth"), F.array_join(F.reverse("nodes") if backwards else F.col("nodes"), " > ").alias("path")))
        if limit is not None:
            found += level.count()
            if found >= limit:
                break
    every = union_all(levels)
    return every if limit is None else every.orderBy("depth", "path").limit(limit)


def distances(edges: DataFrame, seeds: DataFrame, hops: int, direction: str = "forward") -> DataFrame:
    """(usr, dist): nodes within ``hops`` edges of the seeds; direction is forward, backward or both."""
    pairs = {"forward": lambda: edges.select("src", "dst"), "backward": lambda: _flipped(edges).select("src", "dst"), "both": lambda: edges.select("src", "dst").unionByName(_flipped(edges).select("src", "dst"))}[direction]()
    visited = checkpointed(seeds.select("usr").distinct().withColumn("dist", F.lit(0)))
    frontier = visited
    for d in range(1, hops + 1):
        reached = frontier.join(pairs, frontier["usr"] == pairs["src"]).select(F.col("dst").alias("usr")).distinct()
        frontier = checkpointed(reached.join(visited, "usr", "left_anti").withColumn("dist", F.lit(d)))
        if frontier.isEmpty():
            break
        visited = visited.unionByName(frontier)
    return visited


def edges_within(edges: DataFrame, near: DataFrame, hops: int, direction: str = "forward") -> DataFrame:
    """The edges that paths of at most ``hops`` edges from the seeds of ``near`` (usr, dist) can use."""
    inside = near.where(F.col("dist") < hops).select("usr")
    by_source = edges.join(inside, edges["src"] == inside["usr"], "left_semi")
    if direction == "forward":
        return by_source
    by_target = edges.join(inside, edges["dst"] == inside["usr"], "left_semi")
    return by_target if direction == "backward" else by_source.unionByName(by_target).dropDuplicates(["edge_id"])


def neighbors(nodes: DataFrame, edges: DataFrame, usr: str, hops: int) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges around a node, of any relationship, either way."""
    _check(hops, MOST_HOPS)
    near = distances(edges, nodes.where(F.col("usr") == usr), hops, "both")
    return nodes.join(near, "usr"), edges_within(edges, near, hops, "both")


def callchain(nodes: DataFrame, edges: DataFrame, usr: str, direction: str = "both", depth: int = 3) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of all calls to (callers), from (callees) or around (both) a function."""
    _check(depth, MOST_DEPTH)
    calls, seed = edges.where("rel = 'CALLS'"), nodes.where(F.col("usr") == usr)
    found_nodes, found_edges = [seed.select("usr")], []
    for wanted, way in (("callers", "backward"), ("callees", "forward")):
        if direction in (wanted, "both"):
            near = distances(calls, seed, depth, way)
            found_nodes.append(near.select("usr"))
            found_edges.append(edges_within(calls, near, depth, way))
    return nodes.join(union_all(found_nodes).distinct(), "usr", "left_semi"), union_all(found_edges).select("src", "rel", "dst").distinct()


def inheritance(nodes: DataFrame, edges: DataFrame, usr: str, compat: bool = False) -> tuple[DataFrame, DataFrame]:
    """Ancestors and descendants of a class up to ten steps, and the edges between; ``compat`` leaves a class without any out."""
    tree, seed = edges.where("rel = 'INHERITS_FROM'"), nodes.where(F.col("usr") == usr)
    parts = [(distances(tree, seed, 10, way), way) for way in ("forward", "backward")]
    found = union_all([near.select("usr") for near, _ in parts]).distinct()
    used = union_all([edges_within(tree, near, 10, way) for near, way in parts]).dropDuplicates(["edge_id"])
    if compat:
        found = found.join(used.select(F.explode(F.array("src", "dst")).alias("usr")).distinct(), "usr", "left_semi")
    return nodes.join(found, "usr", "left_semi"), used


def impact(nodes: DataFrame, edges: DataFrame, name: str, hops: int = 3) -> DataFrame:
    """(fqn, label) of all that is within ``hops`` edges, either way, of the nodes of a name."""
    near = distances(edges, nodes.where(F.col("name") == name), hops, "both")
    return nodes.join(near.where("dist > 0").select("usr"), "usr", "left_semi").select("fqn", "label").distinct()


def ancestors(edges: DataFrame, relationships: tuple[str, ...] = ("INHERITS_FROM", "IMPLEMENTS"), most: int = MOST_DEPTH) -> DataFrame:
    """(src, ancestor, dist): the transitive closure of inheritance, nearest distance."""
    step = edges.where(F.col("rel").isin(*relationships)).select(F.col("src").alias("child"), F.col("dst").alias("parent")).distinct()
    found = frontier = checkpointed(step.select(F.col("child").alias("src"), F.col("parent").alias("ancestor"), F.lit(1).alias("dist")))
    for d in range(2, most + 1):
        more = frontier.join(step, frontier["ancestor"] == step["child"]).select("src", F.col("parent").alias("ancestor")).distinct()
        frontier = checkpointed(more.join(found, ["src", "ancestor"], "left_anti").withColumn("dist", F.lit(d)))
        if frontier.isEmpty():
            break
        found = found.unionByName(frontier)
    return found


def trace(nodes: DataFrame, edges: DataFrame, usr: str, depth: int = 5, backwards: bool = False, limit: int = 100) -> DataFrame:
    """(chain, depth, usr, name, fqn): the nodes of the first ``limit`` call paths, each with its place."""
    seed = nodes.where(F.col("usr") == usr)
    paths = trails(edges.where("rel = 'CALLS'"), seed, depth, backwards, limit)
    chains = paths.select(F.concat_ws(" > ", "path").alias("chain"), F.posexplode(F.split("path", " > ")).alias("depth", "usr"))
    return chains.join(nodes.select("usr", "name", "fqn"), "usr").select("chain", "depth", "usr", "name", "fqn")


# The wording of a narrative.
_HEADING = "=== Call Flow Narrative for {} ===\n"
_UPSTREAM = ("UPSTREAM (Who calls this?):", "UPSTREAM: No callers found (entry point or unused)")
_DOWNSTREAM = ("DOWNSTREAM (What does this call?):", "DOWNSTREAM: No callees found (leaf function)")


def narrative(nodes: DataFrame, edges: DataFrame, usr: str, depth: int = 3) -> str:
    """Ten call paths to and ten from a function, as text."""

    def section(backwards: bool, some: str, none: str) -> str:
        chains: dict[str, dict[int, str]] = {}
        for r in trace(nodes, edges, usr, depth, backwards).collect():  # 100 paths at most
            chains.setdefault(r.chain, {})[r.depth] = r.name
        shortest = sorted(chains.items(), key=lambda x: (len(x[1]), x[0]))[:10]
        return "\n".join([some, *("  " + " → ".join(own[k] for k in sorted(own)) for _, own in shortest)]) if shortest else none

    known = nodes.where(F.col("usr") == usr).select("fqn").first()
    return "\n".join([_HEADING.format(known.fqn if known else usr), section(True, *_UPSTREAM), "", section(False, *_DOWNSTREAM)])
