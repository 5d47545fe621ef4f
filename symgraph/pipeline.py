"""The indexing pipeline: discover, hash, extract, register, resolve, derive, merge.

Nothing is collected to the driver but counts.  Files that fail give rows of the
table of errors; their hashes are not kept, so they are tried again.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symgraph.extract import cpp, java
from symgraph.operators import derive, incremental, ingest, paths, symbols
from symgraph.schema import FILE_HASH
from symgraph.sources import files as sources
from symgraph.sources import triples
from symgraph.storage import scratch, stored


def _rows(extracted: DataFrame, column: str) -> DataFrame:
    return extracted.select(F.explode(column).alias("r")).select("r.*")


def queued_of(extracted: DataFrame) -> dict[str, DataFrame]:
    """What extracted files hold: nodes, symbols, fixed edges, and queued references, each row with its file."""
    return {"nodes": _rows(extracted, "nodes"), "symbols": _rows(extracted, "symbols"), "fixed": _rows(extracted, "edges").where("relationship IN ('DEFINES', 'CALLS')"), "calls": _rows(extracted, "calls")}


def resolve_queued(calls: DataFrame, table: DataFrame) -> DataFrame:
    """Edges (source_usr ... line) of queued references against a symbol table.

    Java base types become the classes that the table has under their names
    (others stay external); calls, and overrides by way of the inheritance
    closure, are resolved set by set.  C++ references look through their scopes;
    what none of them has is no edge.
    """
    queued = stored(calls.withColumn("call_id", F.monotonically_increasing_id()), "calls")
    shape = lambda rows, rel: rows.select(F.col("caller_usr").alias("source_usr"), "target_usr", rel.alias("relationship"), "file", "line")
    types = table.where("kind IN ('class', 'interface')").groupBy("fqn").agg(F.min("usr").alias("usr"))
    bases = queued.where("kind IN ('INHERITS_FROM', 'IMPLEMENTS')").join(types.withColumnRenamed("fqn", "member"), "member", "left")
    tree = shape(bases.withColumn("target_usr", F.coalesce("usr", F.concat(F.lit("external:"), "member"))), F.col("kind"))
    known = bases.where("usr IS NOT NULL").select(F.col("class_fqn").alias("src"), F.col("kind").alias("rel"), F.col("member").alias("dst"))
    cpp_queue, cpp_table = queued.where("kind LIKE 'CPP_%'"), table.where("language = 'cpp'")
    cpp_bases = cpp_queue.where("kind = 'CPP_INHERITS_FROM'")
    cpp_bases = cpp_bases.join(symbols.resolve_bases(cpp_bases, cpp_table).withColumnRenamed("fqn", "base_fqn"), "call_id").where("base_fqn <> class_fqn")
    known = known.unionByName(cpp_bases.select(F.col("class_fqn").alias("src"), F.lit("INHERITS_FROM").alias("rel"), F.col("base_fqn").alias("dst")))
    above = paths.ancestors(known).select(F.col("src").alias("class_fqn"), F.col("ancestor").alias("ancestor_fqn"), "dist")
    asked = queued.where("kind IN ('CALLS', 'OVERRIDES')")
    resolved = asked.join(symbols.resolve_calls(asked.drop("kind"), table, above), "call_id")
    called = shape(resolved.where((F.col("kind") == "CALLS") | F.col("resolved")).withColumnRenamed("target", "target_usr"), F.col("kind"))
    cpp_asked = cpp_queue.where("kind <> 'CPP_INHERITS_FROM'")
    cpp_found = cpp_asked.join(symbols.resolve_scoped(cpp_asked, cpp_table, above).withColumnRenamed("usr", "target_usr"), "call_id").unionByName(cpp_bases.withColumnRenamed("usr", "target_usr"), allowMissingColumns=True)
    return tree.unionByName(called).unionByName(shape(cpp_found, F.replace("kind", F.lit("CPP_"), F.lit(""))))


def resolve_java(extracted: DataFrame) -> dict[str, DataFrame]:
    """nodes, symbols and resolved edges of extracted Java files."""
    found = queued_of(extracted)
    table = stored(found["symbols"], "symbols")
    return {"nodes": found["nodes"], "symbols": table, "edges": found["fixed"].unionByName(resolve_queued(found["calls"], table))}


def derive_edges(edges: DataFrame, nodes: DataFrame, table: DataFrame) -> DataFrame:
    """Overrides across files and virtual dispatch, from what is there (source_usr ... line)."""
    names = table.select("fqn", "usr", "kind", "signature", "parent_fqn")
    classes = names.where("kind IN ('class', 'interface')")
    step = edges.where("relationship = 'INHERITS_FROM'").select("source_usr", "target_usr")
    tree = step.join(classes.select(F.col("usr").alias("source_usr"), F.col("fqn").alias("child")), "source_usr").join(classes.select(F.col("usr").alias("target_usr"), F.col("fqn").alias("parent")), "target_usr")
    methods = names.where("kind IN ('method', 'function')").select(F.col("parent_fqn").alias("class"), F.element_at(F.split(F.substring_index("fqn", "(", 1), r"::|\."), -1).alias("name"), "signature", "usr", F.col("fqn").alias("seq"))
    found = derive.overrides(tree.select("child", "parent"), methods.where("class IS NOT NULL"))
    shape = lambda df, rel: df.select(F.col("src").alias("source_usr"), F.col("dst").alias("target_usr"), F.lit(rel).alias("relationship"), F.coalesce("file", F.lit("")).alias("file"), F.coalesce("line", F.lit(0)).alias("line"))
    crossed = shape(found.withColumns({"file": F.lit(""), "line": F.lit(0)}), "OVERRIDES")
    every = edges.where("relationship = 'OVERRIDES'").select(F.col("source_usr").alias("src"), F.col("target_usr").alias("dst")).unionByName(found)
    calls = edges.where("relationship = 'CALLS'").select(F.col("source_usr").alias("src"), F.col("target_usr").alias("dst"), "file", "line")
    static = nodes.where("is_static").select("usr")
    return crossed.unionByName(shape(derive.virtual_dispatch(calls, every, static), "VIRTUAL_DISPATCH"))


def as_triples(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes and edges as triples with an order, for the merge."""
    own = triples.of_nodes(nodes)
    return own.unionByName(triples.of_edges(edges, own)).withColumns({"shard": F.lit("run"), "seq": F.monotonically_increasing_id()})


_DERIVED = "rel = 'VIRTUAL_DISPATCH' OR rel = 'OVERRIDES' AND file = ''"


def index(spark: SparkSession, files: DataFrame, store: str, triples: DataFrame | None = None, only_changed: bool = False, clean: bool = False, derive: str = "always") -> dict:
    """Index source files (path, language, content) into a store; counts of the run.

    The store keeps what each file gave before resolution.  An incremental run
    reads just the changed files anew, drops the rows of changed and removed
    ones, and resolves everything again, which is a few joins; so its outcome is
    that of a full run.  Rows that came from triples stay as they are.
    ``derive``: overrides and virtual dispatch always, never, or with ``cpp``
    only if the run has C++ rows.
    """
    began, graph = time.time(), ingest.GraphStore(spark, store)
    if clean:
        graph.wipe()
    with scratch(spark):
        hashes = stored(incremental.content_hashes(files), "hashes")
        cache = graph.read("hashes")
        if cache is None:
            cache = spark.createDataFrame([], FILE_HASH)
        gone = incremental.removed(hashes, cache)
        todo = stored(incremental.changed(hashes, cache) if only_changed else hashes, "todo")
        work = files.join(todo.select(F.col("filepath").alias("path")), "path", "left_semi")
        languages = work.repartition(F.col("path"))
        extracted = stored(java.extract(languages.where("language = 'java'")).unionByName(cpp.extract(languages.where("language = 'cpp'"))), "extracted")
        failed = extracted.where(F.size("errors") > 0)
        touched = stored(todo.select("filepath").unionByName(gone.select("filepath")).distinct(), "touched")
        queues = {}
        for what, rows in queued_of(extracted).items():
            old = graph.read(f"file_{what}")
            if old is not None:
                rows = old.join(touched, old["file"] == touched["filepath"], "left_anti").unionByName(rows)
            queues[what] = stored(rows, what)
        own = stored(hashes.select("filepath").unionByName(cache.select("filepath")).distinct(), "own")
        outside = lambda rows: rows.join(own, rows["file"] == own["filepath"], "left_anti")
        old_nodes, old_edges = graph.read("nodes"), graph.read("edges")
        nodes, table = queues["nodes"], queues["symbols"]
        edges = queues["fixed"].unionByName(resolve_queued(queues["calls"], table))
        if triples is not None:
            more = triples.where("triple_type = 'node'").select(F.col("node_label").alias("label"), "node_data.*")
            nodes = nodes.unionByName(more, allowMissingColumns=True)
            edges = edges.unionByName(triples.where("triple_type = 'edge'").select("edge_data.*"))
            table = table.unionByName(more.select("fqn", "usr", "kind", "file", "line", "language", "signature", "parent_fqn"))
        if old_nodes is not None:
            old_nodes, old_edges = outside(old_nodes), outside(old_edges.where(f"NOT ({_DERIVED})"))
            edges = edges.unionByName(old_edges.select(F.col("src").alias("source_usr"), F.col("dst").alias("target_usr"), F.col("rel").alias("relationship"), "file", "line"))
        old = graph.read("symbols")
        new = table.withColumn("seq", F.monotonically_increasing_id())
        kept = stored(symbols.register(None if old is None else outside(old).withColumn("seq", F.monotonically_increasing_id()), new).drop("seq"), "register")
        nodes, edges = stored(nodes, "nodes"), stored(edges, "edges")
        if derive == "always" or derive == "cpp" and not nodes.where("language = 'cpp'").isEmpty():
            every = nodes if old_nodes is None else nodes.unionByName(old_nodes, allowMissingColumns=True)
            edges = edges.unionByName(derive_edges(edges, every, kept))
        merged = ingest.graph_of(as_triples(nodes, edges), False, old_nodes)
        parsed = todo.join(failed.select(F.col("file").alias("filepath")), "filepath", "left_anti")
        errors = failed.select("file", F.explode("errors").alias("error"))
        tables = {f"file_{what}": rows for what, rows in queues.items()} | {"nodes": merged["nodes"], "edges": merged["edges"], "dangling": merged["dangling"], "symbols": kept, "errors": errors}
        version = graph.write(tables | {"hashes": incremental.update(cache, parsed, gone)})
        counts = {r.what: r.n for r in ingest.ingest_totals(graph.read("nodes"), graph.read("edges")).collect()}
        return {"files": hashes.count(), "parsed": extracted.count(), "failed": failed.count(), "errors": f"{store}/errors/v={version}", "counts": counts, "version": version, "seconds": round(time.time() - began, 2)}


def run(spark: SparkSession, root: str, store: str, cpp_triples: str | None = None, only_changed: bool = False, clean: bool = False, languages: tuple[str, ...] = ("cpp", "java"), derive: str = "always") -> dict:
    """Index a source tree into a store (nodes, edges, symbols, hashes, errors, and what each file gave)."""
    rows = None if cpp_triples is None else triples.read(spark, cpp_triples)[0]
    return index(spark, sources.discover(spark, root, languages), store, rows, only_changed, clean, derive)
