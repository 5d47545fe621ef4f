"""The registered queries over the projected test tables, each with its DuckDB SQL.

Paths and sets are flat columns, as lists hash differently in the two engines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symgraph.functions import scalars
from symgraph.operators import derive, graph, incremental, ingest, paths, symbols
from symgraph.plans.projection import PRELUDE, Projection

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None, prelude: bool = True):
    """Register a function of a Projection under its name, with the SQL of its result."""

    def add(f: Callable[[Projection], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Projection(spark, sf_dir))
        if sql is not None:
            ORACLE_SQL[f.__name__] = (PRELUDE + sql) if prelude else sql
        return f

    return add


_CARD = "usr, name, fqn, file, line, language, kind"


@query("SELECT label, count(*) AS cnt FROM g_nodes GROUP BY label")
def stats_nodes(g):
    return graph.stats_nodes(g.nodes())


@query("SELECT rel, count(*) AS cnt FROM g_edges GROUP BY rel")
def stats_edges(g):
    return graph.stats_edges(g.edges())


@query("SELECT (SELECT count(*) FROM g_nodes) AS nodes, (SELECT count(*) FROM g_edges) AS edges, (SELECT count(*) FROM g_nodes WHERE label = 'Class') AS classes, (SELECT count(*) FROM g_nodes WHERE label = 'Function') AS functions")
def graph_totals(g):
    return graph.totals(g.nodes(), g.edges())


@query("SELECT label AS what, count(*) AS n FROM g_nodes GROUP BY 1 UNION ALL SELECT rel, count(*) FROM g_edges GROUP BY 1")
def ingest_totals(g):
    return ingest.ingest_totals(g.nodes(), g.edges())


@query("SELECT coalesce(namespace, 'global') AS ns, count(*) AS cnt FROM g_nodes WHERE label = 'Class' GROUP BY 1")
def namespaces(g):
    return graph.namespaces(g.nodes("region", "nation", "supplier", "customer"))


@query(f"SELECT {_CARD}, namespace FROM g_nodes WHERE label = 'Class' AND namespace = 'BUILDING' ORDER BY name, usr LIMIT 200")
def classes_in_ns(g):
    return graph.classes(g.nodes("region", "nation", "supplier", "customer"), "BUILDING")


@query(f"SELECT {_CARD}, namespace FROM g_nodes WHERE label = 'Class' AND (namespace IS NULL OR namespace = '') ORDER BY name, usr LIMIT 200")
def classes_global(g):
    return graph.classes(g.nodes("region", "nation", "supplier", "customer"), "global")


@query(f"SELECT {_CARD}, signature FROM g_nodes WHERE label = 'Function' AND usr IN (SELECT dst FROM g_edges WHERE rel = 'DEFINES' AND src = 'C:1')")
def methods_of_class(g):
    return graph.methods(g.nodes("orders"), g.edges("DEFINES"), "C:1")


@query(f"SELECT {_CARD}, label FROM g_nodes WHERE contains(lower(name), lower('Bolt')) OR contains(lower(fqn), lower('Bolt')) ORDER BY fqn, usr LIMIT 100")
def search_ci(g):
    return graph.search(g.nodes(), "Bolt", 100)


@query(f"SELECT {_CARD}, label FROM g_nodes WHERE usr = 'P:1'")
def node_lookup(g):
    return graph.node(g.nodes(), "P:1")


@query("SELECT c.fqn AS child, p.fqn AS parent FROM g_edges e JOIN g_nodes c ON e.src = c.usr JOIN g_nodes p ON e.dst = p.usr WHERE e.rel = 'INHERITS_FROM' AND c.label = 'Class' AND p.label = 'Class' ORDER BY 1, 2 LIMIT 50")
def inherits_one_hop(g):
    return graph.inherits(g.nodes("region", "nation", "supplier", "customer"), g.edges("INHERITS_FROM"))


@query("SELECT parent_fqn, count(*) AS cnt, string_agg(name, ',' ORDER BY name) AS names FROM g_nodes WHERE label = 'Function' AND parent_fqn IS NOT NULL GROUP BY 1")
def methods_by_class(g):
    return graph.methods_by_class(g.nodes("part", "orders"))


@query("SELECT p_brand AS parent_fqn, bool_or(p_size <= 5) AS is_abstract FROM part WHERE p_brand IS NOT NULL GROUP BY 1", prelude=False)
def abstract_classes(g):
    return graph.abstract_classes(g.nodes("part").withColumnRenamed("is_static", "is_pure_virtual"))


@query("""SELECT DISTINCT concat(src, '-', rel, '-', dst) AS id, src AS source, rel, dst AS target FROM g_edges WHERE rel IN ('CALLS', 'INHERITS_FROM', 'DEFINES', 'OVERRIDES')
AND src IN (SELECT usr FROM g_nodes WHERE NOT is_static) AND dst IN (SELECT usr FROM g_nodes WHERE NOT is_static)""")
def edge_visibility(g):
    return graph.visible_elements(g.nodes().where("NOT is_static"), g.edges())


@query("""SELECT usr AS id, name AS label, fqn, file, line, language, kind, CASE WHEN kind IN ('function', 'method', 'constructor', 'lambda') THEN 'Function' ELSE 'Class' END AS type,
coalesce(namespace, 'global') AS namespace, parent_fqn FROM g_nodes""")
def node_elements(g):
    return graph.node_elements(g.nodes())


@query("SELECT DISTINCT usr FROM (SELECT src AS usr FROM g_edges WHERE src = 'N:3' OR dst = 'N:3' UNION ALL SELECT dst FROM g_edges WHERE src = 'N:3' OR dst = 'N:3')")
def highlight_neighbors(g):
    return graph.neighbourhood(g.edges(), "N:3")


# Paths


def _trails_sql(seed: str, depth: int, backwards: bool = False, tail: str = "") -> str:
    here, there = ("dst", "src") if backwards else ("src", "dst")
    joined = lambda first, second: f"concat({second}, ' > ', {first})" if backwards else f"concat({first}, ' > ', {second})"
    return f""", walk AS (
  SELECT {there} AS node, 1 AS depth, [edge_id] AS used, {joined(here, there)} AS path FROM g_edges WHERE rel = 'CALLS' AND {here} IN ({seed})
  UNION ALL
  SELECT e.{there}, depth + 1, list_append(used, e.edge_id), {joined('path', f'e.{there}')} FROM walk JOIN g_edges e ON e.{here} = node
  WHERE e.rel = 'CALLS' AND depth < {depth} AND NOT list_contains(used, e.edge_id)
) SELECT depth, path FROM walk {tail}"""


@query(_trails_sql("'P:1'", 2))
def callees_d2(g):
    return paths.trails(g.edges("CALLS"), g.nodes("part").where("usr = 'P:1'"), 2)


@query(_trails_sql("'P:1'", 3, True, "ORDER BY depth, path LIMIT 100"))
def callers_d3(g):
    return paths.trails(g.edges("CALLS"), g.nodes("part").where("usr = 'P:1'"), 3, backwards=True, limit=100)


@query(_trails_sql("SELECT usr FROM g_nodes WHERE name = (SELECT p_name FROM part WHERE p_partkey = 7) AND label = 'Function'", 1, True))
def callers_by_name(g):
    name = g.table("part").where("p_partkey = 7").select(F.col("p_name").alias("name"))
    return paths.trails(g.edges("CALLS"), g.nodes("part").join(name, "name", "left_semi"), 1, backwards=True)


def _ball_sql(rels: str, seed: str, hops: int, direction: str, select: str) -> str:
    step = {"forward": "SELECT src AS a, dst AS b FROM chosen", "backward": "SELECT dst AS a, src AS b FROM chosen", "both": "SELECT src AS a, dst AS b FROM chosen UNION SELECT dst, src FROM chosen"}[direction]
    return f""", chosen AS (SELECT * FROM g_edges WHERE {rels}), step AS ({step}), reach AS (
  SELECT usr, 0 AS dist FROM g_nodes WHERE {seed} UNION SELECT b, dist + 1 FROM reach JOIN step ON a = usr WHERE dist < {hops}
), near AS (SELECT usr, min(dist) AS dist FROM reach GROUP BY usr) {select}"""


_AROUND = dict(rels="true", seed="usr = 'S:1'", hops=2, direction="both")


@query(_ball_sql(**_AROUND, select="SELECT usr, name, fqn, dist FROM g_nodes JOIN near USING (usr)"))
def neighbors_nodes_h2(g):
    return paths.neighbors(g.nodes(), g.edges(), "S:1", 2)[0].select("usr", "name", "fqn", "dist")


@query(_ball_sql(**_AROUND, select="SELECT src, rel, dst, file, line FROM g_edges WHERE src IN (SELECT usr FROM near WHERE dist < 2) OR dst IN (SELECT usr FROM near WHERE dist < 2)"))
def neighbors_edges_h2(g):
    return paths.neighbors(g.nodes(), g.edges(), "S:1", 2)[1].select("src", "rel", "dst", "file", "line")


@query(_ball_sql(rels="true", seed="name = 'order_7'", hops=2, direction="both", select="SELECT DISTINCT fqn, label FROM g_nodes JOIN near USING (usr) WHERE dist > 0"))
def impact_h2(g):
    return paths.impact(g.nodes(), g.edges(), "order_7", 2)


def _tree_sql(select: str) -> str:
    return f""", up AS (SELECT 'N:1' AS usr, 0 AS d UNION SELECT e.dst, d + 1 FROM up JOIN g_edges e ON e.src = usr WHERE e.rel = 'INHERITS_FROM' AND d < 10),
down AS (SELECT 'N:1' AS usr, 0 AS d UNION SELECT e.src, d + 1 FROM down JOIN g_edges e ON e.dst = usr WHERE e.rel = 'INHERITS_FROM' AND d < 10) {select}"""


@query(_tree_sql("SELECT usr, name, fqn FROM g_nodes WHERE usr IN (SELECT usr FROM up UNION SELECT usr FROM down)"))
def inheritance_nodes(g):
    return paths.inheritance(g.nodes("region", "nation", "supplier", "customer"), g.edges("INHERITS_FROM"), "N:1")[0].select("usr", "name", "fqn")


@query(_tree_sql("SELECT src, rel, dst, file, line FROM g_edges WHERE rel = 'INHERITS_FROM' AND (src IN (SELECT usr FROM up) OR dst IN (SELECT usr FROM down))"))
def inheritance_edges(g):
    return paths.inheritance(g.nodes("region", "nation", "supplier", "customer"), g.edges("INHERITS_FROM"), "N:1")[1].select("src", "rel", "dst", "file", "line")


def _chain_sql(select: str) -> str:
    return f""", ahead AS (SELECT 'P:1' AS usr, 0 AS d UNION SELECT e.dst, d + 1 FROM ahead JOIN g_edges e ON e.src = usr WHERE e.rel = 'CALLS' AND d < 2),
back AS (SELECT 'P:1' AS usr, 0 AS d UNION SELECT e.src, d + 1 FROM back JOIN g_edges e ON e.dst = usr WHERE e.rel = 'CALLS' AND d < 2) {select}"""


@query(_chain_sql("SELECT usr, name, fqn FROM g_nodes WHERE usr IN (SELECT usr FROM ahead UNION SELECT usr FROM back)"))
def callchain_nodes_both(g):
    return paths.callchain(g.nodes("part"), g.edges("CALLS"), "P:1", "both", 2)[0].select("usr", "name", "fqn")


@query(_chain_sql("SELECT DISTINCT src, rel, dst FROM g_edges WHERE rel = 'CALLS' AND (src IN (SELECT usr FROM ahead WHERE d < 2) OR dst IN (SELECT usr FROM back WHERE d < 2))"))
def callchain_edges_both(g):
    return paths.callchain(g.nodes("part"), g.edges("CALLS"), "P:1", "both", 2)[1]


@query(""", up AS (SELECT src, dst AS ancestor, 1 AS dist FROM g_edges WHERE rel IN ('INHERITS_FROM', 'IMPLEMENTS') UNION
SELECT u.src, e.dst, dist + 1 FROM up u JOIN g_edges e ON e.src = u.ancestor WHERE e.rel IN ('INHERITS_FROM', 'IMPLEMENTS') AND dist < 10)
SELECT src, ancestor, min(dist) AS dist FROM up GROUP BY 1, 2""")
def inheritance_closure(g):
    return paths.ancestors(g.edges("INHERITS_FROM", "IMPLEMENTS"))


# Derivation


@query("""SELECT src, dst, file, line FROM (SELECT c.src, o.src AS dst, c.file, c.line, row_number() OVER (PARTITION BY c.src, o.src ORDER BY c.file, c.line) AS k
FROM (SELECT src, dst, min(file) AS file, min_by(line, (file, line)) AS line FROM g_edges WHERE rel = 'CALLS' AND dst NOT IN (SELECT usr FROM g_nodes WHERE is_static) GROUP BY src, dst) c
JOIN g_edges o ON o.rel = 'OVERRIDES' AND o.dst = c.dst) WHERE k = 1""")
def virtual_dispatch(g):
    static = g.nodes("part").where("is_static").select("usr")
    return derive.virtual_dispatch(g.edges("CALLS"), g.edges("OVERRIDES"), static)


@query("SELECT dst, count(DISTINCT src) AS overriders FROM g_edges WHERE rel = 'OVERRIDES' GROUP BY dst")
def virtual_targets(g):
    return derive.virtual_targets(g.edges("OVERRIDES"))


_METHODS = "SELECT concat('C:',o_custkey) AS class, o_orderpriority AS name, o_orderstatus AS signature, concat('O:',o_orderkey) AS usr, o_orderkey AS seq FROM {orders}"
_PARENTS = "SELECT concat('C:',c_custkey) AS child, concat('C:',low) AS parent FROM (SELECT c_custkey, min(c_custkey) OVER (PARTITION BY c_nationkey) AS low FROM {customer}) t WHERE c_custkey <> low"


@query(
    f"""WITH methods AS ({_METHODS}), inheritance AS ({_PARENTS}), base AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY class, name ORDER BY seq DESC, usr DESC) AS k FROM methods) WHERE k = 1)
SELECT DISTINCT m.usr AS src, b.usr AS dst FROM inheritance i JOIN methods m ON m.class = i.child JOIN base b ON b.class = i.parent AND b.name = m.name
WHERE coalesce(nullif(replace(m.signature, ' ', ''), '') = nullif(replace(b.signature, ' ', ''), ''), true) AND m.usr <> b.usr""".replace("{orders}", "orders").replace("{customer}", "customer"),
    prelude=False,
)
def overrides_cross(g):
    return derive.overrides(g.sql(_PARENTS), g.sql(_METHODS))


# Merges


@query("SELECT usr, event_type, props, event_id FROM (SELECT user_id AS usr, event_type, props, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events) WHERE k = 1", prelude=False)
def merge_nodes_lww(g):
    return ingest.last_writer(g.table("events").select(F.col("user_id").alias("usr"), "event_type", "props", "event_id"), ["usr"], ["event_id"])


@query("SELECT src, rel, dst, file, line FROM g_edges")
def merge_edges_dedup(g):
    raw = g.raw_edges()
    return ingest.merged_edges(raw.unionByName(raw), g.nodes(), g.nodes()).select("src", "rel", "dst", "file", "line")


@query("SELECT src, rel, dst, file, line FROM g_raw_edges WHERE src NOT IN (SELECT usr FROM g_nodes) OR dst NOT IN (SELECT usr FROM g_nodes)")
def dangling_edges(g):
    return ingest.dangling_edges(g.raw_edges(), g.nodes())


@query("SELECT fqn, count(*) AS n FROM g_nodes GROUP BY fqn HAVING count(*) > 1")
def unique_fqn_violations(g):
    return ingest.duplicates(g.nodes(), "fqn")


@query(
    """SELECT fqn, usr, seq FROM (SELECT user_id AS fqn, value AS usr, event_id AS seq, max(event_id) OVER (PARTITION BY user_id) AS a, max(event_id) OVER (PARTITION BY value) AS b FROM events) WHERE seq = a AND seq = b""",
    prelude=False,
)
def gst_two_key_replace(g):
    return symbols.register(None, g.table("events").select(F.col("user_id").alias("fqn"), F.col("value").alias("usr"), F.col("event_id").alias("seq")))


_FILES = "SELECT concat('doc/', doc_id) AS filepath, {hash} AS sha256 FROM documents"
_CACHE = "SELECT concat('doc/', doc_id) AS filepath, CASE WHEN doc_id % 5 = 0 THEN 'x' ELSE sha256(text) END AS sha256, '2020-01-01' AS last_parsed FROM documents WHERE doc_id % 3 <> 0"


def _files(g):
    return g.table("documents").select(F.concat(F.lit("doc/"), "doc_id").alias("filepath"), F.sha2("text", 256).alias("sha256"))


def _cache(g):
    stale = F.when(F.col("doc_id") % 5 == 0, "x").otherwise(F.sha2("text", 256)).alias("sha256")
    return g.table("documents").where("doc_id % 3 <> 0").select(F.concat(F.lit("doc/"), "doc_id").alias("filepath"), stale, F.lit("2020-01-01").alias("last_parsed"))


@query(f"WITH cache AS ({_CACHE}) SELECT f.filepath, f.sha256 FROM ({_FILES.format(hash='sha256(text)')}) f LEFT JOIN cache c USING (filepath) WHERE c.sha256 IS NULL OR c.sha256 <> f.sha256", prelude=False)
def changed_files(g):
    return incremental.changed(_files(g), _cache(g))


@query(f"SELECT filepath, sha256 FROM ({_FILES.format(hash='sha256(text)')})", prelude=False)
def hash_upsert(g):
    return incremental.update(_cache(g), incremental.changed(_files(g), _cache(g))).select("filepath", "sha256")


# Symbols


@query("SELECT count(*) AS n FROM g_nodes")
def symbol_count(g):
    return g.symbols().agg(F.count("*").alias("n"))


_CALLS = """SELECT concat('r', r_regionkey) AS call_id, concat('geo.', r_name) AS name, CAST(NULL AS string) AS context, CAST(NULL AS string) AS imp FROM {region}
UNION ALL SELECT concat('n', n_nationkey), n_name, concat('geo.', r_name), NULL FROM {nation} JOIN {region} ON n_regionkey = r_regionkey
UNION ALL SELECT concat('c', c_custkey), c_name, NULL, CASE WHEN c_custkey % 2 = 0 THEN concat(c_mktsegment, '.*') ELSE concat(c_mktsegment, '.', c_name) END FROM {customer}
UNION ALL SELECT concat('s', s_suppkey), s_name, 'nowhere', 'other.*' FROM {supplier}
UNION ALL SELECT concat('e', event_id), event_type, NULL, NULL FROM {events}"""


def _calls(g):
    return g.sql(_CALLS).withColumn("imports", F.when(F.col("imp").isNotNull(), F.array("imp"))).drop("imp")


@query(
    """, calls AS (""" + _CALLS.replace("{", "").replace("}", "") + """), keyed AS (SELECT fqn, usr, parent_fqn, name AS simple_name, CASE WHEN contains(split_part(fqn, '(', 1), '.') THEN regexp_replace(split_part(fqn, '(', 1), '\\.[^.]*$', '') END AS package FROM g_nodes),
found AS (
  SELECT call_id, 1 AS prio, fqn, usr FROM calls JOIN keyed ON fqn = name
  UNION ALL SELECT call_id, 2, fqn, usr FROM calls JOIN keyed ON parent_fqn = context AND simple_name = name
  UNION ALL SELECT call_id, 4, fqn, usr FROM calls JOIN keyed ON fqn = imp WHERE ends_with(imp, concat('.', name))
  UNION ALL SELECT call_id, 4, fqn, usr FROM calls JOIN keyed ON package = regexp_replace(imp, '\\.[^.]*$', '') AND simple_name = name WHERE ends_with(imp, '.*')
  UNION ALL SELECT call_id, 5, fqn, usr FROM calls JOIN keyed ON simple_name = name
) SELECT call_id, usr, fqn FROM (SELECT *, row_number() OVER (PARTITION BY call_id ORDER BY prio, fqn, usr) AS k FROM found) WHERE k = 1"""
)
def resolve_names(g):
    return symbols.resolve_names(_calls(g), g.symbols())


@query("SELECT concat('r', r_regionkey) AS call_id, concat('R:', r_regionkey) AS usr FROM region", prelude=False)
def resolve_exact(g):
    calls = g.table("region").select(F.concat(F.lit("r"), "r_regionkey").alias("call_id"), F.concat(F.lit("geo."), "r_name").alias("name"), F.lit(None).cast("string").alias("context"), F.lit(None).cast("array<string>").alias("imports"))
    return symbols.resolve_names(calls, g.symbols("region", "nation")).select("call_id", "usr")


@query("SELECT s_suppkey AS call_id, concat('S:', s_suppkey) AS usr FROM supplier", prelude=False)
def resolve_suffix(g):
    calls = g.table("supplier").select(F.col("s_suppkey").alias("call_id"), F.col("s_name").alias("name"), F.lit(None).cast("string").alias("context"), F.lit(None).cast("array<string>").alias("imports"))
    return symbols.resolve_names(calls, g.symbols("supplier", "nation")).select("call_id", "usr")


@query(
    """, asked AS (SELECT p_partkey AS call_id, p_brand AS class_fqn, p_name AS name, CAST(p_partkey % 3 AS int) AS arguments FROM part)
SELECT call_id, usr, fqn FROM (SELECT call_id, usr, fqn, row_number() OVER (PARTITION BY call_id ORDER BY CASE WHEN (CASE WHEN length(trim(signature)) > 0 THEN len(string_split(signature, ',')) ELSE 0 END) = arguments THEN 1 ELSE 2 END, fqn, usr) AS k
FROM asked a JOIN g_nodes n ON n.parent_fqn = a.class_fqn AND n.name = a.name) WHERE k = 1"""
)
def resolve_method_arity(g):
    calls = g.sql("SELECT p_partkey AS call_id, p_brand AS class_fqn, p_name AS name, CAST(p_partkey % 3 AS int) AS arguments FROM {part}")
    return symbols.resolve_methods(calls, g.symbols("part"))


@query(
    """SELECT c_custkey AS call_id, CASE WHEN c_custkey % 4 = 0 THEN concat('x.', c_name) WHEN c_custkey % 4 = 1 THEN concat('y.', c_name)
WHEN c_mktsegment IN ('MACHINERY', 'BUILDING', 'AUTOMOBILE') THEN concat(c_mktsegment, '.', c_name) END AS fqn FROM customer""",
    prelude=False,
)
def resolve_type_imports(g):
    names = g.table("customer").select(
        F.col("c_custkey").alias("call_id"), F.when(F.col("c_custkey") % 4 == 0, F.concat(F.lit("x."), "c_name")).otherwise(F.col("c_name")).alias("type"), F.lit("AUTOMOBILE").alias("package"),
        F.when(F.col("c_custkey") % 4 == 1, F.array(F.lit("MACHINERY.*"), F.concat(F.lit("y."), "c_name"))).otherwise(F.array(F.lit("MACHINERY.*"), F.lit("BUILDING.*"))).alias("imports"),
    )
    return symbols.resolve_types(names, g.symbols("customer")).select("call_id", "fqn")


@query(
    """, asked AS (SELECT p_partkey AS call_id, CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE 'none' END AS class_fqn, p_name AS member FROM part),
best AS (SELECT call_id, usr FROM (SELECT call_id, usr, row_number() OVER (PARTITION BY call_id ORDER BY CASE WHEN (CASE WHEN length(trim(signature)) > 0 THEN len(string_split(signature, ',')) ELSE 0 END) = 1 THEN 0 ELSE 1 END, fqn, usr) AS k
FROM asked a JOIN g_nodes n ON n.parent_fqn = a.class_fqn AND n.name = a.member) WHERE k = 1)
SELECT a.call_id, coalesce(usr, concat('unresolved:this.', member)) AS target, usr IS NOT NULL AS resolved FROM asked a LEFT JOIN best b USING (call_id)"""
)
def resolve_fallback(g):
    calls = g.table("part").select(
        F.col("p_partkey").alias("call_id"), F.lit("").alias("qualifier"), F.col("p_name").alias("member"), F.lit(1).alias("arguments_count"), F.lit("u").alias("caller_usr"), F.lit("f").alias("caller_fqn"),
        F.when(F.col("p_partkey") % 2 == 0, F.col("p_brand")).otherwise("none").alias("class_fqn"), F.lit("").alias("package"), F.array().cast("array<string>").alias("imports"), F.lit("f").alias("file"), F.lit(1).alias("line"), F.lit(False).alias("is_constructor"),
    )
    no_parents = g.spark.createDataFrame([], "class_fqn string, ancestor_fqn string, dist int")
    return symbols.resolve_calls(calls, g.symbols("part"), no_parents)


# Scalars


@query("SELECT usr, concat('java@', substring(sha256(concat(fqn, '::', file, '::', CAST(line AS string))), 1, 24)) AS hashed FROM g_nodes")
def usr_hash(g):
    return g.nodes().select("usr", scalars.synthetic_usr("fqn", "file", "line").alias("hashed"))


@query("SELECT usr, string_split(fqn, '.')[-1] AS tail, split_part(string_split(fqn, '.')[-1], '(', 1) AS simple, string_split(replace(fqn, '.', '::'), '::')[-1] AS scope FROM g_nodes")
def fqn_simple_name(g):
    return g.nodes().select("usr", F.element_at(F.split("fqn", r"\."), -1).alias("tail"), scalars.dotted_name("fqn").alias("simple"), scalars.scope_tail(F.replace("fqn", F.lit("."), F.lit("::"))).alias("scope"))


@query("SELECT usr, CASE WHEN length(trim(signature)) > 0 THEN len(string_split(signature, ',')) ELSE 0 END AS arity, nullif(replace(signature, ' ', ''), '') AS bare FROM g_nodes WHERE label = 'Function'")
def signature_arity(g):
    return g.nodes("part", "orders").select("usr", scalars.arity("signature").cast("long").alias("arity"), scalars.signature_key("signature").alias("bare"))


def _shown_sql(n: str) -> str:
    scaled = lambda unit, letter: f"concat(CASE WHEN {n} % {unit} = {unit // 4} THEN concat(CAST({n} // {unit} AS string), '.3') ELSE printf('%.1f', {n} / {unit}.0::double) END, '{letter}')"
    return f"CASE WHEN {n} >= 1000000 THEN {scaled(1000000, 'M')} WHEN {n} >= 1000 THEN {scaled(1000, 'K')} ELSE CAST({n} AS string) END"


@query(f"SELECT k, n, {_shown_sql('s')} AS shown FROM (SELECT l_orderkey AS k, CAST(count(*) AS bigint) AS n, CAST(sum(l_partkey) AS bigint) AS s FROM lineitem GROUP BY 1)", prelude=False)
def short_numbers(g):
    sums = g.table("lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.count("*").alias("n"), F.sum("l_partkey").alias("s"))
    return sums.select("k", "n", scalars.short_number("s").alias("shown"))


@query("SELECT event_type AS severity, count(*) AS n FROM events GROUP BY 1", prelude=False)
def diagnostics_histogram(g):
    return ingest.diagnostics_histogram(g.table("events").withColumnRenamed("event_type", "severity"))
