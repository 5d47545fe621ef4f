"""The test tables as a code graph.

Regions, nations, suppliers and customers stand for types, parts and orders for
functions; order lines in turn are calls.  The texts are valid in Spark and
DuckDB; a table name in braces is a DataFrame there and a view here.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents")

_NODE_PARTS = {
    "region": "SELECT concat('R:',r_regionkey) usr,'Class' label,r_name name,concat('geo.',r_name) fqn,CAST(NULL AS string) namespace,'region' file,CAST(r_regionkey AS int) line,'java' language,'interface' kind,CAST(NULL AS string) signature,CAST(NULL AS string) parent_fqn,false is_static FROM {region}",
    "nation": "SELECT concat('N:',n_nationkey) usr,'Class' label,n_name name,concat('geo.',r_name,'.',n_name) fqn,'' namespace,'nation' file,CAST(n_nationkey AS int) line,'java' language,'class' kind,CAST(NULL AS string) signature,concat('geo.',r_name) parent_fqn,false is_static FROM {nation} JOIN {region} ON n_regionkey=r_regionkey",
    "supplier": "SELECT concat('S:',s_suppkey) usr,'Class' label,s_name name,concat('sup.',s_name) fqn,'sup' namespace,'supplier' file,CAST(s_suppkey AS int) line,'cpp' language,'class' kind,CAST(NULL AS string) signature,CAST(NULL AS string) parent_fqn,false is_static FROM {supplier}",
    "customer": "SELECT concat('C:',c_custkey) usr,'Class' label,c_name name,concat(c_mktsegment,'.',c_name) fqn,c_mktsegment namespace,'customer' file,CAST(c_custkey AS int) line,'java' language,'class' kind,CAST(NULL AS string) signature,CAST(NULL AS string) parent_fqn,false is_static FROM {customer}",
    "part": "SELECT concat('P:',p_partkey) usr,'Function' label,p_name name,concat(p_brand,'.',p_name,'(',p_type,')') fqn,CAST(NULL AS string) namespace,'part' file,CAST(p_partkey AS int) line,'cpp' language,'function' kind,p_type signature,p_brand parent_fqn,p_size<=5 is_static FROM {part}",
    "orders": "SELECT concat('O:',o_orderkey) usr,'Function' label,concat('order_',o_orderkey) name,concat('C',o_custkey,'.order_',o_orderkey) fqn,CAST(NULL AS string) namespace,'orders' file,CAST(o_orderkey AS int) line,'java' language,'constructor' kind,o_orderstatus signature,concat('C',o_custkey) parent_fqn,false is_static FROM {orders}",
}
_SEQUENCE = "SELECT l_orderkey o,l_partkey p,row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber,l_partkey,l_suppkey,l_quantity,l_extendedprice) rn FROM {lineitem}"
_EDGE_PARTS = {
    "INHERITS_FROM": [
        "SELECT concat('N:',n_nationkey) src,'INHERITS_FROM' rel,concat('R:',n_regionkey) dst,'nation' file,CAST(n_nationkey AS int) line FROM {nation}",
        "SELECT concat('C:',c_custkey) src,'INHERITS_FROM' rel,concat('N:',c_nationkey) dst,'customer' file,CAST(c_custkey AS int) line FROM {customer}",
        "SELECT concat('S:',s_suppkey) src,'INHERITS_FROM' rel,concat('N:',s_nationkey) dst,'supplier' file,CAST(s_suppkey AS int) line FROM {supplier}",
    ],
    "IMPLEMENTS": ["SELECT concat('S:',s_suppkey) src,'IMPLEMENTS' rel,concat('R:',n_regionkey) dst,'supplier' file,CAST(s_suppkey AS int) line FROM {supplier} JOIN {nation} ON s_nationkey=n_nationkey"],
    "DEFINES": ["SELECT concat('C:',o_custkey) src,'DEFINES' rel,concat('O:',o_orderkey) dst,'orders' file,CAST(o_orderkey AS int) line FROM {orders}"],
    "CALLS": [
        f"SELECT concat('P:',a.p) src,'CALLS' rel,concat('P:',b.p) dst,CAST(a.o AS string) file,CAST(a.rn AS int) line FROM ({_SEQUENCE}) a JOIN ({_SEQUENCE}) b ON a.o=b.o AND b.rn=a.rn+1",
        "SELECT concat('P:',user_id) src,'CALLS' rel,concat('unresolved:this.',event_type) dst,'events' file,CAST(event_id AS int) line FROM {events}",
    ],
    "OVERRIDES": [
        "SELECT concat('P:',derived) src,'OVERRIDES' rel,concat('P:',base) dst,'part' file,CAST(derived AS int) line FROM (SELECT p_partkey derived,min(p_partkey) OVER (PARTITION BY p_brand,p_type) base FROM {part}) b WHERE derived<>base"
    ],
}

#: The calls of order lines again, with a look at the next line in place of a join.
_NEXT_LINE = """SELECT concat('P:',p) src,'CALLS' rel,concat('P:',next_p) dst,CAST(o AS string) file,CAST(rn AS int) line FROM (
SELECT l_orderkey o,l_partkey p,lead(l_partkey) OVER w next_p,lead(l_orderkey) OVER w next_o,row_number() OVER w rn FROM {lineitem}
WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber,l_partkey,l_suppkey,l_quantity,l_extendedprice)) t WHERE next_o IS NOT NULL"""

#: Where the nodes are that a prefix of a usr names.
_HOME = {"R": "region", "N": "nation", "S": "supplier", "C": "customer", "P": "part", "O": "orders"}
_ENDS = {"INHERITS_FROM": ("NCS", "RN"), "IMPLEMENTS": ("S", "R"), "DEFINES": ("C", "O"), "CALLS": ("P", "P"), "OVERRIDES": ("P", "P")}

#: The same as common table expressions, for DuckDB.
PRELUDE = "WITH RECURSIVE g_nodes AS (" + " UNION ALL ".join(_NODE_PARTS.values()) + "), g_raw_edges AS (" + " UNION ALL ".join(sum(_EDGE_PARTS.values(), [])) + """), g_edges AS (
SELECT DISTINCT e.src,e.rel,e.dst,e.file,e.line,concat(e.src,'|',e.rel,'|',e.dst,'|',e.file,'|',CAST(e.line AS string)) edge_id FROM g_raw_edges e JOIN g_nodes s ON e.src=s.usr JOIN g_nodes t ON e.dst=t.usr)
"""
PRELUDE = re.sub(r"\{(\w+)\}", r"\1", PRELUDE)


class Projection:
    """Nodes and edges of one folder of tables; only what is asked for is read."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def sql(self, text: str) -> DataFrame:
        # braces are for the tables alone
        parts = re.split(rf"(\{{(?:{'|'.join(_TABLES)})\}})", text)
        text = "".join(p if k % 2 else p.replace("{", "{{").replace("}", "}}") for k, p in enumerate(parts))
        return self.spark.sql(text, **{t: self.table(t) for t in _TABLES if "{" + t + "}" in parts})

    def nodes(self, *homes: str) -> DataFrame:
        return reduce(DataFrame.unionByName, [self.sql(_NODE_PARTS[h]) for h in homes or _NODE_PARTS])

    def raw_edges(self, *relationships: str) -> DataFrame:
        return reduce(DataFrame.unionByName, [self.sql(_NEXT_LINE if "{lineitem}" in text else text) for r in relationships or _EDGE_PARTS for text in _EDGE_PARTS[r]])

    def edges(self, *relationships: str) -> DataFrame:
        """Edges whose ends both exist, one for each key. The ends of a relationship live in few tables, so only these are joined."""
        from symgraph.operators.ingest import merged_edges

        return reduce(
            DataFrame.unionByName,
            [merged_edges(self.raw_edges(r), self.nodes(*(_HOME[x] for x in _ENDS[r][0])).select("usr"), self.nodes(*(_HOME[x] for x in _ENDS[r][1])).select("usr")) for r in relationships or _EDGE_PARTS],
        )

    def symbols(self, *homes: str) -> DataFrame:
        return self.nodes(*homes).select("fqn", "usr", "kind", "file", "line", "language", "signature", "parent_fqn", F.col("name").alias("simple_name"))
