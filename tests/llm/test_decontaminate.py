import hashlib
import re

import duckdb
import pytest

from symgraph.llm import decontaminate
from symgraph.llm.decontaminate import digest, find_contamination


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, size=10):
    windows = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - size + 1) if w else 0):
            windows.setdefault(tuple(w[i : i + size]), set()).add(item)
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for window, own in windows.items():
            for i in range(len(w) - len(window) + 1):
                if tuple(w[i : i + len(window)]) == window:
                    hit |= set(range(i, i + len(window)))
                    found |= own
        found = sorted(str(x) for x in found if x is not None)
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(found).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


LONG = " ".join(f"w{i}" for i in range(30))
ITEMS = [(1, LONG), (2, "Short Item, here"), (10, "short item here"), (3, None), (4, "!!"), (None, " ".join(f"v{i}" for i in range(12))), (5, "É été " * 8)]
DOCS = [
    (1, "x " + LONG + " y"), (2, None), (3, ""), (4, " ".join(f"w{i}" for i in range(9))), (5, "a short item HERE! and short, item - here"), (None, LONG.upper()), (5, "a short item HERE! and short, item - here"),
    (6, " ".join(f"v{i}" for i in range(11))), (7, "w0 w1 w2 w3 w4"), (8, "w5 w6 w7 w8 w9 w10"), (9, "É été " * 30), (11, ("z " * 40000) + " ".join(f"w{i}" for i in range(5, 15)) + " short"), (12, "item here"),
]


@pytest.mark.parametrize("block", [1 << 24, 40])
@pytest.mark.parametrize("segment", [1 << 22, 30])
def test_query_equals_brute_force(spark, monkeypatch, block, segment):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
    monkeypatch.setattr(decontaminate, "SEGMENT_BYTES", segment)
    docs = spark.createDataFrame([(*d, 0) for d in DOCS], "doc_id long, text string, n_words int").repartition(2)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert sorted(map(tuple, digest(find_contamination(docs, items)).collect()), key=str) == brute(DOCS, ITEMS)


def test_sql_equals_brute_force():
    c = duckdb.connect()
    for name, key, rows in (("documents", "doc_id", DOCS), ("benchmark", "item_id", ITEMS)):
        c.execute(f"CREATE TABLE {name} ({key} bigint, text varchar)")
        c.executemany(f"INSERT INTO {name} VALUES (?, ?)", rows)
    assert sorted(c.execute(decontaminate.ORACLE_SQL).fetchall(), key=str) == brute(DOCS, ITEMS)


def test_hits_and_proximity(spark):
    docs = spark.createDataFrame([(1, "q a b x c d q"), (2, "a b c d a b c d"), (3, "a b x x x x c d")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "a b c d")], "item_id long, text string")
    got = {r.doc_id: r for r in find_contamination(docs, items, slop=1).collect()}
    assert [(h.start, h.stop) for h in got[2].hits] == [(0, 8)] and got[2]["items"] == ["7"]
    assert got[1].hits == [] and got[1].near_items == ["7"] and got[3].near_items == []


def test_empty_tables(spark):
    docs, items = spark.createDataFrame(DOCS, "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")
    assert find_contamination(docs.limit(0), items).collect() == []
    assert not any(r.contaminated for r in digest(find_contamination(docs, items.limit(0))).collect())
