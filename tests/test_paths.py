import random

import pytest

from symgraph.operators import paths


def brute_trails(edges, seed, depth):
    out, work = [], [(seed, (), (seed,))]
    while work:
        node, used, path = work.pop()
        for s, d, e in edges:
            if s == node and e not in used and len(used) < depth:
                out.append((len(used) + 1, " > ".join((*path, d))))
                work.append((d, (*used, e), (*path, d)))
    return sorted(out)


@pytest.fixture(scope="module")
def graphs(spark):
    out = []
    for seed in range(3):
        rng = random.Random(seed)
        edges = [(str(rng.randrange(6)), str(rng.randrange(6)), f"e{k}") for k in range(9)]
        df = spark.createDataFrame([(s, "CALLS", d, "f", k, e) for k, (s, d, e) in enumerate(edges)], "src string, rel string, dst string, file string, line int, edge_id string")
        nodes = spark.createDataFrame([(str(k), "Function", f"n{k}", f"f.n{k}") for k in range(6)], "usr string, label string, name string, fqn string")
        out.append((edges, df.cache(), nodes.cache()))
    return out


def test_trails_equal_enumeration(spark, graphs):
    for edges, df, nodes in graphs:
        start = nodes.where("usr = '0'")
        assert sorted(map(tuple, paths.trails(df, start, 3).collect())) == brute_trails(edges, "0", 3)
        back = sorted((d, " > ".join(reversed(p.split(" > ")))) for d, p in brute_trails([(b, a, e) for a, b, e in edges], "0", 3))
        assert sorted(map(tuple, paths.trails(df, start, 3, backwards=True).collect())) == back
        limited = list(map(tuple, paths.trails(df, start, 4, limit=5).collect()))
        assert limited == brute_trails(edges, "0", 4)[:5]


def test_balls_equal_trails(spark, graphs):
    for edges, df, nodes in graphs:
        for hops in (1, 2, 3):
            both = [*edges, *((b, a, e) for a, b, e in edges)]
            walks = brute_trails(both, "0", hops)
            near, used = paths.neighbors(nodes, df, "0", hops)
            assert {r.usr for r in near.collect()} == {"0"} | {p.split(" > ")[-1] for _, p in walks}
            ahead, chain = paths.callchain(nodes, df, "0", "callees", hops)
            forward = brute_trails(edges, "0", hops)
            assert {r.usr for r in ahead.collect()} == {"0"} | {x for _, p in forward for x in p.split(" > ")}
            pairs = {(a, b) for _, p in forward for a, b in zip(p.split(" > "), p.split(" > ")[1:])}
            assert {(r.src, r.dst) for r in chain.collect()} == pairs


def test_bounds_and_lonely_nodes(spark, graphs):
    _, df, nodes = graphs[0]
    with pytest.raises(ValueError):
        paths.neighbors(nodes, df, "0", 6)
    with pytest.raises(ValueError):
        paths.trails(df, nodes, 11)
    lonely = nodes.limit(1)
    assert paths.inheritance(lonely, df, lonely.first().usr)[0].count() == 1
    assert paths.inheritance(lonely, df, lonely.first().usr, compat=True)[0].count() == 0


def test_narrative(spark):
    edges = spark.createDataFrame([("a", "CALLS", "b", "f", 1, "1"), ("b", "CALLS", "c", "f", 2, "2")], "src string, rel string, dst string, file string, line int, edge_id string")
    nodes = spark.createDataFrame([(u, "Function", u.upper(), f"p.{u}") for u in "abc"], "usr string, label string, name string, fqn string")
    text = paths.narrative(nodes, edges, "b")
    assert "p.b" in text and "A → B" in text and "B → C" in text
    assert "No callers" in paths.narrative(nodes, edges, "a") and "No callees" in paths.narrative(nodes, edges, "c")
