import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import types as T

from symgraph.llm import simhash
from symgraph.llm.bytescan import Texts
from symgraph.llm.components import components


def brute_fingerprint(text, words=4):
    found = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not found:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(found[i : i + words]).encode(), 42) for i in range(max(1, len(found) - words + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps, ids, radius=4):
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                parent[find(i)] = find(j)
    least = {}
    for i in range(len(fps)):
        if ids[i] is not None:
            least[find(i)] = min(ids[i], least.get(find(i), ids[i]))
    return [least.get(find(i)) for i in range(len(fps))]


def test_xxh64_of_every_length():
    rng = np.random.default_rng(1)
    data = rng.integers(0, 256, 4000).astype(np.uint8)
    starts = rng.integers(0, 3700, 900)
    stops = starts + np.arange(900) % 300
    for seed in (0, 42):
        got = simhash.xxh64(data, starts, stops, seed)
        assert [int(x) for x in got] == [xxhash.xxh64_intdigest(data[a:b].tobytes(), seed) for a, b in zip(starts, stops)]


def test_fingerprints_of_odd_texts():
    texts = [None, "", " \n ", "a b", "A  B\tc D\x0be", "é ü x y z   w", "one two three four five " * 300, "x" * 70000 + " y z w v"]
    assert [int(x) for x in simhash.fingerprints_of(Texts.of_list(texts))] == [brute_fingerprint(t) for t in texts]


@pytest.mark.parametrize("radius", [1, 3, 4, 6])
def test_bit_sliced_pairs_equal_brute_force(radius):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 1 << 63, 12).astype(np.uint64)
    fps = np.unique(np.concatenate([base ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (k % 8 + 1, 12)).astype(np.uint64), axis=0) for k in range(60)]))
    group = np.sort(rng.integers(0, 3, len(fps)))
    a, b = simhash.close_pairs(fps, group, radius, lanes=97)
    want = {(i, j) for i in range(len(fps)) for j in range(i + 1, len(fps)) if group[i] == group[j] and int(fps[i] ^ fps[j]).bit_count() <= radius}
    assert set(zip(a.tolist(), b.tolist())) == want and want


def test_links_reach_what_pairs_reach(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CHUNK", 8)  # so that crowded keys are cut
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 20).astype(np.uint64)
    fps = np.unique(np.concatenate([base ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (k % 5 + 1, 20)).astype(np.uint64), axis=0) for k in range(30)]))
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    roots = {r.node: r.root for r in components(simhash.fingerprint_links(df, 4)).collect()}
    got = [roots.get(int(x), int(x)) for x in fps.view(np.int64)]
    want = brute_components([int(x) for x in fps], [int(x) for x in fps.view(np.int64)])
    assert got == want


def test_components_of_a_long_chain_and_a_star(spark):
    pairs = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 160)] + [(5, 5), (None, 3), (60, 59)]
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 61)} | {i: 100 for i in range(101, 160)}


def test_near_duplicates(spark):
    words = [f"w{i}" for i in range(300)]
    long = " ".join(words)
    rows = [(5, long, "a"), (3, long + " extra", "a"), (9, "unrelated text here now", None), (2, "", "b"), (7, None, "b"), (None, long, "c"), (9, "unrelated text here now", None), (11, "A b", "x")]
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("fp", T.StringType())])
    got = sorted(map(tuple, simhash.near_duplicates(spark.createDataFrame(rows, schema)).collect()), key=str)
    fps = [brute_fingerprint(r[1]) for r in rows]
    want = sorted(((r[0], f"{f:016x}", c) for r, f, c in zip(rows, fps, brute_components(fps, [r[0] for r in rows]))), key=str)
    assert got == want


def test_empty_table(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []
