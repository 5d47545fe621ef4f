import random
import re

import corpus_pipeline as pipeline
from symgraph.llm import shingle_sets
from tests.llm.test_simhash import brute_fingerprint


def shingles(text, words=5):
    found = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {" ".join(found[i : i + words]) for i in range(max(1, len(found) - words + 1))} if found else set()


def brute_components(rows, similarity=0.8):
    sets, root = [shingles(r[1]) for r in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] == sets[j] or sets[i] and sets[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= similarity:
                old, new = root[i], root[j]
                root = [new if r == old else r for r in root]
    least = {}
    for r, (i, _) in zip(root, rows):
        least[r] = min(x for x in (i, least.get(r)) if x is not None) if i is not None or least.get(r) is not None else None
    return sorted(((i, least[r]) for r, (i, _) in zip(root, rows)), key=str)


def corpus(seed=1):
    rng = random.Random(seed)
    texts = [None, "", " \n", "a b", "A  b", "one two three four five"]
    for k in range(60):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([60, 200, 600]))]
        texts.append(" ".join(words))
        for changes in range(1, 5):  # a changed word changes five shingles
            other = list(words)
            for at in rng.sample(range(len(words)), max(1, len(words) * changes // 160)):
                other[at] = f"x{rng.randrange(10**9)}"
            texts.append(" ".join(other))
    rng.shuffle(texts)
    return [(i if i % 17 else None, t) for i, t in enumerate(texts)]


def test_links_are_those_of_the_similarity(spark):
    rows = corpus()
    got = shingle_sets.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.component_id) for r in got), key=str) == brute_components(rows)


def test_stage_drops_copies_that_fingerprints_miss(spark, tmp_path):
    rng = random.Random(2)
    rows, far = [], 0
    for k in range(40):
        words = [f"w{rng.randrange(5000)}" for _ in range(200)]
        other = list(words)
        for at in range(20, 200, 50):  # 176 of 216 shingles are shared: 0.81
            other[at] = "changed"
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(other))]
        far += (brute_fingerprint(rows[-1][1], 5) ^ brute_fingerprint(rows[-2][1], 5)).bit_count() > 6
    got = pipeline.drop_near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), str(tmp_path))
    assert far > 10 and {r.doc_id for r in got.collect()} == set(range(0, 80, 2))


def test_pairs_across_groups_of_a_band(spark, monkeypatch):
    monkeypatch.setattr(shingle_sets, "bands_of", lambda h, at: (lambda full: (full, h[:1].repeat(len(full) * shingle_sets.BANDS).reshape(len(full), -1) * 0))((at[1:] > at[:-1]).nonzero()[0]))
    rows = corpus(3)[:80]
    got = shingle_sets.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(1)).collect()
    assert sorted(((r.doc_id, r.component_id) for r in got), key=str) == brute_components(rows)


def test_empty_table(spark):
    assert shingle_sets.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []
