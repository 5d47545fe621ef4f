import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from symgraph.llm import quality, toxicity
from symgraph.llm.bytescan import Texts
from symgraph.llm.training import auc, labelled_sample

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def restorer():
    words = "idiot stupid worthless moron loser pathetic trash clown disgusting scum you are the a this what should never happen again today people ".split()
    rng = random.Random(1)
    texts = [" ".join(rng.choice(words) for _ in range(200)) for _ in range(20)]
    return toxicity.Restorer(toxicity.CharacterModel(toxicity.trigrams(Texts.of_list(texts))))


@pytest.mark.parametrize(
    "disguised, plain",
    [("1d10t", "idiot"), ("m0r0n", "moron"), ("w0rthl3ss", "worthless"), ("lo$er", "loser"), ("p@thetic", "pathetic"), ("stuuuupid", "stupid"), ("s t u p i d", "stupid"), ("c.l.o.w.n", "clown"), ("s-c-u-m", "scum"), ("5cum!!", "scum!!"), ("id*ot", "idiot")],
)
def test_disguised_words_are_restored(restorer, disguised, plain):
    assert restorer.restore(f"what {disguised} again") == f"what {plain} again"


@pytest.mark.parametrize("text", ["", "plain words, as they are.", "192.168.1.1 and 2020", "word%%% thing*** of$$$ the!!", "réeux ÉTÉ"])
def test_plain_texts_stay(restorer, text):
    assert restorer.restore(text) == text


@pytest.mark.parametrize(
    "disguised, plain",
    [("you a55", "you ass"), ("you a55 stuuuupid", "you ass stupid"), ("i d i 0 t", "idiot"), ("s.t-u p i d", "stupid"), ("l0s3r_l0s3r", "loser_loser"), ("(4ss", "(ass"), ("m0r0n" * 30, "moron" * 30), ("s" + "t" * 500 + "upid", "stupid")],
)
def test_what_else_stands_in_a_text_changes_nothing(disguised, plain):
    words = "you ass ass ass idiot stupid loser moron clown scum stupid idiot moronmoron losers asses".split()
    rng = random.Random(2)
    own = toxicity.Restorer(toxicity.CharacterModel(toxicity.trigrams(Texts.of_list([" ".join(rng.choice(words) for _ in range(3000))]))))
    for before, after in [("", ""), ("so it is: ", " and stuuupid"), ("x9 ", " 4 5"), ("é ", " word!!")]:
        got = own.restored(pa.array([before + disguised + after], pa.large_string()))[0].as_py()
        assert plain in got, (disguised, got)


@given(st.text(alphabet=st.one_of(st.sampled_from("abAéÉßſK\u212a 01234@$!|+*#_-.,\n'²٣"), st.characters(codec="utf-8")), max_size=40))
@settings(max_examples=1500, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
def test_the_gate_lets_all_through_that_restore_changes(restorer, text):
    if not pc.match_substring_regex(pa.array([text]), toxicity.SUSPICIOUS)[0].as_py():
        assert restorer.restore(text) == text


def test_weights_equal_a_plain_count(restorer):
    rng = random.Random(3)
    common, bad = [f"word{a}{b}x" for a in "bcdfg" for b in "hjklmnpq"], ["badword", "worseword", "öfoul"]
    texts = [" ".join(rng.choices(common, k=30) + (rng.choices(bad, k=4) if k % 5 == 0 else [])) for k in range(200)]
    y = np.array([int(k % 5 == 0) for k in range(200)])
    model = toxicity.ToxicityModel(restorer, texts, y)

    def features(text):
        for w in text.split():
            yield w
            data = w.encode()
            yield from (data[:k] for k in (5, 6, 7, 8, 9) if len(data) > k)

    times, have = ({c: Counter() for c in (0, 1)} for _ in range(2))
    for text, label in zip(texts, y.tolist(), strict=True):
        times[label].update(features(text))
        have[label].update(set(features(text)))
    words, docs = {c: sum(len(t.split()) for t, z in zip(texts, y, strict=True) if z == c) for c in (0, 1)}, {c: int((y == c).sum()) for c in (0, 1)}
    expected = []
    for f in times[1]:
        share = [(have[c][f] + 0.5) / (docs[c] + 1) for c in (0, 1)]
        z = (share[1] - share[0]) / math.sqrt((have[0][f] + have[1][f] + 1) / 200 * (1 / docs[0] + 1 / docs[1]))
        ratio = math.log((times[1][f] + 0.5 * words[1] / words[0]) / words[1]) - math.log((times[0][f] + 0.5) / words[0])
        if have[1][f] >= 2 and z > 3 and ratio > 0.7:
            expected.append(ratio)
    assert sorted(expected) == pytest.approx(sorted(model.weights[model.weights != 0].tolist()), rel=1e-5) and expected
    one = "badword wordbhx"
    known = {f: math.log((times[1][f] + 0.5 * words[1] / words[0]) / words[1]) - math.log((times[0][f] + 0.5) / words[0]) for f in features("badword")}
    hits = list(known.values())
    total, n, strong = sum(hits), 2, sum(w > 3 for w in hits)
    columns = [math.log1p(total), total / math.sqrt(n), total / n * 100, math.log1p(len(hits)), max(hits), math.log1p(strong), strong / n * 100, math.log(n), math.log1p(total) * math.log(n)]
    assert model.scores(pa.array([one], pa.large_string()))[0] == pytest.approx(float(model.regression(np.array([columns]))[0]), rel=1e-5)
    assert (model.scores(pa.array(texts, pa.large_string())) >= 0.3).astype(int).tolist() == y.tolist()


def test_few_labels_do_not_reject_the_rest(restorer):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(3000)]
    texts = [" ".join(rng.choices(words, k=120)) for _ in range(400)]
    y = np.array([int(k < 9) for k in range(80)])  # labels that say nothing
    model = toxicity.ToxicityModel(restorer, texts[:80], y)
    assert (model.scores(pa.array(texts[80:], pa.large_string())) >= 0.3).mean() < 0.1


def test_score_columns_with_names_of_ours(spark):
    docs = spark.createDataFrame([(1, "a fine text", "x", 5), (None, None, "y", 6), (1, "", "z", 7)], "doc_id long, text string, score string, id long")
    labels = spark.createDataFrame([(1, 0)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    got = toxicity.with_scores(docs, model).collect()
    assert got[0].asDict().keys() == {"doc_id", "text", "id", "score"} and all(isinstance(r.score, float) for r in got)
    assert sorted(((r.doc_id, r.predicted) for r in toxicity.score_table(docs, model, 4, 2).collect()), key=str) == [(1, 0), (1, 0), (None, 0)]


def test_of_two_rows_of_an_id_the_same_is_learnt_from(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (2, "c")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (2, 1), (2, 0), (3, 1)], "doc_id long, toxic int")
    got = [labelled_sample(docs.repartition(n), labels, "toxic", F.lit(True)) for n in (1, 2, 3)]
    got = [(texts.to_pylist(), y.tolist()) for texts, y in got]
    assert got[0] == got[1] == got[2] and got[0][0][0] in "ab" and got[0][0][1] == "c" and got[0][1] == [0, 1]
    assert len(labelled_sample(docs, labels, "toxic", F.lit(True), bytes_=1)[0]) == 1


def test_viterbi_equals_the_best_of_all_paths(restorer):
    from itertools import product

    def cost(path):
        a = b = 0
        total = 0.0
        for letter, channel in [*path, (" ", 0.0)]:
            total += channel
            if letter:
                k = 0 if letter == " " else toxicity._LETTERS[letter]
                total += float(restorer.logs[a, b, k]) * (k != 0 or b != 0)
                a, b = b, k
        return total

    for span in ("1d10t", "p@7h3t1c", "5tuuup!d"):
        best = max(product(*restorer._lattice(span, False)), key=cost)
        assert restorer.decode(span, False) == " ".join("".join(letter for letter, _ in best).split())


def test_trigrams_count_every_letter():
    texts = ["ab", "", "É x", "ab"]
    counts = toxicity.trigrams(Texts.of_list(texts))
    a, b = toxicity._LETTERS["a"], toxicity._LETTERS["b"]
    assert counts[(0 * 64 + a) * 64 + b] == 2 and counts[(0 * 64 + 0) * 64 + toxicity._LETTERS["é"]] + counts[(b * 64 + 0) * 64 + toxicity._LETTERS["é"]] == 1


@pytest.mark.parametrize("module, label, modulus, held, least", [(toxicity, "toxic", 4, 2, 0.75), (quality, "quality", 5, 0, 0.95)])
def test_held_out_accuracy(spark, module, label, modulus, held, least):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    table = toxicity.score_table(docs, module.fit(docs, labels), modulus, held).collect()
    assert len(table) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % modulus == held) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in table)
    y = {r.doc_id: r[label] for r in labels.collect()}
    scores = [(r.score, y[r.doc_id]) for r in table if r.held_out and r.doc_id in y]
    assert auc(*(np.array(x) for x in zip(*scores))) >= least


def test_held_out_labels_are_not_read(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet").limit(300), spark.read.parquet(f"{DATA}/labels.parquet")
    turned = labels.selectExpr("doc_id", "CASE WHEN crc32(CAST(CAST(doc_id AS string) AS binary)) % 4 = 2 THEN 1 - toxic ELSE toxic END AS toxic")
    texts = pa.array(["some text", "an idiot and a moron", ""], pa.large_string())
    assert toxicity.fit(docs, labels).scores(texts).tolist() == toxicity.fit(docs, turned).scores(texts).tolist()


@pytest.mark.parametrize("module, label", [(toxicity, "toxic"), (quality, "quality")])
def test_odd_tables(spark, module, label):
    docs = spark.createDataFrame([(1, None, 0.5), (2, "", 0.5), (None, "some words", 0.5), (3, "x" * 100000, 0.5), (3, "x" * 100000, 0.5), (4, "!!! ???", 0.5)], "doc_id long, text string, score double")
    empty = spark.createDataFrame([], f"doc_id long, {label} int")
    one = spark.createDataFrame([(1, 1), (2, 1), (2, None), (None, 0)], f"doc_id long, {label} int")
    both = spark.createDataFrame([(1, 1), (2, 0), (3, 1), (4, 0), (3, 0)], f"doc_id long, {label} int")
    for labels in (empty, one, both):
        rows = toxicity.score_table(docs, module.fit(docs, labels), 4, 2).collect()
        assert len(rows) == 6 and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.score_table(docs.limit(0), module.fit(docs.limit(0), both), 4, 2).collect() == []
