import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from symgraph.llm import packing
from symgraph.llm.tokens import public_tokenizer


@pytest.fixture(scope="module")
def tokenizer():
    found = Tokenizer.from_file(public_tokenizer())
    found.encode_special_tokens = True
    return found


@pytest.mark.parametrize("seed", range(6))
def test_plan_takes_every_piece_and_wastes_little(seed):
    rng = random.Random(seed)
    high = [1024, 300, 1024, 700, 40, 1024][seed]
    counts = Counter(rng.randint(1, high) for _ in range(4000))
    if seed == 2:
        counts[600] += 4000
    plan = packing.match_and_fit(dict(counts), 1024)
    taken = Counter()
    for n, lengths in plan:
        assert n > 0 and sum(lengths) <= 1024 and sum(length > 341 for length in lengths) <= 2
        for length in lengths:
            taken[length] += n
    assert taken == counts
    used, total = sum(n for n, _ in plan), sum(k * v for k, v in counts.items())
    large = sum(v for k, v in counts.items() if k > 512)
    assert used <= max(total / 1024 * 1.02, large * 1.001) + 2


def test_plan_of_nothing_and_of_bad_lengths():
    assert packing.match_and_fit({}, 8) == []
    with pytest.raises(ValueError):
        packing.match_and_fit({9: 1}, 8)


def test_pieces_and_places(spark, tokenizer):
    rng = random.Random(1)
    texts = [None, "", "a", "same text", "same text", "<|endoftext|> x", "é 漢字 \U0001f600"] + [" ".join(rng.choice("alpha beta gamma delta".split()) for _ in range(rng.choice([3, 200, 900, 1023, 1024, 3000]))) for _ in range(150)]
    df = spark.createDataFrame([(i if i else None, t, 7) for i, t in enumerate(texts)], "doc_id long, text string, piece int").repartition(5)
    rows = packing.pack(df, public_tokenizer()).collect()
    of_doc, of_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        of_doc[r.doc_id or 0].append(r)
        of_sequence[r.sequence_id].append(r)
    assert sorted(of_doc) == list(range(len(texts)))
    for i, text in enumerate(texts):
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        pieces = sorted(of_doc[i], key=lambda r: r.piece)
        assert [p.piece for p in pieces] == list(range(-(-len(ids) // 1024)))
        assert sum(p.length for p in pieces) == len(ids) and all(p.length == 1024 for p in pieces[1:])
        for p in pieces:
            assert p.start == sum(q.length for q in pieces[: p.piece])
            assert p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes())
    for own in of_sequence.values():
        at = 0
        for p in sorted(own, key=lambda r: r.offset):
            assert p.offset == at
            at += p.length
        assert at <= 1024
    assert packing.pack(df.limit(0), public_tokenizer()).collect() == []


def test_ids_are_kept_on_request(spark, tokenizer):
    df = spark.createDataFrame([(1, "some words")], "doc_id long, text string")
    (row,) = packing.pack(df, public_tokenizer(), keep_ids=True).collect()
    assert np.frombuffer(row.ids, "<u4").tolist() == tokenizer.encode("some words").ids + [2]
