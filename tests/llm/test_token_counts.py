import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from symgraph.llm import token_counts
from symgraph.llm.queries import op2_token_counts
from symgraph.llm.tokens import public_tokenizer


@pytest.mark.parametrize("group", [1, 2, 1024])
def test_scan_stitches_blocks(spark, monkeypatch, group):
    monkeypatch.setattr(token_counts, "GROUP_BLOCKS", group)
    rng = random.Random(group)
    rows, want = [], []
    for stream in range(5):
        lengths = [rng.choice([0, 0, 1, 3, 7, 8, 40]) for _ in range(30)] if stream else [50]
        tokens = [x for n in lengths for x in [*([5] * n), 9]]
        if stream in (0, 3):
            tokens, lengths = [*tokens, 5, 5], [*lengths, 2]
        for b in range(0, len(tokens), 8):
            rows.append((stream, b // 8, bytearray(np.array(tokens[b : b + 8], "<u2").tobytes())))
        want += [(stream, k, n, not (stream in (0, 3) and k == len(lengths) - 1)) for k, n in enumerate(lengths)]
    rng.shuffle(rows)
    blocks = spark.createDataFrame(rows, "stream long, block long, tokens binary")
    got = token_counts.count_tokens(blocks, 9, block_tokens=8).select("stream", "ordinal", "n_tokens", "closed").collect()
    assert sorted(map(tuple, got)) == sorted(want)
    assert token_counts.count_tokens(blocks.limit(0), 9).collect() == []


def test_flat_files(spark, tmp_path):
    tokens = np.array([1, 2, 9, 9, 3, 4, 5, 9, 6] * 50, "<u2")
    tokens.tofile(tmp_path / "a.bin")
    (tmp_path / "empty.bin").touch()
    blocks = token_counts.read_flat_files(token_counts.flat_files(spark, str(tmp_path)), block_tokens=16)
    got = [r.n_tokens for r in token_counts.count_tokens(blocks, 9, block_tokens=16).orderBy("ordinal").collect()]
    assert got == [2, 0, 3] + [3, 0, 3] * 49 + [1]


def test_query_equals_brute_force(spark, tmp_path, monkeypatch):
    texts = [None, "", "one", "<|endoftext|> in a text", "é 漢字", "word " * 5000, "one"]
    spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, stream string").write.parquet(str(tmp_path / "documents.parquet"))
    tokenizer = Tokenizer.from_file(public_tokenizer())
    tokenizer.encode_special_tokens = True
    got = {r.doc_id: r.n_tokens for r in op2_token_counts(spark, str(tmp_path)).collect()}
    assert got == {i: len(tokenizer.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(texts)}


def test_files_hold_ids_alone_and_ids_must_fit(spark, tmp_path):
    docs = spark.createDataFrame([(1, "some words"), (None, "others"), (1, None)], "doc_id long, text string").repartition(1)
    order = token_counts.write_flat_files(docs, public_tokenizer(), 50256, str(tmp_path / "flat")).collect()
    (name,) = {r.stream for r in order}
    library = Tokenizer.from_file(public_tokenizer())
    want = {text: [*library.encode(text or "").ids, 50256] for text in ("some words", "others", None)}
    tokens = np.fromfile(tmp_path / "flat" / name, "<u2").tolist()
    assert len(tokens) == sum(map(len, want.values())) and [r.ordinal for r in order] == [0, 1, 2]
    with pytest.raises(Exception, match="does not fit"):
        token_counts.write_flat_files(docs, public_tokenizer(), 70000, str(tmp_path / "small")).collect()
    assert len(token_counts.write_flat_files(docs, public_tokenizer(), 70000, str(tmp_path / "wide"), dtype="<u4").collect()) == 3


def test_query_on_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert op2_token_counts(spark, str(tmp_path)).collect() == []
