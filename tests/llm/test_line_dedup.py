import random
import re

import numpy as np

from symgraph.llm import line_dedup
from symgraph.llm.bytescan import _mix, hashes, prefix_sums
from symgraph.llm.line_dedup import remove_repeated

VOCABULARY = [f"word{i}" for i in range(4000)]


def sentences(rng, n, words=9):
    return [" ".join(rng.choice(VOCABULARY) for _ in range(words)) + "." for _ in range(n)]


def clean(spark, rows, schema="doc_id long, text string, n_removed string"):
    return {(r.doc_id, k): r for k, r in enumerate(sorted(remove_repeated(spark.createDataFrame(rows, schema), removed="n_gone").collect(), key=str))}


def test_repeated_passages_go_and_the_first_stays(spark):
    rng = random.Random(1)
    passage = sentences(rng, 8)
    rows, own = [], {}
    for doc in range(30):
        before, after = sentences(rng, 5), sentences(rng, 5)
        own[doc] = before + after
        joint = "\n" if doc % 2 else " "
        rows.append((doc, joint.join(before) + "\n" + "\n".join(passage) + "\n" + joint.join(after), "x"))
    got = {r.doc_id: r for r in remove_repeated(spark.createDataFrame(rows, "doc_id long, text string, x string")).collect()}
    assert got[0].text == rows[0][1] and got[0].n_removed == 0
    for doc in range(1, 30):
        left = [p for p in passage if p in got[doc].text]
        assert len(left) <= 2, left  # the chunks at the edges may hold lines of the document's own
        assert all(s in got[doc].text for s in own[doc])


def test_a_long_line_is_a_chunk(spark):
    rng = random.Random(2)
    line = sentences(rng, 1, 60)[0]
    rows = [(d, "\n".join([*sentences(rng, 2), line, *sentences(rng, 2)]), "x") for d in range(5)]
    got = remove_repeated(spark.createDataFrame(rows, "doc_id long, text string, x string")).collect()
    assert [line in r.text for r in sorted(got)] == [True] + [False] * 4


def test_clean_texts_stay_byte_for_byte(spark):
    rng = random.Random(3)
    texts = [None, "", "\n\n", "Of. The. In.", "Of. The. In.", "  a\n\n b. c\t\n", *("  \n".join(sentences(rng, 6)) + "\n\n" for _ in range(40)), " ".join(sentences(rng, 4000))]
    rows = [(i, t, "x") for i, t in enumerate(texts)]
    got = remove_repeated(spark.createDataFrame(rows, "doc_id long, text string, x string")).collect()
    assert sorted((r.doc_id, r.text, r.n_removed) for r in got if r.text is not None) == [(i, t, 0) for i, t in enumerate(texts) if t is not None]


def test_copies_repeated_rows_and_null_ids(spark):
    rng = random.Random(4)
    a, b, c = ("\n".join(sentences(rng, 6)) for _ in range(3))
    rows = [(3, a), (1, a), (1, a), (None, a), (None, b), (None, b), (5, c + "\n" + c)]
    got = sorted(((r.doc_id, r.text) for r in remove_repeated(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    short = next(t for i, t in got if i == 5)
    assert len(short) < len(c) * 2 and short.startswith(c)  # all but the chunks where the two meet
    assert sorted((x for x in got if x[0] != 5), key=str) == sorted([(3, ""), (1, a), (1, a), (None, ""), (None, b), (None, b)], key=str)


def test_empty_table(spark):
    assert remove_repeated(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_equal_keys_of_different_bytes_remove_nothing(spark):
    rng = random.Random(5)
    rows = [(d, "\n".join(sentences(rng, 5))) for d in range(6)]
    same_hash = lambda sums, starts, stops: starts.astype("u8") * 0 + 7
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted((r.doc_id, r.text) for r in remove_repeated(docs, hashes=same_hash).collect()) == rows
    assert sorted((r.doc_id, r.text) for r in remove_repeated(docs, hashes=same_hash, digest=lambda data: b"12345678").collect()) == rows


def words_of(line):
    blank = " \t\n\v\f\r"
    n = sum(c not in blank and (k == 0 or line[k - 1] in blank) for k, c in enumerate(line))
    return n + sum("\u3000" <= c <= "\udfff" for c in line) // 2


def plain(rows):
    """What goes of (id, text) rows, by loops over lines and by the bytes themselves."""
    cut = []
    for _, text in rows:
        data = (text or "").encode()
        spans, at = [], 0
        for m in [*re.finditer(rb"\n|(?<=[!.?]) ", data), None]:
            end = m.start() if m else len(data)
            if end > at:
                spans.append((at, end))
            at = m.end() if m else at
        lines = [data[a:b] for a, b in spans]
        words = [words_of(x.decode(errors="replace")) for x in lines]
        number = [int(hashes(prefix_sums(np.frombuffer(x, np.uint8)), np.array([0]), np.array([len(x)]))[0]) for x in lines]
        ends = []
        for k in range(len(lines)):
            rolled = int(_mix(np.array([((number[k - 1] if k else 0) * 0x9E3779B97F4A7C15 + number[k]) % 2**64], np.uint64))[0])
            ends.append(rolled % 2 == 0 or words[k] >= 50 or k + 1 == len(lines) or words[k + 1] >= 50)
        chunks, first = [], 0
        for k, e in enumerate(ends):
            if e:
                chunks.append((first, k))
                first = k + 1
        size = lambda c: sum(words[c[0] : c[1] + 1])
        raw = lambda a, b, data=data, spans=spans: data[spans[a][0] : spans[b][1]]
        found = []
        for k, c in enumerate(chunks):
            if size(c) >= 10:
                found.append(("full", raw(*c), c))
            else:
                if k and size(chunks[k - 1]) + size(c) >= 10:
                    found.append(("left", raw(chunks[k - 1][0], c[1]), c))
                if k + 1 < len(chunks) and size(chunks[k + 1]) + size(c) >= 10:
                    found.append(("right", raw(c[0], chunks[k + 1][1]), c))
        runs = set()
        for k in range(len(lines)):
            runs |= {(k, e) for e in [next((e for e in range(k, len(lines)) if sum(words[k : e + 1]) >= 50), k)] if e > k}
            runs |= {(b, k) for b in [next((b for b in range(k, -1, -1) if sum(words[b : k + 1]) >= 50), k)] if b < k}
        cut.append((spans, found + [("run", raw(*r), r) for r in sorted(runs)]))
    least = {}
    for (doc, _), (_, found) in zip(rows, cut, strict=True):
        for kind, data, _ in found:
            if doc is not None:
                least[kind, data] = min(doc, least.get((kind, data), doc))
    out = []
    for (doc, text), (spans, found) in zip(rows, cut, strict=True):
        gone, seen = set(), set()
        for kind, data, (a, b) in sorted(found, key=lambda x: (x[0] == "run", x[2])):
            if (kind, data) in seen or (kind, data) in least and least[kind, data] != doc:
                gone |= set(range(a, b + 1))
            seen.add((kind, data))
        data = (text or "").encode()
        starts = [a for a, _ in spans] + [len(data)]
        kept = data[: starts[0]] + b"".join(data[starts[k] : starts[k + 1]] for k in range(len(spans)) if k not in gone)
        kept = kept.decode()
        out.append((doc, None if text is None else kept.rstrip(" \n") if spans and len(spans) - 1 in gone else kept, len(gone)))
    return out


def test_equals_a_plain_version(spark):
    rng = random.Random(8)
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    some = [sentences(rng, 1, rng.choice([1, 2, 4, 9, 30, 60]))[0] for _ in range(60)] + ["漢字が続く長い文章です" * 6, "日本語"]
    made = [(rng.choice([None, *range(1000, 1080)]), rng.choice(["\n", " ", "\n\n"]).join(rng.choices(some, k=rng.randint(0, 12)))) for _ in range(150)]
    rows = docs + list(dict(made).items()) + [(5000, None), (5001, "")]
    got = remove_repeated(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert sorted(((r.doc_id, r.text, r.n_removed) for r in got), key=str) == sorted(plain(rows), key=str)


def test_columns_with_names_of_ours(spark):
    text = " ".join(f"w{i}" for i in range(70))
    rows = [(1, text, "a", 9, 8, 7), (2, text, "b", 6, 5, 4)]
    got = remove_repeated(spark.createDataFrame(rows, "doc_id long, text string, n_removed string, __print long, __pieces long, id long")).collect()
    assert got[0].asDict().keys() == {"doc_id", "text", "__print", "__pieces", "id", "n_removed"}
    assert sorted((r.doc_id, r.text, r.n_removed, r["__print"], r["__pieces"], r.id) for r in got) == [(1, text, 0, 9, 8, 7), (2, "", 1, 6, 5, 4)]


def test_a_hot_passage_in_most_documents(spark):
    rng = random.Random(9)
    passage = "\n".join(sentences(rng, 8))
    own = [sentences(rng, 1, 12)[0] for _ in range(400)]
    rows = [(d, passage + "\n" + own[d]) for d in range(400)]
    got = remove_repeated(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)).collect()
    assert sorted((r.doc_id, r.text) for r in got) == [rows[0], *((d, own[d]) for d in range(1, 400))]


def test_a_very_long_text(spark):
    rng = random.Random(10)
    long = "\n".join(sentences(rng, 20000))  # over a megabyte
    got = remove_repeated(spark.createDataFrame([(1, long), (2, "x y\n" + long)], "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.text) for r in got) == [(1, long), (2, "x y")]


def test_passages_of_few_lines_go_whole(spark):
    rng = random.Random(6)
    for lines, words in [(2, 26), (3, 20), (4, 14), (5, 12), (6, 10), (6, [30, 1, 2, 30, 1, 1])]:
        rows, kept = [], []
        for k in range(40):
            passage = [sentences(rng, 1, w)[0] for w in (words if isinstance(words, list) else [words] * lines)]
            for half in range(2):
                joint = " " if k % 2 else "\n"
                before, after = sentences(rng, 4), sentences(rng, 4)
                rows.append((2 * k + half, joint.join([*before, *passage, *after]), "x"))
                kept.append(joint.join([*before, *after]) if half else rows[-1][1])
        got = remove_repeated(spark.createDataFrame(rows, "doc_id long, text string, x string")).collect()
        assert [r.text for r in sorted(got)] == kept
        assert {r.n_removed for r in got} == {0, lines}


def test_a_text_that_repeats_itself_keeps_one_round(spark):
    rng = random.Random(7)
    part = sentences(rng, 7)
    rows = [(1, "\n".join(part * 9), "x")]
    assert remove_repeated(spark.createDataFrame(rows, "doc_id long, text string, x string")).collect()[0].text == "\n".join(part)


def made(seed, words=60):
    rng = random.Random(seed)
    some = sentences(rng, 30) + sentences(rng, 10, words)
    return [(d, "\n".join(rng.choices(some, k=rng.randint(2, 14)) + sentences(rng, 2))) for d in range(60)] + [(None, "\n".join(some[:9]))]


def test_runs_with_equal_keys_and_different_bytes_stay(spark):
    rng = random.Random(11)
    rows = [(d, "\n".join(sentences(rng, 9))) for d in range(6)]  # over 50 words, so there are runs
    same_hash = lambda sums, starts, stops: starts.astype("u8") * 0 + 7
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted((r.doc_id, r.text) for r in remove_repeated(docs, hashes=same_hash, digest=lambda data: b"12345678").collect()) == rows


def test_equal_hashes_of_long_spans_lose_nothing(spark):
    weak = lambda sums, starts, stops: np.where(stops - starts > 300, np.uint64(7), hashes(sums, starts, stops))
    rows = made(12, 20)  # each line is shorter than that
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = sorted(plain(rows), key=str)
    assert sorted(((r.doc_id, r.text, r.n_removed) for r in remove_repeated(docs, hashes=weak).collect()), key=str) == want
    most = {d: n for d, _, n in want}
    assert all(r.n_removed <= most[r.doc_id] for r in remove_repeated(docs, hashes=weak, digest=lambda data: b"12345678").collect())


def test_rare_and_hot_pieces_alike(spark, monkeypatch):
    rows = made(13)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for share in (1, 60, 1 << 40):  # none, some, all
        monkeypatch.setattr(line_dedup, "HOT_SHARE", share)
        assert sorted(((r.doc_id, r.text, r.n_removed) for r in remove_repeated(docs).collect()), key=str) == sorted(plain(rows), key=str)


def test_blocks_cover_passages_and_are_few(spark):
    rng = random.Random(14)
    rows = [(k, k, 2 * k, 7 * k, 0, 9, a, b - a) for k in range(400) for a, b in [sorted(rng.sample(range(0, 8000, 80), 2))]]
    passages = spark.createDataFrame(rows, "passage long, id long, print long, start int, first_id long, first_print long, first_start int, length int")
    blocks = line_dedup._blocks(passages).collect()
    for k, _, _, start, _, _, first, length in rows:
        own = sorted((b.start, b.first_start, b.length) for b in blocks if b.passage == k)
        assert own[0][:2] == (start, first) and sum(n for *_, n in own) == length
        assert all((a[0] + a[2], a[1] + a[2]) == b[:2] for a, b in zip(own, own[1:], strict=False))
    sent = {b.span: b.length for b in blocks}
    assert sum(sent.values()) < 30 * 8000 < sum(r[-1] for r in rows) / 3  # each edge at most once, not each passage


def test_near_copies_of_a_long_text(spark):
    rng = random.Random(15)
    text = sentences(rng, 60)
    rows = [(d, "\n".join([*sentences(rng, 1), *text[rng.randrange(20) : rng.randrange(30, 60)], *sentences(rng, 1)])) for d in range(50)] + [(50, "\n".join(text))]
    got = remove_repeated(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert sorted((r.doc_id, r.text, r.n_removed) for r in got) == sorted(plain(rows))


def test_sums_are_made_in_blocks():
    import tracemalloc

    from symgraph.llm.bytescan import _tables, prefix_sums

    data = np.resize(np.arange(256, dtype=np.uint8), 1 << 22)
    _tables(len(data) + 1)
    tracemalloc.start()
    sums = prefix_sums(data)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < sums.nbytes + (1 << 21)  # nothing else as long as the text
    few = prefix_sums(data[:70000])
    assert (sums[0, : few.shape[1]] == few[0]).all() and ((sums[1, : few.shape[1]] - few[1]) % ((1 << 31) - 1) == 0).all()
