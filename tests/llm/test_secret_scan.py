import base64
import bz2
import gzip
import hashlib
import re
import urllib.parse
import zlib

import pytest

from symgraph.llm import secret_scan

SECRET = 'token = "abcdefghij1234"'


def brute_base(text):
    found = []
    for order, (pattern, group, least) in enumerate([(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8), (r"AKIA[A-Z0-9]+", 0, 16), (r"[0-9a-f]+", 0, 32)]):
        for m in re.finditer(pattern, text, re.I | re.A if order == 0 else 0):
            if len(m[group]) >= least:
                found.append((m.start(), order, m.end()))
    return sorted(found)


@pytest.mark.parametrize(
    "wrap",
    [
        lambda s: s,
        urllib.parse.quote,
        lambda s: "".join(f"\\u{ord(c):04x}" for c in s),
        lambda s: "".join(f"&#x{ord(c):x};" for c in s),
        lambda s: base64.b64encode(s.encode()).decode(),
        lambda s: base64.urlsafe_b64encode(s.encode()).decode().rstrip("="),
        lambda s: base64.b64encode(gzip.compress(s.encode())).decode(),
        lambda s: base64.b64encode(bz2.compress(zlib.compress(s.encode()))).decode(),
        lambda s: urllib.parse.quote(base64.b64encode(base64.b64encode(zlib.compress(urllib.parse.quote(s).encode()))).decode()),
        lambda s: "".join(f"%{b:02X}" for b in gzip.compress(s.encode())),
    ],
)
def test_layers_are_unwrapped_and_mapped(wrap):
    inner = wrap(SECRET)
    text = f"é before {inner} after"
    spans, _ = secret_scan.all_spans(text)
    (start, kind, end), = [s for s in spans if s[1] == 0]
    assert kind == 0 and 9 <= start < 9 + 6 and 9 + len(inner) - 8 <= end <= 9 + len(inner)
    assert start == 9 or inner != SECRET


def test_cycles_end():
    text = base64.b64encode(b"a" * 30).decode()
    for _ in range(6):
        text = base64.b64encode(text.encode()).decode()
    assert secret_scan.all_spans(text)[1] >= 7


def test_query_equals_brute_force(spark):
    texts = [None, "", SECRET, "API_KEY:'xx' passwd=12345678 AKIA12 AKIA1234567890ABCD", "f" * 31 + " " + "0a" * 16 + "g", "x" * 50000 + " secret: aaaaaaaa", SECRET, "ſecret=abcdefgh12 toKen=abcdefgh12"]
    df = spark.createDataFrame([(i if i != 4 else None, t, i) for i, t in enumerate(texts)], "doc_id long, text string, n_hex long")
    rows = secret_scan.scan_secrets(df).collect()
    assert len(rows) == len(texts)
    for row, text in zip(rows, texts):
        base = brute_base(text or "")
        joined = ",".join(f"{secret_scan.KINDS[k]}:{s}:{e}" for s, k, e in base)
        assert [row.n_assign, row.n_access, row.n_hex] == [sum(k == j for _, k, _ in base) for j in range(3)]
        assert row.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert set(filter(None, joined.split(","))) <= set(row.spans.split(","))
    assert secret_scan.scan_secrets(df.limit(0)).collect() == []


def _kinds(data):
    return [s[1] for s in secret_scan.all_spans("x " + base64.b64encode(data).decode() + " y")[0]]


@pytest.mark.parametrize("odd", ["\0", "\x1b", "\f", "\xa0", "​", "﻿", b"\xff", b"\xe2\x82"])
def test_one_odd_character_keeps_the_layer(odd):
    odd = odd if isinstance(odd, bytes) else odd.encode()
    data = b"host = example\n" + odd + b" " + SECRET.encode() + b"\nport = 80\n"
    assert _kinds(data) == [0] and _kinds(gzip.compress(data)) == [0]
    run = "".join(f"%{b:02X}" for b in data)
    at = 3 * data.index(b"token")
    assert [s for s in secret_scan.all_spans(run)[0] if s[1] == 0] == [(at, 0, at + 3 * (len(SECRET) - 1))]


@pytest.mark.parametrize("pack", [gzip.compress, bz2.compress])
def test_later_members_and_windows(pack, monkeypatch):
    assert _kinds(pack(b"first member, " * 3) + pack(SECRET.encode())) == [0]
    monkeypatch.setattr(secret_scan, "WINDOW", 4096, raising=False)
    monkeypatch.setattr(secret_scan, "OVERLAP", 256, raising=False)
    monkeypatch.setattr(secret_scan, "MAX_EXPANDED", 4096, raising=False)
    for lead in range(4060, 4100, 7):
        assert _kinds(pack("é".encode() * (lead // 2) + b" " + SECRET.encode() + b" " * 9000)) == [0]
