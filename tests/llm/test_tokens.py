import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from symgraph.llm import tokens
from symgraph.llm.tokens import public_tokenizer, token_ids

ODD = [
    "", None, "a", "'s", "don't we'll I'd 'stop' !'s x'S", "a  b   c\n\nd \n e\t\tf  ", "  ", "\n", "x\n", " x", "  x 12 a1b2 ...!! é ñ Œ ß", "漢字 x", "a²b ½", "\x00a",
    "a\x0bb", "<|endoftext|> x", "‘q’", "x'd'll're", "1's 's\n't \t'm", "×÷ é×", "ƻ Ɏ ɏ ɐ", "word " * 30000, " x  y", "\x1c\x1f", "a\r\n\r\nb", "''s '' 'll'", "x'", "x'r", "x 're",
]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_equal_the_library(name):
    path = public_tokenizer(name)
    library = Tokenizer.from_file(path)
    library.encode_special_tokens = True
    want = [library.encode(t or "", add_special_tokens=False).ids + [7] for t in ODD]
    for _ in range(2):  # the second time every pre-token is known
        assert [x.tolist() for x in token_ids(pa.array(ODD, pa.large_string()), path, 7)] == want


def test_a_full_table_starts_anew(monkeypatch):
    path = public_tokenizer()
    tokens._encoder.cache_clear()
    monkeypatch.setattr(tokens, "_MOST_IDS", 10)
    monkeypatch.setattr(tokens, "_SLOT_BITS", 3)
    library = Tokenizer.from_file(path)
    for text in ("some words and more words " * 20, "others follow here", "some words"):
        (got,) = token_ids(pa.array([text]), path, 0)
        assert got.tolist() == library.encode(text).ids + [0]
    tokens._encoder.cache_clear()


def test_few_words_are_encoded_or_split_again(monkeypatch):
    tokens._encoder.cache_clear()
    monkeypatch.setattr(tokens, "_SLOT_BITS", 10)
    words = [f"word{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(300)]  # with 1,024 slots to share
    path, encoded, split = public_tokenizer(), [], []
    for word in words:
        list(token_ids(pa.array([word]), path, 0))
    encode, pretokens = tokens._Encoder._encode_new, tokens.pretokens
    monkeypatch.setattr(tokens._Encoder, "_encode_new", lambda self, new: encoded.extend(new) or encode(self, new))
    monkeypatch.setattr(tokens, "pretokens", lambda texts: split.append(texts) or pretokens(texts))
    library = Tokenizer.from_file(path)
    assert [x.tolist() for x in token_ids(pa.array(words), path, 0)] == [[*library.encode(w).ids, 0] for w in words]
    assert len(encoded) < 20 and len(split) == 1
    tokens._encoder.cache_clear()


def thue_morse(letters):
    """Two words of 1,024 letters that every polynomial modulo 2**64 takes for one."""
    bits = [bin(k).count("1") % 2 for k in range(1024)]
    return "".join(letters[b] for b in bits), "".join(letters[1 - b] for b in bits)


def test_words_with_one_polynomial_hash_are_told_apart():
    from symgraph.llm.bytescan import Texts
    from symgraph.llm.decontaminate import terms_of

    words = thue_morse("ab")
    assert len(set(terms_of(Texts.of_list([*words, "x " + words[0]]))[0].tolist())) == 3
    library = Tokenizer.from_file(public_tokenizer())
    assert [x.tolist() for x in token_ids(pa.array([*words, words[0]]), public_tokenizer(), 0)] == [[*library.encode(w).ids, 0] for w in (*words, words[0])]


def test_hashes_are_the_same_wherever_a_word_stands():
    import numpy as np

    from symgraph.llm.bytescan import hashes, prefix_sums

    word = b"a word of some bytes"
    for size in (0, 1, 1 << 20, (1 << 23) + 5, (1 << 24) - 7):
        data = np.frombuffer(b"\xff" * size + word, np.uint8)
        assert hashes(prefix_sums(data), np.array([size]), np.array([len(data)]))[0] == hashes(prefix_sums(np.frombuffer(word, np.uint8)), np.array([0]), np.array([len(word)]))[0]
