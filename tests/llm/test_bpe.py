import numpy as np
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from scholarlake.llm import bpe as B
from scholarlake.llm import parts

PATH, PATTERN = B.multi_path()
CODER = B.bpe_coder(PATH, PATTERN)
TRUTH = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=CODER.bpe.ranks, special_tokens={})
HARD = ["", " ", "  ", "\n", " a", "a ", "a  b", "a \n b", "a\u00a0b c", "x\x1c y", "don't we'll", "a,b. c!! d***", "1234 56", "日本語 テスト", "é" * 700, "ab" * 4000, "a" * 5000, "=-" * 900 + " end", "<|endoftext|> a", "\u200bz \u3000 q"]


def ids(texts, coder=CODER):
    flat, sizes = coder.encode(pa.array(texts, pa.string()))
    return [x.tolist() for x in np.split(flat, np.cumsum(sizes)[:-1])] if len(sizes) else []


def test_hard_texts():
    got = ids(HARD)
    assert got == [TRUTH.encode_ordinary(x) for x in HARD]
    assert [CODER.bpe.decode(np.array(x)) for x in got if x] == [x.encode() for x in HARD if x]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs", "Cn"]), st.sampled_from(" \n.,'abcé")), max_size=60), max_size=8))
def test_any_texts(texts):
    assert ids(texts) == [TRUTH.encode_ordinary(x) for x in texts]


def test_few_held_parts_give_the_same(monkeypatch):
    monkeypatch.setattr(parts, "HELD", 4)
    coder = B.BpeCoder(CODER.bpe, PATTERN)
    for _ in range(3):
        assert ids(HARD, coder) == [TRUTH.encode_ordinary(x) for x in HARD]


def test_dataframes(frame):
    docs = frame([(1, "hello world"), (2, None), (2, None), (None, "nine lives")])
    out = B.decode_bpe(B.encode_bpe(docs, PATH, PATTERN), PATH)
    for r in out.collect():
        assert bytes(r.decoded).decode() == (r.text or "") and r.ids == TRUTH.encode_ordinary(r.text or "")
    assert out.columns == [*docs.columns, "ids", "decoded"]
    assert B.bpe_digests(frame([]), PATH, PATTERN).collect() == []
    assert B.bpe_digests(docs, PATH, PATTERN).count() == 4


def test_pair_table_finds_all_and_nothing_else():
    rng = np.random.default_rng(0)
    keys = rng.choice(1 << 20, 5000, replace=False)
    left, right = keys >> 10, keys & 1023
    found = B.PairTable(left, right, np.arange(5000))
    assert (found.find(left, right) == np.arange(5000)).all()
    other = np.setdiff1d(np.arange(1 << 20), keys)[:5000]
    assert (found.find(other >> 10, other & 1023) == B._NONE).all()


@pytest.mark.parametrize("n", [B.WIDEST - 1, B.WIDEST, B.WIDEST + 1, 2000])
def test_wide_pieces(n):
    text = ("abc" * n)[:n]
    assert ids([text]) == [TRUTH.encode_ordinary(text)]


def test_long_pieces_of_any_kind():
    r = np.random.default_rng(4)
    long = ["".join(r.choice(list(letters), n)) for n in (257, 300, 1000, 4000) for letters in ("ab", "abcdefghij", "etaoinshrdlu", "\u00e9\u00e8\u4e00", "=-")]
    long += ["a" * n for n in (257, 258, 511)] + ["the" * 400, "zyx" * 333 + "a"]
    assert ids(long) == [TRUTH.encode_ordinary(x) for x in long]


def test_a_vocabulary_out_of_order():
    """Tokens that rank before their own parts: one place at a time, as the library does."""
    ranks = {bytes([b]): 1000 + b for b in range(256)} | {b"abc": 1, b"ab": 5, b"bc": 3, b"ca": 4, b"abcabc": 2, b"aa": 7, b"aaaa": 6}
    own = B.Bpe(ranks)
    truth = tiktoken.Encoding("odd", pat_str=r"(?s).+", mergeable_ranks=ranks, special_tokens={})
    r = np.random.default_rng(1)
    for n in (260, 300, 900):
        for letters in ("abc", "ab", "a"):
            text = "".join(r.choice(list(letters), n))
            assert own.encode_pieces([text.encode()])[0].tolist() == truth.encode_ordinary(text)
