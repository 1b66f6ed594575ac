import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from attesta.llm import bpe

PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(PATH), special_tokens={})


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=60))
def test_same_as_the_library(text):
    own = bpe.engine(PATH, P.PATTERN)
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=own.ranks, special_tokens={})
    offsets, ids, raw = own.both_ways([text])
    assert ids.tolist() == lib.encode_ordinary(text)
    assert raw == [text.encode()]


def same(own, library, text):
    return np.frombuffer(own.encode([text])[0], "<i4").tolist() == library.encode_ordinary(text)


def words(rnd, letters, size, total):
    return " ".join("".join(rnd.choices(letters, k=size)) for _ in range(total // size))


AZ, HAN = "abcdefghijklmnopqrstuvwxyz", "漢字日本語文章書読話聞食飲見行来的一是在不了有和人这中大为上个国我以要他"
BASE64 = AZ + AZ.upper() + "0123456789+/"


def test_long_pieces(library):
    own = bpe.engine(PATH, P.PATTERN)
    for text in ("a" * 5000, "ab" * 3000 + "é" * 2000, "!?" * 4000, " " * 3000, "abcde" * 3001, "\n" * 999, "0" * 777, "aab" * 2000 + "x", "=-" * 3000, "é" * 5000):
        assert same(own, library, text)
    for text in ("a" * 700, "the quick brown fox" * 30):  # windows that are joined, and the query over the whole
        assert own.merge([text.encode()]) == own.merge_long([text.encode()])


@pytest.mark.parametrize("letters,size,total", [(AZ, 300, 150_000), ("acgt", 300, 150_000), (AZ, 1000, 150_000), ("acgt", 500, 150_000), (HAN, 120, 50_000), (BASE64, 400, 150_000), ("acgt", 150_000, 150_000)])
def test_distinct_long_words(library, letters, size, total):
    """What the query has to hold is bounded by rows times rounds, however long the words are."""
    assert same(bpe.engine(PATH, P.PATTERN), library, words(random.Random(size), letters, size, total))


def test_megabytes_of_long_words(library):
    rnd = random.Random(9)
    text = "\n".join(words(rnd, letters, size, 1_250_000) for letters, size in ((AZ, 300), ("acgt", 1000), (BASE64, 500), (HAN, 200)))
    assert len(text.encode()) > 5_000_000 and same(bpe.engine(PATH, P.PATTERN), library, text)


@settings(max_examples=40, deadline=None)
@given(st.text(alphabet="abeinrst é漢", min_size=1, max_size=40), st.integers(1, 40), st.integers(1, 9))
def test_windows_give_the_same(piece, times, window):
    own = bpe.engine(PATH, P.PATTERN)
    piece = (piece * times).encode()
    before, bpe.WINDOW = bpe.WINDOW, window
    try:
        assert own.merge_long([piece, piece[::-1]]) == own.merge([piece, piece[::-1]])
    finally:
        bpe.WINDOW = before


def test_rounds_of_a_query_are_bounded(library, monkeypatch):
    monkeypatch.setattr(bpe, "STATE_ROWS", 1)
    assert same(bpe.Engine(PATH, P.PATTERN), library, "unquestionably extraordinary words, again and again; " + words(random.Random(3), AZ, 60, 600))


def test_long_words_are_not_remembered(library):
    own = bpe.Engine(PATH, P.PATTERN)
    assert same(own, library, "short " + "z" * 5000) and set(map(len, own.words)) <= {5, 6}


def test_long_pieces_are_cut_at_barriers(library):
    own = bpe.engine(PATH, P.PATTERN)
    rnd = random.Random(2)
    for letters in (AZ, HAN, "йцукенгшщзхъ", "qxzjkwv", "\U0001f600\U0001f601\U0001f602"):
        text = "".join(rnd.choices(letters, k=6000))
        assert same(own, library, text) and b"".join(own.parts(text.encode())) == text.encode()
    assert own.parts(b"a" * 3000) == [b"a" * 3000]


def test_cache_generations(library, monkeypatch):
    own = bpe.Engine(PATH, P.PATTERN)
    monkeypatch.setattr(bpe, "CACHE_WORDS", 5)
    for k in range(12):
        text = f"wordy{k} repeatedly wordy{k % 3}"
        assert np.frombuffer(own.encode([text])[0], "<i4").tolist() == library.encode_ordinary(text)


def test_tables(odd, empty, library):
    for both in (bpe.roundtrip, lambda d, p, q: bpe.decode(bpe.encode(d, p, q), p, q)):
        rows = bpe.digest(both(odd, PATH, P.PATTERN)).collect()
        got = sorted((r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows)
        want = []
        for r in odd.collect():
            ids = library.encode_ordinary(r.text or "")
            want.append((len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
        assert got == sorted(want)
    assert bpe.roundtrip(empty, PATH, P.PATTERN).collect() == []
