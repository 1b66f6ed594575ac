import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from attesta.llm import collocations as co
from attesta.llm.words import mixed

LOWER = {c: c + 32 for c in range(65, 91)}


def brute(rows, least=30, top=2000, share=80):
    f, n = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for size in range(1, 5):
                for i in range(len(words) - size + 1):
                    f.setdefault(lang, Counter())[tuple(words[i : i + size])] += 1
    out = []
    for lang, counts in f.items():
        found = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        mostly = set()
        for p, a in found.items():
            for size in range(2, len(p)):
                for i in range(len(p) - size + 1):
                    if 100 * a >= share * counts[p[i : i + size]]:
                        mostly.add(p[i : i + size])
        rows_ = []
        for p, a in found.items():
            if p not in mostly:
                score, k = min((2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k) for k in range(1, len(p)))
                rows_.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(rows_)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def found(df, **more):
    return sorted(tuple(r) for r in co.collocations(df, **more).collect())


def corpus(n=400, seed=1):
    rnd = random.Random(seed)
    common = ["The", "of", "é", "漢", "a", "in", "b'c", "x\x00y", "zzz", "A"]
    fixed = ["new york city", "the United states OF america", "to be or not to be", "la la la la la"]
    rows = []
    for i in range(n):
        words = []
        for _ in range(rnd.randrange(0, 40)):
            words.append(rnd.choice(fixed) if rnd.random() < 0.2 else rnd.choice(common) if rnd.random() < 0.7 else f"w{rnd.randrange(60)}")
            words.append(rnd.choice([" ", "\t", "  ", " ", " ", ". ", ",", "\n", "!", " ? ", "\x0b", "\r"]))
        rows.append((rnd.choice(["en", "en", "de", None, "a\nb"]), "".join(words)))
    return rows + [("en", None), (None, ""), ("fr", "  "), ("en", ".,;"), ("xx", "solo")]


def frame(spark, rows, parts=4):
    return spark.createDataFrame(rows, "lang string, text string").repartition(parts)


@pytest.mark.parametrize("least,top,share", [(30, 2000, 80), (3, 2000, 80), (5, 7, 50)])
def test_against_brute_force(spark, least, top, share):
    rows = corpus()
    assert found(frame(spark, rows), least=least, top=top, share=share) == brute(rows, least, top, share)
    assert brute(rows, least, top, share)


def test_wide_keys_give_the_same(spark):
    rows = corpus(200, 2)
    assert found(frame(spark, rows), least=3, wide=True) == brute(rows, 3)


def test_odd_rows(spark, odd, empty):
    assert found(odd, least=2) == brute([(r.lang, r.text) for r in odd.collect()], 2)
    assert found(empty) == []


def test_equal_batches_count_twice(spark):
    rows = [("en", "one two three four, one two three")] * 3
    df = frame(spark, rows, 1)
    assert found(df.unionByName(df).unionByName(df), least=5) == brute(rows * 3, 5)


def test_chunks_with_equal_numbers_but_other_words(spark):
    rows = [("en", "a b a b"), ("en", "c d c d")]
    df = frame(spark, rows[:1], 1).unionByName(frame(spark, rows[1:], 1))
    assert found(df, least=2) == brute(rows, 2)


def test_a_long_text_in_parts(spark, monkeypatch):
    rnd = random.Random(5)
    text = "".join(rnd.choice(["ab", "cd", "e", "f."]) + rnd.choice([" ", " ", "\n", "\t"]) for _ in range(3000))
    monkeypatch.setattr(co, "buffers", lambda documents: small(documents))

    def small(documents):
        from attesta.llm import recompress

        monkeypatch.setattr(recompress, "BUFFER", 100)
        return recompress.buffers(documents)

    ids, words = co.numbered([b"x y", text.encode(), b"", b"y x"])
    told = " ".join("." if i == 0 else words[i - 1].decode() for i in ids.tolist())
    want = " . ".join(["x y", text.replace("\n", " . ").replace(".", " . "), "", "y x"])
    squeeze = lambda t: [p.split() for p in t.split(".") if p.split()]
    assert squeeze(told) == squeeze(want)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(*[st.integers(0, 2**32 - 1)] * 4), min_size=1, max_size=50), st.booleans(), st.integers(2, 4))
def test_keys_are_kept(rows, wide, n):
    ids = [np.array([r[i] for r in rows], np.uint64) for i in range(n)]
    cols = co.pack(ids, wide)
    assert len(cols) == co.width(n, wide)
    assert [x.tolist() for x in co.unpack(cols, n, wide)] == [x.tolist() for x in ids]
    order = co.radix_order(cols)
    keys = list(zip(*[c.tolist() for c in cols], strict=True))
    assert [keys[i] for i in order.tolist()] == sorted(keys)
    assert (co.unmixed(mixed(cols[0])) == cols[0]).all()


def test_products_beyond_64_bits(spark):
    """Counts of 10**13: scores and comparisons stay exact."""
    a = 10**13
    phrases = spark.createDataFrame([(1, 2, 0, 0, 2, a), (1, 2, 3, 0, 3, a * 8 // 10)], "w1 bigint, w2 bigint, w3 bigint, w4 bigint, size bigint, f bigint")
    phrases = phrases.unionByName(spark.createDataFrame([(2, 3, 0, 0, 2, a + 7)], phrases.schema))
    words = spark.createDataFrame([(1, "en", "x", a + 1), (2, "en", "y", a + 3), (3, "en", "z", 9 * a)], "w1 bigint, lang string, word string, f bigint")
    got = {(r.w1, r.w2, r.w3): (r.l, r.r, r.score) for r in co.scored(phrases, words, 80).collect()}
    big = a * 8 // 10
    assert got[1, 2, 3] == min(((a + 1, a + 7, 2_000_000 * big // (2 * a + 8)), (a, 9 * a, 2_000_000 * big // (10 * a))), key=lambda x: x[2])
    assert (1, 2, 0) not in got and got[2, 3, 0][2] == 2_000_000 * (a + 7) // (10 * a + 3)
