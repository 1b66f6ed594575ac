import hashlib
import random
import re
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from attesta.llm import recompress as rc
from attesta.llm.suffix_dedup import ASK, STRINGS

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, width=35):
    docs = [(d, WORD.findall(t or "")) for d, t in rows]
    seen = Counter(tuple(w[i : i + width]) for _, w in docs for i in range(len(w) - width + 1))
    out = []
    for d, w in docs:
        gone = np.zeros(len(w), bool)
        for i in range(len(w) - width + 1):
            if seen[tuple(w[i : i + width])] > 1:
                gone[i : i + width] = True
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((d, len(w), int(gone.sum()), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def found(df, **more):
    return sorted((tuple(r) for r in rc.digest(rc.remove_repeated_words(df, **more)).collect()), key=str)


def corpus(n=150, seed=1):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdé") for _ in range(rnd.randrange(1, 4)))
    passages = [[word() for _ in range(k)] for k in (34, 35, 36, 50, 90, 300)] + [["la"] * 60, ["x", "y"] * 50, ["p", "q", "r"] * 30]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(rnd.randrange(0, 6)):
            p = rnd.choice(passages) if rnd.random() < 0.5 else [word() for _ in range(rnd.randrange(1, 50))]
            parts += p[rnd.randrange(0, 4) :] if rnd.random() < 0.5 else p
        rows.append((i, "".join(w + rnd.choice([" ", "\n", "  \t"]) for w in parts)))
    return rows + [(5, rows[5][1]), (5, rows[7][1]), (None, rows[9][1]), (7, None), (8, ""), (400, "a " * 3000), (401, "a b " * 2000), (402, "A " * 34), (403, " ".join(passages[4] * 8))]


def test_against_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert found(df) == brute(rows)


def test_parameters_and_marks_give_the_same(spark):
    rows = corpus(80, 2)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for local in (0, 1, 3):
        assert found(df, local=local) == brute(rows)
    assert found(df, rounds=0) == brute(rows) == found(df, rounds=6)
    assert found(df, width=8) == brute(rows, 8)


def test_odd_rows(spark, odd, empty):
    assert found(odd) == brute([(r.doc_id, r.text) for r in odd.collect()])
    assert found(empty) == []


def test_equal_batches_are_documents_of_their_own(spark):
    """Two partitions with the same rows have one chunk in the shared folder."""
    text = " ".join(f"w{i}" for i in range(50))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert found(df.unionByName(df)) == brute([(1, text)] * 2)
    assert found(df) == brute([(1, text)])


def test_long_texts_and_words(spark, monkeypatch):
    monkeypatch.setattr(rc, "PIECE", 300)
    monkeypatch.setattr(rc, "BUFFER", 500)
    rnd = random.Random(4)
    words = [f"w{rnd.randrange(900)}" for _ in range(6000)]
    long = "z" * 6000
    docs = [" ".join(words).encode(), " ".join([*words[100:400], long, "\t", long + "y", *words[3000:3100]]).encode(), b"", b" \n "]
    names, counts = rc.named(docs)
    plain = [w for d in docs for w in WORD.findall(d.decode())]
    assert counts.tolist() == [6000, 402, 0, 0] and len(names) == len(plain)
    assert len(set(zip(names.tolist(), plain, strict=True))) == len(set(plain)) == len(set(names.tolist()))
    rows = rc.phrases(names, counts)
    starts = sorted((r["doc"], r["lo"] + k) for r in rows for k in range(r["more"] + 1))
    assert starts == [(0, i) for i in range(6000 - 34)] + [(1, i) for i in range(402 - 34)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 4), min_size=40, max_size=400), st.integers(0, 5), st.sampled_from([5, 12, 35]))
def test_equal_windows_have_equal_anchors(symbols, rounds, width):
    names = rc.mixed(np.array(symbols * 2, np.uint64))
    anchor, place = rc.anchors(names, width, rounds)
    seen = {}
    for i in range(len(names) - width + 1):
        at = (int(anchor[i]), int(place[i]) - i)
        assert 0 <= at[1] < width and seen.setdefault(names[i : i + width].tobytes(), at) == at


def test_symbols_are_long_and_equal_in_repeats():
    """The method: after three rounds, a passage has the same symbols in other surroundings, of several words each."""
    rnd = random.Random(8)
    passage = [rnd.getrandbits(63) for _ in range(200)]
    kept = []
    for _ in range(2):
        names = np.array([rnd.getrandbits(63) for _ in range(50)] + passage + [rnd.getrandbits(63) for _ in range(50)], np.uint64)
        sym, first, size = names, np.arange(len(names)), np.ones(len(names), np.int64)
        for r in range(3):
            sym, first, size, *_ = rc.next_round(sym, first, size, r)
        assert size.sum() == len(names) and size.mean() > 2
        kept.append({(int(s), int(f)) for s, f in zip(sym, first, strict=True) if 75 <= f < 225})
    assert kept[0] == kept[1]


def test_a_very_common_line(spark):
    """A line in 5,000 texts between other words: what a chunk sends for one anchor is bounded."""
    rnd = random.Random(6)
    line = " ".join(f"line{k}" for k in range(45))
    rows = [(i, " ".join(f"{rnd.getrandbits(40):x}" for _ in range(20)) + f" {line} " + " ".join(f"{rnd.getrandbits(40):x}" for _ in range(20))) for i in range(5000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert found(df) == brute(rows)
    folder = rc.shared_path(spark, "chunks-test")
    fs, base = rc.filesystem(folder)
    fs.create_dir(base, recursive=True)
    sent = rc.parsed(df, folder, 8, 35, 3, 4).collect()
    seeds = [rc.rows_from(bytes(r.data), rc.PHRASE)["seed"] for r in sent if r.kind == ASK]
    chunks = len({r.chunk for r in sent})
    assert max(Counter(np.concatenate(seeds).tolist()).values()) <= 4 * chunks
    assert any(r.kind == STRINGS for r in sent)
