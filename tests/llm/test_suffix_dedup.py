import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from attesta.llm import suffix_dedup as sd

LOW = -(2**63)


def brute(rows, width=100):
    rows = [(LOW if d is None else d, (t or "").encode()) for d, t in rows]
    first = {}
    for d, t in rows:
        for i in range(len(t) - width + 1):
            key, at = t[i : i + width], (d, i)
            if key not in first or at < first[key]:
                first[key] = at
    out = []
    for d, t in rows:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - width + 1):
            if first[t[i : i + width]] < (d, i):
                gone[i : i + width] = True
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        out.append((d, len(t), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(t, np.uint8)[~gone].tobytes()).hexdigest()))
    return sorted(out)


def found(df, **more):
    return sorted((LOW if r[0] is None else r[0], *r[1:]) for r in map(tuple, sd.digest(sd.remove_repeats(df, **more)).collect()))


def corpus():
    rnd = random.Random(1)
    passages = ["".join(rnd.choice("ab cdé") for _ in range(n)) for n in (99, 100, 101, 150, 300, 1000)]
    rows = []
    for i in range(200):
        parts = [rnd.choice(passages) if rnd.random() < 0.5 else "".join(rnd.choice("xyzé ") for _ in range(rnd.randrange(1, 60))) for _ in range(rnd.randrange(0, 6))]
        rows.append((i, "".join(parts)))
    return rows + [(5, rows[5][1]), (5, rows[7][1]), (None, rows[9][1]), (7, None), (8, ""), (400, "a" * 3000), (401, "ab" * 2000), (402, "a" * 777), (403, passages[4] * 8)]


def test_against_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert found(df) == brute(rows)


def test_spread_triggers_give_the_same(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert found(df, spread=2) == brute(rows)
    assert found(df, local=1) == brute(rows) and found(df, spread=3, local=2) == brute(rows)


def test_many_short_texts_in_a_batch(spark):
    """Over 65,535 rows in one Arrow batch; the long text and its copy are the last ones."""
    rnd = random.Random(2)
    long = "".join(rnd.choice("abcdefgh") for _ in range(500))
    rows = [(i, f"t{i}") for i in range(70_000)] + [(70_000, long), (70_001, "x" + long[:300])]
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100000")
    try:
        got = {r[0]: r[2] for r in found(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1))}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert len(got) == 70_002 and {d: n for d, n in got.items() if n} == {70_001: 300}
    with pytest.raises(ValueError):
        sd.phrases([b"x"] * 70_000)


def test_one_trigger_with_very_many_phrases(spark):
    """A line that 20,000 texts hold, each between other words: what is sent for its triggers
    does not grow with the texts of a chunk."""
    rnd = random.Random(6)
    line = "".join(rnd.choice("abcdefgh ") for _ in range(180))
    rows = [(i, f"{rnd.getrandbits(200):x} {line} {rnd.getrandbits(200):x}") for i in range(20_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert found(df) == brute(rows)
    folder = sd.shared_path(spark, "chunks-test")
    fs, base = sd.filesystem(folder)
    fs.create_dir(base, recursive=True)
    sent = sd.parsed(df.selectExpr("doc_id AS id", "text"), folder, 8).filter(f"kind = {sd.ASK}").collect()
    for r in sent:
        assert np.unique(sd.rows_from(bytes(r.data), sd.PHRASE)["seed"], return_counts=True)[1].max() <= sd.LOCAL
    assert sent


def test_rows_of_one_id_are_ordered_by_start(spark):
    rnd = random.Random(9)
    a, b = ("".join(rnd.choice("abcdefgh") for _ in range(n)) for n in (70, 400))
    rows = [(5, a + b), (5, b), (4, a), (6, b[:150])]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    assert found(df) == brute(rows) and found(df.repartition(4), spread=1) == brute(rows)


def test_odd_rows(odd):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert found(odd) == brute(rows)


def test_empty(empty):
    assert found(empty) == []


def test_long_text_is_parsed_in_pieces(spark):
    rnd = random.Random(3)
    text = "".join(rnd.choice("abcdefgh ") for _ in range(1_300_000))
    rows = [(1, text[:1000] + "#" + text[900_000:1_100_000]), (2, text)]
    got = found(spark.createDataFrame(rows, "doc_id long, text string"))
    assert [r[2] for r in got] == [0, 201_000]
    assert [r[3] for r in got] == [0, 2]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab", max_size=400), max_size=6))
def test_every_string_has_one_trigger(texts):
    """Phrases cover each string of WIDTH bytes once."""
    documents = [t.encode() for t in texts]
    rows = sd.phrases(documents)
    starts = sorted((int(r["doc"]), int(r["lo"]) + k) for r in rows for k in range(int(r["more"]) + 1))
    assert starts == [(d, i) for d, t in enumerate(documents) for i in range(len(t) - sd.WIDTH + 1)]
