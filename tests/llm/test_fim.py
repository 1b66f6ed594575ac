import hashlib
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from attesta.llm import fim

CUT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute(doc_id, text):
    text = text or ""
    units = CUT.findall(text)
    n = len(units)
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return doc_id, n, "plain", None, None, sha(text), sha(text)
    a, z = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:z]), "".join(units[z:])
    spm = h4 % 100 < 80
    out = f"<S>{suffix}<P>{prefix}<M>{middle}" if spm else f"<P>{prefix}<S>{suffix}<M>{middle}"
    return doc_id, n, "spm" if spm else "psm", len(prefix), len(middle), sha(out), sha(text)


def key(row):
    return str(row)


def corpus():
    rnd = random.Random(3)
    words = ["a", "bb", "<", "<P", "P>", "é漢", "\U0001f600", "<M", "x<S"]
    rows = [(i, "".join(rnd.choice(words) + rnd.choice([" ", "\n", " \t ", ""]) for _ in range(rnd.randrange(0, 900)))) for i in range(150)]
    return rows + [(i, t) for i, t in enumerate(["<P>", "a <S> b", "<M>", "  ", "\n", "one", " lead", "trail \r\n", "\x85 \xa0 word", "a\x00b c"], 1000)]


def test_against_brute_force(spark):
    rows = corpus()
    got = [tuple(r) for r in fim.digest(fim.fill_in_middle(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))).collect()]
    assert sorted(got, key=key) == sorted((brute(*r) for r in rows), key=key)
    assert {r[2] for r in got} == {"plain", "spm", "psm"}


def test_odd_rows(spark, odd, empty):
    got = [tuple(r) for r in fim.digest(fim.fill_in_middle(odd)).collect()]
    assert sorted(got, key=key) == sorted((brute(r.doc_id, r.text) for r in odd.collect()), key=key)
    assert fim.digest(fim.fill_in_middle(empty)).count() == 0


def test_parameters(spark):
    rows = spark.createDataFrame([(i, f"some words of document {i}") for i in range(60)], "doc_id long, text string")
    assert {r.form for r in fim.fill_in_middle(rows, fim_percent=100, spm_percent=0).collect()} == {"psm"}
    assert {r.form for r in fim.fill_in_middle(rows, fim_percent=0).collect()} == {"plain"}
    assert [r.output for r in fim.fill_in_middle(rows, seed=1).collect()] != [r.output for r in fim.fill_in_middle(rows, seed=2).collect()]


@settings(max_examples=150, deadline=None)
@given(st.text("ab <PSM>\n\té", max_size=400).map(lambda t: t * 7), st.integers(0, 3000))
def test_rope_splits(text, rank):
    doc = fim.rope(text)
    units = CUT.findall(text)
    assert (doc.units, doc.chars, str(doc)) == (len(units), len(text), text)
    a, b = fim.split(doc, rank)
    assert str(a) == "".join(units[:rank]) and str(b) == "".join(units[rank:])
    assert a.units == min(rank, len(units)) and b.units == len(units) - a.units
    a, b = fim.split(doc, rank, "chars")
    assert str(a) == text[:rank] and str(b) == text[rank:] and str(fim.concat(a, b)) == text


def test_heights_stay_balanced():
    doc, rnd = fim.rope(" word" * 200_000), random.Random(1)
    for _ in range(200):
        a, b = fim.split(doc, rnd.randrange(doc.units + 1))
        doc = fim.concat(b, a)
    assert doc.units == 200_000 and doc.height <= 40


def test_long_runs_take_linear_time():
    assert fim.rope(" " * 3_000_000).units == 1
    assert fim.rope("x" * 3_000_000 + " " * 3_000_000).units == 2
    text = "w " * 2_000_000
    form, out, prefix, middle = fim.transform(fim.rope(text), False, [999_999, 1_500_000, 0, 0])
    assert form == "spm" and str(fim.restore(str(out), form)) == text
    with pytest.raises(ValueError):
        fim.restore("<S>no other sentinel", "spm")
