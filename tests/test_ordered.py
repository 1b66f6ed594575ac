import random
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from attesta.operators import ordered, passages, progress


def events(spark, n=3000, seed=1):
    """Half of all rows have key 1, some no key."""
    rnd = random.Random(seed)
    rows = [(rnd.choice([1, 1, 1, 1, 2, 3, 4, None]), i, rnd.choice([None, *range(5)]), rnd.choice("abr")) for i in range(n)]
    rnd.shuffle(rows)
    return rows, spark.createDataFrame(rows, "k int, t int, v int, e string").repartition(7)


def expected(rows):
    out = {}
    for _, group in groupby(sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1])), key=lambda r: r[0]):
        total, most, place, runs = None, None, 0, 0
        for _, t, v, e in group:
            total = v if total is None else total if v is None else total + v
            most = v if most is None else most if v is None else max(most, v)
            place, runs = place + 1, runs + (e == "r")
            out[t] = (total, most, place, runs)
    return out


@pytest.mark.parametrize("most", [10**9, 200, 37])
def test_the_same_with_one_key_in_many_parts(spark, most):
    rows, df = events(spark)
    got = ordered.running(df, ["k"], ["t"], most, total=("sum", F.col("v")), high=("max", F.col("v")), place=("sum", F.lit(1)))
    assert got.columns == ["k", "t", "v", "e", "total", "high", "place"]
    want = expected(rows)
    assert {r.t: (r.total, r.high, r.place) for r in got.collect()} == {t: w[:3] for t, w in want.items()}
    runs = progress.with_runs(df, "k", ["t"], F.col("e") == "r", most)
    assert {r.t: r.run for r in runs.collect()} == {t: w[3] for t, w in want.items()}


def test_no_part_has_more_than_its_share(spark):
    rows = spark.range(20_000).select(F.lit(1).alias("k"), (F.col("id") * 7919 % 20_000).alias("t"))
    sizes = [r["count"] for r in ordered.parts(rows, ["k"], ["t"], 20).groupBy("__part").count().collect()]
    assert len(sizes) == 20 and max(sizes) < 2000
    last = ordered.place(rows, ["k"], ["t"], "n", 1000).agg(F.max("n"), F.sum((F.col("n") == F.col("t") + 1).cast("int"))).first()
    assert tuple(last) == (20_000, 20_000)


def test_without_keys_and_without_rows(spark):
    _, df = events(spark, 500)
    every = ordered.place(df, [], ["t"], "n", 100).collect()
    assert all(r.n == r.t + 1 for r in every) and len(every) == 500
    assert ordered.place(df.limit(0), ["k"], ["t"], "n").count() == 0 and ordered.place(df.limit(0), [], ["t"], "n", 1).count() == 0


def test_sequences_and_ordinals_of_a_large_key(spark):
    rows = [(1, i, i) for i in range(1, 1001)] + [(2, i, i if i != 700 else 701) for i in range(1, 1001)] + [(3, 1, None), (4, 1, 2)]
    df = spark.createDataFrame(rows, "k int, pos int, n int")
    for most in (10**9, 100):
        assert {r.k: r.sequential for r in passages.sequential(df, ["k"], "n", "pos", most).collect()} == {1: True, 2: False, 3: False, 4: False}
    given = df.withColumn("n", F.when(F.col("pos") % 2 == 0, F.col("n")))
    assert {(r.k, r.pos): r.n for r in passages.with_ordinals(given, ["k"], "n", ["pos"], 100).filter("k < 3").collect()} == {(k, i): (i if (k, i) != (2, 700) else 701) for k in (1, 2) for i in range(1, 1001)}


def test_islands(spark):
    df = spark.createDataFrame([("a", n) for n in (1, 2, 3, 3, 7, 9, 10)] + [("b", -1), ("b", 0), ("b", None), (None, 5)], "k string, n int")
    for most in (10**9, 2):
        got = {(r.k, r.first, r.last, r.size) for r in ordered.islands(df, ["k"], "n", most).collect()}
        assert got == {("a", 1, 3, 3), ("a", 7, 7, 1), ("a", 9, 10, 2), ("b", -1, 0, 2), (None, 5, 5, 1)}


def test_first_answers(spark):
    df = spark.createDataFrame([(1, "x", 3, "late"), (1, "x", 2, "first"), (1, "y", 9, None), (None, "x", 1, "n")], "u int, q string, t int, a string")
    got = progress.first_answers(df, ["u", "q"], ["t"])
    assert got.columns == df.columns and {tuple(r) for r in got.collect()} == {(1, "x", 2, "first"), (1, "y", 9, None), (None, "x", 1, "n")}


@pytest.mark.parametrize("short", [0, 3, 1000])
def test_passages_by_blocks(spark, short):
    rnd = random.Random(3)
    verses = [(k, n, rnd.choice(["", "w", None, "long text é"])) for k in ("a", "b") for n in range(-20, 300) if rnd.random() < 0.8]
    ranges = [(i, rnd.choice("ab"), a, a + rnd.choice([-1, 0, 1, 2, 7, 63, 100, 255])) for i, a in enumerate(rnd.choices(range(-25, 290), k=80))] + [(900, "a", None, 3), (901, "none", 1, 70)]
    known = {(k, n): t or "" for k, n, t in verses}
    want = {}
    for i, k, a, z in ranges:
        ns = list(range(a, z + 1)) if a is not None else []
        want[i] = (" ".join(known.get((k, n), "") for n in ns), all((k, n) in known for n in ns), len(ns), sum((k, n) in known for n in ns))
    df = passages.passages(
        spark.createDataFrame(ranges, "id int, book string, verse_start int, verse_end int"), spark.createDataFrame(verses, "book string, verse_number int, text string"), ["book"], short=short
    )
    assert {r.id: (r.passage, r.found, r.size, r.n_found) for r in df.collect()} == want


def test_ranges_of_a_million(spark):
    """Ranges of 10**6 numbers are about forty rows each, over sparse verses."""
    size = 10**6
    at = spark.range(1).select(F.size(passages.blocks(F.lit(3), F.lit(size + 2), 32)).alias("n"), F.size(passages.blocks(F.lit(1 << 20), F.lit((2 << 20) - 1), 32)).alias("one")).first()
    assert at.n <= 40 and at.one == 1
    verses = spark.createDataFrame([("g", n, f"t{n}") for n in (1, 5, 6, size // 2, size, size + 1)], "book string, verse_number int, text string")
    ranges = spark.createDataFrame([(1, "g", 1, size), (2, "g", 6, size + 1), (3, "none", 1, size)], "id int, book string, verse_start int, verse_end int")
    got = {r.id: r for r in passages.passages(ranges, verses, ["book"]).collect()}
    assert (got[1].size, got[1].n_found, got[1].found) == (size, 5, False)
    assert got[1].passage == "t1" + " " * 4 + "t5 t6" + " " * (size // 2 - 6) + f"t{size // 2}" + " " * (size // 2) + f"t{size}"
    assert got[2].passage.startswith("t6 ") and got[2].passage.endswith(f"t{size} t{size + 1}") and got[3].passage == " " * (size - 1)
