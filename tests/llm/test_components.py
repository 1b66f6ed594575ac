import random

from attesta.llm.components import components


def test_paths_stars_and_loops(spark):
    rnd = random.Random(4)
    chain = [(i, i + 1) for i in range(200)]
    star = [(1000, 1000 + i) for i in range(1, 150)]
    odd = [(5000, 5000), (None, 3), (6001, 6000), (6001, 6000), (6000, 6001)]
    rows = chain + star + odd
    rnd.shuffle(rows)
    got = {r.node: r.component for r in components(spark.createDataFrame(rows, "a long, b long")).collect()}
    want = {i: 0 for i in range(201)} | {1000 + i: 1000 for i in range(150)} | {6000: 6000, 6001: 6000}
    assert got == want


def test_empty(spark):
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
