import json

from attesta.operators import passages as ps


def verses(tree):
    return [(0, v["text"]) for v in ps.verse_nodes(json.dumps(tree))]


def test_numbers_under_each_key(spark):
    cases = [({"text": "a", key: value}, n) for key in ps.NUMBER_KEYS for value, n in ((7, 7), ("1:8", 8), (" 9 ", 9), ("x9", 1), (0, 1), (-3, 1), ("v.0", 1))]
    cases += [({"text": "a", key: value}, n) for key in ps.REFERENCE_KEYS for value, n in (("Gen 1:9", 9), ("9", 1), ("g.12 ", 12), (4, 1), ("\u00a07", 7), ("a\u00a07", 7))]
    cases += [({"text": "a", "verse": True}, 1), ({"text": "a", "verse": 2.0}, 1), ({"text": "a", "id": "x.2", "number": 5, "verse": "none"}, 5), ({"text": "a", "verse": "9" * 30, "ref": "r 3"}, 3)]
    df = spark.createDataFrame([(i, json.dumps(tree)) for i, (tree, _) in enumerate(cases)], "k int, payload string")
    assert {r.k: r.verse_number for r in ps.extract_verses(df, "k").collect()} == {i: n for i, (_, n) in enumerate(cases)}


def test_zero_differs_between_the_two_walks(spark):
    tree = [{"text": "x"}, {"text": "a", "reference": "Gen 1:0", "id": "g.5"}]
    df = spark.createDataFrame([(1, json.dumps(tree))], "k int, payload string")
    assert [r.verse_number for r in ps.extract_verses(df, "k").orderBy("pos").collect()] == [1, 5]
    assert [r.verse_number for r in ps.extract_verses(df, "k", strict_zero=False).orderBy("pos").collect()] == [1, 2]


def test_parents_come_first_and_keys_keep_their_order():
    tree = {"z": {"text": "1", "b": [{"text": "2"}, {"text": "3"}]}, "a": {"text": " 4 "}, "text": "0"}
    assert [t for _, t in verses(tree)] == ["0", "1", "2", "3", "4"]


def test_blank_texts():
    tree = [{"text": " "}, {"text": "ab"}, {"text": 5}, {"other": "x"}]
    assert verses(tree) == [(0, "ab")]
    assert ps.text_nodes(json.dumps(tree)) == (2, 3)


def test_deep_trees_do_not_recurse():
    deep = '{"text":"a","x":' * 900 + "{}" + "}" * 900
    assert len(ps.verse_nodes(deep)) == 900


def test_table(spark):
    rows = [(1, '{"success":false,"text":"a"}'), (2, '[{"text":"b","ref":" R 1:4 "}]'), (3, "no json"), (4, None), (5, "{}")]
    df = spark.createDataFrame(rows, "k int, payload string")
    got = ps.extract_verses(df, "k").collect()
    assert [(r.k, r.pos, r.verse_number, r.text) for r in sorted(got)] == [(1, 1, 1, "a"), (2, 1, 4, "b")]
    flags = {r.k: r.ok for r in df.select("k", ps.succeeded(df.payload).alias("ok")).collect()}
    assert flags == {1: False, 2: True, 3: True, 4: True, 5: True}


def test_candidates(spark):
    df = spark.createDataFrame([("Gen", 1, 4, " R 1:4 "), ("Gen", 1, 5, " "), ("Gen", 1, 6, None)], "book string, chapter int, verse_number int, reference_from_api string")
    rows = ps.candidates(df).collect()
    assert [r.reference for r in rows] == ["R 1:4", "Gen 1:5", "Gen 1:6"]
    assert rows[0].question is None and rows[0].options == [] and rows[0].status == "pending_generation"
