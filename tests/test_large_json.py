import json
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from attesta.operators import passages
from attesta.sources import large_json as lj

KEYS = ["text", "verse", "number", "reference", "ref", "id", "other", 'te"xt', "items", "{", "\\"]
scalars = st.one_of(st.none(), st.booleans(), st.integers(-3, 200), st.floats(0, 9, allow_nan=False), st.sampled_from(["", " ", "a", "Gen 1:7", "v.0", 'say "x"', "\\", "{[", "ñ漢\U0001f600", "5", "a\nb", "\\\\\""]))
trees = st.recursive(scalars, lambda inner: st.one_of(st.lists(inner, max_size=4), st.dictionaries(st.sampled_from(KEYS), inner, max_size=5)), max_leaves=25)


def plain(spark, documents):
    df = spark.createDataFrame([(p, d) for p, d in documents.items()], "path string, payload string")
    return sorted(tuple(r) for r in passages.extract_verses(df, "path").select("path", "pos", "verse_number", "text", F.coalesce("reference_from_api", F.lit("-"))).collect())


def by_ranges(spark, folder, documents, **more):
    rows = []
    for name, text in documents.items():
        data = text if isinstance(text, bytes) else text.encode()
        (folder / name).write_bytes(data)
        rows.append((f"file://{folder}/{name}", len(data)))
    found = lj.verses_of_files(spark.createDataFrame(rows, "path string, length bigint"), **more)
    return sorted((r.path.rpartition("/")[2], r.pos, r.verse_number, r.text, r.ref) for r in found.withColumn("ref", F.coalesce("reference_from_api", F.lit("-"))).collect())


@pytest.mark.parametrize("size", [1, 7, 64, 10**6])
def test_the_same_as_the_walk_of_a_tree(spark, tmp_path, size):
    rnd = random.Random(4)

    def tree(depth):
        if depth == 0 or rnd.random() < 0.2:
            return rnd.choice([None, True, 0, 3, 2.5, "", " x ", 'q"\\', "{[", "Gen 1:9", "é漢\U0001f600", "\\u0041\n"])
        if rnd.random() < 0.3:
            return [tree(depth - 1) for _ in range(rnd.randrange(4))]
        return {k: tree(depth - 1) for k in rnd.sample(KEYS, rnd.randrange(1, 7))}

    documents = {f"{i}.json": json.dumps(tree(4), ensure_ascii=bool(i % 2), indent=rnd.choice([None, 1])) for i in range(25)}
    documents |= {"deep.json": '{"text":"a","x":' * 60 + "{}" + "}" * 60, "twice.json": '{"text": "one", "verse": 1, "verse": 4, "text": "two"}'}
    want = plain(spark, documents)
    assert by_ranges(spark, tmp_path, documents, size=size) == want and len(want) > 20


def test_broken_documents_have_no_verses(spark, tmp_path):
    documents = {"a": '{"text": "x"', "b": '{"text": "x}', "c": b'{"text": "\xff"}', "d": "", "e": '[{"text": "ok"}]', "f": '{"text": "bad \\x escape"}'}
    for size in (3, 1000):
        assert by_ranges(spark, tmp_path, documents, size=size) == [("e", 1, 1, "ok", "-")]


@settings(max_examples=80, deadline=None)
@given(trees, st.integers(1, 40), st.booleans())
def test_events_do_not_depend_on_the_cuts(tmp_path_factory, tree, size, ascii):
    path = tmp_path_factory.mktemp("j") / "d.json"
    path.write_text(json.dumps(tree, ensure_ascii=ascii), encoding="utf-8")
    reader = lj.Reader(f"file://{path}")
    whole = list(lj.events(reader, 0, reader.size, False, 0))
    got, quotes, depth = [], 0, 0
    for a in range(0, reader.size, size):
        z = min(a + size, reader.size)
        got += lj.events(reader, a, z, quotes % 2 == 1, depth)
        q, outside, within = lj.counted(reader, a, z)
        depth += within if quotes % 2 else outside
        quotes += q
    assert got == whole and depth == 0 and quotes % 2 == 0


def test_a_long_document_in_many_ranges(spark, tmp_path):
    """Some megabytes, with a string longer than a range, and the root's own text at the very end."""
    verses = [{"verse": i, "text": f"verse {i} " + "words " * 12, "notes": [{"text": " ", "id": f"n.{i}"}]} for i in range(60_000)]
    tree = {"data": {"verses": verses, "long": {"text": "z" * 1_000_000, "id": "x 9"}}, "text": "root"}
    (tmp_path / "big.json").write_text(json.dumps(tree))
    length = (tmp_path / "big.json").stat().st_size
    assert length > 7_000_000
    found = lj.verses_of_files(spark.createDataFrame([(f"file://{tmp_path}/big.json", length)], "path string, length bigint"), size=1 << 18, most=20_000)
    row = found.agg(F.count("*").alias("n"), F.sum((F.col("verse_number") == F.col("pos") - 2).cast("int")).alias("same"), F.max(F.length("text")).alias("long")).first()
    assert (row.n, row.long, row.same) == (60_002, 1_000_000, 59_999)  # a verse 0 has its place
    ends = {r.pos: (r.verse_number, r.text[:5]) for r in found.filter("pos IN (1, 2, 60002)").collect()}
    assert ends == {1: (1, "root"), 2: (2, "verse"), 60_002: (9, "zzzzz")}
