import base64
import gzip
import hashlib
import random
import zlib

from attesta.llm import warc


def brute(rows):
    first = {}
    for i, h in rows:
        k = h or ""
        if i is not None:
            first[k] = min(first.get(k, i), i)
    out = []
    for i, h in rows:
        raw = (h or "").encode()
        f = first.get(h or "")
        known = i == f
        out.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if known else "revisit", None if known else f))
    return sorted(out, key=str)


def found(df, **more):
    return sorted((tuple(r) for r in warc.digest(warc.roundtrip(df, **more)).collect()), key=str)


def pages(spark, sf):
    p = spark.read.parquet(f"{sf}/pages.parquet")
    copies = p.limit(20).selectExpr("page_id + 1000 AS page_id", "url", "html")
    more = spark.createDataFrame([(5000, None, None), (5001, "x\r\ny", ""), (None, "y", "z"), (5002, "u", "z"), (5003, "v", "\x1f\x8b\x08WARC/1.1 é"), (5003, "v", "\x1f\x8b\x08WARC/1.1 é")], p.schema)
    return p.unionByName(copies).unionByName(more)


def test_round_trip_in_small_ranges(spark, sf):
    df = pages(spark, sf)
    want = brute([(r.page_id, r.html) for r in df.collect()])
    for split in (700, 5000, 4 << 20):
        assert found(df, split_bytes=split) == want


def test_least_size_of_revisits(spark):
    df = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "longer text"), (4, "u", "longer text")], "page_id long, url string, html string")
    got = {r[0]: r[3] for r in found(df, min_revisit_bytes=5)}
    assert got == {1: "response", 2: "response", 3: "response", 4: "revisit"}


def test_empty(spark):
    assert found(spark.createDataFrame([], "page_id long, url string, html string, payload int, digest int")) == []


def test_archives_are_plain_gzip_members(spark, tmp_path):
    df = spark.createDataFrame([(1, "http://a/", "<p>é</p>")], "page_id long, url string, html string")
    (row,) = warc.write_warc(df, f"file://{tmp_path}/w").collect()
    data = gzip.open(row.path).read()
    assert data.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and "<p>é</p>".encode() in data
    listed = warc.list_archives(spark, f"file://{tmp_path}/w").collect()
    assert [r["bytes"] for r in listed] == [row["bytes"]]


def test_magic_inside_a_member_is_no_record(spark, tmp_path):
    inner = warc.member(b"WARC/1.1\r\nWARC-Type: response\r\n\r\nno mandatory headers")
    path = tmp_path / "x.warc.gz"
    path.write_bytes(b"junk" + inner + warc.member(warc.record(7, b"u", b"p", b"D", None, False)))
    assert [r["page_id"] for _, r in warc.members(str(path), 0, path.stat().st_size)] == [7]


def test_a_member_at_the_end_of_a_window(tmp_path):
    long = warc.member(warc.record(1, b"u", random.Random(5).randbytes(warc.CHUNK + 5000), b"D", None, False))
    after = warc.member(warc.record(2, b"u", b"p", b"D", None, False))
    assert warc.MAGIC not in long[1:] and len(long) > warc.CHUNK
    path = tmp_path / "x.warc.gz"
    path.write_bytes(long + after)
    for left in (*range(3, 80), 200, 1 << 14):
        start = len(long) + left - warc.CHUNK  # a range's window that ends so many bytes into the second member
        assert [r["page_id"] for _, r in warc.members(str(path), start, path.stat().st_size)] == [2]


def test_archives_inside_payloads_give_no_records(tmp_path):
    """One record in, one out, whatever ranges it is read in; also with junk between members."""
    rnd = random.Random(3)
    noise = rnd.randbytes(100_000)
    inner = b"".join(warc.member(warc.record(k, b"u", rnd.randbytes(500), b"D", None, False)) for k in range(90, 96))
    first = warc.member(warc.record(1, b"u", b"p", b"D", None, False))
    stored = zlib.compressobj(0, zlib.DEFLATED, 31)
    nested = stored.compress(warc.record(2, b"u", noise + inner + noise, b"D", None, False)) + stored.flush()
    last = warc.member(warc.record(3, b"u", noise, b"D", None, False))
    assert inner in nested and warc.MAGIC in nested[1:]
    for parts in ((first, nested, last), (nested,), (first, b"junk" + noise[:999], nested, b"more junk", last)):
        path = tmp_path / "x.warc.gz"
        path.write_bytes(b"".join(parts))
        size = path.stat().st_size
        want = [r["page_id"] for _, r in warc.members(str(path), 0, size)]
        assert set(want) <= {1, 2, 3} and len(want) == sum(p in (first, nested, last) for p in parts)
        for split in (1000, 50_000, 101_000, 170_000):
            got = [r["page_id"] for s in range(0, size, split) for _, r in warc.members(str(path), s, min(size, s + split))]
            assert got == want, (split, got)


def test_magic_across_blocks(tmp_path):
    small = warc.member(warc.record(2, b"u", b"p", b"D", None, False))
    path = tmp_path / "x.warc.gz"
    for shift in range(-4, 4):
        path.write_bytes(b"x" * (warc.CHUNK + shift) + small + small)
        assert [r["page_id"] for _, r in warc.members(str(path), 0, path.stat().st_size)] == [2, 2]
        assert [r["page_id"] for _, r in warc.members(str(path), 5, path.stat().st_size)] == [2, 2]


def test_binary_payloads_come_back(spark, tmp_path):
    payloads = [bytes([k]) * k + random.Random(k).randbytes(3000) for k in range(20)]
    path = tmp_path / "x.warc.gz"
    path.write_bytes(b"".join(warc.member(warc.record(k, b"u", p, b"D", None, False)) for k, p in enumerate(payloads)))
    assert [r["payload"] for _, r in warc.members(str(path), 0, path.stat().st_size)] == payloads


def test_a_very_common_payload(spark):
    rows = [(i, "u", "same" if i % 3 else f"page {i}") for i in range(600)] + [(None, "u", "same"), (None, "u", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert found(df) == brute([(r[0], r[2]) for r in rows])
