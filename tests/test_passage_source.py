import json
import threading
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

import pytest
from pyspark.sql import functions as F

from attesta.operators import passages
from attesta.sources import passage_source as ps

BOOKS = "Gen:12, 1 Rey:3,Empty:0"


@pytest.fixture
def server():
    asked, lock = Counter(), threading.Lock()

    class Answers(BaseHTTPRequestHandler):
        def do_GET(self):
            ref = parse_qs(urlparse(self.path).query)["ref"][0]
            with lock:
                asked[ref] += 1
            if self.headers.get("X-Key") != "k" or ref in server.refused:
                self.send_error(403, "not allowed")
                return
            if ref in server.lost:
                self.connection.close()
                return
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps({"verses": [{"verse": 2, "text": f"{ref} ñ"}]}, ensure_ascii=False).encode())

        def log_message(self, *args):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Answers)
    server.asked, server.refused, server.lost = asked, set(), set()
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield server
    server.shutdown()


def options(server, **more):
    return {"url": f"http://127.0.0.1:{server.server_port}/p", "books": BOOKS, "version": "V", "accessKey": "k", "timeout": "5", **more}


def test_a_row_per_chapter(spark, server):
    ps.register(spark)
    server.refused.add("Gen 2")
    df = spark.read.format("passages").options(**options(server)).load()
    rows = {(r.book, r.chapter): r for r in df.collect()}
    assert set(rows) == {("Gen", c) for c in range(1, 13)} | {("1 Rey", c) for c in (1, 2, 3)}
    assert rows["Gen", 2].status == 403 and rows["Gen", 2].payload is None and rows["Gen", 2].error
    verses = passages.extract_verses(df.filter("book = '1 Rey' AND status = 200").select(F.concat_ws(" ", "book", "chapter").alias("k"), "payload"), "k")
    assert {(r.k, r.verse_number, r.text) for r in verses.collect()} == {(f"1 Rey {c}", 2, f"1 Rey {c} ñ") for c in (1, 2, 3)}
    assert df.rdd.getNumPartitions() == 3  # ten chapters, two, and three of the other book


def test_filters_reach_the_requests(spark, server):
    ps.register(spark)
    load = lambda: spark.read.format("passages").options(**options(server, chaptersPerPartition="2")).load()
    some = load().filter((F.col("book") == "Gen") & (F.col("chapter") > 3) & F.col("chapter").isin(2, 4, 5, 11) & F.col("payload").contains("5"))
    assert [(r.book, r.chapter) for r in some.collect()] == [("Gen", 5)]
    assert server.asked == {"Gen 4": 1, "Gen 5": 1, "Gen 11": 1}
    plan = some._jdf.queryExecution().executedPlan().toString()
    above = plan[: plan.index("BatchScan")]
    assert "book" not in above.split("Filter")[-1].split("\n")[0] and "payload" in above  # what the source applies is no longer in Spark's filter
    server.asked.clear()
    assert load().filter("chapter >= 12 OR book = 'none'").count() == 1 and len(server.asked) == 15  # a filter that cannot be pushed is applied by Spark
    server.asked.clear()
    assert load().filter("chapter = 99").count() == 0 and not server.asked
    assert load().filter("chapter < 2 AND chapter <= 5").count() == 2 and len(server.asked) == 2


def test_nothing_is_asked_for_twice(spark, server, tmp_path):
    ps.register(spark)
    server.lost.add("Gen 3")
    load = lambda: spark.read.format("passages").options(**options(server, store=f"file://{tmp_path}/kept")).load()
    assert [r.chapter for r in load().filter("status IS NULL").collect()] == [3]
    before = dict(server.asked)
    server.lost.clear()
    assert load().filter("status = 200").count() == 15
    assert {k: n - before.get(k, 0) for k, n in server.asked.items() if n != before.get(k, 0)} == {"Gen 3": 1}


def test_a_stream_is_taken_up_where_it_stopped(spark, server, tmp_path):
    """The first run is killed within its second batch; the next one asks only for what is missing."""
    ps.register(spark)
    load = lambda: spark.readStream.format("passages").options(**options(server, store=f"file://{tmp_path}/kept", chaptersPerBatch="4", chaptersPerPartition="2")).load()

    def run(fail_at):
        seen = []

        def keep(rows, batch):
            found = [(r.book, r.chapter) for r in rows.collect()]
            if batch == fail_at:
                raise RuntimeError("killed")
            seen.extend(found)

        query = load().writeStream.foreachBatch(keep).option("checkpointLocation", str(tmp_path / "checkpoint")).start()
        try:
            query.processAllAvailable()
        except Exception as e:
            assert "killed" in str(e)
        finally:
            query.stop()
        return seen

    first = run(1)
    assert first == [("Gen", c) for c in range(1, 5)] and len(server.asked) == 8
    second = run(-1)
    assert sorted(first + second) == sorted([("Gen", c) for c in range(1, 13)] + [("1 Rey", c) for c in (1, 2, 3)])
    assert set(server.asked.values()) == {1} and len(server.asked) == 15


def test_recorded_responses(spark, tmp_path):
    ps.register(spark)
    for book, c in (("Gen", 1), ("1 Rey", 2)):
        (tmp_path / f"{book}-{c}.json").write_text(json.dumps({"text": "ñ"}), encoding="utf-8")
    df = spark.read.format("passages").options(url=f"file://{tmp_path}/{{book}}-{{chapter}}.json", books="Gen:1,1 Rey:2").load()
    assert {(r.book, r.chapter, r.status, r.payload) for r in df.collect()} == {("Gen", 1, 200, '{"text": "\\u00f1"}'), ("1 Rey", 1, 404, None), ("1 Rey", 2, 200, '{"text": "\\u00f1"}')}


def test_options():
    assert ps.catalogue("A b:2, C:1,") == [("A b", 2), ("C", 1)]
    for wrong in ("A", ":3", "A:x"):
        with pytest.raises(ValueError):
            ps.catalogue(wrong)
    with pytest.raises(ValueError):
        ps.Requests({"books": "A:1"})
    assert [(r.book, r.first, r.last) for r in ps.ranges([("A", 1), ("A", 2), ("A", 4), ("B", 5), ("B", 6), ("B", 7)], 2)] == [("A", 1, 2), ("A", 4, 4), ("B", 5, 6), ("B", 7, 7)]
    a, b = ps.Requests({"url": "http://x", "accessKey": "1"}), ps.Requests({"url": "http://x", "accessKey": "2", "store": "file:///s"})
    assert "1" not in a.address("B", 2) and b.kept("B", 2).startswith("file:///s/")
