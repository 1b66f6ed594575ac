import json
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from attesta.operators import page_log as pl
from attesta.operators import scan
from attesta.sources import readers
from attesta.streaming import page_log, runs

ORIGIN = "http://s.example:1"
START = datetime(2026, 1, 1)


def entry(second, kind, request=None, url=f"{ORIGIN}/a", **more):
    return {"ts": (START + timedelta(seconds=second)).isoformat(), "viewport": "v", "kind": kind, "request_id": request, "url": url, **more}


def arrived(folder, name, rows, order):
    """A file of the log; the stream takes files in the order of their times."""
    import os

    path = folder / name
    path.write_text("\n".join(map(json.dumps, rows)))
    os.utime(path, (1_000_000 + order, 1_000_000 + order))


def test_errors_of_a_log(spark, tmp_path):
    rows = [
        entry(0, "pageerror", message="boom"), entry(1, "console", level="error", message="c1"), entry(2, "console", level="log", message="c2"),
        entry(3, "console", level="error", message="c3", location="http://else/"), entry(4, "console", level="error", location=f"{ORIGIN}/x"), entry(5, "requestfailed"),
        entry(6, "requestfailed", url="http://s.example/a", message="m"), entry(7, "response", status=404), entry(8, "response", status=399), entry(9, "response", status=500, url="::"), entry(10, "response"), entry(11, "other"),
    ]
    arrived(tmp_path, "a.json", rows, 0)
    got = [(r.check_name, r.detail) for r in pl.log_findings(readers.page_events(spark, str(tmp_path)), ORIGIN).orderBy("ts").collect()]
    assert got == [("page_error", "boom"), ("console_error", "c1"), ("console_error", "unknown"), ("request_failed", f"{ORIGIN}/a (unknown)"), ("bad_status", f"404 {ORIGIN}/a")]


def test_what_a_viewport_lacks(spark):
    schema = """viewport string, width int, status int, title string, elements array<struct<selector:string,found:boolean,visible:boolean>>, scroll_x int,
        controls array<struct<label:string,left:double,right:double>>, menu struct<button:boolean,nav:boolean,expanded:boolean,visible:boolean,left:double,right:double>"""
    fine = [(s, True, True) for s in pl.ESSENTIAL]
    rows = [
        ("ok", 900, 200, "t", fine, 2, [("a", -2.4, 902.4)], (True, True, True, True, -2.0, 902.0)),
        ("none", 901, None, None, None, None, None, None),
        ("bad", 900, 404, " ", [("header", True, False), *fine[1:]], 3, [(" L  x ", -2.6, 5.0), ("r", 0.0, 902.5)], (True, True, False, True, 0.0, 903.0)),
        ("wide", 901, 200, "t", fine, 0, [], (True, True, False, False, 0.0, 0.0)),
        ("hidden", 360, 200, "t", fine, 0, [], (True, True, None, None, None, None)),
    ]
    got = {}
    for r in pl.page_findings(spark.createDataFrame(rows, schema)).collect():
        got.setdefault(r.viewport, []).append((r.check_name, r.detail))
    assert got == {
        "none": [("page_not_loaded", "no answer"), ("empty_title", ""), *(("missing_element", s) for s in pl.ESSENTIAL)],
        "bad": [
            ("page_not_loaded", "404"), ("empty_title", ""), ("scrolls_sideways", "3"), ("menu_not_expanded", "900"), ("menu_outside", "900"), ("hidden_element", "header"),
            ("control_outside", "L x [-3, 5]"), ("control_outside", "r [0, 903]"),
        ],
        "hidden": [("menu_not_expanded", "360"), ("menu_hidden", "360")],
    }
    rolled = scan.failures(pl.page_findings(spark.createDataFrame(rows, schema)).select("viewport", F.concat_ws(" ", "check_name", "detail").alias("message")), "viewport")
    assert {r.viewport: len(r.errors) for r in rolled.collect()} == {"none": 6, "bad": 8, "hidden": 2}


def test_requests_meet_their_answers_in_event_time(spark, tmp_path):
    """Answers in time, too late for their request, later than the watermark, in an earlier file, and none at all."""
    folder = tmp_path / "log"
    folder.mkdir()
    arrived(folder, "1.json", [entry(0, "request", 1), entry(5, "request", 2), entry(6, "response", 1, status=200), entry(50, "response", 2, status=200), entry(58, "response", 6, status=200)], 1)
    arrived(folder, "2.json", [entry(40, "request", 3), entry(45, "requestfailed", 3, message="x"), entry(52, "request", 6), entry(200, "request", 4), entry(200, "response", 9)], 2)
    arrived(folder, "3.json", [entry(201, "response", 4, status=204)], 3)
    # the batch before has seen the watermark pass: a request and its answer of long ago are dropped, and so is an answer to request 2
    arrived(folder, "4.json", [entry(10, "request", 5), entry(12, "response", 5, status=200), entry(7, "response", 2, status=200), entry(900, "request", 7), entry(900, "response", 8)], 4)
    arrived(folder, "5.json", [entry(2000, "request", None), entry(2000, "response", None), entry(2000, "request", 10), entry(2000, "response", 10, status=1)], 5)
    log = readers.page_event_stream(spark, str(folder), per_trigger=1)
    rows = runs.drained(page_log.exchanges(log, "30 seconds", "60 seconds")).collect()
    got = {r.request_id: (r.outcome, r.status) for r in rows if r.ts < START + timedelta(seconds=1500)}
    assert got == {1: ("response", 200), 2: (None, None), 3: ("requestfailed", None), 4: ("response", 204), 6: ("response", 200), 7: (None, None)}


def test_windows_are_given_once_they_are_over(spark, tmp_path):
    folder = tmp_path / "log"
    folder.mkdir()
    arrived(folder, "1.json", [entry(0, "pageerror"), entry(30, "pageerror"), entry(61, "pageerror"), entry(62, "response", status=500)], 1)
    arrived(folder, "2.json", [entry(20, "pageerror"), entry(300, "pageerror")], 2)  # 20 is late, but not too late
    arrived(folder, "3.json", [entry(302, "pageerror")], 3)
    arrived(folder, "4.json", [entry(25, "pageerror"), entry(301, "pageerror")], 4)  # 25 is too late now
    log = readers.page_event_stream(spark, str(folder), per_trigger=1)
    rows = runs.drained(page_log.failures_by_window(log, ORIGIN)).collect()
    got = sorted(((r.start - START).total_seconds(), r.check_name, r.n) for r in rows)
    assert got == [(0, "page_error", 3), (60, "bad_status", 1), (60, "page_error", 1)]


def test_an_empty_log(spark, tmp_path):
    folder = tmp_path / "log"
    folder.mkdir()
    arrived(folder, "1.json", [], 1)
    assert runs.drained(page_log.exchanges(readers.page_event_stream(spark, str(folder)))).collect() == []


def test_violations(spark):
    schema = "vs array<struct<id:string,impact:string,help:string,helpUrl:string,tags:array<string>,nodes:array<struct<target:array<string>,failureSummary:string,html:string>>>>"
    rows = [([("a", "serious", "h", "u", ["t"], [(["x"], "s", "<b>")]), ("b", None, None, None, None, None)],), (None,)]
    got = spark.createDataFrame(rows, schema).select(pl.violation_summary(F.col("vs")).alias("s"), F.size(pl.blocking(F.col("vs"))).alias("n")).collect()
    assert got[0].s[0].asDict(True) == {"id": "a", "impact": "serious", "help": "h", "helpUrl": "u", "nodes": [{"target": ["x"], "failureSummary": "s"}]}
    assert got[0].n == 1 and got[0].s[1].nodes is None and got[1].s is None
