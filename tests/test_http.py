import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import parse_qs, urlparse

import pytest
from pyspark.sql import functions as F

from attesta.operators import bank, scan
from attesta.plans import flows
from attesta.sources import http, readers, sinks


class Answers(BaseHTTPRequestHandler):
    def do_GET(self):
        asked = parse_qs(urlparse(self.path).query)
        if self.headers.get("X-Key") != "k" or asked["ref"] == ["Gen 9"]:
            self.send_error(403, "not allowed")
            return
        self.answer({"data": {"verses": [{"verse": 1, "text": asked["ref"][0] + " ñ"}], "version": asked["version"][0]}})

    def do_POST(self):
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        asked = body["generationConfig"]["responseFormat"]["text"]
        assert asked["mimeType"] == "application/json" and asked["schema"] == json.loads(http.item_schema(bank.DIFFICULTIES)) and body["contents"][0]["role"] == "user"
        items = {"items": [{"verse_number": 1, "question": body["contents"][0]["parts"][0]["text"]}]}
        self.answer({"candidates": [{"content": {"parts": [{"text": json.dumps(items)}]}}]})

    def answer(self, value):
        self.send_response(200)
        self.end_headers()
        self.wfile.write(json.dumps(value, ensure_ascii=False).encode())

    def log_message(self, *args):
        pass


@pytest.fixture(scope="module")
def base():
    server = HTTPServer(("127.0.0.1", 0), Answers)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/passage"
    server.shutdown()


def test_passages(spark, base):
    chapters = spark.createDataFrame([(" Gen ", 1), ("1 Rey", 2), ("Gen", 9)], "book string, chapter int")
    got = {r.id: r for r in http.responses(http.passage_requests(chapters, base, "V 1"), {"X-Key": "k"}, 5, 2).collect()}
    assert json.loads(got["1 Rey 2"].payload)["data"] == {"verses": [{"verse": 1, "text": "1 Rey 2 ñ"}], "version": "V 1"}
    assert (got["Gen 9"].status, got["Gen 9"].payload) == (403, None) and got["Gen 9"].error
    (lost,) = http.responses(http.passage_requests(chapters.limit(1), "http://127.0.0.1:9/", "V"), {}, 5, 1).collect()
    assert lost.status is None and lost.error
    codes = lambda rows, chapter: [r.c for r in rows.select(flows.connection_code(F.col("status"), F.col("error"), chapter).alias("c")).collect()]
    rows = spark.createDataFrame([(200, None), (403, "x"), (None, "y"), (204, None)], "status int, error string")
    assert codes(rows, False) == [0, 10, 11, 12] and codes(rows, True) == [0, 20, 21, 0]


def test_generated(spark, base):
    prompts = spark.createDataFrame([("a", 'with "quotes"\n')], "id string, prompt string")
    (row,) = http.responses(http.model_requests(prompts, base, http.item_schema(bank.DIFFICULTIES)), {"X-Key": "k"}, http.MODEL_SECONDS, 1).select(bank.generated_items(F.col("payload")).alias("i")).collect()
    assert row.i[0].question == 'with "quotes"'


def test_measurements_and_findings(spark, tmp_path):
    (tmp_path / "e.json").write_text("\n".join(json.dumps(x) for x in [{"kind": "response", "origin": "o", "bytes": 5, "status": 200}, {"kind": "response", "origin": "p", "bytes": 9}, {"kind": "response", "origin": "o"}, {"kind": "pageerror", "message": "m"}]))
    (tmp_path / "s.json").write_text(json.dumps({"dom_nodes": 5000, "dom_ready_ms": 1, "load_ms": 2, "h1": " t ", "main_visible": True}))
    metrics = flows.measured(readers.page_events(spark, str(tmp_path / "e.json")), readers.snapshots(spark, str(tmp_path / "s.json")), "o")
    assert tuple(metrics.first()) == (5, 2, 1, 5000, 1, 2, True)
    assert {r.metric for r in scan.over_budget(metrics).filter("over").collect()} == {"dom_nodes"}
    findings = spark.createDataFrame([("a", "x", 1), ("b", "y", None), ("a", "z", 2)], "check_name string, subject string, line int")
    sinks.write_findings(findings, str(tmp_path / "f"))
    assert sorted(p.name for p in (tmp_path / "f").iterdir() if p.is_dir()) == ["__by=a", "__by=b"]
    sinks.write_report(findings.agg(F.count("*").alias("n")), findings, str(tmp_path / "r"), "subject")
    assert [r.subject for r in spark.read.json(str(tmp_path / "r/results")).collect()] == ["x", "y", "z"]
    assert json.loads(spark.read.text(str(tmp_path / "r/header"), wholetext=True).first().value)["n"] == 3
