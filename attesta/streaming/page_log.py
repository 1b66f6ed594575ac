"""A browser's log as streams in event time.

Requests meet their answers (responses or failures) by an interval join with watermarks on
both sides: an answer counts if it comes within a time after its request, and a request that
none came for is given without one, as soon as the watermarks say that none can come any
more. So the state holds no more than the requests and answers of that time. Findings are
counted by windows of event time.

Edge cases: what is later than the watermark allows is dropped, and is no answer; an answer
without a request is nothing; several answers to a request are several rows; a null time or key meets nothing,
and a request with a null time is not given at all; rows of one time are equal to the watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.operators.page_log import log_findings


def answered(requests: DataFrame, answers: DataFrame, keys: list[str], within: str = "30 seconds", late: str = "1 minute") -> DataFrame:
    """requests (keys, ts, ...) with the columns of their answers (keys, ts, ...), whose time is
    answer_ts; null where there was no answer within the time. The other columns' names must differ."""
    left = requests.filter("ts IS NOT NULL").withWatermark("ts", late)
    right = answers.filter("ts IS NOT NULL").withColumnRenamed("ts", "answer_ts").withWatermark("answer_ts", late)
    right = right.withColumnsRenamed({k: f"__{k}" for k in keys})
    on = [F.col(k) == F.col(f"__{k}") for k in keys]
    on += [F.col("answer_ts") >= F.col("ts"), F.col("answer_ts") <= F.col("ts") + F.expr(f"INTERVAL {within}")]
    return left.join(right, on, "left_outer").drop(*[f"__{k}" for k in keys])


def exchanges(log: DataFrame, within: str = "30 seconds", late: str = "1 minute") -> DataFrame:
    """viewport, request_id, url, ts, answer_ts, outcome (response, requestfailed or null) and status of every request of a log."""
    requests = log.filter("kind = 'request'").select("viewport", "request_id", "url", "ts")
    answers = log.filter("kind IN ('response', 'requestfailed')").select("viewport", "request_id", "ts", F.col("kind").alias("outcome"), "status")
    return answered(requests, answers, ["viewport", "request_id"], within, late)


def by_window(findings: DataFrame, by: list[str], length: str = "1 minute", late: str = "1 minute") -> DataFrame:
    """start, by and n: findings (ts, by) of each window of event time, given once the window is over."""
    counted = findings.withWatermark("ts", late).groupBy(F.window("ts", length).alias("w"), *by).agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("start"), *by, "n")


def failures_by_window(log: DataFrame, origin: str, length: str = "1 minute", late: str = "1 minute") -> DataFrame:
    """start, viewport, check_name and n: the errors of a page's log."""
    return by_window(log_findings(log, origin), ["viewport", "check_name"], length, late)
