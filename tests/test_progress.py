import itertools
import json
import os
import random

from pyspark.sql import functions as F

from attesta.operators import progress as pr
from attesta.plans import flows
from attesta.sources import readers
from attesta.streaming.progress_stream import Quiz, bank, replay


def plain_resume(answered, total, stored, completed):
    done = completed and answered == total
    if done:
        return max(0, total - 1), True, True
    following = answered if answered < total else max(0, total - 1)
    index = stored if stored >= 0 and stored in (answered - 1, following) else following
    return index, False, answered > 0 or stored > 0


def test_resume(spark):
    cases = [(a, n, s, c) for n in (1, 3) for a, s, c in itertools.product(range(n + 1), range(-1, 4), (True, False))]
    df = spark.createDataFrame(cases, "a long, n long, s long, c boolean")
    got = df.select("*", *[x.alias(f"x{i}") for i, x in enumerate(pr.resume(F.col("a"), F.col("n"), F.col("s"), F.col("c")))]).collect()
    for r in got:
        assert (r.x0, r.x1, r.x2) == plain_resume(r.a, r.n, r.s, r.c)


def test_prefix_ends_at_the_first_gap(spark):
    df = spark.createDataFrame([("u", 1, True), ("u", 2, None), ("u", 3, True), ("v", 1, True), ("v", 2, True)], "k string, pos int, ok boolean")
    assert {r.k: (r.answered, r.total) for r in pr.valid_prefix(df, "k", "pos", F.col("ok")).collect()} == {"u": (1, 3), "v": (2, 2)}


def test_score_counts_all_questions(spark):
    q = spark.createDataFrame([(1, "a"), (2, "b")], "question_id int, correct string")
    a = spark.createDataFrame([("u", 1, "a"), ("u", 2, "x")], "user_id string, question_id int, answer string")
    users = spark.createDataFrame([("u",), ("v",)], "user_id string")
    assert {r.user_id: (r.score, r.total) for r in pr.score(q, a, users).collect()} == {"u": (1, 2), "v": (0, 2)}


def test_stored_record(spark):
    raw = ['{"version":1,"answers":{"a":"b"},"completed":true}', '{"version":2,"answers":{}}', '{"version":1,"answers":["a"]}', "broken", "[]", None]
    df = spark.createDataFrame([(r,) for r in raw], "raw string")
    rows = [r.s for r in df.select(pr.stored_progress(F.col("raw")).alias("s")).collect()]
    assert rows[0].answers == {"a": "b"} and rows[1:] == [None] * 5


def test_option_states(spark):
    df = spark.createDataFrame([("a", "a", "a"), ("a", "a", "b"), ("b", "a", "b"), ("c", "a", "b"), ("c", "a", None)], "o string, c string, s string")
    assert [r.x for r in df.select(pr.option_state(F.col("o"), F.col("c"), F.col("s")).alias("x")).collect()] == [pr.BOTH, pr.RIGHT, pr.WRONG, "", ""]


QUIZ = [(f"q{i}", ["a", "b", "c"], "abc"[i]) for i in range(3)]


def played(*events, stored=None):
    quiz = Quiz(QUIZ)
    quiz.restore(stored)
    for e in events:
        quiz.apply(*(e.split(":") + [None])[:2])
    return quiz


def test_quiz_steps():
    q = played("check", "next", "select:z", "check")
    assert (q.idx, q.answers, q.stored, q.n_events) == (0, {}, None, 4)
    q = played("select:b", "select:a", "check", "select:c", "check")
    assert (q.answers, q.answered, q.score) == ({"q0": "a"}, True, 1)
    assert json.loads(q.stored) == {"version": 1, "currentQuestionId": "q0", "answers": {"q0": "a"}, "completed": False}
    q = played("select:a", "check", "next", "next")
    assert (q.idx, q.answered, q.selected, json.loads(q.stored)["currentQuestionId"]) == (1, False, None, "q1")
    all_three = ("select:a", "check", "next", "select:b", "check", "next", "select:a", "check")
    q = played(*all_three)
    assert not q.completed and q.score == 2
    q = played(*all_three, "next", "next", "select:b", "check")
    assert q.completed and (q.idx, q.score) == (2, 2) and json.loads(q.stored)["completed"]
    q = played(*all_three, "next", "reload")
    assert q.completed and q.idx == 2 and q.answers == {"q0": "a", "q1": "b", "q2": "a"}
    q = played(*all_three, "next", "restart", "what")
    assert (q.run, q.n_events, q.idx, q.answers, q.completed, q.stored) == (1, 2, 0, {}, False, None)
    q = played("select:a", "reload", "check")
    assert q.answers == {} and q.stored is None
    q = played("select:a", "check", "next", "select:b", "reload", "check")
    assert (q.idx, q.answers) == (1, {"q0": "a"})


def test_quiz_restores_like_the_batch_flow(spark):
    records = {
        f"{current} {completed} {n}": json.dumps({"version": 1, "currentQuestionId": current, "answers": {f"q{i}": "z" if i == bad else "a" for i in range(n) if i != gap}, "completed": completed})
        for current in ("q0", "q1", "q2", "q9") for completed in (True, False) for n in range(4) for bad, gap in ((9, 9),)
    }
    records |= {"gap": json.dumps({"version": 1, "currentQuestionId": "q2", "answers": {"q0": "a", "q2": "a"}, "completed": True}), "version": '{"version":2,"answers":{}}', "list": '{"version":1,"answers":[]}', "broken": "{"}
    questions = spark.createDataFrame([(i + 1, q, [(o,) for o in options]) for i, (q, options, _) in enumerate(QUIZ)], "pos int, id string, options array<struct<id:string>>")
    stored = spark.createDataFrame(list(records.items()), "user_id string, raw string")
    for r in flows.restore(questions, stored).collect():
        q = played(stored=records[r.user_id])
        assert (q.idx, q.completed, len(q.answers)) == (r.idx, r.completed, r.answered), r


def rows_of(quizzes):
    return sorted((u, q.run, q.n_events, q.idx, q.answered, q.completed, q.score, ",".join(f"{k}:{v}" for k, v in sorted(q.answers.items())), q.stored) for u, q in quizzes.items())


def test_stream_in_batches_with_stored_progress(spark, tmp_path):
    """JSON events in two files, one a batch, and records that users start from; then back to a sink."""
    rnd = random.Random(1)
    start = {1: played("select:a", "check", "next").stored, 2: "broken", 9: played("select:a", "check").stored}
    quizzes = {u: played(stored=start.get(u)) for u in (1, 2, 3)}
    at = 0
    (tmp_path / "in").mkdir()
    for k in range(2):
        lines = []
        for _ in range(80):
            at += 1
            u, e = rnd.choice((1, 2, 3)), rnd.choice(["select:a", "select:b", "select:z", "check", "check", "next", "reload", "restart" if rnd.random() < 0.3 else "next", "odd"])
            quizzes[u].apply(*(e.split(":") + [None])[:2])
            event, option = (e.split(":") + [None])[:2]
            lines.append(json.dumps({"user_id": u, "ts": f"2024-01-01T00:{at // 60:02d}:{at % 60:02d}Z", "event_id": at, "event": event, "option": option}))
        rnd.shuffle(lines)
        (tmp_path / "in" / f"{k}.json").write_text("\n".join(lines))
        os.utime(tmp_path / "in" / f"{k}.json", (1000 + k, 1000 + k))
    stored = spark.createDataFrame(list(start.items()), "user_id long, raw string")
    states = replay(spark, readers.event_stream(spark, str(tmp_path / "in"), 1), QUIZ, stored)
    assert sorted(map(tuple, states.collect())) == rows_of(quizzes)


def test_bank_of_the_quiz(spark):
    rows = spark.createDataFrame([(2, "b", [("x",)], "x"), (1, "a", [("x",), ("y",)], "y")], "pos int, id string, options array<struct<id:string>>, correctOptionId string")
    assert bank(rows).all == [("a", ["x", "y"], "y"), ("b", ["x"], "x")]
    assert Quiz([]).answered is False and not Quiz([]).apply("select", "a")
