import json
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from attesta.plans import flows
from attesta.sources import progress_store as store
from attesta.sources import readers
from attesta.streaming import progress_stream as stream
from tests.test_progress import QUIZ, played


def rows(spark, *given):
    return spark.createDataFrame(list(given), store.RECORD)


def now(spark, path):
    return {r.user_id: (r.raw, r.version) for r in store.records(spark, path).collect()}


def test_batches_clears_and_versions(spark, tmp_path):
    path = f"file://{tmp_path}/s"
    assert now(spark, path) == {}
    assert store.append(rows(spark, (1, "a", 1), (2, "b", 1)), path, "w", 0)
    assert not store.append(rows(spark, (1, "other", 9)), path, "w", 0)  # the batch is there: nothing changes
    assert store.append(rows(spark, (1, None, 2), (3, "c", 5)), path, "w", 1)
    assert store.append(rows(spark, (3, "older", 4), (2, "tie", 1)), path, "v", 1)
    assert store.append(rows(spark, (2, "late", 0)).limit(0), path, "v", 2)
    assert now(spark, path) == {2: ("tie", 1), 3: ("c", 5)}
    assert store.compact(spark, path) and now(spark, path) == {2: ("tie", 1), 3: ("c", 5)}
    assert not store.append(rows(spark, (9, "x", 9)), path, "w", 1)  # held by the table now
    store.append(rows(spark, (1, "back too late", 1), (2, "new", 7)), path, "v", 3)
    assert now(spark, path) == {2: ("new", 7), 3: ("c", 5)}
    assert store.compact(spark, path) and not (tmp_path / "s/log/w-000000000000").exists() and now(spark, path) == {2: ("new", 7), 3: ("c", 5)}
    with pytest.raises(ValueError):
        store.append(rows(spark), path, "a/b", 0)
    with pytest.raises(PySparkException):
        store.append(rows(spark, (None, "x", 1)), path, "w", 7)
    assert now(spark, path) == {2: ("new", 7), 3: ("c", 5)}  # an unfinished batch is not read


def test_two_writers_lose_nothing(spark, tmp_path):
    """Batches of two writers in any order, given twice, with compactions in between."""
    rnd, path = random.Random(2), f"file://{tmp_path}/s"
    given, want = [], {}
    for writer in ("a", "b"):
        for batch in range(4):
            some = {u: (rnd.choice([None, f"{writer}{batch}"]), rnd.randrange(100)) for u in rnd.sample(range(12), 5)}
            given.append((writer, batch, some))
            for u, (raw, version) in some.items():
                want[u] = max(want.get(u, (-1,)), (version, batch, writer, raw or "", raw))
    rnd.shuffle(given)
    for i, (writer, batch, some) in enumerate([*given, *given[:3]]):
        assert store.append(rows(spark, *((u, *v) for u, v in some.items())), path, writer, batch) == (i < len(given))
        if i % 3 == 2:
            assert store.compact(spark, path)
    assert now(spark, path) == {u: (w[4], w[0]) for u, w in want.items() if w[4] is not None}


def test_one_compaction_wins(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/s"
    store.append(rows(spark, (1, "a", 1)), path, "w", 0)
    write, inner = store.merged, []

    def slow(*args):
        if not inner:
            inner.append(True)
            assert store.compact(spark, path)  # another one ends in between
        return write(*args)

    monkeypatch.setattr(store, "merged", slow)
    assert not store.compact(spark, path)
    monkeypatch.undo()
    assert now(spark, path) == {1: ("a", 1)} and len([p for p in (tmp_path / "s").iterdir() if p.name.startswith("base")]) == 1


def questions(spark):
    return spark.createDataFrame([(i + 1, q, [(o,) for o in options], right) for i, (q, options, right) in enumerate(QUIZ)], "pos int, id string, options array<struct<id:string>>, correctOptionId string")


def test_records_are_read_out_of_the_state(spark, tmp_path):
    """Over two restarts of the stream: the records in its checkpoint are those it gave, and restore the same progress."""
    rnd, quizzes, at = random.Random(7), {u: played() for u in range(1, 6)}, 0
    (tmp_path / "in").mkdir()
    path = f"file://{tmp_path}/store"
    for k in range(3):
        lines = []
        for _ in range(60):
            at += 1
            u = rnd.choice(list(quizzes))
            event, option = (rnd.choice(["select:a", "select:b", "check", "check", "next", "reload", "restart" if rnd.random() < 0.2 else "next"]).split(":") + [None])[:2]
            quizzes[u].apply(event, option)
            lines.append(json.dumps({"user_id": u, "ts": f"2024-01-01T00:{at // 60:02d}:{at % 60:02d}Z", "event_id": at, "event": event, "option": option}))
        (tmp_path / "in" / f"{k}.json").write_text("\n".join(lines))
        states = stream.replay(spark, readers.event_stream(spark, str(tmp_path / "in")), stream.bank(questions(spark)), checkpoint=str(tmp_path / "checkpoint"))
        store.append(states.select("user_id", F.col("stored").alias("raw"), F.lit(at).alias("version")), path, "quiz", k)
        want = {u: q.stored for u, q in quizzes.items() if q.stored and q.n_events}
        found = stream.stored_in(spark, str(tmp_path / "checkpoint"), questions(spark))
        assert {r.user_id: json.loads(r.raw) for r in found.collect()} == {u: json.loads(x) for u, x in want.items()}
        assert {u: r for u, (r, _) in now(spark, path).items()} == want
        assert found.select("batch").distinct().count() == 1
        known = {r.user_id: (r.idx, r.completed, r.answered) for r in flows.restore(questions(spark), found.select("user_id", "raw")).collect()}
        assert known == {u: (q.idx, q.completed, len(q.answers)) for u, q in ((u, played(stored=x)) for u, x in want.items())}


def test_a_large_bank_is_a_table(spark, tmp_path):
    large = stream.bank(questions(spark), most=1)
    assert isinstance(large.given, str) and large.all == stream.bank(questions(spark)).all == QUIZ
    (tmp_path / "e.json").write_text(json.dumps({"user_id": 1, "ts": "2024-01-01T00:00:00Z", "event_id": 1, "event": "select", "option": "a"}) + "\n" + json.dumps({"user_id": 1, "ts": "2024-01-01T00:00:01Z", "event_id": 2, "event": "check"}))
    (row,) = stream.replay(spark, readers.event_stream(spark, str(tmp_path)), large).collect()
    assert (row.score, row.answers) == (1, "q0:a")
