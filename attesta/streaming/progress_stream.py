"""The quiz as a keyed state machine over a stream of events, by transformWithStateInPandas.

Events (user_id, ts, event_id, event, option): ``select`` an option, ``check`` the
selected one, go to the ``next`` question, ``restart``, ``reload`` the page (what is
stored is restored; a selection is lost). What a state does not allow is ignored:
a selection or a check once the question is answered, a check without a selection
or of an unknown option, a next before the answer, and all but restart and reload
once the quiz is completed. A check and a next store the progress, as does a
completion; a restart clears it. Next after the last question completes the quiz.

The questions are a bank, in the closure up to MAX_QUESTIONS; a larger one is a table in the
shared folder that each worker reads. A user's state is one value and a map from question
to answer, of which a check writes one entry; the record that is stored follows from them. The
batch's events of one user are held and sorted, which the trigger's input bounds.

``stored_in`` reads the records out of a checkpoint by Spark's state data source, without
running the stream; they are what ``flows.restore`` and the next stream start from.

Edge cases: unknown kinds of events count and do nothing; a null option selects
nothing; events that tie in time go by event_id; stored progress that is broken, of
another version or inconsistent is cut to its valid beginning, as by
``progress.resume``; without questions every event is ignored.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow.dataset as ds
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from attesta.operators.progress import VERSION
from attesta.sources.readers import full_uri
from attesta.sources.sinks import drop_at_exit, shared_folder
from attesta.streaming.runs import drained, setting

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER_KEY = "spark.sql.streaming.stateStore.providerClass"
STATE = "run bigint, n_events bigint, idx bigint, selected string, completed boolean, kept boolean"
OUTPUT = "user_id bigint, run bigint, n_events bigint, idx bigint, answered boolean, completed boolean, score bigint, answers string, stored string"
MAX_QUESTIONS = 100_000
#: (id, option ids, id of the correct option)
Question = tuple[str, list[str], str]


class Bank:
    """The questions in order, and the place of each; given as a list or as a folder of Parquet files."""

    def __init__(self, questions: list[Question] | str):
        self.given = questions
        self._all: list[Question] | None = None

    def __getstate__(self) -> dict:
        return {"given": self.given, "_all": None}

    @property
    def all(self) -> list[Question]:
        if self._all is None:
            found = self.given
            if isinstance(found, str):
                fs, path = pafs.FileSystem.from_uri(full_uri(found))
                table = ds.dataset(path, filesystem=fs, format="parquet").to_table().sort_by("pos")
                found = list(zip(*(table.column(c).to_pylist() for c in ("id", "ids", "correctOptionId")), strict=True))
            self._all = found
            self.place = {q: i for i, (q, *_) in reversed(list(enumerate(found)))}
        return self._all

    def __len__(self) -> int:
        return len(self.all)


class Quiz:
    """One user's run through the questions."""

    def __init__(self, questions: list[Question] | Bank):
        self.bank = questions if isinstance(questions, Bank) else Bank(questions)
        self.questions = self.bank.all
        self.run, self.n_events, self.kept = 0, 0, False
        self._begin()

    def _begin(self) -> None:
        self.idx, self.selected, self.answers, self.completed = 0, None, {}, False
        self.cleared = True  # what was known of the answers before counts no more

    @property
    def answered(self) -> bool:
        return bool(self.questions) and self.questions[self.idx][0] in self.answers

    @property
    def score(self) -> int:
        return sum(self.questions[self.bank.place[q]][2] == a for q, a in self.answers.items())

    @property
    def stored(self) -> str | None:
        """The record as it is stored: what was kept last is what holds now."""
        return json.dumps(self.record(), separators=(",", ":"), ensure_ascii=False) if self.kept else None

    def record(self) -> dict:
        return {"version": VERSION, "currentQuestionId": self.questions[self.idx][0], "answers": self.answers, "completed": self.completed}

    def apply(self, event: str, option: str | None) -> None:
        self.n_events += 1
        step = {"select": lambda: self.select(option), "check": self.check, "next": self.next, "restart": self.restart, "reload": self.reload}.get(event)
        if step and self.questions:
            step()

    def select(self, option: str | None) -> None:
        if not self.answered and not self.completed and option in self.questions[self.idx][1]:
            self.selected = option

    def check(self) -> None:
        if self.selected is not None and not self.answered and not self.completed:
            self.answers[self.questions[self.idx][0]] = self.selected
            self.keep()

    def next(self) -> None:
        if not self.answered or self.completed:
            return
        if self.idx + 1 < len(self.questions):
            self.idx, self.selected = self.idx + 1, None
        else:
            self.completed = True
        self.keep()

    def restart(self) -> None:
        self._begin()
        self.run, self.n_events, self.kept = self.run + 1, 1, False

    def keep(self) -> None:
        self.kept = True

    def reload(self) -> None:
        record = self.record() if self.kept else None
        self.kept = False
        self._begin()
        self.take_up(record)

    def restore(self, raw: str | None) -> None:
        """Take up a record as it is stored, as far as it is one."""
        try:
            self.take_up(json.loads(raw or "null"))
        except ValueError:
            return

    def take_up(self, record: object) -> None:
        """Take up what a record allows; the same rules as progress.valid_prefix and progress.resume."""
        if not (isinstance(record, dict) and record.get("version") == VERSION and isinstance(record.get("answers"), dict)):
            return
        for q, options, _ in self.questions:
            if record["answers"].get(q) not in options:
                break
            self.answers[q] = record["answers"][q]
        total, done = len(self.questions), len(self.answers)
        following = min(done, max(total - 1, 0))
        current = record.get("currentQuestionId")
        at = self.bank.place.get(current, -1) if isinstance(current, str) else -1
        self.completed = record.get("completed") is True and done == total
        self.idx = max(total - 1, 0) if self.completed else at if at >= 0 and at in (done - 1, following) else following
        if self.questions:
            self.keep()


class Progress(StatefulProcessor):
    def __init__(self, questions: list[Question] | Bank):
        self.bank = questions if isinstance(questions, Bank) else Bank(questions)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("quiz", STATE)
        self.given = handle.getMapState("answers", "question string", "option string")

    def load(self) -> Quiz:
        quiz = Quiz(self.bank)
        if self.state.exists():
            run, n, idx, selected, completed, kept = self.state.get()
            quiz.run, quiz.n_events, quiz.idx, quiz.selected, quiz.completed, quiz.kept = int(run), int(n), int(idx), selected, bool(completed), bool(kept)
            if self.given.exists():
                quiz.answers = {k[0]: v[0] for k, v in self.given.iterator()}
        quiz.cleared = False
        return quiz

    def save(self, quiz: Quiz, before: set[str]) -> None:
        """Write the value, and of the answers what is new."""
        self.state.update((quiz.run, quiz.n_events, quiz.idx, quiz.selected, quiz.completed, quiz.kept))
        if quiz.cleared and before:
            self.given.clear()
        for q, option in quiz.answers.items():
            if quiz.cleared or q not in before:
                self.given.updateValue((q,), (option,))

    def handleInitialState(self, key, initialState: pd.DataFrame, timers) -> None:
        """A user's stored record, before the first event."""
        quiz = Quiz(self.bank)
        quiz.restore(initialState["raw"].iloc[0])
        self.save(quiz, set())

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        quiz = self.load()
        before = set(quiz.answers)
        events = pd.concat(list(rows)).sort_values(["ts", "event_id"], kind="stable")
        for event, option in zip(events["event"], events["option"], strict=True):
            quiz.apply(event, option)
        self.save(quiz, before)
        answers = ",".join(f"{q}:{quiz.answers[q]}" for q in sorted(quiz.answers, key=quiz.bank.place.get))
        yield pd.DataFrame(
            {
                "user_id": [key[0]], "run": [quiz.run], "n_events": [quiz.n_events], "idx": [quiz.idx], "answered": [quiz.answered], "completed": [quiz.completed],
                "score": [quiz.score], "answers": [answers], "stored": [quiz.stored],
            }
        )

    def close(self) -> None:
        pass


def bank(questions: DataFrame, most: int = MAX_QUESTIONS) -> Bank:
    """The playable questions (pos, id, options, correctOptionId), in order. Up to `most` of them are in
    the closure, more go to a table in the shared folder."""
    rows = questions.select("pos", "id", F.transform("options", lambda o: o["id"]).alias("ids"), "correctOptionId")
    some = rows.orderBy("pos").limit(most + 1).collect()
    if len(some) <= most:
        return Bank([(r["id"], list(r["ids"]), r["correctOptionId"]) for r in some])
    folder = f"{shared_folder(questions.sparkSession)}/bank-{uuid.uuid4().hex}"
    drop_at_exit(questions.sparkSession, folder)
    rows.write.parquet(folder)
    return Bank(folder)


def progress(events: DataFrame, questions: list[Question] | Bank, stored: DataFrame | None = None) -> DataFrame:
    """A row per user and micro-batch: the state after it. Events of a batch are applied in order of
    time; batches must follow one another in time, as a queue delivers them. stored (user_id, raw)
    are records that users start from, one each."""
    initial = stored.groupBy("user_id") if stored is not None else None
    return events.select("user_id", "ts", "event_id", "event", "option").groupBy("user_id").transformWithStateInPandas(
        statefulProcessor=Progress(questions), outputStructType=OUTPUT, outputMode="update", timeMode="none", initialState=initial
    )


def replay(spark: SparkSession, events: DataFrame, questions: list[Question] | Bank, stored: DataFrame | None = None, checkpoint: str | None = None) -> DataFrame:
    """Run the stream over all that a source (events, a stream) has; the last state of each user that
    had events. A named checkpoint stays: the next run goes on from it."""
    with setting(spark, PROVIDER_KEY, PROVIDER):
        states = drained(progress(events, questions, stored), "update", checkpoint)
    names = [x.split()[0] for x in OUTPUT.split(", ")][1:]
    last = states.groupBy("user_id").agg(F.max_by(F.struct(*names), "batch").alias("s"))
    return last.select("user_id", *[f"s.{n}" for n in names])


def stored_in(spark: SparkSession, checkpoint: str, questions: DataFrame) -> DataFrame:
    """user_id, raw and batch: the records of all users as a checkpoint's state has them, which
    batch it is of; users whose record was cleared have none. questions (pos, id) name the
    current one. The stream need not run."""
    with setting(spark, PROVIDER_KEY, PROVIDER):
        at = spark.read.format("state-metadata").load(checkpoint).agg(F.max("maxBatchId").alias("batch"))
        quiz = spark.read.format("statestore").option("stateVarName", "quiz").load(checkpoint).select("key.user_id", "value.*").filter("kept")
        given = spark.read.format("statestore").option("stateVarName", "answers").load(checkpoint)
        answers = given.select("key.user_id", F.struct(F.col("user_map_key.question").alias("q"), F.col("user_map_value.option").alias("a")).alias("e"))
        names = questions.select((F.col("pos") - 1).cast("bigint").alias("idx"), F.col("id").alias("current"))
        listed = answers.join(questions.select(F.col("id"), "pos"), F.col("e.q") == F.col("id")).groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("pos", "e"))).alias("es"))
        entries = F.map_from_entries(F.transform(F.coalesce("es", F.array().cast("array<struct<pos:int,e:struct<q:string,a:string>>>")), lambda x: x["e"]))
        rows = quiz.join(names, "idx").join(listed, "user_id", "left")
        record = F.struct(F.lit(VERSION).alias("version"), F.col("current").alias("currentQuestionId"), entries.alias("answers"), "completed")
        # the state is read and written here, where the session's provider is the stream's
        folder = f"{shared_folder(spark)}/records-{uuid.uuid4().hex}"
        drop_at_exit(spark, folder)
        rows.crossJoin(F.broadcast(at)).select("user_id", F.to_json(record).alias("raw"), "batch").write.parquet(folder)  # at: one row
    return spark.read.schema("user_id bigint, raw string, batch bigint").parquet(folder)
