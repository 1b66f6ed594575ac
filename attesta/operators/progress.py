"""Progress through a sequence of questions: score, restored prefix, resume position, runs of events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.functions import text as tx
from attesta.operators import ordered

# Fixed values.
CATEGORY_NAMES = {"eventos": "Eventos", "personajes": "Personajes", "lugares": "Lugares", "evangelios": "Evangelios"}
DIFFICULTY_NAMES = {"beginner": "Inicial", "intermediate": "Intermedia", "advanced": "Avanzada"}
BOTH, RIGHT, WRONG = "Respuesta correcta y seleccionada.", "Respuesta correcta.", "Tu respuesta, incorrecta."
RESTORED = "Progreso restaurado. "
PRAISE = "Correcto. Revisa el contexto y la referencia antes de continuar."
REPLY_HEAD, REPLY_TAIL = "No es correcto. La respuesta es ", ". Revisa el contexto y la referencia."
VERSION = 1


def score(questions: DataFrame, answers: DataFrame, users: DataFrame) -> DataFrame:
    """user_id, score and total over all questions (question_id, correct); no answer counts 0.
    Only answers are joined to questions; the total is one number."""
    right = answers.join(questions, "question_id").filter(F.col("answer") == F.col("correct")).groupBy("user_id").agg(F.count("*").alias("score"))
    total = questions.agg(F.count("*").alias("total"))  # one row
    return users.join(right, "user_id", "left").crossJoin(total).select("user_id", F.coalesce("score", F.lit(0)).cast("bigint").alias("score"), "total")


def valid_prefix(rows: DataFrame, key: str, pos: str, valid: Column) -> DataFrame:
    """How many rows of each key, in order of pos from 1, are valid before the first that isn't."""
    bad = F.min(F.when(~F.coalesce(valid, F.lit(False)), F.col(pos)))
    return rows.groupBy(key).agg((F.coalesce(bad - 1, F.count("*"))).cast("bigint").alias("answered"), F.count("*").alias("total"))


def resume(answered: Column, total: Column, stored: Column, completed: Column) -> tuple[Column, Column, Column]:
    """(index, completed, restored) from the valid prefix and the stored index (-1: unknown).

    The stored index is accepted if it is the last answered or the next one. Restored
    is also true for a stored index above 0 that was rejected.
    """
    done = F.coalesce(completed, F.lit(False)) & (answered == total)
    following = F.when(answered < total, answered).otherwise(F.greatest(total - 1, F.lit(0)))
    accepted = (stored >= 0) & ((stored == answered - 1) | (stored == following))
    index = F.when(done, F.greatest(total - 1, F.lit(0))).when(accepted, stored).otherwise(following)
    return index, done, done | (answered > 0) | (stored > 0)


def first_answers(events: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first event of each key: later answers to a question change nothing. A partial aggregate."""
    rest = [c for c in events.columns if c not in keys]
    first = events.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("e"))
    return first.select(*[F.col(c) if c in keys else F.col(f"e.{c}").alias(c) for c in events.columns])


def with_runs(events: DataFrame, user: str, order: list[str], restart: Column, most: int = ordered.MOST) -> DataFrame:
    """events with run: the number of restarts up to and including each event. The events of one
    user may be any number; see ordered.running."""
    return ordered.running(events, [user], order, most, run=("sum", F.when(restart, 1).otherwise(0)))


def option_state(option: Column, correct: Column, selected: Column) -> Column:
    is_right, is_mine = option.eqNullSafe(correct), option.eqNullSafe(selected)
    return F.when(is_right & is_mine, BOTH).when(is_right, RIGHT).when(is_mine, WRONG).otherwise("")


def feedback(correct_text: Column, is_correct: Column, restored: Column) -> Column:
    wrong = F.concat(F.lit(REPLY_HEAD), correct_text, F.lit(REPLY_TAIL))
    return F.concat(F.when(restored, RESTORED).otherwise(""), F.when(is_correct, PRAISE).otherwise(wrong))


def stored_progress(raw: Column) -> Column:
    """The stored record (version, currentQuestionId, answers, completed); null unless it is an
    object of the right version whose answers are an object."""
    record = F.from_json(raw, "version int, currentQuestionId string, answers map<string,string>, completed boolean")
    is_object = F.startswith(F.ltrim(F.get_json_object(raw, "$.answers")), F.lit("{"))
    return F.when((record["version"] == VERSION) & is_object, record)


# What a page says about where a user is.
LAST, NEXT, LEVEL = "Ver resultado", "Siguiente pregunta", "Dificultad"


def caption(category: Column, difficulty: Column) -> Column:
    """The names of a question's category and difficulty; codes without a name stand for themselves."""
    return F.concat(tx.label(category, CATEGORY_NAMES), F.lit(f" · {LEVEL} "), F.lower(tx.label(difficulty, DIFFICULTY_NAMES)))


def place_text(index: Column, total: Column) -> Column:
    """Which of the questions it is, from index 0 on."""
    return F.format_string("Pregunta %d de %d", index.cast("bigint") + 1, total.cast("bigint"))


def score_text(score: Column, total: Column) -> Column:
    return F.format_string("%d/%d", score.cast("bigint"), total.cast("bigint"))


def next_label(index: Column, total: Column) -> Column:
    """What leads on from a question: to the next one, or from the last to the result."""
    return F.when(index == total - 1, LAST).otherwise(NEXT)
