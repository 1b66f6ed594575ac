"""The audit: are answers and explanations supported by a passage, and do distractors conflict with it?"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.functions import text as tx
from attesta.operators.passages import passages

# Fixed values.
VERIFIED, REVIEW = "VERIFICADO_DIRECTO", "REQUIERE_REVISION"


def audit(questions: DataFrame, verses: DataFrame) -> DataFrame:
    """A verdict per question; the passage itself is not returned.

    questions: id (unique), book, chapter, verse_start, verse_end (null: the start),
    support_terms, explanation_terms, distractors. verses: book, chapter,
    verse_number, text, one row per number (see ``last_wins``).

    An empty range is found, with an empty passage. A range that is partly missing is
    not found, but evidence is looked for in what there is; its hash is null.
    """
    questions = questions.withColumn("verse_end", F.coalesce("verse_end", "verse_start"))
    found = passages(questions, verses, ["book", "chapter"])
    rows = questions.join(found, "id").withColumn("norm", tx.normalize(F.col("passage")))
    rows = rows.select(
        "id",
        tx.range_label(F.col("book"), F.col("chapter"), F.col("verse_start"), F.col("verse_end")).alias("reference"),
        F.col("found").alias("reference_exists"),
        tx.terms_missing(F.col("norm"), F.col("support_terms")).alias("missing_support_terms"),
        tx.terms_missing(F.col("norm"), F.col("explanation_terms")).alias("missing_explanation_terms"),
        tx.conflicts(F.col("norm"), F.col("distractors")).alias("distractor_conflicts"),
        F.when(F.col("found"), F.sha2("passage", 256)).alias("passage_sha256"),
    )
    direct = F.col("reference_exists") & (F.size("missing_support_terms") == 0)
    explained = F.col("reference_exists") & (F.size("missing_explanation_terms") == 0)
    unique = F.size("distractor_conflicts") == 0
    return rows.select(
        "id",
        "reference",
        "reference_exists",
        direct.alias("direct_answer_support"),
        "missing_support_terms",
        explained.alias("explanation_claims_supported"),
        "missing_explanation_terms",
        "distractor_conflicts",
        unique.alias("unique_answer_signal"),
        "passage_sha256",
        F.when(direct & explained & unique, VERIFIED).otherwise(REVIEW).alias("verdict"),
        F.lit(False).alias("source_text_persisted"),
    )


def summary(results: DataFrame) -> DataFrame:
    return results.agg(
        F.count("*").alias("questions_audited"),
        F.count_if(F.col("verdict") == VERIFIED).alias("verified_count"),
        F.count_if(F.col("verdict") != VERIFIED).alias("review_required_count"),
    )


def report(results: DataFrame, **header: str | int) -> DataFrame:
    """One row: the header, the counts and the results in order of id, for one JSON document, which
    must fit in one task; sinks.write_report takes results of any number."""
    return results.agg(
        *[F.lit(v).alias(k) for k, v in header.items()],
        F.count("*").alias("questions_audited"),
        F.count_if(F.col("verdict") == VERIFIED).alias("verified_count"),
        F.count_if(F.col("verdict") != VERIFIED).alias("review_required_count"),
        F.lit(False).alias("source_text_persisted"),
        F.array_sort(F.collect_list(F.struct(*results.columns))).alias("results"),
    )
