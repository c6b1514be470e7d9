"""The answer store: an append-only ``answers`` table and an append-only
``feedback`` table, combined at read time.

"First answer of a question" is the earliest ``(ts, answer_id)``; it is taken
with a ``min`` over a struct: an aggregate with map-side partial aggregation
(sort-based when the payload carries strings), so a question holding a large
share of the rows costs one row per map task in the shuffle rather than one
window partition sorted in a single task.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C

ANSWER_COLUMNS = ("answer_id", "question", "answer", "sources", "ts", "confidence",
                  "feedback_count", "feedback_sum", "average_feedback")


def conversation_pairs(conversations: DataFrame, unanswered: bool = False) -> DataFrame:
    """A user turn followed by an assistant turn -> one stored answer (with
    ``unanswered``, also user turns without one, their answer NULL).

    ``answer_id`` is the struct (conv_id, assistant turn), which orders answers;
    ``ts`` grows with the conversation.
    An equi-join on (conv_id, turn) rather than a window per conversation, so
    a long conversation is not one task.
    """
    u = conversations.where(F.col("role") == "user").select(
        "conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("question"))
    a = conversations.where(F.col("role") == "assistant").select(
        "conv_id", "turn", F.col("text").alias("answer"))
    return (u.join(a, ["conv_id", "turn"], "left" if unanswered else "inner")
            .select(F.struct("conv_id", "turn").alias("answer_id"), "question", "answer", "conv_id",
                    F.timestamp_seconds(F.lit(1704067200) + F.col("conv_id")).alias("ts")))


def first_per_question(answers: DataFrame, cols: tuple[str, ...] = ("answer_id", "answer"),
                       key: str = "question") -> DataFrame:
    """``(question, *cols)`` of the earliest ``(ts, answer_id)`` answer per question."""
    order = [c for c in ("ts", "answer_id") if c in answers.columns]
    payload = order + [c for c in cols if c not in order]
    best = F.min(F.struct(*payload)).alias("best")
    return (answers.groupBy(key).agg(best)
            .select(key, *[F.col("best")[c].alias(c) for c in cols]))


def cache_lookup(questions: DataFrame, answers: DataFrame, key: str = "question",
                 cols: tuple[str, ...] = ("answer_id", "answer")) -> DataFrame:
    """Exact-match lookup: the first stored answer per asked question, NULL on a miss.
    Everything wanted of it travels in the aggregate: answer ids may repeat."""
    firsts = first_per_question(answers, cols, key)
    return questions.select(key).distinct().join(firsts, key, "left")


SENTINELS = (C.NO_INFORMATION_ANSWER, C.PIPELINE_ERROR_ANSWER, C.NO_VALID_ANSWERS)


def answer_status(answer: Column) -> Column:
    """``ok``, ``no_information``, ``error`` (also NULL) or ``empty``."""
    return (F.when(answer.isNull() | (answer == C.PIPELINE_ERROR_ANSWER), "error")
            .when(answer.isin(C.NO_INFORMATION_ANSWER, C.NO_VALID_ANSWERS), "no_information")
            .when(answer == "", "empty").otherwise("ok"))


def valid_answers(results: DataFrame, answer_col: str = "answer") -> DataFrame:
    """Results that carry an answer: failures have NULL or sentinel texts,
    which neither vote nor get stored."""
    return results.where(answer_status(F.col(answer_col)) == "ok")


def answer_rows(results: DataFrame, ts, confidence: Column | float = 0.0,
                id_col: str | None = None) -> DataFrame:
    """Rows to append to the store with default metadata and one run timestamp.

    Nothing is de-duplicated: storing twice appends twice.
    """
    tsc = ts if isinstance(ts, Column) else F.lit(ts).cast("timestamp")
    conf = F.lit(float(confidence)) if isinstance(confidence, (int, float)) else confidence
    sources = F.col("sources") if "sources" in results.columns else F.array().cast("array<string>")
    rid = (F.col(id_col) if id_col else
           F.xxhash64("question", "answer", F.to_json(sources), tsc))
    return results.select(rid.alias("answer_id"), "question", "answer",
                          sources.alias("sources"), tsc.alias("ts"),
                          conf.cast("double").alias("confidence"),
                          F.lit(0).cast("bigint").alias("feedback_count"),
                          F.lit(0.0).alias("feedback_sum"),
                          F.lit(0.0).alias("average_feedback"))


def storable(final: DataFrame) -> DataFrame:
    """Final results worth caching: a real (non-NULL, non-empty) answer."""
    return valid_answers(final)


EXACT = "decimal(38,10)"  # ratings are summed exactly: the result does not depend on order


def feedback_totals(feedback: DataFrame, key: str = "question",
                    rating: str = "rating") -> DataFrame:
    """``(question, n, total)`` of the ratings per question (partial+final agg).

    ``total`` is an exact decimal sum, so the average rounds the same way
    whatever order the partial sums arrive in.
    """
    return feedback.groupBy(key).agg(F.count(F.lit(1)).alias("n"),
                                     F.sum(F.col(rating).cast(EXACT)).alias("total"))


def feedback_stats(feedback: DataFrame, key: str = "question", rating: str = "rating") -> DataFrame:
    """Running statistics per question as a fresh answer would show them."""
    t = feedback_totals(feedback, key, rating)
    return t.select(key, F.col("n").alias("feedback_count"),
                    F.round("total", 4).cast("double").alias("feedback_sum"),
                    F.round(F.col("total") / F.col("n"), 6).cast("double").alias("average_feedback"))


def apply_feedback(answers: DataFrame, feedback: DataFrame, key: str = "question",
                   rating: str = "rating") -> DataFrame:
    """Answers with feedback folded in.  Only the first answer of a question
    receives that question's ratings; questions with no answer change nothing.

    Stored counts (if present) are added to, never overwritten, and the stored
    confidence is kept.
    """
    cols = answers.columns
    if "feedback_count" not in cols:
        answers = (answers.withColumn("feedback_count", F.lit(0).cast("bigint"))
                   .withColumn("feedback_sum", F.lit(0.0)))
    firsts = first_per_question(answers, ("answer_id",), key).withColumnRenamed("answer_id", "_first")
    t = feedback_totals(feedback, key, rating)
    got = firsts.join(t, key).select(F.col("_first").alias("answer_id"), "n", "total")
    out = answers.join(got, "answer_id", "left")
    cnt = (F.col("feedback_count") + F.coalesce("n", F.lit(0))).cast("bigint")
    tot = F.col("feedback_sum").cast(EXACT) + F.coalesce("total", F.lit(0).cast(EXACT))
    out = (out.withColumn("feedback_count", cnt).withColumn("_sum", tot)
           .withColumn("feedback_sum", F.col("_sum").cast("double"))
           .withColumn("average_feedback",
                       F.when(F.col("feedback_count") > 0,
                              F.round(F.col("_sum") / F.col("feedback_count"), 6).cast("double"))
                       .otherwise(F.lit(0.0)))
           .drop("n", "total", "_sum"))
    return out


def feedback_confidence(answers_with_feedback: DataFrame, key: str = "question") -> DataFrame:
    """Per question: the first answer that has feedback, scored by its mean
    rating; ``(NULL, 0.0)`` when no answer of the question has any."""
    rated = answers_with_feedback.where(F.col("feedback_count") > 0).withColumn(
        "score", F.col("average_feedback"))
    best = first_per_question(rated, ("answer", "score"), key)
    return (answers_with_feedback.select(key).distinct().join(best, key, "left")
            .select(key, "answer", F.round(F.coalesce("score", F.lit(0.0)), 6).alias("confidence")))
