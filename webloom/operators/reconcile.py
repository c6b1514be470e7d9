"""Reconciling the candidate answers of several hosts into one.

Per question: keep valid answers, build similarity neighbourhoods (every
answer's set of answers at or above the threshold, itself included; not
transitive), take the largest neighbourhood (ties: lowest answer index), its
most frequent answer (ties: smallest answer) and the mean confidence of its
members; sources are the union over *all* valid answers.  Every step is a
grouped aggregate, so no question is ever collected whole.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from .answers import valid_answers
from .similarity import DEFAULT_BLOCK_ROWS, similarity_pairs


def neighbourhoods(answers: DataFrame, threshold: float = C.SIMILARITY_THRESHOLD, *,
                   question: str = "question", answer_id: str = "answer_id",
                   vec_col: str = "embedding", block_rows: int = DEFAULT_BLOCK_ROWS) -> DataFrame:
    """``(question, i, j)``: j is in the neighbourhood of i."""
    return similarity_pairs(answers, threshold, id_col=answer_id, vec_col=vec_col,
                            scope=question, block_rows=block_rows).select(question, "i", "j")


def neighbour_counts(pairs: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    return pairs.groupBy(*keys, "i").agg(F.count(F.lit(1)).alias("n"))


def best_cluster(pairs: DataFrame, question: str = "question",
                 order_col: str | None = None) -> DataFrame:
    """``(question, i, size)`` of the largest neighbourhood.

    Ties go to the lowest ``order_col`` of i when given (a column of
    ``pairs``, constant per i, e.g. the answering host), else the lowest i.
    """
    keys = (question,) + ((order_col,) if order_col else ())
    counts = neighbour_counts(pairs, keys)
    rank = [(-F.col("n")).alias("neg")] + ([F.col(order_col)] if order_col else []) + ["i"]
    best = counts.groupBy(question).agg(F.min(F.struct(*rank)).alias("b"))
    return best.select(question, F.col("b.i").alias("i"), (-F.col("b.neg")).alias("size"))


def best_answer(answers: DataFrame, pairs: DataFrame, *, question: str = "question",
                answer_id: str = "answer_id", answer: str = "answer",
                confidence: str = "confidence", order_col: str | None = None) -> DataFrame:
    """``(question, answer, confidence, size)`` from the winning neighbourhood."""
    best = best_cluster(pairs, question, order_col)
    members = (pairs.join(best.select(question, "i", "size"), [question, "i"])
               .select(question, "size", F.col("j").alias(answer_id))
               .join(answers.select(question, answer_id, answer, confidence),
                     [question, answer_id]))
    votes = members.groupBy(question, answer).agg(F.count(F.lit(1)).alias("votes"))
    mode = votes.groupBy(question).agg(
        F.min(F.struct((-F.col("votes")).alias("neg"), F.col(answer).alias("a"))).alias("m"))
    # exact decimal mean, rounded half-up: no dependence on summation order or
    # on how an engine rounds a binary double that lies on a half
    conf = members.groupBy(question).agg(F.avg(F.col(confidence).cast("decimal(30,12)")).alias("conf"),
                                         F.first("size").alias("size"))
    return (mode.join(conf, question)
            .select(question, F.col("m.a").alias(answer),
                    F.round("conf", 6).cast("double").alias(confidence), "size"))


def answer_sources(answers: DataFrame, *, question: str = "question",
                   sources: str = "sources") -> DataFrame:
    """Distinct ``(question, source)`` over all valid answers (the source union
    as a relation, so a question with many answers is never one array)."""
    return (valid_answers(answers)
            .select(question, F.explode(sources).alias("source")).distinct())


def reconcile(answers: DataFrame, questions: DataFrame | None = None,
              threshold: float = C.SIMILARITY_THRESHOLD, *, question: str = "question",
              answer_id: str = "answer_id", block_rows: int = DEFAULT_BLOCK_ROWS) -> DataFrame:
    """One final row per question: ``(question, answer, sources, confidence)``.

    ``answers`` = ``(question, answer_id, answer, embedding, confidence,
    sources)``.  Questions (from ``questions`` when given) without a valid
    answer get the fixed "no valid answers" row with no sources and 0.0.
    The final source list per question is bounded by its answers' sources.
    """
    valid = valid_answers(answers)
    pairs = neighbourhoods(valid, threshold, question=question, answer_id=answer_id,
                           block_rows=block_rows)
    won = best_answer(valid, pairs, question=question, answer_id=answer_id)
    srcs = (answer_sources(valid, question=question)
            .groupBy(question).agg(F.array_sort(F.collect_list("source")).alias("sources")))
    everyone = (questions.select(question) if questions is not None
                else answers.select(question)).distinct()
    out = everyone.join(won, question, "left").join(srcs, question, "left")
    return out.select(
        question,
        F.coalesce("answer", F.lit(C.NO_VALID_ANSWERS)).alias("answer"),
        F.coalesce("sources", F.array().cast("array<string>")).alias("sources"),
        F.coalesce("confidence", F.lit(0.0)).alias("confidence"))


def confident(final: DataFrame, gate: float = C.CONFIDENCE_GATE) -> DataFrame:
    """Answers that pass the confidence gate (returned without re-scraping)."""
    return final.where(F.col("answer").isNotNull() & (F.col("confidence") >= gate))
