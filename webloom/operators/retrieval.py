"""Lexical retrieval: term rows, cosine scoring through a token equi-join, top-k.

The default embedder needs no model: a text becomes rows ``(id, token, tf)``,
so similarity of a question to a passage is an equi-join on ``token`` followed
by a sum per (question, passage), both inside the passage's partition.  No
dense vectors and no pairwise product are ever materialised; pairs that share
no token never meet.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.text import tokens
from ..session import cut_lineage, parallelism


def well_formed_documents(records: DataFrame, content_col: str = "content",
                          url_col: str = "url", keep: tuple[str, ...] = ()) -> DataFrame:
    """Keep records that have both a content and a url; reshape to documents.

    Empty content passes (presence is what is tested), it just yields no split.
    """
    return (records
            .where(F.col(content_col).isNotNull() & F.col(url_col).isNotNull())
            .select(*keep, F.col(content_col).alias("page_content"),
                    F.col(url_col).alias("source")))


def explode_tokens(df: DataFrame, keys: list, arr) -> DataFrame:
    """One row per token occurrence.

    ``explode_outer`` + a NULL filter rather than ``explode``: for ``explode``
    Catalyst infers a ``size(array) > 0`` filter below the generator, which
    evaluates the tokenising regex again for every row.
    """
    return (df.select(*keys, F.explode_outer(arr).alias("token"))
            .where(F.col("token").isNotNull()))


def term_rows(df: DataFrame, id_col: str, text_col: str, scope: str | None = None,
              carry: tuple[str, ...] = ()) -> DataFrame:
    """``([scope,] [carry...,] id, token, tf)``: token counts per text (the lexical
    embedding), with the columns of ``carry`` that depend on the id.

    Rows without an id (or scope) are dropped here, explicitly: the same
    filters a join on these keys would infer, so every consumer of one term
    table plans the identical subtree and Spark reuses its exchange instead
    of tokenising the corpus again.
    """
    sc = [*([scope] if scope else []), *carry]
    keys = [F.col(c) for c in sc] + [F.col(id_col).alias("id")]
    src = df.where(F.col(id_col).isNotNull())
    if scope:
        src = src.where(F.col(scope).isNotNull())
    return (explode_tokens(src, keys, tokens(F.col(text_col)))
            .groupBy(*sc, "id", "token")
            .agg(F.count(F.lit(1)).alias("tf")))


def _norms(terms: DataFrame, scope: str | None = None) -> DataFrame:
    return terms.groupBy(*([scope] if scope else []), "id").agg(
        F.sqrt(F.sum(F.col("tf") * F.col("tf"))).alias("norm"))


def _scoped_scores(questions: DataFrame, corpus: DataFrame, q_id: str, q_text: str, d_id: str,
                   d_text: str, scope: str) -> DataFrame:
    """Unrounded scores within a scope: an equi-join of term rows on (scope, token)."""
    qt, dt = term_rows(questions, q_id, q_text, scope), term_rows(corpus, d_id, d_text, scope)
    qn = _norms(qt, scope).withColumnsRenamed({"id": "qid", "norm": "qnorm"})
    dn = _norms(dt, scope).withColumnsRenamed({"id": "did", "norm": "dnorm"})
    dots = (qt.select(scope, F.col("id").alias("qid"), "token", F.col("tf").alias("qtf"))
            .join(dt.select(scope, F.col("id").alias("did"), "token", F.col("tf").alias("dtf")),
                  [scope, "token"])
            .groupBy(scope, "qid", "did").agg(F.sum(F.col("qtf") * F.col("dtf")).alias("dot")))
    return (dots.join(qn, [scope, "qid"]).join(dn, [scope, "did"])
            .select(scope, "qid", "did", (F.col("dot") / (F.col("qnorm") * F.col("dnorm"))).alias("sim")))


#: At most about so many (question, passage) pairs and characters of text are scored by one task.
TASK_PAIRS = 400_000
TASK_CHARS = 12_000_000


def bounded_parts(passages: DataFrame, text: str, n_questions: int = 0) -> int:
    """Partitions in which a task's passages, and their pairs with ``n_questions`` questions, are bounded."""
    rows, chars = passages.agg(F.count(F.lit(1)), F.sum(F.length(text).cast("bigint"))).first()
    return max(parallelism(passages.sparkSession), -(-rows * n_questions // TASK_PAIRS), -(-(chars or 0) // TASK_CHARS))


def lexical_scores(questions: DataFrame, corpus: DataFrame, *,
                   q_id: str, q_text: str, d_id: str, d_text: str,
                   scope: str | None = None, carry: tuple[str, ...] = (),
                   block_terms: int = 1_000_000, rounded: bool = True) -> DataFrame:
    """Cosine of token-count vectors for every (question, passage) sharing a token
    (and the same ``scope`` value when given: e.g. a question).  Columns of
    ``carry`` go along with the passage.

    The corpus is partitioned by passage once, as text; counting its terms,
    its norms, and the sums of products per (question, passage) then need no
    further exchange, because the question terms come to it by broadcast.
    They are counted first and sent in blocks of questions of about
    ``block_terms`` term rows, so the broadcast is bounded whatever their number.
    A partition holds a bounded number of passages, of characters, and of (question,
    passage) pairs (``bounded_parts``), so a task's memory does not grow with the corpus.
    """
    if scope:
        scores = _scoped_scores(questions, corpus, q_id, q_text, d_id, d_text, scope)
        return scores.withColumn("sim", F.round("sim", 6)) if rounded else scores
    qt = term_rows(questions, q_id, q_text)
    asked = cut_lineage(qt.join(_norms(qt).withColumnRenamed("norm", "qnorm"), "id")
             .select(F.col("id").alias("qid"), "token", F.col("tf").alias("qtf"), "qnorm"))
    terms, n_questions = asked.agg(F.count(F.lit(1)), F.countDistinct("qid")).first()
    blocks = max(1, -(-terms // block_terms))
    passages = corpus.select(d_id, d_text, *carry).where(F.col(d_id).isNotNull())
    parts = bounded_parts(passages, d_text, -(-n_questions // blocks))
    dt = term_rows(passages.repartition(parts, F.col(d_id)), d_id, d_text, carry=carry)
    squares = F.sum(F.col("tf") * F.col("tf")).over(Window.partitionBy(*carry, "id"))
    dt = dt.select(*carry, F.col("id").alias("did"), "token", F.col("tf").alias("dtf"), F.sqrt(squares).alias("dnorm"))
    out = None
    for b in range(blocks):
        mine = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == b)
        part = (dt.join(F.broadcast(mine), "token").groupBy("qid", "qnorm", *carry, "did", "dnorm")
                .agg(F.sum(F.col("qtf") * F.col("dtf")).alias("dot")))
        out = part if out is None else out.unionByName(part)
    sim = F.col("dot") / (F.col("qnorm") * F.col("dnorm"))
    return out.select(*carry, "qid", "did", (F.round(sim, 6) if rounded else sim).alias("sim"))


def top_k(scores: DataFrame, k: int = C.TOP_K, *, by: str | list[str] = "qid",
          score: str = "sim", tie: str = "did") -> DataFrame:
    """Keep the k best rows per ``by`` (score desc, then ``tie`` asc) with ``rank``.

    ``row_number() <= k`` lets Spark insert a partial WindowGroupLimit before
    the shuffle, so at most k rows per key and map task cross the network.
    """
    w = Window.partitionBy(*([by] if isinstance(by, str) else by)).orderBy(
        F.col(score).desc(), F.col(tie).asc())
    return (scores.withColumn("rank", F.row_number().over(w))
            .where(F.col("rank") <= k))


def lexical_top_k(questions: DataFrame, corpus: DataFrame, k: int = C.TOP_K, *,
                  q_id: str = "item_id", q_text: str = "text",
                  d_id: str = "doc_id", d_text: str = "text") -> DataFrame:
    """``(qid, rank, did, sim)`` for the k nearest passages of each question."""
    s = lexical_scores(questions, corpus, q_id=q_id, q_text=q_text, d_id=d_id, d_text=d_text)
    return top_k(s, k).select("qid", "rank", "did", "sim")


def attach_passages(hits: DataFrame, corpus: DataFrame, *, d_id: str = "doc_id",
                    d_text: str = "text", d_source: str = "source") -> DataFrame:
    """Join the retrieved ids back to their text and source (column-pruned)."""
    return hits.join(corpus.select(F.col(d_id).alias("did"),
                                   F.col(d_text).alias("passage"),
                                   F.col(d_source).alias("source")), "did")


def retrieved_sources(hits_with_passages: DataFrame) -> DataFrame:
    """Distinct sources of the retrieved passages per question (sorted)."""
    return (hits_with_passages.groupBy("qid")
            .agg(F.array_sort(F.collect_set("source")).alias("sources")))


def assemble_context(hits_with_passages: DataFrame,
                     separator: str = C.CONTEXT_SEPARATOR) -> DataFrame:
    """Concatenate retrieved passages in rank order (k per question, bounded)."""
    ranked = F.array_sort(F.collect_list(F.struct("rank", "passage")))
    return (hits_with_passages.groupBy("qid")
            .agg(F.array_join(F.transform(ranked, lambda x: x["passage"]),
                              separator).alias("context")))


def build_prompt(contexts: DataFrame, questions: DataFrame, *,
                 q_id: str = "item_id", q_text: str = "text",
                 template: str = C.SYSTEM_PROMPT) -> DataFrame:
    """System message with ``{context}`` filled in, human message = question."""
    head, tail = template.split("{context}")
    return (contexts.join(questions.select(F.col(q_id).alias("qid"),
                                           F.col(q_text).alias("question")), "qid")
            .select("qid",
                    F.concat(F.lit(head), F.col("context"), F.lit(tail)).alias("system"),
                    F.col("question").alias("human")))
