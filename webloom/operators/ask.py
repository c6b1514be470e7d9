"""The whole question-answering pass over a *table* of questions.

questions -> cached? (exact-match lookup in the answer store) -> otherwise
retrieve the k nearest passages (globally, or per host) -> context and prompt
-> generator -> one candidate answer per (question, host) -> reconcile the
hosts' candidates -> confidence gate flag.  The fan-out over hosts is a
``host`` column, never a cross product: a question meets a host's passages
only through shared tokens.

The generator is a seam: a function from the prompts DataFrame
``(qid, host, system, human)`` to ``(qid, host, answer)``, e.g. a
``mapInPandas`` calling a model.  The shipped default is extractive and
needs none: the top-ranked passage is the answer and its similarity the
confidence.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..session import cut_lineage
from . import answers as A
from . import reconcile as RC
from . import retrieval as R
from . import similarity as V

Generator = Callable[[DataFrame], DataFrame]
#: ``(id, text)`` to ``(id, embedding array<double>)``, e.g. a ``mapInPandas`` model call.
Embedder = Callable[[DataFrame], DataFrame]


#: Up to so many hosts are named to the passage scan, which then reads their folders only.
MAX_NAMED_HOSTS = 10_000


def dense_hits(questions: DataFrame, passages: DataFrame, k: int, embedder: Embedder) -> DataFrame:
    """``(qid, rank, did, sim)``: the k passages nearest to each question by the
    cosine of the embedder's vectors (exact, in blocks of vectors; ``pid`` is a bigint)."""
    qs, ps = _embedded(questions, passages, embedder)
    return V.knn(qs, ps, k, q_id="id", d_id="id")


def _embedded(questions: DataFrame, passages: DataFrame, embedder: Embedder) -> tuple[DataFrame, DataFrame]:
    # counted, dealt into blocks and joined: embedded once
    return (cut_lineage(embedder(questions.select(F.col("qid").alias("id"), F.col("question").alias("text")))),
            cut_lineage(embedder(passages.select(F.col("pid").alias("id"), F.col("chunk").alias("text")))))


def dense_host_hits(questions: DataFrame, passages: DataFrame, k: int, embedder: Embedder,
                    hosts: DataFrame | None = None) -> DataFrame:
    """``(host, qid, rank, did, sim)``: the k nearest of each host's own passages, of the
    question's hosts where a list is given (its vectors then meet those hosts' blocks only)."""
    qs, ps = _embedded(questions, passages, embedder)
    ps = ps.join(passages.select(F.col("pid").alias("id"), "host"), "id")
    if hosts is None:
        return V.knn_within(qs, ps, k, "host")
    asked = qs.join(hosts.select(F.col("qid").alias("id"), "host"), "id")
    return V.knn(asked, ps, k, q_id="id", d_id="id", scope="host")


def asked_hosts(hosts: DataFrame) -> DataFrame:
    """``(qid, host)`` once each; rows with a null in either are no request."""
    return hosts.select("qid", "host").where(F.col("qid").isNotNull() & F.col("host").isNotNull()).distinct()


def passages_of(passages: DataFrame, hosts: DataFrame, max_named: int = MAX_NAMED_HOSTS) -> DataFrame:
    """Passages of the hosts that some question names.  Few hosts are a literal filter, which
    prunes the folders of a table partitioned by host; beyond ``max_named`` they are joined."""
    names = hosts.select("host").distinct()
    few = [r.host for r in names.limit(max_named + 1).collect()]
    if len(few) > max_named:
        return passages.join(names, "host", "left_semi")
    return passages.where(F.col("host").isin(few))


def host_answers(questions: DataFrame, passages: DataFrame, k: int = C.TOP_K, *,
                 scope: str = "global", generator: Generator | None = None,
                 embedder: Embedder | None = None, hosts: DataFrame | None = None,
                 hits: DataFrame | None = None) -> DataFrame:
    """``(qid, host, answer_id, answer, confidence, sources, status)`` per question and host.

    ``questions``: ``(qid, question)``; ``passages``: ``(pid, host, source, chunk)``.
    ``scope="global"`` ranks all passages for every host (so all hosts agree);
    ``scope="host"`` ranks each host's own passages.  With an ``embedder``
    passages are ranked by dense vectors instead of terms.  ``hosts``, rows
    ``(qid, host)``, is each question's list: only these hosts' passages are ranked
    for it, and a question that names none gets no answer.  ``hits``, rows ``(qid, [host,]
    rank, did, sim)``, are passages that were ranked before: nothing is scored then.
    """
    if scope not in ("global", "host"):
        raise ValueError(f"unknown scope {scope!r}")
    by_host = scope == "host"
    if hosts is not None:
        hosts = asked_hosts(hosts)
        passages = passages_of(passages, hosts)
    ranked_before = hits is not None
    if ranked_before:
        pass
    elif embedder is not None and hosts is None:
        hits = (dense_host_hits if by_host else dense_hits)(questions, passages, k, embedder)
    elif embedder is not None:
        hits = dense_host_hits(questions, passages, k, embedder, hosts)   # global: the k best are among the hosts' k best
        hits = hits if by_host else R.top_k(hits.drop("rank"), k, by="qid")
    else:
        scores = R.lexical_scores(questions, passages, q_id="qid", q_text="question", d_id="pid", d_text="chunk",
                                  carry=("host",) if by_host or hosts is not None else ())
        if hosts is not None:
            scores = scores.join(hosts, ["qid", "host"], "left_semi")
        hits = R.top_k(scores, k, by=["qid", "host"] if by_host else "qid")
    # rank on ids and host only; passage text joins the k winners afterwards
    hits = hits.select("qid", "host" if by_host else F.lit("*").alias("host"), "rank", "did", "sim")
    if not ranked_before:      # read by the sources and by the answers: the corpus is scored once
        hits = cut_lineage(hits)
    hits = hits.join(passages.select(F.col("pid").alias("did"), "source",
                                     F.col("chunk").alias("passage")), "did")
    keys = ["qid", "host"]
    srcs = hits.groupBy(*keys).agg(F.array_sort(F.collect_set("source")).alias("sources"))
    if generator is None:
        top = hits.where(F.col("rank") == 1).select(
            *keys, F.col("passage").alias("answer"), F.col("sim").alias("confidence"))
    else:
        ctx = hits.groupBy(*keys).agg(F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("rank", "passage"))),
                        lambda x: x["passage"]), C.CONTEXT_SEPARATOR).alias("context"))
        head, tail = C.SYSTEM_PROMPT.split("{context}")
        prompts = ctx.join(questions.select("qid", F.col("question").alias("human")), "qid") \
                     .select(*keys, F.concat(F.lit(head), "context", F.lit(tail)).alias("system"),
                             "human")
        best = hits.where(F.col("rank") == 1).select(*keys, F.col("sim").alias("confidence"))
        top = generator(prompts).join(best, keys)
    # a host whose generation failed (NULL or a sentinel text) keeps its row and its status
    return (top.join(srcs, keys)
            .withColumn("answer_id", F.xxhash64("host"))
            .withColumn("status", A.answer_status(F.col("answer"))))


def lexical_neighbourhoods(answers: DataFrame, threshold: float = C.SIMILARITY_THRESHOLD,
                           question: str = "qid") -> DataFrame:
    """``(qid, i, j)``: answers of one question whose token cosine >= threshold.
    A lone answer is its own neighbourhood even when it has no tokens."""
    a = answers.withColumnRenamed(question, "_q")
    s = R.lexical_scores(a, a, q_id="answer_id", q_text="answer",
                         d_id="answer_id", d_text="answer", scope="_q", rounded=False)
    pairs = s.where(F.col("sim") >= threshold).select(F.col("_q").alias(question),
                                                      F.col("qid").alias("i"),
                                                      F.col("did").alias("j"))
    lone = (answers.groupBy(question).agg(F.count(F.lit(1)).alias("n"),
                                          F.min("answer_id").alias("i"))
            .where(F.col("n") == 1).select(question, "i", F.col("i").alias("j")))
    return pairs.unionByName(lone).distinct()


def from_store(questions: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(qid, question, answer, sources, confidence)`` of the questions whose answer is
    stored, and the other questions."""
    # one row for each question, however often the append-only store repeats an answer
    payload = ("answer", *[c for c in ("sources", "confidence") if c in cache.columns])
    hit = A.cache_lookup(questions, cache, cols=payload).where(F.col("answer").isNotNull())
    cached = questions.join(hit, "question").select(
        "qid", "question", "answer",
        (F.col("sources") if "sources" in cache.columns
         else F.array().cast("array<string>")).alias("sources"),
        (F.col("confidence") if "confidence" in cache.columns else F.lit(0.0)).alias("confidence"))
    return cached, questions.join(cached.select("qid"), "qid", "left_anti")


def ask(questions: DataFrame, passages: DataFrame, cache: DataFrame | None = None, *,
        k: int = C.TOP_K, scope: str = "global", threshold: float = C.SIMILARITY_THRESHOLD,
        gate: float = C.CONFIDENCE_GATE, generator: Generator | None = None,
        embedder: Embedder | None = None, hosts: DataFrame | None = None,
        hits: DataFrame | None = None) -> DataFrame:
    """``(qid, question, answer, sources, confidence, cached, confident)``, one row
    per question.  Cached questions are answered from the store and skip the rest.
    ``hosts`` and ``hits`` as in ``host_answers``."""
    qs = questions.select("qid", "question")
    if cache is not None:
        cached, todo = from_store(qs, cache)
        cached = cached.withColumn("cached", F.lit(True))
    else:
        cached, todo = None, qs
    # candidates feed four consumers: materialise once (reliable checkpoint)
    cand = cut_lineage(A.valid_answers(host_answers(todo, passages, k, scope=scope,
                                                    generator=generator, embedder=embedder, hosts=hosts,
                                                    hits=hits)))
    # ties between equally large neighbourhoods go to the lowest host name
    pairs = (lexical_neighbourhoods(cand.select("qid", "answer_id", "answer"), threshold)
             .join(cand.select("qid", F.col("answer_id").alias("i"),
                               F.col("host").alias("i_host")), ["qid", "i"]))
    won = RC.best_answer(cand, pairs, question="qid", order_col="i_host")
    srcs = (cand.select("qid", F.explode("sources").alias("source")).distinct()
            .groupBy("qid").agg(F.array_sort(F.collect_list("source")).alias("sources")))
    fresh = (todo.join(won.drop("size"), "qid", "left").join(srcs, "qid", "left")
             .select("qid", "question",
                     F.coalesce("answer", F.lit(C.NO_VALID_ANSWERS)).alias("answer"),
                     F.coalesce("sources", F.array().cast("array<string>")).alias("sources"),
                     F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
                     F.lit(False).alias("cached")))
    out = fresh if cached is None else fresh.unionByName(cached)
    return out.withColumn("confident", F.col("confidence") >= F.lit(gate))


def answers_to_store(final: DataFrame, ts) -> DataFrame:
    """Newly computed answers worth caching (not cached ones, not the sentinel)."""
    new = A.valid_answers(final.where(~F.col("cached")))
    return A.answer_rows(new, ts, confidence=F.col("confidence"))


def ask_fresh_first(questions: DataFrame, passages: DataFrame, listing: DataFrame, now,
                    cache: DataFrame | None = None, *, max_age_days: int = C.MAX_AGE_DAYS,
                    k: int = C.TOP_K, scope: str = "global",
                    threshold: float = C.SIMILARITY_THRESHOLD, gate: float = C.CONFIDENCE_GATE,
                    generator: Generator | None = None) -> DataFrame:
    """The full question flow with freshness, one row per question plus ``stage``.

    * ``cache``: answered from the store;
    * ``fresh``: answered from the passages of fresh hosts only and confident
      enough to return early (such answers are not stored);
    * ``all``: every other question, answered over all hosts' passages (where
      the stale hosts would have been fetched again); these are the ones to store.

    ``listing`` is ``(host, ts)`` of stored objects; freshness as in
    ``operators.freshness``.  The corpus is scored once for both passes: the k
    best passages of each (question, host), or in global scope of each question
    among fresh and among other hosts, hold the k best of either pass.
    """
    from .freshness import fresh_host_set
    if scope not in ("global", "host"):
        raise ValueError(f"unknown scope {scope!r}")
    fresh = fresh_host_set(listing, now, max_age_days)
    qs = questions.select("qid", "question")
    todo = qs if cache is None else from_store(qs, cache)[1]
    part = "host" if scope == "host" else "is_fresh"
    flagged = passages.join(fresh.select("host", F.lit(True).alias("is_fresh")), "host", "left")
    scores = R.lexical_scores(todo, flagged, q_id="qid", q_text="question", d_id="pid", d_text="chunk",
                              carry=("host", "is_fresh") if scope == "host" else ("is_fresh",))
    ranked = cut_lineage(R.top_k(scores, k, by=["qid", part]))

    def hits(rows: DataFrame) -> DataFrame:
        return rows if scope == "host" else R.top_k(rows.drop("rank"), k, by="qid")

    same = dict(k=k, scope=scope, threshold=threshold, gate=gate, generator=generator)
    # read three times below: computed once
    first = cut_lineage(ask(qs, passages, cache, hits=hits(ranked.where("is_fresh")), **same))
    early = first.where(F.col("cached") | F.col("confident")).withColumn(
        "stage", F.when(F.col("cached"), F.lit("cache")).otherwise(F.lit("fresh")))
    rest = qs.join(early.select("qid"), "qid", "left_anti")
    second = ask(rest, passages, None, hits=hits(ranked.join(rest.select("qid"), "qid", "left_semi")),
                 **same).withColumn("stage", F.lit("all"))
    return early.unionByName(second)


def answers_to_store_after_flow(final: DataFrame, ts) -> DataFrame:
    """From ``ask_fresh_first``: only second-pass answers are stored (not
    cached ones, not early confident returns, not the sentinel)."""
    new = A.valid_answers(final.where(F.col("stage") == "all"))
    return A.answer_rows(new, ts, confidence=F.col("confidence"))
