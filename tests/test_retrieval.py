from pyspark.sql import functions as F

from webloom.operators import retrieval as R


def test_lexical_scores(spark):
    q = spark.createDataFrame([(1, "the fox")], "item_id long, text string")
    d = spark.createDataFrame([(10, "the fox"), (11, "the cat"), (12, "the dog"), (13, "fox fox")],
                              "doc_id long, text string")
    full = {r.did: r.sim for r in R.lexical_scores(q, d, q_id="item_id", q_text="text",
                                                   d_id="doc_id", d_text="text").collect()}
    assert full[10] == 1.0 and full[11] == 0.5 and full[13] == round(2 / (2 ** 0.5 * 2), 6)


def test_question_blocks_change_nothing(spark):
    q = spark.createDataFrame([(i, f"the fox {i % 3}x y{i}") for i in range(9)] + [(None, "the")], "item_id long, text string")
    d = spark.createDataFrame([(i, f"fox the the x y{i}", f"h{i % 2}") for i in range(7)] + [(None, "fox", "h"), (9, None, None)],
                              "doc_id long, text string, host string")
    kw = dict(q_id="item_id", q_text="text", d_id="doc_id", d_text="text", carry=("host",))
    one = sorted(map(tuple, R.lexical_scores(q, d, **kw).collect()))
    assert one == sorted(map(tuple, R.lexical_scores(q, d, block_terms=5, **kw).collect())) and len(one) == 63


def test_corpus_is_exchanged_once(spark):
    q = spark.createDataFrame([(1, "the fox")], "item_id long, text string")
    d = spark.createDataFrame([(10, "the fox"), (11, "the cat")], "doc_id long, text string")
    s = R.lexical_scores(q, d, q_id="item_id", q_text="text", d_id="doc_id", d_text="text")
    s.collect()
    plan = s._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "hashpartitioning(did" not in plan and "hashpartitioning(qid" not in plan
    assert sum("hashpartitioning(doc_id" in ln for ln in plan.splitlines()) == 1


def test_top_k_ties_break_on_id(spark):
    scores = spark.createDataFrame([(1, 5, 0.5), (1, 3, 0.5), (1, 4, 0.9), (1, 6, 0.1)],
                                   "qid long, did long, sim double")
    got = [(r["rank"], r.did) for r in R.top_k(scores, 3).orderBy("rank").collect()]
    assert got == [(1, 4), (2, 3), (3, 5)]


def test_scoring_partitions_follow_the_corpus(spark):
    """A scoring task gets a bounded number of pairs and characters (F3 to F12: its memory grew with the corpus)."""
    def parts(n, chars, questions):
        df = spark.range(n).select(F.col("id").alias("d"), F.repeat(F.lit("x"), chars).alias("t"))
        return R.bounded_parts(df, "t", questions)
    least = spark.sparkContext.defaultParallelism
    assert parts(10, 5, 3) == least and parts(0, 5, 3) == least
    assert parts(40_000, 5, 1000) == 40_000 * 1000 // R.TASK_PAIRS
    assert parts(1000, 240_000, 1) == 1000 * 240_000 // R.TASK_CHARS
