"""Every registered query.  Each reads whole driver tables (no id subsets)."""
from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..session import path_exists, table, table_stream
from ..operators import retrieval as R
from .registry import ORACLE_SQL, register

# ---------------------------------------------------------------- M0: retrieval

_SQL_TERMS = """
qt AS (SELECT id, token, count(*) AS tf FROM (
         SELECT item_id AS id, unnest(regexp_extract_all(lower(text), '[\\p{L}]+')) AS token
         FROM benchmark) GROUP BY id, token),
dt AS (SELECT id, token, count(*) AS tf FROM (
         SELECT doc_id AS id, unnest(regexp_extract_all(lower(text), '[\\p{L}]+')) AS token
         FROM documents) GROUP BY id, token),
qn AS (SELECT id, sqrt(sum(tf * tf)) AS norm FROM qt GROUP BY id),
dn AS (SELECT id, sqrt(sum(tf * tf)) AS norm FROM dt GROUP BY id),
dots AS (SELECT qt.id AS qid, dt.id AS did, sum(qt.tf * dt.tf) AS dot
         FROM qt JOIN dt ON qt.token = dt.token GROUP BY 1, 2),
scored AS (SELECT qid, did, round(dot / (qn.norm * dn.norm), 6) AS sim
           FROM dots JOIN qn ON qn.id = qid JOIN dn ON dn.id = did),
hits AS (SELECT qid, CAST(rank AS INTEGER) AS rank, did, sim FROM (
           SELECT *, row_number() OVER (PARTITION BY qid ORDER BY sim DESC, did) AS rank
           FROM scored) WHERE rank <= 4),
hitp AS (SELECT hits.*, d.text AS passage, d.source AS source
         FROM hits JOIN documents d ON d.doc_id = hits.did)
"""


def _hits(spark, d):
    bench, docs = table(spark, d, "benchmark"), table(spark, d, "documents", spread=True)
    return R.attach_passages(R.lexical_top_k(bench, docs), docs), bench


@register("docs_wellformed", sql="""
SELECT doc_id, text AS page_content, source FROM documents
WHERE text IS NOT NULL AND source IS NOT NULL AND lang <> 'fr'
""")
def docs_wellformed(spark, d):
    """Records whose URL is missing (here: those in French) are not documents."""
    docs = table(spark, d, "documents").withColumn("source", F.when(F.col("lang") != "fr", F.col("source")))
    return R.well_formed_documents(docs, "text", "source", keep=("doc_id",))


@register("doc_terms", sql="""
SELECT id, token, count(*) AS tf FROM (
  SELECT doc_id AS id, unnest(regexp_extract_all(lower(text), '[\\p{L}]+')) AS token
  FROM documents) GROUP BY id, token
""")
def doc_terms(spark, d):
    return R.term_rows(table(spark, d, "documents", spread=True), "doc_id", "text")


@register("lexical_top4", sql="WITH " + _SQL_TERMS + "SELECT qid, rank, did, sim FROM hits")
def lexical_top4(spark, d):
    return R.lexical_top_k(table(spark, d, "benchmark"), table(spark, d, "documents", spread=True))


@register("retrieved_sources", sql="WITH " + _SQL_TERMS + """
SELECT qid, list_sort(list_distinct(list(source))) AS sources FROM hitp GROUP BY qid
""")
def retrieved_sources(spark, d):
    return R.retrieved_sources(_hits(spark, d)[0])


@register("ask_context", sql="WITH " + _SQL_TERMS + """
SELECT qid, string_agg(passage, chr(10) || chr(10) ORDER BY rank) AS context
FROM hitp GROUP BY qid
""")
def ask_context(spark, d):
    return R.assemble_context(_hits(spark, d)[0])


@register("ask_prompt", sql="WITH " + _SQL_TERMS + """,
ctx AS (SELECT qid, string_agg(passage, chr(10) || chr(10) ORDER BY rank) AS context
        FROM hitp GROUP BY qid)
SELECT ctx.qid AS qid,
       'You are an assistant for question-answering tasks. Use the following pieces of '
       || 'retrieved context to answer the question. If you don''t know the answer, say '
       || 'that you don''t know.' || chr(10) || chr(10) || ctx.context AS system,
       b.text AS human
FROM ctx JOIN benchmark b ON b.item_id = ctx.qid
""")
def ask_prompt(spark, d):
    hits, bench = _hits(spark, d)
    return R.build_prompt(R.assemble_context(hits), bench)


# ---------------------------------------------------------------- M1: pages
from ..operators import pages as P  # noqa: E402
from . import sql_snippets as S  # noqa: E402
from ..session import cut_lineage, scratch_path  # noqa: E402
from ..sinks import store as ST  # noqa: E402

RUN_TS = 1717171717.5  # record timestamp (epoch seconds) used by registered queries


def _pages(spark, d):
    return table(spark, d, "pages", spread=True)


@register("page_hosts", sql=f"""
SELECT {S.netloc('url')} AS host, count(*) AS n_pages FROM pages GROUP BY 1
""")
def page_hosts(spark, d):
    return P.page_hosts(_pages(spark, d))


@register("page_text", sql=S.PAGE_TEXT)
def page_text(spark, d):
    return P.page_text(_pages(spark, d))


@register("extract_rejects", sql=f"""
SELECT page_id, url, CASE WHEN url LIKE '%/fr/%' THEN 'ValueError: no html' ELSE 'no text' END AS reason
FROM (SELECT p.page_id, p.url, p.html, t.content FROM pages p
      LEFT JOIN ({S.PAGE_TEXT}) t ON t.page_id = p.page_id)
WHERE url LIKE '%/fr/%' OR url LIKE '%/de/%' OR content IS NULL
""")
def extract_rejects(spark, d):
    """French pages come without html, German ones without text: both are rejects."""
    html = (F.when(F.col("url").contains("/fr/"), F.lit(None).cast("string"))
            .when(F.col("url").contains("/de/"), "<html><script>var p;</script><p> </p></html>").otherwise(F.col("html")))
    return P.extract_rejects(_pages(spark, d).withColumn("html", html))


@register("page_title_content", sql=f"""
SELECT page_id, url, {S.nonempty(S.nodes('h', 'title'))}[1] AS title,
       array_to_string({S.nonempty(S.nodes('h', 'p'))}, ' ') AS content
FROM ({S.CLEAN_PAGES})
""")
def page_title_content(spark, d):
    return P.page_title_content(_pages(spark, d))


@register("page_links", sql=S.PAGE_LINKS)
def page_links(spark, d):
    return P.page_links(_pages(spark, d))


@register("internal_links", sql=f"""
WITH l AS (SELECT page_id, page_id // 4 AS batch_id, {S.netloc('url')} AS host, link,
                  {S.netloc('link')} AS link_host
           FROM ({S.PAGE_LINKS}) WHERE starts_with(link, 'http')),
allowed AS (SELECT DISTINCT page_id // 4 AS batch_id, {S.netloc('url')} AS link_host FROM pages)
SELECT page_id, batch_id, host, link, link_host FROM l
WHERE EXISTS (SELECT 1 FROM allowed a WHERE a.batch_id = l.batch_id AND a.link_host = l.link_host)
""")
def internal_links(spark, d):
    return P.internal_links(_pages(spark, d))


_SQL_ROOT_LINKS = f"""
WITH l AS (SELECT page_id, page_id // 4 AS batch_id, link,
                  {S.root_domain(S.hostname('link'))} AS root_domain
           FROM ({S.PAGE_LINKS})),
s AS (SELECT batch_id, {S.root_domain(S.hostname('first_seed'))} AS start_root
      FROM (SELECT page_id // 4 AS batch_id, arg_min(url, page_id) AS first_seed
            FROM pages GROUP BY 1))
SELECT page_id, batch_id, link, root_domain FROM l
WHERE {{neg}} EXISTS (SELECT 1 FROM s WHERE s.batch_id = l.batch_id AND s.start_root = l.root_domain)
"""


@register("root_domain_links", sql=_SQL_ROOT_LINKS.format(neg=""))
def root_domain_links(spark, d):
    return P.root_domain_links(_pages(spark, d))


@register("root_domain_skipped", sql=_SQL_ROOT_LINKS.format(neg="NOT"))
def root_domain_skipped(spark, d):
    return P.root_domain_links(_pages(spark, d), keep=False)


@register("clean_urls", sql=r"""
SELECT page_id, url,
  CASE WHEN regexp_matches(url, '[?&]ref=[^&#]') THEN
    regexp_extract(url, '^([^?#]*)', 1)
    || CASE WHEN q <> '' THEN '?' || q ELSE '' END
    || regexp_extract(url, '(#.*)$', 1)
  ELSE url END AS clean_url
FROM (SELECT page_id, url,
        array_to_string(list_filter(string_split(regexp_extract(url, '\?([^#]*)', 1), '&'),
                        lambda x: NOT starts_with(x, 'ref=') AND regexp_matches(x, '=.')), '&') AS q
      FROM pages)
""")
def clean_urls(spark, d):
    return P.clean_urls(_pages(spark, d), param="ref")


@register("root_domains", sql=f"""
SELECT page_id, {S.hostname('url')} AS hostname, {S.root_domain(S.hostname('url'))} AS root_domain
FROM pages
""")
def root_domains(spark, d):
    return P.root_domains(_pages(spark, d))


@register("distinct_pages", sql="""
SELECT regexp_replace(url, '#.*$', '') AS url_key, min(page_id) AS page_id FROM pages GROUP BY 1
""")
def distinct_pages(spark, d):
    return P.distinct_pages(_pages(spark, d))


@register("distinct_links", sql=f"""
SELECT regexp_replace(link, '#.*$', '') AS url_key, min(page_id) AS page_id FROM ({S.PAGE_LINKS}) GROUP BY 1
""")
def distinct_links(spark, d):
    """The pages that links lead to, each once."""
    return P.distinct_pages(P.page_links(_pages(spark, d)).select("page_id", F.col("link").alias("url")))


_FIXED = 41 + len(repr(RUN_TS))
_SQL_RECORDS = f"""
SELECT page_id, host, url, content, CAST({RUN_TS!r} AS DOUBLE) AS timestamp,
       CAST({_FIXED} + {S.json_len('url')} + {S.json_len('content')} AS BIGINT) AS record_size
FROM ({S.PAGE_TEXT})
"""


@register("host_pages", sql=f"""
SELECT host, count(*) AS n_records, CAST(sum(record_size) AS BIGINT) AS buffer_chars
FROM ({_SQL_RECORDS}) GROUP BY host
""")
def host_pages(spark, d):
    return P.host_pages(_pages(spark, d), RUN_TS)


# ---------------------------------------------------------------- M2: answer store
from ..operators import answers as A  # noqa: E402
from ..operators import freshness as FR  # noqa: E402
from ..functions.text import normalise_answer  # noqa: E402
from ..functions.urls import hostname, netloc as _netloc, root_domain, strip_fragment  # noqa: E402

NOW = "2024-02-05 00:00:00"   # evaluation clock of the freshness queries
FRESH_DAYS = 10               # max age used by the freshness queries
HOST_DAYS = 5                 # of the listing by user id, where every host has an event in the last ten days

_SQL_PAIRS = """
pairs AS (SELECT a.conv_id AS conv_id, a.turn AS turn, u.text AS question, a.text AS answer
          FROM conversations u JOIN conversations a
            ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
          WHERE u.role = 'user' AND a.role = 'assistant'),
firsts AS (SELECT question, conv_id, turn, answer FROM (
             SELECT *, row_number() OVER (PARTITION BY question ORDER BY conv_id, turn, answer) AS r FROM pairs)
           WHERE r = 1)
"""


def _pairs(spark, d):
    return A.conversation_pairs(table(spark, d, "conversations"))


def _flat(answers):
    """Answer ids as their two columns."""
    return answers.select("answer_id.conv_id", "answer_id.turn", *[c for c in answers.columns if c != "answer_id"])


@register("first_answer", sql="WITH " + _SQL_PAIRS + """
SELECT question, conv_id, turn, answer FROM firsts
""")
def first_answer(spark, d):
    return _flat(A.first_per_question(_pairs(spark, d)))


@register("cache_lookup", sql="WITH " + _SQL_PAIRS + """,
q AS (SELECT DISTINCT text AS question FROM conversations WHERE role = 'user')
SELECT q.question, f.conv_id, f.turn, f.answer
FROM q LEFT JOIN firsts f ON f.question = q.question
""")
def cache_lookup(spark, d):
    conv = table(spark, d, "conversations")
    qs = conv.where(F.col("role") == "user").select(F.col("text").alias("question"))
    return _flat(A.cache_lookup(qs, _pairs(spark, d)))


@register("valid_answers", sql="WITH " + _SQL_PAIRS + """
SELECT conv_id, turn, question, answer FROM pairs WHERE answer IS NOT NULL AND answer <> ''
""")
def valid_answers(spark, d):
    asked = A.conversation_pairs(table(spark, d, "conversations"), unanswered=True)
    return _flat(A.valid_answers(asked).select("answer_id", "question", "answer"))


@register("answers_append", sql="WITH " + _SQL_PAIRS + """
SELECT conv_id, turn, question, answer, CAST(0.0 AS DOUBLE) AS confidence,
       CAST(0 AS BIGINT) AS feedback_count, CAST(0.0 AS DOUBLE) AS feedback_sum,
       CAST(0.0 AS DOUBLE) AS average_feedback
FROM pairs WHERE answer IS NOT NULL AND answer <> ''
""")
def answers_append(spark, d):
    asked = A.conversation_pairs(table(spark, d, "conversations"), unanswered=True)
    path = scratch_path(spark, "answers")
    ST.append_answers(A.answer_rows(A.storable(asked), ts=NOW, id_col="answer_id"), path)
    return _flat(spark.read.parquet(path).drop("ts", "sources"))


@register("first_document", sql="""
SELECT source AS question, doc_id, text AS answer FROM (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents) WHERE r = 1
""")
def first_document(spark, d):
    """The first answer where every question has many: each source's first document."""
    docs = table(spark, d, "documents").select(F.col("source").alias("question"), F.col("doc_id").alias("answer_id"),
                                               F.col("text").alias("answer"))
    return A.first_per_question(docs).withColumnRenamed("answer_id", "doc_id")


@register("distinct_answers", sql=f"""
SELECT DISTINCT {S.py_strip('lower(text)')} AS answer_norm FROM documents
""")
def distinct_answers(spark, d):
    return (table(spark, d, "documents", spread=True)
            .select(normalise_answer(F.col("text")).alias("answer_norm")).distinct())


@register("doc_sources", sql="SELECT DISTINCT source FROM documents")
def doc_sources(spark, d):
    return table(spark, d, "documents").select("source").distinct()


@register("feedback_stats", sql="""
SELECT user_id AS question, count(*) AS feedback_count,
       CAST(round(sum(CAST(value AS DECIMAL(38,10))), 4) AS DOUBLE) AS feedback_sum,
       round(CAST(sum(CAST(value AS DECIMAL(38,10))) AS DOUBLE) / count(*), 6) AS average_feedback
FROM events GROUP BY user_id
""")
def feedback_stats(spark, d):
    ev = table(spark, d, "events").select(F.col("user_id").alias("question"),
                                          F.col("value").alias("rating"))
    return A.feedback_stats(ev)


def _conv_feedback(spark, d):
    ev, conv = table(spark, d, "events"), table(spark, d, "conversations")
    asked = conv.where(F.col("role") == "user").select(
        F.col("conv_id").alias("user_id"), F.col("text").alias("question"))
    return ev.join(asked, "user_id").select("question", F.col("value").alias("rating"))


@register("feedback_confidence", sql="WITH " + _SQL_PAIRS + """,
fb AS (SELECT c.text AS question, count(*) AS n, CAST(sum(CAST(e.value AS DECIMAL(38,10))) AS DOUBLE) AS s
       FROM events e JOIN conversations c ON c.conv_id = e.user_id AND c.role = 'user'
       GROUP BY 1),
best AS (SELECT f.question, f.answer, round(fb.s / fb.n, 6) AS score
         FROM firsts f JOIN fb ON fb.question = f.question)
SELECT q.question, best.answer, round(coalesce(best.score, 0.0), 6) AS confidence
FROM (SELECT DISTINCT question FROM pairs) q LEFT JOIN best ON best.question = q.question
""")
def feedback_confidence(spark, d):
    store = A.apply_feedback(_pairs(spark, d), _conv_feedback(spark, d))
    return A.feedback_confidence(store)


_SQL_LISTING = f"""
listing AS (SELECT {S.netloc('p.url')} AS host, e.ts AS ts FROM events e
            JOIN pages p ON p.page_id = e.user_id),
fresh AS (SELECT DISTINCT host FROM listing
          WHERE ts > TIMESTAMP '{NOW}' - INTERVAL {FRESH_DAYS + 1} DAY)
"""


def _listing(spark, d):
    ev = table(spark, d, "events")
    pg = table(spark, d, "pages")
    return ev.join(pg.select(F.col("page_id").alias("user_id"), "url"), "user_id") \
             .select(_netloc(F.col("url")).alias("host"), "ts")


def _urls(spark, d):
    return table(spark, d, "pages").select("page_id", "url", _netloc(F.col("url")).alias("host"))


@register("fresh_hosts", sql=f"""
SELECT user_id AS host, bool_or(ts > TIMESTAMP '{NOW}' - INTERVAL {HOST_DAYS + 1} DAY) AS fresh
FROM events WHERE ts IS NOT NULL GROUP BY user_id
""")
def fresh_hosts(spark, d):
    ev = table(spark, d, "events")
    return FR.fresh_hosts(ev.select(F.col("user_id").alias("host"), "ts"), NOW, HOST_DAYS)


@register("urls_fresh", sql="WITH " + _SQL_LISTING + f"""
SELECT page_id, url, {S.netloc('url')} AS host FROM pages
WHERE {S.netloc('url')} IN (SELECT host FROM fresh)
""")
def urls_fresh(spark, d):
    return FR.split_urls(_urls(spark, d), _listing(spark, d), NOW, FRESH_DAYS)[0]


@register("urls_stale", sql="WITH " + _SQL_LISTING + f"""
SELECT page_id, url, {S.netloc('url')} AS host FROM pages
WHERE {S.netloc('url')} NOT IN (SELECT host FROM fresh)
""")
def urls_stale(spark, d):
    return FR.split_urls(_urls(spark, d), _listing(spark, d), NOW, FRESH_DAYS)[1]


@register("url_batches", sql="SELECT page_id, url, page_id // 2 AS batch_id FROM pages")
def url_batches(spark, d):
    return P.seed_batches(table(spark, d, "pages").select("page_id", "url"), batch_size=2)


# ---------------------------------------------------------------- M3: vectors, reconcile
from ..operators import similarity as V  # noqa: E402
from ..operators import reconcile as RC  # noqa: E402

PAIR_T = 0.3       # neighbourhood threshold (0.85 gives only singletons here)
GROUP_T = 0.15     # threshold inside the question groups
GROUP_SIZE = 10    # embeddings form question groups by vec_id div 10

_SQL_EMB = """
a AS (SELECT vec_id // 10 AS question, vec_id AS id, label AS answer,
             label / CAST(10.0 AS DOUBLE) AS confidence,
             CAST(embedding AS DOUBLE[]) AS e,
             sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS nrm
      FROM embeddings)
"""
_COS = "CASE WHEN x.nrm * y.nrm > 0 THEN list_dot_product(x.e, y.e) / (x.nrm * y.nrm) ELSE 0.0 END"


def _emb(spark, d):
    return table(spark, d, "embeddings")


def _emb_answers(spark, d):
    e = _emb(spark, d)
    return e.select(F.floor(F.col("vec_id") / GROUP_SIZE).alias("question"),
                    F.col("vec_id").alias("answer_id"), F.col("label").alias("answer"),
                    (F.col("label") / F.lit(10.0)).alias("confidence"), "embedding")


@register("knn_top4", sql="WITH " + _SQL_EMB + f""",
m AS (SELECT label, list(v ORDER BY k) AS e FROM (
        SELECT label, k, CAST(sum(CAST(v AS DECIMAL(38,12))) AS DOUBLE) / count(*) AS v FROM (
          SELECT label, generate_subscripts(embedding, 1) AS k, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)
        GROUP BY label, k) GROUP BY label),
q AS (SELECT label AS id, e, sqrt(list_dot_product(e, e)) AS nrm FROM m)
SELECT qid, CAST(rank AS INTEGER) AS rank, did, sim FROM (
  SELECT x.id AS qid, y.id AS did, round({_COS}, 6) AS sim,
         row_number() OVER (PARTITION BY x.id ORDER BY round({_COS}, 6) DESC, y.id) AS rank
  FROM q x, a y) WHERE rank <= 4
""")
def knn_top4(spark, d):
    """The vectors nearest to each label's mean vector: few queries against the whole table."""
    e = _emb(spark, d)
    parts = e.select("label", F.posexplode(F.col("embedding").cast("array<double>")).alias("k", "v"))
    mean = F.sum(F.col("v").cast("decimal(38,12)")).cast("double") / F.count(F.lit(1))
    means = (parts.groupBy("label", "k").agg(mean.alias("v")).groupBy("label")
             .agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "v"))), lambda x: x["v"]).alias("embedding")))
    return V.knn(means.select(F.col("label").cast("bigint").alias("vec_id"), "embedding"), e, 4)


@register("knn_top4_rows", sql="WITH " + _SQL_EMB + f"""
SELECT qid, CAST(rank AS INTEGER) AS rank, did, sim FROM (
  SELECT x.id AS qid, y.id AS did, round({_COS}, 6) AS sim,
         row_number() OVER (PARTITION BY x.id ORDER BY round({_COS}, 6) DESC, y.id) AS rank
  FROM a x, a y WHERE x.id % 100 = 0) WHERE rank <= 4
""")
def knn_top4_rows(spark, d):
    """The vectors nearest to each row whose vec_id is divisible by 100: a hundredth of the table against all of it."""
    e = _emb(spark, d)
    return V.knn(e.where(F.col("vec_id") % 100 == 0), e, 4)


@register("knn_top4_same_label", sql="WITH " + _SQL_EMB + f"""
SELECT label, qid, CAST(rank AS INTEGER) AS rank, did, sim FROM (
  SELECT x.answer AS label, x.id AS qid, y.id AS did, round({_COS}, 6) AS sim,
         row_number() OVER (PARTITION BY x.id ORDER BY round({_COS}, 6) DESC, y.id) AS rank
  FROM a x JOIN a y ON x.answer = y.answer) WHERE rank <= 4
""")
def knn_top4_same_label(spark, d):
    e = _emb(spark, d)
    return V.knn(e, e, 4, scope="label")


@register("knn_top4_group", sql="WITH " + _SQL_EMB + f"""
SELECT question, qid, CAST(rank AS INTEGER) AS rank, did, sim FROM (
  SELECT x.question AS question, x.id AS qid, y.id AS did, round({_COS}, 6) AS sim,
         row_number() OVER (PARTITION BY x.id ORDER BY round({_COS}, 6) DESC, y.id) AS rank
  FROM a x JOIN a y ON x.question = y.question) WHERE rank <= 4
""")
def knn_top4_group(spark, d):
    e = _emb(spark, d).withColumn("question", F.floor(F.col("vec_id") / GROUP_SIZE))
    return V.knn(e, e, 4, scope="question")


_SQL_SCOPED_PAIRS = "WITH " + _SQL_EMB + f""",
p AS (SELECT x.id AS i, y.id AS j, {_COS} AS sim FROM a x JOIN a y ON x.question = y.question WHERE {_COS} >= {PAIR_T})
"""


def _scoped_pairs(spark, d):
    """The reference compares the answers of one question: pairs keep to their group."""
    scoped = _emb(spark, d).withColumn("question", F.floor(F.col("vec_id") / GROUP_SIZE))
    return V.similarity_pairs(scoped, PAIR_T, scope="question")


@register("similar_pairs_group", sql=_SQL_SCOPED_PAIRS + "SELECT i, j, round(sim, 6) AS sim FROM p")
def similar_pairs_group(spark, d):
    return _scoped_pairs(spark, d).select("i", "j", F.round("sim", 6).alias("sim"))


@register("neighbour_counts_group", sql=_SQL_SCOPED_PAIRS + "SELECT i, count(*) AS n FROM p GROUP BY i")
def neighbour_counts_group(spark, d):
    return RC.neighbour_counts(_scoped_pairs(spark, d))


# whole table: the rows whose vec_id is divisible by 100 against all rows
from ..operators import vector_index as VI  # noqa: E402

_SQL_TABLE_PAIRS = "WITH " + _SQL_EMB + f""",
p AS (SELECT x.id AS i, y.id AS j, {_COS} AS sim FROM a x, a y WHERE x.id % 100 = 0 AND {_COS} >= {PAIR_T})
"""
PROBES = 44     # of 64 lists; the vectors of the test tables have no structure, so neighbours lie in many lists


def _indexed(spark, d):
    e = _emb(spark, d)
    return e.where(F.col("vec_id") % 100 == 0), VI.build(e, scratch_path(spark, "vector-index"))


def _table_pairs(spark, d):
    return VI.within(*_indexed(spark, d), PAIR_T)


@register("similar_pairs", sql=_SQL_TABLE_PAIRS + "SELECT i, j, round(sim, 6) AS sim FROM p")
def similar_pairs(spark, d):
    return _table_pairs(spark, d).select("i", "j", F.round("sim", 6).alias("sim"))


@register("neighbour_counts", sql=_SQL_TABLE_PAIRS + "SELECT i, count(*) AS n FROM p GROUP BY i")
def neighbour_counts(spark, d):
    return RC.neighbour_counts(_table_pairs(spark, d))


@register("knn_index_exact", sql=ORACLE_SQL["knn_top4_rows"])
def knn_index_exact(spark, d):
    """Through the index with every list probed."""
    return VI.nearest(*_indexed(spark, d), 4)


@register("knn_index_top4")
def knn_index_top4(spark, d):
    """Through the index, approximate (tests measure the recall)."""
    return VI.nearest(*_indexed(spark, d), 4, PROBES)


_SQL_GROUP_PAIRS = "WITH " + _SQL_EMB + f""",
p AS (SELECT x.question, x.id AS i, y.id AS j FROM a x JOIN a y ON x.question = y.question
      WHERE {_COS} >= {GROUP_T}),
n AS (SELECT question, i, count(*) AS n FROM p GROUP BY 1, 2),
b AS (SELECT question, i, n AS size FROM (
        SELECT *, row_number() OVER (PARTITION BY question ORDER BY n DESC, i) AS r FROM n)
      WHERE r = 1),
m AS (SELECT p.question, b.size, a.answer, a.confidence FROM p
      JOIN b ON b.question = p.question AND b.i = p.i
      JOIN a ON a.id = p.j),
v AS (SELECT question, answer FROM (
        SELECT question, answer, row_number() OVER (PARTITION BY question ORDER BY count(*) DESC, answer) AS r
        FROM m GROUP BY question, answer) WHERE r = 1),
ba AS (SELECT v.question, v.answer, round(c.conf, 6) AS confidence, c.size FROM v
       JOIN (SELECT question, avg(confidence) AS conf, any_value(size) AS size FROM m GROUP BY 1) c
       ON c.question = v.question)
"""


def _group_pairs(spark, d):
    return RC.neighbourhoods(_emb_answers(spark, d), GROUP_T)


@register("clusters", sql=_SQL_GROUP_PAIRS + "SELECT question, i, j FROM p")
def clusters(spark, d):
    return _group_pairs(spark, d)


@register("best_cluster", sql=_SQL_GROUP_PAIRS + "SELECT question, i, size FROM b")
def best_cluster(spark, d):
    return RC.best_cluster(_group_pairs(spark, d))


def _best_answer(spark, d):
    return RC.best_answer(_emb_answers(spark, d), _group_pairs(spark, d))


@register("best_answer", sql=_SQL_GROUP_PAIRS + "SELECT question, answer, confidence, size FROM ba")
def best_answer(spark, d):
    return _best_answer(spark, d)


@register("confident_answers", sql=_SQL_GROUP_PAIRS + """
SELECT question, answer, confidence, size FROM ba WHERE confidence >= 0.6
""")
def confident_answers(spark, d):
    return RC.confident(_best_answer(spark, d))


@register("answer_sources", sql="""
SELECT DISTINCT lang AS question, source FROM documents
WHERE text IS NOT NULL AND text <> '' AND source IS NOT NULL
""")
def answer_sources(spark, d):
    docs = table(spark, d, "documents")
    per_host = docs.select(F.col("lang").alias("question"), F.col("text").alias("answer"),
                           F.when(F.col("source").isNotNull(), F.array("source"))
                           .otherwise(F.array().cast("array<string>")).alias("sources"))
    return RC.answer_sources(per_host)


# ---------------------------------------------------------------- M4: splitting, chunk files
from ..operators import chunks as CH  # noqa: E402
from ..sinks import chunkfiles as KF  # noqa: E402
from ..sources import chunkfiles as SF  # noqa: E402
from ..sources import listing as LS  # noqa: E402

ASSIGN_LIMIT = 20_000  # flush size for the registered chunk queries (hosts here are small)


def _docs(spark, d):
    return table(spark, d, "documents", spread=True)


@register("doc_chunks")
def doc_chunks(spark, d):
    return CH.split_documents(_docs(spark, d))


@register("chunk_counts")
def chunk_counts(spark, d):
    return CH.chunk_counts(CH.split_documents(_docs(spark, d)))


@register("record_size", sql=f"""
SELECT doc_id, CAST({_FIXED} + {S.json_len('source')} + {S.json_len('text')} AS BIGINT) AS record_size
FROM documents
""")
def record_size(spark, d):
    docs = _docs(spark, d)
    return docs.select("doc_id", CH.record_size(F.col("source"), F.col("text"), RUN_TS).alias("record_size"))


@register("chunk_assign", sql=f"""
WITH RECURSIVE rec AS (
  SELECT host, page_id, record_size AS size,
         row_number() OVER (PARTITION BY host ORDER BY page_id) AS rn
  FROM ({_SQL_RECORDS})),
walk AS (
  SELECT host, rn, page_id, CAST(0 AS BIGINT) AS chunk_no,
         CASE WHEN size >= {ASSIGN_LIMIT} THEN 0 ELSE size END AS fill,
         CASE WHEN size >= {ASSIGN_LIMIT} THEN 1 ELSE 0 END AS nxt
  FROM rec WHERE rn = 1
  UNION ALL
  SELECT r.host, r.rn, r.page_id, w.nxt,
         CASE WHEN w.fill + r.size >= {ASSIGN_LIMIT} THEN 0 ELSE w.fill + r.size END,
         w.nxt + CASE WHEN w.fill + r.size >= {ASSIGN_LIMIT} THEN 1 ELSE 0 END
  FROM walk w JOIN rec r ON r.host = w.host AND r.rn = w.rn + 1)
SELECT host, page_id, chunk_no FROM walk
""")
def chunk_assign(spark, d):
    recs = P.page_records(_pages(spark, d), RUN_TS)
    return CH.assign_chunks(recs, ASSIGN_LIMIT).withColumnRenamed("ord", "page_id")


def _written_page_chunks(spark, d):
    recs = P.page_records(_pages(spark, d), RUN_TS)
    assigned = CH.assign_chunks(recs, ASSIGN_LIMIT).withColumnRenamed("ord", "page_id")
    recs = recs.join(assigned.drop("host"), "page_id")
    path = scratch_path(spark, "page-chunks")
    KF.write_chunk_files(recs, path)
    return path


@register("chunk_roundtrip", sql=f"""
SELECT host, url, content, timestamp FROM ({_SQL_RECORDS})
""")
def chunk_roundtrip(spark, d):
    path = _written_page_chunks(spark, d)
    return SF.scan_chunks(spark, path).select("host", "url", "content", "timestamp")


def _written_doc_chunks(spark, d):
    docs = _docs(spark, d)
    recs = docs.select(F.col("doc_id").alias("page_id"), F.col("source").alias("host"),
                       F.col("source").alias("url"), F.col("text").alias("content"),
                       F.lit(RUN_TS).alias("timestamp"),
                       CH.record_size(F.col("source"), F.col("text"), RUN_TS).alias("record_size"))
    assigned = CH.assign_chunks(recs).withColumnRenamed("ord", "page_id")
    path = scratch_path(spark, "doc-chunks")
    KF.write_chunk_files(recs.join(assigned.drop("host"), "page_id"), path, doc="page_id")
    return path


@register("chunk_scan", sql="""
SELECT source AS host, source AS url, text AS content FROM documents
""")
def chunk_scan(spark, d):
    path = _written_doc_chunks(spark, d)
    return SF.scan_chunks(spark, path).select("host", "url", "content")


@register("chunk_rejects", sql="SELECT DISTINCT source AS host FROM documents WHERE regexp_matches(source, '[02468]$')")
def chunk_rejects(spark, d):
    """Hosts with chunk lines that do not parse, where the lines of every other host are cut in half."""
    path, broken = _written_doc_chunks(spark, d), scratch_path(spark, "broken-chunks")
    half = F.when(F.col("host").rlike("[02468]$"), F.expr("substr(value, 1, length(value) div 2)")).otherwise(F.col("value"))
    (spark.read.format("text").schema("value string, host string").load(path).select("host", half.alias("value"))
     .write.partitionBy("host").text(broken))
    return SF.chunk_rejects(spark, broken).select("host").distinct()


@register("legacy_content", sql="SELECT text AS content FROM documents")
def legacy_content(spark, d):
    path = _written_doc_chunks(spark, d)
    return SF.require_rows(SF.legacy_content(spark, path))


@register("index_idempotent")
def index_idempotent(spark, d):
    chunks = CH.split_documents(_docs(spark, d))
    path = scratch_path(spark, "index")
    ST.append_index(chunks, path)
    ST.append_index(chunks, path)   # a second load adds nothing
    return ST.read_index(spark, path)


def _stored_files(spark, d):
    """The chunk files of the hosts that ``events`` lists as fresh, as the file system lists them."""
    recs = P.page_records(_pages(spark, d), RUN_TS)
    recs = recs.join(FR.fresh_host_set(_listing(spark, d), NOW, FRESH_DAYS), "host", "left_semi").withColumn("chunk_no", F.lit(0))
    path = scratch_path(spark, "listed-chunks")
    KF.write_chunk_files(recs, path)
    return LS.file_listing(spark, path)


@register("urls_fresh_files", sql=ORACLE_SQL["urls_fresh"])
def urls_fresh_files(spark, d):
    """URLs whose host has a chunk file written in the last days, by the files' own times."""
    return FR.split_urls(_urls(spark, d), _stored_files(spark, d), dt.datetime.now(dt.timezone.utc), FRESH_DAYS)[0]


@register("urls_stale_files", sql=ORACLE_SQL["urls_stale"])
def urls_stale_files(spark, d):
    return FR.split_urls(_urls(spark, d), _stored_files(spark, d), dt.datetime.now(dt.timezone.utc), FRESH_DAYS)[1]


# ---------------------------------------------------------------- M5: frontier
from ..operators import frontier as FT  # noqa: E402

REACH_SEED = "s1"    # start node (supplier 1)


def _supply_edges(spark, d):
    li = table(spark, d, "lineitem").where("l_suppkey IS NOT NULL AND l_partkey IS NOT NULL")
    s = F.concat(F.lit("s"), F.col("l_suppkey").cast("string"))
    p = F.concat(F.lit("p"), F.col("l_partkey").cast("string"))
    return li.select(s.alias("src"), p.alias("dst")).unionByName(
        li.select(p.alias("src"), s.alias("dst")))


@register("reach_depth", sql=f"""
WITH e AS (SELECT DISTINCT 's' || l_suppkey AS src, 'p' || l_partkey AS dst
           FROM lineitem
           UNION SELECT DISTINCT 'p' || l_partkey, 's' || l_suppkey FROM lineitem),
d0 AS (SELECT '{REACH_SEED}' AS node),
d1 AS (SELECT DISTINCT dst AS node FROM e WHERE src IN (SELECT node FROM d0)
       AND dst NOT IN (SELECT node FROM d0)),
d2 AS (SELECT DISTINCT dst AS node FROM e WHERE src IN (SELECT node FROM d1)
       AND dst NOT IN (SELECT node FROM d0 UNION SELECT node FROM d1)),
d3 AS (SELECT DISTINCT dst AS node FROM e WHERE src IN (SELECT node FROM d2)
       AND dst NOT IN (SELECT node FROM d0 UNION SELECT node FROM d1 UNION SELECT node FROM d2))
SELECT node, 0 AS depth, '{REACH_SEED}' AS seed FROM d0
UNION ALL SELECT node, 1, '{REACH_SEED}' FROM d1
UNION ALL SELECT node, 2, '{REACH_SEED}' FROM d2
UNION ALL SELECT node, 3, '{REACH_SEED}' FROM d3
""")
def reach_depth(spark, d):
    seeds = spark.range(1).select(F.lit(REACH_SEED).alias("node"), F.lit(REACH_SEED).alias("seed"))
    return FT.reach(_supply_edges(spark, d), seeds, 3)


# ---------------------------------------------------------------- M5b: the crawl as one job
from ..operators import crawl as CW  # noqa: E402

# The links of the pages table name no page of it.  A link is therefore answered, like a
# redirect, by the page whose id is the link's md5 (first 8 digits) modulo the table's size.
_SQL_SITE = f"""
site AS (SELECT regexp_replace(url, '#.*$', '') AS key, min(page_id) AS page_id FROM pages GROUP BY 1),
links AS (SELECT page_id, link, ('0x' || md5(link)[1:8])::BIGINT % (SELECT max(page_id) + 1 FROM pages) AS target_id
          FROM ({S.PAGE_LINKS})),
edges AS (SELECT DISTINCT s.key AS src, {{place}} AS place, regexp_replace(p.url, '#.*$', '') AS target
          FROM links l JOIN site s ON s.page_id = l.page_id JOIN pages p ON p.page_id = l.target_id WHERE {{keep}})
"""


def _answered(spark, d):
    pages = table(spark, d, "pages")
    n = pages.agg(F.max("page_id")).first()[0]
    target = pages.select(F.col("page_id").alias("target_id"), F.col("url").alias("target"))

    def follow(links):
        h = F.conv(F.substring(F.md5("link"), 1, 8), 16, 10).cast("bigint")
        return links.withColumn("target_id", h % F.lit((n or 0) + 1)).join(target, "target_id").drop("target_id")
    return follow


def _crawl_step(n):
    seen = " UNION ALL ".join(f"SELECT batch_id, url FROM d{i}" for i in range(n))
    return f"""d{n} AS (SELECT f.batch_id, e.target AS url, min(f.seed_host) AS seed_host
      FROM d{n - 1} f JOIN edges e ON e.src = f.url
      JOIN allowed a ON a.batch_id = f.batch_id AND a.place = e.place
      WHERE (f.batch_id, e.target) NOT IN ({seen}) GROUP BY 1, 2)"""


_SQL_CRAWL = "WITH RECURSIVE " + _SQL_SITE.format(place=S.netloc("link"), keep="starts_with(link, 'http')") + f""",
allowed AS (SELECT DISTINCT page_id // 4 AS batch_id, {S.netloc('url')} AS place FROM pages),
d0 AS (SELECT page_id // 4 AS batch_id, regexp_replace(url, '#.*$', '') AS url, min({S.netloc('url')}) AS seed_host
       FROM pages GROUP BY 1, 2),
{_crawl_step(1)}, {_crawl_step(2)}, {_crawl_step(3)},
visited AS (""" + " UNION ALL ".join(f"SELECT batch_id, url, seed_host, {i} AS depth FROM d{i}" for i in range(4)) + ")\n"


def _crawled(spark, d):
    """Every page is a seed, four to a batch, as in ``internal_links``."""
    seeds = P.seed_batches(table(spark, d, "pages").select(F.col("page_id").alias("seq"), "url"), seq_col="seq")
    return CW.crawl(_pages(spark, d), seeds, follow=_answered(spark, d), with_feed=False)


@register("crawl_frontier", sql=_SQL_CRAWL + "SELECT batch_id, url, seed_host, depth FROM visited")
def crawl_frontier(spark, d):
    return _crawled(spark, d).visited


@register("crawl_chunks", sql=_SQL_CRAWL + f""",
rec AS (SELECT v.batch_id, v.seed_host AS host, v.depth, r.url, r.content, r.record_size AS size,
               row_number() OVER (PARTITION BY v.batch_id, v.seed_host ORDER BY v.depth, r.url) AS rn
        FROM visited v JOIN site s ON s.key = v.url JOIN ({_SQL_RECORDS}) r ON r.page_id = s.page_id),
walk AS (
  SELECT batch_id, host, rn, 0::BIGINT AS chunk_no, CASE WHEN size >= {ASSIGN_LIMIT} THEN 0 ELSE size END AS fill,
         CASE WHEN size >= {ASSIGN_LIMIT} THEN 1 ELSE 0 END AS nxt FROM rec WHERE rn = 1
  UNION ALL
  SELECT r.batch_id, r.host, r.rn, w.nxt, CASE WHEN w.fill + r.size >= {ASSIGN_LIMIT} THEN 0 ELSE w.fill + r.size END,
         w.nxt + CASE WHEN w.fill + r.size >= {ASSIGN_LIMIT} THEN 1 ELSE 0 END
  FROM walk w JOIN rec r ON r.batch_id = w.batch_id AND r.host = w.host AND r.rn = w.rn + 1)
SELECT batch_id, host, chunk_no, url, content FROM walk JOIN rec USING (batch_id, host, rn)
""")
def crawl_chunks(spark, d):
    """Records under their seed's host, in chunk files by host with a line for each batch's chunk, read back."""
    path = scratch_path(spark, "crawl-chunks")
    done = _crawled(spark, d)
    CW.write_crawl(CW.crawl_records(done, RUN_TS, content=False), path, ASSIGN_LIMIT, layout=("host",), pages=done.pages, form="parquet")
    rows = SF.scan_chunks(spark, path, fields=("batch_id", "chunk_no"), form="parquet")
    return rows.select("batch_id", "host", "chunk_no", "url", "content")


@register("crawl_fixpoint", sql="WITH RECURSIVE " + _SQL_SITE.format(place=S.root_domain(S.hostname("link")), keep="true") + f""",
seeds AS (SELECT min(page_id) AS batch_id, {S.root_domain(S.hostname('url'))} AS place FROM pages GROUP BY 2),
reached(batch_id, url) AS (
  SELECT batch_id, regexp_replace(url, '#.*$', '') FROM seeds JOIN pages ON page_id = batch_id
  UNION
  SELECT r.batch_id, e.target FROM reached r JOIN edges e ON e.src = r.url
  JOIN seeds s ON s.batch_id = r.batch_id AND s.place = e.place)
SELECT r.batch_id, r.url AS url_key, t.title, t.content
FROM reached r JOIN site s ON s.key = r.url JOIN ({ORACLE_SQL['page_title_content']}) t ON t.page_id = s.page_id
""")
def crawl_fixpoint(spark, d):
    """A crawl of each root domain from its first page, over all its hosts, until nothing new is found."""
    pages = table(spark, d, "pages").select("page_id", "url")
    first = (pages.groupBy(root_domain(hostname(F.col("url")))).agg(F.min("page_id").alias("page_id")).select("page_id"))
    seeds = pages.join(first, "page_id").select(F.col("page_id").alias("batch_id"), F.col("page_id").alias("seq"), "url")
    done = CW.crawl(_pages(spark, d), seeds, max_depth=None, rule="root_domain", follow=_answered(spark, d))
    return CW.feed(done).select("batch_id", strip_fragment(F.col("url")).alias("url_key"), "title", "content")


# ---------------------------------------------------------------- M6: ask
from ..operators import ask as AK  # noqa: E402
from ..operators import embed as EM  # noqa: E402


def _passages(spark, d):
    chunks = CH.split_documents(_docs(spark, d))
    return chunks.select(F.struct("doc_id", "chunk_index").alias("pid"),
                         F.col("source").alias("host"), "source", "chunk")


def _bench_questions(spark, d):
    return table(spark, d, "benchmark").select(F.col("item_id").alias("qid"),
                                               F.col("text").alias("question"))


@register("ask")
def ask(spark, d):
    store = A.answer_rows(_pairs(spark, d), ts=NOW, id_col="answer_id")
    index = cut_lineage(_passages(spark, d))   # the passage index, built once
    return AK.ask(_bench_questions(spark, d), index, store, scope="host")


# ---------------------------------------------------------------- M7: streaming
from ..streaming import chunk_state as SS  # noqa: E402
from ..streaming import feedback as SFB  # noqa: E402
from ..streaming import ingest as SI  # noqa: E402

STREAM_SLICES = 2   # the page-record stream arrives in 2 slices in page order (state crosses a batch)


@register("stream_ingest")
def stream_ingest(spark, d):
    src = _written_doc_chunks(spark, d)
    index = scratch_path(spark, "stream-index")
    q = SI.ingest_chunk_files(spark, src, index, scratch_path(spark, "stream-ingest-ckpt"),
                              files_per_batch=8)
    q.awaitTermination()
    return ST.read_index(spark, index)


@register("stream_chunk_assign", sql=ORACLE_SQL["chunk_assign"])
def stream_chunk_assign(spark, d):
    recs = P.page_records(_pages(spark, d), RUN_TS).select(
        F.col("host"), F.col("page_id").alias("ord"), F.col("record_size").alias("size"))
    recs = cut_lineage(recs)
    bounds = recs.agg(F.min("ord"), F.max("ord")).first()
    lo, hi = int(bounds[0]), int(bounds[1])
    step = max(1, (hi - lo + STREAM_SLICES) // STREAM_SLICES)
    src, out = scratch_path(spark, "record-stream"), scratch_path(spark, "stream-chunks")

    def write_slice(s):
        (recs.where((F.col("ord") >= s) & (F.col("ord") < s + step))
         .write.mode("append").parquet(src))

    def batch(df, epoch_id):     # a replayed epoch writes its own folder again
        df.write.mode("overwrite").parquet(f"{out}/epoch={epoch_id}")
    # records arrive slice by slice in page order.  Each slice is written, then
    # processed by an availableNow run that resumes the same checkpoint (state
    # included) and stops; no run is active while a slice is being written, so
    # a listing can never see half of a slice.
    ckpt = scratch_path(spark, "stream-chunks-ckpt")
    for s in range(lo, hi + 1, step):
        write_slice(s)
        stream = spark.readStream.schema("host string, ord long, size long").parquet(src)
        with state_partitions(spark):
            q = (SS.assign_chunks_stream(stream, ASSIGN_LIMIT).writeStream.outputMode("append")
                 .foreachBatch(batch).option("checkpointLocation", ckpt)
                 .trigger(availableNow=True).start())
        q.awaitTermination()
    return spark.read.parquet(out).select("host", F.col("ord").alias("page_id"), "chunk_no")


@register("stream_feedback", sql=ORACLE_SQL["feedback_stats"])
def stream_feedback(spark, d):
    ev = table_stream(spark, d, "events")
    stats = SFB.running_feedback(ev.select(F.col("user_id").alias("question"),
                                           F.col("value").alias("rating")))
    out = scratch_path(spark, "stream-feedback")
    with state_partitions(spark):
        q = SFB.write_changes(stats, out, scratch_path(spark, "stream-feedback-ckpt"))
    q.awaitTermination()
    return SFB.latest_feedback(spark, out)


from ..streaming import dedup as SD  # noqa: E402
from ..streaming import state_partitions  # noqa: E402

FETCHED_AT = "2024-02-01 00:00:00"  # fetch time stamped on the page stream


@register("stream_distinct_pages", sql="""
SELECT DISTINCT regexp_replace(url, '#.*$', '') AS url_key FROM pages
""")
def stream_distinct_pages(spark, d):
    pages = table_stream(spark, d, "pages").withColumn("fetched_at", F.lit(FETCHED_AT).cast("timestamp"))
    out = scratch_path(spark, "stream-distinct-pages")

    def batch(df, epoch_id):     # a replayed epoch writes its own folder again
        df.write.mode("overwrite").parquet(f"{out}/epoch={epoch_id}")
    with state_partitions(spark):
        q = (SD.distinct_pages_stream(pages).writeStream.outputMode("append").foreachBatch(batch)
             .option("checkpointLocation", scratch_path(spark, "stream-distinct-pages-ckpt"))
             .trigger(availableNow=True).start())
    q.awaitTermination()
    if not path_exists(spark, out):      # no file held a row: no batch was written
        return spark.createDataFrame([], "url_key string")
    return spark.read.parquet(out).select("url_key")


# ---------------------------------------------------------------- ask over whole documents
_SQL_ASK_HOSTS = r""",
sh AS (SELECT s.qid, s.did, s.sim, d.source AS host, d.text AS passage
       FROM scored s JOIN documents d ON d.doc_id = s.did{listed}),
hr AS (SELECT *, row_number() OVER (PARTITION BY qid, host ORDER BY sim DESC, did) AS hrank FROM sh),
cand AS (SELECT qid, host, passage AS answer, sim AS confidence FROM hr
         WHERE hrank = 1 AND passage IS NOT NULL AND passage <> ''),
srcs AS (SELECT qid, list_sort(list(DISTINCT host)) AS sources FROM cand GROUP BY qid),
aterm AS (SELECT qid, host, token, count(*) AS tf FROM (
         SELECT qid, host, unnest(regexp_extract_all(lower(answer), '[\p{L}]+')) AS token FROM cand)
       GROUP BY qid, host, token),
an AS (SELECT qid, host, sqrt(sum(tf * tf)) AS norm FROM aterm GROUP BY qid, host),
ad AS (SELECT a.qid, a.host AS i, b.host AS j, sum(a.tf * b.tf) AS dot
       FROM aterm a JOIN aterm b ON a.qid = b.qid AND a.token = b.token GROUP BY a.qid, a.host, b.host),
pairs AS (SELECT ad.qid, ad.i, ad.j FROM ad
            JOIN an x ON x.qid = ad.qid AND x.host = ad.i
            JOIN an y ON y.qid = ad.qid AND y.host = ad.j
          WHERE ad.dot / (x.norm * y.norm) >= 0.85
          UNION
          SELECT qid, min(host), min(host) FROM cand GROUP BY qid HAVING count(*) = 1),
nc AS (SELECT qid, i, count(*) AS n FROM pairs GROUP BY qid, i),
bc AS (SELECT qid, i FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY n DESC, i) AS r FROM nc)
       WHERE r = 1),
mem AS (SELECT p.qid, c.answer, c.confidence FROM pairs p
        JOIN bc ON bc.qid = p.qid AND bc.i = p.i
        JOIN cand c ON c.qid = p.qid AND c.host = p.j),
vote AS (SELECT qid, answer FROM (
           SELECT qid, answer, row_number() OVER (PARTITION BY qid ORDER BY count(*) DESC, answer) AS r
           FROM mem GROUP BY qid, answer) WHERE r = 1),
conf AS (SELECT qid, CAST((2 * sum(CAST(round(confidence * 1000000) AS BIGINT)) + count(*))
                          // (2 * count(*)) AS DOUBLE) / 1000000 AS confidence
         FROM mem GROUP BY qid)
SELECT b.item_id AS qid, b.text AS question,
       coalesce(vote.answer, 'No valid answers found.') AS answer,
       coalesce(srcs.sources, CAST([] AS VARCHAR[])) AS sources,
       coalesce(conf.confidence, 0.0) AS confidence,
       false AS cached,
       coalesce(conf.confidence, 0.0) >= 0.6 AS confident
FROM benchmark b
LEFT JOIN vote ON vote.qid = b.item_id
LEFT JOIN conf ON conf.qid = b.item_id
LEFT JOIN srcs ON srcs.qid = b.item_id
"""


def _sql_ask_hosts(terms, listed=""):
    return "WITH " + terms + _SQL_ASK_HOSTS.replace("{listed}", listed)


def _doc_passages(spark, d):
    """Each document one passage, its source the host."""
    return table(spark, d, "documents", spread=True).select(
        F.col("doc_id").alias("pid"), F.col("source").alias("host"), "source", F.col("text").alias("chunk"))


@register("ask_documents", sql=_sql_ask_hosts(_SQL_TERMS))
def ask_documents(spark, d):
    """The whole ask pass with each document one passage and its source the host."""
    return AK.ask(_bench_questions(spark, d), _doc_passages(spark, d), None, scope="host")


#: Hosts that a question asks, by its number: lists of unequal length, some of one host, some with hosts that hold nothing.
_SQL_LISTED = """
 JOIN (SELECT item_id, 'src' || CAST((item_id * 7 + unnest(range(0, 1 + item_id % 6)) * 3) % 24 AS VARCHAR) AS host
       FROM benchmark) l ON l.item_id = s.qid AND l.host = d.source"""


def _listed_hosts(spark, d):
    i = F.explode(F.sequence(F.lit(0), F.col("item_id") % 6)).alias("i")
    return (table(spark, d, "benchmark").select("item_id", i)
            .select(F.col("item_id").alias("qid"),
                    F.concat(F.lit("src"), ((F.col("item_id") * 7 + F.col("i") * 3) % 24).cast("string")).alias("host")))


@register("ask_listed_hosts", sql=_sql_ask_hosts(_SQL_TERMS, _SQL_LISTED))
def ask_listed_hosts(spark, d):
    """Each question asks the hosts of its own list."""
    return AK.ask(_bench_questions(spark, d), _doc_passages(spark, d), None, scope="host", hosts=_listed_hosts(spark, d))


_SQL_DENSE = f"""
qv AS (SELECT id, h % {EM.WIDTH} AS k, sum(tf * (1 - 2 * ((h // {EM.WIDTH}) % 2))) AS v
       FROM (SELECT *, CAST('0x' || md5(token)[1:8] AS BIGINT) AS h FROM qt) GROUP BY 1, 2),
dv AS (SELECT id, h % {EM.WIDTH} AS k, sum(tf * (1 - 2 * ((h // {EM.WIDTH}) % 2))) AS v
       FROM (SELECT *, CAST('0x' || md5(token)[1:8] AS BIGINT) AS h FROM dt) GROUP BY 1, 2),
qn AS (SELECT id, sqrt(sum(v * v)) AS norm FROM qv GROUP BY id),
dn AS (SELECT id, sqrt(sum(v * v)) AS norm FROM dv GROUP BY id),
dots AS (SELECT qv.id AS qid, dv.id AS did, sum(qv.v * dv.v) AS dot FROM qv JOIN dv ON qv.k = dv.k GROUP BY 1, 2),
scored AS (SELECT qn.id AS qid, dn.id AS did, CASE WHEN qn.norm * dn.norm > 0
                  THEN round(coalesce(dot, 0) / (qn.norm * dn.norm), 6) ELSE 0.0 END AS sim
           FROM qn CROSS JOIN dn LEFT JOIN dots ON dots.qid = qn.id AND dots.did = dn.id)
"""


@register("ask_dense_hosts", sql=_sql_ask_hosts(_SQL_TERMS[:_SQL_TERMS.index("qn AS")] + _SQL_DENSE))
def ask_dense_hosts(spark, d):
    """The nearest passages of every host by hashed vectors."""
    return AK.ask(_bench_questions(spark, d), _doc_passages(spark, d), None, scope="host", embedder=EM.hashing_embedder())


@register("ask_dense_listed", sql=_sql_ask_hosts(_SQL_TERMS[:_SQL_TERMS.index("qn AS")] + _SQL_DENSE, _SQL_LISTED))
def ask_dense_listed(spark, d):
    """As ``ask_dense_hosts``, where a question's vector meets the vectors of its listed hosts only."""
    return AK.ask(_bench_questions(spark, d), _doc_passages(spark, d), None, scope="host",
                  embedder=EM.hashing_embedder(), hosts=_listed_hosts(spark, d))


@register("ask_global", sql="WITH " + _SQL_TERMS + """,
top1 AS (SELECT qid, passage AS answer, sim AS confidence FROM hitp
         WHERE rank = 1 AND passage IS NOT NULL AND passage <> ''),
srcs AS (SELECT h.qid, list_sort(list(DISTINCT h.source)) AS sources FROM hitp h
         WHERE h.qid IN (SELECT qid FROM top1) GROUP BY h.qid)
SELECT b.item_id AS qid, b.text AS question,
       coalesce(top1.answer, 'No valid answers found.') AS answer,
       coalesce(srcs.sources, CAST([] AS VARCHAR[])) AS sources,
       coalesce(top1.confidence, 0.0) AS confidence,
       false AS cached,
       coalesce(top1.confidence, 0.0) >= 0.6 AS confident
FROM benchmark b LEFT JOIN top1 ON top1.qid = b.item_id LEFT JOIN srcs ON srcs.qid = b.item_id
""")
def ask_global(spark, d):
    """The ask pass with the reference's global retrieval: all hosts share the
    4 nearest documents, so the hosts' answers coincide."""
    return AK.ask(_bench_questions(spark, d), _doc_passages(spark, d), None, scope="global")


# ---------------------------------------------------------------- the whole question flow
def _flow(spark, d):
    """Cache, then fresh hosts, then all hosts: sources are hosts, an event is
    an object of the host its user id points to, the store repeats its rows."""
    docs = table(spark, d, "documents", spread=True)
    passages = docs.select(F.col("doc_id").alias("pid"), F.col("source").alias("host"), "source", F.col("text").alias("chunk"))
    listing = table(spark, d, "events").select(
        F.concat(F.lit("src"), (F.col("user_id") % 40).cast("string")).alias("host"), "ts")
    bench = _bench_questions(spark, d)
    known = bench.where(F.col("qid") % 5 == 0).select(
        "question", F.concat(F.lit("stored "), F.col("qid").cast("string")).alias("answer"))
    store = A.answer_rows(known.union(known), ts=NOW, confidence=0.9)
    return AK.ask_fresh_first(bench, passages, listing, NOW, store, max_age_days=FRESH_DAYS, scope="host")


@register("ask_fresh_first")
def ask_fresh_first(spark, d):
    return _flow(spark, d)


@register("answers_after_flow")
def answers_after_flow(spark, d):
    """What the flow stores, written through the answer store and read back."""
    path = scratch_path(spark, "flow-answers")
    ST.append_answers(AK.answers_to_store_after_flow(_flow(spark, d), NOW), path)
    return spark.read.parquet(path)
