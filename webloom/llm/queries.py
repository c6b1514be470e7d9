"""The registered queries of the operators, over whole tables."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import (decontaminate, fim, importance, jaccard, mixing, packing, quality, repeats, revisits, rules, shards,
               tokens, toxicity)
from .tables import read_table

QUERIES = {}
ORACLE_SQL = {}


def _register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE_SQL[name] = sql.strip()
        return fn
    return deco


_SQL_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


@_register("op10_substring_dedup", sql=f"""
WITH d AS (SELECT doc_id, {_SQL_WORDS} AS w FROM documents),
p AS (SELECT doc_id, unnest(range(1, len(w) - 33)) AS i, w FROM d WHERE len(w) >= 35),
g AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 34], ' ')) AS h FROM p),
r AS (SELECT h FROM g GROUP BY h HAVING count(*) > 1),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS k FROM g JOIN r USING (h)),
e AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS k FROM d),
s AS (SELECT e.doc_id, string_agg(word, ' ' ORDER BY e.k) AS kept, count(*) AS n
      FROM e LEFT JOIN c ON c.doc_id = e.doc_id AND c.k = e.k WHERE c.k IS NULL GROUP BY 1)
SELECT d.doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN s USING (doc_id)
""")
def op10_substring_dedup(spark, d):
    return repeats.remove_repeats(read_table(spark, d, "documents"))


@_register("op9_token_output")
def op9_token_output(spark, d):
    return tokens.token_output(read_table(spark, d, "documents"))


_SQL_SHINGLES = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 3 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 2], ' ') END AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1)
"""


@_register("op5_jaccard_join", sql=_SQL_SHINGLES + """,
p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (
  SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * i >= 90 * (nx.n + ny.n - i)),
e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
r(v, c) AS (SELECT doc_id, doc_id FROM d UNION SELECT e.y, r.c FROM r JOIN e ON e.x = r.v)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.c AS component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT v, min(c) AS c FROM r GROUP BY v) m ON m.v = d.doc_id
""")
def op5_jaccard_join(spark, d):
    return jaccard.jaccard_classes(read_table(spark, d, "documents"))


@_register("op1_decontamination")
def op1_decontamination(spark, d):
    found = decontaminate.leaks(read_table(spark, d, "documents"), read_table(spark, d, "benchmark"))
    return found.drop("th")


@_register("op4_quality")
def op4_quality(spark, d):
    return quality.scored(read_table(spark, d, "documents"), read_table(spark, d, "labels"))


@_register("op8_toxicity")
def op8_toxicity(spark, d):
    return toxicity.scored(read_table(spark, d, "documents"), read_table(spark, d, "labels")).drop("passages")


@_register("op7_sharding")
def op7_sharding(spark, d):
    rows = shards.shuffle(read_table(spark, d, "documents"), shards=40)
    text = F.coalesce("text", F.lit(""))
    return rows.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"),
                       F.crc32(text).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot",
                       F.lit(None).cast("int").alias("grown_shard"))


_SQL_CAPTURES = r"""
WITH c AS (
  SELECT page_id * 6 AS record_id, url, page_id AS m, 'response' AS kind, md5(coalesce(html, '')) AS etag, NULL AS modified,
         strlen(html)::VARCHAR AS length, page_id::VARCHAR AS d, 'a' AS server, NULL AS expires, NULL AS ctype, sha1(html) AS payload
  FROM pages
  UNION ALL
  SELECT page_id * 6 + 1, regexp_replace(url, '[#?].*$', '') || '#again', page_id + 100000, 'revisit',
         CASE WHEN page_id % 7 = 0 THEN 'changed' ELSE md5(coalesce(html, '')) END, NULL, '0', (page_id + 100000)::VARCHAR,
         NULL, NULL, NULL, NULL FROM pages
  UNION ALL
  SELECT page_id * 6 + 2, url || CASE WHEN url LIKE '%?%' THEN '&' ELSE '?' END || 'utm_id=1', page_id + 200000, 'revisit',
         NULL, NULL, NULL, NULL, NULL, 'never', NULL, NULL FROM pages
  UNION ALL
  SELECT page_id * 6 + 3, regexp_extract(url, '^([A-Za-z]+://[^/?#]*)', 1) || '/', page_id,
         CASE WHEN page_id % 10 = 0 THEN 'response' ELSE 'revisit' END, NULL, 'day ' || (page_id // 500)::VARCHAR, NULL,
         page_id::VARCHAR, NULL, NULL, CASE WHEN page_id % 10 = 0 THEN 'text/html' ELSE 'none' END,
         CASE WHEN page_id % 10 = 0 THEN sha1(regexp_extract(url, '^([A-Za-z]+://[^/?#]*)', 1) || '/') END FROM pages),
r AS (SELECT *, regexp_replace(regexp_replace(url, '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS rest FROM c),
q AS (SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(rest, '^([^/?]*)', 1)), ':(80|443)$', ''), '^(www|m)\.', '')
             || regexp_replace(regexp_extract(rest, '^[^/?]*([^?]*)', 1), '/+$', '') AS base,
             list_filter(list_sort(string_split(regexp_extract(rest, '\?(.*)$', 1), '&')),
                         lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[a-z]+|gclid|fbclid|ref)(=|$)')) AS args FROM r),
k AS (SELECT *, base || CASE WHEN len(args) > 0 THEN '?' || array_to_string(args, '&') ELSE '' END AS url_key FROM q),
f AS (SELECT *, last_value(CASE WHEN kind = 'response' THEN record_id END IGNORE NULLS) OVER (
             PARTITION BY url_key ORDER BY m, record_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS rid FROM k),
j AS (SELECT n.record_id, n.url_key, n.m, s.record_id AS sid, s.payload AS spayload,
             n.etag AS e1, s.etag AS e2, n.modified AS m1, s.modified AS m2, s.length AS length, s.ctype AS ctype,
             coalesce(n.d, s.d) AS d, coalesce(n.server, s.server) AS server, coalesce(n.expires, s.expires) AS expires,
             n.etag AS ne, s.etag AS se
      FROM f n LEFT JOIN c s ON s.record_id = n.rid WHERE n.kind = 'revisit'),
t AS (SELECT *, CASE WHEN sid IS NULL THEN 'no_earlier_response' WHEN e1 = e2 THEN 'resolved' WHEN e1 <> e2 THEN 'validator_mismatch'
                     WHEN m1 = m2 THEN 'resolved' WHEN m1 <> m2 THEN 'validator_mismatch' ELSE 'no_validator' END AS status FROM j)
SELECT record_id, url_key, 1600000000 + 60 * m AS seconds, status, CASE WHEN status = 'resolved' THEN sid END AS response_id,
       CASE WHEN status = 'resolved' THEN array_to_string(list_sort(list_filter([
         'etag: ' || coalesce('W/' || ne, se), 'last-modified: ' || coalesce(m1, m2), 'content-length: ' || length,
         'content-type: ' || ctype, 'date: ' || d, 'server: ' || server, 'expires: ' || expires], lambda h: h IS NOT NULL)),
         chr(10)) END AS headers,
       CASE WHEN status = 'resolved' THEN spayload END AS payload
FROM t
"""


@_register("op2_warc_revisits", sql=_SQL_CAPTURES)
def op2_warc_revisits(spark, d):
    out = revisits.resolve(revisits.captures(read_table(spark, d, "pages")))
    return out.select("record_id", "url_key", F.unix_seconds("ts").alias("seconds"), "status", "response_id",
                      revisits.header_lines(F.col("headers")).alias("headers"), "payload")


_SQL_LEDGER = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {_SQL_WORDS} AS w FROM documents),
p AS (SELECT doc_id, i, w[i:i + 7] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM p),
c AS (SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS k FROM g WHERE n > 1) GROUP BY 1),
l AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM d),
m AS (
  SELECT d.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
         length(regexp_replace(t, '[^\\p{{Lu}}]', '', 'g')) AS n_upper, length(regexp_replace(t, '[^!]', '', 'g')) AS n_marks,
         len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words,
         len(list_filter(range(1, len(w)), lambda i: w[i] = w[i + 1])) AS n_same
  FROM d JOIN l USING (doc_id) LEFT JOIN c USING (doc_id)),
f AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
    (n_words < 20)::INT + 2 * (n_repeat_words * 100 > n_words * 30)::INT + 4 * (n_dup_lines * 100 > n_lines * 60)::INT
    + 8 * (n_symbols * 100 > n_words * 25)::INT + 16 * (word_chars < n_words * 2)::INT + 32 * (word_chars > n_words * 20)::INT
    + 64 * (n_upper * 100 > word_chars * 30)::INT + 128 * (n_marks * 100 > n_words * 25)::INT
    + 256 * (n_same * 100 > n_words * 25)::INT AS failed
  FROM m)
"""


@_register("op3_quality_rules", sql=_SQL_LEDGER + f"""
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       (failed & {rules.mask(rules.POLICIES["v2"])}) = 0 AS kept, failed::BIGINT AS failed
FROM f
""")
def op3_quality_rules(spark, d):
    entries = rules.ledger(read_table(spark, d, "documents"))
    return entries.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                          (~rules.passes("base")).alias("base_failed"), rules.passes("v2").alias("kept"), "failed")


_SQL_POLICIES = ",\n".join(f"('{policy}', '{rule}', {rules.mask([rule])}, {rules.mask(names)})"
                           for policy, names in rules.POLICIES.items() for rule in names)


@_register("rules_ablation", sql=_SQL_LEDGER + f""",
r(policy, rule, bit, mask) AS (VALUES {_SQL_POLICIES})
SELECT policy, rule, count(*) FILTER (failed & bit <> 0) AS n_failed, count(*) FILTER (failed & mask = bit) AS n_only,
       count(*) FILTER (failed & (mask - bit) = 0) AS n_kept_without
FROM f CROSS JOIN r GROUP BY policy, rule
""")
def rules_ablation(spark, d):
    entries = rules.ledger(read_table(spark, d, "documents"))
    each = [rules.ablations(entries, p).select(F.lit(p).alias("policy"), "*") for p in rules.POLICIES]
    return reduce(DataFrame.unionByName, each)


#: Shares of the mixture's expected tokens.
TARGET = {"clean": 0.93, "toxic": 0.05, "low": 0.02}


@_register("op6_soft_mixing")
def op6_soft_mixing(spark, d):
    return mixing.rates(read_table(spark, d, "documents"), read_table(spark, d, "labels"), TARGET)


@_register("op11_fill_in_middle", sql="""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n,
                  sha256('1:' || doc_id::VARCHAR) AS h FROM documents),
h AS (SELECT *, ('0x' || h[1:8])::BIGINT % (n + 1) AS c1, ('0x' || h[9:16])::BIGINT % (n + 1) AS c2,
             ('0x' || h[17:24])::BIGINT % 100 AS h3, ('0x' || h[25:32])::BIGINT % 100 AS h4 FROM d),
f AS (SELECT *, least(c1, c2) AS a, greatest(c1, c2) AS b,
             CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 >= 90 THEN 'plain'
                  WHEN h4 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, t[1:a] AS prefix, t[a + 1:b] AS middle, t[b + 1:] AS suffix FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p
""")
def op11_fill_in_middle(spark, d):
    out = fim.transform(read_table(spark, d, "documents"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                      F.sha2(fim.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


@_register("op12_packing")
def op12_packing(spark, d):
    return packing.pack(read_table(spark, d, "documents")).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@_register("op13_importance_resampling")
def op13_importance_resampling(spark, d):
    return importance.resample(read_table(spark, d, "documents"), read_table(spark, d, "benchmark")).drop("n_words")
