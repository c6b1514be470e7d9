"""The registered queries over the whole smoke tables."""
import os

import duckdb
import pytest

import __spark_entry__ as E
from webloom.llm.queries import ORACLE_SQL, QUERIES

from .tests_data import SF001

COLUMNS = {
    "op1_decontamination": {"doc_id", "item_id", "score"},
    "op3_quality_rules": {"doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"},
    "op4_quality": {"doc_id", "held_out", "score", "predicted"},
    "op5_jaccard_join": {"doc_id", "n_shingles", "component_id"},
    "op7_sharding": {"doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"},
    "op8_toxicity": {"doc_id", "held_out", "score", "predicted"},
    "op9_token_output": {"doc_id", "start", "n_tokens", "ids_crc32"},
    "op10_substring_dedup": {"doc_id", "n_words", "n_removed", "kept_sha256"},
    "op11_fill_in_middle": {"doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"},
    "op12_packing": {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"},
    "op13_importance_resampling": {"doc_id", "n_features", "weight", "score", "rank"},
}
FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython")


def test_each_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES if n.startswith("op")) == list(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(E.queries()) and set(ORACLE_SQL) <= set(E.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_whole_tables(spark, name):
    df = E.queries()[name](spark, SF001)
    rows = sorted((tuple(r[c] for c in sorted(df.columns)) for r in df.collect()), key=repr)
    assert COLUMNS.get(name, set()) <= set(df.columns)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in FORBIDDEN)
    if name not in ("op1_decontamination", "op2_warc_revisits", "op12_packing", "rules_ablation"):
        assert len(rows) == spark.read.parquet(f"{SF001}/documents.parquet").count()
    if name in ORACLE_SQL:
        con = duckdb.connect()
        for f in os.listdir(SF001):
            con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF001}/{f}')")
        cur = con.execute(ORACLE_SQL[name])
        cols = [d[0] for d in cur.description]
        assert sorted(cols) == sorted(df.columns)
        want = sorted((tuple(dict(zip(cols, r))[c] for c in sorted(cols)) for r in cur.fetchall()), key=repr)
        assert rows == want


def test_sharding_law(spark):
    rows = E.queries()["op7_sharding"](spark, SF001).collect()
    n = [sum(r.shard == s for r in rows) for s in range(40)]
    assert max(n) - min(n) <= 1 and {r.law for r in rows} == {"rows"}
