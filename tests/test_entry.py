import os

import __spark_entry__ as E
from webloom.plans import QUERIES


def test_registry_consistent():
    q, s = E.queries(), E.oracle_sql()
    assert set(s) <= set(q)
    assert len(q) >= 50


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["qid", "context"]
    assert df.count() > 0


def test_every_query_runs_on_smoke_data(spark):
    for name in QUERIES:
        df = E.queries()[name](spark, "/root/testdata/sf0.001")
        df.write.format("noop").mode("overwrite").save()


def test_workers_import_the_shipped_package(tmp_path):
    """Run a Python-worker query from another directory, with the repo only on
    the driver's sys.path: the shipped zip must make webloom importable."""
    import subprocess
    import sys
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = ("import sys; sys.path.insert(0, %r)\n"
            "from pyspark.sql import SparkSession\n"
            "s = SparkSession.builder.master('local[2]').config('spark.ui.enabled','false').getOrCreate()\n"
            "import __spark_entry__ as E\n"
            "print('ROWS', E.queries()['page_text'](s, '/root/testdata/sf0.001').count())\n") % repo
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env,
                         capture_output=True, text=True, timeout=600)
    assert "ROWS 50" in out.stdout, out.stderr[-2000:]
