"""Structured Streaming forms: incremental ingest, per-host flush state, running
feedback statistics.  All use ``availableNow`` triggers in tests and the
registered queries, checkpoints under the shared checkpoint folder, and
idempotent or overwrite sinks so a replayed micro-batch changes nothing."""

from contextlib import contextmanager


@contextmanager
def state_partitions(spark, n: int | None = None):
    """Start a stateful stream with ``n`` state partitions; without ``n`` the
    session's shuffle partitions hold and nothing is changed.

    A stateful query fixes its partition count in its checkpoint when it
    first starts; the session setting is restored afterwards.
    """
    key = "spark.sql.shuffle.partitions"
    old = spark.conf.get(key)
    if n is None:
        yield int(old)
        return
    spark.conf.set(key, str(n))
    try:
        yield n
    finally:
        spark.conf.set(key, old)
