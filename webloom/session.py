"""Session helpers.

The library never creates a session on its own; operators take DataFrames.
`local_session` is for tests and the bench.  `ensure_checkpoint_dir` reads the
cluster's shared checkpoint folder from the session; where none is configured
it takes a folder on the cluster's default file system.
"""
from __future__ import annotations

import gc
import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "webloom") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.webloom.spread", str(os.cpu_count() if cores == "*" else cores))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def _context(spark: SparkSession):
    """The SparkContext of a classic session; None for a Spark Connect client."""
    try:
        return spark.sparkContext
    except Exception:  # noqa: BLE001 - Connect sessions expose no SparkContext
        return None


def parallelism(spark: SparkSession) -> int:
    sc = _context(spark)
    if sc is not None:
        return sc.defaultParallelism
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def refuse_local(master: str, uri: str) -> None:
    """An error where scratch tables would go to each machine's own disk."""
    if uri.startswith("file:") and not master.startswith("local"):
        raise RuntimeError(f"the default file system of this cluster is {uri}, which machines do not share: "
                           "set spark.checkpoint.dir to a shared folder")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, setting a scratch one only if unset."""
    sc = _context(spark)
    if sc is None:   # Connect: the server's configured folder
        conf_dir = spark.conf.get("spark.checkpoint.dir", None)
        if not conf_dir:
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        return conf_dir
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if not conf_dir:     # the cluster's default file system, not this machine's temp folder
        fs = sc._jvm.org.apache.hadoop.fs.FileSystem.get(sc._jsc.hadoopConfiguration())
        base = fs.getUri().toString()
        refuse_local(sc.master, base)
        conf_dir = f"{base.rstrip('/')}/tmp/webloom-{sc.applicationId}"
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared folder (survives executor loss)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Let Spark's ContextCleaner drop shuffle files of finished jobs now.

    It does so when the driver's JVM has collected the plans that own them;
    left alone that happens every 30 minutes (spark.cleaner.periodicGC.interval),
    and a chain of jobs would keep every exchange on disk until then.
    """
    gc.collect()
    try:
        spark.sparkContext._jvm.System.gc()
    except Exception:  # noqa: BLE001 - a Connect client has no JVM of its own
        pass


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists, asked of the cluster's Hadoop file system."""
    sc = _context(spark)
    if sc is None:      # Connect: only the reader can tell
        return bool(spark.read.format("binaryFile").option("recursiveFileLookup", "true")
                    .option("ignoreMissingFiles", "true").load(path.rstrip("/") + "*").limit(1).count())
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(sc._jsc.hadoopConfiguration()).exists(p))


def table(spark: SparkSession, sf_dir: str, name: str, spread: bool = False) -> DataFrame:
    """Read a driver table.

    ``spread=True`` marks inputs followed by CPU-heavy per-row work
    (tokenising, HTML parsing, splitting).  Where the session sets
    ``spark.webloom.spread`` to a number (``local_session`` does: its tables are
    single row groups, one task each), these are dealt out over that many
    tasks; elsewhere the scan's own splits are used, at any size.
    """
    df = spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
    n = spark.conf.get("spark.webloom.spread", None) if spread else None
    return df.repartition(int(n)) if n else df


def table_stream(spark: SparkSession, sf_dir: str, name: str, files_per_batch: int = 64) -> DataFrame:
    """A driver table as a stream of its files, be it one file or a folder of part files."""
    schema = spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet")).schema
    # a stream refuses the path of a single file unless it is a pattern; this one matches that name only
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
            .parquet(os.path.join(sf_dir, f"{name}.parque[t]")))


def remove_path(spark: SparkSession, path: str) -> bool:
    """Delete a folder through the cluster's Hadoop file system; whether it was there."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True))


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder (never machine-local
    on a cluster: the checkpoint folder is the cluster's shared one)."""
    import uuid
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/webloom-scratch/{name}-{uuid.uuid4().hex}"


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``webloom`` importable by every Python worker of this application.

    Python UDF workers (``mapInPandas``, ``applyInPandas``, pandas UDFs)
    import the functions they run by module; they do not see the driver's
    ``sys.path``.  The package is zipped once per application and added with
    ``addPyFile``, which distributes it to every executor, as a cluster job
    ships its code.
    """
    import zipfile
    sc = _context(spark)
    app = sc.applicationId if sc is not None else f"connect-{id(spark)}"
    if app in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    out = os.path.join(tempfile.mkdtemp(prefix="webloom-pkg-"), "webloom.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for base, _dirs, files in os.walk(root):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(base, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    if sc is not None:
        sc.addPyFile(out)
    else:
        spark.addArtifacts(out, pyfile=True)
    _SHIPPED.add(app)
