"""Session construction and small plan helpers shared by all operators."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# What a side may hold and still be broadcast: rows, and bytes of its values as
# text. A side is only broadcast after both were measured (or when it is bounded
# by construction, e.g. a fixed domain list); beyond it the planner decides.
BROADCAST_MAX_ROWS = 2_000_000
BROADCAST_MAX_BYTES = 64 << 20


def get_session(master: str | None = None, app: str = "riskloom",
                shuffle_partitions: int | None = None) -> SparkSession:
    """The active session when there is one (a cluster's own settings are
    left alone); otherwise a new local/test session with our settings."""
    active = SparkSession.getActiveSession()
    if active is not None and master is None:
        checkpoint_dir(active)
        ship_package(active)
        return active
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    builder = (builder
               .config("spark.ui.enabled", "false")
               .config("spark.ui.showConsoleProgress", "false")
               .config("spark.sql.adaptive.enabled", "true")
               .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
               .config("spark.sql.adaptive.skewJoin.enabled", "true")
               .config("spark.sql.session.timeZone", "UTC")
               .config("spark.sql.execution.arrow.pyspark.enabled", "true"))
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    ship_package(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by the cluster (spark.checkpoint.dir).

    Only when the setting is absent on a local master (tests) a fresh local
    folder is made; a cluster without the setting is an error, as each node
    would write to a disk of its own.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    d = sc.getConf().get("spark.checkpoint.dir", None)
    if not d:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        d = tempfile.mkdtemp(prefix="riskloom-ckpt-")  # unset: local tests only
    sc.setCheckpointDir(d)
    return sc.getCheckpointDir() or d


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder (survives the
    loss of executors, unlike a local checkpoint)."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def sized_broadcast(df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS,
                    max_bytes: int = BROADCAST_MAX_BYTES) -> DataFrame:
    """Broadcast ``df`` only after measuring its rows and bytes; otherwise
    leave the join to the planner (sort-merge / shuffle hash, AQE may still
    convert)."""
    width = F.octet_length(F.to_json(F.struct(*df.columns)))
    size = df.agg(F.count(F.lit(1)).alias("n"), F.sum(width).alias("b")).first()
    return F.broadcast(df) if size["n"] <= max_rows and (size["b"] or 0) <= max_bytes else df


def parallelism_floor(df: DataFrame, key: str | None = None) -> DataFrame:
    """Spread a scan that yields fewer splits than the cluster has cores
    (e.g. one file with one row group) by hashing it on ``key``. A large
    table already has enough splits and passes through unchanged, so this
    never adds a shuffle at scale."""
    target = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= target:
        return df
    return df.repartition(target, key) if key else df.repartition(target)


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make the riskloom package importable in the Python workers (pandas
    UDFs reference its functions): zip it once per application and add it
    with ``addPyFile``, which distributes it to every executor."""
    import zipfile

    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    import riskloom

    pkg = os.path.dirname(os.path.abspath(riskloom.__file__))
    root = os.path.dirname(pkg)
    zpath = os.path.join(tempfile.mkdtemp(prefix="riskloom-pkg-"), "riskloom.zip")
    with zipfile.ZipFile(zpath, "w") as z:
        for dirpath, _, files in os.walk(pkg):
            for f in files:
                if f.endswith((".py", ".csv")):
                    full = os.path.join(dirpath, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(zpath)
    _SHIPPED.add(sc.applicationId)


def to_shared(spark: SparkSession, local_path: str, name: str) -> str:
    """Copy a driver-local file into the shared checkpoint folder (Hadoop
    FileSystem API), so executors on any node can read it."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    dst = jvm.org.apache.hadoop.fs.Path(os.path.join(checkpoint_dir(spark), "shared", name))
    src = jvm.org.apache.hadoop.fs.Path("file://" + os.path.abspath(local_path))
    dst.getFileSystem(conf).copyFromLocalFile(False, True, src, dst)
    return dst.toString()


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")
