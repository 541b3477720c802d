"""Session and checkpoint helpers."""
from __future__ import annotations

import os
import tempfile
import threading
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, shuffle_partitions: int = 8,
                  app_name: str = "quarry", text_partitions: int | None = None) -> SparkSession:
    """Session for tests and local runs. On a cluster use the cluster's own
    session; the settings below only fill gaps.  ``text_partitions``: see
    :func:`quarry.sources.tables.table`."""
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    b = (b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
          .config("spark.sql.adaptive.enabled", "true")
          .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
          .config("spark.sql.adaptive.skewJoin.enabled", "true")
          .config("spark.sql.session.timeZone", "UTC")
          .config("spark.sql.execution.arrow.pyspark.enabled", "true")
          .config("spark.ui.enabled", "false")
          .config("spark.ui.showConsoleProgress", "false")
          .config("spark.driver.memory", "16g"))
    if text_partitions:
        b = b.config("spark.quarry.textPartitions", str(text_partitions))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``quarry`` importable in every Python worker (executors on a
    cluster, worker processes locally): zip the package's sources once per
    application and add it with ``SparkContext.addPyFile``, which Spark copies
    to each executor."""
    sc = spark.sparkContext
    app = sc.applicationId
    if app in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg)
    zpath = os.path.join(tempfile.mkdtemp(prefix="quarry-pkg-"), "quarry.zip")
    with zipfile.ZipFile(zpath, "w", zipfile.ZIP_DEFLATED) as z:
        for dirpath, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(dirpath, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(zpath)
    _SHIPPED.add(app)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the cluster's ``spark.checkpoint.dir``; only when it is unset (local
    tests) create a private scratch directory."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not conf_dir:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        conf_dir = tempfile.mkdtemp(prefix="quarry-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the queries that end inside are deleted as each ends.  For
    writes, whose plan nobody runs again: Spark itself would keep the files until the
    driver collects its garbage."""
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)


_CUTS: dict[str, list[str]] = {}
_BATCH = threading.local()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` as a Parquet table in the shared checkpoint folder and
    read it back: lineage is cut (a lost executor re-reads files instead of
    recomputing), the copy is columnar and compressed, and later readers get
    column pruning.  Never ``localCheckpoint``.  The table lives until
    :func:`drop_cuts`."""
    spark = df.sparkSession
    path = scratch_path(spark, "cut")
    with shuffles_dropped(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A new folder name under the checkpoint folder, remembered for
    :func:`drop_cuts`."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"
    mine = getattr(_BATCH, "paths", None)
    (_CUTS.setdefault(spark.sparkContext.applicationId, []) if mine is None else mine).append(path)
    return path


@contextmanager
def batch_cuts(spark: SparkSession) -> Iterator[None]:
    """Intermediate tables that this thread writes inside are deleted at the end: a
    stream's batch leaves only what it returns.  No frame made inside is used later."""
    outer, _BATCH.paths = getattr(_BATCH, "paths", None), []
    try:
        yield
    finally:
        mine, _BATCH.paths = _BATCH.paths, outer
        _delete(spark, mine)


def drop_cuts(spark: SparkSession) -> int:
    """Delete the intermediate tables this application wrote so far.  Call it
    when no frame that reads them is needed any more (after a query's result
    was written); returns how many folders were named."""
    paths = _CUTS.pop(spark.sparkContext.applicationId, [])
    _delete(spark, paths)
    return len(paths)


def _delete(spark: SparkSession, paths: list[str]) -> None:
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(conf).delete(target, True)
