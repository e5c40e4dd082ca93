"""Session set-up shared by the library, the tests and the bench.

Everything here is plain Spark configuration. The library never reads the
wall clock: every operator takes an explicit ``as_of`` timestamp.
"""

from __future__ import annotations

import os
import tempfile
import threading
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Settings every query relies on. The session time zone is pinned to UTC so
# that timestamp literals and day arithmetic mean the same on every executor.
SQL_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime SQL settings to an existing session."""
    for key, value in SQL_CONF.items():
        spark.conf.set(key, value)
    ensure_checkpoint_dir(spark)
    return spark


def get_spark(
    app_name: str = "cohortlake",
    master: str | None = None,
    shuffle_partitions: int | None = None,
    extra: dict[str, str] | None = None,
) -> SparkSession:
    """Build (or fetch) a session with the library's settings.

    ``master`` and ``shuffle_partitions`` are only applied when given, so on a
    cluster the submit-time settings win.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    builder = builder.config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    for key, value in SQL_CONF.items():
        builder = builder.config(key, value)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in (extra or {}).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint directory, setting one only when unset.

    On a cluster ``spark.checkpoint.dir`` names a shared folder and is used as
    is. Only when nothing is configured (local runs, tests) a fresh scratch
    folder is created.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None
    )
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError(
                "spark.checkpoint.dir is not set; point it at a shared folder "
                "(HDFS/object store) before running on a cluster"
            )
        configured = tempfile.mkdtemp(prefix="cohortlake-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the reliable checkpoint folder (shared storage on
    a cluster) for intermediate files such as exports or landed pages."""
    import uuid

    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/scratch/{name}-{uuid.uuid4().hex[:12]}"


def freeze(df: DataFrame) -> DataFrame:
    """Cut the lineage of a DataFrame that several branches consume.

    Writes it once as a Parquet table in a scratch folder under the
    reliable checkpoint folder (shared storage on a cluster, so lost
    executors do not lose it) and reads it back. Without this, every branch
    re-runs the whole upstream plan. (``Dataset.checkpoint`` would compute
    the plan twice - once to count, once to write - and store rows rather
    than columns.)
    """
    spark = df.sparkSession
    path = scratch_dir(spark, "frozen")
    for paths in getattr(_scopes, "open", []):
        paths.append(path)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_scopes = threading.local()


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Drops the tables that :func:`freeze` writes within, at the end.

    For jobs whose results are written elsewhere before the end, such as a batch
    of a stream; a DataFrame that reads such a table must not be used after it.
    """
    paths: list[str] = []
    _scopes.open = [*getattr(_scopes, "open", []), paths]
    try:
        yield
    finally:
        _scopes.open = _scopes.open[:-1]
        sc = spark.sparkContext
        for path in paths:
            target = sc._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(sc._jsc.hadoopConfiguration()).delete(target, True)
