"""The stored tables as plain partitioned Parquet under one root folder::

    state/part=<p>/batch=<b>/          rows that batch b inserted or changed, whole
    snapshots/day=<d>/batch=<b>/       snapshot rows of batch b, by their day
    runs/batch=<b>/record=<r>/         run records: started, ended or failed
    quarantine/batch=<b>/              malformed nodes and pages of batch b, with the reasons

Batches are written with dynamic partition overwrite, so a replay replaces what it
wrote before and nothing else. The current state is the row of the latest batch for
each id. ``part`` is a hash of the id: a batch reads the partitions that its ids fall
in and appends its own rows, whatever the size of the state. A time bound prunes days.
"""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Hash partitions of the state; fixed for a store.
PARTS = 64
PARTITIONED = {
    "state": [T.StructField("part", T.IntegerType()), T.StructField("batch", T.LongType())],
    "snapshots": [T.StructField("day", T.DateType()), T.StructField("batch", T.LongType())],
    "runs": [T.StructField("batch", T.LongType()), T.StructField("record", T.StringType())],
    "quarantine": [T.StructField("batch", T.LongType())],
}


def path_of(root: str, table: str) -> str:
    return f"{root.rstrip('/')}/{table}"


def _there(spark: SparkSession, path: str):
    sc = spark.sparkContext
    target = sc._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(sc._jsc.hadoopConfiguration()), target


def part_of(key: str) -> Column:
    return F.pmod(F.xxhash64(F.col(key)), F.lit(PARTS)).cast("int")


def utc(micros: int) -> datetime:
    """Microseconds since 1970 as a naive UTC datetime, whatever zone the driver is in."""
    return datetime(1970, 1, 1) + timedelta(microseconds=micros)


def write(df: DataFrame, root: str, table: str) -> None:
    """Replaces the partitions that ``df`` (with the table's partition columns) has rows in."""
    names = [f.name for f in PARTITIONED[table]]
    df.write.partitionBy(*names).option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path_of(root, table))


def write_batch(root: str, batch: int, state: DataFrame | None = None, snapshots: DataFrame | None = None) -> None:
    """The rows that a batch changed in the state, and its new snapshots."""
    if state is not None:
        state = state.withColumn("part", part_of("id")).withColumn("batch", F.lit(int(batch)))
        write(state.repartition("part"), root, "state")
    if snapshots is not None:
        write(snapshots.withColumn("day", F.to_date("snapshot_at")).withColumn("batch", F.lit(int(batch))), root, "snapshots")


def read_rows(spark: SparkSession, root: str, table: str, schema: T.StructType, before_batch: int | None = None, since: date | None = None) -> DataFrame:
    """All stored rows with their partition columns; of batches before ``before_batch``, of ``since`` and later days."""
    full = T.StructType([*schema.fields, *PARTITIONED[table]])
    fs, target = _there(spark, path_of(root, table))
    if not fs.exists(target):
        return spark.createDataFrame([], full)
    rows = spark.read.schema(full).parquet(path_of(root, table))
    rows = rows if before_batch is None else rows.where(F.col("batch") < int(before_batch))
    return rows if since is None else rows.where(F.col("day") >= F.lit(since))


def read_appended(spark: SparkSession, root: str, table: str, schema: T.StructType, before_batch: int | None = None, since: datetime | None = None) -> DataFrame:
    """Rows of an appended table (later than ``since``) without the partition columns."""
    rows = read_rows(spark, root, table, schema, before_batch, since.date() if since is not None else None)
    rows = rows if since is None else rows.where(F.unix_micros("snapshot_at") > int((since - datetime(1970, 1, 1)) / timedelta(microseconds=1)))
    return rows.select(*schema.names)


def read_state(spark: SparkSession, root: str, schema: T.StructType, before_batch: int | None = None, keys: DataFrame | None = None) -> DataFrame:
    """The latest row of each id (of batches before ``before_batch``).

    With ``keys`` (column ``id``) only theirs: the partitions that they fall in are
    read, by their numbers, PARTS at most.
    """
    rows = read_rows(spark, root, "state", schema, before_batch)
    if keys is not None:
        keys = keys.select("id").distinct()
        parts = [r[0] for r in keys.select(part_of("id")).distinct().collect()]
        rows = rows.where(F.col("part").isin(parts) if parts else F.lit(False)).join(keys, "id", "left_semi")
    latest = rows.groupBy("id").agg(F.max_by(F.struct(*schema.names), "batch").alias("row"))
    return latest.select("row.*")


def replace_rows(spark: SparkSession, root: str, table: str, touched: DataFrame, left: DataFrame) -> None:
    """Rewrites the partitions in ``touched`` with their rows in ``left`` (both written elsewhere); others stay as they are."""
    names = [f.name for f in PARTITIONED[table]]
    write(left.join(touched, names, "left_semi"), root, table)
    for row in touched.join(left.select(*names).distinct(), names, "left_anti").collect():  # partitions, not rows
        drop(spark, f"{path_of(root, table)}/" + "/".join(f"{n}={row[n]}" for n in names))


def drop(spark: SparkSession, path: str) -> None:
    fs, target = _there(spark, path)
    fs.delete(target, True)
