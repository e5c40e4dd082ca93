"""Table scans.

Reads are lazy and column-pruned: callers pass the columns they need so the
Parquet scan's ``ReadSchema`` only holds those, and filters applied later are
pushed into the scan by Catalyst.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlake.schemas import conform

#: Types that another one holds without loss (a column may have grown from them).
WIDENS = {
    "tinyint": ("smallint", "int", "bigint", "float", "double"),
    "smallint": ("int", "bigint", "float", "double"),
    "int": ("bigint", "double"),
    "float": ("double",),
    "date": ("timestamp",),
    "timestamp_ntz": ("timestamp",),
}


def as_instants(df: DataFrame) -> DataFrame:
    """Timestamps without zone become instants (session zone is UTC)."""
    ntz = {f.name for f in df.schema.fields if isinstance(f.dataType, T.TimestampNTZType)}
    if not ntz:
        return df
    return df.select(*[F.col(c).cast("timestamp").alias(c) if c in ntz else F.col(c) for c in df.columns])


def read_table(
    spark: SparkSession,
    path: str,
    schema: T.StructType | None = None,
    columns: list[str] | None = None,
) -> DataFrame:
    """Scan a Parquet table, optionally with a declared schema and a projection."""
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    df = reader.parquet(path)
    if columns:
        df = df.select(*columns)
    return as_instants(df)


def driver_table(spark: SparkSession, sf_dir: str, name: str, columns: list[str] | None = None) -> DataFrame:
    """One of the driver's tables under ``sf_dir``."""
    return read_table(spark, f"{sf_dir.rstrip('/')}/{name}.parquet", columns=columns)


def widens(old: T.DataType, new: T.DataType) -> bool:
    """Whether every value of ``old`` is one of ``new``."""
    if isinstance(old, T.ArrayType) and isinstance(new, T.ArrayType):
        return widens(old.elementType, new.elementType)
    if isinstance(old, T.DecimalType) and isinstance(new, T.DecimalType):
        return new.scale >= old.scale and new.precision - new.scale >= old.precision - old.scale
    names = old.simpleString(), new.simpleString()
    return names[0] == names[1] or names[1] in WIDENS.get(names[0], ())


def read_evolved(
    spark: SparkSession,
    folders: list[str],
    schema: T.StructType,
    defaults: dict | None = None,
    keep_extra: bool = False,
) -> DataFrame:
    """Parquet folders of different age as one table of the declared schema.

    The files of a folder are merged by column name (``mergeSchema``; a column that a
    file lacks is NULL in its rows). A column that a whole folder lacks takes its
    default, a narrower stored type becomes the declared one, and undeclared columns
    are dropped, or kept with ``keep_extra``. A stored type that the declared one does
    not hold without loss is an error, raised before any row is read. Every scan reads
    only its folder's own columns that are asked for.
    """
    if not folders:
        raise ValueError("read_evolved needs at least one folder")
    declared = {f.name: f.dataType for f in schema.fields}
    out: DataFrame | None = None
    for folder in folders:
        old = spark.read.option("mergeSchema", "true").parquet(folder)
        lossy = [f"{f.name}: {f.dataType.simpleString()}" for f in old.schema.fields if f.name in declared and not widens(f.dataType, declared[f.name])]
        if lossy:
            raise ValueError(f"{folder} has columns that the declared types do not hold: {', '.join(lossy)}")
        part = conform(old, schema, defaults, keep_extra)
        out = part if out is None else out.unionByName(part, allowMissingColumns=keep_extra)
    return out
