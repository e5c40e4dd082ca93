"""Exports: Parquet ordered by score (NULLs last), CSV with the list column
joined. The writers are Spark's own, one file per task; the global order is
a range-partitioned sort, so no task holds the whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def export_order(df: DataFrame, score: str = "potential_score", key: str = "id") -> DataFrame:
    return df.orderBy(F.col(score).desc_nulls_last(), F.col(key))


def flatten_lists(df: DataFrame, sep: str = ", ") -> DataFrame:
    """Array-of-string columns become ``sep``-joined strings (CSV has no lists)."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.ArrayType):
            cols.append(F.array_join(F.col(f.name), sep).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def export(df: DataFrame, path: str, mode: str = "overwrite", score: str = "potential_score", key: str = "id") -> str:
    """Write ``df`` ordered by score; ``.parquet`` suffix -> Parquet, anything
    else -> CSV with a header. Returns the format used."""
    ordered = export_order(df, score, key)
    if path.lower().endswith(".parquet"):
        ordered.write.mode(mode).parquet(path)
        return "parquet"
    # a quote inside a field is doubled, as CSV readers expect
    flatten_lists(ordered).write.mode(mode).options(header=True, escape='"').csv(path)
    return "csv"


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """What ``export`` wrote as CSV: fields may hold quotes and line breaks."""
    return spark.read.schema(schema).options(header=True, escape='"', multiLine=True).csv(path)
