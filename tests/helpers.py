from datetime import datetime

from cohortlake.schemas import ENTITY_DEFAULTS, ENTITY_SCHEMA, SNAPSHOT_SCHEMA, conform

AS_OF = datetime(2026, 3, 1)


def entities(spark, rows):
    """rows: list of dicts with any entity columns; the rest take defaults."""
    cols = sorted({k for r in rows for k in r})
    fields = {f.name: f for f in ENTITY_SCHEMA.fields}
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField(c, fields[c].dataType) for c in cols])
    df = spark.createDataFrame([tuple(r.get(c) for c in cols) for r in rows], schema)
    return conform(df, ENTITY_SCHEMA, ENTITY_DEFAULTS)


def repo(i, **kw):
    """An entity that every check of the text quality passes, a hundred days old."""
    base = dict(
        id=f"e-{i}", name=f"lake{i}", full_name=f"shore/lake{i}", primary_language="Scala",
        stars=240, forks=31, open_issues=7, closed_issues=44, contributors_count=12,
        created_at=datetime(2025, 11, 21), updated_at=datetime(2026, 2, 14), pushed_at=datetime(2026, 2, 11),
        readme_length_chars=1234, readme_h2_sections=6, readme_has_badges=True, readme_has_demo_gif=True,
        readme_has_install=True, releases_count=3,
    )
    base.update(kw)
    return base


def no_snapshots(spark):
    return spark.createDataFrame([], SNAPSHOT_SCHEMA)
