"""Time-series points (one row per field value) to wide tables and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Columns that are tags by convention.
TAG_PREFIX = "tag_"
TAG_NAMES = ("host", "region")


def points_to_table(points: DataFrame, tags: list[str], fields: list[str], measurement: str | None = None) -> DataFrame:
    """One row per tags and time, one column per field.

    The field list is given, so one aggregation does it, combined map-side. Of
    two values for one point the larger stays, which makes a rerun give the same table.
    """
    rows = points.filter(F.col("measurement") == measurement) if measurement else points
    keys = ([] if measurement else ["measurement"]) + tags + ["time"]
    values = [F.max(F.when(F.col("field") == f, F.col("field_value"))).alias(f) for f in fields]
    return rows.filter(F.col("field").isin(*fields)).groupBy(*keys).agg(*values)


def measurement_schema(points: DataFrame, tags: list[str]) -> DataFrame:
    """Columns of each measurement: the time, its tags and its fields with their types."""
    fields = points.groupBy("measurement", "field", "field_type").agg(F.count("*").alias("n"))
    typed = fields.groupBy("measurement", F.col("field").alias("column_name")).agg(F.upper(F.min("field_type")).alias("data_type"))
    names = fields.select("measurement").distinct()
    fixed = [F.struct(F.lit("time").alias("column_name"), F.lit("TIMESTAMP").alias("data_type"))]
    fixed += [F.struct(F.lit(t).alias("column_name"), F.lit("TAG").alias("data_type")) for t in tags]
    always = names.select("measurement", F.explode(F.array(*fixed)).alias("c")).select("measurement", "c.*")
    return always.unionByName(typed).withColumn("is_key", F.col("data_type").isin("TIMESTAMP", "TAG"))


def point_rows(points: DataFrame, tags: list[str]) -> DataFrame:
    """Rows per measurement as the wide table has them, not field values."""
    rows = points.select("measurement", *tags, "time").distinct()
    return rows.groupBy("measurement").agg(F.count("*").alias("n_rows"))


def is_tag(name: str, tags: list[str]) -> bool:
    return name in tags or name.startswith(TAG_PREFIX) or name in TAG_NAMES


def table_to_points(df: DataFrame, measurement: str, default_time: Column, tags: list[str] | None = None) -> DataFrame:
    """Long points from a wide table: (measurement, tags…, time, field, value).

    Text tags are kept, other tag values are dropped as the store's writer does;
    a row without a time gets the time the caller passes; empty fields give no point.
    """
    names = [c for c in df.columns if c != "time"]
    tag_cols = [c for c in names if is_tag(c, tags or []) and isinstance(df.schema[c].dataType, T.StringType)]
    fields = [c for c in names if not is_tag(c, tags or [])]
    when = F.coalesce(F.col("time"), default_time).alias("time")
    values = [F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in fields]
    out = df.select(F.lit(measurement).alias("measurement"), *tag_cols, when, F.explode(F.array(*values)).alias("p"))
    return out.select("measurement", *tag_cols, "time", "p.field", "p.value").filter(F.col("value").isNotNull())
