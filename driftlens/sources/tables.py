"""Tabular sources with validation, and report sinks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

OVERRIDE_SCHEMA = "image_id string, view_id string, building_id string, year string, reviewed string, notes string"


def read_override_csv(spark: SparkSession, path) -> DataFrame:
    return spark.read.schema(OVERRIDE_SCHEMA).option("header", True).csv(path)


def _blank(column):
    text = F.trim(F.col(column))
    return F.when(text != "", text)


def checked_overrides(rows: DataFrame, ids: DataFrame):
    """(reviewed overrides, problems): blanks become NULL, bad rows are reported."""
    flag = F.coalesce(F.lower(F.trim("reviewed")), F.lit(""))
    year = F.expr("try_cast(trim(year) AS int)")
    typed = rows.select(
        "image_id", _blank("view_id").alias("view_id"), _blank("building_id").alias("building_id"), year.alias("year"), _blank("year").alias("_text"), flag.alias("_flag"), "notes"
    )
    reviewed = F.col("_flag") == "true"
    bad_year = F.col("_text").isNotNull() & ~F.coalesce(F.col("year").between(1800, 2100), F.lit(False))
    checks = F.array_compact(F.array(
        F.when(~F.col("_flag").isin("true", "false", ""), "invalid_reviewed_flag"),
        F.when(reviewed & F.col("building_id").isNull(), "reviewed_without_building"), F.when(reviewed & bad_year, "invalid_year"),
    ))
    problems = typed.select("image_id", F.explode(checks).alias("problem"))
    twice = typed.groupBy("image_id").count().filter("count > 1").select("image_id", F.lit("duplicate_override").alias("problem"))
    unknown = typed.join(ids, "image_id", "left_anti").select("image_id", F.lit("unknown_image").alias("problem"))
    good = typed.filter(reviewed & F.col("building_id").isNotNull() & ~bad_year).drop("_text", "_flag")
    # An id given twice or not known is reported and never accepted.
    good = good.join(twice, "image_id", "left_anti").join(ids, "image_id", "left_semi")
    return good, problems.unionByName(twice).unionByName(unknown)


def read_index(spark: SparkSession, path, schema) -> DataFrame:
    """Line-delimited JSON; unparsable lines stay visible in ``_corrupt_record``."""
    return spark.read.schema(f"{schema}, _corrupt_record string").json(path)


def duplicate_keys(rows: DataFrame, key) -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias("rows")).filter("rows > 1")


def flat_columns(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text, ready for CSV."""
    nested = {f.name for f in df.schema.fields if f.dataType.typeName() in ("struct", "array", "map")}
    return df.select(*[F.to_json(c).alias(c) if c in nested else F.col(c) for c in df.columns])


def union_tables(frames) -> DataFrame:
    """Union of columns in first-seen order; absent ones are NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def write_table(df: DataFrame, path, kind="parquet", partition_by=()) -> None:
    writer = (flat_columns(df) if kind == "csv" else df).write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.option("header", True).format(kind).save(path)


def write_wide_report(df: DataFrame, path, by=("domain", "split", "mode"), files=None) -> None:
    """One folder per report slice.

    Slices are rebalanced at run time, so a large slice becomes several tasks
    and files; ``files`` fixes the number of files of every slice instead.
    """
    if files is None:
        flat_columns(df).hint("rebalance", *by).write.mode("overwrite").partitionBy(*by).option("header", True).csv(path)
        return
    salt = F.pmod(F.xxhash64(*[F.col(c).cast("string") for c in df.columns]), F.lit(files))
    flat = flat_columns(df).withColumn("_salt", salt)
    flat.repartition(*by, "_salt").drop("_salt").write.mode("overwrite").partitionBy(*by).option("header", True).csv(path)
