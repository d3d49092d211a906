"""Facts about one table of rows: classes, entities, runs, fills and nulls."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import tables
from . import positions, profiles


def fill_check(df: DataFrame, columns: list[str]) -> DataFrame:
    """Of each column with values that aren't whole: how many rows, how many values, and the most frequent.

    NaN isn't whole; nulls don't count. Values are counted once over all columns; ties go to the least.
    """
    rows = df.agg(F.count(F.lit(1)).alias("rows_sampled"))
    long = df.select(*(F.col(c).cast("double").alias(c) for c in columns)).unpivot([], columns, "column", "value").where("value is not null and (isnan(value) or value % 1 <> 0)")
    counts = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    top = F.min_by(F.struct("value", "n"), F.struct(-F.col("n"), F.col("value")))
    out = counts.groupBy("column").agg(F.sum("n").alias("non_integer_rows"), F.count(F.lit(1)).alias("distinct_non_integer"), top.alias("top"))
    return out.crossJoin(F.broadcast(rows)).select("column", "rows_sampled", "non_integer_rows", "distinct_non_integer", F.col("top.value").alias("top_value"), F.col("top.n").alias("top_value_rows"))


def null_columns(df: DataFrame) -> DataFrame:
    """Columns with a null, from the rows (where footers can't be read)."""
    counts = df.agg(*(F.count_if(F.col(c).isNull()).alias(c) for c in df.columns))
    return counts.unpivot([], df.columns, "column", "nulls").where("nulls > 0")


def report(df: DataFrame, key: str, label: str, order: str, fill_columns: list[str]) -> DataFrame:
    """All facts as one nested row."""
    classes = profiles.per_label(df, label, key).agg(F.map_from_entries(F.collect_list(F.struct(F.coalesce(label, F.lit("")), F.struct("rows", "entities")))).alias("classes"))
    fills = fill_check(df, fill_columns).agg(F.collect_list(F.struct("*")).alias("filled_columns")) if fill_columns else df.sparkSession.range(1).select(F.array().alias("filled_columns"))
    parts = [positions.runs(df, key, order), profiles.rows_per_entity(df, key), profiles.unknown_rows(df, label), classes, fills]
    return reduce(lambda a, b: a.crossJoin(b), parts)  # one row each


def scan_file(spark: SparkSession, path: str, key: str, label: str, fill_columns: list[str], sample_groups: int = 3) -> DataFrame:
    """One nested row of facts on a parquet file, in the order of its rows.

    Footer facts and null columns, keys that stand on both sides of a row group's end, runs, classes and
    entities over all rows, and fills over the rows of some row groups, spread over the file.
    """
    listed = tables.list_parquet(spark, path)
    facts = tables.footers(listed).collect()
    if len(facts) != 1:
        raise ValueError(f"{path} is {len(facts)} parquet files, not one")
    found = facts[0]
    rows = spark.read.parquet(path)
    placed = rows.select("*", F.col("_metadata.row_index").alias("_at"))
    whole = report(placed, key, label, "_at", [])
    sampled = fill_check(tables.sampled_rows(rows, found.group_rows, sample_groups), fill_columns).agg(F.collect_list(F.struct("*")).alias("filled_columns")) if fill_columns else whole.select("filled_columns")
    spans = tables.group_spans(rows, key, found.group_rows)
    fixed = spark.createDataFrame([(path, found.rows, found.row_groups, found.null_columns, spans)], "path string, rows long, row_groups int, null_columns array<string>, keys_over_group_ends long")
    return fixed.crossJoin(whole.drop("filled_columns")).crossJoin(sampled)  # one row each
