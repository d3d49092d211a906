"""Positions within an entity, prefixes, sliding windows and runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def file_order() -> list[Column]:
    """The place of a row in its files; carried explicitly, for a table has no order of its own."""
    return [F.col("_metadata.file_path"), F.col("_metadata.row_index")]


def with_position(df: DataFrame, key: str, order: list, name: str = "position") -> DataFrame:
    """1-based number of each row within its entity."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(key).orderBy(*order)).cast("long"))


def first_rows(rows: DataFrame, key: str, prefixes: list[int], position: str = "position") -> DataFrame:
    """For each prefix N, the row with the largest position up to N of each entity, as ``prefix``.

    All prefixes come from one pass; an entity's rows beyond the longest prefix are dropped before the
    exchange, and the rest is pre-aggregated by ``max_by``.
    """
    near = rows.where(F.col(position) <= max(prefixes))
    spread = near.withColumn("prefix", F.explode(F.array(*(F.lit(n) for n in sorted(prefixes))))).where(F.col(position) <= F.col("prefix"))
    last = spread.groupBy(key, "prefix").agg(F.max_by(F.struct(*rows.columns), position).alias("row"))
    return last.select("prefix", "row.*").withColumn("windows", F.col(position))


def sliding_counts(rows: DataFrame, key: str, what: str, values: list[str], width: int, position: str = "position") -> DataFrame:
    """Counts of each value among the last ``width`` rows; the head grows from one row."""
    over = Window.partitionBy(key).orderBy(position).rowsBetween(1 - width, 0)
    return rows.select(key, position, *(F.sum((F.col(what) == v).cast("long")).over(over).alias(v) for v in values))


def window_mass(rows: DataFrame, key: str, width: int) -> DataFrame:
    """Rows of each entity and the sum that all its sliding counts must have."""
    counted = rows.groupBy(key).agg(F.count(F.lit(1)).alias("windows"))
    w = F.col("windows")
    head = F.expr("windows * (windows + 1) div 2")
    return counted.withColumn("expected", F.when(w <= width, head).otherwise(w * width - width * (width - 1) // 2).cast("long"))


def runs(df: DataFrame, key: str, order: str, chunk: int = 1_000_000) -> DataFrame:
    """One row: rows, distinct keys, maximal runs of equal consecutive keys, contiguous.

    Runs are counted within chunks of the order column and joined at the chunks' ends, so no window
    spans the whole table.
    """
    rows = df.select(F.col(key).alias("k"), F.col(order).alias("o"), F.floor(F.col(order) / chunk).alias("c"))
    before = F.lag("k").over(Window.partitionBy("c").orderBy("o"))
    marked = rows.select("c", "o", "k", (F.row_number().over(Window.partitionBy("c").orderBy("o")) == 1).alias("first"), F.equal_null(before, F.col("k")).alias("same"))
    parts = marked.groupBy("c").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("first") | ~F.col("same")).alias("runs"), F.min_by("k", "o").alias("head"), F.max_by("k", "o").alias("tail"))
    tail = F.lag("tail").over(Window.orderBy("c"))  # a row per chunk
    joined = parts.select("n", "runs", (F.lag("c").over(Window.orderBy("c")).isNotNull() & F.equal_null(tail, F.col("head"))).alias("goes_on"))
    counted = joined.agg(F.sum("n").alias("rows"), (F.sum("runs") - F.count_if("goes_on")).alias("runs"))
    distinct = rows.select("k").distinct().agg(F.count(F.lit(1)).alias("distinct_keys"))
    return counted.crossJoin(distinct).select("rows", "distinct_keys", "runs", (F.col("runs") == F.col("distinct_keys")).alias("contiguous"))


def upsert(state: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """The state with the changed rows in place of those of the same key."""
    return state.join(changes, key, "left_anti").unionByName(changes)
