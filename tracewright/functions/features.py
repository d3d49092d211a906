"""Column expressions over count columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def total(columns: list[str]) -> Column:
    out = F.lit(0).cast("long")
    for c in columns:
        out = out + F.coalesce(F.col(c), F.lit(0))
    return out


def shares(columns: list[str], digits: int | None = None) -> list[Column]:
    """Each count's share of the row's total, 0 where that is 0."""
    whole = total(columns)
    out = [F.when(whole > 0, F.coalesce(F.col(c), F.lit(0)) / whole).otherwise(F.lit(0.0)) for c in columns]
    return [(F.round(x, digits) if digits is not None else x).alias(c) for x, c in zip(out, columns)]


def log_counts(columns: list[str]) -> list[Column]:
    return [F.log1p(F.coalesce(F.col(c), F.lit(0)).cast("double")).alias(c) for c in columns]


def featurize(df: DataFrame, columns: list[str], kind: str, length: str = "windows") -> DataFrame:
    """The frame with its counts turned into features: profile (shares and log length), log_counts or window (shares)."""
    kept = [c for c in df.columns if c not in columns]
    if kind == "log_counts":
        return df.select(*kept, *log_counts(columns))
    features = shares(columns)
    return df.select(*kept, *features, *([F.log1p(F.col(length).cast("double")).alias("log_length")] if kind == "profile" else []))


def signatures(columns: list[str]) -> dict[str, Column]:
    """Hashes of a count vector: as it is, as whole-percent shares, as presence.

    Percents are rounded half up in whole numbers, so no engine's rounding of doubles matters; a total
    of 0 divides by 1. The row's total stands in a column ``_whole``.
    """
    count = {c: F.coalesce(F.col(c), F.lit(0)).cast("long") for c in columns}
    percent = [F.expr(f"(200 * coalesce(cast(`{c}` as bigint), 0) + _whole) div (2 * _whole)") for c in columns]
    return {
        "exact": F.md5(F.concat_ws(",", *(x.cast("string") for x in count.values()))),
        "profile": F.md5(F.concat_ws(",", *(p.cast("string") for p in percent))),
        "presence": F.md5(F.concat_ws("", *(F.when(x > 0, "1").otherwise("0") for x in count.values()))),
    }


def add_signatures(store: DataFrame, columns: list[str]) -> DataFrame:
    """The store with exact, profile and presence signatures."""
    held = store.withColumn("_whole", F.greatest(total(columns).cast("long"), F.lit(1).cast("long")))
    return held.select(*store.columns, *(x.alias(n) for n, x in signatures(columns).items()))


def inert(columns: list[str], max_calls: int, present: list[str], length: str = "windows") -> Column:
    """Short traces without any of the given calls; calls that aren't there don't count."""
    return (F.col(length) < max_calls) & (total([c for c in columns if c in present]) == 0)


def group_key(domain: str, key: str) -> Column:
    return F.concat(F.col(domain), F.lit(":"), F.col(key).cast("string"))
