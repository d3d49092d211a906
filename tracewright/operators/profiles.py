"""Per-entity profiles, duplicate and conflict reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("exact", "profile", "presence")


def profile(rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Rows and summed counts of each entity; partial sums come before the one exchange."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("windows"), *(F.sum(F.col(c).cast("long")).alias(c) for c in columns))


def duplicate_report(signed: DataFrame, domain: str, label: str) -> DataFrame:
    """Entities, distinct signatures of each kind, and the largest exact group, per domain and label.

    Entities are first counted per exact signature, so distinct counts run over groups, not rows. Equal
    counts have equal profile and presence signatures.
    """
    sizes = signed.groupBy(domain, label, "exact").agg(F.count(F.lit(1)).alias("n"), F.min("profile").alias("profile"), F.min("presence").alias("presence"))
    out = sizes.groupBy(domain, label).agg(
        F.sum("n").alias("binaries"),
        F.count(F.lit(1)).alias("unique_exact"),
        F.countDistinct("profile").alias("unique_profile"),
        F.countDistinct("presence").alias("unique_presence"),
        F.max("n").alias("largest_exact"),
    )
    return out.orderBy(domain, F.desc("binaries"), label)


def cross_class_report(signed: DataFrame, domain: str, by: str) -> DataFrame:
    """Signatures of each kind held by more than one class, per domain; zero rows stay."""
    long = signed.select(domain, by, *KINDS).unpivot([domain, by], list(KINDS), "kind", "signature")
    sides = long.groupBy(domain, "kind", "signature").agg((F.min(by) != F.max(by)).alias("mixed"))
    return sides.groupBy(domain, "kind").agg(F.count(F.lit(1)).alias("signatures"), F.count_if("mixed").alias("shared")).orderBy(domain, "kind")


def shared_across(stores: dict[int, DataFrame], domain: str, target: str, values: list[str]) -> DataFrame:
    """Distinct exact signatures per prefix, domain and side, and those on both sides; absent sides are 0."""
    parts = []
    for prefix, signed in sorted(stores.items()):
        sides = signed.groupBy(domain, "exact").agg(*(F.max((F.col(target) == v).cast("int")).alias(v) for v in values))
        both = reduce(lambda a, b: a & b, (F.col(v) == 1 for v in values))
        parts.append(sides.groupBy(domain).agg(*(F.sum(v).cast("long").alias(v) for v in values), F.count_if(both).alias("shared")).select(F.lit(prefix).alias("prefix"), "*"))
    return reduce(DataFrame.unionByName, parts)


def per_label(rows: DataFrame, label: str, key: str) -> DataFrame:
    """Rows and distinct entities of each label, most rows first."""
    pairs = rows.groupBy(label, key).agg(F.count(F.lit(1)).alias("n"))
    return pairs.groupBy(label).agg(F.sum("n").alias("rows"), F.count(F.col(key)).alias("entities")).orderBy(F.desc("rows"), label)


def unknown_rows(rows: DataFrame, label: str, name: str = "unknown") -> DataFrame:
    return rows.agg(F.count_if(F.lower(F.coalesce(label, F.lit(""))) == name).alias("unknown_rows"))


def rows_per_entity(rows: DataFrame, key: str) -> DataFrame:
    """Distinct entities, and the least, median and most rows of one."""
    sizes = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.count(F.lit(1)).alias("entities"), F.min("n").alias("least"), F.percentile("n", 0.5).alias("median"), F.max("n").alias("most"))


def mean_filled(df: DataFrame, columns: list[str]) -> DataFrame:
    """Nulls replaced by the column's mean over the table; a contrast to counting them as 0."""
    means = df.agg(*(F.avg(c).alias(f"_mean_{c}") for c in columns))
    filled = {c: F.coalesce(F.col(c), F.col(f"_mean_{c}")).alias(c) for c in columns}
    return df.crossJoin(F.broadcast(means)).select(*(filled.get(c, F.col(c)) for c in df.columns))
