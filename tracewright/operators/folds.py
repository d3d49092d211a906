"""Folds: within each domain, and leaving one domain out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DOMAIN

#: Leaving one out makes a copy of the entities for each domain; more than these are refused.
MOST_DOMAINS = 1000


def in_domain(live: DataFrame) -> DataFrame:
    """Each domain by itself; the role is the split."""
    return live.select("*", F.lit("in-architecture").alias("experiment"), F.col(DOMAIN).alias("held_out"), F.col("split").alias("role"))


def leave_one_out(live: DataFrame) -> DataFrame:
    """For each domain: all its entities as test, train and val from the others."""
    found = [r[0] for r in live.select(DOMAIN).distinct().limit(MOST_DOMAINS + 1).collect()]
    if len(found) > MOST_DOMAINS:
        raise ValueError(f"more than {MOST_DOMAINS} domains: each is a fold over all entities")
    held = live.sparkSession.createDataFrame([(x,) for x in sorted(x for x in found if x is not None)], "held_out string")
    role = F.when(F.col(DOMAIN) == F.col("held_out"), "test").when(F.col("split").isin("train", "val"), F.col("split"))
    out = live.crossJoin(F.broadcast(held)).withColumn("role", role).where("role is not null")
    return out.select(*live.columns, F.lit("leave-one-architecture-out").alias("experiment"), "held_out", "role")


def compare(results: DataFrame, labels: list[str], metric: str = "mcc") -> DataFrame:
    """A metric of all runs of a fold in one row: the unlabelled run as ``whole``, then a column per label.

    One aggregation over fold and view. A fold that some run lacks gives no row; one that runs score over
    different numbers of entities raises.
    """
    run, base = F.lit("whole"), F.col("experiment")
    for label in labels:
        mine = F.startswith(F.col("experiment"), F.lit(f"{label} "))
        run = F.when(mine, F.lit(label)).otherwise(run)
        base = F.when(mine, F.substr("experiment", F.lit(len(label) + 2))).otherwise(base)
    sides = ["whole", *labels]
    folds = results.withColumns({"_run": run, "experiment": base}).groupBy("experiment", "held_out", "view")
    wide = folds.agg(
        F.count_distinct("_run").alias("_runs"),
        F.min("test_n").alias("_least"),
        F.max("test_n").alias("_most"),
        *(F.max(F.when(F.col("_run") == side, F.col(metric))).alias(side) for side in sides),
    )
    whole = F.when(F.col("_least") == F.col("_most"), F.col("_most")).otherwise(F.raise_error(F.lit("runs of one fold score different entities")).cast("long"))
    return wide.where(F.col("_runs") == len(sides)).select("experiment", "held_out", "view", whole.alias("test_n"), *sides)


def summarize(results: DataFrame, kinds: tuple[str, ...] = ("row_random", "hash_grouped", "behaviour_grouped")) -> DataFrame:
    """Means and ranges over seeds per split kind, and the gaps between kinds."""
    keys = ["unit", "cap", "arch", "view"]
    of = lambda c, k: F.when(F.col("split") == k, F.col(c))
    parts = []
    for k in kinds:
        parts += [F.avg(of("mcc", k)).alias(f"mcc_{k}"), F.min(of("mcc", k)).alias(f"mcc_min_{k}"), F.max(of("mcc", k)).alias(f"mcc_max_{k}"), F.avg(of("auroc", k)).alias(f"auroc_{k}"), F.count_if(F.col("split") == k).alias(f"_n_{k}")]
    out = results.groupBy(*keys).agg(*parts)
    counts = [F.when(F.col(f"_n_{k}") > 0, F.col(f"_n_{k}")) for k in kinds]
    out = out.withColumn("seeds", F.least(*counts)).withColumn("row_gap", F.col(f"mcc_{kinds[0]}") - F.col(f"mcc_{kinds[1]}")).withColumn("identity_gap", F.col(f"mcc_{kinds[1]}") - F.col(f"mcc_{kinds[2]}"))
    return out.drop(*(f"_n_{k}" for k in kinds)).orderBy(F.desc("unit"), F.desc("cap"), "view", "arch")
