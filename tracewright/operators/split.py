"""Entities dealt to train, val and test in whole behaviour groups."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DOMAIN, KEY, LABEL, SPLITS, SplitConfig
from ..functions.features import group_key, inert

INERT, CONFLICT = "inert", "conflict"


def marked(signed: DataFrame, cfg: SplitConfig) -> DataFrame:
    """Rows of kept labels with inert and group."""
    kept = signed.where(~F.col(LABEL).isin(list(cfg.drop_labels)))
    flag = inert(list(cfg.inert_columns), cfg.inert_max_calls, signed.columns)
    key = KEY if cfg.group_by == "hash" else cfg.group_by
    return kept.withColumn(INERT, flag).withColumn("group", group_key(DOMAIN, key))


def group_facts(rows: DataFrame, benign: str) -> DataFrame:
    """Of each group: conflict (live rows on both sides), the label it is dealt as, and its live rows.

    The label is the most frequent one, the alphabetically first of equals. Rows are pre-aggregated per
    group and label; one more exchange by group gives all three.
    """
    counts = rows.groupBy("group", DOMAIN, LABEL).agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col(INERT)).alias("live"))
    side = F.when(F.col("live") > 0, F.col(LABEL) == benign)
    return counts.groupBy("group", DOMAIN).agg(
        F.coalesce(F.min(side) != F.max(side), F.lit(False)).alias(CONFLICT),
        F.min_by(LABEL, F.struct(-F.col("n"), F.col(LABEL))).alias("deal_as"),
        F.sum("live").alias("live"),
    )


def order_key(seed: int, group: str = "group"):
    """The place of a group in the deal of its stratum: stable, and independent of other strata."""
    return F.md5(F.concat_ws("/", F.lit(str(seed)), DOMAIN, "deal_as", group))


def deal(groups: DataFrame, cfg: SplitConfig) -> DataFrame:
    """group and split for groups (arch, deal_as, group, n): each goes where least of the target share is filled.

    The deal is sequential within a stratum, so a stratum's groups stream through one task in order,
    with three numbers of state; strata run in parallel.
    """
    over = Window.partitionBy(DOMAIN, "deal_as")
    sized = groups.select(DOMAIN, "deal_as", "group", F.col("n").cast("long").alias("n"), F.sum("n").over(over).cast("long").alias("total"), order_key(cfg.seed).alias("place"))
    ordered = sized.repartition(DOMAIN, "deal_as").sortWithinPartitions(DOMAIN, "deal_as", "place", "group")
    fractions = [cfg.fractions[s] for s in SPLITS]

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stratum, got = None, [0, 0, 0]
        for batch in batches:
            names, where = batch.column(2), []
            for arch, label, n, total in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3, 4))):
                if (arch, label) != stratum:
                    stratum, got = (arch, label), [0, 0, 0]
                filled = [g / (f * total) if f > 0 else float("inf") for g, f in zip(got, fractions)]
                chosen = filled.index(min(filled))
                got[chosen] += n
                where.append(SPLITS[chosen])
            yield pa.RecordBatch.from_arrays([names, pa.array(where, pa.string())], names=["group", "split"])

    return ordered.mapInArrow(pick, "group string, split string")


def assign(signed: DataFrame, cfg: SplitConfig) -> DataFrame:
    """hash, family, arch, group, inert, split: inert before conflict before the deal."""
    rows = marked(signed, cfg)
    facts = group_facts(rows, cfg.benign)
    dealt = deal(facts.where((F.col("live") > 0) & ~F.col(CONFLICT)).select(DOMAIN, "deal_as", "group", F.col("live").alias("n")), cfg)
    known = facts.select("group", CONFLICT).join(dealt, "group", "left")
    split = F.when(F.col(INERT), INERT).when(F.col(CONFLICT), CONFLICT).otherwise(F.col("split"))
    return rows.join(known, "group").select(KEY, LABEL, DOMAIN, "group", INERT, split.alias("split"))


def split_summary(assignment: DataFrame) -> DataFrame:
    """Entities, inert, conflict, groups and entities per split, by domain and label, in one pass."""
    live = F.col("split").isin(*SPLITS)
    return assignment.groupBy(DOMAIN, LABEL).agg(
        F.count(F.lit(1)).alias("binaries"),
        F.count_if(INERT).alias("inert"),
        F.count_if(F.col("split") == CONFLICT).alias("conflict"),
        F.countDistinct(F.when(live, F.col("group"))).alias("groups"),
        *(F.count_if(F.col("split") == s).alias(s) for s in SPLITS),
    ).orderBy(DOMAIN, F.desc("binaries"), LABEL)


def leaks(assignment: DataFrame) -> DataFrame:
    """Groups and entities that stand in more than one of train, val and test; none if all is well."""
    live = assignment.where(F.col("split").isin(*SPLITS)).select(DOMAIN, "split", "group", KEY)
    long = live.unpivot([DOMAIN, "split"], ["group", KEY], "what", "value")
    return long.groupBy(DOMAIN, "what", "value").agg(F.countDistinct("split").alias("n")).where("n > 1")


def check(assignment: DataFrame) -> None:
    found = {r.what: r["count"] for r in leaks(assignment).groupBy("what").count().collect()}
    if found:
        raise AssertionError(f"split over several sides: {', '.join(f'{found[what]} by {what}' for what in sorted(found))}")


def live_entities(store: DataFrame, assignment: DataFrame, benign: str) -> DataFrame:
    """The store's dealt entities, with group, split and is_malware."""
    dealt = assignment.where(F.col("split").isin(*SPLITS)).select(KEY, DOMAIN, "group", "split")
    return store.join(dealt, [KEY, DOMAIN]).withColumn("is_malware", F.col(LABEL) != benign)
