"""The flows of the analysis: profiles and duplicates, splits, folds, prefixes and row draws."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DOMAIN, KEY, LABEL, ModelConfig, PrefixConfig, SampleConfig, SplitConfig
from ..functions.features import add_signatures
from ..functions.names import NameRules, canonicalize, vocabulary
from ..operators import folds, model, positions, profiles, sampling, split


def dedup(raw: DataFrame, rules: NameRules | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Raw rows to (signed store, duplicate report, cross-class report)."""
    rules = rules or NameRules.default()
    words = vocabulary(rules, [c for c in raw.columns if c.startswith("Call_")])
    rows = canonicalize(raw, rules, words).withColumnsRenamed({"Hash": KEY, "MalwareFamily": LABEL, "Arch": DOMAIN})
    signed = add_signatures(profiles.profile(rows, [KEY, LABEL, DOMAIN], words), words)
    return signed, profiles.duplicate_report(signed, DOMAIN, LABEL), profiles.cross_class_report(signed, DOMAIN, LABEL)


def splits(signed: DataFrame, cfg: SplitConfig) -> tuple[DataFrame, DataFrame]:
    """(assignment, summary); raises if an entity or group is on two sides."""
    assignment = split.assign(signed, cfg)
    split.check(assignment)
    return assignment, split.split_summary(assignment)


def baselines(store: DataFrame, assignment: DataFrame, columns: list[str], cfg: ModelConfig, split_cfg: SplitConfig, prefix_stores: dict[int, DataFrame] | None = None, prefixes: PrefixConfig | None = None) -> DataFrame:
    """All folds on the whole store, then on each first-N store, and once more without the ablated columns."""
    live = lambda s: split.live_entities(s, assignment, split_cfg.benign)
    out = [model.run(live(store), columns, cfg)]
    prefixes = prefixes or PrefixConfig()
    for n, first in sorted((prefix_stores or {}).items()):
        out.append(model.run_prefix(first, live, columns, cfg, n))
        dropped = tuple(c for c in prefixes.dropped_columns if c in columns)
        if n == prefixes.ablation_prefix and dropped:
            out.append(model.run_prefix(first, live, columns, cfg, n, dropped, f"first-{n}-ablated"))
    return reduce(DataFrame.unionByName, out)


def prefix_stores(rows: DataFrame, cfg: PrefixConfig) -> dict[int, DataFrame]:
    """A store per prefix, all from one pass over positioned rows."""
    first = positions.first_rows(rows, KEY, list(cfg.prefixes))
    return {n: first.where(F.col("prefix") == n).drop("prefix", "position") for n in cfg.prefixes}


def leakage(rows: DataFrame, store: DataFrame, behaviour: DataFrame, columns: list[str], cfg: SampleConfig, split_cfg: SplitConfig, model_cfg: ModelConfig) -> DataFrame:
    """Draws split three ways, scored on window features (a drawn row has no trace length), and summarised over seeds."""
    model_cfg = replace(model_cfg, features="window")
    by_hash = split.assign(store, SplitConfig(**{**split_cfg.__dict__, "group_by": "hash"}))
    plan = sampling.plan_sample(store, cfg)
    sample = sampling.sample_rows(rows, plan)
    sampling.check_draw(sample, plan)
    out = None
    for unit in cfg.units:
        for seed in cfg.seeds:
            drawn = sampling.three_way(sampling.draw(sample, plan, unit, seed, cfg.cap), behaviour, by_hash, seed, split_cfg.fractions)
            sampling.check_sides(drawn)
            labelled = model.assembled(drawn.withColumn("is_malware", F.col(LABEL) != split_cfg.benign), columns, model_cfg)
            for arch in sorted(r[0] for r in labelled.select(DOMAIN).distinct().collect()):  # a row per domain
                for kind in ("row_random", "hash_grouped", "behaviour_grouped"):
                    part = model.score_rows(labelled.where(F.col(DOMAIN) == arch), kind, model_cfg)
                    part = part.select(F.lit(unit).alias("unit"), F.lit(cfg.cap).alias("cap"), F.lit(seed).alias("seed"), F.lit(arch).alias("arch"), "*")
                    out = part if out is None else out.unionByName(part)
    return folds.summarize(out)
