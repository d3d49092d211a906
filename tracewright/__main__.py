"""Flows from the command line: ``python -m tracewright FLOW INPUT OUTPUT [options]``."""

from __future__ import annotations

import argparse
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import DOMAIN, KEY, LABEL, ModelConfig, PrefixConfig, SampleConfig, SplitConfig, load
from .functions.names import NameRules, inventory, resolution
from .operators import folds, report, verify
from .plans import flows
from .sources import tables

_FIXED = {KEY, LABEL, DOMAIN, "windows", "position", "exact", "profile"}


def _settings(kind: type, path: str | None):
    return load(kind, path) if path else kind()


def _said(df: DataFrame, layout: str, out: str) -> None:
    """A small result as markdown beside its table, where the output is a local folder."""
    text = report.render(df, layout)
    if "://" not in out:
        Path(out).mkdir(parents=True, exist_ok=True)
        (Path(out) / f"{layout}.md").write_text(text)
    print(text)


def _counts(store: DataFrame) -> list[str]:
    return [c for c, t in store.dtypes if c not in _FIXED and t in ("smallint", "int", "bigint", "double")]


def _chosen(df: DataFrame, args: argparse.Namespace, column: str = DOMAIN) -> DataFrame:
    return df.where(F.col(column).isin(args.arch)) if args.arch else df


def manifest(spark: SparkSession, args: argparse.Namespace) -> None:
    """Parquet files below INPUT, and their rows against published counts (--counts)."""
    files = tables.manifest(spark, args.input)
    files = files.where(F.col("modality").isin(args.modality)) if args.modality else files
    files = _chosen(files, args)
    tables.save_csv(files, f"{args.output}/manifest")
    _said(files, "manifest", args.output)
    if args.counts:
        _said(tables.compare_counts(files, tables.paper_totals(tables.load_paper_counts(spark, args.counts))), "counts", args.output)


def columns(spark: SparkSession, args: argparse.Namespace) -> None:
    """Inventory of count columns over the stores in INPUT, and what each name becomes."""
    found = {}
    for domain, path in zip(tables.DOMAINS, tables.store_paths(args.input, args.stem)):
        if not args.arch or domain in args.arch:
            found |= {domain: spark.read.parquet(path).columns} if tables._is_there(spark, path) else {}
    listed = inventory(spark, found)
    tables.save_csv(listed, f"{args.output}/inventory")
    tables.save_csv(resolution(listed, NameRules.load(args.rules) if args.rules else NameRules.default()), f"{args.output}/vocabulary")


def scan(spark: SparkSession, args: argparse.Namespace) -> None:
    """Facts on one file, INPUT."""
    counts = [c for c, t in spark.read.parquet(args.input).dtypes if t in ("float", "double")]
    tables.save_json(verify.scan_file(spark, args.input, args.key, args.label, counts, args.groups), f"{args.output}/scan")


def dedup(spark: SparkSession, args: argparse.Namespace) -> None:
    """Signed profiles and duplicate reports of the raw stores in INPUT."""
    raw = tables.load_store(spark, args.input, args.stem)
    signed, duplicates, across = flows.dedup(_chosen(raw, args, "Arch"), NameRules.load(args.rules) if args.rules else None)
    tables.save_store(signed, f"{args.output}/signed")
    for df, layout in ((duplicates, "duplicates"), (across, "cross-class")):
        tables.save_csv(df, f"{args.output}/{layout}")
        _said(df, layout, args.output)


def splits(spark: SparkSession, args: argparse.Namespace) -> None:
    """Assignment of the signed store INPUT to sides."""
    assignment, summary = flows.splits(_chosen(spark.read.parquet(args.input), args), _settings(SplitConfig, args.config))
    tables.save_assignment(assignment, f"{args.output}/assignment")
    _said(summary, "splits", args.output)


def prefixes(spark: SparkSession, args: argparse.Namespace) -> None:
    """First-N stores of the positioned rows INPUT."""
    rows = _chosen(spark.read.parquet(args.input), args)
    for n, store in flows.prefix_stores(rows, _settings(PrefixConfig, args.config)).items():
        tables.save_store(store, f"{args.output}/{tables.prefix_stem(n)}.parquet")


def baselines(spark: SparkSession, args: argparse.Namespace) -> None:
    """Scores of all folds over the store INPUT and an assignment (--assignment); first-N stores are looked for in --prefixes."""
    store, settings = _chosen(spark.read.parquet(args.input), args), _settings(PrefixConfig, None)
    first = {n: spark.read.parquet(p) for n in settings.prefixes if args.prefixes and tables._is_there(spark, p := f"{args.prefixes}/{tables.prefix_stem(n)}.parquet")}
    results = flows.baselines(store, tables.load_assignment(spark, args.assignment), _counts(store), _settings(ModelConfig, args.config), SplitConfig(), first, settings).persist()
    tables.save_results(results, f"{args.output}/results")
    _said(results, "results", args.output)
    if first:
        _said(folds.compare(results, [f"first-{n}" for n in first]), "results", f"{args.output}/compared")


def leakage(spark: SparkSession, args: argparse.Namespace) -> None:
    """Row draws of the positioned rows INPUT, split three ways, with a store (--store) and an assignment (--assignment)."""
    store = _chosen(spark.read.parquet(args.store), args)
    assignment = tables.load_assignment(spark, args.assignment)
    summary = flows.leakage(spark.read.parquet(args.input), store, assignment, _counts(store), _settings(SampleConfig, args.config), SplitConfig(), ModelConfig()).persist()
    tables.save_csv(summary, f"{args.output}/leakage")
    _said(report.leakage_cells(summary), "leakage", args.output)


FLOWS = {f.__name__: f for f in (manifest, columns, scan, dedup, splits, prefixes, baselines, leakage)}


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="tracewright", description=__doc__)
    flows_ = out.add_subparsers(dest="flow", required=True)
    for name, flow in FLOWS.items():
        one = flows_.add_parser(name, help=flow.__doc__)
        one.add_argument("input")
        one.add_argument("output")
        one.add_argument("--arch", action="append", choices=tables.DOMAINS, help="only these domains")
        one.add_argument("--modality", action="append", choices=tables.MODALITIES, help="only these kinds of files")
        for option in ("config", "rules", "counts", "assignment", "prefixes", "store"):
            one.add_argument(f"--{option}")
        one.add_argument("--stem", default="strace")
        one.add_argument("--key", default="Hash")
        one.add_argument("--label", default="MalwareFamily")
        one.add_argument("--groups", type=int, default=3, help="row groups looked at for fills")
    return out


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    FLOWS[args.flow](SparkSession.builder.appName("tracewright").getOrCreate(), args)


if __name__ == "__main__":
    main()
