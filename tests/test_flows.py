"""Flows over small stores, the command line, files of settings, and layouts."""

import json
import shutil
from pathlib import Path

import pytest
from helpers import rows
from pyspark.sql import functions as F

from tracewright.__main__ import main, parser
from tracewright.config import ModelConfig, PrefixConfig, SampleConfig, SplitConfig
from tracewright.functions.names import NameRules
from tracewright.operators import folds, model, report, sampling, split, verify
from tracewright.plans import flows
from tracewright.sources import tables

TINY = ModelConfig(rounds=2, depth=2, patience=1)


@pytest.fixture(scope="module")
def raw(spark, tmp_path_factory):
    """Raw stores of two domains: entities with a signal in their calls, a name in two spellings."""
    folder = tmp_path_factory.mktemp("raw")
    for arch in ("arm", "x86"):
        data = [(f"{arch}{i}", "Benign" if i % 2 else "Mirai", arch, i % 2 + k % 2, i % 5, k, 1.0 if k else 0.5) for i in range(60) for k in range(4)]
        df = spark.createDataFrame(data, "Hash string, MalwareFamily string, Arch string, Call_open int, Call_openat int, Call_read int, fill double")
        df.coalesce(1).sortWithinPartitions("Hash").write.option("parquet.block.size", 2048).parquet(str(folder / f"{arch}_strace.parquet"))
    return str(folder)


def positioned(spark, raw):
    from tracewright.operators.positions import with_position

    df = tables.load_store(spark, raw).select(F.col("Hash").alias("hash"), F.col("MalwareFamily").alias("family"), F.col("Arch").alias("arch"), F.col("Call_open").alias("open"), F.col("Call_read").alias("read"))
    return with_position(df, "hash", ["read"])


def test_best_round():
    assert model.best_round([3, 2, 1, 1.5, 1.2, 0.5], 2) == (3, True)
    assert model.best_round([3, 2, 1, 1.5], 2) == (3, False)
    assert model.best_round([1.0], 5) == (1, False)


def test_rounds_double_until_enough_were_seen(spark, monkeypatch):
    monkeypatch.setattr(model, "FEW_ROUNDS", 1)
    data = [(float(i % 2), [float(i % 2), float(i % 7)]) for i in range(80)]
    from pyspark.ml.functions import array_to_vector

    df = spark.createDataFrame(data, "y double, f array<double>").select("y", array_to_vector("f").alias("features"))
    one, n = model.fit(df, df, ModelConfig(rounds=9, depth=2, patience=1))
    whole = model._trees(ModelConfig(rounds=9, depth=2, patience=1), 9).fit(df)
    assert n == model.best_round(whole.evaluateEachIteration(df), 1)[0] == one.getNumTrees


def test_command_line(spark, raw, tmp_path, capsys):
    out = str(tmp_path / "out")
    (tmp_path / "paper.csv").write_text("Architecture,DataType,count\nARM,strace,200\n")
    for arch in ("arm", "x86"):
        (tmp_path / "files" / arch).mkdir(parents=True)
        (part,) = Path(f"{raw}/{arch}_strace.parquet").glob("*.parquet")
        shutil.copy(part, tmp_path / "files" / arch / "strace.parquet")
    main(["manifest", str(tmp_path / "files"), out, "--counts", str(tmp_path / "paper.csv"), "--arch", "arm", "--modality", "strace"])
    assert "| arm | strace | 240 | 200 | +40 |" in (said := capsys.readouterr().out) and "x86" not in said
    main(["columns", raw, out])
    assert {r.column: r.canonical for r in tables.load_vocabulary(spark, f"{out}/vocabulary").collect()} == {"Call_open": "open", "Call_openat": "open", "Call_read": "read"}
    assert rows(tables.load_inventory(spark, f"{out}/inventory")) == [("Call_open", 1, 1), ("Call_openat", 1, 1), ("Call_read", 1, 1)]
    main(["dedup", raw, out])
    main(["splits", f"{out}/signed", out])
    assert {r.arch for r in tables.load_assignment(spark, f"{out}/assignment").collect()} == {"arm", "x86"}
    main(["dedup", raw, f"{out}/one", "--arch", "arm"])
    assert [r.arch for r in spark.read.parquet(f"{out}/one/signed").select("arch").distinct().collect()] == ["arm"]
    positioned(spark, raw).write.parquet(f"{out}/rows")
    main(["prefixes", f"{out}/rows", f"{out}/first"])
    assert spark.read.parquet(f"{out}/first/first5_strace.parquet").count() == 120
    with pytest.raises(SystemExit):
        parser().parse_args(["manifest", raw])


def test_scan_of_a_file(spark, raw):
    path = spark.read.parquet(f"{raw}/arm_strace.parquet").inputFiles()[0]
    got = verify.scan_file(spark, path, "Hash", "MalwareFamily", ["fill"], 2).first().asDict(recursive=True)
    assert got["rows"] == 240 and got["null_columns"] == [] and got["filled_columns"][0]["top_value"] == 0.5
    assert got["classes"]["Benign"]["entities"] == 30
    with pytest.raises(ValueError):
        verify.scan_file(spark, raw, "Hash", "MalwareFamily", [])


def test_folds_prefixes_and_draws(spark, raw, monkeypatch):
    """The flows' folds, labels, draws and checks; fits stand in for themselves elsewhere."""
    def scored(fold, *more):
        return fold.groupBy().agg(F.count("*").alias("test_n"), F.lit(0.5).alias("mcc"), F.lit(0.5).alias("auroc"), F.lit("binary").alias("view"), *(F.lit(x).alias("split") for x in more[:-1]))

    monkeypatch.setattr(model, "score_fold", scored)
    monkeypatch.setattr(model, "score_rows", scored)
    at = positioned(spark, raw)
    signed, _, _ = flows.dedup(tables.load_store(spark, raw))
    signed = signed.persist()
    cfg = SplitConfig(group_by="hash", inert_max_calls=0)
    assignment = flows.splits(signed, cfg)[0].persist()
    results = flows.baselines(signed, assignment, ["open", "read"], TINY, cfg, {5: flows.prefix_stores(at, PrefixConfig())[5]}, PrefixConfig()).persist()
    assert {(r.experiment, r.held_out) for r in results.collect()} == {(f"{p}{e}", a) for p in ("", "first-5 ") for e in ("in-architecture", "leave-one-architecture-out") for a in ("arm", "x86")}
    compared = folds.compare(results, ["first-5"])
    assert compared.count() == 4 and "| whole |" in report.render(compared, "results")
    live = lambda s: split.live_entities(s, assignment, cfg.benign)
    with pytest.raises(ValueError, match="3 are the most"):
        model.run_prefix(signed, live, ["open"], TINY, 3)
    with pytest.raises(ValueError, match="never"):
        model.run_prefix(signed, live, ["open"], TINY, 4, ("never",))
    sample = SampleConfig(units={"all": 1}, cap=2, sensitivity_cap=1, seeds=(0,))
    summary = flows.leakage(at, signed, assignment, ["open", "read"], sample, cfg, TINY)
    assert [(r.arch, r.seeds, r.cap) for r in summary.collect()] == [("arm", 1, 2), ("x86", 1, 2)]
    assert "by behaviour" in report.render(report.leakage_cells(summary), "leakage")


def test_scores_of_drawn_rows(spark):
    data = [(f"h{i}", f"g{i}", 1, i % 2, ("train", "val", "test")[i // 2 % 3], i % 2 == 1, "Mirai", "arm") for i in range(60)]
    drawn = spark.createDataFrame(data, "hash string, group string, position int, open int, side string, is_malware boolean, family string, arch string")
    got = model.score_rows(model.assembled(drawn, ["open"], ModelConfig(rounds=2, depth=2, patience=1, features="window")), "side", TINY).collect()
    assert {r.view: (r.test_n, r.mcc) for r in got} == {v: (20, 1.0) for v in ("window", "binary", "group")}


def test_a_sample_that_lacks_rows(spark, raw):
    at = positioned(spark, raw)
    store = at.groupBy("hash", "family", "arch").agg(F.count("*").alias("windows"))
    plan = sampling.plan_sample(store, SampleConfig(units={"all": 1}, cap=2, sensitivity_cap=1, seeds=(0,)))
    with pytest.raises(ValueError, match="lacks"):
        sampling.check_draw(at.where("position > 1"), plan)


def test_rules_from_a_file(tmp_path):
    (tmp_path / "rules.json").write_text(json.dumps({"aliases": {"open": ["openat", "open64"]}, "fragments": ["op"]}))
    rules = NameRules.load(str(tmp_path / "rules.json"))
    assert rules.canonical_of == {"openat": "open", "open64": "open"} and rules.fragments == {"op"}
    for bad in ({"aliases": {"a": ["x"], "b": ["x"]}}, {"alias": {}}):
        (tmp_path / "rules.json").write_text(json.dumps(bad))
        with pytest.raises(ValueError):
            NameRules.load(str(tmp_path / "rules.json"))
