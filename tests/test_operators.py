"""Contracts of the operators on small tables."""

import itertools
import random

import numpy as np
import pytest
from helpers import rows
from pyspark.sql import functions as F

from tracewright.config import ModelConfig, PrefixConfig, SampleConfig, SplitConfig
from tracewright.functions.features import add_signatures, featurize
from tracewright.functions.names import NameRules, canonicalize, resolution, resolve, vocabulary
from tracewright.operators import folds, metrics, model, positions, profiles, report, sampling, split, verify
from tracewright.sources import tables


def test_configs_reject_nonsense():
    for bad in ({"fractions": {"train": 0.5, "val": 0.1, "test": 0.2}}, {"fractions": {"train": 1.0}}, {"group_by": "label"}):
        with pytest.raises(ValueError):
            SplitConfig(**bad)
    for bad in ({"units": {}}, {"units": {"a": 0}}, {"cap": 5, "sensitivity_cap": 6}, {"seeds": ()}):
        with pytest.raises(ValueError):
            SampleConfig(**bad)
    for bad in ({"prefixes": ()}, {"prefixes": (5, 5)}, {"ablation_prefix": 7}):
        with pytest.raises(ValueError):
            PrefixConfig(**bad)
    with pytest.raises(ValueError):
        ModelConfig(features="raw")


def test_canonicalize(spark):
    raw = spark.createDataFrame(
        [("h1", "Benign", "arm", 1, 3.0, 3, None, 5), ("h2", "Mirai", "arm", 0, 3.0, 0, 0, 0)],
        "Hash string, MalwareFamily string, Arch string, Call_mmap2 byte, Call_mmap double, Call_readlin short, Call_wri int, Call_syscall_0x193 int",
    )
    rules = NameRules.default()
    words = ["clock_gettime", "mmap", "readlink", "write", "writev"]
    out = canonicalize(raw, rules, words)
    assert out.columns == ["Hash", "MalwareFamily", "Arch", *words]
    assert {t for c, t in out.dtypes if c in words} == {"smallint"}
    assert rows(out.select(*words)) == [(0, 3, 0, 0, 0), (5, 4, 3, 0, 0)]
    assert resolve(rules, "Call_wri", words) is None and resolve(rules, "Call_readlin", words) == "readlink"


def test_resolution_matches_schema_rule(spark):
    names = ["Call_mmap2", "Call_read", "Call_readlink", "Call_readlin", "Call_re", "Call_socket", "Call_socke", "Call_tim", "Call_open"]
    rules = NameRules.default()
    words = vocabulary(rules, names)
    got = {r.column: r.canonical for r in resolution(spark.createDataFrame([(n,) for n in names], "column string"), rules).collect()}
    assert got == {n: resolve(rules, n, words) for n in names}


@pytest.mark.parametrize("parts", [1, 3, 7])
def test_positions_and_prefixes_dont_depend_on_partitions(spark, parts):
    data = [(k, i, i + 1) for k, n in (("a", 25), ("b", 3), ("c", 22)) for i in range(n)]
    random.Random(parts).shuffle(data)
    df = spark.createDataFrame(data, "hash string, o int, want long").repartition(parts)
    placed = positions.with_position(df, "hash", ["o"])
    assert placed.where("position != want").count() == 0
    first = positions.first_rows(placed, "hash", [5, 20])
    assert rows(first.select("prefix", "hash", "windows")) == sorted([(5, "a", 5), (5, "b", 3), (5, "c", 5), (20, "a", 20), (20, "b", 3), (20, "c", 20)], key=repr)


def test_file_order(spark, tmp_path):
    spark.range(5000).select(F.col("id"), (F.col("id") % 3).cast("string").alias("hash")).repartition(1).sortWithinPartitions("id").write.option("parquet.block.size", 4096).parquet(str(tmp_path / "t"))
    placed = positions.with_position(spark.read.parquet(str(tmp_path / "t")), "hash", positions.file_order())
    assert placed.where(F.col("position") != F.floor(F.col("id") / 3) + 1).count() == 0


@pytest.mark.parametrize("chunk", [2, 3, 5, 100])
def test_runs(spark, chunk):
    for keys, want in ((list("aaaabbbccccc"), (12, 3, 3, True)), (list("aabbaabb"), (8, 2, 4, False)), ([None, None, "a"], (3, 2, 2, True))):
        df = spark.createDataFrame(list(enumerate(keys)), "o long, k string")
        assert tuple(positions.runs(df, "k", "o", chunk).first()) == want


def test_verify_report(spark):
    data = [(i, k, "Unknown" if k == "c" else "Mirai", 0.37 if i in (2, 5, 9) else float(i)) for i, k in enumerate("aaaabbbccccc")]
    df = spark.createDataFrame(data, "o long, k string, label string, x double")
    got = verify.report(df, "k", "label", "o", ["x"]).first()
    assert (got.runs, got.entities, got.least, got.median, got.most, got.unknown_rows, got.contiguous) == (3, 3, 3, 4.0, 5, 5, True)
    fill = got.filled_columns[0]
    assert (fill.column, fill.rows_sampled, fill.non_integer_rows, fill.distinct_non_integer, fill.top_value, fill.top_value_rows) == ("x", 12, 3, 1, 0.37, 3)
    assert rows(verify.null_columns(spark.createDataFrame([(1, None), (2, 3)], "a int, b int"))) == [("b", 1)]


STORE = "hash string, family string, arch string, windows long, a long, b long, c long"


def test_signatures_and_reports(spark):
    data = [("1", "Benign", "x", 4, 2, 2, 0), ("2", "Mirai", "x", 4, 2, 2, 0), ("3", "Mirai", "x", 8, 4, 4, 0), ("4", "Mirai", "x", 4, 3, 0, 1), ("5", "Mirai", "y", 1, 0, 0, 0)]
    signed = add_signatures(spark.createDataFrame(data, STORE), ["a", "b", "c"])
    s = {r.hash: r for r in signed.collect()}
    assert s["1"].exact == s["2"].exact != s["3"].exact and s["2"].profile == s["3"].profile and s["3"].presence != s["4"].presence
    assert rows(profiles.duplicate_report(signed, "arch", "family")) == [("x", "Benign", 1, 1, 1, 1, 1), ("x", "Mirai", 3, 3, 2, 2, 1), ("y", "Mirai", 1, 1, 1, 1, 1)]
    assert ("y", "exact", 1, 0) in rows(profiles.cross_class_report(signed, "arch", "family"))
    assert ("x", "exact", 3, 1) in rows(profiles.cross_class_report(signed, "arch", "family"))


def _store(spark):
    data = [(f"b{i}", "Benign", "arm", 100 + i, i, 1, 0) for i in range(100)] + [(f"m{i}", "Mirai", "arm", 500 + i, i, 2, 0) for i in range(100)]
    data += [("i1", "Mirai", "arm", 10, 900, 0, 0), ("x1", "Benign", "arm", 99, 901, 1, 1), ("x2", "Mirai", "arm", 99, 901, 1, 1), ("u", "Unknown", "arm", 99, 902, 1, 1)]
    data += [(f"s{i}", "Generic" if i == 0 else "Mirai", "arm", 99, 903, 1, 1) for i in range(5)]
    return add_signatures(spark.createDataFrame(data, STORE), ["a", "b", "c"])


CFG = SplitConfig(inert_columns=("b", "nothing"))


def test_assign(spark):
    got = split.assign(_store(spark), CFG)
    split.check(got)
    by = {r.hash: r for r in got.collect()}
    assert "u" not in by and by["i1"].split == "inert" and by["x1"].split == by["x2"].split == "conflict"
    assert len({by[f"s{i}"].split for i in range(5)}) == 1
    singles = [by[f"b{i}"].split for i in range(100)]
    assert [singles.count(s) for s in ("train", "val", "test")] == [70, 10, 20]
    again = {r.hash: r.split for r in split.assign(_store(spark).repartition(7), CFG).collect()}
    assert again == {k: r.split for k, r in by.items()}
    without = {r.hash: r.split for r in split.assign(_store(spark).where("family != 'Benign' or hash like 'x%'"), CFG).collect()}
    assert all(without[f"m{i}"] == by[f"m{i}"].split for i in range(100))  # families deal independently
    assert sum(r.binaries for r in split.split_summary(got).collect()) == len(by)


def test_check_raises(spark):
    bad = spark.createDataFrame([("a", "F", "x", "x:1", False, "train"), ("b", "F", "x", "x:1", False, "test")], "hash string, family string, arch string, group string, inert boolean, split string")
    with pytest.raises(AssertionError):
        split.check(bad)


def test_samples_are_nested_and_complete(spark):
    entities = spark.createDataFrame([("a", "x", 5), ("b", "x", 25), ("c", "x", 150)], "hash string, arch string, windows long")
    cfg = SampleConfig(cap=8, sensitivity_cap=4, seeds=(0, 1))
    plan = sampling.plan_sample(entities, cfg).cache()
    counts = {(r.hash, r.unit): r["count"] for r in plan.where("seed = 0").groupBy("hash", "unit").count().collect()}
    assert counts == {("a", "all"): 5, ("b", "mid"): 5, ("b", "all"): 8, ("c", "mid"): 8, ("c", "all"): 8}
    assert plan.where("unit = 'mid' and position < 21").count() == 0
    small = rows(sampling.plan_sample(entities, SampleConfig(cap=4, sensitivity_cap=4, seeds=(0, 1))))
    assert small == rows(plan.where("rank <= 4"))
    with pytest.raises(ValueError):
        sampling.check_draw(plan.where("position > 30"), plan)


def test_folds(spark):
    live = spark.createDataFrame([(f"{a}{s}", a, s) for a in "xy" for s in ("train", "val", "test")], "hash string, arch string, split string")
    got = {(r.hash, r.held_out): r.role for r in folds.leave_one_out(live).collect()}
    assert got == {**{(f"{a}{s}", a): "test" for a in "xy" for s in ("train", "val", "test")}, **{(f"{a}{s}", b): s for a, b in ("xy", "yx") for s in ("train", "val")}}
    assert folds.in_domain(live).where("role != split or held_out != arch").count() == 0


def test_compare_raises_on_other_entities(spark):
    schema = "experiment string, held_out string, view string, test_n long, mcc double"
    ok = spark.createDataFrame([("e", "x", "binary", 5, 0.5), ("first-5 e", "x", "binary", 5, 0.4)], schema)
    assert rows(folds.compare(ok, ["first-5"])) == [("e", "x", "binary", 5, 0.5, 0.4)]
    bad = spark.createDataFrame([("e", "x", "binary", 5, 0.5), ("first-5 e", "x", "binary", 6, 0.4)], schema)
    with pytest.raises(Exception, match="different entities"):
        folds.compare(bad, ["first-5"]).collect()


def _mcc(y, p):
    tp, fp, fn, tn = (float(((y == a) & (p == b)).sum()) for a, b in ((1, 1), (0, 1), (1, 0), (0, 0)))
    under = np.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    return (tp * tn - fp * fn) / under if under else 0.0


def test_threshold_and_auroc_against_brute_force(spark):
    rng = np.random.default_rng(1)
    data, want = [], {}
    for k in range(12):
        n = int(rng.integers(2, 40))
        y, s = rng.integers(0, 2, n), rng.integers(0, 12, n) / 12
        data += [(k, int(a), float(b)) for a, b in zip(y, s)]
        values = np.unique(s)
        cuts = (values[:-1] + values[1:]) / 2
        if len(set(y)) < 2 or not len(cuts):
            cut, area = 0.5, None
        else:
            q = np.array([_mcc(y, (s > c).astype(int)) for c in cuts])
            best = cuts[np.isclose(q, q.max())]
            cut = best[np.argmin(abs(best - 0.5))]
        area = np.mean([(a > b) + 0.5 * (a == b) for a, b in itertools.product(s[y == 1], s[y == 0])]) if len(set(y)) == 2 else None
        want[k] = (cut, area)
    df = spark.createDataFrame(data, "k int, y int, score double")
    cuts = {r.k: r.threshold for r in metrics.choose_threshold(df, ["k"]).collect()}
    areas = {r.k: r.auroc for r in metrics.auroc(df, ["k"]).collect()}
    for k, (cut, area) in want.items():
        assert cuts[k] == pytest.approx(cut)
        assert areas[k] == (None if area is None else pytest.approx(area))


def test_metrics_on_constant_scores(spark):
    df = spark.createDataFrame([(1, 0.7), (0, 0.7), (0, 0.7)], "y int, score double")
    m = metrics.binary_metrics(df, [], F.lit(0.5)).first()
    assert m.mcc == 0 and m.chance == pytest.approx(2 / 3) and m.macro_f1 == pytest.approx(0.25)
    assert metrics.auroc(df, []).first()[0] == 0.5 and metrics.choose_threshold(df, []).first()[0] == 0.5


def test_model_finds_a_separable_signal(spark):
    data = [(f"{a}{i}", "Mirai" if i % 2 else "Benign", a, 100, 9 * (i % 2) + i % 3, 5, i % 7, f"{a}:{i}", ("train", "train", "train", "val", "test")[i // 2 % 5]) for a in "xy" for i in range(60)]
    live = spark.createDataFrame(data, STORE + ", group string, split string").withColumn("is_malware", F.col("family") != "Benign")
    cfg = ModelConfig(rounds=3, depth=2, patience=2)
    out = model.score_fold(folds.leave_one_out(model.assembled(live, ["a", "b", "c"], cfg)).where("held_out = 'x'"), cfg).collect()
    assert {r.view for r in out} == {"binary", "group"} and all(r.mcc > 0.9 and r.test_n == 60 for r in out)


def test_features(spark):
    df = spark.createDataFrame([("h", "F", "x", 3, 1, 3, 0), ("z", "F", "x", 0, 0, 0, None)], STORE)
    got = rows(featurize(df, ["a", "b", "c"], "window").select("hash", "a", "b", "c"))
    assert got == [("h", 0.25, 0.75, 0.0), ("z", 0.0, 0.0, 0.0)]


def test_files(spark, tmp_path):
    place = tmp_path / "mips"
    spark.createDataFrame([(1, None), (2, "x")], "a int, b string").coalesce(1).write.parquet(str(place / "strace.parquet"))
    facts = tables.manifest(spark, str(tmp_path)).collect()
    assert [(r.rows, r.columns, r.row_groups, r.arch) for r in facts] == [(2, 2, 1, "mips")]
    assert tables.footers(tables.list_parquet(spark, str(tmp_path))).first().null_columns == ["b"]
    assert [tables.spread(10, 3), tables.spread(2, 3), tables.spread(5, 1)] == [[0, 4, 9], [0, 1], [0]]
    assert tables.default_features_uri("s3a://bucket/raw/x") == "s3a://bucket/features" and tables.default_features_uri("/data") is None
    with pytest.raises(FileNotFoundError):
        tables.load_store(spark, str(tmp_path))
    spark.range(1).write.parquet(str(tmp_path / "s" / "arm_strace.parquet"))
    spark.range(9).write.parquet(str(tmp_path / "s" / "arm_first20_strace.parquet"))
    assert tables.load_store(spark, str(tmp_path / "s")).count() == 1


def test_assignment_round_trip(spark, tmp_path):
    got = split.assign(_store(spark), CFG)
    tables.save_assignment(got, str(tmp_path / "a"))
    assert rows(tables.load_assignment(spark, str(tmp_path / "a"))) == rows(got)


def test_markdown(spark):
    df = spark.createDataFrame([("a", 1, 0.5), ("a", 2, None), ("b", 3, 0.25)], "g string, n int, x double").orderBy("g", "n")
    text = report.to_markdown(df, {"x": "X"}, {"x": ".3f"}, by=["g"], heading="Group {}")
    assert text.startswith("## Group a\n\n| n | X |\n| --- | --- |\n| 1 | 0.500 |\n| 2 |  |\n") and "## Group b" in text


def test_stream_positions(spark, tmp_path):
    from tracewright.streaming.state import stream_positions

    schema = "k string, o long"
    for part in range(3):
        spark.createDataFrame([("ab"[i % 2], part * 10 + i) for i in range(10)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = stream_positions(stream, "k", "o").writeStream.format("memory").queryName("placed").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    got = spark.sql("select k, sort_array(collect_list(position)) from placed group by k").collect()
    assert {r[0]: r[1] for r in got} == {k: list(range(1, 16)) for k in "ab"}
