"""Every query with SQL gives what DuckDB gives on the same tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tracewright.config import ModelConfig
from tracewright.operators import model
from tracewright.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{SF}/{name}'")
    return con


def _sorted(rows):
    return sorted((tuple("nan" if isinstance(v, float) and math.isnan(v) else v for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equals_sql(spark, duck, name):
    got = QUERIES[name](spark, SF)
    want = duck.sql(ORACLE[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    order = [want.columns.index(c) for c in columns]
    assert _sorted(tuple(r[c] for c in columns) for r in got.collect()) == _sorted(tuple(r[i] for i in order) for r in want.fetchall())


@pytest.mark.parametrize("name", ["parquet_manifest", "null_columns", "table_report"])
def test_rows_only(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


@pytest.mark.parametrize("name, experiment, tests", [("gbt_in_arch", "in-architecture", 190), ("gbt_leave_one_out", "leave-one-architecture-out", 936)])
def test_models_score_all_folds(spark, monkeypatch, name, experiment, tests):
    """Every fold reaches training, with the default settings; training itself is left out."""
    seen = []

    def score_fold(fold, cfg):
        seen.append(cfg)
        return fold.where("role = 'test'").selectExpr("count(*) AS n")

    monkeypatch.setattr(model, "score_fold", score_fold)
    got = QUERIES[name](spark, SF).collect()
    assert sorted((r.experiment, r.held_out) for r in got) == [(experiment, k) for k in "FOP"] and sum(r.n for r in got) == tests
    assert seen == [ModelConfig()] * 3


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
