"""Registered queries, their SQL, and the pipeline."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from tracewright.llm.oracle import ORACLE
from tracewright.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for t in os.listdir(SF):
        con.sql(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{SF}/{t}'")
    got, want = QUERIES[name](spark, SF), con.sql(ORACLE[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    order = [want.columns.index(c) for c in columns]
    assert sorted((tuple(r[c] for c in columns) for r in got.collect()), key=repr) == sorted((tuple(r[i] for i in order) for r in want.fetchall()), key=repr)


def test_registered():
    names = entry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))


def test_pipeline(spark, docs):
    from test_llm_operators import base_spans, groups

    kept, held = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in kept.collect()}
        out = stage(spark, kept, SF)
        if name != "packing":
            assert out.columns == docs.columns
        from tracewright.llm.storage import written

        kept = written(out, name)
        held[name] = (before, kept.collect())
    before, after = held["near_duplicates"]
    want = {c for _, _, c in groups([(i, r.text) for i, r in before.items()])}
    assert {r.doc_id for r in after} == want
    before, after = held["decontamination"]
    assert all(r.text == before[r.doc_id].text or r.n_chars < before[r.doc_id].n_chars for r in after)
    assert all(not base_spans(r.text) for r in held["personal_data"][1])
    assert {r.doc_id for r in held["packing"][1]} == {r.doc_id for r in held["personal_data"][1]}
    assert corpus_pipeline.run(spark, SF).count() == len(held["packing"][1])
