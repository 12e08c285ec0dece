"""Every query of the core against its SQL, and the ones without SQL for what must hold of them."""

from __future__ import annotations

import pytest
from oracle import connect, rows
from pyspark.sql import functions as F

from quaymark.plans import catalog


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_sql(spark, sf_dir, con, name):
    ours, theirs = catalog.QUERIES[name](spark, sf_dir).toPandas(), con.sql(catalog.SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


def test_edges(spark, sf_dir):
    found = catalog.QUERIES["format_edges"](spark, sf_dir).collect()
    assert len(found) == 60
    ends = [x for r in found for x in (r.node_a, r.node_b)]
    assert all(r.node_a and r.node_b for r in found) and {r.slot for r in found} == {0, 1, 2}
    assert len(ends) == 120


def test_paths(spark, sf_dir):
    for r in catalog.QUERIES["format_paths"](spark, sf_dir).collect():
        assert r.node_0 and r.node_1 and r.node_2


def test_thompson_never_exceeds_the_data(spark, sf_dir):
    trace = catalog.QUERIES["thompson_run"](spark, sf_dir).collect()
    assert all(0 <= r.successes <= r.trials <= 1000 for r in trace)
    assert {r.phase for r in trace} <= {"highest", "lowest"}


def test_files(spark, sf_dir):
    r = catalog.QUERIES["json_roundtrip"](spark, sf_dir).first()
    assert (r.formats, r.rows) == (640, catalog._instances(spark, sf_dir).where(F.col("task") == catalog.ORDERED).count())
    assert '"generation_order"' in catalog.QUERIES["run_document"](spark, sf_dir).first().document


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).limit(3).count() == 3
    assert set(e.oracle_sql()) <= set(e.queries())


def test_whole_jobs_have_every_test_row(spark):
    d = "/root/testdata/sf0.01"
    rows = catalog._rows(spark, d).where("part = 'test'").groupBy("task").count()
    nodes, want = catalog._nodes(spark, d).groupBy("task").agg(F.count("*").alias("n")), {}
    for r in rows.join(nodes, "task").collect():
        want[r.task] = r["count"] * r.n
    for name in ("full_prompts", "full_prompts_zero_shot"):
        assert {r.task: r["count"] for r in catalog.QUERIES[name](spark, d).groupBy("task").count().collect()} == want
    totals = {r.task: r.total for r in catalog.QUERIES["full_evaluation"](spark, d).groupBy("task").agg(F.sum("total").alias("total")).collect()}
    assert totals and all(want[t] == n for t, n in totals.items())


def test_stored_order_is_a_permutation(spark):
    d = "/root/testdata/sf0.01"
    order = catalog.QUERIES["json_order"](spark, d).collect()
    pos = sorted(r.pos for r in catalog._instances(spark, d).where(F.col("task") == catalog.ORDERED).select("pos").collect())
    assert sorted(r.row for r in order) == pos != [r.row for r in order] and [r.place for r in order] == list(range(len(pos)))
