"""The bandit search, model adapter, task files and the stream."""

from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from quaymark.operators import model, scoring
from quaymark.plans import search
from quaymark.sources import task_files
from quaymark.sources.tables import table
from quaymark.streaming.accuracy import stream_accuracy


@pytest.mark.parametrize("rule", ["thompson", "ucb"])
def test_search_finds_the_extremes(rule):
    rng = np.random.default_rng(1)
    grid = rng.random((20, 400)) < np.linspace(0.1, 0.9, 20)[:, None]
    names = [f"n{k:02d}" for k in range(20)]
    found = search.two_phases(names, grid, 4000, 20, rule=rule)
    assert (found.trials <= 400).all()
    assert found.best("highest") >= "n15"
    again = search.two_phases(names, grid, 4000, 20, rule=rule)
    assert found.trace == again.trace


def test_budget_and_prior():
    with pytest.raises(ValueError):
        search.check_budget(30, 20, 100)
    assert search.check_budget(80, 20, 100) == 2
    assert search.prior_from(1.0)[0] > 1000 and search.prior_from(0.0) == (1.1, 5.0)


def _echo():
    class Echo:
        def generate(self, prompts, max_tokens):
            return [p[:max_tokens] for p in prompts]

        def class_logits(self, prompts, classes):
            return [[float(len(c)) for c in cs] for cs in classes]

    return Echo


def test_model_adapter(spark):
    echo = _echo()
    rows = spark.createDataFrame([("abcdef", ["x", "yy"])], "prompt string, output_classes array<string>")
    assert model.generate(rows, echo, 3).first().generation == "abc"
    assert model.rank_classes(rows, echo).first().logits == [1.0, 2.0]


def test_task_files(spark, tmp_path):
    (tmp_path / "task1_x.json").write_text(json.dumps({"Definition": ["D"], "Instances": [{"input": "a", "output": ["b"]}, {"input": "c", "output": ["d"]}], "Other": 1}, indent=1))
    assert [r.input for r in task_files.read_task(spark, task_files.one_file(spark, str(tmp_path), "task1_")).orderBy("pos").collect()] == ["a", "c"]
    with pytest.raises(ValueError):
        task_files.one_file(spark, str(tmp_path), "task2")
    (tmp_path / "a.json").write_text(json.dumps({"annotations": ["One", "two"]}))
    (tmp_path / "e.json").write_text(json.dumps({"examples": {"10": {"input": "x", "output": "y"}, "2": {"input": "u", "output": "v"}}}))
    told, rows = task_files.read_examples(spark, str(tmp_path / "a.json"), str(tmp_path / "e.json"))
    assert [(r.input, r.output) for r in rows.orderBy("pos").collect()] == [("x", ["y"]), ("u", ["v"])] and told.first().annotations == ["One", "two"]
    assert task_files.output_name("task158_abc.json", "m/x", "probability_ranking", 1, 10) == "rankscore_task158_m-x_1shot_10formats_full.json"


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    log = table(spark, sf_dir, "logs").where("arrived_at is not null").withColumn("arrived_at", F.col("arrived_at").cast("timestamp"))
    log.write.parquet(str(tmp_path / "log"))
    stream = spark.readStream.schema(log.schema).parquet(str(tmp_path / "log"))
    q = stream_accuracy(stream, "400 days").writeStream.outputMode("complete").format("memory").queryName("acc").start()
    q.processAllAvailable()
    q.stop()
    once = scoring.scored(log.dropDuplicates(["log_id"]))
    want = {r.node_id: r.n for r in once.groupBy("node_id").agg(F.count("*").alias("n")).collect()}
    assert {r.node_id: r.total for r in spark.sql("select * from acc").collect()} == want


def test_arms_of_unequal_length():
    """An arm is spent at its own rows; the original is spent from the start and gives the prior."""
    grid = [[1] * 6 + [0] * 4, [1] * 30, [0] * 7]
    found = search.two_phases(["o", "a", "b"], grid, 200, 5, original="o")
    assert found.prior == search.prior_from(0.6) and (found.trials <= [10, 30, 7]).all()
    assert "o" not in {node for _, _, node, *_ in found.trace} and found.trials[0] == 10 and found.successes[0] == 6
    assert found.best("highest") == "a" and found.best("lowest") == "b" and found.trials.tolist() == [10, 30, 7]


def test_steps_follow_given_draws():
    arms = search.Arms.of(["o", "a", "b"], [[1, 0], [1, 0, 1, 1], [0, 0, 1]], 2)
    s = search.Search(arms)
    s.finish("o")
    s.run("highest", 4, draws=np.array([[9, 1, 2], [9, 3, 2], [9, 3, 2], [9, 3, 2]], float))
    assert [(n, a, b) for _, _, n, a, b, _ in s.trace] == [("b", 0, 2), ("a", 1, 2), ("a", 3, 4), ("b", 1, 3)]


def test_outcomes_are_summed_by_batch(spark):
    """The same search from a log as from a grid, with steps fewer than the batches and a row that is there twice."""
    rng = np.random.default_rng(2)
    grid = [rng.random(n) < p for n, p in ((50, 0.5), (83, 0.7), (31, 0.3))]
    rows = [(f"n{k}", at, bool(hit)) for k, r in enumerate(grid) for at, hit in enumerate(r)]
    log = spark.createDataFrame([*rows, rows[0]], "node_id string, eval_pos bigint, is_right boolean")
    names = ["n0", "n1", "n2"]
    a, b = search.search_arms(search.outcomes(log, 10, 6), 60, 3, original="n0"), search.two_phases(names, grid, 60, 10, 3, original="n0")
    assert a.trace == b.trace and a.successes.tolist() == b.successes.tolist() and a.trials.tolist() == b.trials.tolist()
