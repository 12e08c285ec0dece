"""A whole run, exhaustive and on a budget."""

from __future__ import annotations

import json
import re

import pytest

from pyspark.sql import functions as F

from quaymark.__main__ import command
from quaymark.plans.run import Settings, answered, input_formats, run
from quaymark.plans.templates import CATALOGUE, TASKS
from quaymark.sources.tables import table

TASK = "task9001_tide_reports_yesno"


@pytest.mark.parametrize("more", [{}, {"formats": None, "edges": 6}, {"formats": None, "paths": 4}, {"budget": 800}])
def test_run(spark, more):
    s = Settings(TASK, CATALOGUE["input_output"], samples=60, **more)
    acc, ends = run(spark, table(spark, "/root/testdata/sf0.01", "instances"), "DEF", s, ["Yes", "No"])
    rows = acc.collect()
    assert 2 <= len(rows) <= 13 and ends.first().best and ends.first().worst
    assert s.name().startswith("genscore_task9001_mock_1shot")


@pytest.mark.parametrize("more", [{"edges": 3}, {"samples": 61}, {"n_shot": 11}, {"metric": "x"}, {"budget": 30}])
def test_guards(more):
    with pytest.raises(ValueError):
        Settings(TASK, CATALOGUE["input_output"], **more).check()


def _inputs(spark, bad):
    rows = [(k, TASK, f"Text {k}" if bad(k) else f"Text: a{k}", ["Yes"] if k % 7 else ["Yes", "No"]) for k in range(200)]
    return spark.createDataFrame(rows, "instance_id bigint, task string, input string, output array<string>")


def test_unparsed_rows_take_no_place(spark):
    """Of 200 rows a third can't be parsed; samples and demonstrations are still whole."""
    s = Settings(TASK, CATALOGUE["input_output"], samples=60, n_shot=2, formats=2)
    log = answered(spark, _inputs(spark, lambda k: k % 3 == 0), "DEF", s, ["Yes", "No"], original="Text: {}").select("node_id", "eval_pos", "prompt").collect()
    assert {n: sorted(r.eval_pos for r in log if r.node_id == n) for n in {r.node_id for r in log}} == dict.fromkeys({r.node_id for r in log}, list(range(60)))
    assert all(len(re.findall(r"a[0-9]+", r.prompt)) == 3 for r in log)
    with pytest.raises(ValueError, match="demonstrations"):
        answered(spark, _inputs(spark, lambda k: True), "DEF", s, ["Yes", "No"], original="Text: {}")


@pytest.mark.parametrize("more", [{}, {"budget": 80}])
def test_ranking(spark, more):
    """Ranking asks for logits and is right where the likeliest class is the answer, even one that begins like it."""

    class Ranker:
        def class_logits(self, prompts, classes):
            return [[float(len(p) % 2), 0.5] for p in prompts]

    s = Settings(TASK, CATALOGUE["input_output"], samples=40, formats=2, metric="probability_ranking", **more)
    rows, classes = _inputs(spark, lambda k: False), ["Yes", "Yes no"]
    with pytest.raises(ValueError, match="ranking"):
        run(spark, rows, "DEF", s, classes)
    log = answered(spark, rows, "DEF", s, classes, Ranker).select("node_id", "prompt", "generation").collect()
    assert all(r.generation == ("Yes" if len(r.prompt) % 2 else "Yes no") for r in log) and len({r.generation for r in log}) == 2
    acc = run(spark, rows, "DEF", s, classes, Ranker)[0].collect()
    if not more:
        assert {r.node_id: round(r.right * 40) for r in acc} == {r.node_id: sum(x.generation == "Yes" for x in log if x.node_id == r.node_id) for r in acc}
        assert all(r.other == 0 for r in acc)


def test_options_are_renamed_by_each_format(spark):
    """Classes of options follow the format's numbering, in demonstrations, answers and classes; the instruction names them too."""
    t = TASKS[1380]
    text = "Sentence: s{} Question: q{} (A) a{} (B) b{}"
    rows = spark.createDataFrame([(k, TASK, text.replace("{}", str(k)), ["A" if k % 2 else "B"]) for k in range(60)], "instance_id bigint, task string, input string, output array<string>")
    s = Settings(TASK, t, samples=20, formats=12, n_shot=2)
    log = answered(spark, rows, "Say {enum1_1} or {enum1_2}.", s, None, original=input_formats(spark, t)).collect()
    assert len(log) == 20 * len({r.node_id for r in log})
    for r in log:
        assert r.answer in r.output_classes and r.prompt.startswith(f"Say {r.output_classes[0]} or {r.output_classes[1]}.")
    assert len({tuple(r.output_classes) for r in log}) > 1
    bad = rows.withColumn("output", F.array(F.lit("C")))
    with pytest.raises(Exception, match="no such class"):
        answered(spark, bad, "", s, None, original=input_formats(spark, t)).collect()


def test_items_of_varying_number(spark):
    t = TASKS[84]
    facts = lambda n: " ".join(f"Fact {i}- f{i}." for i in range(1, n + 1))
    rows = spark.createDataFrame([(k, TASK, f"Passage: {facts(2 + k % 3)} Question: q{k} Answer: a{k}", ["1"]) for k in range(60)], "instance_id bigint, task string, input string, output array<string>")
    log = answered(spark, rows, "D", Settings(TASK, t, samples=20, formats=3, n_shot=1), None, original=input_formats(spark, t)).collect()
    assert len(log) % 20 == 0 and {len(re.findall(r"f[0-9]\.", r.prompt.split("\n\n")[-1])) for r in log} == {2, 3, 4}


def test_stored_formats_and_order(spark, tmp_path):
    """A run by the command line writes its formats and order; another one takes them from the file."""
    (tmp_path / "tasks").mkdir()
    doc = {"Definition": ["Is it?"], "Instances": [{"input": f"Sentence: s{k}", "output": ["Yes" if k % 3 else "No"]} for k in range(80)]}
    (tmp_path / "tasks" / "task113_x.json").write_text(json.dumps(doc))
    args = ["--tasks", str(tmp_path / "tasks"), "--task", "task113_", "--formats", "5", "--samples", "40", "--batch", "20", "--out", str(tmp_path / "out")]
    stored = str(tmp_path / "formats.json")
    one = command(spark, [*args, "--stored", stored])
    two = command(spark, [*args, "--stored", stored])
    a, b = (spark.read.json(x).first() for x in (one, two))
    assert a.all_structured_prompt_formats_accuracies == b.all_structured_prompt_formats_accuracies and len(a.generation_order) >= 2
    spread = spark.read.json(command(spark, [*args, "--stored", stored, "--budget", "80"])).first()
    assert spread.metadata.thompson_sampling and spread.metadata.settings.metric == "exact_prefix_matching"
