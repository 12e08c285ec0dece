"""Truth tables of cleaning, matching, filling and ranking; extraction; prompts; scores."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from quaymark.functions.text import clean, filled, log_softmax, matches, titled
from quaymark.operators import dataset, extract, prompts, scoring


@pytest.mark.parametrize(
    "g,a,ok",
    [("article", "a", False), ("a", "a", True), ("iii", "ii", False), ("ii)", "ii", True), ("", "", True), ("x", "", False), ("- y", "", True), ("yes, indeed", "yes", True), ("yes1", "yes", False), ("да!", "да", True), ("日本", "日", False)],
)
def test_matches(spark, g, a, ok):
    row = spark.createDataFrame([(g, a)], "g string, a string")
    assert row.select(matches(F.col("g"), F.col("a")).alias("m")).first().m is ok


def test_clean_and_title(spark):
    row = spark.createDataFrame([(" -(A.)\n", "two-part don't")], "x string, y string")
    got = row.select(clean(F.col("x")).alias("x"), titled(F.col("y")).alias("y")).first()
    assert (got.x, got.y) == ("a", "Two-Part Don'T")


def test_filled(spark):
    row = spark.createDataFrame([("A: {}\nB: {}", ["$1 \\2", "{x}", "surplus"])], "t string, f array<string>")
    assert row.select(filled(F.col("t"), F.col("f")).alias("x")).first().x == "A: $1 \\2\nB: {x}"
    with pytest.raises(Exception, match="fewer fields"):
        row.select(filled(F.col("t"), F.slice("f", 1, 1)).alias("x")).collect()


def test_log_softmax(spark):
    got = spark.sql("select array(1d, 2d, 1000d) as x").select(log_softmax(F.col("x")).alias("y")).first().y
    assert got[2] == 0.0 and math.isclose(got[0], -999.0)


def test_extract_longest_variant_first_and_odd_characters(spark):
    rows = spark.createDataFrame([(1, "A: x B: y"), (2, "A: x"), (3, "A: \tx"), (4, None), (5, ""), (6, "A: 字"), (7, "A: x\r")], "k int, input string")
    out = {r.k: (r.fields, r.regex_key) for r in extract.extract(rows, {1: "A: {}", 2: "A: {} B: {}"}).collect()}
    assert out[1] == (["x", "y"], 2) and out[2] == (["x"], 1)
    assert all(out[k] == (None, None) for k in (3, 4, 5, 6, 7))
    odd = {r.k: r.characters for r in extract.unparsed(extract.extract(rows, {1: "A: {}"}), "k").collect()}
    assert odd[3] == "\t" and odd[6] == "字" and odd[7] == "\r" and 4 not in odd


def test_longest_instruction_and_classes(spark):
    rows = spark.createDataFrame([("t", ["Abc", "Xyz", "lower case is longer"]), ("u", None)], "task string, definition array<string>")
    assert [tuple(r) for r in dataset.longest_instruction(rows).collect()] == [("t", "Abc")]


def test_stored_order_must_exist(spark):
    rows = spark.createDataFrame([(0, "a")], "row int, x string")
    order = spark.createDataFrame([(0, 5)], "place int, row int")
    with pytest.raises(Exception, match="stored order"):
        dataset.applied(rows, order).collect()


def test_prompts_by_hand(spark):
    nodes = spark.createDataFrame([("t", "n", "Sentence: {}\nAnswer: {}", "DEF")], "task string, node_id string, node string, instruction string")
    demos = spark.createDataFrame([("t", 0, ["d1"], "y1"), ("t", 1, ["d2"], "y2")], "task string, place int, fields array<string>, answer string")
    rows = spark.createDataFrame([("t", 7, ["x1"])], "task string, dataset_idx int, fields array<string>")
    one = prompts.full_prompts(nodes, rows, prompts.demo_block(nodes, demos, 1)).first().prompt
    assert one == "DEF\n\nSentence: d1\nAnswer: y1\n\nSentence: x1\nAnswer: "
    assert prompts.full_prompts(nodes, rows, None).first().prompt == "Sentence: x1\nAnswer: "


def test_class_map_errors(spark):
    with pytest.raises(Exception, match="differ in length"):
        prompts.class_map(spark.sql("select 'n' as node_id, array('a') as original_classes, array('x', 'y') as current_classes")).collect()
    mapping = spark.sql("select 'n' as node_id, 'a' as original, 'x' as current")
    with pytest.raises(Exception, match="no such class"):
        prompts.remapped(spark.sql("select 'n' as node_id, 'b' as answer"), mapping).collect()


def test_scores(spark):
    log = spark.createDataFrame(
        [("a", "a b", "a", ["a", "a b"]), ("b", None, "a", ["a"]), ("c", "zzz", "a", None), ("d", "b", "a", ["a", "b"])],
        "node_id string, generation string, answer string, output_classes array<string>",
    )
    got = {r.node_id: (r.is_right, r.is_wrong, r.is_other) for r in scoring.scored(log).collect()}
    assert got == {"a": (True, True, False), "b": (False, False, True), "c": (False, False, True), "d": (False, True, False)}
    assert scoring.accuracy(scoring.scored(log.limit(0)), "node_id").count() == 0


def test_argmax_ties(spark):
    row = spark.sql("select array(1f, 3f, 3f) as x").select(scoring.argmax(F.col("x"), True).alias("last"), scoring.argmax(F.col("x"), False).alias("first")).first()
    assert (row.last, row.first) == (2, 1)


def test_final_node_ties(spark):
    arms = spark.createDataFrame([("a", 1, 2), ("b", 2, 4), ("c", 0, 0)], "node_id string, successes int, trials int")
    assert scoring.final_node(arms, True).first().node_id == "b" and scoring.final_node(arms, False).first().node_id == "a"


def test_permutation_is_a_bijection_for_any_task(spark):
    rows = spark.range(3000).selectExpr("id as instance_id", "case when id % 3 = 0 then null when id % 50 = 1 then 'b' else 'a' end as task", "'clash' as place_")
    out = dataset.permuted(rows).toPandas()
    assert len(out) == 3000
    for _, part in out.groupby("task", dropna=False):
        assert sorted(part["place"]) == list(range(len(part)))
    assert dataset.permuted(rows.limit(0)).count() == 0
