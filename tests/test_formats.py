"""Format grammar: golden counts, refusals, sampling, domains."""

from __future__ import annotations

import pytest

from quaymark.functions.domains import DOMAINS, cased, number
from quaymark.operators import formats
from quaymark.plans.grammar import Compiled, Field, Items, Owner, Spaced, Template
from quaymark.plans.templates import CATALOGUE, template_of


def _reduced(spark, name):
    """The valid assignments of the slots that rules speak of; the others are free."""
    t = CATALOGUE[name]
    slots = [s for s in t.slots() if s.kind not in ("wrapper", "numbering", "casing")]
    n = 1
    for s in slots:
        n *= len(DOMAINS[s.kind])
    rows = formats._digits(spark.range(n).withColumnRenamed("id", "cand_id"), slots, "cand_id")
    free = [s for s in t.slots() if s not in slots]
    return formats.valid(rows.selectExpr("*", *(f"0 as {s.column}" for s in free)), t).count()


def test_one_field_counts(spark):
    t = CATALOGUE["one_field"]
    valid = formats.valid(formats.product(spark, t), t)
    assert (t.size(), valid.count(), formats.distinct(valid, t).count(), formats.nodes(valid, t).count()) == (960, 680, 640, 480)


@pytest.mark.parametrize("name,size,count", [("sentence_question_2", 8_294_400, 38_800), ("question_options_5_blank", 132_710_400, 230_000)])
def test_larger_counts(spark, name, size, count):
    assert CATALOGUE[name].size() == size
    assert _reduced(spark, name) == count  # times 144 for wrapper, numbering and casing


@pytest.mark.parametrize(
    "name,size",
    [("sentence_pair", 33_177_600), ("story_titles", 5_096_079_360), ("text_options_4", 124_416_000), ("passage_facts_variable", 530_841_600), ("facts_question_options_8", 4_586_471_424_000), ("story_gap", 1_146_617_856_000), ("prompt_completions", 33_177_600), ("bare_options_5", 8_294_400), ("title_sentences_choices", 1_223_059_046_400)],
)
def test_space_sizes(name, size):
    assert CATALOGUE[name].size() == size


def test_template_of_a_task():
    assert template_of("task065_story.json").name == "story_gap" and template_of("task1431_x").name == "question_options_5"
    assert template_of("task902_x", frozenset({902})).name == "input_output"
    with pytest.raises(KeyError):
        template_of("task999_x")


def test_own_empty_separator_keeps_the_old_one(spark):
    t = Template("t", Spaced("all", (Field("a", "A", ": "), Field("b", "B", ""))))
    row = spark.range(1).selectExpr("2 as all__space", "0 as a__separator", "0 as a__casing", "0 as b__separator", "0 as b__casing")
    got = row.select(Compiled(t).render().alias("node"), Compiled(t).valid().alias("ok")).first()
    assert got.node == "A: {}\nB{}" and not got.ok


def test_numeral_signs_end_at_twelve(spark):
    for n, ok in ((12, True), (13, False)):
        t = Template("t", Items("i", "", tuple(range(n)), "\n", " "))
        row = spark.range(1).selectExpr("2 as i__space", "8 as i__separator", "0 as i__wrapper", "3 as i__numbering")
        assert row.select(Compiled(t).valid().alias("ok")).first().ok is ok


def test_owner_separator_needs_the_items_break(spark):
    t = Template("t", Items("i", "", (0, 1), " ", " ", separator_of="s"), (Owner("s", "separator", " "),))
    row = spark.range(1).selectExpr("1 as i__space", "0 as i__wrapper", "0 as i__numbering", "10 as s__separator")
    assert not row.select(Compiled(t).valid().alias("ok")).first().ok


def test_sample_is_distinct_valid_and_bounded(spark):
    t = CATALOGUE["facts_question_options_8"]
    got = formats.sample(spark, t, 50)
    assert got.count() == 50 and formats.valid(got, t).count() == 50
    assert got.select(*(s.column for s in t.slots())).distinct().count() == 50
    with pytest.raises(ValueError, match="fewer than"):
        formats.sample(spark, CATALOGUE["one_field"], 700)


def test_every_template_renders(spark):
    for name, t in CATALOGUE.items():
        text = spark.range(1).select(Compiled(t, original=True).render().alias("node")).first().node
        assert text.count("{}") >= 2, name


def test_casing_and_numbers():
    assert cased("two-part don't")[1] == "Two-Part Don'T"
    assert [number(s, 3) for s in DOMAINS["numbering"]] == ["4", "D", "d", "Ⅳ", "iv", "IV"]


def test_lookup_of_an_unknown_name(spark):
    from quaymark.functions import domains

    names = spark.createDataFrame([("space", "no such")], "action_type string, name string")
    with pytest.raises(Exception, match="no such value"):
        formats.lookup(names, domains.table(spark)).collect()
