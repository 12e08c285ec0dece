"""Layout-blind copies and texts of equal look, against brute force and on hard cases."""

from __future__ import annotations

import itertools

from pyspark.sql import functions as F

from quaymark.llm import chars, copies, looks
from quaymark.sources.tables import table

INSTANCES = "instance_id bigint, task string, input string, copies bigint, text string"


def _labels(spark, labels):
    return spark.createDataFrame([("t", labels)], "grp string, labels array<string>")


def _found(spark, rows, labels=("Text", "Question")):
    df = spark.createDataFrame([(i, t, s, 9, "clash") for i, t, s in rows], INSTANCES)
    return {tuple(r) for r in copies.copies(df, _labels(spark, list(labels))).collect()}


def test_copies_differ_in_layout_only(spark):
    rows = [
        (5, "t", "Text: A b.\nQuestion: C d?"),
        (3, "t", "question - c D\n\ntext: a, B!"),
        (4, "t", "Text: A b. Question: C é d?"),
        (6, "t", "Text: C d?\nQuestion: A b."),
        (7, "t", "Tеxt: A​ b. Question: C d"),  # Cyrillic е
        (8, "u", "Text: A b.\nQuestion: C d?"),
        (9, "t", "Text: A b²\nQuestion: C d?"),
        (10, "t", None), (11, "t", ""), (12, "t", " .!"), (13, "t", " .!"), (None, "t", "Text: A b.\nQuestion: C d?"),
        (14, None, "x"), (15, None, "x"),
    ]
    assert _found(spark, rows) == {(3, 5), (3, 7)}


def test_copies_ties_repeats_and_empty(spark):
    assert _found(spark, [(1, "t", "x"), (1, "t", "X"), (2, "t", "x"), (2, "t", "x")]) == {(1, 2)}
    assert _found(spark, []) == set()
    long = "word " * 200_000
    assert _found(spark, [(1, "t", long), (2, "t", long.upper())]) == {(1, 2)}


def test_json_members_in_any_order(spark):
    rows = [(1, "t", '{"a": "X y", "b": "1"}'), (2, "t", '{"b": "1", "a": "x \\n y."}'), (3, "t", '{"b": "X y", "a": "1"}'), (4, "t", '{"a": "X\\ty", "b": "1"')]
    assert _found(spark, rows, ("a", "b")) == {(1, 2), (1, 4)}


def test_copies_against_brute_force(spark, sf_dir):
    tasks = table(spark, sf_dir, "tasks")
    labels = {r.task: tuple(r.field_labels) for r in tasks.collect()}
    rows = table(spark, sf_dir, "instances").select("instance_id", "task", "input").collect()
    groups: dict = {}
    for r in sorted(rows, key=lambda r: r.instance_id):
        form = copies.canonical(r.input, labels[r.task]) if r.input else ""
        if form:
            groups.setdefault((r.task, form), []).append(r.instance_id)
    want = {(g[0], x) for g in groups.values() for x in g[1:]}
    got = {tuple(r) for r in copies.copies(table(spark, sf_dir, "instances"), tasks.select(F.col("task").alias("grp"), F.col("field_labels").alias("labels"))).collect()}
    assert got == want and want


def test_counts_and_collisions(spark):
    df = spark.createDataFrame([(1, "t", "x"), (2, "t", "X!"), (3, "t", "y")], "instance_id bigint, task string, input string")
    keys = copies.keyed(df, _labels(spark, None))
    assert {(r.kept_id, r.copies) for r in copies.counts(keys).collect()} == {(1, 2), (3, 1)} and copies.collisions(keys).count() == 0
    clash = keys.withColumn("h", F.lit(b"same"))
    assert copies.collisions(clash).count() == 1 and copies.counts(clash).count() == 2


def _pairs(spark, rows):
    df = spark.createDataFrame([(i, t, s, 9, "clash") for i, t, s in rows], INSTANCES)
    return {tuple(r) for r in looks.same_look(df).collect()}


def test_equal_looks(spark):
    rows = [
        (1, "t", "The café, office 12: ok"),
        (2, "t", "The café, ofﬁce １２： ok"),
        (3, "t", "Thе  café, office\t12: ok"),  # Cyrillic е, no-break space
        (4, "t", "The  café,\noffice 12: ok"),
        (5, "t", "The cafe, office 12: ok"),
        (6, "t", "the café, office 12: ok"),
        (7, "t", "The café, office 1²: ok"),
        (8, "t", None), (9, "t", ""), (10, "t", "​"), (11, "t", " "),
        (12, "u", "The café, office 12: ok"),
    ]
    assert _pairs(spark, rows) == {(1, 2), (1, 3), (2, 3), (2, 4), (3, 4)}
    assert _pairs(spark, []) == set()


def test_equal_looks_in_cyrillic(spark):
    rows = [(1, "t", "Где канат, а не парус?"), (2, "t", "Где кaнат, a не пapус?"), (3, "t", "Где⁠ канат, а не парус?"), (4, "t", "где канат, а не парус?")]
    assert _pairs(spark, rows) == {(1, 2), (1, 3), (2, 3)}


def test_pairs_against_brute_force(spark, sf_dir):
    rows = [r for r in table(spark, sf_dir, "instances").select("instance_id", "task", "input").collect() if r.input and r.input.strip()]
    drop = str.maketrans("", "", " \t\n\r\x0b\x0c")
    form = {r.instance_id: (r.task, "".join(chars.skeleton(r.input).split()), r.input.translate(drop)) for r in rows}
    want = {(min(a, b), max(a, b)) for a, b in itertools.combinations(form, 2) if form[a][:2] == form[b][:2] and form[a][2] != form[b][2]}
    got = {tuple(r) for r in looks.same_look(table(spark, sf_dir, "instances")).collect()}
    assert got == want and want


def test_trie_costs():
    t = looks.Trie()
    t.add("cope", 5)
    t.add("cape", 9)
    assert t.nearest("соре") == "cope" and t.nearest("c​ope") == "cope" and t.nearest("cupe") is None
    assert t.nearest("cupe", limit=1) == "cape" and t.nearest("cop", limit=1) == "cope" and t.nearest("ccope", limit=1) == "cope"


def test_consistent_spelling(spark):
    df = spark.createDataFrame([(1, "office ofﬁce оffice"), (2, None), (3, ""), (4, "ｘ１ nаïve")], "k bigint, text string")
    got = {r.k: r.canonical for r in looks.consistent(df, ["k"]).collect()}
    assert got == {1: "office office office", 2: None, 3: "", 4: "x1 naïve"}
