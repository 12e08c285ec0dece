"""Right, wrong, other: prefix matching and ranking, and accuracy over any grouping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quaymark.functions.text import clean, log_softmax, matches


def scored(log: DataFrame) -> DataFrame:
    """A log with ``is_right``, ``is_wrong``, ``is_other`` by prefix matching; the first two may both hold.

    A null generation or answer is neither right nor wrong; without classes nothing is wrong.
    """
    g, a = clean(F.col("generation")), clean(F.col("answer"))
    right = F.coalesce(matches(g, a), F.lit(False))
    others = F.filter(F.coalesce("output_classes", F.array().cast("array<string>")), lambda c: c.isNotNull() & ~c.eqNullSafe(F.col("answer")))
    wrong = F.coalesce(F.exists(others, lambda c: matches(g, clean(c))), F.lit(False))
    return log.withColumn("is_right", right).withColumn("is_wrong", wrong).withColumn("is_other", ~(F.col("is_right") | F.col("is_wrong")))


def accuracy(log: DataFrame, *by: str) -> DataFrame:
    """``right``, ``wrong`` (shares), ``other``, ``total`` per group; sums are partial before any shuffle."""
    count = {k: F.sum(F.col(f"is_{k}").cast("bigint")) for k in ("right", "wrong", "other")}
    total = F.count("*")
    return log.groupBy(*by).agg((count["right"] / total).alias("right"), (count["wrong"] / total).alias("wrong"), count["other"].alias("other"), total.alias("total"))


def classes_by_batch(log: DataFrame, batch: Column, *by: str) -> DataFrame:
    """The sorted distinct answers of each group's batch; with them a batch is scored by its own classes."""
    return log.groupBy(*by, batch.alias("batch")).agg(F.sort_array(F.collect_set("answer")).alias("classes"))


def ranking(acc: DataFrame) -> DataFrame:
    """``rank`` from 1: right, wrong and total descending, then the node's text descending."""
    order = Window.orderBy(F.desc("right"), F.desc("wrong"), F.desc("total"), F.desc("node"), F.desc("node_id"))
    return acc.withColumn("rank", F.row_number().over(order))


def best_worst(acc: DataFrame) -> DataFrame:
    """The first and the last of the ranking, without sorting it."""
    key = F.struct("right", "wrong", "total", "node", "node_id")
    return acc.agg(F.max_by("node_id", key).alias("best"), F.min_by("node_id", key).alias("worst"))


def running(batches: DataFrame) -> DataFrame:
    """Successes and trials of each node up to each batch, and the accuracy before it.

    ``batches``: node_id, batch, right_count, trials.
    """
    so_far = Window.partitionBy("node_id").orderBy("batch").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("node_id").orderBy("batch")
    out = batches.withColumn("successes", F.sum("right_count").over(so_far)).withColumn("trials", F.sum("trials").over(so_far))
    return out.withColumn("accuracy", F.col("successes") / F.greatest("trials", F.lit(1))).withColumn("previous", F.lag("accuracy").over(before)).drop("right_count")


def best_so_far(snapshots: DataFrame) -> DataFrame:
    """``batch``, ``node_id``: at each batch the node of the best accuracy so far, the largest id on a tie."""
    return snapshots.groupBy("batch").agg(F.max_by("node_id", F.struct("accuracy", "node_id")).alias("node_id"))


def final_node(arms: DataFrame, highest: bool) -> DataFrame:
    """The arm of the best ratio of successes to trials: the largest id on a tie for 'highest', the smallest for the lowest."""
    key = F.struct(F.col("successes") / F.col("trials"), F.col("node_id"))
    pick = F.max_by if highest else F.min_by
    return arms.where("trials > 0").agg(pick("node_id", key).alias("node_id"))


def ucb(arms: DataFrame, step: Column) -> DataFrame:
    """With ``ucb``: mean plus 2 * sqrt(ln(1 + step) / trials); an untried arm has 0."""
    score = F.col("successes") / F.col("trials") + 2 * F.sqrt(F.log1p(step) / F.col("trials"))
    return arms.withColumn("ucb", F.when(F.col("trials") > 0, score).otherwise(F.lit(0.0)))


def top_logits(logits: DataFrame, key: str, values: str, k: int = 100) -> DataFrame:
    """``key``, ``rank``, ``token_id``, ``logit``: the k largest of each row, the lower token first on a tie."""
    each = F.transform(F.col(values), lambda x, i: F.struct((-x.cast("double")).alias("minus"), i.alias("token_id")))
    best = F.slice(F.array_sort(each), 1, k)
    return logits.select(key, F.posexplode(best).alias("rank", "t")).select(key, (F.col("rank") + 1).alias("rank"), F.col("t.token_id").alias("token_id"), (-F.col("t.minus")).alias("logit"))


def argmax(logits: Column, last: bool) -> Column:
    """The place (from 0) of the largest value: the last or the first of equals."""
    pairs = F.transform(logits, lambda x, i: F.struct(x.cast("double").alias("x"), (i if last else -i).alias("i")))
    at = F.array_max(pairs)["i"]
    return at if last else -at


def class_score(logits: Column, tokens: Column) -> Column:
    """The sum of the log-probabilities of the given tokens."""
    probs = log_softmax(F.transform(logits, lambda x: x.cast("double")))
    return F.aggregate(tokens, F.lit(0.0), lambda a, t: a + F.element_at(probs, t.cast("int") + 1))


def single_token(tokens: Column) -> Column:
    """Do all class encodings have two tokens (a start and one more), or share all but their last one?"""
    two = F.forall(tokens, lambda t: F.size(t) == 2)
    heads = F.size(F.array_distinct(F.transform(tokens, lambda t: F.slice(t, F.lit(1), F.greatest(F.size(t) - 1, F.lit(0)))))) == 1
    return two | heads
