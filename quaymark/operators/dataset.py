"""Order, demonstrations and test rows of a task's instances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

POOL = 10


def digest(*parts: Column | str, seed: str = "0") -> Column:
    """Text of 32 hexadecimal digits that orders rows at random but alike everywhere."""
    return F.md5(F.encode(F.concat_ws("|", F.lit(seed), *parts), "UTF-8"))


def permuted(df: DataFrame, seed: str = "0", by: str = "task", key: str = "instance_id") -> DataFrame:
    """With ``place``: a permutation of each task's rows from 0, by the digest of the seed and the key; ties by key.

    Rows are ranked within (task, first digits of the digest) and shifted by the counts of the lesser ones, so a
    task that holds most rows is sorted in thousands of pieces and not by one worker.
    """
    d = digest(F.col(key).cast("string"), seed=seed)
    rows = df.withColumn("_d", d).withColumn("_b", F.substring("_d", 1, 3)).withColumn("_g", F.struct(F.col(by)))
    counts = rows.groupBy("_g", "_b").agg(F.count("*").alias("n"))
    below = Window.partitionBy("_g").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    shift = counts.select("_g", "_b", F.coalesce(F.sum("n").over(below), F.lit(0)).alias("_shift"))
    local = F.row_number().over(Window.partitionBy("_g", "_b").orderBy("_d", key))
    ranked = rows.withColumn("_n", local)
    return ranked.join(shift, ["_g", "_b"]).withColumn("place", (F.col("_shift") + F.col("_n") - 1).cast("bigint")).drop("_g", "_b", "_d", "_n", "_shift")


def split(df: DataFrame, pool: int = POOL) -> DataFrame:
    """With ``part`` ('demo' for the first ``pool`` places, else 'test') and ``dataset_idx`` counted within the part."""
    demo = F.col("place") < pool
    return df.withColumn("part", F.when(demo, "demo").otherwise("test")).withColumn("dataset_idx", F.when(demo, F.col("place")).otherwise(F.col("place") - pool))


def interval(df: DataFrame, last: int, n: int, order: str = "eval_pos") -> DataFrame:
    """Rows [last, last + n); n = -1: the rest."""
    return df.where((F.col(order) >= last) & (F.lit(n == -1) | (F.col(order) < last + n)))


def applied(df: DataFrame, order: DataFrame, row: str = "row") -> DataFrame:
    """Rows put in a stored order (``place``, ``row``): joined by row; a stored row that isn't there is an error."""
    rows = df.withColumn("_here", F.lit(True))
    missing = F.raise_error(F.lit("the stored order names a row that isn't there")).cast("boolean")
    return order.join(rows, row, "left").where(F.coalesce("_here", missing)).drop("_here")


def longest_instruction(df: DataFrame, by: str = "task", texts: str = "definition") -> DataFrame:
    """``by``, ``instruction``: the longest text that begins in upper case; the first of equals; null texts are skipped."""
    each = df.select(by, F.posexplode(texts).alias("at", "text")).where(F.regexp_like("text", F.lit(r"^\p{Lu}")))
    return each.groupBy(by).agg(F.max_by("text", F.struct(F.length("text"), -F.col("at"))).alias("instruction"))


def few_classes(df: DataFrame, most: int = 10, by: str = "task") -> DataFrame:
    """``by``, ``classes``, ``rankable``: distinct first outputs over the whole set; ranking needs fewer than ``most``."""
    out = df.groupBy(by).agg(F.countDistinct(F.try_element_at("output", F.lit(1))).alias("classes"))
    return out.withColumn("rankable", F.col("classes") < most)
