"""Demonstrations, instructions and full prompts of every format and row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaymark.functions.text import filled


def shown(node: Column, fields: Column) -> Column:
    """A format filled with a row's fields, the answer included."""
    return filled(node, fields)


def asked(node: Column, fields: Column) -> Column:
    """A format filled up to its answer: what stands after the last hole is kept, the answer's text is not."""
    return filled(node, F.concat(fields, F.array(F.lit(""))))


def current(answer: Column, originals: Column, classes: Column) -> Column:
    """An answer under a format's own class names; where it has none the answer itself. An answer that is no class is an error."""
    at = F.array_position(originals, answer)
    unknown = F.raise_error(F.concat(F.lit("no such class: "), answer)).cast("string")
    return F.when(classes.isNull(), answer).when(at > 0, F.try_element_at(classes, at.cast("int"))).otherwise(unknown)


def _node(rows: DataFrame) -> Column:
    """The format of a row: the variant of its number of items, where formats have such."""
    known = "variants" in rows.columns and "regex_key" in rows.columns
    return F.coalesce(F.try_element_at("variants", F.col("regex_key")), F.col("node")) if known else F.col("node")


def demo_block(nodes: DataFrame, demos: DataFrame, n_shot: int) -> DataFrame:
    """``task``, ``node_id``, ``block``: the instruction and the first ``n_shot`` demonstrations in each format.

    ``nodes``: task, node_id, node, instruction; ``demos``: task, place, fields, answer. Demonstrations are joined
    by an empty line in order of ``place``. With too few demonstrations there are fewer.
    """
    each = nodes.join(demos.where(F.col("place") < n_shot), "task")
    answer = current(F.col("answer"), F.col("originals"), F.col("classes")) if "classes" in nodes.columns else F.col("answer")
    text = shown(_node(each), F.concat("fields", F.array(answer)))
    ordered = F.array_sort(F.collect_list(F.struct("place", text.alias("text"))))
    return each.groupBy("task", "node_id", "instruction").agg(F.array_join(F.transform(ordered, lambda x: x["text"]), "\n\n").alias("shots")).select("task", "node_id", F.concat_ws("\n\n", "instruction", "shots").alias("block"))


def full_prompts(nodes: DataFrame, rows: DataFrame, blocks: DataFrame | None) -> DataFrame:
    """``task``, ``node_id``, ``dataset_idx``, ``prompt`` of every format with every row of its task.

    Without demonstrations (``blocks`` null) the prompt is the row alone, without the instruction.
    """
    if blocks is not None:  # joined to the few formats, not to every row of them
        nodes = nodes.join(blocks.select("task", "node_id", "block"), ["task", "node_id"])
    cross = rows.join(nodes, "task")
    alone = asked(_node(cross), F.col("fields"))
    return cross.select("task", "node_id", "dataset_idx", (alone if blocks is None else F.concat_ws("\n\n", "block", alone)).alias("prompt"))


def class_map(nodes: DataFrame, original: str = "original_classes", current: str = "current_classes") -> DataFrame:
    """``node_id``, ``original``, ``current``: the two class lists side by side; lists of unequal length are an error."""
    same = F.when(F.size(original) != F.size(current), F.raise_error(F.lit("class lists differ in length")).cast("boolean")).otherwise(True)
    pairs = F.explode(F.arrays_zip(F.col(original).alias("original"), F.col(current).alias("current")))
    return nodes.where(same).select("node_id", pairs.alias("p")).select("node_id", F.col("p").getField("original").alias("original"), F.col("p").getField("current").alias("current"))


def remapped(outputs: DataFrame, mapping: DataFrame) -> DataFrame:
    """``node_id``, key columns and ``answer`` renamed to the format's classes; an answer that is none is an error."""
    out = outputs.join(mapping.withColumnRenamed("original", "answer"), ["node_id", "answer"], "left")
    unknown = F.raise_error(F.concat(F.lit("no such class: "), F.col("answer"))).cast("string")
    return out.withColumn("answer", F.coalesce("current", unknown)).drop("current")
