"""Task documents, stored formats and run documents as files."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TASK = "Definition array<string>, Instances array<struct<input:string, output:array<string>>>"
ANNOTATIONS = "annotations array<string>"
EXAMPLES = "examples map<string, struct<input:string, output:string>>"
FORMATS = "valid_value_assignments array<array<string>>, dataset_ordered_ids array<bigint>"


def one_file(spark: SparkSession, folder: str, part: str) -> str:
    """The path of the one file in ``folder`` whose name contains ``part``; none or several are an error."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    found = [s.getPath() for s in path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path) if part in s.getPath().getName()]
    if len(found) != 1:
        raise ValueError(f"{len(found)} files contain {part!r}")
    return found[0].toString()


def read_task(spark: SparkSession, path: str) -> DataFrame:
    """``pos``, ``input``, ``output`` of a task document of the first kind, in its order."""
    doc = spark.read.schema(TASK).option("multiLine", True).json(path)
    return doc.select(F.posexplode("Instances").alias("pos", "i")).select(F.col("pos").cast("bigint").alias("pos"), "i.*")


def read_definition(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TASK).option("multiLine", True).json(path).select(F.col("Definition").alias("definition"))


def read_examples(spark: SparkSession, annotations: str, examples: str) -> tuple[DataFrame, DataFrame]:
    """Instructions, and ``pos``, ``input``, ``output`` (of one element) of a task of the second kind, in file order."""
    told = spark.read.schema(ANNOTATIONS).option("multiLine", True).json(annotations)
    rows = spark.read.schema(EXAMPLES).option("multiLine", True).json(examples)
    each = rows.select(F.posexplode("examples").alias("pos", "name", "e"))
    return told, each.select(F.col("pos").cast("bigint").alias("pos"), F.col("e.input").alias("input"), F.array("e.output").alias("output"))


def write_formats(names: DataFrame, ids: DataFrame, path: str) -> None:
    """Stored formats and order; an existing file is never replaced. Bounded by the number of formats evaluated."""
    a = names.agg(F.transform(F.array_sort(F.collect_list(F.struct("cand_id", "names"))), lambda x: x["names"]).alias("valid_value_assignments"))
    b = ids.agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "row"))), lambda x: x["row"]).alias("dataset_ordered_ids"))
    a.join(b).coalesce(1).write.mode("error").json(path)


def read_formats(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FORMATS).json(path)


def run_document(acc: DataFrame, log: DataFrame, settings: dict[str, str] | None = None, trace: DataFrame | None = None) -> DataFrame:
    """One row: ``generation_order``, ``edges`` (empty), the accuracies of each node, and ``metadata``: the settings, and of
    the log how many rows of each outcome every node has; of a search (``trace``) its steps in order.

    Bounded by the number of formats and of steps.
    """
    ordered = F.map_from_entries(F.array_sort(F.collect_list(F.struct("node", F.col("gen_order").cast("int")))))
    results = F.map_from_entries(F.array_sort(F.collect_list(F.struct("node", F.array("right", "wrong", F.col("total").cast("double"))))))
    head = acc.agg(ordered.alias("generation_order"), F.array().cast("array<string>").alias("edges"), results.alias("all_structured_prompt_formats_accuracies"))
    counts = {k: F.count_if(F.col(f"is_{k}")).alias(k) for k in ("right", "wrong", "other")}
    each = log.groupBy("node_id").agg(*counts.values(), F.count("*").alias("rows")).join(acc.select("node_id", "node"), "node_id")
    nodes = each.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("node", F.struct("right", "wrong", "other", "rows").alias("counts"))))).alias("nodes"), F.sum("rows").alias("rows"))
    told = F.from_json(F.lit(json.dumps(settings or {})), "map<string,string>")
    steps = nodes.sparkSession.range(1).select(F.lit(None).cast("array<string>").alias("steps")) if trace is None else trace.agg(F.array_sort(F.collect_list(F.struct("phase", "step", "node_id", "successes", "trials", "best_so_far"))).alias("steps"))
    return head.join(nodes.join(steps).select(F.struct(told.alias("settings"), "nodes", "rows", F.col("steps").alias("thompson_sampling")).alias("metadata")))


def output_name(task: str, model: str, metric: str, n_shot: int, n_formats: int, search: str = "full") -> str:
    """A file name that tells a run's settings."""
    short = task.split("_")[0].removesuffix(".json").replace("_", "-")
    kind = "rankscore" if metric == "probability_ranking" else "genscore"
    return f"{kind}_{short}_{model.replace('/', '-')}_{n_shot}shot_{n_formats}formats_{search}.json"
