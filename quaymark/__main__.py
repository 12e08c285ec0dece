"""Command line: measure how a task's accuracy moves with the format of its prompts.

    python -m quaymark --tasks FOLDER --task task065_ --formats 9 --out FOLDER

Give one of --formats, --edges and --paths. With --stored, formats and the order of the data are taken from that file
where it exists, else sampled and written there.
"""

from __future__ import annotations

import argparse
import importlib
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaymark.operators import dataset, formats, scoring
from quaymark.plans import run as runs
from quaymark.plans import search
from quaymark.plans.templates import UNFORMATTED, number_of, template_of
from quaymark.session import cut
from quaymark.sources import task_files


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("quaymark", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("--tasks", required=True, help="folder of task files")
    p.add_argument("--task", required=True, help="part of the name of one task file, or of a file of examples with --annotations")
    p.add_argument("--annotations", help="folder of instructions, for tasks whose files only hold examples")
    p.add_argument("--model", default="mock", help="'mock', or module:function that makes a backend")
    p.add_argument("--metric", default="exact_prefix_matching", choices=("exact_prefix_matching", "probability_ranking"))
    p.add_argument("--formats", type=int)
    p.add_argument("--edges", type=int)
    p.add_argument("--paths", type=int)
    p.add_argument("--stored", help="file of formats and order")
    p.add_argument("--shots", type=int, default=1)
    p.add_argument("--samples", type=int, default=1000)
    p.add_argument("--batch", type=int, default=20)
    p.add_argument("--budget", type=int, help="model calls of a search; without it every format is evaluated in full")
    p.add_argument("--seed", default="0")
    p.add_argument("--out", required=True, help="folder of run documents")
    return p


def _loaded(spark: SparkSession, a: argparse.Namespace, name: str) -> tuple[DataFrame, str]:
    """The instances of a task and its instruction: the longest annotation in upper case, or the first definition."""
    if a.annotations:
        told, rows = task_files.read_examples(spark, task_files.one_file(spark, a.annotations, a.task), task_files.one_file(spark, a.tasks, a.task))
        told = dataset.longest_instruction(told.select(F.lit(name).alias("task"), F.col("annotations").alias("definition"))).select("instruction")
    else:
        path = task_files.one_file(spark, a.tasks, a.task)
        rows, told = task_files.read_task(spark, path), task_files.read_definition(spark, path).select(F.try_element_at("definition", F.lit(1)).alias("instruction"))
    first = told.first()
    return rows.withColumn("task", F.lit(name)).withColumn("instance_id", F.col("pos")), first.instruction if first and first.instruction else ""


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def command(spark: SparkSession, argv: list[str]) -> str:
    """Runs what the arguments ask for; the path of the run document."""
    a = _parser().parse_args(argv)
    path = task_files.one_file(spark, a.tasks, a.task)
    name = path.rsplit("/", 1)[-1]
    instances, instruction = _loaded(spark, a, name)
    bare = bool(a.annotations) or number_of(name) in UNFORMATTED
    template = template_of("task0_", frozenset({0})) if bare else template_of(name)
    s = runs.Settings(name, template, a.model, a.metric, a.shots, a.samples, a.batch, a.formats, a.edges, a.paths, a.budget, a.seed)
    s.check()
    original = None if bare else runs.input_formats(spark, template)
    given = order = None
    if a.stored:
        if not _exists(spark, a.stored):
            made = cut(runs.assignments(spark, s))
            ids = dataset.permuted(instances, s.seed).select("place", F.col("pos").alias("row"))
            task_files.write_formats(formats.named(made, template).select("cand_id", "names"), ids, a.stored)
        kept = cut(task_files.read_formats(spark, a.stored))
        given = formats.from_names(kept.select(F.posexplode("valid_value_assignments").alias("cand_id", "names")).withColumn("cand_id", F.col("cand_id").cast("bigint")), template)
        if s.formats is not None:
            given = given.where(F.col("cand_id") < s.formats)
        order = kept.select(F.posexplode("dataset_ordered_ids").alias("place", "row"))
    factory = None
    if a.model != "mock":
        module, _, made_by = a.model.partition(":")
        factory = getattr(importlib.import_module(module), made_by)
    few = dataset.few_classes(instances).first()
    if a.metric == "probability_ranking" and not few.rankable:
        raise ValueError(f"{few.classes} different answers are too many to rank")
    classes = [r[0] for r in instances.select(F.try_element_at("output", F.lit(1)).alias("c")).where("c is not null").distinct().orderBy("c").limit(99).collect()] if few.classes < 100 else None
    log = cut(runs.scored_log(runs.answered(spark, instances, instruction, s, classes, factory, original, given, order), s))
    found = trace = None
    if s.budget is not None:
        arms = search.outcomes(log, s.batch, s.budget // s.batch)
        first = log.where("gen_order = 0").select("node_id").first()
        found = search.search_arms(arms, s.budget, int(s.seed) if s.seed.isdigit() else 0, original=first.node_id)
        trace = spark.createDataFrame(found.trace, "phase string, step int, node_id string, successes bigint, trials bigint, best_so_far string")
    acc = scoring.accuracy(log, "node_id", "node", "gen_order")
    settings = {k: str(v) for k, v in asdict(s).items() if k not in ("template", "options")}
    out = f"{a.out}/{s.name()}"
    task_files.run_document(acc, log, settings, trace).coalesce(1).write.mode("overwrite").json(out)
    ends = (found.best("highest"), found.best("lowest")) if found else tuple(scoring.best_worst(acc).first())
    named = {r.node_id: (r.node, r.right, r.wrong, r.total) for r in acc.where(F.col("node_id").isin(*ends)).collect()}
    for label, node in zip(("best", "worst"), ends, strict=True):
        print(label, *named.get(node, (node,)))
    return out


def main() -> None:
    import sys

    command(SparkSession.builder.appName("quaymark").getOrCreate(), sys.argv[1:])


if __name__ == "__main__":
    main()
