"""One run: formats of a task, prompts, answers, accuracy, best and worst; exhaustive or on a budget."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaymark.functions.text import named_fill
from quaymark.operators import dataset, extract, formats, model, prompts, scoring
from quaymark.plans import search
from quaymark.plans.grammar import Compiled, Template
from quaymark.plans.templates import OPEN_NAMES
from quaymark.session import cut
from quaymark.sources.task_files import output_name


@dataclass(frozen=True)
class Settings:
    """What a run is asked for; ``check`` refuses what can't be kept."""

    task: str
    template: Template
    model_name: str = "mock"
    metric: str = "exact_prefix_matching"
    n_shot: int = 1
    samples: int = 1000
    batch: int = 20
    formats: int | None = 9
    edges: int | None = None
    paths: int | None = None
    budget: int | None = None
    seed: str = "0"
    pool: int = dataset.POOL
    options: dict = field(default_factory=dict)

    def check(self) -> None:
        if sum(x is not None for x in (self.formats, self.edges, self.paths)) != 1:
            raise ValueError("exactly one of formats, edges and paths")
        if self.samples % self.batch:
            raise ValueError("samples must be whole batches")
        if self.n_shot > self.pool:
            raise ValueError("more shots than the pool holds")
        if self.metric not in ("exact_prefix_matching", "probability_ranking"):
            raise ValueError(f"no such metric: {self.metric}")
        if self.budget is not None:
            search.check_budget(self.budget, self.batch, self.samples)

    def name(self) -> str:
        return output_name(self.task, self.model_name, self.metric, self.n_shot, self.formats or self.edges or self.paths or 0, "full" if self.budget is None else "spread")


def assignments(spark: SparkSession, s: Settings) -> DataFrame:
    """The formats asked for as rows of slot values in their order (``cand_id``): sampled, or the ends of edges, or the stops of paths."""
    if s.edges is not None:
        pairs = formats.edges(spark, s.template, s.edges, s.seed, keep=True)
        ends = pairs.select(F.posexplode(F.array("a", "b")).alias("at", "v"), "edge")
        return formats.from_json(ends.select((F.col("edge") * 2 + F.col("at")).cast("bigint").alias("cand_id"), "v"), s.template)
    if s.paths is not None:
        steps = formats.paths(formats.sample(spark, s.template, s.paths, s.seed), s.template, s.seed, s.paths, keep=True)
        stops = steps.select(F.posexplode(F.array("v0", "v1", "v2")).alias("at", "v"), F.col("cand_id").alias("k"))
        return formats.from_json(stops.select((F.col("k") * 3 + F.col("at")).cast("bigint").alias("cand_id"), "v"), s.template)
    drawn = formats.sample(spark, s.template, s.formats or 0, s.seed) if s.formats else formats.product(spark, s.template).where("false").withColumn("draw", F.col("cand_id"))
    return drawn.drop("cand_id").withColumnRenamed("draw", "cand_id")


def chosen(spark: SparkSession, s: Settings, definition: str = "", given: DataFrame | None = None) -> DataFrame:
    """The original format and those asked for (or ``given``): ``node_id``, ``node`` with its answer, ``gen_order``, ``aliases``;
    the ``instruction`` with its signs, and the names of the ``classes`` beside the ``originals`` (null without options)."""
    classed = s.template.class_template is not None
    none = F.lit(None).cast("array<string>")

    def made(compiled: Compiled) -> list:
        variants = F.create_map(*(x for n in s.template.lengths for x in (F.lit(n), compiled.render(length=n)))) if s.template.lengths else F.lit(None).cast("map<int,string>")
        told = named_fill(F.lit(definition), compiled.enumeration_names())
        return [compiled.render().alias("node"), variants.alias("variants"), told.alias("instruction"), (compiled.classes() if classed else none).alias("classes")]

    rows = (assignments(spark, s) if given is None else given).select("cand_id", *made(Compiled(s.template)))
    first = spark.range(1).select(F.lit(-1).cast("bigint").alias("cand_id"), *made(Compiled(s.template, original=True)))
    kept = [F.min_by(c, "cand_id").alias(c) for c in ("instruction", "classes")]
    once = first.unionByName(rows).withColumn("variants", F.array_sort(F.map_entries("variants")))
    once = once.groupBy("node").agg(F.min("cand_id").alias("cand_id"), F.count("*").alias("aliases"), *kept, F.min_by("variants", "cand_id").alias("variants")).withColumn("variants", F.map_from_entries("variants"))
    rank = F.row_number().over(formats.Window.orderBy("cand_id", "node")) - 1
    originals = Compiled(s.template, original=True).classes() if classed else none
    return once.select(F.md5(F.encode("node", "UTF-8")).alias("node_id"), "node", rank.alias("gen_order"), "cand_id", "aliases", "instruction", "classes", "variants", originals.alias("originals"))


def input_formats(spark: SparkSession, template: Template) -> dict[int | None, str]:
    """The format that inputs of a task are written in: the original without its output; one for each number of items where that varies."""
    root = template.root
    seen = replace(template, root=replace(root, children=tuple(c for c in root.children if not getattr(c, "output", False))))
    compiled = Compiled(seen, original=True)
    lengths: tuple[int | None, ...] = template.lengths or (None,)
    row = spark.range(1).select(*(compiled.render(length=n).alias(str(n)) for n in lengths)).first()
    return dict(zip(lengths, row, strict=True))


def prepared(instances: DataFrame, s: Settings, original: str | dict[int | None, str] | None = None, order: DataFrame | None = None) -> DataFrame:
    """Parsed rows of the task in their order: part, dataset_idx, fields, answer; and ``eval_pos``, counted over the
    parsed rows of each part, so that what can't be parsed takes no sample's and no demonstration's place.

    ``original``: the format the inputs are written in, up to the answer, or one for each number of items; without
    one the whole input is the field. ``order``: a stored order (``place``, ``row``: the instance's pos).
    """
    mine = instances.where(F.col("task") == s.task)
    rows = dataset.permuted(mine, s.seed) if order is None else dataset.applied(mine.withColumn("row", F.col("pos").cast("bigint")), order, "row")
    rows = dataset.split(rows, s.pool)
    forms = {None: original} if isinstance(original, str) else original
    rows = extract.extract(rows, forms) if forms else rows.withColumn("fields", F.array("input")).withColumn("regex_key", F.lit(None).cast("int"))
    rows = rows.where(F.col("fields").isNotNull() & (F.size("output") == 1))
    rows = rows.withColumn("answer", F.try_element_at("output", F.lit(1)))
    most = max(s.samples, s.n_shot)
    parts = [extract.first_parsed(rows.where(F.col("part") == p), most, order="dataset_idx") for p in ("demo", "test")]
    return parts[0].unionByName(parts[1])


def answered(spark: SparkSession, instances: DataFrame, definition: str, s: Settings, classes: list[str] | None, factory: Callable | None = None, original: str | dict[int | None, str] | None = None, given: DataFrame | None = None, order: DataFrame | None = None) -> DataFrame:
    """A log row for every format and test row: node_id, node, eval_pos, generation, answer, output_classes."""
    s.check()
    ranked = s.metric == "probability_ranking"
    if ranked and (factory is None or not (classes or s.template.class_template) or len(classes or ()) >= 100):
        raise ValueError("ranking needs a model that gives logits, and classes, fewer than 100")
    rows = prepared(instances, s, original, order)
    nodes = chosen(spark, s, definition, given).withColumn("task", F.lit(s.task))
    test = dataset.interval(rows.where("part = 'test'"), 0, s.samples)
    demos = rows.where("part = 'demo'").withColumn("place", F.col("eval_pos")).where(F.col("place") < s.n_shot)
    if s.n_shot and (found := demos.count()) < s.n_shot:
        raise ValueError(f"{found} of {s.n_shot} demonstrations")
    blocks = prompts.demo_block(nodes, demos, s.n_shot) if s.n_shot else None
    asked = prompts.full_prompts(nodes, test, blocks).join(test.select("dataset_idx", "eval_pos", "instance_id", "answer"), "dataset_idx").join(nodes.select("node_id", "node", "gen_order", "classes", "originals"), "node_id")
    asked = asked.withColumn("answer", prompts.current(F.col("answer"), F.col("originals"), F.col("classes")))
    asked = asked.withColumn("output_classes", F.coalesce("classes", F.array(*map(F.lit, classes)) if classes else F.array("answer"))).drop("classes", "originals")
    if ranked:
        logits = model.rank_classes(asked, factory)
        return logits.withColumn("generation", F.element_at("output_classes", (scoring.argmax(F.col("logits"), last=False) + 1).cast("int")))
    if factory is None:
        return asked.withColumn("generation", model.mock("node", F.col("instance_id").cast("string"), F.col("answer"), F.col("output_classes")))
    return model.generate(asked, factory, model.max_tokens(s.task, OPEN_NAMES))


def scored_log(log: DataFrame, s: Settings) -> DataFrame:
    """The log with ``is_right``, ``is_wrong``, ``is_other`` by the run's metric."""
    if s.metric != "probability_ranking":
        return scoring.scored(log)
    log = log.withColumn("is_right", F.col("generation").eqNullSafe(F.col("answer")))  # the answer is one of the classes
    return log.withColumn("is_wrong", ~F.col("is_right")).withColumn("is_other", F.lit(False))


def run(spark: SparkSession, instances: DataFrame, definition: str, s: Settings, classes: list[str] | None = None, factory: Callable | None = None, original: str | dict[int | None, str] | None = None, given: DataFrame | None = None, order: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Accuracy of every node evaluated, and the best and worst; on a budget only what it paid for is played."""
    log = answered(spark, instances, definition, s, classes, factory, original, given, order)
    log = scored_log(log, s)
    if s.budget is None:
        acc = scoring.accuracy(log, "node_id", "node")
        return acc, scoring.best_worst(acc)
    log = cut(log.select("node_id", "eval_pos", "gen_order", "is_right"))
    original = log.where("gen_order = 0").select("node_id").first()
    arms = search.outcomes(log, s.batch, s.budget // s.batch)
    found = search.search_arms(arms, s.budget, int(s.seed) if s.seed.isdigit() else 0, original=original.node_id)
    acc = spark.createDataFrame([(n, int(a), int(b)) for n, a, b in zip(found.nodes, found.successes, found.trials, strict=True) if b], "node_id string, successes bigint, trials bigint")
    return acc, spark.createDataFrame([(found.best("highest"), found.best("lowest"))], "best string, worst string")
