"""Queries of the operators in this subpackage and the SQL that some are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaymark.llm import copies, cut, encode, garbled, looks, pack, pairs, sentences
from quaymark.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query and, where SQL can express it, the SQL with the same columns."""

    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def _labels(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "tasks").select(F.col("task").alias("grp"), F.col("field_labels").alias("labels"))


@query("p1_found")
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return pairs.defective(table(spark, d, "instances"), table(spark, d, "logs"), table(spark, d, "tasks"))


@query("p1_labels")
def p1_labels(spark: SparkSession, d: str) -> DataFrame:
    return pairs.all_labels(table(spark, d, "instances"), table(spark, d, "logs"), table(spark, d, "tasks"))


@query("p2_found")
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return copies.copies(table(spark, d, "instances"), _labels(spark, d))


@query("p2_counts")
def p2_counts(spark: SparkSession, d: str) -> DataFrame:
    return copies.counts(copies.keyed(table(spark, d, "instances"), _labels(spark, d))).select("kept_id", "copies")


@query("p2_collisions", "select task as grp, input as h, instance_id as least, instance_id as most from instances where false")
def p2_collisions(spark: SparkSession, d: str) -> DataFrame:
    return copies.collisions(copies.keyed(table(spark, d, "instances"), _labels(spark, d)))


@query("p3_found")
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return looks.same_look(table(spark, d, "instances"))


@query("p3_consistent")
def p3_consistent(spark: SparkSession, d: str) -> DataFrame:
    return looks.consistent(table(spark, d, "instances").select("instance_id", F.col("input").alias("text")), ["instance_id"]).drop("text")


def _languages(spark: SparkSession, d: str) -> DataFrame:
    tasks = table(spark, d, "tasks").select("task", F.col("input_language").alias("lang")).dropDuplicates(["task"])
    return table(spark, d, "instances").select("instance_id", "task", F.col("input").alias("text")).join(tasks, "task", "left").select("instance_id", "lang", "text")


@query("p6_found")
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return garbled.garbled(_languages(spark, d)).select("instance_id").distinct()


@query("p6_restored")
def p6_restored(spark: SparkSession, d: str) -> DataFrame:
    return garbled.garbled(_languages(spark, d))


@query("p7_ids")
def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode.encoded(table(spark, d, "documents"))


@query("p7_roundtrip", "select doc_id, md5(coalesce(text, '')) as text_md5 from documents")
def p7_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Every text, encoded and decoded again."""
    return encode.decoded(encode.encoded(table(spark, d, "documents"))).select("doc_id", F.md5(F.encode("text", "UTF-8")).alias("text_md5"))


def _packed(spark: SparkSession, d: str) -> DataFrame:
    return pack.pack(pack.pieces(pack.sizes(table(spark, d, "documents")), table(spark, d, "containers")))


@query("p8_packed")
def p8_packed(spark: SparkSession, d: str) -> DataFrame:
    return _packed(spark, d)


@query("p8_filled")
def p8_filled(spark: SparkSession, d: str) -> DataFrame:
    return pack.filled(_packed(spark, d))


#: Limits of documents and attention cost that bind, under both rules.
LIMITED = {rule: pack.Limits(documents=24, attention=0.4, rule=rule) for rule in ("dot", "norm")}


def _limited(spark: SparkSession, d: str) -> DataFrame:
    items = pack.pieces(pack.sizes(table(spark, d, "documents")), table(spark, d, "containers"))
    by_rule = [pack.pack(items, limits=x).withColumn("rule", F.lit(rule)) for rule, x in LIMITED.items()]
    return by_rule[0].unionByName(by_rule[1])


@query("p8_limited")
def p8_limited(spark: SparkSession, d: str) -> DataFrame:
    """Packed under all three capacities by the dot-product and by the norm."""
    return _limited(spark, d)


@query("p8_violations", "select '' as rule, container_kind, 0 as container from containers where false")
def p8_violations(spark: SparkSession, d: str) -> DataFrame:
    """Containers of ``p8_limited`` that exceed a limit: none."""
    packed = _limited(spark, d)
    parts = [pack.violations(packed.where(F.col("rule") == rule), x).withColumn("rule", F.lit(rule)) for rule, x in LIMITED.items()]
    return parts[0].unionByName(parts[1])


@query("p8_unplaced", "select container_kind, 0 as doc_id from containers where false")
def p8_unplaced(spark: SparkSession, d: str) -> DataFrame:
    """Texts whose pieces in a kind of container don't make up all of their tokens: none."""
    measured = pack.sizes(table(spark, d, "documents")).groupBy("doc_id").agg(F.sum("tokens").alias("tokens"))
    kinds = table(spark, d, "containers").where("container_kind is not null and capacity > 0").select("container_kind").distinct()
    placed = _packed(spark, d).groupBy("container_kind", "doc_id").agg(F.sum("size").alias("placed"))
    wanted = measured.withColumn("one", F.lit(1)).join(kinds.withColumn("one", F.lit(1)), "one")  # a few kinds
    return wanted.join(placed, ["container_kind", "doc_id"], "full").where("not (tokens <=> placed)").select("container_kind", "doc_id")


@query("p9_found")
def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return sentences.split_sentences(table(spark, d, "documents"))


def _truncated(spark: SparkSession, d: str) -> DataFrame:
    return cut.truncated(table(spark, d, "logs"), table(spark, d, "tasks"), table(spark, d, "instances"))


@query("p5_found")
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _truncated(spark, d)


@query("p5_share")
def p5_share(spark: SparkSession, d: str) -> DataFrame:
    return cut.shares(table(spark, d, "logs"), table(spark, d, "runs"), _truncated(spark, d))


@query("p5_generations", "select model_name, count(*) as generations from (select distinct on (log_id) log_id, run_id from logs where log_id is not null) left join runs using (run_id) group by model_name")
def p5_generations(spark: SparkSession, d: str) -> DataFrame:
    """What the shares are shares of."""
    return p5_share(spark, d).select("model_name", "generations")
