"""Format assignments and nodes: product, sample, neighbours, edges, paths, distinct rendered formats.

Assignments are rows of slot indices. Whatever isn't needed whole is addressed by its number in the product
(a mixed-radix index), so spaces of 10^12 formats are sampled without being listed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quaymark.functions.domains import DOMAINS
from quaymark.plans.grammar import Compiled, Slot, Template

#: Sampling draws this many times what it still needs, in at most so many rounds.
SURPLUS, ROUNDS = 4, 24


def _digits(df: DataFrame, slots: list[Slot], index: str) -> DataFrame:
    """With the slot values of the member of the product at ``index``, the last slot turning fastest."""
    step = 1
    cols = []
    for s in reversed(slots):
        n = len(DOMAINS[s.kind])
        cols.append(F.expr(f"cast(({index} div {step}) % {n} as int)").alias(s.column))
        step *= n
    return df.select("*", *cols[::-1])


def product(spark: SparkSession, template: Template) -> DataFrame:
    """``cand_id`` and a column per slot: every assignment, names that occur twice included.

    The slots' domains are multiplied by arithmetic over one range, so no join is needed and any part of the
    product can be computed where it is used.
    """
    return _digits(spark.range(template.size()).withColumnRenamed("id", "cand_id"), template.slots(), "cand_id")


def valid(candidates: DataFrame, template: Template) -> DataFrame:
    """The assignments whose format keeps all rules, local refusals and global ones."""
    return candidates.where(Compiled(template).valid())


def named(assignments: DataFrame, template: Template) -> DataFrame:
    """With ``names``: the value of each slot, in slot order."""
    return assignments.withColumn("names", F.array(*(F.element_at(F.array(*map(F.lit, DOMAINS[s.kind])), F.col(s.column) + 1) for s in template.slots())))


def distinct(assignments: DataFrame, template: Template) -> DataFrame:
    """One row per assignment of values: a value that a domain lists twice counts once, under its first place."""
    slots = template.slots()
    same = [F.element_at(F.array(*(F.lit(DOMAINS[s.kind].index(v)) for v in DOMAINS[s.kind])), F.col(s.column) + 1).alias(s.column) for s in slots]
    return assignments.select("cand_id", *same).groupBy(*(s.column for s in slots)).agg(F.min("cand_id").alias("cand_id")).select("cand_id", *(s.column for s in slots))


def nodes(assignments: DataFrame, template: Template) -> DataFrame:
    """``node_id``, ``node``, ``gen_order``, ``cand_id``, ``aliases``: distinct rendered formats in order of first occurrence.

    The original format is node 0, whether or not it keeps the rules. ``aliases``: how many assignments render so.
    """
    spark = assignments.sparkSession
    made = assignments.select(Compiled(template).render().alias("node"), "cand_id")
    first = spark.range(1).select(Compiled(template, original=True).render().alias("node"), F.lit(-1).cast("bigint").alias("cand_id"))
    once = first.unionByName(made).groupBy("node").agg(F.min("cand_id").alias("cand_id"), F.count("*").alias("aliases"))
    order = F.row_number().over(Window.orderBy("cand_id")) - 1
    return once.select(F.md5(F.encode("node", "UTF-8")).alias("node_id"), "node", order.alias("gen_order"), "cand_id", "aliases")


def representations(assignments: DataFrame, template: Template) -> DataFrame:
    """``node``, ``bits``: the assignments that render to each node, in order of their number."""
    rows = named(assignments, template).select(Compiled(template).render().alias("node"), F.struct("cand_id", "names").alias("one"))
    return rows.groupBy("node").agg(F.transform(F.array_sort(F.collect_list("one")), lambda x: x["names"]).alias("bits"))


def draw(spark: SparkSession, count: int, seed: str, limit: int) -> DataFrame:
    """``draw``, ``cand_id``: uniform numbers below ``limit`` from the digest of the seed and the draw's number."""
    digest = F.expr(f"conv(substr(md5(concat('{seed}|', cast(id as string))), 1, 14), 16, 10)")
    return spark.range(count).select(F.col("id").alias("draw"), F.pmod(digest.cast("bigint"), F.lit(limit)).alias("cand_id"))


def sample(spark: SparkSession, template: Template, n: int, seed: str = "0") -> DataFrame:
    """``n`` distinct valid assignments in the order drawn, with ``draw``.

    Where the product holds no more than ``n``, all its valid assignments. Draws are bounded: if the space has
    too few valid formats, an error says so rather than drawing for ever.
    """
    slots = template.slots()
    if template.size() <= n:
        return valid(product(spark, template), template).withColumn("draw", F.col("cand_id"))
    drawn = SURPLUS * n
    for _ in range(ROUNDS):
        rows = valid(_digits(draw(spark, drawn, seed, template.size()), slots, "cand_id"), template)
        once = rows.groupBy(*(s.column for s in slots)).agg(F.min(F.struct("draw", "cand_id")).alias("first")).select(*(s.column for s in slots), "first.*")
        ranked = once.withColumn("rank", F.row_number().over(Window.orderBy("draw"))).where(F.col("rank") <= n).drop("rank")
        if ranked.count() == n:
            return ranked
        if drawn > 64 * template.size():
            break
        drawn *= 4
    raise ValueError(f"fewer than {n} valid formats were drawn")


def neighbours(assignments: DataFrame, template: Template, keep: tuple[str, ...] = ("cand_id",)) -> DataFrame:
    """Every assignment that differs from one of ``assignments`` in a single slot, by name: ``slot``, ``value`` and the slots."""
    slots = template.slots()
    changes = F.array(*(F.struct(F.lit(k).alias("slot"), F.lit(i).alias("value")) for k, s in enumerate(slots) for i, v in enumerate(DOMAINS[s.kind]) if DOMAINS[s.kind].index(v) == i))
    rows = assignments.select(*keep, *(F.col(s.column).alias(f"_{s.column}") for s in slots), F.explode(changes).alias("c")).select("*", "c.*").drop("c")
    current = F.coalesce(*(F.when(F.col("slot") == k, F.element_at(F.array(*map(F.lit, DOMAINS[s.kind])), F.col(f"_{s.column}") + 1)) for k, s in enumerate(slots)))
    new = F.coalesce(*(F.when(F.col("slot") == k, F.element_at(F.array(*map(F.lit, DOMAINS[s.kind])), F.col("value") + 1)) for k, s in enumerate(slots)))
    moved = [F.when(F.col("slot") == k, F.col("value")).otherwise(F.col(f"_{s.column}")).alias(s.column) for k, s in enumerate(slots)]
    return rows.where(current != new).select(*keep, "slot", "value", *(F.col(f"_{s.column}") for s in slots), *moved)


def _turn(k: Column, salt: str, n: Column | int) -> Column:
    digest = F.conv(F.substring(F.md5(F.concat(F.lit(f"{salt}|"), k.cast("string"))), 1, 8), 16, 10).cast("bigint")
    return F.pmod(digest, n if isinstance(n, Column) else F.lit(n))


def edges(spark: SparkSession, template: Template, n: int, seed: str = "0", keep: bool = False) -> DataFrame:
    """``n`` edges of two valid assignments that differ in one slot, edge i in slot i modulo their number, no assignment twice.

    ``edge``, ``slot``, ``node_a``, ``node_b``; with ``keep`` also the assignments as JSON, ``a`` and ``b``. Fewer are
    returned only where the space is used up.
    """
    slots = template.slots()
    start = sample(spark, template, min(3 * n, max(1, template.size() // 8)), seed)
    ordered = start.withColumn("k", F.row_number().over(Window.orderBy("draw")) - 1)
    near = neighbours(ordered, template, keep=("k", "cand_id")).where(F.col("slot") == F.pmod("k", F.lit(len(slots))))
    near = valid(near, template).withColumn("rank", F.row_number().over(Window.partitionBy("k").orderBy(_turn(F.concat_ws("|", "k", "value"), seed, 1 << 30), "value")))
    a = F.struct(*(F.col(f"_{s.column}").alias(s.column) for s in slots))
    b = F.struct(*(F.col(s.column) for s in slots))
    pairs = near.where("rank = 1").select("k", "slot", F.to_json(a).alias("a"), F.to_json(b).alias("b"), Compiled(template, prefix="_").render().alias("node_a"), Compiled(template).render().alias("node_b"))
    ends = pairs.select("k", F.explode(F.array("a", "b")).alias("end")).groupBy("end").agg(F.min("k").alias("k"))
    free = pairs.join(ends.select(F.col("end").alias("a"), F.col("k").alias("ka")), "a").join(ends.select(F.col("end").alias("b"), F.col("k").alias("kb")), "b").where("k = ka and k = kb")
    turn = F.row_number().over(Window.partitionBy("slot").orderBy("k")) - 1
    out = free.withColumn("edge", (turn * len(slots) + F.col("slot")).cast("int")).where(F.col("edge") < n)
    return out.select("edge", "slot", "node_a", "node_b", *(("a", "b") if keep else ()))


def paths(start: DataFrame, template: Template, seed: str = "0", most: int = 300, keep: bool = False) -> DataFrame:
    """Two steps from each of the first ``most`` assignments: three distinct formats, one slot changed at a time.

    ``cand_id``, ``node_0``, ``node_1``, ``node_2`` (with ``keep`` also the assignments as JSON, ``v0``, ``v1``, ``v2``); of all such paths of a start the one whose digest is least.
    """
    slots = template.slots()
    heads = start.withColumn("k", F.row_number().over(Window.orderBy("cand_id"))).where(F.col("k") <= most)
    one = valid(neighbours(heads, template, keep=("cand_id",)), template)
    one = one.withColumn("rank", F.row_number().over(Window.partitionBy("cand_id").orderBy(_turn(F.concat_ws("|", "cand_id", "slot", "value"), seed, 1 << 30), "slot", "value"))).where("rank <= 8")
    first = one.select("cand_id", F.col("rank").alias("turn"), Compiled(template, prefix="_").render().alias("node_0"), Compiled(template).render().alias("node_1"), F.to_json(F.struct(*(F.col(f"_{s.column}").alias(s.column) for s in slots))).alias("v0"), *(F.col(s.column) for s in slots))
    two = valid(neighbours(first, template, keep=("cand_id", "turn", "node_0", "node_1", "v0")), template)
    two = two.where(F.to_json(F.struct(*(F.col(s.column) for s in slots))) != F.col("v0"))
    best = Window.partitionBy("cand_id").orderBy("turn", _turn(F.concat_ws("|", "cand_id", "slot", "value"), seed + "'", 1 << 30), "slot", "value")
    v1, v2 = F.struct(*(F.col(f"_{s.column}").alias(s.column) for s in slots)), F.struct(*(F.col(s.column) for s in slots))
    last = two.withColumn("node_2", Compiled(template).render()).withColumn("rank", F.row_number().over(best)).where("rank = 1")
    return last.select("cand_id", "node_0", "node_1", "node_2", *(("v0", F.to_json(v1).alias("v1"), F.to_json(v2).alias("v2")) if keep else ()))


def lookup(names: DataFrame, domains: DataFrame) -> DataFrame:
    """``action_type``, ``name`` to ``idx``: the first place of a name; a name that its domain lacks is an error."""
    first = domains.groupBy("action_type", "name").agg(F.min("idx").alias("idx"))
    found = names.join(first, ["action_type", "name"], "left")
    unknown = F.raise_error(F.concat(F.lit("no such value: "), F.col("name"))).cast("int")
    return found.withColumn("idx", F.coalesce("idx", unknown))


def from_names(stored: DataFrame, template: Template) -> DataFrame:
    """Assignments from the ``names`` of their values (``cand_id``): each name's first place in its domain."""
    slots = template.slots()

    def place(k: int, slot: Slot) -> Column:
        name = F.try_element_at("names", F.lit(k + 1))
        at = F.array_position(F.array(*map(F.lit, DOMAINS[slot.kind])), name)
        return F.when(at > 0, (at - 1).cast("int")).otherwise(F.raise_error(F.concat(F.lit("no such value: "), F.coalesce(name, F.lit("null")))).cast("int")).alias(slot.column)

    return stored.select("cand_id", *(place(k, s) for k, s in enumerate(slots)))


def from_json(rows: DataFrame, template: Template, column: str = "v") -> DataFrame:
    """Assignments from JSON of their slots (``cand_id``, ``column``)."""
    kinds = ", ".join(f"{s.column} int" for s in template.slots())
    return rows.select("cand_id", F.from_json(column, kinds).alias("x")).select("cand_id", "x.*")
