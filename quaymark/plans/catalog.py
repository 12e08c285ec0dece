"""Queries of the core and the SQL they are checked against."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaymark.functions import domains
from quaymark.functions import text as text_functions
from quaymark.functions.text import named_fill
from quaymark.operators import dataset, extract, formats, model, prompts, scoring, split_rows
from quaymark.plans import search
from quaymark.plans.grammar import Compiled, Items, Template
from quaymark.plans.templates import CATALOGUE, TASKS
from quaymark.session import folder
from quaymark.sources import task_files
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


@query("p4_found", split_rows.FOUND_SQL)
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return split_rows.rejects(table(spark, d, "raw_instances"), table(spark, d, "tasks"))


@query("p4_loaded", split_rows.LOADED_SQL)
def p4_loaded(spark: SparkSession, d: str) -> DataFrame:
    return split_rows.loadable(table(spark, d, "raw_instances"), table(spark, d, "tasks"))


@query("p4_reasons", f"select reason, count(*) as records from ({split_rows.FOUND_SQL}) group by reason")
def p4_reasons(spark: SparkSession, d: str) -> DataFrame:
    return p4_found(spark, d).groupBy("reason").agg(F.count("*").alias("records"))


# --- instances: order, parts, instructions -----------------------------------------------------------------------


def _instances(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "instances")


_PLACE = "row_number() over (partition by task order by md5('0|' || instance_id), instance_id) - 1"


@query("instances_from_documents", "select doc_id as pos, text as input, concat_ws('', lang) as answer, 1 as outputs from documents")
def instances_from_documents(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("pos"), F.col("text").alias("input"), F.array("lang").alias("output"))
    return rows.select("pos", "input", F.coalesce(F.try_element_at("output", F.lit(1)), F.lit("")).alias("answer"), F.size("output").alias("outputs"))


@query("permute_rows", f"select instance_id, task, {_PLACE} as place from instances")
def permute_rows(spark: SparkSession, d: str) -> DataFrame:
    return dataset.permuted(_instances(spark, d)).select("instance_id", "task", "place")


@query(
    "demo_test_split",
    f"select instance_id, case when place < 10 then 'demo' else 'test' end as part, case when place < 10 then place else place - 10 end as dataset_idx from (select instance_id, {_PLACE} as place from instances)",
)
def demo_test_split(spark: SparkSession, d: str) -> DataFrame:
    return dataset.split(dataset.permuted(_instances(spark, d))).select("instance_id", "part", "dataset_idx")


@query("interval_slice", f"select instance_id, place - 10 as dataset_idx from (select instance_id, {_PLACE} as place from instances) where place - 10 >= 20 and place - 10 < 40")
def interval_slice(spark: SparkSession, d: str) -> DataFrame:
    test = dataset.split(dataset.permuted(_instances(spark, d))).where("part = 'test'")
    return dataset.interval(test, 20, 20, "dataset_idx").select("instance_id", "dataset_idx")


@query("llm_batches", f"select task, place // 32 as batch, count(*) as n from (select task, {_PLACE} as place from instances) group by 1, 2")
def llm_batches(spark: SparkSession, d: str) -> DataFrame:
    return dataset.permuted(_instances(spark, d)).groupBy("task", F.expr("place div 32").alias("batch")).agg(F.count("*").alias("n"))


@query("stored_order", f"select place, instance_id, md5(coalesce(input, '')) as input_md5 from (select instance_id, input, {_PLACE} as place from instances)")
def stored_order(spark: SparkSession, d: str) -> DataFrame:
    rows = _instances(spark, d)
    order = dataset.permuted(rows).select("place", "instance_id")
    return dataset.applied(rows.select("instance_id", "input"), order, "instance_id").select("place", "instance_id", F.md5(F.encode(F.coalesce("input", F.lit("")), "UTF-8")).alias("input_md5"))


@query(
    "instruction_longest",
    r"select task, arg_max(text, (length(text), -k)) as instruction from (select task, unnest(definition) as text, generate_subscripts(definition, 1) as k from tasks) where regexp_matches(text, '^\p{Lu}') group by task",
)
def instruction_longest(spark: SparkSession, d: str) -> DataFrame:
    return dataset.longest_instruction(table(spark, d, "tasks"))


@query("output_cardinality_guard", "select task, count(distinct output[1]) as classes, count(distinct output[1]) < 10 as rankable from instances group by task")
def output_cardinality_guard(spark: SparkSession, d: str) -> DataFrame:
    return dataset.few_classes(_instances(spark, d))


# --- extraction ---------------------------------------------------------------------------------------------------

_TWO = "Passage: {}\nQuestion: {}"
_CHOICE = {n: "Question: {} Options: " + " ".join(f"({chr(65 + k)}) " + "{}" for k in range(n)) for n in (2, 3, 4)}


def _sql_text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _sql_fields(template: str) -> str:
    p = _sql_text(extract.pattern(template))
    return f"case when regexp_matches(input, {p}) then [{', '.join(f'regexp_extract(input, {p}, {i + 1})' for i in range(template.count('{}')))}] end"


@query("field_extract", f"select instance_id, array_to_string(f, '|') as fields from (select instance_id, {_sql_fields(_TWO)} as f from instances) where f is not null")
def field_extract(spark: SparkSession, d: str) -> DataFrame:
    out = extract.extract(_instances(spark, d), {None: _TWO}).where("fields is not null")
    return out.select("instance_id", F.array_join("fields", "|").alias("fields"))


@query(
    "field_extract_variable",
    f"select instance_id, array_to_string(coalesce({', '.join(_sql_fields(_CHOICE[n]) for n in (4, 3, 2))}), '|') as fields, case {' '.join(f'when regexp_matches(input, {_sql_text(extract.pattern(_CHOICE[n]))}) then {n}' for n in (4, 3, 2))} end as regex_key from instances where regexp_matches(input, {_sql_text(extract.pattern(_CHOICE[2]))})",
)
def field_extract_variable(spark: SparkSession, d: str) -> DataFrame:
    out = extract.extract(_instances(spark, d), dict(_CHOICE)).where("fields is not null")
    return out.select("instance_id", F.array_join("fields", "|").alias("fields"), "regex_key")


@query("extract_first_n", f"select instance_id, eval_pos from (select instance_id, row_number() over (partition by task order by pos) - 1 as eval_pos from (select *, {_sql_fields(_TWO)} as f from instances) where f is not null) where eval_pos < 50")
def extract_first_n(spark: SparkSession, d: str) -> DataFrame:
    return extract.first_parsed(extract.extract(_instances(spark, d), {None: _TWO}), 50).select("instance_id", "eval_pos")


@query(
    "unparseable_report",
    f"select instance_id, array_to_string(list_sort(list_filter(list_distinct(string_split(input, '')), lambda c: c <> '' and not regexp_matches(c, {_sql_text('[' + extract.ALLOWED + ']')}))), '') as characters from instances where input is not null and not regexp_matches(input, {_sql_text(extract.pattern(_TWO))})",
)
def unparseable_report(spark: SparkSession, d: str) -> DataFrame:
    return extract.unparsed(extract.extract(_instances(spark, d), {None: _TWO}), "instance_id")


@query("extract_roundtrip", "select 0 as broken")
def extract_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    out = extract.extract(_instances(spark, d), {None: _TWO}).where("fields is not null")
    return out.agg(F.count_if(extract.rendered(out, _TWO) != F.col("input")).cast("int").alias("broken"))


# --- formats ------------------------------------------------------------------------------------------------------

_ONE = CATALOGUE["one_field"]


def _values(rows: list[tuple]) -> str:
    cell = lambda v: str(v) if isinstance(v, int) else _sql_text(v)
    return "(values " + ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in rows) + ")"


_CASED = list(zip(*(domains.cased(x) for x in ("Sentence", "Answer")), strict=True))
_PRODUCT = f"""
select (sp.i * 15 + se.i) * 4 + ca.i as cand_id, sp.i as sp, se.i as se, ca.i as ca, sp.v as space, se.v as separator, ca.v as casing,
       ca.a || se.v || '{{}}' || sp.v || ca.b || se.v || '{{}}' as node,
       se.v <> '' and sp.v <> '' and (contains(sp.v, chr(10)) or not contains(se.v, chr(10))) as ok
from {_values(list(enumerate(domains.SPACES)))} sp(i, v), {_values(list(enumerate(domains.SEPARATORS)))} se(i, v),
     {_values([(i, c, *_CASED[i]) for i, c in enumerate(domains.CASINGS)])} ca(i, v, a, b)
"""


def _valid(spark: SparkSession) -> DataFrame:
    return formats.valid(formats.product(spark, _ONE), _ONE)


@query("format_product", f"select cand_id, array_to_string([space, separator, casing], '|') as names from ({_PRODUCT})")
def format_product(spark: SparkSession, d: str) -> DataFrame:
    return formats.named(formats.product(spark, _ONE), _ONE).select("cand_id", F.array_join("names", "|").alias("names"))


@query("format_valid", f"select cand_id, node from ({_PRODUCT}) where ok")
def format_valid(spark: SparkSession, d: str) -> DataFrame:
    return _valid(spark).select("cand_id", Compiled(_ONE).render().alias("node"))


_NODES = f"""
select md5(node) as node_id, node, row_number() over (order by min(cand_id)) - 1 as gen_order, count(*) as aliases
from (select node, cand_id from ({_PRODUCT}) where ok union all select 'Sentence: {{}}' || chr(10) || 'Answer: {{}}', -1) group by node
"""


@query("format_nodes", _NODES)
def format_nodes(spark: SparkSession, d: str) -> DataFrame:
    return formats.nodes(_valid(spark), _ONE).drop("cand_id")


@query("bit_representations", f"select node, array_to_string(list(array_to_string([space, separator, casing], '|') order by cand_id), ' & ') as bits from ({_PRODUCT}) where ok group by node")
def bit_representations(spark: SparkSession, d: str) -> DataFrame:
    out = formats.representations(_valid(spark), _ONE)
    return out.select("node", F.array_join(F.transform("bits", lambda b: F.array_join(b, "|")), " & ").alias("bits"))


@query("space_size", "select * from " + _values([(k, t.size()) for k, t in CATALOGUE.items()]) + " t(template, formats)")
def space_size(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.createDataFrame([(k, [len(domains.DOMAINS[s.kind]) for s in t.slots()]) for k, t in CATALOGUE.items()], "template string, sizes array<bigint>")
    return rows.select("template", F.aggregate("sizes", F.lit(1).cast("bigint"), lambda a, x: a * x).alias("formats"))


# The original formats of the tasks, those of varying length with two items.
_ORIGINALS = [
    (18, "Sentence: {}\nQuestion: {}\nAnswer: {}"),
    (27, "Passage: {}\nQuestion: {}\nAnswer: {}"),
    (50, "Sentence: {} \nQuestion: {} \nAnswer: {}"),
    (65, "Sentence 1: {} \n Sentence 3: {} \n Sentence 4: {} \n Sentence 5: {} \n Option 1: {} \n Option 2: {} \n Answer: {}"),
    (69, "Beginning: {} Middle 1: {} Middle 2: {} Ending: {} Answer: {}"),
    (84, "Passage: Fact 1- {} Fact 2- {} Question: {} Answer: {} Final Output: {}"),
    (113, "Sentence: {}\nAnswer: {}"),
    (118, "{}\n(A){} (B){} (C){} (D){} (E){}\nAnswer: {}"),
    (133, "Sentence: {}\n Reason: {}\n Question: {}\n Answer: {}"),
    (137, "Prompt: {} \nCompletion A: {} \nCompletion B: {} \nAnswer: {}"),
    (190, "Sentence 1: {} Sentence 2: {} \n Answer: {}"),
    (213, "Title: {} Sentence 1: {} Sentence 2: {} Sentence 3: {} Sentence 4: {} Choices: a. {} b. {} Answer: {}"),
    (220, "Sentence 1: {} Sentence 2: {} Sentence 3: {} Sentence 4: {} Sentence 5: {} Choices: a. {} b. {} Answer: {}"),
    (277, "Context: {}\nAnswer: {}"),
    (279, "Passage: {}\nAnswer: {}"),
    (296, "Sentence1: {} Sentence2: {} \n (A) {} (B) {} \n Answer: {}"),
    (309, "Article: {}\n Question: {}\n Options: (A) {} (B) {} (C) {} (D) {}\n Answer: {}"),
    (318, "Target: {} \n{} \nAnswer: {}"),
    (322, "Comment: {}\nAnswer: {}"),
    (333, "Post: {}\nAnswer: {}"),
    (385, "Context: {} \n Question: {} \n Options: (A) {} (B) {} (C) {} \n Answer: {}"),
    (491, "Sentence: {} Question: {} Answer: {}"),
    (501, "CLAIM : {}. POST : {}. ANSWER : {}"),
    (697, "{}\n(A){} (B){} (C){} (D){}\nAnswer: {}"),
    (903, "Review: {}\nPolarity: {}\nAnswer: {}"),
    (905, "Tweet: {}\nLabel: {}\nAnswer: {}"),
    (1135, "Question: {} \n Options: A {} B {} C {} D {} E {} \n Answer: {}"),
    (1162, "Paragraph: {}\n Title: {}\n Answer: {}"),
    (1186, "System Reference: {}\nOriginal Reference: {}\nAnswer: {}"),
    (1297, "Fact1: {}, Fact2: {}, Question: {} (A) {} (B) {} (C) {} (D) {} (E) {} (F) {} (G) {} (H) {}, Answer: {}"),
    (1366, "Paragraph: {}\nClaim: {}\nAnswer: {}"),
    (1380, "Sentence: {} Question: {} (A) {} (B) {} Answer: {}"),
    (1387, "Premise: {} <sep> Hypothesis: {} <sep> Answer: {}"),
    (1419, "Problem: {} \nOptions: a ) {} , b ) {} , c ) {} , d ) {} , e ) {} \nAnswer: {}"),
    (1431, "Question: {}\n Options:  <1> {} <2> {} <3> {} <4> {} <5> {}\n Answer: {}"),
    (1587, "Abstract: {}. Title: {}. Answer: {}"),
    (1612, "sentence_A: {} sentence_B: {} \n Answer: {}"),
    (1678, "Problem: {}\nOptions: a. {}, b. {}, c. {}, d. {}, e. {}\nAnswer: {}"),
]


@query("template_originals", "select task, original from " + _values(_ORIGINALS) + " t(task, original)")
def template_originals(spark: SparkSession, d: str) -> DataFrame:
    first = {id(t): n for n, t in sorted(TASKS.items(), reverse=True)}  # a task of each shape, the one of the least number
    parts = [spark.range(1).select(F.lit(n).alias("task"), Compiled(TASKS[n], original=True).render(length=2 if TASKS[n].lengths else None).alias("original")) for n in first.values()]
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


@query("template_classes", "select * from " + _values([(65, "Option 1|Option 2"), (137, "Completion A|Completion B"), (309, "A|B|C|D"), (1431, "1|2|3|4|5")]) + " t(task, classes)")
def template_classes(spark: SparkSession, d: str) -> DataFrame:
    """The class names of tasks whose answers are options, in their original format."""
    parts = [spark.range(1).select(F.lit(n).alias("task"), F.array_join(Compiled(TASKS[n], original=True).classes(), "|").alias("classes")) for n in (65, 137, 309, 1431)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


_DOMAIN_ROWS = [(k, i, v) for k, vs in domains.DOMAINS.items() for i, v in enumerate(vs)]


@query("assignment_lookup", f"select action_type, name, min(idx) as idx, count(*) as places from {_values(_DOMAIN_ROWS)} t(action_type, idx, name) group by 1, 2")
def assignment_lookup(spark: SparkSession, d: str) -> DataFrame:
    all_ = domains.table(spark)
    return formats.lookup(all_.select("action_type", "name"), all_).groupBy("action_type", "name", "idx").agg(F.count("*").alias("places"))


@query(
    "format_sample",
    f"select draw, cand_id from (select min(draw) as draw, arg_min(cand_id, draw) as cand_id from (select id as draw, ('0x' || substr(md5('0|' || id), 1, 14))::bigint % 960 as k from range(800) t(id)) join ({_PRODUCT}) p on p.cand_id = k where ok group by sp, se, ca) order by draw limit 200",
)
def format_sample(spark: SparkSession, d: str) -> DataFrame:
    return formats.sample(spark, _ONE, 200).select("draw", "cand_id")


@query("format_edges")
def format_edges(spark: SparkSession, d: str) -> DataFrame:
    return formats.edges(spark, _ONE, 60)


@query("format_paths")
def format_paths(spark: SparkSession, d: str) -> DataFrame:
    return formats.paths(formats.sample(spark, _ONE, 200), _ONE)


def _known(spark: SparkSession) -> DataFrame:
    return formats.nodes(_valid(spark), _ONE).select("node")


@query("format_edge_rules", "select slot, 20 as edges, 0 as unsound from (values (0), (1), (2)) t(slot)")
def format_edge_rules(spark: SparkSession, d: str) -> DataFrame:
    """Of each slot's edges, how many don't join two valid assignments that differ in that slot alone, or use one that another edge uses."""
    slots = [x.column for x in _ONE.slots()]
    found = formats.edges(spark, _ONE, 60, keep=True)
    ends = found.select(F.explode(F.array("a", "b")).alias("v")).groupBy("v").agg(F.count("*").alias("uses"))
    kinds = ", ".join(f"{c} int" for c in slots)
    a, b = (F.from_json(c, kinds) for c in "ab")
    others = F.lit(True)
    for k, c in enumerate(slots):
        same = a[c].eqNullSafe(b[c])
        others = others & F.when(F.col("slot") == k, ~same).otherwise(same)
    known = _known(spark)
    out = found.join(ends.select(F.col("v").alias("a"), F.col("uses").alias("ua")), "a").join(ends.select(F.col("v").alias("b"), F.col("uses").alias("ub")), "b")
    out = out.join(known.select(F.col("node").alias("node_a"), F.lit(1).alias("ka")), "node_a", "left").join(known.select(F.col("node").alias("node_b"), F.lit(1).alias("kb")), "node_b", "left")
    sound = others & (F.col("ua") == 1) & (F.col("ub") == 1) & F.col("ka").isNotNull() & F.col("kb").isNotNull()
    return out.groupBy("slot").agg(F.count("*").alias("edges"), F.count_if(~sound).alias("unsound"))


@query("format_path_rules", "select 200 as paths, 0 as unsound")
def format_path_rules(spark: SparkSession, d: str) -> DataFrame:
    """How many paths don't go through three distinct valid assignments, one slot changed at a time."""
    slots = [x.column for x in _ONE.slots()]
    found = formats.paths(formats.sample(spark, _ONE, 200), _ONE, keep=True)
    kinds = ", ".join(f"{c} int" for c in slots)
    v = [F.from_json(f"v{k}", kinds) for k in range(3)]
    steps = [sum(((~v[k][c].eqNullSafe(v[k + 1][c])).cast("int") for c in slots), F.lit(0)) for k in range(2)]
    sound = (steps[0] == 1) & (steps[1] == 1) & (F.col("v0") != F.col("v2"))
    for k in range(3):
        found = found.join(_known(spark).select(F.col("node").alias(f"node_{k}"), F.lit(1).alias(f"k{k}")), f"node_{k}", "left")
        sound = sound & F.col(f"k{k}").isNotNull()
    return found.agg(F.count("*").alias("paths"), F.count_if(~sound).alias("unsound"))


@query(
    "format_neighbours",
    f"select a.cand_id, count(*) as neighbours, count(*) filter (b.ok) as valid from ({_PRODUCT}) a join ({_PRODUCT}) b on (a.sp <> b.sp)::int + (a.se <> b.se)::int + (a.ca <> b.ca)::int = 1 and (a.space <> b.space or a.separator <> b.separator or a.casing <> b.casing) and (b.sp <> 9 or a.sp = 9) where a.ok group by 1",
)
def format_neighbours(spark: SparkSession, d: str) -> DataFrame:
    near = formats.neighbours(_valid(spark), _ONE)
    return near.groupBy("cand_id").agg(F.count("*").alias("neighbours"), F.count_if(Compiled(_ONE).valid()).alias("valid"))


_LABELS = _values([(s, n, i, domains.number(n, i)) for s, n in enumerate(domains.NUMBERINGS) for i in range(5)])
_SIDES = _values([(w, *p.split("{}")) for w, p in enumerate(domains.WRAPPERS)])
_ITEMS = CATALOGUE["sentence_question_2"]


@query(
    "enumeration_render",
    f"select w.i as wrapper, n.s as numbering, string_agg(w.a || n.label || w.b || ' {{}}', ' ' order by n.k) as text from {_LABELS} n(s, name, k, label), {_SIDES} w(i, a, b) where n.k < 2 group by 1, 2",
)
def enumeration_render(spark: SparkSession, d: str) -> DataFrame:
    wanted = Template("items", Items("answers", "", (0, 1), " ", " "))
    rows = spark.range(36).selectExpr("cast(id div 6 as int) as answers__wrapper", "cast(id % 6 as int) as answers__numbering", "1 as answers__space", "8 as answers__separator")
    return rows.select(F.col("answers__wrapper").alias("wrapper"), F.col("answers__numbering").alias("numbering"), Compiled(wanted).render().alias("text"))


@query("instruction_fill", f"select s as numbering, 'Answer ' || max(label) filter (k = 0) || ' or ' || max(label) filter (k = 1) || ', not {{other}}' as instruction from {_LABELS} n(s, name, k, label) group by s")
def instruction_fill(spark: SparkSession, d: str) -> DataFrame:
    wanted = Template("items", Items("answers", "", (0, 1), " ", " "))
    rows = spark.range(6).selectExpr("0 as answers__wrapper", "cast(id as int) as answers__numbering", "1 as answers__space", "8 as answers__separator")
    text = named_fill(F.lit("Answer {enum1_1} or {enum1_2}, not {other}"), Compiled(wanted).enumeration_names())
    return rows.select(F.col("answers__numbering").alias("numbering"), text.alias("instruction"))


@query(
    "class_remap",
    "select task, 'Option ' || list_position(class_labels, output[1]) as answer, count(*) as n from instances join tasks using (task) where list_contains(class_labels, output[1]) group by 1, 2",
)
def class_remap(spark: SparkSession, d: str) -> DataFrame:
    tasks = table(spark, d, "tasks").where("class_labels is not null")
    current = F.transform("class_labels", lambda c, i: F.concat(F.lit("Option "), (i + 1).cast("string")))
    mapping = prompts.class_map(tasks.select(F.col("task").alias("node_id"), F.col("class_labels").alias("original_classes"), current.alias("current_classes")))
    known = tasks.select(F.col("task").alias("node_id"), F.explode("class_labels").alias("answer"))
    outputs = _instances(spark, d).select(F.col("task").alias("node_id"), F.try_element_at("output", F.lit(1)).alias("answer")).join(known, ["node_id", "answer"], "left_semi")
    return prompts.remapped(outputs, mapping).groupBy(F.col("node_id").alias("task"), "answer").agg(F.count("*").alias("n"))


# --- prompts and evaluation ---------------------------------------------------------------------------------------

N_SHOT = 2


def _rows(spark: SparkSession, d: str) -> DataFrame:
    rows = dataset.split(dataset.permuted(_instances(spark, d).where("input is not null and try_element_at(output, 1) is not null")))
    return rows.select("task", "instance_id", "part", "place", "dataset_idx", F.array("input").alias("fields"), F.try_element_at("output", F.lit(1)).alias("answer"))


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    told = dataset.longest_instruction(table(spark, d, "tasks"))
    one = table(spark, d, "formats").select("node_id", "node")
    return told.withColumn("_k", F.lit(1)).join(one.withColumn("_k", F.lit(1)), "_k").drop("_k")  # fixed tables: formats of each task


_ROWS_SQL = f"select task, instance_id, input, output[1] as answer, {_PLACE} as place from instances where input is not null and output[1] is not null"
_NODES_SQL = "select task, instruction, node_id, split_part(node, '{}', 1) as a, split_part(node, '{}', 2) as b, split_part(node, '{}', 3) as c, node from (" + SQL["instruction_longest"] + "), formats"
_BLOCK_SQL = f"select task, node_id, any_value(instruction) || chr(10) || chr(10) || string_agg(a || input || b || answer || c, chr(10) || chr(10) order by place) as block from ({_ROWS_SQL}) join ({_NODES_SQL}) using (task) where place < {N_SHOT} group by 1, 2"


@query("demo_block", f"select task, node_id, md5(block) as block_md5 from ({_BLOCK_SQL})")
def demo_block(spark: SparkSession, d: str) -> DataFrame:
    blocks = prompts.demo_block(_nodes(spark, d), _rows(spark, d).where("part = 'demo'"), N_SHOT)
    return blocks.select("task", "node_id", F.md5(F.encode("block", "UTF-8")).alias("block_md5"))


def _prompted(spark: SparkSession, d: str, shots: int) -> DataFrame:
    rows, nodes = _rows(spark, d), _nodes(spark, d)
    blocks = prompts.demo_block(nodes, rows.where("part = 'demo'"), shots) if shots else None
    return prompts.full_prompts(nodes, rows.where("part = 'test'"), blocks)


_TEST_SQL = f"select *, place - 10 as dataset_idx from ({_ROWS_SQL}) where place >= 10"


@query("full_prompts", f"select task, node_id, dataset_idx, md5(block || chr(10) || chr(10) || a || input || b || c) as prompt_md5 from ({_TEST_SQL}) join ({_NODES_SQL}) using (task) join ({_BLOCK_SQL}) using (task, node_id)")
def full_prompts(spark: SparkSession, d: str) -> DataFrame:
    return _prompted(spark, d, N_SHOT).select("task", "node_id", "dataset_idx", F.md5(F.encode("prompt", "UTF-8")).alias("prompt_md5"))


@query("full_prompts_zero_shot", f"select task, node_id, dataset_idx, md5(a || input || b || c) as prompt_md5 from ({_TEST_SQL}) join ({_NODES_SQL}) using (task)")
def full_prompts_zero_shot(spark: SparkSession, d: str) -> DataFrame:
    return _prompted(spark, d, 0).select("task", "node_id", "dataset_idx", F.md5(F.encode("prompt", "UTF-8")).alias("prompt_md5"))


_STRIP = _sql_text(text_functions.STRIPPED)


def _sql_clean(x: str) -> str:
    return f"lower(trim({x}, {_STRIP}))"


def _sql_match(g: str, a: str) -> str:
    return f"(starts_with({g}, {a}) and not regexp_matches(substr({g}, length({a}) + 1, 1), '[\\p{{L}}\\p{{Nd}}]'))"


def _sql_scored(source: str, keep: str) -> str:
    right = f"coalesce({_sql_match(_sql_clean('generation'), _sql_clean('answer'))}, false)"
    others = "list_filter(coalesce(output_classes, []), lambda c: c is not null and c is distinct from answer)"
    wrong = f"coalesce(list_bool_or(list_transform({others}, lambda c: {_sql_match(_sql_clean('generation'), _sql_clean('c'))})), false)"
    return f"select {keep}, {right} as is_right, {wrong} as is_wrong from {source}"


@query("full_evaluation", f"""
with m as (select t.task, node_id, dataset_idx, answer, class_labels as output_classes, md5(node || '|' || instance_id) as h from ({_TEST_SQL}) t join tasks using (task) join ({_NODES_SQL}) using (task) where class_labels is not null),
k as (select *, ('0x' || substr(h, 1, 8))::bigint as h1, ('0x' || substr(h, 9, 8))::bigint as h2, ('0x' || substr(h, 17, 8))::bigint as h3 from m),
s as (select *, case when h1 % 100 < 60 then answer else output_classes[h2 % len(output_classes) + 1] end as said from k),
g as (select *, case h3 % 3 when 0 then ' ' || said || '.' when 1 then '(' || said || ')' else said || 'foo' end as generation from s)
select task, node_id, round(avg(is_right::int), 9) as "right", round(avg(is_wrong::int), 9) as wrong, count(*) as total from ({_sql_scored('g', 'task, node_id')}) group by 1, 2
""")  # fmt: skip
def full_evaluation(spark: SparkSession, d: str) -> DataFrame:
    rows = _rows(spark, d).where("part = 'test'").select("task", "instance_id", "answer")
    classes = table(spark, d, "tasks").where("class_labels is not null").select("task", F.col("class_labels").alias("output_classes"))
    pairs = rows.join(classes, "task").join(_nodes(spark, d).select("task", "node_id", "node"), "task")
    said = pairs.withColumn("generation", model.mock("node", F.col("instance_id").cast("string"), F.col("answer"), F.col("output_classes")))
    return search.evaluate_all(said, "task", "node_id").select("task", "node_id", F.round("right", 9).alias("right"), F.round("wrong", 9).alias("wrong"), "total")


def _log(spark: SparkSession, d: str) -> DataFrame:
    """Scored log rows, each once however often it was delivered, as the stream counts them."""
    rows = scoring.scored(table(spark, d, "logs")).select("log_id", "node_id", "task", "dataset_idx", "is_right", "is_wrong", "is_other")
    return rows.dropDuplicates(["log_id"])


_LOG_SQL = f"select distinct on (log_id) * from ({_sql_scored('logs', 'log_id, node_id, task, dataset_idx')})"


@query("prefix_match_log", f"select log_id, is_right, is_wrong, not (is_right or is_wrong) as is_other from ({_sql_scored('logs', 'log_id')})")
def prefix_match_log(spark: SparkSession, d: str) -> DataFrame:
    return scoring.scored(table(spark, d, "logs")).select("log_id", "is_right", "is_wrong", "is_other")


@query("echo_stripped", "select distinct log_id, md5(generation) as generation_md5 from logs where full_prompt_string is not null and generation is not null")
def echo_stripped(spark: SparkSession, d: str) -> DataFrame:
    """Generations as a model gives them, in lower case behind their prompts, and without these."""
    rows = table(spark, d, "logs").where("full_prompt_string is not null and generation is not null").dropDuplicates(["log_id"])
    said = F.concat(F.lower("full_prompt_string"), "generation")
    return rows.select("log_id", F.md5(F.encode(text_functions.without_echo(said, F.col("full_prompt_string")), "UTF-8")).alias("generation_md5"))


_ACC_SQL = f'select node_id, round(avg(is_right::int), 9) as "right", round(avg(is_wrong::int), 9) as wrong, count(*) filter (not is_right and not is_wrong) as other, count(*) as total from ({_LOG_SQL}) group by node_id'


def _acc(spark: SparkSession, d: str) -> DataFrame:
    out = scoring.accuracy(_log(spark, d), "node_id")
    return out.withColumn("right", F.round("right", 9)).withColumn("wrong", F.round("wrong", 9))


@query("node_accuracy", _ACC_SQL)
def node_accuracy(spark: SparkSession, d: str) -> DataFrame:
    return _acc(spark, d)


_RANK_SQL = f'select a.node_id, node, row_number() over (order by "right" desc, wrong desc, total desc, node desc, a.node_id desc) as rank from ({_ACC_SQL}) a join formats f on a.node_id = f.node_id'


@query("node_ranking", _RANK_SQL)
def node_ranking(spark: SparkSession, d: str) -> DataFrame:
    return scoring.ranking(_acc(spark, d).join(table(spark, d, "formats").select("node_id", "node"), "node_id")).select("node_id", "node", "rank")


@query("best_worst", f"select arg_min(node_id, rank) as best, arg_max(node_id, rank) as worst from ({_RANK_SQL})")
def best_worst(spark: SparkSession, d: str) -> DataFrame:
    return scoring.best_worst(_acc(spark, d).join(table(spark, d, "formats").select("node_id", "node"), "node_id"))


@query("output_classes_by_batch", "select task, node_id, dataset_idx // 20 as batch, array_to_string(list_sort(list(distinct answer)), '|') as classes from logs group by 1, 2, 3")
def output_classes_by_batch(spark: SparkSession, d: str) -> DataFrame:
    out = scoring.classes_by_batch(table(spark, d, "logs"), F.expr("dataset_idx div 20"), "task", "node_id")
    return out.select("task", "node_id", "batch", F.array_join("classes", "|").alias("classes"))


_BATCH_SQL = f"select node_id, dataset_idx // 20 as batch, sum(is_right::int)::bigint as right_count, count(*) as trials from ({_LOG_SQL}) group by 1, 2"
_RUN_SQL = f"""
select node_id, batch, trials, successes, round(successes / greatest(trials, 1), 9) as accuracy, round(lag(successes / greatest(trials, 1)) over (partition by node_id order by batch), 9) as previous
from (select node_id, batch, (sum(trials) over w)::bigint as trials, (sum(right_count) over w)::bigint as successes from ({_BATCH_SQL}) window w as (partition by node_id order by batch rows unbounded preceding))
"""


def _batches(spark: SparkSession, d: str) -> DataFrame:
    return _log(spark, d).groupBy("node_id", F.expr("dataset_idx div 20").alias("batch")).agg(F.sum(F.col("is_right").cast("bigint")).alias("right_count"), F.count("*").alias("trials"))


@query("running_accuracy", _RUN_SQL)
def running_accuracy(spark: SparkSession, d: str) -> DataFrame:
    return scoring.running(_batches(spark, d)).select("node_id", "batch", "trials", "successes", F.round("accuracy", 9).alias("accuracy"), F.round("previous", 9).alias("previous"))


@query("best_so_far", f"select batch, arg_max(node_id, (accuracy, node_id)) as node_id from ({_RUN_SQL}) group by batch")
def best_so_far(spark: SparkSession, d: str) -> DataFrame:
    return scoring.best_so_far(running_accuracy(spark, d))


_ARMS_SQL = f"select node_id, sum(right_count)::bigint as successes, sum(trials)::bigint as trials from ({_BATCH_SQL}) group by node_id"


def _arms(spark: SparkSession, d: str) -> DataFrame:
    return _batches(spark, d).groupBy("node_id").agg(F.sum("right_count").alias("successes"), F.sum("trials").alias("trials"))


@query("final_node", f"select 'highest' as objective, arg_max(node_id, (successes / trials, node_id)) as node_id from ({_ARMS_SQL}) union all select 'lowest', arg_min(node_id, (successes / trials, node_id)) from ({_ARMS_SQL})")
def final_node(spark: SparkSession, d: str) -> DataFrame:
    arms = _arms(spark, d)
    high, low = (scoring.final_node(arms, x).select(F.lit(n).alias("objective"), "node_id") for x, n in ((True, "highest"), (False, "lowest")))
    return high.unionByName(low)


@query("ucb_scores", f"select node_id, round(successes / trials + 2 * sqrt(ln(1 + 1000) / trials), 6) as ucb from ({_ARMS_SQL})")
def ucb_scores(spark: SparkSession, d: str) -> DataFrame:
    return scoring.ucb(_arms(spark, d), F.lit(1000)).select("node_id", F.round("ucb", 6).alias("ucb"))


@query("thompson_run")
def thompson_run(spark: SparkSession, d: str) -> DataFrame:
    """All rows of every format, in an order of its own; the original format is the one of gen_order 0."""
    rows = table(spark, d, "logs").where("log_id is not null and node_id is not null").dropDuplicates(["log_id"]).select("log_id", "node_id", "generation", "answer", "output_classes")
    log = dataset.permuted(scoring.scored(rows).select("log_id", "node_id", "is_right"), "7", "node_id", "log_id").withColumnRenamed("place", "eval_pos")
    original = table(spark, d, "formats").where("gen_order = 0").select("node_id").first()
    found = search.search_arms(search.outcomes(log, 20, 400), 400 * 20, 7, original=original.node_id)
    return spark.createDataFrame(found.trace, "phase string, step int, node_id string, successes bigint, trials bigint, best_so_far string")


_ARM_ROWS = f"select node_id, is_right, row_number() over (partition by node_id order by md5('7|' || log_id), log_id) - 1 as eval_pos from (select distinct on (log_id) log_id, node_id, is_right from ({_LOG_SQL}))"


@query("arm_outcomes", f"select node_id, least(eval_pos // 20, 40) as batch, sum(is_right::int)::bigint as hits, count(*) as n from ({_ARM_ROWS}) group by 1, 2")
def arm_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """What the search plays with, of the first 40 batches, and the rest together."""
    log = dataset.permuted(_log(spark, d).dropDuplicates(["log_id"]).select("log_id", "node_id", "is_right"), "7", "node_id", "log_id").withColumnRenamed("place", "eval_pos")
    arms = search.outcomes(log, 20, 40)
    rows = []
    for k, node in enumerate(arms.nodes):
        each = list(zip(arms.right[k].tolist(), arms.size[k].tolist(), strict=True))
        rest = int(arms.total_right[k]) - sum(r for r, _ in each), int(arms.total[k]) - sum(n for _, n in each)
        rows += [(node, b, r, n) for b, (r, n) in enumerate([*each, rest] if rest[1] else each)]
    return spark.createDataFrame(rows, "node_id string, batch bigint, hits bigint, n bigint")


@query("run_document")
def run_document(spark: SparkSession, d: str) -> DataFrame:
    acc = _acc(spark, d).join(table(spark, d, "formats").select("node_id", "node", "gen_order"), "node_id")
    document = task_files.run_document(acc, _log(spark, d), {"metric": "exact_prefix_matching", "table": "logs"})
    return document.select(F.to_json(F.struct(*document.columns)).alias("document"))


ORDERED = "task9001_tide_reports_yesno"


def _stored(spark: SparkSession, d: str) -> DataFrame:
    """All distinct formats of a shape and a task's order, written to a file and read again."""
    path = f"{folder(spark)}/formats-{uuid.uuid4().hex}.json"
    names = formats.named(formats.distinct(_valid(spark), _ONE), _ONE).select("cand_id", "names")
    rows = dataset.permuted(_instances(spark, d).where(F.col("task") == ORDERED))
    task_files.write_formats(names, rows.select("place", F.col("pos").alias("row")), path)
    return task_files.read_formats(spark, path)


@query("json_roundtrip", f"select (select count(*) from (select distinct space, separator, casing from ({_PRODUCT}) where ok))::int as formats, count(*)::int as rows from instances where task = '{ORDERED}'")
def json_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    return _stored(spark, d).select(F.size("valid_value_assignments").alias("formats"), F.size("dataset_ordered_ids").alias("rows"))


@query("json_order", f"select place, pos as row from (select task, pos, {_PLACE} as place from instances) where task = '{ORDERED}'")
def json_order(spark: SparkSession, d: str) -> DataFrame:
    return _stored(spark, d).select(F.posexplode("dataset_ordered_ids").alias("place", "row"))


# --- ranking by logits --------------------------------------------------------------------------------------------


@query("topk_logits", "select vec_id, rank, token_id, round(logit, 6) as logit from (select vec_id, i - 1 as token_id, embedding[i]::double as logit, row_number() over (partition by vec_id order by embedding[i] desc, i) as rank from embeddings, range(1, 65) t(i)) where rank <= 10")
def topk_logits(spark: SparkSession, d: str) -> DataFrame:
    return scoring.top_logits(table(spark, d, "embeddings"), "vec_id", "embedding", 10).withColumn("logit", F.round("logit", 6))


@query(
    "log_softmax_score",
    "select vec_id, round(embedding[1]::double + embedding[label + 2]::double - 2 * (top + ln(total)), 5) as score from (select vec_id, embedding, label, list_max(embedding)::double as top, list_sum(list_transform(embedding, lambda x: exp(x::double - list_max(embedding)::double))) as total from embeddings)",
)
def log_softmax_score(spark: SparkSession, d: str) -> DataFrame:
    tokens = F.array(F.lit(0), F.col("label") + 1)
    return table(spark, d, "embeddings").select("vec_id", F.round(scoring.class_score(F.col("embedding"), tokens), 5).alias("score"))


_COARSE = "list_transform(embedding, lambda x: floor(x * 4))"


@query("argmax_last_tie", f"select vec_id, max(i) - 1 as token_id from (select vec_id, {_COARSE} as e from embeddings), range(1, 65) t(i) where e[i] = list_max(e) group by vec_id")
def argmax_last_tie(spark: SparkSession, d: str) -> DataFrame:
    coarse = F.transform("embedding", lambda x: F.floor(x * 4))
    return table(spark, d, "embeddings").select("vec_id", scoring.argmax(coarse, last=True).alias("token_id"))


@query("argmax_first_tie", f"select vec_id, min(i) - 1 as token_id from (select vec_id, {_COARSE} as e from embeddings), range(1, 65) t(i) where e[i] = list_max(e) group by vec_id")
def argmax_first_tie(spark: SparkSession, d: str) -> DataFrame:
    coarse = F.transform("embedding", lambda x: F.floor(x * 4))
    return table(spark, d, "embeddings").select("vec_id", scoring.argmax(coarse, last=False).alias("token_id"))


@query(
    "token_prefix_test",
    "select task, list_bool_and(list_transform(t, lambda x: len(x) = 2)) or len(list_distinct(list_transform(t, lambda x: x[:-2]))) = 1 as single from (select task, list_transform(class_labels, lambda c: list_prepend('', string_split(c, ' '))) as t from tasks where class_labels is not null)",
)
def token_prefix_test(spark: SparkSession, d: str) -> DataFrame:
    tokens = F.transform("class_labels", lambda c: F.concat(F.array(F.lit("")), F.split(c, " ")))
    return table(spark, d, "tasks").where("class_labels is not null").select("task", scoring.single_token(tokens).alias("single"))


@query("ranked_generation", "select log_id, count(*)::int as steps, round(max(list_max(list_transform(s, lambda x: x.logit))) + 0.0, 6) + 0.0 as top from (select log_id, unnest(scores) as s from logs where scores is not null) group by log_id")
def ranked_generation(spark: SparkSession, d: str) -> DataFrame:
    steps = table(spark, d, "logs").where("scores is not null").select("log_id", F.explode("scores").alias("s"))
    return steps.groupBy("log_id").agg(F.count("*").cast("int").alias("steps"), F.round(F.max(F.array_max(F.transform("s", lambda x: x["logit"]))) + 0.0, 6).alias("top"))
