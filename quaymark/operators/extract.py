"""Fields of an instance by the format it was written in."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quaymark.functions.text import filled

#: Fixed value: the characters a field may hold; the range runs from the apostrophe to the en dash.
ALLOWED = r" !\"#$%&\n\x{27}-\x{2013}—“”‘’′…−∶≤≥≠†€₹→≡∨⊃•∃∀⁄𝑆𝑚√𝑠𝑁𝐴𝑒𝑅𝑇⟩⟨›‹‖♥‰�龍►➥™‚∼⋅"
FIELD = f"([{ALLOWED}]+)"


def pattern(template: str) -> str:
    """The regular expression of a format whose holes are ``{}``: the whole text, each field at least one allowed character."""
    return r"\A(?:" + FIELD.join(_literal(p) for p in template.split("{}")) + r")\z"


def _literal(text: str) -> str:
    return re.sub(r"([\\.^$|?*+()\[\]{}\-])", r"\\\1", text)


def extract(df: DataFrame, templates: dict[int | None, str], text: str = "input") -> DataFrame:
    """With ``fields`` (null where nothing matches) and ``regex_key``: the variant that matched.

    Variants are tried from the longest key to the shortest; the first that matches counts. A field takes as
    much as it can, up to the last place where the rest still matches. Null and empty texts match nothing.
    """
    order = sorted(templates.items(), key=lambda kv: -1 if kv[0] is None else kv[0], reverse=True)
    col = F.col(text)
    fields: list[Column] = []
    keys: list[Column] = []
    for key, template in order:
        regex, n = F.lit(pattern(template)), template.count("{}")
        hit = F.regexp_like(col, regex)
        fields.append(F.when(hit, F.array(*(F.regexp_extract(col, pattern(template), i + 1) for i in range(n)))))
        keys.append(F.when(hit, F.lit(-1 if key is None else key)))
    return df.withColumn("fields", F.coalesce(*fields)).withColumn("regex_key", F.nullif(F.coalesce(*keys), F.lit(-1)))


def first_parsed(extracted: DataFrame, n: int, by: str = "task", order: str = "pos") -> DataFrame:
    """The first ``n`` rows of each task that were parsed, numbered from 0 in ``eval_pos``."""
    # each map task keeps the first n of a task before anything is shuffled
    ranked = extracted.where("fields is not null").withColumn("_rank", F.row_number().over(Window.partitionBy(by).orderBy(order))).where(F.col("_rank") <= n)
    return ranked.withColumn("eval_pos", F.col("_rank") - 1).drop("_rank")


def unparsed(extracted: DataFrame, key: str, text: str = "input") -> DataFrame:
    """``key``, ``characters``: of every row that wasn't parsed, the distinct characters a field may not hold, sorted."""
    odd = F.filter(F.array_distinct(F.split(F.col(text), "")), lambda c: (c != "") & ~F.regexp_like(c, F.lit(f"[{ALLOWED}]")))
    return extracted.where(F.col("fields").isNull() & F.col(text).isNotNull()).select(key, F.array_join(F.array_sort(odd), "").alias("characters"))


def rendered(df: DataFrame, template: str, fields: str = "fields") -> Column:
    """The inverse of ``extract``: a format filled with the fields."""
    return filled(F.lit(template), F.col(fields))
