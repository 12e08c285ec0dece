"""Text functions as column expressions: cleaning, prefix matching, filling."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: what is stripped from both sides of a generation before it is compared.
STRIPPED = " .,()\n-><"


def clean(text: Column) -> Column:
    """Without outer blanks, stops, brackets, dashes and line feeds, in lower case."""
    return F.lower(F.btrim(text, F.lit(STRIPPED)))


def matches(generation: Column, answer: Column) -> Column:
    """A cleaned generation begins with a cleaned answer, and no letter or digit follows it."""
    after = F.substring(generation, F.length(answer) + 1, F.lit(1))
    return F.startswith(generation, answer) & ~F.regexp_like(after, F.lit(r"[\p{L}\p{Nd}]"))


def filled(template: Column, fields: Column) -> Column:
    """A format's holes filled with the fields in order; surplus fields are left out, a missing one is an error.

    Texts are only concatenated, so no sign in them is special.
    """
    parts = F.split(template, r"\{\}")
    holes = F.size(parts) - 1
    enough = F.when(F.size(fields) < holes, F.raise_error(F.lit("fewer fields than holes")).cast("string"))
    pairs = F.zip_with(parts, F.concat(F.slice(fields, F.lit(1), F.greatest(holes, F.lit(0))), F.array(F.lit(""))), lambda a, b: F.concat(a, b))
    return F.coalesce(enough, F.array_join(pairs, ""))


def named_fill(text: Column, values: list[tuple[str, Column]]) -> Column:
    """``{name}`` replaced by its value for every name; other braces stay."""
    out = text
    for name, value in values:
        out = F.replace(out, F.lit("{" + name + "}"), value)
    return out


def without_echo(text: Column, prompt: Column) -> Column:
    """What a model wrote after its prompt; all of it where it doesn't begin with the prompt (case aside)."""
    echoed = F.coalesce(F.startswith(F.lower(text), F.lower(prompt)), F.lit(False))
    return F.when(echoed, F.substring(text, F.length(prompt) + 1, F.length(text))).otherwise(text)


def titled(text: Column) -> Column:
    """First letter of each word in upper case, where words are runs of letters."""
    low = F.split(F.lower(text), "")
    before = F.concat(F.array(F.lit("")), low)
    return F.array_join(F.zip_with(low, F.slice(before, F.lit(1), F.size(low)), lambda c, b: F.when(F.regexp_like(b, F.lit(r"\p{L}")), c).otherwise(F.upper(c))), "")


def log_softmax(logits: Column) -> Column:
    """x - max - ln(sum(exp(x - max))) over an array of doubles."""
    top = F.array_max(logits)
    total = F.aggregate(logits, F.lit(0.0), lambda a, x: a + F.exp(x - top))
    return F.transform(logits, lambda x: x - top - F.log(total))
