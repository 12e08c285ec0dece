"""The values that a format's slots range over, and the functions behind them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

# Order matters, a value's index is its place; a name that occurs twice stands for its first place.
SEPARATORS = ("", "::: ", ":: ", ": ", " \n\t", "\n    ", " : ", " - ", " ", "\n ", "\n\t", ":", "::", "- ", "\t")
SPACES = ("", " ", "\n", " \n", " -- ", "  ", "; \n", " || ", " <sep> ", " -- ", ", ", " \n ", " , ", "\n ", ". ", " ,  ")
GAPS = ("", " ", "  ", "\t")
CASINGS = ("identity", "title", "upper", "lower")
WRAPPERS = ("({})", "{}.", "{})", "{} )", "[{}]", "<{}>")
NUMBERINGS = ("arabic", "upper_letter", "lower_letter", "numeral_sign", "lower_roman", "upper_roman")
ROMAN = ("i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix", "x", "xi", "xii", "xiii", "xiv", "xv")

#: Signs of the Unicode numeral block exist for twelve items only; a format that needs more is invalid.
SIGNS = 12
DOMAINS: dict[str, tuple[str, ...]] = {
    "space": SPACES,
    "separator": SEPARATORS,
    "gap": GAPS,
    "casing": CASINGS,
    "wrapper": WRAPPERS,
    "numbering": NUMBERINGS,
}


def cased(text: str) -> tuple[str, str, str, str]:
    """A descriptor in each casing, in the order of CASINGS; a letter after a non-letter starts a title word."""
    return text, text.title(), text.upper(), text.lower()


def number(system: str, i: int) -> str:
    """The label of the i-th item, from 0."""
    named: dict[str, Callable[[int], str]] = {
        "arabic": lambda k: str(k + 1),
        "upper_letter": lambda k: chr(ord("A") + k),
        "lower_letter": lambda k: chr(ord("a") + k),
        "numeral_sign": lambda k: chr(0x2160 + k) if k < SIGNS else "",
        "lower_roman": lambda k: ROMAN[k],
        "upper_roman": lambda k: ROMAN[k].upper(),
    }
    return named[system](i)


def wrapped(pattern: str, label: str) -> str:
    return pattern.replace("{}", label)


def blank(text: str) -> bool:
    """Nothing but white space, and some."""
    return text != "" and text.isspace()


def table(spark: SparkSession) -> DataFrame:
    """``action_type``, ``idx``, ``name``: every value of every domain; a name is its own text."""
    rows = [(k, i, v) for k, vs in DOMAINS.items() for i, v in enumerate(vs)]
    return spark.createDataFrame(rows, "action_type string, idx int, name string")
