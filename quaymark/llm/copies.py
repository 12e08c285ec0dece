"""Records that differ only in layout (problem 2): one canonical form, a 128-bit hash, counts combined map-side."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaymark.llm.chars import caseless
from quaymark.session import cut

_ESCAPED = regex.compile(r"(?<!\\)\\[nrt]")
_SIGNS = regex.compile(r"[^\p{L}\p{N}\p{M}]+")


@lru_cache(maxsize=4096)
def _markers(labels: tuple[str, ...]) -> regex.Pattern | None:
    """A field label, not inside a word, before its separator."""
    names = sorted({caseless(x) for x in labels if x and x.strip()}, key=len, reverse=True)
    if not names:
        return None
    return regex.compile(r"(?<![\p{L}\p{N}\p{M}])(" + "|".join(map(regex.escape, names)) + r")[\s\"'*]*[:：\-–—=|>]")


def _members(text: str) -> list[tuple[str, str]] | None:
    """The members of a JSON object with string values, else None."""
    if not text.lstrip().startswith("{"):
        return None
    try:
        pairs = json.loads(text, object_pairs_hook=list)
    except ValueError:
        return None
    if isinstance(pairs, list) and pairs and all(isinstance(p, tuple) and isinstance(p[1], str) for p in pairs):
        return [(caseless(k), caseless(v)) for k, v in pairs]
    return None


def canonical(text: str, labels: tuple[str, ...]) -> str:
    """Letters, digits and marks only, case and look-alikes folded, the labelled fields sorted by label.

    Fields are the members of a JSON object, or what stands between the task's labels. Digits, superscripts
    and accents stay. Text without a letter or digit gives ''.
    """
    fields = _members(text)
    if fields is None:
        folded, marker = caseless(text), _markers(labels)
        if folded.lstrip().startswith("{"):  # an object that doesn't parse any more: its escaped blanks are blanks too
            folded = _ESCAPED.sub(" ", folded)
        parts = marker.split(folded) if marker else [folded]
        fields = [("", parts[0]), *zip(parts[1::2], parts[2::2], strict=True)]
    kept = sorted((_SIGNS.sub("", k), _SIGNS.sub("", v)) for k, v in fields)
    if not any(v for _, v in kept):
        return ""
    return "\x1e".join(f"{k}\x1f{v}" for k, v in kept if k or v)


def keyed(records: DataFrame, labels: DataFrame, id_col: str = "instance_id", group: str = "task", text: str = "input") -> DataFrame:
    """``id``, ``grp``, 128-bit ``h`` and an independent 64-bit ``proof`` of every record that is a case.

    Null ids, null groups and null, empty or letterless texts are no case. ``labels`` has ``grp`` and ``labels``
    (array of names; null or missing: no fields).
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            forms = [canonical(t, tuple(x for x in lab if x) if lab is not None else ()) for t, lab in zip(b["text"], b["labels"], strict=True)]
            b = b[["id", "grp"]].assign(form=forms)
            b = b[b["form"] != ""]
            raw = [f.encode("utf-8", "surrogatepass") for f in b["form"]]
            yield b.drop(columns="form").assign(
                h=[hashlib.md5(x, usedforsecurity=False).digest() for x in raw],
                proof=[int.from_bytes(hashlib.blake2b(x, digest_size=8).digest(), "big", signed=True) for x in raw],
            )

    named = records.select(F.col(id_col).cast("bigint").alias("id"), F.col(group).alias("grp"), F.col(text).alias("text")).where("id is not null and grp is not null and text is not null")
    lists = labels.select("grp", "labels").dropDuplicates(["grp"])
    return named.join(lists, "grp", "left").select("id", "grp", "text", "labels").mapInPandas(run, "id bigint, grp string, h binary, proof bigint")


def counts(keys: DataFrame) -> DataFrame:
    """A row per distinct record: the smallest id and the number of copies; grouping by hash and proof keeps
    two records apart whose hashes collide (``collided`` tells)."""
    once = keys.groupBy("grp", "h", "proof").agg(F.min("id").alias("kept_id"), F.count("*").alias("copies"))
    return once


def collisions(keys: DataFrame) -> DataFrame:
    """Hashes that stand for more than one record; none are expected."""
    return keys.groupBy("grp", "h").agg(F.min("proof").alias("least"), F.max("proof").alias("most")).where("least <> most")


def copies(records: DataFrame, labels: DataFrame, id_col: str = "instance_id", group: str = "task", text: str = "input") -> DataFrame:
    """``kept_id``, ``copy_id``: each group's smallest id with each other member.

    The compact keys are written once; groups are counted with partial aggregation, so a group of any size
    arrives as one row per map task. Only members of groups of two or more come back through the join, which
    adaptive execution splits where one group is hot.
    """
    keys = cut(keyed(records, labels, id_col, group, text))
    groups = counts(keys).where("copies > 1")
    same: list[Column] = [keys[c] == groups[c] for c in ("grp", "h", "proof")]
    return keys.join(groups, same).where(F.col("id") != F.col("kept_id")).select("kept_id", F.col("id").alias("copy_id")).distinct()
