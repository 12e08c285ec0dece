"""Model calls behind one interface; a deterministic mock made of columns, and an adapter for models in Python."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Backend(Protocol):
    """Answers a batch of prompts; made once per worker by a factory, so only the factory is sent around."""

    def generate(self, prompts: list[str], max_tokens: int) -> list[str]: ...

    def class_logits(self, prompts: list[str], classes: list[list[str]]) -> list[list[float]]: ...


def mock(node: Column | str, row: Column | str, answer: Column, classes: Column) -> Column:
    """A generation from the digest of node and row: right in 60 of 100, else one of the classes, in one of three dresses."""
    m = F.md5(F.encode(F.concat_ws("|", node, row), "UTF-8"))
    h = [F.conv(F.substring(m, at, 8), 16, 10).cast("bigint") for at in (1, 9, 17)]
    said = F.when(h[0] % 100 < 60, answer).otherwise(F.element_at(classes, (h[1] % F.greatest(F.size(classes), F.lit(1))).cast("int") + 1))
    return F.when(h[2] % 3 == 0, F.concat(F.lit(" "), said, F.lit("."))).when(h[2] % 3 == 1, F.concat(F.lit("("), said, F.lit(")"))).otherwise(F.concat(said, F.lit("foo")))


def generate(prompts: DataFrame, factory: Callable[[], Backend], max_tokens: int = 10, batch: int = 32, retries: int = 3, wait: float = 1.0) -> DataFrame:
    """``prompts`` with ``generation``: in batches, each tried again at growing intervals a bounded number of times."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in prompts.schema) + ", generation string"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        backend = factory()
        for frame in frames:
            said: list[str] = []
            for at in range(0, len(frame), batch):
                part = list(frame["prompt"].iloc[at : at + batch])
                for attempt in range(retries + 1):
                    try:
                        said += backend.generate(part, max_tokens)
                        break
                    except OSError:
                        if attempt == retries:
                            raise
                        time.sleep(wait * 2**attempt)
            yield frame.assign(generation=said)

    return prompts.mapInPandas(run, schema)


def rank_classes(prompts: DataFrame, factory: Callable[[], Backend], batch: int = 32) -> DataFrame:
    """``prompts`` (with ``output_classes``) with ``logits``: one per class and prompt."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in prompts.schema) + ", logits array<double>"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        backend = factory()
        for frame in frames:
            out: list[list[float]] = []
            for at in range(0, len(frame), batch):
                part = frame.iloc[at : at + batch]
                out += backend.class_logits(list(part["prompt"]), [list(c) for c in part["output_classes"]])
            yield frame.assign(logits=out)

    return prompts.mapInPandas(run, schema)


def max_tokens(task: str, open_tasks: frozenset[str] = frozenset(), second_corpus: bool = False) -> int:
    """50 for open generation, 15 for the second corpus, else 10."""
    return 15 if second_corpus else 50 if task in open_tasks else 10
