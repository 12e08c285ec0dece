"""Token ids of whole texts by a public byte-level BPE (problem 7), by overlapping chunks.

A text is pre-tokenised in overlapping chunks, each from an arbitrary start. Where two neighbours have a
boundary in common inside their overlap, the pattern goes on alike in both, so the text may be cut there;
the pieces between cuts are encoded on their own and their ids concatenated. Texts up to ``spread`` characters
are chunked inside a task; longer ones have their pieces encoded as rows of their own, so no task holds the
encoding of an unbounded text.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the published pre-token pattern of this vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CHUNK, OVERLAP, SPREAD = 4096, 256, 1 << 20
_PRETOKEN = regex.compile(PATTERN)


@lru_cache(maxsize=4)
def _ranks(path: str) -> dict[bytes, int]:
    with Path(path).open("rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


@lru_cache(maxsize=4)
def encoding(path: str = VOCABULARY):
    """The encoder, loaded once per worker; it has no special tokens, so their strings are plain text."""
    import tiktoken

    return tiktoken.Encoding(Path(path).stem, pat_str=PATTERN, mergeable_ranks=_ranks(path), special_tokens={})


@lru_cache(maxsize=4)
def _bytes_of(path: str) -> dict[int, bytes]:
    return {i: b for b, i in _ranks(path).items()}


def decode(ids: list[int], path: str = VOCABULARY) -> str:
    """The text of ``ids``: their raw bytes concatenated, then read as UTF-8."""
    of = _bytes_of(path)
    return b"".join(of[i] for i in ids).decode("utf-8")


def _boundaries(text: str, start: int, stop: int) -> list[int]:
    """Ends of the pre-tokens of text[start:stop], as places in the text; the last may be cut short and is left out
    unless the text ends there."""
    ends = [m.end() for m in _PRETOKEN.finditer(text, start, stop)]
    return ends if stop == len(text) else ends[:-1]


def cuts(text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[int]:
    """Places at which the text may be cut so that its pieces encode as the whole does; ends with its length.

    Two neighbouring chunks are stitched at the first boundary they share after a character that isn't white
    space (what a run of white space becomes depends on what follows it). Without one, the chunk is run
    together with the next.
    """
    out, size = [], len(text)
    left, start = _boundaries(text, 0, min(size, chunk + overlap)), chunk
    while start < size:
        right = _boundaries(text, start, min(size, start + chunk + overlap))
        known = set(right)
        at = next((e for e in left if e > start and e in known and not text[e - 1].isspace()), None)
        if at is not None:
            out.append(at)
        left, start = right, start + chunk
    return [*out, size]


def encode(text: str | None, path: str = VOCABULARY, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[int]:
    """Ids of one text; [] for an empty or null one."""
    if not text:
        return []
    enc = encoding(path)
    if len(text) <= chunk:
        return enc.encode_ordinary(text)
    at, ids = 0, []
    for e in cuts(text, chunk, overlap):
        ids += enc.encode_ordinary(text[at:e])
        at = e
    return ids


def encoded(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str = VOCABULARY, chunk: int = CHUNK, overlap: int = OVERLAP, spread: int = SPREAD) -> DataFrame:
    """``key``, ``ids`` (array<int>) of every row; an empty list for an empty or null text.

    ``key`` may repeat or be null: each row gives one row. Other columns are ignored, whatever their names.
    The vocabulary file must be at ``path`` on every worker.
    """
    rows = docs.select(F.col(key).cast("bigint").alias(key), F.col(text).alias("text"))
    long = F.length("text") > spread

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = [encode(t, path, chunk, overlap) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], [key, "ids"])

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for row, k, t in b.itertuples(index=False):
                at, ends = 0, cuts(t, chunk, overlap)
                for n in range(0, len(ends), 64):  # some 64 chunks a row
                    e = ends[min(n + 63, len(ends) - 1)]
                    yield pd.DataFrame({"row": [row], key: [k], "n": [n], "piece": [t[at:e]]})
                    at = e

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = [encode(t, path, chunk, overlap) for t in b.column("piece").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column(key), b.column("n"), pa.array(ids, pa.list_(pa.int32()))], ["row", key, "n", "ids"])

    small = rows.where(~F.coalesce(long, F.lit(False))).mapInArrow(short, f"{key} bigint, ids array<int>")
    split = rows.where(long).select(F.monotonically_increasing_id().alias("row"), key, "text").mapInPandas(pieces, f"row bigint, {key} bigint, n int, piece string").repartition("row", "n")
    whole = split.mapInArrow(one, f"row bigint, {key} bigint, n int, ids array<int>").groupBy("row", key).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("n", "ids"))), lambda x: x["ids"])).alias("ids"))
    return small.unionByName(whole.select(key, "ids"))


def decoded(ids: DataFrame, key: str = "doc_id", path: str = VOCABULARY) -> DataFrame:
    """``key``, ``text`` of rows of ``key``, ``ids``; '' for an empty or null list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([decode(x or [], path) for x in b.column(1).to_pylist()], pa.string())], [key, "text"])

    return ids.select(F.col(key).cast("bigint").alias(key), "ids").mapInArrow(run, f"{key} bigint, text string")
