"""Texts into fixed-capacity containers (problem 8) by vector best-fit.

A container has three capacities: tokens, documents and attention cost (the sum of squared lengths). Items go, in
decreasing size, into the container that they fit best under all three; the best is that of the largest weighted
dot-product of demand and room, or of the smallest weighted norm of the room left. Shards of bounded size are
packed side by side; containers with room left are opened again and packed together, until one shard remains.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaymark.llm.encode import VOCABULARY, encode
from quaymark.session import cut as write_once

SHARD = 20_000
#: A container with more than this share of its capacity left is opened again.
ROOM = 0.004
#: Another round must save this share of the containers opened again.
SAVED = 0.001


@dataclass(frozen=True)
class Limits:
    """Documents a container (0: no limit), attention cost in units of capacity squared (1 never binds), the rule and its weights."""

    documents: int = 0
    attention: float = 1.0
    rule: str = "norm"
    weights: tuple[float, float, float] = (1.0, 0.01, 0.01)


def best_fit(sizes: np.ndarray, capacity: int, limits: Limits = Limits()) -> np.ndarray:
    """The container of each item, numbered from 0. Sizes must be positive, in decreasing order and at most ``capacity``.

    An item whose own attention cost exceeds the limit gets a container for itself.
    """
    n = len(sizes)
    placed = np.empty(n, np.int64)
    caps = np.array([capacity, limits.documents or n + 1, limits.attention * float(capacity) ** 2], float)
    room = np.empty((min(n, 1024), 3))
    name = np.empty(min(n, 1024), np.int64)
    weights, used, made = np.array(limits.weights) / caps**2, 0, 0
    least = sizes[-1] if n else 0
    for k in range(n):
        need = np.array([sizes[k], 1.0, float(sizes[k]) ** 2])
        at = -1
        if used:
            fits = np.flatnonzero((room[:used] >= need).all(axis=1))
            if len(fits):
                left = room[fits]
                if limits.rule == "dot":
                    at = fits[np.argmax((left * need) @ weights)]
                else:
                    at = fits[np.argmin(((left - need) ** 2) @ weights)]
        if at < 0:
            if used == len(room):
                room, name = np.concatenate([room, np.empty_like(room)]), np.concatenate([name, np.empty_like(name)])
            room[used], name[used] = caps, made
            at, used, made = used, used + 1, made + 1
        room[at] -= need
        placed[k] = name[at]
        if room[at, 0] < least or room[at, 1] < 1 or room[at, 2] < float(least) ** 2:  # nothing can come any more
            used -= 1
            room[at], name[at] = room[used], name[used]
    return placed


def sizes(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str = VOCABULARY) -> DataFrame:
    """``key``, ``tokens`` of every text that has any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(encode(t, path)) for t in b.column(1).to_pylist()], pa.int64())], [key, "tokens"])

    return docs.select(F.col(key).cast("bigint").alias(key), F.col(text).alias("text")).where("text <> ''").mapInArrow(run, f"{key} bigint, tokens bigint").where("tokens > 0")


def pieces(measured: DataFrame, containers: DataFrame, key: str = "doc_id") -> DataFrame:
    """Every text once per kind of container, whole, or in pieces of the capacity and a rest where it alone exceeds it.

    The kinds come to the driver; there are at most a few, which is checked.
    """
    kinds = containers.where("container_kind is not null and capacity > 0").select("container_kind", F.col("capacity").cast("bigint").alias("capacity")).distinct().limit(1001).collect()
    if len(kinds) > 1000:
        raise ValueError("more than 1000 kinds of container")
    each = F.array(*(F.struct(F.lit(r.container_kind).alias("container_kind"), F.lit(r.capacity).alias("capacity")) for r in kinds)) if kinds else F.expr("cast(array() as array<struct<container_kind:string,capacity:bigint>>)")
    rows = measured.select(key, "tokens", F.explode(each).alias("c")).select(key, "tokens", "c.*")
    count = F.ceil(F.col("tokens") / F.col("capacity"))
    cutup = rows.select(key, "container_kind", "capacity", "tokens", F.explode(F.sequence(F.lit(0).cast("bigint"), count - 1)).alias("piece"))
    return cutup.select(key, "container_kind", "capacity", "piece", F.least(F.col("capacity"), F.col("tokens") - F.col("piece") * F.col("capacity")).alias("size"))


def pack(items: DataFrame, key: str = "doc_id", limits: Limits = Limits(), shard: int = SHARD) -> DataFrame:
    """``container_kind``, ``capacity``, ``container``, ``key``, ``piece``, ``size``: the container of each piece.

    Pieces are spread over shards by a hash of their key, so a hot key or source doesn't make a hot shard. Each
    round packs all shards at once; the pieces of containers with room left go on to another round, spread anew, until
    they fit one shard or a round saves less than SAVED of the containers that it opened again. No shard ever grows.
    Every piece is placed. Containers are numbered alike in every run over the same data.
    """
    schema = f"container_kind string, capacity bigint, container bigint, {key} bigint, piece bigint, size bigint, open boolean, turn int"
    pool, done, turn, before = write_once(items), None, 0, None
    while True:
        total = pool.groupBy("container_kind").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
        shards = max(1, -(-total // shard))
        spread = pool.withColumn("part", F.pmod(F.xxhash64(key, "piece", F.lit(turn)), F.lit(shards)).cast("bigint"))
        packed = write_once(spread.groupBy("container_kind", "part").applyInPandas(_packer(key, limits, turn, shards == 1), schema))
        used = packed.groupBy("container_kind", "container", "open").agg(F.lit(1).alias("one")).agg(F.count("*").alias("all"), F.count_if("open").alias("open")).first()
        if shards == 1 or before is not None and before - used["all"] < SAVED * before:
            last = packed.drop("open", "turn")
            return last if done is None else done.unionByName(last)
        closed = packed.where("not open").drop("open", "turn")
        done = closed if done is None else done.unionByName(closed)
        pool, turn, before = packed.where("open").select(key, "container_kind", "capacity", "piece", "size"), turn + 1, used["open"]


def violations(packed: DataFrame, limits: Limits) -> DataFrame:
    """``container_kind``, ``container`` of every container that exceeds a limit; a piece that alone exceeds the attention
    cost has a container of its own, which is none. There are no such containers."""
    each = packed.groupBy("container_kind", "capacity", "container").agg(F.count("*").alias("n"), F.sum("size").alias("tokens"), F.sum(F.col("size").cast("double") ** 2).alias("cost"))
    over = (F.col("tokens") > F.col("capacity")) | (F.col("n") > 1) & (F.col("cost") > limits.attention * F.col("capacity").cast("double") ** 2)
    if limits.documents:
        over |= F.col("n") > limits.documents
    return each.where(over).select("container_kind", "container")


def _packer(key: str, limits: Limits, turn: int, last: bool):
    """Packs one shard of one kind."""

    def run(keys: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        capacity = int(rows["capacity"].iloc[0])
        rows = rows.sort_values(["size", key, "piece"], ascending=[False, True, True], kind="stable")
        bins = best_fit(rows["size"].to_numpy(np.int64), capacity, limits)
        again = (capacity - np.bincount(bins, weights=rows["size"]) > ROOM * capacity) & (not last)
        number = (turn << 56) + (int(keys[1]) << 24) + bins
        return pd.DataFrame({"container_kind": rows["container_kind"], "capacity": rows["capacity"], "container": number, key: rows[key], "piece": rows["piece"], "size": rows["size"], "open": again[bins], "turn": np.int32(turn)})

    return run


def filled(packed: DataFrame) -> DataFrame:
    """Per kind: containers, tokens, and the share of their room that is used."""
    out = packed.groupBy("container_kind", "capacity").agg(F.countDistinct("container").alias("containers"), F.sum("size").alias("tokens"))
    return out.withColumn("used", F.col("tokens") / (F.col("containers") * F.col("capacity")))
