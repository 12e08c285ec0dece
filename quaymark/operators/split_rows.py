"""Delimited raw records into valid rows and reasoned rejects (problem 4).

A batch of records is one byte buffer. A quote mask and its running parity, restarted at each
record, tell which delimiters and line breaks stand outside quotes; everything up to the columns'
bytes is numpy over the whole buffer. Counts and types are then checked column by column.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COLUMNS = ("task", "pos", "lang", "input", "output", "loaded_at")
_QUOTE, _COMMA, _LF, _CR = 34, 44, 10, 13
_CONTROL = r"[\x00-\x09\x0b-\x1f\x7f-\x{9f}]"
_DAYS = np.array([0, 31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31])


def structure(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per record: is its quoting broken, its number of columns, and for records of ``width`` sound columns
    the (start, end) byte positions of each column, in record order."""
    n = len(offsets) - 1
    sizes = np.diff(offsets)
    record = np.repeat(np.arange(n), sizes)
    quote = data == _QUOTE
    running = np.concatenate([[0], np.cumsum(quote)])
    inside = ((running[:-1] - running[offsets[:-1]][record]) & 1).astype(bool)  # an odd number of quotes stands before
    comma = (data == _COMMA) & ~inside
    first = np.zeros(len(data), bool)
    last = np.zeros(len(data), bool)
    full = sizes > 0
    first[offsets[:-1][full]] = True
    last[offsets[1:][full] - 1] = True

    before = np.concatenate([[False], (comma | (quote & inside))[:-1]])
    after = np.concatenate([((data == _COMMA) | quote)[1:], [False]])
    opening, closing = quote & ~inside, quote & inside
    wrong = (opening & ~(first | before)) | (closing & ~(last | after)) | (((data == _LF) | (data == _CR)) & ~inside)
    broken = np.bincount(record[wrong], minlength=n).astype(bool)
    broken |= ((running[offsets[1:]] - running[offsets[:-1]]) & 1).astype(bool)

    count = np.bincount(record[comma], minlength=n) + 1
    good = ~broken & (count == width)
    cuts = np.flatnonzero(comma & good[record]).reshape(-1, width - 1)
    starts = np.column_stack([offsets[:-1][good], cuts + 1])
    ends = np.column_stack([cuts, offsets[1:][good]])
    return broken, count, np.stack([starts, ends], axis=-1)


def column(data: np.ndarray, spans: np.ndarray) -> pa.Array:
    """The strings at ``spans``, without their outer quotes and with doubled quotes made single."""
    starts, ends = spans[:, 0].copy(), spans[:, 1].copy()
    quoted = (ends - starts >= 2) & (data[np.minimum(starts, max(len(data) - 1, 0))] == _QUOTE) if len(data) else np.zeros(len(spans), bool)
    starts[quoted] += 1
    ends[quoted] -= 1
    sizes = ends - starts
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    picked = data[np.repeat(starts - offsets[:-1], sizes) + np.arange(offsets[-1])] if offsets[-1] else data[:0]
    text = pa.LargeStringArray.from_buffers(len(spans), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(picked)))
    return pc.if_else(pa.array(quoted), pc.replace_substring(text, '""', '"'), text)


def _whole_number(text: pa.Array) -> pa.Array:
    digits = pc.match_substring_regex(text, r"\A[0-9]+\z")
    short = pc.utf8_ltrim(text, "0")
    size = pc.utf8_length(short)
    fits = pc.or_(pc.less(size, 19), pc.and_(pc.equal(size, 19), pc.less_equal(short, "9223372036854775807")))
    return pc.and_(digits, fits)


def _existing_time(text: pa.Array) -> np.ndarray:
    form = pc.match_substring_regex(text, r"\A[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}\z")
    ok = form.to_numpy(zero_copy_only=False).astype(bool)
    if not ok.any():
        return ok
    chars = np.frombuffer("".join(text.filter(form).to_pylist()).encode(), np.uint8).reshape(-1, 19).astype(np.int64) - 48
    year, month, day, hour, minute, second = (chars[:, a:b] @ (10 ** np.arange(b - a)[::-1]) for a, b in ((0, 4), (5, 7), (8, 10), (11, 13), (14, 16), (17, 19)))
    leap = (year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0))
    days = _DAYS[np.clip(month, 0, 12)] + (leap & (month == 2))
    ok[ok] = (year >= 1) & (month >= 1) & (month <= 12) & (day >= 1) & (day <= days) & (hour < 24) & (minute < 60) & (second < 60)
    return ok


def _stated(text: pa.Array) -> pa.Array:
    return pc.and_(pc.greater(pc.utf8_length(pc.utf8_trim_whitespace(text)), 0), pc.invert(pc.match_substring_regex(text, _CONTROL)))


def parse_batch(lines: pa.Array) -> tuple[pa.Array, dict[str, pa.Array]]:
    """Reason (null where the row is sound so far) and the columns (null where rejected) of a batch of raw records."""
    lines = lines.cast(pa.large_binary())
    null = lines.is_null().to_numpy(zero_copy_only=False)
    lines = lines.fill_null(b"")
    offsets = np.frombuffer(lines.buffers()[1], np.int64)[lines.offset : lines.offset + len(lines) + 1]
    body = lines.buffers()[2]
    data = np.frombuffer(body, np.uint8)[offsets[0] : offsets[-1]] if body is not None and len(lines) else np.zeros(0, np.uint8)
    broken, count, spans = structure(data, offsets - offsets[0], len(COLUMNS))
    good = ~broken & (count == len(COLUMNS)) & ~null
    reason = np.where(broken, "broken_quoting", np.where(good, None, "column_count")).astype(object)
    cols = {c: column(data, spans[:, k]) for k, c in enumerate(COLUMNS)}
    sound = pc.and_(_whole_number(cols["pos"]), pc.and_(_stated(cols["input"]), _stated(cols["output"]))).to_numpy(zero_copy_only=False).astype(bool)
    sound &= _existing_time(cols["loaded_at"])
    kept = np.flatnonzero(good)
    reason[kept[~sound]] = "invalid_value"
    place = np.full(len(lines), -1)
    place[kept] = np.arange(len(kept))
    take = pa.array(place, pa.int64(), mask=place < 0)
    return pa.array(reason, pa.string()), {c: v.take(take).cast(pa.string()) for c, v in cols.items()}


def split_rows(raw: DataFrame, tasks: DataFrame, key: str = "line_id", line: str = "raw_line", keep: tuple[str, ...] = ()) -> DataFrame:
    """Every raw record once: ``key``, ``keep`` columns, ``reason`` and the six parsed columns.

    ``reason`` is null for a loadable row, else the first that holds of 'broken_quoting' (a quote that neither
    opens nor closes a column, an open quote at the end, a line break outside quotes), 'column_count' and
    'invalid_value'. A null record has no columns: 'column_count'; an empty one has a single one: the same.
    Other columns of ``raw`` are ignored, whatever their names. An empty table gives an empty result.
    The value lists (``tasks.task``, both language columns) are joined, so Spark broadcasts them only below
    its size threshold.
    """
    out = ", ".join([f"{key} bigint", *(f"{c} {raw.schema[c].dataType.simpleString()}" for c in keep), "reason string", *(f"{c} string" for c in (f"_{c}" for c in COLUMNS))])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                reason, cols = parse_batch(b.column(b.schema.names.index(line)))
                yield pa.RecordBatch.from_arrays([b.column(0), *(b.column(b.schema.names.index(c)) for c in keep), reason, *cols.values()], [key, *keep, "reason", *(f"_{c}" for c in cols)])

    parsed = raw.select(F.col(key).cast("bigint").alias(key), *keep, line).mapInArrow(parse, out)
    names = tasks.select(F.col("task").alias("_known_task")).where("_known_task is not null").distinct()
    langs = tasks.select(F.explode(F.array("input_language", "output_language")).alias("_known_lang")).where("_known_lang is not null").distinct()
    joined = parsed.join(names, parsed["_task"] == names["_known_task"], "left").join(langs, parsed["_lang"] == langs["_known_lang"], "left")
    unknown = F.col("reason").isNull() & (F.col("_known_task").isNull() | F.col("_known_lang").isNull())
    reason = F.when(unknown, "invalid_value").otherwise(F.col("reason"))
    loaded = {"pos": F.expr("try_cast(_pos as bigint)"), "loaded_at": F.expr("try_cast(_loaded_at as timestamp_ntz)")}
    flat = joined.select(key, *keep, reason.alias("reason"), *(f"_{c}" for c in COLUMNS))
    return flat.select(key, *keep, "reason", *(F.when(F.col("reason").isNull(), loaded.get(c, F.col(f"_{c}"))).alias(c) for c in COLUMNS))


def rejects(raw: DataFrame, tasks: DataFrame) -> DataFrame:
    """``line_id``, ``reason`` of the records that can't be loaded."""
    return split_rows(raw, tasks).where("reason is not null").select("line_id", "reason")


def loadable(raw: DataFrame, tasks: DataFrame) -> DataFrame:
    """The good records with their typed columns."""
    return split_rows(raw, tasks, keep=("file_name", "line_no")).where("reason is null").drop("reason")


FOUND_SQL = r"""
with shaped as (
  select line_id, raw_line,
         regexp_full_match(raw_line, '(?s)("([^"]|"")*"|[^",\n\r]*)(,("([^"]|"")*"|[^",\n\r]*))*') as sound
  from raw_instances
), counted as (
  select line_id, sound, raw_line,
         case when sound then len(regexp_extract_all(',' || raw_line, '(?s),("([^"]|"")*"|[^",\n\r]*)')) end as n,
         case when sound then regexp_extract_all(',' || raw_line, '(?s),("([^"]|"")*"|[^",\n\r]*)', 1) end as f
  from shaped
), plain as (
  select line_id, sound, n, raw_line,
         case when n = 6 then list_transform(f, lambda x: case when starts_with(x, '"') then replace(x[2:-2], '""', '"') else x end) end as f
  from counted
), reasoned as (
  select line_id,
    case when raw_line is null then 'column_count'
         when not sound then 'broken_quoting'
         when n <> 6 then 'column_count'
         when f[1] not in (select task from tasks) then 'invalid_value'
         when not regexp_full_match(f[2], '[0-9]+') or try_cast(f[2] as bigint) is null then 'invalid_value'
         when f[3] not in (select input_language from tasks union select output_language from tasks) then 'invalid_value'
         when not regexp_matches(f[4], '[^\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]')
           or not regexp_matches(f[5], '[^\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]') then 'invalid_value'
         when regexp_matches(f[4] || f[5], '[\x00-\x09\x0b-\x1f\x7f-\x{9f}]') then 'invalid_value'
         when not regexp_full_match(f[6], '[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}')
           or try_strptime(f[6], '%Y-%m-%d %H:%M:%S') is null then 'invalid_value'
    end as reason
  from plain
)
select line_id, reason from reasoned where reason is not null
"""

LOADED_SQL = FOUND_SQL.replace(
    "select line_id, reason from reasoned where reason is not null",
    """select line_id, r.file_name, r.line_no, f[1] as task, f[2]::bigint as pos, f[3] as lang, f[4] as input, f[5] as output, f[6]::timestamp as loaded_at
from plain join reasoned using (line_id) join raw_instances r using (line_id) where reason is null""",
)
