"""Raw rows into good rows and reasons."""

from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quaymark.operators import split_rows

TASKS = [("t1", "en", "fr")]
OK = "t1,0,en,in,out,2024-02-29 00:00:00"


def _run(spark, lines):
    raw = spark.createDataFrame([(k, "f", k, x, "clash") for k, x in enumerate(lines)], "line_id bigint, file_name string, line_no bigint, raw_line string, reason string")
    tasks = spark.createDataFrame(TASKS, "task string, input_language string, output_language string")
    return {r.line_id: r for r in split_rows.split_rows(raw, tasks).collect()}


@pytest.mark.parametrize(
    "line,reason",
    [
        (OK, None),
        ('"t1","0","fr","a ""b"", c\nd",out,2024-01-01 23:59:59', None),
        (None, "column_count"),
        ("", "column_count"),
        ("t1;0;en;in;out;2024-01-01 00:00:00", "column_count"),
        (OK + ",more", "column_count"),
        ('t1,0,en,"in,out,2024-01-01 00:00:00', "broken_quoting"),
        ('t1,0,en,i"n,out,2024-01-01 00:00:00', "broken_quoting"),
        ('t1,0,en,"in"x,out,2024-01-01 00:00:00', "broken_quoting"),
        ('t1,0,en, "in",out,2024-01-01 00:00:00', "broken_quoting"),
        ("t1,0,en,in\nx,out,2024-01-01 00:00:00", "broken_quoting"),
        ('a"', "broken_quoting"),
        ("t2,0,en,in,out,2024-01-01 00:00:00", "invalid_value"),
        ("t1,-1,en,in,out,2024-01-01 00:00:00", "invalid_value"),
        ("t1,9223372036854775807,en,in,out,2024-01-01 00:00:00", None),
        ("t1,9223372036854775808,en,in,out,2024-01-01 00:00:00", "invalid_value"),
        ("t1,٣,en,in,out,2024-01-01 00:00:00", "invalid_value"),
        ("t1,0,de,in,out,2024-01-01 00:00:00", "invalid_value"),
        ("t1,0,en,\u00a0 ,out,2024-01-01 00:00:00", "invalid_value"),
        ('t1,0,en,"a\rb",out,2024-01-01 00:00:00', "invalid_value"),
        ("t1,0,en,a\tb,out,2024-01-01 00:00:00", "invalid_value"),
        ("t1,0,en,in,,2024-01-01 00:00:00", "invalid_value"),
        ("t1,0,en,in,out,2023-02-29 00:00:00", "invalid_value"),
        ("t1,0,en,in,out,2024-01-01 24:00:00", "invalid_value"),
        ("t1,0,en,in,out,2024-01-01T00:00:00", "invalid_value"),
    ],
)
def test_reasons(spark, line, reason):
    assert _run(spark, [line])[0].reason == reason


def test_values_long_rows_and_empty_table(spark):
    long = "x, " * 100_000
    got = _run(spark, ['"t1",007,en,"' + long + '","a ""b""",2024-02-29 12:00:00', OK, OK])
    assert got[0].input == long and got[0].output == 'a "b"' and got[0].pos == 7 and str(got[0].loaded_at) == "2024-02-29 12:00:00"
    assert len(got) == 3 and _run(spark, []) == {}


@settings(max_examples=25, deadline=None)
@given(st.lists(st.lists(st.text(alphabet='a,"\n ', max_size=6), min_size=6, max_size=6), min_size=1, max_size=5))
def test_round_trip(fields):
    import pyarrow as pa

    lines = [",".join('"' + f.replace('"', '""') + '"' for f in r) for r in fields]
    reason, cols = split_rows.parse_batch(pa.array(lines))
    assert set(reason.to_pylist()) <= {None, "invalid_value"}
    assert [list(r) for r in zip(*(c.to_pylist() for c in cols.values()))] == fields
