"""A query's rows against its SQL's."""

from __future__ import annotations

import math
from pathlib import Path


def rows(frame) -> list[tuple]:
    """The rows of a pandas frame with columns by name, numbers rounded, in a fixed order."""

    def cell(x):
        if x is None or isinstance(x, float) and math.isnan(x) or str(x) in ("NaT", "<NA>"):
            return ""
        if isinstance(x, bool) or type(x).__name__.startswith("bool"):
            return str(bool(x))
        if isinstance(x, (int, float)) or type(x).__name__[:3] in ("int", "flo", "uin"):
            return f"{float(x):.6f}".replace("-0.000000", "0.000000")
        return str(x)

    frame = frame[sorted(frame.columns)]
    return sorted(tuple(map(cell, r)) for r in frame.itertuples(index=False))


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for f in sorted(Path(sf_dir).glob("*.parquet")):
        con.sql(f"create view {f.stem} as select * from '{f}'")
    return con
