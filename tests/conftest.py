from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
os.environ.setdefault("PYARROW_IGNORE_TIMEZONE", "1")

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from lastro.session import local_session

    return local_session(4, "tests", "4g")


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def rows_of(frame) -> list[str]:
    """Rows as comparable text: columns by name, floats to six places, every kind of missing alike."""

    def one(v):
        if v is None or str(v) in ("nan", "NaT", "<NA>", "None"):
            return "~"
        return round(float(v), 6) + 0.0 if isinstance(v, float) else str(v)

    return sorted(str(tuple(one(v) for v in r)) for r in frame[sorted(frame.columns)].astype(object).values.tolist())
