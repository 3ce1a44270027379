"""Every core query against its SQL on the smallest tables."""

from __future__ import annotations

import importlib
import pkgutil

import pytest

import lastro.plans
from conftest import rows_of

MODULES = [importlib.import_module(f"lastro.plans.{m.name}") for m in pkgutil.iter_modules(lastro.plans.__path__)]
CASES = [(m, q) for m in MODULES for q in m.QUERIES]


@pytest.mark.parametrize(("module", "name"), CASES, ids=[q for _, q in CASES])
def test_query(spark, sf, duck, module, name):
    got = module.QUERIES[name](spark, sf).toPandas()
    if name in module.SQL:
        want = duck.execute(module.SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows_of(got) == rows_of(want)
    else:
        assert list(got.columns)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).limit(1).count() == 1
    assert set(e.oracle_sql()) <= set(e.queries())


def test_core_stands_alone():
    from pathlib import Path

    root = Path(lastro.plans.__file__).parent.parent
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert "lastro.llm" not in p.read_text(), p
