"""Every registered query against its DuckDB oracle on the smallest tables, and entry()."""

import importlib.util
import os

import pytest

from conftest import SF001

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def _entry_module():
    spec = importlib.util.spec_from_file_location("spark_entry", os.path.join(ROOT, "__spark_entry__.py"))
    mod = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(mod)
    return mod


ENTRY = _entry_module()

from cuefind.plans import catalog  # noqa: E402  (importable once the entry module is loaded)


def test_entry_smoke(spark):
    df = ENTRY.entry(spark)
    rows = df.collect()
    assert len(rows) > 0 and "similarity_score" in df.columns


def test_every_query_has_an_oracle():
    assert set(catalog.ORACLE) == set(catalog.QUERIES)
    assert len(catalog.QUERIES) == 41   # a dropped registration fails here
    assert set(catalog.QUERIES) <= set(ENTRY.queries()) and set(catalog.ORACLE) <= set(ENTRY.oracle_sql())


@pytest.fixture(scope="module")
def duck():
    from oracle_compare import duck_connect
    return duck_connect(SF001)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_matches_oracle(spark, duck, name):
    from oracle_compare import compare
    res = compare(spark, name, SF001, duck)
    assert res.get("match"), res
