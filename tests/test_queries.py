"""Every registered query against its SQL counterpart in DuckDB."""

import importlib.util
import os

import pytest

duckdb = pytest.importorskip("duckdb")

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def load(path, name):
    spec = importlib.util.spec_from_file_location(name, os.path.join(ROOT, path))
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return module


from tidemark.plans import registry  # noqa: E402

contract = load("__spark_entry__.py", "spark_entry")
checker = load("tools/check_oracles.py", "check_oracles")

WITHOUT_SQL = set()


def test_only_inexpressible_queries_lack_sql():
    assert set(registry.queries()) - set(registry.oracle_sql()) == WITHOUT_SQL
    assert set(registry.queries()) <= set(contract.queries())
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.fixture(scope="module")
def database():
    sf_dir = "/root/testdata/sf0.001"
    if not os.path.isdir(sf_dir):
        pytest.skip("test tables are not mounted")
    return checker.database(sf_dir)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, database, sf_dir, name):
    assert checker.compare(spark, database, sf_dir, name) == ""


def test_entry(spark, sf_dir):
    df = contract.entry(spark)
    rows = df.collect()
    assert {r.engine for r in rows} == {"run_a", "run_b"} and not any(r.empty_run for r in rows)
    assert len(df.columns) == len(set(df.columns))
