"""Every registered query against DuckDB, where SQL can express it."""

import pytest

from planweave.plans.coverage import covered, report
from planweave.queries import ORACLES, QUERIES

from .compare import duck, same
from .conftest import DATA


@pytest.fixture(scope="module")
def con():
    return duck(DATA)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, DATA)
    if name in ORACLES:
        same(df, con, ORACLES[name])
    else:
        assert df.count() >= 0


def test_every_row_of_the_inventory_has_a_query():
    assert [row for row, queries in covered().items() if not queries] == []
    assert report().endswith(f"{len(covered())} of {len(covered())} rows")


def test_nothing_has_drifted(spark, monkeypatch):
    from pyspark.sql import DataFrame

    from planweave.plans import coverage

    assert coverage.drift(spark) == []
    monkeypatch.setattr(DataFrame, "pivotAll", lambda self: self, raising=False)
    monkeypatch.setitem(coverage.CLAIMS, "R10", "limit limitBy")
    assert coverage.drift() == ["DataFrame.pivotAll is no row's", "DataFrame.limitBy of R10 is gone"]


def test_entry_is_complete(spark):
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


def test_samples_keep_their_bounds(spark):
    n = spark.read.parquet(f"{DATA}/events.parquet").count()
    assert 0 < QUERIES["sample"](spark, DATA).count() < n / 4
    kinds = {r["event_type"] for r in QUERIES["sample_by"](spark, DATA).collect()}
    assert kinds <= {"click", "error"}


def test_entry_imports_without_a_session():
    import subprocess
    import sys
    from pathlib import Path

    code = "import __spark_entry__ as e; print(len(e.queries()) >= len(e.oracle_sql()) > 100)"
    done = subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parents[1], capture_output=True, text=True)
    assert done.stdout.strip() == "True", done.stderr
