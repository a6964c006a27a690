"""Every registered query with check SQL gives the same rows as DuckDB."""

from __future__ import annotations

import pathlib
import subprocess
import sys

import pytest
from parity import compare, open_views

from moundwork.plans import catalog

ITEMS = catalog.load()


@pytest.fixture(scope="module")
def duck(folder):
    return open_views(folder)


@pytest.mark.parametrize("name", [n for n, item in ITEMS.items() if item.sql is not None])
def test_query_matches_sql(name, spark, folder, duck):
    item = ITEMS[name]
    frame = item.run(spark, folder)
    cursor = duck.execute(item.oracle())
    names = [d[0] for d in cursor.description]
    problem, _ = compare([tuple(r) for r in frame.collect()], frame.columns, cursor.fetchall(), names)
    assert problem is None, problem


def test_entry_points():
    import __spark_entry__ as driver

    assert set(driver.oracle_sql()) <= set(driver.queries())
    assert len(driver.queries()) > 150


def test_queries_load_without_the_corpus_part_or_its_libraries():
    """Hidden modules must not take the other queries away."""
    code = """
import sys
class Hidden:
    def find_spec(self, name, path=None, target=None):
        if name.split(".")[0] == HIDE or name == HIDE:
            raise ModuleNotFoundError(f"No module named {name!r}", name=name)
sys.meta_path.insert(0, Hidden())
import __spark_entry__ as entry
names = entry.queries()
assert len(names) > 250 and "pipeline" not in names and "pipeline" not in entry.oracle_sql()
"""
    root = pathlib.Path(__file__).resolve().parents[1]
    for hidden in ("corpus_pipeline", "moundwork.llm", "xxhash"):
        found = subprocess.run([sys.executable, "-c", f"HIDE = {hidden!r}\n{code}"], cwd=root, capture_output=True, text=True)
        assert found.returncode == 0, found.stderr
