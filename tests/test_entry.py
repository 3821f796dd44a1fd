import os
import shutil
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from foliary.plans import archive, catalog

assert catalog  # its queries are registered beside the archive's

DIR = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DIR):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DIR}/{f}'")
    return con


def cells(rows):
    norm = lambda v: round(float(v), 6) if isinstance(v, float) or type(v).__name__ == "Decimal" else v
    return sorted(repr([norm(v) for v in r]) for r in rows)


@pytest.mark.parametrize("name", sorted(archive.SQL))
def test_equals_sql(spark, duck, name):
    frame = archive.QUERIES[name](spark, DIR)
    columns = sorted(frame.columns)
    got = [tuple(r) for r in frame.select(*columns).collect()]
    want = duck.execute(f"SELECT {', '.join(columns)} FROM ({archive.SQL[name]})").fetchall()
    assert cells(got) == cells(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())


def test_stands_without_the_subpackage(tmp_path):
    shutil.copytree(f"{ROOT}/foliary", tmp_path / "foliary", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert e.queries() and not any(q.startswith('op') for q in e.queries() if q[2:3].isdigit())"
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, check=False).returncode == 0


def test_listing_pages_do_not_grow_with_the_table(spark, monkeypatch):
    from pyspark.sql import functions as F

    seen, real = [], catalog.markup.listing_summary
    monkeypatch.setattr(catalog.markup, "listing_summary", lambda pages: seen.append(pages.agg(F.max(F.length("html"))).first()[0]) or real(pages))
    assert sum(r.rows for r in archive.QUERIES["listing_summary"](spark, DIR).collect()) == 1500 and seen[0] < 15_000
