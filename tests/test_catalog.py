"""Every registry query against its oracle, at the smallest scale."""

import datetime
import decimal

import pytest

duckdb = pytest.importorskip("duckdb")

from hearthspark.plans import catalog  # noqa: E402
from tests.conftest import SF  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted({f.__name__: k for k, f in catalog.QUERIES.items()}.values()))
def test_matches_oracle(spark, db, name):
    df = catalog.QUERIES[name](spark, SF)
    if name not in catalog.ORACLES:
        assert df.count() > 0
        return
    cur = db.execute(catalog.ORACLES[name])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(df.columns)
    want = sorted((tuple(map(plain, r)) for r in cur.fetchall()), key=repr)
    assert sorted((tuple(map(plain, r)) for r in df.select(*cols).collect()), key=repr) == want


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(catalog.QUERIES) <= set(e.queries()) and set(catalog.ORACLES) <= set(e.oracle_sql())


def test_imports_without_the_optional_part(tmp_path):
    """A copy without the llm folders and the pipeline still imports."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    shutil.copytree(root / "hearthspark", tmp_path / "hearthspark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; q = e.queries(); print(len(q), any(k.startswith('op1_') for k in q))"], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert out.stdout.split()[1:] == ["False"], out.stderr
