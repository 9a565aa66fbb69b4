"""Every query with SQL against that SQL, on the smallest tables; and the rest of the package without the training-data operators."""

import os
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

ROOT = Path(__file__).resolve().parents[1]
DATA = Path("/root/testdata/sf0.001")
sys.path.insert(0, str(ROOT))
from lectern.plans import book_queries, library_queries, queries  # noqa: E402

assert book_queries and library_queries
needs_data = pytest.mark.skipif(not DATA.exists(), reason="no tables here")


def canon(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([round(r[i], 6) if isinstance(r[i], float) else r[i] for i in order]) for r in rows)


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


@needs_data
@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, name):
    df = queries.QUERIES[name](spark, str(DATA))
    got = canon(df.columns, [tuple(r) for r in df.collect()])
    assert got or name == "yo_lookup"
    if name in queries.ORACLE_SQL:
        cur = duck.execute(queries.ORACLE_SQL[name])
        assert got == canon([c[0] for c in cur.description], cur.fetchall())


@needs_data
@pytest.mark.parametrize("rule", [r.id for r in queries.R.STEPS])
def test_no_rule_is_tried_in_vain(spark, rule):
    """A query whose rule finds nothing would match its SQL whatever it does."""
    df = queries.QUERIES[f"rule_{rule.replace('-', '_')}"](spark, str(DATA))
    assert df.agg({"n_findings": "sum"}).first()[0] > 0


def test_entry_without_the_training_operators(tmp_path):
    for p in ROOT.iterdir():
        if p.name not in ("lectern", "corpus_pipeline.py", ".git", "tests"):
            (tmp_path / p.name).symlink_to(p)
    (tmp_path / "lectern").mkdir()
    for p in (ROOT / "lectern").iterdir():
        if p.name != "llm":
            (tmp_path / "lectern" / p.name).symlink_to(p)
    code = "import __spark_entry__ as e; assert e._llm is None and len(e.queries()) > 60 and not [n for n in e.queries() if n[2:3].isdigit()]"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})
