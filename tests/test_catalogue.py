"""Every registered query against its SQL, and the entry without the optional part."""

import shutil
import subprocess
import sys
from collections import Counter
from pathlib import Path

import duckdb
import pytest

from sparklode.plans.catalogue import ORACLE, QUERIES

REPO, DATA = Path(__file__).resolve().parents[1], Path("/root/testdata/sf0.001")


def rows(frame, columns):
    return Counter(tuple(None if v is None or v != v else round(float(v), 6) if isinstance(v, float) else v for v in r) for r in frame[columns].astype(object).values.tolist())


@pytest.mark.skipif(not DATA.exists(), reason="the tables are not here")
@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, name):
    got = QUERIES[name](spark, str(DATA)).toPandas()
    if name in ORACLE:
        db = duckdb.connect()
        for table in DATA.glob("*.parquet"):
            db.execute(f"CREATE VIEW {table.stem} AS SELECT * FROM '{table}'")
        want = db.execute(ORACLE[name]).fetchdf()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got, sorted(got.columns)) == rows(want, sorted(want.columns))


def test_entry_without_the_corpus_operators(tmp_path):
    shutil.copytree(REPO / "sparklode", tmp_path / "sparklode", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(REPO / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'pipeline' not in q and len(q) > 30 and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)
