import subprocess
import sys
from pathlib import Path

import pytest

from glossmill.plans.queries import ORACLE_SQL, QUERIES

ROOT = Path(__file__).resolve().parent.parent
DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_entry_imports_without_the_llm_folders():
    code = "import sys; sys.modules['glossmill.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    said = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=True).stdout
    assert said.split() == [str(len(QUERIES)), str(len(ORACLE_SQL))]


def test_nothing_outside_imports_llm():
    for path in (ROOT / "glossmill").rglob("*.py"):
        if "llm" not in path.parts:
            assert "llm" not in path.read_text(encoding="utf-8"), path


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not DATA.exists():
        pytest.skip("no driver tables here")
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


def plain(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    return sorted(map(repr, frame.where(frame.notna(), None).itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_oracle(spark, duck, name):
    assert plain(QUERIES[name](spark, str(DATA)).toPandas()) == plain(duck.sql(ORACLE_SQL[name]).df())


def test_flagship(spark):
    if not DATA.exists():
        pytest.skip("no driver tables here")
    import __spark_entry__

    row = __spark_entry__.entry(spark).first()
    assert row.n_utts > 0 and row.findings
