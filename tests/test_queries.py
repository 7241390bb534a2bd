"""Every registered query beside the optional ones runs on the smallest tables and equals its SQL."""

import duckdb
import pytest

from siftwell.catalog import ORACLE_SQL, QUERIES
from verify import TABLES, rows

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, con, name):
    got = QUERIES[name](spark, SF).toPandas()
    if name in ORACLE_SQL:
        want = con.execute(ORACLE_SQL[name]).fetchdf()
        assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


def test_core_needs_no_optional_part():
    import ast
    from pathlib import Path

    root = Path(__file__).parent.parent / "siftwell"
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            for node in ast.walk(ast.parse(p.read_text())):
                names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
                assert not any("llm" in n or "corpus_pipeline" in n for n in names), p
