"""The registry against DuckDB on the smallest tables; the library stands without its llm part."""

import os
import re
import subprocess
import sys
from pathlib import Path

import pytest

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def cell(x):
    if x is None or x != x:
        return "~"
    if isinstance(x, float) or type(x).__name__ == "Decimal":
        return f"{float(x):.9g}"
    return str(x)


def plain(row):
    """Numbers in one notation: SQL gives decimals or integers where Spark gives doubles."""
    return tuple(f"{float(c):.9g}" if re.fullmatch(r"-?\d+(\.\d+)?(e[+-]\d+)?", c) else c.lower() if c in ("True", "False") else c for c in row)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_queries_against_sql(spark):
    import duckdb

    from abacora.plans import registry

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    wrong = []
    for name, sql in registry.ORACLES.items():
        df = registry.QUERIES[name](spark, DATA)
        cols = sorted(df.columns)
        got = sorted(tuple(cell(r[c]) for c in cols) for r in df.collect())
        rel = con.sql(sql)
        at = [rel.columns.index(c) for c in cols]
        wanted = sorted(tuple(cell(r[i]) for i in at) for r in rel.fetchall())
        if sorted(map(plain, got)) != sorted(map(plain, wanted)):
            wrong.append(name)
    assert wrong == []


def test_imports_need_no_session():
    code = "import __spark_entry__ as e; assert e.queries() and e.oracle_sql(); import abacora.streaming.scoring, abacora.sources.records"
    subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parents[1], check=True)


def test_nothing_imports_llm():
    root = Path(__file__).resolve().parents[1] / "abacora"
    assert [p for p in root.rglob("*.py") if "llm" not in p.parts and re.search(r"\bllm\b", p.read_text())] == []
