"""Every query against its SQL counterpart, and the package without its optional part."""

import os
import shutil
import subprocess
import sys

import duckdb
import pandas as pd
import pytest

from quire.plans import registry

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables")


def plain(df):
    def value(v):
        if hasattr(v, "__len__") and not isinstance(v, str | bytes):
            return str(list(v))
        if v is None or v is pd.NA or v != v:
            return ""
        return f"{v:.9g}" if isinstance(v, float) else str(v)

    return sorted(tuple(value(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))


@needs_data
@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_against_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    got, want = registry.queries()[name](spark, DATA).toPandas(), con.execute(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


def test_every_query_has_an_oracle():
    assert set(registry.oracle_sql()) == set(registry.queries())


def test_entry_works_without_the_optional_part(tmp_path):
    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(os.path.join(here, "quire"), tmp_path / "quire", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(here, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert q and set(o) <= set(q) and not any(n.startswith('op') and n[2].isdigit() for n in q) and 'pipeline' not in q"
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, check=False).returncode == 0
