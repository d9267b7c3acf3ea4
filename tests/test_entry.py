import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def rows_of(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(f"{r[i]:.6f}" if isinstance(r[i], float) else str(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(n for n in __spark_entry__.oracle_sql() if not n.startswith("op")))
def test_query_against_sql(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = __spark_entry__.queries()[name](spark, SF)
    found = db.sql(__spark_entry__.oracle_sql()[name])
    assert sorted(df.columns) == sorted(found.columns)
    assert rows_of(map(tuple, df.collect()), df.columns) == rows_of(found.fetchall(), found.columns)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_the_rest_imports_without_the_training_data_operators(tmp_path):
    here = os.path.dirname(os.path.abspath(__spark_entry__.__file__))
    for x in os.listdir(here):
        if x not in ("lumifuzz", "corpus_pipeline.py", ".git"):
            os.symlink(f"{here}/{x}", tmp_path / x)
    os.mkdir(tmp_path / "lumifuzz")
    for x in os.listdir(f"{here}/lumifuzz"):
        if x != "llm":
            os.symlink(f"{here}/lumifuzz/{x}", tmp_path / "lumifuzz" / x)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'flagship_winner_summary' in q and not any(n.startswith('op') or n == 'pipeline' for n in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, check=True)
