"""Every registered query against its DuckDB oracle on the smallest driver tables."""

import decimal
import math

import pytest

import __spark_entry__ as entry
from tests.conftest import SF_SMALL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if v is None or isinstance(v, (bool, int)):
        return v
    return str(v)


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


def test_entry_smoke(spark):
    df = entry.entry(spark)
    rows = spark.read.parquet(f"{SF_SMALL}/events.parquet").count()
    assert df.count() == rows and "anomaly_label_final" in df.columns


@pytest.mark.parametrize("name", [n for n in sorted(entry.oracle_sql()) if not n.startswith("op")])
def test_query_matches_oracle(spark, duck, name):
    sdf = entry.queries()[name](spark, SF_SMALL)
    cols = sorted(sdf.columns)
    got = sorted((tuple(_norm(r[c]) for c in cols) for r in sdf.collect()), key=repr)
    rel = duck.sql(entry.oracle_sql()[name])
    assert sorted(rel.columns) == cols
    idx = [rel.columns.index(c) for c in cols]
    want = sorted((tuple(_norm(r[i]) for i in idx) for r in rel.fetchall()), key=repr)
    assert got == want


NO_ORACLE = {"templates_spell", "isolation_forest", "lof", "features", "embed",
             "explain_files", "trim_iterative", "one_class_svm", "explain_lines_semantic"}


def own(names):
    """Without the queries that have a test folder of their own."""
    return sorted(n for n in names if not n.startswith("op") and n != "pipeline")


def test_every_query_has_an_oracle_or_is_listed():
    assert set(own(set(entry.queries()) - set(entry.oracle_sql()))) <= NO_ORACLE


@pytest.mark.parametrize("name", own(set(entry.queries()) - set(entry.oracle_sql())))
def test_rows_only_queries_run(spark, name):
    assert entry.queries()[name](spark, SF_SMALL).count() > 0
