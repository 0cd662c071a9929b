"""Every query of the library against its SQL."""

import duckdb
import pytest
from pyspark.sql import functions as F

from clearwell.operators import layer1
from clearwell.queries import FLAGSHIP, QUERIES, SQL, table

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def views(data):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{data}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, data, views, name):
    df = QUERIES[name](spark, data)
    columns = sorted(df.columns)
    want = views.sql(SQL[name])
    assert sorted(want.columns) == columns
    listed = ", ".join(f'"{c}"' for c in columns)
    assert sorted(repr(tuple(r)) for r in df.select(columns).collect()) == sorted(map(repr, views.sql(f"select {listed} from ({SQL[name]})").fetchall()))


def test_entry(spark):
    import __spark_entry__

    rows = __spark_entry__.entry(spark).collect()
    assert len(rows) > 1 and sum(r["n_docs"] for r in rows) == table(spark, "/root/testdata/sf0.001", "documents").count() and FLAGSHIP in __spark_entry__.queries()
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_one_scan_and_few_python_stages(spark, data):
    from clearwell.plans import sanitize

    docs = table(spark, data, "documents").select("doc_id", "text")
    plan = sanitize.sanitize(docs, secrets=True)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("Union") == 0 and plan.count("ArrowEvalPython") <= 4
    native = docs.select(layer1.native(F.col("text")).alias("t"))._jdf.queryExecution().optimizedPlan().toString()
    assert native.count("regexp_replace") <= 10


def test_only_a_missing_subpackage_is_passed_over(monkeypatch):
    import __spark_entry__

    assert __spark_entry__._given("clearwell.llm.no_such_module") is None
    with pytest.raises(ModuleNotFoundError):
        __spark_entry__._given("no_such_package.module")
