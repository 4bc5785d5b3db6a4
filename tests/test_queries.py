import pytest

import __spark_entry__
from tests.oracle import rows_of_spark, rows_of_sql

CORE = __spark_entry__.importlib.import_module("sheaf.plans.queries")
TRAINING = __spark_entry__.importlib.import_module("sheaf.plans.training")


@pytest.mark.parametrize("name", sorted(CORE.SQL))
def test_same_rows_as_sql(spark, folder, name):
    names, want = rows_of_sql(CORE.SQL[name], folder)
    got_names, got = rows_of_spark(CORE.QUERIES[name](spark, folder))
    assert got_names == names
    assert got == want
    assert sum(got.values()) > 0


@pytest.mark.parametrize("name", sorted(set(CORE.QUERIES) - set(CORE.SQL)) + sorted(TRAINING.QUERIES))
def test_gives_rows(spark, folder, name):
    query = (CORE.QUERIES | TRAINING.QUERIES)[name]
    assert query(spark, folder).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).limit(1).count() == 1


def test_every_sql_has_its_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_paper_concat_loses_no_text(spark, folder):
    documents = spark.read.parquet(f"{folder}/documents.parquet")
    whole = sum(len(r["text"] or "") for r in documents.select("text").collect())
    groups = [r["joined"] for r in CORE.QUERIES["paper_concat"](spark, folder).collect()]
    between = len("\n\n---\n\n") * (documents.count() - len(groups))
    assert sum(map(len, groups)) == whole + between and len(groups) > 1


def test_filters_and_columns_reach_the_scan(spark, folder):
    plan = CORE.QUERIES["status_counts"](spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<status:string>" in plan
    plan = CORE.QUERIES["garbage_flag"](spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<result_id:bigint,markdown:string>" in plan and "Exchange" not in plan and "Python" not in plan
