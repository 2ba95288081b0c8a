"""Every query with SQL gives what the SQL gives, and every query runs."""

import os

import duckdb
import pytest

from paperloom.plans.queries import QUERIES, SQL


def rows_of(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(repr(round(r[i], 6)) if isinstance(r[i], float) else repr(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, name):
    got = QUERIES[name](spark, data)
    rows = [tuple(r) for r in got.collect()]
    assert rows
    if name in SQL:
        db = duckdb.connect()
        for file in os.listdir(data):
            db.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{data}/{file}'")
        result = db.execute(SQL[name])
        columns = [c[0] for c in result.description]
        assert sorted(columns) == sorted(got.columns)
        assert rows_of(rows, got.columns) == rows_of(result.fetchall(), columns)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_on_empty_tables(spark, empty, name):
    rows = QUERIES[name](spark, empty).collect()
    assert not rows or name in ("run_pass_rate", "supervision", "training_counts")


@pytest.fixture(scope="module")
def empty(spark, data, tmp_path_factory):
    folder = tmp_path_factory.mktemp("empty")
    for file in os.listdir(data):
        spark.read.parquet(f"{data}/{file}").limit(0).write.parquet(f"{folder}/{file}")
    return str(folder)


@pytest.mark.parametrize("name", "section_text section_forward_fill doc_title heading_match text_normalize paragraph_chunks token_chunks cleaned_answers qa_texts evidence_prompts training_counts".split())
def test_texts_stay_where_they_are(spark, data, name):
    """No exchange, or (training_counts) none that carries a chunk of a text before it is chosen."""
    plan = QUERIES[name](spark, data)._jdf.queryExecution().executedPlan().toString()
    if name != "training_counts":
        assert "Exchange" not in plan
    assert "CartesianProduct" not in plan


def test_filters_and_columns_reach_the_scan(spark, data):
    plan = QUERIES["run_pass_rate"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<qc_ok:boolean>" in plan
    plan = QUERIES["prefix_dedup"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "IsNotNull(text)" in plan
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan
