"""Every query of the engine against its SQL, and plans that must stay as they are."""

import pytest

from logweir.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(spark, duck, rows_of, name):
    got = catalog.QUERIES[name](spark, SF).toPandas()
    want = duck.sql(catalog.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)


def test_codes_of_ids_sort_by_time(spark):
    rows = catalog.QUERIES["event_ids"](spark, SF).orderBy("global_offset").collect()
    codes = [r["code"] for r in rows]
    assert codes == sorted(codes) and all(len(c) == 13 for c in codes)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scan_of_a_range_is_pushed_to_the_files(spark):
    text = plan(catalog.QUERIES["dlq_range"](spark, SF))
    assert "PushedFilters: [IsNotNull(event_id)" in text and "ReadSchema: struct<event_id:bigint,event_type:string>" in text


def test_pages_are_a_top_n_without_a_sort_of_all(spark):
    text = plan(catalog.QUERIES["outbox_by_status"](spark, SF))
    assert "TakeOrderedAndProject" in text and "Exchange rangepartitioning" not in text


def test_heads_of_streams_are_combined_before_the_shuffle(spark):
    assert "partial_count" in plan(catalog.QUERIES["stream_head"](spark, SF))


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
