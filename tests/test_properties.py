"""Laws that hold on any data, checked on the test tables."""

from __future__ import annotations

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from conftest import DATA
from frames import rows_of
from stallwise.functions.work import fresh_path
from stallwise.operators import audit, baskets, clean, dims, ranking
from stallwise.plans import binding, customers as bound
from stallwise.plans.registry import Tables
from stallwise.sources import writers


@pytest.fixture(scope="module")
def tables(spark):
    return Tables(spark, f"{DATA}/sf0.001")


def test_in_set_and_not_in_set_partition_the_rows(tables):
    ids = tables.orders.select(F.col("o_custkey").alias("k"))
    rich = tables.customer.filter("c_acctbal > 5000").select(F.col("c_custkey").alias("k"))
    inside, outside = dims.in_set(ids, rich, "k").count(), dims.not_in_set(ids, rich, "k").count()
    assert inside + outside == ids.count()
    assert inside and outside


def test_day_baskets_lie_inside_user_baskets(tables):
    orders = bound._basket_orders(tables)
    daily = baskets.day_baskets(orders).select("account", "product_id")
    whole = baskets.user_baskets(orders).select("account", "product_id")
    assert daily.exceptAll(whole).count() >= 0
    assert daily.subtract(whole).isEmpty()


def test_union_minus_and_orphans_agree(tables):
    suppliers = tables.supplier.select(F.col("s_nationkey").alias("id"))
    customers = tables.customer.select(F.col("c_nationkey").alias("id"))
    both = audit.union_ids([suppliers, customers], "id")
    missing = audit.orphan_ids(suppliers, [customers], "id")
    assert rows_of(audit.minus_ids(both, suppliers, "id"), "id") == rows_of(missing, "id")


def test_upsert_twice_equals_once(spark, tables):
    rows = tables.orders.select("o_orderkey", "o_totalprice", F.date_format("o_orderdate", "yyyy").alias("year"))
    once, twice = fresh_path(spark, "once"), fresh_path(spark, "twice")
    writers.upsert(rows, once, "o_orderkey", ["o_totalprice"], "year")
    for _ in range(2):
        writers.upsert(rows, twice, "o_orderkey", ["o_totalprice"], "year")
    read = [spark.read.schema(rows.schema).parquet(p) for p in (once, twice)]
    assert read[0].count() == read[1].count() == rows.count()
    assert read[0].exceptAll(read[1]).isEmpty()


def test_upsert_leaves_other_folders_alone(spark):
    path = fresh_path(spark, "parts")
    first = spark.createDataFrame([(1, 10, "2023"), (2, 20, "2024")], "k int, v int, year string")
    second = spark.createDataFrame([(2, 21, "2024"), (3, 30, "2024")], "k int, v int, year string")
    for batch in (first, second, second):
        writers.upsert(batch, path, "k", ["v"], "year")
    stored = spark.read.schema(first.schema).parquet(path)
    assert rows_of(stored, "k", "v", "year") == [(1, 10, "2023"), (2, 21, "2024"), (3, 30, "2024")]


def test_replayed_increments_count_once(spark):
    path = fresh_path(spark, "counts")
    batch = spark.createDataFrame([("a", 2)], "k string, n bigint")
    write = writers.delta_sink(path)
    for batch_id in (0, 1, 1, 0):
        write(batch, batch_id)
    assert rows_of(writers.summed_deltas(spark, path, batch.schema, ["k"], "n"), "k", "n") == [("a", 4)]


def test_deltas_before_the_first_batch_are_empty(spark):
    schema = spark.createDataFrame([], "k string, n bigint").schema
    assert writers.latest_deltas(spark, fresh_path(spark, "none"), schema, ["k"]).isEmpty()


def test_latest_per_key_ignores_input_order(spark):
    rows = [("a", 1, "x"), ("a", 2, "y"), ("a", 2, "z"), ("b", None, "w")]
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "k string, ts int, v string")
        assert rows_of(writers.latest_per_key(df, ["k"], ["ts"]), "k", "ts", "v") == [("a", 2, "z"), ("b", None, "w")]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("abc"), st.integers(0, 5)), min_size=1, max_size=40))
def test_bands_cover_best_and_worst(spark, rows):
    named = [(k, f"n{i:02d}", float(v)) for i, (k, v) in enumerate(rows)]
    df = spark.createDataFrame(named, "k string, name string, v double")
    found = ranking.bands(df, ["k"], "v", "name").collect()
    for key in {k for k, _ in rows}:
        values = [v for k, v in rows if k == key]
        n = len(values)
        picked = {b: [r for r in found if r["k"] == key and r["band"] == b] for b in ("best", "worst", "top", "bottom", "median")}
        assert [r["v"] for r in picked["best"]] == [max(values)]
        assert [r["v"] for r in picked["worst"]] == [min(values)]
        assert len(picked["top"]) == len(picked["bottom"]) == n // 10 + (1 if n % 10 > 4 else 0)
        assert len(picked["median"]) == (1 if n % 2 else 2)


def test_valid_lines_split_all_lines(tables):
    every, valid = binding.all_lines(tables), binding.valid_lines(tables)
    dropped = every.filter(F.col("is_promotion") | (F.col("amount") >= binding.CAP))
    assert valid.count() + dropped.count() == every.count()


def test_band_filter_bounds(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,)], "x double")
    assert rows_of(clean.in_band(df, "x", 2, 3), "x") == [(2.0,), (3.0,)]
