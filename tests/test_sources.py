"""Files in and out."""

from __future__ import annotations

import glob

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from frames import rows_of
from stallwise.functions import expr as X, work
from stallwise.functions.skew import salted_join
from stallwise.functions.work import fresh_path, shared_folder
from stallwise.operators import clean
from stallwise.sources import readers, schemas, writers
from stallwise.streaming import orders, run


def _lines(spark, path, *lines, mode="append"):
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.mode(mode).text(path)


def test_positional_feed_by_glob(spark):
    path = fresh_path(spark, "feed")
    row = ["t"] * 19
    row[1], row[4], row[8], row[9] = "m1", "250.5", "s1", "p1"
    _lines(spark, f"{path}/a", ",".join(row))
    _lines(spark, f"{path}/b", ",".join(["x"] * 3))
    df = readers.delimited(spark, f"{path}/*", schemas.ORDERS)
    assert df.columns == list(schemas.ORDER_FIELDS)
    assert rows_of(df, "machine_id", "amount", "site_id", "point_id") == [("m1", "250.5", "s1", "p1"), ("x", None, None, None)]


@pytest.mark.parametrize(
    ("schema", "name", "position"),
    [
        (schemas.ORDERS, "paid_at", 6), (schemas.ORDER_MESSAGE, "paid_at", 7), (schemas.SITE_TREE, "community_id", 20),
        (schemas.POINT_ATTRIBUTES, "is_deleted", 16), (schemas.SITE_ATTRIBUTES, "is_deleted", 24),
        (schemas.OPERATING_STATS, "faulty_machines", 11), (schemas.SALES_STATS, "volume_30d", 12),
        (schemas.ASSORTMENT, "vacancy_rate", 8), (schemas.USERS, "level", 20), (schemas.MACHINES, "kind", 21),
        (schemas.MACHINE_LOG, "logged_at", 3), (schemas.TERMINALS, "area_name", 52),
        (schemas.TERMINAL_SALES_BY_SITE, "amount", 5), (schemas.TERMINAL_SALES_BY_CHANNEL, "amount", 6),
        (schemas.BOX_ROWS, "lower", 6), (schemas.CLICK_LOG, "referer", 4),
    ],
)
def test_positions(schema, name, position):
    assert schema.names.index(name) == position


def test_numbered_columns_and_header_rows(spark):
    path = fresh_path(spark, "plain")
    _lines(spark, path, "id,name", "1,a", "2,b")
    df = clean.named_columns(readers.numbered_columns(spark, path, 2), {"c0": "id", "c1": "name"})
    assert rows_of(clean.without_header_rows(df), "id", "name") == [("1", "a"), ("2", "b")]


def test_csv_with_header_prunes_columns(spark):
    path = fresh_path(spark, "headed")
    df = spark.createDataFrame([(1, "x,y", None)], "id int, name string, note string")
    writers.write_csv(df, path, n_files=1)
    assert len(glob.glob(f"{path}/*.csv")) == 1
    assert rows_of(readers.headed(spark, path, ["name", "id"]), "id", "name") == [("1", "x,y")]
    writers.write_csv(df, path)
    assert readers.headed(spark, path).count() == 1


def test_lines_refuse_an_existing_path(spark):
    path = fresh_path(spark, "once")
    df = spark.createDataFrame([(1, None, "c")], "a int, b string, c string")
    writers.write_lines(df, path, ["a", "b", "c"], overwrite=False)
    assert readers.text_lines(spark, path).first()["value"] == "1,,c"
    with pytest.raises(AnalysisException):
        writers.write_lines(df, path, ["a"], overwrite=False)
    writers.write_lines(df, path, ["a"], n_files=1)
    assert [r["value"] for r in readers.text_lines(spark, path).collect()] == ["1"]


def test_parquet_and_file_counts(spark):
    path = fresh_path(spark, "files")
    writers.write_parquet(spark.range(100), path, n_files=3)
    assert len(glob.glob(f"{path}/*.parquet")) == 3
    assert spark.read.parquet(path).count() == 100


def test_partitioned_write_replaces_only_its_folders(spark):
    path = fresh_path(spark, "months")
    schema = "month string, v int"
    writers.write_partitioned(spark.createDataFrame([("2024-01", 1), ("2024-02", 2)], schema), path, ["month"])
    writers.write_partitioned(spark.createDataFrame([("2024-02", 3)], schema), path, ["month"])
    stored = spark.read.schema(schema).parquet(path)
    assert rows_of(stored, "month", "v") == [("2024-01", 1), ("2024-02", 3)]
    plan = stored.filter("month = '2024-02'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(month" in plan


def test_compacted_table_has_disjoint_sorted_files(spark):
    path = fresh_path(spark, "sorted")
    df = spark.range(20_000).select(F.md5(F.col("id").cast("string")).alias("k"), "id")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        writers.write_sorted_by_key(df, path, "k")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    spans = (
        spark.read.parquet(path).groupBy(F.input_file_name().alias("f")).agg(F.min("k").alias("a"), F.max("k").alias("b"))
        .orderBy("a").collect()
    )
    assert len(spans) > 1
    assert all(x["b"] < y["a"] for x, y in zip(spans, spans[1:]))


def test_stream_table_reads_a_file_and_a_folder(spark):
    path = fresh_path(spark, "t.parquet")
    writers.write_parquet(spark.range(10), path, n_files=2)
    file = glob.glob(f"{path}/*.parquet")[0]
    schema = spark.range(0).schema
    from stallwise.streaming.run import replay

    assert replay(readers.stream_table(spark, path, schema)).count() == 10
    assert replay(readers.stream_table(spark, file, schema)).count() < 10


def test_views_and_shared_folder(spark):
    writers.as_view(spark.range(3), "three")
    assert spark.sql("SELECT count(*) AS n FROM three").first()["n"] == 3
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")
    assert fresh_path(spark, "a") != fresh_path(spark, "a")


# --- nothing is lost ------------------------------------------------------------------


def test_two_queries_into_one_table(spark):
    path, rows = fresh_path(spark, "shared"), "k int, v string"
    for first in (10, 20):  # a second query with a checkpoint of its own
        source, checkpoint = fresh_path(spark, "source"), fresh_path(spark, "offsets")
        for i in range(3):
            spark.createDataFrame([(first + i, "x")], rows).coalesce(1).write.mode("append").parquet(source)
        stream = readers.stream_table(spark, source, spark.createDataFrame([], rows).schema, max_files=1)
        run.start(stream, writers.delta_sink(path), checkpoint, mode="append").awaitTermination()
    stored = writers.latest_deltas(spark, path, spark.createDataFrame([], rows).schema, ["k"])
    assert sorted(r["k"] for r in stored.collect()) == [10, 11, 12, 20, 21, 22]


def test_upsert_keeps_rows_of_a_null_partition(spark):
    path = fresh_path(spark, "nulls")
    for key in (1, 3):
        writers.upsert(spark.createDataFrame([(key, 1, None)], "k int, v int, day string"), path, "k", ["v"], "day")
    stored = spark.read.schema("k int, v int, day string").parquet(path)
    assert sorted(r["k"] for r in stored.collect()) == [1, 3]


def test_stream_of_a_table_leaves_its_namesakes_alone(spark):
    folder = fresh_path(spark, "streams")
    schema = spark.createDataFrame([], "k int").schema
    spark.createDataFrame([(1,), (2,), (3,)], "k int").write.parquet(f"{folder}/events")
    spark.createDataFrame([(9,)] * 5, "k int").write.parquet(f"{folder}/events_old")
    read = run.replay(readers.stream_table(spark, f"{folder}/events", schema))
    assert sorted(r["k"] for r in read.collect()) == [1, 2, 3]


def test_compaction_bounds_the_files_and_keeps_the_state(spark):
    path = fresh_path(spark, "compacted")
    schema = spark.createDataFrame([], "k int, n long").schema
    files = []
    for batch in range(6):
        rows = spark.createDataFrame([(k, 1) for k in range(batch + 1)], "k int, n long").coalesce(1)
        writers.delta_sink(path)(rows, batch)
        writers.delta_sink(path)(rows, batch)
        writers.compact(spark, path, schema, writers.sum_of(["k"], "n"), "k")
        files.append(len(writers.read_deltas(spark, path, schema).inputFiles()))
    writers.delta_sink(path)(spark.createDataFrame([(0, 5)], "k int, n long"), 6)
    stored = writers.summed_deltas(spark, path, schema, ["k"], "n")
    assert sorted((r["k"], r["n"]) for r in stored.collect()) == [(0, 11), (1, 5), (2, 4), (3, 3), (4, 2), (5, 1)]
    assert max(files) <= files[0] + 1


def test_wide_numbers_and_old_times(spark):
    df = spark.createDataFrame(
        [("123456", "9999", "3000000000", "1969-01-01 00:00:00")], "n string, last string, q string, ts string"
    )
    row = df.select(
        X.zero_padded("n", 4).alias("n"), X.next_number("last", 4).alias("next"), X.whole_number("q").alias("q"),
        X.reversed_time_key("n", X.parse_time("ts")).alias("key"),
        X.course_id(F.lit("/other/class/12.html")).alias("other"), X.course_id(F.lit("/class/12.html")).alias("own"),
        X.course_id(F.lit("/class/99999999999999999999.html")).alias("wide"), X.course_id(F.lit(None).cast("string")).alias("none"),
    ).first()
    assert tuple(row) == ("123456", "10000", 3_000_000_000, None, 0, 12, None, 0)


def test_unknown_values_are_not_dropped_as_listed(spark):
    df = spark.createDataFrame([(100.0, "a"), (None, None), (5.0, "b")], "amount double, product string")
    assert clean.without_promotions(df).count() == 2
    assert clean.without_values(df, "product", ["a"]).count() == 2


def test_a_salted_join_refuses_outer_modes(spark):
    df = spark.createDataFrame([(1, 2)], "k int, v int")
    for how in ("right", "full"):
        with pytest.raises(ValueError):
            salted_join(df, df.select("k"), "k", "v", how)


def test_messages_without_a_key_are_counted(spark):
    line = "{id},{at},m1,1,102,9,u,2024-01-01 10:00:01,9,s,p,c,7,tea,1.5,1,1,0,m1,d"
    messages = [line.format(id=1, at="2024-01-01 10:00:00"), line.format(id=2, at="1969-01-01 10:00:00"), "x"]
    df = spark.createDataFrame([(m,) for m in messages], "value string")
    assert orders.parsed_orders(df).count() == 1
    assert orders.rejected_orders(df).count() == 2


def test_retired_copies_are_gone(spark, monkeypatch):
    own = f"{shared_folder(spark)}/stallwise/one-job"
    monkeypatch.setattr(work, "_own_folder", lambda spark: own)
    kept = work.cut(spark.range(3), "copy")
    assert kept.count() == 3 and glob.glob(f"{own}/copy-*")
    work.retire(spark)
    assert not glob.glob(f"{own}*")
