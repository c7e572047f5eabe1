"""Tables kept beside the facts: rollups, changes, layouts, histories, and streams whose state ends."""

from __future__ import annotations

import glob
import random
import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from conftest import DATA
from frames import orders, rows_of, timed
from stallwise.functions import work
from stallwise.functions.work import fresh_path, input_files
from stallwise.operators import clean, dims, history, rollup
from stallwise.plans import binding, stored
from stallwise.plans.registry import Tables
from stallwise.sources import layouts, readers, writers
from stallwise.streaming import counts, orders as messages, run

FOLDER = f"{DATA}/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


# --- rollup ---------------------------------------------------------------------------


def test_closing_days_are_those_of_midnight_windows(spark):
    times = ["2024-03-30 00:00:00", "2024-03-30 00:00:01", "2024-03-31 00:00:00", None]
    df = timed(spark, [(t,) for t in times], "ts string", "ts")
    days = [str(r[0]) for r in df.select(rollup.closing_day("ts")).collect()]
    assert days == ["2024-03-30", "2024-03-31", "2024-03-31", "None"]


def test_withdrawn_lines_leave_nothing(spark):
    rows = [(1, "a", 0.1, "2024-03-01 10:00:00"), (1, "b", 0.2, "2024-03-01 11:00:00"), (2, "a", 5.0, "2024-03-02 00:00:00"), (2, "a", None, None)]
    lines = orders(spark, rows)
    first = rollup.sales_increments(lines, F.col("amount") < 1)
    gone = rollup.sales_increments(lines.filter("point_id = 1"), F.col("amount") < 1, F.lit(True))
    assert rows_of(first, "point_id", "cents", "lines", "seen") == [(1, 30, 2, 2), (2, 0, 0, 1), (2, 0, 0, 1)]
    left = rollup.folded(first.union(gone).union(first).union(gone))
    assert rows_of(left, "point_id", "seen") == [(2, 2), (2, 2)]
    assert rollup.as_orders(left).isEmpty()


def test_measures_read_the_rollup_only(spark):
    for name in ("rollup_site_daily_sales", "rollup_point_bands"):
        read = contract.queries()[name](spark, FOLDER).inputFiles()
        assert read and not any("lineitem.parquet" in f for f in read)


def test_bitmaps_merge_over_days_and_batches(spark):
    rows = [(p, d, a) for p in (1, 2) for d in range(10) for a in ((7, 40_000, None), (d, 7, 2**40))[d % 2]]
    facts = spark.createDataFrame(rows, "point int, day int, account long")
    facts = facts.withColumn("paid_at", F.expr("timestamp_ntz'2024-03-01 00:00:00' + make_interval(0, 0, 0, day)"))
    parts = [rollup.member_bitmaps(facts.filter(f"day % 3 = {i}"), ["point"], "account") for i in range(3)]
    table = parts[0].union(parts[1]).union(parts[2])
    window = rollup.trailing_days(table, "2024-03-10 00:00:00", 5)
    expected = facts.filter("day >= 5").groupBy("point").agg(F.count_distinct("account").alias("members"))
    assert rows_of(rollup.distinct_members(window, ["point"]), "point", "members") == rows_of(expected, "point", "members")


def test_members_far_apart_take_little_room(spark):
    """A thousand members, each in another range: bitmaps of whole ranges took 4 KB for each."""
    facts = spark.range(1000).select(
        F.lit(1).alias("point"), (F.col("id") * 40_000 - 20_000_000).alias("account"), F.lit("2024-03-01 00:00:00").cast("timestamp_ntz").alias("paid_at")
    )
    table = rollup.member_bitmaps(facts.union(facts), ["point"], "account")
    assert sum(len(m) if isinstance(m, bytes | bytearray) else 8 for (m,) in table.select("members").collect()) <= 1000 * 8
    assert rows_of(rollup.distinct_members(table, ["point"]), "point", "members") == [(1, 1000)]


# --- changes --------------------------------------------------------------------------


def test_changes_by_hand(spark):
    path, keys = fresh_path(spark, "changed"), ["k"]
    rows = lambda *r: spark.createDataFrame(r, "k string, a int, b string")
    schema = rows().schema
    put = lambda *r: writers.changes(schema, keys, puts=rows(*r))
    only = lambda *k: spark.createDataFrame([(x,) for x in k], "k string")
    now = lambda: rows_of(writers.current_rows(spark, path, schema, keys), "k", "a", "b")
    write = writers.delta_sink(path)
    write(put(("x", 1, "one"), ("y", 2, "two"), ("z", 3, None), (None, 4, "none")), 0)
    write(writers.changes(schema, keys, deleted=only("y", "y", "nobody"), cleared=[(only("x"), ["b"]), (only("z", None), ["a", "b"])]), 1)
    state = sorted([("x", 1, None), ("z", None, None), (None, None, None)], key=str)
    assert now() == state
    write(writers.changes(schema, keys, deleted=only("y", "y", "nobody"), cleared=[(only("x"), ["b"]), (only("z", None), ["a", "b"])]), 1)
    assert now() == state
    writers.compact(spark, path, writers.with_marks(schema), writers.current_of(keys), "k")
    assert now() == state
    write(put(("y", 5, "again")), 1)  # an old batch delivered again after it was compacted changes nothing
    assert now() == state
    write(writers.changes(schema, keys, puts=rows(("y", 5, "again"), ("x", 6, "new")), deleted=only("x"), cleared=[(only("y"), ["b"])]), 2)
    write(writers.changes(schema, keys, deleted=only("z")), 3)
    assert now() == sorted([("x", 6, "new"), ("y", 5, "again"), (None, None, None)], key=str)
    with pytest.raises(ValueError):
        writers.changes(schema, keys, cleared=[(only("x"), ["nothing"])])


def test_the_latest_row_needs_no_sort_aggregate(spark):
    rows = spark.createDataFrame([(i % 3, i, None if i % 2 else "t") for i in range(50)], "k int, v int, t string")
    latest = writers.latest_per_key(rows, ["k"], ["v"])
    assert rows_of(latest, "k", "v") == [(0, 48), (1, 49), (2, 47)]
    for df in (latest, contract.queries()["lookup_dim"](spark, FOLDER), contract.queries()["st_upsert"](spark, FOLDER)):
        assert "SortAggregate" not in _plan(df)
    assert "WindowGroupLimit" in _plan(latest)


# --- layouts --------------------------------------------------------------------------


def test_bucketed_joins_have_no_exchange(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        owned, purchases, accounts = stored.bucketed_purchases(Tables(spark, FOLDER))
        for joined in (owned, purchases.join(accounts, "account")):
            plan = _plan(joined)
            assert "SortMergeJoin" in plan and "Exchange" not in plan
            assert joined.count() == Tables(spark, FOLDER).lineitem.count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def _scanned(df) -> int:
    """Rows that the scans of a query really read."""
    df.write.format("noop").mode("overwrite").save()
    df.collect()
    total = 0
    todo = [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
            continue
        if node.nodeName().startswith("Scan parquet"):
            total += node.metrics().apply("numOutputRows").value()
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return total


def test_each_search_skips_most_of_the_z_order(spark):
    index = stored.z_index(Tables(spark, f"{DATA}/sf0.01"), 4)
    rows = index.count()
    for name, met in stored.z_searches().items():
        assert 0 < _scanned(index.filter(met)) < rows / 4, name


def test_z_values_interleave(spark):
    df = spark.createDataFrame([(None, 1), (0, 0), (1, 0), (0, 1), (1, 1), (3, 3)], "a int, b int")
    z = [r[0] for r in df.select(layouts.z_value({"a": [1, 2, 3], "b": [1, 2, 3]}, 2)).collect()]
    assert z == [2, 0, 1, 2, 3, 15]
    assert [r[0] for r in df.select(layouts.z_value({"a": []}, 2)).distinct().collect()] == [0]


def test_parts_of_a_z_value_are_the_limits_reached(spark):
    draw = random.Random(3)
    for n in (1, 2, 5, 8, 255):
        limits = sorted(draw.sample(range(1000), n))
        values = [None, *range(-2, 1003, 7), *limits]
        df = spark.createDataFrame([(v,) for v in values], "a int")
        made = {r[0]: r[1] for r in df.select("a", layouts.z_value({"a": limits})).collect()}
        assert made == {v: sum(x <= v for x in limits if v is not None) * 255 // n for v in values}


def test_a_z_ordered_table_is_computed_once(spark):
    seen = spark.sparkContext.accumulator(0)
    count = F.udf(lambda x: (seen.add(1), x)[1], "long")
    path = fresh_path(spark, "z")
    layouts.write_z_ordered(spark.range(200, numPartitions=2).select(count("id").alias("a")), path, ["a"])
    assert spark.read.parquet(path).count() == 200 and seen.value == 200


def test_grams_find_every_key_that_holds_a_text(spark):
    draw = random.Random(4)
    keys = sorted({"".join(draw.choice("abc") for _ in range(draw.randrange(0, 8))) for _ in range(300)})
    grams = layouts.key_grams(spark.createDataFrame([(k,) for k in [*keys, None]], "k string"), "k")
    for text in ("ab", "abca", "\x02ab", "ca\x03"):
        near = {r[0] for r in layouts.keys_that_may_hold(grams, "k", [text]).collect()}
        assert {k for k in keys if text in f"\x02{k}\x03"} <= near
    either = {r[0] for r in layouts.keys_that_may_hold(grams, "k", ["aaa", "bb"]).collect()}
    assert either == {k for k in keys if "aaa" in k or "bb" in k}
    with pytest.raises(ValueError):
        layouts.wanted_grams("a")


# --- trees and histories --------------------------------------------------------------


def test_ancestors_of_a_deep_tree(spark):
    links = [(i, i - 1 if i else None) for i in range(40)] + [(100 + i, 20) for i in range(5)]
    found = rows_of(history.ancestors(spark.createDataFrame(links, "id int, parent_id int")), "node", "ancestor", "depth")
    expected = [(i, j, i - j) for i in range(40) for j in range(i + 1)]
    expected += [(100 + k, j, 21 - j) for k in range(5) for j in range(21)] + [(100 + k, 100 + k, 0) for k in range(5)]
    assert found == sorted(expected, key=str)
    with pytest.raises(ValueError, match="above itself"):
        history.ancestors(spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "id int, parent_id int"))
    with pytest.raises(ValueError, match="two parents"):
        history.ancestors(spark.createDataFrame([(1, 2), (1, 3)], "id int, parent_id int"))


def test_versions_as_of_with_a_hot_key(spark):
    """One point holds most of the facts and spans ranges, some without any version."""
    draw = random.Random(8)
    day = lambda n: datetime(2024, 1, 1) + timedelta(hours=n)
    facts = [(i, 7 if draw.random() < 0.9 else draw.choice([1, 2, 3, None]), day(draw.randrange(3000))) for i in range(3000)]
    facts += [(9000, 7, None), (9001, 1, day(0)), (9001, 1, day(0))]
    versions = [(k, day(draw.randrange(3000)), f"v{j}") for k in (1, 2, 7) for j in range(4)] + [(None, day(0), "none"), (3, None, "none")]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        schema = "point_id int, since timestamp_ntz, label string"
        df = spark.createDataFrame(facts, "id int, point_id int, at timestamp_ntz")
        told = history.as_of_join(df, spark.createDataFrame(versions, schema), "point_id", "at", "since", ["label"], "id").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")

    def valid(key, at):
        known = [(s, v) for k, s, v in versions if k == key and key is not None and at is not None and s is not None and s <= at]
        return max(known)[1] if known else None

    assert sorted(map(tuple, told), key=str) == sorted([(*f, valid(f[1], f[2])) for f in facts], key=str)


def test_ranges_as_of_follow_the_rows(spark, monkeypatch):
    """With many rows there are more ranges than partitions, and no two of them in one task."""
    monkeypatch.setattr(work, "PART_ROWS", 100)
    facts = spark.range(3000).select("id", (F.col("id") % 5).alias("point_id"), F.timestamp_seconds("id").alias("at"))
    versions = spark.createDataFrame([(k, 0, k * 10) for k in range(4)], "point_id long, s long, label long")
    told = history.as_of_join(facts, versions.withColumn("since", F.timestamp_seconds("s")).drop("s"), "point_id", "at", "since", ["label"], "id")
    assert sorted(map(tuple, told.select("id", "label").collect())) == [(i, i % 5 * 10 if i % 5 < 4 else None) for i in range(3000)]
    held = told.groupBy(F.spark_partition_id()).count().collect()
    assert len(held) > 16 and max(r["count"] for r in held) < 400


# --- aggregates that read each file once ----------------------------------------------


def test_a_kept_aggregate_reads_no_file_twice(spark):
    source, path = fresh_path(spark, "days"), fresh_path(spark, "kept")
    read: list[int] = []

    def fresh(files):
        read.append(len(files))
        return dims.first_seen(spark.read.parquet(*files), "k", ts="at")

    def merged(known, more):
        return known.union(more).groupBy("k").agg(F.min("first_operated").alias("first_operated"))

    def add(day: int):
        spark.createDataFrame([(k, day) for k in range(day)], "k int, at int").coalesce(1).write.mode("append").parquet(source)

    def now():
        return rows_of(writers.kept_up(spark, path, input_files(spark, source), fresh, merged), "k", "first_operated")

    add(2)
    assert now() == [(0, 2), (1, 2)] and now() == [(0, 2), (1, 2)] and read == [1]
    add(3)
    add(4)
    assert now() == [(0, 2), (1, 2), (2, 3), (3, 4)] and read == [1, 2]
    spark.createDataFrame([(0, 9)], "k int, at int").write.mode("overwrite").parquet(source)
    assert now() == [(0, 9)] and read[2:] == [len(input_files(spark, source))]


def test_first_seen_outlives_its_reader(spark, monkeypatch):
    t = Tables(spark, FOLDER)
    once = rows_of(binding.first_seen_points(t), "point_id")
    monkeypatch.setattr(dims, "first_seen", lambda *a, **k: pytest.fail("read again"))
    assert rows_of(binding.first_seen_points(Tables(spark, FOLDER)), "point_id") == once
    assert not any("lineitem.parquet" in f for f in binding.first_seen_points(t).inputFiles())


# --- streams --------------------------------------------------------------------------


def _days_of_clicks(spark, path, first: int, days: int):
    for day in range(first, first + days):
        line = f"10.0.0.1\t2024-01-{day + 1:02d} 10:00:00\tGET /class/5.html HTTP/1.1\t200\t-"
        spark.createDataFrame([(line,)] * 3, "value string").coalesce(1).write.mode("append").text(path)
        yield day


def test_state_does_not_grow_with_the_days(spark):
    """After twice the days a query of days holds the same few rows of state."""
    held = []
    for days in (8, 16):
        path, checkpoint = fresh_path(spark, "clicks"), fresh_path(spark, "offsets")
        spark.createDataFrame([], "value string").write.text(path)
        clicks = counts.timed_clicks(spark.readStream.text(path), "2 days")
        counted = counts.clicks_of_day(clicks, "course_id")
        run.drain(counted, writers.delta_sink(fresh_path(spark, "days")), checkpoint, "update", _days_of_clicks(spark, path, 0, days))
        held.append(run.state_rows(spark, checkpoint).count())
    assert held[0] == held[1] <= 4


def test_late_rows_are_an_error_everywhere(spark):
    path = fresh_path(spark, "late")
    for hour in ("2024-01-10", "2024-01-20", "2024-01-01"):
        timed(spark, [(hour + " 00:00:00",)], "ts string", "ts").coalesce(1).write.mode("append").parquet(path)
    windows = counts.windowed_counts(readers.stream_table(spark, path, spark.read.parquet(path).schema, max_files=1), "ts", "1 day", late_by="1 day")
    with pytest.raises(ValueError, match="later than the watermark"):
        run.replay(windows, ["window_start", "window_end"])


def test_messages_come_once_and_counts_add_up(spark):
    path, folder, checkpoint = (fresh_path(spark, n) for n in ("keyed", "topic", "offsets"))
    line = lambda i: f"{i},2024-01-{i % 9 + 1:02d} 00:00:00,m,1,102,{i}.5,a,2024-01-01 00:00:00,,,,,p,name,1.5,2,,,,"
    spark.createDataFrame([], "value string").write.text(folder)

    def feed():
        for ids in (range(20), range(30), range(10, 40)):
            spark.createDataFrame([(line(i),) for i in [*ids, *ids]], "value string").write.mode("append").text(folder)
            yield

    parsed = messages.once(messages.parsed_orders(spark.readStream.text(folder)), "30 days")
    queries = run.drain(parsed, writers.delta_sink(path), checkpoint, feed=feed())
    assert messages.stopped(queries) == (160, 40, 120)
    assert writers.read_deltas(spark, path, parsed.schema).groupBy("row_key").count().agg(F.max("count"), F.count("*")).first() == (1, 40)


def test_a_watched_folder_is_read_once_and_archived(spark, tmp_path):
    inbox, archive, checkpoint, path = f"{tmp_path}/inbox", f"{tmp_path}/archive", fresh_path(spark, "offsets"), fresh_path(spark, "lines")
    spark.createDataFrame([], "value string").write.text(f"{inbox}/day-none")
    stream = readers.new_text_files(spark, f"{inbox}/day-*", archive=archive)
    seen = []
    for day in range(3):
        writers.write_lines(spark.createDataFrame([(f"line {day}",)], "value string"), f"{inbox}/day-{day}", ["value"], n_files=1)
        run.drain(stream, writers.delta_sink(path), checkpoint)
        rows = writers.read_deltas(spark, path, stream.schema).filter("value <> ''").collect()
        assert len(rows) == len({r.value for r in rows}) == day + 1
        seen = [r.file for r in rows]
    assert all(re.search(r"/day-\d/part-", f) for f in seen)
    left = [f for f in glob.glob(f"{inbox}/day-[0-9]/part-*")]
    moved = glob.glob(f"{archive}/**/day-[0-9]/part-*", recursive=True)
    assert moved and len(left) + len(moved) == 3


def test_rules_name_what_they_reject(spark):
    lines = spark.createDataFrame([("1;a;2.5",), ("2;;x",), ("id;b;c",), (None,), ("3",)], "value string")
    part = lambda i: F.get(F.split("value", ";"), F.lit(i))
    rules = {"header": part(0) != "id", "name": F.length(part(1)) > 0, "amount": part(2).try_cast("double").isNotNull()}
    told = {r.value: r.reasons for r in clean.judged(lines, rules).collect()}
    assert told == {"1;a;2.5": [], "2;;x": ["name", "amount"], "id;b;c": ["header", "amount"], None: ["header", "name", "amount"], "3": ["name", "amount"]}
