"""Edge rules with hand-computed answers."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from frames import AS_OF, orders, rows_of, timed
from stallwise.functions import expr as X
from stallwise.operators import audit, clean, customers, dims, keyed, ranking, sales


# --- windows and thresholds -----------------------------------------------------------


def test_trailing_window_excludes_its_start_and_includes_its_end(spark):
    df = orders(
        spark,
        [
            (1, "a", 1.0, "2024-03-24 00:00:00"),
            (2, "a", 1.0, "2024-03-24 00:00:00.000001"),
            (3, "a", 1.0, "2024-03-23 23:59:59.999999"),
            (4, "a", 1.0, "2024-03-31 00:00:00"),
            (5, "a", 1.0, "2024-03-31 00:00:00.000001"),
        ],
    )
    assert rows_of(clean.trailing(df, AS_OF, 7), "point_id") == [(2,), (4,)]


def test_fixed_range_is_half_open(spark):
    df = orders(spark, [(1, "a", 1.0, "2017-05-01 00:00:00"), (2, "a", 1.0, "2018-05-01 00:00:00")])
    kept = clean.between(df, "2017-05-01 00:00:00", "2018-05-01 00:00:00")
    assert rows_of(kept, "point_id") == [(1,)]


def test_promotions_cap_and_tenure(spark):
    df = orders(
        spark,
        [(1, "a", 100.0, "2024-03-30"), (2, "a", 15000.0, "2024-03-30"), (3, "a", 14999.0, "2024-03-30")],
    )
    assert rows_of(clean.below_cap(clean.without_promotions(df)), "point_id") == [(3,)]
    aged = spark.createDataFrame([(1, 15), (2, 16)], "point_id int, tenure_days int")
    assert rows_of(clean.tenured(aged, 15), "point_id") == [(2,)]


def test_daily_sales_divide_by_the_window_or_a_shorter_tenure(spark):
    df = orders(spark, [(1, "a", 3000.0, "2024-03-30"), (2, "a", 3000.0, "2024-03-30")])
    points = spark.createDataFrame([(1, 10), (2, 20)], "point_id int, site_id int")
    aged = spark.createDataFrame([(10, 40), (20, 3)], "site_id int, tenure_days int")
    means = sales.site_daily_sales(df, points, aged, AS_OF, days=15, min_tenure=2)
    assert rows_of(means, "site_id", "daily_sales") == [(10, 2.0), (20, 10.0)]


# --- repeat purchase and new users ----------------------------------------------------


def test_repeat_interval_is_span_per_order(spark):
    df = orders(
        spark,
        [
            (1, "a", 100.0, "2024-03-25 10:00:00"),
            (1, "a", 100.0, "2024-03-27 10:00:00"),
            (1, "a", 100.0, "2024-03-30 09:00:00"),
            (1, "b", 330.0, "2024-03-29 00:00:00"),
        ],
    ).withColumn("member", F.col("account") == "b")
    users = spark.createDataFrame([("a", "2"), ("b", None)], "account string, level string")
    machines = spark.createDataFrame([(1, 3)], "point_id int, machines int")
    profile = customers.point_profile(df, users, machines, AS_OF, F.col("member"), ["1", "2"], days=7)
    row = profile.first().asDict()
    # a: from the 25th 10:00 to the 30th 09:00 are 4 whole days, over 3 orders.
    assert row["repeat_interval"] == pytest.approx(4 / 3)
    assert (row["buyers"], row["repeat_buyers"], row["member_payments"]) == (2, 1, 1)
    assert (row["level_total"], row["level_1"], row["level_2"]) == (1, 0, 1)
    assert row["sales_per_machine"] == pytest.approx(630 / 7 / 3)
    assert row["idle_days"] == 0


def test_new_users_fall_into_half_open_weeks_with_zeros(spark):
    df = orders(
        spark,
        [
            (1, "a", 1.0, "2024-03-01 00:00:00"),
            (1, "a", 1.0, "2024-03-09 00:00:00"),  # not new any more
            (1, "b", 1.0, "2024-03-08 00:00:00"),  # exactly on the second week's start
            (1, "c", 1.0, "2024-03-30 00:00:00"),
        ],
    )
    weekly = customers.new_users_weekly(df, AS_OF)
    assert rows_of(weekly, "week", "new_users") == [(0, 1), (1, 1), (2, 0), (3, 0), (4, 1)]


def test_new_user_weeks_stop_before_as_of(spark):
    df = orders(spark, [(1, "a", 1.0, "2024-03-24 00:00:00")])
    assert rows_of(customers.new_users_weekly(df, AS_OF), "week", "new_users") == [(0, 1)]


# --- spread and machines --------------------------------------------------------------


def test_variation_over_active_or_all_points(spark):
    df = orders(spark, [(2, "a", 10.0, "2024-03-30"), (3, "a", 30.0, "2024-03-30")])
    points = spark.createDataFrame([(1, 9), (2, 9), (3, 9)], "point_id int, site_id int")
    sites = spark.createDataFrame([(9, 100)], "site_id int, tenure_days int")
    args = dict(as_of=AS_OF, min_total=0, at_least=0)
    active = sales.coefficient_of_variation(df, points, sites, **args).first()["cv"]
    padded = sales.coefficient_of_variation(df, points, sites, include_idle=True, **args).first()["cv"]
    assert active == pytest.approx(10 / 20)
    assert padded == pytest.approx((((40 / 3) ** 2 + (10 / 3) ** 2 + (50 / 3) ** 2) / 3) ** 0.5 / (40 / 3))


@pytest.mark.parametrize(
    ("tenure", "volume", "machines", "expected"),
    [
        ("10", "70", "2", 5.0),
        ("5", "70", "2", 7.0),
        ("7", "70", "2", 5.0),
        (None, "70", "2", 5.0),
        ("", "70", "2", 5.0),
        ("10", "", "2", 0.0),
        ("10", None, "2", 0.0),
        ("10", "42", "", 2.0),
        ("10", "42", None, 2.0),
        ("0", "42", "2", None),
    ],
)
def test_sales_per_machine_defaults(spark, tenure, volume, machines, expected):
    volumes = spark.createDataFrame([("(7", volume, volume)], "id string, volume_7d string, volume_30d string")
    stats = spark.createDataFrame([("(7", tenure, machines)], "id string, tenure_days string, machines string")
    row = sales.sales_with_operations(volumes, stats).first()
    assert row["id"] == "7"
    assert row["sales_7d"] == expected


def test_site_tiers_are_cumulative_and_split_by_type(spark):
    points = spark.createDataFrame(
        [(1, 5, "1"), (2, 5, "0"), (3, 5, None)], "point_id int, site_id int, point_type string"
    )
    sites = spark.createDataFrame([(5, 100)], "site_id int, tenure_days int")
    df = orders(
        spark,
        [(1, "a", 70000.0, "2024-03-30"), (2, "a", 42000.0, "2024-03-30"), (3, "a", 21000.0, "2024-03-30")],
    )
    row = sales.site_tiers(df, points, sites, AS_OF).first()
    assert row["all_label"] == "1/2/3/3"
    assert row["underground_label"] == "1/1/1/1"
    assert row["ground_label"] == "0/1/1/1"
    assert row["daily_sales"] == pytest.approx(190.0)


def test_monthly_mean_without_sales_is_null(spark):
    facts = timed(
        spark, [(1, 10.0, "2024-01-05"), (1, 20.0, "2024-01-06"), (2, 30.0, "2024-01-07"), (3, 9.0, "2024-01-07")],
        "terminal_id int, amount double, sold_at string", "sold_at",
    )
    terminals = spark.createDataFrame([(1, "x"), (2, "x"), (3, "x")], "terminal_id int, channel_id string")
    blocked = spark.createDataFrame([(3,)], "terminal_id int")
    row = sales.month_pivot(facts, terminals, blocked, ["2024-01", "2024-02"]).first()
    assert (row["m01"], row["m02"]) == (30.0, None)


def test_poor_points_are_flagged_not_dropped(spark):
    points = spark.createDataFrame([(1, 5), (2, 5), (3, 5)], "point_id int, site_id int")
    sites = spark.createDataFrame([(5, "s")], "site_id int, site_name string")
    df = orders(spark, [(1, "a", 4001.0, "2024-03-30"), (2, "a", 4000.0, "2024-03-30")])
    fact = sales.point_fact(df, points, sites, AS_OF)
    assert rows_of(fact, "point_id", "sales", "is_poor", "points_in_site") == [
        (1, 40.01, False, 3), (2, 40.0, True, 3), (3, 0.0, True, 3),
    ]


def test_marker_sites(spark):
    df = orders(spark, [(1, "m", 500.0, "2024-03-30"), (1, "x", 700.0, "2024-03-30"), (2, "x", 1.0, "2024-03-30")])
    points = spark.createDataFrame([(1, 10), (2, 20)], "point_id int, site_id int")
    sites = spark.createDataFrame([(10, 21), (20, 21)], "site_id int, tenure_days int")
    sold = df.withColumn("product_id", F.col("account"))
    products = spark.createDataFrame([("m", True), ("x", False)], "product_id string, marker boolean")
    found = sales.marker_sites(sold, products, points, sites, F.col("marker"), AS_OF)
    assert rows_of(found, "site_id", "marker_orders", "other_sales") == [(10, 1, 7.0)]


# --- ranks ----------------------------------------------------------------------------


def _groups(spark, sizes):
    rows = [(f"g{n}", f"m{i:03d}", float(i)) for n in sizes for i in range(1, n + 1)]
    return spark.createDataFrame(rows, "area string, name string, value double")


@pytest.mark.parametrize(
    ("n", "tenth", "medians"),
    [(1, 0, [1]), (2, 0, [1, 2]), (4, 0, [2, 3]), (5, 1, [3]), (6, 1, [3, 4]), (14, 1, [7, 8]), (15, 2, [8])],
)
def test_band_sizes(spark, n, tenth, medians):
    found = ranking.bands(_groups(spark, [n]), ["area"], "value", "name")
    by_band = {}
    for row in found.collect():
        by_band.setdefault(row["band"], []).append(int(row["value"]))
    assert by_band["best"] == [n]
    assert by_band["worst"] == [1]
    assert sorted(by_band["median"]) == medians
    assert sorted(by_band.get("top", [])) == list(range(n - tenth + 1, n + 1))
    assert sorted(by_band.get("bottom", [])) == list(range(1, tenth + 1))


def test_legacy_median_is_one_below_the_middle(spark):
    found = ranking.bands(_groups(spark, [1, 5]), ["area"], "value", "name", legacy_median=True)
    assert rows_of(found.filter("band = 'median'"), "area", "value") == [("g5", 2.0)]


def test_bands_break_ties_by_name(spark):
    df = spark.createDataFrame([("g", "b", 1.0), ("g", "a", 1.0)], "area string, name string, value double")
    found = ranking.bands(df, ["area"], "value", "name")
    assert rows_of(found.filter("band = 'best'"), "name") == [("b",)]


def test_five_numbers_at_exact_ranks(spark):
    row = ranking.five_numbers(_groups(spark, [11]), ["area"], "value", "name").first()
    assert tuple(row[c] for c in ("lower", "q1", "middle", "q3", "upper")) == (2, 3, 6, 9, 10)


def test_year_means_need_enough_records_and_terminals(spark):
    months = [f"2024-{m:02d}-05" for m in range(1, 9)]
    rows = [(t, 12.0, day) for t in [*range(1, 12), 300] for day in months]
    rows += [(t, 12.0, day) for t in range(101, 111) for day in months]
    rows += [(200, 12.0, day) for day in months[1:] * 9]  # many orders, seven months
    rows += [(1, 500.0, "2023-12-31"), (1, 500.0, "2025-01-01"), (None, 9.0, months[0])]
    facts = timed(spark, rows, "terminal_id int, amount double, sold_at string", "sold_at")
    members = [(t, "eleven") for t in [*range(1, 12), 200, 300]] + [(t, "ten") for t in range(101, 111)]
    terminals = spark.createDataFrame(members, "terminal_id int, channel_id string")
    blocked = spark.createDataFrame([(300,)], "terminal_id int")
    kept = sales.terminal_year_means(facts, terminals, ("2024-01-01 00:00:00", "2025-01-01 00:00:00"), blocked)
    assert {r["channel_id"] for r in kept.collect()} == {"eleven"}
    assert kept.count() == 11
    assert kept.first()["mean_sales"] == 8.0


def test_gaps_between_distinct_days(spark):
    df = orders(
        spark,
        [(1, "a", 1.0, f"2024-03-{d} {h}:00:00") for d, h in (("01", "09"), ("01", "17"), ("04", "08"), ("20", "01"))]
        + [(1, "b", 1.0, "2024-03-01 00:00:00")],
    )
    found = [(r["account"], r["purchase_days"], r["gaps"]) for r in ranking.purchase_gaps(df).collect()]
    assert found == [("a", 3, [3, 16])]


def test_top_n_breaks_ties_by_name(spark):
    df = spark.createDataFrame([("c", "b", 5), ("c", "a", 5), ("c", "d", 9), ("c", "e", 1)], "k string, p string, n int")
    assert rows_of(ranking.top_n(df, ["k"], "n", "p"), "rank", "p") == [(1, "d"), (2, "a"), (3, "b")]


# --- audits and dimensions ------------------------------------------------------------


def test_site_without_a_community_is_an_orphan(spark):
    seen = spark.createDataFrame([(1,), (2,), (3,), (4,)], "site_id int")
    tree = spark.createDataFrame([(1, "x"), (2, None), (3, "gone")], "site_id int, community_id string")
    live = spark.createDataFrame([("x",)], "community_id string")
    assert rows_of(audit.orphan_sites(seen, tree, live), "site_id") == [(2,), (3,), (4,)]


def test_reconciled_names(spark):
    left, right = (spark.createDataFrame([(x,) for x in names], "name string") for names in (["a", "b", "b", None], ["b", "c", None]))
    assert rows_of(audit.reconciled_names(left, right, "name"), "left_name", "right_name", "side") == sorted(
        [("a", None, "left"), ("b", "b", "both"), (None, None, "left"), (None, "c", "right"), (None, None, "right")], key=str
    )


def test_cohorts_may_share_a_site(spark):
    rows = spark.createDataFrame([(1, 5.0), (2, 6.0), (3, 7.0)], "site_id int, v double")
    good, uneven = (spark.createDataFrame([(x,) for x in ids], "site_id int") for ids in ([1, 2, 2], [2]))
    found = audit.cohort_rows(rows, {"good": good, "uneven": uneven})
    assert rows_of(found, "cohort", "site_id") == [("good", 1), ("good", 2), ("uneven", 2)]


def test_dims_drop_deleted_closed_and_foreign_kinds(spark):
    tree = spark.createDataFrame(
        [("1", "50", "point", "c1"), ("2", "101", "point", "c2"), ("3", "50", "net", "c3"), ("4", "50", "point", "c4"),
         ("101", "0", "net", "c5")],
        "id string, parent_id string, kind string, community_id string",
    )
    attributes = spark.createDataFrame(
        [(c, c.upper(), "1" if c == "c4" else "0") for c in ("c1", "c2", "c3", "c4", "c5")],
        "id string, label string, is_deleted string",
    )
    assert rows_of(dims.point_dim(tree, attributes), "id", "label", "pid") == [("1", "C1", "c1")]
    assert rows_of(dims.site_dim(tree, attributes), "id", "label", "nid") == [("3", "C3", "c3")]


def test_eligible_machines(spark):
    good = ("m", "5", "7", "2", "1", "0")
    bad = [("m", "101", "7", "2", "1", "0"), ("m", "", "7", "2", "1", "0"), ("m", "5", None, "2", "1", "0"),
           ("m", "5", "7", "1", "1", "0"), ("m", "5", "7", "2", "0", "0"), ("m", "5", "7", "2", "1", "1")]
    df = spark.createDataFrame([good, *bad], "machine_id string, site_id string, point_id string, kind string, enabled string, fault string")
    assert [tuple(r) for r in clean.eligible_machines(df).collect()] == [good]


def test_right_join_keeps_sites_without_points(spark):
    points = spark.createDataFrame([(1, 10), (2, 10)], "point_id int, site_id int")
    machines = spark.createDataFrame([(10, 5), (20, None)], "site_id int, machines int")
    assert rows_of(dims.points_and_machines(points, machines), "site_id", "points", "machines") == [(10, 2, 5), (20, 0, 0)]


def test_machine_age_and_never_logged(spark):
    machines = timed(spark, [(1, "2024-03-30 12:00:00"), (2, "2024-03-01 00:00:00")], "machine_id int, deployed_at string", "deployed_at")
    log = timed(
        spark, [(1, "2024-03-30 18:00:00"), (1, "2024-03-30 20:00:00"), (2, "2024-04-02 00:00:00")],
        "machine_id int, logged_at string", "logged_at",
    )
    aged = customers.machine_age(machines, log, AS_OF)
    assert rows_of(aged, "machine_id", "deployed_days", "operating_days") == [(1, 0.5, 0.25), (2, 30.0, None)]
    assert audit.never_logged(machines, log.filter("machine_id = 1")).first()["machine_id"] == 2


# --- search ---------------------------------------------------------------------------


@pytest.mark.parametrize("mask", range(16))
def test_search_is_the_conjunction_of_all_given_predicates(spark, mask):
    rows = [(1, "u1", "p1", "n1", "2024-03-01"), (2, "u1", "p2", "n1", "2024-03-02"),
            (3, "u2", "p1", "n2", "2024-03-03"), (4, "u1", "p1", "n1", "2024-04-09")]
    index = timed(spark, rows, "row_key int, user string, point string, site string, paid_at string", "paid_at")
    use = [bool(mask & (1 << i)) for i in range(4)]
    wanted = {"user": "u1" if use[0] else None, "point": "p1" if use[1] else None, "site": "n1" if use[2] else None}
    start, end = ("2024-03-01 00:00:00", "2024-03-31 00:00:00") if use[3] else (None, None)
    expected = [
        r[0] for r in rows
        if all(v is None or r[1 + i] == v for i, v in enumerate(wanted.values())) and (not use[3] or r[4] < "2024-04")
    ]
    hits = keyed.matches(index, wanted, "paid_at", start, end)
    assert [r["row_key"] for r in keyed.page(hits, "paid_at", "row_key", 0, 10).collect()] == expected[::-1]


def test_pages_do_not_overlap(spark):
    index = timed(spark, [(i, "2024-03-01") for i in range(25)], "row_key int, paid_at string", "paid_at")
    pages = [[r["row_key"] for r in keyed.page(index, "paid_at", "row_key", p, 10).collect()] for p in range(4)]
    assert pages == [list(range(10)), list(range(10, 20)), list(range(20, 25)), []]


def test_key_exists_and_cell_delete(spark):
    table = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    assert keyed.key_exists(table, "k", "a") and not keyed.key_exists(table, "k", "z")
    doomed = spark.createDataFrame([("a",), ("a",)], "k string")
    assert rows_of(keyed.delete_cells(table, doomed, "k", ["v"]), "k", "v") == [("a", None), ("b", 2)]
    assert rows_of(keyed.delete_rows(table, doomed, "k"), "k") == [("b",)]


# --- scalars --------------------------------------------------------------------------


def test_row_key_depends_on_the_row_only_and_sorts_newest_first(spark):
    df = timed(spark, [("x", "2024-01-01"), ("x", "2024-01-02")], "id string, ts string", "ts")
    older, newer = (r[0] for r in df.orderBy("ts").select(X.reversed_time_key("id", "ts")).collect())
    assert newer < older
    assert older.endswith("_x") and older[:3] == newer[:3]


def test_scalars(spark):
    row = spark.createDataFrame(
        [("(a#)", " 1.5 ", "x", "", "/tmp/dir.d/file.tar.gz", "a,b,,", "0041")],
        "marked string, num string, bad string, blank string, path string, line string, padded string",
    ).select(
        X.strip_marks("marked").alias("marked"),
        X.number("num").alias("num"),
        X.number("bad").alias("bad"),
        X.filled_or("blank", "3").alias("filled"),
        X.file_stem("path").alias("stem"),
        X.file_extension("path").alias("ext"),
        X.width("line").alias("width"),
        X.field("line", 9).alias("past"),
        X.next_number("padded", 4).alias("next"),
        X.ratio_label(F.lit(1), F.lit(2)).alias("ratio"),
        X.first_keyword(F.lit("尖叫 NFC"), clean.PRODUCT_FAMILIES).alias("family"),
        X.previous_month(F.lit("2024-03-31")).alias("month"),
        X.previous_iso_week(F.lit("2024-01-03")).alias("week"),
    ).first()
    assert row.asDict() == {
        "marked": "a", "num": 1.5, "bad": None, "filled": "3", "stem": "file.tar", "ext": "gz", "width": 4,
        "past": None, "next": "0042", "ratio": "1/2", "family": "NFC", "month": "2024-02", "week": 52,
    }
