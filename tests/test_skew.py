"""Results and task sizes under one hot key."""

from __future__ import annotations

import random
from itertools import combinations

import pytest
from pyspark.sql import Window, functions as F

from frames import AS_OF, rows_of
from stallwise.functions.ranks import with_rank
from stallwise.functions.skew import hot_keys, salted_join
from stallwise.operators import baskets, customers, dims, ranking, sales

N = 30_000


def _hot(spark):
    """Key 'hot' holds two thirds of the rows, and half of those share one value."""
    i = F.col("id")
    return spark.range(N).select(
        F.when(i % 3 < 2, "hot").otherwise(F.concat(F.lit("k"), (i % 50).cast("string"))).alias("k"),
        F.when(i % 2 == 0, 7.0).otherwise((i * 7919 % 10007).cast("double")).alias("v"),
        F.concat(F.lit("n"), i.cast("string")).alias("name"),
    )


def test_rank_equals_row_number(spark):
    df = _hot(spark)
    w = Window.partitionBy("k").orderBy("v", "name")
    expected = df.select("*", F.row_number().over(w).cast("bigint").alias("rn"),
                         F.count(F.lit(1)).over(Window.partitionBy("k")).alias("n"))
    ranked = with_rank(df, ["k"], ["v", "name"])
    assert ranked.count() == N
    assert ranked.select(expected.columns).exceptAll(expected).isEmpty()


def test_rank_spreads_a_hot_group(spark):
    df = _hot(spark)
    placed = df.orderBy("k", "v", "name").withColumn("part", F.spark_partition_id())
    hot = placed.filter("k = 'hot'").groupBy("part").count().collect()
    if len(hot) > 1:  # adaptive execution may merge small partitions; a set size prevents it
        assert max(r["count"] for r in hot) < 0.5 * N
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        placed = df.orderBy("k", "v", "name").withColumn("part", F.spark_partition_id())
        hot = placed.filter("k = 'hot'").groupBy("part").count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(hot) >= 4
    assert max(r["count"] for r in hot) < 0.25 * N


def test_salted_join_equals_plain_join(spark):
    facts = _hot(spark)
    dim = facts.select("k").distinct().filter("k <> 'k5'").withColumn("attr", F.upper("k"))
    for how in ("inner", "left"):
        salted = salted_join(facts, dim, "k", "name", how).select("k", "v", "name", "attr")
        plain = facts.join(dim, "k", how).select("k", "v", "name", "attr")
        assert salted.count() == plain.count()
        assert salted.exceptAll(plain).isEmpty()


def test_salted_join_splits_the_hot_key(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        facts = _hot(spark)
        dim = facts.select("k").distinct().withColumn("attr", F.upper("k"))
        joined = salted_join(facts, dim, "k", "name").withColumn("part", F.spark_partition_id())
        sizes = joined.filter("k = 'hot'").groupBy("part").count().collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert len(sizes) >= 4
    assert max(r["count"] for r in sizes) < 0.5 * N


def test_top_n_limits_before_the_shuffle(spark):
    plan = ranking.top_n(_hot(spark), ["k"], "v", "name")._jdf.queryExecution().executedPlan().toString()
    limit = plan.index("WindowGroupLimit [k")
    assert "Partial" in plan and "WindowGroupLimit" in plan[plan.index("Exchange hashpartitioning") :]
    assert limit >= 0


def test_baskets_of_a_hot_account(spark):
    i = F.col("id")
    orders = spark.range(5000).select(
        F.when(i % 2 == 0, "anon").otherwise(F.concat(F.lit("a"), (i % 100).cast("string"))).alias("account"),
        (i * 31 % 1000).alias("product_id"),
        F.timestamp_seconds(i % 7 * 86400).cast("timestamp_ntz").alias("paid_at"),
    )
    found = baskets.user_baskets(orders)
    expected = orders.groupBy("account").agg(F.collect_set("product_id").alias("s")).filter("size(s) > 1")
    exploded = expected.select("account", F.explode("s").alias("product_id"), F.size("s").cast("bigint").alias("products"))
    assert found.select(exploded.columns).exceptAll(exploded).isEmpty()
    assert found.count() == exploded.count()


def test_day_baskets_keep_each_distinct_basket_once(spark):
    rows = [("a", d, p) for d in (1, 2) for p in (5, 3)]  # same basket on two days
    rows += [("a", 3, p) for p in (3, 5, 9)]  # a superset
    rows += [("a", 4, 3), ("b", 1, 3), ("b", 1, 5), ("b", 1, 5)]  # a single item; equal to a's, other account
    df = spark.createDataFrame(rows, "account string, d int, product_id int").withColumn(
        "paid_at", F.to_timestamp_ntz(F.concat(F.lit("2024-01-0"), F.col("d").cast("string"), F.lit(" 10:00:00")))
    )
    found = baskets.day_baskets(df).withColumn("d", F.dayofmonth("day"))
    assert rows_of(found, "account", "d", "product_id", "products") == sorted(
        [("a", 1, 3, 2), ("a", 1, 5, 2), ("a", 3, 3, 3), ("a", 3, 5, 3), ("a", 3, 9, 3), ("b", 1, 3, 2), ("b", 1, 5, 2)],
        key=str,
    )


def test_transactions_equal_plain_lists_of_frequent_items(spark):
    i = F.col("id")
    items = spark.range(4000).select((i % 900).alias("basket"), F.concat(F.lit("p"), (i * i % 97).cast("string")).alias("item"))
    made = baskets.transactions(items, ["basket"], "item", 0.05)
    plain = items.groupBy("basket").agg(F.collect_set("item").alias("items"))
    assert made.count() == plain.count()
    ours = baskets.frequent_item_sets(baskets.mine(made, 0.05))
    theirs = baskets.frequent_item_sets(baskets.mine(plain, 0.05))
    assert ours.count() == theirs.count() > 0
    assert ours.exceptAll(theirs).isEmpty()


def test_mining_finds_every_set_and_rule(spark):
    draw = random.Random(5)
    held = [sorted(draw.sample("abcdefgh", draw.randrange(0, 6))) for _ in range(60)] + [["a", None], ["a", None], None]
    model = baskets.mine(spark.createDataFrame([(h,) for h in held], "items array<string>"), 1.5 / 62, 0.3)
    known = [frozenset(h) for h in held if h is not None]
    sets = {frozenset(c) for h in known for k in range(1, len(h) + 1) for c in combinations(h, k)}
    freq = {s: sum(s <= h for h in known) for s in sets}
    freq = {s: n for s, n in freq.items() if n > 1}
    found = [(frozenset(r["items"]), r["freq"]) for r in model.freqItemsets.collect()]
    assert len(found) == len(freq) and dict(found) == freq
    rules = {(frozenset(r.antecedent), r.consequent[0]): (r.confidence, r.lift, r.support) for r in model.associationRules.collect()}
    expected = {
        (s - {c}, c): (n / freq[s - {c}], n / freq[s - {c}] / (freq[frozenset([c])] / 62), n / 62) for s, n in freq.items() if len(s) > 1 for c in s
    }
    assert rules == {k: v for k, v in expected.items() if v[0] >= 0.3}
    assert baskets.mine(spark.createDataFrame([], "items array<string>"), 0.5).associationRules.isEmpty()
    with pytest.raises(Exception, match="unique"):
        baskets.mine(spark.createDataFrame([(["a", "a"],)], "items array<string>"))


def test_mining_keeps_no_item_on_the_driver(spark, monkeypatch):
    """Ten thousand items that two baskets share, mined without a row of them collected."""
    i = F.col("id")
    rows = spark.range(20_000).select((i % 1000 + F.floor(i / 10_000) * 1000).alias("basket"), (i % 10_000).cast("string").alias("item"))
    made = rows.groupBy("basket").agg(F.slice(F.collect_list("item"), 1, 3).alias("items"))
    for name in ("collect", "toPandas", "toLocalIterator"):
        monkeypatch.setattr(type(made), name, lambda *a, **k: pytest.fail("collected"))
    model = baskets.mine(made, 1.5 / 2000)
    assert "Scan parquet" in model.freqItemsets._jdf.queryExecution().executedPlan().toString()
    assert "Scan parquet" in model.associationRules._jdf.queryExecution().executedPlan().toString()


def test_new_users_sum_to_distinct_buyers(spark):
    i = F.col("id")
    orders = spark.range(20_000).select(
        F.when(i % 3 == 0, 1).otherwise(i % 40).cast("int").alias("point_id"),
        (i * 17 % 3001).cast("string").alias("account"),
        F.lit(1.0).alias("amount"),
        (F.to_timestamp_ntz(F.lit("2024-01-01 05:30:00")) + F.make_dt_interval(days=(i % 80).cast("int"))).alias("paid_at"),
    )
    weekly = customers.new_users_weekly(orders, AS_OF)
    buyers = orders.select("point_id", "account").distinct().count()
    assert weekly.agg(F.sum("new_users")).first()[0] == buyers
    assert weekly.filter("new_users < 0").isEmpty()


def test_scaled_values_of_a_hot_site(spark):
    values = _hot(spark).groupBy("k", "name").agg(F.sum("v").alias("total"))
    scaled = sales.scaled_to_max(values, "k", spread_by="name")
    tops = scaled.groupBy("k").agg(F.max("scaled").alias("top"))
    assert scaled.count() == N
    assert tops.filter("top <> 1.0").isEmpty()


@pytest.fixture
def static_shuffles(spark):
    """Shuffle joins without adaptive help, so that only the plan itself can spread a key."""
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    for name, value in settings.items():
        spark.conf.set(name, value)
    yield
    for name in settings:
        spark.conf.unset(name)


def _largest_share(df, hot):
    sizes = df.withColumn("part", F.spark_partition_id()).filter(hot).groupBy("part").count().collect()
    return max(r["count"] for r in sizes) / sum(r["count"] for r in sizes)


def test_operators_spread_a_hot_key(spark, static_shuffles):
    i = F.col("id")
    rows = spark.range(N).select(
        F.when(i % 3 < 2, "hot").otherwise(F.concat(F.lit("k"), (i % 50).cast("string"))).alias("account"),
        i.alias("product_id"),
        i.cast("double").alias("total"),
    )
    hot = F.col("account") == "hot"
    assert _largest_share(baskets.user_baskets(rows), hot) < 0.5
    assert _largest_share(sales.scaled_to_max(rows, "account", spread_by="product_id"), hot) < 0.5
    points = rows.select(F.col("account").alias("site_id"), F.col("product_id").alias("point_id"))
    assert _largest_share(sales.points_of_sites(points), F.col("site_id") == "hot") < 0.5
    listed = rows.groupBy("account").agg(F.count(F.lit(1)).alias("n")).filter("n > 10")
    assert _largest_share(dims.in_set(rows, listed, "account", spread_by="product_id"), hot) < 0.5
    assert dims.in_set(rows, listed, "account", spread_by="product_id").count() == N
    assert dims.not_in_set(rows, listed, "account", spread_by="product_id").count() == 0


def test_ranks_of_nothing(spark):
    empty = _hot(spark).filter("k = 'none'")
    assert with_rank(empty, ["k"], ["v", "name"]).count() == 0
    assert with_rank(_hot(spark), ["k"], ["v", "name"]).columns == ["k", "v", "name", "rn", "n"]


def test_only_hot_keys_are_copied(spark):
    """One account holds half of all rows; the many others are not multiplied."""
    rows = spark.range(40_000).select(
        F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id")).alias("account"), F.col("id").alias("product_id")
    )
    dim = rows.select("account").distinct().withColumn("size", F.lit(1))
    hot = hot_keys(rows, "account", "product_id")
    assert [r["account"] for r in hot.collect()] == [0]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        joined = salted_join(rows, dim, "account", "product_id", hot=hot)
        assert joined.count() == 40_000
        assert joined.exceptAll(rows.join(dim, "account").select(*joined.columns)).isEmpty()
        parts = joined.withColumn("part", F.spark_partition_id()).groupBy("part").count().collect()
        assert max(r["count"] for r in parts) < 2.5 * 40_000 / 8
        plan = joined._jdf.queryExecution().executedPlan()
        joined.write.format("noop").mode("overwrite").save()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    salts = hot.first()["_salts"]
    copies = dim.join(hot, "account", "left").agg(F.sum(F.coalesce("_salts", F.lit(1)))).first()[0]
    assert 6 <= salts <= 10 and copies == dim.count() + salts - 1 and "BroadcastHashJoin" in plan.toString()


def test_a_hot_key_is_split_by_its_share(spark):
    i = F.col("id")
    key = F.when(i % 4 < 2, "half").when(i % 4 == 2, "quarter").otherwise(F.concat(F.lit("k"), i.cast("string")))
    rows = spark.range(200_000).select(key.alias("k"), "id")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "100")
    try:
        salts = {r["k"]: r["_salts"] for r in hot_keys(rows, "k", "id").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert set(salts) == {"half", "quarter"}
    assert 85 <= salts["half"] <= 115 and 40 <= salts["quarter"] <= 60


def test_a_join_by_shares_keeps_every_row(spark):
    rows = _hot(spark)
    dim = rows.select("k").distinct().filter("k <> 'k5'").withColumn("attr", F.upper("k"))
    hot = hot_keys(rows, "k", "name")
    assert [r["k"] for r in hot.collect() if r["k"] == "hot"] == ["hot"]
    for how in ("inner", "left", "left_semi", "left_anti"):
        salted, plain = salted_join(rows, dim, "k", "name", how, hot=hot), rows.join(dim, "k", how)
        columns = plain.columns
        assert salted.count() == plain.count()
        assert salted.select(columns).exceptAll(plain).isEmpty()
