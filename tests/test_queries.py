"""Every registered query against its SQL."""

from __future__ import annotations

import pytest

import __spark_entry__ as contract
import oracle
from conftest import DATA
from stallwise.plans.registry import REGISTER

FOLDER = f"{DATA}/sf0.01"
CHECKS = {name: query.sql for name, query in REGISTER.items() if query.sql is not None}
QUERIES = {name: run for name, run in contract.queries().items() if name in REGISTER}


@pytest.fixture(scope="module")
def con():
    return oracle.connect(FOLDER)


def test_each_query_has_a_check():
    assert set(QUERIES) == set(CHECKS)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_sql(name, spark, con):
    diff, rows = oracle.difference(QUERIES[name](spark, FOLDER), con, CHECKS[name])
    assert diff is None
    assert rows > 0


JOINING = (
    "site_tiers", "point_fact", "star_lookup", "complete_profile", "new_users_weekly", "gender_category",
    "day_baskets", "channel_bands", "cohort_rows", "lookup_left", "anti_blocked", "st_blocklist",
)


@pytest.mark.parametrize("name", JOINING)
def test_matches_sql_without_broadcasts(name, spark, con):
    settings = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    for setting in settings:
        spark.conf.set(setting, "-1")
    try:
        diff, rows = oracle.difference(QUERIES[name](spark, FOLDER), con, CHECKS[name])
    finally:
        for setting in settings:
            spark.conf.unset(setting)
    assert diff is None and rows > 0


def test_entry_has_rows(spark):
    assert contract.entry(spark).count() > 0
