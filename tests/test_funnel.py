from __future__ import annotations

from datetime import date

from spending import Till, shop, spend_tables

from triptally.config import IndexConfig
from triptally.plans.reports import FUNNEL, city_profile, filter_funnel

JULY = IndexConfig(date(2025, 7, 1), date(2025, 7, 31))


def test_funnel_multiplies_out_every_fan_out(spark):
    weeks = [date(2025, 7, 4), date(2025, 7, 11)]
    shops = [shop("mall", "5311", city="6001", ref=w) for w in weeks]
    shops += [shop("web", "5311", kind=1, city="6001"), shop("diner", "5812", city="6001")]
    shops += [shop("lost", "5311", city="SAN JOSE"), shop("far", "5311", city="7001")]
    till = Till().buy("mall", "a", 1.0, times=3).buy("mall", "a", 1.0, distance=1.0)
    till.buy("web", "a", 1.0).buy("diner", "a", 1.0).buy("lost", "a", 1.0).buy("far", "a", 1.0)
    till.buy("unknown", "a", 1.0).buy("mall", "a", 1.0, day=date(2025, 8, 1))
    geo = spark.createDataFrame(
        [("United States", 6001), ("United States", 6001), ("Canada", 7001), ("Canada", None)],
        "country string, admin2_id long",
    )
    tables = spend_tables(spark, till.rows, shops, geo=geo)
    counts = {r.check_name: r["count"] for r in filter_funnel(tables, JULY).collect()}
    wanted = {
        "in_period": 9, "far": 8, "matched": 6 + 4, "physical": 6 + 3, "coded": 6 + 2,
        "located": 12 + 1, "in_country": 12,
    }
    assert counts == {FUNNEL[step]: n for step, n in wanted.items()}


def test_city_profile(spark):
    shops = [shop("a", "1", city="X"), shop("b", "1", city="X"), shop("c", "1", city=None)]
    tables = spend_tables(spark, Till().buy("a", "c", 1.0).rows, shops)
    assert [tuple(r) for r in city_profile(tables.merchants).collect()] == [("X", 2)]
