"""Explicit schemas of every table that is read or written. Codes and ids stay strings."""

from pyspark.sql import types as T

from triptally.config import Category

_str, _dbl, _long, _date = T.StringType(), T.DoubleType(), T.LongType(), T.DateType()


def _schema(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


TRANSACTIONS = _schema(
    txid=_str, mtid=_str, merch_h3_13=_str, membccid=_str, card_h3_13=_str, trans_date=_date,
    trans_amount=_dbl, norm_spend=_dbl, trans_distance=_dbl, delivery_date=_date, ref_date=_date,
)
MERCHANTS = _schema(
    mtid=_str, merch_desc=_str, mcc=_str, merch_type=_long, merch_city=_str, merch_state=_str,
    merch_zip=_str, merch_country=_str, z_country=_str, h3_13=_str, delivery_date=_date,
    ref_date=_date,
)
GEO_REFERENCE = _schema(
    client_id=_str, country=_str, country_id=_long, country_abbr=_str, admin1=_str,
    admin1_id=_long, admin1_abbr=_str, admin2=_str, admin2_id=_long, admin3=_str,
    admin3_id=_long, admin_pk=_long, processed_timestamp=T.TimestampType(),
)
REGION_BRIDGE = _schema(
    state_name=_str, abbreviation=_str, state_fips_code=_str, census_region=_str,
    census_region_division=_str,
)
LODGING = _schema(
    county_fips=_str, state_abbr=_str, stay_date=_date, adr=_dbl, property_id=_str, country=_str,
    occupancy=_dbl,
)
BASKET = _schema(
    month_date=_date, merch_state=_str, accommodation_cost=_dbl, attraction_cost=_dbl,
    breakfast_lunch_cost=_dbl, dinner_cost=_dbl, median_meal_cost=_dbl, retail_cost=_dbl,
    cost_per_trip=_dbl,
)
# Key columns of the county table must be present; the rest may be missing.
COUNTY_INDEX = T.StructType(
    [T.StructField("county_fips", _str, False), T.StructField("month_date", _date, False)]
    + [
        T.StructField(name, _dbl)
        for name in (
            "lodging_cost", "breakfast_lunch_cost", "dinner_cost", "attraction_cost",
            "retail_cost", "total_basket_cost",
        )
    ]
    + [
        T.StructField(name, _long)
        for name in (
            "lodging_txn_count", "restaurant_txn_count", "attraction_txn_count",
            "retail_txn_count", "lodging_txn_removed", "restaurant_txn_removed",
            "attraction_txn_removed", "retail_txn_removed", "hotel_property_count",
        )
    ]
    + [
        T.StructField("meets_threshold", T.BooleanType()),
        T.StructField("created_at", T.TimestampType()),
    ]
)


def category_export(category: Category) -> T.StructType:
    """Schema of a state-level category result as exported to CSV."""
    columns = {"merch_state": _str, "month_date": _date}
    columns |= {name: _dbl for name, _ in category.prices}
    columns |= {"transaction_count": _long, "unique_visitors": _long}
    if category.spread:
        columns |= {name: _dbl for name in ("min_cost", "max_cost", "q25", "q75")}
    columns |= {
        "data_quality_flag": _str, "period_start": _date, "period_end": _date,
        "calculation_timestamp": T.TimestampType(),
    }
    return _schema(**columns)
