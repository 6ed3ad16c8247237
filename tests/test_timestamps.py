from datetime import datetime, timedelta
from zoneinfo import ZoneInfo

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.operators import timestamps as ts

UTC = ZoneInfo("UTC")


def us(*parts, zone="UTC", micro=0):
    at = datetime(*parts, microsecond=micro, tzinfo=ZoneInfo(zone)).astimezone(UTC)
    return round((at - datetime(1970, 1, 1, tzinfo=UTC)).total_seconds()) * 1_000_000 + micro if not micro else int(at.replace(microsecond=0).timestamp()) * 1_000_000 + micro


NOON = us(2024, 3, 5, 13, 4, 5)
CASES = [
    ("2024-03-05T13:04:05Z", None, NOON),
    ("2024-03-05T13:04:05.250+0000", None, NOON + 250_000),
    ("2024-03-05T14:04:05+01:00", None, NOON),
    ("2024-03-05T08:04:05−05:00", None, NOON),
    ("2024-03-05 14:04:05+01", None, NOON),
    ("2024-03-05 18:49:05+05:45", None, NOON),
    ("2024-03-05 14:04:05,123+01:00", None, NOON + 123_000),
    ("2024-03-05t13:04:05.000001z", None, NOON + 1),
    ("2024-03-05T13:04:05.123456789Z", None, NOON + 123_456),
    ("20240305T130405Z", None, NOON),
    ("2024-03-05 13:04:05 UTC", "Asia/Tokyo", NOON),
    ("2024-03-05 08:04:05 EST", None, NOON),
    ("2024-03-05 13:04:05 UTC+00:00", None, NOON),
    ("2024-03-05 13:04:05 Z", None, NOON),
    ("Tue, 05 Mar 2024 14:04:05 +0100", None, NOON),
    ("Wed, 06 Mar 2024 14:04:05 +0100", None, NOON + 86_400_000_000),
    ("Mon, 05 Mar 2024 14:04:05 +0100", None, None),
    ("Mar 5, 2024 2:04:05 PM CET", None, NOON),
    ("Mar 5, 2024 2:04:05 PM", "Europe/Berlin", NOON),
    ("05/Mar/24 2:04 PM", "Europe/Berlin", NOON - 5_000_000),
    ("05.03.2024 14:04:05", "Europe/Berlin", NOON),
    ("2024/03/05 14:04", "Europe/Berlin", NOON - 5_000_000),
    ("2024-03-05T14:04:05[Europe/Berlin]", "Asia/Tokyo", NOON),
    ("2024-03-05T14:04:05+01:00[Europe/Berlin]", None, NOON),
    ("\t 2024-03-05 14:04:05 \n", "Europe/Berlin", NOON),
    ("1709643845", None, NOON),
    ("1709643845.5", None, NOON + 500_000),
    ("1709643845123", None, NOON + 123_000),
    ("1709643845123456", None, NOON + 123_456),
    ("1709643845123456789", None, NOON + 123_456),
    ("20240305140405", "Europe/Berlin", NOON),
    ("202403051404", "Europe/Berlin", NOON - 5_000_000),
    ("20240305140405.25", "Europe/Berlin", NOON + 250_000),
    ("20240305140405", None, None),
    ("20240305", "UTC", None),
    ("999999999", "UTC", None),
    ("2024-03-05", "UTC", None),
    ("13:04", "UTC", None),
    ("2024-03-05 14:04:05", None, None),
    ("2024-03-05 14:04:05", "Mars/Olympus", None),
    ("2024-03-05 14:04:05", "../../etc/passwd", None),
    ("2024-02-30T13:04:05Z", None, None),
    ("2023-02-29T13:04:05Z", None, None),
    ("2024-02-29T13:04:05Z", None, us(2024, 2, 29, 13, 4, 5)),
    ("2024-03-05T24:00:00Z", None, None),
    ("2024-03-05T13:60:00Z", None, None),
    ("0000-00-00 00:00:00", "UTC", None),
    ("2024-03-05 14:04:05 XYZ", "UTC", None),
    ("Mar 5, 2024 13:04:05 PM", "UTC", None),
    # Skipped and doubled wall clocks.
    ("2024-03-31 02:30:00", "Europe/Berlin", None),
    ("2024-10-27 02:30:00", "Europe/Berlin", None),
    ("2024-10-27 03:00:00", "Europe/Berlin", us(2024, 10, 27, 2)),
    ("2024-10-27 01:59:59", "Europe/Berlin", us(2024, 10, 26, 23, 59, 59)),
    ("2024-10-06T02:15:00", "Australia/Sydney", None),
    ("2024-10-27T02:30:00[Europe/Berlin]", "UTC", None),
    ("2024-10-27 02:30:00 CEST", None, us(2024, 10, 27, 0, 30)),
    # Closing rules go on beyond the tables, and before them the first offset.
    ("2071-07-01 12:00:00", "America/New_York", us(2071, 7, 1, 16)),
    ("2071-01-01 12:00:00", "America/New_York", us(2071, 1, 1, 17)),
    ("2471-07-01 12:00:00", "Europe/Berlin", us(2471, 7, 1, 10)),
    ("9999-07-01 12:00:00", "Europe/Berlin", us(9999, 7, 1, 10)),
    ("9999-12-31 23:59:59", "Asia/Tokyo", us(9999, 12, 31, 14, 59, 59)),
    ("2437-12-31 23:59:59", "Europe/London", us(2437, 12, 31, 23, 59, 59)),
    ("1900-06-01 12:00:00", "America/New_York", us(1900, 6, 1, 17)),
    ("2024-03-05T13:04:05." + "0" * 200 + "Z", None, NOON),
    ("2024-03-05 13:04:05é", "UTC", None),
    ("", "UTC", None),
    (None, "UTC", None),
    ("pending", "UTC", None),
    ("x" * 100_000, "UTC", None),
    ("2" * 30, "UTC", None),
]


@pytest.mark.parametrize(("value", "zone", "want"), CASES)
def test_forms(value, zone, want):
    out, good = ts.to_utc([value], [zone])
    assert (int(out[0]) if good[0] else None) == want


def test_column(spark):
    df = spark.createDataFrame([(v, z, w) for v, z, w in CASES] * 2, "value string, zone string, want long").withColumn("utc", F.lit(1)).repartition(3)
    got = df.withColumn("got", ts.utc_micros(F.col("value"), F.col("zone")))
    assert got.where("not (got <=> want)").collect() == [] and got.count() == 2 * len(CASES)
    assert df.limit(0).withColumn("got", ts.utc_micros(F.col("value"))).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.datetimes(datetime(1975, 1, 1), datetime(2036, 1, 1)), st.sampled_from(["Europe/Berlin", "America/New_York", "Australia/Sydney", "America/Sao_Paulo", "Asia/Kathmandu", "UTC", "Europe/London", "Australia/Lord_Howe", "Africa/Casablanca"]))
def test_transition_tables_agree_with_the_zone(wall, name):
    zone, wall = ts._zone(name), wall.replace(microsecond=0)
    first, second = wall.replace(tzinfo=zone, fold=0), wall.replace(tzinfo=zone, fold=1)
    one = first.utcoffset() == second.utcoffset()
    local = int((wall - datetime(1970, 1, 1)).total_seconds()) * 1_000_000
    out, good = ts.wall_to_utc(np.array([local]), name)
    assert bool(good[0]) == one
    if one:
        assert int(out[0]) == int(first.timestamp()) * 1_000_000


def test_one_parser_for_a_mask():
    ts.parser_of.cache_clear()
    ts.to_utc([f"2024-03-{d:02d} 10:00:00" for d in range(1, 29)], ["UTC"] * 28)
    assert ts.parser_of.cache_info().misses == 1


@pytest.mark.parametrize("name", ["Europe/Berlin", "America/New_York", "Australia/Sydney", "Africa/Casablanca", "Asia/Tokyo"])
def test_far_years_agree_with_the_zone(name):
    zone = ts._zone(name)
    for year in (1850, 1950, 2069, 2070, 2088, 2200, 2437, 2438, 3000, 8000):
        for month in range(1, 13):
            wall = datetime(year, month, 15, 12)
            local = int((wall - datetime(1970, 1, 1)).total_seconds()) * 1_000_000
            out, good = ts.wall_to_utc(np.array([local]), name)
            want = wall - wall.replace(tzinfo=zone).utcoffset()
            assert good[0] and int(out[0]) // 1_000_000 == (want - datetime(1970, 1, 1)) // timedelta(seconds=1), (name, wall)


def test_editions(spark):
    df = spark.createDataFrame([("2024-03-05 14:04:05", "UTC")], "v string, z string")
    of = lambda edition: df.select(ts.utc_micros(F.col("v"), F.col("z"), edition=edition).alias("u")).first().u
    assert of(ts.zone_edition()) == of(None) is not None
    with pytest.raises(ValueError, match="1999z"):
        of("1999z")
    with pytest.raises(Exception, match="in the plan"):
        df.select(ts._reader("1999z")(F.col("v"), F.col("z"))).collect()
