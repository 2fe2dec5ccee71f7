"""Timestamps against the standard library's own arithmetic."""

from __future__ import annotations

import random
from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import pandas as pd
import pytest
from pyspark.sql import functions as F

from convograph.functions.instants import parse_instants, unix_instant, zone_table
from convograph.sources.exports import instants


def parse(value, zone="", order="dmy"):
    out = parse_instants(pd.Series([value]), pd.Series([zone]), pd.Series([order]))[0]
    return None if pd.isna(out) else int(out)


def us(*a, tz=timezone.utc):
    return int(datetime(*a, tzinfo=tz).timestamp()) * 1_000_000


@pytest.mark.parametrize(
    ("value", "zone", "want"),
    [
        ("2023-01-27T00:41:48.245834+09:00", "", us(2023, 1, 26, 15, 41, 48) + 245834),
        ("2023-01-07T02:41:58.752943420Z", "", us(2023, 1, 7, 2, 41, 58) + 752943),
        ("2023-01-22 01:14:22", "America/Chicago", us(2023, 1, 22, 7, 14, 22)),
        ("20230105T130758Z", "", us(2023, 1, 5, 13, 7, 58)),
        ("08.01.2023, 17:47:32", "Europe/Berlin", us(2023, 1, 8, 16, 47, 32)),
        ("19/07/2024 16:29", "Europe/London", us(2024, 7, 19, 15, 29)),
        ("Fri, 27 Jan 2023 07:26:41 +0530", "", us(2023, 1, 27, 1, 56, 41)),
        ("Nov 27, 2024, 8:48:33 PM", "Asia/Tokyo", us(2024, 11, 27, 11, 48, 33)),
        ("May 21, 2024, 12:13:54 AM CEST", "", us(2024, 5, 20, 22, 13, 54)),
        ("2023-01-28 08:15:16 UTC+01:00", "", us(2023, 1, 28, 7, 15, 16)),
        ("2023-01-12T12:17:40-03:00[America/Sao_Paulo]", "Asia/Tokyo", us(2023, 1, 12, 15, 17, 40)),
        ("1675756261122", "", 1675756261122000), ("1672690396", "", 1672690396000000), ("1673179956093585", "", 1673179956093585),
        ("2024-03-31T02:19:10", "Europe/Berlin", None), ("2024-10-27T02:30:00", "Europe/Berlin", None), ("2024-10-27T03:00:00", "Europe/Berlin", us(2024, 10, 27, 2)),
        ("2023-01-22 01:14:22", "", None), ("2023-01-22 01:14:22", "No/Zone", None), ("2023-02-30 10:00:00", "Asia/Tokyo", None),
        ("25:61", "", None), ("2024-05", "", None), ("n/a", "Asia/Tokyo", None), ("", "", None), (None, "", None), ("0", "", None), ("99999999999", "", None),
        ("x" * 100_000, "Asia/Tokyo", None), ("13:00 PM", "Asia/Tokyo", None),
    ],
)
def test_formats(value, zone, want):
    assert parse(value, zone) == want


def test_date_order():
    assert parse("03/04/2024 10:00", "Asia/Tokyo", "mdy") == us(2024, 3, 4, 1)
    assert parse("03/04/2024 10:00", "Asia/Tokyo", "dmy") == us(2024, 4, 3, 1)
    assert parse("03/04/2024 10:00", "Asia/Tokyo", "") is None


@pytest.mark.parametrize("zone", ["Europe/Berlin", "America/Sao_Paulo", "Australia/Lord_Howe", "Asia/Kathmandu", "Africa/Casablanca"])
def test_wall_times_against_zoneinfo(zone):
    """A wall time counts exactly where one fold-independent instant maps back to it."""
    r, tz = random.Random(1), ZoneInfo(zone)
    for _ in range(300):
        wall = datetime(2023, 1, 1) + timedelta(minutes=r.randrange(60 * 24 * 900))
        fits = {int(t.timestamp()) for fold in (0, 1) if (t := wall.replace(tzinfo=tz, fold=fold)).astimezone(timezone.utc).astimezone(tz).replace(tzinfo=None) == wall}
        want = fits.pop() * 1_000_000 if len(fits) == 1 else None
        assert parse(wall.strftime("%Y-%m-%d %H:%M:%S"), zone) == want
    assert zone_table("nowhere") is None


def test_doubles(spark):
    xs = [1687146016.8, 1674608639368.0, 1672622429629000.0, 0.0, None, float("nan"), float("inf"), -5.0, 5e9]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x double").select(unix_instant(F.col("x"))).collect()]
    assert got == [1687146016800000, 1674608639368000, 1672622429629000, None, None, None, None, None, None]


def test_whole_tables(spark, small):
    df = instants(spark, small)
    assert df.columns == ["tab", "rec_id", "utc_us"]
    assert df.count() == df.select("tab", "rec_id").distinct().count() > 300


def test_far_years():
    """No year of the calendar is left out; local times of other centuries follow their zone's rules."""
    from convograph.functions.instants import parse_instants

    values = ["1970-06-01T00:00:00Z", "2100-01-01T00:00:00Z", "0001-01-01T00:00:00Z", "9999-12-31T23:59:59Z", "1950-01-01T00:00:00", "2150-07-01T00:00:00", "1850-01-01T00:00:00"]
    zones = [None] * 4 + ["Europe/Berlin"] * 2 + [None]
    got = parse_instants(pd.Series(values), pd.Series(zones), pd.Series([None] * 7))
    want = [13046400, 4102444800, -62135596800, 253402300799, -631155600, 5695912800]
    assert [None if pd.isna(x) else int(x) // 10**6 for x in got] == [*want, None]
