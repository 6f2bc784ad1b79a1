"""Opening hours, times and zones."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from hostloom.functions import hours as H
from hostloom.functions import times as C

X = F.col("x")


@pytest.mark.parametrize(
    "text, line",
    [
        ("Mo-Fr 09:00-17:00", "Mo, Tu, We, Th, Fr 09:00–17:00"),
        ("Sa - Mo 8:30 - 12:00", "Sa, Su, Mo 08:30–12:00"),
        ("Mo,We 10:00-14:00; Su 11:00-12:00", "Mo, We 10:00–14:00; Su 11:00–12:00"),
        ("closed", ""),
    ],
)
def test_plain_dialect(one, text, line):
    assert one(H.hours_line(H.parse_hours(X)), "x string", [text]) == line


@pytest.mark.parametrize(
    "text, line",
    [
        ("24/7", "Mo, Tu, We, Th, Fr, Sa, Su 00:00–23:59"),
        ("Mo-Fr 09:00-17:30; Sa 10:00-14:00; PH off", "Mo, Tu, We, Th, Fr 09:00–17:30; Sa 10:00–14:00"),
        ("Mo-Su 10:00-18:00; We off; Fr 12:00-20:00", "Mo, Tu, Th, Sa, Su 10:00–18:00; Fr 12:00–20:00"),
        ("Mo 8:00-12:00, 13:00-17:00", "Mo 08:00–12:00; Mo 13:00–17:00"),
        ("by appointment", None),
    ],
)
def test_map_dialect(one, text, line):
    assert one(H.hours_line(H.parse_map_hours(X)), "x string", [text]) == line


def test_canonical_is_order_free(one):
    a = one(H.canonical_hours(H.parse_hours(X)), "x string", ["We,Mo 09:00-10:00; Su 11:00-12:00"])
    b = one(H.canonical_hours(H.parse_hours(X)), "x string", ["Su 11:00-12:00; Mo,We 09:00-10:00"])
    assert a == b


def test_day_codes(one):
    assert one(H.day_code(X), "x string", ["https://schema.org/Wednesday"]) == "We"
    assert one(H.day_code(X), "x string", ["xx"]) is None


SPECIAL = "array<struct<`from`:string,`to`:string,closed:boolean,opens:string,closes:string>>"


def _open(one, hours, at, country="Denmark", special=None):
    column = H.is_open(H.parse_hours(F.col("h")), F.col("s"), F.lit(country), F.to_timestamp(F.col("t")))
    return one(column, f"h string, s {SPECIAL}, t string", [hours, special, at])


def test_open_now(one):
    assert _open(one, "Mo-Fr 09:00-17:00", "2024-01-31 08:30:00") is True  # 09:30 in Copenhagen
    assert _open(one, "Mo-Fr 09:00-17:00", "2024-01-31 07:30:00") is False
    assert _open(one, "We 22:00-02:00", "2024-01-31 21:30:00") is True  # past midnight allowed
    assert _open(one, "Mo-Fr 09:00-17:00", "2024-01-31 08:30:00", country="Atlantis") is None
    closed = [("2024-01-30", "2024-02-01", True, None, None)]
    assert _open(one, "Mo-Fr 09:00-17:00", "2024-01-31 08:30:00", special=closed) is False
    short = [("2024-01-31", "2024-01-31", False, "10:00", "11:00")]
    assert _open(one, "Mo-Fr 09:00-17:00", "2024-01-31 09:30:00", special=short) is True


@pytest.mark.parametrize(
    "value, zone, utc",
    [
        ("2026-10-01T19:00:00", "Europe/Copenhagen", dt.datetime(2026, 10, 1, 17)),
        ("2026-10-01T19:00", "America/New_York", dt.datetime(2026, 10, 1, 23)),
        ("2026-10-01T19:00:00+0200", "UTC", dt.datetime(2026, 10, 1, 17)),
        ("2026-10-01T19:00:00Z", "Asia/Tokyo", dt.datetime(2026, 10, 1, 19)),
        ("2026-10-01", "Asia/Tokyo", dt.datetime(2026, 10, 1)),
        ("soon", "UTC", None),
    ],
)
def test_to_utc(one, value, zone, utc):
    assert one(C.to_utc(F.col("v"), F.col("z")), "v string, z string", [value, zone]) == utc


@pytest.mark.parametrize(
    "country, region, lon, url, zone",
    [
        ("United States", "CA", None, "", "America/Los_Angeles"),
        ("us", "", -100.0, "", "America/Chicago"),
        ("Canada", "", None, "", "America/Toronto"),
        ("USA", "Arizona", None, "", "America/Phoenix"),
        ("", "", None, "https://a.dk/x", "Europe/Copenhagen"),
        ("", "", None, "https://a.com/x", "UTC"),
    ],
)
def test_event_zone(one, country, region, lon, url, zone):
    column = C.event_zone(F.col("c"), F.col("r"), F.col("l"), F.col("u"))
    assert one(column, "c string, r string, l double, u string", [country, region, lon, url]) == zone


def test_dates_without_year(one):
    now = F.lit("2024-01-31").cast("timestamp")
    zone = F.lit("Europe/Copenhagen")
    assert one(C.next_date(F.lit(10), F.lit(10), F.lit("20:00"), zone, now)) == dt.datetime(2024, 10, 10, 18)
    assert one(C.next_date(F.lit(12), F.lit(24), F.lit("20:00"), zone, F.lit("2024-12-31").cast("timestamp"))) == dt.datetime(2024, 12, 24, 19)
    assert one(C.next_date(F.lit(1), F.lit(2), F.lit("20:00"), zone, F.lit("2024-12-31").cast("timestamp"))) == dt.datetime(2025, 1, 2, 19)


def test_clock_and_month(one):
    assert one(C.clock_24(X), "x string", ["7:30 PM"]) == "19:30"
    assert one(C.clock_24(X), "x string", ["12 am"]) == "00:00"
    assert one(C.month_number(X), "x string", ["Oktober"]) == 10
    assert one(C.month_number(X), "x string", ["??"]) is None
