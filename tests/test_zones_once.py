"""Zones and instants of events, with each fact read once."""

import pytest
from pyspark.sql import functions as F

from hostloom.functions.times import event_zone, to_utc


@pytest.mark.parametrize(
    "country, region, longitude, want",
    [("Denmark", None, None, "Europe/Copenhagen"), ("us", "CA", None, "America/Los_Angeles"), ("USA", "", -118.0, "America/Los_Angeles"),
     ("US", "Nowhere", None, "America/New_York"), (None, None, None, "Europe/Berlin"), ("Atlantis", None, None, "UTC")],
)
def test_event_zone(one, country, region, longitude, want):
    zone = event_zone(F.col("c"), F.col("r"), F.col("l"), F.lit("https://x.de/p"))
    assert one(zone, "c string, r string, l double", (country, region, longitude)) == want


def test_each_fact_is_read_once(spark):
    row = spark.createDataFrame([("us", "CA")], "c string, r string")
    code = F.lower(F.reverse("c"))
    zone = event_zone(code, F.lower(F.reverse("r")), F.lit(None).cast("double"), F.lit("https://x.de/p"))
    plan = row.select(zone.alias("zone"), to_utc(F.concat("c", F.lit("!")), F.lit("UTC")).alias("start"))
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("reverse(c") == 1 and text.count("reverse(r") == 1 and text.count("concat(c") == 1
