"""Opening hours: parsing, comparing and testing.

Hours are ``array<struct<days: array<string>, opens: string, closes: string>>`` with
two-letter days and ``HH:MM`` clocks.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hostloom.functions.patterns import all_matches, let
from hostloom.functions.times import lookup

DAYS = ["Mo", "Tu", "We", "Th", "Fr", "Sa", "Su"]
_INDEX = {d.lower(): i for i, d in enumerate(DAYS)}
EMPTY = "array<struct<days:array<string>,opens:string,closes:string>>"
_DAY = "(?:Mo|Tu|We|Th|Fr|Sa|Su)"


def day_code(value: Column) -> Column:
    """Two-letter day of a name, abbreviation or schema.org URL; NULL if it is none."""
    letters = F.regexp_replace(F.lower(F.regexp_extract(F.coalesce(value, F.lit("")), "([^/]*)$", 1)), "[^a-z]", "")
    return lookup({d.lower(): d for d in DAYS}, F.substring(letters, 1, 2))


def clock(value: Column) -> Column:
    """``HH:MM`` found in a text, NULL if there is none."""
    pattern = r"(\d{1,2}):(\d{2})"
    return F.when(
        value.rlike(pattern), F.concat(F.lpad(F.regexp_extract(value, pattern, 1), 2, "0"), F.lit(":"), F.regexp_extract(value, pattern, 2))
    )


def _span(chunk: Column) -> Column:
    """Days of ``Mo`` or ``Fr-Su``; ranges may wrap around the week."""
    ends = F.transform(F.split(chunk, "-"), day_code)
    first, last = lookup(_INDEX, F.lower(F.get(ends, F.lit(0)))), lookup(_INDEX, F.lower(F.get(ends, F.lit(1))))
    ordered = F.array(*[F.lit(d) for d in DAYS])
    run = F.transform(F.sequence(F.lit(0), F.pmod(last - first, F.lit(7))), lambda n: F.get(ordered, (first + n) % 7))
    return F.when(first.isNotNull() & last.isNotNull(), run).when(first.isNotNull(), F.array(F.get(ordered, first))).otherwise(
        F.array().cast("array<string>")
    )


def day_list(text: Column) -> Column:
    """Distinct days of a comma list of days and ranges."""
    return F.array_distinct(F.flatten(F.transform(F.split(text, ","), _span)))


def _entry(days: Column, opens: Column, closes: Column) -> Column:
    return F.struct(days.alias("days"), opens.alias("opens"), closes.alias("closes"))


def parse_hours(text: Column) -> Column:
    """Hours of texts such as ``Mo-Fr 09:00-17:00``; every group stands for itself."""
    pattern = r"([A-Za-z]{2}(?:\s*[-,]\s*[A-Za-z]{2})*)\s+(\d{1,2}:\d{2})\s*-\s*(\d{1,2}:\d{2})"
    groups = F.arrays_zip(*[all_matches(text, pattern, g).alias(n) for g, n in ((1, "d"), (2, "o"), (3, "c"))])
    parsed = F.transform(groups, lambda g: _entry(day_list(g["d"]), clock(g["o"]), clock(g["c"])))
    return F.filter(parsed, lambda h: F.size(h["days"]) > 0)


def parse_map_hours(text: Column) -> Column:
    """Hours in the map dialect: ``24/7``, holidays ignored, later rules override days."""
    rule = rf"(?i)(?:({_DAY}(?:\s*[-,]\s*{_DAY})*)\s+)?(off|closed|(?:\d{{1,2}}:\d{{2}}\s*-\s*\d{{1,2}}:\d{{2}}(?:\s*,\s*(?=\d))?)+)"
    cleaned = F.regexp_replace(text, "(?<![A-Za-z0-9_])(?:PH|SH)(?![A-Za-z0-9_])[^;,]*", " ")
    rules = F.arrays_zip(all_matches(cleaned, rule, 1).alias("d"), all_matches(cleaned, rule, 2).alias("t"))
    every_day = F.array(*[F.lit(d) for d in DAYS])

    def apply(acc: Column, r: Column) -> Column:
        days = F.when(r["d"] == "", every_day).otherwise(day_list(r["d"]))
        span = r"(\d{1,2}:\d{2})\s*-\s*(\d{1,2}:\d{2})"
        times = F.zip_with(
            all_matches(r["t"], span, 1), all_matches(r["t"], span, 2),
            lambda o, c: _entry(days, F.lpad(o, 5, "0"), F.lpad(c, 5, "0")),
        )
        kept = F.filter(
            F.transform(acc, lambda h: _entry(F.array_except(h["days"], days), h["opens"], h["closes"])), lambda h: F.size(h["days"]) > 0
        )
        return F.when(r["t"].rlike("(?i)^(?:off|closed)$"), kept).otherwise(F.concat(kept, times))

    folded = F.aggregate(rules, F.array().cast(EMPTY), apply)
    always = F.array(_entry(every_day, F.lit("00:00"), F.lit("23:59")))
    return F.when(text.rlike(r"^\s*24/7\s*$"), always).otherwise(let(folded, lambda h: F.when(F.size(h) > 0, h)))


def hours_line(hours: Column) -> Column:
    """Hours in words, in stored order."""
    parts = F.transform(hours, lambda h: F.concat(F.array_join(h["days"], ", "), F.lit(" "), h["opens"], F.lit("–"), h["closes"]))
    return F.array_join(parts, "; ")


def special_line(special: Column) -> Column:
    """Special days in words, in stored order."""
    span = lambda s: F.concat(s["from"], F.when(s["to"] != s["from"], F.concat(F.lit(" to "), s["to"])).otherwise(""))
    when = lambda s: F.when(s["closed"], "closed").otherwise(F.concat(s["opens"], F.lit("–"), s["closes"]))
    return F.array_join(F.transform(special, lambda s: F.concat(span(s), F.lit(": "), when(s))), "; ")


def canonical_hours(hours: Column) -> Column:
    """Order-free text of hours for comparison."""
    parts = F.transform(hours, lambda h: F.concat(F.array_join(F.array_sort(h["days"]), ","), F.lit(" "), h["opens"], F.lit("-"), h["closes"]))
    return F.array_join(F.array_sort(parts), "; ")


#: Time zones of countries for opening hours, and country names.
OPENING_ZONES = {
    "DK": "Europe/Copenhagen", "SE": "Europe/Stockholm", "NO": "Europe/Oslo", "FI": "Europe/Helsinki", "DE": "Europe/Berlin",
    "NL": "Europe/Amsterdam", "BE": "Europe/Brussels", "FR": "Europe/Paris", "ES": "Europe/Madrid", "IT": "Europe/Rome",
    "PT": "Europe/Lisbon", "AT": "Europe/Vienna", "CH": "Europe/Zurich", "PL": "Europe/Warsaw", "IE": "Europe/Dublin",
    "GB": "Europe/London", "UK": "Europe/London", "US": "America/New_York", "CA": "America/Toronto", "AU": "Australia/Sydney",
    "NZ": "Pacific/Auckland", "JP": "Asia/Tokyo", "IN": "Asia/Kolkata", "SG": "Asia/Singapore",
}
COUNTRY_CODES = {
    "denmark": "DK", "sweden": "SE", "norway": "NO", "germany": "DE", "netherlands": "NL", "france": "FR", "spain": "ES",
    "italy": "IT", "united kingdom": "GB", "united states": "US", "ireland": "IE",
}


def country_code(country: Column) -> Column:
    """Two-letter code of a code or an English country name."""
    return F.when(F.length(country) == 2, F.upper(country)).otherwise(lookup(COUNTRY_CODES, F.lower(country)))


def minutes(text: Column) -> Column:
    """Minutes since midnight of ``HH:MM``."""
    return F.substring(text, 1, 2).try_cast("int") * 60 + F.substring(text, 4, 2).try_cast("int")


def is_open(hours: Column, special: Column, country: Column, at: Column) -> Column:
    """Open at an instant? NULL when hours or the zone are unknown.

    A special day comes before the weekday; closing before opening means past midnight.
    """

    def decide(local: Column) -> Column:
        now = F.hour(local) * 60 + F.minute(local)
        today = F.substring(F.date_format(local, "EEE"), 1, 2)
        date = F.date_format(local, "yyyy-MM-dd")
        day = F.try_element_at(F.filter(special, lambda s: (s["from"] <= date) & (date <= s["to"])), F.lit(1))
        on_day = F.when(F.coalesce(day["closed"], F.lit(False)), False).otherwise(
            (now >= minutes(day["opens"])) & (now < minutes(day["closes"]))
        )

        def inside(h: Column) -> Column:
            opens, closes = minutes(h["opens"]), minutes(h["closes"])
            same_day = (now >= opens) & (now < closes)
            return F.array_contains(h["days"], today) & F.when(closes > opens, same_day).otherwise((now >= opens) | (now < closes))

        return F.when(day.isNotNull(), on_day).when(F.size(hours) > 0, F.exists(hours, inside))

    zone = lookup(OPENING_ZONES, country_code(country))
    known = (F.coalesce(F.size(hours), F.lit(0)) > 0) | (F.coalesce(F.size(special), F.lit(0)) > 0)
    return F.when(known & zone.isNotNull(), let(F.from_utc_timestamp(at, zone), decide))
