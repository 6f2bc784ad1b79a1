"""Local times, zones and dates without a year."""

from __future__ import annotations

from zoneinfo import available_timezones

from pyspark.sql import Column
from pyspark.sql import functions as F

from hostloom.functions.patterns import first_group, let, strip_blank
from hostloom.functions.urls import host_of


def lookup(table: dict, key: Column) -> Column:
    """Value of a small constant map, NULL for unknown keys."""
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[key]


#: Time zones of countries for events, and country names.
EVENT_ZONES = {
    "dk": "Europe/Copenhagen", "se": "Europe/Stockholm", "no": "Europe/Oslo", "fi": "Europe/Helsinki", "de": "Europe/Berlin",
    "nl": "Europe/Amsterdam", "be": "Europe/Brussels", "fr": "Europe/Paris", "es": "Europe/Madrid", "it": "Europe/Rome",
    "pt": "Europe/Lisbon", "at": "Europe/Vienna", "ch": "Europe/Zurich", "pl": "Europe/Warsaw", "cz": "Europe/Prague",
    "ie": "Europe/Dublin", "gb": "Europe/London", "uk": "Europe/London", "is": "Atlantic/Reykjavik", "au": "Australia/Sydney",
    "nz": "Pacific/Auckland", "jp": "Asia/Tokyo", "in": "Asia/Kolkata", "sg": "Asia/Singapore", "br": "America/Sao_Paulo",
    "mx": "America/Mexico_City",
}
EVENT_COUNTRIES = {
    "united states": "us", "usa": "us", "united kingdom": "gb", "denmark": "dk", "danmark": "dk", "germany": "de",
    "sweden": "se", "norway": "no", "canada": "ca", "australia": "au", "ireland": "ie", "france": "fr", "spain": "es",
    "netherlands": "nl",
}
#: Zones of North American states, and of countries with several zones where nothing more is known.
STATE_ZONES = {
    "America/Phoenix": ["AZ", "Arizona"],
    "America/Los_Angeles": ["CA", "WA", "OR", "NV", "California", "Washington", "Oregon", "Nevada"],
    "America/Denver": ["CO", "UT", "NM", "MT", "WY", "ID", "Colorado", "Utah", "New Mexico", "Montana", "Wyoming", "Idaho"],
    "America/Chicago": [
        "IL", "TX", "TN", "MO", "MN", "WI", "LA", "AL", "MS", "IA", "KS", "OK", "AR", "NE", "ND", "SD", "Illinois", "Texas", "Tennessee",
        "Missouri", "Minnesota", "Wisconsin", "Louisiana", "Alabama", "Mississippi", "Iowa", "Kansas", "Oklahoma", "Arkansas", "Nebraska",
    ],
}
HOME_ZONES = {"us": "America/New_York", "ca": "America/Toronto"}
#: North American zones by longitude: each begins at its western edge.
ZONE_EDGES = [(-180.0, "America/Los_Angeles"), (-115.0, "America/Denver"), (-101.0, "America/Chicago"), (-87.0, "America/New_York")]


def event_zone(country: Column, region: Column, longitude: Column, page_url: Column) -> Column:
    """Time zone of an event, by look-ups from the narrowest fact to the widest.

    A stated country decides over the page's TLD. Where a country has several zones, the state
    names one; an unnamed state is replaced by the longitude, and with neither the country's main
    zone holds. Unknown countries are UTC.
    """
    by_state = {state.lower(): zone for zone, states in STATE_ZONES.items() for state in states}
    edges = F.array(*[F.struct(F.lit(west).alias("west"), F.lit(zone).alias("zone")) for west, zone in ZONE_EDGES])

    def code_of(stated: Column) -> Column:
        from_page = first_group(host_of(page_url), r"([^.]+)$")
        return F.when(stated != "", F.coalesce(lookup(EVENT_COUNTRIES, stated), stated)).when(from_page.isin(*EVENT_ZONES), from_page)

    def zone_of(code: Column) -> Column:
        def by_place(state: Column) -> Column:
            by_longitude = F.when(state == "", F.array_max(F.filter(edges, lambda e: e["west"] <= F.greatest(longitude, F.lit(-180.0))))["zone"])
            return F.coalesce(lookup(by_state, state), F.when(longitude.isNotNull(), by_longitude))

        main = lookup(HOME_ZONES, code)
        several = F.when(main.isNotNull(), F.coalesce(let(F.lower(F.coalesce(region, F.lit(""))), by_place), main))
        return F.coalesce(several, lookup(EVENT_ZONES, code), F.lit("UTC"))

    return let(let(F.lower(F.trim(F.coalesce(country, F.lit("")))), code_of), zone_of)


#: Zone names that office calendars write, and their zone ids.
OFFICE_ZONES = {
    "Romance Standard Time": "Europe/Paris", "W. Europe Standard Time": "Europe/Berlin", "Central Europe Standard Time": "Europe/Budapest",
    "Central European Standard Time": "Europe/Warsaw", "GMT Standard Time": "Europe/London", "E. Europe Standard Time": "Europe/Chisinau",
    "FLE Standard Time": "Europe/Kiev", "GTB Standard Time": "Europe/Bucharest", "Russian Standard Time": "Europe/Moscow",
    "Turkey Standard Time": "Europe/Istanbul", "Eastern Standard Time": "America/New_York", "Central Standard Time": "America/Chicago",
    "Mountain Standard Time": "America/Denver", "Pacific Standard Time": "America/Los_Angeles", "Atlantic Standard Time": "America/Halifax",
    "Tokyo Standard Time": "Asia/Tokyo", "China Standard Time": "Asia/Shanghai", "India Standard Time": "Asia/Kolkata",
    "AUS Eastern Standard Time": "Australia/Sydney", "New Zealand Standard Time": "Pacific/Auckland",
}


def known_zone(name: Column) -> Column:
    """A zone id for a calendar's zone name: quotes go, office names are mapped, unknown names are UTC."""
    plain = F.trim(F.regexp_replace(name, '"', ""))
    mapped = F.coalesce(lookup(OFFICE_ZONES, plain), plain)
    return F.when(mapped.isin(*sorted(available_timezones())), mapped).otherwise("UTC")


def to_utc(value: Column, zone: Column) -> Column:
    """ISO text to an instant; wall time without an offset is local to ``zone``."""

    def instant(text: Column) -> Column:
        local = text.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}") & ~text.rlike(r"(?:[zZ]|[+-]\d{2}:?\d{2})$")
        wall = F.try_to_timestamp(F.replace(F.substring(text, 1, 16), F.lit("T"), F.lit(" ")))
        with_colon = F.regexp_replace(text, r"([+-]\d{2})(\d{2})$", "$1:$2")
        exact = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}T"), F.try_to_timestamp(with_colon)).when(
            text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_timestamp(text)
        )
        return F.when(local, F.to_utc_timestamp(wall, zone)).otherwise(exact)

    return let(strip_blank(F.coalesce(value, F.lit(""))), instant)


#: Month numbers by the first three letters, in the languages read.
MONTHS = {
    "jan": 1, "feb": 2, "mar": 3, "apr": 4, "maj": 5, "may": 5, "mai": 5, "jun": 6, "jul": 7, "aug": 8, "sep": 9,
    "okt": 10, "oct": 10, "nov": 11, "dec": 12, "des": 12,
}


def month_number(name: Column) -> Column:
    """Number of a month from its name, NULL if unknown."""
    return lookup(MONTHS, F.substring(F.lower(name), 1, 3))


def clock_24(text: Column) -> Column:
    """``7:30 pm`` to ``19:30``; NULL when there is no such time."""
    pattern = r"(?i)(\d{1,2})(?::(\d{2}))?\s*(am|pm)"
    hour = F.regexp_extract(text, pattern, 1).try_cast("int") % 12
    minute = F.coalesce(F.when(F.regexp_extract(text, pattern, 2) != "", F.regexp_extract(text, pattern, 2)), F.lit("00"))
    late = F.when(F.lower(F.regexp_extract(text, pattern, 3)) == "pm", 12).otherwise(0)
    return F.when(text.rlike(pattern), F.concat(F.lpad((hour + late).cast("string"), 2, "0"), F.lit(":"), minute))


def wall_time(year: Column, month: Column, day: Column, clock: Column, zone: Column) -> Column:
    """Instant of a local date and ``HH:MM`` clock; NULL for dates that don't exist, such as 31 February."""
    padded = lambda part, n: F.lpad(part.cast("string"), n, "0")
    date = F.concat(padded(year, 4), F.lit("-"), padded(month, 2), F.lit("-"), padded(day, 2))
    text = F.concat(date, F.lit(" "), F.lpad(F.replace(clock, F.lit("."), F.lit(":")), 5, "0"))
    return F.to_utc_timestamp(F.try_to_timestamp(text), zone)


def next_date(month: Column, day: Column, clock: Column, zone: Column, as_of: Column, grace_days: int = 30) -> Column:
    """Date without a year: this year's, or next year's once it is a month past."""
    this = wall_time(F.year(as_of), month, day, clock, zone)
    later = wall_time(F.year(as_of) + 1, month, day, clock, zone)
    return F.when(this < as_of - F.make_dt_interval(days=F.lit(grace_days)), later).otherwise(this)


def iso(column: Column) -> Column:
    """Instant as ISO text in UTC with milliseconds."""
    return F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
