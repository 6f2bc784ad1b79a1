"""Structured data inside pages: business details, events, products, offers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hostloom.functions import hours as H
from hostloom.functions.patterns import (
    ANY_CASE,
    all_matches,
    blank_to_null,
    collapse,
    first_group,
    let,
    round_half_up,
    strip_blank,
    words,
)
from hostloom.functions.text import decode_feed, drop_elements, drop_tags
from hostloom.functions.times import event_zone, to_utc
from hostloom.functions.urls import resolve
from hostloom.operators.keyed import keep_first, settle

# --- JSON access ----------------------------------------------------------------------------

_NOTHING = "cast(array() as array<variant>)"


def at(node: Column, path: str, kind: str = "variant") -> Column:
    """Value at a path, NULL when it is missing or of another kind."""
    return F.try_variant_get(node, f"$.{path}" if not path.startswith("[") else f"${path}", kind)


def text_at(node: Column, path: str) -> Column:
    """String at a path; numbers, objects and arrays do not count."""
    return F.when(F.schema_of_variant(at(node, path)) == "STRING", at(node, path, "string"))


def scalar_at(node: Column, path: str) -> Column:
    """String or number at a path, as text."""
    return F.when(~F.schema_of_variant(at(node, path)).rlike("^(?:OBJECT|ARRAY|VOID)"), at(node, path, "string"))


def number_at(node: Column, path: str) -> Column:
    """Number at a path, also from numeric text."""
    return scalar_at(node, path).try_cast("double")


def is_object(node: Column) -> Column:
    """The value is an object; looks at its own fields only, where a schema would read all below it."""
    return F.try_variant_get(node, "$", "struct<>").isNotNull()


def list_at(node: Column, path: str) -> Column:
    """Array at a path; a single value counts as an array of one."""
    value = at(node, path)
    missing = value.isNull() | F.is_variant_null(value)
    return F.coalesce(at(node, path, "array<variant>"), F.when(~missing, F.array(value)), F.expr(_NOTHING))


def first_at(node: Column, path: str) -> Column:
    """The value at a path, or its first element when it is an array."""
    return F.try_element_at(list_at(node, path), F.lit(1))


def types_of(node: Column) -> Column:
    """All ``@type`` values joined by spaces."""
    return F.coalesce(F.array_join(at(node, '["@type"]', "array<string>"), " "), text_at(node, '["@type"]'), F.lit(""))


def _unfold(value: Column, text: Column) -> Column:
    """Objects of a JSON value in document order, graphs and nested arrays included.

    Every round opens the lists and graphs of one level, however deep; a value has no more
    levels than its ``text`` has opening brackets, and rounds with nothing to open are free.
    """
    entry = lambda node, open_: F.struct(node.alias("node"), F.lit(open_).alias("open"))

    def open_one(e: Column) -> Column:
        node = e["node"]
        graph = at(node, '["@graph"]')
        itself = F.array(entry(node, False))
        elements = F.transform(F.try_variant_get(node, "$", "array<variant>"), lambda v: entry(v, True))
        opened = F.when(graph.isNull(), itself).otherwise(F.concat(itself, F.array(entry(graph, True))))
        none = F.filter(itself, lambda _: F.lit(False))
        return F.when(~e["open"], F.array(e)).when(F.schema_of_variant(node).startswith("OBJECT"), opened).otherwise(F.coalesce(elements, none))

    def one_level(state: Column, _: Column) -> Column:
        found = F.flatten(F.transform(state["found"], open_one))
        more = let(found, lambda f: F.struct(f.alias("found"), F.exists(f, lambda e: e["open"]).alias("more")))
        return F.when(state["more"], more).otherwise(state)

    start = F.struct(F.array(entry(value, True)).alias("found"), F.lit(True).alias("more"))
    rounds = F.sequence(F.lit(0), F.length(F.regexp_replace(text, r"[^\[{]", "")))
    return F.aggregate(rounds, start, one_level, lambda state: F.transform(state["found"], lambda e: e["node"]))


JSON_LD = r"""(?is)<script[^>]+type=["']application/ld\+json["'][^>]*>(.*?)</script>"""


def json_blocks(html: Column) -> Column:
    """Parsed JSON-LD blocks; blocks that are not JSON are NULL."""
    return F.transform(all_matches(html, JSON_LD, 1), lambda b: F.try_parse_json(strip_blank(b)))


def json_nodes(html: Column) -> Column:
    """Every object of a page's JSON-LD in document order."""
    parsed = lambda b: F.struct(F.try_parse_json(strip_blank(b)).alias("value"), b.alias("text"))
    blocks = F.filter(F.transform(all_matches(html, JSON_LD, 1), parsed), lambda b: b["value"].isNotNull())
    return F.flatten(F.transform(blocks, lambda b: _unfold(b["value"], b["text"])))


def salvage_json(text: Column) -> Column:
    """JSON of a text, else of its part from the first to the last brace."""
    return F.coalesce(F.try_parse_json(text), F.try_parse_json(first_group(text, r"(?s)(\{.*\})")))


# --- prices and offers ----------------------------------------------------------------------


def price_of(offer: Column) -> Column:
    """``struct<price, currency>`` of an offer.

    The first comma is read as a decimal point and every other sign is dropped, so a
    price with a thousands separator is not a number and stays NULL.
    """
    spec = first_at(offer, "priceSpecification")
    raw = F.coalesce(scalar_at(offer, "price"), scalar_at(offer, "lowPrice"), scalar_at(spec, "price"), scalar_at(spec, "minPrice"))
    point = F.regexp_replace(raw, "^([^,]*),", "$1.")
    price = F.regexp_replace(point, r"[^\d.]", "").try_cast("double")
    currency = F.coalesce(blank_to_null(text_at(offer, "priceCurrency")), text_at(spec, "priceCurrency"))
    return F.struct(F.when(price > 0, price).alias("price"), F.substring(F.upper(currency), 1, 3).alias("currency"))


#: Keys under which catalogues and menus hold their parts, in order.
CATALOGUE_KEYS = ("itemListElement", "hasMenuSection", "hasMenuItem", "hasOfferCatalog", "makesOffer", "hasMenu", "item")
_FRONT = "array<struct<path:array<int>,node:variant,category:string>>"


def _open_lists(front: Column) -> Column:
    """Replace arrays of a frontier by their elements, keeping document order."""

    def open_one(f: Column) -> Column:
        elements = F.try_variant_get(f["node"], "$", "array<variant>")
        as_entries = F.transform(
            elements,
            lambda e, i: F.struct(F.array_append(f["path"], i).alias("path"), e.alias("node"), f["category"].alias("category")),
        )
        return F.coalesce(as_entries, F.array(f))

    return F.flatten(F.transform(front, open_one))


def collect_offers(roots: DataFrame, column: str, depth: int = 6, limit: int = 40) -> DataFrame:
    """Offers, menu items and services below catalogue nodes, in document order.

    ``column`` is an array of JSON values. The tree is walked level by level inside
    the row: every level turns its catalogue nodes into the next frontier and its
    leaves into offers tagged with their path, and the paths restore the order.
    Arrays count as a level of their own, as in the rule for the depth.
    """
    keep = [c for c in roots.columns if c != column]
    start = F.transform(
        F.col(column), lambda n, i: F.struct(F.array(i).alias("path"), n.alias("node"), F.lit(None).cast("string").alias("category"))
    )
    none_yet = F.array().cast("array<struct<path:array<int>,name:string,price:double,currency:string,category:string>>")
    df = roots.select(*keep, start.cast(_FRONT).alias("_f"), none_yet.alias("_done"))
    for _ in range(depth):
        known = F.transform(
            F.filter(_open_lists(F.col("_f")), lambda f: is_object(f["node"])),
            lambda f: F.struct(
                f["path"].alias("path"), f["node"].alias("node"), f["category"].alias("category"),
                types_of(f["node"]).alias("types"), text_at(f["node"], "name").alias("name"),
            ),
        )
        opened = settle(df, known.alias("_g"), keep=[*keep, "_done"])
        is_offer = lambda f: f["types"].rlike(r"Offer\b") & ~f["types"].rlike("OfferCatalog")
        is_item = lambda f: f["types"].rlike("MenuItem|Service|Product") & f["name"].isNotNull()

        def leaf(f: Column) -> Column:
            name = F.when(is_offer(f), F.coalesce(text_at(f["node"], "itemOffered.name"), f["name"])).otherwise(f["name"])
            source = F.when(is_offer(f), f["node"]).otherwise(first_at(f["node"], "offers"))
            priced = F.transform(F.array(source), price_of)[0]
            return F.struct(
                f["path"].alias("path"), F.substring(strip_blank(name), 1, 120).alias("name"), priced.alias("price"), f["category"].alias("category")
            )

        def children(f: Column) -> Column:
            named = f["types"].rlike("OfferCatalog|MenuSection") & f["name"].isNotNull()
            category = F.when(named, F.substring(f["name"], 1, 60)).otherwise(f["category"])
            keys = F.array(*[F.struct(F.lit(i).alias("i"), at(f["node"], key).alias("node")) for i, key in enumerate(CATALOGUE_KEYS)])
            return F.transform(
                F.filter(keys, lambda k: k["node"].isNotNull()),
                lambda k: F.struct(F.array_append(f["path"], k["i"]).alias("path"), k["node"].alias("node"), category.alias("category")),
            )

        leaves = F.transform(F.filter("_g", lambda f: is_offer(f) | is_item(f)), leaf)
        found = F.transform(
            F.filter(leaves, lambda o: F.coalesce(o["name"], F.lit("")) != ""),
            lambda o: F.struct(
                o["path"].alias("path"), o["name"].alias("name"), o["price"]["price"].alias("price"), o["price"]["currency"].alias("currency"), o["category"].alias("category")
            ),
        )
        below = F.flatten(F.transform(F.filter("_g", lambda f: ~is_offer(f) & ~is_item(f)), children))
        df = settle(opened, F.concat("_done", found).alias("_done"), below.alias("_f"), keep=keep)
    ordered = F.slice(F.array_sort("_done"), 1, limit)
    firsts = let(ordered, lambda all_: F.filter(all_, lambda o, i: ~F.exists(F.slice(all_, 1, i), lambda e: e["name"] == o["name"])))
    return df.select(*keep, F.posexplode(firsts).alias("pos", "_o")).select(
        *keep, "pos", F.col("_o.name").alias("name"), F.col("_o.price").alias("price"),
        F.col("_o.currency").alias("currency"), F.col("_o.category").alias("category"),
    )


def page_offers(pages: DataFrame) -> DataFrame:
    """Offers of the business node and of separate menu, catalogue and service blocks."""
    keep = [c for c in pages.columns if c != "html"]
    nodes = settle(pages, json_nodes(F.col("html")).alias("_nodes"), keep=keep)
    found = settle(nodes, business_node(F.col("_nodes")).alias("_b")).where(F.col("_b").isNotNull())
    roots = F.concat(
        F.array_compact(F.array(*[at(F.col("_b"), key) for key in ("makesOffer", "hasOfferCatalog", "hasMenu")])),
        F.filter("_nodes", lambda n: types_of(n).rlike("^(?:Menu|OfferCatalog|Service)$")),
    )
    return collect_offers(settle(found, roots.alias("_roots"), keep=keep), "_roots")


# --- business -------------------------------------------------------------------------------

#: Types that describe a business.
BUSINESS_TYPES = (
    "(?i)LocalBusiness|Organization|Store|Restaurant|CafeOrCoffeeShop|BarOrPub|FoodEstablishment|HealthAndBeautyBusiness"
    "|HairSalon|BeautySalon|DaySpa|MedicalBusiness|Dentist|Physician|Hotel|LodgingBusiness|AutoRepair|AutomotiveBusiness"
    "|ProfessionalService|LegalService|FinancialService|RealEstateAgent|SportsActivityLocation|ExerciseGym"
    "|EntertainmentBusiness|TouristAttraction|ShoppingCenter|HomeAndConstructionBusiness|EducationalOrganization|Library|Museum"
)


def business_node(nodes: Column) -> Column:
    """The node that describes the business: a specific one with address or hours first."""
    typed = F.transform(nodes, lambda n: F.struct(n.alias("node"), types_of(n).alias("types")))
    placed = lambda n: at(n, "address").isNotNull() | at(n, "openingHoursSpecification").isNotNull() | at(n, "openingHours").isNotNull()
    specific = lambda e: ~e["types"].rlike("(?i)^Organization$") & placed(e["node"])

    def chosen(fit: Column) -> Column:
        return F.coalesce(F.try_element_at(F.filter(fit, specific), F.lit(1)), F.try_element_at(fit, F.lit(1)))["node"]

    return let(F.filter(typed, lambda e: e["types"].rlike(BUSINESS_TYPES)), chosen)


def _address(node: Column) -> Column:
    a = first_at(node, "address")
    country = F.coalesce(text_at(a, "addressCountry.name"), scalar_at(a, "addressCountry"))
    street = F.coalesce(blank_to_null(text_at(a, "streetAddress")), F.when(F.schema_of_variant(a) == "STRING", F.try_variant_get(a, "$", "string")))
    parts = F.struct(
        street.alias("street"), blank_to_null(text_at(a, "addressLocality")).alias("city"),
        blank_to_null(scalar_at(a, "postalCode")).alias("postcode"), blank_to_null(text_at(a, "addressRegion")).alias("region"),
        blank_to_null(country).alias("country"),
    )
    return let(parts, lambda p: F.when(F.coalesce(p["street"], p["city"], p["postcode"], p["region"], p["country"]).isNotNull(), p))


_DATE = r"^\d{4}-\d{2}-\d{2}$"


def _special_days(node: Column, as_of: Column) -> Column:
    specs = F.concat(list_at(node, "openingHoursSpecification"), list_at(node, "specialOpeningHoursSpecification"))

    def special(s: Column) -> Column:
        opens, closes = H.clock(scalar_at(s, "opens")), H.clock(scalar_at(s, "closes"))
        start = F.substring(F.coalesce(scalar_at(s, "validFrom"), F.lit("")), 1, 10)
        end = F.substring(F.coalesce(scalar_at(s, "validThrough"), scalar_at(s, "validFrom"), F.lit("")), 1, 10)
        closed = opens.isNull() | closes.isNull() | ((opens == "00:00") & (closes == "00:00"))
        from_, to = F.when(start.rlike(_DATE), F.try_to_timestamp(start)), F.when(end.rlike(_DATE), F.try_to_timestamp(end))
        soon = (to >= as_of - F.make_dt_interval(days=F.lit(1))) & (from_ <= as_of + F.make_dt_interval(days=F.lit(366)))
        return F.when(
            soon,
            F.struct(
                start.alias("from"), end.alias("to"), closed.alias("closed"), F.when(~closed, opens).alias("opens"), F.when(~closed, closes).alias("closes")
            ),
        )

    return F.slice(F.array_compact(F.transform(specs, special)), 1, 20)


def _weekly_hours(node: Column) -> Column:
    specs = F.concat(list_at(node, "openingHoursSpecification"), list_at(node, "specialOpeningHoursSpecification"))
    dated = lambda s: F.coalesce(F.substring(scalar_at(s, "validFrom"), 1, 10).rlike(_DATE), F.lit(False))

    def weekly(s: Column) -> Column:
        days = F.array_compact(F.transform(list_at(s, "dayOfWeek"), lambda d: H.day_code(F.try_variant_get(d, "$", "string"))))
        return F.struct(days.alias("days"), H.clock(scalar_at(s, "opens")).alias("opens"), H.clock(scalar_at(s, "closes")).alias("closes"))

    parsed = F.transform(F.filter(specs, lambda s: ~dated(s)), weekly)
    whole = F.filter(parsed, lambda h: (F.size(h["days"]) > 0) & h["opens"].isNotNull() & h["closes"].isNotNull())
    text = F.array_join(F.transform(list_at(node, "openingHours"), lambda t: F.try_variant_get(t, "$", "string")), "; ")
    return let(whole, lambda w: F.when(F.size(w) > 0, w).otherwise(H.parse_hours(text)))


def page_rating(html: Column) -> Column:
    """``struct<value, count, best, source>`` shown on a page: microdata, or "4.7/5 … Google".

    Only five-point ratings with a named source or microdata count.
    """

    def plain_count(text: Column) -> Column:
        value = F.regexp_replace(text, r"[.,](?=\d{3}\b)", "").try_cast("double")
        return F.when(value > 0, value)

    def micro(prop: str) -> Column:
        pattern = rf"""(?i)itemprop=["']{prop}["'][^>]*?(?:content=["']([\d.,]+)["']|>\s*([\d.,]+))"""
        return F.coalesce(blank_to_null(F.regexp_extract(html, pattern, 1)), blank_to_null(F.regexp_extract(html, pattern, 2)))

    as_number = lambda t: F.regexp_replace(t, "^([^,]*),", "$1.").try_cast("double")
    micro_value = as_number(micro("ratingValue"))
    sites = r"trustpilot|google|tripadvisor|yelp|feefo|reviews\.io|trusted shops"
    star = r"[1-4](?:[.,]\d)?|5(?:[.,]0)?"
    left = rf"(?i)\b({star})\s*(?:/\s*5|out of 5)(?:\s*stars?)?[^.]{{0,60}}?\b({sites})\b"
    right = rf"(?i)\b(trustpilot|google|tripadvisor|yelp|feefo)\b[^.]{{0,40}}?\b({star})\s*(?:/\s*5|out of 5)"
    text = collapse(drop_tags(html))

    def shown(t: Column) -> Column:
        where_left, where_right = F.regexp_instr(t, F.lit(left)), F.regexp_instr(t, F.lit(right))
        use_left = (where_left > 0) & ((where_right == 0) | (where_left <= where_right))
        value = as_number(F.when(use_left, F.regexp_extract(t, left, 1)).when(where_right > 0, F.regexp_extract(t, right, 2)))
        source = F.lower(F.when(use_left, F.regexp_extract(t, left, 2)).when(where_right > 0, F.regexp_extract(t, right, 1)))
        place = F.when(use_left, where_left).otherwise(where_right)
        near = F.substring(t, F.greatest(place - 80, F.lit(1)), F.lit(240))
        count = plain_count(F.regexp_extract(near, r"(?i)([\d.,]{1,9})\s*(?:reviews|ratings|anmeldelser|bewertungen|avis)", 1))
        return F.when((value > 0) & (value <= 5), rating(value, count, F.lit(None), source))

    def rating(value: Column, count: Column, best: Column, source: Column) -> Column:
        return F.struct(value.alias("value"), count.alias("count"), best.cast("double").alias("best"), source.alias("source"))

    micro_count = plain_count(F.coalesce(micro("reviewCount"), micro("ratingCount")))
    from_micro = F.when(
        (micro_value > 0) & (micro_value <= 5), rating(round_half_up(micro_value, 1), micro_count, F.lit(None), F.lit("microdata"))
    )
    return F.coalesce(from_micro, let(text, shown))


#: Notices of closure and of holiday hours.
CLOSED_NOTICE = (
    rf"{ANY_CASE}(?<!\p{{L}})(?:temporarily closed|closed for (?:renovation|refurbishment|the season|winter|summer|holidays?|maintenance)"
    r"|closed until|currently closed|we are closed|we're closed|midlertidigt lukket|lukket indtil|lukket for sæsonen"
    r"|vorübergehend geschlossen|geschlossen bis|wegen renovierung geschlossen|tijdelijk gesloten|gesloten tot"
    r"|tillfälligt stängt|stängt till)(?!\p{L})"
)
HOLIDAY_NOTICE = (
    rf"{ANY_CASE}(?<!\p{{L}})(?:holiday (?:opening )?hours|christmas (?:opening )?hours|easter (?:opening )?hours"
    r"|åbningstider (?:i|til|over) (?:jul|påske|ferien)|öffnungszeiten (?:an|zu|über) (?:weihnachten|ostern|feiertagen)"
    r"|openingstijden (?:rond|met|tijdens) (?:kerst|pasen|feestdagen))(?!\p{L})"
)
PAST_NOTICE = words("was", "were", "had been", "reopened", "genåbnet", "wiedereröffnet", "heropend", r"(?:19|20)[0-2]\d")
WEEKDAY_NOTICE = words("(?:on|på|am|op) (?:mondays?|sundays?|mandag|søndag|montags?|sonntags?|maandag|zondag)")


def closure_notice(html: Column, as_of: Column) -> Column:
    """``struct<text, closed>`` of a current closure or holiday-hours notice.

    Sentences about the past do not count, unless they name this year or the next.
    """
    this_year = F.year(as_of)
    current = lambda s: s.contains(this_year.cast("string")) | s.contains((this_year + 1).cast("string"))

    def notice(body: Column, pattern: str, closing: bool) -> Column:
        def from_position(place: Column) -> Column:
            before = F.substring(body, F.lit(1), place - 1)
            dot = F.instr(F.reverse(before), " .")
            sentence_start = F.when(dot > 0, F.length(before) - dot + 2).otherwise(1)
            start = F.greatest(sentence_start, place - 120)
            end = F.locate(". ", F.substring(body, place, F.lit(10_000)))
            stop = F.when((end > 0) & (end - 1 < 200), place + end - 1).otherwise(place + 159)
            sentence = strip_blank(F.substring(body, start, stop - start + 1))

            def judged(s: Column) -> Column:
                past = s.rlike(PAST_NOTICE) & ~current(s)
                closed = F.lit(closing) & ~s.rlike(WEEKDAY_NOTICE)
                return F.when(~past, F.struct(F.substring(s, 1, 200).alias("text"), closed.alias("closed")))

            return let(sentence, judged)

        return F.when(body.rlike(pattern), let(F.regexp_instr(body, F.lit(pattern)), from_position))

    text = collapse(F.replace(drop_tags(drop_elements(html, ("script", "style", "noscript", "svg"))), F.lit("&nbsp;"), F.lit(" ")))
    return let(text, lambda body: F.coalesce(notice(body, CLOSED_NOTICE, True), notice(body, HOLIDAY_NOTICE, False)))


def page_business(pages: DataFrame, as_of: Column) -> DataFrame:
    """Business details of every page that has any; pages with nothing useful drop out."""
    keep = [c for c in pages.columns if c != "html"]
    read = settle(pages, json_nodes(F.col("html")).alias("_nodes"))
    nodes = settle(read, business_node(F.col("_nodes")).alias("n"), keep=[*keep, "html"]).where(F.col("n").isNotNull())
    n = F.col("n")
    value, best = number_at(n, "aggregateRating.ratingValue"), number_at(n, "aggregateRating.bestRating")
    count = F.coalesce(number_at(n, "aggregateRating.reviewCount"), number_at(n, "aggregateRating.ratingCount"))
    rating = F.when(
        value > 0,
        F.struct(
            round_half_up(value, 1).alias("value"), F.when(count > 0, count).alias("count"),
            F.when((best > 0) & (best != 5), best).alias("best"), F.lit("schema.org").alias("source"),
        ),
    )
    lat, lon = number_at(n, "geo.latitude"), number_at(n, "geo.longitude")
    out = settle(
        nodes,
        blank_to_null(F.split(types_of(n), " ")[0]).alias("type"),
        F.substring(text_at(n, "name"), 1, 120).alias("name"),
        text_at(n, "telephone").alias("telephone"),
        F.regexp_replace(text_at(n, "email"), "^mailto:", "").alias("email"),
        F.substring(text_at(n, "priceRange"), 1, 40).alias("price_range"),
        _address(n).alias("address"),
        F.when(lat.isNotNull() & lon.isNotNull(), F.struct(lat.alias("lat"), lon.alias("lon"))).alias("geo"),
        let(_weekly_hours(n), lambda h: F.when(F.size(h) > 0, h)).alias("opening_hours"),
        let(_special_days(n, as_of), lambda s: F.when(F.size(s) > 0, s)).alias("special_hours"),
        closure_notice(F.col("html"), as_of).alias("closure_notice"),
        F.coalesce(rating, page_rating(F.col("html"))).alias("rating"),
        keep=keep,
    )
    return out.where(
        F.coalesce(F.col("address").cast("string"), "telephone", F.col("opening_hours").cast("string"), F.col("geo").cast("string"), F.col("rating").cast("string")).isNotNull()
    )


# --- events ---------------------------------------------------------------------------------

EVENT_TYPES = r"(?:^|\s)(?:Event|\w+Event|Festival|CourseInstance)(?:\s|$)"


def page_events(pages: DataFrame, as_of: Column, url_column: str = "url", limit: int = 50) -> DataFrame:
    """Upcoming events of pages: from a day back to 400 days ahead, in page order.

    A row of ``pages`` gives its first ``limit`` upcoming events (0: all). The start decides
    which those are, so it is worked out inside the page's list; everything else is read
    after the cut. Nothing is shuffled, and two snapshots of a page don't share the limit.
    """
    keep = [c for c in pages.columns if c != "html"]
    nodes = json_nodes(F.col("html"))
    nested = lambda n: F.concat(*[_unfold_if(at(n, key)) for key in ("event", "events", "subEvent")])
    staged = settle(pages, nodes.alias("_nodes"), keep=keep)
    every = F.concat("_nodes", F.flatten(F.transform("_nodes", nested)))
    is_event = lambda n: types_of(n).rlike(EVENT_TYPES) & text_at(n, "name").isNotNull()
    country_of = lambda loc: F.coalesce(text_at(loc, "address.addressCountry.name"), text_at(loc, "address.addressCountry"))
    earliest, latest = as_of - F.make_dt_interval(days=F.lit(1)), as_of + F.make_dt_interval(days=F.lit(400))

    def started(n: Column, pos: Column) -> Column:
        def timed(loc: Column) -> Column:
            zone = event_zone(country_of(loc), text_at(loc, "address.addressRegion"), number_at(loc, "geo.longitude"), F.col(url_column))
            begin = lambda z: F.struct(
                pos.alias("pos"), n.alias("n"), loc.alias("loc"), z.alias("zone"), to_utc(scalar_at(n, "startDate"), z).alias("start")
            )
            return let(zone, begin)

        return let(first_at(n, "location"), timed)

    upcoming = F.filter(F.transform(F.filter(every, is_event), started), lambda e: e["start"].between(earliest, latest))
    rows = staged.select(*keep, F.explode(F.slice(upcoming, 1, limit) if limit else upcoming).alias("_e"))
    n, loc = F.col("_e.n"), F.col("_e.loc")
    timed = settle(
        rows,
        first_at(n, "offers").alias("offer"),
        country_of(loc).alias("_country"),
        text_at(n, "url").alias("_href"),
        F.col("_e.start").alias("start_date"),
        to_utc(scalar_at(n, "endDate"), F.col("_e.zone")).alias("_end"),
    )
    country = F.col("_country")
    price = price_of(F.col("offer"))
    online = F.coalesce(text_at(n, "eventAttendanceMode").rlike("(?i)Online"), F.lit(False)) | F.coalesce(
        types_of(loc).contains("VirtualLocation"), F.lit(False)
    )
    lat, lon = number_at(loc, "geo.latitude"), number_at(loc, "geo.longitude")
    both = lat.isNotNull() & lon.isNotNull()
    return timed.select(
        *keep,
        F.col("_e.pos").alias("pos"),
        F.substring(strip_blank(decode_feed(text_at(n, "name"))), 1, 200).alias("name"),
        F.coalesce(resolve(F.col("_href"), F.col(url_column)), F.col(url_column)).alias("event_url"),
        "start_date",
        F.when(F.col("_end") >= F.col("start_date"), F.col("_end")).alias("end_date"),
        F.substring(collapse(decode_feed(drop_tags(text_at(n, "description")))), 1, 300).alias("description"),
        F.substring(decode_feed(text_at(loc, "name")), 1, 120).alias("venue"),
        F.substring(text_at(loc, "address.addressLocality"), 1, 80).alias("city"),
        F.substring(country, 1, 60).alias("country"),
        F.when(both, lat).alias("lat"),
        F.when(both, lon).alias("lon"),
        price["price"].alias("price"),
        price["currency"].alias("currency"),
        online.alias("online"),
    )


def _unfold_if(value: Column) -> Column:
    return F.when(value.isNotNull(), _unfold(value, F.to_json(value))).otherwise(F.expr(_NOTHING))


# --- products -------------------------------------------------------------------------------


def page_products(pages: DataFrame, default_currency: str = "USD") -> DataFrame:
    """The page's own product: the first Product, or a group's first priced variant."""
    keep = [c for c in pages.columns if c != "html"]
    is_type = lambda n, name: F.array_contains(F.split(types_of(n), " "), name)

    def of_block(block: Column) -> Column:
        items = F.coalesce(F.try_variant_get(block, "$", "array<variant>"), at(block, '["@graph"]', "array<variant>"), F.array(block))
        product = F.try_element_at(F.filter(items, lambda n: is_type(n, "Product")), F.lit(1))
        group = F.try_element_at(F.filter(items, lambda n: is_type(n, "ProductGroup")), F.lit(1))
        variant = F.try_element_at(F.filter(list_at(group, "hasVariant"), lambda v: at(v, "offers").isNotNull()), F.lit(1))
        return F.when(product.isNotNull(), F.struct(product.alias("p"), F.lit(None).cast("variant").alias("g"))).when(
            variant.isNotNull(), F.struct(variant.alias("p"), group.alias("g"))
        )

    blocks = F.array_compact(F.transform(F.array_compact(json_blocks(F.col("html"))), of_block))
    rows = settle(pages, F.try_element_at(blocks, F.lit(1)).alias("_b"), keep=keep).where(F.col("_b").isNotNull()).select(*keep, "_b.p", "_b.g")
    p, g = F.col("p"), F.col("g")
    own = lambda path: F.coalesce(text_at(g, path), text_at(p, path))
    brand = F.coalesce(text_at(g, "brand"), text_at(g, "brand.name"), text_at(p, "brand"), text_at(p, "brand.name"))
    offer = F.coalesce(first_at(p, "offers.offers"), first_at(p, "offers"))
    staged = settle(rows, own("name").alias("_name"), brand.alias("_brand"), offer.alias("offer"), keep=[*keep, "p"]).where(F.coalesce("_name", F.lit("")) != "")
    offer = F.col("offer")
    price = F.coalesce(scalar_at(offer, "price"), scalar_at(offer, "lowPrice")).try_cast("double")
    codes = F.array(*[strip_blank(scalar_at(p, f)) for f in ("gtin13", "gtin12", "gtin14", "gtin8", "gtin")])
    named = F.when(
        F.col("_brand").isNotNull() & ~F.lower("_name").contains(F.lower("_brand")), F.concat_ws(" ", "_brand", "_name")
    ).otherwise(F.col("_name"))
    return staged.select(
        *keep,
        F.substring(named, 1, 200).alias("name"),
        price.alias("price"),
        F.coalesce(text_at(offer, "priceCurrency"), F.lit(default_currency)).alias("currency"),
        F.coalesce(F.try_variant_get(first_at(p, "image"), "$", "string")).alias("image"),
        text_at(offer, "availability").rlike("(?i)InStock|LimitedAvailability|PreOrder").alias("available"),
        F.try_element_at(F.filter(codes, lambda c: c.rlike(r"^\d{8,14}$")), F.lit(1)).alias("gtin"),
    )


def without_repeats(events: DataFrame) -> DataFrame:
    """Events once per (url, start): the first in page order stays."""
    return keep_first(events, ["event_url", "start_date"], F.col("pos"), F.col("name"))

