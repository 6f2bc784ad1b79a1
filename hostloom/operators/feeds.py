"""Text feeds and listings: robots.txt, site guides, calendars, map places, venue listings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hostloom.functions import hours as H
from hostloom.functions.patterns import all_matches, blank_to_null, collapse, first_group, let, strip_blank, words
from hostloom.functions.text import decode_feed, drop_tags
from hostloom.functions.times import clock_24, known_zone, lookup, month_number, next_date, to_utc, wall_time
from hostloom.functions.urls import host_of, path_of, resolve, same_site, trimmed_path, without_www
from hostloom.operators.keyed import fence, join_hot_left, keep_first, keep_last, settle, top_per_group
from hostloom.operators.pages import is_own_website
from hostloom.operators.shops import labels_of
from hostloom.operators.structured import at, list_at, scalar_at, text_at

# --- robots.txt -----------------------------------------------------------------------------


def robots_groups(body: Column) -> Column:
    """``array<struct<agents, rules: array<struct<allow, path>>>>`` of a robots.txt.

    Consecutive user-agent lines share the rules that follow. One fold over the lines
    of a file; a file is one row, so no window over all files is needed.
    """
    lines = F.transform(F.split(body, r"\r?\n"), lambda line: F.trim(F.regexp_replace(line, "#.*$", "")))
    fields = F.filter(
        F.transform(
            lines,
            lambda line: F.struct(
                F.lower(F.regexp_extract(line, r"^([A-Za-z-]+)\s*:\s*(.*)$", 1)).alias("key"),
                F.trim(F.regexp_extract(line, r"^([A-Za-z-]+)\s*:\s*(.*)$", 2)).alias("value"),
            ),
        ),
        lambda f: f["key"] != "",
    )
    group = "struct<agents:array<string>,rules:array<struct<allow:boolean,path:string>>>"
    state = f"struct<done:array<{group}>,open:{group},naming:boolean>"
    start = F.from_json(F.lit('{"done":[],"open":null,"naming":false}'), state)

    def step(s: Column, f: Column) -> Column:
        is_agent = f["key"] == "user-agent"
        is_rule = f["key"].isin("allow", "disallow") & s["open"].isNotNull()
        starts = is_agent & (s["open"].isNull() | ~s["naming"])
        closed = F.when(starts & s["open"].isNotNull(), F.array_append(s["done"], s["open"])).otherwise(s["done"])
        rule = F.struct((f["key"] == "allow").alias("allow"), f["value"].alias("path"))
        fresh = F.struct(F.array(F.lower(f["value"])).alias("agents"), F.array().cast("array<struct<allow:boolean,path:string>>").alias("rules"))
        named = F.struct(F.array_append(s["open"]["agents"], F.lower(f["value"])).alias("agents"), s["open"]["rules"].alias("rules"))
        ruled = F.struct(s["open"]["agents"].alias("agents"), F.array_append(s["open"]["rules"], rule).alias("rules"))
        opened = F.when(starts, fresh).when(is_agent, named).when(is_rule, ruled).otherwise(s["open"])
        return F.struct(closed.alias("done"), opened.alias("open"), is_agent.alias("naming")).cast(state)

    return F.aggregate(
        fields, start, step, lambda s: F.when(s["open"].isNotNull(), F.array_append(s["done"], s["open"])).otherwise(s["done"])
    )


def _pattern(path: Column) -> Column:
    """Regular expression of a robots path: ``*`` is a wildcard, a final ``$`` anchors."""
    anchored = path.endswith("$")
    body = F.regexp_replace(path, r"\$$", "")
    escaped = F.regexp_replace(body, r"[.+?^${}()|\[\]\\]", r"\\$0")
    return F.concat(F.lit("^"), F.replace(escaped, F.lit("*"), F.lit(".*")), F.when(anchored, "$").otherwise(""))


def crawl_permissions(robots: DataFrame, requests: DataFrame, agent: str) -> DataFrame:
    """May ``agent`` fetch a path? The longest matching rule wins, allow wins ties.

    ``robots`` has (host, status, body), ``requests`` (host, path). Server errors
    forbid everything, other failures nothing. The rules stay in the host's row: a
    request meets one row, never the product of rules and paths.
    """
    name = agent.lower()
    ours = lambda g: F.exists(g["agents"], lambda a: a.contains(name))
    groups = robots_groups(F.col("body"))
    chosen = let(
        groups,
        lambda all_: let(
            F.filter(all_, ours),
            lambda mine: F.when(F.size(mine) > 0, mine).otherwise(F.filter(all_, lambda g: F.array_contains(g["agents"], "*"))),
        ),
    )
    rules = F.filter(F.flatten(F.transform(chosen, lambda g: g["rules"])), lambda r: r["path"] != "")
    prepared = robots.select(
        "host",
        (F.col("status") >= 500).alias("_closed"),
        F.when(F.col("status").between(200, 299), F.transform(
            rules, lambda r: F.struct(_pattern(r["path"]).alias("regex"), F.length(F.regexp_replace(r["path"], r"\$$", "")).alias("length"), r["allow"].alias("allow"))
        )).alias("_rules"),
    )
    best = F.array_max(
        F.transform(
            F.filter("_rules", lambda r: F.regexp_like(F.col("path"), r["regex"])), lambda r: F.struct(r["length"].alias("length"), r["allow"].alias("allow"))
        )
    )
    return requests.join(prepared, "host", "left").select(
        *requests.columns,
        F.when(F.coalesce("_closed", F.lit(False)), False).otherwise(F.coalesce(best["allow"], F.lit(True))).alias("allowed"),
    )


#: Assistants and crawlers that robots.txt files name.
AI_BOTS = (
    "GPTBot", "OAI-SearchBot", "ChatGPT-User", "ClaudeBot", "Claude-SearchBot", "Claude-User", "PerplexityBot", "Perplexity-User",
    "Google-Extended", "Applebot-Extended", "Amazonbot", "meta-externalagent", "CCBot", "Bytespider", "cohere-ai",
    "DuckAssistBot", "MistralAI-User",
)


def blocked_everywhere(groups: Column, bot: str) -> Column:
    """The bot's most specific group forbids the root without allowing it again."""
    name = F.lit(bot.lower())
    own = F.filter(groups, lambda g: F.exists(g["agents"], lambda a: (a != "*") & name.contains(a)))
    general = F.filter(groups, lambda g: F.array_contains(g["agents"], "*"))
    group = F.coalesce(F.try_element_at(own, F.lit(1)), F.try_element_at(general, F.lit(1)))

    def verdict(g: Column) -> Column:
        shut = F.exists(g["rules"], lambda r: ~r["allow"] & r["path"].isin("/", "/*"))
        again = F.exists(g["rules"], lambda r: r["allow"] & r["path"].isin("/", "/*", ""))
        return F.coalesce(shut & ~again, F.lit(False))

    return let(group, verdict)


def bot_block_audit(robots: DataFrame, bots: Sequence[str] = AI_BOTS) -> DataFrame:
    """Per host: is there a robots.txt, which bots it shuts out, and whether everyone.

    ``robots`` has (host, status, content_type, body); no status means no answer. An
    empty rule keeps its meaning here: ``Allow:`` opens, ``Disallow:`` says nothing.
    """
    readable = F.col("status").between(200, 299) & ~F.coalesce(F.col("content_type"), F.lit("")).contains("html")
    groups = F.transform(
        robots_groups(F.col("body")),
        lambda g: F.struct(
            g["agents"].alias("agents"), F.filter(g["rules"], lambda r: r["allow"] | (r["path"] != "")).alias("rules")
        ),
    )
    staged = settle(robots, readable.alias("_ok"), F.when(readable, groups).alias("_g"), keep=["host", "status"])
    found = F.array_compact(F.array(*[F.when(blocked_everywhere(F.col("_g"), b), F.lit(b)) for b in bots]))
    return staged.select(
        "host",
        F.when(F.col("status").isNotNull(), F.col("_ok")).alias("robots_txt"),
        F.when(F.col("_ok"), found).otherwise(F.array().cast("array<string>")).alias("blocked"),
        F.when(F.col("_ok"), blocked_everywhere(F.col("_g"), "SomeOtherBot")).alias("blocks_everyone"),
    )


# --- site guides (markdown files that list a site's pages) -----------------------------------

#: Fixed value: a guide's list entry: title, address and note.
GUIDE_LINK = r"(?m)^\s*[-*]\s*\[([^\]]{1,120})\]\((\S+?)\)\s*(?::\s*(.+))?$"


def is_guide(text: Column) -> Column:
    """The file starts with a markdown heading."""
    return text.rlike(r"^\s*#\s+\S")


def guide_summary(text: Column) -> Column:
    """The block quote under the title."""
    return F.substring(F.trim(first_group(text, r"^\s*#[^\n]*\n+\s*>\s*([^\n]+)")), 1, 400)


def guide_pages(guides: DataFrame, limit: int = 10) -> DataFrame:
    """Pages of the site's own host that a guide lists: (domain, pos, path, title, content)."""
    body = F.col("body")
    groups = F.arrays_zip(*[all_matches(body, GUIDE_LINK, g).alias(n) for g, n in ((1, "t"), (2, "u"), (3, "d"))])
    links = guides.where(is_guide(body)).select("domain", F.posexplode(groups).alias("pos", "g"))
    url = resolve(F.col("g.u"), F.concat(F.lit("https://"), F.col("domain"), F.lit("/")))
    path = F.regexp_replace(F.regexp_replace(path_of(url), r"\.md$", ""), "/index$", "/")
    rows = links.where(same_site(host_of(url), F.col("domain"))).select(
        "domain", "pos", path.alias("path"), F.trim("g.t").alias("title"),
        F.substring(F.trim(F.coalesce(blank_to_null(F.col("g.d")), F.col("g.t"))), 1, 300).alias("content"),
    ).where(~F.col("path").isin("", "/"))
    unique = keep_first(rows, ["domain", "path"], F.col("pos"))

    return top_per_group(unique, ["domain"], [F.col("pos")], limit)


def merge_guide_pages(pages: Column, extra: Column, language: Column, limit: int = 20) -> Column:
    """Add a guide's pages to a page map up to the limit; existing pages stay as they are."""
    keys = F.array_except(F.map_keys(extra), F.map_keys(pages))
    room = F.greatest(F.lit(limit) - F.size(pages), F.lit(0))
    chosen = F.slice(keys, F.lit(1), room)
    merged = F.map_concat(pages, F.map_filter(extra, lambda k, _: F.array_contains(chosen, k)))
    foreign = language.isNotNull() & (language != "en")
    return F.when(extra.isNull() | foreign, pages).otherwise(merged)


# --- calendars ------------------------------------------------------------------------------


def calendar_links(html: Column, page_url: Column, limit: int = 3) -> Column:
    """Calendar feeds a page links to."""
    tags = all_matches(html, r"""(?i)<link[^>]+type=["']text/calendar["'][^>]*>""")
    from_tags = F.array_compact(F.transform(tags, lambda t: first_group(t, r"""(?i)href=["']([^"']+)["']""")))
    hrefs = all_matches(
        html,
        r"""(?i)href=["']((?:webcal|https?)://[^"']+?\.ics(?:\?[^"']*)?|[^"':]+?\.ics(?:\?[^"']*)?|webcal://[^"']+)["']""", 1,
    )
    urls = F.transform(F.array_distinct(F.concat(from_tags, hrefs)), lambda u: resolve(F.regexp_replace(u, "(?i)^webcal:", "https:"), page_url))
    return F.slice(F.filter(urls, lambda u: u.startswith("https://")), 1, limit)


def _unescape(text: Column) -> Column:
    return collapse(F.regexp_replace(F.regexp_replace(text, r"(?i)\\n", " "), r"\\([,;\\])", "$1"))


#: The lines of a calendar event that are read; one pass over the event finds them all.
_EVENT_LINE = r"(?m)^(?:DTSTART|DTEND|SUMMARY|LOCATION|DESCRIPTION|URL|UID)(?:;[^:\r\n]*)?:[^\r\n]*"


def _field(lines: Column, name: str) -> tuple[Column, Column]:
    """Parameters and value of the first line with that name."""
    line = F.try_element_at(F.filter(lines, lambda x: x.startswith(f"{name}:") | x.startswith(f"{name};")), F.lit(1))
    return F.substring_index(line, ":", 1), F.substring(line, F.locate(":", line) + 1, F.length(line))


def calendar_time(params: Column, value: Column, zone: Column) -> Column:
    """Instant of a calendar date: UTC with ``Z``, else local to its own or the feed's zone."""
    pattern = r"^(\d{4})(\d{2})(\d{2})(?:T(\d{2})(\d{2})(?:\d{2})?(Z)?)?$"
    part = lambda g: F.regexp_extract(value, pattern, g)
    clock = F.when(part(4) != "", F.concat(part(4), F.lit(":"), part(5))).otherwise("00:00")
    text = F.concat_ws(" ", F.concat_ws("-", part(1), part(2), part(3)), clock)
    named = known_zone(F.coalesce(first_group(params, "(?i)TZID=([^;:]+)"), zone))
    wall = F.try_to_timestamp(text)
    return F.when(value.rlike(pattern), F.when(part(6) == "Z", wall).otherwise(F.to_utc_timestamp(wall, named)))


def calendar_events(feeds: DataFrame, as_of: Column, days: int = 120, limit: int = 100) -> DataFrame:
    """Upcoming events of calendar feeds: ``feeds`` has (feed_url, body).

    Folded lines are joined, then every event block is one array element of its feed. A
    row of ``feeds`` gives its first ``limit`` upcoming events (0: all); only start and
    name are read before that cut, which is made inside the row.
    """

    flat = F.regexp_replace("body", r"\r?\n[ \t]", "")
    blocks = all_matches(F.col("_flat"), r"(?s)BEGIN:VEVENT\r?\n(.*?)END:VEVENT", 1)
    staged = settle(
        settle(feeds, flat.alias("_flat"), keep=["feed_url"]),
        F.trim(first_group(F.col("_flat"), r"(?m)^X-WR-TIMEZONE:([^\r\n]+)")).alias("_zone"),
        F.transform(blocks, lambda e, i: F.struct(i.alias("pos"), all_matches(e, _EVENT_LINE).alias("lines"))).alias("_events"),
        keep=["feed_url"],
    )
    text = lambda e, name, n: F.substring(_unescape(_field(e["lines"], name)[1]), 1, n)
    when = lambda e, name: calendar_time(*_field(e["lines"], name), F.col("_zone"))
    begun = F.transform(
        "_events", lambda e: F.struct(e.alias("e"), when(e, "DTSTART").alias("start"), text(e, "SUMMARY", 200).alias("name"))
    )
    earliest, latest = as_of - F.make_dt_interval(hours=F.lit(3)), as_of + F.make_dt_interval(days=F.lit(days))
    cancelled = "(?i)^(?:cancelled|canceled|aflyst)"
    upcoming = F.filter(begun, lambda b: b["start"].between(earliest, latest) & (b["name"] != "") & ~b["name"].rlike(cancelled))
    rows = staged.select("feed_url", "_zone", F.explode(F.slice(upcoming, 1, limit) if limit else upcoming).alias("_b"))
    e = F.col("_b.e")
    read = settle(
        rows, _field(e["lines"], "URL")[1].alias("_url"), _field(e["lines"], "UID")[1].alias("_uid"), when(e, "DTEND").alias("end_date"),
        text(e, "LOCATION", 200).alias("venue"), text(e, "DESCRIPTION", 400).alias("description"),
    )
    anchor = F.replace(F.url_encode(F.coalesce("_uid", F.col("_b.name"))), F.lit("+"), F.lit("%20"))
    url = F.when(F.col("_url").rlike("^https?://"), F.col("_url")).otherwise(F.concat("feed_url", F.lit("#"), anchor))
    return read.select(
        "feed_url", F.col("_b.e.pos").alias("pos"), F.col("_b.start").alias("start_date"), "end_date", F.col("_b.name").alias("name"),
        "venue", "description", url.alias("url"),
    )


# --- places of a map ------------------------------------------------------------------------

#: Local city names and their English form.
CITY_NAMES = {
    "københavn": "Copenhagen", "kobenhavn": "Copenhagen", "münchen": "Munich", "köln": "Cologne", "wien": "Vienna", "praha": "Prague",
    "roma": "Rome", "milano": "Milan", "firenze": "Florence", "lisboa": "Lisbon", "warszawa": "Warsaw", "kraków": "Krakow",
    "göteborg": "Gothenburg", "bruxelles": "Brussels", "brussel": "Brussels", "antwerpen": "Antwerp", "genève": "Geneva",
    "zürich": "Zurich", "αθήνα": "Athens", "athína": "Athens", "montréal": "Montreal", "den haag": "The Hague", "sevilla": "Seville",
    "napoli": "Naples", "torino": "Turin", "venezia": "Venice",
}
#: Tags of venues and the order in which tags name a kind of place.
VENUE_TAGS = (
    "^(?:theatre|cinema|arts_centre|music_venue|nightclub|concert_hall|events_venue|community_centre|stadium|museum|gallery"
    "|comedy_club|jazz_club|social_centre)$"
)
KIND_TAGS = ("shop", "amenity", "craft", "healthcare", "office", "tourism", "leisure")


def city_name(city: Column, fallback: Column) -> Column:
    """City without its postal district, under its English name."""
    base = strip_blank(F.regexp_replace(strip_blank(city), r"(?i)\s+(?:K|V|Ø|N|S|NV|SV|C|\d{1,2}(?:\.|e|er)?(?: arr\.?)?)$", ""))
    return F.when(F.coalesce(city, F.lit("")) == "", fallback).otherwise(F.coalesce(lookup(CITY_NAMES, F.lower(base)), base))


def place_features(tags: Column) -> Column:
    """What a place offers, from its tags."""
    tag = lambda k: F.coalesce(F.try_element_at(tags, F.lit(k)), F.lit(""))
    some = lambda k: tag(k).isin("yes", "only", "limited")
    rules = [
        (some("diet:vegan"), "vegan"), (some("diet:vegetarian") | some("diet:vegan"), "vegetarian"), (some("diet:gluten_free"), "gluten_free"),
        (tag("wheelchair") == "yes", "wheelchair"), (tag("outdoor_seating") == "yes", "outdoor_seating"),
        (tag("internet_access").isin("yes", "wlan", "wifi", "free"), "wifi"), (tag("dog").isin("yes", "leashed"), "dogs"),
        ((tag("changing_table") == "yes") | (tag("kids_area") == "yes") | (tag("kids_area:indoor") == "yes"), "kids"),
    ]
    return F.array_compact(F.array(*[F.when(test, F.lit(name)) for test, name in rules]))


def places(elements: DataFrame) -> DataFrame:
    """Map elements to businesses with their own website.

    ``elements`` has (pos, tags map, lat, lon, center, city, country). Closed places,
    platform hosts and places without a name or website are left out.
    """
    tag = lambda k: F.try_element_at("tags", F.lit(k))
    website = F.coalesce(tag("website"), tag("contact:website"), tag("url"))
    full = F.when(website.rlike("(?i)^https?://"), website).otherwise(F.concat(F.lit("https://"), website))
    closed = (
        (F.coalesce(tag("shop"), F.lit("")) == "vacant")
        | (F.coalesce(tag("amenity"), F.lit("")) == "vacant")
        | F.exists(F.map_keys("tags"), lambda k: k.rlike("^(?:disused|abandoned|was|demolished|removed):"))
    )
    one = lambda a, b: F.trim(F.split(F.coalesce(tag(a), tag(b)), ";")[0])
    kind = F.coalesce(*[F.when(tag(k) != "yes", F.replace(tag(k), F.lit("_"), F.lit(" "))) for k in KIND_TAGS], F.lit("business"))
    stars = F.when(tag("stars").rlike(r"^[1-5](?:\.5)?S?$"), F.regexp_replace(tag("stars"), "S$", "").try_cast("double"))
    staged = elements.where(website.isNotNull() & tag("name").isNotNull() & ~closed).withColumn("_url", full)
    domain = without_www(host_of(F.col("_url")))
    return staged.where(is_own_website(domain)).select(
        "pos",
        domain.alias("domain"),
        trimmed_path(F.col("_url")).alias("path"),
        kind.alias("type"),
        tag("name").alias("name"),
        F.coalesce(F.coalesce(tag("amenity"), tag("leisure"), tag("tourism")).rlike(VENUE_TAGS), F.lit(False)).alias("venue"),
        one("phone", "contact:phone").alias("telephone"),
        one("email", "contact:email").alias("email"),
        blank_to_null(F.concat_ws(" ", tag("addr:street"), tag("addr:housenumber"))).alias("street"),
        city_name(tag("addr:city"), F.col("city")).alias("city"),
        tag("addr:postcode").alias("postcode"),
        F.upper(F.coalesce(tag("addr:country"), F.col("country"))).alias("country"),
        F.coalesce("lat", F.col("center.lat")).alias("lat"),
        F.coalesce("lon", F.col("center.lon")).alias("lon"),
        H.parse_map_hours(tag("opening_hours")).alias("opening_hours"),
        place_features(F.col("tags")).alias("features"),
        stars.alias("stars"),
    )


def local_places(found: DataFrame, max_branches: int = 2) -> DataFrame:
    """One place per domain, chains left out: the last root page, else the first place.

    Both the pick and the branch count come from one map-side combined aggregate.
    """
    root = F.col("path") == "/"
    picked = keep_last(found, ["domain"], root, F.when(root, F.col("pos")).otherwise(-F.col("pos")), count_as="_branches")
    return picked.where(F.col("_branches") <= max_branches).drop("_branches")


def place_record(place: DataFrame) -> DataFrame:
    """A site record from map data alone, for websites that cannot be read."""
    where = F.concat_ws(", ", "street", "city")
    spot = F.when(where != "", F.concat(F.lit(" at "), where)).otherwise("")
    hours = F.when(F.size("opening_hours") > 0, " Opening hours are listed.").otherwise("")
    action = lambda test, id_: F.when(test, F.lit(id_))
    return place.select(
        "domain",
        "name",
        F.concat("name", F.lit(" is a "), "type", spot, F.lit("."), hours).alias("content"),
        F.array_compact(
            F.array(
                F.lit("visit"), action(F.col("telephone").isNotNull(), "call"), action(F.col("email").isNotNull(), "contact"),
                action(F.col("lat").isNotNull() & F.col("lon").isNotNull(), "directions"),
            )
        ).alias("actions"),
    )


def prefer_fields(own: DataFrame, other: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """Field-by-field precedence: ``own`` where it says something, else ``other``."""
    second = other.select(key, *[F.col(f).alias(f"_{f}") for f in fields])
    joined = own.select(key, *fields).join(second, key, "full")
    return joined.select(key, *[F.coalesce(f, f"_{f}").alias(f) for f in fields])


# --- listings -------------------------------------------------------------------------------


def listing_cards(pages: DataFrame, source: str, marker: str, fields: dict[str, str]) -> DataFrame:
    """Cards of a listing page: split on a marker, then one pattern per field.

    ``pages`` has (url, html); every field is the first group of its pattern, decoded.
    """
    cards = F.split("html", marker)
    rows = pages.select("url", F.posexplode(F.slice(cards, F.lit(2), F.greatest(F.size(cards) - 1, F.lit(0)))).alias("pos", "_card"))
    read = lambda pattern: blank_to_null(collapse(decode_feed(drop_tags(F.regexp_extract("_card", f"(?s){pattern}", 1)))))
    return rows.select(F.lit(source).alias("source"), "url", "pos", *[read(p).alias(name) for name, p in fields.items()])


def card_events(cards: DataFrame, zone: str, as_of: Column, default_clock: str = "20:00", venue: str | None = None,
                city: str = "", country: str = "", currency: str | None = None) -> DataFrame:
    """Typed events of listing cards with the text fields day, month, year and clock.

    Cards carry ``link``, ``title``, ``day``, ``month``; ``year``, ``clock``, ``hall``
    and ``price`` may be missing. Dates without a year mean the next such date.
    """
    have = set(cards.columns)
    optional = lambda name: F.col(name) if name in have else F.lit(None).cast("string")
    spoken = optional("clock")
    clock = F.coalesce(clock_24(spoken), F.replace(first_group(spoken, r"(\d{1,2}[:.]\d{2})"), F.lit("."), F.lit(":")), F.lit(default_clock))
    month, day = month_number(F.col("month")), F.col("day").try_cast("int")
    fixed = wall_time(optional("year").try_cast("int"), month, day, clock, F.lit(zone))
    start = F.coalesce(fixed, next_date(month, day, clock, F.lit(zone), as_of))
    price = F.regexp_replace(optional("price"), "[^0-9.]", "").try_cast("double")
    staged = settle(
        fence(cards).where(F.col("link").isNotNull() & F.col("title").isNotNull() & month.isNotNull()),
        resolve(F.col("link"), F.col("url")).alias("event_url"),
        clean_listing_title(F.col("title")).alias("name"),
        start.alias("start_date"),
        F.coalesce(optional("hall"), F.lit(venue)).alias("venue"),
        F.lit(city).alias("city"),
        F.lit(country).alias("country"),
        F.when(price > 0, price).alias("price"),
        F.when(price > 0, F.lit(currency)).alias("currency"),
        keep=["source", "pos"],
    )
    upcoming = F.col("start_date") > as_of - F.make_dt_interval(hours=F.lit(6))
    return keep_first(staged.where(upcoming & ~is_cancelled(F.col("name"))), ["event_url", "start_date"], F.col("pos"))


def clean_listing_title(title: Column) -> Column:
    """Title with its sold-out prefix in one form."""
    return strip_blank(F.regexp_replace(title, r"(?i)^SOLD OUT\s*[|:-]\s*", "SOLD OUT: "))


def is_cancelled(title: Column) -> Column:
    """The title says the event is off."""
    return title.rlike("(?i)^(?:cancelled|canceled|aflyst|postponed)")


def listing_json(feeds: DataFrame, source: str, items: str, fields: dict[str, str]) -> DataFrame:
    """Rows of a JSON listing: the array at ``items``, one path per field.

    A path may offer alternatives separated by ``|``; the first that exists counts.
    """
    rows = feeds.select("url", F.posexplode(list_at(F.try_parse_json("body"), items)).alias("pos", "_item"))
    read = lambda paths: F.coalesce(*[blank_to_null(scalar_at(F.col("_item"), p)) for p in paths.split("|")])
    return rows.select(F.lit(source).alias("source"), "url", "pos", *[read(p).alias(name) for name, p in fields.items()])


def json_events(rows: DataFrame, as_of: Column, zone: str = "UTC", venue: str | None = None, city: str | None = None,
                country: str | None = None, currency: str | None = None) -> DataFrame:
    """Typed events of JSON listing rows (link, title, start and optional fields).

    ``start`` is ISO text (local to ``zone`` without an offset) or epoch milliseconds.
    """
    have = set(rows.columns)
    optional = lambda name, default: F.coalesce(F.col(name), F.lit(default)) if name in have else F.lit(default)
    epoch = F.when(F.col("start").rlike(r"^\d{11,}$"), F.timestamp_millis(F.col("start").try_cast("bigint")))
    start = F.coalesce(epoch, to_utc(F.col("start"), F.lit(zone)))
    price = F.regexp_replace(optional("price", None), "[^0-9.]", "").try_cast("double")
    off = F.coalesce(optional("state", None).rlike("(?i)cancel|postpone|aflyst|occurred"), F.lit(False))
    staged = settle(
        fence(rows).where(F.col("link").isNotNull() & F.col("title").isNotNull() & ~off),
        resolve(F.col("link"), F.col("url")).alias("event_url"),
        clean_listing_title(collapse(decode_feed(drop_tags(F.col("title"))))).alias("name"),
        start.alias("start_date"),
        decode_feed(optional("venue", venue)).alias("venue"),
        optional("city", city).alias("city"),
        optional("country", country).alias("country"),
        F.when(price > 0, price).alias("price"),
        F.when(price > 0, optional("currency", currency)).alias("currency"),
        keep=["source", "pos"],
    )
    upcoming = F.col("start_date") > as_of - F.make_dt_interval(hours=F.lit(6))
    return keep_first(staged.where(upcoming), ["event_url", "start_date"], F.col("pos"))


#: Fields that a reader may name. JSON readers give paths, card readers patterns whose first group counts.
LISTING_FIELDS = ("link", "title", "start", "day", "month", "year", "clock", "venue", "city", "country", "price", "currency", "state")
#: A reader is a row: which source, how its body is cut into items, where each field stands, what holds by default.
#: ``wrapper`` is a pattern whose first group holds the JSON of a page; ``items`` is a path to
#: an array (kind ``json``) or the pattern between two cards (kind ``cards``).
READER = (
    "source string, kind string, wrapper string, items string, fields map<string,array<string>>, "
    "zone string, default_clock string, place struct<venue:string,city:string,country:string,currency:string>"
)


def read_listings(feeds: DataFrame, readers: DataFrame) -> DataFrame:
    """Items of listings in any format, each read by the reader row of its source.

    ``feeds`` has (source, url, body), ``readers`` the columns of :data:`READER`, one row per
    source. A new source is a new row: paths and patterns are data, so one plan reads all
    formats in one pass, without a branch or a Python call per source. Sources without a reader
    and bodies that can't be read give no rows; an item's missing fields are NULL, and of a
    field's alternatives the first that is there counts.
    """
    is_json = F.col("kind") == "json"
    joined = feeds.select("source", "url", "body").join(readers, "source")
    inner = F.when(F.col("wrapper").isNull(), F.col("body")).otherwise(F.call_function("regexp_extract", F.col("body"), F.col("wrapper"), F.lit(1)))
    listed = F.transform(F.try_variant_get(F.try_parse_json(inner), F.col("items"), "array<variant>"), lambda v: F.to_json(v))
    cards = F.split("body", F.col("items"))
    pieces = F.when(is_json, listed).otherwise(F.slice(cards, F.lit(2), F.greatest(F.size(cards) - 1, F.lit(0))))
    rows = joined.select("source", "url", "kind", "fields", "zone", "default_clock", "place", F.posexplode(pieces).alias("pos", "_piece"))
    rows = settle(rows, F.when(is_json, F.try_parse_json("_piece")).alias("_item"))

    def read(name: Column) -> Column:
        ways = F.coalesce(F.col("fields")[name], F.array().cast("array<string>"))
        by_path = F.transform(ways, lambda w: blank_to_null(F.try_variant_get("_item", w, "string")))
        by_pattern = F.transform(ways, lambda w: blank_to_null(collapse(decode_feed(drop_tags(F.call_function("regexp_extract", F.col("_piece"), w, F.lit(1)))))))
        return F.get(F.array_compact(F.when(is_json, by_path).otherwise(by_pattern)), F.lit(0))

    # One expression for all fields: its text handling stands in the plan once, not once a field.
    rows = settle(rows, F.transform(F.array(*[F.lit(name) for name in LISTING_FIELDS]), read).alias("_read"))
    return rows.select(
        "source", "url", "pos", "zone", "default_clock", "place", *[F.get("_read", F.lit(i)).alias(name) for i, name in enumerate(LISTING_FIELDS)]
    )


def listing_events(rows: DataFrame, as_of: Column) -> DataFrame:
    """Typed upcoming events of :func:`read_listings`, once per address and start.

    A start is epoch milliseconds, ISO text (``T`` or a blank before the time; local to the reader's zone without an offset) or a
    day and month in words; without a year the next such date is meant. Items that are called
    off, by their state or title, or have no link, title or date are left out.
    """
    zone = F.coalesce("zone", F.lit("UTC"))
    epoch = F.when(F.col("start").rlike(r"^\d{11,}$"), F.timestamp_millis(F.col("start").try_cast("bigint")))
    iso = F.regexp_replace("start", r"^(\d{4}-\d{2}-\d{2}) (\d)", "$1T$2")
    stated = F.when(~F.col("start").rlike(r"^\d{11,}$"), to_utc(iso, zone))
    spoken = F.replace(first_group(F.col("clock"), r"(\d{1,2}[:.]\d{2})"), F.lit("."), F.lit(":"))
    clock = F.coalesce(clock_24(F.col("clock")), spoken, "default_clock", F.lit("20:00"))
    month, day = month_number(F.col("month")), F.col("day").try_cast("int")
    in_words = F.when(
        F.col("month").isNotNull(),
        F.when(F.col("year").isNotNull(), wall_time(F.col("year").try_cast("int"), month, day, clock, zone)).otherwise(next_date(month, day, clock, zone, as_of)),
    )
    price = first_group(F.col("price"), r"(\d+(?:\.\d+)?)").try_cast("double")
    off = F.coalesce(F.col("state").rlike("(?i)cancel|postpone|aflyst|occurred"), F.lit(False)) | is_cancelled(F.col("title"))
    staged = settle(
        fence(rows.where(F.col("link").isNotNull() & F.col("title").isNotNull() & ~off)),
        resolve(F.col("link"), F.col("url")).alias("event_url"),
        clean_listing_title(collapse(decode_feed(drop_tags(F.col("title"))))).alias("name"),
        F.coalesce(epoch, stated, in_words).alias("start_date"),
        F.coalesce(decode_feed(F.col("venue")), F.col("place.venue")).alias("venue"),
        F.coalesce("city", F.col("place.city")).alias("city"),
        F.coalesce("country", F.col("place.country")).alias("country"),
        F.when(price > 0, price).alias("price"),
        F.when(price > 0, F.coalesce("currency", F.col("place.currency"))).alias("currency"),
        keep=["source", "pos"],
    )
    upcoming = F.col("start_date") > as_of - F.make_dt_interval(hours=F.lit(6))
    return keep_first(staged.where(upcoming), ["event_url", "start_date"], F.col("source"), F.col("pos"))


def with_default_place(events: DataFrame, city: str, country: str, low_postcodes: dict[str, int] | None = None) -> DataFrame:
    """Fill missing city, country and venue of generic listings.

    ``low_postcodes`` names cities for all postcodes below a number.
    """
    town = F.col("city")
    if low_postcodes and "postcode" in events.columns:
        for name, below in low_postcodes.items():
            town = F.when(F.col("postcode").try_cast("int") < below, name).otherwise(town)
    return (
        events.withColumn("city", F.coalesce(town, F.lit(city)))
        .withColumn("country", F.coalesce("country", F.lit(country)))
        .withColumn("venue", F.coalesce("venue", without_www(host_of(F.col("event_url")))))
    )


def savable_events(events: DataFrame, as_of: Column, library_days: int = 42, other_days: int = 183) -> DataFrame:
    """Events near enough to keep: libraries six weeks ahead, others half a year.

    Events without a readable date pass.
    """
    ahead = F.when(F.coalesce(F.col("description"), F.lit("")).rlike("(?i)library"), library_days).otherwise(other_days)
    return events.where(F.col("start_date").isNull() | (F.col("start_date") < as_of + F.make_dt_interval(days=ahead)))


# --- genres ---------------------------------------------------------------------------------

#: Broad music families, and words that mark an event as music.
GENRE_FAMILIES = {
    "metal": words("metal|metalcore|deathcore|grindcore|doom|thrash|djent"),
    "punk": words("punk|hardcore|emo|post-hardcore"),
    "rock": words("rock|grunge|shoegaze|post-rock|garage"),
    "indie": words("indie"),
    "pop": words("pop|k-pop|synth-pop|dance-pop|teen pop"),
    "hip hop": words("hip[- ]?hop|rap|trap|drill|grime"),
    "soul": words("soul|r&b|rhythm and blues|funk|neo soul|gospel"),
    "electronic": words("electronic|techno|house music|deep house|tech house|acid house|edm|trance|dubstep|drum and bass|drum & bass|dnb|ambient|electronica|dj[- ]?set|club night|rave"),
    "jazz": words("jazz|bebop|swing|big band|jazzkoncert"),
    "blues": words("blues"),
    "classical": words("classical|klassisk|symphon(?:y|ic)|symfoni|orchestra|orkester|opera|chamber music|kammermusik|baroque|barok|choir|kor|pianist|string quartet|strygekvartet"),
    "folk": words("folk|singer-songwriter|americana|bluegrass|visesang"),
    "country": words("country"),
    "reggae": words("reggae|dancehall|ska|dub"),
    "latin": words("latin|salsa|reggaeton|bachata|cumbia|flamenco|tango"),
    "world": words("afrobeats?|world music|balkan|klezmer"),
}
MUSIC_WORDS = words(
    "concerts?|koncert(?:er)?|konsert(?:er)?|konzert(?:e)?|live music|livemusik|gig|tour|band|dj|orchestra|orkester|symphony"
    "|symfoni|jazz|quartet|kvartet|choir|kor|album release|release party|in concert|live"
)
#: Kinds of library events in Danish, Norwegian and Swedish.
LIBRARY_KINDS = {
    "kids family": "(?iu)b(?:ø|o)rn|famil|fortelling|eventyr|baby|barn|saga|bäbis",
    "music concert": "(?iu)musik|koncert|konsert|musikk",
    "film": "(?iu)film",
    "talk": "(?iu)foredrag|debat|samtale|föredrag|samtal",
    "workshop": "(?iu)v(?:æ|ae)rksted|workshop|kreativ|verksted|verkstad|pyssel",
    "exhibition": "(?iu)udstilling|utstilling|utställning",
    "books reading": "(?iu)litteratur|l(?:æ|ae)sning|forfatter|bog|bokcirkel|läs|författar",
    "theatre": "(?iu)teater",
    "games": "(?iu)spil|spill|spel|gaming",
    "walk": "(?iu)tur|vandring",
    "language": "(?iu)sprog|språk|language",
    "crafts": "(?iu)strik|h(?:å|aa)ndarbejde",
}


def looks_like_music(event: DataFrame) -> DataFrame:
    """Events that look like music and have no genre yet."""
    text = F.concat_ws(" ", "name", "description", "venue")
    return event.where(text.rlike(MUSIC_WORDS) & ~F.coalesce("description", F.lit("")).contains("Genre: "))


def artist_of(name: Column) -> Column:
    """Artist from an event title: before support acts, dashes, colons and brackets."""
    text = F.regexp_replace(name, r"(?i)^(?:sold out|udsolgt|cancelled|aflyst|new date|nyt tidspunkt|postponed)\s*[:|-]\s*", "")
    head = F.split(text, r"(?i)\s+(?:with|w/|feat\.?|ft\.?|featuring|support:?|\+|&|og|x|vs\.?|presents)\s+|\s+[–—|-]\s+|:\s+|\s*\(")[0]
    return F.trim(F.regexp_replace(head, "[\"“”]", ""))


def add_genres(events: DataFrame, earlier: DataFrame, entities: DataFrame) -> DataFrame:
    """Compose ``Genre: …`` lines.

    ``earlier`` holds described events of former runs (url, description), ``entities``
    (label, genres array) what a knowledge base says about artists by exact name.
    """
    known = keep_first(
        earlier.select("url", first_group(F.col("description"), r"Genre: ([^.]+)\.").alias("_known")).where(F.col("_known").isNotNull()),
        ["url"], F.col("_known"),
    )
    labels = keep_first(entities.select(F.lower("label").alias("_artist"), F.slice("genres", 1, 3).alias("_names")), ["_artist"], F.col("_names"))
    artist = artist_of(F.col("name"))
    usable = F.when(F.length(artist).between(2, 60), F.lower(artist))
    joined = join_hot_left(events.withColumn("_artist", usable), labels, "_artist", F.col("url")).join(known, "url", "left")
    families = labels_of(
        F.when(F.size("_names") > 0, F.array_join("_names", " ")).otherwise(F.concat_ws(" ", "name", "description")), GENRE_FAMILIES
    )

    def line(fam: Column) -> Column:
        list_ = F.array_join(fam, ", ")
        from_names = F.concat(F.array_join("_names", ", "), F.when(F.size(fam) > 0, F.concat(F.lit(" ("), list_, F.lit(")"))).otherwise(""))
        return F.when(F.size("_names") > 0, from_names).when(F.size(fam) > 0, list_)

    genre = F.coalesce("_known", let(families, line))
    already = F.coalesce("description", F.lit("")).contains("Genre: ")
    described = F.trim(F.concat(F.trim(F.coalesce("description", F.lit(""))), F.lit(" Genre: "), genre, F.lit(".")))
    return joined.withColumn("description", F.when(already | genre.isNull(), F.col("description")).otherwise(described)).select(*events.columns)


def host_and_parents(host: Column, itself: bool = True) -> Column:
    """A host's suffixes at its dots, with or without the host itself."""
    labels = F.split(host, r"\.")
    first = 1 if itself else 2
    cuts = F.filter(F.sequence(F.lit(1), F.size(labels)), lambda i: i >= first)
    return F.transform(cuts, lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def match_websites(names: DataFrame, entities: DataFrame) -> DataFrame:
    """Named places to entities: exact label, and the entity's website is the place's host.

    Hosts agree if they are equal or one lies below the other. Each way round is an equi-join on
    (label, host): one side's host against the other's host and parents. A label that a third of
    both sides bear ("Cafe") pairs nothing by itself. Repeated rows meet once: both sides are made
    distinct by a map-side combined aggregate first.
    """
    left = names.select("name", F.lower("name").alias("_label"), "domain", without_www(F.col("domain")).alias("_host")).distinct()
    right = entities.select(F.lower("label").alias("_label"), "entity", without_www(host_of(F.col("website"))).alias("_host")).distinct()
    left, right = (side.where(F.col("_label").isNotNull() & F.col("_host").isNotNull()) for side in (left, right))
    above = right.select("_label", "entity", F.explode(host_and_parents(F.col("_host"))).alias("_host"))
    below = left.select("_label", "name", "domain", F.explode(host_and_parents(F.col("_host"), itself=False)).alias("_host"))
    found = left.join(above, ["_label", "_host"]).unionByName(below.join(right, ["_label", "_host"]))
    return found.select("name", without_www(F.col("domain")).alias("domain"), "entity").distinct()


def library_kinds(text: Column) -> Column:
    """English kind words of a library event."""
    return labels_of(text, LIBRARY_KINDS)


def own_document_valid(document: Column, domain: Column) -> Column:
    """A site's own document has an action list, pages, and names its own domain."""
    pages = at(document, "pages")
    stated = text_at(document, "domain")
    host = without_www(F.split(F.regexp_replace(stated, "^https?://", ""), "/")[0])
    page_map = at(document, "pages", "map<string,variant>")
    return F.coalesce(
        F.schema_of_variant(at(document, "actions")).startswith("ARRAY")
        & F.schema_of_variant(pages).startswith("OBJECT")
        & (F.size(F.map_keys(page_map)) > 0)
        & (stated.isNull() | (stated == "") | (host == without_www(domain))),
        F.lit(False),
    )


def document_problem(status: Column, body: Column) -> Column:
    """What is wrong with a site's own document, in plain words; NULL when it is fine."""
    doc = F.try_parse_json(body)

    def judge(d: Column) -> Column:
        kind = F.schema_of_variant(d)
        return (
            F.when(status.isNull(), "it could not be reached")
            .when(~status.between(200, 299), F.concat(F.lit("it answers with an error (HTTP "), status.cast("string"), F.lit(")")))
            .when(d.isNull(), "it is not valid JSON")
            .when(~kind.startswith("OBJECT"), "it is not a JSON object")
            .when(F.coalesce(scalar_at(d, "name"), F.lit("")) == "", "the name is missing")
            .when(~F.coalesce(F.schema_of_variant(at(d, "actions")).startswith("ARRAY"), F.lit(False)), "the list of actions is missing")
        )

    return let(doc, judge)


def english_overlay(pages: Column, english: Column, language: Column) -> Column:
    """Pages with their English translation laid over the original."""
    overlaid = F.map_concat(F.map_filter(pages, lambda k, _: ~F.map_contains_key(english, k)), english)
    return F.when((language != "en") & english.isNotNull(), overlaid).otherwise(pages)


