"""Shop feeds, prices in euro, price changes and shipping countries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hostloom.functions.patterns import blank_to_null, let, words
from hostloom.functions.text import drop_elements, drop_tags
from hostloom.operators.keyed import keep_first, settle, top_per_group
from hostloom.operators.structured import at, first_at, list_at, number_at, scalar_at, text_at

#: Names of size and colour options in shop languages.
SIZE_NAMES = "(?iu)^(?:size|sizes|størrelse|str|größe|grösse|taille|talla|storlek|koko|maat|taglia|shoe size|eu size)$"
COLOUR_NAMES = "(?iu)^(?:colou?rs?|farve|farbe|couleur|färg|väri|kleur|colore)$"
GTIN = r"^\d{8,14}$"


def _gtin(text: Column) -> Column:
    return F.when(F.trim(text).rlike(GTIN), F.trim(text))


def _distinct_texts(values: Column, limit: int = 40) -> Column:
    found = F.array_distinct(F.filter(values, lambda v: F.coalesce(v, F.lit("")) != ""))
    return let(F.slice(found, 1, limit), lambda f: F.when(F.size(f) > 0, f))


def feed_items(feeds: DataFrame) -> DataFrame:
    """Products of shop feeds in either of the two feed dialects.

    ``feeds`` has (domain, currency, body). A body with a ``products`` array is the
    first dialect (``currency`` comes with the shop), an array of products with minor
    units is the second. Rows without a name or link are left out.
    """
    parsed = settle(
        feeds.select("domain", F.col("currency").alias("_shop_currency"), "body"), F.try_parse_json("body").alias("_j"), keep=["domain", "_shop_currency"]
    )
    lists = settle(
        parsed, at(F.col("_j"), "products", "array<variant>").alias("_products"), F.try_variant_get("_j", "$", "array<variant>").alias("_list"),
        keep=["domain", "_shop_currency"],
    )
    rows = lists.select(
        "domain",
        "_shop_currency",
        F.col("_products").isNotNull().alias("_first"),
        F.explode(F.coalesce("_products", "_list")).alias("p"),
    )
    kept = ["domain", "_shop_currency", "_first", "p"]
    listed = settle(rows, F.when(F.col("_first"), list_at(F.col("p"), "variants")).alias("_variants"))
    stocked = settle(
        listed,
        F.try_element_at("_variants", F.lit(1)).alias("_head"),
        F.filter("_variants", lambda v: F.coalesce(at(v, "available", "boolean"), F.lit(True))).alias("_in_stock"),
        keep=kept,
    )
    optioned = settle(
        stocked,
        F.when(F.col("_first"), _option(F.col("p"), SIZE_NAMES, F.col("_in_stock"))).alias("_sizes"),
        F.when(F.col("_first"), _option(F.col("p"), COLOUR_NAMES, F.col("_in_stock"))).alias("_colours"),
    )
    p = F.col("p")
    item = F.when(F.col("_first"), F.struct(*_first_dialect(p))).otherwise(F.struct(*_second_dialect(p)))
    return (
        settle(optioned, item.alias("_item"), keep=["domain"]).select("domain", "_item.*")
        .where((F.coalesce("name", F.lit("")) != "") & F.col("url").isNotNull())
    )


def _option(p: Column, names: str, in_stock: Column) -> Column:
    """In-stock (value, id) pairs of an option."""
    option = F.try_element_at(F.filter(list_at(p, "options"), lambda o: F.trim(text_at(o, "name")).rlike(names)), F.lit(1))
    place = F.transform(F.array(option), lambda o: F.when(o.isNotNull(), F.coalesce(number_at(o, "position").cast("int"), F.lit(1))))
    value = lambda v, n: F.trim(F.when(n == 1, scalar_at(v, "option1")).when(n == 2, scalar_at(v, "option2")).when(n == 3, scalar_at(v, "option3")))
    pairs = lambda n: F.transform(in_stock, lambda v: F.struct(value(v, n).alias("value"), scalar_at(v, "id").alias("id")))
    return F.filter(F.element_at(F.transform(place, pairs), 1), lambda x: F.coalesce(x["value"], F.lit("")) != "")


def _first_dialect(p: Column) -> list[Column]:
    head, in_stock, sizes = F.col("_head"), F.col("_in_stock"), F.col("_sizes")
    firsts = F.filter(sizes, lambda x, i: x["id"].isNotNull() & ~F.exists(F.slice(sizes, 1, i), lambda e: e["value"] == x["value"]))
    return [
        F.concat(F.lit("https://"), F.col("domain"), F.lit("/products/"), text_at(p, "handle")).alias("url"),
        F.substring(F.coalesce(scalar_at(p, "title"), F.lit("")), 1, 200).alias("name"),
        number_at(head, "price").alias("price"),
        F.col("_shop_currency").alias("currency"),
        text_at(first_at(p, "images"), "src").alias("image"),
        (F.size(in_stock) > 0).alias("available"),
        _gtin(scalar_at(head, "barcode")).alias("gtin"),
        scalar_at(head, "id").alias("variant_id"),
        _distinct_texts(F.transform(sizes, lambda x: x["value"])).alias("sizes"),
        _distinct_texts(F.transform("_colours", lambda x: x["value"])).alias("colours"),
        let(firsts, lambda f: F.when(F.size(f) > 0, F.map_from_entries(f))).alias("size_variants"),
        F.lit("products").alias("source"),
    ]


def _second_dialect(p: Column) -> list[Column]:
    minor = F.coalesce(number_at(p, "prices.currency_minor_unit"), F.lit(2.0))
    terms = lambda names: _distinct_texts(
        F.flatten(
            F.transform(
                F.filter(list_at(p, "attributes"), lambda a: F.trim(text_at(a, "name")).rlike(names)),
                lambda a: F.transform(list_at(a, "terms"), lambda t: F.trim(scalar_at(t, "name"))),
            )
        )
    )
    return [
        blank_to_null(text_at(p, "permalink")).alias("url"),
        F.substring(drop_tags(F.coalesce(scalar_at(p, "name"), F.lit("")), ""), 1, 200).alias("name"),
        (number_at(p, "prices.price") / F.pow(F.lit(10.0), minor)).alias("price"),
        text_at(p, "prices.currency_code").alias("currency"),
        text_at(first_at(p, "images"), "src").alias("image"),
        F.coalesce(at(p, "is_in_stock", "boolean"), F.lit(True)).alias("available"),
        _gtin(scalar_at(p, "sku")).alias("gtin"),
        F.lit(None).cast("string").alias("variant_id"),
        terms(SIZE_NAMES).alias("sizes"),
        terms(COLOUR_NAMES).alias("colours"),
        F.lit(None).cast("map<string,string>").alias("size_variants"),
        F.lit("store-api").alias("source"),
    ]


def with_euro(items: DataFrame, rates: DataFrame) -> DataFrame:
    """Add ``price_eur``. ``rates`` has one row per currency; EUR itself counts as 1."""
    table = rates.select(F.upper("currency").alias("_code"), F.col("rate").alias("_rate"))
    joined = items.withColumn("_code", F.upper("currency")).join(table, "_code", "left")
    rate = F.when(F.col("_code") == "EUR", F.lit(1.0)).otherwise(F.col("_rate"))
    euro = F.when(rate != 0, F.floor(F.col("price") / rate * 100 + 0.5) / 100)
    return joined.select(*items.columns, euro.alias("price_eur"))


def price_changes(items: DataFrame, stored: DataFrame, least: float = 0.01) -> DataFrame:
    """Feed items against stored prices: new, changed or unchanged.

    ``items`` should hold one row per url (see :func:`latest_offers`).
    """
    known = stored.select("url", F.col("price_eur").alias("previous_price_eur"), F.lit(True).alias("_known"))
    joined = items.join(known, "url", "left")
    moved = F.abs(F.col("previous_price_eur") - F.col("price_eur")) >= least
    label = F.when(F.col("_known").isNull(), "new").when(F.coalesce(moved, F.lit(False)), "changed").otherwise("unchanged")
    return joined.withColumn("change", label).drop("_known")


def history_rows(changes: DataFrame, observed_at: Column) -> DataFrame:
    """Rows to append to the price history: new and changed items that have a price."""
    return changes.where((F.col("change") != "unchanged") & F.col("price_eur").isNotNull()).select(
        "url", "price_eur", observed_at.alias("observed_at")
    )


def latest_offers(observations: DataFrame, before: Column | None = None) -> DataFrame:
    """Latest observation per url (a map-side combined aggregate)."""
    rows = observations if before is None else observations.where(F.col("observed_at") < before)
    order = [F.col("observed_at"), F.col("observation_id"), F.col("price_eur"), F.col("available")]
    ranked = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])
    return rows.groupBy("url").agg(F.max_by(F.struct("observed_at", "observation_id", "price_eur", "available"), ranked).alias("_r")).select("url", "_r.*")


def within_daily_cap(new_rows: DataFrame, day: str, order: Sequence[Column], cap: int, used: DataFrame | None = None) -> DataFrame:
    """First new rows of every day until the day's allowance is used up.

    The window is limited to ``cap`` rows before the shuffle; what earlier runs used
    of the allowance is taken off afterwards.
    """
    ranked = top_per_group(new_rows, [day], order, cap, rank_as="_place")
    if used is None:
        return ranked.drop("_place")
    spent = used.select(day, F.col("used").alias("_used"))
    joined = ranked.join(spent, day, "left")
    return joined.where(F.col("_place") <= F.lit(cap) - F.coalesce("_used", F.lit(0))).drop("_place", "_used")


def thin_history(history: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    """All observations of the last days, before that the last one per item and week."""
    recent = F.col("observed_at") >= as_of - F.make_dt_interval(days=F.lit(days))
    older = history.where(~recent).withColumn("_week", F.date_trunc("week", "observed_at"))
    order = [F.col(c) for c in ("observed_at", "observation_id", "price_eur", "available")]
    rank = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])
    weekly = older.groupBy("url", "_week").agg(F.max_by(F.struct(*history.columns), rank).alias("_r")).select("_r.*")
    return history.where(recent).unionByName(weekly.select(*history.columns))


# --- shipping countries ---------------------------------------------------------------------

#: Country names in shipping policies, and words for everywhere.
SHIP_TO = {
    "dk": "denmark|danmark|dänemark|danemark", "se": "sweden|sverige|schweden|suède", "no": "norway|norge|norwegen|norvège",
    "fi": "finland|suomi|finnland", "de": "germany|deutschland|tyskland|allemagne", "nl": "netherlands|nederland|holland|niederlande",
    "be": "belgium|belgië|belgique|belgien", "fr": "france|frankrig|frankreich", "es": "spain|españa|spanien|espagne",
    "it": "italy|italia|italien|italie", "pt": "portugal", "at": "austria|österreich|østrig", "ch": "switzerland|schweiz|suisse",
    "pl": "poland|polska|polen|pologne", "ie": "ireland|irland|irlande",
    "gb": "united kingdom|uk|great britain|england|storbritannien|großbritannien",
    "us": r"united states|usa|u\.s\.|us only|contiguous us|lower 48", "ca": "canada", "au": "australia", "nz": "new zealand", "jp": "japan",
}
EVERYWHERE = "worldwide|world-wide|internationally|all countries|verden over|weltweit|dans le monde entier"


def labels_of(text: Column, dictionary: dict[str, str]) -> Column:
    """Labels of a dictionary whose pattern occurs in the text, in dictionary order."""
    return F.array_compact(F.array(*[F.when(text.rlike(pattern), F.lit(label)) for label, pattern in dictionary.items()]))


def ships_to(html: Column, countries: dict[str, str] | None = None, everywhere: str = EVERYWHERE) -> Column:
    """Countries a shipping policy names, ``["*"]`` for worldwide, NULL when it names none."""
    named = {code: words(pattern) for code, pattern in (countries or SHIP_TO).items()}
    text = drop_tags(drop_elements(html, ("script", "style")))
    return let(
        text,
        lambda t: F.when(t.rlike(words(everywhere)), F.array(F.lit("*"))).otherwise(
            let(labels_of(t, named), lambda found: F.when(F.size(found) > 0, found))
        ),
    )


def seed_domains(seeds: DataFrame) -> DataFrame:
    """Seed lists ``{country: [domain, …], _about: text}`` as (country, domain) rows."""
    lists = seeds.select(F.explode(F.from_json("value", "map<string,string>")).alias("country", "_list"))
    domains = F.from_json("_list", "array<string>")
    named = lists.where(~F.col("country").startswith("_")).select("country", F.posexplode(domains).alias("pos", "domain"))
    return named.select("country", "pos", F.regexp_replace(F.lower(F.trim("domain")), r"^www\.", "").alias("domain"))


#: Brands whose product pages are wanted, and pages for children.
BRAND_PATHS = (
    "(?i)/(?:nike|hoka|brooks|asics|on|on-running|saucony|new-balance|adidas|ugg|birkenstock|crocs|converse|vans|dr-martens"
    "|the-north-face|patagonia|merrell|salomon|altra|timberland|teva|keen|allbirds|reebok|puma|mizuno|clarks|sorel|columbia)-"
)
CHILDREN_PATHS = r"(?i)(?:kids?|toddler|infant|baby|little-kid|big-kid|youth)\b|/brooks-brothers-"


def wanted_products(urls: DataFrame, product_path: str, all_brands: bool = False, brands: str = BRAND_PATHS) -> DataFrame:
    """Product pages of the wanted brands, without children's products."""
    path = F.regexp_replace(F.regexp_extract("url", r"^[a-z]+://[^/]*([^?#]*)", 1), "(?i)/(?:mens|womens|men|women|unisex)-", "/")
    test = F.col("url").rlike(product_path) & ~F.col("url").rlike(CHILDREN_PATHS)
    return urls.where(test if all_brands else test & path.rlike(brands))


def preferred_order(urls: DataFrame, prefer: str, run: str, k: int) -> DataFrame:
    """Preferred pages first, otherwise a repeatable shuffle; at most ``k`` per run."""
    order = [F.desc(F.col("url").rlike(prefer)), F.sha2(F.concat(F.lit(run), F.lit(" "), F.col("url")), 256), F.col("url")]
    return urls.select("url").distinct().orderBy(*order).limit(k)


def first_listing(items: DataFrame) -> DataFrame:
    """Items once per url, the first in feed order."""
    return keep_first(items, ["url"], F.col("pos"))
