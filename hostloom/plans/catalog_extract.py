"""Catalogue: structured data and feeds.

The given tables hold no JSON-LD or feeds, so every query first writes such documents
from table rows with Spark and then reads them back; the SQL states what must come out
straight from the table.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from hostloom.functions import hours as H
from hostloom.operators import feeds as X
from hostloom.operators import shops
from hostloom.operators import structured as J
from hostloom.operators.keyed import rule_table
from hostloom.plans.registry import query, shared
from hostloom.plans.roles import AS_OF, as_of, spread, table

_NOW = f"TIMESTAMP '{AS_OF}'"


def _script(json):
    return F.concat(F.lit('<script type="application/ld+json">'), json, F.lit("</script>"))


def _pick(key, values):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (key % len(values) + 1).cast("int"))


def _site(prefix, key):
    return F.concat(F.lit(prefix), key.cast("string"), F.lit(".example"))


# --- business -------------------------------------------------------------------------------


def _business_pages(spark, sf):
    k = F.col("c_custkey")
    spec = lambda days, opens, closes: F.struct(days.alias("dayOfWeek"), F.lit(opens).alias("opens"), F.lit(closes).alias("closes"))
    weekday = spec(F.array(F.lit("https://schema.org/Monday"), F.lit("Tuesday")), "9:00", "17:30:00")
    sunday = spec(F.array(F.lit("su")), "10:00", "14:00")
    holiday = F.struct(F.lit("2024-02-20").alias("validFrom"), F.lit("00:00").alias("opens"), F.lit("00:00").alias("closes"))
    address = F.struct(
        F.concat(F.lit("Street "), k.cast("string")).alias("streetAddress"), F.col("n_name").alias("addressLocality"),
        k.alias("postalCode"), F.struct(F.lit("Denmark").alias("name")).alias("addressCountry"),
    )
    rating = F.struct((k % 50 / 10.0).alias("ratingValue"), (k % 90).cast("string").alias("reviewCount"))
    full = F.struct(
        F.lit("Restaurant").alias("@type"), F.col("c_name").alias("name"), F.concat(F.lit("+45 "), k.cast("string")).alias("telephone"),
        address.alias("address"), F.array(weekday, sunday).alias("openingHoursSpecification"), F.array(holiday).alias("specialOpeningHoursSpecification"),
        rating.alias("aggregateRating"),
    )
    plain = F.struct(F.lit("Organization").alias("@type"), F.lit("Parent").alias("name"), F.lit("1").alias("telephone"))
    listed = F.struct(
        F.array(F.lit("Store"), F.lit("Thing")).alias("@type"), F.col("c_name").alias("name"), F.array(address).alias("address"),
        F.lit("Mo-Fr 08:00-16:00, Sa,Su 10:00-12:00").alias("openingHours"),
    )
    html = (
        F.when(k % 4 == 0, F.concat(_script(F.to_json(plain)), _script(F.to_json(full))))
        .when(k % 4 == 1, _script(F.to_json(F.struct(F.array(F.to_json(plain)).alias("x"), F.array(full).alias("@graph")))))
        .when(k % 4 == 2, _script(F.to_json(F.array(listed))))
        .otherwise(F.concat(_script(F.lit("{broken")), _script(F.to_json(plain))))
    )
    return (
        spread(spark, sf, "customer")
        .join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .select(k.alias("site_id"), F.concat(F.lit("<html><head>"), html, F.lit("</head><body>x</body></html>")).alias("html"))
    )


@query(
    "jsonld_business",
    """SELECT c_custkey AS site_id, CASE WHEN k < 2 THEN 'Restaurant' WHEN k = 2 THEN 'Store' ELSE 'Organization' END AS type,
         CASE WHEN k = 3 THEN 'Parent' ELSE c_name END AS name,
         CASE WHEN k < 2 THEN '+45 ' || c_custkey WHEN k = 3 THEN '1' END AS telephone,
         CASE WHEN k < 3 THEN 'Street ' || c_custkey || ', ' || n_name || ', ' || c_custkey || ', Denmark' END AS address,
         CASE WHEN k < 2 THEN 'Mo, Tu 09:00–17:30; Su 10:00–14:00' WHEN k = 2 THEN 'Mo, Tu, We, Th, Fr 08:00–16:00; Sa, Su 10:00–12:00' END AS hours,
         CASE WHEN k < 2 THEN '2024-02-20: closed' END AS special,
         CASE WHEN k < 2 AND c_custkey % 50 > 0 THEN round(c_custkey % 50 / 10.0, 1)::DOUBLE END AS rating,
         CASE WHEN k < 2 AND c_custkey % 50 > 0 AND c_custkey % 90 > 0 THEN (c_custkey % 90)::DOUBLE END AS reviews
       FROM (SELECT *, c_custkey % 4 AS k FROM customer JOIN nation ON c_nationkey = n_nationkey)""",
)
def jsonld_business(spark, sf):
    b = J.page_business(_business_pages(spark, sf), as_of())
    a = F.col("address")
    return b.select(
        "site_id", "type", "name", "telephone",
        F.when(a.isNotNull(), F.concat_ws(", ", a["street"], a["city"], a["postcode"], a["country"])).alias("address"),
        H.hours_line(F.col("opening_hours")).alias("hours"), H.special_line(F.col("special_hours")).alias("special"),
        F.col("rating.value").alias("rating"), F.col("rating.count").alias("reviews"),
    )


@query(
    "hours_accuracy",
    """SELECT outcome, count(*) AS places FROM (SELECT CASE WHEN c_custkey % 10 = 9 THEN 'failed' WHEN c_custkey % 4 = 3 THEN 'no hours'
         WHEN c_custkey % 4 < 2 THEN CASE WHEN c_custkey % 6 = 0 THEN 'differ' ELSE 'same' END ELSE 'differ' END AS outcome FROM customer) GROUP BY outcome""",
)
def hours_accuracy(spark, sf):
    from hostloom.operators.change import hours_outcomes

    pages = _business_pages(spark, sf).where(F.col("site_id") % 10 != 9)
    fresh = J.page_business(pages, as_of()).select(F.col("site_id").alias("domain"), F.col("opening_hours").alias("fresh_hours"))
    read = pages.select(F.col("site_id").alias("domain"))
    opened = H.parse_hours(F.when(F.col("site_id") % 6 == 0, "Mo 08:00-09:00").otherwise("Su 10:00-14:00; Tu,Mo 09:00-17:30"))
    stored = _business_pages(spark, sf).select(F.col("site_id").alias("domain"), opened.alias("opening_hours"))
    outcomes = hours_outcomes(stored, read, fresh)
    return outcomes.groupBy("outcome").agg(F.count(F.lit(1)).alias("places"))


@query(
    "page_ratings",
    """SELECT c_custkey AS site_id, CASE c_custkey % 4 WHEN 0 THEN 4.5::DOUBLE WHEN 1 THEN (c_custkey % 4 + 3.5)::DOUBLE ELSE 3.2 END AS value,
         CASE c_custkey % 4 WHEN 0 THEN (1000 + c_custkey % 900)::DOUBLE WHEN 1 THEN CASE WHEN c_custkey > 0 THEN c_custkey::DOUBLE END END AS count,
         CASE c_custkey % 4 WHEN 0 THEN 'microdata' WHEN 1 THEN 'google' ELSE 'trustpilot' END AS source
       FROM customer WHERE c_custkey % 4 < 3""",
)
def page_ratings(spark, sf):
    k = F.col("c_custkey")
    html = (
        F.when(
            k % 4 == 0,
            F.concat(F.lit('<b itemprop="ratingValue" content="4,5"></b><i itemprop="reviewCount">1,'), F.lpad((k % 900).cast("string"), 3, "0"), F.lit("</i>")),
        )
        .when(k % 4 == 1, F.concat(F.lit("<p>Rated 4.5/5 on Google from "), k.cast("string"), F.lit(" reviews</p>")))
        .when(k % 4 == 2, "<p>Trustpilot says <b>3,2</b> out of 5 for us</p>")
        .otherwise("<p>Version 4.8 is out</p>")
    )
    rated = spread(spark, sf, "customer").select(k.alias("site_id"), J.page_rating(html).alias("r")).where(F.col("r").isNotNull())
    return rated.select("site_id", "r.value", "r.count", "r.source")


@query(
    "closure_notices",
    """SELECT c_custkey AS site_id, CASE c_custkey % 5 WHEN 0 THEN 'We are closed until 3 March for shop ' || c_custkey || '.'
         WHEN 1 THEN 'See our christmas opening hours for shop ' || c_custkey || ' here.'
         WHEN 2 THEN 'We are closed on Sundays in shop ' || c_custkey || '.' ELSE 'Temporarily closed from May 2024 as it was in 2019.' END AS notice,
         c_custkey % 5 IN (0, 3) AS closed FROM customer WHERE c_custkey % 5 < 4""",
)
def closure_notices(spark, sf):
    k = F.col("c_custkey")
    key = k.cast("string")
    html = F.concat(
        F.lit("<p>Welcome to us.</p><script>closed until</script><p>"),
        F.when(k % 5 == 0, F.concat(F.lit("We are closed until 3&nbsp;March for shop "), key, F.lit(".")))
        .when(k % 5 == 1, F.concat(F.lit("See our christmas opening hours for shop "), key, F.lit(" here.")))
        .when(k % 5 == 2, F.concat(F.lit("We are closed on Sundays in shop "), key, F.lit(".")))
        .when(k % 5 == 3, "Temporarily closed from May 2024 as it was in 2019.")
        .otherwise("We reopened after we were temporarily closed in 2019."),
        F.lit(" </p><p>Bye then.</p>"),
    )
    found = spread(spark, sf, "customer").select(k.alias("site_id"), J.closure_notice(html, as_of()).alias("n")).where(F.col("n").isNotNull())
    return found.select("site_id", F.col("n.text").alias("notice"), "n.closed")


# --- events ---------------------------------------------------------------------------------


def _event_pages(spark, sf):
    k = F.col("o_orderkey")
    key = k.cast("string")
    day = F.date_format(as_of() + F.make_dt_interval(days=(k % 30 - 3).cast("int")), "yyyy-MM-dd")
    place = F.struct(
        F.concat(F.lit("Hall "), (k % 9).cast("string"), F.lit(" &amp; Bar")).alias("name"),
        F.struct(_pick(k, ["Copenhagen", "Boston"]).alias("addressLocality"), _pick(k, ["DK", "US"]).alias("addressCountry"),
                 F.when(k % 4 == 1, "CA").alias("addressRegion")).alias("address"),
    )
    event = F.struct(
        F.lit("MusicEvent").alias("@type"), F.concat(F.lit("Show &#8211; "), key).alias("name"),
        F.concat(day, F.when(k % 3 == 0, "T19:30:00").when(k % 3 == 1, "T19:30:00+02:00").otherwise("")).alias("startDate"),
        F.concat(F.lit("/e/"), key).alias("url"), place.alias("location"),
        F.array(F.struct(F.concat((k % 200).cast("string"), F.lit(",50")).alias("price"), F.lit("dkk").alias("priceCurrency"))).alias("offers"),
    )
    holder = F.struct(F.lit("Organization").alias("@type"), F.array(event).alias("event"))
    html = F.when(k % 2 == 0, _script(F.to_json(event))).otherwise(_script(F.to_json(holder)))
    return spread(spark, sf, "orders").select(F.concat(F.lit("https://venue.example/p/"), key).alias("url"), html.alias("html"))


_EVENT_START = f"""CAST(CAST({_NOW} AS DATE) + CAST(o_orderkey % 30 - 3 AS INTEGER) AS TIMESTAMP) + CASE o_orderkey % 3 WHEN 0 THEN
    INTERVAL 1170 MINUTE - to_hours(CASE WHEN o_orderkey % 2 = 0 THEN 1 WHEN o_orderkey % 4 = 1 THEN -8 ELSE -5 END)
    WHEN 1 THEN INTERVAL 1050 MINUTE ELSE INTERVAL 0 MINUTE END"""


@query(
    "jsonld_events",
    f"""SELECT 'https://venue.example/e/' || o_orderkey AS event_url, 'Show – ' || o_orderkey AS name,
          strftime({_EVENT_START}, '%Y-%m-%d %H:%M') AS starts, 'Hall ' || (o_orderkey % 9) || ' & Bar' AS venue,
          CASE WHEN o_orderkey % 2 = 0 THEN 'Copenhagen' ELSE 'Boston' END AS city, (o_orderkey % 200 + 0.5)::DOUBLE AS price, 'DKK' AS currency
        FROM orders WHERE {_EVENT_START} >= {_NOW} - INTERVAL 1 DAY""",
)
def jsonld_events(spark, sf):
    events = J.without_repeats(J.page_events(_event_pages(spark, sf), as_of()))
    return events.select("event_url", "name", F.date_format("start_date", "yyyy-MM-dd HH:mm").alias("starts"), "venue", "city", "price", "currency")


@query(
    "savable_events",
    f"""SELECT count(*) AS events, count(*) FILTER (o_orderkey % 4 = 0) AS library FROM orders
        WHERE o_orderkey % 97 = 0 OR {_NOW} + to_days(CAST(o_orderkey % 300 AS INTEGER)) < {_NOW} + to_days(CASE WHEN o_orderkey % 4 = 0 THEN 42 ELSE 183 END)""",
)
def savable_events(spark, sf):
    k = F.col("o_orderkey")
    events = table(spark, sf, "orders").select(
        k,
        F.when(k % 97 != 0, as_of() + F.make_dt_interval(days=(k % 300).cast("int"))).alias("start_date"),
        F.when(k % 4 == 0, "Library event").alias("description"),
    )
    kept = X.savable_events(events, as_of())
    return kept.agg(F.count(F.lit(1)).alias("events"), F.count_if(k % 4 == 0).alias("library"))


# --- products and shops ---------------------------------------------------------------------


def _product_pages(spark, sf):
    k = F.col("p_partkey")
    offer = F.struct(F.col("p_retailprice").cast("string").alias("price"), _pick(k, ["USD", "DKK"]).alias("priceCurrency"),
                     F.when(k % 5 == 0, "https://schema.org/OutOfStock").otherwise("https://schema.org/InStock").alias("availability"))
    code = F.when(k % 3 == 0, F.lpad(k.cast("string"), 13, "4")).otherwise("x1")
    product = F.struct(F.lit("Product").alias("@type"), F.col("p_name").alias("name"), F.struct(F.col("p_brand").alias("name")).alias("brand"),
                       code.alias("gtin13"), offer.alias("offers"))
    variant = F.struct(F.lit("red one").alias("name"), code.alias("gtin13"), F.array(offer).alias("offers"))
    bare = F.struct(F.lit("no offer").alias("name"))
    group = F.struct(F.array(F.lit("ProductGroup")).alias("@type"), F.concat("p_brand", F.lit(" "), "p_name").alias("name"),
                     F.col("p_brand").alias("brand"), F.array(F.to_json(bare)).alias("x"), F.array(variant).alias("hasVariant"))
    html = (
        F.when(k % 3 == 0, _script(F.to_json(product)))
        .when(k % 3 == 1, F.concat(_script(F.lit("[]")), _script(F.to_json(F.struct(F.array(group).alias("@graph"))))))
        .otherwise(F.concat(_script(F.lit("nope")), _script(F.to_json(F.array(product)))))
    )
    return spread(spark, sf, "part").select(k.alias("item_id"), html.alias("html"))


@query(
    "jsonld_products",
    """SELECT p_partkey AS item_id, p_brand || ' ' || p_name AS name, p_retailprice AS price,
         CASE WHEN p_partkey % 2 = 0 THEN 'USD' ELSE 'DKK' END AS currency, p_partkey % 5 <> 0 AS available,
         CASE WHEN p_partkey % 3 = 0 THEN lpad(CAST(p_partkey AS VARCHAR), 13, '4') END AS gtin FROM part""",
)
def jsonld_products(spark, sf):
    return J.page_products(_product_pages(spark, sf)).drop("image")


@query(
    "jsonld_offers",
    """WITH b AS (SELECT p_partkey AS k, p_name, p_retailprice FROM part)
       SELECT k AS item_id, CAST(0 AS INTEGER) AS pos, 'Cut ' || k AS name, (k % 90 + 1)::DOUBLE AS price, 'EUR' AS currency, NULL AS category FROM b
       UNION ALL SELECT k, 1, p_name, p_retailprice, 'EUR', 'Mains ' || (k % 7) FROM b
       UNION ALL SELECT k, 2, 'Soup of ' || k, NULL, NULL, 'Mains ' || (k % 7) FROM b
       UNION ALL SELECT k, 3, 'Tea', 2.5, 'EUR', 'Drinks' FROM b WHERE k % 2 = 0""",
)
def jsonld_offers(spark, sf):
    k = F.col("p_partkey")
    key = k.cast("string")
    item = lambda name, price: F.struct(
        F.lit("MenuItem").alias("@type"), name.alias("name"), F.when(price.isNotNull(), F.struct(price.alias("price"), F.lit("eur").alias("priceCurrency"))).alias("offers")
    )
    none = F.lit(None).cast("string")
    mains = F.struct(
        F.lit("MenuSection").alias("@type"), F.concat(F.lit("Mains "), (k % 7).cast("string")).alias("name"),
        F.array(item(F.col("p_name"), F.col("p_retailprice").cast("string")), item(F.concat(F.lit("Soup of "), key), none)).alias("hasMenuItem"),
    )
    drinks = F.struct(
        F.lit("MenuSection").alias("@type"), F.lit("Drinks").alias("name"),
        F.array(item(F.lit("Tea"), F.lit("2.50")), item(F.lit("Tea"), F.lit("9.99"))).alias("hasMenuItem"),
    )
    menu = F.struct(F.lit("Menu").alias("@type"), F.when(k % 2 == 0, F.array(mains, drinks)).otherwise(F.array(mains)).alias("hasMenuSection"))
    offer = F.struct(
        F.lit("Offer").alias("@type"), F.struct(F.concat(F.lit("Cut "), key).alias("name")).alias("itemOffered"),
        (k % 90 + 1).alias("price"), F.lit("EUR").alias("priceCurrency"),
    )
    business = F.struct(F.lit("HairSalon").alias("@type"), F.lit("Here").alias("address"), F.array(offer).alias("makesOffer"), menu.alias("hasMenu"))
    pages = spread(spark, sf, "part").select(k.alias("item_id"), _script(F.to_json(business)).alias("html"))
    return J.page_offers(pages)


def _shop_feeds(spark, sf):
    k = F.col("p_partkey")
    key = k.cast("string")
    variant = lambda n, size, ok: F.struct(
        (k * 10 + n).alias("id"), F.col("p_retailprice").cast("string").alias("price"), ok.alias("available"),
        F.lpad(key, 12, "7").alias("barcode"), F.lit(size).alias("option1"), F.lit("Red").alias("option2"),
    )
    first = F.struct(
        F.concat(F.lit("h-"), key).alias("handle"), F.col("p_name").alias("title"),
        F.array(F.struct(F.lit("Størrelse").alias("name"), F.lit(1).alias("position")), F.struct(F.lit("Colour").alias("name"), F.lit(2).alias("position"))).alias("options"),
        F.array(variant(1, "S", k % 5 != 0), variant(2, "M", k % 3 != 0), variant(3, "S", F.lit(True))).alias("variants"),
    )
    second = F.struct(
        F.concat(F.lit("https://w.example/"), key).alias("permalink"), F.concat(F.lit("<b>"), "p_name", F.lit("</b>")).alias("name"),
        F.struct(F.floor(F.col("p_retailprice") * 100 + 0.5).cast("bigint").cast("string").alias("price"), F.lit(2).alias("currency_minor_unit"), F.lit("DKK").alias("currency_code")).alias("prices"),
        (k % 4 != 1).alias("is_in_stock"), F.lit("sku-1").alias("sku"),
        F.array(F.struct(F.lit("Color").alias("name"), F.array(F.struct(F.lit("Blue").alias("name"))).alias("terms"))).alias("attributes"),
    )
    body = F.when(k % 2 == 0, F.to_json(F.struct(F.array(first).alias("products")))).otherwise(F.to_json(F.array(second)))
    return spread(spark, sf, "part").select(_site("s", k).alias("domain"), F.lit("EUR").alias("currency"), body.alias("body"))


@query(
    "shop_items",
    """SELECT CASE WHEN even THEN 'https://s' || k || '.example/products/h-' || k ELSE 'https://w.example/' || k END AS url, p_name AS name,
         CASE WHEN even THEN p_retailprice ELSE floor(p_retailprice * 100 + 0.5) / 100 END AS price, CASE WHEN even THEN 'EUR' ELSE 'DKK' END AS currency,
         CASE WHEN even THEN p_retailprice ELSE floor(floor(p_retailprice * 100 + 0.5) / 100 / 7.5 * 100 + 0.5) / 100 END AS price_eur,
         CASE WHEN even THEN true ELSE k % 4 <> 1 END AS available, CASE WHEN even THEN lpad(CAST(k AS VARCHAR), 12, '7') END AS gtin,
         CASE WHEN even THEN CASE WHEN k % 5 <> 0 THEN CASE WHEN k % 3 <> 0 THEN 'S M' ELSE 'S' END ELSE CASE WHEN k % 3 <> 0 THEN 'M S' ELSE 'S' END END END AS sizes,
         CASE WHEN even THEN 'Red' ELSE 'Blue' END AS colours,
         CASE WHEN even THEN CAST(k * 10 + CASE WHEN k % 5 <> 0 THEN 1 ELSE 3 END AS VARCHAR) END AS s_variant
       FROM (SELECT *, p_partkey AS k, p_partkey % 2 = 0 AS even FROM part)""",
)
def shop_items(spark, sf):
    rates = table(spark, sf, "nation").where(F.col("n_nationkey") == 0).select(F.lit("DKK").alias("currency"), F.lit(7.5).alias("rate"))
    items = shops.with_euro(shops.feed_items(_shop_feeds(spark, sf)), rates)
    return items.select(
        "url", "name", "price", "currency", "price_eur", "available", "gtin",
        F.array_join("sizes", " ").alias("sizes"), F.array_join("colours", " ").alias("colours"),
        F.try_element_at("size_variants", F.lit("S")).alias("s_variant"),
    )


@query(
    "shipping_countries",
    """SELECT c_custkey AS site_id, CASE c_custkey % 4 WHEN 0 THEN 'de fr' WHEN 1 THEN '*' WHEN 2 THEN 'dk gb us' END AS ships_to FROM customer""",
)
def shipping_countries(spark, sf):
    k = F.col("c_custkey")
    policy = _pick(k, ["<p>Wir liefern nach Frankreich und Deutschland.</p>", "<p>We ship Worldwide, also to Spain</p>",
                       "<p>UK, Danmark and U.S. orders</p>".replace("U.S. ", "the USA "), "<script>spain</script><p>Ask us</p>"])
    return spread(spark, sf, "customer").select(k.alias("site_id"), F.array_join(shops.ships_to(policy), " ").alias("ships_to"))


@query(
    "seed_shops",
    """SELECT CASE WHEN s_suppkey % 2 = 0 THEN 'dk' ELSE 'us' END AS country, CAST(n AS INTEGER) AS pos, 's' || s_suppkey || CASE n WHEN 0 THEN 'a' ELSE 'b' END || '.example' AS domain
       FROM supplier, (SELECT unnest([0, 1]) AS n)""",
)
def seed_shops(spark, sf):
    key = F.col("s_suppkey").cast("string")
    value = F.concat(
        F.lit('{"_about":"text","'), F.when(F.col("s_suppkey") % 2 == 0, "dk").otherwise("us"), F.lit('":["WWW.s'), key, F.lit('a.example"," s'), key, F.lit('b.example "]}'),
    )
    return shops.seed_domains(table(spark, sf, "supplier").select(value.alias("value")))


def _product_urls(spark, sf):
    k = F.col("p_partkey")
    slug = F.concat(_pick(k, ["mens-nike-", "asics-", "plain-", "womens-hoka-kids-"]), F.replace(F.col("p_name"), F.lit(" "), F.lit("-")))
    return table(spark, sf, "part").select(F.concat(F.lit("https://x.example/product/"), k.cast("string"), F.lit("/"), slug).alias("url"))


@query(
    "wanted_products",
    """SELECT 'https://x.example/product/' || p_partkey || '/' || CASE p_partkey % 4 WHEN 0 THEN 'mens-nike-' ELSE 'asics-' END || replace(p_name, ' ', '-') AS url
       FROM part WHERE p_partkey % 4 < 2""",
)
def wanted_products(spark, sf):
    return shops.wanted_products(_product_urls(spark, sf), r"^https://x\.example/product/\d+/")


@query(
    "preferred_pages",
    """SELECT url FROM (SELECT 'https://x.example/product/' || p_partkey || '/' || CASE p_partkey % 4 WHEN 0 THEN 'mens-nike-' ELSE 'asics-' END || replace(p_name, ' ', '-') AS url
       FROM part WHERE p_partkey % 4 < 2) ORDER BY contains(url, 'nike') DESC, sha256('week-5 ' || url), url LIMIT 600""",
)
def preferred_pages(spark, sf):
    wanted = shops.wanted_products(_product_urls(spark, sf), r"^https://x\.example/product/\d+/")
    return shops.preferred_order(wanted, "nike", "week-5", 600)


# --- robots ---------------------------------------------------------------------------------


def _robots(spark, sf):
    k = F.col("s_suppkey")
    body = (
        F.when(k % 5 == 0, "User-agent: OtherBot\nUser-agent: LoomBot\nDisallow: /private\nAllow: /private/open$\n\nUser-agent: *\nDisallow: /")
        .when(k % 5 == 1, "# hi\nUser-agent: *\r\nDisallow: /*.pdf$\r\nDisallow: /a\r\nAllow: /a")
        .when(k % 5 == 2, "User-agent: *\nDisallow: /\nUser-agent: GPTBot\nDisallow: /\nAllow: /")
        .when(k % 5 == 3, "User-agent: GPTBot\nUser-agent: CCBot\nDisallow: /\nUser-agent: *\nDisallow:")
        .otherwise("User-agent: loombot/1.0\nDisallow: /x.y?z")
    )
    return table(spark, sf, "supplier").select(
        _site("s", k).alias("host"), F.when(k % 17 == 0, 503).when(k % 19 == 0, 404).otherwise(200).alias("status"), F.lit("text/plain").alias("content_type"), body.alias("body"), k
    )


@query(
    "robots_access",
    """WITH p AS (SELECT unnest(['/', '/private/x', '/private/open', '/private/open2', '/a', '/doc/f.pdf', '/f.pdf?x', '/x.y?z=1', '/xay?z']) AS path),
         r AS (SELECT s_suppkey AS k, path FROM supplier, p)
       SELECT 's' || k || '.example' AS host, path, CASE WHEN k % 17 = 0 THEN false WHEN k % 19 = 0 THEN true
         WHEN k % 5 = 0 THEN NOT (path IN ('/private/x', '/private/open2')) WHEN k % 5 = 1 THEN path <> '/doc/f.pdf'
         WHEN k % 5 = 2 THEN false WHEN k % 5 = 3 THEN true ELSE path <> '/x.y?z=1' END AS allowed FROM r""",
)
def robots_access(spark, sf):
    paths = ["/", "/private/x", "/private/open", "/private/open2", "/a", "/doc/f.pdf", "/f.pdf?x", "/x.y?z=1", "/xay?z"]
    requests = table(spark, sf, "supplier").select(
        _site("s", F.col("s_suppkey")).alias("host"), F.explode(F.array(*[F.lit(p) for p in paths])).alias("path")
    )
    return X.crawl_permissions(_robots(spark, sf), requests, "LoomBot")


shared(
    "blocked_bots",
    """SELECT s_suppkey AS k, 's' || s_suppkey || '.example' AS host, s_suppkey % 17 <> 0 AND s_suppkey % 19 <> 0 AS robots_txt,
         CASE WHEN s_suppkey % 17 = 0 OR s_suppkey % 19 = 0 THEN '' ELSE CASE s_suppkey % 5 WHEN 0 THEN 'GPTBot CCBot' WHEN 2 THEN 'CCBot' WHEN 3 THEN 'GPTBot CCBot' ELSE '' END END AS blocked,
         CASE WHEN s_suppkey % 17 = 0 OR s_suppkey % 19 = 0 THEN NULL ELSE s_suppkey % 5 = 2 END AS blocks_everyone FROM supplier""",
)


@query("bot_block_audit", "SELECT host, robots_txt, blocked, blocks_everyone FROM blocked_bots")
def bot_block_audit(spark, sf):
    audit = X.bot_block_audit(_robots(spark, sf), bots=("GPTBot", "CCBot"))
    return audit.withColumn("blocked", F.array_join("blocked", " "))


@query(
    "blocked_share",
    """SELECT count(*) AS checked, count(*) FILTER (blocked <> '') AS blocking, floor(count(*) FILTER (blocked <> '') * 1000.0 / count(*) + 0.5) / 10 AS blocking_percent
       FROM blocked_bots""",
)
def blocked_share(spark, sf):
    from hostloom.plans.report import blocked_share as share

    return share(X.bot_block_audit(_robots(spark, sf), bots=("GPTBot", "CCBot")))


# --- guides and calendars -------------------------------------------------------------------


def _guides(spark, sf):
    k = F.col("s_suppkey")
    domain = _site("s", k)
    body = F.concat(
        F.when(k % 6 == 0, "No heading\n").otherwise(F.concat(F.lit("# "), "s_name", F.lit("\n\n> All about "), "s_name", F.lit("\n\n"))),
        F.lit("- [Prices](https://www."), domain, F.lit("/pricing.md): What it costs\n* [Docs](/docs/index)\n- [Away](https://other.example/x): no\n- [Home](/): no\n- [Prices again](/pricing): twice\n- ["),
        F.col("s_name"), F.lit("](about)\n"),
    )
    return table(spark, sf, "supplier").select(domain.alias("domain"), body.alias("body"))


@query(
    "guide_pages",
    """WITH g AS (SELECT s_suppkey, s_name, unnest([0, 1, 5]) AS pos FROM supplier WHERE s_suppkey % 6 <> 0)
       SELECT 's' || s_suppkey || '.example' AS domain, CAST(pos AS INTEGER) AS pos, CASE pos WHEN 0 THEN '/pricing' WHEN 1 THEN '/docs/' ELSE '/about' END AS path,
         CASE pos WHEN 0 THEN 'Prices' WHEN 1 THEN 'Docs' ELSE s_name END AS title, CASE pos WHEN 0 THEN 'What it costs' WHEN 1 THEN 'Docs' ELSE s_name END AS content FROM g""",
)
def guide_pages(spark, sf):
    return X.guide_pages(_guides(spark, sf))


@query(
    "guide_summaries",
    "SELECT 's' || s_suppkey || '.example' AS domain, CASE WHEN s_suppkey % 6 <> 0 THEN 'All about ' || s_name END AS summary FROM supplier",
)
def guide_summaries(spark, sf):
    return _guides(spark, sf).select("domain", X.guide_summary(F.col("body")).alias("summary"))


@query(
    "merged_guides",
    """SELECT 's' || s_suppkey || '.example' AS domain, CASE WHEN s_suppkey % 6 = 0 OR s_suppkey % 4 = 0 THEN '/=Home /pricing=Own'
         ELSE '/=Home /about=' || s_name || ' /docs/=Docs /pricing=Own' END AS pages FROM supplier""",
)
def merged_guides(spark, sf):
    page = F.struct("title", "content")
    extra = X.guide_pages(_guides(spark, sf)).groupBy("domain").agg(F.map_from_entries(F.collect_list(F.struct("path", page))).alias("extra"))
    k = F.col("s_suppkey")
    text = lambda a, b: F.struct(F.lit(a).alias("title"), F.lit(b).alias("content"))
    stored = table(spark, sf, "supplier").select(
        _site("s", k).alias("domain"),
        F.create_map(F.lit("/"), text("Home", "h"), F.lit("/pricing"), text("Own", "p")).alias("pages"),
        F.when(k % 4 == 0, "de").otherwise("en").alias("language"),
    )
    merged = stored.join(extra, "domain", "left").select("domain", X.merge_guide_pages(F.col("pages"), F.col("extra"), F.col("language")).alias("m"))
    shown = F.transform(F.array_sort(F.map_keys("m")), lambda p: F.concat(p, F.lit("="), F.element_at("m", p)["title"]))
    return merged.select("domain", F.array_join(shown, " ").alias("pages"))


def _calendars(spark, sf):
    k = F.col("o_orderkey")
    key = k.cast("string")
    day = F.date_format(as_of() + F.make_dt_interval(days=(k % 160 - 10).cast("int")), "yyyyMMdd")
    start = (
        F.when(k % 4 == 0, F.concat(F.lit("DTSTART:"), day, F.lit("T190000Z")))
        .when(k % 4 == 1, F.concat(F.lit("DTSTART;TZID=America/Phoenix:"), day, F.lit("T190000")))
        .when(k % 4 == 2, F.concat(F.lit("DTSTART:"), day, F.lit("T190000")))
        .otherwise(F.concat(F.lit("DTSTART;VALUE=DATE:"), day))
    )
    body = F.concat(
        F.lit("BEGIN:VCALENDAR\r\nX-WR-TIMEZONE:Asia/Tokyo\r\nBEGIN:VEVENT\r\n"), start,
        F.lit("\r\nSUMMARY:"), F.when(k % 10 == 9, "Cancelled: ").otherwise(""), F.lit("Talk\\, no "), key, F.lit(" with a\r\n  long title\r\nUID:u "), key,
        F.when(k % 3 == 0, F.concat(F.lit("\r\nURL:https://cal.example/"), key)).otherwise(""),
        F.lit("\r\nLOCATION:Room\\n"), key, F.lit("\r\nEND:VEVENT\r\nEND:VCALENDAR"),
    )
    return spread(spark, sf, "orders").select(F.concat(F.lit("https://cal.example/f"), key, F.lit(".ics")).alias("feed_url"), body.alias("body"))


_CAL = f"""CAST(CAST({_NOW} AS DATE) + CAST(o_orderkey % 160 - 10 AS INTEGER) AS TIMESTAMP) + CASE o_orderkey % 4 WHEN 0 THEN INTERVAL 19 HOUR
    WHEN 1 THEN INTERVAL 26 HOUR WHEN 2 THEN INTERVAL 10 HOUR ELSE INTERVAL (-9) HOUR END"""


@query(
    "calendar_events",
    f"""SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'https://cal.example/' || o_orderkey ELSE 'https://cal.example/f' || o_orderkey || '.ics#u%20' || o_orderkey END AS url,
          'Talk, no ' || o_orderkey || ' with a long title' AS name, strftime({_CAL}, '%Y-%m-%d %H:%M') AS starts, 'Room ' || o_orderkey AS venue
        FROM orders WHERE o_orderkey % 10 <> 9 AND {_CAL} >= {_NOW} - INTERVAL 3 HOUR AND {_CAL} <= {_NOW} + INTERVAL 120 DAY""",
)
def calendar_events(spark, sf):
    events = X.calendar_events(_calendars(spark, sf), as_of())
    return events.select("url", "name", F.date_format("start_date", "yyyy-MM-dd HH:mm").alias("starts"), "venue")


@query(
    "calendar_links",
    """SELECT s_suppkey, 'https://s.example/c' || s_suppkey || '.ics' AS a, 'https://cal.example/' || s_suppkey AS b FROM supplier""",
)
def calendar_links(spark, sf):
    key = F.col("s_suppkey").cast("string")
    html = F.concat(
        F.lit('<link rel="alternate" type="text/calendar" href="/c'), key, F.lit('.ics"><a href="/c'), key, F.lit('.ics">x</a><a href="webcal://cal.example/'), key, F.lit('">y</a>')
    )
    links = X.calendar_links(html, F.lit("https://s.example/events"))
    return table(spark, sf, "supplier").select("s_suppkey", links.alias("l")).select("s_suppkey", F.get("l", F.lit(0)).alias("a"), F.get("l", F.lit(1)).alias("b"))


# --- places ---------------------------------------------------------------------------------


def _elements(spark, sf):
    k = F.col("c_custkey")
    key = k.cast("string")
    host = F.concat(F.lit("www.p"), F.floor(k / 3 * F.when(k % 2 == 0, 1).otherwise(1)).cast("int").cast("string"), F.lit(".example"))
    tags = F.map_filter(
        F.map_from_arrays(
            F.array(*[F.lit(t) for t in ("name", "website", "shop", "amenity", "phone", "addr:city", "addr:street", "addr:housenumber", "opening_hours", "diet:vegan", "dog", "stars", "disused:shop")]),
            F.array(
                F.col("c_name"),
                F.when(k % 11 == 0, "https://www.facebook.com/x").otherwise(F.concat(F.when(k % 2 == 0, "https://").otherwise(""), host, F.when(k % 4 == 1, "/shop/").otherwise("/"))),
                F.when(k % 5 == 0, "hair_dresser"),
                F.when(k % 5 == 1, "theatre"),
                F.concat(F.lit(" +45 "), key, F.lit(" ; 2")),
                F.when(k % 3 == 0, "København NV").when(k % 3 == 1, "Roskilde 4"),
                F.lit("Gade"), key,
                F.lit("Mo-Fr 9:00-17:00; We off; Sa 10:00-12:00,13:00-14:00; PH off"),
                F.when(k % 2 == 0, "only"), F.when(k % 4 == 0, "leashed"), F.when(k % 6 == 0, "4.5S"),
                F.when(k % 13 == 0, "yes"),
            ),
        ),
        lambda _, v: v.isNotNull(),
    )
    centre = F.struct((k / 100.0).alias("lat"), (k / 50.0).alias("lon"))
    return table(spark, sf, "customer").select(
        k.alias("pos"), tags.alias("tags"), F.when(k % 2 == 0, k / 100.0).alias("lat"), F.when(k % 2 == 0, k / 50.0).alias("lon"), centre.alias("center"),
        F.lit("Aarhus").alias("city"), F.lit("dk").alias("country"),
    )


shared(
    "place_rows",
    """SELECT k AS pos, 'p' || (k // 3) || '.example' AS domain, CASE WHEN k % 4 = 1 THEN '/shop' ELSE '/' END AS path,
         CASE k % 5 WHEN 0 THEN 'hair dresser' WHEN 1 THEN 'theatre' ELSE 'business' END AS type, c_name AS name, k % 5 = 1 AS venue,
         '+45 ' || k AS telephone, 'Gade ' || k AS street, CASE k % 3 WHEN 0 THEN 'Copenhagen' WHEN 1 THEN 'Roskilde' ELSE 'Aarhus' END AS city,
         k / 100.0 AS lat, concat_ws(' ', CASE WHEN k % 2 = 0 THEN 'vegan vegetarian' END, CASE WHEN k % 4 = 0 THEN 'dogs' END) AS features,
         CASE WHEN k % 6 = 0 THEN 4.5::DOUBLE END AS stars
       FROM (SELECT *, c_custkey AS k FROM customer) WHERE k % 11 <> 0 AND k % 13 <> 0""",
)
_HOURS = "Mo, Tu, Th, Fr 09:00–17:00; Sa 10:00–12:00; Sa 13:00–14:00"


@query("places", f"SELECT *, '{_HOURS}' AS hours, 'DK' AS country FROM place_rows")
def places(spark, sf):
    found = X.places(_elements(spark, sf))
    return found.select(
        "pos", "domain", "path", "type", "name", "venue", "telephone", "street", "city", "lat", F.array_join("features", " ").alias("features"), "stars",
        H.hours_line(F.col("opening_hours")).alias("hours"), "country",
    )


@query(
    "local_places",
    """SELECT domain, arg_max(pos, CASE WHEN path = '/' THEN 1000000 + pos ELSE -pos END) AS pos FROM place_rows GROUP BY domain HAVING count(*) <= 2""",
)
def local_places(spark, sf):
    return X.local_places(X.places(_elements(spark, sf))).select("domain", "pos")


@query(
    "place_records",
    """SELECT domain, pos, name || ' is a ' || type || ' at ' || street || ', ' || city || '. Opening hours are listed.' AS content, 'visit call directions' AS actions FROM place_rows""",
)
def place_records(spark, sf):
    found = X.places(_elements(spark, sf))
    records = X.place_record(found.withColumn("domain", F.concat_ws("|", "domain", F.col("pos").cast("string"))))
    parts = F.split("domain", r"\|")
    return records.select(parts[0].alias("domain"), parts[1].cast("bigint").alias("pos"), "content", F.array_join("actions", " ").alias("actions"))


@query(
    "preferred_fields",
    """SELECT 'c' || c_custkey AS domain, CASE WHEN c_custkey % 2 = 0 AND c_custkey % 3 = 0 THEN 'own' WHEN c_custkey % 3 <> 1 THEN 'map' END AS telephone,
         CASE WHEN c_custkey % 2 = 0 THEN 'own mail' END AS email FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 <> 1""",
)
def preferred_fields(spark, sf):
    k = F.col("c_custkey")
    rows = table(spark, sf, "customer").select(F.concat(F.lit("c"), k.cast("string")).alias("domain"), k)
    own = rows.where(k % 2 == 0).withColumn("telephone", F.when(k % 3 == 0, "own")).withColumn("email", F.lit("own mail"))
    other = rows.where(k % 3 != 1).withColumn("telephone", F.lit("map")).withColumn("email", F.lit(None).cast("string"))
    return X.prefer_fields(own, other, "domain", ["telephone", "email"])


# --- hours ----------------------------------------------------------------------------------


@query(
    "hours_parse",
    """SELECT c_custkey AS site_id, CASE c_custkey % 3 WHEN 0 THEN 'Mo, Tu, We, Th, Fr 09:00–17:00; Sa 10:00–14:00' WHEN 1 THEN 'Sa, Su, Mo 08:30–12:00' ELSE 'Mo, We 10:00–14:00' END AS plain,
         CASE c_custkey % 4 WHEN 0 THEN 'Mo, Tu, We, Th, Fr, Sa, Su 00:00–23:59' WHEN 1 THEN 'Tu, We, Th, Fr 09:00–17:30; Mo 10:00–12:00' WHEN 2 THEN 'Mo, Tu, We, Th, Fr, Sa 08:00–12:00; Mo, Tu, We, Th, Fr, Sa 13:00–18:00' END AS map
       FROM customer""",
)
def hours_parse(spark, sf):
    k = F.col("c_custkey")
    plain = _pick(k, ["Mo-Fr 09:00-17:00, Sa 10:00-14:00", "Sa - Mo 8:30 - 12:00", "Mo,We 10:00-14:00"])
    mapped = _pick(k, ["24/7", "Mo-Fr 09:00-17:30; Mo 10:00-12:00; PH off", "08:00-12:00, 13:00-18:00; Su off", "by appointment"])
    return spread(spark, sf, "customer").select(
        k.alias("site_id"), H.hours_line(H.parse_hours(plain)).alias("plain"), H.hours_line(H.parse_map_hours(mapped)).alias("map")
    )


@query(
    "open_now",
    """SELECT c_custkey AS site_id, CASE WHEN c_custkey % 4 = 3 THEN NULL WHEN c_custkey % 5 = 0 THEN false
         ELSE ((c_custkey % 24) + CASE c_custkey % 4 WHEN 0 THEN 1 WHEN 1 THEN -5 ELSE 9 END + 24) % 24 BETWEEN 9 AND 16
           OR ((c_custkey % 24) + CASE c_custkey % 4 WHEN 0 THEN 1 WHEN 1 THEN -5 ELSE 9 END + 24) % 24 >= 22
           OR ((c_custkey % 24) + CASE c_custkey % 4 WHEN 0 THEN 1 WHEN 1 THEN -5 ELSE 9 END + 24) % 24 < 2 END AS open
       FROM customer""",
)
def open_now(spark, sf):
    k = F.col("c_custkey")
    hours = H.parse_hours(F.lit("Mo-Su 09:00-17:00; Mo-Su 22:00-02:00"))
    special = F.when(k % 5 == 0, F.array(F.struct(F.lit("2024-01-29").alias("from"), F.lit("2024-02-03").alias("to"), F.lit(True).alias("closed"),
        F.lit(None).cast("string").alias("opens"), F.lit(None).cast("string").alias("closes"))))
    at = as_of() + F.make_dt_interval(hours=(k % 24).cast("int"))
    country = _pick(k, ["Denmark", "us", "JP", "Atlantis"])
    return spread(spark, sf, "customer").select(k.alias("site_id"), H.is_open(hours, special, country, at).alias("open"))


# --- listings and genres --------------------------------------------------------------------


def _listing_pages(spark, sf):
    k = F.col("p_partkey")
    key = k.cast("string")
    month = _pick(k, ["Feb", "mar", "Oct", "jan"])
    card = lambda n, prefix: F.concat(
        F.lit('<div class="card"><a href="/show/'), key, F.lit(f'-{n}">{prefix}Act &amp; '), key, F.lit('</a><i class="d">'), (k % 27 + 1).cast("string"), F.lit(". "), month,
        F.lit('</i><i class="t">7:30 PM</i><b class="p">kr. '), (k % 300).cast("string"), F.lit("</b></div>"),
    )
    html = F.concat(F.lit("<html><h1>Shows</h1>"), card(1, "SOLD OUT | "), card(2, "Cancelled: "), F.lit("</html>"))
    return spread(spark, sf, "part").select(F.concat(F.lit("https://hall.example/list/"), key).alias("url"), html.alias("html"))


@query(
    "listing_cards",
    """WITH c AS (SELECT p_partkey AS k, p_partkey % 27 + 1 AS d, [2, 3, 10, 1][p_partkey % 4 + 1] AS m FROM part),
         t AS (SELECT *, make_timestamp(2024, m, d, 19, 30, 0) - CASE WHEN m = 10 AND d < 27 THEN INTERVAL 2 HOUR ELSE INTERVAL 1 HOUR END AS s,
           make_timestamp(2025, m, d, 19, 30, 0) - INTERVAL 1 HOUR AS later FROM c)
       SELECT 'https://hall.example/show/' || k || '-1' AS event_url, 'SOLD OUT: Act & ' || k AS name,
         strftime(CASE WHEN s < TIMESTAMP '2024-01-31' - INTERVAL 30 DAY THEN later ELSE s END, '%Y-%m-%d %H:%M') AS starts,
         'The Hall' AS venue, CASE WHEN k % 300 > 0 THEN (k % 300)::DOUBLE END AS price, CASE WHEN k % 300 > 0 THEN 'DKK' END AS currency
       FROM t WHERE CASE WHEN s < TIMESTAMP '2024-01-31' - INTERVAL 30 DAY THEN later ELSE s END > TIMESTAMP '2024-01-30 18:00:00'""",
)
def listing_cards(spark, sf):
    fields = {
        "link": 'href="([^"]+)"', "title": "<a [^>]*>(.*?)</a>", "day": r'class="d">(\d+)\.', "month": r'class="d">\d+\. (\w+)',
        "clock": 'class="t">([^<]*)<', "price": r'class="p">\D*([\d.]+)<',
    }
    cards = X.listing_cards(_listing_pages(spark, sf), "hall", '<div class="card">', fields)
    events = X.card_events(cards, "Europe/Copenhagen", as_of(), venue="The Hall", city="Copenhagen", country="DK", currency="DKK")
    return events.select("event_url", "name", F.date_format("start_date", "yyyy-MM-dd HH:mm").alias("starts"), "venue", "price", "currency")


@query(
    "listing_json",
    f"""SELECT 'https://api.example/e/' || o_orderkey AS event_url, 'Night & ' || o_orderkey AS name, strftime({_NOW} + to_days(CAST(o_orderkey % 35 AS INTEGER)) + CASE WHEN o_orderkey % 2 = 0 THEN INTERVAL 0 HOUR ELSE INTERVAL 23 HOUR END, '%Y-%m-%d %H:%M') AS starts,
          CASE WHEN o_orderkey % 3 = 0 THEN 'Main' ELSE 'Default' END AS venue, CASE WHEN o_orderkey % 50 > 0 THEN (o_orderkey % 50)::DOUBLE END AS price
        FROM orders WHERE o_orderkey % 7 <> 0""",
)
def listing_json(spark, sf):
    k = F.col("o_orderkey")
    start = as_of() + F.make_dt_interval(days=(k % 35).cast("int"))
    item = F.struct(
        F.concat(F.lit("/e/"), k.cast("string")).alias("slug"),
        F.struct(F.concat(F.lit("<b>Night</b> &amp; "), k.cast("string")).alias("text")).alias("title"),
        F.when(k % 2 == 0, F.unix_millis(start).cast("string")).otherwise(F.date_format(start, "yyyy-MM-dd'T'18:00:00")).alias("when"),
        F.struct(F.when(k % 3 == 0, "Main").alias("name")).alias("hall"),
        F.concat(F.lit("$"), (k % 50).cast("string"), F.lit(".00")).alias("low"),
        F.when(k % 7 == 0, "Cancelled").otherwise("open").alias("status"),
    )
    feeds = spread(spark, sf, "orders").select(F.lit("https://api.example/feed").alias("url"), F.to_json(F.struct(F.array(item).alias("events"))).alias("body"))
    fields = {"link": "slug", "title": "title.text|title", "start": "when", "venue": "hall.name|place", "price": "low", "state": "status"}
    events = X.json_events(X.listing_json(feeds, "api", "events", fields), as_of(), zone="America/New_York", venue="Default", currency="USD")
    return events.select("event_url", "name", F.date_format("start_date", "yyyy-MM-dd HH:mm").alias("starts"), "venue", "price")


#: Four formats of public listings as reader rows: two calendars' JSON, JSON inside a page, cards of a page.
_READERS = [
    ("library", "json", None, "$.results", {"link": ["$.url"], "title": ["$.title"], "start": ["$.startdt"], "venue": ["$.campus", "$.location"], "price": ["$.registration_cost"]},
     "America/New_York", None, ("The Library", "Boston", "US", "USD")),
    ("plugin", "json", None, "$.events", {"link": ["$.url"], "title": ["$.title"], "start": ["$.utc_start_date"], "venue": ["$.venue.venue"], "city": ["$.venue.city"], "price": ["$.cost"]},
     "UTC", None, ("Plugin Hall", "Austin", "US", "USD")),
    ("page", "json", r'(?s)<script id="__STATE__"[^>]*>(.*?)</script>', "$.data.items", {"link": ["$.attributes.url"], "title": ["$.attributes.name"], "start": ["$.attributes.startTime", "$.attributes.startDate"], "state": ["$.attributes.status"]},
     "UTC", None, ("Canal House", "Amsterdam", "NL", "EUR")),
    ("cards", "cards", None, '<li class="card">', {"link": ['href="([^"]*)"'], "title": ["(?s)<h3>(.*?)</h3>"], "day": [r"<time>(\d+)\."], "month": [r"<time>\d+\. (\w+)"], "year": [r"<time>\d+\. \w+ (\d{4})"], "price": ["<b>([^<]*)</b>"]},
     "Europe/Copenhagen", "19:30", ("Kulturhus", "Aarhus", "DK", "DKK")),
]


@query(
    "listings_by_reader",
    f"""WITH o AS (SELECT o_orderkey AS k, o_orderkey % 4 AS f, {_NOW} + to_days(CAST(o_orderkey % 30 AS INTEGER)) AS day FROM orders)
        SELECT ['library', 'plugin', 'page', 'cards'][f + 1] AS source, 'https://' || ['library', 'plugin', 'page', 'cards'][f + 1] || '.example/e/' || k AS event_url,
          CASE WHEN f = 3 THEN 'Night & ' || k ELSE 'Night ' || k END AS name,
          strftime(day + CASE f WHEN 0 THEN INTERVAL '23 hours' WHEN 1 THEN INTERVAL '18 hours' WHEN 2 THEN CASE WHEN k % 3 = 0 THEN INTERVAL '12 hours' ELSE INTERVAL '20 hours' END ELSE INTERVAL '18 hours 30 minutes' END, '%Y-%m-%d %H:%M') AS starts,
          CASE f WHEN 0 THEN CASE WHEN k % 3 = 0 THEN 'East' WHEN k % 3 = 1 THEN 'Room 1' ELSE 'The Library' END WHEN 1 THEN CASE WHEN k % 3 = 0 THEN 'Barn' ELSE 'Plugin Hall' END WHEN 2 THEN 'Canal House' ELSE 'Kulturhus' END AS venue,
          CASE f WHEN 0 THEN 'Boston' WHEN 1 THEN CASE WHEN k % 3 = 0 THEN 'Waco' ELSE 'Austin' END WHEN 2 THEN 'Amsterdam' ELSE 'Aarhus' END AS city,
          CASE WHEN f <> 2 AND k % 50 > 0 THEN (k % 50)::DOUBLE END AS price, CASE WHEN f <> 2 AND k % 50 > 0 THEN CASE WHEN f = 3 THEN 'DKK' ELSE 'USD' END END AS currency
        FROM o WHERE k % 7 <> 0""",
)
def listings_by_reader(spark, sf):
    k = F.col("o_orderkey")
    at, key = as_of() + F.make_dt_interval(days=(k % 30).cast("int")), k.cast("string")
    link, night, price = F.concat(F.lit("/e/"), key), F.concat(F.lit("Night "), key), F.concat(F.lit("$"), (k % 50).cast("string"), F.lit(".00"))
    third, off = k % 3, k % 7 == 0
    called = F.when(off, F.concat(F.lit("Cancelled: "), night)).otherwise(night)
    library = F.struct(F.struct(link.alias("url"), called.alias("title"), F.date_format(at, "yyyy-MM-dd 18:00:00").alias("startdt"), F.when(third == 0, "East").alias("campus"),
                                F.when(third < 2, "Room 1").alias("location"), price.alias("registration_cost")).alias("i"))
    plugin = F.struct(F.struct(link.alias("url"), called.alias("title"), F.date_format(at, "yyyy-MM-dd 18:00:00").alias("utc_start_date"), price.alias("cost"),
                               F.when(third == 0, F.struct(F.lit("Barn").alias("venue"), F.lit("Waco").alias("city"))).alias("venue")).alias("i"))
    page = F.struct(F.struct(link.alias("url"), F.concat(F.lit("<i>Night</i> "), key).alias("name"), F.when(third == 0, F.date_format(at, "yyyy-MM-dd'T'12:00:00'Z'")).alias("startTime"),
                             F.date_format(at, "yyyy-MM-dd'T'20:00:00'Z'").alias("startDate"), F.when(off, "cancelled").alias("status")).alias("attributes"))
    one = lambda item: F.to_json(F.array(item))
    state = F.concat(F.lit('<html><script id="__STATE__" type="x">{"data":{"items":'), one(page), F.lit("}}</script></html>"))
    card = F.concat(F.lit('<ul><li class="card"><a href="'), link, F.lit('"><h3>'), F.when(off, "Aflyst: ").otherwise(""), F.lit("<b></b>Night &amp; "), key, F.lit("</h3></a><time>"),
                    F.date_format(at, "d. MMMM yyyy"), F.lit("</time><b>"), F.concat((k % 50).cast("string"), F.lit(" kr</b></ul>")))
    body = (
        F.when(k % 4 == 0, F.concat(F.lit('{"results":'), one(library["i"]), F.lit("}"))).when(k % 4 == 1, F.concat(F.lit('{"events":'), one(plugin["i"]), F.lit("}")))
        .when(k % 4 == 2, state).otherwise(F.replace(card, F.lit("<b></b>"), F.lit("")))
    )
    source = _pick(k, ["library", "plugin", "page", "cards"])
    feeds = spread(spark, sf, "orders").select(source.alias("source"), F.concat(F.lit("https://"), source, F.lit(".example/list")).alias("url"), body.alias("body"))
    events = X.listing_events(X.read_listings(feeds, rule_table(spark, _READERS, X.READER)), as_of())
    return events.select("source", "event_url", "name", F.date_format("start_date", "yyyy-MM-dd HH:mm").alias("starts"), "venue", "city", "price", "currency")


@query(
    "generic_listings",
    f"""SELECT 'https://venue.example/e/' || o_orderkey AS event_url, CASE WHEN o_orderkey % 60 < 28 THEN 'Copenhagen' WHEN o_orderkey % 2 = 0 THEN 'Oslo' ELSE 'Boston' END AS city,
          CASE WHEN o_orderkey % 2 = 0 THEN 'NO' ELSE 'US' END AS country FROM orders WHERE {_EVENT_START} >= {_NOW} - INTERVAL 1 DAY""",
)
def generic_listings(spark, sf):
    events = J.without_repeats(J.page_events(_event_pages(spark, sf), as_of()))
    number = F.regexp_extract("event_url", r"(\d+)$", 1).cast("bigint")
    blanked = (
        events.withColumn("postcode", ((number % 60) * 100).cast("string"))
        .withColumn("city", F.when(F.col("country") == "US", F.col("city")))
        .withColumn("country", F.when(F.col("country") == "US", F.col("country")))
    )
    return X.with_default_place(blanked, "Oslo", "NO", {"Copenhagen": 2800}).select("event_url", "city", "country")


@query(
    "event_genres",
    """SELECT p_partkey AS item_id, CASE WHEN p_partkey % 6 = 5 THEN 'Old. Genre: pop.' WHEN p_partkey % 6 = 4 THEN 'Genre: old jazz.'
         WHEN p_partkey % 6 IN (0, 3) THEN 'Live. Genre: doom metal, noise (metal).' WHEN p_partkey % 6 = 1 THEN 'Genre: jazz, blues.' ELSE 'Plain' END AS description FROM part""",
)
def event_genres(spark, sf):
    k = F.col("p_partkey")
    events = table(spark, sf, "part").select(
        k.alias("item_id"),
        F.concat(F.lit("u"), k.cast("string")).alias("url"),
        F.when(k % 6 == 0, F.concat(F.lit("SOLD OUT: "), "p_brand", F.lit(" with Guest"))).when(k % 6 == 3, F.concat(F.lower("p_brand"), F.lit(" – 40 years")))
        .otherwise(_pick(k, ["", "Big Band Blues Night", "Chess", "", "Reading", "Pop"])).alias("name"),
        F.when(k % 6 == 5, "Old. Genre: pop.").when(k % 6 == 2, "Plain").when(k % 3 == 0, "Live. ").alias("description"),
    )
    earlier = events.where(k % 6 == 4).select("url", F.lit("x. Genre: old jazz. y").alias("description"))
    # The brands stand for artists, each of them named by many events.
    entities = table(spark, sf, "part").select(F.col("p_brand").alias("label"), F.array(F.lit("doom metal"), F.lit("noise")).alias("genres"))
    return X.add_genres(events, earlier, entities).select("item_id", "description")


@query(
    "music_events",
    """SELECT p_partkey AS item_id, CASE p_partkey % 3 WHEN 0 THEN 'Foster' WHEN 1 THEN 'Gnags' END AS artist FROM part WHERE p_partkey % 3 < 2""",
)
def music_events(spark, sf):
    k = F.col("p_partkey")
    events = table(spark, sf, "part").select(
        k.alias("item_id"), _pick(k, ["Foster with Goth", "Gnags – 40 års jubilæum", "Rock climbing"]).alias("name"),
        F.when(k % 3 < 2, "En koncert").alias("description"), F.lit("Hall").alias("venue"),
    )
    return X.looks_like_music(events).select("item_id", X.artist_of(F.col("name")).alias("artist"))


@query(
    "library_kinds",
    """SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'kids family, music concert' WHEN 1 THEN 'exhibition' ELSE '' END AS kinds FROM documents""",
)
def library_kinds(spark, sf):
    title = _pick(F.col("doc_id"), ["Koncert for BØRN", "Utställning", "Chess"])
    return table(spark, sf, "documents").select("doc_id", F.array_join(X.library_kinds(title), ", ").alias("kinds"))


@query(
    "website_matches",
    """SELECT c_name AS name, 'c' || c_custkey || '.example' AS domain, 'q' || c_custkey AS entity FROM customer WHERE c_custkey % 3 <> 2""",
)
def website_matches(spark, sf):
    k = F.col("c_custkey")
    names = table(spark, sf, "customer").select(F.col("c_name").alias("name"), _site("c", k).alias("domain"))
    site = F.when(k % 3 == 0, F.concat(F.lit("https://www."), _site("c", k), F.lit("/x"))).when(k % 3 == 1, F.concat(F.lit("http://en."), _site("c", k))).otherwise("https://x.example")
    entities = table(spark, sf, "customer").select(F.upper("c_name").alias("label"), F.concat(F.lit("q"), k.cast("string")).alias("entity"), site.alias("website"))
    return X.match_websites(names, entities)


# --- own documents --------------------------------------------------------------------------


def _own_documents(spark, sf):
    k = F.col("c_custkey")
    doc = (
        F.when(k % 6 == 0, F.concat(F.lit('{"domain":"https://www.c'), k.cast("string"), F.lit('.example/x","name":"n","pages":{"/":{}},"actions":[]}')))
        .when(k % 6 == 1, '{"domain":"other.example","name":"n","pages":{"/":{}},"actions":[]}')
        .when(k % 6 == 2, '{"name":"n","pages":{},"actions":[]}')
        .when(k % 6 == 3, '{"pages":{"/":{}},"actions":{}}')
        .when(k % 6 == 4, "{oops")
        .otherwise('["x"]')
    )
    return table(spark, sf, "customer").select(_site("c", k).alias("domain"), F.when(k % 17 != 0, F.when(k % 13 == 0, 404).otherwise(200)).alias("status"), doc.alias("body"))


@query(
    "own_documents",
    """SELECT 'c' || c_custkey || '.example' AS domain, c_custkey % 6 = 0 AS valid, CASE WHEN c_custkey % 17 = 0 THEN 'it could not be reached'
         WHEN c_custkey % 13 = 0 THEN 'it answers with an error (HTTP 404)' ELSE CASE c_custkey % 6 WHEN 3 THEN 'the name is missing' WHEN 4 THEN 'it is not valid JSON'
           WHEN 5 THEN 'it is not a JSON object' END END AS problem FROM customer""",
)
def own_documents(spark, sf):
    return _own_documents(spark, sf).select(
        "domain",
        X.own_document_valid(F.try_parse_json("body"), F.col("domain")).alias("valid"),
        X.document_problem(F.col("status"), F.col("body")).alias("problem"),
    )


@query(
    "salvaged_json",
    """SELECT c_custkey AS site_id, CASE WHEN c_custkey % 3 < 2 THEN c_name END AS name FROM customer""",
)
def salvaged_json(spark, sf):
    k = F.col("c_custkey")
    json = F.concat(F.lit('{"name":"'), "c_name", F.lit('"}'))
    text = F.when(k % 3 == 0, json).when(k % 3 == 1, F.concat(F.lit("Sure:\n"), json, F.lit("\nDone"))).otherwise("no json {")
    return table(spark, sf, "customer").select(k.alias("site_id"), J.text_at(J.salvage_json(text), "name").alias("name"))


@query(
    "english_overlays",
    """SELECT c_custkey AS site_id, CASE WHEN c_custkey % 3 = 0 THEN '/=Start /b=Zwei' WHEN c_custkey % 3 = 1 THEN '/=Home /b=Zwei /c=Three' ELSE '/=Start /b=Zwei' END AS pages FROM customer""",
)
def english_overlays(spark, sf):
    k = F.col("c_custkey")
    text = lambda t: F.struct(F.lit(t).alias("title"))
    own = F.create_map(F.lit("/"), text("Start"), F.lit("/b"), text("Zwei"))
    english = F.when(k % 3 < 2, F.create_map(F.lit("/"), text("Home"), F.lit("/c"), text("Three")))
    merged = X.english_overlay(own, english, F.when(k % 3 == 0, "en").otherwise("de"))
    shown = lambda m: F.array_join(F.transform(F.array_sort(F.map_keys(m)), lambda p: F.concat(p, F.lit("="), F.element_at(m, p)["title"])), " ")
    return table(spark, sf, "customer").select(k.alias("site_id"), shown(merged).alias("pages"))
