"""Site records: scores, categories, duplicates, peers, slimming and merges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hostloom.functions.patterns import collapse, let, round_half_up, strip_blank
from hostloom.functions.text import brand_of, clean_reader_text, content_hash
from hostloom.functions.urls import without_www
from hostloom.operators.keyed import fence, join_to_unique, keep_first, settle, top_per_group

# --- guards ---------------------------------------------------------------------------------


def editable(owner: Column, native: Column) -> Column:
    """Nobody has claimed the site and it does not publish its own document."""
    return owner.isNull() & ~F.coalesce(native, F.lit(False))


# --- readiness ------------------------------------------------------------------------------

#: Checks and points of the readiness score.
READINESS_POINTS = [
    ("description", 15), ("several pages", 15), ("actions", 15), ("three actions", 10),
    ("own document", 15), ("executable actions", 15), ("business details", 15),
]


def home_page(pages: Column) -> Column:
    """Content of ``/``, or of the page with the shortest path. Map order has no meaning."""
    keys = F.array_sort(F.transform(F.map_keys(pages), lambda k: F.struct(F.length(k).alias("n"), k.alias("k"))))
    return F.coalesce(F.try_element_at(pages, F.lit("/")), F.try_element_at(pages, F.try_element_at(keys, F.lit(1))["k"]))["content"]


def readiness(home: Column, page_count: Column, action_count: Column, native: Column, executable: Column, has_business: Column) -> Column:
    """``struct<score, label, passed>`` of a site from its measures."""
    tests = [
        (F.length(F.coalesce(home, F.lit(""))) > 80) & ~F.coalesce(home, F.lit("")).startswith("Website at "),
        page_count >= 3,
        action_count >= 1,
        action_count >= 3,
        native,
        native & executable,
        has_business,
    ]
    score = sum((F.when(t, p).otherwise(0) for t, (_, p) in zip(tests, READINESS_POINTS)), F.lit(0))
    passed = F.array_compact(F.array(*[F.when(t, F.lit(name)) for t, (name, _) in zip(tests, READINESS_POINTS)]))
    label = lambda s: F.when(s >= 80, "ready").when(s >= 45, "partly ready").otherwise("not ready yet")
    return let(score, lambda s: F.struct(s.alias("score"), label(s).alias("label"), passed.alias("passed")))


def with_readiness(sites: DataFrame) -> DataFrame:
    """Add ``score``, ``label`` and ``passed`` to site records."""
    r = readiness(
        F.col("home"), F.col("page_count"), F.col("action_count"), F.col("native"), F.col("executable"), F.col("has_business")
    )
    return sites.withColumn("_r", r).select(*sites.columns, "_r.score", "_r.label", "_r.passed")


def score_movers(this_week: DataFrame, last_week: DataFrame, k: int = 20) -> DataFrame:
    """Sites whose score rose most since last week."""
    before = last_week.select("domain", F.col("score").alias("before"))
    risen = this_week.select("domain", F.col("score").alias("now")).join(before, "domain").where(F.col("now") > F.col("before"))
    return risen.orderBy(F.desc(F.col("now") - F.col("before")), "domain").limit(k)


def peer_comparison(scored: DataFrame, peers: int = 5, hidden: Sequence[str] = ("adult", "gambling")) -> DataFrame:
    """Each site against its best peers.

    Peers share the category and, when at least two others do, the city; else they
    are the category's sites with their own document, topped up with sites that have
    business details when there are fewer than ``peers`` of the former.

    A site needs only the ``peers`` best of its group other than itself, so every
    group is first cut to ``peers + 1`` rows (before the shuffle) and becomes one
    short array. Nothing compares all pairs of a group.
    """
    base = scored.where(F.col("category").isNotNull() & ~F.col("category").isin(*hidden))
    pool = base.where(F.col("status").isNull() & (F.col("action_count") > 0))
    member = F.struct((-F.col("score")).alias("minus"), F.col("domain"), F.col("passed")).alias("m")

    def best(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
        short = top_per_group(rows, keys, [F.desc("score"), F.col("domain")], peers + 1)
        lists = short.select(*keys, member).groupBy(*keys).agg(F.array_sort(F.collect_list("m")).alias(name))
        sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias(f"{name}_n"))
        return lists.join(sizes, keys)

    located = pool.where(F.col("city").isNotNull())
    local = best(located, ["category", "city"], "local")
    own = best(pool.where("native"), ["category"], "own")
    wide = best(pool.where(F.col("native") | F.col("has_business")), ["category"], "wide")
    joined = base.join(local, ["category", "city"], "left").join(own, "category", "left").join(wide, "category", "left")

    in_pool = F.col("status").isNull() & (F.col("action_count") > 0)

    def others(name: str, member_of: Column) -> Column:
        return F.coalesce(F.col(f"{name}_n"), F.lit(0)) - F.when(member_of, 1).otherwise(0)

    is_local = others("local", in_pool & F.col("city").isNotNull()) >= 2
    enough_own = others("own", in_pool & F.col("native")) >= peers
    chosen = F.when(is_local, F.col("local")).when(enough_own, F.col("own")).otherwise(F.col("wide"))
    without_self = F.slice(F.filter(chosen, lambda m: m["domain"] != F.col("domain")), 1, peers)
    staged = joined.select(
        "domain", "category", "score", "passed", F.when(is_local, F.col("city")).alias("city"), without_self.alias("_peers")
    ).where(F.size("_peers") > 0)
    better = F.size(F.filter("_peers", lambda m: -m["minus"] > F.col("score")))
    return staged.select(
        "domain",
        "category",
        "city",
        "score",
        (better + 1).alias("rank"),
        (F.size("_peers") + 1).alias("total"),
        F.transform("_peers", lambda m: m["domain"]).alias("peers"),
        F.flatten(F.transform("_peers", lambda m: F.array_except(m["passed"], F.col("passed")))).alias("missing"),
    )


def they_have(comparison: DataFrame) -> DataFrame:
    """Per site: checks its peers pass and it does not, with the number of such peers."""
    return (
        comparison.select("domain", F.explode("missing").alias("check")).groupBy("domain", "check").agg(F.count(F.lit(1)).alias("peers"))
    )


# --- categories -----------------------------------------------------------------------------

#: Business types that name a category, in order.
TYPE_CATEGORIES = [
    ("Restaurant|FastFoodRestaurant|FoodEstablishment", "restaurant"), ("CafeOrCoffeeShop", "cafe"),
    ("BarOrPub|Winery|Brewery|Distillery|NightClub", "bar"), ("Bakery", "bakery"),
    ("HairSalon|BeautySalon|NailSalon|HealthAndBeautyBusiness", "hair_beauty"), ("DaySpa|TattooParlor", "spa_wellness"),
    ("ExerciseGym|SportsActivityLocation|SportsClub|HealthClub", "fitness"), ("Dentist", "dental"),
    ("MedicalBusiness|MedicalClinic|Physician|Hospital|Pharmacy|Optician|Physiotherapy|VeterinaryCare", "health"),
    ("Hotel|LodgingBusiness|BedAndBreakfast|Hostel|Motel|Resort|Campground", "hotel"), ("TravelAgency|TouristAttraction", "travel"),
    ("EntertainmentBusiness|MovieTheater|Casino|AmusementPark|EventVenue", "events"), ("Museum|ArtGallery|Library", "museum_culture"),
    ("ClothingStore|ShoeStore|JewelryStore", "shop_fashion"), ("ElectronicsStore|ComputerStore|MobilePhoneStore", "shop_electronics"),
    ("FurnitureStore|HomeGoodsStore|HardwareStore|GardenStore", "shop_home"), ("GroceryStore|LiquorStore|ConvenienceStore", "shop_grocery"),
    ("SportingGoodsStore|BikeStore", "shop_sports"), ("Store|OnlineStore|ShoppingCenter|OnlineBusiness", "shop"),
    ("RealEstateAgent", "real_estate"), ("LegalService|Attorney|Notary", "legal"),
    ("FinancialService|BankOrCreditUnion|InsuranceAgency|AccountingService", "finance"),
    ("AutoRepair|AutoDealer|AutomotiveBusiness|AutoRental|GasStation", "automotive"),
    ("HomeAndConstructionBusiness|Plumber|Electrician|HVACBusiness|Locksmith|RoofingContractor|HousePainter|MovingCompany|GeneralContractor", "home_services"),
    ("EducationalOrganization|School|CollegeOrUniversity|Preschool", "education"), ("NGO", "nonprofit"),
    ("GovernmentOrganization|GovernmentOffice", "government"), ("PetStore", "pets"), ("NewsMediaOrganization", "news_media"),
]
#: Categories that need stronger evidence, and suffixes that name one.
BROAD_CATEGORIES = ("shop", "software", "developer", "social", "jobs", "news_media", "education")
SUFFIX_CATEGORIES = [
    (r"\.gov(?:\.[a-z]{2})?$|\.gouv\.|\.gv\.at$", "government"), (r"\.edu$|\.ac\.[a-z]{2}$", "education"),
]
BARE_SUFFIX_CATEGORIES = [
    (r"\.(?:bank|insurance)$", "finance"), (r"\.news$", "news_media"), (r"\.(?:museum|art)$", "museum_culture"),
    (r"\.(?:games|game)$", "games"),
]
#: Fixed value: words of a clothes shop.
FASHION_HINT = "cloth|fashion|shoe|sneaker|wear|apparel|jewel"


def _letter_run(word: str) -> str:
    """Longest run of a-z in a word: it must be a whole run of any text with the word."""
    import re

    return max(re.findall("[a-z]+", word) or [""], key=len)


def categorise(sites: DataFrame, words: Sequence[tuple[str, Sequence[str]]], broad: Sequence[str] = BROAD_CATEGORIES,
               types: Sequence[tuple[str, str]] = TYPE_CATEGORIES) -> DataFrame:
    """Category of every site from its type, domain and words.

    ``words`` is the dictionary: (category, its words), the most specific first. Page
    text counts once, the name twice, actions half, a word in the domain adds one.

    Counting every dictionary word in every text would run hundreds of patterns per
    row. A word can only occur where its longest letter run is a token of the text,
    so a hash intersection of tokens finds the few candidates and only those are
    counted. Everything stays inside the row: no explode, no shuffle, no Python.
    """
    flat = [(i, category, w, _letter_run(w)) for i, (category, ws) in enumerate(words) for w in ws]
    specials = r"[.*+?^${}()|\[\]\\]"
    import re

    def pattern(word: str) -> str:
        # The texts are padded with blanks, so both ends may ask for a sign that is no letter.
        return "[^a-z]" + re.sub(specials, lambda m: "\\" + m.group(0), word) + "[^a-z]"

    entry = lambda i, w, run: F.struct(
        F.lit(i).alias("ord"), F.lit(pattern(w)).alias("pattern"), F.lit(run).alias("run"),
        F.lit(w).alias("word"), F.lit(re.sub(r"\s+", "", w)).alias("joined"),
    )
    dictionary = F.array(*[entry(i, w, run) for i, _, w, run in flat])
    names = F.array(*[F.lit(c) for c, _ in words])
    runs = F.array(*[F.lit(r) for r in sorted({r for *_, r in flat})])
    thick = F.array(*[F.lit(c in broad) for c, _ in words])

    lowered = settle(
        sites,
        F.lower(F.coalesce("name", F.lit(""))).alias("_name"),
        F.lower(F.coalesce("page_text", F.lit(""))).alias("_pages"),
        F.lower(F.coalesce("action_text", F.lit(""))).alias("_actions"),
        without_www(F.col("domain")).alias("_bare"),
    )
    seen = F.array_intersect(F.split(F.concat_ws(" ", "_pages", "_name", "_actions"), "[^a-z]+"), runs)
    padded = lambda c: F.concat(F.lit(" "), c, F.lit(" "))
    staged = settle(
        lowered, seen.alias("_seen"), padded("_pages").alias("_p"), padded("_name").alias("_n"), padded("_actions").alias("_a")
    )
    in_domain = lambda w: F.col("_bare").contains(w["joined"]) & (F.length(w["word"]) >= 4)
    candidates = F.filter(dictionary, lambda w: F.array_contains("_seen", w["run"]) | in_domain(w))
    occurrences = lambda text, w: F.size(F.regexp_extract_all(text, w["pattern"], F.lit(0)))
    counted = F.transform(
        candidates,
        lambda w: F.struct(
            w["ord"].alias("ord"),
            (
                occurrences(F.col("_p"), w)
                + occurrences(F.col("_n"), w) * 2
                + occurrences(F.col("_a"), w) * 0.5
                + F.when(in_domain(w), 1).otherwise(0)
            ).alias("score"),
        ),
    )
    short = F.length("_pages") < 400

    def total(c: Column, i: Column) -> Column:
        score = F.aggregate(
            F.filter(F.col("_hits"), lambda h: h["ord"] == i), F.lit(0.0), lambda acc, h: acc + h["score"]
        )
        need = F.when(F.get(thick, i), F.when(short, 2).otherwise(3)).otherwise(F.when(short, 1).otherwise(2))
        return let(score, lambda s: F.when(s >= need, F.struct(s.alias("score"), (-i).alias("minus"), c.alias("category"))))

    by_words = F.array_max(F.array_compact(F.transform(names, total)))["category"]
    label = F.regexp_replace(F.regexp_replace(F.col("_bare"), r"\.[a-z.]+$", ""), "[-_.]", " ")
    by_label = F.try_element_at(
        F.array_compact(
            F.array(
                *[
                    F.when(label.contains(w), F.lit(c))
                    for c, ws in words
                    if c not in broad
                    for w in ws
                    if len(w) >= 4 and " " not in w
                ]
            )
        ),
        F.lit(1),
    )
    category = None
    for pattern_, name in types:
        test = F.col("business_type").rlike(f"^(?:{pattern_})$")
        category = F.when(test, name) if category is None else category.when(test, name)
    for pattern_, name in SUFFIX_CATEGORIES:
        category = category.when(F.col("domain").rlike(pattern_), name)
    sells = F.col("_bare").rlike(r"\.(?:shop|store|boutique)$") | F.coalesce("action_ids", F.lit("")).rlike(
        "(?<![A-Za-z0-9_])(?:view_cart|add_to_cart|checkout)(?![A-Za-z0-9_])"
    )
    category = category.when(sells & F.concat_ws(" ", "_name", "_pages").rlike(FASHION_HINT), "shop_fashion")
    for pattern_, name in BARE_SUFFIX_CATEGORIES:
        category = category.when(F.col("_bare").rlike(pattern_), name)
    empty = (strip_blank(F.col("_pages")) == "") | strip_blank(F.col("_pages")).startswith("website at ")
    category = category.when(empty, by_label).otherwise(by_words)
    return settle(staged, counted.alias("_hits")).select(*sites.columns, category.alias("found_category"))


def fill_categories(sites: DataFrame, found: DataFrame) -> DataFrame:
    """Write found categories where none is set; "" marks sites tried without success.

    Returns changed rows only: domain, old and new category.
    """
    new = found.select("domain", F.col("found_category").alias("_new"))
    joined = sites.where(F.col("category").isNull() | (F.col("category") == "")).select("domain", "category").join(new, "domain")
    target = F.when(F.col("category").isNull(), F.coalesce("_new", F.lit(""))).otherwise(F.coalesce("_new", F.col("category")))
    return joined.withColumn("new_category", target).where(~F.col("new_category").eqNullSafe(F.col("category"))).select(
        "domain", "category", "new_category"
    )


def accept_labels(sites: DataFrame, labels: DataFrame, allowed: Sequence[str]) -> DataFrame:
    """Labels from outside that are allowed and differ from what is stored."""
    return (
        sites.select("domain", "category")
        .join(labels.select("domain", "label"), "domain")
        .where(F.col("label").isin(*allowed) & ~F.col("label").eqNullSafe(F.col("category")))
    )


# --- duplicates -----------------------------------------------------------------------------


def duplicate_copies(sites: DataFrame, key: str, hash_column: str, *best_first: Column, hot_rows: int = 1_000_000) -> DataFrame:
    """Copies of the same content with the best-known original each points at.

    The original of a hash comes from a map-side combined aggregate. Attaching it to
    the copies is a join whose hot hashes are salted, so a third of all sites may
    share one parked page.
    """
    originals = keep_first(
        sites.select(hash_column, F.col(key).alias("duplicate_of"), *[c.alias(f"_o{i}") for i, c in enumerate(best_first)]),
        [hash_column],
        *[F.col(f"_o{i}") for i in range(len(best_first))],
        F.col("duplicate_of"),
        count_as="n",
    ).where(F.col("n") > 1)
    joined = join_to_unique(
        sites.select(key, hash_column), originals.select(hash_column, "duplicate_of", "n"), hash_column, F.col(key), hot_rows
    )
    return joined.where(F.col(key) != F.col("duplicate_of")).select(key, hash_column, "duplicate_of")


def www_copies(sites: DataFrame) -> DataFrame:
    """``www.`` rows whose bare domain is indexed, unless only the former is cared for."""
    cared = F.col("owner_key").isNotNull() | F.coalesce("native", F.lit(False))
    open_rows = sites.where(F.col("status").isNull())
    plain = open_rows.select(F.col("domain").alias("_bare"), cared.alias("_plain_cared"))
    www = open_rows.where(F.col("domain").startswith("www.")).select(
        "domain", F.expr("substring(domain, 5)").alias("_bare"), cared.alias("_www_cared")
    )
    return (
        www.join(plain, "_bare")
        .where(~F.col("_www_cared") | F.col("_plain_cared"))
        .select("domain", F.col("_bare").alias("duplicate_of"))
    )


def slash_copies(sites: DataFrame) -> DataFrame:
    """Rows saved with a path in the domain: copies of their host."""
    return sites.where(F.col("status").isNull() & F.col("domain").contains("/")).select(
        "domain", F.split("domain", "/")[0].alias("duplicate_of")
    )


def redirect_duplicates(redirects: DataFrame, sites: DataFrame) -> DataFrame:
    """Redirecting sites whose target is another indexed site, bare or with ``www.``."""
    target, site = without_www(F.col("target")), without_www(F.col("domain"))
    related = (
        (target == site) | target.endswith(F.concat(F.lit("."), site)) | site.endswith(F.concat(F.lit("."), target))
    )
    known = sites.select(without_www(F.col("domain")).alias("duplicate_of")).distinct()
    return redirects.where(~related).select("domain", target.alias("duplicate_of")).join(known, "duplicate_of", "left_semi")


# --- ranks, peers of lists -----------------------------------------------------------------


def rank_updates(sites: DataFrame, ranks: DataFrame) -> DataFrame:
    """New popularity ranks, with or without ``www.``; only rows that change."""
    exact = ranks.select("domain", F.col("rank").alias("_exact"))
    bare = ranks.select(F.col("domain").alias("_bare"), F.col("rank").alias("_bare_rank"))
    joined = sites.select("domain", "popularity_rank", F.regexp_replace("domain", r"^www\.", "").alias("_bare"))
    found = joined.join(exact, "domain", "left").join(bare, "_bare", "left")
    return (
        found.select("domain", "popularity_rank", F.coalesce("_exact", "_bare_rank").alias("new_rank"))
        .where(~F.col("new_rank").eqNullSafe(F.col("popularity_rank")))
    )


def not_indexed(wanted: DataFrame, *known: DataFrame) -> DataFrame:
    """Wanted domains that none of the known tables holds."""
    for frame in known:
        wanted = wanted.join(frame.select("domain"), "domain", "left_anti")
    return wanted


def has_all(container: Column, *items: str) -> Column:
    """Array containment of every given item."""
    test = F.lit(True)
    for item in items:
        test = test & F.array_contains(container, item)
    return test


# --- slimming -------------------------------------------------------------------------------


def intent_words(intent: Column, limit: int = 10) -> Column:
    """Lower-case, collapsed, distinct keywords in order."""
    cleaned = F.filter(F.transform(intent, lambda w: collapse(F.lower(w))), lambda w: w != "")
    return F.slice(F.array_distinct(cleaned), 1, limit)


def slim_actions(actions: Column) -> Column:
    """Actions without repeats of (id, url), their keywords tidied."""
    firsts = F.filter(
        actions,
        lambda a, i: ~F.exists(
            F.slice(actions, 1, i), lambda e: e["id"].eqNullSafe(a["id"]) & e["url"].eqNullSafe(a["url"])
        ),
    )
    return F.transform(firsts, lambda a: a.withField("intent", intent_words(a["intent"])))


def slim_pages(pages: Column, domain: Column) -> Column:
    """Pages without empty ones and without copies of the home page."""
    home = strip_blank(F.coalesce(F.try_element_at(pages, F.lit("/"))["content"], F.lit("")))

    def keep(path: Column, page: Column) -> Column:
        content = strip_blank(F.coalesce(page["content"], F.lit("")))
        title = strip_blank(F.coalesce(page["title"], F.lit("")))
        bare = (content == "") & ((title == "") | (title == domain))
        copy = (home != "") & (content == home)
        return (path == "/") | (~bare & ~copy)

    return F.map_filter(pages, keep)


def slim_sites(sites: DataFrame, min_saved: int = 40) -> DataFrame:
    """Editable sites that get at least ``min_saved`` characters smaller."""
    staged = fence(sites.where(editable(F.col("owner_key"), F.col("native")))).select(
        "domain", "pages", "actions", slim_pages(F.col("pages"), F.col("domain")).alias("slim_pages"),
        slim_actions(F.col("actions")).alias("slim_actions"),
    )
    size = lambda *names: sum((F.length(F.to_json(n)) for n in names), F.lit(0))
    saved = size("pages", "actions") - size("slim_pages", "slim_actions")
    return staged.withColumn("saved", saved).where(F.col("saved") >= min_saved).select("domain", "slim_pages", "slim_actions", "saved")


def byte_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Total serialised length of nested columns: (column, bytes, rows)."""
    sums = df.agg(F.count(F.lit(1)).alias("_n"), *[F.sum(F.length(F.to_json(c))).alias(c) for c in columns])
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("bytes"), F.col("_n").alias("rows")) for c in columns])
    return sums.select(F.explode(pairs).alias("p")).select("p.*")


# --- records --------------------------------------------------------------------------------

#: Names of site languages.
LANGUAGE_NAMES = {
    "de": "German", "fr": "French", "es": "Spanish", "it": "Italian", "nl": "Dutch", "pt": "Portuguese", "da": "Danish",
    "sv": "Swedish", "no": "Norwegian", "nb": "Norwegian", "fi": "Finnish", "pl": "Polish", "cs": "Czech", "ru": "Russian",
    "uk": "Ukrainian", "tr": "Turkish", "ja": "Japanese", "zh": "Chinese", "ko": "Korean", "ar": "Arabic", "he": "Hebrew",
    "hi": "Hindi", "id": "Indonesian", "vi": "Vietnamese", "th": "Thai", "el": "Greek", "hu": "Hungarian", "ro": "Romanian",
    "fa": "Persian",
}


def site_names(metadata: DataFrame) -> DataFrame:
    """Name, language and summary of a site from its home page's metadata.

    Sites in another language are described by one English sentence.
    """
    own = strip_blank(F.coalesce("site_name", F.split("title", rf"\s[|\-–—:·]\s")[0], F.lit("")))
    brand = brand_of(F.col("domain"))
    name = F.substring(F.when((own != "") & (F.length(own) <= 60), own).otherwise(brand), 1, 80)
    foreign = F.coalesce(F.col("language") != "en", F.lit(False))
    label = F.coalesce(F.create_map(*[F.lit(x) for kv in LANGUAGE_NAMES.items() for x in kv])[F.col("language")], F.col("language"))
    staged = metadata.where((F.coalesce("title", F.lit("")) != "") | F.col("description").isNotNull()).withColumn("name", name)
    line = F.concat("name", F.lit(" is a "), label, F.lit("-language website at "), F.col("domain"), F.lit("."))
    return staged.select(
        *[c for c in metadata.columns if c not in ("title", "description", "site_name", "language")],
        "name",
        F.coalesce("language", F.lit("en")).alias("language"),
        F.when(foreign, F.col("name")).otherwise(F.substring(F.coalesce(F.when(F.col("title") != "", F.col("title")), "name"), 1, 120)).alias("title"),
        F.when(foreign, line).otherwise(F.substring(F.coalesce("description", "title"), 1, 400)).alias("content"),
    )


def minimal_record(domain: Column, content: Column) -> Column:
    """Record of a site nothing usable was found for."""
    text = F.substring(clean_reader_text(F.coalesce(content, F.lit(""))), 1, 200)
    name = F.concat(F.upper(F.substring(domain, 1, 1)), F.substring(F.split(domain, r"\.")[0], F.lit(2), F.length(domain)))
    return F.struct(
        domain.alias("domain"), name.alias("name"), domain.alias("title"),
        F.when(text != "", text).otherwise(F.concat(F.lit("Website at "), domain)).alias("content"),
    )


def best_source(candidates: DataFrame) -> DataFrame:
    """First usable candidate record per domain, by source order.

    ``candidates`` has (domain, source_order, source, action_count, ...); a record is
    usable when it has actions.
    """
    usable = candidates.where(F.col("action_count") > 0)
    return keep_first(usable, ["domain"], F.col("source_order"))


def outcome_tally(outcomes: DataFrame, column: str = "outcome") -> DataFrame:
    """Number of rows per outcome."""
    return outcomes.groupBy(column).agg(F.count(F.lit(1)).alias("sites"))


def freshness(new_etag_hit: Column, new_text_hash: Column, old_text_hash: Column, new_content_hash: Column,
              old_content_hash: Column, action_count: Column) -> Column:
    """What a re-crawl found, in the order the cheap checks are made."""
    return (
        F.when(new_etag_hit, "unchanged (not modified)")
        .when(new_text_hash == old_text_hash, "unchanged (same text)")
        .when(new_content_hash.isNull(), "blocked")
        .when(new_content_hash == old_content_hash, "unchanged")
        .when(F.coalesce(action_count, F.lit(0)) == 0, "kept existing")
        .otherwise("refreshed")
    )


def round_score(column: Column, digits: int = 1) -> Column:
    """Half-up rounding used for scores."""
    return round_half_up(column, digits)


def record_hash(column: Column) -> Column:
    """Hash stored with a record to notice unchanged content."""
    return content_hash(column)
