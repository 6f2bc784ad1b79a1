"""Site documents: one nested record a site, read by path.

A document holds ``pages map<path, struct>``, ``home_path``, ``actions array<struct>``, ``business`` and
``ai_access`` structs. The accessors below name single leaves, so a scan of stored documents
reads those leaves and no page text it doesn't need: never put a whole ``pages`` column into
an expression where its keys or one field will do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hostloom.functions.patterns import percent
from hostloom.operators.keyed import keep_first, top_per_group
from hostloom.operators.sites import readiness

HOME = "/"


def assemble(records: DataFrame, pages: DataFrame, actions: DataFrame, most_pages: int = 8, most_actions: int = 6) -> DataFrame:
    """One document per row of ``records`` (unique ``domain``, any further columns).

    ``pages`` has (domain, path, page struct): of equal paths the smallest page counts, and a
    site keeps the ``most_pages`` with the shortest paths, ``/`` first; the first of them is its
    ``home_path``, and each page also holds its ``path``. ``actions`` has (domain,
    action struct with an ``id``): one per id, ``most_actions`` in order of id. Both cuts are part
    of the document's form; they are made before the shuffle, so a site with a third of all pages
    sends a few rows per task. Sites without pages or actions get empty ones; rows without domain
    or path are left out.
    """
    named = pages.where(F.col("domain").isNotNull() & F.col("path").isNotNull()).select("domain", "path", F.col("page").withField("path", F.col("path")).alias("page"))
    order = [F.col("path") != HOME, F.length("path"), F.col("path")]
    kept = top_per_group(keep_first(named, ["domain", "path"], F.col("page")), ["domain"], order, most_pages)
    by_site = kept.groupBy("domain").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("path", "page")))).alias("pages"), F.min_by("path", F.struct(*order)).alias("home_path")
    )

    acts = actions.where(F.col("domain").isNotNull() & F.col("action.id").isNotNull()).select("domain", F.col("action.id").alias("_id"), "action")
    few = top_per_group(keep_first(acts, ["domain", "_id"], F.col("action")), ["domain"], [F.col("_id")], most_actions)
    listed = few.groupBy("domain").agg(F.transform(F.array_sort(F.collect_list(F.struct("_id", "action"))), lambda a: a["action"]).alias("actions"))

    none_p = F.from_json(F.lit("{}"), by_site.schema["pages"].dataType)
    none_a = F.array().cast(listed.schema["actions"].dataType)
    joined = records.join(by_site, "domain", "left").join(listed, "domain", "left")
    return joined.select(*records.columns, F.coalesce("pages", none_p).alias("pages"), "home_path", F.coalesce("actions", none_a).alias("actions"))


def page_field(path: Column | str, field: str, pages: str = "pages") -> Column:
    """A field of one page, NULL where the site has no such page; the scan reads this field alone."""
    return F.col(pages)[path][field]


def home_content(pages: str = "pages", home: str = "home_path") -> Column:
    """Content of the page that ``home_path`` names.

    Looked up among the pages' own ``path`` fields: a map key that isn't a constant, or the
    map's keys, would make the scan read whole pages.
    """
    every = F.map_values(F.col(pages))
    return F.get(every["content"], F.array_position(every["path"], F.col(home)).cast("int") - 1)


def page_count(pages: str = "pages") -> Column:
    """Number of pages, counted on the one field that the home page needs anyway."""
    return F.size(F.map_values(pages)["content"])


def executable() -> Column:
    """The site's own document has an action that can be called."""
    return F.col("native") & F.exists(F.col("actions.endpoint.url"), lambda u: u.isNotNull())


def states_hours() -> Column:
    """The business details hold opening hours."""
    return F.col("business.opening_hours").isNotNull()


def blocks_bots() -> Column:
    """The checked access rules shut out at least one bot."""
    return F.coalesce(F.size("ai_access.blocked") > 0, F.lit(False))


def is_placeholder() -> Column:
    """The home page says no more than that there is a site."""
    return F.coalesce(page_field(F.lit(HOME), "content").like("Website at %"), F.lit(False))


def comes_from(source: str) -> Column:
    """The business details come from the named source."""
    return F.coalesce(F.col("business.source") == source, F.lit(False))


def with_readiness(documents: DataFrame) -> DataFrame:
    """(domain, score, label, passed) of every document, from the leaves that the checks need."""
    r = readiness(
        home_content(), page_count(), F.size("actions.id"), F.coalesce("native", F.lit(False)), F.coalesce(executable(), F.lit(False)),
        F.col("business").isNotNull(),
    )
    return documents.select("domain", r.alias("_r")).select("domain", "_r.score", "_r.label", "_r.passed")


def predicates(documents: DataFrame, tests: dict[str, Column]) -> DataFrame:
    """(predicate, domain) for every test a document passes: one scan for all tests, no shuffle."""
    found = F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in tests.items()]))
    return documents.select(F.explode(found).alias("predicate"), "domain")


def index_totals(documents: DataFrame, items: DataFrame, pages: DataFrame, events: DataFrame, searches: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    """The thirteen counts of the weekly report over its five tables, one aggregate per table.

    ``documents`` also has ``status`` and ``first_seen_at``, ``events`` a ``start_date`` and
    ``searches`` a ``created_at``. Only counts leave the scans.
    """
    since = as_of - F.make_dt_interval(days=F.lit(days))
    visible, acts = F.col("status").isNull(), F.size("actions.id")
    one = F.count(F.lit(1)).alias("n")
    counts = documents.agg(
        F.count_if(visible).alias("sites"),
        F.count_if(visible & (acts > 0)).alias("readable"),
        F.count_if(F.col("native")).alias("native"),
        F.count_if(visible & (acts == 0)).alias("minimal"),
        F.count_if(F.col("business").isNotNull()).alias("with_business"),
        F.count_if(states_hours()).alias("with_hours"),
        F.count_if(F.col("ai_access").isNotNull()).alias("checked_access"),
        F.count_if(blocks_bots()).alias("blocking_bots"),
        F.count_if(F.col("first_seen_at") >= since).alias("new_sites"),
    )
    others = {
        "items": items.agg(one), "pages": pages.agg(one), "upcoming_events": events.where(F.col("start_date") >= as_of).agg(one),
        "searches": searches.where(F.col("created_at") >= since).agg(one),
    }
    for name, total in others.items():
        counts = counts.withColumn(name, total.scalar())
    return counts.withColumn("readable_percent", percent(F.col("readable"), F.col("sites"))).withColumn(
        "blocking_percent", percent(F.col("blocking_bots"), F.col("checked_access"))
    )
