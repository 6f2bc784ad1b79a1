"""Catalogue: crawled pages and page texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from hostloom.functions import text as T
from hostloom.functions import urls as U
from hostloom.operators import pages as P
from hostloom.operators.keyed import settle
from hostloom.plans import roles
from hostloom.plans.registry import query, shared
from hostloom.plans.roles import spread, table

# SQL pieces (RE2): the same white-space class, no look-around.
_B = r"\s\x{000b}\x{00a0}\x{feff}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def _squeeze(expr: str) -> str:
    return f"regexp_replace(regexp_replace({expr}, '[{_B}]+', ' ', 'g'), '^ | $', '', 'g')"


def _trim(expr: str) -> str:
    return f"regexp_replace({expr}, '^[{_B}]+|[{_B}]+$', '', 'g')"


def _fill(template: str, **values: object) -> str:
    """Put values into a text whose other braces belong to patterns."""
    for name, value in values.items():
        template = template.replace("{" + name + "}", str(value))
    return template


def _drop(expr: str, *names: str) -> str:
    for name in names:
        expr = f"regexp_replace({expr}, '(?is)<{name}.*?</{name}>', ' ', 'g')"
    return expr


def _tags(expr: str) -> str:
    return f"regexp_replace({expr}, '<[^>]+>', ' ', 'g')"


def _entities(expr: str) -> str:
    for old, new in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&#039;", "''"), ("&apos;", "''"), ("&nbsp;", " ")):
        expr = f"replace({expr}, '{old}', '{new}')"
    return expr


def _link_text(expr: str) -> str:
    return _squeeze(_entities(_tags(_drop(expr, "script", "style", "noscript"))))


@query(
    "ranked_admissible_hosts",
    r"""SELECT domain, CAST(min(page_id + 1) AS BIGINT) AS rank FROM (
          SELECT page_id, lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]+)', 1)) AS domain FROM pages)
        WHERE regexp_matches(domain, '^[a-z0-9.-]+\.[a-z]{2,}$') AND NOT domain LIKE '%.net'
          AND NOT regexp_matches(domain || '.', '(^|\.)(spam-farm|ththin)\.') GROUP BY domain""",
)
def ranked_admissible_hosts(spark, sf):
    ranks = table(spark, sf, "pages").select((F.col("page_id") + 1).alias("rank"), U.host_of(F.col("url")).alias("domain"))
    # Host labels of this corpus stand in for the infrastructure list.
    return P.ranked_domains(ranks, skipped_suffixes=(".net",), infrastructure=r"(?:^|\.)(?:spam-farm|ththin)\.")


@query(
    "page_text_hash",
    "SELECT page_id, substring(sha256("
    + _squeeze(
        "regexp_replace("
        + _tags("regexp_replace(" + _drop("html", "script", "style", "noscript", "svg", "template") + ", '(?s)<!--.*?-->', ' ', 'g')")
        + ", '(?i)&[a-z#0-9]+;', ' ', 'g')"
    )
    + "), 1, 32) AS text_hash FROM pages",
)
def page_text_hash(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.visible_text_hash(F.col("html")).alias("text_hash"))


@query(
    "page_text",
    "SELECT page_id, length(t) AS chars, md5(t) AS text_md5 FROM (SELECT page_id, "
    + _squeeze("replace(replace(" + _tags(_drop("html", "script", "style", "noscript", "svg")) + ", '&nbsp;', ' '), '&amp;', '&')")
    + " AS t FROM pages)",
)
def page_text(spark, sf):
    text = table(spark, sf, "pages").select("page_id", T.html_to_text(F.col("html"), "summary").alias("t"))
    return text.select("page_id", F.length("t").cast("bigint").alias("chars"), F.md5("t").alias("text_md5"))


@query(
    "page_metadata",
    "SELECT page_id, " + _link_text("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)") + " AS title, "
    "list_filter(list_transform(regexp_extract_all(html, '(?is)<p[^>]*>(.*?)</p>', 1), lambda p: " + _link_text("p") + "), "
    "lambda p: length(p) > 60)[1] AS description, "
    """lower(regexp_extract(html, '(?i)<html[^>]+lang=["'']([a-z]{2})', 1)) AS language FROM pages""",
)
def page_metadata(spark, sf):
    return P.page_metadata(table(spark, sf, "pages").drop("url")).drop("site_name")


_LINK_RE = """(?is)<a[^>]+href=["'']([^"''#]+)["''][^>]*>(.*?)</a>"""
shared(
    "links_cte",
    f"""SELECT page_id, domain, unnest(range(len(h))) AS pos, unnest(h) AS href, unnest(t) AS label FROM (
          SELECT page_id, domain, list_transform(regexp_extract_all(html, '{_LINK_RE}', 1), lambda x: {_entities("x")}) AS h,
            list_transform(regexp_extract_all(html, '{_LINK_RE}', 2), lambda x: {_link_text("x")}) AS t FROM crawled)""",
)


@query("page_links", "SELECT page_id, domain, CAST(pos AS INTEGER) AS pos, href, label FROM links_cte")
def page_links(spark, sf):
    return P.page_links(roles.crawled(spark, sf).drop("url"))


@query(
    "resolved_links",
    r"""SELECT page_id, CAST(pos AS INTEGER) AS pos, regexp_extract(url, '^([A-Za-z]+://[^/?#]*)', 1) || href AS target
        FROM links_cte JOIN pages USING (page_id) WHERE href LIKE '/%'""",
)
def resolved_links(spark, sf):
    links = P.page_links(roles.crawled(spark, sf)).where(F.col("href").startswith("/"))
    return links.select("page_id", "pos", U.resolve(F.col("href"), F.col("url")).alias("target"))


# Words that occur in this corpus take the place of the production rules.
_RULES = [
    ("book", "Book", "the|and", "the"),
    ("shop", "Shop products", "que|des", "que|des"),
    ("contact", "Contact", "para|los", "para|los"),
    ("help", "Get help", "und|der", "und|die"),
]


@query(
    "page_actions",
    """WITH l AS (SELECT page_id, lower(href) AS path, label FROM links_cte),
       hit AS (
         SELECT page_id, 0 AS ord, 'book' AS id, 'Book' AS name FROM l
           WHERE regexp_matches(path, '/(the|and)(/?$|\\?)') OR regexp_matches(label, '(?i)^(the)$')
         UNION ALL SELECT page_id, 1, 'shop', 'Shop products' FROM l
           WHERE regexp_matches(path, '/(que|des)(/|$)') OR regexp_matches(label, '(?i)^(que|des)$')
         UNION ALL SELECT page_id, 2, 'contact', 'Contact' FROM l
           WHERE regexp_matches(path, '/(para|los)(/|$)') OR regexp_matches(label, '(?i)^(para|los)$')
         UNION ALL SELECT page_id, 3, 'help', 'Get help' FROM l
           WHERE regexp_matches(path, '/(und|der)(/|$)') OR regexp_matches(label, '(?i)^(und|die)$')),
       d AS (SELECT DISTINCT page_id, ord, id, name FROM hit)
       SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY ord) - 1 AS INTEGER) AS pos, id, name FROM d
       QUALIFY pos < 3""".replace("\\\\", "\\"),
)
def page_actions(spark, sf):
    out = P.page_actions(roles.crawled(spark, sf).drop("url"), rules=_RULES, limit=3)
    return out.select("page_id", "pos", "id", "name")


_PROVIDERS_SQL = """WITH p AS (SELECT c_custkey AS k, 'c' || c_custkey || '.example' AS domain,
    ['calendly.com/c', 'www.opentable.co.uk/r', 'wolt.com/en/v', 'cal.com/', 'm.facebook.com/c'][c_custkey % 5 + 1] AS a,
    ['book.resy.com/x', 'deliveroo.fr/menu', 'calendly.com/c'][c_custkey % 3 + 1] AS b FROM customer),
  u AS (SELECT k, domain, 0 AS o, 'https://' || a || CASE WHEN a LIKE '%/' THEN '' ELSE CAST(k AS VARCHAR) END AS url FROM p
    UNION ALL SELECT k, domain, 1, 'https://' || b || k FROM p),
  n AS (SELECT *, CASE WHEN url LIKE 'https://calendly%' THEN 'Calendly' WHEN url LIKE '%opentable%' THEN 'OpenTable'
      WHEN url LIKE '%wolt%' THEN 'Wolt' WHEN url LIKE '%resy%' THEN 'Resy' WHEN url LIKE '%deliveroo%' THEN 'Deliveroo' END AS provider
    FROM u),
  f AS (SELECT * FROM n WHERE provider IS NOT NULL QUALIFY row_number() OVER (PARTITION BY k, provider ORDER BY o) = 1)"""


def _provider_pages(spark, sf):
    k = F.col("c_custkey")
    pick = lambda names, n: F.element_at(F.array(*[F.lit(x) for x in names]), (k % n + 1).cast("int"))
    a = pick(["calendly.com/c", "www.opentable.co.uk/r", "wolt.com/en/v", "cal.com/", "m.facebook.com/c"], 5)
    b = pick(["book.resy.com/x", "deliveroo.fr/menu", "calendly.com/c"], 3)
    key = k.cast("string")
    return spread(spark, sf, "customer").select(
        F.concat(F.lit("c"), key, F.lit(".example")).alias("domain"),
        F.concat(
            F.lit('<body><a href="https://'), a, F.when(a.endswith("/"), "").otherwise(key), F.lit('">Go</a> <iframe src="https://'),
            b, key, F.lit('"></iframe></body>'),
        ).alias("html"),
    )


@query(
    "booking_links",
    _PROVIDERS_SQL
    + """ SELECT domain, provider, CASE WHEN provider IN ('Wolt', 'Deliveroo') THEN 'order' ELSE 'book' END AS kind, url FROM f""",
)
def booking_links(spark, sf):
    found = _provider_pages(spark, sf).select("domain", F.explode(P.booking_links(F.col("html"))).alias("b"))
    return found.select("domain", "b.provider", "b.kind", "b.url")


@query(
    "actions_with_booking",
    _PROVIDERS_SQL
    + """, g AS (SELECT k, domain, CASE WHEN provider IN ('Wolt', 'Deliveroo') THEN 'order' ELSE 'book' END AS kind, o, url FROM f),
         h AS (SELECT k, domain, kind, arg_min(url, o) AS url, min(o) AS o FROM g GROUP BY ALL)
       SELECT 'c' || c_custkey || '.example' AS domain, concat_ws(' ',
         (SELECT string_agg(kind || '=' || url, ' ' ORDER BY o DESC) FROM h WHERE h.k = c_custkey AND kind = 'order'),
         'reserve_table=' || coalesce((SELECT url FROM h WHERE h.k = c_custkey AND kind = 'book'), '-')) AS actions
       FROM customer""",
)
def actions_with_booking(spark, sf):
    stored = F.array(
        F.struct(F.lit("reserve_table").alias("id"), F.lit("Reserve").alias("name"), F.lit(None).cast("string").alias("url"))
    )
    merged = P.with_booking_links(stored, P.booking_links(F.col("html")))
    shown = F.transform(merged, lambda a: F.concat(a["id"], F.lit("="), F.coalesce(a["url"], F.lit("-"))))
    return _provider_pages(spark, sf).select("domain", F.array_join(shown, " ").alias("actions"))


def _sitemaps(spark, sf):
    key = F.col("p_partkey")
    host = F.concat(F.lit("s"), (key % 50).cast("string"), F.lit(".example"))
    word = F.regexp_replace("p_name", " ", "-")
    entry = lambda path: F.concat(F.lit("<url><loc>https://www."), host, path, F.lit("</loc></url>"))
    return spread(spark, sf, "part").select(
        host.alias("domain"),
        key.alias("file_no"),
        F.concat(
            F.lit("<urlset>"),
            entry(F.concat(F.lit("/"), word)),
            entry(F.concat(F.lit("/range/"), word, F.lit("/"))),
            entry(F.concat(F.lit("/blog/"), word)),
            F.lit("</urlset>"),
        ).alias("body"),
    )


@query(
    "useful_paths",
    """WITH loc AS (SELECT 's' || (p_partkey % 50) || '.example' AS domain, p_partkey * 3 AS pos, '/' || replace(p_name, ' ', '-') AS path FROM part
         UNION ALL SELECT 's' || (p_partkey % 50) || '.example', p_partkey * 3 + 1, '/range/' || replace(p_name, ' ', '-') FROM part),
       typed AS (SELECT *, string_split(regexp_extract(path, '([^/]*)$', 1), '-') AS w, len(string_split(path, '/')) - 1 AS depth FROM loc),
       s AS (SELECT domain, path, min(pos) AS pos, any_value(CASE WHEN list_has_any(w, ['ring']) THEN 'ring'
           WHEN list_has_any(w, ['widget', 'bolt']) THEN 'parts' WHEN list_has_any(w, ['red', 'blue']) THEN 'colour' END) AS type,
         any_value(CASE WHEN list_has_any(w, ['ring']) THEN 9 WHEN list_has_any(w, ['widget', 'bolt']) THEN 7
           WHEN list_has_any(w, ['red', 'blue']) THEN 5 END - (depth - 1) * 2) AS score FROM typed GROUP BY domain, path),
       t AS (SELECT * FROM s WHERE type IS NOT NULL AND score > 0
         QUALIFY row_number() OVER (PARTITION BY domain, type ORDER BY score DESC, length(path), pos, path) <= 2)
       SELECT domain, path, type, CAST(score AS INTEGER) AS score, CAST(row_number() OVER (
         PARTITION BY domain ORDER BY score DESC, length(path), pos, path) AS INTEGER) AS place FROM t QUALIFY place <= 4""",
)
def useful_paths(spark, sf):
    maps = _sitemaps(spark, sf)
    locations = maps.select("domain", "file_no", F.posexplode(P.sitemap_locations(F.col("body"))).alias("n", "url")).select(
        "domain", "url", (F.col("file_no") * 3 + F.col("n")).alias("pos")
    )
    types = [("ring", 9, ["ring"]), ("parts", 7, ["widget", "bolt"]), ("colour", 5, ["red", "blue"])]
    return P.useful_paths(locations, types=types, per_site=4)


@query(
    "sitemap_children",
    """WITH e AS (SELECT s_suppkey, 's' || s_suppkey || '.example' AS domain, unnest(range(5)) AS pos,
         unnest(['posts', 'page-a', 'x', 'main', 'site']) AS n FROM supplier)
       SELECT domain, CAST(pos AS INTEGER) AS pos, 'https://' || domain || '/' || n || s_suppkey || '.xml' AS url FROM (
         SELECT *, row_number() OVER (PARTITION BY domain ORDER BY
           CASE WHEN regexp_matches('https://' || domain || '/' || n || s_suppkey || '.xml', '(?i)page|main|site') THEN 0 ELSE 1 END, pos) AS r FROM e)
       WHERE r <= 2""",
)
def sitemap_children(spark, sf):
    key = F.col("s_suppkey").cast("string")
    domain = F.concat(F.lit("s"), key, F.lit(".example"))
    body = F.concat(
        F.lit("<sitemapindex>"),
        *[F.concat(F.lit("<loc> https://"), domain, F.lit(f"/{n}"), key, F.lit(".xml </loc>")) for n in ("posts", "page-a", "x", "main", "site")],
    )
    maps = table(spark, sf, "supplier").select(domain.alias("domain"), body.alias("body"))
    return P.sitemap_children(maps, k=2)


@query(
    "robots_sitemaps",
    """SELECT s_suppkey, CAST(n AS INTEGER) AS pos, 'https://s' || s_suppkey || '.example/' || n || '.xml' AS url
       FROM supplier, (SELECT unnest(range(3)) AS n)""",
)
def robots_sitemaps(spark, sf):
    key = F.col("s_suppkey").cast("string")
    lines = F.concat(
        F.lit("User-agent: *\n"),
        *[F.concat(F.lit("  Sitemap: https://s"), key, F.lit(f".example/{n}.xml\r\n")) for n in range(4)],
    )
    return table(spark, sf, "supplier").select("s_suppkey", F.posexplode(P.robots_sitemaps(lines)).alias("pos", "url"))


# --- documents ------------------------------------------------------------------------------

_NOISE = [
    r"(?i)\b(use|using|uses|set|sets|store|stores|place|places)( of)? cookies\b",
    r"^[A-Za-z]{2,12}[.!]?$",
    r"(?i)\bcookies?\b.*\b(use|accept|consent|settings|preferences|policy|partners|improve|experience|personali[sz]e|analytics|advertis)",
    r"(?i)\b(accept|reject|decline|allow) (all|cookies|necessary|essential)\b",
    r"(?i)\b(manage|customi[sz]e) (your )?(cookie|privacy|consent) (settings|preferences|choices)\b",
    r"(?i)\bwe (and our partners )?(use|store|process) (cookies|personal data|data)\b",
    r"(?i)\byour privacy (choices|is important)\b",
    r"(?i)^(no,? thanks|yes,? that''?s fine|ok(ay)?,? got it|got it|accept|dismiss|close)\.?$",
    r"(?i)\bskip to (main )?content\b",
    r"(?i)\b(toggle|open|close) (navigation|menu)\b",
    r"(?i)\bsubscribe to our newsletter\b|\bsign up for our newsletter\b",
    rf"(?i)^(©|copyright)[{_B}]?\d{{4}}|all rights reserved",
    r"(?i)\bthis site is protected by recaptcha\b",
    r"(?i)\byou (need to|must) enable javascript\b|\bplease enable javascript\b",
    r"(?i)\byour browser (is|does not)\b.*\b(support|outdated)",
]
_NOISY_SQL = " OR ".join(f"regexp_matches({_trim('x')}, '{p}')" for p in _NOISE)


def _sql_chain(expr: str, *steps: tuple[str, str]) -> str:
    for pattern, by in steps:
        expr = f"regexp_replace({expr}, '{pattern}', '{by}', 'g')"
    return expr


shared(
    "noisy_docs",
    """SELECT doc_id, lang, CASE doc_id % 4
           WHEN 0 THEN 'Skip to content Back to top. ' || text || ' We use cookies to improve the page. © 2024 Someone.'
           WHEN 1 THEN 'Title: T' || doc_id || chr(10) || 'Markdown Content:' || chr(10) || text || ' [more](https://a.example/x) ## end'
           WHEN 2 THEN 'Home Shop About Contact Login Cart Help News Jobs Press Team Blog ' || text
           ELSE text END AS text FROM documents""",
)


def _noisy_docs(spark, sf):
    doc = F.col("doc_id")
    return table(spark, sf, "documents").select(
        "doc_id",
        "lang",
        F.when(doc % 4 == 0, F.concat(F.lit("Skip to content Back to top. "), "text", F.lit(" We use cookies to improve the page. © 2024 Someone.")))
        .when(doc % 4 == 1, F.concat(F.lit("Title: T"), doc.cast("string"), F.lit("\nMarkdown Content:\n"), "text", F.lit(" [more](https://a.example/x) ## end")))
        .when(doc % 4 == 2, F.concat(F.lit("Home Shop About Contact Login Cart Help News Jobs Press Team Blog "), "text"))
        .otherwise(F.col("text"))
        .alias("text"),
    )


_HEADER = r"(?m)^(Title|URL Source|Published Time|Warning|Markdown Content):.*$"
_READER_STEPS = (
    (_HEADER, " "),
    (r"!\[[^\]]*\]\([^)]*\)", " "),
    (r"\[([^\]]*)\]\([^)]*\)", r"\1"),
    (rf"https?://[^{_B}]+", " "),
)
_BODY = "CASE WHEN regexp_matches(text, '^\\s*Title:') AND instr(text, 'Markdown Content:') > 0 THEN substring(text, instr(text, 'Markdown Content:') + 17) ELSE text END"


@query(
    "clean_documents",
    f"""WITH a AS (SELECT doc_id, text, {_sql_chain(_BODY, *_READER_STEPS, (rf'(?m)^[{_B}]*[-*+][{_B}]+', ' '))} AS t FROM noisy_docs),
        b AS (SELECT doc_id, text, replace(regexp_replace(regexp_replace(t, '([{_B}])', chr(2) || '\\1', 'g') || chr(2),
            '(^|[{_B}])(#{{1,6}}|\\*{{1,3}}|>|`{{1,3}}|={{2,}}|-{{3,}}|_{{2,}})' || chr(2), ' ' || chr(2), 'g'), chr(2), '') AS o FROM a),
        c AS (SELECT doc_id, text, {_squeeze(_sql_chain('o', (r'\*\*(.+?)\*\*', r'\1'), (r'__(.+?)__', r'\1')))} AS o FROM b),
        d AS (SELECT doc_id, text, o, CASE WHEN regexp_matches(o, '(?i)cookie|consent') THEN regexp_replace(o,
              '(?i)\\b(no,? thanks|yes,? that[’'']?s fine|(accept|reject|allow|decline) all( cookies)?|accept cookies|ok(ay)?,? got it|manage (cookie )?preferences|cookie settings)\\b[.!]?', ' ', 'g') ELSE o END AS t FROM c),
        e AS (SELECT doc_id, text, o, {_squeeze("regexp_replace(regexp_replace(t, '(?i)" + r"\b(skip to (the )?(main )?content|skip to navigation|skip to footer|enable accessibility for (low vision|the visually impaired|visually impaired|blind users|keyboard navigation|screen readers?|[a-z]+)|open the accessibility menu|accessibility (menu|statement|tools)|toggle (navigation|menu)|open menu|close menu|main menu|back to top)\b[.:]?" + r"', ' ', 'g'), '\b(?:[A-Z][a-z]{1,12} ){10,}([A-Z])', '\1', 'g')")} AS t FROM d),
        s AS (SELECT doc_id, text, o, string_split(regexp_replace(regexp_replace(t, '([.!?])[{_B}]+([A-Z0-9"“(©])', '\\1' || chr(1) || '\\2', 'g'),
              '([.!?])[{_B}]+([A-Z0-9"“(©])', '\\1' || chr(1) || '\\2', 'g'), chr(1)) AS parts FROM e),
        k AS (SELECT doc_id, text, o, {_squeeze("array_to_string(list_filter(parts, lambda x: NOT (" + _NOISY_SQL + ")), ' ')")} AS kept FROM s)
        SELECT doc_id, length(r) AS chars, md5(r) AS text_md5 FROM (SELECT doc_id, CASE WHEN length(kept) >= 20 THEN kept
          WHEN length(o) >= 20 THEN o ELSE {_squeeze('text')} END AS r FROM k)""",
)
def clean_documents(spark, sf):
    cleaned = _noisy_docs(spark, sf).select("doc_id", T.clean_page_text(F.col("text")).alias("t"))
    return cleaned.select("doc_id", F.length("t").cast("bigint").alias("chars"), F.md5("t").alias("text_md5"))


@query(
    "reader_snippets",
    f"""SELECT doc_id, md5({_squeeze(_sql_chain('text', *_READER_STEPS, (r'[#*_>`|]+', ' ')))}) AS text_md5 FROM noisy_docs""",
)
def reader_snippets(spark, sf):
    return _noisy_docs(spark, sf).select("doc_id", F.md5(T.clean_reader_text(F.col("text"))).alias("text_md5"))


@query(
    "summary_audit",
    f"""WITH t AS (SELECT doc_id, lang, {_trim("CASE WHEN doc_id % 50 = 0 THEN '  ' WHEN doc_id % 50 = 1 THEN 'Website at x' WHEN doc_id % 50 = 2 THEN 'Please log in to continue with this very long page of ours' WHEN doc_id % 50 = 3 THEN 'Это очень длинное описание магазина на русском языке для проверки' ELSE text END")} AS s,
            CASE WHEN doc_id % 2 = 0 THEN 'en' ELSE lang END AS l FROM documents),
        r AS (SELECT CASE WHEN s = '' THEN 'empty' WHEN s LIKE 'Website at %' OR length(s) < 40 THEN 'too short'
            WHEN regexp_matches(substring(s, 1, 120), '(?i)cookie|javascript|enable js|skip to|accept all|sign in to|log in to|404|not found|access denied|captcha|just a moment|checking your browser') THEN 'boilerplate'
            WHEN length(regexp_replace(s, '[^\\p{{L}}]', '', 'g')) > 20 AND length(regexp_replace(s, '[^a-zA-Z]', '', 'g')) / length(regexp_replace(s, '[^\\p{{L}}]', '', 'g')) < 0.6 THEN 'not English'
            WHEN l = 'en' AND regexp_matches(' ' || s || ' ', '(?i) (und|der|die|les|des|et|el|los|het|och|og) ')
              AND NOT regexp_matches(' ' || s || ' ', '(?i) (the|and|of|for|with) ') THEN 'not English' ELSE 'fine' END AS reason FROM t)
        SELECT reason, count(*) AS summaries FROM r GROUP BY reason""",
)
def summary_audit(spark, sf):
    doc = F.col("doc_id") % 50
    summary = (
        F.when(doc == 0, "  ")
        .when(doc == 1, "Website at x")
        .when(doc == 2, "Please log in to continue with this very long page of ours")
        .when(doc == 3, "Это очень длинное описание магазина на русском языке для проверки")
        .otherwise(F.col("text"))
    )
    language = F.when(F.col("doc_id") % 2 == 0, "en").otherwise(F.col("lang"))
    reason = F.coalesce(P.bad_summary(summary, language), F.lit("fine"))
    return table(spark, sf, "documents").groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("summaries"))


@query(
    "parked_pages",
    r"""WITH t AS (SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN 'Buy this domain today. ' || text WHEN doc_id % 9 = 1 THEN 'Page not found'
            WHEN doc_id % 9 = 2 THEN text || ' Buy this domain' ELSE text END AS s FROM documents)
        SELECT doc_id FROM t WHERE regexp_matches(substring(s, 1, 1500), '(?i)\b(this domain (is|may be) for sale|buy this domain|domain for sale|parked (free|domain)|is parked|domain has expired|renew (this|your) domain)\b')
          OR (length(s) < 400 AND regexp_matches(s, '(?i)\b(404|page not found|access denied|forbidden|just a moment|checking your browser|attention required|enable javascript and cookies|account suspended|bandwidth limit exceeded)\b'))""",
)
def parked_pages(spark, sf):
    doc = F.col("doc_id") % 9
    shown = (
        F.when(doc == 0, F.concat(F.lit("Buy this domain today. "), "text"))
        .when(doc == 1, "Page not found")
        .when(doc == 2, F.concat("text", F.lit(" Buy this domain")))
        .otherwise(F.col("text"))
    )
    return table(spark, sf, "documents").where(P.is_parked_or_error(shown)).select("doc_id")


_PARTS = f"""SELECT {{id}}, i, p FROM (SELECT {{id}}, unnest(range(len(l))) AS i, unnest(l) AS p FROM (
    SELECT {{id}}, list_transform(string_split_regex({{text}}, '\\n+'), lambda x: {_squeeze("x")}) AS l FROM {{src}}))"""
_BUDGET = """, u AS (SELECT {id}, p, min(i) AS i FROM parts WHERE {keep} GROUP BY {id}, p),
    n AS (SELECT {id}, p, length(p) AS c, row_number() OVER (PARTITION BY {id} ORDER BY i) AS j,
        sum(length(p)) OVER (PARTITION BY {id} ORDER BY i) AS through FROM u),
    o AS (SELECT *, min(CASE WHEN through + greatest(j - 2, 0) > {budget} THEN j END) OVER (PARTITION BY {id}) AS stop FROM n),
    r AS (SELECT {id}, string_agg(p, ' ' ORDER BY j) AS content FROM o WHERE stop IS NULL OR j < stop GROUP BY {id})"""


@query(
    "policy_paragraphs",
    "WITH parts AS ("
    + _fill(_PARTS, id="doc_id", text="text", src="documents")
    + ")"
    + _fill(
        _BUDGET,
        id="doc_id",
        keep="length(p) BETWEEN 30 AND 1200 AND regexp_matches(p, '(?i)\\b(refund|license|the|der|que)\\b')",
        budget=600,
    )
    + " SELECT doc_id, length(content) AS chars, md5(content) AS text_md5 FROM r",
)
def policy_paragraphs(spark, sf):
    pattern = r"(?i)(?<![A-Za-z0-9_])(?:refund|license|the|der|que)(?![A-Za-z0-9_])"
    text = P.relevant_paragraphs(F.col("text"), relevant=pattern, budget=600)
    docs = settle(table(spark, sf, "documents"), text.alias("t"), keep=["doc_id"]).where(F.col("t") != "")
    return docs.select("doc_id", F.length("t").cast("bigint").alias("chars"), F.md5("t").alias("text_md5"))


@query(
    "policy_pages",
    """WITH src AS (SELECT doc_id, doc_id // 6 AS site, doc_id % 20 AS o, 'The return window is ' || (doc_id % 30 + 10)
           || ' days and shipping of order number ' || doc_id || ' is free of charge.' AS a,
           'Refunds for order number ' || doc_id || ' go back to the card and take five business days after the parcel has come in; customs are paid by us.' AS b
         FROM documents),
       p AS (SELECT *, a || ' ' || b AS content, CASE WHEN o IN (1, 14, 15, 16, 17, 18, 19) THEN 'shipping' ELSE 'returns' END AS kind FROM src),
       w AS (SELECT ['/policies/refund-policy', '/policies/shipping-policy', '/returns', '/return-policy', '/returns-policy', '/pages/returns',
         '/help/returns', '/customer-service/returns', '/pages/returns-exchanges', '/pages/return-policy', '/returns-exchanges',
         '/help/returns-exchanges', '/pages/shipping-returns', '/shipping-returns', '/customer-service/shipping', '/pages/shipping-policy',
         '/shipping', '/shipping-policy', '/pages/shipping', '/help/shipping'] AS paths)
       SELECT 'shop' || site || '.example' AS domain, kind, paths[o + 1] AS path, content,
         CASE WHEN doc_id % 2 = 0 THEN CASE WHEN kind = 'returns' THEN 'Returns' ELSE 'Shipping' END ELSE 'Rules & ' || doc_id END AS title
       FROM p, w WHERE length(content) >= 150 QUALIFY row_number() OVER (PARTITION BY site, kind ORDER BY o) = 1""",
)
def policy_pages(spark, sf):
    doc = F.col("doc_id")
    key = doc.cast("string")
    path = F.element_at(F.array(*[F.lit(p) for p, _ in P.POLICY_PATHS]), (doc % 20 + 1).cast("int"))
    html = F.concat(
        F.lit("<html><head><title>"),
        F.when(doc % 2 == 0, "").otherwise(F.concat(F.lit("Rules &amp; "), key)),
        F.lit("</title></head><body><nav>Returns and shipping menu of the shop that is long enough</nav><main><p>The return window is "),
        (doc % 30 + 10).cast("string"),
        F.lit(" days and shipping of order number "), key,
        F.lit(" is free of charge.</p><script>var returns = 1;</script><p>Refunds for order number "), key,
        F.lit(" go back to the card and take five business days after the parcel has come in; customs are paid by us.</p></main></body></html>"),
    )
    domain = F.concat(F.lit("shop"), F.floor(doc / 6).cast("string"), F.lit(".example"))
    shop_pages = table(spark, sf, "documents").select(
        domain.alias("domain"), F.concat(F.lit("https://www."), domain, path).alias("url"), html.alias("html")
    )
    return P.policy_pages(shop_pages)


@query(
    "subpage_titles",
    "SELECT page_id, substring(t, 1, 120) AS title FROM (SELECT page_id, "
    + _squeeze(_sql_chain("replace(" + _tags("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)") + ", '&amp;', '&')", (r"[#*_>`|]+", " ")))
    + " AS t FROM pages)",
)
def subpage_titles(spark, sf):
    return P.subpage_records(table(spark, sf, "pages")).select("page_id", "title")


@query(
    "manifest_pointers",
    """SELECT 'c' || c_custkey || '.example' AS domain,
         CASE c_custkey % 4 WHEN 0 THEN 'https://c' || c_custkey || '.example/h.json' WHEN 1 THEN 'https://c' || c_custkey || '.example/site.json'
           ELSE 'https://c' || c_custkey || '.example/r.json' END AS pointer,
         CASE c_custkey % 4 WHEN 0 THEN 'link-header' WHEN 1 THEN 'html-link' ELSE 'robots' END AS via
       FROM customer WHERE c_custkey % 4 <> 3""",
)
def manifest_pointers(spark, sf):
    k = F.col("c_custkey")
    domain = F.concat(F.lit("c"), k.cast("string"), F.lit(".example"))
    docs = spread(spark, sf, "customer").select(
        domain.alias("domain"),
        F.when(k % 4 == 0, '<https://a.example/>; rel="preload", </h.json>; rel="manifest-x"').alias("link_header"),
        F.when(k % 4 <= 1, '<head><link rel="icon" href="i.png"><link rel="manifest-x" href="site.json"></head><body>')
        .otherwise('<head></head><link rel="manifest-x" href="late.json">')
        .alias("html"),
        F.when(k % 4 == 2, F.concat(F.lit("User-agent: *\nmanifest-x: https://"), domain, F.lit("/r.json"))).alias("robots"),
    )
    return P.manifest_pointers(docs, "manifest-x")


@query(
    "clean_names",
    """SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN c_name WHEN 1 THEN c_name WHEN 2 THEN c_name WHEN 3 THEN 'C' || c_custkey
         ELSE c_name END AS name,
         CASE c_custkey % 3 WHEN 0 THEN 'About ' || c_name WHEN 1 THEN c_name ELSE 'Home' END AS title FROM customer""",
)
def clean_names(spark, sf):
    k = F.col("c_custkey")
    raw = (
        F.when(k % 5 == 0, F.concat(F.lit("Home - "), "c_name"))
        .when(k % 5 == 1, F.concat(F.lit("Welcome to   "), "c_name"))
        .when(k % 5 == 2, F.concat("c_name", F.lit(" | Official Website")))
        .when(k % 5 == 3, "  Homepage ")
        .otherwise(F.concat("c_name", F.lit(" – home")))
    )
    title = F.when(k % 3 == 0, F.concat(F.lit("Home : About "), "c_name")).when(k % 3 == 1, F.concat("c_name", F.lit(" - Homepage"))).otherwise("Home")
    return table(spark, sf, "customer").select(
        "c_custkey",
        T.clean_name(raw, F.concat(F.lit("www.c"), k.cast("string"), F.lit(".example"))).alias("name"),
        T.clean_title(title).alias("title"),
    )


@query(
    "short_descriptions",
    f"""WITH t AS (SELECT doc_id, {_squeeze("text")} AS t FROM documents), c AS (SELECT doc_id, t, substring(t, 1, 240) AS c FROM t),
        e AS (SELECT *, CASE WHEN length(regexp_extract(c, '(?s)^(.*[.!?]) ', 1)) > 0 THEN length(regexp_extract(c, '(?s)^(.*[.!?]) ', 1)) - 1 ELSE -1 END AS stop,
            length(regexp_extract(c, '(?s)^(.*) ', 1)) AS sp, substring(t, 1, 59) AS d FROM c)
        SELECT doc_id, CASE WHEN length(t) <= 240 THEN nullif(t, '') WHEN stop > 120 THEN substring(c, 1, stop + 1)
            ELSE CASE WHEN sp > 0 THEN substring(c, 1, sp) ELSE c END || '…' END AS short,
          CASE WHEN length(t) > 60 THEN regexp_replace(d, '\\s+\\S*$', '') || '…' ELSE t END AS clipped FROM e""",
)
def short_descriptions(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.shorten(F.col("text")).alias("short"), T.clip(F.col("text"), 60).alias("clipped"))


@query(
    "slugs",
    """SELECT doc_id, regexp_replace(regexp_replace(strip_accents(replace(replace(replace(replace(lower(text), 'ø', 'o'),
         'æ', 'ae'), 'å', 'a'), 'ß', 'ss')), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS slug FROM documents""",
)
def slugs(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.slug(F.col("text")).alias("slug"))
