"""Text, URL and name functions on small literals."""

import pytest
from pyspark.sql import functions as F

from hostloom.functions import text as T
from hostloom.functions import urls as U
from hostloom.functions.patterns import collapse, percent, round_half_up, strip_blank, words

X = F.col("x")


def test_blank_covers_no_break_space(one):
    assert one(collapse(X), "x string", [" a   b﻿"]) == "a b"
    assert one(strip_blank(X), "x string", ["  a b 　"]) == "a b"


def test_words_ignore_accented_neighbours(one):
    assert one(X.rlike(words("ske")), "x string", ["påske"]) is True  # an ASCII boundary
    assert one(X.rlike(words("åbningstider")), "x string", ["ÅBNINGSTIDER i dag"]) is True
    assert one(X.rlike(words("shop")), "x string", ["workshop"]) is False


def test_rounding_goes_up(one):
    assert one(round_half_up(F.lit(-2.5))) == -2.0
    assert one(percent(F.lit(1), F.lit(3))) == 33.3
    assert one(percent(F.lit(1), F.lit(0))) is None


@pytest.mark.parametrize(
    "raw, clean",
    [
        ("Talk &#8211; Q&amp;A", "Talk – Q&A"),
        ("&#x1F600;&nbsp;x&#39;s", "😀 x's"),
        ("&#0; &#55296;end", " end"),
        ("plain", "plain"),
    ],
)
def test_decode(one, raw, clean):
    assert one(T.decode_feed(X), "x string", [raw]) == clean


def test_policy_entities(one):
    assert one(T.decode_policy(X), "x string", ["30&ndash;40&euro; &thorn;x"]) == "30–40€  x"


def test_html_presets(one):
    html = "<p>A &amp; B</p><script>x</script><svg><b>s</b></svg><!-- c > d -->&copy;"
    assert one(T.html_to_text(X, "link"), "x string", [html]) == "A & B s d -->&copy;"
    assert one(T.html_to_text(X, "visible"), "x string", [html]) == "A B"


def test_visible_hash_ignores_scripts(one):
    a, b = "<p>Hi</p><script>1</script>", "<div>Hi</div><script>2</script><!-- x -->"
    assert one(T.visible_text_hash(X), "x string", [a]) == one(T.visible_text_hash(X), "x string", [b])


def test_clean_page_text_drops_chrome(one):
    raw = "Skip to content We use cookies to improve things. Accept all. The bakery sells bread every day. © 2024 Us"
    assert one(T.clean_page_text(X), "x string", [raw]) == "The bakery sells bread every day."


def test_clean_page_text_keeps_ordinary_accept_all(one):
    raw = "Please accept all our thanks for the visit today."
    assert "thanks for the visit" in one(T.clean_page_text(X), "x string", [raw])


def test_clean_page_text_falls_back(one):
    assert one(T.clean_page_text(X), "x string", ["Accept cookies now ok"]) == "Accept cookies now ok"
    assert one(T.clean_page_text(X), "x string", [""]) == ""


def test_long_menu_runs(one):
    menu = "Home " * 5000 + "This shop sells many useful things to people."
    assert one(T.clean_page_text(X), "x string", [menu]) == "This shop sells many useful things to people."


def test_cleaning_is_idempotent(one):
    raw = "Menu Back to top. We sell lamps. Open menu We also sell chairs for your whole house."
    first = one(T.clean_page_text(X), "x string", [raw])
    assert one(T.clean_page_text(X), "x string", [first]) == first


def test_reader_markup(one):
    raw = "Title: T URL Source: x Markdown Content: # Hello **bold** [link](http://a.b/c) ![i](j) http://u.v/w"
    assert one(collapse(T.strip_reader_markup(X)), "x string", [raw]) == "Hello bold link"


def test_clean_pages_only_when_changed(spark):
    rows = [({"/": ("t", "Good text about lamps and chairs.")},), ({"/": ("t", "Back to top Good text about lamps and chairs.")},)]
    df = spark.createDataFrame(rows, "pages map<string,struct<title:string,content:string>>")
    out = [r[0] for r in df.select(T.clean_pages(F.col("pages"))).collect()]
    assert out[0] is None and out[1]["/"]["content"] == "Good text about lamps and chairs."


def test_shorten(one):
    text = "First sentence that is quite long and says a lot. " * 4 + "tail"
    out = one(T.shorten(X, 120), "x string", [text])
    assert out.endswith("a lot.") and len(out) <= 120
    assert one(T.shorten(X, 20), "x string", ["word " * 10]) == "word word word word…"
    assert one(T.shorten(X), "x string", ["  "]) is None


@pytest.mark.parametrize(
    "name, clean",
    [("Home - Nike", "Nike"), ("Welcome to Nike", "Nike"), ("Nike | Official Site", "Nike"), ("Homepage", "Acme"), ("", "Acme")],
)
def test_clean_name(one, name, clean):
    assert one(T.clean_name(X, F.lit("www.acme.com")), "x string", [name]) == clean


def test_slug(one):
    assert one(T.slug(X), "x string", ["København Ø / Straße"]) == "kobenhavn-o-strasse"


@pytest.mark.parametrize(
    "href, base, url",
    [
        ("../a/b?x=1", "https://e.com/p/q/r", "https://e.com/p/a/b?x=1"),
        ("/x/./y", "https://e.com/p", "https://e.com/x/y"),
        ("?q", "https://e.com/p", "https://e.com/p?q"),
        ("//o.com/z", "https://e.com/", "https://o.com/z"),
        ("#t", "https://e.com/p#old", "https://e.com/p#t"),
        ("https://x.org", "https://e.com", "https://x.org/"),
    ],
)
def test_resolve(one, href, base, url):
    assert one(U.resolve(F.col("h"), F.col("b")), "h string, b string", [href, base]) == url


def test_hosts(one):
    assert one(U.bare_host(X), "x string", ["HTTPS://WWW.Ærø.dk:8080/x"]) == "ærø.dk"
    assert one(U.same_site(X, F.lit("www.a.com")), "x string", ["shop.a.com"]) is True
    assert one(U.same_site(X, F.lit("a.com")), "x string", ["ba.com"]) is False
    assert one(U.host_suffixes(X), "x string", ["a.b.c.com"]) == ["a.b.c.com", "b.c.com", "c.com"]
    assert one(U.trimmed_path(X), "x string", ["https://a.com/x//"]) == "/x"
