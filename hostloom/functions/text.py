"""Text of pages and feeds: markup removal, cleaning, hashing, shortening."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from hostloom.functions.patterns import (
    ANY_CASE,
    BLANK,
    NOT_BLANK,
    WORD_END,
    WORD_START,
    collapse,
    let,
    strip_blank,
    words,
)

# --- entities -------------------------------------------------------------------------------

#: The named entities each caller understands.
BASIC_ENTITIES = {"&nbsp;": " ", "&amp;": "&"}
PAGE_ENTITIES = {"&amp;": "&", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&#039;": "'", "&apos;": "'", "&nbsp;": " "}
POLICY_ENTITIES = {
    "amp": "&", "nbsp": " ", "ndash": "–", "mdash": "—", "rsquo": "’", "lsquo": "‘", "rdquo": "”", "ldquo": "“",
    "quot": '"', "apos": "'", "hellip": "…", "eacute": "é", "euro": "€", "pound": "£",
}
LETTER_ENTITIES = {
    "aelig": "æ", "AElig": "Æ", "oslash": "ø", "Oslash": "Ø", "aring": "å", "Aring": "Å", "eacute": "é", "Eacute": "É",
    "auml": "ä", "Auml": "Ä", "ouml": "ö", "Ouml": "Ö", "uuml": "ü", "Uuml": "Ü",
    "ndash": "–", "mdash": "—", "hellip": "…", "rsquo": "’", "lsquo": "‘", "rdquo": "”", "ldquo": "“",
}


def code_point(number: Column) -> Column:
    """The character of a Unicode code point; NULL outside the valid range."""
    valid = number.between(1, 0x10FFFF) & ~number.between(0xD800, 0xDFFF)
    return F.when(valid, F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32"))


def _rebuild(column: Column, pattern: str, base: int) -> Column:
    """Replace numeric entities: split around them and put the characters back between."""

    def decoded(text: Column) -> Column:
        codes = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
        chars = F.transform(codes, lambda c: F.coalesce(code_point(F.conv(c, base, 10).cast("bigint")), F.lit("")))
        pieces = F.zip_with(F.split(text, pattern), chars, lambda p, c: F.concat(p, F.coalesce(c, F.lit(""))))
        return F.when(text.rlike(pattern), F.array_join(pieces, "")).otherwise(text)

    return let(column, decoded)


def decode_numeric(column: Column) -> Column:
    """Decimal and hexadecimal character references."""
    return _rebuild(_rebuild(column, "&#([0-9]{1,7});", 10), "(?i)&#x([0-9a-f]{1,6});", 16)


def replace_all(column: Column, table: dict[str, str]) -> Column:
    """Apply plain replacements one after the other."""
    for old, new in table.items():
        column = F.replace(column, F.lit(old), F.lit(new))
    return column


def decode_page(column: Column) -> Column:
    """Entities of ordinary page text."""
    return decode_numeric(replace_all(column, PAGE_ENTITIES))


def decode_feed(column: Column) -> Column:
    """Entities of feed and listing text: numbers first, then names and letters.

    All of them begin with an ampersand, so a text without one is left as it is.
    """
    table = {**PAGE_ENTITIES, **{f"&{name};": char for name, char in LETTER_ENTITIES.items()}}
    return let(column, lambda t: F.when(t.contains("&"), replace_all(decode_numeric(t), table)).otherwise(t))


def decode_policy(column: Column) -> Column:
    """Known named entities become text, any other named entity becomes a space."""
    names = {f"&{name};": char for name, char in POLICY_ENTITIES.items()}
    return F.regexp_replace(replace_all(decode_numeric(column), names), "(?i)&[a-z]+;", " ")


# --- markup ---------------------------------------------------------------------------------


def drop_elements(column: Column, names: Iterable[str], by: str = " ") -> Column:
    """Remove elements together with their content."""
    for name in names:
        column = F.regexp_replace(column, f"(?is)<{name}.*?</{name}>", by)
    return column


def drop_tags(column: Column, by: str = " ") -> Column:
    """Remove tags, keep what is between them."""
    return F.regexp_replace(column, "<[^>]+>", by)


#: Presets: (dropped elements, entity handling).
PRESETS = {
    "link": (("script", "style", "noscript"), "page"),
    "summary": (("script", "style", "noscript", "svg"), "basic"),
    "plain": (("script", "style"), "none"),
    "notice": (("script", "style", "noscript", "svg"), "space"),
    "visible": (("script", "style", "noscript", "svg", "template"), "blank"),
}


def html_to_text(column: Column, preset: str = "summary") -> Column:
    """Readable text of an HTML page, on one line."""
    dropped, entities = PRESETS[preset]
    text = drop_elements(column, dropped)
    if entities == "blank":
        text = F.regexp_replace(text, "(?s)<!--.*?-->", " ")
    text = drop_tags(text)
    if entities == "page":
        text = decode_page(text)
    elif entities == "basic":
        text = replace_all(text, BASIC_ENTITIES)
    elif entities == "space":
        text = F.replace(text, F.lit("&nbsp;"), F.lit(" "))
    elif entities == "blank":
        text = F.regexp_replace(text, "(?i)&[a-z#0-9]+;", " ")
    return collapse(text)


def main_text_lines(html: Column) -> Column:
    """Text of ``<main>`` (or the page) with one line per block element."""
    body = F.coalesce(F.when(html.rlike("(?is)<main.*?</main>"), F.regexp_extract(html, "(?is)<main.*?</main>", 0)), html)
    for name in ("script", "style", "noscript", "svg", "nav", "header", "footer", "form"):
        body = F.regexp_replace(body, f"(?is)<{name}[^>]*>.*?</{name}>", " ")
    body = F.regexp_replace(body, r"(?i)</(?:p|div|li|h\d|td|section|br)>|<br\s*/?>", "\n")
    return decode_policy(drop_tags(body))


def page_title(html: Column) -> Column:
    """Raw content of the first ``<title>``; empty when there is none."""
    return F.regexp_extract(html, "(?is)<title[^>]*>(.*?)</title>", 1)


# --- hashes ---------------------------------------------------------------------------------


def content_hash(column: Column) -> Column:
    """First 32 hex digits of the SHA-256 of the text."""
    return F.substring(F.sha2(column, 256), 1, 32)


def visible_text_hash(html: Column) -> Column:
    """Hash of what a reader sees; unchanged by scripts, comments and markup."""
    return content_hash(html_to_text(html, "visible"))


def watch_text(column: Column) -> Column:
    """Text compared by page watches: lower case, runs of white space as one space."""
    return F.regexp_replace(F.lower(column), f"{BLANK}+", " ")


# --- reader markdown ------------------------------------------------------------------------

#: Header lines of saved reader output, and markdown links.
READER_HEADER = "(?m)^(?:Title|URL Source|Published Time|Warning|Markdown Content):.*$"
MD_IMAGE = r"!\[[^\]]*\]\([^)]*\)"
MD_LINK = r"\[([^\]]*)\]\([^)]*\)"


def clean_reader_text(column: Column) -> Column:
    """Plain snippet from reader markdown: no headers, images, links or markup signs."""
    text = F.regexp_replace(column, READER_HEADER, " ")
    text = F.regexp_replace(text, MD_IMAGE, " ")
    text = F.regexp_replace(text, MD_LINK, "$1")
    text = F.regexp_replace(text, f"https?://{NOT_BLANK}+", " ")
    return collapse(F.regexp_replace(text, r"[#*_>`|]+", " "))


def clean_subpage_text(column: Column) -> Column:
    """Text of a sub-page that may be HTML or markdown."""
    text = F.regexp_replace(column, MD_IMAGE, " ")
    text = F.regexp_replace(text, MD_LINK, "$1")
    text = drop_tags(drop_elements(text, ("script", "style")))
    return collapse(F.regexp_replace(replace_all(text, BASIC_ENTITIES), r"[#*_>`|]+", " "))


def _holds_any(text: Column, plain: tuple[str, ...]) -> Column:
    test = text.contains(plain[0])
    for item in plain[1:]:
        test = test | text.contains(item)
    return test


def _replace_if(text: Column, hints: tuple[str, ...], pattern: str, by: str = " ") -> Column:
    """Run a replacement only on texts that hold one of the plain hints."""
    return let(text, lambda t: F.when(_holds_any(t, hints), F.regexp_replace(t, pattern, by)).otherwise(t))


def strip_reader_markup(column: Column) -> Column:
    """Undo reader output kept as page text, including a header block on one line."""
    marker = F.instr(column, "Markdown Content:")
    text = F.when(
        (marker > 0) & column.rlike(f"^{BLANK}*Title:"), F.substring(column, marker + 17, F.length(column))
    ).otherwise(column)
    steps = [
        (("Title:", "URL Source:", "Published Time:", "Warning:", "Markdown Content:"), READER_HEADER, " "),
        (("](",), MD_IMAGE, " "),
        (("](",), MD_LINK, "$1"),
        (("://",), f"https?://{NOT_BLANK}+", " "),
        (("-", "*", "+"), f"(?m)^{BLANK}*[-*+]{BLANK}+", " "),
        (
            ("#", "*", ">", "`", "==", "---", "__"),
            rf"(?:^|{BLANK})(?:#{{1,6}}|\*{{1,3}}|>|`{{1,3}}|={{2,}}|-{{3,}}|_{{2,}})(?={BLANK}|$)",
            " ",
        ),
        (("**", "__"), r"(\*\*|__)(.+?)\1", "$2"),
    ]
    for hints, pattern, by in steps:
        text = _replace_if(text, hints, pattern, by)
    return text


# --- boilerplate ----------------------------------------------------------------------------

#: Sentences that are page chrome, as (texts one of which the sentence must hold,
#: pattern); without such texts the sentence must be short. Word edges are added by ``words``.
NOISY_SENTENCES = [
    (("cookies",), words(r"(?:use|using|uses|set|sets|store|stores|place|places)(?: of)? cookies")),
    ((), r"^[A-Za-z]{2,12}[.!]?$"),
    (("cookie",), f"{ANY_CASE}{WORD_START}cookies?{WORD_END}.*{WORD_START}(?:use|accept|consent|settings|preferences|policy|partners|improve|experience|personali[sz]e|analytics|advertis)"),
    (("accept ", "reject ", "decline ", "allow "), words("(?:accept|reject|decline|allow) (?:all|cookies|necessary|essential)")),
    (("manage ", "customi"), words("(?:manage|customi[sz]e) (?:your )?(?:cookie|privacy|consent) (?:settings|preferences|choices)")),
    (("cookies", "data"), words("we (?:and our partners )?(?:use|store|process) (?:cookies|personal data|data)")),
    (("your privacy ",), words("your privacy (?:choices|is important)")),
    ((), r"(?i)^(?:no,? thanks|yes,? that'?s fine|ok(?:ay)?,? got it|got it|accept|dismiss|close)\.?$"),
    (("skip to ",), words("skip to (?:main )?content")),
    (("navigation", "menu"), words("(?:toggle|open|close) (?:navigation|menu)")),
    (("newsletter",), words("subscribe to our newsletter", "sign up for our newsletter")),
    (("©", "copyright", "rights reserved"), rf"(?i)^(?:©|copyright){BLANK}?\d{{4}}|all rights reserved"),
    (("recaptcha",), words("this site is protected by recaptcha")),
    (("javascript",), words("you (?:need to|must) enable javascript", "please enable javascript")),
    (("your browser ",), f"{ANY_CASE}{WORD_START}your browser (?:is|does not){WORD_END}.*{WORD_START}(?:support|outdated)"),
]
#: Accessibility and navigation labels glued into running text.
INLINE_CHROME = (
    words(
        "skip to (?:the )?(?:main )?content",
        "skip to navigation",
        "skip to footer",
        "enable accessibility for (?:low vision|the visually impaired|visually impaired|blind users|keyboard navigation|screen readers?|[a-z]+)",
        "open the accessibility menu",
        "accessibility (?:menu|statement|tools)",
        "toggle (?:navigation|menu)",
        "open menu",
        "close menu",
        "main menu",
        "back to top",
    )
    + "[.:]?"
)
#: Buttons of a consent banner.
BANNER_BUTTONS = (
    words(
        "no,? thanks",
        "yes,? that[’']?s fine",
        "(?:accept|reject|allow|decline) all(?: cookies)?",
        "accept cookies",
        "ok(?:ay)?,? got it",
        "manage (?:cookie )?preferences",
        "cookie settings",
    )
    + "[.!]?"
)
_MENU_WORD = "[A-Z][a-z]{1,12} "


def drop_menu_runs(column: Column) -> Column:
    """Remove runs of ten or more capitalised words that lead up to another capital.

    Java matches a repeated group recursively, so a run is taken off in pieces of at
    most 300 words and the short rest next to a piece is taken off with it.
    """
    mark = "\u0001"
    text = F.regexp_replace(column, f"{WORD_START}(?:{_MENU_WORD}){{10,300}}(?=[A-Z])", mark)
    text = F.regexp_replace(text, f"{mark}(?:{_MENU_WORD}){{1,9}}(?=[A-Z])", mark)
    return F.replace(text, F.lit(mark), F.lit(""))


def sentences(column: Column) -> Column:
    """Split collapsed text after ``.``, ``!`` or ``?`` before a capital, digit or opening mark."""
    return F.split(column, r' (?<=[.!?] )(?=[A-Z0-9"“(©])')


def is_noise(sentence: Column) -> Column:
    """The sentence is page chrome rather than content."""

    def judge(lowered: Column) -> Column:
        verdict = F.lit(False)
        for plain, pattern in NOISY_SENTENCES:
            likely = _holds_any(lowered, plain) if plain else F.length(sentence) <= 24
            verdict = verdict | (likely & sentence.rlike(pattern))
        return verdict

    return let(F.lower(sentence), judge)


#: Plain texts one of which every inline label holds.
_CHROME_HINTS = ("skip to ", "accessibility", "navigation", "menu", "back to top")


def clean_page_text(column: Column) -> Column:
    """Page text without banners, menus and account chrome.

    Falls back to the uncleaned text when hardly anything is left.
    """

    def without_chrome(original: Column) -> Column:
        def cleaned(lowered: Column) -> Column:
            banner = F.when(_holds_any(lowered, ("cookie", "consent")), F.regexp_replace(original, BANNER_BUTTONS, " ")).otherwise(original)
            chrome = F.when(_holds_any(lowered, _CHROME_HINTS), F.regexp_replace(banner, INLINE_CHROME, " ")).otherwise(banner)
            squeezed = let(drop_menu_runs(chrome), lambda t: F.when(t == original, original).otherwise(collapse(t)))
            return F.trim(F.array_join(F.filter(sentences(squeezed), lambda s: ~is_noise(s)), " "))

        return let(F.lower(original), cleaned)

    def choose(original: Column) -> Column:
        return let(
            without_chrome(original),
            lambda kept: F.when(F.length(kept) >= 20, kept)
            .when(F.length(original) >= 20, original)
            .otherwise(collapse(column)),
        )

    cleaned = let(collapse(strip_reader_markup(column)), choose)
    return F.when(column.isNull() | (column == ""), column).otherwise(cleaned)


def changed_text(before: Column, after: Column) -> Column:
    """True when cleaning changed more than white space."""
    return collapse(before) != after


def clean_pages(pages: Column) -> Column:
    """Clean every page of a ``map<path, struct<title, content>>``; NULL if none changed."""
    cleaned = F.transform_values(
        pages, lambda _, p: F.struct(p["title"].alias("title"), clean_page_text(p["content"]).alias("content"))
    )
    changed = F.exists(
        F.map_keys(pages),
        lambda k: F.coalesce(
            changed_text(F.element_at(pages, k)["content"], F.element_at(cleaned, k)["content"]), F.lit(False)
        ),
    )
    return F.when(changed, cleaned)


# --- shortening and names -------------------------------------------------------------------


def _last_index(column: Column, needle: str) -> Column:
    """Zero-based position of the last occurrence, -1 when absent."""
    at = F.instr(F.reverse(column), needle[::-1])
    return F.when(at > 0, F.length(column) - at - (len(needle) - 1)).otherwise(F.lit(-1))


def shorten(column: Column, limit: int = 240) -> Column:
    """At most ``limit`` characters, cut after a sentence or else after a word."""
    text = collapse(F.coalesce(column, F.lit("")))
    cut = F.substring(text, 1, limit)
    end = F.greatest(*[_last_index(cut, mark) for mark in (". ", "! ", "? ")])
    space = _last_index(cut, " ")
    word = F.when(space > 0, F.substring(cut, F.lit(1), space)).otherwise(cut)
    return (
        F.when(F.length(text) <= limit, F.when(text != "", text))
        .when(end > limit * 0.5, F.substring(cut, F.lit(1), end + 1))
        .otherwise(F.concat(word, F.lit("…")))
    )


def clip(column: Column, limit: int) -> Column:
    """Cut to ``limit`` characters at a word and mark the cut with an ellipsis."""
    text = collapse(F.coalesce(column, F.lit("")))
    head = F.regexp_replace(F.substring(text, 1, limit - 1), f"{BLANK}+{NOT_BLANK}*$", "")
    return F.when(F.length(text) > limit, F.concat(head, F.lit("…"))).otherwise(text)


def capitalised(column: Column) -> Column:
    """First letter in upper case, the rest untouched."""
    return F.concat(F.upper(F.substring(column, 1, 1)), F.substring(column, F.lit(2), F.length(column)))


def brand_of(domain: Column) -> Column:
    """Capitalised first label of a domain, without ``www.``."""
    return capitalised(F.split(F.regexp_replace(domain, r"^www\.", ""), r"\.")[0])


_DASH = "[-|–—:]"


def clean_name(name: Column, domain: Column) -> Column:
    """Site name without "Home -" and "Official site"; the brand when nothing is left."""
    text = collapse(F.coalesce(name, F.lit("")))
    text = F.regexp_replace(text, rf"(?i)^(?:welcome to|home{BLANK}*{_DASH}{BLANK}*|homepage{BLANK}*{_DASH}{BLANK}*)", "")
    text = strip_blank(F.regexp_replace(text, rf"(?i){BLANK}*{_DASH}{BLANK}*(?:home|homepage|official (?:web)?site|welcome)$", ""))
    generic = (text == "") | text.rlike("(?i)^(?:home|homepage|index|untitled|welcome|website)$")
    return F.substring(F.when(generic, brand_of(domain)).otherwise(text), 1, 100)


def clean_title(title: Column) -> Column:
    """Page title without a leading or trailing "Home"; unchanged when that empties it."""
    text = F.regexp_replace(F.regexp_replace(title, f"{BLANK}+", " "), rf"(?i)^home{BLANK}*{_DASH}{BLANK}*", "")
    text = strip_blank(F.regexp_replace(text, rf"(?i){BLANK}*{_DASH}{BLANK}*(?:home|homepage)$", ""))
    text = F.substring(text, 1, 120)
    return F.when(text != "", text).otherwise(title)


#: Letters folded before a slug is cut.
_FOLDED = "áàâãäåéèêëíìîïóòôõöúùûüýÿñçčšžř"
_PLAIN = "aaaaaaeeeeiiiiooooouuuuyynccszr"


def slug(column: Column) -> Column:
    """URL slug: Nordic and German folds, accents off, other signs to dashes."""
    text = replace_all(F.lower(column), {"ø": "o", "æ": "ae", "å": "a", "ß": "ss"})
    text = F.translate(text, _FOLDED, _PLAIN)
    return F.regexp_replace(F.regexp_replace(text, "[^a-z0-9]+", "-"), "^-|-$", "")
