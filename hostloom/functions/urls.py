"""Hosts, paths and links as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hostloom.functions.patterns import first_group, let


def host_of(url: Column) -> Column:
    """Lower-case host of an absolute URL, without port or user info."""
    return F.lower(first_group(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"))


def without_www(host: Column) -> Column:
    """Host or domain in lower case without a leading ``www.``."""
    return F.regexp_replace(F.lower(host), r"^www\.", "")


def bare_host(url: Column) -> Column:
    """Host of a URL without ``www.``."""
    return without_www(host_of(url))


def path_of(url: Column) -> Column:
    """Path of an absolute URL; ``/`` when there is none."""
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)?", 1)
    return F.when(host_of(url).isNotNull(), F.when(path == "", F.lit("/")).otherwise(path))


def query_of(url: Column) -> Column:
    """Query string with its question mark, or the empty string."""
    return F.regexp_extract(url, r"(\?[^#]*)", 1)


def trimmed_path(url: Column) -> Column:
    """Path without trailing slashes; ``/`` for the root."""
    path = F.regexp_replace(path_of(url), "/+$", "")
    return F.when(path == "", F.lit("/")).otherwise(path)


def same_site(host: Column, domain: Column) -> Column:
    """The host is the domain itself or one of its subdomains."""
    bare, site = without_www(host), without_www(domain)
    return (bare == site) | bare.endswith(F.concat(F.lit("."), site))


def host_suffixes(host: Column) -> Column:
    """Every suffix of a host that still has a dot, longest first.

    Turns "equal to or below one of these domains" into an equi-join.
    """
    labels = F.split(host, r"\.")
    starts = F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1)))
    return F.transform(starts, lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def _drop_dot_segments(path: Column) -> Column:
    """Fold ``.`` and ``..`` segments of an absolute path."""

    def folded(path: Column) -> Column:
        segments = F.split(path, "/")
        ends_open = path.rlike(r"/\.{0,2}$")
        kept = F.aggregate(
            F.slice(segments, 2, F.size(segments)),
            F.array().cast("array<string>"),
            lambda acc, s: F.when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
            .when(s == ".", acc)
            .otherwise(F.array_append(acc, s)),
        )
        joined = F.concat(F.lit("/"), F.array_join(kept, "/"))
        return let(joined, lambda j: F.when(ends_open & ~j.endswith("/"), F.concat(j, F.lit("/"))).otherwise(j))

    # A path without such a segment is its own result.
    return let(path, lambda p: F.when(p.startswith("/") & ~p.contains("/."), p).otherwise(folded(p)))


def resolve(href: Column, base: Column) -> Column:
    """Absolute URL of a link found on the page ``base``."""
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)
    origin = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    folder = F.regexp_extract(path_of(base), "^(.*/)", 1)
    target = F.regexp_extract(href, r"^([^?#]*)", 1)
    rest = F.regexp_extract(href, r"^[^?#]*(.*)$", 1)
    absolute = F.when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://[^/]+$"), F.concat(target, F.lit("/"), rest)).otherwise(href)
    own_path = F.regexp_extract(base, r"^([^?#]*)", 1)
    return (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), absolute)
        .when(href.startswith("//"), F.concat(scheme, F.lit(":"), href))
        .when(href.startswith("/"), F.concat(origin, _drop_dot_segments(target), rest))
        .when(target == "", F.concat(own_path, rest))
        .otherwise(F.concat(origin, _drop_dot_segments(F.concat(folder, target)), rest))
    )


def link_path(href: Column, domain: Column) -> Column:
    """Lower-case path of a link if it stays on the site, else NULL."""
    base = F.concat(F.lit("https://"), domain, F.lit("/"))
    url = resolve(href, base)
    return F.when(same_site(host_of(url), domain), F.lower(path_of(url)))
