"""URL filters: given rules, and association rules mined from labelled URLs.

A URL is a set of tokens (scheme, host labels, path segments, query keys). FP-growth finds
token combinations that go with a verdict; rules of enough support and confidence judge
the URLs that no given rule fits. Everything is DataFrame functions and Spark's own
FP-growth; matching goes through an inverted index from tokens to rules.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The given rules (host and path) and their verdicts.
RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))
#: Least share of labelled URLs with a combination, and least share of those with the verdict.
SUPPORT, CONFIDENCE = 0.01, 0.9

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host(url: Column) -> Column:
    """Text after the first ``://`` up to ``/``, ``?``, ``#`` or the end; A-Z in lower case."""
    return F.translate(F.regexp_extract(_after_scheme(url), r"^([^/?#]*)", 1), _UPPER, _LOWER)


def path(url: Column) -> Column:
    """Text after the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def given_rule(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule whose host and path fit, as ``struct(rule, verdict)``; else null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for text, verdict in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        name, start = text.split("/", 1)
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{start}")
        out = F.when(fits, F.struct(F.lit(text).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def tokens(url: Column, host: Column, path: Column) -> Column:
    """The different tokens of a URL; numbers are one token."""
    shown = lambda part: F.when(part.rlike("^[0-9]+$"), "#").otherwise(part)
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    lists = (
        F.array(F.concat(F.lit("scheme:"), F.translate(F.substring_index(url, "://", 1), _UPPER, _LOWER))),
        F.transform(F.filter(F.split(host, r"\."), lambda x: x != ""), lambda x: F.concat(F.lit("host:"), x)),
        F.transform(F.filter(F.split(path, "/"), lambda x: x != ""), lambda x: F.concat(F.lit("path:"), shown(x))),
        F.transform(F.filter(F.split(query, "&"), lambda x: x != ""), lambda x: F.concat(F.lit("query:"), F.substring_index(x, "=", 1))),
    )
    return F.when(host != "", F.array_distinct(F.concat(*lists))).otherwise(F.array().cast("array<string>"))


def mine(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """Rules ``tokens, verdict, confidence, support`` from rows ``tokens, verdict``.

    A rule is left out if fewer of its tokens already give the verdict as surely.
    """
    verdict = F.concat(F.lit("verdict:"), "verdict")
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(labelled.select(F.concat("tokens", F.array(verdict)).alias("items")))
    label = F.element_at("consequent", 1)
    rules = model.associationRules.where(label.startswith("verdict:")).select(F.array_sort("antecedent").alias("tokens"), F.regexp_replace(label, "^verdict:", "").alias("verdict"), "confidence", "support")
    rules = rules.where(~F.exists("tokens", lambda t: t.startswith("verdict:")))
    each = rules.select("*", F.explode("tokens").alias("token"))
    less = each.select(F.col("tokens").alias("part"), "token", F.col("verdict").alias("same"), F.col("confidence").alias("sure"))
    covered = each.join(less, "token").where("size(part) < size(tokens) and same = verdict and sure >= confidence").groupBy("tokens", "verdict", "part").agg(F.count(F.lit(1)).alias("n")).where("n = size(part)")
    return rules.join(covered.select("tokens", "verdict").distinct(), ["tokens", "verdict"], "left_anti")


def best_rule(sets: DataFrame, rules: DataFrame) -> DataFrame:
    """``tokens, mined`` of each token set that holds a rule's tokens: the surest rule's verdict.

    Equally sure rules go by support, more tokens, then by their tokens' order.
    """
    order = [F.col("confidence"), F.col("support"), F.size("needs").cast("double")]
    index = rules.select(F.explode("tokens").alias("token"), F.col("tokens").alias("needs"), F.col("verdict").alias("mined"), "confidence", "support")
    hits = sets.select("tokens", F.explode("tokens").alias("token")).join(index, "token").groupBy("tokens", "needs", "mined").agg(F.count(F.lit(1)).alias("n"), F.max("confidence").alias("confidence"), F.max("support").alias("support"))
    full = hits.where("n = size(needs)")
    return full.groupBy("tokens").agg(F.max_by("mined", F.struct(*order, "needs", "mined")).alias("mined"))


def judge(pages: DataFrame, labelled: DataFrame | None = None, rules=RULES, support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """``page_id, host, path, rule, verdict`` of every page.

    ``labelled`` has rows ``url, verdict``; without it the pages that given rules fit are the
    labelled ones. Null URLs and those without ``://`` have no host, path or tokens. Pages
    that neither a given nor a mined rule fits are allowed. Repeated rows stay.
    """
    url = F.coalesce("url", F.lit(""))
    parts = pages.select("page_id", url.alias("url"), host(url).alias("host"), path(url).alias("path"))
    known = parts.select("page_id", "host", "path", given_rule(F.col("host"), F.col("path"), rules).alias("given"), tokens(F.col("url"), F.col("host"), F.col("path")).alias("tokens"))
    if labelled is None:
        examples = known.where("given is not null").select("tokens", "given.verdict")
    else:
        link = F.coalesce("url", F.lit(""))
        examples = labelled.where("verdict is not null").select(tokens(link, host(link), path(link)).alias("tokens"), "verdict")
    examples = examples.where("size(tokens) > 0")
    columns = ["page_id", "host", "path", F.col("given.rule").alias("rule")]
    if examples.isEmpty():
        return known.select(*columns, F.coalesce("given.verdict", F.lit("allow")).alias("verdict"))
    mined = mine(examples, support, confidence)
    # Only tokens of rules matter. Each occurs in a share `support` of the labelled URLs, so
    # there are at most (mean tokens per URL) / support of them.
    used = sorted(r.token for r in mined.select(F.explode("tokens").alias("token")).distinct().collect())
    known = known.withColumn("tokens", F.when(F.col("given").isNull(), F.array_sort(F.array_intersect("tokens", F.array(*map(F.lit, used)).cast("array<string>")))))
    matched = best_rule(known.where("size(tokens) > 0").select("tokens").distinct(), mined)
    return known.join(matched, "tokens", "left").select(*columns, F.coalesce("given.verdict", "mined", F.lit("allow")).alias("verdict"))
