"""Words of texts: search vocabulary, all-words match, typo matching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hostloom.operators.keyed import join_to_unique, keep_first, top_per_group


def tokens(text: Column, min_length: int = 1) -> Column:
    """Distinct lower-case ASCII words of a text."""
    words = F.split(F.regexp_replace(F.lower(text), "[^a-z]+", " "), " ")
    return F.array_distinct(F.filter(words, lambda w: F.length(w) >= min_length))


def rarest_words(sets: DataFrame, docs: DataFrame) -> DataFrame:
    """For every word set (``_set``, ``words``) its rarest word and that word's document count ``n``.

    A set with a word that no document holds has no match and gets no row. Only
    (word, count) pairs leave the scan of ``docs``: the count is combined map-side.
    """
    asked = sets.select("_set", F.explode("words").alias("_w"))
    held = docs.select(F.explode("words").alias("_w")).groupBy("_w").agg(F.count(F.lit(1)).alias("n"))
    counted = asked.join(held, "_w", "left")
    return (
        counted.groupBy("_set")
        .agg(F.min_by(F.struct("_w", "n"), F.struct("n", "_w")).alias("_rare"), F.every(F.col("n").isNotNull()).alias("_held"))
        .where("_held")
        .select("_set", "_rare.*")
    )


def all_words(queries: DataFrame, query_id: str, docs: DataFrame, doc_id: str, k: int = 40) -> DataFrame:
    """Documents that hold every word of a query, best-known first.

    ``queries`` and ``docs`` carry a ``words`` array of distinct words; ``docs`` also a
    ``rank``. Queries with equal words are asked once. A document is a candidate only
    through a query's rarest word, so a common word pairs nothing; the other words are
    checked inside the candidate's row. A rarest word that is common all the same (all
    words of its query are) is spread over salted tasks. Queries without words match
    nothing; a document id in several rows matches if one of them does.
    """
    sets = queries.select(query_id, F.array_sort("words").alias("words")).where(F.size("words") > 0)
    sets = sets.withColumn("_set", F.sha2(F.array_join("words", " "), 256))
    unique = keep_first(sets.select("_set", "words"), ["_set"], F.col("words"))
    rare = rarest_words(unique, docs)
    pivots = rare.select("_w", "n").distinct()
    held = docs.select(doc_id, F.explode("words").alias("_w")).join(pivots.select("_w"), "_w", "left_semi")
    found = join_to_unique(held, pivots, "_w", F.col(doc_id)).select(doc_id, "_w").join(rare.select("_w", "_set"), "_w")
    hits = (
        found.join(docs.select(doc_id, "rank", F.col("words").alias("_have")), doc_id)
        .join(unique, "_set")
        .where(F.size(F.array_except("words", "_have")) == 0)
        .groupBy("_set", doc_id)
        .agg(F.min("rank").alias("_rank"))
    )
    best = top_per_group(hits, ["_set"], [F.asc_nulls_last("_rank"), F.col(doc_id)], k, rank_as="place")
    return sets.select(query_id, "_set").join(best, "_set").select(query_id, doc_id, "place")


def vocabulary(sites: DataFrame, columns: list[str], min_length: int = 3) -> DataFrame:
    """Search vocabulary: how many sites use each word in the given text columns."""
    text = F.concat_ws(" ", *columns)
    return (
        sites.select(F.explode(tokens(text, min_length)).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("sites"))
    )


def deletions(word: Column, start: int = 1) -> Column:
    """The word and every form with one letter left out."""
    places = F.sequence(F.lit(start), F.length(word))
    cut = F.transform(
        places, lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.length(word)))
    )
    return F.array_distinct(F.concat(F.array(word), cut))


def closest_names(typos: DataFrame, names: DataFrame, max_distance: int = 1) -> DataFrame:
    """Closest known name for every misspelt query.

    Two words within one edit share a form with at most one letter left out, so
    candidates come from an equi-join on those forms, never from comparing all
    pairs. The edit distance then decides; ties go to the alphabetically first.
    """
    left = typos.select("query", F.explode(deletions(F.col("query"))).alias("_form")).distinct()
    right = names.select("name", F.explode(deletions(F.col("name"))).alias("_form")).distinct()
    pairs = left.join(right, "_form").select("query", "name").distinct()
    scored = pairs.withColumn("distance", F.levenshtein("query", "name")).where(
        (F.col("distance") <= max_distance) & (F.col("query") != F.col("name"))
    )
    return keep_first(scored, ["query"], F.col("distance"), F.col("name"))
