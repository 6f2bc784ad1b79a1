"""Mixing sources to target weights by systematic sampling.

Every document of a source expects the same number of copies, its source's target over its
source's size. Within a source, documents stand in order of size; the running sum of their
expected copies, moved by one random offset, crosses an integer as often as a document is
taken. In order of size the words taken miss the target by about one document at most.

Places come from a range sort whose parts are counted, so no source is one task's work.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hostloom.llm.common import settled
from hostloom.operators.keyed import join_to_unique

#: Weights of the sources in code point order, repeating.
WEIGHTS = (5, 2, 1)
#: No source is taken more often than this.
CAP = 3
#: Documents from which on a source is salted.
HOT = 20_000
#: Words as everywhere in this subpackage.
WORD = r"[^\x20\x09-\x0D]+"


def numbered(df: DataFrame, *order: str, name: str) -> DataFrame:
    """``df`` with each row's place (from 0) in the given order.

    Parts of a range sort are written once; only their row counts, one per part, pass the driver.
    """
    parted = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(name, F.monotonically_increasing_id())
    rows = settled(parted)
    part = F.shiftright(F.col(name), 33)
    before, total = {}, 0
    for p, n in sorted(tuple(r) for r in rows.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()):
        before[p], total = total, total + n
    if not before:
        return rows
    offsets = F.create_map(*[F.lit(x) for p, n in before.items() for x in (p, n)])
    return rows.withColumn(name, offsets[part] + F.col(name).bitwiseAND(F.lit((1 << 33) - 1)))


def source_key(source: Column) -> Column:
    """A never-null key with the same order as the source: code points, null last."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source.cast("string")))


def offset(key: Column, seed: int) -> Column:
    """The source's random offset in [0, 1), from the seed and its key."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key)), 1, 8), 16, 10).cast("double") / float(1 << 32)


def targets(sources: DataFrame, weights: Sequence[int] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """``sources`` (``key, source_size`` and others) with ``target``: all sizes shared by weight.

    A target stops at ``cap`` times its source's size; what is over goes to the others by
    weight until none is above. That is one level: each target is the lesser of its cap and
    the level times its weight, and the level rises until the shares add up.
    """
    placed = numbered(sources, "key", name="_place")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("_place") % len(weights) + 1).cast("int"))
    known = settled(placed.withColumn("_weight", weight).drop("_place"))
    total, level = known.agg(F.sum("source_size")).first()[0] or 0, 0.0
    while True:
        over = F.lit(level) * F.col("_weight") > F.col("source_size") * cap
        stopped, left = known.agg(F.sum(F.when(over, F.col("source_size"))), F.sum(F.when(~over, F.col("_weight")))).first()
        now = (total - cap * (stopped or 0)) / left if left else level
        if now <= level:
            break
        level = now
    return known.withColumn("target", F.least(F.lit(level) * F.col("_weight"), (F.col("source_size") * cap).cast("double"))).drop("_weight")


def planned(docs: DataFrame, carry: Sequence[str] = ("doc_id",), weights: Sequence[int] = WEIGHTS, cap: int = CAP, seed: int = 11) -> DataFrame:
    """``_row`` (the carried columns), ``size, source_size, target, copies`` of every row of ``docs``.

    Null or empty texts have size 0 and are taken like others of their source (it adds no
    words); a source without words has target 0 and no copies. Null sources are one source.
    Rows are told apart by (size, doc_id), null ids first; rows equal in both are
    exchangeable, and repeated rows are rows of their own. An empty table gives no rows. The
    same table, weights and seed give the same result, however it is partitioned.
    """
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint")
    rows = docs.select(F.struct(*[F.col(c) for c in carry]).alias("_row"), source_key(F.col("source")).alias("key"), size.alias("size"), F.col("doc_id").alias("id"))
    placed = numbered(rows, "key", "size", "id", name="place")
    sources = placed.groupBy("key").agg(F.sum("size").alias("source_size"), F.min("place").alias("start"), F.count(F.lit(1)).alias("n"))
    shared = settled(targets(sources, weights, cap))
    both = join_to_unique(placed, shared, "key", F.col("place"), hot_rows=HOT)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    upto = lambda k: F.floor(offset(F.col("key"), seed) + k * rate)
    k = F.col("place") - F.col("start")
    # Rounding of long running sums may not add a copy above the cap.
    return both.select("_row", "size", "source_size", "target", F.least(upto(k + 1) - upto(k), F.lit(cap).cast("bigint")).alias("copies"))


def taken(docs: DataFrame, **options) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` of every row: ``taken`` is copies times size, in words."""
    plan = planned(docs, ("doc_id",), **options)
    return plan.select("_row.doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix: each document as often as it is taken, all its columns and ``copy`` (from 1; renamed if taken)."""
    name = "copy"
    while name in docs.columns:
        name = f"_{name}"
    chosen = planned(docs, docs.columns, **options).where("copies > 0")
    return chosen.select("_row.*", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))).alias(name))
