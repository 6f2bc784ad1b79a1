"""Grouping helpers that stay flat when one key holds a large share of the rows.

None of them gathers a group in one task: the first step is always a partial
aggregate or a partial limit on the map side, or the group is cut into chunks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rule tables built on the driver may be broadcast because their size is known.
MAX_RULE_ROWS = 10_000


def rule_table(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A small table of constants, marked for broadcast after checking its size."""
    if len(rows) > MAX_RULE_ROWS:
        raise ValueError(f"{len(rows)} rule rows; pass large dictionaries as tables instead")
    return F.broadcast(spark.createDataFrame(list(rows), schema))


def settle(df: DataFrame, *new: Column, keep: Sequence[str] | None = None) -> DataFrame:
    """Add columns that later steps use many times, computed exactly once per row.

    Catalyst merges adjacent projections and pushes filters below them, which copies
    an expensive expression to every place it is used. A generator of one row is a
    boundary for both, stays inside the stage and costs next to nothing.
    """
    kept = list(df.columns if keep is None else keep)
    return df.select(*kept, F.explode_outer(F.array(F.struct(*new))).alias("_settled")).select(*kept, "_settled.*")


def fence(df: DataFrame) -> DataFrame:
    """The same rows behind the boundary of :func:`settle`.

    For operators that use their input columns inside lambdas: without it, the caller's
    expressions would be copied into the lambda and run once per array element.
    """
    return df.select(F.explode_outer(F.array(F.struct(*df.columns))).alias("_row")).select("_row.*")


def nulls_last(column: Column) -> list[Column]:
    """Ascending order with NULLs at the end, usable inside a struct."""
    return [column.isNull(), column]


def keep_first(df: DataFrame, keys: Sequence[str], *order: Column, count_as: str | None = None) -> DataFrame:
    """The smallest row of every key by ``order``: a map-side combined aggregate.

    A window would pull every row of a hot key into one task; ``min_by`` ships one
    row per key and map task instead.
    """
    rest = [c for c in df.columns if c not in keys]
    rank = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])
    aggs = [F.min_by(F.struct(*rest), rank).alias("_row")] if rest else []
    if count_as:
        aggs.append(F.count(F.lit(1)).alias(count_as))
    if not aggs:
        return df.dropDuplicates(list(keys))
    out = df.groupBy(*keys).agg(*aggs)
    picked = [F.col(k) for k in keys] + ([F.col("_row")[c].alias(c) for c in rest] if rest else [])
    return out.select(*picked, *([F.col(count_as)] if count_as else []))


def keep_last(df: DataFrame, keys: Sequence[str], *order: Column, count_as: str | None = None) -> DataFrame:
    """The largest row of every key by ``order``."""
    rest = [c for c in df.columns if c not in keys]
    rank = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])
    aggs = [F.max_by(F.struct(*rest), rank).alias("_row")]
    if count_as:
        aggs.append(F.count(F.lit(1)).alias(count_as))
    out = df.groupBy(*keys).agg(*aggs)
    return out.select(
        *[F.col(k) for k in keys], *[F.col("_row")[c].alias(c) for c in rest], *([F.col(count_as)] if count_as else [])
    )


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank_as: str | None = None) -> DataFrame:
    """First ``k`` rows of each group; Spark limits per map task before the shuffle."""
    name = rank_as or "_rank"
    ranked = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    out = ranked.where(F.col(name) <= k)
    return out if rank_as else out.drop(name)


def previous_row(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    carry: Sequence[str],
    chunk: Column,
    prefix: str = "prev_",
) -> DataFrame:
    """``lag(1)`` over (keys, order) without holding a key in one task.

    ``chunk`` must grow with ``order`` (an hour or a day of the time column). Each
    (key, chunk) is one window partition; the last row of every chunk is found by a
    map-side combined aggregate and handed to the following chunk of its key as a
    marker row. Only one row per (key, chunk) ever meets in the carry step.
    """
    keys, order, carry = list(keys), list(order), list(carry)
    chunked = df.withColumn("_chunk", chunk)
    last = chunked.groupBy(*keys, "_chunk").agg(
        F.max_by(F.struct(*carry), F.struct(*order)).alias("_last")
    )
    across = Window.partitionBy(*keys).orderBy("_chunk")
    markers = (
        last.withColumn("_carried", F.lag("_last").over(across))
        .where(F.col("_carried").isNotNull())
        .select(*keys, "_chunk", "_carried")
    )
    columns = df.columns
    rows = chunked.select(
        *columns, "_chunk", F.lit(1).alias("_real"), F.struct(*carry).alias("_values")
    )
    heads = markers.select(
        *[F.col(c) if c in keys else F.lit(None).cast(df.schema[c].dataType).alias(c) for c in columns],
        "_chunk",
        F.lit(0).alias("_real"),
        F.col("_carried").alias("_values"),
    )
    inside = Window.partitionBy(*keys, "_chunk").orderBy("_real", *order)
    merged = rows.unionByName(heads).withColumn("_before", F.lag("_values").over(inside))
    return merged.where(F.col("_real") == 1).select(
        *columns, *[F.col("_before")[c].alias(f"{prefix}{c}") for c in carry]
    )


def coarse_bin(value: Column) -> Column:
    """An order-preserving bin: the sign, the decimal exponent and three digits."""
    size = F.abs(value)
    exponent = F.when(size > 0, F.floor(F.log10(size))).otherwise(F.lit(-400)).cast("long")
    digits = F.when(size > 0, F.floor(size / F.pow(F.lit(10.0), exponent.cast("double")) * 100)).otherwise(F.lit(0)).cast("long")
    magnitude = (exponent + 400) * 10_000 + digits
    return F.when(value < 0, -magnitude).otherwise(magnitude)


def floor_index_percentiles(
    df: DataFrame, keys: Sequence[str], value: str, shares: dict[str, float], count_as: str = "n", clamp: bool = True
) -> DataFrame:
    """Exact percentiles at position ``floor(n * p)`` of each sorted group.

    Sorting is never done per group. Rows shrink to (group, value) counts, then to
    (group, bin) counts; a running sum over the few bins finds the bin that holds
    the position, and only that bin's distinct values are summed up.
    """
    keys = list(keys)
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
    counts = counts.withColumn("_bin", coarse_bin(F.col(value).cast("double")))
    bins = counts.groupBy(*keys, "_bin").agg(F.sum("_c").alias("_c"))
    up_to = Window.partitionBy(*keys).orderBy("_bin")
    whole = Window.partitionBy(*keys)
    bins = bins.select(
        *keys,
        "_bin",
        (F.sum("_c").over(up_to) - F.col("_c")).alias("_before"),
        F.sum("_c").over(up_to).alias("_through"),
        F.sum("_c").over(whole).alias("_n"),
    )

    def position(share: float) -> Column:
        at = F.floor(F.col("_n") * F.lit(float(share))).cast("long")
        return F.least(at, F.col("_n") - 1) if clamp else at

    wanted = F.filter(
        F.array(*[F.struct(F.lit(name).alias("name"), position(p).alias("at")) for name, p in shares.items()]),
        lambda w: (w["at"] >= F.col("_before")) & (w["at"] < F.col("_through")),
    )
    targets = bins.withColumn("_w", F.explode(wanted)).select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
        F.col("_bin").alias("_tbin"),
        "_before",
        "_n",
        F.col("_w.name").alias("_name"),
        F.col("_w.at").alias("_at"),
    )
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)] + [F.col("_bin") == F.col("_tbin")]
    condition = same[0]
    for extra in same[1:]:
        condition = condition & extra
    inside = counts.join(targets, condition)
    running = Window.partitionBy(*keys, "_name").orderBy(value)
    reached = (
        inside.withColumn("_cum", F.col("_before") + F.sum("_c").over(running))
        .where(F.col("_cum") > F.col("_at"))
        .groupBy(*keys, "_name", "_n")
        .agg(F.min(value).alias("_v"))
    )
    return reached.groupBy(*keys).agg(
        F.max("_n").alias(count_as), *[F.max(F.when(F.col("_name") == name, F.col("_v"))).alias(name) for name in shares]
    )


def join_to_unique(left: DataFrame, right: DataFrame, key: str, left_id: Column, hot_rows: int = 1_000_000, salts: int = 64) -> DataFrame:
    """Inner join to a table that has one row per key and that key's row count ``n``.

    Hot keys are spread over ``salts`` tasks: their right row is copied once per salt
    and each left row picks a salt from a hash of its own identity. A key counts as
    hot from ``hot_rows`` rows on, and only if it holds a ten-thousandth of all rows,
    so the list of hot keys has at most 10,000 entries and may be broadcast.
    """
    total = right.agg(F.sum("n").alias("_total")).scalar()
    is_hot = (F.col("n") >= hot_rows) & (F.col("n") * 10_000 >= total)
    flagged = right.withColumn("_is_hot", is_hot)
    hot = F.broadcast(flagged.where("_is_hot").select(F.col(key).alias("_hot")))
    copies = flagged.withColumn(
        "_salt", F.explode(F.when(F.col("_is_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0))))
    ).drop("_is_hot")
    marked = left.join(hot, F.col(key) == F.col("_hot"), "left")
    salted = marked.withColumn(
        "_salt", F.when(F.col("_hot").isNotNull(), F.pmod(F.xxhash64(left_id), F.lit(salts)).cast("int")).otherwise(F.lit(0))
    ).drop("_hot")
    return salted.join(copies, [key, "_salt"]).drop("_salt")


def join_hot_left(left: DataFrame, unique: DataFrame, key: str, left_id: Column, salts: int = 64, share: int = 1_000) -> DataFrame:
    """Left join to a table with one row per key, flat when one key holds a third of ``left``.

    Rows per key are counted first (combined on the map side). A key with more than 1/``share``
    of all rows is hot, so there are fewer than ``share`` of them, whatever the data: the hot
    rows of ``unique`` are copied once per salt and each left row takes the salt of its own
    hash. Rows whose key is NULL or has no partner among the hot ones never wait in one task:
    NULL keys are spread like hot keys and stay unmatched.
    """
    if share > MAX_RULE_ROWS:
        raise ValueError("the list of hot keys would be too long to broadcast")
    counts = left.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_hot")).agg(F.count(F.lit(1)).alias("_rows"))
    total = left.agg(F.count(F.lit(1)).alias("_all")).scalar()
    hot = F.broadcast(counts.where(F.col("_rows") * share > total).select("_hot"))
    salt = F.pmod(F.xxhash64(left_id), F.lit(salts)).cast("int")
    spread = F.col("_hot").isNotNull() | F.col(key).isNull()
    salted = left.join(hot, F.col(key) == F.col("_hot"), "left").withColumn("_salt", F.when(spread, salt).otherwise(F.lit(0))).drop("_hot")
    copies = unique.join(hot, F.col(key) == F.col("_hot"), "left").withColumn(
        "_salt", F.explode(F.when(F.col("_hot").isNotNull(), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0))))
    ).drop("_hot")
    return salted.join(copies, [key, "_salt"], "left").drop("_salt")
