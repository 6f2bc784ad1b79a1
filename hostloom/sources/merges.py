"""Merges as DataFrames: the next version of a table from the stored one and a batch."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hostloom.operators.keyed import keep_first, keep_last



def one_per_key(new: DataFrame, key: str, order: Sequence[Column] = ()) -> DataFrame:
    """One row per key of a batch: the last by ``order``, then by the row's JSON text, so that repeats agree."""
    return keep_last(new, [key], *order, F.to_json(F.struct(*new.columns)))


def upsert(stored: DataFrame, new: DataFrame, key: str, supplied: Sequence[str], order: Sequence[Column] = ()) -> DataFrame:
    """Next version of a table: supplied columns replace stored ones, others stay.

    Of incoming rows with one key the last by ``order`` counts.

    An update writes exactly the supplied columns, NULLs included; it never means
    "keep the old value where the new one is NULL". New keys get NULL elsewhere.
    """
    incoming = one_per_key(new, key, order).select(key, *[F.col(c).alias(f"_new_{c}") for c in supplied], F.lit(True).alias("_in"))
    joined = stored.join(incoming, key, "full")
    arrived = F.coalesce("_in", F.lit(False))
    pick = lambda c: F.when(arrived, F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in supplied else F.col(c)
    return joined.select(*[F.col(key) if c == key else pick(c) for c in stored.columns])


def changed_rows(stored: DataFrame, new: DataFrame, key: str, supplied: Sequence[str], order: Sequence[Column] = ()) -> DataFrame:
    """Incoming rows that would change something: new keys and real differences, one row per key."""
    old = stored.select(key, *[F.col(c).alias(f"_old_{c}") for c in supplied], F.lit(True).alias("_known"))
    same = F.lit(True)
    for c in supplied:
        same = same & F.col(c).eqNullSafe(F.col(f"_old_{c}"))
    joined = one_per_key(new, key, order).select(key, *supplied).join(old, key, "left")
    return joined.where(F.col("_known").isNull() | ~same).select(key, *supplied)


def insert_ignore(stored: DataFrame, new: DataFrame, keys: Sequence[str], *first: Column) -> DataFrame:
    """New rows only: duplicates inside the batch and keys already stored drop out."""
    unique = keep_first(new, list(keys), *first)
    return unique.join(stored.select(*keys), list(keys), "left_anti").select(*new.columns)


def guarded_patch(stored: DataFrame, patches: DataFrame, key: str, columns: Sequence[str], guard: Column, order: Sequence[Column] = ()) -> DataFrame:
    """Apply patches only where the guard still holds for the stored row; of several for a key the last.

    The guard may compare stored columns with patch columns named ``patch_*``, such as
    the ``patch_updated_at`` the patch was computed from.
    """
    incoming = one_per_key(patches, key, order).select(
        key, *[F.col(c).alias(f"patch_{c}") for c in patches.columns if c != key], F.lit(True).alias("_in")
    )
    joined = stored.join(incoming, key, "left")
    applies = F.coalesce(F.col("_in") & guard, F.lit(False))
    return joined.select(
        *[F.when(applies, F.col(f"patch_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in stored.columns]
    )
