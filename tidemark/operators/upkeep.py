"""Upkeep of what has landed: erasing streams, expiring, and keeping current tables by the keys that changed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.cdc import STREAM


def erased(rows: DataFrame, tombstones: DataFrame) -> DataFrame:
    """The rows that an erasure deletes: those of streams that an active tombstone names.

    Two semi joins on equal keys; a row that both kinds of tombstones name is found once.
    """
    active = tombstones.where("cleared_at IS NULL")
    exact = active.where("incarnation IS NOT NULL").select(*STREAM).distinct()
    wide = active.where("incarnation IS NULL").select(*STREAM[:-1]).distinct()
    by_all = rows.join(wide, STREAM[:-1], "left_semi")
    return by_all.unionByName(rows.join(wide, STREAM[:-1], "left_anti").join(exact, STREAM, "left_semi"))


def with_tombstones(tombstones: DataFrame, asked: DataFrame) -> DataFrame:
    """Tombstones with those asked for added; one that is active already stays as it is, so asking again changes nothing.

    Both: STREAM (incarnation null for all), erased_at, reason, cleared_at. A
    cleared tombstone doesn't keep another from being added.
    """
    named = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in STREAM]
    active = tombstones.where("cleared_at IS NULL").select(*(F.col(c).alias(f"_{c}") for c in STREAM)).distinct()
    both = named[0] & named[1] & named[2] & named[3] & named[4]
    fresh = asked.groupBy(*STREAM).agg(F.min(F.struct("erased_at", "reason")).alias("t")).join(active, both, "left_anti")
    return tombstones.unionByName(fresh.select(*STREAM, "t.erased_at", "t.reason", F.lit(None).cast(tombstones.schema["cleared_at"].dataType).alias("cleared_at")))


def expired(landed: DataFrame, *, now: str, days: int = 7) -> DataFrame:
    """Landed rows old enough to go: they have long been routed."""
    return landed.where(F.col("landed_at") < F.lit(now).cast("timestamp") - F.make_dt_interval(F.lit(days)))


def upkeep(current: DataFrame, batch: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """A current table after one more batch: per key the row that comes last by ``order``.

    Both have the same columns, deletions among them (they must be remembered, as
    an older row may still come). The result depends on all rows that ever came,
    not on how they were cut into batches. Keys that the batch doesn't name
    pass by untouched; the others are one aggregate with map-side combine.
    """
    touched = batch.select(*keys).distinct()
    rest = current.join(touched, keys, "left_anti")
    rows = [c for c in current.columns if c not in keys]
    met = current.join(touched, keys, "left_semi").unionByName(batch)
    newest = met.groupBy(*keys).agg(F.max_by(F.struct(*rows), F.struct(*order)).alias("v"))
    return rest.unionByName(newest.select(*keys, "v.*"))
