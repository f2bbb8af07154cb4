"""Key-value namespaces as tables: name, value, size, metadata, expires_at (ms or null). Every view is as of an explicit ``now``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULT_LIMIT = 1000


def prefix_upper(prefix: str) -> str | None:
    """The least string after all that start with ``prefix``; None if there is none. Surrogates are stepped over."""
    for at in range(len(prefix) - 1, -1, -1):
        code = ord(prefix[at]) + 1
        code = 0xE000 if code == 0xD800 else code
        if code <= 0x10FFFF:
            return prefix[:at] + chr(code)
    return None


def visible(now: int) -> Column:
    return F.col("expires_at").isNull() | (F.col("expires_at") > now)


def clamp_limit(limit: int | None, most: int = DEFAULT_LIMIT) -> int:
    return most if not limit or limit <= 0 else min(limit, most)


def list_page(kv: DataFrame, *, now: int, prefix: str = "", after: str | None = None, limit: int | None = None) -> DataFrame:
    """One page of names in binary order, and ``list_complete``: whether nothing follows.

    One row more than the page is fetched to tell; the range bounds of the
    prefix and the cursor reach the scan as pushed filters.
    """
    n = clamp_limit(limit)
    rows = kv.where(visible(now))
    if prefix:
        upper = prefix_upper(prefix)
        rows = rows.where(F.col("name").startswith(prefix) & (F.col("name") >= prefix))
        rows = rows if upper is None else rows.where(F.col("name") < upper)
    if after is not None:
        rows = rows.where(F.col("name") > after)
    ahead = rows.orderBy("name").limit(n + 1)
    # At most limit + 1 rows are left: one group.
    gathered = ahead.agg(F.array_sort(F.collect_list(F.struct("name", "size", "expires_at"))).alias("page"))
    return gathered.select(F.inline(F.slice("page", 1, n)), (F.size("page") <= n).alias("list_complete"))


def do_list(kv: DataFrame, *, start: str | None = None, start_after: str | None = None, end: str | None = None, prefix: str = "", reverse: bool = False, limit: int | None = None) -> DataFrame:
    """Ordered map listing: from ``start`` (or after ``start_after``) up to ``end``, exclusive, from either side."""
    rows = kv.where(F.col("name").startswith(prefix)) if prefix else kv
    rows = rows.where(F.col("name") >= start) if start is not None else rows
    rows = rows.where(F.col("name") > start_after) if start_after is not None else rows
    rows = rows.where(F.col("name") < end) if end is not None else rows
    rows = rows.orderBy(F.desc("name") if reverse else F.asc("name"))
    return rows if limit is None else rows.limit(limit)


def metrics(kv: DataFrame, *, now: int) -> DataFrame:
    """Visible keys, their bytes, and the next expiry of all."""
    live = visible(now)
    return kv.agg(F.count_if(live).alias("keys"), F.coalesce(F.sum(F.when(live, F.col("size"))), F.lit(0)).alias("bytes"), F.min("expires_at").alias("next_expiry"))


def sweep(kv: DataFrame, *, now: int, limit: int) -> DataFrame:
    """The oldest expired keys, at most ``limit``: what one sweep deletes."""
    return kv.where(F.col("expires_at") <= now).orderBy("expires_at", "name").limit(limit)
