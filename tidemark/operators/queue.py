"""Message queues as tables, and what each step of their life does at an explicit ``now`` (ms).

Messages: seq, id, size, enqueued_at, visible_at, attempts, lease_id, leased_until, dlq_target, purge_on_settle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ALARM_FIRST_MS, ALARM_DOUBLINGS, ALARM_TRIES = 2000, 6, 6


def leased(now: int) -> Column:
    return F.col("lease_id").isNotNull() & (F.col("leased_until") > now)


def moving() -> Column:
    return F.col("dlq_target").isNotNull()


def state(now: int) -> Column:
    """moving, leased, expired (a lease that ran out), delayed or ready."""
    return F.when(moving(), "moving").when(leased(now), "leased").when(F.col("lease_id").isNotNull(), "expired").when(F.col("visible_at") > now, "delayed").otherwise("ready")


def candidates(q: DataFrame, *, now: int, limit: int) -> DataFrame:
    """The next messages to deliver, by (visible_at, seq): a top-k, not a sort."""
    return q.where(F.col("lease_id").isNull() & ~moving() & (F.col("visible_at") <= now)).orderBy("visible_at", "seq").limit(limit)


def batch(q: DataFrame, *, now: int, limit: int, wait_ms: int) -> DataFrame:
    """The candidates, if they fill a batch or the oldest has waited ``wait_ms``; else none."""
    found = candidates(q, now=now, limit=limit)
    full = found.agg(F.count("*").alias("n"), F.min("visible_at").alias("oldest")).where((F.col("n") >= limit) | (F.col("oldest") + wait_ms <= now))
    return found.join(F.broadcast(full.select("n")), F.lit(True), "left_semi")  # one row or none


def expire_leases(q: DataFrame, *, now: int, max_retries: int, delay_ms: int, dlq: str | None) -> DataFrame:
    """What becomes of messages whose lease ran out: purge, dead_letter, drop or retry with a later visible_at."""
    out = q.where(F.col("lease_id").isNotNull() & (F.col("leased_until") <= now) & ~moving())
    spent = F.col("attempts") > max_retries
    fate = F.when(F.col("purge_on_settle"), "purge").when(spent, "dead_letter" if dlq else "drop").otherwise("retry")
    return out.select("seq", "id", "attempts", fate.alias("fate"), F.when(fate == "retry", F.lit(now) + delay_ms).alias("visible_at"))


def metrics(q: DataFrame, *, now: int) -> DataFrame:
    """Backlog: messages, bytes, oldest; of them leased, moving, delayed, and active leases."""
    return q.agg(
        F.count("*").alias("backlog"),
        F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"),
        F.min("enqueued_at").alias("oldest"),
        F.count_if(leased(now)).alias("leased"),
        F.count_if(moving()).alias("moving"),
        F.count_if(state(now) == "delayed").alias("delayed"),
        F.count_distinct(F.when(leased(now), F.col("lease_id"))).alias("active_leases"),
    )


def peek(q: DataFrame, *, now: int, limit: int) -> DataFrame:
    return q.select("seq", "id", "attempts", state(now).alias("state")).orderBy("seq").limit(limit)


def purge_plan(q: DataFrame, *, now: int) -> DataFrame:
    """Purging: messages under a lease go when it settles, the others now."""
    return q.where(~moving()).select("seq", "id", F.when(leased(now), "on_settle").otherwise("now").alias("when"))


def expired(q: DataFrame, *, now: int, retention_ms: int) -> DataFrame:
    return q.where((F.col("enqueued_at") + retention_ms <= now) & ~leased(now))


def dead_letters(q: DataFrame, receipts: DataFrame) -> DataFrame:
    """Messages to hand over by target; those whose transfer has a receipt only await deletion."""
    waiting = q.where(moving()).join(receipts.select("id").distinct(), "id", "left_anti")
    return waiting.groupBy("dlq_target").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"), F.min("seq").alias("first_seq"))


def redrive(q: DataFrame, *, now: int, limit: int) -> DataFrame:
    """Dead messages returned to their source: fresh attempts, visible now."""
    back = q.where("dead_letter_source IS NOT NULL AND lease_id IS NULL").orderBy("seq").limit(limit)
    return back.select("seq", "id", "dead_letter_source", F.lit(0).alias("attempts"), F.lit(now).alias("visible_at"))


def alarm_delay(retry: Column) -> Column:
    """Milliseconds to the next try: doubling from 2 s, null once given up."""
    return F.when(retry < ALARM_TRIES, F.lit(ALARM_FIRST_MS) * F.pow(F.lit(2), F.greatest(F.lit(0), F.least(retry, F.lit(ALARM_DOUBLINGS)))).cast("bigint"))


def workflow_delay(kind: Column, base: Column, attempt: Column) -> Column:
    """constant, linear or exponential backoff of a workflow step."""
    return F.when(kind == "exponential", base * F.pow(F.lit(2), attempt - 1)).when(kind == "linear", base * attempt).otherwise(base).cast("bigint")
