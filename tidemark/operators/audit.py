"""Checks of what was exported against what is stored: inventories, heads, findings, drift, repairs."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.relational import asof_join, range_join
from tidemark.operators.walks import dealt, tasks_for, walk

OBJECT = r"^cells/([^/]+)/ltx/e(\d+)/ltx/(\d)/([0-9a-f]{16})-([0-9a-f]{16})\.ltx$"


def inventory(objects: DataFrame) -> DataFrame:
    """Object names as txid ranges: scope, epoch, level, lo, hi, modified_ms; other names are left out."""
    part = lambda i: F.regexp_extract("key", OBJECT, i)
    number = lambda i: F.conv(part(i), 16, 10).cast("bigint")
    named = objects.where(F.col("key").rlike(OBJECT))
    return named.select(part(1).alias("scope"), part(2).cast("bigint").alias("epoch"), part(3).cast("int").alias("level"), number(4).alias("lo"), number(5).alias("hi"), "modified_ms")


def restorable_cuts(files: DataFrame) -> DataFrame:
    """Per (scope, epoch) all txids reached by contiguous ranges from 0: scope, epoch, txid.

    Ranges in order of (hi, lo) extend what is reached when some reached txid
    lies in [lo - 1, hi). Ranges that begin at 0, or end before they begin, count for nothing.
    """

    def visit(key: tuple, ranges: Iterator[tuple]) -> Iterator[tuple]:
        reached = 0  # what is reached ascends, and all before hi are below it
        for lo, hi in ranges:
            if hi > reached >= lo - 1:
                reached = hi
                yield (*key, hi)

    sound = files.where("lo > 0 AND hi >= lo").select("scope", "epoch", "lo", "hi").distinct()
    return walk(sound, by=["scope", "epoch"], order=["hi", "lo"], take=["lo", "hi"], visit=visit, schema="scope string, epoch bigint, txid bigint", tasks=tasks_for(files))


def restore_plan(files: DataFrame, targets: DataFrame) -> DataFrame:
    """The files to restore a (scope, epoch) to a txid: the newest snapshot not past it, then greedily the file that reaches furthest.

    Returns scope, epoch, step, lo, hi; no rows where the target can't be
    reached. Snapshots come first, then files by their start: one pass keeps the
    furthest reaching of those that start early enough.
    """

    def visit(key: tuple, found: Iterator[tuple]) -> Iterator[tuple]:
        steps: list[tuple[int, int]] = []
        at, best, target = 0, None, None
        for target, snapshot, lo, hi in found:
            if snapshot:
                if not steps or (hi, lo) > steps[0][::-1]:
                    steps, at = [(lo, hi)], hi
                continue
            while at < target and lo > at + 1 and best and best[0] > at:
                steps.append((best[1], best[0]))
                at = best[0]
            if lo > at + 1:
                break
            if best is None or hi > best[0]:
                best = (hi, lo)
        while target is not None and at < target and best and best[0] > at:
            steps.append((best[1], best[0]))
            at = best[0]
        if target is not None and at == target:
            yield from ((*key, i, lo, hi) for i, (lo, hi) in enumerate(steps))

    snapshot = F.col("level") == 9
    tasks = tasks_for(files)
    files, targets = (dealt(x, tasks, "scope", "epoch") for x in (files, targets))
    fit = files.join(targets, ["scope", "epoch"]).where("hi <= target").select("scope", "epoch", "target", snapshot.alias("snapshot"), "lo", "hi").distinct()
    return walk(fit, by=["scope", "epoch"], order=[F.desc("snapshot"), "lo", "hi"], take=["target", "snapshot", "lo", "hi"], visit=visit, schema="scope string, epoch bigint, step int, lo bigint, hi bigint", tasks=tasks)


def epoch_spans(heads: DataFrame) -> DataFrame:
    """Which txids each epoch of a scope serves: up to one before the next epoch's first."""
    following = F.lead("lo").over(Window.partitionBy("scope").orderBy("epoch"))
    return heads.withColumn("served_to", F.coalesce(following - 1, F.col("hi")))


def epoch_chain(files: DataFrame) -> DataFrame:
    """Per scope the epochs that a restore follows, with the first txid each serves: scope, epoch, lo.

    From the newest epoch down: below a continued epoch comes the next whose
    files, but for those that reach its first txid or beyond, end exactly before
    it; an epoch that ends elsewhere (a fenced owner's) is skipped. The chain ends at
    txid 1. Files are read as a stream, newest epoch first.
    """

    def visit(key: tuple, found: Iterator[tuple]) -> Iterator[tuple]:
        above = None
        for epoch, group in groupby(found, key=lambda r: r[0]):
            if above == 1:
                break
            lo = ends = None
            for _, first, last in group:
                if above is None or last < above:
                    lo = first if lo is None else min(lo, first)
                    ends = last if ends is None else max(ends, last)
            if lo is None or above is not None and ends != above - 1:
                continue
            yield (*key, epoch, lo)
            above = lo

    return walk(files, by=["scope"], order=[F.desc("epoch"), "lo", "hi"], take=["epoch", "lo", "hi"], visit=visit, schema="scope string, epoch bigint, lo bigint")


def oldest_holding(files: DataFrame, wanted: DataFrame, *, width: int = 64) -> DataFrame:
    """When each wanted (scope, epoch, txid) was first stored: a range join on bins of ``width`` txids."""
    ranges = files.where("hi >= lo").select("scope", "epoch", "lo", (F.col("hi") + 1).alias("end"), "modified_ms")
    held = range_join(wanted, ranges, by=["scope", "epoch"], at="txid", low="lo", high="end", width=width)
    return held.groupBy("scope", "epoch", "txid").agg(F.min("modified_ms").alias("stored_ms"))


def choose_cut(cuts: DataFrame, wanted: DataFrame) -> DataFrame:
    """The first restorable txid at or after each wanted one; null if none: an as-of join backwards."""
    behind = cuts.select("scope", "epoch", (-F.col("txid")).alias("_back"), F.col("txid").alias("cut"))
    return asof_join(wanted.withColumn("_back", -F.col("txid")), behind, by=["scope", "epoch"], at="_back", keep=["cut"]).drop("_back")


def reconcile(heads: DataFrame, streams: DataFrame, *, now_ms: int, settle_ms: int) -> DataFrame:
    """Findings by cell: gap (head ahead of what is certified), missing_deleted, unknown_stream; each only once its evidence settled.

    heads: cell, head, stored_ms, deleted_ms; streams: cell, certified, deleted, last_ms.
    """
    old = lambda c: F.col(c) + settle_ms <= now_ms
    both = heads.join(streams, "cell", "full_outer")
    kind = (
        F.when(F.col("head").isNull() & F.col("deleted_ms").isNull(), F.when(old("last_ms") & ~F.col("deleted"), "unknown_stream"))
        .when(F.col("deleted_ms").isNotNull(), F.when(old("deleted_ms") & ~F.coalesce("deleted", F.lit(False)), "missing_deleted"))
        .when(old("stored_ms") & (F.col("head") > F.coalesce("certified", F.lit(0))), "gap")
    )
    return both.withColumn("finding", kind).where("finding IS NOT NULL").select("cell", "finding", "head", "certified")


def audit_scopes(heads: DataFrame, files: DataFrame, broken: DataFrame, streams: DataFrame, certified: DataFrame, nodes: DataFrame, losses: DataFrame, tombstones: DataFrame, exported: DataFrame, *, now_ms: int, settle_ms: int) -> DataFrame:
    """What the bucket and the consumer disagree on: scope, finding, epochs, evidence_ms, settled, and scopes passed over as findings of their own.

    heads: scope, class, facet (bool), epoch, txid, modified_ms, first_ms;
    files: scope, epoch, lo, hi, modified_ms of the chain's epochs; broken:
    scope, class, first_ms (objects that form no chain); streams: scope, root,
    class, incarnation, last_ms, deleted, snapshot_epoch, snapshot_txid (root:
    the scope of a facet's root, null for roots); certified: scope,
    incarnation, epoch, txid; nodes: scope, incarnation, epoch, node; losses: node,
    modified_ms; tombstones: scope; exported: class.

    finding is one of gap (an epoch's end lies beyond what is certified and no
    snapshot covers it), lost (certified changes that the chain doesn't hold: past an epoch that
    it left, in an epoch that it skipped, or past the head after a loss of one
    of its nodes), unknown_stream (no stream), unrestorable (broken),
    missing_deleted (a facet without objects whose root has some), or, for what
    isn't judged, not_exported, tombstoned, checked. A scope's stream is the
    newest incarnation not after its head, for facets the last active. Only
    evidence ``settle_ms`` old counts: ``settled``.
    """
    scopes = heads.select("scope", "class").unionByName(broken.select("scope", "class")).distinct()
    tagged = scopes.join(exported.distinct().withColumn("_e", F.lit(True)), "class", "left").join(tombstones.distinct().withColumn("_t", F.lit(True)), "scope", "left")
    tagged = tagged.withColumn("why", F.when(F.col("_e").isNull(), "not_exported").when(F.col("_t").isNotNull(), "tombstoned"))
    open_ = tagged.where("why IS NULL").select("scope")
    live = heads.join(open_, "scope", "left_semi")

    fits = live.select("scope", "facet", F.col("epoch").alias("_head")).join(streams.drop("root", "class"), "scope").where("facet OR incarnation <= _head")
    order = F.when(F.col("facet"), F.struct(F.lit(0).cast("bigint").alias("i"), "last_ms", "incarnation")).otherwise(F.struct(F.col("incarnation").cast("bigint").alias("i"), "last_ms", "incarnation"))
    chosen = fits.groupBy("scope").agg(F.max_by(F.struct("incarnation", "deleted", "snapshot_epoch", "snapshot_txid"), order).alias("s")).select("scope", "s.*")
    unknown = live.join(chosen, "scope", "left_anti").select("scope", F.lit("unknown_stream").alias("finding"), F.lit(None).cast("string").alias("epochs"), F.col("first_ms").alias("evidence_ms"))
    checked = live.join(chosen.where("NOT deleted"), "scope").withColumnRenamed("epoch", "head_epoch")

    ends = files.groupBy("scope", "epoch").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    whole = Window.partitionBy("scope")
    ends = ends.withColumns({"first": F.min("epoch").over(whole), "newest": F.max("epoch").over(whole), "next": F.lead(F.struct("epoch", "lo")).over(whole.orderBy("epoch"))})
    sure = certified.withColumnRenamed("txid", "sure")
    covered = lambda e, t: F.coalesce(F.struct(F.col("snapshot_epoch").alias("e"), F.col("snapshot_txid").alias("t")) >= F.struct(F.col(e).alias("e"), F.col(t).alias("t")), F.lit(False))
    spans = checked.join(ends, "scope").where("facet OR epoch >= incarnation").join(sure, ["scope", "incarnation", "epoch"], "left")

    def landed(rows: DataFrame, epoch: str, txid: str) -> DataFrame:
        """rows with the time at which a txid was first stored, or the head's."""
        wanted = rows.select("scope", F.col(epoch).alias("epoch"), F.col(txid).alias("txid")).distinct()
        stored = oldest_holding(files, wanted).select(F.col("scope").alias("_s"), F.col("epoch").alias("_e"), F.col("txid").alias("_t"), "stored_ms")
        met = rows.join(stored, (F.col("scope") == F.col("_s")) & (F.col(epoch) == F.col("_e")) & (F.col(txid) == F.col("_t")), "left")
        return met.withColumn("evidence_ms", F.coalesce("stored_ms", "modified_ms")).drop("_s", "_e", "_t", "stored_ms")

    short = spans.where((F.coalesce("sure", F.lit(0)) < F.col("hi")) & ~covered("epoch", "hi")).withColumn("missing", F.greatest(F.coalesce(F.col("sure") + 1, F.col("lo")), F.col("lo")))
    short = landed(short, "epoch", "missing").select("scope", F.lit("gap").alias("finding"), "epoch", "evidence_ms")
    past = spans.where((F.col("sure") > F.col("hi")) & ~covered("epoch", "sure"))
    left = landed(past.where("epoch <> newest").withColumns({"next_epoch": F.col("next.epoch"), "next_lo": F.col("next.lo")}), "next_epoch", "next_lo").select("scope", "epoch", "evidence_ms")
    lossy = losses.groupBy("node").agg(F.min("modified_ms").alias("evidence_ms"))
    after_loss = past.where("epoch = newest").select("scope", "incarnation", "epoch").join(nodes, ["scope", "incarnation", "epoch"]).join(lossy, "node").select("scope", "epoch", "evidence_ms")
    range_ = ends.select("scope", "first", "newest").distinct()
    between = checked.join(sure, ["scope", "incarnation"]).join(range_, "scope").where("epoch > first AND epoch < newest").join(ends.select("scope", "epoch"), ["scope", "epoch"], "left_anti").where(~covered("epoch", "sure"))
    onward = ends.select("scope", F.col("epoch").alias("next_epoch"), F.col("lo").alias("next_lo"))
    following = between.join(onward, "scope").where("next_epoch > epoch").groupBy(*between.columns).agg(F.min(F.struct("next_epoch", "next_lo")).alias("n")).select(*between.columns, "n.*")
    skipped = landed(following, "next_epoch", "next_lo").select("scope", "epoch", "evidence_ms")
    lost = left.unionByName(after_loss).unionByName(skipped).withColumn("finding", F.lit("lost"))
    epochs = F.array_join(F.array_sort(F.collect_set("epoch")), ",").alias("epochs")
    compared = short.unionByName(lost.select("scope", "finding", "epoch", "evidence_ms")).groupBy("scope", "finding").agg(epochs, F.min("evidence_ms").alias("evidence_ms"))

    none = F.lit(None).cast("string").alias("epochs")
    useless = broken.join(open_, "scope", "left_semi").select("scope", F.lit("unrestorable").alias("finding"), none, F.col("first_ms").alias("evidence_ms"))
    present = heads.select("scope").unionByName(broken.select("scope")).distinct()
    facets = streams.where("root IS NOT NULL").join(present, "scope", "left_anti").join(present.withColumnRenamed("scope", "root"), "root", "left_semi").join(tombstones, "scope", "left_anti")
    gone = facets.select("scope", F.lit("missing_deleted").alias("finding"), none, F.col("last_ms").alias("evidence_ms"))
    found = unknown.unionByName(compared).unionByName(useless).unionByName(gone).withColumn("settled", F.col("evidence_ms") + settle_ms <= now_ms)
    passed = tagged.where("why IS NOT NULL").select("scope", F.col("why").alias("finding")).unionByName(checked.select("scope", F.lit("checked").alias("finding")))
    return found.unionByName(passed.withColumns({"epochs": F.lit(None).cast("string"), "evidence_ms": F.lit(None).cast("bigint"), "settled": F.lit(None).cast("boolean")}))


def as_records(findings: DataFrame) -> DataFrame:
    """Findings as records of origin repair: gaps at the head, deletions of the root."""
    kind = F.when(F.col("finding") == "missing_deleted", "deleted").otherwise("gap")
    return findings.where("finding <> 'unknown_stream'").select("cell", kind.alias("kind"), F.greatest(F.coalesce("head", F.lit(0)), F.coalesce("certified", F.lit(0))).alias("txid"), F.lit("repair").alias("origin"), F.lit("reconciler").alias("node"))


def compare(expected: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    """Row-level drift by key: missing, extra or changed, and the columns that differ; a column that one side lacks is null there."""
    columns = sorted({*expected.columns, *actual.columns} - {*keys})
    side = lambda df, tag: df.select(*keys, F.struct(*((F.col(c) if c in df.columns else F.lit(None)).alias(c) for c in columns)).alias(tag))
    both = side(expected, "e").join(side(actual, "a"), keys, "full_outer")
    differ = F.filter(F.array(*(F.when(~F.col(f"e.{c}").eqNullSafe(F.col(f"a.{c}")), F.lit(c)) for c in columns)), lambda x: x.isNotNull())
    kind = F.when(F.col("a").isNull(), "missing").when(F.col("e").isNull(), "extra").when(F.size(differ) > 0, "changed")
    return both.select(*keys, kind.alias("drift"), F.when(kind == "changed", F.concat_ws(",", differ)).alias("columns")).where("drift IS NOT NULL")


def net_changes(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """The changes that turn one snapshot into another: op I, U or D by key."""
    op = {"missing": "D", "extra": "I", "changed": "U"}
    found = compare(before, after, keys)
    return found.select(*keys, F.create_map(*(F.lit(x) for kv in op.items() for x in kv))[F.col("drift")].alias("op"), "columns")


def repair_jobs(gaps: DataFrame) -> DataFrame:
    """One job per cell: up to the greatest bound, or to the head (null) if any gap has none, with all its reasons."""
    return gaps.groupBy("cell").agg(F.when(~F.bool_or(F.col("bound").isNull()), F.max("bound")).alias("target"), F.concat_ws(",", F.array_sort(F.collect_set("reason"))).alias("reasons"))


def compact_pages(pages: DataFrame, commit: Column | int) -> DataFrame:
    """Pages of several inputs merged: the last input's wins, pages past the committed size go."""
    newest = pages.groupBy("scope", "page").agg(F.max_by("data", "input").alias("data"), F.max("input").alias("input"))
    return newest.where(F.col("page") <= commit)
