"""Derivations from a set of change records.

A stream is (script, class, cell, facet, incarnation), root facets ''. A
position in it is (epoch, txid, commit), ordered part by part. Records arrive at
least once, in any order and in fragments; every function here depends on the
set of records alone, never on the order of arrival.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.walks import dealt, tasks_for, walk
from tidemark.storage import store

STREAM = ["script", "class", "cell", "facet", "incarnation"]
POSITION = ["epoch", "txid", "commit"]
TABLE = ["table_name", "generation"]
ROW_KINDS = ("rows", "snapshot")
BODY = "columns array<string>, key_columns array<string>, rows array<array<string>>"


def position(*prefix: str) -> Column:
    """A struct that compares as positions do."""
    return F.struct(*(F.col(f"{''.join(prefix)}{p}").alias(p) for p in POSITION))


def position_key(*parts: str) -> Column:
    """Text of 62 characters whose order is the order of positions."""
    return F.concat_ws(".", *(F.lpad(F.col(p).cast("string"), 20, "0") for p in parts or POSITION))


def origin_rank() -> Column:
    """Of records at one position, repair supersedes snapshot supersedes live."""
    return F.when(F.col("origin") == "repair", 2).when(F.col("origin") == "snapshot", 1).otherwise(0)


#: What makes two deliveries the same record; ``_target`` and ``_bulk`` come with ``keyed``.
RECORD_KEY = [*STREAM, *POSITION, "kind", "origin", *TABLE, "snapshot_id", "_target", "_bulk"]
#: Kinds of records that may come in fragments.
SPLITTABLE = ("rows", "snapshot")


def _has(df: DataFrame, name: str, kind: str) -> Column:
    return F.col(name).cast(kind) if name in df.columns else F.lit(None).cast(kind)


def keyed(records: DataFrame) -> DataFrame:
    """Records with the parts of their key that only some kinds have.

    ``_target``: the stream that a deletion names, when not its own, so that two
    facet deletions of one commit stay two. ``_bulk``: the tables that a bulk
    record marks (``bulk_tables``, an array of texts, in any order).
    """
    incarnation = F.coalesce(_has(records, "target_incarnation", "string"), _has(records, "through_incarnation", "string"), F.lit("0"))
    target = F.when((F.col("kind") == "deleted") & _has(records, "target_facet", "string").isNotNull(), F.concat_ws("\0", _has(records, "target_facet", "string"), incarnation))
    bulk = F.when(F.col("kind") == "bulk", F.array_join(F.array_sort(_has(records, "bulk_tables", "array<string>")), "\0"))
    return records.withColumns({"_target": target, "_bulk": bulk})


def first_deliveries(records: DataFrame) -> DataFrame:
    """One delivery of each fragment of each record.

    Deliveries of one fragment are equal but for where and when they landed,
    so whichever comes is taken. Few come twice, so nothing is lost by dealing
    them before: the sort that finds repeats then has a task's share of rows.
    """
    return dealt(keyed(records), tasks_for(records), *RECORD_KEY).dropDuplicates([*RECORD_KEY, "fragment", "fragments"]).drop("_target", "_bulk")


def _judged(records: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Single records, fragments with ``_fault`` and ``_here``, and single records out of range; each once.

    The exchange is by record key, which serves the removal of repeats and the
    window over a record's fragments alike; records of one fragment, nearly all,
    never enter the window.
    """
    once = dealt(keyed(records), tasks_for(records), *RECORD_KEY).dropDuplicates([*RECORD_KEY, "fragment", "fragments"])
    off = ~(F.col("fragment").between(1, F.col("fragments")))
    single = once.where("fragments = 1 AND fragment = 1")
    stray = once.where(off).withColumn("_fault", F.lit("out_of_range"))
    parts = once.where((F.col("fragments") > 1) & ~off)
    head = F.xxhash64(F.col("fragments"), *(F.col(c).cast("string") for c in ("cell_name", "committed_at", "node") if c in records.columns), *([F.get_json_object("body", "$.columns"), F.get_json_object("body", "$.key_columns")] if "body" in records.columns else []))
    own = Window.partitionBy(*RECORD_KEY)
    fault = F.when(~F.col("kind").isin(*SPLITTABLE), "not_splittable").when(F.min("_head").over(own) != F.max("_head").over(own), "inconsistent")
    judged = parts.withColumn("_head", head).withColumns({"_fault": fault, "_here": F.count("*").over(own)}).drop("_head")
    return single, judged, stray


def whole_records(records: DataFrame) -> DataFrame:
    """Fragments of records of which all have come; incomplete and faulty records go.

    A fragment number outside 1 to ``fragments`` is set aside before anything is
    counted. Fragments that disagree on anything but their number and rows, and
    fragments of kinds that are never split, make the record faulty: see
    ``quarantined``. Nulls in fragment or fragments are out of range.
    """
    single, judged, _ = _judged(records)
    whole = judged.where("_fault IS NULL AND _here = fragments").drop("_fault", "_here")
    return single.unionByName(whole).drop("_target", "_bulk")


def quarantined(records: DataFrame) -> DataFrame:
    """Fragments that no record can be made of, once each, with ``fault``: out_of_range, not_splittable or inconsistent."""
    _, judged, stray = _judged(records)
    return judged.where("_fault IS NOT NULL").drop("_here").unionByName(stray).withColumnRenamed("_fault", "fault").drop("_target", "_bulk")


def reassembled(whole: DataFrame) -> DataFrame:
    """Whole fragments joined into records of one fragment: the rows of all, in the order of the fragments."""
    key = [c for c in RECORD_KEY if not c.startswith("_")]
    single, parts = whole.where("fragments = 1"), whole.where("fragments > 1")
    rows = F.from_json(F.get_json_object("body", "$.rows"), "array<string>")
    rest = [F.first(c).alias(c) for c in whole.columns if c not in {*key, "fragment", "fragments", "body"}]
    joined = parts.withColumn("_rows", rows).groupBy(*key).agg(*rest, F.min_by("body", "fragment").alias("body"), F.array_sort(F.collect_list(F.struct("fragment", "_rows"))).alias("_parts"))
    texts = F.array_join(F.flatten(F.transform("_parts", lambda p: p["_rows"])), ",")
    body = F.concat(F.lit('{"columns":'), F.get_json_object("body", "$.columns"), F.lit(',"key_columns":'), F.get_json_object("body", "$.key_columns"), F.lit(',"rows":['), texts, F.lit("]}"))
    one = joined.withColumns({"body": body, "fragment": F.lit(1).cast(whole.schema["fragment"].dataType), "fragments": F.lit(1).cast(whole.schema["fragments"].dataType)}).drop("_parts")
    return single.unionByName(one.select(*whole.columns))


def deletion_cuts(meta: DataFrame) -> DataFrame:
    """Per stream the newest position at which it was deleted by itself: STREAM, cut."""
    own = meta.where("kind = 'deleted' AND target_facet IS NULL")
    return own.groupBy(*STREAM).agg(F.max(position()).alias("cut"))


def above_deletions(records: DataFrame, meta: DataFrame) -> DataFrame:
    """Records after their stream's deletion."""
    joined = records.join(deletion_cuts(meta), STREAM, "left")
    return joined.where(F.col("cut").isNull() | (position() > F.col("cut"))).drop("cut")


def facet_deletions(streams: DataFrame, meta: DataFrame) -> DataFrame:
    """Facet streams removed by a record of their root.

    With ``through``: incarnations up to it, at the target's path, and under it
    if subtree. Without: the target's incarnation (any if absent) at the path,
    and with subtree all that is strictly under it. An equi-join on the cell
    with the path test as residual.
    """
    orders = meta.where("kind = 'deleted' AND target_facet IS NOT NULL").select("script", "class", "cell", "target_facet", "target_incarnation", "subtree", "through_incarnation").distinct()
    under = F.col("facet").startswith(F.concat("target_facet", F.lit("/")))
    at = F.col("facet") == F.col("target_facet")
    bounded = (F.col("incarnation") <= F.col("through_incarnation")) & (at | (F.col("subtree") & under))
    exact = (at & (F.col("target_incarnation").isNull() | (F.col("incarnation") == F.col("target_incarnation")))) | (F.col("subtree") & under)
    hit = F.when(F.col("through_incarnation").isNotNull(), bounded).otherwise(exact)
    facets = streams.where("facet <> ''").select(*STREAM).distinct()
    return facets.join(orders, ["script", "class", "cell"]).where(hit).select(*STREAM).distinct()


def without_tombstones(rows: DataFrame, tombstones: DataFrame) -> DataFrame:
    """Rows of streams that no active tombstone names; a tombstone without incarnation names all.

    Two anti joins on equal keys instead of one with OR, so both can hash.
    """
    active = tombstones.where("cleared_at IS NULL")
    exact = active.where("incarnation IS NOT NULL").select(*STREAM).distinct()
    wide = active.where("incarnation IS NULL").select(*STREAM[:-1]).distinct()
    return rows.join(exact, STREAM, "left_anti").join(wide, STREAM[:-1], "left_anti")


def route(landed: DataFrame, tombstones: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Landed records as (row changes, other records), facets filled, times typed, erased streams left out."""
    typed = landed.withColumns({"facet": F.coalesce("facet", F.lit("")), "committed_at": F.timestamp_millis("committed_at")})
    kept = without_tombstones(typed, tombstones)
    rows = F.col("kind").isin(*ROW_KINDS)
    return kept.where(rows), kept.where(~rows)


def snapshot_cuts(records: DataFrame) -> DataFrame:
    """Complete snapshots: an end whose count equals the snapshot records with its id and position.

    STREAM, scope, table_name and generation (null in stream scope), POSITION,
    origin, snapshot_id, cut. records are whole, with ``scope`` and
    ``expected`` on ends and one table per table-scoped end.
    """
    parts = records.where("kind = 'snapshot' AND fragment = 1").groupBy(*STREAM, *POSITION, "snapshot_id").agg(F.count("*").alias("_n"))
    ends = records.where("kind = 'snapshot_end'").drop("_n")
    joined = ends.join(parts, [*STREAM, *POSITION, "snapshot_id"], "left").where(F.coalesce("_n", F.lit(0)) == F.col("expected"))
    cut = F.struct(position().alias("position"), origin_rank().alias("rank"), F.col("snapshot_id").alias("id"))
    tables = [F.when(F.col("scope") == "tables", F.col(t)).alias(t) for t in TABLE]
    return joined.select(*STREAM, "scope", *tables, *POSITION, "origin", "snapshot_id", cut.alias("cut"))


def winning_cuts(cuts: DataFrame) -> DataFrame:
    """The greatest (position, origin, id) per stream and scope."""
    return cuts.groupBy(*STREAM, "scope", *TABLE).agg(F.max("cut").alias("cut"))


def generations(records: DataFrame, cuts: DataFrame) -> DataFrame:
    """STREAM, TABLE, opened, closed, cut, uncertain of every table generation.

    Opened at the least position that names it; closed if dropped, if the name
    has a higher generation, or if a table renamed from the name appears at or
    after opening. cut is the better of the stream's and the table's
    snapshot; uncertain means that a bulk record lies above it.
    """
    named = records.where("table_name IS NOT NULL AND kind IN ('rows', 'snapshot', 'schema', 'bulk')")
    opened = named.groupBy(*STREAM, *TABLE).agg(
        F.min(position()).alias("opened"),
        F.bool_or(F.coalesce("dropped", F.lit(False)) & (F.col("kind") == "schema")).alias("dropped"),
        F.max(F.when(F.col("kind") == "bulk", position())).alias("bulk"),
    )
    newest = F.max("generation").over(Window.partitionBy(*STREAM, "table_name"))
    renames = records.where("kind = 'schema' AND renamed_from IS NOT NULL").groupBy(*STREAM, F.col("renamed_from").alias("table_name")).agg(F.max(position()).alias("renamed"))
    joined = opened.withColumn("newest", newest).join(renames, [*STREAM, "table_name"], "left")
    closed = F.col("dropped") | (F.col("newest") > F.col("generation")) | F.coalesce(F.col("renamed") >= F.col("opened"), F.lit(False))
    best = winning_cuts(cuts)
    whole = best.where("scope = 'stream'").select(*STREAM, F.col("cut").alias("stream_cut"))
    single = best.where("scope = 'tables'").select(*STREAM, *TABLE, F.col("cut").alias("table_cut"))
    cut = F.greatest("stream_cut", "table_cut")
    full = joined.join(whole, STREAM, "left").join(single, [*STREAM, *TABLE], "left").withColumn("cut", cut).withColumn("closed", closed)
    uncertain = ~F.col("closed") & F.col("bulk").isNotNull() & (F.col("cut").isNull() | (F.col("bulk") > F.col("cut.position")))
    return full.select(*STREAM, *TABLE, "opened", "closed", "cut", uncertain.alias("uncertain"))


def row_changes(records: DataFrame) -> DataFrame:
    """One row per change of whole row records: op, key and row as JSON text, columns, and where it stood."""
    parsed = records.where(F.col("kind").isin(*ROW_KINDS)).withColumn("_b", F.from_json("body", BODY))
    exploded = parsed.select(*STREAM, *POSITION, "kind", "origin", *TABLE, "snapshot_id", "fragment", "_b.columns", F.posexplode("_b.rows").alias("index", "_r"))
    return exploded.select("*", F.get("_r", F.lit(0)).alias("op"), F.get("_r", F.lit(1)).alias("key"), F.get("_r", F.lit(2)).alias("row")).drop("_r")


def latest_rows(records: DataFrame, gens: DataFrame) -> DataFrame:
    """The live row of every key of open generations: STREAM, TABLE, key, row, columns, POSITION.

    Rows of the winning snapshot, and changes strictly above its cut; of each
    key the last by position, origin, fragment and place, unless a deletion.
    The key is compared as canonical JSON text, which keeps 1 and 1.0 apart.
    An aggregate by row key, not by stream, so one busy stream spreads out.
    """
    live = row_changes(records).join(gens.where("NOT closed").select(*STREAM, *TABLE, "cut"), [*STREAM, *TABLE])
    snap = (F.col("kind") == "snapshot") & (F.col("snapshot_id") == F.col("cut.id")) & (origin_rank() == F.col("cut.rank")) & (position() == F.col("cut.position"))
    change = (F.col("kind") == "rows") & (F.col("cut").isNull() | (position() > F.col("cut.position")))
    order = F.struct(*POSITION, origin_rank().alias("r"), "fragment", "index")
    newest = live.where(snap | change).groupBy(*STREAM, *TABLE, "key").agg(F.max_by(F.struct("op", "row", "columns", *POSITION), order).alias("v"))
    return newest.where("v.op <> 'D'").select(*STREAM, *TABLE, "key", "v.row", "v.columns", *(F.col(f"v.{p}") for p in POSITION))


def affinity(declared: str) -> str:
    """The column type of a declared SQLite type; the order of the tests matters."""
    name = (declared or "").upper()
    for kind, marks in (("integer", ("INT",)), ("text", ("CHAR", "CLOB", "TEXT")), ("blob", ("BLOB",)), ("real", ("REAL", "FLOA", "DOUB"))):
        if any(m in name for m in marks):
            return kind
    return "variant"


def projection(schemas: list[tuple[str, str]]) -> dict[str, str]:
    """Typed columns of the union of generations: (name, declared type) in order seen; a disagreement makes a variant."""
    found: dict[str, str] = {}
    for name, declared in schemas:
        kind = affinity(declared)
        found[name] = kind if found.setdefault(name, kind) == kind else "variant"
    if not found:
        raise ValueError("no schema")
    return found


def typed(token: Column, kind: str) -> Column:
    """A JSON token as a typed value; null where it doesn't fit."""
    tag = lambda name: F.get_json_object(token, f"$.{name}")
    if kind == "integer":
        return token.try_cast("decimal(38,0)")
    if kind == "real":
        return F.coalesce(tag("$real").try_cast("double"), token.try_cast("double"))
    if kind == "blob":
        return F.try_to_binary(tag("$blob"), F.lit("base64"))
    if kind == "text":
        return F.when(token.startswith("{") | (token == "null"), None).otherwise(token)
    return token


def typed_rows(rows: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Rows with one typed column per name, looked up in the record's own columns; missing ones are null."""
    values = rows.withColumn("_v", F.from_json("row", "array<string>"))
    at = lambda name: F.nullif(F.array_position("columns", name), F.lit(0))
    out = {name: typed(F.try_element_at("_v", at(name).cast("int")), kind) for name, kind in columns.items()}
    return values.withColumns(out).drop("_v", "columns")


def certified_heads(sent: DataFrame, marks: DataFrame, *, tasks: int | None = None) -> DataFrame:
    """The position up to which each stream's epoch is provably complete: STREAM, epoch, txid, commit.

    sent: STREAM, POSITION of live records; marks: STREAM, epoch, from_txid and
    from_commit (null in the first), txid, commit, commits, records. A mark
    holds if (from, through] has as many records and distinct positions as it
    says; heads follow holding marks from -> through, from the first on. Repeated
    marks count once; of several that hold from one position the nearest is followed.

    Counts come from running totals over the union of records and marks, so
    the range join becomes one sort per (stream, epoch) of counts, one row per
    position: records at a position are pre-aggregated. Only totals where a mark
    begins or ends go on. Marks and totals are read several times, so both are
    stored. ``tasks``: ``tasks_for(sent)``.
    """
    keys = [*STREAM, "epoch"]
    sent, marks = dealt(sent, tasks, *keys), dealt(marks, tasks, *keys)
    marks = store(marks.select(*keys, "from_txid", "from_commit", "txid", "commit", "commits", "records").distinct(), "marks")
    points = sent.groupBy(*keys, "txid", "commit").agg(F.count("*").alias("n")).select(*keys, "txid", "commit", "n", F.lit(1).alias("p"), F.lit(0).alias("e"))
    ends = marks.select(*keys, "txid", "commit").union(marks.where("from_txid IS NOT NULL").select(*keys, "from_txid", "from_commit")).distinct()
    both = points.unionByName(ends.select(*keys, "txid", "commit", F.lit(0).alias("n"), F.lit(0).alias("p"), F.lit(1).alias("e")))
    at = both.groupBy(*keys, "txid", "commit").agg(F.sum("n").alias("n"), F.sum("p").alias("p"), F.max("e").alias("e"))
    upto = Window.partitionBy(*keys).orderBy("txid", "commit")
    totals = store(at.select(*keys, "txid", "commit", "e", F.sum("n").over(upto).alias("tn"), F.sum("p").over(upto).alias("tp")).where("e = 1").drop("e"), "totals")
    through = marks.join(totals, [*keys, "txid", "commit"])
    start = totals.select(*keys, F.col("txid").alias("from_txid"), F.col("commit").alias("from_commit"), F.col("tn").alias("fn"), F.col("tp").alias("fp"))
    judged = through.join(start, [*keys, "from_txid", "from_commit"], "left")
    holds = (F.col("tn") - F.coalesce("fn", F.lit(0)) == F.col("records")) & (F.col("tp") - F.coalesce("fp", F.lit(0)) == F.col("commits"))
    later = F.col("from_txid").isNull() | (F.struct("txid", "commit") > F.struct(F.col("from_txid").alias("txid"), F.col("from_commit").alias("commit")))
    good = judged.where(holds & later)
    # Of holding marks that start at one position the nearest is followed, so a position has one successor.
    onward = good.groupBy(*keys, "from_txid", "from_commit").agg(F.min(F.struct("txid", "commit")).alias("to"))
    return _followed(onward.select(*keys, "from_txid", "from_commit", "to.txid", "to.commit"), keys, tasks)


def _followed(marks: DataFrame, keys: list[str], tasks: int | None) -> DataFrame:
    """The end of each key's chain of marks from -> (txid, commit), begun by the one without ``from``: keys, txid, commit.

    Ends ascend along a chain, so one pass over a key's marks in order of their
    ends finds it, whatever marks lie between that belong to no chain. A task
    reads its sorted rows as a stream and holds one position.
    """
    kinds = {f.name: f.dataType.simpleString() for f in marks.schema}

    def visit(key: tuple, ends: Iterator[tuple]) -> Iterator[tuple]:
        at = (None, None)
        for *source, txid, commit in ends:
            if tuple(source) == at:
                at = (txid, commit)
        if at[0] is not None:
            yield (*key, *at)

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in [*keys, "txid", "commit"])
    return walk(marks, by=keys, order=["txid", "commit"], take=["from_txid", "from_commit", "txid", "commit"], visit=visit, schema=schema, tasks=tasks)


def recovered_applied(recovered: DataFrame, streams: DataFrame) -> DataFrame:
    """Recoveries, which name no script, applied to streams: the newest root incarnation not after the head's epoch, per script.

    recovered: class, cell, epoch, session, loss; streams: STREAM. Recoveries
    that no stream adopts stay as placeholders with script ''.
    """
    roots = streams.where("facet = ''").select(*STREAM).distinct()
    fits = recovered.join(roots, ["class", "cell"], "left").where("incarnation IS NULL OR incarnation <= epoch")
    newest = fits.groupBy("class", "cell", "epoch", "session", "loss", F.coalesce("script", F.lit("")).alias("script")).agg(F.max("incarnation").alias("incarnation"))
    lost = recovered.join(newest.select("class", "cell", "epoch", "session").distinct(), ["class", "cell", "epoch", "session"], "left_anti")
    none = lost.select("class", "cell", "epoch", "session", "loss", F.lit("").alias("script"), F.lit(None).cast("bigint").alias("incarnation"))
    return newest.unionByName(none)


def state_at(records: DataFrame, epoch: int, txid: int, commit: int) -> DataFrame:
    """Records not after a position, and recovery placeholders: the input of the state as it was then."""
    upto = position() <= F.struct(F.lit(epoch).alias("epoch"), F.lit(txid).alias("txid"), F.lit(commit).alias("commit"))
    return records.where(upto | ((F.col("kind") == "recovered") & (F.col("script") == "")))


def stream_summary(records: DataFrame, whole: DataFrame, certified: DataFrame) -> DataFrame:
    """Per stream: records, nodes, first and last position key, last commit time, certified, snapshot_at, deleted_at.

    nodes: per epoch the nodes that sent its live records; certified: per epoch
    the position up to which it is complete; both maps in order of the epoch.
    snapshot_at: the complete stream snapshot that its state starts from;
    deleted_at: where it was deleted by itself. Both are position keys.
    """
    live = (F.col("origin") == "live") & (F.col("kind") != "recovered")
    base = records.groupBy(*STREAM, "epoch").agg(
        F.count("*").alias("n"),
        F.array_sort(F.collect_set(F.when(live, F.col("node")))).alias("sent"),
        F.min(position_key()).alias("lo"),
        F.max(position_key()).alias("hi"),
        F.max("committed_at").alias("last"),
    )
    summary = base.groupBy(*STREAM).agg(
        F.sum("n").alias("records"),
        F.array_sort(F.collect_list(F.when(F.size("sent") > 0, F.struct("epoch", "sent")))).alias("nodes"),
        F.min("lo").alias("first_key"),
        F.max("hi").alias("last_key"),
        F.max("last").alias("last_committed_at"),
    )
    ends = certified.groupBy(*STREAM).agg(F.array_sort(F.collect_list(F.struct("epoch", "txid", "commit"))).alias("certified"))
    cut = winning_cuts(snapshot_cuts(above_deletions(whole, whole))).where("scope = 'stream'").select(*STREAM, F.struct(*(F.col(f"cut.position.{p}").alias(p) for p in POSITION)).alias("snapshot_at"))
    gone = deletion_cuts(whole).withColumnRenamed("cut", "deleted_at")
    joined = summary.join(ends, STREAM, "left").join(cut, STREAM, "left").join(gone, STREAM, "left")
    key = lambda c: F.when(F.col(c).isNotNull(), F.concat_ws(".", *(F.lpad(F.col(f"{c}.{p}").cast("string"), 20, "0") for p in POSITION)))
    return joined.withColumns({"snapshot_at": key("snapshot_at"), "deleted_at": key("deleted_at")})


def export_gaps(meta: DataFrame, cuts: DataFrame, certified: DataFrame, uncertain: DataFrame, findings: DataFrame | None = None) -> DataFrame:
    """What is missing: STREAM, gap_kind, POSITION of the record that says so, bound_epoch, bound_txid, certified_txid, TABLE, reason.

    gap: a declared gap whose end no stream snapshot covers. link: a link whose
    predecessor lies beyond what is certified of its epoch and isn't covered.
    recovered: a recovery whose head does, or that lost changes and lies before
    what is certified, until a snapshot passes both. bulk: uncertain tables
    (``generations``). reconciler: open findings (STREAM, finding, head_epoch, head_txid).
    The bound is where a repair snapshot must reach.

    meta has to_epoch and to_txid on gaps, prev_epoch and prev_txid on links,
    head_epoch, head_txid and loss on recoveries, and reason.
    """
    covered = winning_cuts(cuts).where("scope = 'stream'").select(*STREAM, F.struct("cut.position.epoch", "cut.position.txid").alias("upto"))
    heads = certified.select(*STREAM, F.col("epoch").alias("bound_epoch"), F.col("txid").alias("certified_txid"))
    of = lambda gap, link, recovered: F.when(F.col("kind") == "gap", F.col(gap)).when(F.col("kind") == "link", F.col(link)).otherwise(F.col(recovered))
    bounded = meta.where("kind IN ('gap', 'link', 'recovered')").withColumns({"bound_epoch": of("to_epoch", "prev_epoch", "head_epoch"), "bound_txid": of("to_txid", "prev_txid", "head_txid")})
    known = bounded.where("bound_epoch IS NOT NULL AND bound_txid IS NOT NULL").join(heads, [*STREAM, "bound_epoch"], "left").join(covered, STREAM, "left")
    lost = (F.col("kind") == "recovered") & F.coalesce("loss", F.lit(False))
    ahead = lost & F.coalesce(F.col("certified_txid") > F.col("bound_txid"), F.lit(False))
    short = F.col("bound_txid") > F.coalesce("certified_txid", F.lit(0))
    known = known.where((F.col("kind") == "gap") | short | ahead).withColumn("bound_txid", F.when(lost, F.greatest("bound_txid", "certified_txid")).otherwise(F.col("bound_txid")))
    known = known.where(F.col("upto").isNull() | (F.struct(F.col("bound_epoch").alias("epoch"), F.col("bound_txid").alias("txid")) > F.col("upto")))
    null = lambda kind: F.lit(None).cast(kind)
    first = known.select(*STREAM, F.col("kind").alias("gap_kind"), *POSITION, "bound_epoch", "bound_txid", "certified_txid", null("string").alias("table_name"), null("bigint").alias("generation"), F.col("reason").cast("string").alias("reason"))
    none = [null("bigint").alias(c) for c in (*POSITION, "bound_epoch", "bound_txid", "certified_txid")]
    bulk = uncertain.select(*STREAM, F.lit("bulk").alias("gap_kind"), *none, *TABLE, F.lit("bulk").alias("reason"))
    found = first.unionByName(bulk)
    if findings is not None:
        found = found.unionByName(findings.select(*STREAM, F.lit("reconciler").alias("gap_kind"), *none[:3], F.col("head_epoch").alias("bound_epoch"), F.col("head_txid").alias("bound_txid"), *none[5:], null("string").alias("table_name"), null("bigint").alias("generation"), F.col("finding").alias("reason")))
    return found.distinct()
