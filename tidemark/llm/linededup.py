"""Line dedup by a deletion-neighbourhood join (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import own_name, release, store, table

#: Lines with fewer characters, trimmed, have no neighbours at one edit (any two single letters would); equal ones are repeats all the same.
MIN_CHARS = 12
#: Lines with fewer characters, trimmed, stay even where they repeat: empty ones, which only part others.
MIN_EXACT = 1
#: Characters of a part of a line in which single characters are deleted; longer parts lose blocks first.
SHORT_PART = 96
#: Blocks that a line is cut into before single characters are deleted.
BLOCKS = 8
_LINES = 2**32
_LAST_DOC = 2**63 - 1
RANK = "decimal(38,0)"


def normalised(line: Column) -> Column:
    return F.lower(F.expr("trim(BOTH ' \t\r' FROM {0})".format(line if isinstance(line, str) else "line")))


def occurrences(docs: DataFrame, least: int) -> DataFrame:
    """One row per line long enough: doc_id, text_hash, line_no, rank, norm."""
    exploded = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    rank = F.coalesce("doc_id", F.lit(_LAST_DOC)).cast(RANK) * F.lit(_LINES).cast("decimal(11,0)") + F.col("line_no")
    rows = exploded.select("doc_id", "text_hash", "line_no", rank.cast(RANK).alias("rank"), normalised("line").alias("norm"))
    return rows.where(F.char_length("norm") >= least)


def _half_keys() -> Column:
    """A line's halves: two lines one edit apart share the first or the second half of the shorter one."""
    n = F.char_length("norm")
    halves = F.array_distinct(F.array(F.floor(n / 2).cast("int"), F.floor((n - 1) / 2).cast("int")))
    key = lambda h, side: F.xxhash64(h, F.lit(side), F.left(F.col("norm"), h) if side == 0 else F.right(F.col("norm"), h))
    return F.flatten(F.transform(halves, lambda h: F.array(key(h, 0), key(h, 1))))


def _shared(rows: DataFrame, key: str) -> DataFrame:
    """The rows whose key occurs twice or more."""
    often = rows.groupBy(key).agg(F.count("*").alias("_n")).where("_n > 1").select(key)
    return rows.join(often, key)


def _without_blocks(parts: DataFrame, spent: list[DataFrame]) -> DataFrame:
    """(rank, context, part, longer) of the blocks whose loss makes a part equal another's: each is cut into BLOCKS blocks.

    parts: rank, context (a hash of all that was cut off so far), part, longer
    (the part has one character more than its partner's shorter side). Two parts
    under one context that are one edit apart are equal without some block at
    the same place, counted by the shorter length.
    """
    cut = parts.withColumn("n", F.char_length("part") - F.col("longer").cast("int")).withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1))))
    start, end = F.floor(F.col("q") * F.col("n") / BLOCKS).cast("int"), F.floor((F.col("q") + 1) * F.col("n") / BLOCKS).cast("int")
    cut = cut.withColumns({"start": start, "rest": F.col("n") - end})
    keyed = cut.select("rank", F.col("context").alias("above"), "q", "longer", F.xxhash64("context", "n", "q", F.left("part", F.col("start")), F.right("part", F.col("rest"))).alias("context"))
    meeting = store(_shared(keyed, "context"), "blocks")
    spent.append(meeting)
    inner = meeting.join(parts.withColumnRenamed("context", "above"), ["rank", "above", "longer"]).withColumn("n", F.char_length("part") - F.col("longer").cast("int")).withColumns({"start": start, "rest": F.col("n") - end})
    return inner.select("rank", "context", F.expr("substring(part, start + 1, char_length(part) - rest - start)").alias("part"), "longer")


def near_lines(lines: DataFrame, texts: DataFrame, spent: list[DataFrame]) -> DataFrame:
    """Pairs (rank, first): lines one edit apart, ``first`` the earlier.

    lines: rank, halves (of distinct lines); texts: rank, norm, of at least the
    lines that share a half. For every line the neighbourhood of one edit is
    emitted as hashed keys: the line less one character (and the line itself,
    for partners one longer), keyed with the position where lengths are equal,
    so that all lines under a key are one edit apart and the earliest of them
    is a minimum, not a pair join. To emit only neighbourhoods that can meet, a
    line first loses whole blocks: lines that equal no other after losing any
    block have no partner, and the others go on with that block alone, block
    within block while it is long, so that a line of n characters costs n log n.
    Tables stored on the way are added to ``spent``.
    """
    halves = lines.select("rank", F.explode("halves").alias("half"))
    candidates = _shared(halves, "half").select("rank").distinct()
    texts = store(texts.join(candidates, "rank").select("rank", "norm"), "linetexts")
    # Each line is the shorter or the longer of a pair, or as long as its partner.
    parts = texts.select("rank", F.col("norm").alias("part"), F.explode(F.array(F.lit(False), F.lit(True))).alias("longer"))
    parts = parts.withColumn("context", F.xxhash64((F.char_length("part") - F.col("longer").cast("int")).alias("n")))
    parts = parts.where(F.col("longer") <= (F.char_length("part") > 0)).select("rank", "context", "part", "longer")
    ready: list[DataFrame] = []
    while True:
        inner = store(_without_blocks(parts, spent), "parts")
        spent.append(inner)
        ready.append(inner.where(F.char_length("part") <= SHORT_PART))
        parts = inner.where(F.char_length("part") > SHORT_PART)
        if parts.isEmpty():
            break
    short = ready[0]
    for more in ready[1:]:
        short = short.unionByName(more)

    size = F.char_length("part")
    positions = F.when(size > 0, F.sequence(F.lit(1), size)).otherwise(F.array().cast("array<int>"))
    less = lambda j: F.concat(F.left(F.col("part"), j - 1), F.expr("part").substr(j + 1, size))
    shorter = F.transform(positions, lambda j: F.struct(F.xxhash64("context", F.lit(0), less(j)).alias("key"), F.lit(2).alias("role")))
    swapped = F.transform(positions, lambda j: F.struct(F.xxhash64("context", j, less(j)).alias("key"), F.lit(0).alias("role")))
    itself = F.array(F.struct(F.xxhash64("context", F.lit(0), "part").alias("key"), F.lit(1).alias("role")))
    variants = short.select("rank", F.explode(F.when(F.col("longer"), shorter).otherwise(F.concat(itself, swapped))).alias("v"))
    variants = store(variants.select("rank", "v.key", "v.role").distinct(), "variants")
    spent += [texts, variants]

    of = lambda role: F.min(F.when(F.col("role") == role, F.col("rank")))
    met = variants.groupBy("key").agg(F.count("*").alias("n"), of(0).alias("m0"), of(1).alias("m1"), of(2).alias("m2")).where("n > 1").drop("n")
    partner = F.when(F.col("role") == 0, F.col("m0")).when(F.col("role") == 1, F.col("m2")).otherwise(F.col("m1"))
    pairs = variants.join(met, "key").select("rank", partner.alias("first")).where("first < rank").distinct()
    checked = pairs.join(texts.select("rank", F.col("norm").alias("a")), "rank").join(texts.select(F.col("rank").alias("first"), F.col("norm").alias("b")), "first")
    return checked.where(F.levenshtein("a", "b", 1) == 1).groupBy("rank").agg(F.min("first").alias("first"))


def repeated_lines(docs: DataFrame, *, min_chars: int = MIN_CHARS, min_exact: int = MIN_EXACT) -> DataFrame:
    """The lines to remove: doc_id, text_hash, line_no, first_doc_id, first_line_no, edits.

    docs: doc_id, text (more columns are ignored). Lines are parts of the text
    between line feeds, counted from 0, compared trimmed and lower-cased. A line
    goes if an earlier one, by (doc_id, line_no), equals it (edits 0) or is one
    character insertion, deletion or substitution away (edits 1); the earliest
    such line is named. Lines are compared as they stand in the input, so a line
    goes also where its earlier neighbour goes. Lines of fewer than
    ``min_chars`` characters have no neighbours at one edit; of fewer than
    ``min_exact`` they always stay.

    A null text has no lines. Documents without doc_id come last; lines of
    equal rank (repeated rows, or documents that share a doc_id) do not
    precede each other. An empty table gives an empty result.

    Equal lines are collapsed first, by digest with map-side combine, so a line
    that a third of all documents hold is one line afterwards.
    """
    rows = occurrences(docs, min_exact)
    halves = F.when(F.char_length("norm") >= min_chars, _half_keys())
    narrow = store(rows.select("doc_id", "text_hash", "line_no", "rank", F.xxhash64("norm").alias("d1"), F.xxhash64(F.lit(1), "norm").alias("d2"), halves.alias("halves")), "lines")
    keys = [F.min(F.get("halves", F.lit(i))).alias(f"h{i}") for i in range(4)]
    distinct = narrow.groupBy("d1", "d2").agg(F.min("rank").alias("rank"), F.count("*").alias("n"), *keys)
    halves = F.filter(F.array(*(f"h{i}" for i in range(4))), lambda h: h.isNotNull())
    distinct = store(distinct.select("d1", "d2", "rank", "n", halves.alias("halves")), "distinct")
    spent: list[DataFrame] = []
    near = store(near_lines(distinct, rows.where(F.char_length("norm") >= min_chars).select("rank", "norm"), spent), "near")
    for table_ in spent:
        release(table_)
    verdict = distinct.join(near, "rank", "left").where("n > 1 OR first IS NOT NULL").select("d1", "d2", F.col("rank").alias("own"), "first")
    hit = narrow.select("doc_id", "text_hash", "line_no", "rank", "d1", "d2").join(verdict, ["d1", "d2"]).where("first IS NOT NULL OR rank > own")
    first = F.coalesce(F.least("first", F.when(F.col("rank") > F.col("own"), F.col("own"))), "own")
    edits = F.when(F.col("rank") > F.col("own"), 0).otherwise(1)
    doc = F.floor(first / F.lit(_LINES).cast("decimal(11,0)"))
    return hit.select(
        "doc_id",
        "text_hash",
        "line_no",
        F.when(doc < _LAST_DOC, doc.cast("bigint")).alias("first_doc_id"),
        (first - doc * F.lit(_LINES).cast("decimal(11,0)")).cast("int").alias("first_line_no"),
        edits.alias("edits"),
    )


def dedup_lines(docs: DataFrame, *, min_chars: int = MIN_CHARS, min_exact: int = MIN_EXACT) -> DataFrame:
    """docs with the lines of ``repeated_lines`` taken out of text; n_chars, if there, follows. No row goes; columns may have any names."""
    key, own, gone, parts = (own_name(docs, f"_{x}") for x in ("doc", "hash", "gone", "parts"))
    found = repeated_lines(docs, min_chars=min_chars, min_exact=min_exact).groupBy(F.col("doc_id").alias(key), F.col("text_hash").alias(f"{own}_")).agg(F.collect_set("line_no").alias(gone))
    marked = docs.withColumn(own, F.xxhash64("text"))
    joined = marked.join(found, F.col("doc_id").eqNullSafe(F.col(key)) & (F.col(own) == F.col(f"{own}_")), "left")
    stay = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), gone)
    text = F.when(F.col(gone).isNull(), F.col("text")).otherwise(F.array_join(F.transform(stay, lambda i: F.get(F.col(parts), i)), "\n"))
    out = joined.withColumn(parts, F.split("text", "\n")).withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(gone).isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select(*docs.columns)


def op1_line_dedup(spark, sf_dir: str) -> DataFrame:
    return repeated_lines(table(spark, sf_dir, "documents")).drop("text_hash")


#: Pairs are sought among lines that share the first or second half of the shorter one, and verified by edit distance.
OP1_SQL = f"""
WITH raw AS (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents),
line AS (SELECT doc_id, unnest(range(0, len(parts))) AS line_no, lower(trim(unnest(parts), ' ' || chr(9) || chr(13))) AS norm FROM raw),
occ AS (SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, norm, doc_id * 100000000 + line_no AS rank FROM line WHERE length(norm) >= {MIN_EXACT}),
uniq AS (SELECT norm, length(norm) AS n, min(rank) AS rank FROM occ GROUP BY norm),
long AS (SELECT * FROM uniq WHERE n >= {MIN_CHARS}),
short AS (SELECT norm, rank, n, n // 2 AS h FROM long),
cand AS (
  SELECT a.norm AS x, a.rank AS rx, b.norm AS y, b.rank AS ry FROM short a
    JOIN (SELECT norm, rank, n, unnest([n // 2, (n - 1) // 2]) AS h FROM long) b ON a.h = b.h AND left(a.norm, a.h) = left(b.norm, b.h) AND b.n IN (a.n, a.n + 1) AND a.rank <> b.rank
  UNION
  SELECT a.norm, a.rank, b.norm, b.rank FROM short a
    JOIN (SELECT norm, rank, n, unnest([n // 2, (n - 1) // 2]) AS h FROM long) b ON a.h = b.h AND right(a.norm, a.h) = right(b.norm, b.h) AND b.n IN (a.n, a.n + 1) AND a.rank <> b.rank),
pair AS (SELECT * FROM cand WHERE levenshtein(x, y) = 1),
near AS (
  SELECT norm, min(first) AS first FROM (SELECT x AS norm, ry AS first, rx AS own FROM pair UNION ALL SELECT y, rx, ry FROM pair) WHERE first < own GROUP BY norm),
hit AS (
  SELECT occ.doc_id, occ.line_no, CASE WHEN occ.rank > u.rank THEN 0 ELSE 1 END AS edits, least(coalesce(near.first, u.rank), CASE WHEN occ.rank > u.rank THEN u.rank ELSE near.first END) AS first
  FROM occ JOIN uniq u USING (norm) LEFT JOIN near USING (norm) WHERE occ.rank > u.rank OR near.first IS NOT NULL)
SELECT doc_id, line_no, first // 100000000 AS first_doc_id, CAST(first % 100000000 AS INTEGER) AS first_line_no, edits FROM hit
"""
