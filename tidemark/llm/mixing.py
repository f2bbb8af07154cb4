"""Mixing sources to target weights by Poisson replication (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import store, table

#: One draw covers a mean of at most this much; larger means are sums of several draws, as exp(-mean) would underflow.
MEAN_PER_DRAW = 500.0
SEED = 20
#: Target weight of a source where none are given: its document count to this power.
ALPHA = 0.5
HEX = 13


def _uniform(*parts: Column) -> Column:
    """In [0, 1): the first 52 bits of an MD5 digest."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, HEX), 16, 10).cast("bigint") / F.lit(float(16**HEX))


def _cdf(mean: Column) -> Column:
    """P(N <= k) of a Poisson variable for k = 0, 1, ... to where the rest is below any 52-bit uniform."""
    last = (mean + 12 * F.sqrt(mean) + 40).cast("int")
    steps = F.aggregate(
        F.sequence(F.lit(1), last),
        F.struct(F.exp(-mean).alias("p"), F.array(F.exp(-mean)).alias("c")),
        lambda s, k: F.struct((s["p"] * mean / k).alias("p"), F.array_append(s["c"], F.element_at(s["c"], -1) + s["p"] * mean / k).alias("c")),
    )
    return steps["c"]


def rates(docs: DataFrame, weights: DataFrame | None = None, alpha: float = ALPHA, epochs: float = 1.0) -> DataFrame:
    """(source, n_docs, rate): the mean number of copies of each document of a source.

    ``weights`` (source, weight) sets the targets; a source that it lacks, or
    whose weight is null or not positive, gets rate 0. Without it a source
    weighs its size to the power ``alpha``. The expected size of the result is
    ``epochs`` times the input.
    """
    sizes = docs.groupBy("source").agg(F.count("*").alias("n_docs"))
    if weights is None:
        weighed = sizes.withColumn("weight", F.pow(F.col("n_docs").cast("double"), F.lit(alpha)))
    else:
        given = weights.groupBy(F.col("source").alias("_w_source")).agg(F.sum("weight").alias("weight"))
        weighed = sizes.join(given, F.col("source").eqNullSafe(F.col("_w_source")), "left").drop("_w_source")
        weighed = weighed.withColumn("weight", F.when(F.col("weight") > 0, F.col("weight").cast("double")).otherwise(0.0))
    total = weighed.agg(F.sum("n_docs").alias("_all"), F.sum("weight").alias("_weights"))
    share = weighed.join(F.broadcast(total), F.lit(True))  # one row
    rate = F.when(F.col("_weights") > 0, F.col("weight") / F.col("_weights") * F.col("_all") * F.lit(float(epochs)) / F.col("n_docs")).otherwise(0.0)
    return share.select("source", "n_docs", rate.alias("rate"))


def poisson_mix(docs: DataFrame, weights: DataFrame | None = None, *, alpha: float = ALPHA, epochs: float = 1.0, seed: int = SEED) -> DataFrame:
    """Repeat each document a Poisson number of times and shuffle the copies globally.

    docs: doc_id, source and any other columns. Returns docs' columns plus
    ``mix_copy`` (1, 2, ... within a document) and ``mix_key`` (the order of the
    shuffled result: rows are dealt over partitions by it and sorted within each).

    The count inverts the Poisson distribution at a uniform number hashed from
    (seed, doc_id), so it does not depend on partitioning or retries. Rows
    with one doc_id are drawn alike; rows without one are drawn by a digest of their text, if there is such a column. A null source is a source of its
    own. Columns named mix_copy or mix_key are replaced. An empty table gives an
    empty result. Only the per-source counts are aggregated (with map-side
    combine), so a source with most rows costs nothing extra.
    """
    docs = docs.drop("mix_copy", "mix_key")
    per_draw = F.ceil(F.greatest(F.col("rate"), F.lit(1e-9)) / F.lit(MEAN_PER_DRAW)).cast("int")
    plan = rates(docs, weights, alpha, epochs).where("rate > 0").select(F.col("source").alias("_mix_source"), per_draw.alias("_mix_draws"), _cdf(F.col("rate") / per_draw).alias("_mix_cdf"))
    plan = store(plan, "plan")  # one row per source: read from files its size is known, and the documents aren't shuffled to meet it if it is small
    joined = docs.join(plan, F.col("source").eqNullSafe(F.col("_mix_source")))
    unnamed = F.md5(F.coalesce("text", F.lit(""))) if "text" in docs.columns else F.lit("null")
    ident = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text "), unnamed))
    uniforms = F.transform(F.sequence(F.lit(1), F.col("_mix_draws")), lambda j: _uniform(F.lit(str(seed)), ident, j.cast("string")))
    drawn = F.aggregate(uniforms, F.lit(0), lambda n, u: n + F.size(F.filter(F.col("_mix_cdf"), lambda c: c <= u)))
    copies = joined.withColumn("_mix_n", drawn).where("_mix_n > 0").drop("_mix_source", "_mix_draws", "_mix_cdf")
    copies = copies.withColumn("mix_copy", F.explode(F.sequence(F.lit(1), F.col("_mix_n")))).drop("_mix_n")
    keyed = copies.withColumn("mix_key", F.md5(F.concat_ws("|", F.lit(f"order{seed}"), ident, F.col("mix_copy").cast("string"))))
    return keyed.repartition("mix_key").sortWithinPartitions("mix_key")


def op6_mix_sources(spark, sf_dir: str) -> DataFrame:
    return poisson_mix(table(spark, sf_dir, "documents"))


OP6_SQL = f"""
WITH sizes AS (SELECT source, count(*) AS n_docs, pow(count(*), {ALPHA}) AS weight FROM documents GROUP BY source),
rate AS (SELECT source, weight / sum(weight) OVER () * sum(n_docs) OVER () / n_docs AS rate FROM sizes),
cdf AS (
  SELECT source, k, sum(exp(k * ln(rate) - rate - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS c
  FROM rate, range(0, 200) t(k)),
u AS (SELECT doc_id, source, CAST(concat('0x', substr(md5(concat('{SEED}|', doc_id, '|1')), 1, {HEX})) AS BIGINT) / CAST(16 AS DOUBLE) ** {HEX} AS u FROM documents),
n AS (SELECT doc_id, count(*) AS n FROM u JOIN cdf ON u.source IS NOT DISTINCT FROM cdf.source AND cdf.c <= u.u GROUP BY doc_id)
SELECT d.*, CAST(t.k AS INTEGER) AS mix_copy, md5(concat('order{SEED}|', d.doc_id, '|', t.k)) AS mix_key
FROM documents d JOIN n USING (doc_id), range(1, 200) t(k) WHERE t.k <= n.n
"""
