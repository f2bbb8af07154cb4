"""Quality rules: robust multivariate outliers of text statistics, by language and source."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import release, store, table
from tidemark.llm.textstats import FIELDS, text_stats

#: A group of n documents counts n / (n + this) of its documents' distances, its language the like share of the rest, and all documents of what is left.
PRIOR_DOCS = 200.0
#: Share of the documents that a minimum-covariance-determinant fit covers.
COVERED = 0.75
#: Concentration steps go on until no log determinant falls by more, and at most so often.
SETTLED, MOST_STEPS = 1e-3, 25
#: Widths of a subset's box around the medians, in median deviations, from which a fit starts; None for all documents.
STARTS = (None, 1.5, 4.0)
#: Steps of squared distance, per doubling, in which documents enter a subset together.
BINS = 32
#: Chance of a Gaussian document to lie beyond the cutoff.
TAIL = 1e-6
#: Pseudo-words added to each ratio's denominator, so that short texts aren't outliers by chance.
PRIOR_WORDS = 40.0
PRIOR_LENGTH = 5.0
#: The transformed statistics with the least standard deviation each is granted.
FLOORS = {"word_length": 0.06, "symbols": 0.06, "dup_lines": 0.06, "repeats": 0.12, "echoes": 0.06}
NAMES = tuple(FLOORS)

MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30


def with_stats(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` and the counts of textstats.FIELDS for the whole text of each document; ``text`` may be a field of a kept struct: row.text."""
    root, *path = text.split(".")
    taken = keep if root in keep else [*keep, root]
    schema = docs.select(*keep).schema
    for name in FIELDS:
        schema = schema.add(name, "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                texts = part.column(taken.index(root))
                for name in path:
                    texts = pc.struct_field(texts, name)
                found = [text_stats(x.as_py()) for x in texts]
                columns = [part.column(i) for i in range(len(keep))]
                columns += [pa.array(x, pa.int64()) for x in zip(*found, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=[*keep, *FIELDS])

    return docs.select(*taken).mapInArrow(run, schema)


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def transformed() -> dict[str, Column]:
    """Statistics brought near a Gaussian shape: logs and square roots of shrunken ratios."""
    words = F.col("n_words") + F.lit(PRIOR_WORDS)
    return {
        "word_length": F.log((F.col("word_chars") + F.lit(PRIOR_WORDS * PRIOR_LENGTH)) / words),
        "symbols": F.sqrt(F.col("n_symbols") / words),
        "dup_lines": F.sqrt(F.col("n_dup_lines") / words),
        "repeats": F.sqrt(F.col("n_repeat_words") / words),
        "echoes": F.sqrt(F.col("n_echo_words") / words),
    }


def chi2_cdf(x: float, k: int) -> float:
    """Of the chi-square distribution, by the series of the incomplete gamma function."""
    a, h = k / 2, x / 2
    if h <= 0:
        return 0.0
    term = total = 1 / a
    n = 0
    while term > total * 1e-16:
        n += 1
        term *= h / (a + n)
        total += term
    return min(1.0, total * math.exp(a * math.log(h) - h - math.lgamma(a)))


def chi2_quantile(p: float, k: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, k) < p else (low, mid)
    return high


def _distance(features: str, centre: str, precision: str, p: int) -> Column:
    """Squared Mahalanobis distance; ``precision`` is the row-major inverse covariance."""
    diff = [F.get(features, i) - F.get(centre, i) for i in range(p)]
    terms = [diff[i] * diff[j] * F.get(precision, i * p + j) for i in range(p) for j in range(p)]
    return sum(terms[1:], terms[0])


def _fitted(p: int, floors: list[float], scale: float):
    """From the moments of a covered subset to centre, inverse covariance and log determinant, row by row."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for key, start, m in zip(frame["fit_key"], frame["start"], frame["moments"], strict=True):
                mean = np.array(m[1 : 1 + p]) / m[0]
                second = np.zeros((p, p))
                second[np.triu_indices(p)] = np.array(m[1 + p :]) / m[0]
                cov = second + np.triu(second, 1).T - np.outer(mean, mean)
                cov = cov * scale + np.diag(np.square(floors))
                rows.append((key, start, mean.tolist(), np.linalg.inv(cov).ravel().tolist(), float(np.linalg.slogdet(cov)[1])))
            yield pd.DataFrame(rows, columns=["fit_key", "start", "centre", "precision", "logdet"])

    return run


_FIT = "fit_key string, start int, centre array<double>, precision array<double>, logdet double"


def fit_outliers(rows: DataFrame, floors: dict[str, float], *, covered: float = COVERED, starts: tuple = STARTS, most_steps: int = MOST_STEPS) -> DataFrame:
    """Minimum-covariance-determinant fits: (fit_key, n, centre, precision), one row a key.

    rows: fit_key, features (array of double, no nulls), stored. From each of
    several starts, concentration steps over all rows are repeated until the
    determinants settle: keep the ``covered`` share nearest to the current fit
    and take their mean and covariance. Of a key's fits the one with the least
    determinant is returned. The starts are the moments of the documents within
    boxes of several widths around the coordinate-wise medians.

    A step is one aggregation with map-side combine, by key, start and bin of
    distance, so a key with most rows stays spread over its input partitions;
    of the bin that the covered share ends in, all rows count by the part that
    still belongs to it. ``floors`` are variances' square roots added to the
    diagonal: a statistic that is 0 nearly everywhere has no covariance of its own.
    """
    p, floor = len(floors), list(floors.values())
    at = [F.element_at("features", i + 1) for i in range(p)]
    products = [*at, *(at[i] * at[j] for i in range(p) for j in range(i, p))]
    size = len(products)
    sums = [F.sum(x).alias(f"s{i}") for i, x in enumerate(products)]
    moments = F.array("n", *(f"s{i}" for i in range(size))).alias("moments")
    middle = F.array(*(F.percentile_approx(x, 0.5, 200) for x in at)).alias("middle")
    medians = store(rows.groupBy("fit_key").agg(F.count("*").alias("n"), middle), "mcd")
    off = [F.abs(at[i] - F.element_at("middle", i + 1)) for i in range(p)]
    widths = rows.join(medians, "fit_key").groupBy("fit_key", "n", "middle").agg(F.array(*(F.percentile_approx(x, 0.5, 200) for x in off)).alias("width"))
    widths = store(widths.withColumn("width", F.transform("width", lambda w, i: F.greatest(w * 1.4826, F.get(F.lit([float(x) for x in floor]), i)))), "mcd")
    far = F.greatest(*(off[i] / F.element_at("width", i + 1) for i in range(p))) if p > 1 else off[0] / F.element_at("width", 1)
    boxes = F.array(*(F.when(F.lit(True) if w is None else far <= w, F.lit(k)) for k, w in enumerate(starts)))
    begun = rows.join(widths, "fit_key").select("fit_key", "features", F.explode(F.filter(boxes, lambda k: k.isNotNull())).alias("start"))
    first = begun.groupBy("fit_key", "start").agg(F.count("*").cast("double").alias("n"), *sums)
    fit = store(first.select("fit_key", "start", moments).mapInPandas(_fitted(p, floor, 1.0), _FIT), "mcd")
    scale = covered / chi2_cdf(chi2_quantile(covered, p), p + 2)
    counts = medians.select("fit_key", (F.col("n") * covered).alias("share"))
    for _ in range(most_steps):
        near = rows.join(fit, "fit_key").select("fit_key", "start", "features", F.floor(F.log2(_distance("features", "centre", "precision", p) + 1e-9) * BINS).cast("int").alias("bin"))
        binned = near.groupBy("fit_key", "start", "bin").agg(F.count("*").cast("double").alias("n"), *sums)
        upto = F.sum("n").over(Window.partitionBy("fit_key", "start").orderBy("bin"))
        part = F.greatest(F.least((F.col("share") - (F.col("upto") - F.col("n"))) / F.col("n"), F.lit(1.0)), F.lit(0.0))
        inside = binned.withColumn("upto", upto).join(counts, "fit_key").withColumn("part", part).where("part > 0")
        kept = inside.groupBy("fit_key", "start").agg(*(F.sum(F.col(c) * F.col("part")).alias(c) for c in ("n", *(f"s{i}" for i in range(size)))))
        following = store(kept.select("fit_key", "start", moments).mapInPandas(_fitted(p, floor, scale), _FIT), "mcd")
        moved = following.join(fit.select("fit_key", "start", F.col("logdet").alias("before")), ["fit_key", "start"]).agg(F.max(F.abs(F.col("before") - F.col("logdet")))).first()[0]
        release(fit)
        fit = following
        if moved is None or moved <= SETTLED:
            break
    best = fit.groupBy("fit_key").agg(F.min_by(F.struct("centre", "precision"), F.struct("logdet", "start")).alias("b"))
    return best.join(medians.select("fit_key", "n"), "fit_key").select("fit_key", "n", "b.centre", "b.precision")


def quality_rules(docs: DataFrame, *, prior_docs: float = PRIOR_DOCS, tail: float = TAIL, keep: tuple[str, ...] = (), text: str = "text") -> DataFrame:
    """One row per document: doc_id, the columns of ``keep``, statistics, ``base_failed``, ``distance`` and ``kept``.

    docs: doc_id, text, lang, source (more columns are ignored but for ``keep``;
    ``text`` may name a field of a kept struct, so that it isn't carried twice).
    A document fails the base rules with fewer than 20 words, or with more than
    30 % of its words in 8-word runs found twice. The others are fitted by
    language and source, by language, and all together; a document is rejected
    whose squared Mahalanobis distance exceeds the chi-square quantile of ``tail``.
    The distance is the mean of those from its three fits, in which a fit of n
    documents counts n / (n + ``prior_docs``) of what finer fits leave: nothing
    changes at once as a group grows, and few documents reject nothing.

    Without any document that passes the base rules distances are null. A null
    text has no words and fails the base rules. Null languages or sources form
    groups of their own. Repeated rows count as often as they occur and each
    returns. Texts may have any length. Empty table: empty result.
    """
    stats = store(with_stats(docs, ["doc_id", "lang", "source", *keep], text).withColumn("base_failed", base_failed()), "stats")
    p = len(NAMES)
    features = F.array(*transformed().values()).alias("features")
    lang, source = F.coalesce(F.concat(F.lit("+"), "lang"), F.lit("-")), F.coalesce(F.concat(F.lit("+"), "source"), F.lit("-"))
    levels = [F.concat_ws("|", F.lit("source"), lang, source), F.concat_ws("|", F.lit("lang"), lang), F.lit("all")]
    good = stats.where("NOT base_failed").select(features, F.explode(F.array(*levels)).alias("fit_key"))
    spread = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    fit = store(fit_outliers(store(good.repartition(spread), "fitrows"), FLOORS), "fits")
    judged = stats.withColumns({"_k0": levels[0], "_k1": levels[1], "_k2": levels[2]}).withColumn("_features", features)
    distance, left = F.lit(0.0), F.lit(1.0)
    for i in range(3):
        named = fit.select(F.col("fit_key").alias(f"_k{i}"), F.col("n").alias(f"_n{i}"), F.col("centre").alias(f"_c{i}"), F.col("precision").alias(f"_p{i}"))
        # A column of its own: the next join keeps it from being written out again in all that is derived from it.
        judged = judged.join(named, f"_k{i}", "left").withColumn(f"_d{i}", F.coalesce(_distance("_features", f"_c{i}", f"_p{i}", p), F.lit(0.0))).drop(f"_c{i}", f"_p{i}")
        weight = F.coalesce(F.col(f"_n{i}") / (F.col(f"_n{i}") + F.lit(float(prior_docs))), F.lit(0.0))
        distance = distance + left * weight * F.col(f"_d{i}")
        left = left * (1 - weight)
    cutoff = chi2_quantile(1 - tail, p)
    judged = judged.withColumn("distance", F.when(F.col("_n2").isNotNull(), distance))
    kept = ~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= cutoff)
    return judged.select("doc_id", *keep, *FIELDS, "base_failed", "distance", kept.alias("kept"))


def op4_quality_rules(spark, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))
