"""Quality rules: text statistics and robust multivariate outliers per language and source.

A minimum-covariance-determinant estimate is found for every (language, source) by
concentration steps over all its documents: take the share ``core`` of documents nearest
to the present centre, estimate centre and covariance anew from them, repeat.  Each step
is one projection, one histogram of distances and one sum per group, all with map-side
combine, so a source with a third of all rows costs no more than many small ones.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kontor.session import checkpoint_cut

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
REPEAT_WINDOW = 5

#: Share of documents that the estimate rests on: fewer than half of a group may be junk.
CORE = 0.5
#: Steps end when no group's least log determinant falls by more than ``STILL``.
STILL = 0.01
#: Share of clean (normal) documents beyond the cutoff.
TAIL = 1e-5
#: Documents' worth of the language's and of the corpus' estimate that each group is given.
PRIOR = 50.0
#: Transformed statistics, and the spread below which differences in each are no defect: a third of a
#: language's spread for lengths and words.  Shares that are 0 in most clean documents have a spread of
#: their own instead, since a tight one rejects good documents for a few repeated lines.
FEATURES = {"f_length": 0.35, "f_word": 0.04, "f_symbols": 0.15, "f_lines": 0.1, "f_repeats": 0.1, "f_stutter": 0.08}

STATS = "n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long, n_stutters long"


def text_stats(text: str | None) -> tuple[int, ...]:
    """Words, code points in words, symbols, lines with a word, repeated lines, words in repeated windows, words like the one before."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    word_chars = len(text or "") - sum(raw.count(c) for c in (b" ", b"\t", b"\n", b"\v", b"\f", b"\r"))
    symbols = sum(raw.count(bytes([c])) for c in b"#*$%&|<>")
    lines = [line for line in raw.split(b"\n") if line.strip()]
    k = REPEAT_WINDOW
    seen = Counter(zip(*(words[i:] for i in range(k))))
    repeated = 0
    if len(seen) < len(words) - k + 1:
        reach = 0  # words before this place are counted
        for i, window in enumerate(zip(*(words[i:] for i in range(k)))):
            if seen[window] > 1:
                repeated += i + k - max(reach, i)
                reach = i + k
    return len(words), word_chars, symbols, len(lines), len(lines) - len(set(lines)), repeated, sum(map(eq, words, words[1:]))


def statistics(docs: DataFrame, id_col="doc_id", text_col="text", lang_col="lang", source_col="source") -> DataFrame:
    """The statistics of every row, with its id, language and source."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stats = np.array([text_stats(t.as_py()) for t in batch.column(3)], dtype=np.int64).reshape(-1, 7)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], *(pa.array(stats[:, i]) for i in range(7))],
                names=["doc_id", "lang", "source", *(x.split()[0] for x in STATS.split(", "))],
            )

    slim = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).cast("string").alias("lang"),
        F.col(source_col).cast("string").alias("source"), F.col(text_col).alias("text"),
    )
    return slim.mapInArrow(run, f"doc_id long, lang string, source string, {STATS}")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def features() -> dict[str, Column]:
    words, lines = F.greatest("n_words", F.lit(1)), F.greatest("n_lines", F.lit(1))
    return {
        "f_length": F.log1p("n_words"),
        "f_word": F.log((F.col("word_chars") + 1) / words),
        "f_symbols": F.log1p(100 * F.col("n_symbols") / words),
        "f_lines": F.col("n_dup_lines") / lines,
        "f_repeats": F.col("n_repeat_words") / words,
        "f_stutter": F.col("n_stutters") / words,
    }


def chi2_cdf(x: float, dof: int) -> float:
    """Distribution function of chi-square (series of the lower incomplete gamma function)."""
    a, y = dof / 2, x / 2
    if y <= 0:
        return 0.0
    term = total = 1 / a
    n = a
    while term > total * 1e-16:
        n += 1
        term *= y / n
        total += term
    return total * math.exp(-y + a * math.log(y) - math.lgamma(a))


def chi2_quantile(p: float, dof: int) -> float:
    lo, hi = 0.0, 1000.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2_cdf(mid, dof) < p else (lo, mid)
    return (lo + hi) / 2


def _on_grid(x: Column, per_unit: int) -> Column:
    """Few distinct values, so that exact percentiles need bounded memory and don't depend on the order of rows."""
    return F.round(x * per_unit) / per_unit


def robust_distance(
    rows: DataFrame, groups: list[str], spreads: dict[str, float], use: Column,
    core: float = CORE, prior: float = PRIOR,
) -> DataFrame:
    """``rows`` with ``_d2``, the squared Mahalanobis distance to the robust estimate of the row's group.

    ``groups``: columns from general to special (language, source); a null is a group of
    its own.  ``spreads``: the statistics, each with a spread whose square is added to
    its variance, so that a statistic that is constant in a group gives no infinite
    distance.  ``use``: rows that may enter the estimate.  Small groups are drawn
    towards their language and the corpus by ``prior`` documents' worth of either.  A
    group without any row to use has null distances.
    """
    xs, p = list(spreads), len(spreads)
    rows = rows.withColumn("_use", use)
    for k, g in enumerate(groups):  # keys that join with nulls
        rows = rows.withColumn(f"_g{k}", F.coalesce(F.concat(F.lit("="), F.col(g)), F.lit("null")))
    keys = [f"_g{k}" for k in range(len(groups))]
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    consistency = core / chi2_cdf(chi2_quantile(core, p), p + 2)
    floor = np.array([spreads[x] ** 2 for x in xs])

    # start: medians, and the spread that goes with their absolute deviations
    used = rows.where("_use")
    near = used.groupBy(*keys).agg(*(F.percentile(_on_grid(F.col(x), 256), F.lit(0.5)).alias(f"_m{i}") for i, x in enumerate(xs)))
    away = used.join(near, keys).groupBy(*keys).agg(
        *(F.first(f"_m{i}").alias(f"_m{i}") for i in range(p)),
        *(F.percentile(_on_grid(F.abs(F.col(x) - F.col(f"_m{i}")), 256), F.lit(0.5)).alias(f"_s{i}") for i, x in enumerate(xs)),
    )
    estimate = checkpoint_cut(
        away.select(
            *keys, *(f"_m{i}" for i in range(p)),
            *((1 / (F.pow(1.4826 * F.col(f"_s{i}"), 2) + float(floor[i])) if i == j else F.lit(0.0)).alias(f"_a{i}_{j}") for i, j in pairs),
        )
    )
    d2 = sum((F.lit(1.0 if i == j else 2.0) * F.col(f"_a{i}_{j}") * (F.col(xs[i]) - F.col(f"_m{i}")) * (F.col(xs[j]) - F.col(f"_m{j}")) for i, j in pairs), F.lit(0.0))

    best = None
    while True:  # ends, as every further step lowers a determinant that the spreads bound from below
        far = used.join(estimate, keys).select(*keys, *xs, _on_grid(F.log(F.greatest(d2, F.lit(1e-9))), 64).alias("_far"))
        edge = checkpoint_cut(far.groupBy(*keys).agg(F.percentile("_far", F.lit(core)).alias("_edge")))
        inside = far.join(edge, keys).where("_far <= _edge")
        sums = inside.groupBy(*keys).agg(
            F.count("*").cast("double").alias("_n"), *(F.sum(x).alias(f"_x{i}") for i, x in enumerate(xs)),
            *(F.sum(F.col(xs[i]) * F.col(xs[j])).alias(f"_x{i}_{j}") for i, j in pairs),
        )
        estimate = _estimate(checkpoint_cut(sums), keys, p, pairs, prior, consistency, floor)
        if best is None:
            best = estimate = checkpoint_cut(estimate.withColumn("_fall", F.lit(float("inf"))))
            continue
        old = best.select(*keys, *(F.col(c).alias(f"_old{c}") for c in best.columns if c not in keys))
        both, falls = estimate.join(old, keys), F.col("_det") < F.col("_old_det")
        values = [c for c in estimate.columns if c not in keys]
        best = estimate = checkpoint_cut(
            both.select(
                *keys, *(F.when(falls, F.col(c)).otherwise(F.col(f"_old{c}")).alias(c) for c in values),
                F.greatest(F.col("_old_det") - F.col("_det"), F.lit(0.0)).alias("_fall"),
            )
        )
        if (best.agg(F.max("_fall").alias("fall")).first().fall or 0.0) <= STILL:
            break
    columns = [c for c in estimate.columns if c not in keys]
    rows = rows.join(estimate, keys, "left")
    return rows.withColumn("_d2", d2).drop(*columns, *keys, "_use")


def _estimate(sums: DataFrame, keys: list[str], p: int, pairs, prior: float, consistency: float, floor: np.ndarray) -> DataFrame:
    """Centre, inverse covariance and log determinant of every group."""
    moments = [c for c in sums.columns if c not in keys]
    language, corpus = Window.partitionBy(keys[0]), Window.partitionBy()  # over one row per group
    up, all_ = F.sum("_n").over(language), F.sum("_n").over(corpus)
    table = sums.select(
        *keys, *((F.col(c) + prior * F.sum(c).over(language) / up + prior * F.sum(c).over(corpus) / all_).alias(c) for c in moments)
    )
    out = [*(f"_m{i}" for i in range(p)), *(f"_a{i}_{j}" for i, j in pairs), "_det"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            n = batch["_n"].to_numpy()[:, None]
            mean = batch[[f"_x{i}" for i in range(p)]].to_numpy() / n
            cov = np.empty((len(batch), p, p))
            for i, j in pairs:
                cov[:, i, j] = cov[:, j, i] = batch[f"_x{i}_{j}"].to_numpy() / n[:, 0] - mean[:, i] * mean[:, j]
            whole = cov * consistency + np.diag(floor)
            inverse = np.linalg.inv(whole)
            values = [*mean.T, *(inverse[:, i, j] for i, j in pairs), np.linalg.slogdet(whole)[1]]
            yield pd.concat([batch[keys].reset_index(drop=True), pd.DataFrame(dict(zip(out, values)))], axis=1)

    return table.mapInPandas(run, ", ".join([*(f"{k} string" for k in keys), *(f"{c} double" for c in out)]))


def quality(docs: DataFrame, id_col="doc_id", text_col="text", lang_col="lang", source_col="source", tail: float = TAIL) -> DataFrame:
    """One row per row of ``docs``: statistics, ``base_failed``, ``distance`` and ``kept``.

    A null text is empty and fails the base rule.  A null language or source is a group
    of its own.  Repeated rows come back as often as they came and count as often in the
    estimates.  An empty table gives an empty table; other columns are not read.
    """
    stats = checkpoint_cut(statistics(docs, id_col, text_col, lang_col, source_col))
    rows = stats.withColumns(features()).withColumn("base_failed", base_failed())
    rows = robust_distance(rows, ["lang", "source"], FEATURES, ~F.col("base_failed"))
    cutoff = chi2_quantile(1 - tail, len(FEATURES))
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & F.coalesce(F.col("_d2") <= cutoff, F.lit(True))).alias("kept"),
        F.col("_d2").alias("distance"),
    )
