"""How good an extraction is: fields against expected values, models against each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kontor.functions import routing
from kontor.operators.rollup import percentiles


def norm_value(c: Column, kind: str = "string") -> Column:
    """Comparable form: trimmed lower-case text; lists element-wise and sorted."""
    if kind == "string":
        return F.lower(F.regexp_replace(c, r"^\s+|\s+$", ""))
    return F.array_sort(F.transform(c, lambda x: norm_value(x)))


def _empty(c: Column, kind: str) -> Column:
    if kind == "string":
        return F.coalesce(c == "", F.lit(True))
    return F.coalesce(F.size(c) == 0, F.lit(True)) if kind == "array" else c.isNull()


def _compared(extracted: DataFrame, expected: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """One row per expected record with a struct per field: states of both sides."""
    kinds = {f: expected.schema[f].dataType.typeName() for f in fields}
    left = expected.select(key, *[F.col(f).alias(f"want_{f}") for f in fields])
    right = extracted.select(key, F.lit(True).alias("_there"), *[F.col(f).alias(f"got_{f}") for f in fields])
    joined = left.join(right, key, "left")
    states, given = [], []
    for f in fields:
        want, got, kind = F.col(f"want_{f}"), F.col(f"got_{f}"), kinds[f]
        same = (norm_value(want, kind) == norm_value(got, kind)) if kind in ("string", "array") else want == got
        no_want, no_got = _empty(want, kind), _empty(got, kind)
        state = (
            F.when(no_want & no_got, "none")
            .when(no_want, "invented")
            .when(no_got, "missed")
            .when(same, "right")
            .otherwise("wrong")
        )
        states.append(state)
        given.append(got.isNotNull())
    return joined.select(key, F.coalesce("_there", F.lit(False)).alias("there"), F.array(*states).alias("states"), F.array(*given).alias("given"))


def _share(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def field_quality(extracted: DataFrame, expected: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Precision, recall, F1 and completeness per record.

    A wrong value counts as a false positive, not as a false negative.  A record
    that was not extracted at all scores zero throughout.
    """

    def n(*names: str) -> Column:
        return F.when(F.col("there"), F.size(F.filter("states", lambda s: s.isin(*names)))).otherwise(0)

    counted = _compared(extracted, expected, key, fields).select(
        key,
        n("right").alias("tp"),
        n("wrong", "invented").alias("fp"),
        n("missed").alias("fn"),
    )
    rated = counted.withColumns(
        {
            "precision": _share(F.col("tp"), F.col("tp") + F.col("fp")),
            "recall": _share(F.col("tp"), F.col("tp") + F.col("fn")),
            "completeness": F.col("tp") / F.lit(len(fields)),
        }
    )
    p, r = F.col("precision"), F.col("recall")
    return rated.withColumn("f1", _share(2 * p * r, p + r))


def hallucination(extracted: DataFrame, expected: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Share of the extracted fields whose value is not the expected one.

    A NULL field was not extracted and does not count.  One that is empty although a value was expected
    differs from it and counts.  Without extracted fields the share is zero, without a record one.
    """
    states = _compared(extracted, expected, key, fields)
    off = F.size(F.filter(F.arrays_zip("states", "given"), lambda s: s["given"] & s["states"].isin("wrong", "invented", "missed")))
    rate = _share(off, F.size(F.filter("given", lambda g: g)))
    return states.select(key, F.when(F.col("there"), rate).otherwise(F.lit(1.0)).alias("hallucination_rate"))


def tokens_per_second(length: Column, latency: Column) -> Column:
    return F.when(latency > 0, F.greatest(F.lit(1), F.floor(length / 4)) / latency).otherwise(F.lit(0.0))


def model_summary(results: DataFrame, model: str = "model") -> DataFrame:
    """Means, latency percentiles, peak memory and errors per model.

    ``results``: model, latency, precision, recall, f1, completeness, json_valid,
    hallucination_rate, tokens_per_second, memory_used_mb, error.
    """
    means = ["precision", "recall", "f1", "completeness", "hallucination_rate"]
    ranks = percentiles(results, [model], "latency", [0.5, 0.95, 0.99], "latency_p").drop("n")
    rates = results.groupBy(model).agg(
        F.count(F.lit(1)).alias("runs"),
        *[F.avg(c).alias(c) for c in means],
        F.avg(F.col("json_valid").cast("double")).alias("json_valid_rate"),
        F.avg("tokens_per_second").alias("mean_tokens_per_second"),
        F.max("memory_used_mb").alias("peak_memory_mb"),
        F.count("error").alias("errors"),
    )
    return rates.join(ranks, model, "left")


def errors_per_case(results: DataFrame, model: str = "model", case: str = "case_id") -> DataFrame:
    return results.filter(F.col("error").isNotNull()).groupBy(model, case).agg(F.count(F.lit(1)).alias("errors"))


def recommend_config(summary: DataFrame) -> DataFrame:
    return summary.withColumns(
        routing.recommended_config(
            F.col("hallucination_rate"), F.col("completeness"), F.col("latency_p95"), F.col("f1")
        )
    )


def best_variant(scores: DataFrame, name: str = "prompt", position: str = "position") -> DataFrame:
    """The variant with the highest mean F1 minus mean hallucination; the first one on ties.

    ``scores``: name, position (order of listing), f1, hallucination.
    """
    means = scores.groupBy(name).agg(
        F.avg("f1").alias("f1_mean"), F.avg("hallucination").alias("hallucination_mean"), F.min(position).alias(position)
    )
    ranked = means.withColumn("gain", F.round(F.col("f1_mean") - F.col("hallucination_mean"), 12))
    return ranked.orderBy(F.desc("gain"), position).limit(1).drop("gain")
