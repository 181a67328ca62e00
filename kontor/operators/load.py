"""Analysis of load-test statistics and request logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kontor.operators.rollup import percentiles

# Default targets and bottleneck limits.
TARGETS = {"p95_latency_ms": 200.0, "error_rate_pct": 1.0, "throughput_rpm": 1000.0}
SLOW_P95_MS = 500
HIGH_ERROR_PCT = 1.0


def endpoint_rollup(df: DataFrame, endpoint: str, latency: str, failed: Column, seconds: float) -> DataFrame:
    """Per endpoint: requests, failures, error share, latency percentiles, requests per second."""
    named = df.withColumn("name", F.col(endpoint))
    ranks = percentiles(named, ["name"], latency, [0.5, 0.95, 0.99]).select(
        "name", *[F.col(f"p{p}").alias(f"p{p}_ms") for p in (50, 95, 99)]
    )
    rates = named.groupBy("name").agg(
        F.count(F.lit(1)).alias("requests"),
        F.count_if(failed).alias("failures"),
        (F.count_if(failed) * 100.0 / F.count(F.lit(1))).alias("error_rate_pct"),
        (F.count(F.lit(1)) / F.lit(float(seconds))).alias("rps"),
    )
    return rates.join(ranks, "name", "left")


def totals(endpoints: DataFrame) -> DataFrame:
    """Totals of endpoint rows (requests, failures, p95_ms, rps).

    The duration is estimated from the request count and the summed rates.
    """
    active = F.col("requests") > 0
    sums = endpoints.agg(
        F.coalesce(F.sum("requests"), F.lit(0)).alias("requests"),
        F.coalesce(F.sum("failures"), F.lit(0)).alias("failures"),
        F.coalesce(F.sum("rps"), F.lit(0.0)).alias("rps"),
        F.sum(F.when(active, F.col("p95_ms"))).alias("p95_sum"),
        F.count_if(active).alias("active"),
        F.count(F.lit(1)).alias("listed"),
    )
    duration = F.when(F.col("rps") > 0, F.col("requests") / F.col("rps")).otherwise(F.lit(0.0))
    return sums.select(
        "requests",
        "failures",
        duration.alias("duration_seconds"),
        F.when(F.col("requests") > 0, F.col("failures") * 100.0 / F.col("requests")).otherwise(F.lit(0.0)).alias("error_rate_pct"),
        F.when(duration > 0, F.col("requests") / duration * 60.0).otherwise(F.lit(0.0)).alias("throughput_rpm"),
        F.when(F.col("listed") > 0, F.coalesce("p95_sum", F.lit(0.0)) / F.greatest("active", F.lit(1))).alias("avg_p95"),
    )


def performance_score(endpoints: DataFrame, targets: dict[str, float] | None = None) -> DataFrame:
    """Scores 0-100 against the targets, their mean, and whether all are met."""
    goal = {**TARGETS, **(targets or {})}
    t = totals(endpoints)
    rpm, err = F.col("throughput_rpm"), F.col("error_rate_pct")
    p95 = F.coalesce("avg_p95", F.lit(goal["p95_latency_ms"]))
    speed = F.least(rpm / goal["throughput_rpm"], F.lit(1.0)) * 100
    clean = F.greatest(F.lit(0.0), 100.0 - F.least(err / goal["error_rate_pct"], F.lit(1.0)) * 100)
    quick = F.least(F.coalesce(F.lit(goal["p95_latency_ms"]) / F.nullif(p95, F.lit(0.0)), F.lit(1.0)), F.lit(1.0)) * 100
    met = (rpm >= goal["throughput_rpm"]) & (err <= goal["error_rate_pct"]) & (p95 <= goal["p95_latency_ms"])
    return t.select(
        F.round((speed + clean + quick) / 3, 2).alias("score"),
        met.alias("passed"),
        F.round(speed, 2).alias("throughput_score"),
        F.round(clean, 2).alias("error_score"),
        F.round(quick, 2).alias("latency_score"),
        F.round(rpm, 2).alias("throughput_rpm"),
        F.round(err, 3).alias("error_rate_pct"),
        F.round(p95, 2).alias("avg_p95_latency_ms"),
    )


def bottlenecks(endpoints: DataFrame) -> DataFrame:
    """Slow or failing endpoints, slowest first."""
    error = F.when(F.col("requests") > 0, F.col("failures") * 100.0 / F.col("requests")).otherwise(F.lit(0.0))
    rows = endpoints.withColumn("error_rate_pct", error).filter(
        (F.col("requests") > 0) & ((F.col("p95_ms") > SLOW_P95_MS) | (F.col("error_rate_pct") > HIGH_ERROR_PCT))
    )
    return rows.orderBy(F.desc("p95_ms"), F.desc("error_rate_pct"), "name")


def baseline_delta(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """Change of throughput and error share between two endpoint tables."""
    before = totals(baseline).select(F.struct("throughput_rpm", "error_rate_pct")).scalar()
    return totals(current).select("throughput_rpm", "error_rate_pct", before.alias("before")).select(
        F.round(F.col("throughput_rpm") - F.col("before.throughput_rpm"), 2).alias("throughput_delta_rpm"),
        F.round(F.col("error_rate_pct") - F.col("before.error_rate_pct"), 3).alias("error_rate_delta_pct"),
    )
