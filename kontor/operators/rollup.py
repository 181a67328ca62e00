"""Counts, shares and rankings over company and job tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kontor.functions.text import filled
from kontor.operators.prefix import carry
from kontor.session import checkpoint_cut

# Bucket bounds of the job duration histogram, in seconds.
JOB_BUCKETS = [10, 30, 60, 120, 300, 600, 1800, 3600]


def _sections(df: DataFrame, dims: list[str], **aggs: Column) -> DataFrame:
    """One pass over ``df``: count and sums in total and per value of each dimension.

    An empty table still has its total row.
    """
    sums = {"n": F.count(F.lit(1)), **aggs}
    grouped = df.groupingSets([[], *[[F.col(d)] for d in dims]], *dims).agg(
        *[c.alias(name) for name, c in sums.items()], F.grouping_id().alias("gid")
    )
    full = (1 << len(dims)) - 1
    section = F.when(F.col("gid") == full, "total")
    for i, d in enumerate(dims):
        section = section.when(F.col("gid") == full - (1 << (len(dims) - 1 - i)), d)
    label = F.coalesce(*[F.col(d).cast("string") for d in dims])
    rows = grouped.select(section.alias("section"), label.alias("label"), *sums)
    nothing = df.sparkSession.range(1).select(
        F.lit("total").alias("section"), F.lit(None).cast("string").alias("label"), *[F.lit(0).cast(rows.schema[c].dataType).alias(c) for c in sums]
    )
    return rows.unionByName(nothing).groupBy("section", "label").agg(*[F.sum(c).alias(c) for c in sums])


def _top(sections: DataFrame, ranked: list[str], k: int, salts: int = 64) -> DataFrame:
    """Keep all rows of plain sections and the ``k`` largest of the ranked ones.

    A ranked section may have very many labels, so each slice of it is cut to its own
    k largest before the section is ranked as a whole.
    """
    largest = [F.desc("n"), F.asc_nulls_last("label")]
    is_ranked = F.col("section").isin(ranked)
    sliced = sections.withColumn("_slice", F.pmod(F.xxhash64("label"), F.lit(salts)))
    within = F.row_number().over(Window.partitionBy("section", "_slice").orderBy(*largest))
    kept = sliced.withColumn("_nth", within).filter(~is_ranked | (F.col("_nth") <= k)).drop("_slice", "_nth")
    pos = F.row_number().over(Window.partitionBy("section").orderBy(*largest))
    return kept.withColumn("pos", F.when(is_ranked, pos)).filter(F.col("pos").isNull() | (F.col("pos") <= k))


def overview(df: DataFrame, k: int = 10) -> DataFrame:
    """Active rows: total, by status, by quality, top cities (NULL city counts)."""
    dims = ["lead_status", "lead_quality", "city"]
    return _top(_sections(df.filter("is_active").select(dims), dims), ["city"], k)


def export_stats(df: DataFrame, k: int = 10) -> DataFrame:
    """All rows: total, by status, by quality, top industries and cities without NULL."""
    dims = ["lead_status", "lead_quality", "industry", "city"]
    sections = _sections(df.select(dims), dims)
    known = ~F.col("section").isin("industry", "city") | F.col("label").isNotNull()
    return _top(sections.filter(known), ["industry", "city"], k)


def scoring_stats(df: DataFrame) -> DataFrame:
    """Total, average score (2 digits, NULL -> 0) and one count per grade, in long form."""
    rows = _sections(df, ["lead_quality"], points=F.sum("lead_score"), scored=F.count("lead_score"))
    whole = F.col("section") == "total"
    average = F.coalesce(F.round(F.col("points") / F.nullif(F.col("scored"), F.lit(0)), 2), F.lit(0.0))
    return rows.select(
        F.when(whole, "all").otherwise(F.col("label")).alias("grade"), "n", F.when(whole, average).alias("average")
    )


def top_bottom(df: DataFrame, column: str, k: int = 10, key: str = "id") -> DataFrame:
    """The k highest and k lowest rows; NULL values take no part.  Two bounded top-k scans."""
    known = df.filter(F.col(column).isNotNull())
    top = known.orderBy(F.desc(column), key).limit(k).withColumn("side", F.lit("top"))
    bottom = known.orderBy(F.asc(column), key).limit(k).withColumn("side", F.lit("bottom"))
    return top.unionByName(bottom)


def leads_per_source(sources: DataFrame) -> DataFrame:
    """``sources`` in long form (one row per lead and source): leads per source name."""
    return sources.groupBy("name").agg(F.count(F.lit(1)).alias("leads"))


def completeness(df: DataFrame, columns: list[str]) -> DataFrame:
    """Filled count and share in percent per column, one row per column, one pass."""
    def usable(c: str) -> Column:
        kind = df.schema[c].dataType.typeName()
        if kind in ("array", "map"):
            return F.size(c) > 0
        return filled(F.col(c)) if kind == "string" else F.col(c).isNotNull()

    counts = df.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(usable(c)).alias(c) for c in columns])
    pairs = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("filled")) for c in columns])
    long = counts.select("total", F.explode(pairs).alias("p")).select("total", "p.*")
    return long.withColumn("share", F.round(F.col("filled") * 100.0 / F.nullif(F.col("total"), F.lit(0)), 4))


def job_duration() -> Column:
    """Stored duration if positive, else completed minus started if positive."""
    stored = F.when(F.col("duration_seconds") > 0, F.col("duration_seconds"))
    span = F.unix_micros("completed_at") - F.unix_micros("started_at")
    return F.coalesce(stored, F.when(span > 0, span / F.lit(1e6)))


def job_metrics(jobs: DataFrame, buckets: list[int] | None = None) -> DataFrame:
    """Long-form job metrics (metric, source, label, value) from one aggregate.

    Metrics: jobs by status, cumulative duration buckets, result totals by type.
    """
    bounds = buckets or JOB_BUCKETS
    source, status = F.coalesce("source", F.lit("unknown")), F.coalesce("status", F.lit("unknown"))
    d = job_duration()
    base = jobs.groupBy(source.alias("source"), status.alias("status")).agg(
        F.count(F.lit(1)).alias("jobs"),
        F.count(d).alias("b_inf"),
        *[F.count_if(d <= le).alias(f"b_{le}") for le in bounds],
        *[
            F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c)
            for c in ("new_companies", "updated_companies", "errors_count")
        ],
    )
    names = [(f"b_{le}", "duration_le", F.lit(str(le))) for le in bounds] + [("b_inf", "duration_le", F.lit("+Inf"))]
    names += [(c, "results", F.lit(c.removesuffix("_count"))) for c in ("new_companies", "updated_companies", "errors_count")]
    names.append(("jobs", "jobs", F.col("status")))
    items = [F.struct(F.lit(metric).alias("metric"), label.alias("label"), F.col(c).alias("value")) for c, metric, label in names]
    long = base.select("source", F.explode(F.array(*items)).alias("x")).select("x.metric", "source", "x.label", "x.value")
    return long.groupBy("metric", "source", "label").agg(F.sum("value").alias("value"))


def flatten_counters(df: DataFrame, column: str, levels: int = 1) -> DataFrame:
    """Sum JSON counters: ``{key: n}`` (1 level) or ``{group: {key: n}}`` (2 levels)."""
    if levels == 1:
        parsed = F.from_json(column, "map<string,bigint>")
        return df.select(F.explode(parsed).alias("key", "n")).groupBy("key").agg(F.sum("n").alias("n"))
    parsed = F.from_json(column, "map<string,map<string,bigint>>")
    outer = df.select(F.explode(parsed).alias("grp", "inner"))
    return outer.select("grp", F.explode("inner").alias("key", "n")).groupBy("grp", "key").agg(F.sum("n").alias("n"))


def linear_percentile(c: Column, p: float) -> Column:
    """Exact interpolated percentile as an aggregate, for groups that fit a task.

    ``percentiles`` does the same for groups of any size.
    """
    return F.percentile(c, F.lit(p))


#: Bits of a value's image that one round of the rank search tells apart.
DIGIT = 16


def ordered_image(c: Column) -> Column:
    """A double as a 64-bit number in the same order: exponent and mantissa, negated for negative values; NaN is the largest."""
    a = F.abs(c)
    near = F.floor(F.log2(a))
    exponent = near - (F.pow(F.lit(2.0), near) > a).cast("int") + (F.pow(F.lit(2.0), near + 1) <= a).cast("int")
    normal = (exponent + 1023) * F.lit(1 << 52) + ((a / F.pow(F.lit(2.0), exponent) - 1) * F.lit(float(1 << 52))).cast("bigint")
    size = (
        F.when(F.isnan(c), F.lit((2047 << 52) + 1))
        .when(a == float("inf"), F.lit(2047 << 52))
        .when(a < 2.2250738585072014e-308, (a / F.lit(5e-324)).cast("bigint"))
        .otherwise(normal)
    )
    return F.when(c < 0, -size).otherwise(size)


def _join(left: DataFrame, right: DataFrame, names: list[str]) -> DataFrame:
    """Inner join on equal names, nulls being equal; the names come from the left."""
    other = right.withColumnsRenamed({c: f"_r_{c}" for c in names})
    met = F.lit(True)
    for c in names:
        met = met & left[c].eqNullSafe(other[f"_r_{c}"])
    return left.join(other, met).drop(*[f"_r_{c}" for c in names])


def percentiles(
    df: DataFrame, keys: list[str], value: str, shares: list[float], prefix: str = "p",
    panes: list[str] | None = None, groups: DataFrame | None = None,
) -> DataFrame:
    """Exact interpolated percentiles per key for groups of any size.

    Radix selection: rows are counted by key and the first ``DIGIT`` bits of the value's image (with map-side combine),
    the running count tells which of these ranges holds each wanted rank, and only the rows of
    those ranges are counted by their next bits, until a range holds one value.  No task sees more than the counts of a group's
    ranges, however close the values lie.  Columns: keys, n, and e.g. p50, p95.

    With ``groups`` (columns ``panes`` and ``keys``) a row belongs to every key of its panes, as with
    sliding windows: counts of panes are added up to groups, rows are not copied.
    """
    at_panes = groups is not None
    rows = df.filter(F.col(value).isNotNull()).select(*(panes if at_panes else keys), F.col(value).cast("double").alias("_v"))
    rows = rows.withColumn("_u", ordered_image(F.col("_v")))
    ends = []
    for i, share in enumerate(shares):
        rank = (F.col("n") - 1) * F.lit(share)
        ends += [F.struct(F.lit(2 * i).alias("slot"), F.floor(rank).alias("at")), F.struct(F.lit(2 * i + 1).alias("slot"), F.ceil(rank).alias("at"))]
    totals = done = open_ = None
    part = list(keys)
    for shift in range(64 - DIGIT, -1, -DIGIT):
        if open_ is not None:
            wanted = open_.select(*keys, "_prefix").distinct()
            if at_panes:
                wanted = _join(wanted, groups, keys)
            known = rows.withColumn("_prefix", F.shiftright("_u", shift + DIGIT))
            rows = _join(known, wanted, [*(panes if at_panes else keys), "_prefix"])
            rows, at_panes, part = checkpoint_cut(rows.select(*keys, "_prefix", "_v", "_u")), False, [*keys, "_prefix"]
        counts = rows.groupBy(*(panes if at_panes else part), F.shiftright("_u", shift).alias("_range")).agg(
            F.count(F.lit(1)).alias("_n"), F.min("_u").alias("_low"), F.max("_u").alias("_high"), F.min("_v").alias("_value")
        )
        if at_panes:
            counts = _join(counts, groups, panes).groupBy(*keys, "_range").agg(
                F.sum("_n").alias("_n"), F.min("_low").alias("_low"), F.max("_high").alias("_high"), F.min("_value").alias("_value")
            )
        counts = checkpoint_cut(counts.withColumn("_upto", F.sum("_n").over(Window.partitionBy(*part).orderBy("_range"))))
        if totals is None:
            totals = checkpoint_cut(counts.groupBy(*keys).agg(F.max("_upto").alias("n")))
            wants = totals.select(*keys, F.inline(F.array(*ends)))
        else:
            wants = open_
        inside = (F.col("_upto") - F.col("_n") <= F.col("at")) & (F.col("at") < F.col("_upto"))
        found = _join(counts, wants, part).filter(inside).withColumn("at", F.col("at") - F.col("_upto") + F.col("_n"))
        found = checkpoint_cut(found.select(*keys, "slot", "at", F.col("_range").alias("_prefix"), "_low", "_high", "_value"))
        settled = found.filter("_low = _high").select(*keys, "slot", "_value")
        done = settled if done is None else done.unionByName(settled)
        open_ = found.filter("_low < _high").select(*keys, "slot", "at", "_prefix")
        if open_.isEmpty():
            break
    whole = _join(done, totals, keys)
    at = [F.max(F.when(F.col("slot") == i, F.col("_value"))).alias(f"_{i}") for i in range(2 * len(shares))]
    whole = whole.groupBy(*keys).agg(F.max("n").alias("n"), *at)
    out = []
    for i, share in enumerate(shares):
        rank = (F.col("n") - 1) * F.lit(share)
        low, high = F.col(f"_{2 * i}"), F.col(f"_{2 * i + 1}")
        label = f"{prefix}{share * 100:g}".replace(".", "_")
        out.append((low + (high - low) * (rank - F.floor(rank))).alias(label))
    return whole.select(*keys, "n", *out)


def histogram_quantile(df: DataFrame, keys: list[str], le: str, count: str, q: float) -> DataFrame:
    """Quantile from cumulative buckets, linear inside the bucket.

    Rows: keys, ``le`` (upper bound, NULL = +Inf), ``count`` (cumulative).  If the
    rank falls into the +Inf bucket the highest finite bound is returned.
    """
    order = Window.partitionBy(*keys).orderBy(F.asc_nulls_last(le))
    whole = Window.partitionBy(*keys)
    step = df.withColumns(
        {
            "lower": F.coalesce(F.lag(le).over(order), F.lit(0.0)),
            "before": F.coalesce(F.lag(count).over(order), F.lit(0)),
            "total": F.max(count).over(whole),
            "top": F.max(le).over(whole),
        }
    ).filter(F.col("total") > 0)
    rank = F.lit(q) * F.col("total")
    hit = step.filter((F.col(count) >= rank) & ((F.col("before") < rank) | (F.col("before") == 0)))
    inside = F.col("lower") + (F.col(le) - F.col("lower")) * (rank - F.col("before")) / F.nullif(
        F.col(count) - F.col("before"), F.lit(0)
    )
    value = F.when(F.col(le).isNull(), F.col("top")).otherwise(inside)
    first = F.min_by(value, F.coalesce(F.col(le), F.lit(float("inf"))))
    return hit.groupBy(*keys).agg(first.alias("quantile"))


def to_histogram(df: DataFrame, keys: list[str], value: Column, bounds: list[float]) -> DataFrame:
    """Cumulative histogram (keys, le, n) with one aggregate and no join."""
    counts = df.groupBy(*keys).agg(
        F.count(value).alias("n_inf"), *[F.count_if(value <= b).alias(f"n_{i}") for i, b in enumerate(bounds)]
    )
    rows = [F.struct(F.lit(float(b)).alias("le"), F.col(f"n_{i}").alias("n")) for i, b in enumerate(bounds)]
    rows.append(F.struct(F.lit(None).cast("double").alias("le"), F.col("n_inf").alias("n")))
    return counts.select(*keys, F.explode(F.array(*rows)).alias("b")).select(*keys, "b.le", "b.n")


def top_endpoints(df: DataFrame, k: int = 10, by: str = "rate", endpoint: str = "endpoint", value: str = "value") -> DataFrame:
    """Busiest (``rate``) or slowest (``p95``) endpoints."""
    counted = df.groupBy(endpoint).agg(F.count(F.lit(1)).alias("requests"))
    if by == "rate":  # only the endpoints that are reported are ranked by time
        counted = checkpoint_cut(counted.orderBy(F.desc("requests"), endpoint).limit(k))
        df = df.join(counted.select(endpoint), endpoint, "left_semi")
    slow = percentiles(df, [endpoint], value, [0.95]).select(endpoint, F.round("p95", 6).alias("p95"))
    stats = counted.join(slow, endpoint, "left")
    return stats.orderBy(F.desc("requests" if by == "rate" else "p95"), endpoint).limit(k)


def slow_queries(df: DataFrame, limit: int = 20) -> DataFrame:
    """Statements by mean time, without housekeeping ones.  Rows: query, elapsed."""
    work = df
    # Statements left out of the ranking.
    for prefix in ("VACUUM%", "BEGIN%", "COMMIT%"):
        work = work.filter(~F.col("query").ilike(prefix))
    return (
        work.groupBy("query")
        .agg(
            F.count(F.lit(1)).alias("calls"),
            F.sum("elapsed").alias("total_time"),
            F.avg("elapsed").alias("mean_time"),
            F.max("elapsed").alias("max_time"),
            F.stddev_pop("elapsed").alias("stddev_time"),
        )
        .orderBy(F.desc("mean_time"), "query")
        .limit(limit)
    )
