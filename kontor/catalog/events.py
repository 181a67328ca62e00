"""Queries on event tables: job metrics, quality, load analysis, alert rules, guards, sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from kontor.catalog import duck as D
from kontor.catalog.base import query
from kontor.catalog.change import JOB_SQL, jobs, outcomes
from kontor.catalog.leads import stored
from kontor.functions import routing
from kontor.operators import load as L
from kontor.operators import monitor as M
from kontor.operators import quality as Q
from kontor.operators import rollup as R
from kontor.operators import sinks as S
from kontor.operators import upsert as U
from kontor.plans.demo_view import companies, table
from kontor.session import checkpoint_cut


def events(spark, sf_dir):
    return table(spark, sf_dir, "events")


# --- job metrics ----------------------------------------------------------------------------

_BUCKET_ROWS = " UNION ALL ".join(
    [f"SELECT 'duration_le' AS metric, source, '{le}' AS label, count(*) FILTER (d <= {le}) AS value FROM j GROUP BY source" for le in R.JOB_BUCKETS]
    + ["SELECT 'duration_le', source, '+Inf', count(d) FROM j GROUP BY source"]
    + [
        f"SELECT 'results', source, '{label}', CAST(sum({c}) AS BIGINT) FROM j GROUP BY source"
        for c, label in (("new_companies", "new_companies"), ("updated_companies", "updated_companies"), ("errors_count", "errors"))
    ]
)


@query(
    "metrics_jobs",
    f"""WITH j AS (SELECT *, CASE WHEN duration_seconds > 0 THEN duration_seconds END AS d FROM ({JOB_SQL}) x)
        SELECT 'jobs' AS metric, source, status AS label, count(*) AS value FROM j GROUP BY source, status UNION ALL {_BUCKET_ROWS}""",
)
def _(spark, sf_dir):
    return R.job_metrics(U.finalize_jobs(jobs(spark, sf_dir), outcomes(spark, sf_dir)))


@query(
    "metrics_flatten",
    """SELECT 'k' AS key, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS n FROM events""",
)
def _(spark, sf_dir):
    return R.flatten_counters(events(spark, sf_dir), "props")


@query(
    "metrics_flatten_nested",
    """SELECT event_type AS grp, CASE WHEN user_id % 2 = 0 THEN 'even' ELSE 'odd' END AS key, count(*) AS n FROM events GROUP BY 1, 2""",
)
def _(spark, sf_dir):
    stats = events(spark, sf_dir).selectExpr(
        """concat('{"', event_type, '": {"', CASE WHEN user_id % 2 = 0 THEN 'even' ELSE 'odd' END, '": 1}}') AS stats"""
    )
    return R.flatten_counters(stats, "stats", levels=2)


@query(
    "metrics_counter_delta",
    """WITH s AS (SELECT event_id, event_type AS queue, ts, event_id % 700 AS sample FROM events)
       SELECT event_id, CAST(CASE WHEN sample >= prev THEN sample - prev ELSE sample END AS BIGINT) AS delta
       FROM (SELECT *, coalesce(lag(sample) OVER (PARTITION BY queue ORDER BY ts, event_id), 0) AS prev FROM s) x""",
)
def _(spark, sf_dir):
    samples = events(spark, sf_dir).selectExpr("event_id", "event_type AS queue", "ts", "event_id % 700 AS sample")
    return M.counter_delta(samples, ["queue"], "ts", "event_id", "sample").select("event_id", "delta")


_BOUNDS = [5.0, 10.0, 25.0, 50.0, 100.0, 250.0]


def _quantile_sql(q: float) -> str:
    cases = " UNION ALL ".join(
        f"SELECT event_type, {b}::DOUBLE AS le, {a}::DOUBLE AS lower, count(*) FILTER (value <= {b}) AS n, count(*) FILTER (value <= {a}) AS before, count(*) AS total FROM events GROUP BY event_type"
        for a, b in zip([0.0, *_BOUNDS[:-1]], _BOUNDS)
    )
    return f"""SELECT event_type, round(coalesce(arg_min(lower + (le - lower) * ({q}::DOUBLE * total - before) / (n - before), le)
                 FILTER (n >= {q}::DOUBLE * total AND n > before), {_BOUNDS[-1]}::DOUBLE), 6) AS quantile FROM ({cases}) x GROUP BY event_type"""


def _register_quantiles() -> None:
    for q in (0.5, 0.95, 0.99):
        def build(spark, sf_dir, q=q):
            hist = R.to_histogram(events(spark, sf_dir), ["event_type"], F.col("value"), _BOUNDS)
            return R.histogram_quantile(hist, ["event_type"], "le", "n", q).withColumn("quantile", F.round("quantile", 6))

        query(f"metrics_histogram_p{int(q * 100)}", _quantile_sql(q))(build)


_register_quantiles()


@query(
    "metrics_top_rate",
    "SELECT CAST(user_id AS VARCHAR) AS endpoint, count(*) AS requests, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
)
def _(spark, sf_dir):
    return R.top_endpoints(events(spark, sf_dir).selectExpr("CAST(user_id AS STRING) AS endpoint", "value"))


@query(
    "metrics_top_p95",
    "SELECT CAST(user_id AS VARCHAR) AS endpoint, count(*) AS requests, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY 1 ORDER BY 3 DESC, 1 LIMIT 10",
)
def _(spark, sf_dir):
    return R.top_endpoints(events(spark, sf_dir).selectExpr("CAST(user_id AS STRING) AS endpoint", "value"), by="p95")


@query(
    "metrics_percentile",
    """SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99
       FROM events GROUP BY event_type""",
)
def _(spark, sf_dir):
    ranks = R.percentiles(events(spark, sf_dir), ["event_type"], "value", [0.5, 0.95, 0.99])
    return ranks.select("event_type", *[F.round(f"p{p}", 6).alias(f"p{p}") for p in (50, 95, 99)])


_STATEMENT = "CASE WHEN event_type = 'view' THEN 'vacuum full' WHEN event_type = 'click' THEN 'Commit' ELSE 'SELECT ' || event_type || CAST(user_id % 20 AS {t}) END"


@query(
    "metrics_slow_queries",
    f"""SELECT query, count(*) AS calls, round(sum(value), 6) AS total_time, round(avg(value), 6) AS mean_time, max(value) AS max_time, round(stddev_pop(value), 6) AS stddev_time
        FROM (SELECT {_STATEMENT.format(t='VARCHAR')} AS query, value FROM events) x
        WHERE query NOT ILIKE 'VACUUM%' AND query NOT ILIKE 'BEGIN%' AND query NOT ILIKE 'COMMIT%' GROUP BY query ORDER BY avg(value) DESC, query LIMIT 20""",
)
def _(spark, sf_dir):
    log = events(spark, sf_dir).selectExpr(f"{_STATEMENT.format(t='STRING')} AS query", "value AS elapsed")
    top = R.slow_queries(log)
    return top.withColumns({c: F.round(c, 6) for c in ("total_time", "mean_time", "stddev_time")})


# --- extraction quality ------------------------------------------------------------------------

# Extracted: the raw demo rows; expected: the stored ones.
_FIELDS = ["company_name", "email", "phone", "website", "city", "technologies"]


def _quality_sql() -> str:
    text = [f for f in _FIELDS if f != "technologies"]
    state = "CASE WHEN coalesce({w}, '') = '' AND coalesce({g}, '') = '' THEN 'none' WHEN coalesce({w}, '') = '' THEN 'invented' WHEN coalesce({g}, '') = '' THEN 'missed' WHEN {nw} = {ng} THEN 'right' ELSE 'wrong' END"

    def arm(f):
        return state.format(w=f"e.{f}", g=f"x.{f}", nw=f"lower({D.strip('e.' + f)})", ng=f"lower({D.strip('x.' + f)})")

    def sorted_list(c):
        return f"list_sort(list_transform(string_split({c}, '|'), lambda t: lower({D.strip('t')})))"

    # splitting an empty text gives one empty item, so the raw list is never empty
    tech = (
        "CASE WHEN coalesce(e.technologies_text, '') = '' THEN 'invented'"
        f" WHEN {sorted_list('e.technologies_text')} = {sorted_list('x.technologies_text')} THEN 'right' ELSE 'wrong' END"
    )
    states = "[" + ", ".join([arm(f) for f in text] + [tech]) + "]"
    given = "[" + ", ".join(f"x.{f} IS NOT NULL" for f in [*text, "technologies_text"]) + "]"
    return f"""SELECT e.id, {states} AS states, {given} AS given FROM ({D.STORED}) e JOIN ({D.CO}) x ON x.id = e.id"""


def _n(*names: str) -> str:
    quoted = ", ".join(f"'{n}'" for n in names)
    return f"len(list_filter(states, lambda s: s IN ({quoted})))"


@query(
    "quality_fields",
    f"""WITH c AS (SELECT id, {_n('right')} AS tp, {_n('wrong', 'invented')} AS fp, {_n('missed')} AS fn FROM ({_quality_sql()}) s),
        r AS (SELECT id, CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) ELSE 0 END AS p, CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) ELSE 0 END AS r, tp::DOUBLE / 6 AS c FROM c)
        SELECT id, round(p, 6) AS precision, round(r, 6) AS recall, round(c, 6) AS completeness, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1 FROM r""",
)
def _(spark, sf_dir):
    rated = Q.field_quality(companies(spark, sf_dir), stored(spark, sf_dir), "id", _FIELDS)
    return rated.select("id", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "completeness", "f1")])


@query(
    "quality_hallucination",
    f"""SELECT id, round(CASE WHEN n > 0 THEN len(list_filter(list_zip(states, given), lambda s: s[2] AND s[1] IN ('wrong', 'invented', 'missed')))::DOUBLE / n ELSE 0 END, 6)
          AS hallucination_rate FROM (SELECT *, len(list_filter(given, lambda g: g)) AS n FROM ({_quality_sql()}) s) t""",
)
def _(spark, sf_dir):
    rated = Q.hallucination(companies(spark, sf_dir), stored(spark, sf_dir), "id", _FIELDS)
    return rated.withColumn("hallucination_rate", F.round("hallucination_rate", 6))


@query(
    "quality_norm_value",
    f"SELECT id, lower({D.strip('company_name')}) AS name, array_to_string(list_sort(list_transform(string_split(technologies_text, '|'), lambda t: lower({D.strip('t')}))), '|') AS technologies FROM ({D.CO}) c",
)
def _(spark, sf_dir):
    return companies(spark, sf_dir).select(
        "id",
        Q.norm_value(F.col("company_name")).alias("name"),
        F.array_join(Q.norm_value(F.col("technologies"), "array"), "|").alias("technologies"),
    )


# Benchmark results derived from events: the event type is the model, the value the latency.
_RESULT_COLS = """event_type AS model, user_id AS case_id, value / 10 AS latency,
  (event_id % 10) / CAST(10 AS DOUBLE) AS precision, (event_id % 7) / CAST(7 AS DOUBLE) AS recall, (event_id % 9) / CAST(9 AS DOUBLE) AS f1,
  (event_id % 5) / CAST(5 AS DOUBLE) AS completeness, event_id % 3 <> 0 AS json_valid, (user_id % 4) / CAST(10 AS DOUBLE) AS hallucination_rate,
  CASE WHEN event_id % 6 <> 0 THEN value * 2 END AS memory_used_mb, CASE WHEN event_id % 50 = 0 THEN 'timeout' END AS error, length(props) AS answer_length"""


def _results(spark, sf_dir):
    rows = events(spark, sf_dir).selectExpr(*[c.strip() for c in _split_columns(_RESULT_COLS)])
    return rows.withColumn("tokens_per_second", Q.tokens_per_second(F.col("answer_length"), F.col("latency")))


def _split_columns(text: str) -> list[str]:
    parts, depth, cur = [], 0, ""
    for ch in text:
        depth += (ch == "(") - (ch == ")")
        if ch == "," and depth == 0:
            parts.append(cur)
            cur = ""
        else:
            cur += ch
    return [*parts, cur]


_SUMMARY_SQL = f"""
SELECT model, count(*) AS runs, avg(precision) AS precision, avg(recall) AS recall, avg(f1) AS f1, avg(completeness) AS completeness,
  avg(hallucination_rate) AS hallucination_rate, avg(CAST(json_valid AS DOUBLE)) AS json_valid_rate,
  quantile_cont(latency, 0.5) AS latency_p50, quantile_cont(latency, 0.95) AS latency_p95, quantile_cont(latency, 0.99) AS latency_p99,
  avg(CASE WHEN latency > 0 THEN greatest(1, floor(answer_length / 4)) / latency ELSE 0 END) AS mean_tokens_per_second,
  max(memory_used_mb) AS peak_memory_mb, count(error) AS errors
FROM (SELECT {_RESULT_COLS} FROM events) r GROUP BY model
"""
_SUMMARY_ROUND = [
    "precision", "recall", "f1", "completeness", "hallucination_rate", "json_valid_rate", "latency_p50", "latency_p95",
    "latency_p99", "mean_tokens_per_second", "peak_memory_mb",
]


@query(
    "quality_model_summary",
    f"SELECT model, runs, errors, {', '.join(f'round({c}, 6) AS {c}' for c in _SUMMARY_ROUND)} FROM ({_SUMMARY_SQL}) s",
)
def _(spark, sf_dir):
    return Q.model_summary(_results(spark, sf_dir)).withColumns({c: F.round(c, 6) for c in _SUMMARY_ROUND})


@query("quality_case_errors", f"SELECT model, case_id, count(*) AS errors FROM (SELECT {_RESULT_COLS} FROM events) r WHERE error IS NOT NULL GROUP BY 1, 2")
def _(spark, sf_dir):
    return Q.errors_per_case(_results(spark, sf_dir))


@query(
    "quality_recommend",
    f"""SELECT model, round(CASE WHEN quick THEN least(t + 0.05::DOUBLE, 0.25::DOUBLE) ELSE t END, 6) AS temperature,
          CASE WHEN latency_p95 > 12 THEN least(tp, 0.88::DOUBLE) ELSE tp END AS top_p,
          CAST(CASE WHEN latency_p95 > 12 THEN least(np, 1024) ELSE np END AS INT) AS num_predict, rp AS repeat_penalty, CAST(tk AS INT) AS top_k
        FROM (SELECT model, latency_p95, latency_p95 < 6 AND f1 > 0.65 AS quick, CASE WHEN hallucination_rate > 0.15 THEN 0.05::DOUBLE ELSE 0.1::DOUBLE END AS t,
            CASE WHEN hallucination_rate > 0.15 THEN 0.85::DOUBLE ELSE 0.9::DOUBLE END AS tp, CASE WHEN completeness < 0.55 THEN 1536 ELSE 1024 END AS np,
            CASE WHEN hallucination_rate > 0.15 THEN 1.15::DOUBLE ELSE 1.05::DOUBLE END AS rp, CASE WHEN completeness < 0.55 THEN 60 END AS tk FROM ({_SUMMARY_SQL}) s) x""",
)
def _(spark, sf_dir):
    rows = Q.recommend_config(Q.model_summary(_results(spark, sf_dir)))
    return rows.select("model", F.round("temperature", 6).alias("temperature"), "top_p", "num_predict", "repeat_penalty", "top_k")


@query(
    "quality_best_variant",
    """SELECT prompt, round(f, 6) AS f1_mean, round(h, 6) AS hallucination_mean FROM (
         SELECT event_type AS prompt, avg((event_id % 9) / 9.0::DOUBLE) AS f, avg((user_id % 4) / 10.0::DOUBLE) AS h, min(event_id) AS position FROM events GROUP BY 1) x
       ORDER BY round(f - h, 12) DESC, position LIMIT 1""",
)
def _(spark, sf_dir):
    scores = events(spark, sf_dir).selectExpr(
        "event_type AS prompt", "event_id AS position", "(event_id % 9) / 9.0D AS f1", "(user_id % 4) / 10.0D AS hallucination"
    )
    best = Q.best_variant(scores)
    return best.select("prompt", F.round("f1_mean", 6).alias("f1_mean"), F.round("hallucination_mean", 6).alias("hallucination_mean"))


_ROUTE_IN = "CASE doc_id % 4 WHEN 0 THEN 'simple' WHEN 1 THEN 'complex' WHEN 2 THEN 'medium' END AS cx, CASE doc_id % 5 WHEN 0 THEN 'speed' WHEN 1 THEN 'accuracy' WHEN 2 THEN 'resource_efficient' WHEN 3 THEN 'balanced' END AS pr"


@query(
    "quality_route_model",
    f"""SELECT doc_id, CASE WHEN n_chars < 1000 AND cx = 'simple' THEN CASE WHEN pr = 'accuracy' THEN 'llama3.2' ELSE 'llama3.2:1b' END
          WHEN n_chars > 5000 OR cx = 'complex' THEN CASE WHEN pr = 'speed' THEN 'mistral' ELSE 'llama3.2' END
          WHEN pr = 'speed' THEN 'llama3.2:1b' WHEN pr = 'accuracy' THEN 'llama3.2' WHEN pr = 'resource_efficient' THEN 'qwen2.5' ELSE 'mistral' END AS model
        FROM (SELECT doc_id, n_chars, {_ROUTE_IN} FROM documents) d""",
)
def _(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").selectExpr("doc_id", "n_chars", *[c.strip() for c in _ROUTE_IN.split(", ")])
    return docs.select("doc_id", routing.route_model(F.col("n_chars"), F.col("cx"), F.col("pr")).alias("model"))


@query(
    "quality_model_for_use_case",
    """SELECT doc_id, CASE WHEN pr <> 'balanced' THEN CASE pr WHEN 'speed' THEN 'llama3.2:1b' WHEN 'accuracy' THEN 'llama3.2' ELSE 'llama3.2' END
         ELSE CASE uc WHEN 'company_basic' THEN 'llama3.2:1b' WHEN 'company_detailed' THEN 'llama3.2' ELSE 'mistral' END END AS model
       FROM (SELECT doc_id, CASE source WHEN 'src0' THEN 'company_basic' WHEN 'src1' THEN 'company_detailed' ELSE 'employees' END AS uc,
         CASE doc_id % 4 WHEN 0 THEN 'speed' WHEN 1 THEN 'accuracy' WHEN 2 THEN 'unheard_of' ELSE 'balanced' END AS pr FROM documents) d""",
)
def _(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").selectExpr(
        "doc_id",
        "CASE source WHEN 'src0' THEN '' WHEN 'src1' THEN 'company_detailed' ELSE 'employees' END AS uc",
        "CASE doc_id % 4 WHEN 0 THEN 'Speed' WHEN 1 THEN 'accuracy' WHEN 2 THEN 'unheard_of' END AS pr",
    )
    return docs.select("doc_id", routing.model_for_use_case(F.col("uc"), F.col("pr")).alias("model"))


# --- load analysis ---------------------------------------------------------------------------------

_SPAN = 30 * 86400


def _endpoints(spark, sf_dir, where="true", seconds=_SPAN):
    rows = events(spark, sf_dir).filter(where).withColumn("latency", F.col("value") * 10)
    rows = rows.withColumn("endpoint", F.concat_ws("-", "event_type", (F.col("user_id") % 5).cast("string")))
    return L.endpoint_rollup(rows, "endpoint", "latency", F.col("event_id") % 40 == 0, seconds)


def _endpoint_sql(where="true", seconds=_SPAN):
    return f"""SELECT event_type || '-' || CAST(user_id % 5 AS VARCHAR) AS name, count(*) AS requests, count(*) FILTER (event_id % 40 = 0) AS failures,
      count(*) FILTER (event_id % 40 = 0) * 100.0::DOUBLE / count(*) AS error_rate_pct, quantile_cont(value * 10, 0.5) AS p50_ms, quantile_cont(value * 10, 0.95) AS p95_ms,
      quantile_cont(value * 10, 0.99) AS p99_ms, count(*) / {seconds}::DOUBLE AS rps FROM events WHERE {where} GROUP BY 1"""


def _total_sql(rel):
    return f"SELECT sum(requests) / (sum(requests) / sum(rps)) * 60 AS rpm, sum(failures) * 100.0::DOUBLE / sum(requests) AS err, avg(p95_ms) AS p95 FROM ({rel}) e"


@query(
    "load_endpoints",
    f"SELECT name, requests, failures, round(error_rate_pct, 6) AS error_rate_pct, round(p50_ms, 6) AS p50_ms, round(p95_ms, 6) AS p95_ms, round(p99_ms, 6) AS p99_ms, round(rps, 9) AS rps FROM ({_endpoint_sql()}) e",
)
def _(spark, sf_dir):
    rows = _endpoints(spark, sf_dir)
    return rows.withColumns({c: F.round(c, 6) for c in ("error_rate_pct", "p50_ms", "p95_ms", "p99_ms")} | {"rps": F.round("rps", 9)})


@query(
    "load_score",
    f"""SELECT round((least(rpm / 1000, 1) * 100 + greatest(0, 100 - least(err / 1, 1) * 100) + least(200 / p95, 1) * 100) / 3, 2) AS score,
          rpm >= 1000 AND err <= 1 AND p95 <= 200 AS passed, round(least(rpm / 1000, 1) * 100, 2) AS throughput_score, round(greatest(0, 100 - least(err, 1) * 100), 2) AS error_score,
          round(least(200 / p95, 1) * 100, 2) AS latency_score, round(rpm, 2) AS throughput_rpm, round(err, 3) AS error_rate_pct, round(p95, 2) AS avg_p95_latency_ms FROM ({_total_sql(_endpoint_sql())}) t""",
)
def _(spark, sf_dir):
    return L.performance_score(_endpoints(spark, sf_dir))


@query("load_bottlenecks", f"SELECT name, round(p95_ms, 6) AS p95_ms, round(error_rate_pct, 6) AS error_rate_pct, requests FROM ({_endpoint_sql()}) e WHERE p95_ms > 500 OR error_rate_pct > 1")
def _(spark, sf_dir):
    return L.bottlenecks(_endpoints(spark, sf_dir)).select(
        "name", F.round("p95_ms", 6).alias("p95_ms"), F.round("error_rate_pct", 6).alias("error_rate_pct"), "requests"
    )


_FIRST, _SECOND = "ts < TIMESTAMP '2024-01-16'", "ts >= TIMESTAMP '2024-01-16'"


@query(
    "load_baseline_delta",
    f"SELECT round(a.rpm - b.rpm, 2) AS throughput_delta_rpm, round(a.err - b.err, 3) AS error_rate_delta_pct FROM ({_total_sql(_endpoint_sql(_SECOND, _SPAN // 2))}) a, ({_total_sql(_endpoint_sql(_FIRST, _SPAN // 2))}) b",
)
def _(spark, sf_dir):
    return L.baseline_delta(_endpoints(spark, sf_dir, _SECOND, _SPAN // 2), _endpoints(spark, sf_dir, _FIRST, _SPAN // 2))


# --- alert rules ---------------------------------------------------------------------------------


def _minutes(count: int, cols: str, by: str = "") -> str:
    """Every event in every sliding window of ``count`` minutes that holds it, aggregated."""
    return f"""SELECT date_trunc('minute', ts) - INTERVAL 1 MINUTE * o AS window_start, {cols} FROM events, range(0, {count}) r(o) GROUP BY 1 {by}"""


def _stamp(df, column="window_start"):
    return df.withColumn(column, F.date_format(column, "yyyy-MM-dd HH:mm:ss"))


def _ratio_sql(threshold: float, bad: str) -> str:
    return f"""WITH w AS ({_minutes(5, f'count(*) AS total, count(*) FILTER ({bad}) AS errors')}),
      b AS (SELECT *, errors::DOUBLE / total > {threshold} AS breached FROM w)
      SELECT strftime(window_start, '%Y-%m-%d %H:%M:%S') AS window_start, total, errors, round(errors::DOUBLE / total, 6) AS ratio, breached,
        sum(CAST(breached AS INT)) OVER (ORDER BY window_start RANGE BETWEEN INTERVAL 4 MINUTE PRECEDING AND CURRENT ROW) >= 5 AS firing FROM b"""


def _ratio(spark, sf_dir, threshold, bad):
    alert = M.ratio_alert(events(spark, sf_dir), "ts", F.expr(bad), threshold)
    return _stamp(alert).withColumn("ratio", F.round("ratio", 6))


@query("alert_http_errors", _ratio_sql(0.05, "event_type = 'error'"))
def _(spark, sf_dir):
    return _ratio(spark, sf_dir, M.HTTP_ERROR_RATIO, "event_type = 'error'")


@query("alert_job_failures", _ratio_sql(0.2, "event_type = 'error'"))
def _(spark, sf_dir):
    return _ratio(spark, sf_dir, M.JOB_FAILURE_RATIO, "event_type = 'error'")


@query("alert_result_errors", _ratio_sql(0.1, "value > 50"))
def _(spark, sf_dir):
    return _ratio(spark, sf_dir, M.RESULT_ERROR_RATIO, "value > 50")


def _level_sql(minutes: int, agg: str, threshold: float, hold: int) -> str:
    return f"""WITH w AS ({_minutes(minutes, f'{agg} AS level')}), b AS (SELECT *, level > {threshold} AS breached FROM w)
      SELECT strftime(window_start, '%Y-%m-%d %H:%M:%S') AS window_start, round(CAST(level AS DOUBLE), 6) AS level, breached,
        sum(CAST(breached AS INT)) OVER (ORDER BY window_start RANGE BETWEEN INTERVAL {hold - 1} MINUTE PRECEDING AND CURRENT ROW) >= {hold} AS firing FROM b"""


@query("alert_latency", _level_sql(5, "quantile_cont(value / 100, 0.95)", 0.3, 5))
def _(spark, sf_dir):
    rows = events(spark, sf_dir).withColumn("seconds", F.col("value") / 100)
    alert = M.quantile_alert(rows, "ts", "seconds", 0.95, 0.3)
    return _stamp(alert).withColumn("level", F.round("level", 6))


@query("alert_request_rate", _level_sql(5, "count(*) / 300.0::DOUBLE", 0.005, 5))
def _(spark, sf_dir):
    alert = M.level_alert(events(spark, sf_dir), "ts", F.count(F.lit(1)) / F.lit(300.0), 0.005)
    return _stamp(alert).withColumn("level", F.round("level", 6))


@query("alert_backlog", _level_sql(5, "max(CAST(json_extract_string(props, '$.k') AS BIGINT))", 40, 10))
def _(spark, sf_dir):
    size = F.max(F.get_json_object("props", "$.k").cast("bigint"))
    alert = M.level_alert(events(spark, sf_dir), "ts", size, 40, hold="10 minutes")
    return _stamp(alert).withColumn("level", F.round(F.col("level").cast("double"), 6))


def _absence_sql(minutes: int, running: str | None) -> str:
    slot = f"CAST(floor(epoch(ts) / {minutes * 60}) AS BIGINT) * {minutes * 60}"
    alive = f"count(*) FILTER ({running}) > 0" if running else "true"
    return f"""WITH s AS (SELECT {slot} AS slot, count(*) FILTER (event_type = 'purchase') AS n, {alive} AS alive FROM events GROUP BY 1),
      t AS (SELECT unnest(range((SELECT min(slot) FROM s), (SELECT max(slot) FROM s) + 1, {minutes * 60})) AS slot)
      SELECT strftime(make_timestamp(t.slot * 1000000), '%Y-%m-%d %H:%M:%S') AS window_start, coalesce(n, 0) AS n,
        coalesce(n, 0) = 0 AND coalesce(alive, {'false' if running else 'true'}) AS firing FROM t LEFT JOIN s USING (slot)"""


@query("alert_absence", _absence_sql(60, None))
def _(spark, sf_dir):
    return _stamp(M.absence_alert(events(spark, sf_dir), "ts", F.col("event_type") == "purchase"))


@query("alert_stuck", _absence_sql(10, "event_type = 'click'"))
def _(spark, sf_dir):
    done, busy = F.col("event_type") == "purchase", F.col("event_type") == "click"
    return _stamp(M.absence_alert(events(spark, sf_dir), "ts", done, "10 minutes", busy))


@query("alert_worker_down", _absence_sql(5, "event_type = 'view'"))
def _(spark, sf_dir):
    done, queued = F.col("event_type") == "purchase", F.col("event_type") == "view"
    return _stamp(M.absence_alert(events(spark, sf_dir), "ts", done, "5 minutes", queued))


# --- gauges and guards -------------------------------------------------------------------------------


@query(
    "gauge_in_progress",
    """SELECT event_id, CAST(sum(CASE event_type WHEN 'click' THEN 1 WHEN 'purchase' THEN -1 ELSE 0 END) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS in_progress FROM events""",
)
def _(spark, sf_dir):
    start, end = F.col("event_type") == "click", F.col("event_type") == "purchase"
    return M.in_progress(events(spark, sf_dir), "ts", "event_id", start, end).select("event_id", "in_progress")


# Several users share a login here so that failures come close together.
@query(
    "guard_lockouts",
    """WITH RECURSIVE e AS (SELECT event_id, user_id % 2 AS login, epoch_us(ts) AS us, event_type NOT IN ('error', 'view', 'signup') AS ok,
         row_number() OVER (PARTITION BY user_id % 2 ORDER BY ts, event_id) AS n FROM events),
       st AS (SELECT login, 0::BIGINT AS n, CAST(NULL AS BIGINT) AS event_id, 0::BIGINT AS fails, 0::BIGINT AS until, false AS refused FROM e WHERE n = 1
         UNION ALL
         SELECT e.login, e.n, e.event_id, CASE WHEN e.ok THEN CASE WHEN st.until > e.us THEN st.fails ELSE 0 END ELSE st.fails + 1 END,
           CASE WHEN NOT e.ok AND st.fails + 1 >= 5 THEN e.us + 3600000000 ELSE st.until END, e.ok AND st.until > e.us
         FROM st JOIN e ON e.login = st.login AND e.n = st.n + 1)
       SELECT event_id, fails AS failed_attempts, refused FROM st WHERE n > 0""",
)
def _(spark, sf_dir):
    rows = events(spark, sf_dir).withColumn("login", F.col("user_id") % 2)
    ok = ~F.col("event_type").isin("error", "view", "signup")
    return M.lockouts(rows, "login", "ts", "event_id", ok).select("event_id", "failed_attempts", "refused")


@query(
    "guard_suppress",
    """WITH RECURSIVE e AS (SELECT event_id, event_type, epoch_us(ts) AS us, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS n FROM events),
       st AS (SELECT event_type, 0::BIGINT AS n, CAST(NULL AS BIGINT) AS event_id, CAST(NULL AS BIGINT) AS last_sent, false AS sent FROM e WHERE n = 1
         UNION ALL
         SELECT e.event_type, e.n, e.event_id, CASE WHEN st.last_sent IS NULL OR e.us - st.last_sent >= 3600000000 THEN e.us ELSE st.last_sent END,
           st.last_sent IS NULL OR e.us - st.last_sent >= 3600000000 FROM st JOIN e ON e.event_type = st.event_type AND e.n = st.n + 1)
       SELECT event_id, sent FROM st WHERE n > 0""",
)
def _(spark, sf_dir):
    return M.suppress(events(spark, sf_dir), "event_type", "ts", "event_id", ttl=3600).select("event_id", "sent")


@query(
    "guard_admission",
    """WITH RECURSIVE e AS (SELECT event_id, event_type, epoch_us(ts) AS us, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS n FROM events),
       st AS (SELECT event_type, 0::BIGINT AS n, CAST(NULL AS BIGINT) AS event_id, CAST([] AS BIGINT[]) AS kept, false AS admitted, 0::BIGINT AS remaining FROM e WHERE n = 1
         UNION ALL
         SELECT event_type, n, event_id, CASE WHEN len(k) < 3 THEN list_append(k, us) ELSE k END, len(k) < 3, greatest(0, 3 - len(k) - CAST(len(k) < 3 AS BIGINT))
         FROM (SELECT e.*, list_filter(st.kept, lambda x: x > e.us - 3600000000) AS k FROM st JOIN e ON e.event_type = st.event_type AND e.n = st.n + 1) y)
       SELECT event_id, admitted, remaining FROM st WHERE n > 0""",
)
def _(spark, sf_dir):
    rows = M.admission(events(spark, sf_dir), "event_type", "ts", "event_id", limit=3, width=3600)
    return rows.select("event_id", "admitted", "remaining")


@query(
    "guard_observed_load",
    """SELECT event_id, count(*) OVER (PARTITION BY event_type ORDER BY epoch_us(ts) RANGE BETWEEN 1799999999 PRECEDING AND CURRENT ROW) AS observed FROM events""",
)
def _(spark, sf_dir):
    return M.observed_load(events(spark, sf_dir), "event_type", "ts", 1800).select("event_id", "observed")


@query(
    "guard_observed_load_3h",
    """SELECT event_id, count(*) OVER (PARTITION BY event_type ORDER BY epoch_us(ts) RANGE BETWEEN 10799999999 PRECEDING AND CURRENT ROW) AS observed FROM events""",
)
def _(spark, sf_dir):
    return M.observed_load(events(spark, sf_dir), "event_type", "ts", 10_800).select("event_id", "observed")


@query(
    "events_fan_out",
    """WITH s AS (SELECT s_suppkey AS webhook_id, 'https://hook' || CAST(s_suppkey AS VARCHAR) AS url, s_acctbal > 0 AS active,
         CASE s_nationkey % 3 WHEN 0 THEN ['view', 'error'] WHEN 1 THEN ['purchase', 'purchase'] ELSE ['signup'] END AS events FROM supplier)
       SELECT event_id, webhook_id, url FROM events e JOIN s ON s.active AND list_contains(s.events, e.event_type)""",
)
def _(spark, sf_dir):
    subs = table(spark, sf_dir, "supplier").selectExpr(
        "s_suppkey AS webhook_id",
        "concat('https://hook', CAST(s_suppkey AS STRING)) AS url",
        "s_acctbal > 0 AS active",
        "CASE s_nationkey % 3 WHEN 0 THEN array('view', 'error') WHEN 1 THEN array('purchase', 'purchase') ELSE array('signup') END AS events",
    )
    return M.fan_out(events(spark, sf_dir), subs, "event_type").select("event_id", "webhook_id", "url")


_CHECK = "CASE event_type WHEN 'view' THEN 'database' WHEN 'click' THEN 'redis' WHEN 'error' THEN 'ollama' WHEN 'signup' THEN 'api' ELSE 'queue' END"
_STATE = "CASE WHEN value > 200 THEN 'unhealthy: slow' WHEN value > 150 THEN 'timeout' ELSE 'healthy' END"


def _checks(spark, sf_dir):
    return events(spark, sf_dir).selectExpr("event_id", "user_id AS round", "ts", f"{_CHECK} AS component", f"{_STATE} AS status")


@query(
    "health_rollup",
    f"""SELECT round, CASE WHEN bool_and(status = 'healthy') THEN 'healthy' ELSE 'degraded' END AS status,
          coalesce(array_to_string(list_sort(list_distinct(list(component) FILTER (status <> 'healthy'))), ','), '') AS failing,
          bool_or(status <> 'healthy' AND component IN ('database', 'redis')) AS critical
        FROM (SELECT user_id AS round, {_CHECK} AS component, {_STATE} AS status FROM events) c GROUP BY round""",
)
def _(spark, sf_dir):
    return M.health_rollup(_checks(spark, sf_dir), ["round"]).withColumn("failing", F.array_join("failing", ","))


@query(
    "health_alerts",
    f"""SELECT event_id, component || '_issue' AS alert_type, CASE WHEN component IN ('database', 'redis') THEN 'critical' ELSE 'warning' END AS severity,
          CASE WHEN contains(status, 'unhealthy') THEN status ELSE 'health_check_failed' END AS issue_type
        FROM (SELECT event_id, {_CHECK} AS component, {_STATE} AS status FROM events) c WHERE status <> 'healthy'""",
)
def _(spark, sf_dir):
    return M.component_alerts(_checks(spark, sf_dir)).select("event_id", "alert_type", "severity", "issue_type")


@query(
    "events_sessions",
    """WITH o AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS brk FROM events),
       s AS (SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM o)
       SELECT user_id, epoch_us(min(ts)) AS started_us, count(*) AS events FROM s GROUP BY user_id, sid""",
)
def _(spark, sf_dir):
    rows = M.sessionize(events(spark, sf_dir), "user_id", "ts", "6 hours", order="event_id")
    return rows.select("user_id", F.unix_micros("session_start").alias("started_us"), "events")


@query(
    "events_tumbling",
    "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS v FROM events GROUP BY 1, 2",
)
def _(spark, sf_dir):
    w = M.windowed(events(spark, sf_dir), "ts", "1 hour", "1 hour", ["event_type"], n=F.count(F.lit(1)), v=F.round(F.sum("value"), 4))
    return _stamp(w)


# --- sinks -------------------------------------------------------------------------------------------


def _timed(spark, sf_dir):
    """Demo companies with scrape times taken from the id."""
    return companies(spark, sf_dir).withColumns(
        {
            "first_scraped_at": F.timestamp_micros(F.lit(1_704_067_200_000_000) + F.col("id") * 3_600_500_000),
            "last_updated_at": F.expr("CASE WHEN id % 3 = 0 THEN timestamp_seconds(1704067200 + id * 60) END"),
        }
    )


_ISO_FIRST = "CASE WHEN id * 3600500000 % 1000000 = 0 THEN strftime(make_timestamp(1704067200000000 + id * 3600500000), '%Y-%m-%dT%H:%M:%S') ELSE strftime(make_timestamp(1704067200000000 + id * 3600500000), '%Y-%m-%dT%H:%M:%S.%f') END"
_ISO_LAST = "CASE WHEN id % 3 = 0 THEN strftime(make_timestamp((1704067200 + id * 60) * 1000000), '%Y-%m-%dT%H:%M:%S') END"


@query(
    "export_csv_rows",
    f"""SELECT id AS "ID", company_name AS "Name", city AS "City", street AS "Street", postal_code AS "Postal Code", phone AS "Phone", email AS "Email",
          website AS "Website", industry AS "Industry", lead_status AS "Lead Status", lead_quality AS "Lead Quality", lead_score AS "Lead Score",
          {_ISO_FIRST} AS "Created At", coalesce({_ISO_LAST}, '') AS "Updated At"
        FROM ({D.CO}) c WHERE lead_status = 'new'""",
)
def _(spark, sf_dir):
    return S.csv_rows(_timed(spark, sf_dir), status="NEW")


@query(
    "export_json_rows",
    f"""SELECT id, company_name AS name, city, street, postal_code, phone, email, website, industry, lead_status, lead_quality, lead_score,
          {_ISO_FIRST} AS created_at, {_ISO_LAST} AS updated_at FROM ({D.CO}) c WHERE lead_quality = 'b' ORDER BY id LIMIT 500""",
)
def _(spark, sf_dir):
    return S.json_rows(_timed(spark, sf_dir), quality="b", limit=500)


@query(
    "export_json_envelope",
    f"""SELECT count(*) AS total, '2024-02-01T00:00:00' AS exported_at, 'c' AS quality, CAST(sum(id) AS BIGINT) AS ids
        FROM (SELECT id FROM ({D.CO}) c WHERE lead_quality = 'c' ORDER BY id LIMIT 300) x""",
)
def _(spark, sf_dir):
    env = S.json_envelope(_timed(spark, sf_dir), F.lit("2024-02-01T00:00:00"), quality="c", limit=300)
    ids = F.aggregate("companies.id", F.lit(0).cast("bigint"), lambda a, x: a + x)
    return env.select("total", "exported_at", F.col("filters.lead_quality").alias("quality"), ids.alias("ids"))


@query(
    "export_dump",
    f"SELECT id, company_name, website, phone, email, address, city, postal_code FROM ({D.CO}) c",
)
def _(spark, sf_dir):
    rows = companies(spark, sf_dir).select("id", "company_name", "website", "phone", "email", "address", "city", "postal_code")
    return S.dump_rows(rows.withColumns({"detail_url": F.lit("x"), "source_url": F.lit("y")}))


@query(
    "snapshot_retention",
    """WITH m AS (SELECT o_orderkey AS snapshot, CASE o_orderpriority WHEN '1-URGENT' THEN 'daily' WHEN '2-HIGH' THEN 'weekly' WHEN '3-MEDIUM' THEN 'monthly' ELSE 'manual' END AS kind, o_orderdate FROM orders)
       SELECT snapshot, kind FROM m WHERE kind <> 'manual'
       QUALIFY row_number() OVER (PARTITION BY kind ORDER BY o_orderdate DESC, snapshot) > CASE kind WHEN 'daily' THEN 7 WHEN 'weekly' THEN 4 ELSE 12 END""",
)
def _(spark, sf_dir):
    manifest = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS snapshot",
        "CASE o_orderpriority WHEN '1-URGENT' THEN 'daily' WHEN '2-HIGH' THEN 'weekly' WHEN '3-MEDIUM' THEN 'monthly' ELSE 'manual' END AS kind",
        "o_orderdate AS created_at",
    )
    return S.expired_snapshots(manifest).select("snapshot", "kind")


_CHECKED = ["region", "nation", "customer", "orders", "lineitem", "events"]


@query(
    "snapshot_check",
    " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS row_count, count(*) AS copied, true AS valid FROM {t}" for t in _CHECKED if t != "customer")
    + """ UNION ALL SELECT 'customer', count(*), count(*) FILTER (c_acctbal >= 0), count(*) = count(*) FILTER (c_acctbal >= 0) FROM customer""",
)
def _(spark, sf_dir):
    """Written copies of whole tables; the one of the customers lacks those in debt and has to be found short."""
    tables = {t: table(spark, sf_dir, t) for t in _CHECKED}
    copies = {t: checkpoint_cut(rows.filter("c_acctbal >= 0") if t == "customer" else rows) for t, rows in tables.items()}
    return S.snapshot_check(tables, copies)
