"""Upsert order, prefix sums, exports, quality and load formulas on small tables."""

import json

import pytest
from pyspark.sql import functions as F

from kontor.operators import enrich as E
from kontor.operators import load as L
from kontor.operators import prefix, quality as Q, rollup, select, sinks, upsert as U


def test_upsert_order_and_null_city(spark):
    cur = spark.createDataFrame([(1, "A", None, "alt"), (2, "B", "Ulm", None)], "id long, company_name string, city string, email string")
    inc = spark.createDataFrame(
        [("A", None, None, 1), ("A", None, "neu", 2), ("A", None, None, 3), ("B", "Bonn", "b1", 4), ("B", "Bonn", None, 5), (None, "x", "y", 6), ("C", "Ulm", "c", 0)],
        "company_name string, city string, email string, seq long",
    )
    snapshot, counts = U.upsert(cur, inc, "seq")
    rows = {(r.company_name, r.city): (r.id, r.email) for r in snapshot.collect()}
    assert rows == {("A", None): (1, "neu"), ("B", "Ulm"): (2, None), ("C", "Ulm"): (3, "c"), ("B", "Bonn"): (4, "b1")}
    assert counts.first().asDict() == {"new": 2, "updated": 4, "errors": 1}


def test_upsert_updates_the_lowest_id_of_a_repeated_key(spark):
    cur = spark.createDataFrame([(5, "A", None, "x"), (2, "A", None, "y"), (9, "A", "Ulm", "z")], "id long, company_name string, city string, email string")
    inc = spark.createDataFrame([("A", None, "neu", 1), ("A", None, None, 2)], "company_name string, city string, email string, seq long")
    snapshot, counts = U.upsert(cur, inc, "seq")
    assert {r.id: r.email for r in snapshot.collect()} == {5: "x", 2: "neu", 9: "z"}
    assert counts.first().asDict() == {"new": 0, "updated": 2, "errors": 0}


def test_upsert_into_an_empty_table(spark):
    cur = spark.createDataFrame([], "id long, company_name string, city string, email string")
    inc = spark.createDataFrame([("A", "Ulm", "e", 7)], "company_name string, city string, email string, seq long")
    assert U.upsert(cur, inc, "seq")[0].first().id == 0


def test_bulk_arguments_are_checked(spark):
    rows, ids = spark.range(3), spark.range(1)
    with pytest.raises(ValueError):
        U.bulk_set(rows, ids, {"company_name": "x"})
    with pytest.raises(ValueError):
        U.bulk_set(rows, ids, {"lead_status": "nope"})
    with pytest.raises(ValueError):
        U.change_status(rows, ids)
    with pytest.raises(ValueError):
        select.parse_choice("NEW", ["new"], by="value")


@pytest.mark.parametrize("reverse", [False, True])
def test_carry_equals_one_window(spark, reverse):
    df = spark.range(300).selectExpr("id", "CASE WHEN id % 10 < 6 THEN 0 WHEN id % 10 = 9 THEN NULL ELSE id % 10 END AS k", "(id * 37) % 101 AS v", "CASE WHEN id % 7 = 0 THEN id END AS mark")
    got = prefix.carry(df, ["k"], ["v", "id"], sums={"s": F.col("v")}, lasts={"l": F.col("mark")}, reverse=reverse)
    down = "DESC" if reverse else "ASC"
    want = df.selectExpr(
        "id", f"sum(v) OVER (PARTITION BY k ORDER BY v {down}, id {down} ROWS UNBOUNDED PRECEDING) AS s",
        f"last(mark, true) OVER (PARTITION BY k ORDER BY v {down}, id {down} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS l",
    )
    assert sorted(map(tuple, got.select("id", "s", "l").collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    # further values in the same ranges, over all keys
    ranged = prefix.in_ranges(df, ["k"], ["v", "id"], reverse)
    assert ranged.groupBy(prefix.RANGE).count().agg(F.max("count")).first()[0] < 200
    first = prefix.carry(ranged, ["k"], ["v", "id"], sums={"s": F.col("v")}, reverse=reverse)
    if not reverse:
        both = prefix.carry(first, [], ["k", "v", "id"], sums={"n": F.lit(1)}).collect()
        assert sorted(r.n for r in both) == list(range(1, 301))
        assert [r.id for r in sorted(both, key=lambda r: r.n)] == [r.id for r in df.orderBy("k", "v", "id").collect()]


def slow_guards(rows, ttl, limit, width):
    """(sent, admitted, remaining) by id; rows are (id, key, second)."""
    last, held, out = {}, {}, {}
    for i, k, t in sorted(rows, key=lambda r: (r[2], r[0])):
        sent = k not in last or t - last[k] >= ttl
        if sent:
            last[k] = t
        kept = [x for x in held.get(k, []) if x > t - width]
        ok = len(kept) < limit
        held[k] = kept + [t] * ok
        out[i] = (sent, ok, max(0, limit - len(held[k])))
    return out


@pytest.mark.parametrize("seed, step", [(1, 7), (2, 40), (3, 400)])
def test_guards_of_a_key_that_never_pauses(spark, seed, step):
    import random

    from kontor.operators import monitor

    rng = random.Random(seed)
    rows, t = [], 0
    for i in range(1500):
        t += rng.randrange(step) if rng.random() < 0.9 else 0
        rows.append((i, rng.choice([0, 0, 0, 0, 1, 2, None]), t))
    rows += [(2000 + i, 9, 5) for i in range(40)]  # one second holds a whole key
    df = spark.createDataFrame(rows, "id long, k long, t long").withColumn("ts", F.timestamp_seconds("t")).repartition(4)
    want = slow_guards(rows, 300, 3, 60)
    sent = {r.id: r.sent for r in monitor.suppress(df, "k", "ts", "id", 300).collect()}
    assert sent == {i: v[0] for i, v in want.items()}
    admitted = {r.id: (r.admitted, r.remaining) for r in monitor.admission(df, "k", "ts", "id", 3, 60).collect()}
    assert admitted == {i: v[1:] for i, v in want.items()}


def test_provenance_keeps_sources_without_fields(spark):
    src = spark.createDataFrame(
        [(1, 0, "a", "u", ["y"]), (1, 1, "b", "u", None), (1, 2, "a", "u", ["x", "y"])],
        "id long, position long, name string, url string, fields array<string>",
    )
    got = E.merge_provenance(src, ["id"]).orderBy("position").collect()
    assert [(r.name, r.position, r.fields) for r in got] == [("a", 0, ["x", "y"]), ("b", 1, [])]


def test_exports(spark, tmp_path):
    df = spark.createDataFrame(
        [(2, "B", None, None, None, None, None, None, None, "new", "a", 1.5, None, None), (1, "A", "Ulm", None, None, None, None, None, None, "new", "b", None, None, None)],
        "id long, company_name string, city string, street string, postal_code string, phone string, email string, website string,"
        "industry string, lead_status string, lead_quality string, lead_score double, first_scraped_at timestamp, last_updated_at timestamp",
    ).withColumn("first_scraped_at", F.expr("CASE WHEN id = 1 THEN timestamp'2024-01-02 03:04:05' END"))
    rows = sinks.csv_rows(df, status="new").collect()
    assert [r["ID"] for r in rows] == [1, 2] and rows[0]["Created At"] == "2024-01-02T03:04:05" and rows[1]["Created At"] == ""
    sinks.export_csv(df, str(tmp_path / "csv"))
    back = spark.read.option("header", True).csv(str(tmp_path / "csv"))
    assert back.columns == list(sinks.CSV_COLUMNS) and back.count() == 2
    sinks.export_json(df, str(tmp_path / "json"), quality="a")
    assert spark.read.json(str(tmp_path / "json")).first().name == "B"
    env = json.loads(sinks.json_envelope(df, F.lit("t"), limit=1).toJSON().first())
    assert env["total"] == 1 and env["filters"] == {"limit": 1} and env["companies"][0]["id"] == 1
    with pytest.raises(ValueError):
        sinks.csv_rows(df, limit=0)


def test_quality_formulas(spark):
    want = spark.createDataFrame(
        [(1, "Firma", None, ["A", "b"], 5), (2, "X", "m", [], None), (3, "Y", "m", ["q"], 1)], "id long, name string, mail string, tech array<string>, size int"
    )
    got = spark.createDataFrame(
        [(1, " firma ", "erfunden", ["B", "a "], 6), (2, None, "m", None, None)], "id long, name string, mail string, tech array<string>, size int"
    )
    fields = ["name", "mail", "tech", "size"]
    q = {r.id: r for r in Q.field_quality(got, want, "id", fields).collect()}
    assert (q[1].tp, q[1].fp, q[1].fn) == (2, 2, 0) and q[1].precision == 0.5 and q[1].recall == 1.0 and q[1].completeness == 0.5
    assert (q[2].tp, q[2].fp, q[2].fn) == (1, 0, 1)
    assert (q[3].f1, q[3].completeness) == (0.0, 0.0)
    h = {r.id: r.hallucination_rate for r in Q.hallucination(got, want, "id", fields).collect()}
    assert h == {1: 0.5, 2: 0.0, 3: 1.0}  # of record 2 only the mail was extracted, and rightly
    blank = got.filter("id = 2").withColumns({"name": F.lit(""), "tech": F.array().cast("array<string>")})
    h = {r.id: r.hallucination_rate for r in Q.hallucination(blank, want, "id", fields).collect()}
    assert h[2] == pytest.approx(1 / 3)  # an empty name was extracted although one is expected


def test_load_score(spark):
    eps = spark.createDataFrame(
        [("/companies", 1200, 12, 220.0, 40.0), ("/idle", 0, 0, 9000.0, 0.0), ("/export", 300, 30, 800.0, 10.0)],
        "name string, requests long, failures long, p95_ms double, rps double",
    )
    row = L.performance_score(eps).first()
    assert (row.throughput_rpm, row.error_rate_pct, row.avg_p95_latency_ms) == (3000.0, 2.8, 510.0)
    assert (row.throughput_score, row.error_score, row.latency_score, row.passed) == (100.0, 0.0, 39.22, False)
    assert [r.name for r in L.bottlenecks(eps).collect()] == ["/export"]
    delta = L.baseline_delta(eps, eps.filter("name = '/companies'")).first()
    assert (delta.throughput_delta_rpm, delta.error_rate_delta_pct) == (600.0, 1.8)


def test_histogram_quantile_edges(spark):
    hist = spark.createDataFrame([("a", 1.0, 0), ("a", 2.0, 10), ("a", None, 10), ("b", 1.0, 0), ("b", None, 4), ("c", 1.0, 0), ("c", None, 0)], "k string, le double, n long")
    got = {r.k: r.quantile for r in rollup.histogram_quantile(hist, ["k"], "le", "n", 0.5).collect()}
    assert got == {"a": 1.5, "b": 1.0}


def test_percentiles_of_a_hot_group(spark):
    rows = spark.range(5000).selectExpr(
        "CASE WHEN id % 3 = 0 THEN 'hot' WHEN id = 1 THEN NULL ELSE concat('k', id % 40) END AS k",
        "CASE WHEN id % 11 <> 0 THEN (id * 7919 % 1009) / 10.0D - 20 END AS v",
    )
    got = {r.k: (r.n, r.p50, r.p95, r.p99) for r in rollup.percentiles(rows, ["k"], "v", [0.5, 0.95, 0.99]).collect()}
    want = rows.groupBy("k").agg(F.count("v").alias("n"), F.percentile("v", F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99))).alias("p"))
    expected = {r.k: (r.n, *r.p) for r in want.collect()}
    assert got.keys() == expected.keys() and None in got
    for k, values in expected.items():
        assert got[k] == pytest.approx(values, abs=1e-9)


def exact_percentiles(values, shares):
    import numpy as np

    return [float(np.percentile(np.array(values), 100 * p)) for p in shares]


def test_percentiles_of_close_and_extreme_values(spark):
    import math
    import random

    rng = random.Random(4)
    groups = {
        "one ms": [1.0 + rng.random() / 1000 for _ in range(4000)],
        "neighbours": [math.nextafter(1.0, 2.0) if i % 3 else 1.0 for i in range(300)] + [1.0 + 2**-50],
        "orders": [rng.choice([-1, 1]) * 10.0 ** rng.randint(-300, 300) for _ in range(500)],
        "tiny": [5e-324, 1e-310, 2.2250738585072014e-308, 2.225073858507201e-308, 0.0, -0.0, -5e-324],
        "powers": [2.0**k for k in range(-40, 41)] + [math.nextafter(2.0**k, 0) for k in range(-40, 41)],
        "single": [7.25],
        None: [float(i) for i in range(10)],
    }
    rows = spark.createDataFrame([(k, v) for k, vs in groups.items() for v in vs] + [("empty", None)], "k string, v double").repartition(5)
    shares = [0.0, 0.25, 0.5, 0.95, 1.0]
    got = {r.k: r for r in rollup.percentiles(rows, ["k"], "v", shares).collect()}
    assert set(got) == set(groups)
    for k, values in groups.items():
        assert got[k].n == len(values)
        assert [got[k].p0, got[k].p25, got[k].p50, got[k].p95, got[k].p100] == pytest.approx(exact_percentiles(values, shares), rel=1e-12, abs=0)


def test_images_keep_the_order(spark):
    import random
    import struct

    rng = random.Random(8)
    values = [struct.unpack("<d", rng.randbytes(8))[0] for _ in range(3000)] + [2.0**k for k in range(-1074, 1024, 7)] + [0.0, float("inf"), float("-inf")]
    values = sorted({v for v in values if v == v})
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i long, v double")
    images = [r.u for r in rows.select("i", rollup.ordered_image(F.col("v")).alias("u")).orderBy("i").collect()]
    assert all(a < b for a, b in zip(images, images[1:]))


@pytest.mark.parametrize("width, slide", [("5 minutes", "1 minute"), ("7 minutes", "3 minutes"), ("1 minute", "1 minute")])
def test_window_percentiles_equal_copies(spark, width, slide):
    from kontor.operators import monitor

    rows = spark.range(3000).selectExpr("timestamp_seconds(1700000000 + (id * 7919) % 4000) AS ts", "(id * 31 % 997) / 997.0D AS v")
    got = monitor.quantile_alert(rows, "ts", "v", 0.95, 0.9, width, slide, slide)
    copied = rows.groupBy(F.window("ts", width, slide).alias("w")).agg(F.percentile("v", F.lit(0.95)).alias("level")).select(F.col("w.start").alias("window_start"), "level")
    want = {r.window_start: r.level for r in copied.collect()}
    found = {r.window_start: r.level for r in got.collect()}
    assert found.keys() == want.keys() and all(found[k] == pytest.approx(want[k], abs=1e-12) for k in want)


def test_planned_join_spreads_a_hot_key(spark):
    from kontor.operators import monitor, skew

    events = spark.range(4000).selectExpr("id AS event_id", "CASE WHEN id % 10 < 9 THEN 'hot' WHEN id % 50 = 49 THEN NULL ELSE concat('k', id % 7) END AS event", "map('a', id) AS extra")
    subs = spark.range(60).selectExpr("id AS webhook_id", "concat('u', id) AS url", "id % 4 <> 0 AS active", "CASE WHEN id < 50 THEN array('hot', 'hot') ELSE array('k1', 'k2') END AS events")
    got = monitor.fan_out(events, subs).select("event_id", "webhook_id")
    wanted = subs.filter("active").select("webhook_id", F.explode(F.array_distinct("events")).alias("event"))
    want = events.join(wanted, "event").select("event_id", "webhook_id")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert skew._cuts(events, "event", parts)["hot"] >= parts * 0.9 and len(skew._cuts(events, "event", parts)) <= parts
    assert skew.planned_join(events.limit(0), wanted, "event").count() == 0


def test_planned_join_of_one_file_is_not_one_task(spark):
    from kontor.operators import monitor

    events = spark.range(4000).selectExpr("id AS event_id", "CASE WHEN id % 10 < 9 THEN 'hot' ELSE concat('k', id % 7) END AS event").coalesce(1)
    subs = spark.range(60).selectExpr("id AS webhook_id", "concat('u', id) AS url", "true AS active", "array('hot', 'k1') AS events").coalesce(1)
    rows = [r["count"] for r in monitor.fan_out(events, subs).groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert len(rows) > int(spark.conf.get("spark.sql.shuffle.partitions")) // 2 and max(rows) < sum(rows) * 0.75


def _dealt_rows(plan) -> int:
    """Rows that the exchanges of an executed plan wrote."""
    if plan.nodeName() == "AdaptiveSparkPlan":
        return _dealt_rows(plan.executedPlan())
    if "QueryStage" in plan.getClass().getSimpleName():
        return _dealt_rows(plan.plan())
    own = plan.metrics().apply("shuffleRecordsWritten").value() if plan.nodeName() == "Exchange" else 0
    return own + sum(_dealt_rows(plan.children().apply(i)) for i in range(plan.children().size()))


def test_planned_join_copies_no_side_for_a_few_rows(spark):
    from kontor.operators import monitor

    events = spark.range(3000).selectExpr("id AS event_id", "concat('k', id % 2) AS event")
    subs = spark.range(400).selectExpr("id AS webhook_id", "concat('u', id) AS url", "true AS active", "array('k0', 'k1') AS events")
    got = monitor.fan_out(events, subs)
    assert len(got.collect()) == 3000 * 400
    assert _dealt_rows(got._jdf.queryExecution().executedPlan()) == 3000 + 2 * 400


@pytest.mark.parametrize("least", [1, 7, 2048])
def test_planned_join_equals_a_plain_join(spark, monkeypatch, least):
    from kontor.operators import skew

    monkeypatch.setattr(skew, "LEAST", least)
    left = spark.range(300).selectExpr("id % 150 AS a", "CASE WHEN id % 3 > 0 THEN 'hot' WHEN id % 9 = 0 THEN NULL ELSE concat('k', id % 11) END AS k", "map('m', id % 150) AS extra")
    # equal rows, null values and null keys on both sides
    right = spark.range(200).selectExpr("CASE WHEN id % 4 = 0 THEN NULL ELSE id % 60 END AS b", "CASE WHEN id % 2 = 0 THEN 'hot' WHEN id % 5 = 0 THEN NULL ELSE concat('k', id % 13) END AS k", "if(id % 7 = 0, NULL, 'u') AS u", "map('n', id % 60) AS more")
    for other in (right, right.filter("b < 0"), right.filter("k = 'hot'").withColumn("b", F.lit(1)).withColumn("u", F.lit("u")), right.select("k")):
        got, want = skew.planned_join(left, other, "k"), left.join(other, "k")
        assert got.schema == want.schema
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_retention_boundaries(spark):
    import datetime as dt
    import random

    rng = random.Random(2)
    rows = [(f"s{i:03d}", rng.choice(["daily", "weekly", "monthly", "other"]), rng.choice([None, dt.datetime(2024, 1, rng.randint(1, 9))])) for i in range(120)]
    manifest = spark.createDataFrame(rows, "snapshot string, kind string, created_at timestamp").repartition(5)
    keep = {"daily": 7, "weekly": 0, "monthly": 500}
    want = set()
    for kind, n in keep.items():
        own = sorted((r for r in rows if r[1] == kind), key=lambda r: (r[2] is None, -(r[2].timestamp() if r[2] else 0), r[0]))
        want |= {r[0] for r in own[n:]}
    found = sinks.expired_snapshots(manifest, keep)
    assert found.columns == manifest.columns and {r.snapshot for r in found.collect()} == want
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window") == plan.count("GlobalLimit")  # windows over the few newest only


def test_postings_read_the_asked_buckets_only(spark, tmp_path):
    names = [(i, f"Rote Widget {i % 5} GmbH" if i % 3 else f"Blau & Rote-Anlage {i}") for i in range(200)] + [(900, None), (901, "")]
    df = spark.createDataFrame(names, "id long, company_name string")
    path = str(tmp_path / "postings")
    select.write_postings(df, path)
    for terms in (["rote"], ["ROTE", "widget"], ["rote", "rote", "anlage", "blau"], ["nichts"], ["rote", "nichts"]):
        got = sorted(r.id for r in select.lookup_postings(spark, path, terms).collect())
        assert got == sorted(r.id for r in select.name_match(df, terms).collect()), terms
    plan = select.lookup_postings(spark, path, ["rote", "widget"])._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan
    assert "PushedFilters" in plan and "token" in plan


def test_company_updates_field_by_field(spark):
    df = spark.createDataFrame([(1, "A", "a@x.de", 5.0, "new"), (2, "B", None, None, None)], "id long, company_name string, email string, lead_score double, lead_status string")
    changes = spark.createDataFrame(
        [
            (1, 1, ["email", "lead_score"], None, "b@x.de", 50.0, None, None), (1, 2, ["email"], None, None, 7.0, None, None), (1, 3, ["company_name"], "", None, None, None, None),
            (2, 4, ["lead_status", "company_name"], "Neu", None, None, "contacted", None), (2, 5, ["lead_status"], None, None, None, "gone", None), (2, 6, ["lead_score"], None, None, 100.5, None, None),
            (2, 7, ["email"], None, "kein", None, None, None), (9, 8, ["email"], None, "c@x.de", None, None, None), (1, 9, ["notes"], None, None, None, None, "n"), (2, 10, [], None, None, None, None, None),
        ],
        "id long, seq long, given array<string>, company_name string, email string, lead_score double, lead_status string, notes string",
    )
    rows, refused = U.update_companies(df, changes)
    assert sorted(map(tuple, rows.collect())) == [(1, "A", None, 50.0, "new"), (2, "Neu", None, None, "contacted")]
    assert {r.seq: r.reason for r in refused.collect()} == {
        3: "invalid company_name", 5: "invalid lead_status", 6: "invalid lead_score", 7: "invalid email", 8: "company not found", 9: "field cannot be set",
    }
