"""Streams give what the batch operators give."""

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from kontor.operators import monitor as M
from kontor.plans.demo_view import companies, table
from kontor.streaming import alerts as A
from kontor.streaming import buckets
from kontor.streaming import guards as G
from kontor.streaming import ingest as I

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def events(spark):
    rows = table(spark, SF, "events")
    # squeeze the month into two days so that windows overlap
    start = F.unix_micros(F.lit("2024-01-01").cast("timestamp"))
    return rows.withColumn("ts", F.timestamp_micros(start + ((F.unix_micros("ts") - start) / 15).cast("bigint"))).cache()


@pytest.fixture(scope="module")
def stream(spark, events, tmp_path_factory):
    """The events in six files by time, read one file per micro-batch."""
    path = str(tmp_path_factory.mktemp("events") / "in")
    for i in range(6):
        part = events.filter(F.floor(F.hour("ts") / 12 + (F.dayofmonth("ts") - 1) * 2) == i)
        if i == 5:
            part = events.filter(F.floor(F.hour("ts") / 12 + (F.dayofmonth("ts") - 1) * 2) >= 5)
        part.coalesce(1).write.mode("append").parquet(path)

    def read():
        return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(path)

    return read


def drain(spark, df, name, tmp_path, mode="append"):
    query = (
        df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    )
    query.awaitTermination(120)
    assert query.exception() is None
    return spark.table(name)


def test_ratio_alert(spark, events, stream, tmp_path):
    bad = F.col("event_type").isin("error", "view")
    batch = M.ratio_alert(events, "ts", bad, 0.2, "30 minutes", "10 minutes", "30 minutes")
    last = events.agg(F.max("ts")).first()[0]
    want = {r.window_start for r in batch.filter("firing").collect()}
    got = {r.window_start for r in drain(spark, A.ratio_alert_stream(stream(), "ts", bad, 0.2, "30 minutes", "10 minutes", "30 minutes"), "ratio", tmp_path).collect()}
    assert len(want) > 10
    assert got <= want
    # windows the watermark has not closed yet are still open at the end
    assert all((last - w).total_seconds() < 6000 for w in want - got)


def test_windows_and_sessions(spark, events, stream, tmp_path):
    w = A.windowed_stream(stream(), "ts", "1 hour", "1 hour", ["event_type"], n=F.count(F.lit(1)))
    got = {(r.w.start, r.event_type, r.n) for r in drain(spark, w, "tumbling", tmp_path).collect()}
    batch = M.windowed(events, "ts", "1 hour", "1 hour", ["event_type"], n=F.count(F.lit(1)))
    want = {(r.window_start, r.event_type, r.n) for r in batch.collect()}
    assert got <= want and len(got) > 0.8 * len(want)
    s = drain(spark, A.sessions_stream(stream(), "user_id", "ts", "2 hours"), "sessions", tmp_path)
    whole = {(r.user_id, r.session_start, r.events) for r in M.sessionize(events, "user_id", "ts", "2 hours", order="event_id").collect()}
    closed = {(r.user_id, r.session_start, r.events) for r in s.collect()}
    assert closed <= whole and len(closed) > 0.5 * len(whole)


GUARDS = {
    "locks": (lambda df, ok: G.lockouts_stream(df, "k", "ts", "event_id", ok, delay="1 minute"), lambda df, ok: M.lockouts(df, "k", "ts", "event_id", ok).select("k", "event_id", "failed_attempts", "refused")),
    "sent": (lambda df, ok: G.suppress_stream(df, "k", "ts", "event_id", 3600, delay="1 minute"), lambda df, ok: M.suppress(df, "k", "ts", "event_id", 3600).select("k", "event_id", "sent")),
    "admitted": (lambda df, ok: G.admission_stream(df, "k", "ts", "event_id", 3, 3600, delay="1 minute"), lambda df, ok: M.admission(df, "k", "ts", "event_id", 3, 3600).select("k", "event_id", "admitted", "remaining")),
}


@pytest.mark.parametrize("name", GUARDS)
def test_guards(spark, events, stream, tmp_path, name):
    """Rows come out of order within the files; what the watermark has passed equals the batch."""
    ok = ~F.col("event_type").isin("error", "view", "signup")
    key = F.col("user_id") % 3
    live, batch = GUARDS[name]
    got = sorted(map(tuple, drain(spark, live(stream().withColumn("k", key), ok), name, tmp_path).collect()))
    last = events.agg(F.max("ts")).first()[0]
    want = batch(events.withColumn("k", key), ok).join(events.select("event_id", "ts"), "event_id").select("k", *batch(events.withColumn("k", key), ok).columns[1:], "ts").collect()
    passed = sorted(tuple(r)[:-1] for r in want if (last - r.ts).total_seconds() >= 60)
    assert len(passed) > 100 and got == passed
    assert len({r[2:] for r in got}) > 1


def test_late_rows_are_dropped_and_silent_keys_forgotten(spark, tmp_path):
    def at(rows, name):
        df = spark.createDataFrame(rows, "event_id long, k string, s long").withColumn("ts", F.timestamp_seconds("s"))
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        return df.schema

    schema = at([(1, "a", 1000), (2, "a", 1100), (3, "b", 1000)], "0")
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))

    def step():
        query = G.suppress_stream(stream, "k", "ts", "event_id", 300, delay="1 minute").writeStream.format("parquet").option(
            "checkpointLocation", str(tmp_path / "chk")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
        query.awaitTermination(120)
        assert query.exception() is None
        rows = spark.read.parquet(str(tmp_path / "out")).collect()
        state = spark.read.format("statestore").option("stateVarName", "state").load(str(tmp_path / "chk"))
        return sorted((r.event_id, r.sent) for r in rows), state.count()

    assert step() == ([(1, True), (3, True)], 2)  # 2 is not passed yet
    at([(4, "a", 1250), (5, "c", 5000)], "1")
    out, kept = step()
    assert out == [(1, True), (2, False), (3, True), (4, False)] and kept == 0  # a and b end at 1300
    at([(6, "a", 1350), (7, "c", 5010), (8, "c", 9000)], "2")  # 6 is late
    out, kept = step()
    assert out == [(1, True), (2, False), (3, True), (4, False), (5, True), (7, False)] and kept == 0


@pytest.mark.parametrize("width", [60, 3600, 10_800])
def test_observed_load_over_any_window(spark, events, width):
    rows = [(r.event_type, r.us, r.observed) for r in M.observed_load(events.withColumn("us", F.unix_micros("ts")), "event_type", "ts", width).collect()]
    times = {}
    for kind, us, _ in rows:
        times.setdefault(kind, []).append(us)
    assert len(rows) == events.count()
    assert all(n == sum(us - width * 1_000_000 < t <= us for t in times[kind]) for kind, us, n in rows)


def test_a_missing_snapshot_is_empty_at_the_first_batch_only(spark, tmp_path):
    assert I.read_snapshot(spark, str(tmp_path / "none"), before=0) is None
    with pytest.raises(AnalysisException):
        I.read_snapshot(spark, str(tmp_path / "none"), before=3)


def test_absence_and_dedup(spark, stream, tmp_path):
    silent = drain(spark, A.absence_stream(stream(), "user_id", "ts", "1 hour"), "silent", tmp_path)
    assert silent.count() > 0
    few = drain(spark, A.dedup_stream(stream(), ["event_type"], "ts", "1 hour"), "few", tmp_path)
    assert 0 < few.count() < 1000


def test_ingest_stream_is_idempotent(spark, tmp_path):
    raw = companies(spark, SF).withColumn("seq", F.col("id")).drop("g", "directors_text", "technologies_text", "street", "is_active", "id", "lead_score")
    raw = raw.filter("seq < 120")
    for i in range(3):
        raw.filter(F.col("seq") % 3 == i).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    current = raw.drop("seq").withColumns(
        {"id": F.lit(0).cast("bigint"), "is_active": F.lit(True), "is_duplicate": F.lit(False), "duplicate_of_id": F.lit(None).cast("bigint")}
    )
    stream = spark.readStream.schema(raw.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    # a new row has no flag yet: it counts as active
    incoming = stream.withColumn("is_active", F.lit(True))
    query = I.ingest_stream(incoming, str(tmp_path / "out"), str(tmp_path / "chk"), current.schema, once=True)
    query.awaitTermination(240)
    assert query.exception() is None
    snap = I.read_snapshot(spark, str(tmp_path / "out"))
    rows = snap.collect()
    assert len({r.id for r in rows}) == len(rows)
    merged = [r for r in rows if r.is_duplicate]
    assert merged and all(not r.is_active and r.duplicate_of_id is not None for r in merged)
    primaries = {r.id: r for r in rows}
    assert all(primaries[r.duplicate_of_id].duplicate_of_id is None for r in merged)
    # running the last batch again leaves the same snapshot
    write = I.batch_writer(str(tmp_path / "out"), current.schema)
    files = sorted((tmp_path / "in").glob("*.parquet"), key=lambda p: p.stat().st_mtime)
    write(spark.read.parquet(str(files[-1])).withColumn("is_active", F.lit(True)), 2)
    again = I.read_snapshot(spark, str(tmp_path / "out"))
    assert sorted(map(str, again.collect())) == sorted(map(str, rows))


def files(folder):
    import os

    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(folder) for f in names if f.endswith(".parquet")}


def test_a_batch_leaves_untouched_buckets_alone(spark, tmp_path):
    root = str(tmp_path / "table")
    columns = "id long, company_name string, city string, phone string, website string, address string, is_active boolean, is_duplicate boolean, duplicate_of_id long"
    rows = [(i, f"Firma {i} GmbH", f"Ort {i % 40}", f"+49 711 {i:06d}", f"https://www.f{i}.de", f"Weg {i}, 70173 Ort", True, False, None) for i in range(400)]
    before = spark.createDataFrame(rows, columns)
    buckets.seed(before, root, cities=8, names=4)
    held = files(f"{root}/data")
    assert len({(b.cb, b.nb) for b in buckets.manifest(spark, root)}) == len(buckets.manifest(spark, root)) == 32
    batch = spark.createDataFrame(
        [("Firma 3 GmbH", "Ort 3", "+49 711 999999", None, None, 1), ("Ganz neue AG", "Ort 3", "+49 711 5555", "https://www.neu.de", "Platz 1", 2),
         ("Firma 43 GmbH ", "Ort 3", "+49 711 000043", "https://www.f43.de/", "Weg 43, 70173 Ort", 3), ("x", "Ort 3", None, None, None, 4), ("Neu und leer", None, None, None, None, 5)],
        "company_name string, city string, phone string, website string, address string, seq long",
    )
    write = I.batch_writer(root, before.schema)
    for _ in range(2):  # a retry gives the same
        write(batch, 1)
        now = files(f"{root}/data")
        assert {k: now[k] for k in held} == held
        entries = buckets.manifest(spark, root)
        changed = {(b.cb, b.nb) for b in entries if b.version == 1}
        assert 1 <= len(changed) <= 4 and len(entries) in (32, 33)
        assert all(f"/cb={cb}/nb={nb}/" in " ".join(set(now) - set(held)) for cb, nb in changed)
        found = {r.id: r for r in I.read_snapshot(spark, root).collect()}
        assert sorted(found) == list(range(402)) and found[3].phone == "+49 711 999999" and found[3].website == "https://www.f3.de"
        assert found[400].company_name == "Ganz neue AG" and found[400].is_active and not found[400].is_duplicate and found[401].city is None
        assert spark.read.parquet(f"{root}/counts").drop("batch").first().asDict() == {
            "new": 2, "updated": 2, "errors": 1, "auto_merged_duplicates": 0, "duplicate_candidates_created": 0,
        }
    # the table before the batch can still be read, and an empty batch changes nothing
    assert I.read_snapshot(spark, root, before=1).count() == 400
    write(batch.limit(0), 2)
    assert I.read_snapshot(spark, root).count() == 402 and buckets.manifest(spark, root) is not None
    assert {b.version for b in buckets.manifest(spark, root)} == {0, 1}
