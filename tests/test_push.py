"""Pushes, complaints, retirement, streams, the registry and the briefing."""

import datetime as dt
import json
import re

import pytest
from pyspark.sql import functions as F

from dayroll import vocab as V
from dayroll.operators import state
from dayroll.plans import push
from dayroll.plans import registry as G
from dayroll.plans.briefing import as_json, briefing, briefing_rows
from dayroll.sources.store import ConflictError, Store
from dayroll.streaming.ingest import stream_pushes

DAY = dt.date(2026, 7, 28)
AT = "2026-07-28 08:00:00 -0700"


def body(*metrics):
    return json.dumps({"data": {"metrics": [{"name": n, **({"units": u} if u else {}), "data": pts} for n, u, pts in metrics]}})


def payload(spark, *metrics):
    return spark.createDataFrame([(body(*metrics),)], "value string")


def p(**fields):
    return {"date": AT, **fields}


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "store"))


def stored(store):
    return {r.kind: r for r in store.read("daily_metric").collect()}


def test_shapes(spark, store):
    got = push.ingest(store, payload(spark, ("step_count", "count", [p(qty=5, source="Watch")]), ("heart_rate", "bpm", [p(Avg=70, Min=50, Max=100.5, source="")]), ("sleep_analysis", "min", [p(totalSleep=366, deep=60, rem=60, core=246, awake=6)])), "2026-08-01 00:00:00")
    assert got["ingested"] == 7 and got["refused"] == got["skipped"] == 0 and got["first_day"] == got["last_day"] == DAY
    s = stored(store)
    assert s["sleep-total"].value == pytest.approx(6.1) and s["steps"].source == "Watch" and tuple(s["heart-rate"])[2:6] == (70, 50, 100.5, None)


def test_whole_rows_replace_and_the_last_point_wins(spark, store):
    push.ingest(store, payload(spark, ("weight_body_mass", "kg", [p(Avg=100, Min=99, Max=101, source="a")])), "2026-08-01 00:00:00")
    assert stored(store)["weight"].min == pytest.approx(99 / 0.45359237)
    push.ingest(store, payload(spark, ("weight_body_mass", "lb", [p(qty=200, Min=1), p(qty=201)])), "2026-08-02 00:00:00")
    r = stored(store)["weight"]
    assert (r.value, r.min, r.max, r.source) == (201, None, None, None) and r.created_at < r.updated_at


def test_complaints_and_retirement(spark, store):
    bad = payload(spark, ("weight_body_mass", "furlong", [p(qty=1)]), ("step_count", None, [p(qty=1, note="kept")]), ("new_thing", "x", [p(qty=1)]), ("new_empty", "x", []), ("physical_effort", "x", [{"date": "junk"}]))
    got = push.ingest(store, bad, "2026-08-01 00:00:00")
    assert (got["ingested"], got["refused"], got["unknown_entries"], got["skipped"]) == (0, 2, 1, 0)
    q = {r.name: json.loads(r.point) for r in store.read("quarantine").collect()}
    assert set(q) == {"weight_body_mass", "step_count", "new_thing"} and q["step_count"]["note"] == "kept"
    assert q["step_count"]["_import"] == {"reason": V.MISSING_UNIT, "kinds": ["steps"]} and q["weight_body_mass"]["_import"]["units"] == "furlong"
    got = push.ingest(store, payload(spark, ("weight_body_mass", "lb", [p(qty=150)])), "2026-08-02 00:00:00")
    assert got["quarantine_retired"] == 1 and {r.name for r in store.read("quarantine").collect()} == {"step_count", "new_thing"}


def test_bounds_and_skipping(spark, store):
    got = push.ingest(store, payload(spark, ("blood_oxygen_saturation", "%", [p(Avg=97, Min=0, Max=99)]), ("step_count", "count", [p(qty="5"), {"qty": 5}, p(), p(qty=7)])), "2026-08-01 00:00:00")
    assert (got["ingested"], got["bounds_cleared"], got["skipped"], got["refused"]) == (2, 1, 3, 1)
    s = stored(store)
    assert (s["spo2"].value, s["spo2"].min, s["spo2"].max) == (97, None, 99) and s["steps"].value == 7


@pytest.mark.parametrize("flip", [False, True])
def test_a_lost_point_is_kept_whatever_the_order(spark, flip):
    pts = [p(Avg=97, Min=0, Max=99, n="partial"), p(qty=0, n="lost")]
    r = push.route(payload(spark, ("blood_oxygen_saturation", "%", pts[::-1] if flip else pts)))
    c = r.complaints.first()
    assert (json.loads(c.point)["n"], c.stored, c.kinds, c.reason) == ("lost", True, ["spo2"], V.IMPLAUSIBLE)


def test_a_bad_stage_leaves_the_others(spark):
    r = push.route(payload(spark, ("sleep_analysis", "hr", [p(totalSleep=49.877, inBed=52.953, deep=1, rem=1, core=4)])))
    assert {x.kind for x in r.stored.collect()} == {"sleep-deep", "sleep-rem", "sleep-core"} and r.complaints.first().kinds == ["sleep-total", "time-in-bed"]


def test_a_stream_ends_like_its_batches(spark, store, tmp_path):
    (tmp_path / "in").mkdir()
    for i, v in enumerate((5, 6, 7)):
        (tmp_path / "in" / f"{i}.json").write_text(body(("step_count", "count", [p(qty=v)]), ("heart_rate", "bpm", [p(qty=60 + i)])))
    seen = []
    for _ in range(2):  # a second start finds nothing new
        stream_pushes(spark, str(tmp_path / "in"), store, str(tmp_path / "ck"), "2026-08-01 00:00:00", lambda n, r: seen.append(r["ingested"])).awaitTermination()
    assert sum(seen) == 6 and {k: r.value for k, r in stored(store).items()} == {"steps": 7, "heart-rate": 62}


def test_promoted_names(spark):
    q = spark.createDataFrame([(V.EXPORT_PREFIX + "StepCount", DAY, "{}"), (V.EXPORT_PREFIX + "HeartRate", DAY, '{"_import":{"reason":"missing-unit"}}'), (V.STAGE_PREFIX + "Asleep", DAY, '{"_import":{"reason":"unknown-sleep-stage"}}'), ("step_count", DAY, "{}"), (V.EXPORT_PREFIX + "Other", DAY, "{}")], "name string, day date, point string")
    left, gone = state.swept(q)
    assert left.count() == 3 and {r.name for r in gone.collect()} == {V.EXPORT_PREFIX + "StepCount", V.STAGE_PREFIX + "Asleep"}


def test_registry_verbs(spark):
    now, today = "2026-08-01 12:00:00", "2026-08-01"
    t = {n: G.empty(spark, n) for n in G.SCHEMAS}
    ok, bad = G.new_concerns(spark.createDataFrame([("knee", "n", None, ["b", "a", "b"]), (" ", None, None, [])], "name string, narrative string, opened_on date, tags array<string>"), today)
    assert [r.reason for r in bad.collect()] == ["name is blank"]
    t["concerns"] = G.appended(t["concerns"], ok.drop("tags"), now)
    t["concern_tags"] = G.appended(t["concern_tags"], G.tag_rows(ok.withColumn("id", F.lit(1))).drop("pos"), now, "concern_id")
    assert {r.tag for r in t["concern_tags"].collect()} == {"a", "b"} and t["concerns"].first().opened_on == dt.date(2026, 8, 1)
    r = G.update_concern_status(t["concerns"], spark.createDataFrame([(1, "resolved", "done")], "id int, new_status string, note string"), today).first()
    assert (r.status, r.resolved_on, r.narrative) == ("resolved", dt.date(2026, 8, 1), "n\n[2026-08-01] done")
    goals = spark.createDataFrame([(1, "a", None, None, None), (1, "b", "range", 5.0, 4.0), (1, "c", "at-most", None, None), (9, "d", None, None, None), (None, "e", "range", 1.0, 2.0)], "concern_id int, title string, comparison string, target_value double, target_high double")
    ok, bad = G.check_goals(goals, t["concerns"])
    assert {x.title for x in ok.collect()} == {"a", "e"} and {x.title: x.reason for x in bad.collect()} == {"b": "range is inverted", "c": "target is missing", "d": "no such concern"}
    obs = spark.createDataFrame([("self_reported", "x", 11, None, None, None), ("ai", "y", 10, 1, None, None), ("self_reported", "z", None, None, None, None)], "origin string, body string, severity int, concern_id int, kind string, occurred_at timestamp")
    ok, bad = G.check_observations(obs, t["concerns"], now)
    assert {x.body: x.reviewed for x in ok.collect()} == {"y": 0, "z": 1} and bad.first().reason == "severity out of range"
    t["checkins"], new = G.start_checkin(t["checkins"], now)
    again, fresh = G.start_checkin(t["checkins"], now)
    assert new and not fresh and again.count() == 1
    t["checkins"], bad = G.complete_checkins(t["checkins"], spark.createDataFrame([(1, "fine"), (7, "?")], "id int, new_summary string"), now)
    assert t["checkins"].first().summary == "fine" and bad.first().reason == "no such checkin"
    ok, bad = G.check_responses(spark.createDataFrame([(1, "q", "a", None)], "checkin_id int, question string, answer string, concern_id int"), t["checkins"], t["concerns"])
    assert ok.count() == 0 and bad.first().reason == "checkin is closed"
    pr, _ = G.start_protocols(spark.createDataFrame([("walk", "habit", 1, None, None)], "name string, kind string, concern_id int, goal_id int, started_on date"), t["concerns"], t["goals"], today)
    t["protocols"] = G.appended(t["protocols"], pr, now)
    v = spark.createDataFrame([(1, "worked", "why", None)], "id int, new_verdict string, rationale string, new_ended_on date")
    t["protocols"], bad = G.record_verdicts(t["protocols"], v, today)
    assert bad.count() == 0 and t["protocols"].first().ended_on == dt.date(2026, 8, 1) and G.record_verdicts(t["protocols"], v, today)[1].first().reason == "verdict was given"
    plans = spark.createDataFrame([("p", None, None, None), ("q", None, None, None)], "key string, checkin_id int, starts_on date, horizon_days int")
    items = spark.createDataFrame([("p", "workout", "run")], "plan_key string, kind string, title string")
    ok, kept, bad = G.commit_plan(plans, items, t["checkins"], today)
    assert ok.first().horizon_days == 7 and kept.count() == 1 and bad.first().reason == "no items"
    t["plans"] = G.appended(t["plans"], ok.drop("key"), now, "starts_on")
    t["plan_items"] = G.appended(t["plan_items"], kept.select(F.lit(1).alias("plan_id"), "kind", "title"), now)
    for s in ("skipped", "done"):
        t["plan_item_outcomes"], _ = G.record_outcomes(t["plan_item_outcomes"], spark.createDataFrame([(1, s)], "plan_item_id int, status string"), t["plan_items"], now)
    assert [r.status for r in t["plan_item_outcomes"].collect()] == ["done"]
    claims = spark.createDataFrame([("allergy", "nuts", "unknown", " Self ", None), ("surgery", "none", "verified", "mum", 1)], "category string, statement string, confidence string, subject string, concern_id int")
    ok, bad = G.record_claims(claims, t["concerns"])
    assert bad.count() == 0 and G.record_claims(claims.withColumn("statement", F.when(F.col("category") == "surgery", "").otherwise("x")), t["concerns"])[0].count() == 0
    t["claims"] = G.appended(t["claims"], ok, now)
    assert G.get_claims(t["claims"], subject=None).count() == 1 and G.get_claims(t["claims"], subject=...).count() == 2
    cover = G.coverage(t["claims"]).collect()
    assert [r.category for r in cover] == list(V.CLAIM_CATEGORIES) and {r.category: (r.claims, r.unknowns) for r in cover if r.claims} == {"allergy": (1, 1), "surgery": (1, 0)}
    assert tuple(G.coverage_totals(G.coverage(t["claims"])).first()) == (2, 1)
    n = lambda c: F.lit(None).cast(c)
    change = spark.range(1).select(F.lit(2).alias("id"), F.lit("self").alias("subject"), F.lit(True).alias("subject_set"), n("string").alias("statement"), F.lit(False).alias("statement_set"), F.lit("recalled").alias("confidence"), F.lit(True).alias("confidence_set"), n("string").alias("topic"), F.lit(False).alias("topic_set"), n("date").alias("occurred_on"), F.lit(False).alias("occurred_on_set"))
    t["claims"], bad = G.update_claims(t["claims"], change)
    assert {(r.id, r.subject, r.confidence) for r in t["claims"].collect()} == {(1, None, "unknown"), (2, None, "recalled")}
    t["profile"] = G.update_profile(G.update_profile(t["profile"], {"sex": "female"}, now), {"height_cm": 170}, now)
    assert tuple(t["profile"].first())[:4] == (1, None, "female", 170)
    b = briefing(t, "2026-08-20").first()
    assert b.days_since_checkin == 19 and "19 days" in b.cadence_note and b.last_checkin.summary == "fine" and [x.tag for x in b.concerns[0].tags] and b.plan["items"][0].outcome.status == "done"
    assert [c.statement for c in b.unknowns] == ["nuts"] and b.protocols == [] and json.loads(as_json(briefing(t, "2026-08-20")).first().document)["profile"]["sex"] == "female"
    out = G.delete_concerns(t, t["concerns"].select("id"))
    assert out["concerns"].count() == out["concern_tags"].count() == 0 and out["claims"].where("concern_id is not null").count() == 0 and out["claims"].count() == 2
    none = briefing({n: G.empty(spark, n) for n in G.SCHEMAS}, "2026-08-20").first()
    assert none.cadence_note is None and none.concerns == [] and none.profile is None


def test_a_commit_writes_what_it_touches_and_appears_whole(spark, store, monkeypatch):
    on = lambda day, **f: {"date": f"{day} 08:00:00 -0700", **f}
    push.ingest(store, payload(spark, ("step_count", "count", [on("2026-05-01", qty=5), on("2026-06-01", qty=6)]), ("new_thing", "x", [on("2026-05-02", qty=1)])), "2026-08-01 00:00:00")
    first = store.manifest()
    assert set(first["daily_metric"]) == {"2026-05", "2026-06"} and set(first["quarantine"]) == {"2026-05"}
    push.ingest(store, payload(spark, ("step_count", "count", [on("2026-06-02", qty=7)])), "2026-08-02 00:00:00")
    second = store.manifest()
    assert second["daily_metric"]["2026-05"] == first["daily_metric"]["2026-05"] and second["daily_metric"]["2026-06"] != first["daily_metric"]["2026-06"]
    assert second["quarantine"] == first["quarantine"] and store.read("daily_metric").count() == 3 and store.read("daily_metric", 1).count() == 2
    # a writer that dies before the manifest leaves the version as it was
    real = Store._publish

    def dies(self, version, text):
        raise OSError("killed")

    monkeypatch.setattr(Store, "_publish", dies)
    with pytest.raises(OSError):
        push.ingest(store, payload(spark, ("step_count", "count", [on("2026-06-02", qty=9)])), "2026-08-03 00:00:00")
    monkeypatch.setattr(Store, "_publish", real)
    assert store.version() == 2 and {r.value for r in store.read("daily_metric").collect()} == {5, 6, 7}
    # of two writers on one version the later one is told, and a push is merged anew
    with pytest.raises(ConflictError):
        store.commit({"quarantine": store.read("quarantine")}, base=1)
    assert store.version() == 2 and store.manifest() == second
    late = []

    def overtaken(self, version, text):
        if not late:
            late.append(version)
            push.ingest(store, payload(spark, ("step_count", "count", [on("2026-06-03", qty=8)])), "2026-08-03 00:00:00")
        real(self, version, text)

    monkeypatch.setattr(Store, "_publish", overtaken)
    push.ingest(store, payload(spark, ("step_count", "count", [on("2026-06-04", qty=9)])), "2026-08-03 00:00:00")
    assert store.version() == 4 and {r.value for r in store.read("daily_metric").collect()} == {5, 6, 7, 8, 9}


def test_ids_follow_the_order_over_many_partitions(spark):
    rows = spark.range(500).select((F.col("id") * 7919 % 500).alias("k")).repartition(7)
    schema = "id int, k long, created_at timestamp, updated_at timestamp"
    old = spark.createDataFrame([(40, -1, None, None)], schema)
    got = G.appended(old, rows, "2026-08-01 00:00:00", "k").where("k >= 0").collect()
    assert sorted((r.id, r.k) for r in got) == [(41 + k, k) for k in range(500)]
    assert G.appended(old, rows.limit(0), "2026-08-01 00:00:00", "k").count() == 1


def test_ids_follow_texts_and_days_too(spark):
    r = spark.range(300).select((F.col("id") * 7919 % 300).alias("k"))
    rows = r.select("k", F.format_string("Customer#%09d", "k").alias("name"), F.expr("date_add(DATE '2026-01-01', CAST(k AS INT))").alias("d"), F.expr("timestamp_seconds(k)").alias("t")).unionByName(spark.createDataFrame([(-1, None, None, None)], "k long, name string, d date, t timestamp"))
    schema = "id int, k long, name string, d date, t timestamp, created_at timestamp, updated_at timestamp"
    for by in ("name", "d", "t"):
        got = G.appended(spark.createDataFrame([], schema), rows.repartition(5), "2026-08-01 00:00:00", by).collect()
        assert sorted((x.id, x.k) for x in got) == [(k + 2, k) for k in range(-1, 300)]


def test_briefing_rows_are_the_document_s_sections(spark):
    t = {n: G.empty(spark, n) for n in G.SCHEMAS}
    assert briefing_rows(t, "2026-08-20").count() == 0
    none = F.lit(None)
    t["claims"] = G.empty(spark, "claims").unionByName(spark.createDataFrame([(i, "x", "unknown") for i in (3, 1, 2)], "id int, statement string, confidence string"), allowMissingColumns=True)
    t["goals"] = G.empty(spark, "goals").unionByName(spark.range(1).select(F.lit(9).alias("id"), F.lit("g").alias("title"), F.lit("active").alias("status"), none.cast("double").alias("target_value")), allowMissingColumns=True)
    rows = briefing_rows(t, "2026-08-20").collect()
    doc = briefing(t, "2026-08-20").first()
    order = lambda name: [r.id for r in sorted((r for r in rows if r.section == name), key=lambda r: r.place)]
    assert order("unknowns") == [c.id for c in doc.unknowns] == [3, 2, 1] and order("goals") == [g.id for g in doc.goals] == [9]
    assert json.loads(next(r.record for r in rows if r.section == "goals"))["title"] == "g"


def test_outcomes_are_dealt_by_rows_and_once(spark, monkeypatch):
    """Partitions follow the rows, not the bytes that a shuffle packs them into; joins by item do not deal them again."""
    monkeypatch.setattr(G, "ROWS", 100)
    rows = spark.range(1000).select(F.col("id").cast("int").alias("plan_item_id"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("f"))
    i = G.dealt(rows, "plan_item_id").groupBy("plan_item_id").agg(F.min("f").alias("f"))
    none = lambda k, c: F.lit(None).cast(k).alias(c)
    old = i.where("plan_item_id < 500").select(F.col("plan_item_id").alias("id"), "plan_item_id", F.lit("done").alias("status"), none("string", "note"), *[none("timestamp", c) for c in ("recorded_at", "created_at", "updated_at")])
    new = i.where("f = 'a'").select("plan_item_id", F.lit("skipped").alias("status"))
    got, lost = G.record_outcomes(old, new, i.select(F.col("plan_item_id").alias("id")), "2026-08-01 00:00:00")
    assert i.rdd.getNumPartitions() == 11 and lost.isEmpty()
    assert {r.plan_item_id: r.status for r in got.collect()} == {k: "skipped" if k % 3 == 0 else "done" for k in range(1000) if k % 3 == 0 or k < 500}
    dealt = re.findall(r"Exchange hashpartitioning\(plan_item_id#\d+, (\d+)\)", got._jdf.queryExecution().executedPlan().toString())
    assert set(dealt) <= {"11"}
