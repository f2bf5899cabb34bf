"""Exports: routing, roll-ups, nights, units, and what an import does to state."""

import datetime as dt
import itertools
import random

import pytest
from pyspark.sql import functions as F

from dayroll import vocab as V
from dayroll.functions.scalars import appended_note, cadence_note, folded_unit, instant, local_time, night, number, overdue, subject
from dayroll.operators import diagnostics, intervals, rollup, state
from dayroll.operators.classify import bounded, converted, refusal
from dayroll.plans import importer, report
from dayroll.plans.nights import extend_nights, night_hours
from dayroll.sources.store import Store
from dayroll.sources.xml_export import is_closed, malformed_records

Q, S, ST = V.EXPORT_PREFIX, V.SLEEP_EXPORT, V.STAGE_PREFIX
DAY = dt.date


def rec(kind, value, start="2026-07-28 08:00:00 -0700", unit="count", end=None, source="Watch"):
    e = f' endDate="{end}"' if end else ""
    u = f' unit="{unit}"' if unit else ""
    s = f' sourceName="{source}"' if source is not None else ""
    return f'<Record type="{kind}"{u}{s} startDate="{start}"{e} value="{value}"/>'


def export(tmp_path, *records, end="</HealthData>\n", name="export.xml"):
    p = tmp_path / name
    p.write_text('<?xml version="1.0"?>\n<!DOCTYPE HealthData [<!ELEMENT HealthData ANY>]>\n<HealthData locale="en">\n<Me/>\n' + "\n".join(records) + "\n" + end)
    return str(p)


def rows(spark, path):
    return {(r.kind, r.day): r for r in importer.parse_export(spark, path).rows.collect()}


def test_pounds_spread_and_impossible_readings(spark, tmp_path):
    p = export(
        tmp_path, rec(Q + "BodyMass", 100, unit="kg", source="Scale &amp; Co"), *[rec(Q + "HeartRate", v, unit="count/min", start=f"2026-07-28 08:0{i}:00 -0700") for i, v in enumerate((50, 60, 100))],
        *[rec(Q + "OxygenSaturation", v, unit="%", start=f"2026-07-28 09:0{i}:00 -0700") for i, v in enumerate((0, 0.95, 0.99))], rec(Q + "StepCount", 1200), f'<Correlation type="x">{rec(Q + "BloodPressureSystolic", 120, unit="mmHg")}</Correlation>',
        f'<Record type="{Q}StepCount" unit="count" sourceName="Watch" startDate="2026-07-28 09:00:00 -0700" value="800"><MetadataEntry key="k" value="v"/></Record>',
    )
    got, day = rows(spark, p), DAY(2026, 7, 28)
    assert got["weight", day].value == pytest.approx(220.4622621848776, rel=1e-12) and got["weight", day].source == "Scale & Co"
    assert tuple(got["heart-rate", day])[2:5] == (70, 50, 100)
    assert [got["spo2", day][c] for c in ("value", "min", "max")] == pytest.approx([97, 95, 99])
    assert got["steps", day].value == 2000 and got["blood-pressure-systolic", day].value == 120
    f = importer.parse_export(spark, p).frames
    assert [(r.kind, r.records, r.rows) for r in f["implausible"].collect()] == [("spo2", 1, 0)]


def test_names_units_and_what_is_skipped(spark, tmp_path):
    p = export(
        tmp_path, rec(Q + "DietaryWater", 1), rec(Q + "DietaryWater", 2), rec(Q + "BodyMass", 1, unit="furlong"), rec(Q + "StepCount", 1, unit=None), rec(Q + "StepCount", "NaN"), rec(Q + "StepCount", "abc"),
        rec(Q + "StepCount", 5, start="2026-02-30 08:00:00 -0700"), rec(Q + "PhysicalEffort", 5), rec(S, ST + "Weird", unit=None), rec(S, ST + "AsleepCore", unit=None, end="2026-07-28 08:00:00 -0700"),
    )
    f = importer.parse_export(spark, p).frames
    assert {r.outcome: r.n for r in f["outcomes"].collect()} == {V.UNKNOWN_TYPE: 2, V.UNCONVERTIBLE: 1, V.MISSING_UNIT: 1, "skipped": 4, "excluded": 1, V.UNKNOWN_STAGE: 1}
    q = {r.name: r for r in f["quarantine"].collect()}
    assert q[Q + "DietaryWater"].n == 2 and '"value":"1"' in q[Q + "DietaryWater"].point and ST + "Weird" in q
    assert [tuple(r) for r in f["unconvertible"].collect()] == [(Q + "BodyMass", "furlong", 1)]


def test_a_night(spark, tmp_path):
    z = lambda stage, a, b: rec(S, ST + stage, a + " -0700", unit=None, end=b + " -0700")
    d, e = "2026-07-27 ", "2026-07-28 "
    p = export(
        tmp_path, z("InBed", d + "22:30:00", e + "06:30:00"), z("AsleepCore", d + "23:00:00", e + "01:00:00"), z("AsleepDeep", e + "01:00:00", e + "02:30:00"), z("AsleepREM", e + "02:30:00", e + "04:00:00"), z("Awake", e + "04:00:00", e + "04:15:00"),
        rec(Q + "StepCount", 7, start="2026-07-28 23:40:00 -0700"), z("AsleepCore", "2026-01-01 00:00:00", "2026-01-02 12:00:00"), z("Asleep", "2026-02-01 23:00:00", "2026-02-02 05:30:00"),
    )
    got, day = rows(spark, p), DAY(2026, 7, 28)
    assert {k: got[k, day].value for k in ("time-in-bed", "sleep-core", "sleep-deep", "sleep-rem", "sleep-awake", "sleep-total")} == {"time-in-bed": 8, "sleep-core": 2, "sleep-deep": 1.5, "sleep-rem": 1.5, "sleep-awake": 0.25, "sleep-total": 5}
    assert got["steps", day].value == 7 and ("sleep-core", DAY(2026, 1, 1)) not in got
    assert [k for k, d_ in got if d_ == DAY(2026, 2, 2)] == ["sleep-total"] and got["sleep-total", DAY(2026, 2, 2)].value == 6.5


@pytest.mark.parametrize("reading, want", [([("Phone", 4000), ("Watch", 6000), ("Watch", 3500)], (9500, "Watch")), ([("Phone", 5), ("Watch", 5)], (5, "Phone")), ([(None, 9), ("Watch", 5)], (9, None)), ([(None, 5), ("Watch", 5)], (5, None))])
def test_the_winning_source_in_any_order(spark, reading, want):
    for order in itertools.permutations(reading):
        df = spark.createDataFrame([("steps", DAY(2026, 1, 1), dt.datetime(2026, 1, 1, i), float(v), s) for i, (s, v) in enumerate(order)], "kind string, day date, instant timestamp, value double, source string")
        r = rollup.winning_source(df).first()
        assert (r.value, r.source) == want
    r = rollup.by_policy(df, V.metrics(spark)).first()
    assert (r.value, r.source) == want


def test_ratio_of_several_sources(spark):
    df = spark.createDataFrame([("steps", DAY(2026, 1, 1), "a", 4000.0), ("steps", DAY(2026, 1, 1), "b", 9500.0), ("steps", DAY(2026, 1, 2), "a", 1.0)], "kind string, day date, source string, value double")
    r = rollup.multi_source_ratio(df).first()
    assert r.days == 1 and r.max_ratio == pytest.approx(13500 / 9500)


def test_the_latest_source(spark):
    at = dt.datetime(2026, 1, 1, 8)
    for got, want in [([(at, "b"), (at, "a"), (at, None)], "a"), ([(at, "b"), (at + dt.timedelta(seconds=1), None)], None), ([(at, None), (at, "z")], "z")]:
        for order in itertools.permutations(got):
            df = spark.createDataFrame([("hrv", DAY(2026, 1, 1), t, s, 1.0) for t, s in order], "kind string, day date, instant timestamp, source string, value double")
            assert rollup.latest_source(df).first().source == want == rollup.by_policy(df, V.metrics(spark)).first().source


def test_interval_unions_against_a_set_of_seconds(spark):
    r = random.Random(1)
    data = [(k, a, a + r.choice([-3, 0, 1, 5, 20, 60])) for k in range(8) for a in (r.randrange(400) for _ in range(30))]
    got = {x.k: (x.hours, x.pieces) for x in intervals.union_hours(spark.createDataFrame(data, "k int, from_s long, to_s long"), ("k",)).collect()}
    for k in range(8):
        s = {x for q, a, b in data if q == k for x in range(a, b)}
        assert float(got[k][0]) * 3600 == pytest.approx(len(s)) and got[k][1] == sum(1 for x in s if x - 1 not in s)


def test_pieces_are_the_same_however_segments_come(spark):
    r = random.Random(5)
    for _ in range(3):
        data = [(r.choice("ab"), DAY(2026, r.randrange(1, 3), 1), a, a + r.choice([-3, 0, 1, 5, 20, 60])) for a in (r.randrange(600) for _ in range(120))]
        df = lambda rows: spark.createDataFrame(rows, "kind string, day date, from_s long, to_s long")
        kept, rest = intervals.pieces(df([]), ("kind", "day")), list(data)
        r.shuffle(rest)
        while rest:
            n = r.randrange(1, 60)
            kept = spark.createDataFrame(intervals.extended(kept, df(rest[:n]), ("kind", "day")).collect(), "kind string, day date, begins array<bigint>, ends array<bigint>")
            rest = rest[n:]
        want = intervals.union_hours(df(data), ("kind", "day")).select("kind", "day", F.col("hours").cast("double"), "pieces")
        got = intervals.hours_of(kept, ("kind", "day")).select("kind", "day", F.col("hours").cast("double"), "pieces")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
        assert sorted(map(str, kept.collect())) == sorted(map(str, intervals.pieces(df(data), ("kind", "day")).collect()))


def test_later_segments_extend_a_stored_night(spark, tmp_path):
    store = Store(spark, f"{tmp_path}/store")
    seg = lambda *rows: spark.createDataFrame([("sleep-core", True, DAY(2026, m, 1), a, b) for m, a, b in rows], "stage_kind string, asleep boolean, day date, from_s long, to_s long")
    extend_nights(store, seg((1, 0, 3600), (2, 0, 1800)))
    before = store.manifest()["night_pieces"]
    assert extend_nights(store, seg((1, 7200, 9000), (1, 3600, 5400), (1, 5, 5))) == 2
    got = {(x.kind, x.day.month): (float(x.hours), x.pieces) for x in night_hours(store).collect()}
    assert got == {(k, m): v for k in ("sleep-core", "sleep-total") for m, v in ((1, (2.0, 2)), (2, (0.5, 1)))}
    assert store.manifest()["night_pieces"]["2026-02"] == before["2026-02"]


def test_nights_begin_at_six(spark):
    cases = {"2026-01-01 17:59:59": DAY(2026, 1, 1), "2026-01-01 18:00:00": DAY(2026, 1, 2), "2025-12-31 23:00:00": DAY(2026, 1, 1), "2026-01-01 00:00:00": DAY(2026, 1, 1)}
    df = spark.createDataFrame([(f"{k} -0700", v) for k, v in cases.items()], "s string, d date")
    assert df.where(night(local_time("s")) == F.col("d")).count() == len(cases)
    bad = spark.createDataFrame([(x,) for x in ("", "2026-02-30 00:00:00 -0700", "2026-01-01", "x", None)], "s string")
    assert bad.where(instant("s").isNotNull() | local_time("s").isNotNull()).count() == 0


def test_units(spark):
    cases = [("kg", "weight", 1, 2.2046226218), ("Stones", "weight", 1, 14), ("oz", "weight", 16, 1), (" lb ", "weight", 3, 3), ("mL/min·kg", "vo2-max", 40, 40), ("ml/(kg·min)", "vo2-max", 40, 40), ("Cal", "active-energy", 5, 5), ("kJ", "active-energy", 4.184, 1), ("km", "walking-distance", 1.609344, 1)]
    cases += [("m/s", "walking-speed", 0.44704, 1), ("cm", "step-length", 2.54, 1), ("s", "hrv", 0.05, 50), ("min", "sleep-total", 366, 6.1), ("%", "spo2", 0.985, 98.5), ("steps", "steps", 9, 9), ("bpm", "heart-rate", 60, 60)]
    no = [("cal", "active-energy", 5), ("furlong", "walking-distance", 1), ("kg", "steps", 1), ("%", "steps", 1), ("", "weight", 1)]
    df = spark.createDataFrame([(u, k, float(v), float(w)) for u, k, v, w in cases] + [(u, k, float(v), None) for u, k, v in no], "unit string, kind string, value double, want double")
    got = converted(df, "export").collect()
    assert len(got) == len(cases) + len(no)
    for r in got:
        assert r.canonical == (None if r.want is None else pytest.approx(r.want, rel=1e-9)), r
    assert spark.createDataFrame([("CAL",)], "u string").select(folded_unit("u")).first()[0] == "cal"


def test_bounds(spark):
    edge = []
    for kind, _, _, lo, inclusive, hi, *_ in V.METRICS:
        edge += [(kind, hi, None), (kind, hi + 1, V.IMPLAUSIBLE), (kind, lo, None if inclusive else V.IMPLAUSIBLE), (kind, float("nan"), V.NON_FINITE), (kind, float("inf"), V.NON_FINITE), (kind, -1.0, V.IMPLAUSIBLE), (kind, None, None)]
    df = bounded(spark.createDataFrame(edge, "kind string, value double, want string")).withColumn("got", refusal("value"))
    assert df.where(~F.col("got").eqNullSafe(F.col("want"))).count() == 0


def test_numbers_and_texts(spark):
    df = spark.createDataFrame([("1.5", 1.5), ("-.5e1", -5.0), ("1d", None), (" 1", None), ("0x1p3", None), ("", None), (None, None)], "s string, want double")
    assert df.where(~number("s").eqNullSafe(F.col("want"))).count() == 0
    one = spark.range(1).select(appended_note(F.lit("a"), F.lit("2026-01-02").cast("date"), F.lit("n")), appended_note(F.lit(None).cast("string"), F.lit("2026-01-02").cast("date"), F.lit("n")), subject(F.lit(" SELF ")), subject(F.lit(" mum ")), cadence_note(F.lit(10)), overdue(F.lit(None).cast("date"), F.current_date())).first()
    assert tuple(one) == ("a\n[2026-01-02] n", "[2026-01-02] n", None, "mum", None, False)


def test_imports_change_state_once(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    day = lambda n: f"2026-07-{n:02d} 08:00:00 -0700"
    first = export(tmp_path, *[rec(Q + "StepCount", 100 + n, day(n)) for n in range(1, 10)], rec(Q + "NewThing", 1, day(3)), name="a.xml")
    importer.persist(store, importer.parse_export(spark, first), "2026-08-01 00:00:00")
    assert store.version() == 1 and store.read("daily_metric").count() == 9
    second = export(tmp_path, *[rec(Q + "StepCount", 200 + n, day(n)) for n in (1, 2, 3, 9)], rec(Q + "NewThing", 1, day(5)), name="b.xml")
    got = importer.persist(store, importer.parse_export(spark, second), "2026-08-02 00:00:00")
    s = got["stale"].first()
    assert (s.kind, s.rows, s.first_days) == ("steps", 5, [DAY(2026, 7, n) for n in range(4, 9)])
    o = got["overlap"].first()
    assert (o.days, o.mean_diff, o.max_diff, o.max_day) == (4, 100, 100, DAY(2026, 7, 1))
    kept = {r.day.day: r for r in store.read("daily_metric").collect()}
    assert len(kept) == 9 and kept[1].value == 201 and kept[4].value == 104 and kept[1].created_at < kept[1].updated_at
    assert [(r.name, r.day) for r in store.read("quarantine").collect()] == [(Q + "NewThing", DAY(2026, 7, 5))]
    text = report.render(got, second)
    assert "Stale rows" in text and "steps: 5 (2026-07-04" in text and "NewThing: 1" in text and "off by 100" in text
    cut = export(tmp_path, *[rec(Q + "StepCount", 300 + n, day(n)) for n in (1, 9)], end="", name="c.xml")
    assert not is_closed(spark, cut) and is_closed(spark, second)
    got = importer.persist(store, importer.parse_export(spark, cut), "2026-08-03 00:00:00", replace=True)
    assert got["replace_refused"] and store.read("daily_metric").count() == 9 and "REFUSED" in report.render(got, cut)
    got = importer.persist(store, importer.parse_export(spark, second), "2026-08-04 00:00:00", replace=True)
    assert not got["replace_refused"] and store.read("daily_metric").count() == 4
    assert "daily rows (2026-07-01" in report.preflight(diagnostics.survey(store.read("daily_metric")), "store", True)
    with pytest.raises(Exception, match="(?i)malformed"):
        (tmp_path / "d.xml").write_text("<HealthData><Record type='a' unclosed=></Record></HealthData>")
        importer.parse_export(spark, str(tmp_path / "d.xml")).records.count()


def test_kinds_are_stale_in_their_own_days(spark):
    schema = "kind string, day date, value double"
    old = spark.createDataFrame([("a", DAY(2026, 1, d), 1.0) for d in range(1, 9)] + [("b", DAY(2026, 1, d), 1.0) for d in range(1, 9)] + [("c", DAY(2026, 1, 2), 1.0)], schema)
    new = spark.createDataFrame([("a", DAY(2026, 1, d), 1.0) for d in (2, 4)] + [("b", DAY(2026, 1, 8), 1.0)], schema)
    assert [(r.kind, r.day.day) for r in state.stale(old, new).collect()] == [("a", 3)]


@pytest.mark.parametrize("nights, shift, scale, want", [(20, 1, 0, ("mismatch", 1)), (20, -1, 0, ("mismatch", -1)), (13, 1, 0, ("unverified", 1)), (20, 0, 0, ("agrees", 0)), (20, 0, None, ("self-comparison", None)), (0, 0, 0, ("no-comparable-rows", None))])
def test_day_shift(spark, nights, shift, scale, want):
    r = random.Random(7)
    stored = [(DAY(2026, 1, 1) + dt.timedelta(i), 4 + 4 * r.random()) for i in range(nights + 2 if nights else 0)]
    new = [(stored[i][0], stored[i + shift][1] + (0.01 if scale is not None else 0)) for i in range(1, nights + 1)]
    schema = "day date, value double"
    r = diagnostics.day_shift_verdict(diagnostics.day_shift(spark.createDataFrame(new, schema), spark.createDataFrame(stored, schema))).first()
    assert (r.verdict, r.best_offset) == want and r.compared_days == nights


def test_closing_tags_before_many_blanks(spark, tmp_path):
    (tmp_path / "a.xml").write_text("<HealthData></HealthData>" + " \n" * 9000)
    (tmp_path / "b.xml").write_text("<HealthData>" + " \n" * 9000)
    assert is_closed(spark, str(tmp_path / "a.xml")) and not is_closed(spark, str(tmp_path / "b.xml"))
    with pytest.raises(FileNotFoundError):
        is_closed(spark, str(tmp_path / "none.xml"))


def test_exports_as_devices_write_them(spark, tmp_path):
    """A document type, elements around and inside records, single quotes, escapes, and records that close at once or later."""
    (tmp_path / "e.xml").write_text(
        f"""<?xml version="1.0" encoding="UTF-8"?>
<!DOCTYPE HealthData [
<!ELEMENT HealthData (ExportDate,Me,Record*)>
<!ATTLIST Record type CDATA #REQUIRED>
]>
<HealthData locale="en_US">
 <ExportDate value="2026-08-01 00:00:00 -0700"/>
 <Me Sex="x"/>
 <Record type="{Q}StepCount" sourceName="A &amp; B&#39;s &quot;Watch&quot;" unit="count" startDate="2026-07-01 08:00:00 -0700" endDate="2026-07-01 08:10:00 -0700" value="12"/>
 <Record type='{Q}StepCount' sourceName='x > y' unit='count' startDate='2026-07-02 08:00:00 -0700' endDate='2026-07-02 08:10:00 -0700' value='30'>
  <MetadataEntry key="k" value="99"/>
 </Record>
 <Workout workoutActivityType="w"><WorkoutEvent type="Record"/></Workout>
</HealthData>
"""
    )
    got = importer.parse_export(spark, str(tmp_path / "e.xml"))
    rows = {r.day.day: (r.kind, r.value, r.source) for r in got.rows.collect()}
    assert got.closed and rows == {1: ("steps", 12.0, "A & B's \"Watch\""), 2: ("steps", 30.0, "x > y")}


def test_malformed_records_are_told_with_their_place(spark, tmp_path):
    (tmp_path / "m.xml").write_text(f"<HealthData>\n<Record type='{Q}StepCount' value='1'/>\n<Record type='a' unclosed=></Record>\n</HealthData>")
    got = malformed_records(spark, str(tmp_path / "m.xml")).collect()
    assert len(got) == 1 and got[0].file.endswith("m.xml") and got[0].block_start == 0 and "unclosed=" in got[0].record


def test_readings_are_not_dealt_by_kind(spark):
    """Policies are a few rows: a join that sorts readings by kind would have all of a kind in one task."""
    df = spark.createDataFrame([("steps", "2026-05-01", "2026-05-01 08:00:00", 1.0, "a")], "kind string, day string, instant string, value double, source string").withColumns({"day": F.to_date("day"), "instant": F.to_timestamp("instant")})
    policies = spark.createDataFrame([("steps", "sum")], "kind string, policy string")
    plan = rollup.by_policy(df, policies)._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
