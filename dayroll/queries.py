"""The catalogue: each operator on a stand-in from the driver's tables, with its SQL.

Readings are events: the type is the kind, the user the source (none for every tenth), the local clock seven hours behind.
Raw export records are events too, spelled as an export spells them, so that the real routing and units run over them.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import vocab as V
from .functions.scalars import days_since, json_number, looks_like_fraction, night, overdue
from .operators import diagnostics as D
from .operators import rollup as R
from .operators import state as S
from .operators.classify import converted, routed_records
from .operators.intervals import stage_rows, union_hours
from .plans import importer, push
from .plans import registry as G
from .plans.briefing import briefing_rows, latest
from .sources.push import night_rows, points, shaped

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# --- stand-ins ---------------------------------------------------------------------------------------------------------

POLICIES = {"view": V.SUM, "click": V.SPREAD, "purchase": V.MEAN, "signup": V.MAX}
#: Bounds of the stand-in kinds: low, is low itself refused, high.
BOUNDS = {"view": (0.0, False, 2000.0), "click": (0.5, True, 250.0), "purchase": (20.0, True, 60.0), "signup": (0.0, True, 200.0)}


def policies(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(POLICIES.items()), "kind string, policy string")


def dims(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, *b) for k, b in BOUNDS.items()], "kind string, low double, low_open boolean, high double")


def readings(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    local = F.col("ts") - F.expr("INTERVAL 7 HOURS")
    return e.select(
        "event_id", F.col("ts").cast("timestamp").alias("instant"), local.alias("local"), F.to_date(local).alias("day"), F.col("event_type").alias("kind"),
        F.col("value").cast("decimal(12,2)").alias("value"), F.when(F.col("user_id") % 10 != 0, F.concat(F.lit("u"), "user_id")).alias("source"), F.get_json_object("props", "$.k").cast("int").alias("k"), "user_id",
    )


READ = """r AS (SELECT event_id, ts AS instant, ts - INTERVAL 7 HOUR AS local, (ts - INTERVAL 7 HOUR)::DATE AS day, event_type AS kind, value::DECIMAL(12,2) AS value,
  CASE WHEN user_id % 10 <> 0 THEN 'u' || user_id END AS source, (props->>'$.k')::INT AS k, user_id FROM events)"""


def segments(spark: SparkSession, sf: str) -> DataFrame:
    """Segments from each event on, a minute for each unit of its value."""
    r = readings(spark, sf)
    from_s = F.unix_seconds("instant")
    return r.withColumns({"day": night("local"), "from_s": from_s, "to_s": from_s + F.floor(F.col("value") * 60)})


SEG = f"""{READ}, g AS (SELECT * REPLACE ((local + INTERVAL 6 HOUR)::DATE AS day), epoch(date_trunc('second', instant))::BIGINT AS from_s,
  epoch(date_trunc('second', instant))::BIGINT + floor(value * 60)::BIGINT AS to_s FROM r)"""


def _islands(src: str, keys: str) -> str:
    return f"""a AS (SELECT {keys}, from_s, max(to_s) AS to_s FROM {src} WHERE to_s > from_s GROUP BY {keys}, from_s),
b AS (SELECT *, max(to_s) OVER (PARTITION BY {keys} ORDER BY from_s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM a),
c AS (SELECT *, count(CASE WHEN reach IS NULL OR from_s > reach THEN 1 END) OVER (PARTITION BY {keys} ORDER BY from_s) AS island FROM b),
i AS (SELECT {keys}, island, min(from_s) AS f, max(to_s) AS t FROM c GROUP BY {keys}, island),
u AS (SELECT {keys}, sum(t - f) / 3600.0 AS hours, count(*) AS pieces FROM i GROUP BY {keys})"""


def raw(spark: SparkSession, sf: str) -> DataFrame:
    """Events as export records."""
    r = readings(spark, sf)
    pick = lambda *xs: F.element_at(F.array(*[F.lit(x) for x in xs]), F.col("k") % len(xs) + 1)
    kind = F.col("kind")
    q = V.EXPORT_PREFIX
    kind_name = F.when(kind == "view", q + "StepCount").when(kind == "click", q + "HeartRate").when(kind == "purchase", q + "BodyMass").when(kind == "signup", V.SLEEP_EXPORT).when(F.col("k") % 2 == 0, q + "BasalEnergyBurned").otherwise(q + "DietaryWater")
    unit = F.when(kind == "view", pick("count", "steps", "kg", None)).when(kind == "click", pick("count/min", "BPM", "kg", None)).when(kind == "purchase", pick("kg", "lb", "g", "furlong"))
    stage = F.concat(F.lit(V.STAGE_PREFIX), pick("AsleepCore", "InBed", "Asleep", "Weird"))
    stamp = lambda t: F.concat(F.date_format(t, "yyyy-MM-dd HH:mm:ss"), F.lit(" -0700"))
    end = F.col("local") + F.make_dt_interval(secs=F.floor(F.col("value") * 60).cast("decimal(18,6)"))
    return r.select(kind_name.alias("type"), unit.alias("unit"), F.when(kind == "signup", stage).otherwise(F.col("value").cast("string")).alias("value"), stamp(F.col("local")).alias("start"), stamp(end).alias("end"), "source", F.struct("event_id").alias("pos"))


RAW = f"""{READ}, x AS (SELECT *, CASE kind WHEN 'view' THEN 'steps' WHEN 'click' THEN 'heart-rate' WHEN 'purchase' THEN 'weight' END AS metric,
  CASE kind WHEN 'view' THEN (['count','steps','kg',NULL])[k % 4 + 1] WHEN 'click' THEN (['count/min','BPM','kg',NULL])[k % 4 + 1]
  WHEN 'purchase' THEN (['kg','lb','g','furlong'])[k % 4 + 1] END AS unit,
  CASE WHEN kind IN ('view', 'click') AND k % 4 < 2 THEN value::DOUBLE WHEN kind = 'purchase' AND k % 4 = 0 THEN value::DOUBLE * 1.0 / 0.45359237
    WHEN kind = 'purchase' AND k % 4 = 1 THEN value::DOUBLE WHEN kind = 'purchase'
  AND k % 4 = 2 THEN value::DOUBLE * 0.001 / 0.45359237 END AS canonical FROM r),
o AS (SELECT *, CASE WHEN kind = 'error' THEN CASE WHEN k % 2 = 0 THEN 'excluded' ELSE 'unknown-type' END
  WHEN kind = 'signup' THEN CASE WHEN k % 4 = 3 THEN 'unknown-sleep-stage' WHEN floor(value * 60) < 1 THEN 'skipped' ELSE 'folded' END
  WHEN unit IS NULL THEN 'missing-unit' WHEN canonical IS NULL THEN 'unconvertible-unit'
  WHEN kind = 'click' AND NOT (canonical > 0 AND canonical <= 300) THEN 'implausible-value' WHEN kind = 'purchase' AND NOT (canonical > 0
  AND canonical <= 1500) THEN 'implausible-value' ELSE 'folded' END AS outcome FROM x)"""

# --- roll-ups ----------------------------------------------------------------------------------------------------------

_TOTALS = f"""{READ}, t AS (SELECT kind, day, coalesce(source, '(unattributed)') AS source, sum(value) AS total FROM r WHERE kind = 'view'
  GROUP BY ALL)"""


@query(f"""WITH {_TOTALS} SELECT kind, day, total::DOUBLE AS value, nullif(source, '(unattributed)') AS source FROM t
  QUALIFY row_number() OVER (PARTITION BY kind, day ORDER BY total DESC, source) = 1""")
def rollup_sum_winning_source(spark: SparkSession, sf: str) -> DataFrame:
    return R.winning_source(readings(spark, sf).where("kind = 'view'")).withColumn("value", F.col("value").cast("double"))


@query(f"""WITH {READ} SELECT kind, day, sum(value)::DOUBLE / count(value) AS value, min(value)::DOUBLE AS min, max(value)::DOUBLE AS max FROM r
  WHERE kind = 'click' GROUP BY kind, day""")
def rollup_avg_min_max(spark: SparkSession, sf: str) -> DataFrame:
    return R.spread(readings(spark, sf).where("kind = 'click'"))


@query(f"WITH {READ} SELECT kind, day, sum(value)::DOUBLE / count(value) AS value FROM r WHERE kind = 'purchase' GROUP BY kind, day")
def rollup_mean(spark: SparkSession, sf: str) -> DataFrame:
    return R.by_policy(readings(spark, sf), policies(spark).where(F.col("policy") == V.MEAN)).select("kind", "day", "value")


@query(f"WITH {READ} SELECT kind, day, max(value)::DOUBLE AS value FROM r WHERE kind = 'signup' GROUP BY kind, day")
def rollup_max(spark: SparkSession, sf: str) -> DataFrame:
    return R.by_policy(readings(spark, sf), policies(spark).where(F.col("policy") == V.MAX)).select("kind", "day", "value")


_POLICY = f"""{READ}, t AS (SELECT kind, day, coalesce(source, '(unattributed)') AS source, sum(value) AS total FROM r WHERE kind = 'view'
  GROUP BY ALL),
w AS (SELECT kind, day, total, source FROM t QUALIFY row_number() OVER (PARTITION BY kind, day ORDER BY total DESC, source) = 1),
l AS (SELECT kind, day, instant, min(source) AS source FROM r GROUP BY ALL), s AS (SELECT kind, day, source FROM l
  QUALIFY row_number() OVER (PARTITION BY kind, day ORDER BY instant DESC) = 1),
d AS (SELECT kind, day, sum(value)::DOUBLE / count(value) AS mean, min(value)::DOUBLE AS lo, max(value)::DOUBLE AS hi FROM r WHERE kind <> 'error'
  GROUP BY kind, day),
p AS (SELECT d.kind, d.day, CASE d.kind WHEN 'view' THEN w.total::DOUBLE WHEN 'signup' THEN hi ELSE mean END AS value, CASE
  WHEN d.kind = 'click' THEN lo END AS min, CASE WHEN d.kind = 'click' THEN hi END AS max,
  CASE WHEN d.kind = 'view' THEN nullif(w.source, '(unattributed)') ELSE s.source END AS source FROM d LEFT JOIN w USING (kind, day)
  JOIN s USING (kind, day))"""
_ADMIT = "b(kind, low, low_open, high) AS (VALUES " + ", ".join(f"('{k}', {lo}, {str(o).upper()}, {hi})" for k, (lo, o, hi) in BOUNDS.items()) + ")"
_no = lambda x: f"CASE WHEN {x} IS NULL THEN NULL WHEN NOT (({x} > low OR (NOT low_open AND {x} = low)) AND {x} <= high) THEN 'implausible-value' END"
_ADMIT += f", q AS (SELECT kind, day, value, source, {_no('value')} AS refused, CASE WHEN {_no('min')} IS NULL THEN min END AS min, CASE WHEN {_no('max')} IS NULL THEN max END AS max, {_no('value')} IS NULL AND ({_no('min')} IS NOT NULL OR {_no('max')} IS NOT NULL) AS bounds_cleared FROM p JOIN b USING (kind))"


def _rolled(spark: SparkSession, sf: str) -> DataFrame:
    return R.admitted(R.by_policy(readings(spark, sf), policies(spark)), dims(spark))


@query(f"WITH {_POLICY}, {_ADMIT} SELECT kind, day, value, min, max, source FROM q WHERE refused IS NULL")
def rollup_by_policy(spark: SparkSession, sf: str) -> DataFrame:
    return _rolled(spark, sf).where("refused is null").select("kind", "day", "value", "min", "max", "source")


@query(f"""WITH {_POLICY}, {_ADMIT} SELECT kind, count(*) AS n, arg_min(value, (day, value)) AS sample_value, min(day) AS sample_day FROM q
  WHERE refused IS NOT NULL GROUP BY kind""")
def plausibility_refusals(spark: SparkSession, sf: str) -> DataFrame:
    return D.tally(_rolled(spark, sf).where("refused is not null"))


@query(f"WITH {_POLICY}, {_ADMIT} SELECT kind, day, value, min, max FROM q WHERE bounds_cleared")
def bounds_cleared(spark: SparkSession, sf: str) -> DataFrame:
    return _rolled(spark, sf).where("bounds_cleared").select("kind", "day", "value", "min", "max")


@query(f"""WITH {_POLICY}, {_ADMIT}, v AS (SELECT kind, count(*) AS days, min(value) AS min_value, max(value) AS max_value FROM q
  WHERE refused IS NULL GROUP BY kind) SELECT *, max_value > 0 AND max_value <= 1 AND kind = 'click' AS maybe_fraction FROM v""")
def value_span_by_kind(spark: SparkSession, sf: str) -> DataFrame:
    return R.value_span(_rolled(spark, sf).where("refused is null")).withColumn("maybe_fraction", looks_like_fraction("kind", "max_value", ("click",)))


@query(f"WITH {_POLICY} SELECT kind, day, source FROM s")
def latest_source_credit(spark: SparkSession, sf: str) -> DataFrame:
    return R.latest_source(readings(spark, sf))


@query(f"""WITH {_TOTALS}, d AS (SELECT kind, day, sum(total)::DOUBLE AS a, max(total)::DOUBLE AS b, count(*) AS n FROM t GROUP BY kind, day)
SELECT kind, count(*) AS days, round(avg(a / b), 9) AS mean_ratio, max(a / b) AS max_ratio FROM d WHERE n > 1 AND b > 0 GROUP BY kind""")
def multi_source_ratio(spark: SparkSession, sf: str) -> DataFrame:
    return R.multi_source_ratio(readings(spark, sf).where("kind = 'view'")).withColumn("mean_ratio", F.round("mean_ratio", 9))


@query(f"WITH {READ} SELECT kind, source, day FROM r QUALIFY row_number() OVER (PARTITION BY kind ORDER BY day, event_id) <= 3")
def top_n_per_group(spark: SparkSession, sf: str) -> DataFrame:
    return R.first_rows(readings(spark, sf), ("kind",), ("day", "event_id"), 3).select("kind", "source", "day")


# --- nights and intervals ----------------------------------------------------------------------------------------------


@query(f"WITH {SEG} SELECT kind, day, count(*) AS n FROM g GROUP BY kind, day")
def night_attribution(spark: SparkSession, sf: str) -> DataFrame:
    return segments(spark, sf).groupBy("kind", "day").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {SEG}, {_islands('g', 'kind, day')} SELECT kind, day, hours FROM u")
def interval_union_hours(spark: SparkSession, sf: str) -> DataFrame:
    return union_hours(segments(spark, sf), ("kind", "day")).select("kind", "day", F.col("hours").cast("double").alias("hours"))


@query(f"WITH {SEG}, {_islands('g', 'kind, day')} SELECT kind, day, pieces FROM u WHERE pieces >= 10")
def interval_island_counts(spark: SparkSession, sf: str) -> DataFrame:
    return union_hours(segments(spark, sf), ("kind", "day")).where("pieces >= 10").select("kind", "day", "pieces")


_STAGED = f"{SEG}, s0 AS (SELECT kind, day, from_s, to_s FROM g WHERE kind <> 'error' UNION ALL SELECT 'sleep-total', day, from_s, to_s FROM g WHERE kind IN ('view', 'click'))"


@query(f"WITH {_STAGED}, {_islands('s0', 'kind, day')} SELECT kind, day, hours FROM u")
def total_vs_stage_hours(spark: SparkSession, sf: str) -> DataFrame:
    s = segments(spark, sf).withColumns({"stage_kind": F.when(F.col("kind") != "error", F.col("kind")), "asleep": F.col("kind").isin("view", "click")}).drop("kind")
    return union_hours(stage_rows(s), ("kind", "day")).select("kind", "day", F.col("hours").cast("double").alias("hours"))


@query(f"""WITH {SEG}, l AS (SELECT kind, day, instant, min(source) AS source FROM g GROUP BY ALL) SELECT kind, day, source FROM l
  QUALIFY row_number() OVER (PARTITION BY kind, day ORDER BY instant DESC) = 1""")
def segment_source_credit(spark: SparkSession, sf: str) -> DataFrame:
    return R.latest_source(segments(spark, sf))


# --- routing, units, refusals ------------------------------------------------------------------------------------------


@query(f"WITH {RAW} SELECT event_id, canonical FROM x WHERE kind = 'purchase'")
def unit_convert(spark: SparkSession, sf: str) -> DataFrame:
    r = readings(spark, sf).where("kind = 'purchase'")
    r = r.select("event_id", F.col("value").cast("double").alias("value"), F.element_at(F.array(*[F.lit(u) for u in (" KG", "Pounds", "gram", "furlong")]), F.col("k") % 4 + 1).alias("unit"), F.lit("weight").alias("kind"))
    return converted(r, "export").select("event_id", "canonical")


@query(f"WITH {RAW} SELECT kind, unit, count(*) AS n FROM o WHERE outcome = 'unconvertible-unit' GROUP BY kind, unit")
def unit_unconvertible_tally(spark: SparkSession, sf: str) -> DataFrame:
    f = importer.parse(raw(spark, sf)).frames["unconvertible"]
    name = F.when(F.col("type").endswith("StepCount"), "view").when(F.col("type").endswith("HeartRate"), "click").otherwise("purchase")
    return f.select(name.alias("kind"), "unit", "n")


@query(f"WITH {RAW} SELECT outcome, count(*) AS n FROM o GROUP BY outcome")
def classify_outcome_counts(spark: SparkSession, sf: str) -> DataFrame:
    return routed_records(raw(spark, sf)).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {RAW}, z AS (SELECT event_id, CASE WHEN outcome = 'unknown-sleep-stage' THEN 'HKCategoryValueSleepAnalysisWeird'
  WHEN kind = 'error' THEN 'HKQuantityTypeIdentifierDietaryWater'
  WHEN kind = 'view' THEN 'HKQuantityTypeIdentifierStepCount' WHEN kind = 'click' THEN 'HKQuantityTypeIdentifierHeartRate'
  ELSE 'HKQuantityTypeIdentifierBodyMass' END AS name, day
  FROM o WHERE outcome IN ('unknown-type', 'unknown-sleep-stage', 'missing-unit', 'unconvertible-unit'))
  SELECT name, count(*) AS n, arg_min(day, event_id) AS day FROM z GROUP BY name""")
def quarantine_one_per_name(spark: SparkSession, sf: str) -> DataFrame:
    return importer.parse(raw(spark, sf)).frames["quarantine"].select("name", "n", "day")


@query(f"""WITH {RAW}, f AS (SELECT metric AS kind, day, canonical AS v, source, instant FROM o WHERE outcome = 'folded' AND kind <> 'signup'),
t AS (SELECT kind, day, coalesce(source, '(unattributed)') AS source, sum(v) AS total FROM f WHERE kind = 'steps' GROUP BY ALL),
w AS (SELECT kind, day, total, source FROM t QUALIFY row_number() OVER (PARTITION BY kind, day ORDER BY round(total, 6) DESC, source) = 1),
l AS (SELECT kind, day, date_trunc('second', instant) AS i, min(source) AS source FROM f GROUP BY ALL), s AS (SELECT kind, day, source FROM l
  QUALIFY row_number() OVER (PARTITION BY kind, day ORDER BY i DESC) = 1)
SELECT kind, day, round(avg(v), 6) AS value, round(min(v), 6) AS min, round(max(v), 6) AS max, s.source FROM f JOIN s USING (kind, day)
  WHERE kind <> 'steps' GROUP BY kind, day, s.source
UNION ALL SELECT kind, day, round(total, 6), NULL, NULL, nullif(source, '(unattributed)') FROM w""")
def import_rollup(spark: SparkSession, sf: str) -> DataFrame:
    rows = importer.parse(raw(spark, sf)).rows.where(~F.col("kind").isin(*[m[0] for m in V.METRICS if m[2] == V.UNION]))
    return rows.select("kind", "day", *[F.round(c, 6).alias(c) for c in ("value", "min", "max")], "source")


@query("SELECT event_id, (props->>'$.k')::DOUBLE AS k, NULL::DOUBLE AS missing FROM events")
def json_field_extract(spark: SparkSession, sf: str) -> DataFrame:
    v = F.parse_json("props")
    return table(spark, sf, "events").select("event_id", json_number(v, "k").alias("k"), json_number(v, "missing").alias("missing"))


_NIGHT = {"totalSleep": "sleep-total", "deep": "sleep-deep", "inBed": "time-in-bed"}


@query("""WITH n AS (SELECT l_orderkey, l_linenumber, l_quantity, l_discount, CASE
  WHEN l_returnflag <> 'N' THEN l_tax END AS bed, l_shipdate::DATE AS day FROM lineitem)
SELECT l_orderkey, l_linenumber, day, kind, hours
  FROM (SELECT l_orderkey, l_linenumber, day, l_quantity::DOUBLE AS "sleep-total", l_discount::DOUBLE AS "sleep-deep", bed::DOUBLE AS "time-in-bed"
  FROM n)
UNPIVOT (hours FOR kind IN ("sleep-total", "sleep-deep", "time-in-bed"))""")
def sleep_stage_unpivot(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as nights of a push, whose stages become rows."""
    li = table(spark, sf, "lineitem")
    bed = F.when(F.col("l_returnflag") != "N", F.col("l_tax").cast("double"))
    point = F.to_json(F.struct(F.col("l_quantity").cast("double").alias("totalSleep"), F.col("l_discount").cast("double").alias("deep"), bed.alias("inBed")))
    rows = li.select("l_orderkey", "l_linenumber", F.to_date("l_shipdate").alias("day"), F.parse_json(point).alias("v"))
    return night_rows(rows).select("l_orderkey", "l_linenumber", "day", "kind", F.col("value").alias("hours"))


@query("""SELECT vec_id, (i - 1)::INT AS pos, embedding[i]::FLOAT::DOUBLE AS x
  FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)""")
def array_explode_positions(spark: SparkSession, sf: str) -> DataFrame:
    """Embeddings as pushes of one metric each, whose points become rows."""
    e = table(spark, sf, "embeddings")
    metric = F.struct(F.lit("step_count").alias("name"), F.transform("embedding", lambda x: F.struct(x.alias("qty"))).alias("data"))
    body = F.to_json(F.struct(F.struct(F.array(metric).alias("metrics")).alias("data")))
    got = shaped(points(e.select("vec_id", body.alias("value")), "value", "vec_id"))
    return got.select(F.col("pos._batch").alias("vec_id"), F.col("pos._p").alias("pos"), F.col("value").cast("float").cast("double").alias("x"))


# --- state -------------------------------------------------------------------------------------------------------------

CUT = "2024-01-16"
_HALVES = f"""{READ}, lw AS (SELECT kind, source, (day - INTERVAL 14 DAY)::DATE AS day, value, event_id FROM r WHERE day >= DATE '{CUT}'),
old AS (SELECT kind, day, max(value)::DOUBLE AS value, max(source) AS source FROM r WHERE day < DATE '{CUT}' GROUP BY kind, day),
new AS (SELECT kind, day, value::DOUBLE AS value, source FROM lw QUALIFY row_number() OVER (PARTITION BY kind, day
  ORDER BY event_id DESC) = 1)"""


def _halves(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """State of the first half of the month, and the second half's last readings, moved onto it."""
    r = readings(spark, sf)
    old = r.where(F.col("day") < CUT).groupBy("kind", "day").agg(F.max("value").cast("double").alias("value"), F.max("source").alias("source"))
    new = r.where(F.col("day") >= CUT).select("kind", F.date_sub("day", 14).alias("day"), F.col("value").cast("double").alias("value"), "source", "event_id")
    return old, S.last_write(new, ("kind", "day"), "event_id").drop("event_id")


@query(f"WITH {_HALVES} SELECT kind, day, value, source FROM new UNION ALL SELECT kind, day, value, source FROM old ANTI JOIN new USING (kind, day)")
def upsert_lww(spark: SparkSession, sf: str) -> DataFrame:
    return S.upsert(*_halves(spark, sf), ("kind", "day"))


@query(f"WITH {_HALVES} SELECT kind, day, new.value AS new_value, old.value AS old_value FROM new JOIN old USING (kind, day)")
def upsert_prior_capture(spark: SparkSession, sf: str) -> DataFrame:
    return S.prior(*_halves(spark, sf), ("kind", "day"))


@query(f"""WITH {_HALVES}, p AS (SELECT kind, day, abs(new.value - old.value) AS d FROM new JOIN old USING (kind, day))
SELECT kind, count(*) AS days, round(avg(d), 9) AS mean_diff, max(d) AS max_diff, arg_min(day, (-d, day)) AS max_day FROM p GROUP BY kind""")
def overlap_stats(spark: SparkSession, sf: str) -> DataFrame:
    return D.overlap(S.prior(*_halves(spark, sf), ("kind", "day"))).withColumn("mean_diff", F.round("mean_diff", 9))


_STALE = f"""{_HALVES}, made AS (SELECT kind, day FROM new WHERE day % 3 <> 0), n2 AS (SELECT * FROM new WHERE dayofmonth(day) % 3 <> 0),
sp AS (SELECT kind, min(day) AS lo, max(day) AS hi FROM n2 GROUP BY kind), st AS (SELECT old.* FROM old JOIN sp USING (kind) WHERE old.day BETWEEN lo
  AND hi), stale AS (SELECT * FROM st ANTI JOIN n2 USING (kind, day))""".replace(" made AS (SELECT kind, day FROM new WHERE day % 3 <> 0),", "")


def _stale(spark: SparkSession, sf: str) -> DataFrame:
    old, new = _halves(spark, sf)
    return S.stale(old, new.where(F.dayofmonth("day") % 3 != 0))


@query(f"WITH {_STALE} SELECT kind, day, value, source FROM stale")
def stale_rows(spark: SparkSession, sf: str) -> DataFrame:
    return _stale(spark, sf).select("kind", "day", "value", "source")


@query(f"""WITH {_STALE}, k AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY day) AS n FROM stale)
  SELECT kind, count(*) AS n_rows, string_agg(CASE WHEN n <= 5 THEN day::VARCHAR END, ',' ORDER BY day) AS first_days FROM k GROUP BY kind""")
def stale_summary(spark: SparkSession, sf: str) -> DataFrame:
    return R.first_dates(_stale(spark, sf)).select("kind", F.col("rows").alias("n_rows"), F.array_join(F.col("first_days").cast("array<string>"), ",").alias("first_days"))


_COMPLAINTS = f"""{READ}, c AS (SELECT kind AS name, day, event_id AS pos, value::VARCHAR AS point, CASE WHEN k % 3 = 0 THEN 'implausible-value'
  ELSE 'missing-unit' END AS reason, 'm' || (k % 4) AS metric, k % 2 = 0 AS stored FROM r)"""


def _complaints(spark: SparkSession, sf: str) -> DataFrame:
    r = readings(spark, sf)
    reason = F.when(F.col("k") % 3 == 0, V.IMPLAUSIBLE).otherwise(V.MISSING_UNIT)
    return S.merged_complaints(
        r.select(
            F.col("kind").alias("name"), "day", F.col("event_id").alias("pos"), F.col("value").cast("string").alias("point"), reason.alias("reason"), F.lit(None).cast("string").alias("units"),
            F.concat(F.lit("m"), F.col("k") % 4).alias("kind"), (F.col("k") % 2 == 0).alias("stored"),
        )
    )


@query(f"""WITH {_COMPLAINTS}, kept AS (SELECT name, day, point, reason FROM c QUALIFY row_number() OVER (PARTITION BY name, day
  ORDER BY stored, pos) = 1),
f AS (SELECT name, day, metric, min(pos) AS pos FROM c GROUP BY ALL), ks AS (SELECT name, day, string_agg(metric, ',' ORDER BY pos) AS kinds FROM f
  GROUP BY name, day), so AS (SELECT name, day, bool_or(stored) AS stored FROM c GROUP BY name, day)
SELECT name, day, point, reason, kinds, stored FROM kept JOIN ks USING (name, day) JOIN so USING (name, day)""")
def complaint_merge(spark: SparkSession, sf: str) -> DataFrame:
    return _complaints(spark, sf).select("name", "day", "point", "reason", F.array_join("kinds", ",").alias("kinds"), "stored")


#: Every event has a part in it: it is quarantined, settled or complained of, by its k, under its kind and user.
_RETIRE = f"""{READ}, e AS (SELECT kind || '/' || user_id AS name, day, k % 3 AS part FROM r), q AS (SELECT DISTINCT name, day FROM e WHERE part = 0),
cl AS (SELECT DISTINCT name, day FROM e WHERE part = 1 EXCEPT SELECT name, day FROM e WHERE part = 2)"""


@query(f"WITH {_RETIRE} SELECT name, day, EXISTS (SELECT 1 FROM cl WHERE cl.name = q.name AND cl.day = q.day) AS retired FROM q")
def complaint_retire(spark: SparkSession, sf: str) -> DataFrame:
    e = readings(spark, sf).select(F.concat_ws("/", "kind", "user_id").alias("name"), "day", (F.col("k") % 3).alias("part"))
    quarantined, settled, complained = (e.where(F.col("part") == i).drop("part").distinct() for i in range(3))
    left, gone = S.retired(quarantined, settled, complained)
    return left.withColumn("retired", F.lit(False)).unionByName(gone.withColumn("retired", F.lit(True)))


@query(f"""WITH {READ}, q AS (SELECT event_id, day, CASE k % 4 WHEN 0 THEN 'HKQuantityTypeIdentifierStepCount' WHEN 1 THEN 'hkother'
  WHEN 2 THEN 'HKQuantityTypeIdentifierDietaryWater' ELSE 'HKQuantityTypeIdentifierHeartRate' END || CASE WHEN user_id % 2 = 0 THEN ''
  ELSE 'x' END AS name,
  CASE WHEN k % 5 = 0 THEN NULL WHEN k % 5 = 1 THEN 'missing-unit' ELSE 'unknown-type' END AS reason FROM r),
  one AS (SELECT name, day, arg_min(reason, event_id) FILTER (reason IS NOT NULL) AS reason0, (list(reason ORDER BY event_id))[1] AS reason FROM q
  GROUP BY name, day)
SELECT name, day FROM one WHERE NOT (name IN ('HKQuantityTypeIdentifierStepCount', 'HKQuantityTypeIdentifierHeartRate') AND (reason IS NULL
  OR reason = 'unknown-type'))""")
def promoted_name_sweep(spark: SparkSession, sf: str) -> DataFrame:
    r = readings(spark, sf)
    name = F.concat(F.when(F.col("k") % 4 == 0, "HKQuantityTypeIdentifierStepCount").when(F.col("k") % 4 == 1, "hkother").when(F.col("k") % 4 == 2, "HKQuantityTypeIdentifierDietaryWater").otherwise("HKQuantityTypeIdentifierHeartRate"), F.when(F.col("user_id") % 2 == 0, "").otherwise("x"))
    reason = F.when(F.col("k") % 5 == 1, V.MISSING_UNIT).when(F.col("k") % 5 != 0, V.UNKNOWN_TYPE)
    point = F.when(reason.isNull(), "{}").otherwise(F.concat(F.lit('{"_import":{"reason":"'), reason, F.lit('"}}')))
    q = r.groupBy(name.alias("name"), "day").agg(F.min_by(point, "event_id").alias("point"))
    return S.swept(q)[0].select("name", "day")


@query("""SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, l_returnflag AS outcome, l_quantity FROM lineitem WHERE l_suppkey % 5 <> 0 UNION ALL
  SELECT l_suppkey, min(l_orderkey), NULL, NULL, 'done', count(*)::DOUBLE FROM lineitem WHERE l_suppkey % 5 = 0 GROUP BY l_suppkey""")
def replace_outcome(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", F.col("l_returnflag").alias("outcome"), "l_quantity")
    new = li.where("l_suppkey % 5 = 0").groupBy("l_suppkey").agg(F.min("l_orderkey").alias("l_orderkey"), F.lit("done").alias("outcome"), F.count(F.lit(1)).cast("double").alias("l_quantity"))
    return S.replace_rows(li, new, ("l_suppkey",))


@query("""SELECT c_custkey, c_name, CASE WHEN c_custkey % 3 = 0 THEN NULL WHEN c_custkey % 3 = 1 THEN 'NEW' ELSE c_mktsegment END AS c_mktsegment,
  CASE WHEN c_custkey % 3 = 1 THEN 0.0 ELSE c_acctbal END AS c_acctbal FROM customer""")
def sparse_update(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_acctbal")
    m = F.col("c_custkey") % 3
    ch = c.where(m < 2).select("c_custkey", F.when(m == 1, "NEW").alias("c_mktsegment"), F.lit(True).alias("c_mktsegment_set"), F.lit(0.0).alias("c_acctbal"), (m == 1).alias("c_acctbal_set"))
    return S.sparse_update(c, ch, "c_custkey", ("c_mktsegment", "c_acctbal"))


@query("SELECT count(*) AS n_rows, min(o_orderdate)::DATE AS first_day, max(o_orderdate)::DATE AS last_day FROM orders")
def store_survey(spark: SparkSession, sf: str) -> DataFrame:
    return D.survey(table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("day")))


# --- diagnostics -------------------------------------------------------------------------------------------------------

_SHIFT = """n AS (SELECT o_orderdate::DATE AS day, sum(CASE WHEN o_orderstatus = 'O' THEN round(o_totalprice) END) AS value FROM orders
  GROUP BY 1 HAVING value IS NOT NULL),
s AS (SELECT (o_orderdate + INTERVAL 1 DAY)::DATE AS day, sum(round(o_totalprice)) AS value FROM orders GROUP BY 1),
j AS (SELECT n.value, b.value AS b, o.value AS o, a.value AS a FROM n JOIN s b ON b.day = n.day - 1 JOIN s o ON o.day = n.day
  JOIN s a ON a.day = n.day + 1),
d AS (SELECT count(*) AS compared_days, avg(abs(value - b)) AS prev_day, avg(abs(value - o)) AS same_day, avg(abs(value - a)) AS next_day,
  count(CASE WHEN value = b THEN 1 END) AS prev_exact, count(CASE WHEN value = o THEN 1 END) AS same_exact, count(CASE
  WHEN value = a THEN 1 END) AS next_exact FROM j)"""


def _shift(spark: SparkSession, sf: str) -> DataFrame:
    """Open orders by day against all orders of the day before."""
    o = table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("day"), F.round("o_totalprice").alias("v"), "o_orderstatus")
    new = o.groupBy("day").agg(F.sum(F.when(F.col("o_orderstatus") == "O", F.col("v"))).alias("value")).where("value is not null")
    return D.day_shift(new, o.groupBy(F.date_add("day", 1).alias("day")).agg(F.sum("v").alias("value")))


@query(f"""WITH {_SHIFT} SELECT compared_days, round(prev_day, 3) AS prev_day, round(same_day, 3) AS same_day, round(next_day, 3) AS next_day, prev_exact, same_exact, next_exact FROM d""")
def day_shift_offsets(spark: SparkSession, sf: str) -> DataFrame:
    return _shift(spark, sf).withColumns({c: F.round(c, 3) for c in ("prev_day", "same_day", "next_day")})


@query(f"""WITH {_SHIFT}, b AS (SELECT *, CASE WHEN same_day <= prev_day AND same_day <= next_day THEN 0 WHEN prev_day <= next_day THEN -1
  ELSE 1 END AS o FROM d),
v AS (SELECT *, CASE WHEN compared_days = 0 THEN 'no-comparable-rows' WHEN CASE o WHEN 0 THEN same_exact WHEN -1 THEN prev_exact
  ELSE next_exact END > compared_days * 0.5 THEN 'self-comparison' WHEN compared_days < 14 THEN 'unverified'
  WHEN o = 0 THEN 'agrees' WHEN least(prev_day, same_day, next_day) < same_day * 0.5
  AND same_day - least(prev_day, same_day, next_day) >= 0.25 THEN 'mismatch' ELSE 'agrees' END AS verdict FROM b)
SELECT compared_days, verdict, CASE WHEN verdict NOT IN ('no-comparable-rows', 'self-comparison') THEN o END AS best_offset FROM v""")
def day_shift_verdict(spark: SparkSession, sf: str) -> DataFrame:
    return D.day_shift_verdict(_shift(spark, sf)).select("compared_days", "verdict", "best_offset")


@query(f"""WITH {READ}, d AS (SELECT kind, day, sum(value)::DOUBLE AS value FROM r GROUP BY kind, day)
  SELECT a.day, a.value AS systolic, b.value AS diastolic FROM d a JOIN d b ON a.day = b.day AND a.kind = 'click' AND b.kind = 'view'""")
def pair_by_date(spark: SparkSession, sf: str) -> DataFrame:
    d = readings(spark, sf).groupBy("kind", "day").agg(F.sum("value").cast("double").alias("value"))
    one = lambda k, n: d.where(F.col("kind") == k).select("day", F.col("value").alias(n))
    return one("click", "systolic").join(one("view", "diastolic"), "day")


# --- registry ----------------------------------------------------------------------------------------------------------

LANGS = ("de", "en", "es", "fr", "it")
_CLAIMS = """c AS (SELECT d.doc_id AS id, lang AS category, CASE quality WHEN 1 THEN 'verified' WHEN 0 THEN 'recalled'
  ELSE 'unknown' END AS confidence, CASE WHEN source <> 'src0' THEN source END AS subject, n_chars FROM documents d LEFT
  JOIN labels l USING (doc_id))"""


def _claims(spark: SparkSession, sf: str) -> DataFrame:
    j = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    conf = F.when(F.col("quality") == 1, "verified").when(F.col("quality") == 0, "recalled").otherwise("unknown")
    return j.select(F.col("doc_id").alias("id"), F.col("lang").alias("category"), conf.alias("confidence"), F.when(F.col("source") != "src0", F.col("source")).alias("subject"), F.col("n_chars").alias("updated_at"))


_COVER = f"WITH {_CLAIMS}, v AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{x}')" for i, x in enumerate(LANGS)) + ") t(ord, category)), k AS (SELECT v.ord, v.category, count(c.id) AS claims, count(CASE WHEN confidence = 'unknown' THEN 1 END) AS unknowns, max(n_chars) AS last_updated FROM v LEFT JOIN c USING (category) GROUP BY ALL)"


@query(_COVER + " SELECT * FROM k")
def coverage_zero_fill(spark: SparkSession, sf: str) -> DataFrame:
    return G.coverage(_claims(spark, sf), LANGS)


@query(_COVER + " SELECT sum(claims)::BIGINT AS claims, sum(unknowns)::BIGINT AS unknowns FROM k")
def coverage_totals(spark: SparkSession, sf: str) -> DataFrame:
    return G.coverage_totals(G.coverage(_claims(spark, sf), LANGS))


@query(f"""WITH {_CLAIMS} SELECT 'own' AS scope, id, category, confidence FROM c WHERE subject IS NULL UNION ALL
  SELECT 'src1', id, category, confidence FROM c WHERE subject = 'src1' AND confidence = 'verified' UNION ALL SELECT 'any', id, category, confidence
  FROM c WHERE category = 'de'""")
def claims_filter_tristate(spark: SparkSession, sf: str) -> DataFrame:
    c = _claims(spark, sf)
    parts = {"own": S.filtered(c, subject=None), "src1": S.filtered(c, subject="src1", confidence="verified"), "any": S.filtered(c, subject=..., category="de")}
    out = None
    for n, p in parts.items():
        p = p.select(F.lit(n).alias("scope"), "id", "category", "confidence")
        out = p if out is None else out.unionByName(p)
    return out


@query("""SELECT conv_id AS id, count(*) AS n, string_agg(role || ':' || turn, ',' ORDER BY turn, role) AS responses FROM conversations
  WHERE conv_id = (SELECT max(conv_id) FROM conversations WHERE turn = 1) GROUP BY conv_id""")
def latest_parent_with_children(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations")
    parent = latest(c.where("turn = 1").select(F.col("conv_id").alias("id")).distinct(), "id")
    got = G.children(parent, c.select("turn", "role", F.col("conv_id").alias("of")), "of", "responses", order="turn")
    return got.select("id", F.size("responses").cast("long").alias("n"), F.array_join(F.transform("responses", lambda x: F.concat(x["role"], F.lit(":"), x["turn"])), ",").alias("responses"))


@query("""WITH p AS (SELECT o_orderkey FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1)
  SELECT o.o_orderkey, l.l_linenumber, l.l_partkey, CASE WHEN l.l_returnflag <> 'N' THEN l.l_returnflag END AS outcome FROM p o LEFT
  JOIN lineitem l ON l.l_orderkey = o.o_orderkey""")
def plan_items_left_outcome(spark: SparkSession, sf: str) -> DataFrame:
    plan = latest(table(spark, sf, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate", "o_orderkey").select("o_orderkey")
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("outcome"))
    return plan.join(li, F.col("o_orderkey") == F.col("l_orderkey"), "left").drop("l_orderkey")


@query("""SELECT r_regionkey AS id, r_name AS name, coalesce((SELECT string_agg(n_name, ',' ORDER BY n_nationkey) FROM nation
  WHERE n_regionkey = r_regionkey), '') AS tags FROM region""")
def parent_tags_nested(spark: SparkSession, sf: str) -> DataFrame:
    parents = table(spark, sf, "region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"))
    got = G.children(parents, table(spark, sf, "nation"), "n_regionkey", "tags", order="n_nationkey")
    return got.select("id", "name", F.array_join(F.transform("tags", lambda x: x["n_name"]), ",").alias("tags"))


_FK = "l AS (SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_suppkey % 50 = 0 THEN NULL ELSE l_suppkey * 2 END AS ref FROM lineitem)"


def _fk(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.when(F.col("l_suppkey") % 50 != 0, F.col("l_suppkey") * 2).alias("ref"))
    return S.orphans(li, table(spark, sf, "supplier"), "ref", "s_suppkey")


@query(f"WITH {_FK} SELECT * FROM l WHERE ref IS NOT NULL AND ref NOT IN (SELECT s_suppkey FROM supplier)")
def fk_rejects(spark: SparkSession, sf: str) -> DataFrame:
    return _fk(spark, sf)[1]


@query(f"WITH {_FK} SELECT * FROM l WHERE ref IS NULL OR ref IN (SELECT s_suppkey FROM supplier)")
def fk_accepts(spark: SparkSession, sf: str) -> DataFrame:
    return _fk(spark, sf)[0]


@query("SELECT event_id AS id, ts::VARCHAR AS at FROM events WHERE ts >= TIMESTAMP '2024-01-28'")
def recent_window_desc(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("ts").alias("occurred_at"))
    return G.recent(o, F.lit("2024-01-28 00:00:00").cast("timestamp_ntz")).select("id", F.col("occurred_at").cast("string").alias("at"))


@query("SELECT o_orderkey AS id, o_orderdate::DATE AS day FROM orders WHERE o_orderstatus = 'P'")
def pending_asc(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("occurred_at"), F.when(F.col("o_orderstatus") == "P", 0).otherwise(1).alias("reviewed"))
    return G.pending(o).select("id", F.to_date("occurred_at").alias("day"))


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN FALSE ELSE o_orderdate::DATE < DATE '1998-01-01' END AS overdue FROM orders")
def overdue_flag(spark: SparkSession, sf: str) -> DataFrame:
    by = F.when(F.col("o_orderstatus") != "F", F.to_date("o_orderdate"))
    return table(spark, sf, "orders").select("o_orderkey", overdue(by, F.lit("1998-01-01").cast("date")).alias("overdue"))


@query("SELECT o_orderkey, (DATE '2002-01-01' - o_orderdate::DATE)::INT AS days FROM orders")
def checkin_days_since(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select("o_orderkey", days_since("o_orderdate", F.lit("2002-01-01").cast("date")).alias("days"))


@query(f"""WITH {_CLAIMS}, ck AS (SELECT max(conv_id) AS id FROM conversations WHERE turn = 1)
SELECT 'last_checkin' AS section, 1::BIGINT AS n, id::VARCHAR AS first_id FROM ck UNION ALL SELECT 'responses', count(*), min(turn)::VARCHAR
  FROM conversations WHERE conv_id = (SELECT id FROM ck)
UNION ALL SELECT 'unknowns', count(*), max(id)::VARCHAR FROM c WHERE confidence = 'unknown' UNION ALL
  SELECT 'pending', count(*), arg_min(o_orderkey, (o_orderdate, o_orderkey))::VARCHAR FROM orders WHERE o_orderstatus = 'P'
UNION ALL SELECT 'concerns', count(*), min(r_regionkey)::VARCHAR FROM region UNION ALL SELECT 'plan', 1, (SELECT o_orderkey FROM orders
  ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1)::VARCHAR""")
def briefing_flat(spark: SparkSession, sf: str) -> DataFrame:
    """A registry of conversations (check-ins), orders (plans, observations), regions (concerns) and claims, briefed; its sections counted."""
    t = {n: G.empty(spark, n) for n in G.SCHEMAS}
    c, o = table(spark, sf, "conversations"), table(spark, sf, "orders")
    at = F.to_timestamp("o_orderdate")
    t["checkins"] = c.where("turn = 1").select(F.col("conv_id").alias("id"), F.timestamp_seconds(F.col("conv_id") + F.lit(1_700_000_000)).alias("completed_at")).distinct()
    t["checkin_responses"] = c.select(F.col("turn").alias("id"), F.col("conv_id").alias("checkin_id"), F.col("role").alias("question"))
    t["plans"] = o.select(F.col("o_orderkey").alias("id"), at.alias("starts_on"))
    t["observations"] = o.select(F.col("o_orderkey").alias("id"), at.alias("occurred_at"), F.when(F.col("o_orderstatus") == "P", 0).otherwise(1).alias("reviewed"))
    t["concerns"] = table(spark, sf, "region").select(F.col("r_regionkey").alias("id"), F.lit("active").alias("status"))
    t["claims"] = _claims(spark, sf)
    rows = briefing_rows(t, "2024-01-01")
    first = F.min_by("id", "place").cast("string")
    out = rows.groupBy("section").agg(F.count(F.lit(1)).alias("n"), first.alias("first_id"))
    told = F.from_json(F.col("record"), "responses array<struct<id: long>>")["responses"]
    answers = rows.where("section = 'last_checkin'").select(F.lit("responses").alias("section"), F.size(told).cast("long").alias("n"), F.array_min(F.transform(told, lambda x: x["id"])).cast("string").alias("first_id"))
    return out.unionByName(answers)


# --- sources -----------------------------------------------------------------------------------------------------------


def _folder(spark: SparkSession, name: str) -> str:
    """A new folder under the cluster's shared one; a folder of this machine only where that runs everything."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}" if shared else tempfile.mkdtemp(prefix=f"{name}-")


@query(ORACLE_SQL["import_rollup"])
def xml_roundtrip_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """Events written as an XML export and read again."""
    path = _folder(spark, "export") + "/xml"
    cols = [F.col(n).alias(f"_{a}") for a, n in {"type": "type", "unit": "unit", "value": "value", "startDate": "start", "endDate": "end", "sourceName": "source"}.items()]
    raw(spark, sf).select(*cols).write.format("xml").option("rootTag", "HealthData").option("rowTag", "Record").save(path)
    rows = importer.parse_export(spark, path).rows.where(~F.col("kind").isin(*[m[0] for m in V.METRICS if m[2] == V.UNION]))
    return rows.select("kind", "day", *[F.round(c, 6).alias(c) for c in ("value", "min", "max")], "source")


_PUSHED = f"""WITH {READ}, p AS (SELECT *, ntile(3) OVER (ORDER BY event_id) AS batch FROM r WHERE kind IN ('view', 'click')),
s AS (SELECT kind, day, value::DOUBLE AS value, source, event_id, k FROM p WHERE NOT (kind = 'click' AND (value <= 0 OR value > 300)) AND k % 5 <> 0)
SELECT CASE kind WHEN 'view' THEN 'steps' ELSE 'heart-rate' END AS kind, day, value, source FROM s QUALIFY row_number() OVER (PARTITION BY kind, day
  ORDER BY event_id DESC) = 1"""


PUSHED = 4096


def payloads(spark: SparkSession, sf: str) -> DataFrame:
    """Events as pushes: batch and value (its JSON). A day's points come in the order of their ids, those of PUSHED following
    ids at most in one push, and a day's pushes are in order by batch."""
    r = readings(spark, sf).where("kind in ('view', 'click')")
    stamp = F.concat(F.date_format("local", "yyyy-MM-dd HH:mm:ss"), F.lit(" -0700"))
    q = F.col("value").cast("double")
    point = F.to_json(F.struct(stamp.alias("date"), F.when(F.col("kind") == "view", q).alias("qty"), F.when(F.col("kind") == "click", q).alias("Avg"), F.col("source").alias("source")))
    metric = F.struct(F.when(F.col("kind") == "view", "step_count").otherwise("heart_rate").alias("name"), F.when(F.col("k") % 5 != 0, F.when(F.col("kind") == "view", "count").otherwise("bpm")).alias("units"), point.alias("point"))
    batch = F.concat(F.col("day").cast("string"), F.lit("/"), F.lpad(F.floor(F.col("event_id") / PUSHED).cast("string"), 12, "0"))
    days = r.groupBy(batch.alias("batch")).agg(F.array_sort(F.collect_list(F.struct("event_id", metric.alias("m")))).alias("ms"))
    one = lambda x: F.concat(F.lit('{"name":"'), x["m"]["name"], F.lit('"'), F.coalesce(F.concat(F.lit(',"units":"'), x["m"]["units"], F.lit('"')), F.lit("")), F.lit(',"data":['), x["m"]["point"], F.lit("]}"))
    body = F.concat(F.lit('{"data":{"metrics":['), F.array_join(F.transform("ms", one), ","), F.lit("]}}"))
    return days.select("batch", body.alias("value"))


#: Nights, bounds and unknown names of a push: signups are nights whose stages are wrong for every fifth user, errors are a
#: name that no kind has, purchases carry bounds of which the lower one is out of range for every fourth k.
_FATES = f"""WITH {READ}, s AS (SELECT event_id, day, kind, k, value::DOUBLE AS v, user_id FROM r WHERE kind IN ('signup', 'error', 'purchase')),
n AS (SELECT day, 'sleep_analysis' AS name, st.kind AS kind, CASE WHEN user_id % 5 = 0 THEN st.h * 1000 ELSE st.h END AS h, st.cap, event_id
  FROM s, unnest([{{'kind': 'sleep-total', 'h': 7.5, 'cap': 25.0}}, {{'kind': 'time-in-bed', 'h': 8.25, 'cap': 48.0}}]) u(st)
  WHERE s.kind = 'signup'),
w AS (SELECT day, 'weight_body_mass' AS name, 'weight' AS kind, v, k % 4 = 0 AS low_out, event_id FROM s WHERE kind = 'purchase' AND v > 0
  AND v <= 1500)"""


def fate_payloads(spark: SparkSession, sf: str) -> DataFrame:
    """One push for each signup, error and purchase: its batch is its id."""
    r = readings(spark, sf).where("kind in ('signup', 'error', 'purchase')")
    stamp = F.concat(F.date_format("local", "yyyy-MM-dd HH:mm:ss"), F.lit(" -0700"))
    v, factor = F.col("value").cast("double"), F.when(F.col("user_id") % 5 == 0, 1000.0).otherwise(1.0)
    night = F.struct(stamp.alias("date"), (factor * 7.5).alias("totalSleep"), (factor * 8.25).alias("inBed"))
    weight = F.struct(stamp.alias("date"), v.alias("Avg"), F.when(F.col("k") % 4 == 0, -1.0).otherwise(v).alias("Min"), v.alias("Max"))
    other = F.struct(stamp.alias("date"), v.alias("qty"))
    kind = F.col("kind")
    point = F.when(kind == "signup", F.to_json(night)).when(kind == "purchase", F.to_json(weight)).otherwise(F.to_json(other))
    name = F.when(kind == "signup", V.SLEEP_PUSH).when(kind == "purchase", "weight_body_mass").otherwise("a_new_thing")
    units = F.when(kind == "signup", "hr").when(kind == "purchase", "lb").otherwise("x")
    text = F.concat(F.lit('{"data":{"metrics":[{"name":"'), name, F.lit('","units":"'), units, F.lit('","data":['), point, F.lit("]}]}}"))
    return r.select("event_id", text.alias("value"))


@query(f"""{_FATES}, st AS (SELECT kind, day, h AS value, NULL::DOUBLE AS min, NULL::DOUBLE AS max, event_id FROM n WHERE h <= cap
  UNION ALL SELECT kind, day, v, CASE WHEN NOT low_out THEN v END, v, event_id FROM w)
SELECT kind, day, value, min, max FROM st QUALIFY row_number() OVER (PARTITION BY kind, day ORDER BY event_id DESC) = 1""")
def push_nights_and_bounds(spark: SparkSession, sf: str) -> DataFrame:
    r = push.route(fate_payloads(spark, sf), "value", "event_id")
    return S.last_write(r.stored, ("kind", "day"), "pos").select("kind", "day", "value", "min", "max")


@query(f"""{_FATES}, c AS (SELECT name, day, kind, FALSE AS stored, 'implausible-value' AS reason, event_id, kind = 'time-in-bed' AS later FROM n
  WHERE h > cap
  UNION ALL SELECT name, day, kind, TRUE, 'implausible-value', event_id, FALSE FROM w WHERE low_out UNION ALL
  SELECT 'a_new_thing', day, NULL, FALSE, 'unknown-type', event_id, FALSE FROM s WHERE kind = 'error')
SELECT name, day, arg_min(reason, (stored, event_id, later)) AS reason, bool_or(stored) AS stored,
  CASE WHEN name = 'sleep_analysis' THEN 'sleep-total,time-in-bed' WHEN name = 'weight_body_mass' THEN 'weight' ELSE '' END AS kinds FROM c
  GROUP BY name, day""")
def push_complaints(spark: SparkSession, sf: str) -> DataFrame:
    c = push.route(fate_payloads(spark, sf), "value", "event_id").complaints
    return c.select("name", "day", "reason", "stored", F.array_join("kinds", ",").alias("kinds"))


@query(f"""WITH {_HALVES}, n2 AS (SELECT * FROM new WHERE dayofmonth(day) % 3 <> 0), sp AS (SELECT kind, min(day) AS lo, max(day) AS hi FROM n2
  GROUP BY kind),
m AS (SELECT kind, day, value, source FROM n2 UNION ALL SELECT kind, day, value, source FROM old ANTI JOIN n2 USING (kind, day))
SELECT 'whole' AS document, m.* FROM m LEFT JOIN sp USING (kind) WHERE NOT (sp.lo IS NOT NULL AND m.day BETWEEN lo AND hi AND NOT EXISTS (SELECT 1
  FROM n2 WHERE n2.kind = m.kind AND n2.day = m.day))
UNION ALL SELECT 'cut', m.* FROM m""")
def guarded_range_replace(spark: SparkSession, sf: str) -> DataFrame:
    """Stale rows go where the document was whole; a document that was cut off deletes nothing."""
    old, new = _halves(spark, sf)
    new = new.where(F.dayofmonth("day") % 3 != 0)
    merged = S.upsert(old, new, ("kind", "day"))
    whole, cut = (S.replace_range(merged, new, True, closed)[0] for closed in (True, False))
    return whole.select(F.lit("whole").alias("document"), "kind", "day", "value", "source").unionByName(cut.select(F.lit("cut").alias("document"), "kind", "day", "value", "source"))


@query(_PUSHED)
def push_final_state(spark: SparkSession, sf: str) -> DataFrame:
    r = push.route(payloads(spark, sf), "value", "batch")
    return S.last_write(r.stored, ("kind", "day"), "pos").select("kind", "day", "value", "source")


@query(_PUSHED)
def stream_ingest_final_state(spark: SparkSession, sf: str) -> DataFrame:
    from .sources.store import Store
    from .streaming.ingest import stream_pushes

    root = _folder(spark, "pushes")
    payloads(spark, sf).repartitionByRange(4, "batch").sortWithinPartitions("batch").select("value").write.text(f"{root}/in")
    store = Store(spark, f"{root}/store")
    stream_pushes(spark, f"{root}/in", store, f"{root}/checkpoint", "2024-02-01 00:00:00", lines=True).awaitTermination()
    return store.read("daily_metric").select("kind", "day", "value", "source")
