"""The registry: twelve small tables, and verbs that are validated changes of them.

A verb takes frames and returns frames: what to write, and what was rejected with its reason. Many changes are one job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import vocab as V
from ..functions.scalars import appended_note, subject
from ..operators.state import filtered, orphans, sparse_update

STAMPS = ", created_at timestamp, updated_at timestamp"
SCHEMAS = {
    "profile": "id int, date_of_birth date, sex string, height_cm int, notes string",
    "concerns": "id int, name string, status string, narrative string, opened_on date, resolved_on date",
    "concern_tags": "id int, concern_id int, tag string",
    "goals": "id int, concern_id int, title string, description string, metric_kind string, comparison string, target_value double, target_high double, target_date date, status string",
    "protocols": "id int, concern_id int, goal_id int, name string, kind string, purpose string, schedule string, started_on date, ended_on date, review_by date, verdict string, verdict_rationale string",
    "observations": "id int, occurred_at timestamp, origin string, kind string, body string, severity int, concern_id int, reviewed int",
    "checkins": "id int, started_at timestamp, completed_at timestamp, summary string",
    "checkin_responses": "id int, checkin_id int, question string, answer string, concern_id int",
    "plans": "id int, checkin_id int, starts_on date, horizon_days int, guidance string, nutrition string",
    "plan_items": "id int, plan_id int, kind string, title string, detail string, scheduled_for date",
    "plan_item_outcomes": "id int, plan_item_id int, status string, note string, recorded_at timestamp",
    "claims": "id int, category string, statement string, confidence string, subject string, topic string, occurred_on date, source_quote string, concern_id int",
}
SCHEMAS = {n: s + STAMPS for n, s in SCHEMAS.items()}


#: Ranges of its order that a batch is numbered in.
RANGES = 64
#: Rows of a task in dealt().
ROWS = 500_000


def empty(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], SCHEMAS[name])


def blank(x: str | Column) -> Column:
    return F.coalesce(F.trim(F.col(x) if isinstance(x, str) else x), F.lit("")) == ""


def judged(rows: DataFrame, **rules: Column) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected with reason): the first rule that holds, in order, is the reason."""
    reason = F.lit(None).cast("string")
    for name, test in reversed(rules.items()):
        reason = F.when(F.coalesce(test, F.lit(False)), name.replace("_", " ")).otherwise(reason)
    r = rows.withColumn("reason", reason)
    return r.where("reason is null").drop("reason"), r.where("reason is not null")


def dealt(rows: DataFrame, key: str) -> DataFrame:
    """rows in partitions by a hash of key, so many that a task has about ROWS of them. Partitions that adaptive execution joins
    have as many bytes as are written for them: of keys alone, which pack well, these are a great many rows to be sorted."""
    return rows.repartition(rows.count() // ROWS + 1, key)


def appended(table: DataFrame, rows: DataFrame, now: str, order: str | None = None) -> DataFrame:
    """table and rows with the next ids, in the order given, which must tell all rows apart for ids to be the same every time.

    Rows are dealt to ranges of the order; a range's ids start after the rows of the ranges before it, whose counts alone meet."""
    at, by = F.lit(now).cast("timestamp"), order or rows.columns[0]
    top = table.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top"))
    number = _numbered(rows, by)
    cuts = rows.select(number.alias("_k")).stat.approxQuantile("_k", [i / RANGES for i in range(1, RANGES)], 0.01)
    span = sum((F.when(number > c, 1).otherwise(0) for c in sorted(set(cuts))), F.lit(0))
    placed = rows.withColumn("_p", span).repartition(RANGES, "_p").withColumn("_n", F.row_number().over(Window.partitionBy("_p").orderBy(by)))
    counts = placed.groupBy("_p").agg(F.count(F.lit(1)).alias("_c"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_c").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_p", "_before")  # RANGES rows
    new = placed.join(F.broadcast(before), "_p").crossJoin(top)  # one row
    new = new.withColumn("id", (F.col("_top") + F.col("_before") + F.col("_n")).cast("int")).withColumns({"created_at": at, "updated_at": at})
    cols = [F.col(c) if c in new.columns else F.lit(None).cast(table.schema[c].dataType).alias(c) for c in table.columns]
    return table.unionByName(new.select(*cols))


def _numbered(rows: DataFrame, by: str) -> Column:
    """A number that grows with the values of by: of texts the seven bytes after those that all of them begin with."""
    kind = rows.schema[by].dataType.typeName()
    if kind == "date":
        return F.unix_date(by).cast("double")
    if kind in ("timestamp", "timestamp_ntz"):
        return F.unix_micros(F.col(by).cast("timestamp")).cast("double")
    if kind != "string":
        return F.col(by).cast("double")
    least, most = rows.agg(F.min(by), F.max(by)).first()
    a, b = (least or "").encode(), (most or "").encode()
    same = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return F.conv(F.rpad(F.hex(F.substring(F.encode(F.col(by), "UTF-8"), same + 1, 7)), 14, "0"), 16, 10).cast("double")


def new_concerns(rows: DataFrame, today: str) -> tuple[DataFrame, DataFrame]:
    """rows (name, narrative, opened_on, tags) with defaults; tags first come, first kept, each once."""
    ok, bad = judged(rows, name_is_blank=blank("name"))
    return ok.withColumns({"status": F.lit("active"), "opened_on": F.coalesce("opened_on", F.lit(today).cast("date")), "tags": F.array_distinct("tags")}), bad


def tag_rows(concerns: DataFrame) -> DataFrame:
    return concerns.select(F.col("id").alias("concern_id"), F.posexplode("tags").alias("pos", "tag"))


def update_concern_status(concerns: DataFrame, changes: DataFrame, today: str) -> DataFrame:
    """changes: id, new_status, note. A resolved concern has today as its day, any other none."""
    day = F.lit(today).cast("date")
    j = concerns.join(changes.select(F.col("id").alias("_id"), "new_status", "note"), concerns["id"] == F.col("_id"), "left")
    hit = F.col("_id").isNotNull()
    new = {
        "narrative": F.when(hit, appended_note("narrative", day, "note")).otherwise(F.col("narrative")),
        "resolved_on": F.when(hit, F.when(F.col("new_status") == "resolved", day)).otherwise(F.col("resolved_on")),
        "status": F.coalesce("new_status", "status"),
    }
    return j.withColumns(new).select(*concerns.columns)


def check_goals(rows: DataFrame, concerns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A comparison needs a target, a range a higher end above it, and a target a comparison."""
    found, lost = orphans(rows, concerns, "concern_id", "id")
    c = F.col("comparison")
    ok, bad = judged(
        found, title_is_blank=blank("title"), unknown_comparison=c.isNotNull() & ~c.isin(*V.COMPARISONS), target_is_missing=c.isNotNull() & F.col("target_value").isNull(),
        comparison_is_missing=c.isNull() & F.coalesce("target_value", "target_high").isNotNull(), range_needs_a_higher_end=(c == "range") & F.col("target_high").isNull(),
        range_is_inverted=(c == "range") & (F.col("target_high") <= F.col("target_value")), only_a_range_has_a_higher_end=c.isNotNull() & (c != "range") & F.col("target_high").isNotNull(),
    )
    return ok.withColumn("status", F.lit("active")), bad.unionByName(lost.withColumn("reason", F.lit("no such concern")))


def check_observations(rows: DataFrame, concerns: DataFrame, now: str) -> tuple[DataFrame, DataFrame]:
    found, lost = orphans(rows, concerns, "concern_id", "id")
    ok, bad = judged(found, body_is_blank=blank("body"), severity_out_of_range=F.col("severity").isNotNull() & ~F.col("severity").between(1, 10), unknown_origin=~F.col("origin").isin(*V.ORIGINS))
    ok = ok.withColumns({"occurred_at": F.coalesce("occurred_at", F.lit(now).cast("timestamp")), "reviewed": F.when(F.col("origin") == "self_reported", 1).otherwise(0), "kind": F.coalesce("kind", F.lit("note"))})
    return ok, bad.unionByName(lost.withColumn("reason", F.lit("no such concern")))


def check_responses(rows: DataFrame, checkins: DataFrame, concerns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A closed check-in takes no answers."""
    c = checkins.select(F.col("id").alias("_c"), "completed_at")
    j = rows.join(c, rows["checkin_id"] == F.col("_c"), "left")
    ok, bad = judged(j, no_such_checkin=F.col("_c").isNull(), checkin_is_closed=F.col("completed_at").isNotNull(), answer_is_blank=blank("answer"))
    found, lost = orphans(ok, concerns, "concern_id", "id")
    drop = ("_c", "completed_at")
    return found.drop(*drop), bad.unionByName(lost.withColumn("reason", F.lit("no such concern"))).drop(*drop)


def start_checkin(checkins: DataFrame, now: str) -> tuple[DataFrame, bool]:
    """An open check-in of today is taken up again; else there is a new one. (table, is it new)"""
    at = F.lit(now).cast("timestamp")
    is_open = checkins.where(F.col("completed_at").isNull() & (F.col("started_at") >= F.date_trunc("day", at)))
    if not is_open.isEmpty():
        return checkins, False
    return appended(checkins, checkins.sparkSession.range(1).select(at.alias("started_at")), now, "started_at"), True


def complete_checkins(checkins: DataFrame, changes: DataFrame, now: str) -> tuple[DataFrame, DataFrame]:
    """changes: id, new_summary. (table, rejected)"""
    at = F.lit(now).cast("timestamp")
    j = changes.join(checkins.select(F.col("id").alias("_id"), "completed_at"), changes["id"] == F.col("_id"), "left")
    ok, bad = judged(j, no_such_checkin=F.col("_id").isNull(), checkin_is_closed=F.col("completed_at").isNotNull())
    ok = ok.select(F.col("_id"), "new_summary")
    out = checkins.join(ok, checkins["id"] == F.col("_id"), "left")
    hit = F.col("_id").isNotNull()
    return out.withColumns({"completed_at": F.when(hit, at).otherwise(F.col("completed_at")), "summary": F.when(hit, F.col("new_summary")).otherwise(F.col("summary"))}).select(*checkins.columns), bad


def record_verdicts(protocols: DataFrame, changes: DataFrame, today: str) -> tuple[DataFrame, DataFrame]:
    """changes: id, new_verdict, rationale, new_ended_on. A verdict is given once."""
    j = changes.join(protocols.select(F.col("id").alias("_id"), "verdict"), changes["id"] == F.col("_id"), "left")
    ok, bad = judged(j, no_such_protocol=F.col("_id").isNull(), verdict_was_given=F.col("verdict").isNotNull(), rationale_is_blank=blank("rationale"), unknown_verdict=~F.col("new_verdict").isin(*V.VERDICTS))
    ok = ok.select("_id", "new_verdict", "rationale", "new_ended_on")
    out = protocols.join(ok, protocols["id"] == F.col("_id"), "left")
    hit = F.col("_id").isNotNull()
    new = {"verdict": F.coalesce("new_verdict", "verdict"), "verdict_rationale": F.coalesce("rationale", "verdict_rationale"), "ended_on": F.when(hit, F.coalesce("new_ended_on", "ended_on", F.lit(today).cast("date"))).otherwise(F.col("ended_on"))}
    return out.withColumns(new).select(*protocols.columns), bad


def start_protocols(rows: DataFrame, concerns: DataFrame, goals: DataFrame, today: str) -> tuple[DataFrame, DataFrame]:
    ok, bad = judged(rows, name_is_blank=blank("name"))
    a, lost = orphans(ok, concerns, "concern_id", "id")
    b, gone = orphans(a, goals, "goal_id", "id")
    bad = bad.unionByName(lost.withColumn("reason", F.lit("no such concern"))).unionByName(gone.withColumn("reason", F.lit("no such goal")))
    return b.withColumn("started_on", F.coalesce("started_on", F.lit(today).cast("date"))), bad


def commit_plan(plans: DataFrame, items: DataFrame, checkins: DataFrame, today: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """plans: key, checkin_id, ...; items: plan_key, kind, title, .... A plan without items, or with a blank one, is rejected whole."""
    n = items.groupBy("plan_key").agg(F.count_if(blank("title")).alias("_blank"), F.count(F.lit(1)).alias("_n"))
    j = plans.join(n, plans["key"] == F.col("plan_key"), "left").drop("plan_key")
    ok, bad = judged(j, no_items=F.col("_n").isNull(), item_title_is_blank=F.col("_blank") > 0)
    found, lost = orphans(ok, checkins, "checkin_id", "id")
    found = found.drop("_n", "_blank").withColumns({"starts_on": F.coalesce("starts_on", F.lit(today).cast("date")), "horizon_days": F.coalesce("horizon_days", F.lit(7))})
    return found, items.join(found.select(F.col("key").alias("plan_key")), "plan_key", "left_semi"), bad.unionByName(lost.withColumn("reason", F.lit("no such checkin"))).drop("_n", "_blank")


def record_outcomes(outcomes: DataFrame, new: DataFrame, items: DataFrame, now: str) -> tuple[DataFrame, DataFrame]:
    """One outcome for each item: a new one takes the old one's place. Tables that are dealt() by item are not dealt again."""
    found, lost = orphans(new, items, "plan_item_id", "id")
    kept = outcomes.join(found.select("plan_item_id").distinct(), "plan_item_id", "left_anti").select(*outcomes.columns)
    return appended(kept, found.withColumn("recorded_at", F.lit(now).cast("timestamp")), now, "plan_item_id"), lost


def record_claims(rows: DataFrame, concerns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All or nothing: with any claim rejected, none is accepted."""
    r = rows.withColumn("subject", subject("subject"))
    found, lost = orphans(r, concerns, "concern_id", "id")
    ok, bad = judged(found, statement_is_blank=blank("statement"), unknown_category=~F.col("category").isin(*V.CLAIM_CATEGORIES), unknown_confidence=~F.col("confidence").isin(*V.CONFIDENCES))
    bad = bad.unionByName(lost.withColumn("reason", F.lit("no such concern")))
    return (ok if bad.isEmpty() else ok.limit(0)), bad


def update_claims(claims: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sparse changes: statement, confidence, subject, topic, occurred_on; the quote never changes. `self` clears the subject, a blank one is rejected."""
    is_self = F.lower(F.trim("subject")) == "self"
    c = changes.withColumn("subject", F.when(~is_self, F.trim("subject")).otherwise(F.when(is_self, F.lit(None).cast("string")).otherwise(F.col("subject"))))
    ok, bad = judged(c, subject_is_blank=F.col("subject_set") & F.col("subject").isNotNull() & blank("subject"), statement_is_blank=F.col("statement_set") & blank("statement"))
    return sparse_update(claims, ok, "id", ("statement", "confidence", "subject", "topic", "occurred_on")), bad


def update_profile(profile: DataFrame, changes: dict, now: str) -> DataFrame:
    """The one row of the profile, made if need be; only given columns change."""
    at = F.lit(now).cast("timestamp")
    base = profile if not profile.isEmpty() else profile.sparkSession.range(1).select(F.lit(1).alias("id"), *[F.lit(None).cast(f.dataType).alias(f.name) for f in profile.schema.fields[1:-2]], at.alias("created_at"), at.alias("updated_at"))
    return base.select(*[F.lit(changes[c]).cast(profile.schema[c].dataType).alias(c) if c in changes else (at.alias(c) if c == "updated_at" else F.col(c)) for c in profile.columns])


def get_claims(claims: DataFrame, **scope: object) -> DataFrame:
    """Newest first; subject=None is the person themselves, ... any."""
    return filtered(claims, **scope).orderBy(F.desc("id"))


def protocol_history(protocols: DataFrame) -> DataFrame:
    return protocols.orderBy(F.desc("started_on"), F.desc("id"))


def mark_reviewed(observations: DataFrame, ids: list[int]) -> DataFrame:
    return observations.withColumn("reviewed", F.when(F.col("id").isin(ids), 1).otherwise(F.col("reviewed")))


def update_goal_status(goals: DataFrame, changes: DataFrame) -> DataFrame:
    j = goals.join(changes.select(F.col("id").alias("_id"), "new_status"), goals["id"] == F.col("_id"), "left")
    return j.withColumn("status", F.coalesce("new_status", "status")).select(*goals.columns)


def pending(observations: DataFrame) -> DataFrame:
    return observations.where("reviewed = 0").orderBy("occurred_at", "id")


def recent(observations: DataFrame, since: Column) -> DataFrame:
    return observations.where(F.col("occurred_at") >= since).orderBy(F.desc("occurred_at"), F.desc("id"))


def unresolved(claims: DataFrame) -> DataFrame:
    return claims.where("confidence = 'unknown'").orderBy(F.desc("id"))


def coverage(claims: DataFrame, categories: tuple[str, ...] = V.CLAIM_CATEGORIES) -> DataFrame:
    """category, claims, unknowns, last_updated for every category, those without claims too, in the vocabulary's order (ord)."""
    dim = claims.sparkSession.createDataFrame(list(enumerate(categories)), "ord int, category string")
    n = claims.groupBy("category").agg(F.count(F.lit(1)).alias("claims"), F.count_if(F.col("confidence") == "unknown").alias("unknowns"), F.max("updated_at").alias("last_updated"))
    return dim.join(n, "category", "left").select("ord", "category", F.coalesce("claims", F.lit(0)).alias("claims"), F.coalesce("unknowns", F.lit(0)).alias("unknowns"), "last_updated").orderBy("ord")


def coverage_totals(covered: DataFrame) -> DataFrame:
    return covered.agg(F.sum("claims").alias("claims"), F.sum("unknowns").alias("unknowns"))


def children(parents: DataFrame, rows: DataFrame, key: str, name: str, parent_id: str = "id", order: str = "id") -> DataFrame:
    """parents with an array of their rows, in order; empty where there are none."""
    own = F.struct(order, *[c for c in rows.columns if c != order])
    got = rows.groupBy(F.col(key).alias("_p")).agg(F.array_sort(F.collect_list(own)).alias(name))
    return parents.join(got, parents[parent_id] == F.col("_p"), "left").drop("_p").withColumn(name, F.coalesce(F.col(name), F.array().cast(got.schema[name].dataType)))


def delete_concerns(tables: dict[str, DataFrame], ids: DataFrame) -> dict[str, DataFrame]:
    """Without concerns (ids: id): their tags go with them, other rows lose the reference."""
    gone = ids.select(F.col("id").alias("_gone")).distinct()
    out = dict(tables)
    out["concerns"] = tables["concerns"].join(gone, F.col("id") == F.col("_gone"), "left_anti")
    out["concern_tags"] = tables["concern_tags"].join(gone, F.col("concern_id") == F.col("_gone"), "left_anti")
    for n in ("goals", "protocols", "observations", "checkin_responses", "claims"):
        t = tables[n]
        out[n] = t.join(gone, t["concern_id"] == F.col("_gone"), "left").withColumn("concern_id", F.when(F.col("_gone").isNull(), F.col("concern_id"))).select(*t.columns)
    return out
