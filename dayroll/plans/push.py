"""Incremental load: route pushed points, merge them into state, account for every one."""

from __future__ import annotations

import json
import logging
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from .. import vocab as V
from ..functions.scalars import finite, looks_like_fraction
from ..operators.classify import bounded, classified, converted, refusal
from ..operators.state import last_write, merged_complaints, retired, stamped, upsert
from ..sources.push import measured, points
from ..sources.store import ConflictError, Store


LOG = logging.getLogger("dayroll.push")
#: Times that a push is merged anew after another writer's version.
ATTEMPTS = 5


@dataclass
class Routed:
    """Frames of one push: what is stored, complained of, settled; and every dated or undated point with its fate."""

    stored: DataFrame
    complaints: DataFrame
    settled: DataFrame
    points: DataFrame


def _judged(rows: DataFrame) -> DataFrame:
    """rows with value_ok, min_ok and max_ok in the canonical unit, and value_no, min_no and max_no, the reasons against them."""
    names = ("value", "min", "max")
    r = bounded(converted(rows, "push", "value", "units", "kind", "_value", {c: f"_{c}" for c in names[1:]}))
    new = {}
    for c in names:
        v, own = F.col(c), F.col(f"_{c}")
        new[f"{c}_no"] = F.when(v.isNull(), None).when(F.col("units").isNull(), V.MISSING_UNIT).when(~finite(v), V.NON_FINITE).when(own.isNull(), V.UNCONVERTIBLE).otherwise(refusal(own))
    return r.withColumns(new).withColumns({f"{c}_ok": F.when(F.col(f"{c}_no").isNull(), F.col(f"_{c}")) for c in names}).drop("_value", "_min", "_max", "_low", "_open", "_high")


def routed_points(payloads: DataFrame, body: str = "value", batch: str | None = None) -> DataFrame:
    """A row for each value of a point, judged, and for each point without: what all frames of a push are made from. Payload order decides:
    a later metric, then a later point, wins among those that store."""
    p = measured(classified(points(payloads, body, batch), "push"), others=True)
    fate = F.when(F.col("class") == "excluded", "excluded").when(F.col("day").isNull(), "skipped").when((F.col("class") == "curated") & ~F.col("has_value"), "skipped").otherwise(F.col("class"))
    p = p.select("pos", "stage_pos", "name", "units", "point", "day", "source", "class", "first", fate.alias("fate"), "kind", "value", "min", "max")
    return _judged(p).withColumn("bound_no", F.when(F.col("value_no").isNull(), F.coalesce("min_no", "max_no"))).drop("min", "max", "min_no", "max_no")


def routed(judged: DataFrame) -> Routed:
    """The frames of routed_points()."""
    judged = judged.withColumn("at", F.struct("pos", F.coalesce("stage_pos", F.lit(0)).alias("stage_pos")))
    rows = judged.where("value is not null")
    unknown = judged.where("class = 'unknown' and day is not null").select(F.col("at").alias("pos"), "name", "units", "point", "day", F.lit(None).cast("string").alias("kind"), F.lit(V.UNKNOWN_TYPE).alias("reason"), F.lit(False).alias("stored"))
    bad = rows.where("value_no is not null or bound_no is not null").select(F.col("at").alias("pos"), "name", "units", "point", "day", "kind", F.coalesce("value_no", "bound_no").alias("reason"), F.col("value_no").isNull().alias("stored"))
    good = rows.where("value_no is null")
    stored = good.select(F.col("at").alias("pos"), "kind", "day", F.col("value_ok").alias("value"), F.col("min_ok").alias("min"), F.col("max_ok").alias("max"), "source", "bound_no", looks_like_fraction("kind", "value_ok", V.FRACTION_KINDS).alias("maybe_fraction"))
    settled = good.where("bound_no is null").select("name", "day").distinct()
    return Routed(stored, merged_complaints(unknown.unionByName(bad)), settled, judged.where("first").select("pos", "name", "units", "point", "day", "source", "class", "fate"))


def route(payloads: DataFrame, body: str = "value", batch: str | None = None) -> Routed:
    return routed(routed_points(payloads, body, batch))


#: Counts of a push that are taken while its points are written; of routed_points().
COUNTS = {
    "ingested": "count_if(value IS NOT NULL AND value_no IS NULL)",
    "bounds_cleared": "count_if(value IS NOT NULL AND bound_no IS NOT NULL)",
    "skipped": "count_if(first AND fate = 'skipped')",
    "first_day": "min(CASE WHEN first AND fate NOT IN ('skipped', 'excluded') THEN day END)",
    "last_day": "max(CASE WHEN first AND fate NOT IN ('skipped', 'excluded') THEN day END)",
}


def report(r: Routed) -> DataFrame:
    """One row: ingested points, bounds_cleared, skipped, unknown names (once for each metric entry), first and last day of all points looked at."""
    s = r.stored.agg(F.count(F.lit(1)).alias("ingested"), F.count("bound_no").alias("bounds_cleared"))
    p = r.points.agg(
        F.count_if(F.col("fate") == "skipped").alias("skipped"), F.min(F.when(~F.col("fate").isin("skipped", "excluded"), F.col("day"))).alias("first_day"), F.max(F.when(~F.col("fate").isin("skipped", "excluded"), F.col("day"))).alias("last_day"),
        F.count_distinct(F.when(F.col("fate") == "unknown", F.struct("pos._batch", "pos._m"))).alias("unknown_entries"),
    )
    return s.crossJoin(p)  # one row each


def refused(r: Routed) -> DataFrame:
    """Complaints about known names."""
    return r.complaints.where(F.size("kinds") > 0).select("name", "day", "reason", "kinds", "stored")


def ingest(store: Store, payloads: DataFrame, now: str, body: str = "value", batch: str | None = None) -> dict:
    """Merge a push into the store as one new version, which writes the months that it touches; the report's counts. If another
    writer was faster, the push is merged into what that one left.

    Payloads are read and parsed once: their judged points are written to the store's folder, counted on the way, and all else reads these."""
    spark, folder = payloads.sparkSession, f"{store.root}/staging/{uuid.uuid4().hex}"
    points, seen = routed_points(payloads, body, batch), Observation()
    try:
        points.observe(seen, *[F.expr(e).alias(n) for n, e in COUNTS.items()]).write.parquet(folder)
        r = routed(spark.read.schema(points.schema).parquet(folder))
        at = F.lit(now).cast("timestamp")
        parts = store.parts_of(r.stored.select("day").unionByName(r.complaints.select("day")).unionByName(r.settled.select("day")))
        entries = r.points.agg(F.count_distinct(F.when(F.col("fate") == "unknown", F.struct("pos._batch", "pos._m"))).alias("unknown_entries"))
        counts = seen.get | entries.first().asDict() | {"refused": refused(r).count()}
        for attempt in range(ATTEMPTS):
            try:
                out = counts | {"quarantine_retired": _merge(store, r, at, parts)}
                told(out)
                return out
            except ConflictError:
                if attempt + 1 == ATTEMPTS:
                    raise
    finally:
        store.discard(folder)


def _merge(store: Store, r: Routed, at: Column, parts: list[str]) -> int:
    base = store.version()
    state, quarantine = (store.read(t, base, parts) for t in ("daily_metric", "quarantine"))
    new = last_write(r.stored.drop("bound_no", "maybe_fraction"), ("kind", "day"), "pos").drop("pos").withColumns({"created_at": at, "updated_at": at})
    left, gone = retired(quarantine, r.settled, r.complaints)
    complaints = r.complaints.select("name", "day", stamped(F.col("point"), F.col("reason"), F.col("units"), F.col("kinds")).alias("point"), at.alias("created_at"))
    retired_rows = gone.count()
    store.commit({"daily_metric": upsert(state, new, ("kind", "day"), ("created_at",)), "quarantine": upsert(left, complaints, ("name", "day"), ("created_at",))}, base, parts)
    return retired_rows


def told(counts: dict) -> None:
    """Log a push: one line of JSON, a warning if anything was refused, skipped, cleared or unknown."""
    odd = any(counts[n] for n in ("refused", "skipped", "bounds_cleared", "unknown_entries"))
    LOG.log(logging.WARNING if odd else logging.INFO, "push %s", json.dumps(counts, default=str, sort_keys=True))
