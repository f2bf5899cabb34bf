"""Bulk load: export records to daily rows, cross-checked against state, merged, and reported."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import vocab as V
from ..operators import diagnostics as D
from ..operators.classify import routed_records
from ..operators.intervals import degenerate, nights
from ..operators.rollup import admitted, by_policy, first_dates, multi_source_ratio, value_span
from ..operators.state import one_row_per_name, prior, replace_range, stale, stamped, swept, upsert
from ..sources.store import ConflictError, Store
from ..sources.xml_export import is_closed, read_records, record_json
from ..sources.xml_scan import scan_export
from .push import ATTEMPTS


@dataclass
class Parsed:
    """Frames of one export."""

    records: DataFrame
    rolled: DataFrame
    closed: bool = True
    nights: DataFrame | None = None
    frames: dict[str, DataFrame] = field(default_factory=dict)

    @property
    def rows(self) -> DataFrame:
        return self.rolled.where("refused is null").select("kind", "day", "value", "min", "max", "source")


def parse(raw: DataFrame, closed: bool = True) -> Parsed:
    """Records (type, unit, value, start, end, source, pos) to rolled-up rows."""
    r = routed_records(raw).withColumn("point", record_json())
    folded = r.where("outcome = 'folded'")
    quantities = by_policy(folded.where("class = 'curated'").withColumn("value", F.col("canonical")), V.metrics(raw.sparkSession))
    sleep = nights(folded.where("class = 'sleep'").withColumn("day", F.to_date(F.col("local") + F.expr("INTERVAL 6 HOURS"))))
    rolled = admitted(quantities.unionByName(sleep.drop("pieces")))
    p = Parsed(r, rolled, closed, sleep)
    p.frames["outcomes"] = r.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))
    named = r.withColumn("name", F.when(F.col("outcome") == V.UNKNOWN_STAGE, F.col("value")).otherwise(F.col("type")))
    unit_reasons = (V.MISSING_UNIT, V.UNCONVERTIBLE)
    p.frames["quarantine"] = D.one_per_name(named.where(F.col("outcome").isin(*V.NAME_REASONS, *unit_reasons)).select("name", "day", "point", "outcome", "unit", "kind", "pos"), "pos")
    p.frames["unconvertible"] = r.where(F.col("outcome") == V.UNCONVERTIBLE).groupBy("type", "unit").agg(F.count(F.lit(1)).alias("n"))
    records = r.where(F.col("outcome") == V.IMPLAUSIBLE).select("kind", "day", F.col("canonical").alias("value"))
    p.frames["implausible"] = D.refusals(records, rolled.where("refused is not null"), rolled.where("bounds_cleared"))
    sums = V.metrics(raw.sparkSession).where(F.col("policy") == V.SUM).select(F.col("kind").alias("_k"))
    p.frames["multi_source"] = multi_source_ratio(folded.where("class = 'curated'").join(F.broadcast(sums), F.col("kind") == F.col("_k"), "left_semi"), "canonical")
    p.frames["spans"] = value_span(p.rows)
    p.frames["degenerate"] = degenerate(sleep)
    return p


def parse_export(spark: SparkSession, path: str) -> Parsed:
    return parse(read_records(spark, path), is_closed(spark, path))


def import_export(store: Store, path: str, folder: str, now: str, replace: bool = False, on_progress: Callable[[int], None] | None = None) -> dict[str, DataFrame | bool | int]:
    """Read an export once, into folder (a new one that all executors share), and merge it into the store. Raises MalformedExport
    with the byte at fault, and then leaves the store as it was; on_progress gets the records read so far while the export is read."""
    read = scan_export(store.spark, path, folder, on_progress)
    return persist(store, parse(read.records, read.closed), now, replace) | {"records": read.n_records}


def persist(store: Store, parsed: Parsed, now: str, replace: bool = False) -> dict[str, DataFrame | bool | int]:
    """Merge an export as one new version of the store, which writes the months that it touches. The sleep check reads state before the write, staleness compares with
    what was written; stale rows go only if asked for and the document was whole. State is read in the months of the export's days alone,
    a day more on either side. If another writer was faster, the export is merged into what that one left."""
    first, last = parsed.rows.agg(F.min("day"), F.max("day")).first()
    for attempt in range(ATTEMPTS):
        try:
            return _persist(store, parsed, F.lit(now).cast("timestamp"), replace, first, last)
        except ConflictError:
            if attempt + 1 == ATTEMPTS:
                raise


def _persist(store: Store, parsed: Parsed, at: Column, replace: bool, first: date | None, last: date | None) -> dict[str, DataFrame | bool | int]:
    before = store.version()
    near = [] if first is None else store.parts_between("daily_metric", first - timedelta(1), last + timedelta(1))
    state, quarantine = store.read("daily_metric", before, near), store.read("quarantine", before)
    rows = parsed.rows
    shift = D.day_shift_verdict(D.day_shift(rows.where("kind = 'sleep-total'").select("day", "value"), state.where("kind = 'sleep-total'").select("day", "value")))
    old = prior(state, rows, ("kind", "day"))
    gone = stale(state, rows)
    merged = upsert(state, rows.withColumns({"created_at": at, "updated_at": at}), ("kind", "day"), ("created_at",))
    merged, refused = replace_range(merged, rows, replace, parsed.closed)
    left, promoted = swept(quarantine)
    kinds = F.when(F.col("kind").isNotNull(), F.array("kind")).otherwise(F.array().cast("array<string>"))
    new = parsed.frames["quarantine"].select("name", "day", stamped(F.col("point"), F.col("outcome"), F.col("unit"), kinds).alias("point"), at.alias("created_at"))
    days = rows.select("day").unionByName(gone.select("day")) if replace and parsed.closed else rows.select("day")
    replaced = quarantine.join(new.select("name").distinct(), "name", "left_semi")
    touched = {"daily_metric": store.parts_of(days), "quarantine": store.parts_of(new.select("day").unionByName(promoted.select("day")).unionByName(replaced.select("day")))}
    tables = {"daily_metric": merged, "quarantine": one_row_per_name(left, new)}
    store.commit({t: df.where(store.part(t).isin(touched[t])) for t, df in tables.items()}, before, touched)
    return parsed.frames | {"overlap": D.overlap(old), "stale": first_dates(gone), "shift": shift, "promoted": promoted, "replace_refused": refused, "span": D.survey(rows), "version_before": before, "closed": parsed.closed}
