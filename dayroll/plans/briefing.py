"""The briefing: the registry's open matters on a given day, as rows of sections or as one nested row."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import cadence_note, days_since, overdue
from .registry import children, pending, recent, unresolved


def latest(rows: DataFrame, *order: str) -> DataFrame:
    """The one row that is last by order; a top-1, not a sort."""
    return rows.orderBy(*[F.desc_nulls_last(c) for c in order]).limit(1)


def _section(rows: DataFrame, name: str, *order) -> DataFrame:  # noqa: ANN002
    """All rows as one array, in order. Sections are what one person has open."""
    cols = F.struct(*rows.columns)
    key = F.struct(*[o.alias(f"_{i}") for i, o in enumerate(order)])
    got = rows.agg(F.array_sort(F.collect_list(F.struct(key.alias("k"), cols.alias("r")))).alias("a"))
    return got.select(F.transform("a", lambda x: x["r"]).alias(name))


def _one(rows: DataFrame, name: str) -> DataFrame:
    return rows.agg(F.first(F.struct(*rows.columns)).alias(name))


@dataclass
class Sections:
    """head: one row with last_checkin and what follows from it; ones: sections of one row at most; lists: those of many, with their order."""

    head: DataFrame
    ones: dict[str, DataFrame]
    lists: dict[str, tuple[DataFrame, list[Column]]]


def sections(t: dict[str, DataFrame], day: Column) -> Sections:
    checkin = latest(children(t["checkins"].where("completed_at is not null"), t["checkin_responses"], "checkin_id", "responses"), "completed_at", "id")
    items = t["plan_items"].join(t["plan_item_outcomes"].select(F.col("plan_item_id").alias("_i"), F.struct("status", "note", "recorded_at").alias("outcome")), F.col("id") == F.col("_i"), "left").drop("_i")
    plan = latest(children(t["plans"], items, "plan_id", "items"), "starts_on", "id")
    head = _one(checkin, "last_checkin").withColumn("days_since_checkin", days_since("last_checkin.completed_at", day)).withColumn("cadence_note", cadence_note("days_since_checkin"))
    head = head.withColumn("since", F.coalesce("last_checkin.completed_at", F.date_sub(day, 14).cast("timestamp")))
    since = head.select("since")
    desc = lambda c: -F.col(c) if c == "id" else -F.unix_micros(c)
    lists = {
        "concerns": (children(t["concerns"].where("status <> 'resolved'"), t["concern_tags"], "concern_id", "tags"), [F.col("id")]),
        "goals": (t["goals"].where("status = 'active'"), [F.col("id")]),
        "protocols": (t["protocols"].where("ended_on is null").withColumn("overdue", overdue("review_by", day)), [F.col("id")]),
        "pending": (pending(t["observations"]), [F.unix_micros("occurred_at"), F.col("id")]),
        "recent": (recent(t["observations"].join(F.broadcast(since)), F.col("since")).drop("since"), [desc("occurred_at"), desc("id")]),
        "unknowns": (unresolved(t["claims"]), [desc("id")]),
    }
    return Sections(head.drop("since"), {"profile": t["profile"].where("id = 1"), "plan": plan}, lists)


def briefing_rows(t: dict[str, DataFrame], today: str) -> DataFrame:
    """section, place (array of numbers by which a section's rows are in order), id and record (JSON), a row for each matter
    however many there are."""
    s = sections(t, F.lit(today).cast("date"))
    json = lambda rows: F.to_json(F.struct(*rows.columns))
    out = s.head.where("last_checkin is not null").select(F.lit("last_checkin").alias("section"), F.array(F.lit(0).cast("long")).alias("place"), F.col("last_checkin.id").cast("long").alias("id"), F.to_json("last_checkin").alias("record"))
    for name, rows, order in [*((n, r, [F.lit(0)]) for n, r in s.ones.items()), *((n, *r) for n, r in s.lists.items())]:
        out = out.unionByName(rows.select(F.lit(name).alias("section"), F.array(*[o.cast("long") for o in order]).alias("place"), F.col("id").cast("long").alias("id"), json(rows).alias("record")))
    return out


def briefing(t: dict[str, DataFrame], today: str) -> DataFrame:
    """One row, one person's document: days_since_checkin, cadence_note, last_checkin, profile, concerns, goals, protocols,
    plan, pending, recent, unknowns, today. Over a registry of many people take briefing_rows()."""
    day = F.lit(today).cast("date")
    s = sections(t, day)
    parts = {n: _one(r, n) for n, r in s.ones.items()} | {n: _section(r, n, *order) for n, (r, order) in s.lists.items()}
    out = s.head
    for n in ("profile", "concerns", "goals", "protocols", "plan", "pending", "recent", "unknowns"):
        out = out.crossJoin(parts[n])  # one row each
    return out.withColumn("today", day)


def as_json(rows: DataFrame) -> DataFrame:
    """Each row as one indented JSON document."""
    return rows.select(F.to_json(F.struct(*rows.columns), {"pretty": "true", "ignoreNullFields": "false"}).alias("document"))
