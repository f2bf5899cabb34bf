"""Keyed state: whole-row last-write-wins, replacement, retirement and set difference, as joins over snapshots."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import vocab as V


def last_write(rows: DataFrame, keys: tuple[str, ...], *order: str) -> DataFrame:
    """The last row of each key by order. A pre-aggregated max of whole rows, so a hot key is no window of its own."""
    rest = [c for c in rows.columns if c not in keys]
    at = F.struct(*order)
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), at).alias("_row")).select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])


def upsert(state: DataFrame, incoming: DataFrame, keys: tuple[str, ...], kept: tuple[str, ...] = ()) -> DataFrame:
    """state with incoming rows (one for each key) in place of their own keys'. Whole rows replace whole rows: what an incoming
    row leaves null becomes null; only the columns named by kept are the old row's where there was one."""
    cols = [c for c in state.columns if c not in keys]
    old = state.select(*keys, F.struct(*cols).alias("_old"))
    new = incoming.select(*keys, F.struct(*[F.col(c) if c in incoming.columns else F.lit(None).cast(state.schema[c].dataType).alias(c) for c in cols]).alias("_new"))
    both = old.join(new, list(keys), "full_outer")
    value = lambda c: F.coalesce(F.col(f"_old.{c}"), F.col(f"_new.{c}")) if c in kept else F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(f"_old.{c}"))
    return both.select(*[F.col(c) if c in keys else value(c).alias(c) for c in state.columns])


def prior(state: DataFrame, incoming: DataFrame, keys: tuple[str, ...], value: str = "value") -> DataFrame:
    """Keys that an upsert overwrites, with their old and new value."""
    return incoming.select(*keys, F.col(value).alias("new_value")).join(state.select(*keys, F.col(value).alias("old_value")), list(keys))


def replace_rows(state: DataFrame, incoming: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """state without the keys of incoming, and incoming."""
    return state.join(incoming.select(*keys).distinct(), list(keys), "left_anti").unionByName(incoming, allowMissingColumns=True)


def sparse_update(rows: DataFrame, changes: DataFrame, key: str, columns: tuple[str, ...]) -> DataFrame:
    """Columns are untouched, cleared or set: changes has, for each, <column> and <column>_set."""
    c = changes.select(F.col(key).alias("_key"), *[F.col(n).alias(f"_v_{n}") for n in columns], *[F.col(f"{n}_set").alias(f"_s_{n}") for n in columns])
    out = rows.join(c, rows[key] == F.col("_key"), "left")
    return out.select(*[F.when(F.coalesce(F.col(f"_s_{n}"), F.lit(False)), F.col(f"_v_{n}")).otherwise(F.col(n)).alias(n) if n in columns else F.col(n) for n in rows.columns])


def stale(state: DataFrame, produced: DataFrame) -> DataFrame:
    """Rows of a produced kind, inside that kind's own produced days, that were not produced. A kind that is produced no more is not reported."""
    spans = produced.groupBy("kind").agg(F.min("day").alias("_lo"), F.max("day").alias("_hi"))
    inside = state.join(spans, "kind").where(F.col("day").between(F.col("_lo"), F.col("_hi"))).drop("_lo", "_hi")
    return inside.join(produced.select("kind", "day"), ["kind", "day"], "left_anti")


def replace_range(state: DataFrame, produced: DataFrame, asked: bool, closed: bool) -> tuple[DataFrame, bool]:
    """state without stale rows if that was asked for and the document was whole; and whether it was refused."""
    if not (asked and closed):
        return state, asked and not closed
    return state.join(stale(state, produced).select("kind", "day"), ["kind", "day"], "left_anti"), False


def merged_complaints(points: DataFrame) -> DataFrame:
    """One complaint for each (name, day): the first point that was lost altogether, else the first; stored if any was; kinds as first seen.

    points: name, day, point, reason, units, kind, stored, and the order pos (a struct). Kinds of a name are few.
    """
    at = F.struct(F.col("stored"), F.col("pos"))
    kinds = points.where("kind is not null").groupBy("name", "day", "kind").agg(F.min("pos").alias("pos")).groupBy("name", "day").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "kind"))), lambda x: x["kind"]).alias("kinds"))
    kept = points.groupBy("name", "day").agg(F.min_by(F.struct("point", "reason", "units"), at).alias("k"), F.bool_or("stored").alias("stored"))
    return kept.join(kinds, ["name", "day"], "left").select("name", "day", "k.point", "k.reason", "k.units", F.coalesce("kinds", F.array().cast("array<string>")).alias("kinds"), "stored")


def retired(quarantine: DataFrame, settled: DataFrame, complaints: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Quarantine without the keys that were stored cleanly and not complained of, and the rows that went."""
    keys = ["name", "day"]
    clean = settled.select(*keys).distinct().join(complaints.select(*keys), keys, "left_anti")
    return quarantine.join(clean, keys, "left_anti"), quarantine.join(clean, keys, "left_semi")


def swept(quarantine: DataFrame, producer: str = "export") -> tuple[DataFrame, DataFrame]:
    """Quarantine without rows that were refused for their name alone and whose name is known by now, and those rows."""
    names = V.names(quarantine.sparkSession, producer).select("name").unionByName(V.stages(quarantine.sparkSession).select(F.col("stage").alias("name")))
    reason = F.get_json_object("point", "$._import.reason")
    hit = F.col("name").startswith("HK") & (reason.isNull() | reason.isin(*V.NAME_REASONS))
    gone = quarantine.where(hit).join(F.broadcast(names.distinct()), "name", "left_semi")
    return quarantine.join(gone.select("name", "day"), ["name", "day"], "left_anti"), gone


def one_row_per_name(quarantine: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming rows replace every row of their names, whatever its day."""
    return replace_rows(quarantine, incoming, ("name",))


def stamped(point: Column, reason: Column, units: Column, kinds: Column) -> Column:
    """A point's JSON object with an _import member put first; anything but an object is left alone."""
    meta = F.to_json(F.struct(reason.alias("reason"), units.alias("units"), F.when(F.size(kinds) > 0, kinds).alias("kinds")))
    body = F.regexp_replace(F.trim(point), r"^\{\s*", "")
    return F.when(F.trim(point).startswith("{"), F.concat(F.lit('{"_import":'), meta, F.when(body == "}", F.lit("")).otherwise(F.lit(",")), body)).otherwise(point)


def filtered(rows: DataFrame, **scope: object) -> DataFrame:
    """Each scope is a value (equal), None (is null) or ... (any)."""
    tests = [F.col(k).isNull() if v is None else F.col(k) == v for k, v in scope.items() if v is not ...]
    return rows.where(reduce(lambda a, b: a & b, tests)) if tests else rows


def orphans(children: DataFrame, parents: DataFrame, key: str, parent_key: str) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): children whose parent exists, and the others; a null key needs no parent."""
    p = parents.select(F.col(parent_key).alias("_p")).distinct()
    named = children.where(F.col(key).isNotNull())
    accepted = named.join(p, named[key] == F.col("_p"), "left_semi").unionByName(children.where(F.col(key).isNull()))
    return accepted, named.join(p, named[key] == F.col("_p"), "left_anti")
