"""Nights that grow: sleep segments extend what the store keeps of a night, without the readings it was made from."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.intervals import extended, hours_of, stage_rows
from ..sources.store import ConflictError, Store
from .push import ATTEMPTS

KEYS = ("kind", "day")


def extend_nights(store: Store, segments: DataFrame) -> int:
    """Merge segments (stage_kind, asleep, day, from_s, to_s) into the store's night_pieces as one new version, which reads and
    writes the months that they touch; its number. If another writer was faster, they are merged into what that one left."""
    rows = stage_rows(segments).where("to_s > from_s")
    parts = store.parts_of(rows.select("day"))
    for attempt in range(ATTEMPTS):
        base = store.version()
        try:
            return store.commit({"night_pieces": extended(store.read("night_pieces", base, parts), rows, KEYS)}, base, parts)
        except ConflictError:
            if attempt + 1 == ATTEMPTS:
                raise


def night_hours(store: Store, version: int | None = None) -> DataFrame:
    """kind, day, hours, pieces of the nights that are kept."""
    return hours_of(store.read("night_pieces", version), KEYS)
