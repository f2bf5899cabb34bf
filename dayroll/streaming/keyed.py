"""Pushes as keyed state: for each kind and day the stream itself holds the last row and its place, so files may come in any order.

A row counts if its place (file, line, metric, point, stage) is after that of the row held; what comes late changes nothing. Only
rows that change a key are told, so a sink merges changes and never reads state. State lives in the state store and its checkpoint:
a query that is started again goes on where it was. Days may be rewritten at any time, so there is neither a watermark nor an end to a key.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators.state import upsert
from ..plans.push import route
from ..sources.store import ConflictError, Store

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PLACE = "file string, line long, metric int, point int, stage int"
VALUE = "value double, min double, max double, source string"
#: Times that changes are merged anew after another writer's version.
ATTEMPTS = 5


class LastRow(StatefulProcessor):
    """Holds the last row of a key; tells it when it is another."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", f"{PLACE}, {VALUE}")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: ANN001, N802, N803
        held = self.last.get() if self.last.exists() else None
        place = lambda r: (r[0], r[1], r[2], r[3], r[4])
        best = held
        for r in rows:
            row = (r.file, r.line, r.metric, r.point, r.stage, r.value, r.min, r.max, r.source)
            if best is None or place(row) > place(best):
                best = row
        if best is held:
            return
        self.last.update(tuple(best))
        if held is None or tuple(best)[5:] != tuple(held)[5:]:
            yield Row(kind=key[0], day=key[1], value=best[5], min=best[6], max=best[7], source=best[8])

    def close(self) -> None:
        pass


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, block, value) with line in place of block: a number that grows with a line's place in its file. A line of a split
    begins after at least as many bytes as its split does and lines are before it there, so splits' numbers do not meet."""
    at, n = None, 0
    for b in batches:
        lines = []
        for own in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            at, n = own, n + 1 if own == at else 0
            lines.append(own[1] + (own[1] > 0) + n)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lines, pa.int64()), b.column(2)], ["file", "line", "value"])


def placed_points(spark: SparkSession, source: str, **options: str) -> DataFrame:
    """The stored points of payload files (one payload a line) as a stream: kind, day, value, min, max, source, and their place.

    A file is read in splits, by many tasks."""
    lines = spark.readStream.format("text").options(**options).option("lineSep", "\n").load(source).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    payloads = lines.mapInArrow(_numbered, "file string, line long, value string").select("value", F.struct("file", "line").alias("at"))
    stored = route(payloads, "value", "at").stored
    at = "pos.pos._batch.{0}"
    place = [F.col(at.format("file")).alias("file"), F.col(at.format("line")).alias("line"), F.col("pos.pos._m").alias("metric"), F.col("pos.pos._p").alias("point"), F.col("pos.stage_pos").alias("stage")]
    return stored.select("kind", "day", "value", "min", "max", "source", *place)


def _last_of_each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each batch the last row of each key."""
    for b in batches:
        rows = b.select(["kind", "day", "file", "line", "metric", "point", "stage"]).to_pandas()
        kept = rows.sort_values(["file", "line", "metric", "point", "stage"]).drop_duplicates(["kind", "day"], keep="last").index
        yield b.take(pa.array(kept.to_numpy()))


def changed_rows(points: DataFrame) -> DataFrame:
    """The stream of rows that become a key's last: kind, day, value, min, max, source. A hot key's rows are fewer before they are shuffled."""
    last = points.mapInArrow(_last_of_each, points.schema)
    return last.groupBy("kind", "day").transformWithState(LastRow(), f"kind string, day date, {VALUE}", "Update", "None")


def stream_changes(spark: SparkSession, source: str, store: Store, checkpoint: str, now: str, on_changes=None, **options: str) -> StreamingQuery:  # noqa: ANN001
    """Merge the changes of each micro-batch into the store, which writes the months that they touch; on_changes gets (batch id, rows changed).
    A batch that is run again merges the same rows again. options are those of the file source."""
    own = spark.newSession()  # the state store's provider is a setting of the session
    own.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    at = F.lit(now).cast("timestamp")

    def merge(batch: DataFrame, n: int) -> None:
        batch = batch.persist()  # it is read for its months and for its rows
        try:
            count = batch.count()
            parts = store.parts_of(batch.select("day"))
            for attempt in range(ATTEMPTS if count else 0):
                base = store.version()
                new = batch.withColumns({"created_at": at, "updated_at": at})
                try:
                    store.commit({"daily_metric": upsert(store.read("daily_metric", base, parts), new, ("kind", "day"), ("created_at",))}, base, parts)
                    break
                except ConflictError:
                    if attempt + 1 == ATTEMPTS:
                        raise
        finally:
            batch.unpersist()
        if on_changes:
            on_changes(n, count)

    return changed_rows(placed_points(own, source, **options)).writeStream.foreachBatch(merge).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
