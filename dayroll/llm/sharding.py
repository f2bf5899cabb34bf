"""Sharding by histogram sort: sizes below candidate key boundaries are counted exactly over all partitions, the
candidates are refined until every boundary meets its tolerance, and rows are exchanged once.

The key is (hash of the text, id), so equal texts are neighbours. Boundaries fall between hashes where that is near
enough; inside a group of equal texts only where the group is too large for that. Only the counts below the candidates
come to the driver: candidates x boundaries, whatever the input.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, free_names, written

SIGN = np.uint64(1 << 63)
LOW = 1 << 64
NAMES = ["place", "bytes", "rows", "h0", "h1", "l0", "l1"]
#: Where candidates lie about the interpolated place, in units of the expected error.
SPREAD = (-4.0, -1.0, -0.3, -0.08, 0.08, 0.3, 1.0, 4.0)


def _unsigned(x: np.ndarray) -> np.ndarray:
    """Signed 64-bit integers in their order as unsigned ones."""
    return x.astype(np.int64).view(np.uint64) ^ SIGN


def _below(high: np.ndarray, low: np.ndarray, at: np.ndarray, at_low: np.ndarray) -> np.ndarray:
    """For each key (high, low) the number of boundaries (at, at_low), in order, that are not above it."""
    first, last = np.searchsorted(at, high, "left"), np.searchsorted(at, high, "right")
    for i in np.flatnonzero(first < last):  # few: the hash is that of a boundary
        first[i] += np.searchsorted(at_low[first[i] : last[i]], low[i], "right")
    return first


def _split(keys: list[int]) -> tuple[np.ndarray, np.ndarray]:
    return np.array([k >> 64 for k in keys], np.uint64), np.array([k & (LOW - 1) for k in keys], np.uint64)


def _count(digest: DataFrame, keys: list[int]) -> list[tuple[int, int, int, int, int, int]]:
    """Between each two of these keys: exact bytes and rows, and the least and greatest hash and id there."""
    at, at_low = _split(keys)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            high, low, size = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            place = _below(_unsigned(high), _unsigned(low), at, at_low)
            order = np.argsort(place, kind="stable")
            starts = np.flatnonzero(np.diff(place[order], prepend=-1))
            if len(starts):
                per = [np.add.reduceat(size[order], starts), np.diff(starts, append=len(order)), *(f.reduceat(x[order], starts) for x in (high, low) for f in (np.minimum, np.maximum))]
                yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (place[order][starts], *per)], NAMES)

    sums = [F.sum("bytes"), F.sum("rows"), F.min("h0"), F.max("h1"), F.min("l0"), F.max("l1")]
    found = {r[0]: tuple(r[1:]) for r in digest.select("high", "low", "size").mapInArrow(count, ", ".join(f"{n} long" for n in NAMES)).groupBy("place").agg(*sums).collect()}
    return [found.get(i, (0, 0, 0, 0, 0, 0)) for i in range(len(keys) + 1)]


class Span:
    """The rows between two keys: what lies below each, and the least and greatest hash and id between them."""

    def __init__(self, lo: tuple[int, int, int], hi: tuple[int, int, int], ends: tuple[int, int, int, int]):
        self.lo, self.hi = lo, hi
        self.h0, self.h1, self.l0, self.l1 = (x + (1 << 63) for x in ends)

    def nearest(self, target: float) -> tuple[int, int, int]:
        return min(self.lo, self.hi, key=lambda x: abs(x[1] - target))

    def candidates(self, target: float) -> list[int]:
        """Keys with rows on both sides, around where the target should lie: whole hashes as long as there is more than one, then ids."""
        if self.h0 < self.h1:
            unit, a, b = LOW, self.h0 + 1, self.h1
        else:
            unit, a, b = 1, self.h0 * LOW + self.l0 + 1, self.h0 * LOW + self.l1
        if a > b:
            return []
        place = (target - self.lo[1]) / max(1, self.hi[1] - self.lo[1])
        error = 1.5 / max(1, self.hi[2] - self.lo[2]) ** 0.5
        spots = [0.0, 0.5, 1.0, *(min(1.0, max(0.0, place + error * s)) for s in SPREAD)]
        return [unit * min(b, a + int((b - a) * s)) for s in spots]


def boundaries(digest: DataFrame, parts: int, fine: int, tolerance: float, group_tolerance: float) -> tuple[list[int], list[int]]:
    """parts * fine - 1 keys that cut the rows into runs of near equal bytes, and the rows below each.

    Every fine-th boundary lies within tolerance (a share of a part's bytes) of its place, or within group_tolerance if it
    lies between hashes, or is the nearest there is between two keys; the others are near enough for the work.
    """
    n = parts * fine - 1
    size, rows, *ends = _count(digest, [])[0]
    target = [size * (i + 1) / (n + 1) for i in range(n)]
    spans = [Span((0, 0, 0), (LOW * LOW, size, rows), ends)] * n
    chosen: dict[int, tuple[int, int, int]] = {}
    while True:
        probes: set[int] = set()
        for i, span in enumerate(spans):
            if i in chosen:
                continue
            x = span.nearest(target[i])
            off = abs(x[1] - target[i]) / max(1, size / parts)
            if (i + 1) % fine:
                done = off <= 0.2 / fine
            else:
                done = off <= (group_tolerance if x[0] % LOW == 0 else tolerance)
            if done or not (new := span.candidates(target[i])):
                chosen[i] = x
            else:
                probes.update(new, (k for k in (span.lo[0], span.hi[0]) if 0 < k < LOW * LOW))
        if not probes:
            break
        keys = sorted(probes)
        counted = _count(digest, keys)
        below = np.cumsum([c[:2] for c in counted], axis=0)
        known = [(k, int(x), int(y)) for k, (x, y) in zip(keys, below)]
        at = below[:-1, 0]
        for i, span in enumerate(spans):
            if i not in chosen:
                j = int(np.searchsorted(at, target[i], "right"))
                spans[i] = Span(known[j - 1] if j else span.lo, known[j] if j < len(keys) else span.hi, counted[j][2:])
    found = [chosen[i] for i in range(n)]
    for i in range(1, n):  # coarse ones may have overtaken each other
        found[i] = max(found[i], found[i - 1])
    return [min(x[0], LOW * LOW - 1) for x in found], [x[2] for x in found]


def shard_by_bytes(docs: DataFrame, shards: int, size: str = "size", id_col: str = "doc_id", hash_col: str = "text_hash", fine: int = 32, tolerance: float = 0.001, group_tolerance: float = 0.004) -> DataFrame:
    """docs with shard (int, 0 to shards - 1) and slot (long, gapless from 0 in each shard).

    size, hash_col and id_col name a row's bytes, its text's 64-bit hash and its id; all other columns are carried along.
    Null sizes, hashes and ids count as 0, 0 and the least id. Rows alike in hash and id stay together in one run, in any
    order; empty tables give empty results; with fewer rows than shards some shards stay empty. Columns of docs called
    shard or slot are replaced. Each of the shards x fine runs is one task's work and is sized by bytes, so no group of
    equal texts is a task of its own; a row's slot is the exact number of rows in the runs before plus its place in its run.
    """
    docs = docs.drop("shard", "slot")
    h, low, place = free_names(docs, "high", "low", "at")
    high_of, low_of = F.coalesce(F.col(hash_col), F.lit(0)).cast("long"), F.coalesce(F.col(id_col), F.lit(-(1 << 63))).cast("long")
    digest = written(docs.select(high_of.alias("high"), low_of.alias("low"), F.coalesce(F.col(size), F.lit(0)).cast("long").alias("size")), "shard-digest")
    fine = max(1, min(fine, digest.count() // (64 * shards)))  # a run shorter than that is not worth a task
    keys, below = boundaries(digest, shards, fine, tolerance, group_tolerance)
    at, at_low = _split(keys)
    rows = np.array([0, *below], np.int64)
    base = rows - rows[np.arange(len(rows)) // fine * fine]

    @F.pandas_udf("run int, shard int, base long")
    def run(high, low):  # noqa: ANN001, ANN202
        import pandas as pd

        r = _below(_unsigned(high.to_numpy()), _unsigned(low.to_numpy()), at, at_low)
        return pd.DataFrame({"run": r.astype(np.int32), "shard": (r // fine).astype(np.int32), "base": base[r]})

    forget(digest)
    placed = docs.withColumns({h: high_of, low: low_of}).withColumn(place, run(F.col(h), F.col(low)))
    within = Window.partitionBy(f"{place}.run").orderBy(h, low)
    return placed.withColumns({"shard": F.col(f"{place}.shard"), "slot": F.col(f"{place}.base") + F.row_number().over(within) - 1}).drop(place, h, low)


def shard_documents(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), **how) -> DataFrame:
    """Shards of documents by bytes: id, size (UTF-8 bytes of the text plus 8; a null text has none), text_crc32, law, shard, slot, grown_shard (null under this law) and the columns named by carry."""
    text = F.coalesce(docs[text_col], F.lit(""))
    th, *names = free_names(docs, "text_hash", *carry)
    own = docs.select(docs[id_col], (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias(th), *[docs[c].alias(n) for c, n in zip(carry, names)])
    placed = shard_by_bytes(own, shards, "size", id_col, th, **how)
    return placed.select(id_col, "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), *[F.col(n).alias(c) for c, n in zip(carry, names)])


def write_shards(docs: DataFrame, path: str, shards: int = 24, **how) -> None:
    """Whole rows of docs as Parquet under path/shard=N; the rows of a run make one file, in slot order."""
    carry = tuple(c for c in docs.columns if c not in ("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"))
    shard_documents(docs, shards, carry=carry, **how).write.partitionBy("shard").parquet(path)
