"""Embedding near-duplicates by randomised-rotation binary codes.

Unit vectors are rotated at random. What is stored of a vector are PLANES bits of each rotated coordinate, packed plane by
plane, and its correction, which is the inner product of the vector with its code; and, for the other side of an estimate, one
bit more, which rounds a coordinate up or down at random so that it is right on average. A code against another vector's
rounded coordinates is a product of small whole numbers; divided by the correction it is an unbiased estimate of the cosine.

Codes alone are shuffled to find the pairs whose confidence bound reaches the threshold: vectors of a label are dealt to
blocks of bounded size, each two blocks are one group's work, and a group tells which of its vectors have such a pair. Large
labels are parted into cells around some of their vectors, and a vector meets those cells alone that may hold one within the
threshold's angle, whatever the vectors in between. The vectors that have a candidate then meet with their components, and the
pairs are computed again, exactly, in double precision. A group returns no pairs: for each vector the number of its links and
the least vector it reaches there, so dense groups of copies give as many rows as they have vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bytewords import mix
from .common import forget, written
from .components import components

#: Vectors of a block of codes and of a block of exact products (the means), bits of a coordinate, the half width of the
#: confidence bound in standard errors, and the dimension below which the bound is not relied on: all pairs are candidates.
CODES, BLOCK, PLANES, WIDTH, FEW = 4096, 1024, 6, 4.5, 8
#: Cells of a label at most, and components of all cells' centres together, which every task holds: labels beyond have one cell.
CELLS, CENTRES = 64, 2_000_000


def rotation(dimension: int, seed: int = 11) -> np.ndarray:
    return np.linalg.qr(np.random.default_rng(seed).normal(size=(dimension, dimension)))[0]


def unit_rows(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


class Codes:
    """Of some vectors: level (of each coordinate, from 0 on), up (is it rounded up on the other side?), correction, norm of
    the code, low and step of the levels. A code has the middle of each coordinate's level."""

    def __init__(self, level: np.ndarray, up: np.ndarray, correction: np.ndarray, norm: np.ndarray, low: np.ndarray, step: np.ndarray):
        self.level, self.up, self.correction, self.norm, self.low, self.step = level, up, correction, norm, low, step

    @classmethod
    def of(cls, unit: np.ndarray, turn: np.ndarray, seeds: np.ndarray) -> Codes:
        """seeds: what a vector's rounding follows from, so that a task run again gives the same codes."""
        turned = unit @ turn.T
        d = turned.shape[1]
        low, high = turned.min(axis=1), turned.max(axis=1)
        step = np.maximum((high - low) / (1 << PLANES), 1e-12)
        exact = (turned - low[:, None]) / step[:, None]
        level = np.clip(np.floor(exact), 0, (1 << PLANES) - 1).astype(np.uint8)
        dither = mix(seeds.astype(np.uint64)[:, None] + np.arange(1, d + 1, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)) / 2.0**64
        code = low[:, None] + step[:, None] * (level + 0.5)
        return cls(level, exact - level > dither, np.maximum((code * turned).sum(axis=1), 1e-6), np.linalg.norm(code, axis=1), low, step)

    def bytes_of(self) -> list[bytes]:
        """Each vector's planes, bit by bit, the plane of what is rounded up, correction, norm, low and step."""
        planes = np.stack([*[(self.level >> k & 1).astype(bool) for k in range(PLANES)], self.up], axis=1)
        bits = np.packbits(planes, axis=-1, bitorder="little").reshape(len(self.level), -1)
        numbers = np.ascontiguousarray(np.stack([self.correction, self.norm, self.low, self.step], axis=1)).view(np.uint8).reshape(len(self.level), -1)
        return [x.tobytes() for x in np.concatenate([bits, numbers], axis=1)]

    @classmethod
    def read(cls, column: pa.Array, dimension: int) -> Codes:
        rows = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)
        numbers = np.ascontiguousarray(rows[:, -32:]).view(np.float64)
        planes = np.unpackbits(rows[:, :-32].reshape(len(rows), PLANES + 1, -1), axis=-1, bitorder="little")[..., :dimension]
        level = sum(planes[:, k] << np.uint8(k) for k in range(PLANES))
        return cls(level, planes[:, PLANES].astype(bool), *(numbers[:, k] for k in range(4)))

    def take(self, at: np.ndarray | slice) -> Codes:
        return Codes(self.level[at], self.up[at], self.correction[at], self.norm[at], self.low[at], self.step[at])

    def estimates(self, other: Codes) -> np.ndarray:
        """Unbiased estimates of the cosines of these vectors (by their codes) with others (by their rounded coordinates)."""
        d = self.level.shape[1]
        kind = np.float32 if d << 2 * PLANES < 1 << 24 else np.float64  # whole numbers, exact in either
        rounded = other.level.astype(kind) + other.up
        product = (self.level.astype(kind) @ rounded.T).astype(np.float64)
        over, own = rounded.sum(axis=1, dtype=np.float64), self.level.sum(axis=1, dtype=np.float64) + d / 2
        # (low + step * (level + 1/2)) times (low' + step' * rounded), coordinate by coordinate
        whole = self.low[:, None] * (d * other.low + other.step * over) + self.step[:, None] * (own[:, None] * other.low + other.step * (product + over / 2))
        return whole / self.correction[:, None]

    def errors(self, other: Codes) -> np.ndarray:
        """Standard errors of these estimates at most: of the code, and of the other side's rounding."""
        d = self.level.shape[1]
        if d < FEW:
            return np.full((len(self.level), len(other.level)), np.inf)
        tangent = ((self.norm / self.correction) ** 2 - 1).clip(0) / (d - 1)
        return np.sqrt(tangent[:, None] + (self.norm / self.correction)[:, None] ** 2 * (other.step**2 / 4)[None, :])

    def candidates(self, other: Codes, threshold: float) -> np.ndarray:
        """Which pairs' bound reaches the threshold."""
        return self.estimates(other) + WIDTH * self.errors(other) >= threshold


def _roots(n: int, i: np.ndarray, j: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For each of n nodes the least id it is connected to by the pairs (i, j)."""
    least = ids.copy()
    while True:
        low = np.minimum(least[i], least[j])
        new = least.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        if (new == least).all():
            return least
        least = new


def paired(left: Codes, right: Codes, same: bool, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Which vectors of the left and of the right side have a candidate on the other."""
    has_left, has_right = np.zeros(len(left.level), bool), np.zeros(len(right.level), bool)
    for k in range(0, len(has_left), 512):
        found = left.take(slice(k, k + 512)).candidates(right, threshold)
        if same:
            i = np.arange(len(found))
            found[i, i + k] = False
        has_left[k : k + 512] = found.any(axis=1)
        has_right |= found.any(axis=0)
    return has_left, has_right


def link_blocks(unit: tuple[np.ndarray, np.ndarray], codes: tuple[Codes, Codes], ids: tuple[np.ndarray, np.ndarray], sizes: tuple[np.ndarray, np.ndarray], same: bool, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids, links and reached ids of the vectors of two blocks (or of one with itself) that link: candidates are computed again, exactly."""
    kept: list[tuple[np.ndarray, np.ndarray]] = []
    for k in range(0, len(unit[0]), 256):
        i, j = np.nonzero(codes[0].take(slice(k, k + 256)).candidates(codes[1], threshold))
        i = i + k
        if same:
            i, j = i[i < j], j[i < j]
        for s in range(0, len(i), 65536):
            a, b = i[s : s + 65536], j[s : s + 65536]
            ok = np.einsum("nd,nd->n", unit[0][a], unit[1][b]) >= threshold
            kept.append((a[ok], b[ok]))
    if not kept:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    i, j = (np.concatenate(x) for x in zip(*kept))
    if same:
        all_ids, size = ids[0], sizes[0]
    else:
        all_ids, size, j = np.concatenate(ids), np.concatenate(sizes), j + len(ids[0])
    links = np.bincount(i, size[j], len(all_ids)) + np.bincount(j, size[i], len(all_ids))
    on = np.flatnonzero(links)
    return all_ids[on], links[on].astype(np.int64), _roots(len(all_ids), i, j, all_ids)[on]


def _by_label(b: pa.RecordBatch) -> Iterator[tuple[tuple, np.ndarray, np.ndarray]]:
    """Of a batch with l, d and v: each label and dimension, its rows and their unit vectors."""
    label, d = (b.column(b.schema.get_field_index(c)).to_pylist() for c in ("l", "d"))
    vectors = b.column(b.schema.get_field_index("v"))
    at: dict[tuple, list[int]] = {}
    for i, key in enumerate(zip(label, d)):
        at.setdefault(key, []).append(i)
    for key, rows in at.items():
        yield key, np.array(rows), unit_rows(vectors.take(pa.array(rows)).flatten().to_numpy().reshape(len(rows), key[1]))


def with_codes(rows: DataFrame, centres: dict[tuple, np.ndarray]) -> DataFrame:
    """rows (v, l, d, h) with code: what is stored of each vector beside it; cell: of its label's centres the nearest; and wide, its angle with that."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns: dict[int, np.ndarray] = {}
        for b in batches:
            h = b.column(b.schema.get_field_index("h")).to_numpy()
            code, cell, wide = np.empty(len(h), object), np.zeros(len(h), np.int32), np.zeros(len(h))
            for key, at, x in _by_label(b):
                if key[1] not in turns:
                    turns[key[1]] = rotation(key[1])
                code[at] = Codes.of(x, turns[key[1]], h[at].view(np.uint64)).bytes_of()
                if key in centres:
                    near = x @ centres[key].T
                    cell[at], wide[at] = near.argmax(axis=1), np.arccos(near.max(axis=1).clip(-1, 1))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(code, pa.binary()), pa.array(cell), pa.array(wide)], [*b.schema.names, "code", "cell", "wide"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(encode, f"{kinds}, code binary, cell int, wide double")


def cell_centres(rows: DataFrame) -> dict[tuple, np.ndarray]:
    """Centres of the labels that fill more than one block, largest first: some of their vectors, chosen by a hash."""
    large = rows.groupBy("l", "d").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > CODES).orderBy(F.desc("n"), "d", "l").limit(CENTRES // CELLS).collect()
    kept, room = {}, CENTRES
    for r in large:
        k = min(CELLS, 2 * -(-r.n // CODES))
        if (room := room - k * r.d) < 0:
            break
        kept[r.l, r.d] = k
    if not kept:
        return {}
    sizes = rows.sparkSession.createDataFrame([(l, d, k) for (l, d), k in kept.items()], f"l {rows.schema['l'].dataType.simpleString()}, d int, k int")
    chosen = rows.join(F.broadcast(sizes), ["l", "d"]).withColumn("r", F.row_number().over(Window.partitionBy("l", "d").orderBy(F.xxhash64("h", F.lit(5)), "h"))).where(f"r <= {CELLS} AND r <= k")
    found: dict[tuple, list] = {}
    for r in chosen.select("l", "d", "v").collect():
        found.setdefault((r.l, r.d), []).append(r.v)
    return {key: unit_rows(np.array(v)) for key, v in found.items()}


def with_near_cells(rows: DataFrame, centres: dict[tuple, np.ndarray], threshold: float) -> DataFrame:
    """rows with near: the cells of their label that may hold a vector within the threshold's angle of theirs, their own too."""
    if not centres:
        return rows.withColumn("near", F.array(F.lit(0)))
    widest: dict[tuple, np.ndarray] = {key: np.full(len(c), -np.inf) for key, c in centres.items()}
    for r in rows.groupBy("l", "d", "cell").agg(F.max("wide").alias("w")).where("w > 0").join(F.broadcast(rows.sparkSession.createDataFrame([k for k in centres], f"l {rows.schema['l'].dataType.simpleString()}, d int")), ["l", "d"]).collect():
        widest[r.l, r.d][r.cell] = r.w  # a row for each cell
    angle = float(np.arccos(min(1.0, max(-1.0, threshold)))) + 1e-6

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list[int]] = [[0]] * b.num_rows
            cell = b.column(b.schema.get_field_index("cell")).to_numpy()
            for key, at, x in _by_label(b):
                if key in centres:
                    reach = np.arccos((x @ centres[key].T).clip(-1, 1)) <= np.maximum(widest[key], 0) + angle
                    reach[np.arange(len(at)), cell[at]] = True
                    for i, own in zip(at.tolist(), reach):
                        out[i] = np.flatnonzero(own).tolist()
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.list_(pa.int32()))], [*b.schema.names, "near"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(near, f"{kinds}, near array<int>")


def _block_pairs(rows: DataFrame, size: int) -> DataFrame:
    """rows once for each block of a cell near them that their own block meets: a and b, the two blocks, and at, the own one. A block's number is its cell's and its own in that."""
    per = rows.groupBy("l", "d", "cell").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias("blocks"))
    block = lambda cell, n: (F.col(cell).cast("long") * (1 << 32) + n).alias("block")
    dealt = rows.join(per, ["l", "d", "cell"]).withColumn("at", block("cell", F.pmod("h", F.col("blocks")))).drop("blocks").withColumn("to", F.explode("near"))
    dealt = dealt.join(per.withColumnsRenamed({"cell": "to", "blocks": "others"}), ["l", "d", "to"])
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("others") - 1))).withColumn("other", block("to", F.col("other")))
    return dealt.withColumns({"a": F.least("at", "other"), "b": F.greatest("at", "other")}).drop("other", "others", "to", "near", "cell")


def _sides(group: pa.Table) -> tuple[bool, np.ndarray, np.ndarray]:
    at, a, b = group["at"].to_numpy(), group["a"][0].as_py(), group["b"][0].as_py()
    return a == b, np.flatnonzero(at == a), np.flatnonzero(at == b)


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row for each row of vectors: id, n_links, component_id, kept.

    Rows link if their labels are equal and not null and their cosine reaches the threshold. Vectors that are null, empty,
    zero or hold null or non-finite components, and rows with a null id, link with nothing (their component is their own id,
    and they are kept). Vectors of different lengths don't link. Equal vectors of a label are one class, whose members link
    with each other. Rows with equal ids are one node of the graph, whose links they share, but each counts as a vector. Other columns are ignored.

    Work is quadratic in a label's distinct vectors as far as these lie in cells near each other, in blocks of bounded size. Each
    code (PLANES + 1 bits for each coordinate, and four numbers) is shuffled once for each CODES vectors of the cells that may hold
    a partner of it; components are shuffled only of vectors that have a candidate. Nothing grows with the number of links. A link whose estimate lies
    more than WIDTH standard errors below its cosine is missed: fewer than one in a hundred thousand.
    """
    v = F.col("v")
    fine = F.col("l").isNotNull() & F.col("id").isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(vectors[id_col].alias("id"), F.transform(vectors[vector_col], lambda x: x.cast("double")).alias("v"), vectors[label_col].alias("l"))
    rows = rows.select("id", F.when(fine, v).alias("v"), F.when(fine, F.col("l")).alias("l"))
    # many exact copies of one vector meet as a count and a least id
    classes = rows.where(F.col("v").isNotNull()).groupBy("l", "v").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n"))
    classes = classes.select("l", "v", F.col("rep").cast("long").alias("rep"), "n", F.size("v").alias("d"), F.xxhash64("rep", "v").alias("h"))
    plain = written(classes, "classes")
    centres = cell_centres(plain)
    classes = written(with_codes(plain, centres), "vectors")
    forget(plain)
    coded = with_near_cells(classes, centres, threshold)

    def pair(group: pa.Table) -> pa.Table:
        same, first, second = _sides(group)
        codes, h = Codes.read(group["code"].combine_chunks(), group["d"][0].as_py()), group["h"].to_numpy()
        has = paired(codes.take(first), codes.take(second), same, threshold)
        found = np.unique(np.concatenate([h[first][has[0]], h[second][has[1]]]))
        return pa.table({"h": pa.array(found, pa.int64())})

    some = _block_pairs(coded.select("l", "d", "h", "code", "cell", "near"), CODES).groupBy("l", "d", "a", "b").applyInArrow(pair, "h long").distinct()

    def link(group: pa.Table) -> pa.Table:
        same, first, second = _sides(group)
        d = group["d"][0].as_py()
        x = unit_rows(group["v"].combine_chunks().flatten().to_numpy().reshape(group.num_rows, d))
        codes, ids, n = Codes.read(group["code"].combine_chunks(), d), group["rep"].to_numpy(), group["n"].to_numpy()
        both = lambda c: (c[first], c[second])
        found = link_blocks(both(x), (codes.take(first), codes.take(second)), both(ids), both(n), same, threshold)
        return pa.table({"rep": pa.array(found[0], pa.int64()), "links": pa.array(found[1], pa.int64()), "reach": pa.array(found[2], pa.int64())})

    near = written(coded.drop("wide").join(some, "h", "left_semi"), "near-vectors")
    linked = written(_block_pairs(near, BLOCK).groupBy("l", "d", "a", "b").applyInArrow(link, "rep long, links long, reach long"), "links")
    forget(near)
    joined = components(linked.select(F.col("rep").alias("a"), F.col("reach").alias("b")))
    links = linked.groupBy("rep").agg(F.sum("links").alias("links"))
    own = classes.join(links, "rep", "left").select("l", "v", "rep", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"))
    out = rows.join(own, ["l", "v"], "left").join(joined, F.col("rep") == F.col("node"), "left")
    return out.select(
        F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component", "rep", "id").cast("long").alias("component_id"), F.coalesce(F.col("id") == F.coalesce("component", "rep", "id"), F.lit(True)).alias("kept"),
    )
