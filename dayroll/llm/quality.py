"""Text quality by nearest-neighbour voting in a latent-semantic space.

Terms of a text are hashed byte trigrams, shapes of words and repetitions. Their weighted frequencies are projected on the
leading singular vectors of a bounded labelled sample; that sample's vectors are broadcast. Every text is compared with all
of them, exactly, in blocks of cosine products, and its nearest neighbours vote with their similarities.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytewords import BLANK, Block, blocks, mix
from .common import labelled_rows

GRAMS, SHAPES = 4096, 128
TERMS = GRAMS + SHAPES
#: Latent dimensions, voting neighbours, and labelled texts that the model is fitted on at most (those least by a hash of the id).
DIMENSIONS, NEIGHBOURS, SAMPLE = 48, 25, 4096
#: Classes of bytes by which word shapes are told: lower, upper, digit, other ASCII, part of another character.
KIND = np.full(256, 3, np.int64)
KIND[97:123], KIND[65:91], KIND[48:58], KIND[128:] = 0, 1, 2, 4


def frequencies(block: Block) -> np.ndarray:
    """Relative frequencies of terms, one row for each text: trigrams and shapes sum to 1 each (0 in an empty text)."""
    data, n = block.bytes.astype(np.uint64), block.n
    out = np.zeros((n, TERMS), np.float32)
    if len(data) >= 3:
        h = (data[:-2] << np.uint64(16)) | (data[1:-1] << np.uint64(8)) | data[2:]
        ok = block.inside[:-2] & block.inside[1:-1] & block.inside[2:]
        text = np.repeat(np.arange(n), block.ends - block.starts + 1)[:-2]
        bucket = (mix(h) >> np.uint64(52)).astype(np.int64)
        out[:, :GRAMS] = np.bincount((text * GRAMS + bucket)[ok], minlength=n * GRAMS).reshape(n, GRAMS)
    begins, ends, text = block.words(~BLANK)
    if len(begins):
        kinds = np.zeros((len(begins), 5), bool)
        for k in range(5):
            total = np.concatenate([[0], np.cumsum(KIND[block.bytes] == k)])
            kinds[:, k] = total[ends] > total[begins]
        length = np.minimum(np.log2(ends - begins).astype(np.int64), 3) // 2
        shape = kinds @ (1 << np.arange(5)) + 32 * length
        h = block.hashes(block.bytes, begins, ends)
        again = np.zeros(len(h), bool)
        again[1:] = (h[1:] == h[:-1]) & (text[1:] == text[:-1])
        shape = np.where(again, SHAPES - 2, shape)
        out[:, GRAMS:] = np.bincount(text * SHAPES + shape, minlength=n * SHAPES).reshape(n, SHAPES)
    for part in (slice(0, GRAMS), slice(GRAMS, TERMS)):
        out[:, part] /= np.maximum(out[:, part].sum(axis=1, keepdims=True), 1)
    return out


def leading(x: np.ndarray, dimensions: int, extra: int = 16, rounds: int = 6, seed: int = 7) -> np.ndarray:
    """The leading right singular vectors of x, by subspace iteration from a fixed start."""
    q = np.random.default_rng(seed).normal(size=(x.shape[1], dimensions + extra)).astype(np.float32)
    for _ in range(rounds):
        q = np.linalg.qr(x.T @ (x @ q))[0] if len(x) else np.linalg.qr(q)[0]
    turn = np.linalg.svd(x @ q, full_matrices=False)[2] if len(x) else np.eye(q.shape[1], dtype=np.float32)
    return np.ascontiguousarray(q @ turn[:dimensions].T) if len(turn) >= dimensions else np.ascontiguousarray(q[:, :dimensions])


class Model:
    """Term weights, projection, labelled vectors and their labels."""

    def __init__(self, texts: pa.Array, labels: np.ndarray, dimensions: int = DIMENSIONS, neighbours: int = NEIGHBOURS):
        self.neighbours, self.labels = neighbours, labels.astype(np.float64)
        raw = np.concatenate([frequencies(b) for _, _, b in blocks(texts)]) if len(texts) else np.zeros((0, TERMS), np.float32)
        present = (raw > 0).sum(axis=0)
        self.weight = np.log((len(raw) + 1) / (present + 1)).astype(np.float32) + np.float32(0.1)
        x = self._weighted(raw)
        self.projection = leading(x, dimensions)
        self.vectors = self._unit(x @ self.projection)
        self.share = float(labels.mean()) if len(labels) else 0.5

    def _weighted(self, raw: np.ndarray) -> np.ndarray:
        x = np.sqrt(raw) * self.weight
        for part in (slice(0, GRAMS), slice(GRAMS, TERMS)):
            x[:, part] /= np.maximum(np.linalg.norm(x[:, part], axis=1, keepdims=True), 1e-9)
        return x

    @staticmethod
    def _unit(x: np.ndarray) -> np.ndarray:
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)

    def scores(self, texts: pa.Array) -> np.ndarray:
        out = []
        k = min(self.neighbours, len(self.labels))
        for _, _, block in blocks(texts):
            x = self._unit(self._weighted(frequencies(block)) @ self.projection)
            for i in range(0, len(x), 256):
                if not k:
                    out.append(np.full(len(x[i : i + 256]), self.share))
                    continue
                cosine = x[i : i + 256] @ self.vectors.T
                least = np.partition(cosine, -k, axis=1)[:, -k, None]  # all that are as near as the last neighbour vote too
                weight = np.where(cosine >= least, np.maximum(cosine, 0), 0).astype(np.float64) ** 4
                # what has no likeness to any labelled text gets the share of the sample
                out.append((weight @ self.labels + 1e-6 * self.share) / (weight.sum(axis=1) + 1e-6))
        return np.clip(np.concatenate(out), 0, 1) if out else np.zeros(0)


def fit_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """The model of a bounded sample of labelled rows, and of LABELLED_BYTES of their texts: rows whose label is null, or whose id's crc32 modulo 4 is 2, are not learnt from."""
    usable = labels.select(labels[id_col].alias("_id"), labels[label_col].cast("int").alias("_y")).where(F.col("_y").isin(0, 1) & (F.crc32(F.col("_id").cast("string")) % 4 != 2)).dropDuplicates(["_id"])
    chosen = usable.orderBy(F.xxhash64("_id"), "_id").limit(sample)
    return Model(*labelled_rows(docs, chosen, id_col, text_col))


def score_quality(docs: DataFrame, model: Model, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id, held_out, score (higher: better), predicted.

    Null and empty texts are like no labelled text and get about the sample's share; a null id counts as not held out and
    stays null; repeated rows stay; other columns are ignored. A narrow pass: no shuffle; what is broadcast has a fixed
    bound (SAMPLE vectors of DIMENSIONS, TERMS x DIMENSIONS for the projection: about 1.6 MB).
    """
    own = docs.select(docs[id_col], F.coalesce(F.crc32(docs[id_col].cast("string")) % 4 == 2, F.lit(False)).alias("held_out"), docs[text_col].alias("_text"))
    kind = docs.schema[id_col].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores = model.scores(b.column(2))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(scores), pa.array((scores >= threshold).astype(np.int32))], [id_col, "held_out", "score", "predicted"])

    return own.mapInArrow(score, f"{id_col} {kind}, held_out boolean, score double, predicted int")
