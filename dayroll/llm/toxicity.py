"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained in numpy.

Each word gives two kinds of input: its row of a table of words, and the sum of the rows of its character n-grams (3 to 5
bytes with the word's edges) over the root of their number. Both tables start empty and are learnt with the network. A text is cut into overlapping windows
of words; both directions run over each, attention weighs their states, and the text's score is that of its worst window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytewords import LETTER, LOWER, Block, blocks, mix
from .common import labelled_rows

#: Words by which windows are shifted; a window has twice as many, so every word is in two.
STRIDE = 16
SPAN = 2 * STRIDE
#: Numbers that a word and its n-grams are represented by, and the inputs that make: both and a constant.
WIDTH = 6
HIDDEN, ATTENTION, INPUTS = 8, 6, 2 * WIDTH + 1
TABLE_BITS = 16
GRAMS = (3, 4, 5)
#: Words whose n-grams are looked up at once, and windows that are scored at once.
WORDS, TOGETHER = 8192, 2048
#: Share of a batch's words that do without their own row while training.
DROPPED = 0.8
#: What the squares of a number's slopes start from: entries that few texts have move little.
START = 1e-6
#: Bytes of text worked on at once where the driver fits the model.
LESS = 400_000


def sigmoid(x: np.ndarray) -> np.ndarray:
    np.negative(x, out=x)
    np.exp(np.minimum(x, 30, out=x), out=x)
    x += 1
    return np.reciprocal(x, out=x)


class Vocabulary:
    """Distinct words: the bucket of each, and the buckets of its n-grams (gram[starts[i] : starts[i + 1]])."""

    def __init__(self, word: np.ndarray, gram: np.ndarray, starts: np.ndarray, hashes: np.ndarray | None = None):
        self.word, self.gram, self.starts, self.hashes = word, gram, starts, hashes

    @classmethod
    def of(cls, block: Block) -> tuple[Vocabulary, np.ndarray, np.ndarray]:
        """The words of a block in lower case, in the order of their hashes; which of them stands at each place, and in which text."""
        data = LOWER[block.bytes]
        begins, ends, text = block.words(LETTER)
        hashes, first, which = np.unique(block.hashes(data, begins, ends), return_index=True, return_inverse=True)
        shift = np.uint64(64 - TABLE_BITS)
        # the distinct words, one blank before and after each, so that edges belong to n-grams
        length = (ends - begins)[first] + 2
        at = np.concatenate([[0], np.cumsum(length)])
        own = np.repeat(np.arange(len(first)), length)
        rank = np.arange(at[-1]) - at[own]
        code = np.full(at[-1], 32, np.uint64)
        inside = (rank > 0) & (rank < length[own] - 1)
        code[inside] = data[(begins[first][own] + rank - 1)[inside]]
        buckets, owners = [], []
        for n in GRAMS:
            m = max(len(code) - n + 1, 0)
            h = np.full(m, n, np.uint64)
            for k in range(n):
                h = h * np.uint64(257) + code[k : k + m]
            fits = rank[:m] + n <= length[own[:m]]
            buckets.append((mix(h[fits]) >> shift).astype(np.int32))
            owners.append(own[:m][fits])
        owner = np.concatenate(owners)
        order = np.argsort(owner, kind="stable")
        starts = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(first)))])
        return cls((mix(hashes) >> shift).astype(np.int32), np.concatenate(buckets)[order], starts, hashes), which, text

    @classmethod
    def joined(cls, parts: list[Vocabulary]) -> Vocabulary:
        length = np.concatenate([np.diff(p.starts) for p in parts])
        return cls(np.concatenate([p.word for p in parts]), np.concatenate([p.gram for p in parts]), np.concatenate([[0], np.cumsum(length)]))

    def take(self, ids: np.ndarray) -> Vocabulary:
        length = np.diff(self.starts)[ids]
        starts = np.concatenate([[0], np.cumsum(length)])
        at = np.arange(starts[-1]) - np.repeat(starts[:-1] - self.starts[ids], length)
        return Vocabulary(self.word[ids], self.gram[at], starts)


class Tables:
    """What words and n-grams are represented by; those that training has not met by zeros."""

    def __init__(self):
        self.word, self.gram = (np.zeros((1 << TABLE_BITS, WIDTH), np.float32) for _ in range(2))
        self._seen: list[np.ndarray] = []

    def inputs(self, words: Vocabulary) -> np.ndarray:
        """An input vector for each word. Every word has an n-gram: with its edges it is three bytes long at least."""
        out = np.ones((len(words.word), INPUTS), np.float32)
        out[:, :WIDTH] = self.word[words.word]
        for i in range(0, len(out), WORDS):
            at = words.starts[i : i + WORDS + 1]
            rows = self.gram[words.gram[at[0] : at[-1]]]
            out[i : i + WORDS, WIDTH : 2 * WIDTH] = np.add.reduceat(rows, at[:-1] - at[0], axis=0) / np.sqrt(np.diff(at)[:, None])
        return out

    def learn(self, words: Vocabulary, slope: np.ndarray, rate: float) -> None:
        """Step against the loss's slope by the words' inputs; each number's steps shrink with what it has moved by."""
        if not self._seen:
            self._seen = [np.full_like(self.word, START), np.full_like(self.gram, START)]
        length = np.diff(words.starts)
        each = np.repeat(slope[:, WIDTH : 2 * WIDTH] / np.sqrt(length[:, None]), length, axis=0)
        for table, seen, bucket, g in ((self.word, self._seen[0], words.word, slope[:, :WIDTH]), (self.gram, self._seen[1], words.gram, each)):
            rows, at = np.unique(bucket, return_inverse=True)
            total = np.stack([np.bincount(at, g[:, k], len(rows)) for k in range(WIDTH)], axis=1).astype(np.float32)
            seen[rows] += total**2
            table[rows] -= rate * total / np.sqrt(seen[rows])

    def finish(self) -> None:
        self._seen = []


def layout(text: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each word goes when each text is padded to whole strides, two at least: the place of each word, the strides at
    which windows begin, and the first window of each text."""
    words = np.bincount(text, minlength=n)
    strides = np.maximum(2, -(-words // STRIDE))
    first = np.concatenate([[0], np.cumsum(strides)])
    rank = np.arange(len(text)) - np.concatenate([[0], np.cumsum(words)])[text]
    place = first[text] * STRIDE + rank
    begin = np.ones(first[-1], bool)
    begin[first[1:] - 1] = False
    return place, np.flatnonzero(begin), first[:-1] - np.arange(n)


class Network:
    """The recurrent network. Parameters by name: W (inputs to gates), U (state to gates), b, for both directions; A, v (attention); c, d (output)."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        g = lambda *s: (r.normal(size=s) / np.sqrt(s[-2])).astype(np.float32)
        self.p = {"W": g(2, INPUTS, 3 * HIDDEN), "U": g(2, HIDDEN, 3 * HIDDEN), "b": np.zeros((2, 3 * HIDDEN), np.float32), "A": g(2 * HIDDEN, ATTENTION), "v": g(ATTENTION, 1)[:, 0], "c": g(2 * HIDDEN, 1)[:, 0], "d": np.zeros(1, np.float32)}

    def _direction(self, x: np.ndarray, k: int, keep: list | None) -> np.ndarray:
        """States of direction k over x (time, windows, 3 * HIDDEN: inputs' part of the gates)."""
        u, h = self.p["U"][k], np.zeros((x.shape[1], HIDDEN), np.float32)
        out = np.empty((x.shape[0], x.shape[1], HIDDEN), np.float32)
        for t in range(x.shape[0]) if k == 0 else range(x.shape[0] - 1, -1, -1):
            hu = h @ u
            zr = sigmoid(x[t, :, : 2 * HIDDEN] + hu[:, : 2 * HIDDEN])
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            n = np.tanh(x[t, :, 2 * HIDDEN :] + r * hu[:, 2 * HIDDEN :])
            if keep is not None:
                keep.append((t, h, z, r, n, hu[:, 2 * HIDDEN :]))
            h = out[t] = n + z * (h - n)
        return out

    def logits(self, x: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Of windows x (time, windows, INPUTS)."""
        p, steps = self.p, ([], []) if keep is not None else (None, None)
        s = np.concatenate([self._direction(x @ p["W"][k] + p["b"][k], k, steps[k]) for k in (0, 1)], axis=2)
        a = np.tanh(s @ p["A"])
        e = a @ p["v"]
        e = np.exp(e - e.max(axis=0))
        w = e / e.sum(axis=0)
        pooled = np.einsum("tn,tnh->nh", w, s)
        if keep is not None:
            keep.update(steps=steps, s=s, a=a, w=w, pooled=pooled)
        return pooled @ p["c"] + p["d"]

    def gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean logistic loss, by the parameters and (as x) by the inputs."""
        p, k = self.p, {}
        out = 1 / (1 + np.exp(-self.logits(x, k)))
        dl = ((out - y) / len(y)).astype(np.float32)
        g = {"d": dl.sum(keepdims=True), "c": k["pooled"].T @ dl}
        dp = dl[:, None] * p["c"]
        s, a, w = k["s"], k["a"], k["w"]
        dw = np.einsum("nh,tnh->tn", dp, s)
        de = w * (dw - (w * dw).sum(axis=0))
        g["v"] = np.einsum("tn,tna->a", de, a)
        da = de[:, :, None] * p["v"] * (1 - a * a)
        g["A"] = np.einsum("tnh,tna->ha", s, da)
        ds = w[:, :, None] * dp + da @ p["A"].T
        g |= {n: np.zeros_like(p[n]) for n in ("W", "U", "b")}
        g["x"] = np.zeros_like(x)
        for d in (0, 1):
            dh = np.zeros((x.shape[1], HIDDEN), np.float32)
            for t, h, z, r, n, hun in reversed(k["steps"][d]):
                dh = dh + ds[t, :, d * HIDDEN : (d + 1) * HIDDEN]
                dn = dh * (1 - z) * (1 - n * n)
                gates = np.concatenate([dh * (h - n) * z * (1 - z), dn * hun * r * (1 - r), dn], axis=1)
                own = np.concatenate([gates[:, : 2 * HIDDEN], dn * r], axis=1)
                g["W"][d] += x[t].T @ gates
                g["x"][t] += gates @ p["W"][d].T
                g["b"][d] += gates.sum(axis=0)
                g["U"][d] += h.T @ own
                dh = dh * z + own @ p["U"][d].T
        return g


class Model:
    """Tables and network. fit() is deterministic: the same rows give the same model."""

    def __init__(self, tables: Tables, network: Network):
        self.tables, self.network = tables, network

    @staticmethod
    def windows(block: Block) -> tuple[Vocabulary, np.ndarray, np.ndarray, np.ndarray]:
        """Words of a block; their numbers in strides (strides, STRIDE; -1 is none), the strides at which windows begin, the first window of each text."""
        words, which, text = Vocabulary.of(block)
        place, begin, first = layout(text, block.n)
        padded = np.full((begin[-1] + 2) * STRIDE, -1, np.int64)
        padded[place] = which
        return words, padded.reshape(-1, STRIDE), begin, first

    @staticmethod
    def gather(strides: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """The windows (SPAN, windows) that begin at these strides."""
        return np.concatenate([strides[begin], strides[begin + 1]], axis=1).T

    def logits(self, inputs: np.ndarray, strides: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """Of the windows that begin at these strides. inputs: a row for each word, the last one for none."""
        out = [self.network.logits(inputs[self.gather(strides, begin[i : i + TOGETHER])]) for i in range(0, len(begin), TOGETHER)]
        return np.concatenate(out) if out else np.zeros(0, np.float32)

    def _inputs(self, words: Vocabulary) -> np.ndarray:
        return np.concatenate([self.tables.inputs(words), np.zeros((1, INPUTS), np.float32)])

    def scores(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """For each text its worst window's probability and its number of windows."""
        out, count = [], []
        for _, _, block in blocks(texts):
            words, strides, begin, first = self.windows(block)
            out.append(np.maximum.reduceat(self.logits(self._inputs(words), strides, begin), first))
            count.append(np.diff(first, append=len(begin)))
        if not out:
            return np.zeros(0), np.zeros(0, np.int64)
        return 1 / (1 + np.exp(-np.concatenate(out).astype(np.float64))), np.concatenate(count)

    @classmethod
    def fit(cls, texts: pa.Array, toxic: np.ndarray, rounds: int = 3, steps: int = 80, batch: int = 256, rate: float = 0.02, table_rate: float = 0.1, seed: int = 7) -> Model:
        """In the first round any window stands for its text, in each later one the window that then scores worst."""
        model, rng = cls(Tables(), Network(seed)), np.random.default_rng(seed)
        if not (toxic == 0).any() or not (toxic == 1).any():  # nothing to tell apart
            model.network.p["c"] *= 0
            model.network.p["d"][:] = np.log((np.sum(toxic == 1) + 0.5) / (np.sum(toxic == 0) + 0.5))
            return model
        parts, strides, begins, firsts, n = [], [], [], [], 0
        known, number = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for _, _, block in blocks(texts, LESS):
            own, ids, begin, first = cls.windows(block)
            begins.append(begin + sum(map(len, strides)))
            firsts.append(first + sum(map(len, begins[:-1])))
            fresh = ~np.isin(own.hashes, known)
            at = np.searchsorted(known, own.hashes[~fresh])
            numbers = np.empty(len(fresh) + 1, np.int64)
            numbers[:-1][fresh], numbers[:-1][~fresh], numbers[-1] = n + np.arange(fresh.sum()), number[at], -1
            strides.append(numbers[ids].astype(np.int32))
            parts.append(own.take(np.flatnonzero(fresh)))
            known, number = np.concatenate([known, own.hashes[fresh]]), np.concatenate([number, n + np.arange(fresh.sum())])
            order = np.argsort(known)
            known, number, n = known[order], number[order], n + int(fresh.sum())
        words, strides, begin, first = Vocabulary.joined(parts), np.concatenate(strides), np.concatenate(begins), np.concatenate(firsts)
        del parts
        ends = np.append(first[1:], len(begin))
        groups = [np.flatnonzero(toxic == y) for y in (0, 1)]
        m1, m2, t = {}, {}, 0
        for r in range(rounds):
            if r:
                value = model.logits(model._inputs(words), strides, begin)
                worst = np.array([a + int(np.argmax(value[a:b])) for a, b in zip(first, ends)])
            for _ in range(steps):
                rows = np.concatenate([rng.choice(q, batch // 2) for q in groups])
                ids = cls.gather(strides, begin[worst[rows] if r else rng.integers(first[rows], ends[rows])])
                known, at = np.unique(ids, return_inverse=True)
                none = int(known[0] < 0)
                here = words.take(known[none:])
                # a word that is not met in training has its n-grams alone; so have some of these
                kept = (rng.random(len(here.word)) >= DROPPED)[:, None]
                vectors = model.tables.inputs(here)
                vectors[:, :WIDTH] *= kept
                x = np.concatenate([np.zeros((none, INPUTS), np.float32), vectors])[at.reshape(ids.shape)]
                g = model.network.gradients(x, toxic[rows].astype(np.float32))
                slope = g.pop("x").reshape(-1, INPUTS)
                slope = np.stack([np.bincount(at.ravel(), slope[:, k], len(known)) for k in range(INPUTS)], axis=1)[none:]
                slope[:, :WIDTH] *= kept
                t += 1
                for n, v in g.items():
                    m1[n] = 0.9 * m1.get(n, 0) + 0.1 * v
                    m2[n] = 0.99 * m2.get(n, 0) + 0.01 * v * v
                    model.network.p[n] -= (rate * (m1[n] / (1 - 0.9**t)) / (np.sqrt(m2[n] / (1 - 0.99**t)) + 1e-6)).astype(np.float32)
                model.tables.learn(here, slope.astype(np.float32), table_rate)
        model.tables.finish()
        return model


#: Labelled texts of each class that the model is fitted on at most, those least by a hash of the id.
SAMPLE = 2000


def fit_toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """The model of a bounded sample of labelled rows, and of LABELLED_BYTES of their texts: rows whose label is null, or whose id's crc32 modulo 5 is 0, are not learnt from."""
    usable = labels.select(labels[id_col].alias("_id"), labels[label_col].cast("int").alias("_y")).where(F.col("_y").isin(0, 1) & (F.crc32(F.col("_id").cast("string")) % 5 != 0)).dropDuplicates(["_id"])
    chosen = [usable.where(F.col("_y") == y).orderBy(F.xxhash64("_id"), "_id").limit(sample) for y in (0, 1)]
    texts, toxic = labelled_rows(docs, chosen[0].unionByName(chosen[1]), id_col, text_col)
    return Model.fit(texts, toxic)


def score_toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), threshold: float = 0.5) -> DataFrame:
    """One row for each row of docs: id, held_out, score, predicted, windows, and the columns named by carry.

    Null and empty texts have one window of blanks; a null id counts as not held out and stays null; repeated rows stay;
    other columns are ignored. A narrow pass: no shuffle, memory bounded by a batch and a block of windows.
    """
    own = docs.select(docs[id_col], F.coalesce(F.crc32(docs[id_col].cast("string")) % 5 == 0, F.lit(False)).alias("held_out"), docs[text_col].alias("_text"), *[docs[c].alias(f"_c{i}") for i, c in enumerate(carry)])
    kind = docs.schema[id_col].dataType.simpleString()
    extra = "".join(f", _c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(carry))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores, windows = model.scores(b.column(2))
            cols = [b.column(0), b.column(1), pa.array(scores), pa.array((scores >= threshold).astype(np.int32)), pa.array(windows.astype(np.int64)), *[b.column(3 + i) for i in range(len(carry))]]
            yield pa.RecordBatch.from_arrays(cols, [id_col, "held_out", "score", "predicted", "windows", *[f"_c{i}" for i in range(len(carry))]])

    out = own.mapInArrow(score, f"{id_col} {kind}, held_out boolean, score double, predicted int, windows long{extra}")
    return out.select(id_col, "held_out", "score", "predicted", "windows", *[F.col(f"_c{i}").alias(c) for i, c in enumerate(carry)])


def without_toxic(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """docs without those whose score reaches the threshold; all columns stay."""

    def score(texts):  # noqa: ANN001, ANN202
        import pandas as pd

        return pd.Series(model.scores(pa.array(texts, pa.string()))[0])

    return docs.where(F.pandas_udf(score, "double")(F.coalesce(docs[text_col], F.lit(""))) < threshold)
