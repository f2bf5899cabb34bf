"""Byte-level BPE: every distinct pre-token of the corpus is encoded once.

Pre-tokens are exploded with their positions, block by block: a block of some megabytes of text tells the distinct
pre-tokens that it holds and, for each position of its documents, which of them stands there. The distinct pre-tokens
are shuffled by a hash, so that equal ones of all blocks meet; each is merged once, and its ids go back to the blocks that
asked for it. There the documents' ids are put together by position. Decoding joins ids with the token-byte table.

What is shuffled of a pre-token is its bytes, once for each block and not for each place where it stands. Of a place it is
the number that the pre-token has in its block. Both are packed.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Merger
from .common import forget, release_shuffles, written, written_by

#: Bytes of the texts of a block (a longer text is a block alone), and distinct pre-tokens of all blocks that meet in a bucket (the mean).
BLOCK_BYTES, MEET = 20_000_000, 400_000
#: Ids that are put together or decoded at once.
TOGETHER = 500_000


def ranks(path: str) -> dict[bytes, int]:
    """A file of lines, each a token's bytes in base 64 and its rank, which is its id."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class ByteEncoder:
    """Ids of single pre-tokens under the ranks of a vocabulary."""

    def __init__(self, rank: dict[bytes, int]):
        missing = [b for b in range(256) if bytes([b]) not in rank]
        if missing:
            raise ValueError(f"the vocabulary has no token for the bytes {missing}")
        self.rank = rank
        self.merger = Merger(rank, lambda b: [b[i : i + 1] for i in range(len(b))])

    def ids(self, word: bytes) -> list[int]:
        """A pre-token that is a token is that token; others are merged, the best-ranked pair first."""
        known = self.rank.get(word)
        return [known] if known is not None else [self.rank[p] for p in self.merger.merge(word)]


def pack(x: np.ndarray) -> bytes:
    """Numbers below 2**32, byte by byte of all of them, compressed: how many, the sizes of the four parts, the parts."""
    if not len(x):
        return b""
    planes = np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    parts = [pa.Codec("zstd", compression_level=1 if k == 1 else 9).compress(p.tobytes(), asbytes=True) for k, p in enumerate(planes)]  # second bytes gain nothing from more work
    return np.array([len(x), *map(len, parts)], "<u8").tobytes() + b"".join(parts)


def unpack(data: bytes) -> np.ndarray:
    if not data:
        return np.zeros(0, np.uint32)
    n, *sizes = np.frombuffer(data, "<u8", 5).tolist()
    ends = np.cumsum([40, *sizes]).tolist()
    planes = np.empty((n, 4), np.uint8)
    for k in range(4):
        planes[:, k] = np.frombuffer(pa.decompress(data[ends[k] : ends[k + 1]], n, "zstd"), np.uint8)
    return planes.view("<u4").ravel()


def pack_words(words: pa.Array) -> tuple[bytes, bytes]:
    """Lengths and bytes of a large_binary array, compressed."""
    joined = b"".join(words.to_pylist())
    return pack(pc.binary_length(words).to_numpy()), len(joined).to_bytes(8, "little") + pa.compress(joined, "zstd", asbytes=True)


def unpack_words(lengths: bytes, data: bytes) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum(unpack(lengths), dtype=np.int64)])
    raw = pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd")
    return pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int64)), raw])


class _Block:
    """Texts taken together: their ids, how many pre-tokens each has, and these one after the other."""

    def __init__(self, pattern: regex.Pattern):
        self.find, self.size = pattern.findall, 0
        self.keys: list[pa.Array] = []
        self.counts: list[int] = []
        self.words: list[pa.Array] = []

    def add(self, key: pa.Array, text: str) -> None:
        found = self.find(text)
        self.keys.append(key)
        self.counts.append(len(found))
        if found:
            self.words.append(pa.array(found, pa.large_string()))
        self.size += len(text.encode())

    def rows(self, block: int, buckets: int) -> Iterator[list]:
        """kind 0: the block, its documents' ids, pre-tokens of each, and the numbers of all these; kind 1: the block's distinct
        pre-tokens of a bucket, in the order of their numbers. A number is that of its bucket modulo their number; frequent ones have low ones."""
        coded = pa.chunked_array(self.words, pa.large_string()).combine_chunks().dictionary_encode() if self.words else pa.array([], pa.large_string()).dictionary_encode()
        at, distinct = coded.indices.to_numpy(), coded.dictionary.cast(pa.large_binary())
        bucket = np.array([zlib.crc32(w) for w in distinct.to_pylist()], np.int64) % buckets
        by = np.lexsort((-np.bincount(at, minlength=len(distinct)), bucket))
        first = np.searchsorted(bucket[by], bucket[by])
        number = np.empty(len(by), np.int64)
        number[by] = (np.arange(len(by)) - first) * buckets + bucket[by]
        yield [0, block, 0, pa.concat_arrays(self.keys), pack(np.array(self.counts, np.int64)), pack(number[at])]
        for some in np.split(by, np.flatnonzero(np.diff(bucket[by])) + 1):
            if len(some):
                yield [1, block, int(bucket[some[0]]), None, *pack_words(distinct.take(pa.array(some)))]


def _blocks(docs: DataFrame, pattern: str, buckets: int) -> DataFrame:
    """docs (id, text) as blocks: see _Block.rows."""
    kind, most = docs.schema["id"].dataType.simpleString(), BLOCK_BYTES

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled, names = regex.compile(pattern), ["kind", "block", "bucket", "ids", "a", "b"]
        first, done, id_type = TaskContext.get().partitionId() << 32, 0, None
        block = _Block(compiled)

        def told() -> Iterator[pa.RecordBatch]:
            for r in block.rows(first + done, buckets):
                keys = pa.array([None], pa.list_(id_type)) if r[3] is None else pa.ListArray.from_arrays(pa.array([0, len(r[3])], pa.int32()), r[3])
                yield pa.RecordBatch.from_arrays([pa.array([r[0]], pa.int32()), pa.array([r[1]], pa.int64()), pa.array([r[2]], pa.int32()), keys, *(pa.array([x], pa.binary()) for x in r[4:])], names)

        for batch in batches:
            id_type = batch.column(0).type
            for i, text in enumerate(batch.column(1)):
                text = text.as_py() or ""
                if block.counts and block.size + len(text) > most:
                    yield from told()
                    done, block = done + 1, _Block(compiled)
                    pa.default_memory_pool().release_unused()
                block.add(batch.column(0).slice(i, 1), text)
        if block.counts:
            yield from told()
        del block
        pa.default_memory_pool().release_unused()  # a worker stays for later tasks

    return docs.mapInArrow(cut, f"kind int, block long, bucket int, ids array<{kind}>, a binary, b binary")


_encoders: dict[str, ByteEncoder] = {}


def encoder(path: str) -> ByteEncoder:
    """One encoder for each vocabulary file and Python worker."""
    if path not in _encoders:
        _encoders[path] = ByteEncoder(ranks(path))
    return _encoders[path]


def _encoded(asked: DataFrame, vocabulary: str) -> DataFrame:
    """(block, bucket, n, ids) for asked (block, bucket, lengths, words): ids of each pre-token and how many these are; equal pre-tokens of all blocks are encoded once."""

    def encode(group: pa.Table) -> pa.Table:
        ids = encoder(vocabulary).ids
        each = [unpack_words(x.as_py(), y.as_py()) for x, y in zip(group["a"], group["b"])]
        coded = pa.chunked_array(each).combine_chunks().dictionary_encode()
        found = [ids(w) for w in coded.dictionary.to_pylist()]
        count = np.array([len(x) for x in found], np.int64)
        flat = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32)), pa.array(np.fromiter((i for x in found for i in x), np.int64, int(count.sum()))))
        n, out, start = [], [], 0
        at = coded.indices.to_numpy()
        for words in each:
            own = at[start : start + len(words)]
            start += len(words)
            n.append(pack(count[own]))
            out.append(pack(flat.take(pa.array(own)).flatten().to_numpy()))
        return pa.table([group["block"], group["bucket"], pa.array(n, pa.binary()), pa.array(out, pa.binary())], ["block", "bucket", "n", "ids"])

    return asked.select("block", "bucket", "a", "b").groupBy("bucket").applyInArrow(encode, "block long, bucket int, n binary, ids binary")


def encode_bytes(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id and ids (array<int>) under the ranks in the file vocabulary.

    Each match of pattern is encoded separately, without special tokens; what pattern does not match has no ids. A null or
    empty text has none; a null id stays null; rows with equal ids or texts stay; other columns are ignored, whatever their
    names. Blocks and buckets are of bounded size (a text is never cut); their number follows the input.
    """
    own = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    spark = docs.sparkSession
    size = own.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
    # at most so many distinct pre-tokens that texts of that size have in blocks: none is shorter than a byte, and most are told once a block
    buckets = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // (20 * MEET)))
    blocks, asked = written_by(_blocks(own, pattern, buckets), "kind", [0, 1], "pre-tokens")
    answers = written(_encoded(asked, vocabulary), "word-ids")
    forget(asked)
    release_shuffles(spark)
    kind = docs.schema[id_col].dataType.simpleString()

    def together(left: pa.Table, right: pa.Table) -> pa.Table:
        """Ids of the documents of one block, by position."""
        counts, numbers = (unpack(left[c][0].as_py()) for c in "ab")
        most = int(numbers.max()) + 1 if len(numbers) else 0
        n, begin, rows, total = np.zeros(most, np.int64), np.zeros(most, np.int64), [], 0
        for b, k, ids in zip(right["bucket"].to_pylist(), right["n"].to_pylist(), right["ids"].to_pylist()):
            k = unpack(k).astype(np.int64)
            n[b::buckets][: len(k)] = k
            begin[b::buckets][: len(k)] = total + np.cumsum(k) - k  # where the ids of each pre-token begin in flat
            rows.append(unpack(ids).astype(np.int32))
            total += len(rows[-1])
        flat = np.concatenate(rows) if rows else np.zeros(0, np.int32)
        # position by position, some at a time
        values = []
        for k in range(0, len(numbers), TOGETHER):
            here = numbers[k : k + TOGETHER]
            per = n[here]
            values.append(flat[np.repeat(begin[here] - np.cumsum(per) + per, per) + np.arange(per.sum())])
        ends = np.concatenate([[0], np.cumsum(n.astype(np.int32)[numbers], dtype=np.int32)])[np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])]
        lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.concatenate(values) if values else np.zeros(0, np.int32)))
        pa.default_memory_pool().release_unused()
        return pa.table([left["ids"].combine_chunks().flatten(), lists], ["id", "ids"])

    grouped = blocks.select("block", "ids", "a", "b").groupBy("block").cogroup(answers.groupBy("block"))
    out = grouped.applyInArrow(together, f"id {kind}, ids array<int>")
    return out.select(F.col("id").alias(id_col), "ids")


def decode_bytes(encoded: DataFrame, vocabulary: str, ids_col: str = "ids", into: str = "decoded") -> DataFrame:
    """encoded with a column more, into: the bytes of the ids, one after the other (binary; they need not be UTF-8).

    Ids are joined with the token-byte table, which every task holds: it is as large as the vocabulary, whatever the input.
    Null ids give null, an empty list no bytes; an id that is in no table, or null, raises. A column named into is replaced.
    """
    rows = encoded.drop(into)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_id = {i: t for t, i in encoder(vocabulary).rank.items()}
        table = pa.array([by_id.get(i) for i in range(max(by_id) + 1)], pa.large_binary())
        for batch in batches:
            lengths = pc.fill_null(pc.list_value_length(batch.column(batch.schema.get_field_index(ids_col))), 0).to_numpy()
            part = np.cumsum(lengths) // TOGETHER
            for rows in np.split(np.arange(len(part)), np.flatnonzero(np.diff(part)) + 1):
                b = batch.slice(rows[0] if len(rows) else 0, len(rows))
                lists = b.column(b.schema.get_field_index(ids_col))
                values = lists.flatten()
                wrong = pc.fill_null(pc.or_(pc.less(values, 0), pc.greater_equal(values, len(table))), True)
                tokens = table.take(values) if not pc.any(wrong).as_py() else None
                if tokens is None or tokens.null_count:
                    raise ValueError("an id is in no row of the token-byte table")
                ends = np.concatenate([[0], np.cumsum(lengths[rows])]).astype(np.int64)
                joined = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(ends), tokens), pa.scalar(b"", pa.large_binary()))
                joined = pc.if_else(lists.is_valid(), joined, pa.scalar(None, pa.large_binary())).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([*b.columns, joined], [*b.schema.names, into])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(decode, f"{kinds}, `{into}` binary")
