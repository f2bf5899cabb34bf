"""N-gram Jaccard join: rare-first prefix filtering with length, positional and suffix filters.

A text's set is that of its 5-word shingles. Texts with equal sets are one node. Document frequencies are counted by hash
bucket: each bucket counts its own keys and gives every node its shingles that occur elsewhere, with their frequencies. In
rare-first order the shingles of one node alone come first and match nothing; if they fill a node's prefix it has no
partner. The rest are joined on their prefix shingles: first with a few hubs of each shingle, then, between the components
still apart, with each other. Dense groups so cost as many pairs as they have members, and all links lie within components.
Links are then counted component by component, in blocks of bounded size whose sets meet as 0/1 matrices, so that no pair
is ever a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytewords import BLANK, LOWER, R, Block, blocks, mix
from .common import forget, free_names, release_shuffles, written
from .components import components

WORDS = 5
#: Similarity as a fraction.
NUMERATOR, DENOMINATOR = 4, 5
#: A shingle counted in at least 1/HEAVY of all documents is known beforehand: at most HEAVY x (mean set size) of them, whatever the input.
HEAVY = 128
#: Blocks of fewer texts than FEW (long ones) count common shingles together, in a summary of SUMMARY keys at most.
FEW, SUMMARY = 32, 1_000_000
#: Keys that meet in a bucket at most, values that meet where links are counted, and nodes there (means).
BUCKET_KEYS, MEET_VALUES, MEET_NODES = 2_000_000, 250_000, 2000
#: Hubs of a shingle that its nodes are joined with first.
HUBS = 2
#: Parts by which the suffix filter counts shingles.
PARTS = 8
#: The greatest frequency that is told apart from greater ones.
LARGEST = 32767


class Shingles:
    """Distinct shingles of the texts of a block: hash and text of each, sorted by both; size and node of each text."""

    def __init__(self, block: Block):
        data = LOWER[block.bytes]
        begins, ends, text = block.words(~BLANK)
        w = block.hashes(data, begins, ends)
        words = np.bincount(text, minlength=block.n)
        first = np.cumsum(words) - words
        count = np.where(words >= WORDS, words - WORDS + 1, np.minimum(words, 1))
        of = np.repeat(np.arange(block.n), count)
        at = first[of] + np.arange(len(of)) - (np.cumsum(count) - count)[of]
        h = np.zeros(len(of), np.uint64)
        width = np.minimum(words[of], WORDS)
        for k in range(WORDS):
            ok = k < width
            h[ok] = h[ok] * R + w[at[ok] + k]
        h = mix(h + width.astype(np.uint64))
        order = np.lexsort((h, of))
        h, of = h[order], of[order]
        keep = np.ones(len(h), bool)
        keep[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
        self.hash, self.text = h[keep], of[keep]
        self.size = np.bincount(self.text, minlength=block.n)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(self.hash ^ np.uint64(0x5851F42D4C957F2D)))])
        ends = np.cumsum(self.size)
        self.node = mix(total[ends] - total[ends - self.size] + self.size.astype(np.uint64)).view(np.int64)


class Common:
    """Counts of keys over many blocks in bounded memory: of those left out none was in more than the sum of counts / size."""

    def __init__(self):
        self.keys, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def add(self, keys: np.ndarray, counts: np.ndarray, size: int) -> None:
        keys, at = np.unique(np.concatenate([self.keys, keys]), return_inverse=True)
        counts = np.bincount(at, np.concatenate([self.counts, counts]), len(keys)).astype(np.int64)
        if len(keys) > size:
            counts -= np.partition(counts, len(counts) - size - 1)[len(counts) - size - 1]
        self.keys, self.counts = keys[counts > 0], counts[counts > 0]


def sets(docs: DataFrame) -> DataFrame:
    """For each row of docs (id, text, th): kind 0, id, th, size and node of its set. For each block of rows and shingle that many of them share: kind 1, its key as node, its count as size."""

    names = ["kind", "id", "th", "size", "node"]

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, texts, keys_seen, kind = Common(), 0, 0, None

        def told(keys: np.ndarray, count: np.ndarray) -> pa.RecordBatch:
            n = len(keys)
            return pa.RecordBatch.from_arrays([pa.array(np.ones(n, np.int32)), pa.nulls(n, kind), pa.nulls(n, pa.int64()), pa.array(count.astype(np.int64)), pa.array(keys.view(np.int64))], names)

        for b in batches:
            kind = b.column(0).type
            for i, j, block in blocks(b.column(1)):
                s = Shingles(block)
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(j - i, np.int32)), b.column(0).slice(i, j - i), b.column(2).slice(i, j - i), pa.array(s.size.astype(np.int64)), pa.array(s.node)], names)
                keys, count = np.unique(s.hash >> np.uint64(16), return_counts=True)
                if j - i < FEW:
                    texts, keys_seen = texts + j - i, keys_seen + len(s.hash)
                    common.add(keys, count, min(SUMMARY, max(1000, 2 * HEAVY * keys_seen // texts)))
                    continue
                many = count >= max(2, (j - i) / (2 * HEAVY))
                if many.any():
                    yield told(keys[many], count[many])
            pa.default_memory_pool().release_unused()  # a worker stays for later tasks
        many = common.counts >= max(2, texts / (2 * HEAVY))
        if many.any():
            yield told(common.keys[many], common.counts[many])

    return docs.mapInArrow(one, f"kind int, id {docs.schema['id'].dataType.simpleString()}, th long, size long, node long")


def _packed(docs: DataFrame, buckets: int, heavy: np.ndarray) -> DataFrame:
    """Keys (48 bits of the hash) of all nodes, one row for each block of texts and bucket: nodes, keys of each, and the keys' halves.
    Keys of a bucket meet there; a heavy one, whose frequency is known, goes where its node's hash says."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, _, block in blocks(b.column(0)):
                s = Shingles(block)
                single = np.zeros(block.n, bool)
                single[np.unique(s.node, return_index=True)[1]] = True
                on = single[s.text]
                key, node = s.hash[on] >> np.uint64(16), s.node[s.text[on]]
                bucket = (mix(key) % np.uint64(buckets)).astype(np.int64)
                if len(heavy) and len(key):
                    known = heavy[np.minimum(np.searchsorted(heavy, key), len(heavy) - 1)] == key
                    bucket[known] = (mix(node[known].view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                key, node, bucket = key[order], node[order], bucket[order]
                new = np.flatnonzero((np.diff(bucket, prepend=-1) != 0) | (np.diff(node, prepend=~node[:1]) != 0))
                counts = np.diff(new, append=len(key)).astype(np.uint32)
                nodes, of = node[new], bucket[new]
                edges = np.flatnonzero(np.diff(of, prepend=-1))
                rows = [(a, z) for a, z in zip(edges, [*edges[1:], len(new)])]
                high, low = (key >> np.uint64(16)).astype(np.uint32), key.astype(np.uint16)
                at = np.append(new, len(key))
                cols = [[], [], [], [], []]
                for a, z in rows:
                    for c, v in zip(cols, (int(of[a]), nodes[a:z].tobytes(), counts[a:z].tobytes(), high[at[a] : at[z]].tobytes(), low[at[a] : at[z]].tobytes())):
                        c.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[1:])], ["bucket", "nodes", "counts", "high", "low"])
            pa.default_memory_pool().release_unused()

    return docs.select("text").mapInArrow(pack, "bucket int, nodes binary, counts binary, high binary, low binary")


def shared_shingles(docs: DataFrame, buckets: int, heavy: np.ndarray, often: np.ndarray) -> DataFrame:
    """(node, shared): for each node the shingles that other nodes have too, as frequency (15 bits, LARGEST at most) and key (48 bits) in one number, rare ones first."""

    def count(group: pa.Table) -> pa.Table:
        read = lambda c, t: np.concatenate([np.frombuffer(x.as_buffer(), t) for x in group[c]])
        key = (read("high", np.uint32).astype(np.uint64) << np.uint64(16)) | read("low", np.uint16)
        node = np.repeat(read("nodes", np.int64), read("counts", np.uint32))
        order = np.lexsort((node, key))
        key, node = key[order], node[order]
        keep = np.ones(len(key), bool)
        keep[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])
        key, node = key[keep], node[keep]
        first = np.flatnonzero(np.diff(key, prepend=~key[:1]))
        per = np.diff(first, append=len(key))
        if len(heavy):
            at = np.minimum(np.searchsorted(heavy, key[first]), len(heavy) - 1)
            per = np.where(heavy[at] == key[first], often[at], per)
        n = np.repeat(np.minimum(per, LARGEST), np.diff(first, append=len(key)))
        on = n > 1
        value = (n[on].astype(np.int64) << 48) | key[on].astype(np.int64)
        order = np.argsort(node[on], kind="stable")
        value, node = value[order], node[on][order]
        pa.default_memory_pool().release_unused()
        first = np.flatnonzero(np.diff(node, prepend=~node[:1]))
        return pa.table({"node": pa.array(node[first]), "shared": pa.ListArray.from_arrays(pa.array(np.append(first, len(node)).astype(np.int32)), pa.array(value))})

    packed = _packed(docs, buckets, heavy)
    part = packed.groupBy("bucket").applyInArrow(count, "node long, shared array<long>")
    return part.groupBy("node").agg(F.array_sort(F.flatten(F.collect_list("shared"))).alias("shared"))


def _needed(a: Column, b: Column) -> Column:
    """Shingles that sets of these sizes must share at least: intersection / (a + b - intersection) >= 4 / 5."""
    return F.ceil((a + b) * NUMERATOR / (NUMERATOR + DENOMINATOR))


def _possible(rows: DataFrame, every: bool) -> DataFrame:
    """Pairs (a, b, sizes) that pass the length, the positional and the suffix filter. rows: x, y (node, size, alone:
    shingles of no other node, i: place in the prefix, parts: shingles in each of PARTS parts), a row for each shingle in
    both prefixes. The positional bound counts what comes from that shingle on. If rows hold every such shingle, the first
    one is among them, before which the two share nothing; else what comes before counts too."""
    size = lambda s: F.col(f"{s}.size")
    length = F.least(size("x"), size("y")) * DENOMINATOR >= F.greatest(size("x"), size("y")) * NUMERATOR
    most = F.aggregate(F.zip_with("x.parts", "y.parts", lambda x, y: F.least(x, y)), F.lit(0), lambda s, x: s + x)
    before = F.lit(0) if every else F.least(F.col("x.i"), F.col("y.i"))  # shared ones only: the others match nothing
    after = F.least(size("x") - F.col("x.alone") - F.col("x.i"), size("y") - F.col("y.alone") - F.col("y.i"))
    needed = _needed(size("x"), size("y"))
    pairs = rows.where(length & (before + after >= needed) & (most >= needed))
    return pairs.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b"), (size("x") + size("y")).alias("sizes")).distinct()


def _verified(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """Pairs that link."""
    full = known.select("node", "shared")
    p = pairs.join(full.toDF("a", "a_shared"), "a").join(full.toDF("b", "b_shared"), "b")
    return p.where(F.size(F.array_intersect("a_shared", "b_shared")) >= _needed(F.col("sizes"), F.lit(0))).select("a", "b")


def joined_components(known: DataFrame) -> DataFrame:
    """(node, component) of nodes that links join, but for each component's least node. known: node, size, shared, parts, alone."""
    prefix = F.col("size") - F.ceil(F.col("size") * NUMERATOR / DENOMINATOR) + 1 - F.col("alone")
    cut = F.slice("shared", F.lit(1), F.least(prefix, F.size("shared")).cast("int"))
    posted = written(known.where(prefix > 0).select("node", "size", "alone", "parts", F.posexplode(cut).alias("i", "g")), "postings")
    p = F.struct("node", "size", "alone", "i", "parts")
    # the same nodes are hubs of many shingles: those with few shingles of their own, or least by a hash
    first = lambda k: F.min(F.struct((F.col("alone") / F.col("size") if k == 0 else F.lit(0.0)).alias("s"), F.xxhash64("node", F.lit(k)).alias("h"), p.alias("p")))["p"].alias(f"p{k}")
    hubs = posted.groupBy("g").agg(*[first(k) for k in range(HUBS)], F.count(F.lit(1)).alias("n")).where("n > 1")
    hubs = written(hubs.select("g", F.array_distinct(F.array(*[f"p{k}" for k in range(HUBS)])).alias("hubs")), "hubs")
    near = posted.join(hubs.select("g", F.explode("hubs").alias("y")), "g").where("node <> y.node")
    pairs = written(_possible(near.select(p.alias("x"), "y"), every=False), "pairs")  # a hub is not that of every shingle it shares
    found = written(_verified(pairs, known), "links")
    forget(pairs)
    joined = components(found)
    forget(found)
    apart = posted.join(hubs.select("g"), "g", "left_semi").join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    apart = written(apart, "apart")
    forget(posted)
    forget(hubs)
    mixed = apart.groupBy("g").agg(F.min("component").alias("c0"), F.max("component").alias("c1")).where("c0 <> c1").select("g")
    rest = written(apart.join(mixed, "g", "left_semi"), "rest")
    forget(apart)
    left, right = (rest.select("g", F.col("component").alias(c), p.alias(x)) for c, x in (("c", "x"), ("d", "y")))
    pairs = written(_possible(left.join(right, "g").where("c < d").select("x", "y"), every=True), "pairs")
    forget(rest)
    if pairs.isEmpty():
        return joined
    found = written(_verified(pairs, known), "links")
    forget(pairs)
    if found.isEmpty():
        return joined
    # the components that these links join become one
    of = joined.toDF("of", "to")
    ends = found.join(of.toDF("a", "c"), "a", "left").join(of.toDF("b", "d"), "b", "left").select(F.coalesce("c", "a").alias("a"), F.coalesce("d", "b").alias("b"))
    again = components(ends)
    forget(found)
    moved = joined.join(again.toDF("component", "least"), "component", "left").select("node", F.coalesce("least", "component").alias("component"))
    return moved.unionByName(again)


def link_counts(known: DataFrame, copies: DataFrame, joined: DataFrame) -> DataFrame:
    """(node, links): for each node that others link with, how many rows its partners stand for. known: node, size, shared; copies: node, copies.

    Components meet whole, many small ones together; those of more than MEET_NODES nodes or MEET_VALUES values are dealt to
    blocks by a hash, and each two blocks of a component meet.
    """
    own = joined.unionByName(joined.select(F.col("component").alias("node"), "component").distinct())
    own = written(own.join(known.select("node", "size", "shared"), "node").join(copies, "node"), "members")
    of = own.groupBy("component").agg(F.ceil(F.greatest(F.count(F.lit(1)) / MEET_NODES, F.sum(F.size("shared")) / (8 * MEET_VALUES))).cast("int").alias("blocks"))
    values = own.agg(F.sum(F.size("shared").cast("long"))).first()[0] or 0
    batch = F.pmod(F.xxhash64("component"), F.lit(max(1, values // MEET_VALUES)))
    dealt = own.join(of, "component").withColumn("at", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select(F.when(F.col("blocks") > 1, F.col("component")).otherwise(batch).alias("of"), (F.col("blocks") > 1).alias("large"), F.least("at", "other").alias("a"), F.greatest("at", "other").alias("b"), "at", "component", "node", "size", "copies", "shared")

    def count(group: pa.Table) -> pa.Table:
        component, node, size, copies, at = (group[c].to_numpy() for c in ("component", "node", "size", "copies", "at"))
        shared = group["shared"].combine_chunks()
        starts = np.concatenate([[0], np.cumsum(shared.value_lengths().to_numpy())])
        values = shared.flatten().to_numpy()
        order = np.argsort(component, kind="stable")
        first = np.flatnonzero(np.diff(component[order], prepend=~component[order[:1]]))
        links = np.zeros(len(node))
        a, b = group["a"][0].as_py(), group["b"][0].as_py()
        for i, j in zip(first, [*first[1:], len(order)]):
            rows = order[i:j]
            left, right = rows[at[rows] == a], rows[at[rows] == b]
            if not len(left) or not len(right):
                continue
            link = linking([values[starts[r] : starts[r + 1]] for r in left], [values[starts[r] : starts[r + 1]] for r in right] if a != b else None, size[left], size[right])
            if a == b:
                np.fill_diagonal(link, False)
            links[left] += link @ copies[right].astype(np.float64)
            if a != b:
                links[right] += copies[left].astype(np.float64) @ link
        on = links > 0
        return pa.table({"node": pa.array(node[on]), "links": pa.array(links[on].astype(np.int64))})

    part = dealt.groupBy("of", "large", "a", "b").applyInArrow(count, "node long, links long")
    return part.groupBy("node").agg(F.sum("links").alias("links"))


def linking(left: list[np.ndarray], right: list[np.ndarray] | None, left_sizes: np.ndarray, right_sizes: np.ndarray) -> np.ndarray:
    """Which sets of left link with which of right (None: left itself). Sets hold all shingles that the two sides can share; sizes are the whole sets'."""
    both = left if right is None else [*left, *right]
    n = len(both)
    row = np.repeat(np.arange(n), [len(x) for x in both])
    _, column = np.unique(np.concatenate(both), return_inverse=True)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    often = np.bincount(column) > 1
    keep = often[column]
    row, column = row[keep], (np.cumsum(often) - 1)[column[keep]]
    common = np.zeros((len(left), len(right_sizes)), np.float32)
    width = max(256, 4_000_000 // n)
    for c in range(0, int(often.sum()), width):
        i, j = np.searchsorted(column, [c, c + width])
        m = np.zeros((n, min(width, int(often.sum()) - c)), np.float32)
        m[row[i:j], column[i:j] - c] = 1
        common += m[: len(left)] @ (m if right is None else m[len(left) :]).T
    return common * (NUMERATOR + DENOMINATOR) >= NUMERATOR * (left_sizes[:, None] + right_sizes[None, :])


def similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id, n_shingles, component_id, n_links (other rows linked with directly), node (of its set; equal sets have equal nodes), text_hash.

    Null and empty texts, and those of blanks alone, have 0 shingles and link with nothing: their component is their own id.
    Rows with equal texts link, whatever their ids; a null id stays null and its component is the least id that is not null
    among those it reaches (null if there is none). Other columns are ignored.

    Counting links compares all nodes of a component with each other, in blocks: its work is quadratic in a component's distinct sets.
    """
    spark = docs.sparkSession
    own = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"), F.xxhash64(docs[text_col]).alias("th"))
    found = written(sets(own), "sets")
    rows = found.where("kind = 0").select("id", "th", "size", "node")
    total, shingles = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    # bounded: their counts sum to total x mean size, and each has total / HEAVY at least
    heavy = sorted((r[0], r[1]) for r in found.where("kind = 1").groupBy("node").agg(F.sum("size").alias("n")).where(F.col("n") * HEAVY >= total).collect())
    keys, often = np.array([k for k, _ in heavy], np.int64).view(np.uint64), np.array([n for _, n in heavy], np.int64)
    buckets = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-shingles // BUCKET_KEYS))
    nodes = rows.where("size > 0").groupBy("node").agg(F.first("size").alias("size"), F.count(F.lit(1)).alias("copies"))
    known = shared_shingles(own, buckets, keys, often).join(nodes, "node").where(F.size("shared") * DENOMINATOR >= F.col("size") * NUMERATOR)
    part = lambda k: F.size(F.filter("shared", lambda v: F.pmod(v, F.lit(PARTS)) == k)).cast("int")
    known = known.select("node", F.col("size").cast("int").alias("size"), "copies", "shared", (F.col("size") - F.size("shared")).cast("int").alias("alone"), F.array(*[part(k) for k in range(PARTS)]).alias("parts"))
    known = written(known, "known")
    release_shuffles(spark)
    joined = written(joined_components(known), "components")
    links = written(link_counts(known.drop("copies"), known.select("node", "copies"), joined), "link-counts")
    forget(known)
    release_shuffles(spark)
    placed = rows.join(joined, "node", "left").withColumn("c", F.coalesce("component", "node"))
    # exact copies are linked with each other besides
    least = placed.where("size > 0").groupBy("c", "node").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("copies"))
    of = least.groupBy("c").agg(F.min("least").alias("least"))
    per = least.drop("least").join(of, "c").join(links, "node", "left").select("node", "least", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    out = rows.join(per, "node", "left")
    full = F.col("size") > 0
    return out.select(
        F.col("id").alias(id_col), F.col("size").alias("n_shingles"), F.when(full, F.col("least")).otherwise(F.col("id")).alias("component_id"),
        F.when(full, F.col("n_links")).otherwise(F.lit(0)).cast("long").alias("n_links"), "node", F.col("th").alias("text_hash"),
    )


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document of each group of similar texts, that of the least id; all columns stay.

    Texts without words stay. Of rows alike in id and text one stays. A document with a null id goes if a similar one has an
    id; documents similar only to others without ids stay.
    """
    found = similar(docs, id_col, text_col)
    gone = found.where((F.col("n_shingles") > 0) & F.col("component_id").isNotNull() & ~F.col(id_col).eqNullSafe(F.col("component_id")))
    i, th = free_names(docs, "id", "hash")
    gone = gone.select(F.col(id_col).alias(i), F.col("text_hash").alias(th)).distinct()
    kept = docs.join(gone, docs[id_col].eqNullSafe(F.col(i)) & (F.xxhash64(docs[text_col]) == F.col(th)), "left_anti")
    # rows alike in id and text: their digests alone tell which there are
    again = found.where("n_shingles > 0").groupBy(id_col, "text_hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    if again.isEmpty():
        return kept
    blank = F.coalesce(F.regexp_replace(text_col, r"[\x20\x09-\x0D]", ""), F.lit("")) == ""
    return kept.where(blank).unionByName(kept.where(~blank).dropDuplicates([id_col, text_col]))
