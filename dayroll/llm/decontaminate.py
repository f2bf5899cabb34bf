"""Benchmark decontamination by spaced-seed hashing, all in DataFrame functions.

Fixed masks pick some of the tokens under a window and ignore the others, so that a window with substituted tokens still
hashes as the benchmark's does under one of them. Hashes are joined, each hit gives an alignment of item and document,
and the alignment is verified token by token with substitutions allowed.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: 1 is a token that counts. Wherever the substitutions of a leak fall, and whatever part of the item a text's
#: beginning or end cuts off, some mask of the item's class hits it; every mask spans FEWEST tokens at least.
LONG = ("101001011", "1110011", "110100011")
SHORT = ("0101110", "1101001", "1000111", "10110001")
MASKS = LONG + SHORT
#: Item and document have to have so many tokens side by side.
FEWEST = min(map(len, MASKS))
#: An alignment is a leak if some WINDOW neighbouring tokens of the item (all of a shorter one) have at least SHARE of them equal.
WINDOW, SHARE = 13, 0.75
#: Benchmark seeds are broadcast, so many rows at once (24 bytes each); a larger benchmark is split by item, and each part
#: takes a pass over the documents. Seeds of documents are never shuffled: each would have to take its document along.
BROADCAST_ROWS = 1_000_000
#: A seed that more places of the benchmark than HOT have (of a phrase that many items share) is no hit by itself: more tokens about it
#: have to be equal too, and are part of what is joined.
HOT = 64


def _about(mask: str) -> list[tuple[int, ...]]:
    """Sets of places, counted from the mask's first; in every leak that the mask hits, the tokens of one set at least are all equal.

    A window of WINDOW tokens that holds the mask has 8 other places, 5 of them equal at least. In two groups by turns, 4 places
    each, one has 3 equal ones. Neither the tokens between the mask's own nor a phrase of up to 9 tokens fill three of a group. Shorter
    items have less to spare: two of the ignored places and the nearest ones beside them."""
    ignored = [k for k, c in enumerate(mask) if c == "0"]
    if mask in LONG:
        beside = WINDOW - len(mask)
        group = {p: k % 2 for k, p in enumerate(ignored)} | {-1 - k: k % 2 for k in range(beside)} | {len(mask) + k: (k + 1) % 2 for k in range(beside)}
        return sorted({t for a in range(beside + 1) for g in (0, 1) for t in combinations([p for p in range(-a, WINDOW - a) if group.get(p) == g], 3)})
    left = lambda n, a, r: len(ignored) + min(a, r) + min(n - len(mask) - a, r) - (n - math.ceil(n * SHARE))
    beside = next(r for r in range(WINDOW) if all(left(n, a, r) >= 2 for n in range(len(mask), WINDOW) for a in range(n - len(mask) + 1)))
    return list(combinations([*range(-beside, 0), *ignored, *range(len(mask), len(mask) + beside)], 2))


ABOUT = tuple(map(_about, MASKS))


def tokens(text: Column) -> Column:
    """Runs of letters and digits in lower case; none of a null text."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _hash(h: Column, at: Column, mask: str) -> Column:
    return F.xxhash64(F.lit(mask), *[F.get(h, at + k) for k, c in enumerate(mask) if c == "1"])


def _seeds(rows: DataFrame, masks: Sequence[int]) -> DataFrame:
    """rows (with h, the token hashes) times (at, mask, seed), one for each place where one of these masks fits."""
    placed = rows.where(F.size("h") >= FEWEST).withColumn("at", F.explode(F.sequence(F.lit(0), F.size("h") - FEWEST)))
    fits = [F.when(F.col("at") + len(MASKS[i]) <= F.size("h"), _hash(F.col("h"), F.col("at"), MASKS[i])) for i in masks]
    each = F.array(*[F.struct(F.lit(i).alias("mask"), x.alias("seed")) for i, x in zip(masks, fits)])
    return placed.withColumn("s", F.explode(each)).select(*placed.columns, "s.mask", "s.seed").where(F.col("seed").isNotNull())


def _before(h: Column, at: Column, mask: Column) -> Column:
    """The seed of the same mask one place earlier."""
    found = F.lit(None).cast("long")
    for i, m in enumerate(MASKS):
        found = F.when(mask == i, _hash(h, at - 1, m)).otherwise(found)
    return F.when(at > 0, found)


def _wider(h: Column, at: Column, mask: Column, seed: Column) -> Column:
    """For a seed and each set of places about it where there are tokens: the wider seed, and what it is one place earlier."""
    about = F.array(*[F.array(*[F.array(*map(F.lit, places)) for places in sets]) for sets in ABOUT])

    def wide(x: Column, begin: Column, places: Column) -> Column:
        found = F.transform(places, lambda p: F.get(h, begin + p))
        return F.when(x.isNotNull() & F.forall(found, lambda t: t.isNotNull()), F.xxhash64(x, places, found))

    earlier = _before(h, at, mask)
    each = F.transform(F.get(about, mask), lambda places: F.struct(wide(seed, at, places).alias("seed"), wide(earlier, at - 1, places).alias("before")))
    return F.filter(each, lambda x: x["seed"].isNotNull())


def _hits(docs: DataFrame, items: DataFrame) -> DataFrame:
    """docs (with h) times the places (at) where they hit items (item, item_id, item_at, item_h), of a run of hits on one alignment the first."""
    seeds = _seeds(items, range(len(MASKS))).where((F.size("h") >= WINDOW) == (F.col("mask") < len(LONG)))
    seeds = seeds.select("item", F.col("at").alias("item_at"), F.col("mask").alias("item_mask"), "seed", F.col("h").alias("item_h"))
    seeds = seeds.withColumn("before", _before(F.col("item_h"), F.col("item_at"), F.col("item_mask")))
    often = seeds.groupBy("item_mask", "seed").count()
    hot = F.col("count") > HOT
    each = {r["item_mask"]: r for r in often.groupBy("item_mask").agg(F.sum(F.when(hot, 0).otherwise(F.col("count"))).alias("light"), F.sum(F.when(hot, F.col("count")).otherwise(0)).alias("hot"), F.count_if(hot).alias("keys")).collect()}
    rows = sum(r["light"] + r["keys"] + r["hot"] * len(ABOUT[i]) for i, r in each.items())
    own = _seeds(docs, sorted(each) or range(len(LONG)))
    parts = max(1, -(-rows // max(1, BROADCAST_ROWS)))
    mine = lambda t, part: t if parts == 1 else t.where(F.pmod(F.col("item"), F.lit(parts)) == part)
    before = _before(F.col("h"), F.col("at"), F.col("mask"))
    hits = None
    for part in range(parts):
        if any(r["keys"] for r in each.values()):
            got = _hits_about(own, mine(seeds, part), often.where(hot), before)
        else:
            got = own.join(F.broadcast(mine(seeds.drop("item_h"), part)), "seed").where(F.col("mask") == F.col("item_mask"))
            # of a run the first: the seeds one place earlier differ, or there are none
            got = got.where(F.coalesce(before != F.col("before"), F.lit(True)))
        got = got.select(*own.columns, "item", "item_at")
        got = got.join(F.broadcast(mine(items.select("item", "item_id", F.col("h").alias("item_h")), part)), "item")
        hits = got if hits is None else hits.unionByName(got)
    return hits


def leaks(docs: DataFrame, benchmark: DataFrame, keys: tuple[str, ...] = ("doc_id",), text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row for each document and item that it leaks: keys, item_id, best (equal tokens in the best window), matched
    (equal tokens of the whole alignment), item_tokens, doc_offset (token of the document where the item would begin; it
    is negative if the item's beginning is not there). Of several alignments the best counts, the first of equals.

    Items and documents of fewer than 7 tokens, null or empty texts included, leak nothing, nor does an alignment that has
    fewer than 7 tokens of both side by side; every other alignment is found. Rows with equal keys count as one document,
    items with equal ids as one item that several texts stand for; null keys and ids are a value like others. Other columns are ignored. Work grows with the documents' tokens times the masks
    (those for items of WINDOW tokens or more, those for shorter ones, or both, as the benchmark has them); only hits
    leave the scan, and of a run of hits on one alignment only the first. A seed that many items share is joined with three more
    tokens (two for items shorter than WINDOW), so that a phrase common to items of WINDOW tokens makes no hits by itself; no leak is lost by that.
    """
    hashed = lambda text: F.transform(tokens(text), lambda w: F.xxhash64(w))
    items = benchmark.select(F.col(item_col).alias("item_id"), hashed(F.col(item_text_col)).alias("h")).distinct()
    items = items.withColumn("item", F.xxhash64(F.col("item_id").cast("string"), "h"))  # null and repeated ids are items of their own
    hits = _hits(docs.select(*[docs[k].alias(f"k{i}") for i, k in enumerate(keys)], hashed(docs[text_col]).alias("h")), items)
    hits = hits.withColumn("doc_offset", F.col("at") - F.col("item_at"))
    n = F.size("item_h")
    equal = F.transform(F.col("item_h"), lambda x, p: F.when((p + F.col("doc_offset") >= 0) & (F.get(F.col("h"), p + F.col("doc_offset")) == x), 1).otherwise(0))
    width = F.least(F.lit(WINDOW), n)
    windows = F.transform(F.sequence(F.lit(1), n - width + 1), lambda s: F.aggregate(F.slice(F.col("equal"), s, width), F.lit(0), lambda a, x: a + x))
    found = hits.withColumn("equal", equal).select(
        *[f"k{i}" for i in range(len(keys))], "item_id", F.array_max(windows).alias("best"), F.aggregate("equal", F.lit(0), lambda a, x: a + x).alias("matched"),
        n.alias("item_tokens"), "doc_offset", F.ceil(width * SHARE).alias("need"),
    ).where(F.col("best") >= F.col("need"))
    ks = [f"k{i}" for i in range(len(keys))]
    best = found.groupBy(*ks, "item_id").agg(F.max(F.struct("best", "matched", -F.col("doc_offset"), "item_tokens")).alias("b"))
    return best.select(
        *[F.col(f"k{i}").alias(k) for i, k in enumerate(keys)], "item_id", F.col("b.best").cast("long").alias("best"), F.col("b.matched").cast("long").alias("matched"),
        F.col("b.item_tokens").cast("long").alias("item_tokens"), (-F.col("b.col3")).cast("long").alias("doc_offset"),
    )


def _hits_about(own: DataFrame, seeds: DataFrame, often: DataFrame, before: Column) -> DataFrame:
    """Hits (item, item_at) of own seeds where some seeds are hot: these are joined once each, and then, wider, with their items.

    Of a run of hits the first stays, as each way leaves out only what has a hit one place earlier that one of the ways keeps: a wider
    seed if it is equal there too (so the seed is), a seed if the one there is equal and not hot."""
    hot = often.select("seed", F.lit(True).alias("hot"))
    seeds = seeds.join(hot, "seed", "left")
    light = seeds.where("hot IS NULL").join(hot.toDF("before", "before_hot"), "before", "left")
    light = light.select("seed", "item_mask", "item", "item_at", F.when(F.col("before_hot").isNull(), F.col("before")).alias("before"))
    none = lambda kind: F.lit(None).cast(kind)
    known = light.unionByName(often.select("seed", "item_mask", none("long").alias("item"), none("int").alias("item_at"), none("long").alias("before")))
    wide = seeds.where("hot").select("item", "item_at", F.explode(_wider(F.col("item_h"), F.col("item_at"), F.col("item_mask"), F.col("seed"))).alias("m"))
    wide = wide.select(F.col("m.seed").alias("wide_seed"), F.col("m.before").alias("wide_before"), F.col("item").alias("wide_item"), F.col("item_at").alias("wide_at"))
    got = own.join(F.broadcast(known), "seed").where(F.col("mask") == F.col("item_mask"))
    got = got.where(F.coalesce(before != F.col("before"), F.lit(True)))
    itself = F.array(F.struct(none("long").alias("seed"), none("long").alias("before")))
    got = got.withColumn("m", F.explode(F.when(F.col("item").isNull(), _wider(F.col("h"), F.col("at"), F.col("mask"), F.col("seed"))).otherwise(itself)))
    got = got.join(F.broadcast(wide), F.col("m.seed") == F.col("wide_seed"), "left")
    got = got.where(F.coalesce("item", "wide_item").isNotNull() & F.coalesce(F.col("m.before") != F.col("wide_before"), F.lit(True)))
    return got.withColumns({"item": F.coalesce("item", "wide_item"), "item_at": F.coalesce("item_at", "wide_at")})


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the documents that leak an item; all columns stay. A document is known by its id and its text, so that
    a null or repeated id takes no other text with it."""
    found = leaks(docs.select(docs[id_col].alias("_id"), F.xxhash64(docs[text_col]).alias("_hash"), docs[text_col].alias("_text")), benchmark, ("_id", "_hash"), "_text")
    bad = found.select("_id", "_hash").distinct()
    return docs.join(bad, docs[id_col].eqNullSafe(bad["_id"]) & (F.xxhash64(docs[text_col]) == bad["_hash"]), "left_anti")
