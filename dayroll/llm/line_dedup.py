"""Line dedup by content-defined chunks of lines.

Rolling hashes over the hashes of a text's lines choose where chunks end, so a passage is cut alike wherever it stands, but
for its first lines, whose chunk began before it. Several such rules cut each text; what one rule joins to its surroundings
another cuts off. A chunk that occurs more than once in the corpus is extended line by line, to the left and to the right, as
far as its text and that of the chunk's first occurrence go on alike, so a repeated passage goes up to its edges. Chunks and
the lines they were extended by are compared byte by byte. They mark their lines everywhere but at the first occurrence; runs
of marked lines that are long enough are removed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytewords import BLANK, Block, blocks, mix, powers
from .common import forget, free_names, release_shuffles, written, written_by

#: Lines in the rolling window of each rule. Under each a chunk ends with three in four lines (bits of the hash that must not all be 0).
RULES, CUT = (1, 1, 1, 1, 1, 1, 1, 1, 1, 1, 2, 2), 3
#: Runs of marked lines go if they have SEVERAL lines and ENOUGH words, or LONG words. A line of LONG words is a chunk of its own under every rule.
SEVERAL, ENOUGH, LONG = 2, 25, 50
#: Lines by which a chunk is extended to each side at most. A passage's chunks reach to its last lines and to its second line
#: already, but for one passage in thousands, whatever its length.
REACH = 4
#: An odd multiplier for hashes of runs of lines, and its inverse modulo 2**64.
LINE = np.uint64(0xD1342543DE82EF95)
LINE_INVERSE = np.uint64(pow(0xD1342543DE82EF95, -1, 1 << 64))


def line_table(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all lines of a block, empty ones too: hash, words, text. A text has one line more than newlines."""
    n = len(block.bytes)
    ends = np.flatnonzero((block.bytes == 10) & block.inside | ~block.inside)
    begins = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
    text = np.searchsorted(block.ends, begins, "left")
    words = np.zeros(n + 1, np.int64)
    words[1 + block.words(~BLANK)[0]] = 1
    words = np.cumsum(words)
    return block.hashes(block.bytes, begins, ends), words[ends] - words[begins], text


class Runs:
    """Hashes of runs of lines of a block: sums of powers, so that any run costs as much as one line."""

    def __init__(self, hashes: np.ndarray):
        n = len(hashes)
        self.down = powers(n, LINE_INVERSE)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(hashes) * powers(n, LINE)[:n])])

    def of(self, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[first]) * self.down[first] + (end - first).astype(np.uint64))


def chunks(hashes: np.ndarray, words: np.ndarray, text: np.ndarray, rules: tuple[int, ...] = RULES) -> tuple[np.ndarray, np.ndarray]:
    """First line of each chunk and how many lines it has. Only lines with words are given here; what several rules cut alike is one chunk."""
    n = len(hashes)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    alone = words >= LONG
    forced = (np.diff(text, prepend=-1) != 0) | alone  # a chunk begins here whatever the rule
    forced[1:] |= alone[:-1]
    cuts = []
    for rule, window in enumerate(rules):
        rolling = hashes.copy()
        for k in range(1, window):
            rolling[k:] = rolling[k:] * np.uint64(0x100000001B3) + np.where(text[k:] == text[:-k], hashes[:-k], np.uint64(0))
        cut = (mix(rolling + np.uint64(rule + 1)) & np.uint64(CUT)) != 0  # the chunk ends with this line
        begin = forced.copy()
        begin[1:] |= cut[:-1]
        first = np.flatnonzero(begin)
        cuts.append(first << 32 | np.diff(first, append=n))
    if not rules:
        first = np.flatnonzero(alone)
        cuts.append(first << 32 | 1)
    all_cuts = np.unique(np.concatenate(cuts))
    return all_cuts >> 32, all_cuts & 0xFFFFFFFF


def chunk_rows(docs: DataFrame) -> DataFrame:
    """For docs (id, th, text), counting lines with words alone: kind 0, s, n and h, the first line, lines and hash of every
    chunk, blank lines within it being part of it. Kind 1, once a text: at, the place of each line among all lines; left and right,
    for each line a hash of it and of the blank lines after it, and before it. A text without words has none."""

    rules = RULES

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["kind", "id", "th", "s", "n", "h", "at", "left", "right"]
        for b in batches:
            for first_text, _, block in blocks(b.column(2)):
                hashes, words, text = line_table(block)
                full = np.flatnonzero(words)
                runs, own = Runs(hashes), text[full]
                first, count = chunks(hashes[full], words[full], own, rules)
                start = np.searchsorted(own, np.arange(block.n))  # each text's first line with words
                m, at = len(first), pa.array(own[first] + first_text)
                kinds = lambda n, k: pa.array(np.full(n, k, np.int32))
                none = lambda n, t: pa.nulls(n, t)
                ints, longs = pa.list_(pa.int32()), pa.list_(pa.int64())
                h = runs.of(full[first], full[first + count - 1] + 1) if m else np.zeros(0, np.uint64)
                place = [pa.array((first - start[own[first]]).astype(np.int32)), pa.array(count.astype(np.int32)), pa.array(h.view(np.int64))]
                yield pa.RecordBatch.from_arrays([kinds(m, 0), b.column(0).take(at), b.column(1).take(at), *place, none(m, ints), none(m, longs), none(m, longs)], names)
                each = np.unique(own)
                if not len(each):
                    continue
                offsets = pa.array(np.append(start[each], len(full)).astype(np.int32))
                top = np.searchsorted(text, np.arange(block.n))
                same = own[1:] == own[:-1]
                after, before = full + 1, full.copy()  # where the blank lines after a line end, and those before it begin
                after[:-1][same] = full[1:][same]
                before[1:][same] = full[:-1][same] + 1
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in ((full - top[own]).astype(np.int32), runs.of(full, after).view(np.int64), runs.of(before, full + 1).view(np.int64))]
                k, at = len(each), pa.array(each + first_text)
                yield pa.RecordBatch.from_arrays([kinds(k, 1), b.column(0).take(at), b.column(1).take(at), none(k, pa.int32()), none(k, pa.int32()), none(k, pa.int64()), *lists], names)

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(cut, f"kind int, id {kind}, th long, s int, n int, h long, at array<int>, left array<long>, right array<long>")


def without(text: pd.Series, spans: pd.Series) -> pd.DataFrame:
    """Texts without the runs of marked lines that are long enough. spans: first line * 2**32 + lines, for each marked chunk."""
    out = []
    for t, s in zip(text, spans):
        if t is None:
            out.append((None, 0, 0))
            continue
        if s is None or not len(s):
            out.append((t, t.count("\n") + 1, 0))
            continue
        lines = t.split("\n")
        marked = np.zeros(len(lines) + 1, np.int64)
        at = np.asarray(s, np.int64)
        np.add.at(marked, at >> 32, 1)
        np.add.at(marked, (at >> 32) + (at & 0xFFFFFFFF), -1)
        marked = np.cumsum(marked)[:-1] > 0
        edges = np.flatnonzero(np.diff(marked.view(np.int8), prepend=0, append=0))
        gone = np.zeros(len(lines), bool)
        for a, b in zip(edges[::2], edges[1::2]):
            n = sum(len(x.split()) for x in lines[a:b])
            if n >= LONG or (b - a >= SEVERAL and n >= ENOUGH):
                gone[a:b] = True
        kept = "\n".join(x for x, g in zip(lines, gone) if not g)
        out.append((kept, len(lines), int(gone.sum())))
    return pd.DataFrame(out, columns=["text", "n_lines", "removed_lines"]).astype({"text": object})


def _key(id_column: Column) -> Column:
    """A key of an id that is never null."""
    return F.coalesce(F.concat(F.lit("="), id_column.cast("string")), F.lit(""))


def _alike(a: str, b: str) -> Column:
    """How many elements two arrays begin with alike."""
    shorter = f"least(size({a}), size({b}))"
    differs = f"array_position(zip_with(slice({a}, 1, {shorter}), slice({b}, 1, {shorter}), (x, y) -> x = y), false)"
    return F.expr(f"CASE WHEN {differs} > 0 THEN CAST({differs} AS INT) - 1 ELSE {shorter} END")


def cover(spans: pd.Series) -> pd.Series:
    """For arrays of spans (first line * 2**32 + line after the last) which of them, fewest first to last, cover the same lines."""
    out = []
    for own in spans:
        at = np.asarray(own, np.int64)
        begin, end = at >> 32, at & 0xFFFFFFFF
        kept, best, reach = [], -1, -1  # best: the farthest of those that begin within what is covered
        for i in np.lexsort((-end, begin)).tolist():
            if begin[i] > reach:
                if best >= 0 and end[best] > reach:
                    kept.append(best)
                    reach = end[best]
                if begin[i] > reach:
                    kept.append(i)
                    reach, best = end[i], -1
                    continue
            if best < 0 or end[i] > end[best]:
                best = i
        if best >= 0 and end[best] > reach:
            kept.append(best)
        out.append(kept)
    return pd.Series(out)


def repeated_spans(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """For docs (id, th, text) two tables (key, th, spans). In the first, for every text that repeats what came before it, spans that cover all that it repeats:
    h, and the places of the lines that a chunk was extended by and of its own edge line, on the left (ls) and on the right (rs). The second has,
    for every text in which such a chunk is first, spans with its lines as far as others were extended by them."""
    found, lines = written_by(chunk_rows(docs), "kind", [0, 1], "chunks")
    found = found.select("id", "th", "s", "n", "h")
    lines = lines.select(_key(F.col("id")).alias("key"), "th", "at", "left", "right").dropDuplicates(["key", "th"])
    repeated = found.groupBy("h").agg(F.min(F.struct("id", "th", "s", "n")).alias("f"), F.count(F.lit(1)).alias("of")).where("of > 1")
    repeated = repeated.select("h", _key(F.col("f.id")).alias("key"), F.col("f.th").alias("th"), F.col("f.s").alias("s"), F.col("f.n").alias("n"))
    beside = lambda: (F.expr(f"reverse(slice(left, greatest(1, s - {REACH - 1}), least({REACH}, s)))").alias("ls"), F.expr(f"slice(right, s + n + 1, {REACH})").alias("rs"))
    edges = lambda left, right: F.struct("h", F.expr(f"slice(at, s - {left} + 1, {left} + 1)").alias("ls"), F.expr(f"slice(at, s + n, {right} + 1)").alias("rs"))
    repeated = repeated.join(lines, ["key", "th"])
    repeated = written(repeated.withColumns(dict(zip(("ls", "rs"), beside()))).select("h", F.col("key").alias("key0"), F.col("th").alias("th0"), F.col("s").alias("s0"), edges("size(ls)", "size(rs)").alias("span"), F.col("ls").alias("ls0"), F.col("rs").alias("rs0")), "repeated")
    marked = found.withColumn("key", _key(F.col("id"))).join(repeated.drop("span"), "h").where("NOT (key = key0 AND th = th0 AND s = s0)").select("key", "th", "h", "s", "n", "ls0", "rs0")
    marked = marked.join(lines, ["key", "th"]).select("key", "th", "h", "s", "n", "at", "ls0", "rs0", *beside())
    marked = marked.withColumns({"l": _alike("ls", "ls0"), "r": _alike("rs", "rs0")})
    spans = marked.groupBy("key", "th").agg(F.collect_set(edges("l", "r")).alias("spans"))
    kept = F.pandas_udf(cover, "array<int>")(F.expr("transform(spans, s -> shiftleft(CAST(s.ls[0] AS BIGINT), 32) + element_at(s.rs, -1) + 1)"))
    spans = written(spans.withColumn("kept", kept).select("key", "th", F.expr("transform(kept, i -> spans[i])").alias("spans")), "spans")
    forget(found)
    forget(lines)
    needed = spans.select(F.explode("spans").alias("s")).groupBy("s.h").agg(F.max(F.size("s.ls")).alias("l"), F.max(F.size("s.rs")).alias("r"))
    first = F.struct("span.h", F.expr("slice(span.ls, greatest(1, size(span.ls) - l + 1), l)").alias("ls"), F.expr("slice(span.rs, 1, r)").alias("rs"))
    firsts = repeated.join(needed, "h").select(F.col("key0").alias("key"), F.col("th0").alias("th"), first.alias("s"))
    firsts = written(firsts.groupBy("key", "th").agg(F.collect_list("s").alias("spans")), "first-spans")
    forget(repeated)
    return spans, firsts


def _unequal(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """(h, j): chunks (j = 0), and lines beyond them to the left (j < 0) or right, that differ in bytes under one hash. docs: key, th, text."""
    each = docs.join(spans, ["key", "th"]).select(F.split("text", "\n").alias("lines"), F.explode("spans").alias("s")).select("lines", "s.h", "s.ls", "s.rs")
    # lines a to b - 1: the chunk itself, each line on the left with the blank ones after it, each on the right with those before it
    parts = F.expr("""concat(array(struct(0 AS j, element_at(ls, -1) AS a, rs[0] + 1 AS b)),
        transform(slice(ls, 1, size(ls) - 1), (x, i) -> struct(i + 1 - size(ls) AS j, x AS a, ls[i + 1] AS b)),
        transform(slice(rs, 2, size(rs)), (x, i) -> struct(i + 1 AS j, rs[i] + 1 AS a, x + 1 AS b)))""")
    texts = each.withColumn("p", F.explode(parts)).select("h", "p.j", F.expr("array_join(slice(lines, p.a + 1, p.b - p.a), '\n')").alias("t"))
    return texts.groupBy("h", "j", "t").agg(F.lit(1).alias("one")).groupBy("h", "j").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h", "j")


def remove_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", whole: str | None = None) -> DataFrame:
    """docs with text_col cleaned, and n_lines and removed_lines (columns of these names are replaced); other columns stay.
    With whole, a column of that name keeps the text as it was.

    The first occurrence is that of the least id (nulls first), then of the least line. Rows alike in id and text count as
    one document, and all keep what is first there. A null text stays null, an empty one empty (one line); a text whose
    lines all repeat becomes empty. Rows are never dropped. Other columns may have any names. What is first of each line stays somewhere.

    A repeated passage is found if one of the rules cuts it twice: of two lines all but 3 in 10,000, of more lines nearly all; a line of LONG words always.
    Counting occurrences shuffles hashes only and is pre-aggregated; texts are shuffled once to be compared and once to be cleaned,
    by document. A chunk that a third of all rows share is one count on each side of the shuffle and a join key that adaptive execution can split.
    """
    spark = docs.sparkSession
    docs = docs.drop("n_lines", "removed_lines")
    th = F.xxhash64(docs[text_col])
    spans, firsts = repeated_spans(docs.select(docs[id_col].alias("id"), th.alias("th"), docs[text_col].alias("text")))
    release_shuffles(spark)
    both = spans.unionByName(firsts).groupBy("key", "th").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    unequal = written(_unequal(docs.select(_key(docs[id_col]).alias("key"), th.alias("th"), docs[text_col].alias("text")), both), "unequal")
    forget(firsts)
    release_shuffles(spark)
    if not unequal.isEmpty():  # chunks that differ under one hash stay; those whose neighbours do are not extended
        wrong = unequal.groupBy("h").agg(F.min(F.abs("j")).alias("least"))
        each = spans.select("key", "th", F.explode("spans").alias("s")).withColumn("h", F.col("s.h")).join(wrong, "h", "left").where("least IS NULL OR least > 0")
        edge = F.struct("s.h", F.when(F.col("least").isNull(), F.col("s.ls")).otherwise(F.slice("s.ls", -1, 1)).alias("ls"), F.when(F.col("least").isNull(), F.col("s.rs")).otherwise(F.slice("s.rs", 1, 1)).alias("rs"))
        kept = written(each.groupBy("key", "th").agg(F.collect_list(edge).alias("spans")), "spans")
        forget(spans)
        spans = kept
    forget(unequal)
    key, hashed, own, done = free_names(docs, "key", "hash", "spans", "done")
    marks = F.expr("transform(spans, s -> shiftleft(CAST(s.ls[0] AS BIGINT), 32) + element_at(s.rs, -1) + 1 - s.ls[0])")
    joined = docs.join(spans.select(F.col("key").alias(key), F.col("th").alias(hashed), marks.alias(own)), (_key(docs[id_col]) == F.col(key)) & (th == F.col(hashed)), "left")
    cleaned = joined.withColumn(done, F.pandas_udf(without, "text string, n_lines long, removed_lines long")(F.col(text_col), F.col(own)))
    part = lambda c: F.col(f"{done}.{c}")
    before = [F.col(text_col).alias(whole)] if whole else []
    return cleaned.select(*[part("text").alias(c) if c == text_col else F.col(c) for c in docs.columns], *before, part("n_lines").alias("n_lines"), part("removed_lines").alias("removed_lines"))
