"""How sources of one language differ in their terms: an inverted index of corrections to a baseline.

Every source gives every kept term of its language a share, also the terms that it does not have. The divergence of a pair
of sources is a sum over all kept terms. It starts as if both had no term at all: the number of terms times the value of two
counts of zero. Postings then correct it, and only where a source has a term: a source's own terms against the other's share of
an absent term, once for each distinct share; and what is left where both have it, from the postings of each term.

All arithmetic is in whole numbers: shares are parts of 10**9, divided digit by digit so that counts may be of any size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bytewords import LOWER, blocks
from .common import forget, release_shuffles, written

#: A term is kept in a language if so many of its documents have it. Terms told of a source.
DOCUMENTS, TERMS = 3, 200
#: Bytes of text counted at once, and pairs of postings of many terms corrected at once.
TOGETHER, PAIRS = 4_000_000, 1_000_000
#: Letters of a term: A to Z, a to z, and everything beyond ASCII.
LETTERS = np.zeros(256, bool)
LETTERS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of each term in each group, several rows for one in different blocks. docs: lang, source, text, none null."""

    together = TOGETHER

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, sources = b.column(0).dictionary_encode(), b.column(1).dictionary_encode()
            group = langs.indices.to_numpy().astype(np.int64) * len(sources.dictionary) + sources.indices.to_numpy()
            for first, _, block in blocks(b.column(2), together):
                begins, ends, text = block.words(LETTERS)
                if not len(begins):
                    continue
                offsets = np.concatenate([[0], np.cumsum(ends - begins)]).astype(np.int64)
                letters = LOWER[block.bytes[LETTERS[block.bytes] & block.inside]]
                coded = pa.Array.from_buffers(pa.large_string(), len(begins), [None, pa.py_buffer(offsets), pa.py_buffer(letters)]).dictionary_encode()
                k = len(coded.dictionary)
                own, n = np.unique(text.astype(np.int64) * k + coded.indices.to_numpy(), return_counts=True)  # each text's terms
                of, at = np.unique(group[first + own // k] * k + own % k, return_inverse=True)
                g, code = of // k, of % k
                yield pa.RecordBatch.from_arrays([
                    langs.dictionary.take(pa.array(g // len(sources.dictionary))), sources.dictionary.take(pa.array(g % len(sources.dictionary))), coded.dictionary.take(pa.array(code)).cast(pa.string()),
                    pa.array(np.bincount(at, n, len(of)).astype(np.int64)), pa.array(np.bincount(at, minlength=len(of)).astype(np.int64)),
                ], ["lang", "source", "term", "n", "docs"])

    return docs.select("lang", "source", "text").mapInArrow(count, "lang string, source string, term string, n long, docs long")


def share(n: str, total: str, kept: str) -> Column:
    """1 + floor(10**9 * (n + 1) / (total + kept)), three digits at a time; null if the divisor is 0. Arguments are names or SQL."""
    d = f"nullif({total} + {kept}, 0)"
    r0 = f"(({n} + 1) % {d})"
    r1 = f"({r0} * 1000 % {d})"
    r2 = f"({r1} * 1000 % {d})"
    return F.expr(f"1 + ({n} + 1) div {d} * 1000000000 + {r0} * 1000 div {d} * 1000000 + {r1} * 1000 div {d} * 1000 + {r2} * 1000 div {d}")


def divergence(p: str, q: str) -> str:
    """SQL of floor((p - q)**2 / q)."""
    return f"(({p} - {q}) * ({p} - {q}) div {q})"


def _f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


def corrections(counts: np.ndarray, source: np.ndarray, p: np.ndarray, p0: np.ndarray, most: int = PAIRS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For terms with so many postings each (source: a number, p and p0: its shares of this and of an absent term), in parts of
    bounded size: left source, right source and what both having the term adds to what each having it alone does; zeros left out."""
    begins = np.concatenate([[0], np.cumsum(counts)])
    width = np.repeat(counts, counts)  # of each posting: as many partners, and where they begin
    start = np.repeat(begins[:-1], counts)
    pairs = np.concatenate([[0], np.cumsum(width)])
    i = 0
    while i < len(source):
        j = max(i + 1, int(np.searchsorted(pairs, pairs[i] + most, "right")) - 1)
        for part in range(0, int(width[i]) if j == i + 1 else 1, most):  # one posting may have many partners
            w = width[i:j] if j > i + 1 else np.minimum(width[i:j] - part, most)
            left = np.repeat(np.arange(i, j), w)
            right = start[left] + part + np.arange(len(left)) - np.repeat(np.cumsum(w) - w, w)
            left, right = left[left != right], right[left != right]
            x = _f(p[left], p[right]) - _f(p[left], p0[right]) - _f(p0[left], p[right]) + _f(p0[left], p0[right])
            on = x != 0
            yield source[left[on]], source[right[on]], x[on]
        i = j


def _both(postings: DataFrame) -> DataFrame:
    """(lang, source, item, value) for postings (lang, sources: source, p, p0 of each): corrections where both have a term, summed by task or by many pairs."""

    most = PAIRS

    def correct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: dict[tuple[str, str], int] = {}
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def told() -> Iterator[pa.RecordBatch]:
            if held:
                keys, at = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
                value = np.zeros(len(keys), np.int64)
                np.add.at(value, at, np.concatenate([v for _, v in held]))
                known = list(names)
                a, b = keys >> 32, keys & 0xFFFFFFFF
                yield pa.RecordBatch.from_arrays([pa.array([known[i][0] for i in a], pa.string()), pa.array([known[i][1] for i in a], pa.string()), pa.array([known[i][1] for i in b], pa.string()), pa.array(value)], ["lang", "source", "item", "value"])
            held.clear()
            names.clear()

        for b in batches:
            lists = b.column(1)
            counts = lists.value_lengths().to_numpy().astype(np.int64)
            flat = lists.flatten()
            coded, langs = flat.field("source").dictionary_encode(), b.column(0).dictionary_encode()
            known_langs, known = langs.dictionary.to_pylist(), coded.dictionary.to_pylist()
            # numbers of (lang, source), the same in all batches until they are told
            both, at = np.unique(np.repeat(langs.indices.to_numpy().astype(np.int64), counts) << 32 | coded.indices.to_numpy(), return_inverse=True)
            number = np.array([names.setdefault((known_langs[x >> 32], known[x & 0xFFFFFFFF]), len(names)) for x in both.tolist()], np.int64)
            for left, right, x in corrections(counts, number[at], flat.field("p").to_numpy(), flat.field("p0").to_numpy(), most):
                keys, of = np.unique(left << 32 | right, return_inverse=True)
                value = np.zeros(len(keys), np.int64)
                np.add.at(value, of, x)
                held.append((keys, value))
            if sum(len(k) for k, _ in held) > 2 * most:
                yield from told()
        yield from told()

    return postings.select("lang", "sources").mapInArrow(correct, "lang string, source string, item string, value long")


def audit_sources(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """lang, source, part, item, value, rank.

    Terms are runs of A-Z, a-z and characters beyond ASCII, A-Z lower-cased; a language keeps those that at least DOCUMENTS of
    its documents (rows) have. Part 'pair': item is each other source of the language, value the sum over all kept terms (0
    without any). Part 'term': item is each kept term that the source has with a greater share than the language, up to rank
    TERMS. Ranks count from 1 in each source and part, by value descending, then by item in UTF-8 order. Null language,
    source and text are ''; a source without terms is one too; an empty table has no rows; other columns are ignored.

    Counts are pre-aggregated by block of text before the shuffle. The postings of a term are as many as its language has sources.
    """
    spark = docs.sparkSession
    own = docs.select(*[F.coalesce(docs[c].cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])
    counted = term_counts(own).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    kept = counted.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"), F.collect_list(F.struct("source", "n")).alias("sources"))
    kept = written(kept.where(F.col("docs") >= DOCUMENTS).drop("docs"), "kept-terms")
    release_shuffles(spark)
    of_lang = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("total").alias("lang_total"))
    of_group = kept.select("lang", F.explode("sources").alias("s")).groupBy("lang", "s.source").agg(F.sum("s.n").alias("group_total"))
    groups = own.select("lang", "source").distinct().join(of_group, ["lang", "source"], "left").join(of_lang, "lang", "left")
    groups = groups.select("lang", "source", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("group_total", "v", "lang_total")])
    groups = written(groups.withColumn("p0", share("0", "group_total", "v")), "groups")

    flat = kept.select("lang", "term", "total", F.explode("sources").alias("s")).select("lang", "term", "total", "s.source", "s.n").join(groups, ["lang", "source"])
    weights = written(flat.select("lang", "source", "term", share("n", "group_total", "v").alias("p"), share("total", "lang_total", "v").alias("q"), "p0"), "weights")
    forget(kept)
    release_shuffles(spark)

    terms = weights.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr(divergence("p", "q")).alias("value"))
    by = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    terms = terms.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= TERMS)

    other = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"))
    pairs = groups.join(other, "lang").where("source <> item").select("lang", "source", "item", "v", "p0", "q0")
    start = pairs.select("lang", "source", "item", F.coalesce(F.expr(f"v * {divergence('p0', 'q0')}"), F.lit(0)).alias("value"))
    shares = written(weights.groupBy("lang", "source", "p").agg(F.count(F.lit(1)).alias("n")), "shares")  # what a source's terms have in common
    one = lambda side, change: pairs.join(shares.withColumnRenamed("source", side), ["lang", side]).select("lang", "source", "item", F.expr(f"n * ({change} - {divergence('p0', 'q0')})").alias("value"))
    postings = weights.groupBy("lang", "term").agg(F.collect_list(F.struct("source", "p", "p0")).alias("sources")).where(F.size("sources") > 1)
    corrected = start.unionByName(one("source", divergence("p", "q0"))).unionByName(one("item", divergence("p0", "p"))).unionByName(_both(postings))
    value = corrected.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).withColumn("part", F.lit("pair"))
    ranked = written(value.withColumn("rank", F.row_number().over(by)).select("lang", "source", "part", "item", "value", "rank"), "pairs")
    return ranked.unionByName(terms.select(ranked.columns))
