"""Operators over a whole corpus, against brute force."""

import collections
import gzip
import itertools
import math
import random
import re
import time
import zlib

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from dayroll.llm import components, decontaminate, line_dedup, neighbours, queries, sharding, similarity, warc

WORDS = [a + b for a in ("ba", "do", "ki", "lu", "me", "no", "pa", "ri") for b in ("", "n", "st", "lar", "vo", "x", "mi")]


def words(r, n):
    return [r.choice(WORDS) + r.choice("abcdefgh") for _ in range(n)]


def texts():
    """Base texts, near copies at several distances, exact copies, shared passages, odd ones."""
    r = random.Random(5)
    out = []
    for _ in range(12):
        base = words(r, r.choice([8, 30, 60, 120]))
        out.append(" ".join(base))
        for edits in (0, 1, 1, 2, 3, 5):
            t = list(base)
            for _ in range(edits):
                t[r.randrange(len(t))] = r.choice(WORDS) + "q"
            out.append(" ".join(t))
    hub = words(r, 150)
    for _ in range(40):  # a dense group
        t = list(hub)
        t[r.randrange(150)] = r.choice(WORDS) + "z"
        out.append(" ".join(t))
    passage = " ".join(words(r, 20))
    out += [f"{' '.join(words(r, 60))} {passage}" for _ in range(15)]
    return out + ["", None, " \t\n", "one", "one", "One", "two words", "a b c d", "a b c d e", "A\tB\nc d  e"]


def sets_of(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def groups(n, linked):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_similar_texts_against_all_pairs(spark):
    rows = texts()
    docs = spark.createDataFrame([(i, t, 7, "c", 1, 2) for i, t in enumerate(rows)], "doc_id long, text string, node int, component_id string, _ID int, _hash int")
    s = [sets_of(t) for t in rows]
    linked = [(i, j) for j in range(len(s)) for i in range(j) if s[i] and s[j] and 100 * len(s[i] & s[j]) >= 80 * len(s[i] | s[j])]
    want, links = groups(len(rows), linked), collections.Counter(x for p in linked for x in p)
    got = {r.doc_id: r for r in similarity.similar(docs).collect()}
    assert len(got) == len(rows) and len({*want}) < len(rows) - 60
    for i in range(len(rows)):
        assert (got[i].n_shingles, got[i].component_id, got[i].n_links) == (len(s[i]), want[i], links[i]), i
    kept = {r.doc_id for r in similarity.one_of_each(docs).collect()}
    assert kept == {want[i] for i in range(len(rows)) if s[i]} | {i for i in range(len(rows)) if not s[i]}


def test_links_are_counted_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(similarity, "MEET_NODES", 7)
    monkeypatch.setattr(similarity, "MEET_VALUES", 500)
    monkeypatch.setattr(similarity, "BUCKET_KEYS", 300)
    monkeypatch.setattr(similarity, "HUBS", 1)
    test_similar_texts_against_all_pairs(spark)


def test_components_that_meet_after_the_hubs(spark):
    # chains of texts in which each shares enough with the next alone, and whose hubs see few of them
    r = random.Random(12)
    rows = []
    for n in (40, 25):
        w = words(r, 60 + 4 * n)
        rows += [" ".join(w[4 * i : 4 * i + 60]) for i in range(n)]
    s = [sets_of(t) for t in rows]
    linked = [(i, j) for j in range(len(s)) for i in range(j) if 100 * len(s[i] & s[j]) >= 80 * len(s[i] | s[j])]
    want, links = groups(len(rows), linked), collections.Counter(x for p in linked for x in p)
    got = similarity.similar(spark.createDataFrame([*enumerate(rows)], "doc_id long, text string")).collect()
    assert len(linked) > 60 and {(x.doc_id, x.component_id, x.n_links) for x in got} == {(i, want[i], links[i]) for i in range(len(rows))}


def test_common_shingles_of_long_texts_are_found():
    r = np.random.default_rng(3)
    c = similarity.Common()
    for _ in range(200):
        keys = np.unique(np.concatenate([[5, 7], r.integers(100, 1 << 40, 500)]).astype(np.uint64))
        c.add(keys, np.ones(len(keys), np.int64), 2000)
    assert {5, 7} <= set(c.keys.tolist()) and len(c.keys) <= 2000 and c.counts[c.keys == 5][0] >= 200 - 200 * 502 / 2000


def test_similar_texts_of_odd_tables(spark):
    schema = "doc_id long, text string"
    assert similarity.similar(spark.createDataFrame([], schema)).count() == 0
    docs = spark.createDataFrame([(None, "a b c d e f"), (None, "a b c d e f"), (3, "a b c d e f"), (4, None), (4, None), (5, "z " * 40_000), (5, "z " * 40_000)], schema)
    got = collections.Counter((r.doc_id, r.component_id) for r in similarity.similar(docs).collect())
    assert got == {(None, 3): 2, (3, 3): 1, (4, 4): 2, (5, 5): 2}
    kept = collections.Counter(r.doc_id for r in similarity.one_of_each(docs).collect())
    assert kept == {3: 1, 4: 2, 5: 1}


def test_line_dedup_keeps_first_occurrences(spark):
    r = random.Random(2)
    line = lambda n: " ".join(words(r, n))
    passage, long_line, short = [line(12) for _ in range(6)], line(60), line(6)
    docs, clean = [], []
    for i in range(30):
        own = [line(10) for _ in range(4)]
        body = own[:2] + (passage if i % 3 == 0 else []) + ([long_line] if i % 5 == 1 else []) + own[2:3] + [short] + own[3:]
        docs.append((i, "\n".join(body)))
        clean.append("\n".join(own[:2] + (passage if i == 0 else []) + ([long_line] if i == 1 else []) + own[2:3] + [short] + own[3:]))
    rows = docs + [(100, None), (101, ""), (102, "\n\n"), (103, docs[7][1]), (None, docs[8][1]), (104, "w " * 50_000)]
    df = spark.createDataFrame([(*x, 3, "h") for x in rows], "doc_id long, text string, n_lines int, h string")
    got = {x.doc_id: x for x in line_dedup.remove_repeated_lines(df).collect()}
    assert len(got) == len(rows)
    for i, want in enumerate(clean):
        if i != 8:
            assert got[i].text == want, i
    assert got[100].text is None and got[101].text == "" and got[102].text == "\n\n" and got[104].text == "w " * 50_000
    assert short in got[103].text or got[103].text == ""
    assert got[None].text == "\n".join(docs[8][1].split("\n")) and got[8].text != docs[8][1]  # nulls come first
    assert line_dedup.remove_repeated_lines(df.limit(0)).count() == 0


def test_repeated_passages_go_whole_whatever_stands_around_them(spark):
    r = random.Random(6)
    line = lambda n: " ".join(words(r, n))
    passages = [[line(30), line(30)], [line(20), "", "", "", line(20), "", line(20)], [line(9) for _ in range(7)]]
    own = [(line(10), line(10)) for _ in range(300)]
    docs = [(i, "\n".join([a, *passages[i % 3], b])) for i, (a, b) in enumerate(own)]
    got = {x.doc_id: x.text for x in line_dedup.remove_repeated_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert [i for i in range(3) if got[i] != docs[i][1]] == []
    assert [i for i in range(3, 300) if got[i] != "\n".join(own[i])] == []


def test_the_rules_cut_what_is_found(spark, monkeypatch):
    """Two neighbouring lines of 20 and 15 words are found by the rules' chunks and their extension; without either they stay."""
    r = random.Random(16)
    line = lambda n: " ".join(words(r, n))
    passages = [[line(20), line(15)] for _ in range(40)]
    docs = [(40 * k + i, "\n".join([line(9), *p, line(9)])) for k in range(2) for i, p in enumerate(passages)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    gone = lambda: sum(x.removed_lines == 2 for x in line_dedup.remove_repeated_lines(df).collect())
    assert gone() == 40
    monkeypatch.setattr(line_dedup, "RULES", line_dedup.RULES[:1])
    one_rule = gone()
    monkeypatch.setattr(line_dedup, "_alike", lambda a, b: F.lit(0))  # chunks as they are, without their extension
    assert gone() < one_rule < 35
    monkeypatch.setattr(line_dedup, "RULES", ())
    assert gone() == 0


def test_what_is_first_of_each_line_stays(spark):
    r = random.Random(31)
    pool = [" ".join(words(r, r.choice([3, 12, 20, 30, 55]))) for _ in range(30)]
    run = lambda k: pool[k : k + r.randrange(1, 7)]
    docs = [(i, "\n".join(x for _ in range(r.randrange(1, 4)) for x in run(r.randrange(30)))) for i in range(200)]
    got = line_dedup.remove_repeated_lines(spark.createDataFrame(docs, "doc_id long, text string"), whole="before").collect()
    assert {x.before for x in got} == {t for _, t in docs} and sum(x.removed_lines for x in got) > 500
    assert {x for d in got for x in d.text.split("\n")} >= {x for _, t in docs for x in t.split("\n")}


def test_lines_beside_a_chunk_are_compared_too(spark, monkeypatch):
    r = random.Random(8)
    long_line, near = " ".join(words(r, 60)), [" ".join(words(r, 12)) for _ in range(6)]
    docs = spark.createDataFrame([(i, f"{near[i]}\n{long_line}") for i in range(6)], "doc_id long, text string")
    real = line_dedup.chunk_rows
    monkeypatch.setattr(line_dedup, "chunk_rows", lambda d: real(d).withColumn("left", F.expr("transform(left, x -> 1L)")))  # all lines look alike from the right
    assert sorted(x.text for x in line_dedup.remove_repeated_lines(docs).collect()) == sorted([f"{near[0]}\n{long_line}", *near[1:]])


def test_spans_that_cover_the_same_lines():
    r = random.Random(1)
    lines = lambda spans: {i for a, b in spans for i in range(a, b)}
    for _ in range(2000):
        spans = [(a, a + r.randrange(1, 6)) for a in (r.randrange(20) for _ in range(r.randrange(9)))]
        kept = line_dedup.cover(pd.Series([[a << 32 | b for a, b in spans]]))[0]
        assert lines(spans) == lines([spans[i] for i in kept]) and len(kept) == len(set(kept))
    assert line_dedup.cover(pd.Series([[i << 32 | i + 9 for i in range(40)]]))[0] == [0, 9, 18, 27, 36, 39]


def removed(lines, marks):
    """Numbers of the lines that go if these are marked."""
    out, i = set(), 0
    while i < len(lines):
        j = i
        while j < len(lines) and marks[j]:
            j += 1
        n = sum(len(x.split()) for x in lines[i:j])
        if n >= 50 or (j - i >= 2 and n >= 25):
            out |= {*range(i, j)}
        i = max(j, i + 1)
    return out


def test_line_dedup_between_what_must_go_and_what_may_go(spark):
    """All pairs of neighbouring lines and all long lines that occurred before must go where they are enough; nothing that did not occur before may."""
    r = random.Random(21)
    pool = [" ".join(words(r, r.choice([1, 4, 9, 14, 30, 45, 60]))) for _ in range(40)]
    docs = []
    for i in range(160):
        lines = []
        for _ in range(r.randrange(12)):
            k = r.random()
            at = r.randrange(40)
            lines += pool[at : at + r.randrange(1, 6)] if k < 0.4 else [r.choice(["", "  "])] if k < 0.55 else [" ".join(words(r, r.randrange(1, 15)))]
        docs.append((i, "\n".join(lines)))
    got = {x.doc_id: x.text for x in line_dedup.remove_repeated_lines(spark.createDataFrame([(*x, 1, 2, 3, "d") for x in docs], "doc_id long, text string, _id int, _th int, _spans int, _DONE string")).collect()}
    seen, went = set(), 0
    for i, text in docs:
        lines = text.split("\n")
        full = [k for k, x in enumerate(lines) if x.strip()]
        must, may = [False] * len(lines), [not x.strip() for x in lines]
        for a, b in zip(full, full[1:]):
            chunk = "\n".join(lines[a : b + 1])
            if chunk in seen:
                must[a : b + 1] = [True] * (b + 1 - a)
            seen.add(chunk)
        for k in full:
            if lines[k] in seen:
                may[k] = True
                must[k] |= len(lines[k].split()) >= 40
            seen.add(lines[k])
        least, most = removed(lines, must), removed(lines, may)
        kept = got[i].split("\n") if got[i] else []
        n = len(kept)
        assert len(lines) - len(most) <= n + (n == 0) and n <= max(len(lines) - len(least), 1), (i, n, len(lines), len(least), len(most))
        # what is kept is a subsequence that holds every line that may not go
        at = iter(kept)
        assert all(any(x == y for y in at) for k, x in enumerate(lines) if k not in most and x.strip()), i
        went += len(least)
    assert went > 100


def test_chunks_that_differ_under_one_hash_stay(spark, monkeypatch):
    r = random.Random(4)
    docs = spark.createDataFrame([(i, " ".join(words(r, 60))) for i in range(6)], "doc_id long, text string")
    real = line_dedup.chunk_rows
    monkeypatch.setattr(line_dedup, "chunk_rows", lambda d: real(d).withColumn("h", F.lit(1).cast("long")))
    assert {x.removed_lines for x in line_dedup.remove_repeated_lines(docs).collect()} == {0}


def test_near_vectors_against_all_pairs(spark):
    r = np.random.default_rng(1)
    base = r.normal(size=(40, 24))
    v = np.concatenate([base, base[:20] + 0.02 * r.normal(size=(20, 24)), base[:10] * 3, base[:1] + 0.01 * r.normal(size=(60, 24)), base[5:25] + 0.35 * r.normal(size=(20, 24))])
    label = r.integers(0, 2, len(v))
    label[:80] = 0
    rows = [(i, [float(np.float32(y)) for y in x], int(l)) for i, (x, l) in enumerate(zip(v, label))]
    n = len(rows)
    rows += [(n, None, 0), (n + 1, [0.0] * 24, 0), (n + 2, [float("nan")] * 24, 0), (n + 3, rows[0][1], None), (n + 4, [None] * 24, 0), (n + 5, [], 0), (n + 6, rows[0][1][:5], 0), (n + 7, rows[0][1], 0), (n + 8, rows[0][1], 0)]
    df = spark.createDataFrame([(*x, "n") for x in rows], "vec_id long, embedding array<float>, label int, n string")
    ok = [i for i, x, l in rows if l is not None and x and None not in x and np.isfinite(x).all() and np.any(x)]
    vec = {i: np.array(rows[i][1]) for i in ok}
    cos = lambda a, b: a @ b / np.sqrt((a @ a) * (b @ b))
    linked = [(i, j) for j in ok for i in ok if i < j and rows[i][2] == rows[j][2] and len(vec[i]) == len(vec[j]) and cos(vec[i], vec[j]) >= 0.93]
    want, links = groups(len(rows), linked), collections.Counter(x for p in linked for x in p)
    got = {x.vec_id: x for x in neighbours.near_duplicates(df).collect()}
    assert len(linked) > 500 and len(got) == len(rows)
    for i in range(len(rows)):
        assert tuple(got[i]) == (i, links[i], want[i], want[i] == i), i
    assert neighbours.near_duplicates(df.limit(0)).count() == 0


def test_blocks_of_one_label_meet(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 8)
    monkeypatch.setattr(neighbours, "CODES", 16)
    test_near_vectors_against_all_pairs(spark)


@pytest.mark.parametrize("dimension", [24, 64, 100])
def test_estimates_are_unbiased_and_bounded(dimension):
    r = np.random.default_rng(0)
    x = neighbours.unit_rows(r.normal(size=(300, dimension)))
    y = neighbours.unit_rows(x + r.normal(size=x.shape) * 0.25 / np.sqrt(dimension))
    turn = neighbours.rotation(dimension)
    a, b = (neighbours.Codes.of(z, turn, np.arange(300) + k) for k, z in ((0, x), (999, y)))
    back = neighbours.Codes.read(pa.array(a.bytes_of(), pa.binary()), dimension)
    assert (back.estimates(b) == a.estimates(b)).all()
    # the code's inner product with the rounded coordinates, by definition
    code = a.low[:, None] + a.step[:, None] * (a.level + 0.5)
    rounded = b.low[:, None] + b.step[:, None] * (b.level.astype(int) + b.up)
    assert np.allclose(a.correction, (code * (x @ turn.T)).sum(axis=1)) and np.allclose(code @ rounded.T / a.correction[:, None], a.estimates(b))
    off = a.estimates(b) - x @ y.T
    assert abs(off.mean()) < 0.003 and abs(np.diag(off).mean()) < 0.02 and (np.abs(off) <= neighbours.WIDTH * a.errors(b)).mean() > 0.9999


@pytest.mark.parametrize("dimension, least", [(64, 0.9), (128, 0.91), (384, 0.92)])
def test_the_bound_tells_cosines_apart(dimension, least):
    """Of pairs of a cosine of 0.85 none is a candidate for 0.93, nor of those a little below; of those at 0.93 every one is. Codes are less than a fifth of what float64s take."""
    r = np.random.default_rng(dimension)
    x = neighbours.unit_rows(r.normal(size=(2000, dimension)))
    other = r.normal(size=x.shape)
    other = neighbours.unit_rows(other - (other * x).sum(axis=1, keepdims=True) * x)
    turn = neighbours.rotation(dimension)
    a = neighbours.Codes.of(x, turn, np.arange(2000))
    of = lambda c: neighbours.Codes.of(c * x + np.sqrt(1 - c * c) * other, turn, np.arange(2000) + 5000)
    share = lambda c: np.diag(a.candidates(of(c), 0.93)).mean()
    assert share(0.85) == 0 and share(least - 0.035) < 0.01 and share(0.9301) == 1 and share(0.96) == 1
    assert len(a.bytes_of()[0]) <= 8 * dimension / 5


def test_thousands_of_vectors_with_links_near_the_threshold(spark, monkeypatch):
    """Vectors in clusters, in several cells and blocks; cosines lie close about the threshold. Links are those of all pairs, and few vectors are shuffled to all cells."""
    monkeypatch.setattr(neighbours, "CODES", 200)
    monkeypatch.setattr(neighbours, "BLOCK", 150)
    r = np.random.default_rng(9)
    centers = neighbours.unit_rows(r.normal(size=(12, 64)))
    v = neighbours.unit_rows(centers[r.integers(0, 12, 2600)] + r.normal(size=(2600, 64)) * 0.034)
    label = (np.arange(2600) % 13 == 0).astype(int)
    df = spark.createDataFrame([(i, x.tolist(), int(l)) for i, (x, l) in enumerate(zip(v, label))], "vec_id long, embedding array<double>, label int")
    linked = (v @ v.T >= 0.93) & (label[:, None] == label[None, :])
    np.fill_diagonal(linked, False)
    got = {x.vec_id: x for x in neighbours.near_duplicates(df).collect()}
    near = ((v @ v.T >= 0.91) & (v @ v.T < 0.95)).sum()
    assert linked.sum() > 20_000 and near > 20_000
    assert [got[i].n_links for i in range(2600)] == linked.sum(axis=1).tolist()
    want = groups(2600, zip(*(x.tolist() for x in np.nonzero(linked))))
    assert [got[i].component_id for i in range(2600)] == want
    classes = df.select(F.col("label").alias("l"), F.col("embedding").alias("v"), F.size("embedding").alias("d"), F.xxhash64("vec_id").alias("h"), F.col("vec_id").alias("rep"))
    centres = neighbours.cell_centres(classes)
    cells = neighbours.with_near_cells(neighbours.with_codes(classes, centres), centres, 0.93).where("l = 0")
    assert len(centres[0, 64]) == 24 and cells.agg(F.avg(F.size("near"))).first()[0] < 16


def test_components(spark):
    r = random.Random(1)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(400, 460)] + [(7, 7), (None, 3), (500, 400)]
    want = groups(501, [(a, b) for a, b in edges if a is not None])
    got = {x.node: x.component for x in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: c for i, c in enumerate(want) if c != i}


def test_shards_are_even_and_gapless(spark):
    r = random.Random(0)
    rows = [(i, "x" * r.randrange(2000)) for i in range(3000)] + [(i, "copy of one text " * 20) for i in range(3000, 4500)] + [(None, None), (5000, ""), (5001, "y" * 30_000), (3, "again"), (3, "again")]
    df = spark.createDataFrame([(*x, 1, 2, 3, 4) for x in rows], "doc_id long, text string, shard int, _high int, _low int, _at int")
    got = sharding.shard_documents(df, carry=("_high", "_low", "_at")).toPandas()
    assert set(got._high) == {2} and set(got._low) == {3} and set(got["_at"]) == {4} and len(got) == len(rows) and set(got.law) == {"bytes"} and got.grown_shard.isna().all()
    per = got.groupby("shard").agg(b=("size", "sum"), n=("slot", "size"), top=("slot", "max"), u=("slot", "nunique"))
    assert len(per) == 24 and (per.n == per.top + 1).all() and (per.n == per.u).all()
    assert per.b.max() <= 1.01 * per.b.mean() + 30_008 and per.b.drop(per.b.idxmax()).max() <= 1.02 * per.b.mean()
    assert got.set_index("doc_id").loc[5000, ["size", "text_crc32"]].tolist() == [8, 0]
    assert sharding.shard_documents(df.limit(0)).count() == 0
    few = sharding.shard_documents(df.limit(5)).toPandas()
    assert len(few) == 5 and few.shard.between(0, 23).all()


def test_shards_against_all_possible_boundaries(spark):
    """Rows lie in the order of all keys, sorted on one machine, and each boundary is as near to its place as promised, or as the nearest key there is."""
    docs = queries.table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text")
    size = (F.octet_length(F.coalesce("text", F.lit(""))) + 8).alias("size")
    keys = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"), size).toPandas().sort_values(["h", "doc_id"], ignore_index=True)
    got = sharding.shard_documents(docs, 24).toPandas().sort_values(["shard", "slot"], ignore_index=True)
    assert got.doc_id.tolist() == keys.doc_id.tolist() and got["size"].tolist() == keys["size"].tolist()
    below, part = np.concatenate([[0], np.cumsum(keys["size"])]), keys["size"].sum() / 24
    for k in range(1, 24):
        off = abs(below[(got.shard < k).sum()] - k * part)
        assert off <= max(0.004 * part, np.abs(below - k * part).min()), k


def test_write_shards(spark, tmp_path):
    df = spark.createDataFrame([(i, f"text {i}") for i in range(200)], "doc_id long, text string")
    sharding.write_shards(df, str(tmp_path / "s"), 4)
    back = spark.read.parquet(str(tmp_path / "s")).toPandas()
    assert len(back) == 200 and set(back.shard) == {0, 1, 2, 3} and (back.text == "text " + back.doc_id.astype(str)).all()


def test_warc_records(spark, tmp_path):
    html = '<html><head><title>A &amp; B</title><style>p{}</style></head><body><!-- x --><SCRIPT>var t="</p>";</script ><a class="k" href="/x?a=1">link</a><p>One<br>two &#233;&lt;b&gt;</p>&#xx; &#99999999;</body>'
    pages = spark.createDataFrame([(1, "http://a/", html, 0), (2, None, None, 0), (None, "u", "", 0), (3, "u", "<p>" + "z " * 100_000, 0), (1, "http://a/", html, 0)], "page_id long, url string, html string, block int")
    out = warc.derivatives(warc.responses(pages, "2024-01-01T00:00:00Z"))
    got = {(r.page_id, r.record_type): r for r in out.collect()}
    assert out.count() == 10
    m, c = got[1, "metadata"], got[1, "conversion"]
    assert c.block == "A & B\nlink\nOne\ntwo é<b>\n&#xx; &#99999999;"
    assert "title: A &amp; B\r\n" in m.block and "outlink: /x?a=1 L a/@href\r\n" in m.block and f"conversion: {c.record_id}\r\n" in m.block and "source-header: HTTP/1.1 200 OK\r\n" in m.block
    assert m.refers_to == c.refers_to and f"WARC-Refers-To: {c.refers_to}\r\n" in c.headers and c.content_length == len(c.block.encode())
    assert "WARC-Target-URI" not in got[2, "metadata"].headers and got[2, "conversion"].block == ""
    warc.write_warc(out.where("page_id = 1").coalesce(1), str(tmp_path / "w"))
    text = "".join(r.value for r in spark.read.text(str(tmp_path / "w"), wholetext=True).collect())
    assert text.count("WARC/1.1\r\n") == 5 and text.endswith("\r\n\r\n")
    assert warc.derivatives(warc.responses(pages.limit(0), "d")).count() == 0


def members(data):
    out = []
    while data:
        z = zlib.decompressobj(31)
        out.append(z.decompress(data))
        assert z.eof
        data = z.unused_data
    return out


def test_every_record_is_a_member_of_its_own(spark, tmp_path):
    pages = spark.createDataFrame([(k, f"http://a/{k}", f"<title>{k}</title><p>é {k} \0 \n WARC/1.1") for k in range(20)] + [(20, "u", "<p>" + "ab c" * 4_400_000)], "page_id long, url string, html string")
    out = warc.derivatives(warc.responses(pages, "2024-01-01T00:00:00Z"))
    warc.write_warc(out.repartition(3, "page_id"), str(tmp_path / "w"))
    want = {r.record_id: f"{r.headers}\r\n{r.block}\r\n\r\n".encode() for r in out.collect()}
    files = sorted((tmp_path / "w").glob("part-*"))
    assert len(files) == 3 and all(f.name.endswith(".warc.gz") for f in files)
    got, infos, empty = {}, set(), 0
    for f in files:
        first, *rest = members(f.read_bytes())
        head, block = first.split(b"\r\n\r\n", 1)
        assert b"WARC-Type: warcinfo\r\n" in head and int(re.search(rb"Content-Length: (\d+)", head)[1]) == len(block) - 4
        infos.add(re.search(rb"WARC-Record-ID: (\S+)", head)[1])
        empty += rest.count(b"")
        got |= {re.search(rb"WARC-Record-ID: (\S+)", x)[1].decode(): x for x in rest if x}
    assert got == want and len(infos) == 3 and empty == 1
    assert spark.read.text(str(tmp_path / "w"), wholetext=True).count() == 3
    warc.write_warc(out.limit(0), str(tmp_path / "none"))
    assert not any(f.stat().st_size for f in (tmp_path / "none").glob("part-*"))
    with pytest.raises(Exception, match="without headers"):
        warc.write_warc(out.withColumn("block", F.lit(None).cast("string")), str(tmp_path / "null"))


def test_warc_headers_and_identifiers(spark):
    rows = [(None, "http://a/\r\nEvil: 1", "<p>one"), (None, "http://a/\r\nEvil: 1", "<p>two"), (None, "http://a/\r\nEvil: 1", "<p>two")]
    out = warc.derivatives(warc.responses(spark.createDataFrame([(*x, "h", "b", "l", "t") for x in rows], "page_id long, url string, html string, headers string, block string, length string, text string"), "d")).collect()
    assert len({x.record_id for x in out}) == 4 and all("\r\nEvil" not in x.headers and "%0D%0AEvil: 1\r\n" in x.headers for x in out)


def test_unclosed_tags_cost_linear_time():
    began = time.time()
    for unit in ("<!-- a ", "<a x ", "<a href= ", '<a href="', "<script ", "<script>", "</script ", "<p ", "<", "<title", "<title>"):
        for page in (unit * (1_000_000 // len(unit)), unit * (1_000_000 // len(unit)) + ">"):
            warc.page_text(page), warc.page_title(page), warc.page_links(page)
    assert time.time() - began < 20


def test_page_parts_against_regular_expressions():
    r = random.Random(8)
    units = ["<!--", "-->", "<script>", "<script a=b>", "</script >", "<STYLE>", "</style>", "<p>", "<br/>", "</div\n>", "<b <p>", "<pq>", "<", ">", "text", " ", "\t \t", "\n", "&lt;", "&amp;lt;", "&#65;", "&#0;", "&#55296;", "<title>", "</title>", "<a href='x'", '<a x href = "u>v"', ' href="w"', "<a ", '"', "é"]
    flags = re.A
    for _ in range(4000):
        page = "".join(r.choice(units) for _ in range(r.randrange(25)))
        t = re.sub(r"(?is)<!--.*?-->|" + "|".join(rf"<{x}[^>]*>.*?</{x}\s*>" for x in warc.HIDDEN), "", page, flags=flags)
        t = re.sub(rf"(?i)</?({warc.BREAKS})(\s[^>]*)?/?>", "\n", t, flags=flags)
        t = re.sub("<[^>]*>", "", t)
        t = re.sub("&#([0-9]{1,7});", lambda m: chr(int(m[1])) if 0 < int(m[1]) < 0xD800 else m[0], t)
        for name, char in warc.REFERENCES.items():
            t = t.replace(f"&{name};", char)
        t = re.sub(" ?\n[ \n]*", "\n", re.sub("[ \t\r\f]{2,}|[\t\r\f]", " ", t)).strip(" \n")
        assert warc.page_text(page) == t, page
        m = re.search(r"(?is)<title[^>]*>(.*?)</title\s*>", page, flags)
        assert warc.page_title(page) == (m[1] if m else ""), page
        assert warc.page_links(page) == re.findall(r'(?i)<a\s[^>]*?href\s*=\s*"([^"]*)"', page, flags), page


def test_responses_are_read_from_files(spark, tmp_path):
    http = "HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n"
    body = "<title>é</title>\r\n\r\n<p>WARC/1.1 is no record"
    records = []
    for kind, block in (("warcinfo", "software: x\r\n"), ("response", f"{http}\r\n{body}"), ("request", "GET / HTTP/1.1\r\n\r\n"), ("response", f"{http}\r\n")):
        records.append(f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:{len(records)}>\r\nWARC-Target-URI: http://a/{len(records)}\r\nWARC-Date: d\r\ncontent-length: {len(block.encode())}\r\n\r\n{block}\r\n\r\n")
    (tmp_path / "a.warc").write_bytes("".join(records).encode())
    (tmp_path / "b.warc.gz").write_bytes(b"".join(gzip.compress(x.encode()) for x in records))
    for name in ("a.warc", "b.warc.gz"):
        got = {x.record_id: x for x in warc.read_responses(spark, str(tmp_path / name)).collect()}
        assert set(got) == {"<urn:1>", "<urn:3>"} and all(x.whole for x in got.values())
        assert (got["<urn:1>"].http_headers, got["<urn:1>"].payload, got["<urn:1>"].target_uri) == (http, body, "http://a/1")
        assert (got["<urn:3>"].http_headers, got["<urn:3>"].payload) == (http, "")
    out = warc.derivatives(warc.read_responses(spark, str(tmp_path / "a.warc"))).collect()
    assert len(out) == 4 and any("title: é\r\n" in x.block and "source-header: Content-Type: text/html\r\n" in x.block for x in out)
    assert "WARC-Refers-To: <urn:1>\r\n" in next(x for x in out if x.refers_to == "<urn:1>").headers
    (tmp_path / "c.warc").write_bytes("".join(records).encode()[:-20])
    assert [x.whole for x in warc.read_responses(spark, str(tmp_path / "c.warc")).where("record_id = '<urn:3>'").collect()] == [False]


def leak_docs():
    r = random.Random(9)
    items = [(i, " ".join(words(r, n))) for i, n in enumerate([15, 20, 30, 59, 9, 7, 6, 0])] + [(20, None), (21, "Ein Satz: mit, Satzzeichen; und GROSSEN Wörtern, die (fast) alle hier stehen.")]
    docs = []
    for i, t in items:
        w = (t or "").split()
        for step in (0, 3, 4, 5, 7, 2):
            x = [y if not step or k % step else "sub" for k, y in enumerate(w)]
            docs.append((len(docs), f"{' '.join(words(r, 40))} {' '.join(x)} {' '.join(words(r, 12))}"))
        docs.append((len(docs), " ".join(w[len(w) // 2 :])))
    items += [(None, " ".join(words(r, 30))), (None, " ".join(words(r, 18))), (0, " ".join(words(r, 25))), (21, "short item")]
    docs += [(3000 + k, f"{' '.join(words(r, 9))} {items[-4 + k][1]}") for k in range(3)]
    docs += [(len(docs), "ein satz mit satzzeichen und grossen WÖRTERN die fast"), (None, items[2][1]), (0, items[3][1])] + [(1000 + i, " ".join(words(r, 200))) for i in range(20)]
    return docs + [(2000, None), (2001, ""), (2002, "a " * 30_000)], items


def test_leaks_against_sql(spark):
    docs, items = leak_docs()
    d, b = spark.createDataFrame([(*x, 1) for x in docs], "doc_id long, text string, h int"), spark.createDataFrame(items, "item_id long, text string")
    distinct = d.dropDuplicates(["doc_id"]).where("doc_id <> 0 or doc_id is null")
    got = sorted(map(str, decontaminate.leaks(distinct, b).collect()))
    c = duckdb.connect()
    documents, benchmark = distinct.select("doc_id", "text").toPandas(), b.toPandas()  # noqa: F841
    documents["doc_id"], documents["text"], benchmark["text"] = documents.doc_id.astype("Int64"), documents.text.astype(object), benchmark.text.astype(object)
    benchmark["item_id"] = benchmark.item_id.astype("Int64")
    names = ("doc_id", "item_id", "best", "matched", "item_tokens", "doc_offset")
    want = c.sql(queries._op9_sql()).fetchall()
    assert got == sorted("Row(" + ", ".join(f"{k}={v}" for k, v in zip(names, x)) + ")" for x in want)
    found = {x.doc_id for x in decontaminate.leaks(d, b).collect()}
    assert {i * 7 + k for i in (0, 1, 2, 3) for k in (0, 3, 4)} <= found and None in found and 0 in found
    assert {x for x in found if x is not None and x >= 1000} == {3000, 3001, 3002}
    kept = decontaminate.decontaminate(d, b)
    assert kept.columns == d.columns and not {x.doc_id for x in kept.collect()} & (found - {0, None})
    assert decontaminate.leaks(d.limit(0), b).count() == decontaminate.leaks(d, b.limit(0)).count() == 0
    assert decontaminate.decontaminate(d, b.limit(0)).count() == d.count()


def test_every_pattern_of_a_leak_hits_a_mask():
    for n in range(decontaminate.FEWEST, decontaminate.WINDOW + 1):
        masks = [[k for k, c in enumerate(m) if c == "1"] + [len(m)] for m in (decontaminate.LONG if n >= decontaminate.WINDOW else decontaminate.SHORT)]
        need = math.ceil(n * decontaminate.SHARE)
        for m in range(max(need, decontaminate.FEWEST), n + 1):  # tokens of the window that the document has side by side
            for off in itertools.combinations(range(m), m - need):
                assert any(not any(s + k in off for k in ones) for *ones, size in masks for s in range(m - size + 1)), (n, m, off)


def test_every_pattern_of_a_leak_has_equal_tokens_about_a_mask():
    for n in range(decontaminate.FEWEST, decontaminate.WINDOW + 1):
        for mask, about in zip(decontaminate.MASKS, decontaminate.ABOUT):
            if len(mask) > n or (mask in decontaminate.LONG) != (n >= decontaminate.WINDOW):
                continue
            ones = {k for k, c in enumerate(mask) if c == "1"}
            for s in range(n - len(mask) + 1):
                for off in itertools.combinations([p for p in range(n) if p - s not in ones], n - math.ceil(n * decontaminate.SHARE)):
                    equal = {p - s for p in range(n) if p not in off}
                    assert any(equal.issuperset(places) for places in about), (mask, n, s, off)


@pytest.mark.parametrize("hot", [32, 2, 0])
def test_leaks_against_all_alignments(spark, monkeypatch, hot):
    monkeypatch.setattr(decontaminate, "HOT", hot)
    r = random.Random(13)
    items = [(i, words(r, n)) for i, n in enumerate([7, 8, 9, 10, 11, 12, 13, 13, 14, 16, 20, 25, 59] * 2)]
    docs = []
    for _, w in items:
        for _ in range(12):
            a = r.choice([0, 0, r.randrange(max(1, len(w) // 3))])
            x = [y if r.random() > 0.22 else "sub" for y in w[a:]]
            docs.append((len(docs), r.choice([words(r, 20), []]) + x + r.choice([words(r, 9), []])))
    common = words(r, 9)  # a phrase of many items, some of which go on in the same way
    items += [(len(items) + k, words(r, r.choice([0, 4])) + common + words(r, 2) + (["sub"] if k % 5 == 0 else []) + words(r, 6)) for k in range(40)]
    docs += [(len(docs) + k, words(r, 8) + common[k % 3 :] + ["sub"] * (k % 4) + words(r, 8)) for k in range(12)]
    w = items[6][1]
    docs.append((len(docs), words(r, 9) + [y if k not in (3, 6, 10) else "sub" for k, y in enumerate(w)] + words(r, 9)))
    want = {}
    for d, t in docs:
        for i, w in items:
            n, width = len(w), min(13, len(w))
            for off in range(7 - n, len(t) - 6):
                if min(n, len(t) - off) - max(0, -off) < 7:
                    continue
                eq = [int(0 <= p + off < len(t) and t[p + off] == w[p]) for p in range(n)]
                best = max(sum(eq[s : s + width]) for s in range(n - width + 1))
                if best >= math.ceil(width * 0.75):
                    want[d, i] = max(want.get((d, i), (0, 0, 0)), (best, sum(eq), -off))
    rows = lambda x: [(k, " ".join(v)) for k, v in x]
    got = decontaminate.leaks(spark.createDataFrame(rows(docs), "doc_id long, text string"), spark.createDataFrame(rows(items), "item_id long, text string")).collect()
    assert len(want) > 80 and (docs[-1][0], 6) in want
    assert {(x.doc_id, x.item_id): (x.best, x.matched, -x.doc_offset) for x in got} == want


def test_a_common_phrase_alone_makes_no_hits(spark, monkeypatch):
    number = itertools.count()
    own = lambda n: [f"w{next(number)}" for _ in range(n)]
    phrase = own(9)
    items = [(k, phrase + own(15)) for k in range(200)]
    docs = [(k, own(10) + phrase + (items[k][1][9:] if k < 5 else own(10))) for k in range(100)]
    frame = lambda rows, c: spark.createDataFrame([(k, " ".join(w)) for k, w in rows], f"{c} long, text string")
    d, b = frame(docs, "doc_id"), frame(items, "item_id")
    seen, hits = [], decontaminate._hits
    monkeypatch.setattr(decontaminate, "_hits", lambda *a: seen.append(hits(*a)) or seen[-1])
    got = {hot: (monkeypatch.setattr(decontaminate, "HOT", hot), sorted(map(str, decontaminate.leaks(d, b).collect())), seen[-1].count())[1:] for hot in (10**9, 32)}
    assert got[32][0] == got[10**9][0] and {f"Row(doc_id={k}, item_id={k}" for k in range(5)} <= {",".join(x.split(",")[:2]) for x in got[32][0]}
    assert got[10**9][1] >= 100 * 200 and 5 <= got[32][1] <= 5 * sum(map(len, decontaminate.ABOUT))  # only alignments that are leaks, a run for each set of places


@pytest.mark.parametrize("hot", [32, 1])
def test_large_benchmarks_go_in_parts(spark, monkeypatch, hot):
    monkeypatch.setattr(decontaminate, "HOT", hot)
    docs, items = leak_docs()
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = sorted(map(str, decontaminate.leaks(d, b).collect()))
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 150)
    assert sorted(map(str, decontaminate.leaks(d, b).collect())) == want


@pytest.mark.parametrize("hot", [32, 0])
def test_native_plan_has_no_python(spark, monkeypatch, hot):
    monkeypatch.setattr(decontaminate, "HOT", hot)
    docs, items = leak_docs()
    plan = decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|ArrowEval|MapIn", plan)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("sf"))
    r = random.Random(3)
    rows, labels = [], []
    for i in range(120):
        t = words(r, 80)
        if bad := i % 5 == 0:
            t[r.randrange(80)] = t[r.randrange(80)] = "nitwit"
        rows.append((i, "\n".join(" ".join(t[k : k + 16]) for k in range(0, 80, 16)), "en", "s", 1))
        labels.append((i, 1, int(bad)))
    item = " ".join(words(r, 30))
    rows += [(200, rows[1][1].replace("\n", " "), "en", "s", 1), (201, rows[2][1] + "\n" + item, "en", "s", 1), (202, rows[3][1], "en", "s", 1), (None, None, None, None, None), (203, "", "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return root


def test_pipeline(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    columns = docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, tables)
        more = ["_whole_text"] if name == "line dedup" else []
        assert name == "pieces" or docs.columns == columns + more
        docs = corpus_pipeline.written(docs, "t")
        seen[name] = {r[0] for r in docs.collect()}
    clean = {i for i in range(120) if i % 5}
    assert len(clean - seen["toxicity"]) <= 3 and len({i for i in range(0, 120, 5)} & seen["toxicity"]) <= 3
    assert seen["line dedup"] == seen["toxicity"] and {None, 203} <= seen["pieces"]
    assert not {1, 200} <= seen["near duplicates"] and 201 not in seen["decontamination"]
    assert {r[0] for r in corpus_pipeline.run(spark, tables).collect()} == seen["pieces"]


def test_copies_go_by_their_whole_texts(spark):
    """Line dedup and near duplicates on sf0.01: of each group of similar raw texts one stays, by brute force, and nothing that line dedup emptied."""
    sf = "/root/testdata/sf0.01"
    docs = queries.table(spark, sf, "documents")
    raw = {r.doc_id: r.text for r in docs.collect()}
    ids = sorted(raw)
    sets = [sets_of(raw[i]) for i in ids]
    index = collections.defaultdict(list)
    for k, s in enumerate(sets):
        for g in s:
            index[g].append(k)
    shared = collections.Counter(p for members in index.values() for p in itertools.combinations(members, 2))
    of = groups(len(ids), [(a, b) for (a, b), n in shared.items() if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n)])
    gone = {ids[k] for k, root in enumerate(of) if root != k}
    stages = dict(corpus_pipeline.STAGES)
    lines = corpus_pipeline.written(stages["line dedup"](spark, docs, sf), "lines")
    emptied = {r.doc_id for r in lines.collect() if sets_of(raw[r.doc_id]) and not sets_of(r.text)}
    kept = {r.doc_id: r.text for r in stages["near duplicates"](spark, lines, sf).collect()}
    assert len(gone) > 60 and set(kept) == set(ids) - gone - emptied
    assert all(sets_of(t) or not sets_of(raw[i]) for i, t in kept.items()) and len(emptied - gone) < 5


def test_near_duplicates_alone_decides_on_the_text(spark):
    text = "one two three four five six seven"
    docs = spark.createDataFrame([(1, text), (2, text), (3, ""), (4, None)], "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()) == [1, 3, 4]
    clash = spark.createDataFrame([(1, text, "x"), (2, text, "y"), (3, "", "z")], "doc_id long, text string, _WHOLE_text string")
    lines = corpus_pipeline.line_dedup(spark, clash, "")
    assert lines.columns == [*clash.columns, "__whole_text"]
    assert sorted(corpus_pipeline.near_duplicates(spark, lines, "").select(clash.columns).collect()) == [(1, text, "x"), (3, "", "z")]


def test_what_line_dedup_leaves_decides_on_near_duplicates(spark):
    """Two texts that are alike but for a repeated passage in one of them: raw they are not similar, and line dedup alone leaves both."""
    r = random.Random(5)
    licence = "\n".join(" ".join(words(r, 12)) for _ in range(20))
    lines = [words(r, 60) for _ in range(4)]
    near = [[*x[:-1], "changed"] for x in lines]  # every line differs, so none repeats
    body, other = ("\n".join(" ".join(x) for x in y) for y in (lines, near))
    docs = spark.createDataFrame([(1, licence, "a"), (2, f"{body}\n{licence}", "b"), (3, other, "c"), (4, " ".join(words(r, 70)), "d")], "doc_id long, text string, source string")
    raw = {x.doc_id: sets_of(x.text) for x in docs.collect()}
    assert 100 * len(raw[2] & raw[3]) < 80 * len(raw[2] | raw[3])
    lines = corpus_pipeline.written(corpus_pipeline.line_dedup(spark, docs, ""), "lines")
    left = {x.doc_id: x.text for x in lines.collect()}
    assert left[2] == body and left[3] == other
    assert sorted(x.doc_id for x in corpus_pipeline.near_duplicates(spark, docs, "").collect()) == [1, 2, 3, 4]
    got = corpus_pipeline.near_duplicates(spark, lines, "")
    assert got.columns == docs.columns and sorted(x.doc_id for x in got.collect()) == [1, 2, 4]


def test_pipeline_of_empty_tables(spark, tables, tmp_path):
    for n in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{tables}/{n}.parquet").limit(0).write.parquet(f"{tmp_path}/{n}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
