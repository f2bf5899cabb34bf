"""The audit of sources against its definition, computed pair by pair and term by term."""

import random
import re
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from dayroll.llm import divergence
from dayroll.llm.divergence import audit_sources, corrections


def plain(rows, limit=200):
    """rows: (lang, source, text). The result by its definition."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    docs = [(a or "", b or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(lower))) for a, b, t in rows]
    out = []
    f = lambda p, q: (p - q) ** 2 // q
    for lang in {d[0] for d in docs}:
        df = Counter(w for a, _, ws in docs if a == lang for w in set(ws))
        kept = sorted(w for w, n in df.items() if n >= 3)
        group = {s: Counter() for a, s, _ in docs if a == lang}
        for a, s, ws in docs:
            if a == lang:
                group[s].update(w for w in ws if df[w] >= 3)
        whole = sum(group.values(), Counter())
        share = lambda c: {w: 1 + 10**9 * (c[w] + 1) // (sum(c.values()) + len(kept)) for w in kept}
        q = share(whole)
        p = {s: share(c) for s, c in group.items()}
        for s in group:
            pairs = [(o, sum(f(p[s][w], p[o][w]) for w in kept)) for o in group if o != s]
            terms = [(w, f(p[s][w], q[w])) for w in kept if group[s][w] and p[s][w] > q[w]]
            for part, found, most in (("pair", pairs, None), ("term", terms, limit)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, v, i + 1) for i, (item, v) in enumerate(found[:most])]
    return sorted(out)


def rows(df):
    return sorted((r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in df.collect())


def test_against_the_definition(spark, monkeypatch):
    monkeypatch.setattr(divergence, "PAIRS", 50)  # so that postings are corrected in many parts
    monkeypatch.setattr(divergence, "TOGETHER", 400)
    rng = random.Random(3)
    words = ["Alpha", "beta", "GAMMA", "élan", "ÉLAN", "日本", "x", "don't", "a1b", "zeta", "rare"]
    docs = [(rng.choice(["en", "de", None, ""]), rng.choice(["a", "b", "c", None, "", "é"]), " ".join(rng.choices(words, range(1, 12), k=rng.randrange(0, 30)))) for _ in range(150)]
    docs += [("en", "none", None), ("en", "blank", "  12 \n"), ("alone", "one", "one one one"), ("quiet", "p", "once"), ("quiet", "q", None), ("en", "a", "word " * 20_000), *[("en", "a", "same text")] * 5]
    df = spark.createDataFrame([(i, *d, 1.5, "t") for i, d in enumerate(docs)], "doc_id int, lang string, source string, text string, value double, term string").repartition(4)
    assert rows(audit_sources(df)) == plain(docs)


def test_ranks_stop_and_empty_tables(spark, monkeypatch):
    monkeypatch.setattr(divergence, "TERMS", 4)
    docs = [("en", s, " ".join(f"{c}{d}" for c in "abcdefgh" for d in ("m" if s == "a" else "n"))) for s in "aaabbb"]
    got = rows(audit_sources(spark.createDataFrame(docs, "lang string, source string, text string")))
    assert got == plain(docs, 4) and sum(r[2] == "term" for r in got) == 8
    assert audit_sources(spark.createDataFrame([], "lang string, source string, text string")).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**32), st.integers(1, 40))
def test_corrections_in_parts_are_those_of_all_pairs(seed, most):
    rng = np.random.default_rng(seed)
    counts = rng.integers(1, 9, 12)
    p, p0 = rng.integers(1, 10**9, counts.sum()), rng.integers(1, 50, counts.sum())
    source = np.concatenate([rng.permutation(10)[:n] for n in counts])
    f = lambda a, b: (int(a) - int(b)) ** 2 // int(b)
    want = Counter()
    at = 0
    for n in counts:
        for i in range(at, at + n):
            for j in range(at, at + n):
                if i != j:
                    want[source[i], source[j]] += f(p[i], p[j]) - f(p[i], p0[j]) - f(p0[i], p[j]) + f(p0[i], p0[j])
        at += n
    got = Counter()
    for a, b, x in corrections(counts, source, p, p0, most):
        assert len(a) <= max(most, 1) * 2
        for i, j, v in zip(a, b, x):
            got[i, j] += int(v)
    assert {k: v for k, v in got.items() if v} == {k: v for k, v in want.items() if v}


def test_shares_of_counts_of_any_size(spark):
    for n, total, kept in ((0, 0, 1), (5, 9, 3), (10**13, 10**13 + 7, 10**9), (123_456_789_012, 987_654_321_098, 77)):
        got = spark.sql(f"SELECT {n}L AS n, {total}L AS t, {kept}L AS v").select(divergence.share("n", "t", "v")).first()[0]
        assert got == 1 + 10**9 * (n + 1) // (total + kept)
    assert spark.sql("SELECT 0L AS n, 0L AS t, 0L AS v").select(divergence.share("n", "t", "v")).first()[0] is None
