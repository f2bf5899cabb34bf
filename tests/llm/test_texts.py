"""Operators that work row by row: tokens, pieces, scores. Each on nulls, empty and very long texts, repeated rows, empty tables and clashing columns."""

import hashlib
import json
import random
import re
import time

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from dayroll.llm import bpe, pieces, quality, token_counts, toxicity
from dayroll.llm.bytewords import Block, blocks, mix
from dayroll.llm.common import labelled_rows

BYTES, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [None, "", " ", "\n\n  \t", "a", "Hello  world's <|endoftext|> tests", "日本語🙂 é́ ﬁ", "x" * 30_000, "ab c " * 8_000, "a\x00b\r\n", "<s></s><0x0A>▁▁x", "!!!???***", "thé end　"]


def odd(spark):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, "no id"), (4, "a"), (4, "a")]
    return spark.createDataFrame([(i, t, 1, "x", 2.0) for i, t in rows], "doc_id long, text string, n_tokens int, score string, held_out double")


def none(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def test_token_counts_are_the_library_s(spark):
    lib = Tokenizer.from_file(BYTES)
    got = token_counts.count_tokens(odd(spark), BYTES, 512).collect()
    assert len(got) == len(ODD) + 3
    for r in got:
        text = (ODD[r.doc_id] if r.doc_id is not None else "no id") or ""
        assert (r.n_bytes, r.n_tokens) == (len(text.encode()), len(lib.encode(text, add_special_tokens=False).ids))
        assert r.over_limit == (r.n_tokens > 512)
        assert len(lib.encode(text[: r.fit_chars], add_special_tokens=False).ids) <= 512
    assert token_counts.count_tokens(none(spark), BYTES, 512).count() == 0


def test_kept_prefixes_and_truncation(spark):
    lib = Tokenizer.from_file(BYTES)
    docs = spark.createDataFrame([(1, "one two three four"), (2, None)], "doc_id long, text string")
    r = token_counts.count_tokens(docs, BYTES, 2, keep_prefixes=True).orderBy("doc_id").first()
    assert (r.prefix_chars[-1], r.prefix_tokens[-1], r.fit_chars) == (18, 4, 7)
    cut = token_counts.truncate_tokens(docs, BYTES, 2).orderBy("doc_id").collect()
    assert [x.text for x in cut] == ["one two", None] and len(lib.encode(cut[0].text).ids) == 2


def test_nothing_is_encoded_twice(monkeypatch):
    """Budgets that end inside long pre-tokens are answered from the counts that were kept when the text was counted."""
    c = token_counts.PrefixCounter(BYTES)
    encoded = []
    real = token_counts.PrefixCounter.prefixes

    def counting(self, words):
        words = list(words)
        encoded.extend(words)
        return real(self, words)

    monkeypatch.setattr(token_counts.PrefixCounter, "prefixes", counting)
    r = random.Random(4)
    text = "Hello " + "".join(r.choice("abcdefghijklmnopqrstuvwxyzé") for _ in range(3000)) + " world 日本語日本語"
    x = c.index(text)
    before = sorted(encoded)
    assert before == sorted({w.encode() for w in c.pretokens(text)})
    lib = Tokenizer.from_file(BYTES)
    for budget in (0, 1, 2, 17, 512, 900):
        k = x.fit(budget)
        assert len(lib.encode(text[:k]).ids) <= budget < len(lib.encode(text[: k + 1]).ids)
    assert sorted(encoded) == before
    c.trim(0)
    assert set(c._counts) == c.added and c._held == 0


def test_long_runs_cost_linear_time():
    c, r = token_counts.PrefixCounter(BYTES), random.Random(5)
    took = []
    for n in (20_000, 160_000):
        text = "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
        began = time.time()
        c.count(text)
        took.append(time.time() - began)
    assert took[1] < 16 * took[0] + 0.5 and took[1] < 8


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="aeth 's\n1é🙂<|endoftext|>!", max_size=24))
def test_every_prefix_has_its_exact_count(text):
    lib, x = Tokenizer.from_file(BYTES), token_counts.counter(BYTES).index(text)
    for k in range(len(text) + 1):
        assert x.count(k) == len(lib.encode(text[:k], add_special_tokens=False).ids)


def test_prefixes_where_texts_split_otherwise():
    lib, r = Tokenizer.from_file(BYTES), random.Random(4)
    parts = ["'re", "'ve", "'ll", "'s", "'", "r", "e", " ", "  ", "\n", "\n\n", "\t", "\u3000", "x", "12", "é", "e\u0301", "!", "<|endoftext|>", "<|endo", "don't"]
    for _ in range(1500):
        text = "".join(r.choice(parts) for _ in range(r.randrange(9)))
        want = [len(e.ids) for e in lib.encode_batch([text[:k] for k in range(len(text) + 1)], add_special_tokens=False)]
        x = token_counts.counter(BYTES).index(text)
        assert x.all_counts() == want, text
        assert [x.fit(b) for b in range(5)] == [max(k for k, n in enumerate(want) if n <= b) for b in range(5)], text


def test_memo_tables_stay_bounded_over_many_small_batches(monkeypatch):
    monkeypatch.setattr(token_counts, "MEMO_LIMIT", 500)
    monkeypatch.setattr(pieces, "MEMO_LIMIT", 500)
    counter, coder, r = token_counts.PrefixCounter(BYTES), pieces.PieceCoder(PIECES), random.Random(2)
    for _ in range(12):
        batch = pa.array([" ".join("".join(r.choice("abcdeé") for _ in range(7)) for _ in range(40)) for _ in range(10)])
        assert sum(1 for _ in token_counts.with_pretokens(counter, batch)) == sum(1 for _ in pieces.with_cuts(coder, batch)) == 10
        assert len(counter._counts) <= 501 and len(coder._known) <= 500
    coder.forget()
    assert not coder._known and not coder._apart


def test_other_kinds_of_vocabularies_are_refused(tmp_path):
    spec = json.loads(open(BYTES, encoding="utf-8").read())
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"model": spec["model"] | {"ignore_merges": True}}):
        (tmp_path / "v.json").write_text(json.dumps(spec | change))
        with pytest.raises(ValueError):
            token_counts.PrefixCounter(str(tmp_path / "v.json"))


@pytest.mark.parametrize("text", ["x" * 900, "日本語のとても長い文" * 40, "a " + " " * 300 + "b", "a!!!<|endoftext|>" * 30, "it's extraordinarily\n\n  incomprehensible " * 9, "'" + "!?-" * 90, "ab12" * 60])
def test_budgets_end_inside_pretokens(text):
    lib, x = Tokenizer.from_file(BYTES), token_counts.counter(BYTES).index(text)
    want = [len(e.ids) for e in lib.encode_batch([text[:k] for k in range(len(text) + 1)], add_special_tokens=False)]
    assert x.all_counts() == want
    for budget in (0, 1, 2, 5, 7, 20, 31, 64):
        assert x.fit(budget) == max(k for k, n in enumerate(want) if n <= budget)


def test_pieces_are_the_library_s(spark):
    lib = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = pieces.encode_pieces(odd(spark), PIECES, keep=("ids", "decoded"))
    for r in got.collect():
        text = (ODD[r.doc_id] if r.doc_id is not None else "no id") or ""
        ids = lib.encode(text, add_eos=True)
        assert (r.ids, r.n_tokens, r.decoded) == (ids, len(ids), lib.decode(ids))
        assert (r.ids_sha256, r.decoded_sha256) == (sha(" ".join(map(str, ids))), sha(lib.decode(ids)))
    again = pieces.decode_pieces(got, PIECES).collect()
    assert {(r.doc_id, r.text) for r in again} == {(r.doc_id, r.decoded) for r in got.collect()}
    assert pieces.encode_pieces(none(spark), PIECES).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aeithns▁ \n🙂éx語$%", max_size=40))
def test_encoding_and_decoding_agree_with_the_library(text):
    lib, own = sentencepiece.SentencePieceProcessor(model_file=PIECES), pieces.coder(PIECES)
    ids = lib.encode(text)
    assert own.encode(text) == ids and own.decode(ids) == lib.decode(ids)


def test_long_merges_are_those_of_short_ones(monkeypatch):
    r = random.Random(6)
    merger = pieces.coder(PIECES).merger
    texts = ["".join(r.choice("aehinst▁") for _ in range(r.randrange(2, 60))) for _ in range(400)] + ["a" * 50, "na" * 30]
    short = [merger.merge(t) for t in texts]
    monkeypatch.setattr(bpe, "SHORT", 1)
    assert [merger.merge(t) for t in texts] == short
    began = time.time()
    assert "".join(merger.merge("banana" * 50_000)) == "banana" * 50_000 and time.time() - began < 30


def test_any_ids_decode_as_in_the_library():
    lib, own, r = sentencepiece.SentencePieceProcessor(model_file=PIECES), pieces.coder(PIECES), random.Random(3)
    for _ in range(2000):
        ids = [r.choice([r.randint(1, 258), r.randint(259, 31999), 28705, 259]) for _ in range(r.randint(0, 6))]
        assert own.decode(ids) == lib.decode(ids), ids


def corpus(n, bad, seed):
    r = np.random.default_rng(seed)
    words = ["".join(r.choice(list("abdehinorst"), r.integers(2, 7))) for _ in range(400)]
    out = []
    for i in range(n):
        t = [words[k] for k in r.integers(0, 400, r.integers(20, 150))]
        if i % 4 == 0:
            t = bad(t, r)
        out.append((i, " ".join(t), int(i % 4 == 0)))
    return out


def insult(t, r):
    t = list(t)
    for _ in range(3):
        t[r.integers(0, len(t))] = str(r.choice(["grumbler", "nitwit", "zonkfoo", "zonkbar"]))
    return t


@pytest.fixture(scope="module")
def toxic(spark):
    rows = corpus(400, insult, 1)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y, None) for i, _, y in rows] + [(None, 1, 1), (5, None, 1)], "doc_id long, toxic int, quality int")
    return docs, labels, {i: y for i, _, y in rows}


def test_toxicity_on_held_out_texts(spark, toxic):
    docs, labels, y = toxic
    model = toxicity.fit_toxicity(docs, labels)
    got = toxicity.score_toxicity(docs, model).collect()
    held = [r for r in got if r.held_out]
    assert len(got) == 400 and 40 < len(held) < 120
    assert np.mean([r.predicted == y[r.doc_id] for r in held]) >= 0.95
    assert toxicity.without_toxic(docs, model).count() < 330
    # the same rows give the same model, and the place of a word in a long text doesn't hide it
    again = toxicity.fit_toxicity(docs, labels)
    assert np.allclose(again.scores(pa.array(["x y z"]))[0], model.scores(pa.array(["x y z"]))[0])
    calm = " ".join(t for t in docs.where("doc_id % 4 <> 0").limit(30).toPandas().text)
    low, high = model.scores(pa.array([calm, f"{calm} nitwit nitwit {calm}"]))[0]
    assert low < 0.5 <= high


def test_toxicity_of_odd_rows(spark, toxic):
    docs, labels, _ = toxic
    model = toxicity.fit_toxicity(docs, labels)
    got = toxicity.score_toxicity(odd(spark), model, carry=("score",)).collect()
    assert len(got) == len(ODD) + 3 and all(0 <= r[2] <= 1 for r in got)
    assert toxicity.score_toxicity(none(spark), model).count() == 0
    for l in (labels.limit(0), labels.where("toxic = 1")):  # nothing to learn from
        assert toxicity.score_toxicity(odd(spark), toxicity.fit_toxicity(docs, l)).count() == len(ODD) + 3


def test_gradients_are_those_of_the_loss():
    n, r = toxicity.Network(3), np.random.default_rng(0)
    x, y = r.normal(size=(6, 5, toxicity.INPUTS)).astype(np.float32), np.array([0, 1, 1, 0, 1], np.float32)
    loss = lambda: float(np.mean(np.logaddexp(0, n.logits(x).astype(np.float64)) - y * n.logits(x)))
    g = n.gradients(x, y)
    for name, p in [*n.p.items(), ("x", x)]:
        for at in [tuple(r.integers(0, s) for s in p.shape) for _ in range(3)]:
            old, e = p[at], 3e-2
            p[at] = old + e
            a = loss()
            p[at] = old - e
            b = loss()
            p[at] = old
            assert abs((a - b) / (2 * e) - g[name][at]) < 2e-3, (name, at)


def test_scores_against_one_window_and_one_word_at_a_time():
    """Words, n-grams, windows, the recurrence, attention and the worst window, each by its definition."""
    rows = corpus(60, insult, 3)
    model = toxicity.Model.fit(pa.array([t for _, t, _ in rows], pa.large_string()), np.array([y for _, _, y in rows]), rounds=2, steps=15)
    p, tables, h = model.network.p, model.tables, toxicity.HIDDEN
    sig = lambda v: 1 / (1 + np.exp(-v))

    def bucket(raw, seed, base):
        x = seed
        for byte in raw:
            x = (x * base + byte) % 2**64
        return int(mix(np.array([x], np.uint64))[0]) >> (64 - toxicity.TABLE_BITS)

    def vector(word):
        raw = b" " + word + b" "
        grams = [bucket(raw[i : i + n], n, 257) for n in toxicity.GRAMS for i in range(len(raw) - n + 1)]
        block = Block(pa.array([word.decode()]))
        own = int(mix(block.hashes(block.bytes, np.array([0]), np.array([len(word)])))[0]) >> (64 - toxicity.TABLE_BITS)
        return np.concatenate([tables.word[own], tables.gram[grams].sum(axis=0) / np.sqrt(len(grams)), [1]])

    def direction(xs, k):
        state, out = np.zeros(h), []
        for x in xs:
            a, u = x @ p["W"][k] + p["b"][k], state @ p["U"][k]
            z, reset = sig(a[:h] + u[:h]), sig(a[h : 2 * h] + u[h : 2 * h])
            new = np.tanh(a[2 * h :] + reset * u[2 * h :])
            state = (1 - z) * new + z * state
            out.append(state)
        return out

    texts = [rows[0][1], " ".join(rows[k][1] for k in range(4)), "One, TWO thrée", "", "x"]
    for text, got in zip(texts, model.scores(pa.array(texts))[0]):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text).encode()
        words = [vector(w) for w in re.findall(rb"[0-9a-z\x80-\xff]+", low)]
        strides = max(2, -(-len(words) // toxicity.STRIDE))
        words += [np.zeros(toxicity.INPUTS)] * (strides * toxicity.STRIDE - len(words))
        logits = []
        for s in range(strides - 1):
            xs = words[s * toxicity.STRIDE : s * toxicity.STRIDE + toxicity.SPAN]
            states = [np.concatenate(q) for q in zip(direction(xs, 0), direction(xs[::-1], 1)[::-1])]
            e = np.exp([np.tanh(q @ p["A"]) @ p["v"] for q in states])
            logits.append(sum(w * q for w, q in zip(e / e.sum(), states)) @ p["c"] + p["d"][0])
        assert abs(got - sig(max(logits))) < 1e-4, text


def test_votes_against_all_products_at_once():
    rows = corpus(300, lambda t, r: [w.upper() for w in t], 4)
    texts, labels = [t for _, t, _ in rows], np.array([y for _, _, y in rows])
    labelled = texts[:200] + [texts[0]] * 40  # ties: more equal texts than there are voters
    y = np.concatenate([labels[:200], np.arange(40) % 2])
    model = quality.Model(pa.array(labelled, pa.large_string()), y)
    asked = texts + ["", None, texts[0]]
    x = np.concatenate([quality.frequencies(b) for _, _, b in blocks(pa.array(asked))])
    x = model._unit(model._weighted(x) @ model.projection)
    cosine = x.astype(np.float64) @ model.vectors.T.astype(np.float64)
    want = []
    for c in cosine:
        near = c >= np.sort(c)[-quality.NEIGHBOURS] - 1e-6
        w = np.maximum(c[near], 0) ** 4
        want.append((w @ y[near] + 1e-6 * model.share) / (w.sum() + 1e-6))
    assert np.allclose(model.scores(pa.array(asked)), want, atol=2e-4)


def test_models_are_fitted_on_bounded_rows(spark):
    docs = spark.createDataFrame([(i % 10, f"text {i} " * 50) for i in range(200)] + [(11, "x" * 100_000), (12, None)], "doc_id long, text string")
    chosen = spark.createDataFrame([(i, i % 2) for i in range(13)], "_id long, _y int")
    texts, y = labelled_rows(docs, chosen, "doc_id", "text", 3000)
    assert 4 <= len(texts) == len(y) <= 9 and sum(len(x.as_py() or "") for x in texts) <= 3000
    texts, y = labelled_rows(docs, chosen, "doc_id", "text")
    assert len(texts) == 12 and y.tolist() == [0, 1] * 5 + [1, 0] and texts.to_pylist() == labelled_rows(docs.repartition(5), chosen, "doc_id", "text")[0].to_pylist()


def test_quality_on_held_out_texts(spark):
    rows = corpus(400, lambda t, r: [w.upper() + "!!" for w in t], 2)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1 - y) for i, _, y in rows], "doc_id long, quality int")
    model = quality.fit_quality(docs, labels)
    held = quality.score_quality(docs, model).where("held_out").collect()
    assert len(held) > 50 and np.mean([r.predicted == int(r.doc_id % 4 != 0) for r in held]) >= 0.97
    got = quality.score_quality(odd(spark), model).collect()
    assert len(got) == len(ODD) + 3 and all(0 <= r[2] <= 1 for r in got)
    assert quality.score_quality(none(spark), model).count() == 0
    assert quality.score_quality(odd(spark), quality.fit_quality(docs, labels.limit(0))).count() == len(ODD) + 3
