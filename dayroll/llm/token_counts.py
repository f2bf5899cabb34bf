"""Token counts by prefix dynamic programming.

For every prefix of a pre-token the last piece of its encoding is the one piece ending there that stays apart from the
last piece of the prefix before it; the count of a prefix is one more than the count of that earlier prefix. A pre-token
is kept with the counts of all its prefixes, and an index of a text adds what stands before it, so lengths, truncation and
budget questions at any character are answered from stored counts. Where a text that ends inside a pre-token splits
otherwise (a contraction, the last blank before a word) the index looks up the pre-tokens that it then has.

Vocabulary: a byte-level BPE file of the ``tokenizers`` library (no normaliser, the standard byte-level pattern). Added
special tokens count as one wherever their text appears, as that library does by default.
"""

from __future__ import annotations

import json
from array import array
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from itertools import accumulate, chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .bpe import MEMO_LIMIT, Merger

#: Fixed value: the byte-level pre-token pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters of the texts whose new pre-tokens are learnt together.
TOGETHER = 2_000_000
#: The pattern's contractions that a text can end within.
SPLIT_EARLIER = ("'re", "'ve", "'ll")


def byte_characters() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies: itself where it is printable, else 256 and up in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


def check(spec: dict) -> None:
    """Refuse a file whose texts this module would count otherwise than the library."""
    model, splitter = spec["model"], spec.get("pre_tokenizer") or {}
    wrong = [
        model.get("type", "BPE") != "BPE", model.get("dropout"), model.get("continuing_subword_prefix"), model.get("end_of_word_suffix"), model.get("ignore_merges"), model.get("byte_fallback"), spec.get("normalizer"),
        splitter.get("type") != "ByteLevel", splitter.get("add_prefix_space"), not splitter.get("use_regex", True), any(t.get(k) for t in spec.get("added_tokens", []) for k in ("single_word", "lstrip", "rstrip")),
    ]
    if any(wrong):
        raise ValueError("this vocabulary file is not byte-level BPE with the standard pattern, merges alone and no normaliser")


class PrefixCounter:
    """Exact token counts of every prefix under one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        check(spec)
        table = byte_characters()
        raw = lambda piece: bytes(table[c] for c in piece)
        added = {t["content"] for t in spec.get("added_tokens", [])}
        pieces = {raw(p) for p in spec["model"]["vocab"] if p not in added}
        merges = (m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"])
        ranks: dict[bytes, int] = {}
        for i, (a, b) in enumerate(merges):
            ranks.setdefault(raw(a) + raw(b), i)
        self.merger = Merger(ranks, lambda b: [b[i : i + 1] for i in range(len(b))])
        self.pieces = [p for p in sorted(pieces) if self.merger.merge(p) == [p]]  # those that merging can give
        self.vocab = {p: i for i, p in enumerate(self.pieces)}
        #: Every ending of a piece, and the piece that it is (-1: none).
        self.endings = {p[i:]: -1 for p in self.pieces for i in range(1, len(p))} | self.vocab
        self._apart: dict[int, bool] = {}
        self.words = regex.compile(PATTERN)
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.added = added
        self._counts: dict[str, bytes | array] = {}
        self._held = 0
        self.trim(0)

    def prefixes(self, words: Iterable[bytes]) -> Iterator[list[int]]:
        """For each word the counts of word[:0], word[:1], ... word[:len]. In sorted order a word takes over what the one before it has stored for their common prefix."""
        get, known = self.endings.get, self._apart
        before, counts, last = b"", [0], [-1]
        for word in words:
            same = next((i for i, (x, y) in enumerate(zip(before, word)) if x != y), min(len(before), len(word)))
            del counts[same + 1 :], last[same + 1 :]
            for end in range(same + 1, len(word) + 1):
                found = []  # the pieces that end here: longer ones only where what follows their start ends a piece
                for start in range(end - 1, -1, -1):
                    piece = get(word[start:end])
                    if piece is None:
                        break
                    if piece >= 0:
                        found.append((start, piece))
                for start, piece in reversed(found):
                    if start:
                        pair = last[start] << 20 | piece
                        ok = known.get(pair)
                        if ok is None:
                            ok = self._check(pair, last[start], piece)
                        if not ok:
                            continue
                    counts.append(counts[start] + 1)
                    last.append(piece)
                    break
                else:
                    raise ValueError(f"no encoding of {word[:end]!r}")
            before = word
            yield counts

    def _check(self, pair: int, left: int, right: int) -> bool:
        if len(self._apart) >= MEMO_LIMIT:
            self._apart.clear()
        ok = self._apart[pair] = self.merger.apart(self.pieces[left], self.pieces[right])
        return ok

    def pretokens(self, text: str) -> list[str]:
        if self.special is None or not any(a in text for a in self.added):
            return self.words.findall(text)
        out: list[str] = []
        for part in self.special.split(text):
            out += [part] if part in self.added else self.words.findall(part)
        return out

    def counts(self, pretokens: list[str]) -> list[int]:
        """The number of tokens of each pre-token."""
        self.learn(pretokens)
        known = self._counts
        return [known[w][-1] for w in pretokens]

    def learn(self, pretokens: Iterable[str]) -> None:
        """Have the counts of all prefixes of these pre-tokens at hand: those that are not known yet are encoded, once."""
        known = self._counts
        new = {w for w in pretokens if w not in known}
        if not new:
            return
        coded = sorted((w.encode(), w) for w in new)
        for (raw, w), counts in zip(coded, self.prefixes(x for x, _ in coded)):
            own = counts if len(raw) == len(w) else [counts[i] for i in accumulate((len(c.encode()) for c in w), initial=0)]
            known[w] = bytes(own) if own[-1] < 256 else array("I", own)
            self._held += len(own)

    def prefix_counts(self, pretoken: str) -> bytes | array:
        """Tokens of pretoken[:0], pretoken[:1], ... and the whole pre-token, each as a pre-token of its own."""
        if pretoken not in self._counts:
            self.learn([pretoken])
        return self._counts[pretoken]

    def trim(self, most: int = 8 * MEMO_LIMIT) -> None:
        """Forget all pre-tokens if more counts than that are kept. What is within the bound serves a worker's next task too."""
        if self._held >= most or len(self._counts) > MEMO_LIMIT:
            self._counts.clear()
            self._counts.update(dict.fromkeys(self.added, b"\x01"))
            self._held = 0

    def count(self, text: str) -> int:
        return sum(self.counts(self.pretokens(text)))

    def index(self, text: str) -> PrefixIndex:
        return PrefixIndex(self, text)


class PrefixIndex:
    """Counts of all prefixes of one text: cumulated at the ends of pre-tokens, and by the kept counts of each pre-token between them."""

    def __init__(self, counter: PrefixCounter, text: str, words: list[str] | None = None):
        self.counter, self.text = counter, text
        self.words = counter.pretokens(text) if words is None else words
        self.ends = [0, *accumulate(map(len, self.words))]
        self.tokens = [0, *accumulate(counter.counts(self.words))]

    def count(self, chars: int) -> int:
        """Tokens of text[:chars]."""
        if chars >= self.ends[-1]:
            return self.tokens[-1]
        at = bisect_right(self.ends, chars) - 1
        inside, before = chars - self.ends[at], self.words[at - 1] if at else ""
        if not inside:  # two runs of blanks are one where nothing follows them
            if at > 1 and before.isspace() and self.words[at - 2].isspace():
                return self.tokens[at - 2] + self.counter.prefix_counts(self.words[at - 2] + before)[-1]
            return self.tokens[at]
        word = self.words[at]
        if word in self.counter.added:
            # a special string that is not whole is text: what stands before it goes on into it
            first = max(0, at - 2)
            return self.tokens[first] + self.counter.count(self.text[self.ends[first] : chars])
        if inside == 1 and word[0].isspace() and before.isspace():
            return self.tokens[at - 1] + self.counter.prefix_counts(before + word[0])[-1]
        if inside == 2 and word in SPLIT_EARLIER:
            return self.tokens[at] + self.counter.prefix_counts("'")[-1] + self.counter.prefix_counts(word[1])[-1]
        return self.tokens[at] + self.counter.prefix_counts(word)[inside]

    def fit(self, budget: int) -> int:
        """Characters of the longest prefix that has at most budget tokens, wherever it ends."""
        if self.tokens[-1] <= budget:
            return self.ends[-1]
        if budget < 0:
            return 0
        # what a prefix shares with the text goes up to two pre-tokens before its end at least, so none is longer
        whole = bisect_right(self.tokens, budget) - 1
        most = self.ends[min(whole + 3, len(self.ends) - 1)]
        return next(k for k in range(most, -1, -1) if self.count(k) <= budget)

    def all_counts(self) -> list[int]:
        """Tokens of text[:0], text[:1], ... and the whole text."""
        return [self.count(k) for k in range(len(self.text) + 1)]

    def truncate(self, budget: int) -> str:
        return self.text[: self.fit(budget)]


_loaded: dict[str, PrefixCounter] = {}


def counter(path: str) -> PrefixCounter:
    """One counter for each vocabulary file and Python worker."""
    if path not in _loaded:
        _loaded[path] = PrefixCounter(path)
    return _loaded[path]


def with_pretokens(c: PrefixCounter, column: pa.Array) -> Iterator[tuple[str, list[str]]]:
    """Each text with its pre-tokens; new pre-tokens of many texts are learnt at once, where they share most prefixes."""
    some: list[tuple[str, list[str]]] = []
    size = 0
    for x in column:
        text = x.as_py() or ""
        some.append((text, c.pretokens(text)))
        size += len(text)
        if size > TOGETHER:
            c.learn(chain.from_iterable(words for _, words in some))
            yield from some
            some, size = [], 0
            c.trim()
    c.learn(chain.from_iterable(words for _, words in some))
    yield from some
    c.trim()


def count_tokens(docs: DataFrame, vocabulary: str, limit: int, id_col: str = "doc_id", text_col: str = "text", keep_prefixes: bool = False) -> DataFrame:
    """One row for each row of docs: id, n_bytes, n_tokens, over_limit, fit_chars (characters of the longest prefix
    within limit, wherever it ends) and, with keep_prefixes, the arrays prefix_chars and prefix_tokens of all prefixes.

    A null text counts as empty (0 tokens, not over the limit); a null id stays null; repeated rows stay; other columns
    are ignored, whatever their names. A narrow pass: no shuffle, memory bounded by a batch and the worker's memo table.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    extra = ", prefix_chars array<long>, prefix_tokens array<long>" if keep_prefixes else ""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(vocabulary)
        for b in batches:
            n_bytes, n_tokens, fits, chars, tokens = [], [], [], [], []
            for text, words in with_pretokens(c, b.column(1)):
                n_bytes.append(len(text.encode()))
                if keep_prefixes:
                    x = c.index(text)
                    n, fit = x.tokens[-1], x.fit(limit)
                    chars.append(list(range(len(text) + 1)))
                    tokens.append(x.all_counts())
                else:
                    each = c.counts(words)
                    n, fit = sum(each), len(text)
                    if n > limit:
                        fit = PrefixIndex(c, text, words).fit(limit)
                n_tokens.append(n)
                fits.append(fit)
            cols = [b.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array([n > limit for n in n_tokens], pa.bool_()), pa.array(fits, pa.int64())]
            names = [id_col, "n_bytes", "n_tokens", "over_limit", "fit_chars"]
            if keep_prefixes:
                cols += [pa.array(chars, pa.list_(pa.int64())), pa.array(tokens, pa.list_(pa.int64()))]
                names += ["prefix_chars", "prefix_tokens"]
            yield pa.RecordBatch.from_arrays(cols, names)

    return docs.select(docs[id_col], docs[text_col]).mapInArrow(count, f"{id_col} {kind}, n_bytes long, n_tokens long, over_limit boolean, fit_chars long{extra}")


def truncate_tokens(docs: DataFrame, vocabulary: str, budget: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs' ids with their texts cut to the longest prefix within budget, wherever it ends (null: null)."""
    kind = docs.schema[id_col].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(vocabulary)
        for b in batches:
            texts = [None if t is None else c.index(t).truncate(budget) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], [id_col, text_col])
            c.trim()

    return docs.select(docs[id_col], docs[text_col]).mapInArrow(cut, f"{id_col} {kind}, {text_col} string")
