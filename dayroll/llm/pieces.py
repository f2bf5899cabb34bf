"""SentencePiece encoding and decoding, exact, by backtracking.

A left-to-right search takes the longest piece that an Aho-Corasick automaton finds at a position, keeps it if merging
the previous piece and it anew leaves the two apart, else tries the next shorter one; with none left it steps back and
marks the position as failed in a bitfield, so no position is expanded twice. The sequence in which all neighbours stay
apart is the one that merge-type encoding gives.

Texts are cut where no piece can reach across: before a space that follows another character, and around characters
that are in no piece (they become byte pieces), and then between characters that are neighbours in no piece. Each distinct cut is encoded once for many texts.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from operator import add

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from .bpe import MEMO_LIMIT, Merger

SPACE = "▁"
#: Characters of the texts whose new cuts are encoded together.
TOGETHER = 2_000_000


class PieceCoder:
    """Encoder and decoder of a merge-type SentencePiece model with byte fallback, identity normalisation and a dummy prefix."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.bytes = {int(model.id_to_piece(i)[3:5], 16): i for i in range(n) if model.is_byte(i)}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.end = model.eos_id()
        normal = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
        names = {model.id_to_piece(i): i for i in normal}
        self.merger = Merger({p: -model.get_score(i) for p, i in names.items()})
        self.text_of = {i: p.replace(SPACE, " ") for p, i in names.items()}
        self.control = {i for i in range(n) if model.is_control(i)}
        self.unknown = model.unk_id()
        # single characters, and what merging can give
        self.ids = {p: i for p, i in names.items() if len(p) == 1 or self.merger.merge(p) == [p]}
        self.letters = {c for p in names for c in p}
        # characters that stand side by side in some piece; between any others a text can be cut
        self.together = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        # the next shorter piece at the same start
        self.shorter = {p: next((p[:k] for k in range(len(p) - 1, 0, -1) if p[:k] in self.ids), "") for p in self.ids}
        self.longest = max(map(len, self.ids))
        self.automaton = ahocorasick.Automaton()
        for p in self.ids:
            self.automaton.add_word(p, p)
        self.automaton.make_automaton()
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("this model has pieces with a space after another character")
        if any(model.normalize(x) != SPACE + x.replace(" ", SPACE) for x in ("a  b ﬁ ", " １\n")):
            raise ValueError("this model changes texts before it encodes them")
        self.cuts = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n")
        self._apart: dict[tuple[str, str], bool] = {}
        self._known: dict[str, tuple[str, int, str]] = {}

    def _stay(self, left: str, right: str) -> bool:
        key = (left, right)
        known = self._apart.get(key)
        if known is None:
            if len(self._apart) >= MEMO_LIMIT:
                self._apart.clear()
            known = self._apart[key] = self.merger.apart(left, right)
        return known

    def encode_cut(self, cut: str) -> list[int]:
        """The ids of a cut without looking at its neighbours."""
        if self.letters.issuperset(cut):
            return self._search(cut)
        out: list[int] = []
        run = ""
        for c in cut:
            if c in self.letters:
                run += c
                continue
            out += self._search(run) if run else []
            out += [self.bytes[b] for b in c.encode()]
            run = ""
        return out + (self._search(run) if run else [])

    def _search(self, run: str) -> list[int]:
        n = len(run)
        # the leftmost longest matches in one run of the automaton; other starts, seldom needed, on demand
        greedy = [piece for _, piece in self.automaton.iter_long(run)]
        known = self._apart.get
        if all(map(known, zip(greedy, greedy[1:]))) and sum(map(len, greedy)) == n:
            ids = self.ids
            return [ids[p] for p in greedy]
        longest, at = {}, 0
        for piece in greedy:
            at = run.index(piece, at)
            longest[at] = piece
            at += len(piece)
        shorter, stay = self.shorter, self._stay
        failed, at = 0, 0
        path: list[str] = []
        piece = longest.get(0, "")
        while at < n:
            before = path[-1] if path else ""
            while piece and (failed >> (at + len(piece)) & 1 or (before and not (known((before, piece)) or stay(before, piece)))):
                piece = shorter[piece]
            if piece:
                path.append(piece)
                at += len(piece)
                if at < n and (piece := longest.get(at)) is None:
                    piece = longest[at] = self._longest(run, at)
            elif path:
                failed |= 1 << at
                piece = path.pop()
                at -= len(piece)
                piece = shorter[piece]
            else:
                # a letter that occurs in pieces but is none itself: merging leaves it alone, byte pieces stand for it
                return [i for p in self.merger.merge(run) for i in ([self.ids[p]] if p in self.ids else [self.bytes[b] for b in p.encode()])]
        ids = self.ids
        return [ids[p] for p in path]

    def _longest(self, run: str, at: int) -> str:
        """The longest piece that starts at a position."""
        ahead = run[at : at + self.longest]
        piece = ahead[: self.automaton.longest_prefix(ahead)]
        return piece if piece in self.ids else next((piece[:k] for k in range(len(piece) - 1, 0, -1) if piece[:k] in self.ids), "")

    def cut(self, text: str) -> list[str]:
        return self.cuts.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def learn(self, cuts: Iterable[str]) -> None:
        known = self._known
        together = self.together
        for c in {c for c in cuts if c not in known}:
            parts, at = [], 0
            for i, pair in enumerate(map(add, c, c[1:]), 1):
                if pair not in together:
                    parts.append(c[at:i])
                    at = i
            parts.append(c[at:])
            for p in parts:
                if p not in known:
                    ids = self.encode_cut(p)
                    known[p] = (" ".join(map(str, ids)), len(ids), self.decode_cut(ids))
            if at:
                each = [known[p] for p in parts]
                known[c] = (" ".join([x[0] for x in each]), sum([x[1] for x in each]), "".join([x[2] for x in each]))

    def trim(self) -> None:
        if len(self._known) > MEMO_LIMIT:
            self._known.clear()

    def forget(self) -> None:
        """Empty the memo tables: a worker that is kept for other stages does not hold them."""
        self._known.clear()
        self._apart.clear()

    def encode(self, text: str, end: bool = False) -> list[int]:
        cuts = self.cut(text)
        self.learn(cuts)
        known = self._known
        return [int(i) for c in cuts for i in known[c][0].split()] + [self.end] * end

    def decode_cut(self, ids: list[int]) -> str:
        """Text of ids, the dummy prefix still there. Runs of byte pieces become UTF-8; each byte that is not part of valid UTF-8 becomes U+FFFD."""
        out: list[str] = []
        raw = bytearray()
        try:
            return "".join([self.text_of[i] for i in ids])
        except KeyError:
            pass
        for i in [*ids, -1]:
            if i in self.byte_of:
                raw.append(self.byte_of[i])
                continue
            if raw:
                out.append(utf8(bytes(raw)))
                raw.clear()
            if i == self.unknown:
                out.append(" ⁇ ")
            elif i >= 0 and i not in self.control:
                out.append(self.text_of[i])
        return "".join(out)

    def decode(self, ids: Iterable[int]) -> str:
        ids = [i for i in ids if i not in self.control]
        text = self.decode_cut(ids)
        return text[1:] if ids and self.text_of.get(ids[0], "")[:1] == " " else text


def utf8(raw: bytes) -> str:
    """raw as UTF-8, with one U+FFFD for each byte outside a valid sequence."""
    try:
        return raw.decode()
    except UnicodeDecodeError as e:
        return raw[: e.start].decode() + "�" + utf8(raw[e.start + 1 :])


_loaded: dict[str, PieceCoder] = {}


def coder(path: str) -> PieceCoder:
    """One coder for each model file and Python worker."""
    if path not in _loaded:
        _loaded[path] = PieceCoder(path)
    return _loaded[path]


def with_cuts(c: PieceCoder, column: pa.Array) -> Iterator[tuple[str, list[str]]]:
    """Each text with its cuts, whose encodings are known by then; memory is bounded by TOGETHER and the memo table."""
    some: list[tuple[str, list[str]]] = []
    size = 0
    for x in column:
        text = x.as_py() or ""
        some.append((text, c.cut(text)))
        size += len(text)
        if size > TOGETHER:
            for _, cuts in some:
                c.learn(cuts)
            yield from some
            some, size = [], 0
            c.trim()
    for _, cuts in some:
        c.learn(cuts)
    yield from some
    c.trim()


def encode_pieces(docs: DataFrame, model: str, end: bool = True, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row for each row of docs: id, n_tokens, ids_sha256, decoded_sha256 and, where keep names them, ids (array) and decoded (text).

    A null text counts as empty (the end id alone); a null id stays null; repeated rows stay; other columns are ignored,
    whatever their names. A narrow pass without a shuffle.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    extra = {"ids": "array<int>", "decoded": "string"}

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(model)
        for b in batches:
            n_tokens, ids_sha, text_sha, ids, decoded = [], [], [], [], []
            for _, cuts in with_cuts(c, b.column(1)):
                each = [c._known[x] for x in cuts]
                coded = " ".join([x[0] for x in each] + [str(c.end)] * end)
                text = "".join([x[2] for x in each])[1:]
                n_tokens.append(sum([x[1] for x in each]) + end)
                ids_sha.append(hashlib.sha256(coded.encode()).hexdigest())
                text_sha.append(hashlib.sha256(text.encode()).hexdigest())
                if "ids" in keep:
                    ids.append([int(i) for i in coded.split()])
                if "decoded" in keep:
                    decoded.append(text)
            cols = {id_col: b.column(0), "n_tokens": pa.array(n_tokens, pa.int64()), "ids_sha256": pa.array(ids_sha, pa.string()), "decoded_sha256": pa.array(text_sha, pa.string())}
            cols |= {k: pa.array(ids, pa.list_(pa.int32())) if k == "ids" else pa.array(decoded, pa.string()) for k in keep}
            yield pa.RecordBatch.from_arrays(list(cols.values()), list(cols))
        c.forget()

    return docs.select(docs[id_col], docs[text_col]).mapInArrow(encode, f"{id_col} {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + "".join(f", {k} {extra[k]}" for k in keep))


def decode_pieces(rows: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """rows' ids with the texts that their token ids stand for (null: null)."""
    kind = rows.schema[id_col].dataType.simpleString()

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(model)
        for b in batches:
            texts = [None if x is None else c.decode(x) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], [id_col, text_col])

    return rows.select(rows[id_col], rows[ids_col]).mapInArrow(decode, f"{id_col} {kind}, {text_col} string")
