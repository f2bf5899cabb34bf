"""Words and n-grams of many texts at once, as numpy arrays over their UTF-8 bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: An odd multiplier for polynomial hashes modulo 2**64, and its inverse.
R = np.uint64(0x9E3779B97F4A7C15)
R_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: Bytes of text worked on at once (a longer text is worked on alone).
TOGETHER = 700_000

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Characters 9 to 13 and 32.
BLANK = np.zeros(256, bool)
BLANK[[32, *range(9, 14)]] = True
#: ASCII letters and digits, and all bytes of other characters.
LETTER = np.zeros(256, bool)
LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def powers(n: int, r: np.uint64) -> np.ndarray:
    out = np.full(n + 1, r, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n + 1 powers of R and of its inverse; those for usual blocks are kept."""
    most = TOGETHER + TOGETHER // 4
    if n > most:
        return powers(n, R), powers(n, R_INVERSE)
    if not _powers:
        _powers.update(up=powers(most, R), down=powers(most, R_INVERSE))
    return _powers["up"], _powers["down"]


class Block:
    """Some texts: their bytes, one zero byte after each, and where each begins and ends."""

    def __init__(self, texts: pa.Array):
        n = len(texts)
        if texts.null_count:
            texts = texts.fill_null("")
        texts = texts.cast(pa.large_binary())
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
        raw = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if texts.buffers()[2] else np.zeros(0, np.uint8)
        offsets = offsets - offsets[0]
        self.starts = offsets[:-1] + np.arange(n)
        self.ends = offsets[1:] + np.arange(n)
        self.bytes = np.zeros(len(raw) + n, np.uint8)
        keep = np.ones(len(self.bytes), bool)
        keep[self.ends] = False
        self.bytes[keep] = raw
        self.inside = keep  # False at the zero bytes between texts
        self.n = n

    def words(self, part: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Runs of bytes for which part (a table of 256) holds, never across texts: begins, ends, and the text of each."""
        edge = np.diff((part[self.bytes] & self.inside).view(np.int8), prepend=0, append=0)
        begins, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        return begins, ends, np.searchsorted(self.ends, begins, "right")

    def hashes(self, data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """64-bit hashes of data[begin:end]: a polynomial in the bytes, mixed with the length."""
        up, down = _power(len(data))
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
        return mix((sums[ends] - sums[begins]) * down[begins] + (ends - begins).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def blocks(texts: pa.Array, together: int = TOGETHER) -> Iterator[tuple[int, int, Block]]:
    """(first, end, block) of the texts of a batch, about so many bytes each."""
    lengths = texts.cast(pa.large_binary())
    offsets = np.frombuffer(lengths.buffers()[1], np.int64)[lengths.offset : lengths.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    first = 0
    while first < len(texts):
        end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + together, "right")) - 1)
        yield first, end, Block(texts.slice(first, end - first))
        first = end
