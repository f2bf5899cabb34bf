"""Byte-pair merging helpers: a vocabulary whose pieces merge by rank, and the check that two adjacent pieces stay apart."""

from __future__ import annotations

import heapq

BIG = 1 << 60
#: Symbols up to which all pairs are looked at for each merge.
SHORT = 64
#: Entries kept in a worker's memo tables before they are emptied.
MEMO_LIMIT = 400_000


class Merger:
    """rank: merged piece -> priority (lower merges first). Pieces are str or bytes; symbols start as single characters."""

    def __init__(self, rank: dict, symbols=list):
        self.rank, self.symbols = rank, symbols

    def merge(self, piece) -> list:
        """The pieces that merging gives: always the best-ranked adjacent pair, the leftmost of equals."""
        get, parts = self.rank.get, self.symbols(piece)
        if len(parts) < 2:
            return parts
        if len(parts) > SHORT:
            return self._merge_long(parts)
        ranks = [get(a + b, BIG) for a, b in zip(parts, parts[1:])]
        while ranks and (best := min(ranks)) < BIG:
            i = ranks.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del ranks[i]
            if i:
                ranks[i - 1] = get(parts[i - 1] + parts[i], BIG)
            if i < len(ranks):
                ranks[i] = get(parts[i] + parts[i + 1], BIG)
        return parts

    def _merge_long(self, parts: list) -> list:
        """The same with a heap of pairs, for n parts in the time of n log n."""
        get, n = self.rank.get, len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, pair) for i in range(n - 1) if (r := get(pair := parts[i] + parts[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, pair = heapq.heappop(heap)
            j = after[i]
            if parts[i] is None or j >= n or parts[i] + parts[j] != pair:
                continue  # one of the two has been merged otherwise
            parts[i], parts[j] = pair, None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
            for a, b in ((before[i], i), (i, k)):
                if a >= 0 and b < n and (r := get(joined := parts[a] + parts[b])) is not None:
                    heapq.heappush(heap, (r, a, joined))
        return [p for p in parts if p is not None]

    def apart(self, left, right) -> bool:
        """Do left and right stay two pieces when their concatenation is merged anew?"""
        return self.merge(left + right) == [left, right]
