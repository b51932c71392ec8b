"""Byte-pair merging of one word with a heap of candidate pairs over a doubly linked list of symbols."""

from __future__ import annotations

from heapq import heapify, heappop, heappush


def merge(symbols: list, joined) -> list:
    """What remains of ``symbols`` after all merges.

    ``joined((left, right))`` gives (rank, symbol) of an adjacent pair that may merge, or None. The pair with the lowest
    rank is merged first, of equal ranks the leftmost. A popped pair whose ends have changed meanwhile is skipped.
    n symbols take O(n log n) steps, so one very long word without a break costs no more than many short ones."""
    n = len(symbols)
    if n < 2:
        return symbols
    sym = symbols[:]
    heap = []
    for i in range(n - 1):
        got = joined((sym[i], sym[i + 1]))
        if got is not None:
            heap.append((got[0], i, sym[i], sym[i + 1], i + 1, got[1]))
    if not heap:
        return sym
    heapify(heap)
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    while heap:
        _, i, left, right, j, whole = heappop(heap)
        if sym[i] is not left or j >= n or sym[j] is not right or after[i] != j:
            continue
        sym[i], sym[j] = whole, None
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            got = joined((whole, sym[k]))
            if got is not None:
                heappush(heap, (got[0], i, whole, sym[k], k, got[1]))
        h = before[i]
        if h >= 0:
            got = joined((sym[h], whole))
            if got is not None:
                heappush(heap, (got[0], h, sym[h], whole, i, got[1]))
    return [s for s in sym if s is not None]
