"""Suffixes at content-chosen places, their sort, and what neighbours share."""

from __future__ import annotations

import numpy as np

#: Odd multipliers, one for each doubling of a hash's width.
ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93)]
GRAM = 16


def anchors(data: bytes, length: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the starts 0..n-length of strings of ``length`` bytes, grouped by anchor: anchor, first start, last start.

    A start's anchor is the place in [start, start + window) whose next 16 bytes hash
    lowest, the last such.  It depends on the string's own bytes alone, so wherever the
    string occurs again, its anchor is at the same distance.
    """
    if len(data) < length:
        return tuple(np.zeros(0, np.int64) for _ in range(3))
    hashes = np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1)
    step = 1
    for odd in ODD:
        hashes = hashes[:-step] * odd + hashes[step:]
        hashes ^= hashes >> np.uint64(29)
        step *= 2
    hashes *= ODD[1]
    hashes ^= hashes >> np.uint64(32)
    bits = max(16, len(data).bit_length())
    low = np.uint64((1 << bits) - 1)
    best = (hashes & ~low) | (low - np.arange(len(hashes), dtype=np.uint64))
    step = 1
    while step < window:
        by = min(step, window - step)
        best = np.minimum(best[:-by], best[by:])
        step += by
    places = (low - (best[: len(data) - length + 1] & low)).astype(np.int64)
    change = np.flatnonzero(np.diff(places)) + 1
    first = np.concatenate([[0], change])
    return places[first], first, np.concatenate([change - 1, [len(places) - 1]])


def tokens(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Strings as rows of big-endian 8-byte tokens, zero-padded, and their lengths."""
    lengths = np.array([len(s) for s in strings], np.int64)
    width = max(1, -(-int(lengths.max(initial=0)) // 8))
    joined = b"".join(s.ljust(8 * width, b"\0") for s in strings)
    return np.frombuffer(joined, ">u8").reshape(len(strings), width).astype(np.uint64), lengths


def multikey_quicksort(table: np.ndarray, small: int = 24) -> np.ndarray:
    """The order of rows of tokens: three-way partition by one token, the equal part goes on to the next."""
    done: list[np.ndarray] = []
    todo = [(np.arange(len(table)), 0)]
    while todo:
        rows, depth = todo.pop()
        if len(rows) <= 1 or depth == table.shape[1]:
            done.append(rows)
        elif len(rows) <= small:
            done.append(rows[np.lexsort(table[rows, depth:].T[::-1])])
        else:
            column = table[rows, depth]
            pivot = np.partition(column, len(column) // 2)[len(column) // 2]
            todo += [(rows[column > pivot], depth), (rows[column == pivot], depth + 1), (rows[column < pivot], depth)]
    return np.concatenate(done) if done else np.zeros(0, np.int64)


def neighbours_share(table: np.ndarray, lengths: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Bytes that each string in ``order`` shares with the one before it; 0 for the first."""
    if not len(order):
        return np.zeros(0, np.int64)
    differ = table[order[1:]] ^ table[order[:-1]]
    unequal = differ != 0
    token = np.where(unequal.any(axis=1), unequal.argmax(axis=1), table.shape[1])
    word = differ[np.arange(len(differ)), np.minimum(token, table.shape[1] - 1)]
    byte = np.zeros(len(word), np.int64)
    for k in range(1, 8):  # leading zero bytes of the first token that differs
        byte += (word >> np.uint64(64 - 8 * k)) == 0
    shared = np.where(token == table.shape[1], 8 * token, 8 * token + byte)
    return np.concatenate([[0], np.minimum(shared, np.minimum(lengths[order[1:]], lengths[order[:-1]]))])


def runs(flags: np.ndarray) -> list[int]:
    """First and last index of each run of true values, flat."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    edges[1::2] -= 1
    return edges.tolist()


def repeated(rights: list[bytes], lefts: list[bytes], spans: np.ndarray, length: int, lead: int) -> list[list[int]]:
    """For contexts of anchors: the runs of their starts whose ``length`` bytes another context has too.

    A context is the bytes before its anchor, from its first start, and those after it.
    ``spans``: last start - first start.  Suffixes (the right parts) are sorted by multikey
    quicksort; those that share ``lead`` bytes with a neighbour form groups.  A string that
    starts l bytes before the anchor repeats in a group where l left bytes and length - l
    right bytes are shared, each of which sorted neighbours tell.
    """
    right, right_lengths = tokens(rights)
    order = multikey_quicksort(right)
    shared = neighbours_share(right, right_lengths, order)
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(shared < lead)
    left, left_lengths = tokens([x[::-1] for x in lefts])
    by_left = np.lexsort((*left.T[::-1], group))
    left_shared = neighbours_share(left, left_lengths, by_left)
    rank = np.empty(len(order), np.int64)
    rank[by_left] = np.arange(len(order))
    out: list[list[int]] = [[] for _ in rights]
    bounds = np.flatnonzero(np.concatenate([np.diff(group[order]) != 0, [True]])) + 1 if len(order) else []
    begin = 0
    for end in np.asarray(bounds).tolist():  # the group's members are order[begin:end] and by_left[begin:end]
        if end - begin > 1:
            members = order[begin:end]
            most, least = left_lengths[members], left_lengths[members] - spans[members]
            if end - begin == 2:
                low, high = max(length - shared[begin + 1], least.max()), min(left_shared[begin + 1], most.min())
                if low <= high:
                    for m, n in zip(members.tolist(), most.tolist()):
                        out[m] = [int(n - high), int(n - low)]
            else:
                offsets = np.arange(least.min(), most.max() + 1)[:, None]
                right_class = np.cumsum(shared[None, begin:end] < length - offsets, axis=1)
                left_class = np.cumsum(left_shared[None, begin:end] < offsets, axis=1)[:, rank[members] - begin]
                code = right_class * (end - begin + 1) + left_class
                owned = (offsets >= least) & (offsets <= most)
                code = np.where(owned, code, -1 - np.arange(end - begin))
                place = np.argsort(code, axis=1, kind="stable")
                ranked = np.take_along_axis(code, place, 1)
                same = ranked[:, 1:] == ranked[:, :-1]
                twin = np.zeros_like(owned)
                np.put_along_axis(twin, place, np.pad(same, ((0, 0), (0, 1))) | np.pad(same, ((0, 0), (1, 0))), 1)
                for k, m in enumerate(members.tolist()):
                    starts = twin[::-1, k]  # from the longest left part, the first start, on
                    skip = int(offsets[-1, 0] - most[k])
                    out[m] = [x - skip for x in runs(starts)]
        begin = end
    return out
