"""Word shingles as sets of 64-bit numbers, and exact links between sets."""

from __future__ import annotations

import numpy as np

STEP = np.uint64(0x9E3779B97F4A7C15)
_words: dict[bytes, int] = {}


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, width: int = 5) -> np.ndarray:
    """Sorted distinct shingles of ``width`` words, A-Z lower-cased; fewer words are one shingle, none is none.

    ``bytes.split`` separates at exactly the bytes 9 to 13 and 32.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    found = list(map(_words.get, words))
    if None in found:
        import xxhash

        if len(_words) > 300_000:
            _words.clear()
        new = {w: xxhash.xxh3_64_intdigest(w) for w, f in zip(words, found) if f is None}
        _words.update((w, h) for w, h in new.items() if len(w) <= 64)
        found = [new[w] if f is None else f for w, f in zip(words, found)]
    hashes = np.array(found, np.uint64)
    n = max(1, len(hashes) - width + 1)
    total = np.full(n, min(width, len(hashes)), np.uint64)
    for i in range(min(width, len(hashes))):
        total = mixed(total * STEP + hashes[i : i + n])
    return np.unique(total)


def links(sets: list[np.ndarray], percent: int = 75, left: np.ndarray | None = None) -> list[tuple[int, int]]:
    """All pairs i, j of sets with 100 * intersection >= percent * union; with ``left``, those with left[i] only.

    Intersections are counted through the lists of sets that share an element, so only
    sets with something in common are ever compared.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    owners = np.repeat(np.arange(len(sets)), sizes)
    elements = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    order = np.argsort(elements, kind="stable")
    _, number, counts = np.unique(elements, return_inverse=True, return_counts=True)
    starts = np.concatenate([[0], np.cumsum(counts)])
    holders = owners[order]
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    out: list[tuple[int, int]] = []
    for i in range(len(sets)) if left is None else np.flatnonzero(left).tolist():
        mine = number[bounds[i] : bounds[i + 1]]
        mine = mine[counts[mine] > 1]
        if not len(mine):
            continue
        lengths = counts[mine]
        at = np.arange(lengths.sum()) + np.repeat(starts[mine] - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths)
        common = np.bincount(holders[at], minlength=len(sets))
        near = np.flatnonzero(100 * common >= percent * (sizes[i] + sizes - common))
        out += [(i, j) for j in near.tolist() if j != i and (left is not None or j > i)]
    return out


def roots(n: int, pairs: list[tuple[int, int]]) -> list[int]:
    """For each of n items the smallest item that pairs reach."""
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]
