"""Cover trees over unit vectors, and their dual traversal for all pairs within an angle."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Angles are computed to some 1e-8; bounds are trusted only beyond this.
SLACK = 1e-6
#: Radians of the nested levels; each half of the one before, and the first covers every point.
RADII = tuple(np.pi / 2**k for k in range(6))
#: Children of a pair of nodes from which on they are compared by a matrix product.
MANY = 1024
#: Axes on which such products are bounded before cosines are computed, and what single precision may err there.
AXES, COARSE = 21, np.float32(1e-5)


@dataclass
class CoverTree:
    """Nested levels of centres.  Level k's nodes are points; the last level's are all points.

    ``centres[k]``: indexes of points; ``radius[k]``: largest angle from a centre to its
    descendants; ``parent[k]``: for each node of level k + 1 its node in level k;
    ``size[k]``: points below a node.
    """

    vectors: np.ndarray
    centres: list[np.ndarray]
    radius: list[np.ndarray]
    parent: list[np.ndarray]
    size: list[np.ndarray]


class Forest:
    """Components of points while links come in arrays; links within a component cost no loop."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def join(self, p: np.ndarray, q: np.ndarray) -> None:
        r, s = self.root[p], self.root[q]
        while (apart := r != s).any():
            low, high = np.minimum(r, s)[apart], np.maximum(r, s)[apart]
            np.minimum.at(self.root, high, low)
            while not np.array_equal(up := self.root[self.root], self.root):
                self.root = up
            r, s = self.root[r[apart]], self.root[s[apart]]


def angle(cosine: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosine, -1.0, 1.0))


def build(vectors: np.ndarray) -> CoverTree:
    """Greedy: a level keeps the coarser level's centres and adds points that none covers."""
    n, single = len(vectors), vectors.astype(np.float32)  # whose centre a point takes steers speed; radii are measured in doubles
    centres: list[np.ndarray] = []
    parent: list[np.ndarray] = []
    chosen: list[int] = []
    nearest, best = np.zeros(n, np.int64), np.full(n, -2.0)  # of all centres so far
    for radius in RADII:
        while len(far := np.flatnonzero(best < np.cos(radius))):
            # a batch of uncovered points; those that an earlier one of it covers are dropped
            batch = far[:256]
            near = np.tril(single[batch] @ single[batch].T >= np.cos(radius), -1)
            keep: list[int] = []
            for i in range(len(batch)):
                if not near[i, keep].any():
                    keep.append(i)
            for at in range(0, n, 4096):
                found = single[at : at + 4096] @ single[batch[keep]].T
                top = found.argmax(axis=1)
                value = found[np.arange(len(found)), top]
                better = value > best[at : at + 4096]
                best[at : at + 4096][better] = value[better]
                nearest[at : at + 4096][better] = len(chosen) + top[better]
            for i, p in enumerate(batch[keep]):
                nearest[p], best[p] = len(chosen) + i, 2.0  # a centre belongs to itself
            chosen += batch[keep].tolist()
        centres.append(np.array(chosen))
        parent.append(nearest.copy())
    # parent[k] so far: the level k node nearest to each point; a finer node hangs below that of its own point
    links = [parent[k][centres[k + 1]] for k in range(len(RADII) - 1)] + [parent[-1]]
    centres.append(np.arange(n))
    below = np.arange(n)  # each point's node in the level
    radius, size = [np.zeros(n)], [np.ones(n, np.int64)]
    for k in reversed(range(len(RADII))):
        below = links[k][below]
        far = angle(np.einsum("ij,ij->i", vectors, vectors[centres[k][below]]))
        far[centres[k][below] == np.arange(n)] = 0.0
        reach = np.zeros(len(centres[k]))
        np.maximum.at(reach, below, far)
        radius.insert(0, reach)
        size.insert(0, np.bincount(below, minlength=len(centres[k])))
    return CoverTree(vectors, centres, radius, links, size)


def children(tree: CoverTree, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of level + 1 sorted by parent, and where each parent's begin."""
    order = np.argsort(tree.parent[level], kind="stable")
    return order, np.searchsorted(tree.parent[level][order], np.arange(len(tree.centres[level]) + 1))


def first_points(tree: CoverTree, level: int) -> list[np.ndarray]:
    """For each node of a level the points below it."""
    below = np.arange(len(tree.vectors))
    for k in reversed(range(level, len(RADII))):
        below = tree.parent[k][below]
    order = np.argsort(below, kind="stable")
    return np.split(order, np.searchsorted(below[order], np.arange(1, len(tree.centres[level]))))


def dual(a: CoverTree, b: CoverTree, cosine: float, same: bool, work: list[int] | None = None) -> tuple[np.ndarray, np.ndarray, Forest]:
    """Link counts of a's and of b's points, and their components (b's points follow a's, unless they are the same).

    A pair of nodes is dropped when even its closest descendants are too far apart, and
    taken whole when even its farthest are close enough; else its children are compared.
    ``same``: both are one tree; a pair of points then counts once for each of the two.
    ``work[0]`` grows by the pairs of nodes and points that are compared.
    """
    limit = float(np.arccos(cosine))
    counts = np.zeros(len(a.vectors), np.int64), np.zeros(len(b.vectors), np.int64)
    joined = Forest(len(a.vectors) if same else len(a.vectors) + len(b.vectors))
    shift = 0 if same else len(a.vectors)
    last = len(RADII)
    coarse = bounds(a.vectors, b.vectors)
    i, j = (x.ravel() for x in np.meshgrid(np.arange(len(a.centres[0])), np.arange(len(b.centres[0])), indexing="ij"))
    work = [0] if work is None else work
    for level in range(last + 1):
        whole, part = [], []
        for at in range(0, len(i), 50_000):
            p, q = i[at : at + 50_000], j[at : at + 50_000]
            apart = np.einsum("ij,ij->i", a.vectors[a.centres[level][p]], b.vectors[b.centres[level][q]])
            if level == last:
                near = (apart >= cosine) & ((p != q) if same else True)
                np.add.at(counts[0], p[near], 1)
                np.add.at(counts[1], q[near], 1)
                joined.join(p[near], q[near] + shift)
                continue
            apart, radii = angle(apart), a.radius[level][p] + b.radius[level][q]
            inside = apart + radii <= limit - SLACK
            whole.append((p[inside], q[inside]))
            open_ = ~inside & (apart <= radii + limit + SLACK)
            part.append((p[open_], q[open_]))
        if not part:
            break
        _take_whole(a, b, level, *(np.concatenate(x) for x in zip(*whole)), counts, joined, same)
        i, j = _expand(a, b, level, *(np.concatenate(x) for x in zip(*part)), limit, work, coarse)
    return *counts, joined


def _take_whole(a, b, level, p, q, counts, joined, same) -> None:
    if not len(p):
        return
    single = (a.size[level][p] == 1) & (b.size[level][q] == 1)
    x, y = a.centres[level][p[single]], b.centres[level][q[single]]
    other = x != y if same else np.ones(len(x), bool)
    np.add.at(counts[0], x[other], 1)
    np.add.at(counts[1], y[other], 1)
    joined.join(x[other], y[other] + (0 if same else len(a.vectors)))
    p, q = p[~single], q[~single]
    in_a, in_b = first_points(a, level), first_points(b, level)
    for x, y in zip(p.tolist(), q.tolist()):
        own = int(same and x == y)  # a point is not its own link
        counts[0][in_a[x]] += len(in_b[y]) - own
        counts[1][in_b[y]] += len(in_a[x]) - own
        shift = 0 if same else len(a.vectors)
        joined.join(np.concatenate([in_a[x], np.full(len(in_b[y]), in_a[x][0])]), shift + np.concatenate([np.full(len(in_a[x]), in_b[y][0]), in_b[y]]))


def bounds(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Short vectors whose products are at least the cosines of the unit vectors x and y.

    Some axes on which both have much of their length are kept, and the length of what is left is one more.
    """
    drawn = np.concatenate([v[:: max(1, len(v) // 256)] for v in (x, y)])
    if x.shape[1] <= 256:
        axes = np.linalg.eigh(drawn.T @ drawn)[1][:, ::-1][:, :AXES]
        heads = [v @ axes for v in (x, y)]
    else:
        axes = np.argsort(-(drawn * drawn).sum(axis=0), kind="stable")[:AXES]
        heads = [v[:, axes] for v in (x, y)]
    return tuple(np.concatenate([h, np.sqrt(np.maximum(0.0, 1 - (h * h).sum(axis=1, keepdims=True)))], axis=1).astype(np.float32) for h in heads)


def _expand(a, b, level, p, q, limit, work, coarse) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of children, one of each, whose covering radii do not keep them apart."""
    (order_a, begin_a), (order_b, begin_b) = children(a, level), children(b, level)
    at_a, at_b = a.vectors[a.centres[level + 1]], b.vectors[b.centres[level + 1]]
    reach_a, reach_b = a.radius[level + 1], b.radius[level + 1]
    many_a, many_b = begin_a[p + 1] - begin_a[p], begin_b[q + 1] - begin_b[q]
    work[0] += int((many_a * many_b).sum())
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    large = many_a * many_b >= MANY
    acute = large.any() and reach_a.max() + reach_b.max() + limit + SLACK < np.pi
    if acute:  # the least cosine, cos(u + v), is cos u cos v - sin u sin v: two more axes take it off
        u, v = reach_a + (limit + SLACK), reach_b
        left = np.column_stack([coarse[0][a.centres[level + 1]], -np.cos(u), np.sin(u)]).astype(np.float32)
        right = np.column_stack([coarse[1][b.centres[level + 1]], np.cos(v), np.sin(v)]).astype(np.float32)
    for x, y in zip(p[large].tolist(), q[large].tolist()):
        own, other = order_a[begin_a[x] : begin_a[x + 1]], order_b[begin_b[y] : begin_b[y + 1]]
        step = max(1, 4_000_000 // len(other))
        for at in range(0, len(own), step):
            some = own[at : at + step]
            if acute:
                r, s = np.divmod(np.flatnonzero(left[some] @ right[other].T >= -COARSE), len(other))
                if len(r) <= len(some) * len(other) // 16:  # else they are as cheap all at once
                    r, s = some[r], other[s]
                    near = np.einsum("ij,ij->i", at_a[r], at_b[s]) >= np.cos(reach_a[r] + reach_b[s] + limit + SLACK)
                    found.append((r[near], s[near]))
                    continue
            # cos of an angle that both radii and the limit cannot bridge; beyond pi nothing is dropped
            least = np.cos(np.minimum(np.pi, reach_a[some][:, None] + reach_b[other][None, :] + limit + SLACK)) if reach_a[some].any() or reach_b[other].any() else np.cos(limit + SLACK)
            r, s = np.nonzero(at_a[some] @ at_b[other].T >= least)
            found.append((some[r], other[s]))
    p, q, many_a, many_b = p[~large], q[~large], many_a[~large], many_b[~large]
    ends = np.cumsum(many_a * many_b)
    for at in range(0, int(ends[-1]) if len(ends) else 0, 200_000):
        place = np.arange(at, min(at + 200_000, int(ends[-1])))
        pair = np.searchsorted(ends, place, side="right")
        within = place - (ends[pair] - many_a[pair] * many_b[pair])
        x, y = order_a[begin_a[p[pair]] + within // many_b[pair]], order_b[begin_b[q[pair]] + within % many_b[pair]]
        near = np.einsum("ij,ij->i", at_a[x], at_b[y]) >= np.cos(np.minimum(np.pi, reach_a[x] + reach_b[y] + limit + SLACK))
        found.append((x[near], y[near]))
    return tuple(np.concatenate(x) for x in zip(*found))


def link_blocks(a: CoverTree, b: CoverTree, ids_a: np.ndarray, ids_b: np.ndarray, cosine: float, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """id, links, root of every point with links between two blocks: a row each, however many links."""
    count_a, count_b, joined = dual(a, b, cosine, same)
    ids = ids_a if same else np.concatenate([ids_a, ids_b])
    counts = count_a if same else np.concatenate([count_a, count_b])
    linked = counts > 0
    return ids[linked], counts[linked], ids[joined.root][linked]
