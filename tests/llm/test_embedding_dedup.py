import numpy as np
import pytest

from scriptorium.llm import cover_tree, embedding_dedup
from scriptorium.llm.embedding_dedup import embedding_duplicates
from scriptorium.llm.shingles import roots


def brute(ids, vectors, cosine=0.9):
    x = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    near = x @ x.T >= cosine
    np.fill_diagonal(near, False)
    root = roots(len(ids), list(zip(*map(list, np.nonzero(near)))))
    return {i: (int(n.sum()), min(ids[j] for j in range(len(ids)) if root[j] == root[k])) for k, (i, n) in enumerate(zip(ids, near))}


def clustered(seed, n=300, dim=12):
    draw = np.random.default_rng(seed)
    centres = draw.standard_normal((n // 12, dim))
    return np.concatenate([draw.standard_normal((n // 2, dim)), centres[draw.integers(0, len(centres), n // 2)] + draw.choice([0.02, 0.2, 0.35], (n // 2, 1)) * draw.standard_normal((n // 2, dim))])


@pytest.mark.parametrize("block", [40, 4096])
def test_like_brute_force(spark, block):
    x = clustered(1)
    rows = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    found = {r.vec_id: (r.n_links, r.component_id) for r in embedding_duplicates(rows, block=block).collect()}
    assert found == brute(list(range(len(x))), x)


def test_bounds_hold_and_levels_nest():
    x = clustered(2)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    tree = cover_tree.build(x)
    for k in range(len(cover_tree.RADII) - 1):
        assert set(tree.centres[k]) <= set(tree.centres[k + 1])
    for level in range(len(cover_tree.RADII)):
        points = cover_tree.first_points(tree, level)
        assert sorted(np.concatenate(points)) == list(range(len(x)))
        for node, below in enumerate(points):
            far = cover_tree.angle(x[below] @ x[tree.centres[level][node]]).max()
            assert far <= tree.radius[level][node] + 1e-6 and len(below) == tree.size[level][node]


def test_a_large_group_is_counted_without_listing_pairs():
    draw = np.random.default_rng(3)
    x = np.ones((2000, 8)) + 0.01 * draw.standard_normal((2000, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    tree = cover_tree.build(x)
    ids, counts, root = cover_tree.link_blocks(tree, tree, np.arange(2000), np.arange(2000), 0.9, True)
    assert (counts == 1999).all() and len(set(root)) == 1 and len(ids) == 2000


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    vectors = [[1.0, 0.0], [2.0, 0.0], None, [], [0.0, 0.0], [nan, 1.0], [inf, 1.0], [1.0, None], [1.0, 0.0, 0.0], [0.9, 0.4358898943540674], [1.0, 0.0]]
    rows = spark.createDataFrame([(i if i != 10 else 0, v, "x", 3) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>, rid string, n int")
    found = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in embedding_duplicates(rows).collect())
    alone = [(i, 0, i, True) for i in (2, 3, 4, 5, 6, 7, 8)]
    assert [f for f in found if f[0] in range(2, 9)] == alone
    assert [f for f in found if f[0] in (0, 1, 9)] == [(0, 3, 0, True), (0, 3, 0, True), (1, 3, 0, False), (9, 3, 0, False)]


def test_extreme_components(spark):
    """Squares of the smallest doubles vanish and those of the largest overflow: cosines do not depend on length."""
    near = [[1.0, 0.0, 0.01 * i] for i in range(3)]
    vectors = near + [[1e-200] * 3, [1e200] * 3, [5e-324, 0.0, 0.0]]
    rows = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>")
    found = {r.vec_id: (r.n_links, r.component_id) for r in embedding_duplicates(rows).collect()}
    assert found == {0: (3, 0), 1: (3, 0), 2: (3, 0), 3: (1, 3), 4: (1, 3), 5: (3, 0)}


def test_radii_prune_clusters_but_not_noise():
    """Of all pairs, those whose cosine is computed: few among tight clusters, all among random vectors of 64 dimensions."""
    draw = np.random.default_rng(7)
    centres = draw.standard_normal((40, 64))
    share = []
    for x in (centres[draw.integers(0, 40, 2000)] + 0.05 * draw.standard_normal((2000, 64)), draw.standard_normal((2000, 64))):
        tree, work = cover_tree.build(x / np.linalg.norm(x, axis=1, keepdims=True)), [0]
        assert len(tree.centres[0]) == 1
        cover_tree.dual(tree, tree, 0.9, True, work)
        share.append(work[0] / 2000**2)
    assert share[0] < 0.01 and share[1] < 1.01


def test_many_pivots(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "PIVOT_SHARE", 1)
    x = clustered(4)
    rows = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    found = {r.vec_id: (r.n_links, r.component_id) for r in embedding_duplicates(rows, block=12).collect()}
    assert found == brute(list(range(len(x))), x)


def test_empty_and_unusable(spark):
    rows = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert embedding_duplicates(rows).isEmpty()
    one = spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in embedding_duplicates(one).collect()] == [(1, 0, 1, True)]


def test_short_vectors_bound_cosines_and_lose_no_link():
    """Where no radius prunes, most pairs are told by 22 numbers a vector; links are those of all cosines."""
    draw = np.random.default_rng(5)
    unit = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
    noise = draw.standard_normal((1200, 64))
    noise[600:] = np.where(draw.random((600, 1)) < 0.3, noise[:600] + 0.2 * draw.standard_normal((600, 64)), noise[600:])
    near, wide = 1 + 0.33 * draw.standard_normal((1200, 64)), draw.standard_normal((1200, 300))
    for x in map(unit, (noise, near, wide, noise[:, :8])):
        a, b = x[:600], x[600:]
        left, right = cover_tree.bounds(a, b)
        assert left.shape[1] <= cover_tree.AXES + 1 and (left @ right.T + cover_tree.COARSE >= a @ b.T).all()
        counts = cover_tree.dual(cover_tree.build(a), cover_tree.build(b), 0.9, False)[:2]
        linked = a @ b.T >= 0.9
        assert (counts[0] == linked.sum(axis=1)).all() and (counts[1] == linked.sum(axis=0)).all()
    a, b = unit(noise)[:600], unit(noise)[600:]
    left, right = cover_tree.bounds(a, b)
    assert (left @ right.T >= 0.9).mean() < 0.05
