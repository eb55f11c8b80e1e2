"""Near-duplicate embeddings by dual traversal of cover trees (operator 1).

Vectors go to the nearest of some pivots, whose number grows with the root of the rows, and
each pivot's cell to blocks of bounded size, however many vectors one cell holds.  A block has a cover tree.  Pairs
of cells, then of blocks, are dropped by their covering radii; the other pairs of blocks
are traversed together, a tile of some blocks by some blocks in a task, so that a block
travels once for each tile and not for each pair.  A pair of nodes that is close as a whole is counted, not
enumerated, so a large group of near copies costs its size and not its square; a task
returns a row for each vector that has links, with their number and a representative.

No label takes part.  Cosines are computed in double precision.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.graph import components
from scriptorium.llm.shared import map_batches, settle, written
from scriptorium.session import ship

BLOCK = 4096
#: Blocks on a side of a tile.
SIDE = 3
#: There are a pivot for this many times the root of the rows, and rows drawn for each.
PIVOT_SHARE, DRAWN = 8, 64


def _units(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, np.float64)
    x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])  # exact, and squares neither vanish nor overflow
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """A list column whose lists have one width, as it is stored."""
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def pivots_of(rows: DataFrame, many: int, sample: int) -> np.ndarray:
    """Vectors far from each other, from at most ``sample`` rows: they steer speed, not results."""
    drawn = rows.orderBy(F.xxhash64("rid")).limit(sample).select("vector").collect()
    if not drawn:
        return np.zeros((0, 0))
    wide = max({len(r.vector) for r in drawn}, key=lambda n: (sum(len(r.vector) == n for r in drawn), n))
    x = _units(np.array([r.vector for r in drawn if len(r.vector) == wide]))
    chosen, nearest = [0], x @ x[0]
    while len(chosen) < min(many, len(x)):
        chosen.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, x @ x[chosen[-1]])
    return x[chosen]


def _assigned(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """rid, vector, cell, angle to its pivot; a vector of another width has a cell for its width."""

    def start():
        settle()

        def fill(batch: pa.RecordBatch) -> dict:
            vectors = batch.column("vector")
            widths = pc.list_value_length(vectors).to_numpy(zero_copy_only=False)
            cells, angles = -widths.astype(np.int64), np.full(len(widths), np.pi)
            like = np.flatnonzero(widths == pivots.shape[1])
            if len(like):
                x = _units(pc.list_flatten(vectors.take(pa.array(like))).to_numpy(zero_copy_only=False).reshape(len(like), -1))
                cosines = x @ pivots.T
                cells[like] = cosines.argmax(axis=1)
                angles[like] = np.arccos(np.clip(cosines.max(axis=1), -1, 1))
            return {"rid": batch.column("rid"), "vector": vectors, "cell": cells, "angle": angles}

        return fill

    return map_batches(rows, start, f"rid long, vector {rows.schema['vector'].dataType.simpleString()}, cell int, angle double")


def _blocks(assigned: DataFrame, block: int) -> DataFrame:
    """block, side, cell, reach, rids, vectors (as bytes): a row for each block of some ``block`` vectors at most."""
    cells = assigned.groupBy("cell").agg(F.count("*").alias("n")).select("cell", F.ceil(F.col("n") / block).cast("int").alias("parts"))
    dealt = assigned.join(F.broadcast(cells), "cell")  # a row a pivot, and one a width
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("rid"), F.col("parts")).cast("int"))

    def gather(table: pa.Table) -> pa.Table:
        rids = table.column("rid").to_numpy()
        order = np.argsort(rids, kind="stable")
        cell, part = table.column("cell")[0].as_py(), table.column("part")[0].as_py()
        vectors = _matrix(table.column("vector"), len(table.column("vector")[0]))[order]
        return pa.table({
            "block": pa.array([cell * 1_000_003 + part], pa.int64()), "side": pa.array([cell * 1_000_003 + part // SIDE], pa.int64()),
            "cell": pa.array([cell], pa.int32()), "reach": [float(table.column("angle").to_numpy().max())],
            "rids": [rids[order].tobytes()], "vectors": [vectors.tobytes()],
        })

    return dealt.groupBy("cell", "part").applyInArrow(gather, "block long, side long, cell int, reach double, rids binary, vectors binary")


def _pairs(blocks: DataFrame, pivots: np.ndarray, limit: float) -> DataFrame:
    """Pairs of blocks (a <= b), and their sides, that covering radii cannot tell apart.

    The cells' largest radii, one number a pivot, come to the driver; the pairs of cells are
    listed by tasks, a pivot at a time.
    """
    spark = blocks.sparkSession
    reach = {r.cell: r.reach for r in blocks.groupBy("cell").agg(F.max("reach").alias("reach")).collect()}
    reached = np.array([reach.get(c, -np.inf) for c in range(len(pivots))])

    def near(batches):
        for batch in batches:
            for c in batch.column("id").to_pylist():
                if c < 0:  # vectors of another width have no pivot
                    yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([c], pa.int32()), pa.array([0.0])], names=["cell", "other", "apart"])
                    continue
                apart = np.arccos(np.clip(pivots[c:] @ pivots[c], -1, 1))
                apart[0] = 0.0
                others = np.flatnonzero(apart <= reached[c] + reached[c:] + limit + 1e-6)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(others), c), pa.int32()), pa.array(c + others, pa.int32()), pa.array(apart[others])], names=["cell", "other", "apart"])

    cells = spark.createDataFrame([(int(c),) for c in reach], "id long").mapInArrow(near, "cell int, other int, apart double")
    one = blocks.select("cell", F.col("block").alias("a"), F.col("reach").alias("reach_a"), F.col("side").alias("side_a"))
    two = blocks.select(F.col("cell").alias("other"), F.col("block").alias("b"), F.col("reach").alias("reach_b"), F.col("side").alias("side_b"))
    found = one.join(cells, "cell").join(two, "other")
    return found.where(f"(cell < other OR a <= b) AND apart <= reach_a + reach_b + {limit + 1e-6}").select("a", "b", "side_a", "side_b")


def _links(blocks: DataFrame, pairs: DataFrame, cosine: float, item: str) -> DataFrame:
    """rid, n, root: a row for each vector and pair of blocks in which it has links."""
    pairs = written(pairs.withColumn("tile", F.struct("side_a", "side_b")), "pairs")
    todo = pairs.groupBy("tile").agg(F.collect_list(F.struct("a", "b")).alias("pairs"))  # SIDE squared at most
    wanted = pairs.select("tile", F.explode(F.array("a", "b")).alias("block")).distinct()
    payload = wanted.join(blocks.select("block", "rids", "vectors"), "block").withColumn("pairs", F.lit(None).cast("array<struct<a:bigint,b:bigint>>"))
    heads = todo.select("tile", F.lit(None).cast("long").alias("block"), F.lit(None).cast("binary").alias("rids"), F.lit(None).cast("binary").alias("vectors"), "pairs")
    rows = payload.select("tile", "block", "rids", "vectors", "pairs").unionAll(heads)

    def compare(table: pa.Table) -> pa.Table:
        from scriptorium.llm.cover_tree import build, link_blocks

        settle()
        trees, todo = {}, []
        for row in table.select(["block", "rids", "vectors", "pairs"]).to_pylist():
            if row["block"] is None:
                todo += [(p["a"], p["b"]) for p in row["pairs"]]
            else:
                ids = np.frombuffer(row["rids"], np.int64)
                trees[row["block"]] = ids, build(_units(np.frombuffer(row["vectors"], item).reshape(len(ids), -1)))
        found = [link_blocks(trees[a][1], trees[b][1], trees[a][0], trees[b][0], cosine, a == b) for a, b in sorted(todo)]
        return pa.table({n: pa.array(np.concatenate([f[i] for f in found]), pa.int64()) for i, n in enumerate(("rid", "n", "root"))})

    return rows.groupBy("tile").applyInArrow(compare, "rid long, n long, root long")


def embedding_duplicates(df: DataFrame, cosine: float = 0.9, key: str = "vec_id", vector: str = "embedding", block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row; links are cosines of ``cosine`` or more.

    Vectors that are null, empty, zero or hold null or non-finite components, and vectors
    of different widths, link with nothing.  Repeated rows are vectors of their own and
    link with each other.  A null key counts as larger than any.  Empty table: no rows;
    other columns are not read.
    """
    ship(df.sparkSession)
    single = df.schema[vector].dataType.simpleString() == "array<float>"  # kept as it is; every cosine is computed in doubles
    vectors = F.col(f"`{vector}`") if single else F.col(f"`{vector}`").cast("array<double>")
    rows = written(df.select(F.col(f"`{key}`").alias("vec_id"), vectors.alias("vector")).withColumn("rid", F.monotonically_increasing_id()), "vectors")
    some = F.exists("vector", lambda x: x != 0)
    fine = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    good = rows.where(F.coalesce(some & fine, F.lit(False)))
    count = rows.count()
    many = max(1, min(math.isqrt(count) // PIVOT_SHARE, count // block))
    pivots = pivots_of(good, many, DRAWN * many)
    result = rows.select("vec_id", "rid")
    if not len(pivots):
        return result.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    blocks = written(_blocks(_assigned(good.select("rid", "vector"), pivots), block), "blocks")
    found = written(_links(blocks, _pairs(blocks, pivots, float(np.arccos(cosine))), cosine, "<f4" if single else "<f8"), "links")
    counts = found.groupBy("rid").agg(F.sum("n").alias("n_links"))
    whole = components(found, "rid", "root").withColumnRenamed("id", "rid")
    placed = result.join(counts, "rid", "left").join(whole, "rid", "left")
    placed = written(placed.select("vec_id", "rid", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("root", "rid").alias("root")), "placed")
    least = written(placed.groupBy("root").agg(F.min("vec_id").alias("component_id")), "least")
    named = placed.join(least.hint("merge"), "root")  # both sides are read and dealt: a hot root is split
    return named.select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
