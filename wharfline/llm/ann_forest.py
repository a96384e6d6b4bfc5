"""Approximate nearest neighbours by a forest of random-projection trees.

Each tree halves a bounded sample of the vectors again and again at the median of a projection onto the line
through two of its points. The trees are broadcast (at most FOREST_BYTES) and every vector is routed to its leaf in each tree. A
query walks all trees through one priority queue, the leaves with the smallest sum of squared distances to the planes that
part it from them first, until the leaves that it has seen hold a share of the sample.

The share is calibrated before the search: for CALIBRATION points of the sample, their true neighbours in the sample are
found by comparing with all of it, and the share is the smallest at which the walk finds TARGET of them. Neighbours lie closer
in all the vectors than in a sample of them, so the share errs on the safe side. Where vectors have nearly equal
distances, as random ones have, no order of leaves tells much and the share is large; where they form clusters it is small.

Leaves lie in cells of neighbouring leaves, and a cell in blocks of about BLOCK vectors. A block's vectors and the queries that
visit its cell are dealt to one task, sorted, vectors first; the vectors of one block are held and queries stream
past them, so memory is bounded by a block whatever the number of vectors or queries. Within the block only visited leaves are
compared; the best are reranked by exact distance. Equal vectors are one point that lists the smallest ids it
needs, so that a vector that a third of all rows share is met once.

Defined results: vectors that are null, zero, or hold null or non-finite components take no part, nor do rows with a null id
or with another length than most; ties go to the smaller id; a query meets every row but its own; repeated rows
are candidates once; an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialise, partitions, ship

#: Vectors on which trees are fitted, at most (those with the smallest hashes), and the bytes of the trees.
SAMPLE, FOREST_BYTES = 20_000, 64_000_000
TREES, LEAVES = 4, 512
#: Points for the calibration of the share, and the recall that it has to reach among them.
CALIBRATION, TARGET = 256, 0.97
#: Vectors of a block, about.
BLOCK = 4096

Tree = tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]


def grow(x: np.ndarray, leaf: int, seed: int) -> Tree:
    """(planes, thresholds, children, the sample's numbers in each leaf): a child below zero is leaf -child - 1."""
    rng = np.random.default_rng(seed)
    planes, cuts, children, leaves = [], [], [], []

    def split(at: np.ndarray) -> int:
        if len(at) > leaf:
            for _ in range(5):
                a, b = x[rng.choice(at, 2, replace=False)]
                norm = np.linalg.norm(a - b)
                if norm > 0:
                    p = x[at] @ ((a - b) / norm)
                    cut = float(np.median(p))
                    low = p <= cut
                    if low.any() and not low.all():
                        k = len(planes)
                        planes.append((a - b) / norm), cuts.append(cut), children.append((0, 0))
                        children[k] = (split(at[low]), split(at[~low]))
                        return k
        leaves.append(at)
        return -len(leaves)

    root = split(np.arange(len(x)))
    if root < 0:
        return np.zeros((0, x.shape[1])), np.zeros(0), np.zeros((0, 2), np.int64), leaves
    return np.array(planes), np.array(cuts), np.array(children, np.int64), leaves


def route(tree: Tree, x: np.ndarray) -> np.ndarray:
    """The leaf of each vector."""
    planes, cuts, children, _ = tree
    node = np.zeros(len(x), np.int64) if len(planes) else np.full(len(x), -1)
    while (open_ := np.flatnonzero(node >= 0)).size:
        k = node[open_]
        side = (np.einsum("ij,ij->i", x[open_], planes[k]) > cuts[k]).astype(np.int64)
        node[open_] = children[k, side]
    return -node - 1


def walk(forest: list[Tree], q: np.ndarray) -> Iterator[tuple[int, int]]:
    """(tree, leaf) in the order of the shared queue."""
    margins = [(tree[0] @ q - tree[1]) ** 2 if len(tree[0]) else np.zeros(0) for tree in forest]
    sides = [tree[0] @ q > tree[1] if len(tree[0]) else np.zeros(0, bool) for tree in forest]
    heap = [(0.0, t, 0 if len(tree[0]) else -1) for t, tree in enumerate(forest)]
    while heap:
        near, t, node = heapq.heappop(heap)
        if node < 0:
            yield t, -node - 1
            continue
        low, high = forest[t][2][node]
        here, there = (high, low) if sides[t][node] else (low, high)
        heapq.heappush(heap, (near, t, int(here)))
        heapq.heappush(heap, (near + margins[t][node], t, int(there)))


def visits(forest: list[Tree], q: np.ndarray, share: float, held: int) -> list[tuple[int, int]]:
    """(tree, leaf) in the order of the queue, until the leaves hold ``share`` of the sample of ``held`` vectors."""
    out, seen, n = [], np.zeros(held, bool), 0
    for t, leaf in walk(forest, q):
        if n >= share * held:
            break
        out.append((t, leaf))
        at = forest[t][3][leaf]
        n += len(at) - int(seen[at].sum())
        seen[at] = True
    return out


def calibrate(forest: list[Tree], x: np.ndarray, k: int, target: float = TARGET, points: int = CALIBRATION, seed: int = 7) -> float:
    """The least share of the sample ``x`` at which the walks from some of its points find ``target`` of their true neighbours."""
    n = len(x)
    if n <= k + 1:
        return 1.0
    norms, needs = (x**2).sum(axis=1), []
    for i in np.random.default_rng(seed).choice(n, min(points, n), replace=False).tolist():
        far = norms - 2 * (x @ x[i])
        far[i] = np.inf
        waiting = np.zeros(n, bool)
        waiting[np.argpartition(far, k)[:k]] = True
        seen, size = np.zeros(n, bool), 0
        for t, leaf in walk(forest, x[i]):
            at = forest[t][3][leaf]
            at = at[~seen[at]]
            seen[at] = True
            size += len(at)
            hit = int(waiting[at].sum())
            if hit:
                waiting[at] = False
                needs += [size / n] * hit
                if not waiting.any():
                    break
    needs.sort()
    return min(1.0, needs[min(len(needs) - 1, int(np.ceil(target * len(needs))) - 1)])


def _valid(v: Column) -> Column:
    return v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)


def _matrix(v: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(v), "<f8").reshape(len(v), -1) if len(v) else np.zeros((0, 1))


def best(b: np.ndarray, norms: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(numbers, distances) of the vectors ``b`` that can be among the k + 1 nearest to q: a fast bound, then the exact measure."""
    rough = norms - 2 * (b @ q)
    last = min(k, len(b) - 1)
    slack = 1e-9 * (1 + float(np.abs(rough).max()) + float(q @ q))
    at = np.flatnonzero(rough <= np.partition(rough, last)[last] + slack)
    return at, np.sqrt(((b[at] - q) ** 2).sum(axis=1))


def search(
    vectors: DataFrame, every: int = 100, k: int = 10, trees: int = TREES, leaves: int = LEAVES, target: float = TARGET, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row whose id is divisible by ``every``."""
    spark = vectors.sparkSession
    ship(spark)
    shards = partitions(spark)
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = rows.where(F.col("id").isNotNull() & _valid(F.col("v")))

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"id": f["id"], "v": [np.asarray(x, "<f8").tobytes() for x in f["v"]], "d": f["v"].map(len)})

    packed = materialise(rows.mapInPandas(pack, "id long, v binary, d int"), "vectors")
    common = packed.groupBy("d").count().orderBy(F.desc("count"), "d").limit(1).collect()
    if not common:
        return empty
    dims = common[0]["d"]
    packed = packed.where(F.col("d") == dims)

    # equal vectors: the k + 1 smallest ids, first in each of the salts, then over all
    keep = k + 1
    salted = packed.select("v", "id", F.pmod(F.xxhash64("id"), F.lit(shards)).alias("s")).distinct()
    first = salted.withColumn("r", F.row_number().over(Window.partitionBy("v", "s").orderBy("id"))).where(F.col("r") <= keep)
    merged = first.groupBy("v").agg(F.slice(F.array_sort(F.collect_list("id")), 1, keep).alias("ids"))
    points = materialise(merged, "points")

    # the sample: points whose hash is below a bound that lets about `most` of them through, in the order of their hashes
    n_points, most = points.count(), min(SAMPLE, max(1000, FOREST_BYTES // (8 * dims * trees)))
    hashed = F.xxhash64("v")
    chosen = points if n_points <= most else points.where(F.pmod(hashed, F.lit(1 << 30)) < int(most / n_points * (1 << 30)))
    sample = chosen.select("v").orderBy(hashed, "v").toPandas()
    x = _matrix(sample["v"])
    held = len(x)
    forest = [grow(x, max(8, -(-held // leaves)), seed) for seed in range(trees)]
    share = calibrate(forest, x, min(k, max(1, held - 2)), target)
    shared = spark.sparkContext.broadcast(forest)
    # neighbouring leaves make a cell, as long as a cell is not more than a block
    n_leaves = max(len(t[3]) for t in forest)
    per_cell = int(max(1, min(n_leaves, BLOCK * n_leaves // max(1, n_points))))
    blocks = int(max(1, -(-n_points * per_cell // (n_leaves * BLOCK))))

    def to_leaves(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            m = _matrix(f["v"])
            for t, tree in enumerate(shared.value):
                leaf = route(tree, m) if len(m) else np.zeros(0, np.int64)
                yield pd.DataFrame({"tree": t, "cell": leaf // per_cell, "block": f["block"], "asks": 0, "leaf": leaf, "id": 0, "v": f["v"], "ids": f["ids"]})

    def to_visits(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for name, raw in zip(f["id"].tolist(), f["v"], strict=True):
                per: dict[tuple[int, int], list[int]] = {}
                for t, leaf in visits(shared.value, np.frombuffer(raw, "<f8"), share, held):
                    per.setdefault((t, leaf // per_cell), []).append(leaf)
                yield pd.DataFrame({"tree": [t for t, _ in per], "cell": [c for _, c in per], "asks": 1, "leaf": 0, "id": name, "v": raw, "ids": list(per.values())})

    def nearest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, parts, b, norms, leaf, ids = None, [], None, None, None, []
        for f in frames:
            out = []
            for (tree, cell, block, asks), g in f.groupby(["tree", "cell", "block", "asks"], sort=True):
                if (tree, cell, block) != at:
                    at, parts, b = (tree, cell, block), [], None
                if not asks:
                    parts.append(g)
                    continue
                if b is None:
                    if not parts:
                        continue
                    base = pd.concat(parts)
                    b, leaf, ids = _matrix(base["v"]), base["leaf"].to_numpy(np.int64) - cell * per_cell, base["ids"].tolist()
                    norms = (b**2).sum(axis=1)
                for name, raw, visited in zip(g["id"].tolist(), g["v"], g["ids"], strict=True):
                    wanted = np.zeros(per_cell, bool)
                    wanted[np.asarray(visited, np.int64) - cell * per_cell] = True
                    mine = np.flatnonzero(wanted[leaf])
                    if not len(mine):
                        continue
                    q = np.frombuffer(raw, "<f8")
                    some, far = best(b[mine], norms[mine], q, k)
                    found = sorted((d, int(n)) for j, d in zip(mine[some].tolist(), far.tolist(), strict=True) for n in ids[j] if n != name)
                    out += [(name, n, d) for d, n in found[:k]]
            yield pd.DataFrame(out, columns=["query", "id", "score"])

    schema = "tree int, cell int, block int, asks int, leaf int, id long, v binary, ids array<long>"
    base = points.select("v", "ids", F.pmod(F.xxhash64("v", F.lit(1)), F.lit(blocks)).cast("int").alias("block")).mapInPandas(to_leaves, schema)
    queries = packed.where(F.col("id") % every == 0).select("id", "v").distinct().repartition(shards)
    asked = queries.mapInPandas(to_visits, "tree int, cell int, asks int, leaf int, id long, v binary, ids array<long>")
    asked = asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    dealt = base.unionByName(asked).repartition(shards, "tree", "cell", "block").sortWithinPartitions("tree", "cell", "block", "asks")
    hits = dealt.mapInPandas(nearest, "query long, id long, score double")
    near = hits.groupBy("query", "id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query").orderBy("score", "id"))
    ranked = near.withColumn("rank", rank).where(F.col("rank") <= k)
    return ranked.select(F.col("query").alias("query_id"), F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), "score")
