"""Hard negatives of anchors: rows of other labels that score nearly as high as a positive, found in k-means inverted lists.

Vectors are whole numbers (floor of SCALE times a component) and scores their inner products, so nothing depends on rounding. K-means
runs on a bounded sample of the vectors (PER_CENTRE for each centre; their sums are whole numbers too, so the same centres come out however rows are
dealt); then every vector enters the inverted list of its nearest centre, and each list stores its radius, the largest
distance of a member from the centre. By Cauchy-Schwarz no member of a list scores above a.c + |a| r against an anchor a, nor below a.c - |a| r.

An anchor visits lists by falling bound. A list whose range lies outside the window of scores is skipped, and the visit stops
where the bound falls strictly below the kth score found so far (strictly, as an equal score with a smaller id would come
first). Lists lie on different machines, so visits go in waves: the first FIRST lists of the order, then WIDER times as many with the kth
scores known by then, until no anchor has lists left. Bounds are widened by rounding's share, so the result is exact.

Equal vectors of a label are one point that lists its smallest ids, as many as anyone can need. Anchors with the same vector and label are one too. A list lies in
blocks of about BLOCK points by a hash, and a task holds one block while requests stream past it. Centres and radii are
broadcast: at most CENTRES of them.

Positives are the best of the anchor's own label, negatives those of other labels whose score is at least LOW and at most HIGH
hundredths of the positive's.

Defined results: rows with a null id, label or vector, or with null or non-finite components take no part, nor those of another
length than most, nor those with a component of LARGEST or more (after scaling), whose scores are no 64-bit numbers. Rows equal in id, label and vector count once. Rows that share the
anchor's id are neither its positives nor its negatives. Ties go to the smaller id. A positive score of 0 or less has
no window, but for 0 itself. An anchor without positives, and a positive without negatives, give no row. An empty table gives an empty
result. Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialise, partitions, ship

SCALE, LOW, HIGH = 256, 50, 95
#: Centres at most, points of the sample for each, and rounds of k-means.
CENTRES, PER_CENTRE, ROUNDS = 4096, 32, 4
#: Points of a block, about; lists of the first wave, and how much wider each next one is.
BLOCK, FIRST, WIDER = 4096, 8, 8
#: The first scaled component that is too large.
LARGEST = 1 << 22
TOP, BOTTOM = (1 << 63) - 1, -(1 << 63)


def _valid(v: Column) -> Column:
    return v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def _matrix(v: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(v), "<i4").reshape(len(v), -1) if len(v) else np.zeros((0, 1), np.int32)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The exact inner products of whole vectors: by floating point where every sum is below 2^53, else by 64-bit integers."""
    most = lambda x: int(np.abs(x.astype(np.int64)).max(initial=0))
    if most(a) * most(b) * a.shape[1] < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the nearest centre, distance from it) of each vector, some at a time."""
    at, far, half = np.zeros(len(x), np.int64), np.zeros(len(x)), (centres**2).sum(axis=1) / 2
    for i in range(0, len(x), 4096):
        part = x[i : i + 4096].astype(np.float64)
        at[i : i + 4096] = (part @ centres.T - half).argmax(axis=1)
        far[i : i + 4096] = np.sqrt(((part - centres[at[i : i + 4096]]) ** 2).sum(axis=1))
    return at, far


def fit(points: DataFrame, n: int, dims: int) -> np.ndarray:
    """The centres of k-means on the points (v): about the square root of their number."""
    k = min(CENTRES, max(1, int(n**0.5)))
    hashed = F.pmod(F.xxhash64("v", F.lit(5)), F.lit(1 << 30))
    size = k * PER_CENTRE
    sample = materialise(points.select("v", hashed.alias("h")).where(hashed < int(min(1.0, size / n) * (1 << 30))), "sample")
    first = sample.orderBy("h", "v").limit(k).toPandas()  # the smallest hashes: at most CENTRES vectors
    if not len(first):  # a sample by hashes can be empty, in theory
        first = points.select("v").limit(1).toPandas()
    centres = _matrix(first["v"]).astype(np.float64)

    def sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, count = np.zeros((len(centres), dims), np.int64), np.zeros(len(centres), np.int64)
        for f in frames:
            x = _matrix(f["v"])
            if len(x):
                at, _ = nearest(x, centres)
                np.add.at(total, at, x)
                count += np.bincount(at, minlength=len(count))
        met = np.flatnonzero(count)
        yield pd.DataFrame({"centre": met, "n": count[met], "total": [total[i].tolist() for i in met]})

    for _ in range(ROUNDS):
        parts = sample.select("v").mapInPandas(sums, "centre long, n long, total array<long>")
        added = parts.groupBy("centre").agg(F.sum("n").alias("n"), *[F.sum(F.get("total", F.lit(i))).alias(f"t{i}") for i in range(dims)]).toPandas()
        moved = centres.copy()
        moved[added["centre"]] = added[[f"t{i}" for i in range(dims)]].to_numpy(np.float64) / added["n"].to_numpy()[:, None]
        if (moved == centres).all():
            break
        centres = moved
    return centres


class Lists:
    """Where the inverted lists lie: centres, radii, sizes. Bounded by CENTRES."""

    def __init__(self, centres: np.ndarray, radii: np.ndarray, sizes: np.ndarray):
        self.centres, self.radii, self.sizes = centres, radii, sizes
        self.blocks = np.maximum(1, -(-sizes // BLOCK))

    def bounds(self, a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(lowest, highest) score that a member of each list can have against a."""
        a = a.astype(np.float64)
        near, reach = self.centres @ a, float(np.linalg.norm(a)) * self.radii
        slack = 1e-9 * (1 + np.abs(near) + reach)
        return near - reach - slack, near + reach + slack

    def order(self, a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(lists by falling bound, their lowest and highest scores); empty lists are left out."""
        low, high = self.bounds(a)
        at = np.lexsort((np.arange(len(high)), -high))
        at = at[self.sizes[at] > 0]
        return at, low[at], high[at]


def requests(frames: Iterator[pd.DataFrame], lists: Lists, begin: int, end: int) -> Iterator[pd.DataFrame]:
    """The lists that each unit visits in this wave, places ``begin`` to ``end`` of its order, with the windows that are open there."""
    for f in frames:
        out = []
        for row in f.itertuples():
            at, low, high = lists.order(np.frombuffer(row.v, "<i4"))
            lo, hi, kth = (np.array(x, np.int64).astype(np.float64) for x in (row.lo, row.hi, row.kth))
            for c, least, most in zip(at[begin:end].tolist(), low[begin:end], high[begin:end], strict=True):
                open_ = (most >= kth) & (most >= lo) & (least <= hi)  # the kth score stops a window only if the bound is strictly below it
                if open_.any():
                    which = np.flatnonzero(open_)
                    out += [(c, b, 1, row.unit, row.label, row.v, [row.lo[i] for i in which], [row.hi[i] for i in which], which.tolist()) for b in range(int(lists.blocks[c]))]
        yield pd.DataFrame(out, columns=["list", "block", "asks", "unit", "label", "v", "lo", "hi", "windows"])


def answers(frames: Iterator[pd.DataFrame], k: int, own: bool) -> Iterator[pd.DataFrame]:
    """From a block's points and then its requests: the best k (unit, window, score, id) of the block in each window."""
    at, parts, base, labels, ids = None, [], None, None, []
    for f in frames:
        out = []
        for (list_, block, asks), g in f.groupby(["list", "block", "asks"], sort=True):
            if (list_, block) != at:
                at, parts, base = (list_, block), [], None
            if not asks:
                parts.append(g)
                continue
            if base is None:
                if not parts:
                    continue
                held = pd.concat(parts)
                base, labels, ids = _matrix(held["v"]), held["label"].to_numpy(np.int64), held["ids"].tolist()
            for i in range(0, len(g), 256):
                some = g.iloc[i : i + 256]
                score = products(_matrix(some["v"]), base)
                for row, s in zip(some.itertuples(), score, strict=True):
                    fits = (labels == row.label) if own else (labels != row.label)
                    for lo, hi, w in zip(row.lo, row.hi, row.windows, strict=True):
                        mine = np.flatnonzero(fits & (s >= lo) & (s <= hi))
                        if len(mine) > k:  # ties with the kth stay
                            mine = mine[s[mine] >= -np.partition(-s[mine], k - 1)[k - 1]]
                        found = sorted((-int(s[j]), int(n)) for j in mine.tolist() for n in ids[j])
                        out += [(row.unit, w, -t, n) for t, n in found[:k]]
        yield pd.DataFrame(out, columns=["unit", "window", "score", "id"], dtype="int64")


def _best(hits: DataFrame, k: int) -> DataFrame:
    order = F.row_number().over(Window.partitionBy("unit", "window").orderBy(F.desc("score"), "id"))
    return hits.distinct().withColumn("_r", order).where(F.col("_r") <= k).drop("_r")


def search(points: DataFrame, lists: Lists, units: DataFrame, k: int, own: bool) -> DataFrame:
    """(unit, window, score, id): the best k of each window of the units (unit, label, v, lo array, hi array), of its own label or of others."""
    spark = points.sparkSession
    shards, shared = partitions(spark), spark.sparkContext.broadcast(lists)
    base = points.select("list", "block", F.lit(0).alias("asks"), F.lit(None).cast("long").alias("unit"), "label", "v", *[F.lit(None).cast("array<long>").alias(c) for c in ("lo", "hi", "windows")], "ids")
    hits = spark.createDataFrame([], "unit long, window long, score long, id long")
    begin, width, total = 0, FIRST, int((lists.sizes > 0).sum())
    while begin < total:
        full = hits.groupBy("unit", "window").agg(F.count(F.lit(1)).alias("_n"), F.min("score").alias("_kth")).where(F.col("_n") >= k)
        kth = full.groupBy("unit").agg(F.map_from_entries(F.collect_list(F.struct("window", "_kth"))).alias("_found"))  # a few windows for each unit
        known = F.transform("lo", lambda _, i: F.coalesce(F.try_element_at(F.col("_found"), i.cast("long")), F.lit(BOTTOM).cast("long")))
        waiting = units.join(kth, "unit", "left").withColumn("kth", known).select("unit", "label", "v", "lo", "hi", "kth")
        span = (begin, begin + width)
        asked = waiting.mapInPandas(lambda fs, span=span: requests(fs, shared.value, *span), "list long, block int, asks int, unit long, label long, v binary, lo array<long>, hi array<long>, windows array<long>")
        asked = materialise(asked, "requests")
        begin, width = begin + width, width * WIDER
        if asked.isEmpty():
            continue
        visited = asked.select("list", "block").distinct()
        met = base.join(visited, ["list", "block"], "left_semi").unionByName(asked, allowMissingColumns=True)
        dealt = met.repartition(shards, "list", "block").sortWithinPartitions("list", "block", "asks")
        found = dealt.mapInPandas(lambda fs: answers(fs, k, own), "unit long, window long, score long, id long")
        hits = materialise(_best(hits.unionByName(found), k), "hits")
    return hits


def mine(
    vectors: DataFrame, every: int = 50, positives: int = 5, negatives: int = 3, low: int = LOW, high: int = HIGH, scale: int = SCALE,
    id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for anchors whose id is divisible by ``every``."""
    spark = vectors.sparkSession
    ship(spark)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("x"))
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & _valid(F.col("x"))).withColumn("x", F.transform("x", lambda c: F.floor(c * scale)))
    rows = rows.where(~F.exists("x", lambda c: F.abs(c) >= LARGEST))

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"id": f["id"], "label": f["label"], "v": [np.asarray(x, "<i4").tobytes() for x in f["x"]], "d": f["x"].map(len)})

    packed = materialise(rows.mapInPandas(pack, "id long, label long, v binary, d int"), "vectors")
    common = packed.groupBy("d").count().orderBy(F.desc("count"), "d").limit(1).collect()
    if not common:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    dims = common[0]["d"]
    packed = packed.where(F.col("d") == dims).select("id", "label", "v")

    # equal vectors of a label are a point with as many of its smallest ids as can be needed, first in each of the salts, then over all
    keep = max(positives, negatives) + 1
    salted = packed.withColumn("s", F.pmod(F.xxhash64("id"), F.lit(partitions(spark)))).distinct()
    first = salted.withColumn("r", F.row_number().over(Window.partitionBy("label", "v", "s").orderBy("id"))).where(F.col("r") <= keep)
    points = materialise(first.groupBy("label", "v").agg(F.slice(F.array_sort(F.collect_list("id")), 1, keep).alias("ids")), "points")
    n = points.count()
    centres = spark.sparkContext.broadcast(fit(points, n, dims))

    def enter(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            x = _matrix(f["v"])
            at, far = nearest(x, centres.value) if len(x) else (np.zeros(0, np.int64), np.zeros(0))
            yield f.assign(list=at, radius=far)

    entered = materialise(points.mapInPandas(enter, "label long, v binary, ids array<long>, list long, radius double"), "lists")
    stored = entered.groupBy("list").agg(F.max("radius").alias("radius"), F.count(F.lit(1)).alias("n")).toPandas()  # one row for each centre
    radii, sizes = np.zeros(len(centres.value)), np.zeros(len(centres.value), np.int64)
    radii[stored["list"]], sizes[stored["list"]] = stored["radius"] * (1 + 1e-9) + 1e-9, stored["n"]
    lists = Lists(centres.value, radii, sizes)
    blocks = spark.sparkContext.broadcast(lists.blocks)

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f.assign(block=[zlib.crc32(v) % n for v, n in zip(f["v"], blocks.value[f["list"]].tolist(), strict=True)])

    placed = entered.select("label", "v", "ids", "list").mapInPandas(place, "label long, v binary, ids array<long>, list long, block int")
    points = materialise(placed, "points")

    # anchors of the same vector and label are one unit
    anchors = packed.where(F.col("id") % every == 0).distinct()
    units = materialise(anchors.select("label", "v").distinct().withColumn("unit", F.monotonically_increasing_id()), "units")
    anchors = anchors.join(units, ["label", "v"]).select("id", "unit")
    whole = units.withColumn("lo", F.array(F.lit(BOTTOM).cast("long"))).withColumn("hi", F.array(F.lit(TOP).cast("long")))
    near = search(points, lists, whole, positives + 1, True)
    windows = materialise(near.groupBy("unit").agg(F.array_sort(F.collect_set("score")).alias("scores")), "windows")  # positives + 1 scores at most
    floor = lambda a: F.call_function("div", a - F.pmod(a, F.lit(100)), F.lit(100))
    narrow = units.join(windows, "unit").withColumn("lo", F.transform("scores", lambda s: -floor(-s * low))).withColumn("hi", F.transform("scores", lambda s: floor(s * high)))
    far = search(points, lists, narrow, negatives + 1, False)
    scored = far.join(windows, "unit").select("unit", F.element_at("scores", F.col("window").cast("int") + 1).alias("positive_score"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))

    turn = F.row_number().over(Window.partitionBy("anchor_id", "unit").orderBy(F.desc("positive_score"), "positive_id"))
    pairs = anchors.withColumnRenamed("id", "anchor_id").join(near.select("unit", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "unit")
    pairs = pairs.where("positive_id <> anchor_id").withColumn("_r", turn).where(F.col("_r") <= positives)
    hard = pairs.join(scored, ["unit", "positive_score"]).where("negative_id <> anchor_id")
    rank = F.row_number().over(Window.partitionBy("anchor_id", "unit", "positive_id").orderBy(F.desc("negative_score"), "negative_id"))
    return hard.withColumn("rank", rank).where(F.col("rank") <= negatives).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")

