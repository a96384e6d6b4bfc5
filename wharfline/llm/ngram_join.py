"""Near duplicates by the Jaccard similarity of word shingles, with count-vector R-trees.

Shingles of a document are hashed into groups, and the counts of the groups are its point. Two points bound the
overlap of their documents by the sum of the coordinate minima. An R-tree over points (nodes keep the largest
coordinates and the range of sizes below them) leaves out whole subtrees whose bound is too small; pairs that
survive are verified on the whole shingle sets.

A single tree over the corpus would compare points of equal size all with all: at the usual thresholds counts
of unrelated documents of a size lie close together. The leaves of the index are therefore pages of documents
that can be linked at all. A pair with Jaccard similarity of at least t differs in at most d = n (1 - t) / t
shingles (n the smaller size), so if the hash space is cut into g > d groups, at least g - d hold the
same shingles in both. A page is keyed by the content of a group. All documents order their groups alike, by the popularity of
the content and then its hash, and each enters the pages of its first d + 1: of the groups that two linked documents share, the first in the order is among
the first d + 1 of either, since at most d others come before it. No link is lost, and content that many documents have, as
headers and footers, is passed over wherever a document has enough of its own. Groups are counted per level of size, and there are spare ones: as many as are expected to be
empty at the level's smallest size, five standard deviations and a quarter. Empty groups come last in the order.
Popularity is in three levels (POPULAR) and known from a bitmap of hashed keys; where two keys share a bit both count as popular, for all documents
alike.

Within a page the smallest document is a star's centre and is verified against all others; the components of the
links found so far decide what is left: documents of a page that are not in the centre's component search the
R-trees of the page's blocks, and whatever the bound does not exclude is verified too. Pages, blocks and stars
are streamed in sorted order or dealt out by a salt, so no task holds a page.

Exact copies are told by a 128-bit digest of their words' bytes. Pages are made with one 64-bit hash of words and shingles
and links are verified with a second, independent one, on the whole sets: a wrong link would need both to fail together.

Defined results: null texts and texts without words have no shingles and no links; a text with fewer words than a
shingle is one shingle as a whole; rows with a null id take no part and have a null component; rows that
repeat an id are one node; an empty table gives an empty result. Only id and text are read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import ASCII_SPACE, TO_LOWER, WINDOW
from .common import materialise, partitions, ship
from .graph import components

#: Coordinates of a point, a byte each; the more, the closer the bound.
GROUPS = 512
#: Documents of a block, and a salt's share of a star.
PAGE, SALTS = 1024, 32


#: Seeds of the two independent hashes of words and shingles.
PAGING, VERIFYING = 1, 2
#: Words of more bytes are hashed by BLAKE2; masks that keep the first bytes of eight.
LONG_WORD, KEPT = 64, np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)
LOWER_BYTES = TO_LOWER.tobytes()
#: A page key that more than so many documents have is popular; the more, the higher its level. Bits of the bitmap of a level, 8 MB.
POPULAR, BITS = (32, 1024, 32768), 1 << 26
#: Wants of a document that travel with one copy of its text, about.
WANTS = 512


# ---- shingle sets

def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: each input bit changes every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words(texts: list[str | None], seed: int = PAGING) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words, offsets of each text): A-Z lower-cased, split at ASCII white space.

    A word is hashed eight bytes at a time, each step through :func:`mix`, so no family of words has equal hashes whatever they are
    made of, as words of two letters have under a polynomial; words above LONG_WORD bytes by BLAKE2.
    """
    raw = [t.encode("utf-8", "replace") if t else b"" for t in texts]
    joined = TO_LOWER[np.frombuffer(b"\n".join([*raw, b"", b""]) + b"\n" * 8, np.uint8)]
    ends = np.cumsum([len(x) + 1 for x in raw])
    space = ASCII_SPACE[joined]
    start = np.flatnonzero(~space & np.append(True, space[:-1]))
    end = np.flatnonzero(~space[:-1] & space[1:]) + 1
    size = end - start
    eights = np.ndarray((len(joined) - 7,), "<u8", joined.tobytes(), strides=(1,))
    odd = mix(np.array([seed], np.uint64))[0] | np.uint64(1)
    hashed = mix((size.astype(np.uint64) + np.uint64(1)) * odd)
    at, offset = np.flatnonzero(size <= LONG_WORD), 0
    while len(at):
        eight = eights[start[at] + offset] & KEPT[np.minimum(size[at] - offset, 8)]
        hashed[at] = mix((hashed[at] ^ eight) * odd)
        offset += 8
        at = at[size[at] > offset]
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        hashed[i] = int.from_bytes(hashlib.blake2b(joined[start[i] : end[i]].tobytes(), digest_size=8, salt=bytes([seed])).digest(), "little")
    return hashed, np.concatenate([[0], np.searchsorted(start, ends)])


def shingle_sets(texts: list[str | None], k: int, seed: int = PAGING) -> list[np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of each text."""
    word, at = words(texts, seed)
    odd = [mix(np.array([(seed << 8) + 2 * i + 1], np.uint64))[0] | np.uint64(1) for i in range(k)]
    n = max(0, len(word) - k + 1)
    rolled = np.zeros(n, np.uint64)
    for i in range(k):
        rolled += word[i : i + n] * odd[i]
    rolled = mix(rolled)
    out = []
    for i, j in zip(at.tolist(), at[1:].tolist(), strict=False):
        if j - i >= k:
            s = np.sort(rolled[i : j - k + 1])
            out.append(s[np.append(True, s[1:] != s[:-1])])
        elif j > i:
            few = np.array([j - i], np.uint64)
            for at_, o in zip(range(i, j), odd, strict=False):
                few = mix(few + word[at_ : at_ + 1] * o)
            out.append(few)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def word_digest(text: str | None) -> bytes:
    """A digest of the bytes of a text's words; texts that share it have the same shingles for any number of words."""
    return hashlib.blake2b(b" ".join((text or "").encode("utf-8", "replace").translate(LOWER_BYTES).split()), digest_size=16).digest()


def windows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Slices of Arrow batches of about WINDOW characters."""
    for f in frames:
        size = f["text"].str.len().fillna(0).to_numpy().cumsum()
        part = (size // WINDOW).astype(np.int64) if len(size) else size
        for p in np.unique(part):
            yield f[part == p]


# ---- points and the R-tree

def point(s: np.ndarray) -> np.ndarray:
    """Counts of the groups; 255 stands for as many or more."""
    return np.minimum(np.bincount((s >> np.uint64(55)).astype(np.int64), minlength=GROUPS), 255).astype(np.uint8)


def points(raw: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(raw), np.uint8).reshape(len(raw), GROUPS)


def overlap_bound(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sum of the coordinate minima; no bound where a coordinate is full in both."""
    least = np.minimum(a, b)
    total = least.sum(axis=1, dtype=np.int64)
    full = (least == 255).any(axis=1)
    return np.where(full, np.int64(1) << 40, total) if full.any() else total


def needed(a: np.ndarray, b: np.ndarray, num: int, den: int) -> np.ndarray:
    """The least overlap of linked sets of these sizes: den * o >= num * (a + b - o)."""
    return -(-(num * (a + b)) // (num + den))


class CountRTree:
    """Points packed by size and by their largest coordinates; nodes bound the overlap from above."""

    FAN = 16

    def __init__(self, p: np.ndarray, sizes: np.ndarray, num: int, den: int):
        order = np.lexsort((p.argmax(axis=1), sizes))
        self.order, self.num, self.den = order, num, den
        self.levels = [(p[order], sizes[order], sizes[order])]
        while len(self.levels[-1][0]) > 1:
            top, low, high = self.levels[-1]
            cut = np.arange(0, len(top), self.FAN)
            self.levels.append((np.maximum.reduceat(top, cut), np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut)))

    def search(self, q: np.ndarray, size: int) -> np.ndarray:
        """Numbers of the points whose bound allows a link to q."""
        at = np.arange(len(self.levels[-1][0]))
        for depth in range(len(self.levels) - 1, -1, -1):
            top, low, high = (x[at] for x in self.levels[depth])
            fits = (self.den * high >= self.num * size) & (self.num * low <= self.den * size)
            fits &= overlap_bound(top, q) >= needed(np.int64(size), np.maximum(low, 0), self.num, self.den)
            at = at[fits]
            if depth and len(at):
                at = (at[:, None] * self.FAN + np.arange(self.FAN)).ravel()
                at = at[at < len(self.levels[depth - 1][0])]
        return self.order[at]


# ---- pages

def levels(upto: int, num: int, den: int) -> list[tuple[int, int, int, int]]:
    """(first size, first size beyond, groups, spares) of the levels up to a size."""
    out, low = [], 1
    while low <= upto:
        high = max(low + 1, low * 5 // 4)
        differ = (high - 1) * (den - num) // num
        groups = differ + 1
        while groups < 16 * high:  # until the full groups of the smallest size are enough and a quarter more, five deviations below their mean
            void = math.exp(-low / groups)
            deviation = math.sqrt(max(0.0, groups * (void - (1 + low / groups) * void * void)))
            if groups * (1 - void) - 5 * deviation >= 1.25 * differ + 1:
                break
            groups += max(1, groups // 100)
        out.append((low, high, groups, groups - differ - 1))
        low = high
    return out


def group_keys(sets: list[np.ndarray], num: int, den: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, need, keys of all entries, their offsets): an entry for each level that a document takes part in.

    ``need`` keys, the first in an order that is the same for all documents, have to be entered, and any two linked documents then share one: they
    differ in fewer than ``need`` groups, so one of those that they share is among the first of either. Empty groups
    come last in the order and are listed only where the full ones are not enough.
    """
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    table = levels(int(size.max()) if len(size) else 0, num, den)
    lows = np.array([x[0] for x in table], np.int64)
    own = np.searchsorted(lows, size, side="right") - 1
    highs = np.array([x[1] for x in table], np.int64)
    which, level = np.flatnonzero(size), own[size > 0]
    more, lower = which, level - 1
    while len(more):  # levels below, of which this may be the larger partner
        fits = lower >= 0
        fits[fits] = size[more[fits]] * num <= (highs[lower[fits]] - 1) * den
        more, lower = more[fits], lower[fits]
        which, level = np.concatenate([which, more]), np.concatenate([level, lower])
        lower = lower - 1
    if not len(which):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, np.uint64), np.zeros(1, np.int64)
    groups = np.array([x[2] for x in table], np.uint64)[level]
    need = groups.astype(np.int64) - np.array([x[3] for x in table])[level]
    flat = np.concatenate([sets[i] for i in which.tolist()])
    row = np.repeat(np.arange(len(which)), size[which])
    group = ((flat >> np.uint64(32)) * groups[row]) >> np.uint64(32)
    cut = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (group[1:] != group[:-1])))
    content = np.add.reduceat(mix(flat ^ np.uint64(0x5851F42D4C957F2D)), cut)
    salt = lambda r, g: mix(level[r].astype(np.uint64) * np.uint64(0x100000001) + (g << np.uint64(20)) + np.uint64(7))
    keys, rows = [mix(content + salt(row[cut], group[cut]))], [row[cut]]
    full = np.bincount(row[cut], minlength=len(which))
    for r in np.flatnonzero(full < need).tolist():
        empty = np.setdiff1d(np.arange(int(groups[r]), dtype=np.uint64), group[row == r])[: int(need[r] - full[r])]
        keys.append(mix(salt(np.full(len(empty), r), empty)))
        rows.append(np.full(len(empty), r))
    key, at = np.concatenate(keys), np.concatenate(rows)
    order = np.argsort(at, kind="stable")  # the empty groups of an entry stay last
    return which, need, key[order], np.concatenate([[0], np.cumsum(np.bincount(at, minlength=len(which)))])


def chosen(need: np.ndarray, keys: np.ndarray, at: np.ndarray, popularity: np.ndarray) -> np.ndarray:
    """Places of the keys to enter: of each entry the ``need`` keys that are least popular, and smallest among those."""
    row = np.repeat(np.arange(len(need)), np.diff(at))
    order = np.lexsort((keys, popularity, row))
    return order[np.arange(len(order)) - at[row[order]] < need[row[order]]]


def page_keys(sets: list[np.ndarray], ids: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys, ids) of the pages that each document enters where no key is popular."""
    which, need, keys, at = group_keys(sets, num, den)
    kept = chosen(need, keys, at, np.zeros(len(keys), np.int8))
    return keys[kept].view(np.int64), ids[np.repeat(which, np.diff(at))[kept]]


def places(keys: np.ndarray) -> np.ndarray:
    """The 32 bits of each key by which its popularity is counted."""
    return (keys >> np.uint64(32)).astype(np.uint32).view(np.int32)


def counted(keys: np.ndarray) -> pd.DataFrame:
    """(place, n) of some keys."""
    place, n = np.unique(places(keys), return_counts=True)
    return pd.DataFrame({"place": place, "n": n.astype(np.int32)})


def popular(counts: DataFrame) -> list[np.ndarray]:
    """A bitmap of places for each level of popularity, from the counts (place, n) of all keys: 8 MB each, whatever the number of documents."""
    many = counts.groupBy("place").agg(F.sum("n").alias("n")).where(F.col("n") > POPULAR[0])
    bit = F.pmod("place", F.lit(BITS)).cast("long") + 1
    held = many.select(F.bitmap_bucket_number(bit).alias("bucket"), F.bitmap_bit_position(bit).alias("bit"), F.explode(F.array(*[F.when(F.col("n") > n, i) for i, n in enumerate(POPULAR)])).alias("level")).where("level is not null")
    out = [np.zeros(BITS // 8, np.uint8) for _ in POPULAR]
    for r in held.groupBy("level", "bucket").agg(F.bitmap_construct_agg("bit").alias("bits")).toLocalIterator():
        part = np.frombuffer(bytes(r["bits"]), np.uint8)
        first = (r["bucket"] - 1) * len(part)
        out[r["level"]][first : first + len(part)] = part
    return out


def popularity(keys: np.ndarray, bitmaps: list[np.ndarray]) -> np.ndarray:
    """How popular each key may be. A key that shares its place or bit with others counts as popular as they are together, for every document alike, so no link is lost by it."""
    bit = places(keys).view(np.uint32) & np.uint32(BITS - 1)
    byte, shift = (bit >> np.uint32(3)).astype(np.int64), (bit & np.uint32(7)).astype(np.uint8)
    return sum(((b[byte] >> shift) & 1 for b in bitmaps), np.zeros(len(keys), np.uint8)).astype(np.int8)


def stars(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """From rows (key, id) sorted by both: (key, centre, other) of each further document of a page.

    Pages of two need nothing after their star; their key is null, and such a star is given once in a batch.
    """
    open_key, open_centre = None, None
    for f in frames:
        if not len(f):
            continue
        key, name = f["key"].to_numpy(np.int64), f["id"].to_numpy(np.int64)
        new = np.append(True, key[1:] != key[:-1])
        head, number = np.flatnonzero(new), np.cumsum(new) - 1
        first, size = name[head], np.diff(np.append(head, len(key)))
        two = size == 2
        two[[0, -1]] = False  # these may go on in another batch
        if key[0] == open_key:
            first[0] = open_centre
        open_key, open_centre = key[-1], first[-1]
        centre, two = first[number], two[number]
        ok = name != centre
        pages = pd.DataFrame({"key": pd.array(key[ok], "Int64"), "a": centre[ok], "b": name[ok]})
        pages.loc[two[ok], "key"] = pd.NA
        yield pages.drop_duplicates()


# ---- verification

def verify(pairs: DataFrame, docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose whole shingle sets are linked. ``a`` is sent to each salt that one of its ``b`` has."""
    salted = pairs.select("a", "b", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int").alias("salt"))
    wants = salted.select(F.col("b").alias("id"), "a", "salt", F.lit(1).alias("second"))
    wants = wants.union(salted.select("a", "salt").distinct().select(F.col("a").alias("id"), "a", "salt", F.lit(0).alias("second")))
    wants = materialise(wants, "wants")
    # a document's wants travel with copies of its text, about WANTS with each, however many there are
    parts = wants.groupBy("id").agg(F.ceil(F.count(F.lit(1)) / WANTS).alias("_parts"))
    dealt = wants.join(parts, "id").withColumn("_part", F.pmod(F.xxhash64("a", "salt"), "_parts"))
    wants = materialise(dealt.groupBy("id", "_part").agg(F.collect_list(F.struct("a", "salt", "second")).alias("wants")).drop("_part"), "wants")

    def send(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in windows(frames):
            a, salt, second, name, sets, held = [], [], [], [], [], 0
            for doc, want, s in zip(f["id"].tolist(), f["wants"], shingle_sets(f["text"].tolist(), k, VERIFYING), strict=True):
                raw = s.tobytes()
                for w in want:
                    a.append(w["a"])
                    salt.append(w["salt"])
                    second.append(w["second"])
                    name.append(doc)
                    sets.append(raw)
                held += len(raw) * len(want)
                if held > 16_000_000:
                    yield pd.DataFrame({"a": a, "salt": salt, "second": second, "id": name, "shingles": sets})
                    a, salt, second, name, sets, held = [], [], [], [], [], 0
            yield pd.DataFrame({"a": a, "salt": salt, "second": second, "id": name, "shingles": sets})

    def meet(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, centres = None, []
        for f in frames:
            found = []
            for a, salt, second, doc, raw in zip(f["a"].tolist(), f["salt"].tolist(), f["second"].tolist(), f["id"].tolist(), f["shingles"], strict=True):
                s = np.frombuffer(raw, np.uint64)
                if (a, salt) != at:
                    at, centres = (a, salt), []
                if not second:
                    centres.append(s)
                    continue
                for c in centres:
                    small, large = (s, c) if len(s) < len(c) else (c, s)
                    if num * len(large) <= den * len(small):
                        where = np.searchsorted(large, small)
                        both = int((large[np.minimum(where, len(large) - 1)] == small).sum())
                        if den * both >= num * (len(s) + len(c) - both):
                            found.append((a, doc))
                            break
            yield pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    sent = docs.join(wants, "id").mapInPandas(send, "a long, salt int, second int, id long, shingles binary")
    dealt = sent.repartition(partitions(docs.sparkSession), "a", "salt").sortWithinPartitions("a", "salt", "second")
    return dealt.mapInPandas(meet, "a long, b long").distinct()


def near_components(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: id, n_shingles, component_id (the smallest id that links reach).

    Documents are linked when den * |A and B| >= num * |A or B| of their sets of k-word shingles.
    """
    spark = docs.sparkSession
    ship(spark)
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))

    def describe(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in windows(frames):
            texts = f["text"].tolist()
            sets = shingle_sets(texts, k)
            yield pd.DataFrame({
                "id": f["id"].astype("Int64"), "n": [len(s) for s in sets],
                "digest": [word_digest(t) for t in texts], "point": [point(s).tobytes() for s in sets],
            })

    def keyed(frames: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        for f in windows(frames):
            yield f["id"].to_numpy(np.int64), *group_keys(shingle_sets(f["text"].tolist(), k), num, den)

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, _, _, keys, _ in keyed(frames):
            yield counted(keys)

    described = materialise(source.mapInPandas(describe, "id long, n long, digest binary, point binary"), "points")
    live = described.where("id is not null and n > 0")
    same = materialise(live.groupBy(F.col("digest").alias("_digest")).agg(F.min("id").alias("rep")), "classes")
    nodes = live.join(same, F.col("digest") == F.col("_digest")).select("id", "rep")
    nodes = materialise(nodes.groupBy("id").agg(F.min("rep").alias("rep")), "nodes")
    shape = live.groupBy("id").agg(F.max("n").alias("n"), F.max_by("point", "n").alias("point"))

    known = source.where("id is not null")
    bitmaps = spark.sparkContext.broadcast(popular(known.mapInPandas(count, "place int, n int")))

    def enter(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for name, which, need, keys, at in keyed(frames):
            kept = chosen(need, keys, at, popularity(keys, bitmaps.value))
            key, name = keys[kept].view(np.int64), np.repeat(name[which], np.diff(at))[kept]
            for i in range(0, len(key), 200_000):
                yield pd.DataFrame({"key": key[i : i + 200_000], "id": name[i : i + 200_000]})

    paged = known.mapInPandas(enter, "key long, id long").repartition(partitions(spark), "key").sortWithinPartitions("key", "id")
    starred = materialise(paged.mapInPandas(stars, "key long, a long, b long"), "stars")

    # exact copies stand for one another from here on
    ra, rb = nodes.select(F.col("id").alias("a"), F.col("rep").alias("ra")), nodes.select(F.col("id").alias("b"), F.col("rep").alias("rb"))
    lifted = starred.distinct().join(ra, "a").join(rb, "b").select("key", F.col("ra").alias("a"), F.col("rb").alias("b")).distinct()
    lifted = materialise(lifted, "lifted")
    sides = lifted.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()
    bounded = _bound(sides, shape, num, den)
    links = materialise(verify(materialise(bounded, "pairs"), known, k, num, den), "links")

    found = components(links)
    rest = _search(lifted, found, shape, num, den)
    rest = materialise(rest.join(bounded, ["a", "b"], "left_anti"), "rest")
    if not rest.isEmpty():
        more = materialise(verify(rest, known, k, num, den), "links")
        if not more.isEmpty():
            found = components(links.union(more))
    label = nodes.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("id", F.coalesce("component", "rep").alias("component_id"))
    out = described.select("id", "n").join(label, "id", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))


def _bound(pairs: DataFrame, shape: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs that the sum of the coordinate minima does not exclude."""
    left, right = (shape.select(F.col("id").alias(c), F.col("n").alias(f"n{c}"), F.col("point").alias(f"p{c}")) for c in "ab")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                na, nb = f["na"].to_numpy(np.int64), f["nb"].to_numpy(np.int64)
                most = overlap_bound(points(f["pa"].tolist()), points(f["pb"].tolist()))
                yield f.loc[most >= needed(na, nb, num, den), ["a", "b"]]

    return pairs.join(left, "a").join(right, "b").where(F.least("na", "nb") * den >= F.greatest("na", "nb") * num).mapInPandas(run, "a long, b long")


def _search(lifted: DataFrame, found: DataFrame, shape: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs of a page in different components, of which none is the centre, that the R-trees of its blocks return."""
    part = found.select(F.col("node").alias("id"), "component")
    pages = lifted.where("key is not null")
    own = pages.join(part.select(F.col("id").alias("b"), F.col("component").alias("cb")), "b", "left").join(part.select(F.col("id").alias("a"), F.col("component").alias("ca")), "a", "left")
    members = own.select("key", F.col("b").alias("id"), F.coalesce("cb", "b").alias("component"), (F.coalesce("cb", "b") != F.coalesce("ca", "a")).alias("odd")).distinct()
    members = materialise(members, "members")
    sizes = members.groupBy("key").agg(
        F.count(F.lit(1)).alias("n_page"), F.count_if("odd").alias("n_odd"), F.bit_xor(F.xxhash64("id")).alias("_x"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("_y"), F.bit_xor(F.xxhash64("id", "odd")).alias("_z")
    )
    # pages with the same members are searched once
    sizes = sizes.where("n_odd > 0 and n_page > 1").groupBy("n_page", "n_odd", "_x", "_y", "_z").agg(F.min("key").alias("key")).select("key", "n_page")
    blocks = F.ceil(F.col("n_page") / PAGE).cast("int")
    held = members.join(sizes, "key").join(shape, "id").withColumn("blocks", blocks)
    held = held.select("key", F.pmod(F.xxhash64("id"), "blocks").cast("int").alias("block"), "blocks", "id", "component", "n", "point", "odd")
    asked = held.where("odd").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    every = held.withColumn("asks", F.lit(0)).unionByName(asked.withColumn("asks", F.lit(1))).drop("blocks", "odd")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, base, tree, names, parts = None, [], None, None, None
        for f in frames:
            out: list[pd.DataFrame] = []
            for (key, block, asks), g in f.groupby(["key", "block", "asks"], sort=True):
                if (key, block) != at:
                    at, base, tree = (key, block), [], None
                if not asks:
                    base.append(g)
                    continue
                if tree is None and base:
                    all_ = pd.concat(base)
                    names, parts = all_["id"].to_numpy(np.int64), all_["component"].to_numpy(np.int64)
                    tree = CountRTree(points(all_["point"].tolist()), all_["n"].to_numpy(np.int64), num, den)
                if tree is None:
                    continue
                for q, size, name, part_ in zip(points(g["point"].tolist()), g["n"].tolist(), g["id"].tolist(), g["component"].tolist(), strict=True):
                    hit = tree.search(q, size)
                    hit = hit[parts[hit] != part_]
                    if len(hit):
                        out.append(pd.DataFrame({"a": np.minimum(names[hit], name), "b": np.maximum(names[hit], name)}))
            if out:
                yield pd.concat(out).drop_duplicates()

    n = partitions(lifted.sparkSession)
    return every.repartition(n, "key", "block").sortWithinPartitions("key", "block", "asks").mapInPandas(run, "a long, b long").distinct()


def drop_near_copies(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: of each component the document with the smallest id."""
    found = near_components(docs, k, num, den, id_col, text_col)
    gone = found.where(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias("_gone")).distinct()
    names = [f"_c{i}" for i in range(len(docs.columns))]
    own = docs.select(*[F.col(c).alias(n) for c, n in zip(docs.columns, names, strict=True)], F.col(id_col).cast("long").alias("_id"))
    kept = own.join(gone, F.col("_id") == F.col("_gone"), "left_anti")
    return kept.select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)])
