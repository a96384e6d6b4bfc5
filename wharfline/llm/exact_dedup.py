"""Exact duplicates by a tree merge of sorted digest runs.

Every document is dealt to a leaf by a hash of its id. A leaf's run is a table sorted by digest, one entry for each
digest: the smallest (or largest) id and how many documents have it. A run lies in chunks of about CHUNK entries, cut
by bits of the digest, and a chunk is one sorted array.

Leaves are a power of two, and partners meet in binomial rounds: in round i, a node and the one whose number differs in bit
i exchange the halves of their chunks, split by bit i of the digests, so that each holds one half of what both had.
A chunk then consists of two sorted runs, which ``array_sort`` (a merge sort that takes runs as it finds them) merges.
Neighbours with equal digests become one entry with the smallest id of both and the sum of their counts; they are equal
only if length and a second, independent hash agree as well, so every level verifies what it merges. After
the last round every node holds the merged run of its part of all digests, and no round moves more than one entry for each
digest and node. The answer goes back to the leaves on (leaf, digest), so that a text that a third of all rows share
is spread over all leaves, as it is merged within each leaf before it is sent. Texts never move.

Defined results: a null text equals an empty text. Of rows that repeat the id and the text exactly one is kept.
Rows with a null id are kept only if all ids of their group are null. An empty table gives an empty result.
Columns other than id and text are not read here, and :func:`drop_copies` returns them as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import all_of, ascii_lower, materialise, partitions

DIGEST = ["_sha", "_bytes", "_check"]
#: Entries of a chunk of a sorted run, about.
CHUNK = 1024


def _digest(text: Column) -> list[Column]:
    normal = ascii_lower(F.coalesce(text.cast("string"), F.lit("")))
    return [F.unhex(F.sha2(normal, 256)).alias("_sha"), F.octet_length(normal).alias("_bytes"), F.xxhash64(normal).alias("_check")]


def _prefix(sha: Column) -> Column:
    """The first 52 bits of a digest as a number."""
    return F.conv(F.substring(F.hex(sha), 1, 13), 16, 10).cast("long")


def leaf_runs(keyed: DataFrame, leaves: int, chunks: int, keep: str) -> tuple[DataFrame, DataFrame]:
    """(one row for each leaf and digest, the leaves' sorted runs: node, chunk, run) of rows (_id, _leaf, digest)."""
    best = {"min": F.min, "max": F.max}[keep]
    held = keyed.groupBy("_leaf", *DIGEST).agg(best("_id").alias("_keep"), F.count(F.lit(1)).alias("_n"))
    place = F.pmod(_prefix(F.col("_sha")), F.lit(leaves * chunks))
    entry = F.struct(*DIGEST, (place % leaves).cast("int").alias("_slot"), "_keep", "_n").alias("_entry")
    chunked = held.select(F.col("_leaf").alias("node"), F.floor(place / leaves).cast("long").alias("chunk"), entry)
    return held, chunked.groupBy("node", "chunk").agg(F.array_sort(F.collect_list("_entry")).alias("run"))


def _same(a: Column, b: Column) -> Column:
    return all_of([a[c] == b[c] for c in DIGEST])


def merged(runs: Column, keep: str) -> Column:
    """One sorted array from ``runs`` (an array of sorted arrays): equal digests are verified and become one entry."""
    best = {"min": F.array_min, "max": F.array_max}[keep]
    entries = F.array_sort(F.flatten(runs))
    starts = lambda s: F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | ~_same(F.get(s, i), F.get(s, F.greatest(i - 1, F.lit(0)))))

    def one(s: Column, at: Column, k: Column) -> Column:
        first, upto = F.get(at, k), F.coalesce(F.get(at, k + 1), F.size(s))
        equal = F.slice(s, first + 1, upto - first)
        joined = F.struct(*[F.get(s, first)[c].alias(c) for c in [*DIGEST, "_slot"]], best(F.transform(equal, lambda x: x["_keep"])).alias("_keep"), F.aggregate(equal, F.lit(0).cast("long"), lambda n, x: n + x["_n"]).alias("_n"))
        return F.when(upto - first == 1, F.get(s, first)).otherwise(joined)

    # each intermediate is bound once, as the element of an array of one
    return F.flatten(F.transform(F.array(entries), lambda s: F.flatten(F.transform(F.array(starts(s)), lambda at: F.transform(F.sequence(F.lit(0), F.size(at) - 1), lambda k: one(s, at, k))))))


def exchange(runs: DataFrame, bit: int, keep: str) -> DataFrame:
    """The runs after partners whose numbers differ in ``bit`` have exchanged halves and merged what they hold."""
    power = 1 << bit
    half = lambda b: F.struct((F.col("node") - F.col("node").bitwiseAND(power) + b * power).alias("node"), F.filter("run", lambda x: x["_slot"].bitwiseAND(power) == b * power).alias("run"))
    sent = runs.select("chunk", F.explode(F.array(half(0), half(1))).alias("_half")).select(F.col("_half.node").alias("node"), "chunk", F.col("_half.run").alias("run")).where(F.size("run") > 0)
    met = sent.groupBy("node", "chunk").agg(F.collect_list("run").alias("_runs"))
    return met.select("node", "chunk", F.when(F.size("_runs") == 1, F.get("_runs", F.lit(0))).otherwise(merged(F.col("_runs"), keep)).alias("run"))


def tree_merge(keyed: DataFrame, leaves: int, keep: str, rows: int) -> tuple[DataFrame, DataFrame]:
    """(one row for each leaf and digest, one row for each digest) of ``rows`` rows (_id, _leaf, digest); leaves is a power of two."""
    chunks = 1 << max(0, (rows // (leaves * CHUNK)).bit_length())
    held, runs = leaf_runs(keyed, leaves, chunks, keep)
    for bit in range(leaves.bit_length() - 1):
        runs = exchange(runs, bit, keep)
    return held, runs.select(F.explode("run").alias("_e")).select(*[F.col(f"_e.{c}").alias(c) for c in [*DIGEST, "_keep", "_n"]])


def _digests(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, int]:
    """(_id, digest, _leaf) of every row in a table of its own, and the number of leaves."""
    leaves = 1 << max(1, (partitions(docs.sparkSession) - 1).bit_length())
    keyed = docs.select(F.col(id_col).alias("_id"), *_digest(F.col(text_col)))
    return materialise(keyed.withColumn("_leaf", F.pmod(F.xxhash64("_id"), F.lit(leaves)).cast("int")), "digests"), leaves


def duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min") -> DataFrame:
    """One row for each document: id, keep_id, group_size, kept, text_sha256."""
    keyed, leaves = _digests(docs, id_col, text_col)
    held, root = tree_merge(keyed, leaves, keep, keyed.count())
    answer = held.select("_leaf", *DIGEST).join(root, DIGEST)
    rows = keyed.join(answer, ["_leaf", *DIGEST])
    turn = F.row_number().over(Window.partitionBy("_leaf", *DIGEST, "_id").orderBy(F.lit(0)))
    return rows.select(
        F.col("_id").alias(id_col),
        F.col("_keep").alias("keep_id"),
        F.col("_n").alias("group_size"),
        (F.col("_id").eqNullSafe(F.col("_keep")) & (turn == 1)).alias("kept"),
        F.lower(F.hex("_sha")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Which row of an id stays is known from the id, but for ids that occur with several texts or repeatedly; only
    those rows' texts are hashed a second time.
    """
    keyed, leaves = _digests(docs, id_col, text_col)
    _, root = tree_merge(keyed, leaves, keep, keyed.count())
    root = root.select(*[F.col(c).alias(f"_r{c}") for c in DIGEST], F.col("_keep"))
    best = keyed.join(root, all_of([F.col(c) == F.col(f"_r{c}") for c in DIGEST] + [F.col("_id").eqNullSafe(F.col("_keep"))])).select("_id", *DIGEST).distinct()
    often = keyed.where("_id is not null").groupBy("_id").agg(F.count(F.lit(1)).alias("_rows")).where("_rows > 1").select(F.col("_id").alias("_often"))
    best, often = materialise(best, "kept"), materialise(often, "often")
    names = [f"_c{i}" for i in range(len(docs.columns))]
    own = docs.select(*[F.col(c).alias(n) for c, n in zip(docs.columns, names, strict=True)], F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    among = lambda df, how: df.join(often, F.col("_id") == F.col("_often"), how)
    sure = among(best.where("_id is not null"), "left_anti").select(F.col("_id").alias("_one"))
    plain = own.join(sure, F.col("_id") == F.col("_one"), "left_semi").select(*names)
    doubtful = own.where("_id is null").unionByName(among(own, "left_semi")).select(*names, "_id", *_digest(F.col("_text")))
    known = best.where("_id is null").unionByName(among(best, "left_semi")).select(*[F.col(c).alias(f"_k{c}") for c in ["_id", *DIGEST]])
    turn = F.row_number().over(Window.partitionBy("_id", *DIGEST).orderBy(F.lit(0)))
    found = doubtful.join(known, all_of([F.col(c).eqNullSafe(F.col(f"_k{c}")) for c in ["_id", *DIGEST]]), "left_semi").withColumn("_turn", turn).where("_turn = 1").select(*names)
    return plain.unionByName(found).select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)])
