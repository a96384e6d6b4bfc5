"""Document quality by an interpolated modified Kneser-Ney model of n-grams of bytes.

An n-gram is ORDER bytes of UTF-8, every script and mark as it is, written exactly into one number. What the model gathers from the trusted
documents (all those labelled so) grows with them: one row for each distinct n-gram. Lower orders count
the distinct left neighbours of their n-grams. Joins sharded by context bring together counts, context totals and the
three discounts of each order. The model stays a table: for each n-gram its discounted share, and as a context the
weight it leaves to the order below. It is never collected or broadcast.

The model meets the documents in a join sharded by n-gram. A block is what one task reads (or a share of it, by a hash, of about BLOCK
bytes). A first reading sends the distinct n-grams of every block to the join: pre-aggregated, so that an n-gram goes
once for each block however often it occurs. A second reading sends the texts, compressed in pages, to their block's
answers (shares and weights), where every whole text is scored. Pages stream past the answers, so a task holds one block's n-grams and
one page of text. Both readings need the same blocks, so the documents have to be a table or a plan that deals its
rows alike each time; a checksum of what was asked
stops the job otherwise.

Which texts are the trusted documents' is settled by a join on their ids; before it, a bitmap of hashes of those ids (BITS bits,
whatever their number) keeps other texts from being moved.

Trusted documents fall into two halves by a hash of their text, each with a model and discounts of its own. A document, trusted or not, is
scored by the model of the half that its hash is not in, so that trusted scores are no better than those of new documents.

A document's score is its mean negative log-probability, drawn towards the median of its language by PRIOR bytes, so
that a short text is not judged by a few bytes. It is rejected beyond its language's threshold, the HIGH quantile of
the trusted documents' scores. Repetition is cheap to such a model, so it has a bound of its own: the share of words that
repeat the word before, or whose pair with it came within the last NEAR words, with NEW unrepeated words added; it is
rejected beyond the MOST quantile of the trusted documents. Below FEW trusted documents of a language the highest is no
bound of these quantiles; only there the limit is twice as far from the median.

Defined results: null and empty texts have no symbols, the score of their language's median and are kept; a null
language is a language of its own, apart from the empty one; a language without trusted documents takes the quantiles of all trusted ones;
without any trusted document everything is kept; repeated rows are scored each; an empty table gives an empty
result. Scores are whole numbers of 1/UNIT nats, so sums do not depend on their order.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .bpe import WINDOW
from .common import among, materialise, partitions, ship

ORDER, UNIT = 5, 4096
PRIOR, HIGH = 200, 0.99
NEAR, NEW, MOST = 64, 8, 0.999
#: So many values are needed for the highest to be above their 0.99 quantile with a confidence of 0.95.
FEW = 299
#: Steps of scores to a nat, for quantiles.
STEP = 10_000
#: The half that a text is in, as SQL.
HALF = "pmod(xxhash64(coalesce(text, '')), 2)"


#: Bytes of text of a block and of a page, about.
BLOCK, PAGE = 64_000_000, 4_000_000
#: A number holds the bytes of an n-gram, its order above them and the half of its model above that.
ORDER_AT, HALF_AT = 8 * ORDER, 8 * ORDER + 4
NO_GRAM = -1
#: A share and a weight are packed into one number, as negative logarithms in 1/FINE nats; NONE where there is none.
FINE, NONE = 1 << 16, (1 << 31) - 1
#: Flat columns only: rows with arrays are slow to hand to Python. ``data`` is a page of texts and, as JSON, what is known of its
#: documents; ``value`` is the length of the JSON.
PAGES = "block long, page int, value long, data binary"


def tag(half: int, order: int) -> np.uint64:
    return np.uint64((half << HALF_AT) | (order << ORDER_AT))


def grams(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(n-grams of all texts, offsets of each): every byte with the ORDER - 1 before it, as if after blank lines."""
    gap = b"\n" * (ORDER - 1)
    size = np.fromiter(map(len, raw), np.int64, len(raw))
    s = np.frombuffer(b"".join(x for t in raw if t for x in (gap, t)), np.uint8)
    n = max(0, len(s) - ORDER + 1)
    code = np.zeros(n, np.uint64)
    for i in range(ORDER):
        code <<= np.uint64(8)
        code |= s[i : n + i]
    own = np.ones(n, bool)
    for e in np.cumsum((size + ORDER - 1)[size > 0])[:-1].tolist():
        own[e - ORDER + 1 : e] = False
    return code[own], np.concatenate([[0], np.cumsum(size)])


def summed(codes: list[np.ndarray], times: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes in order, and the sums of their times."""
    code, n = np.concatenate(codes), np.concatenate(times)
    order = np.argsort(code, kind="stable")
    code, n = code[order], n[order]
    if not len(code):
        return code, n
    head = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
    return code[head], np.add.reduceat(n, head)


def _slices(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        part = (f["text"].str.len().fillna(0).to_numpy(np.int64).cumsum() // WINDOW) if len(f) else np.zeros(0)
        for p in np.unique(part):
            yield f[part == p]


def repetition(text: str | None) -> int:
    """The share of repeated words, in 1/STEP."""
    words, last, before, repeated = (text or "").split(), {}, None, 0
    for i, word in enumerate(words):
        pair = (before, word)
        repeated += word == before or i - last.get(pair, -NEAR - 1) <= NEAR
        last[pair], before = i, word
    return STEP * repeated // (len(words) + NEW)


class Grams:
    """Distinct n-grams of texts and how often they were added, merged as they come."""

    def __init__(self) -> None:
        self.codes, self.times, self.held = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0

    def add(self, code: np.ndarray) -> None:
        one, n = np.unique(code, return_counts=True)
        self.codes.append(one), self.times.append(n)
        self.held += len(one)
        if self.held > 1_000_000 and self.held > 2 * len(self.codes[0]):
            self.sum()

    def sum(self) -> tuple[np.ndarray, np.ndarray]:
        code, n = summed(self.codes, self.times)
        self.codes, self.times, self.held = [code], [n], len(code)
        return code, n


def _encoded(f: pd.DataFrame) -> list[bytes]:
    return [t.encode("utf-8", "replace") if t else b"" for t in f["text"]]


def _own_blocks(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[int, pd.DataFrame]]:
    """(block, rows) of rows (text, block, ...), some text at a time."""
    for f in _slices(frames):
        for block, g in f.groupby("block", sort=True):
            yield int(block), g


def _answering(raw: list[bytes], half: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n-grams with the mark of the model that scores them, offsets of each text)."""
    code, at = grams(raw)
    return code | np.repeat((1 - half.astype(np.int64)).astype(np.uint64) << np.uint64(HALF_AT), np.diff(at)), at


def asks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(block, gram, mark): what the blocks of (text, half, block) need of the model, and a row with NO_GRAM and the checksum of it."""
    blocks: dict[int, Grams] = {}
    for block, f in _own_blocks(frames):
        blocks.setdefault(block, Grams()).add(_answering(_encoded(f), f["half"].to_numpy())[0])
    for block, seen in blocks.items():
        own = seen.sum()[0]
        yield pd.DataFrame({"block": [block], "gram": [NO_GRAM], "mark": [checksum(own)]})
        code = expand(own).view(np.int64)
        for i in range(0, len(code), 500_000):
            yield pd.DataFrame({"block": block, "gram": code[i : i + 500_000], "mark": 0})


def checksum(code: np.ndarray) -> int:
    return int(np.bitwise_xor.reduce(code, initial=np.uint64(0)))


def pages(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The blocks of (id, lang, text, half, block): rows with pages of compressed texts, and one (page -1) with the block's n-grams."""
    blocks: dict[int, Grams] = {}
    held: dict[int, list] = {}

    def row(block: int, page: int, value: int, data: bytes) -> pd.DataFrame:
        return pd.DataFrame({"block": [block], "page": [page], "value": [value], "data": [data]})

    def page_row(block: int) -> pd.DataFrame:
        page, texts, meta, _ = held[block]
        held[block] = [page + 1, [], {k: [] for k in meta}, 0]
        head = json.dumps(meta | {"sizes": [len(t) for t in texts]}).encode()
        return row(block, page, len(head), zlib.compress(b"".join([head, *texts]), 6))

    for block, f in _own_blocks(frames):
        raw, half = _encoded(f), f["half"].to_numpy()
        blocks.setdefault(block, Grams()).add(_answering(raw, half)[0])
        own = held.setdefault(block, [0, [], {"ids": [], "langs": [], "repeated": [], "halves": []}, 0])
        own[1] += raw
        for name, values in {"ids": [None if pd.isna(x) else int(x) for x in f["id"]], "langs": f["lang"].tolist(), "repeated": [repetition(t) for t in f["text"]], "halves": half.tolist()}.items():
            own[2][name] += values
        own[3] += sum(map(len, raw))
        if own[3] >= PAGE:
            yield page_row(block)
    for block, seen in blocks.items():
        if held[block][1]:
            yield page_row(block)
        yield row(block, -1, 0, zlib.compress(seen.sum()[0].tobytes(), 1))


def expand(code: np.ndarray) -> np.ndarray:
    """All n-grams of orders 1 to ORDER that end as the given ones of the highest order, and their contexts."""
    half = code & np.uint64(1 << HALF_AT)
    out = []
    for order in range(ORDER + 1):
        mask = np.uint64((1 << 8 * order) - 1)
        mark = half | np.uint64(order << ORDER_AT)
        out.append(np.unique((code & mask) | mark))
        if order < ORDER:
            out.append(np.unique(((code >> np.uint64(8)) & mask) | mark))
    return np.unique(np.concatenate(out))


def count(texts: DataFrame) -> DataFrame:
    """(gram, n) of the texts (text, half)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = Grams()
        for f in _slices(frames):
            seen.add(_answering(_encoded(f), 1 - f["half"].to_numpy())[0])
        code, n = seen.sum()
        code = code.view(np.int64)
        for i in range(0, len(code), 500_000):
            yield pd.DataFrame({"gram": code[i : i + 500_000], "n": n[i : i + 500_000]})

    return texts.mapInPandas(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def model(counts: DataFrame) -> DataFrame:
    """(gram, packed share and back): the discounted share of each n-gram of each order, and the weight that it leaves, as a context, to the order below."""
    out = None
    table = counts
    for order in range(ORDER, 0, -1):
        half = F.col("gram").bitwiseAND(1 << HALF_AT)
        stat = table.groupBy(half.alias("_half")).agg(*[F.count_if(F.col("n") == i).cast("double").alias(f"c{i}") for i in (1, 2, 3, 4)])
        y = F.col("c1") / F.greatest(F.col("c1") + 2 * F.col("c2"), F.lit(1.0))
        over = lambda i: F.least(F.lit(float(i)), F.greatest(F.lit(0.1), i - (i + 1) * y * F.col(f"c{i + 1}") / F.greatest(F.col(f"c{i}"), F.lit(1.0))))
        discounts = stat.select("_half", *[over(i).alias(f"d{i}") for i in (1, 2, 3)])
        own = F.col("gram") - half
        shard = table.select("gram", "n", half.bitwiseOR(F.shiftright(own, 8)).bitwiseOR((order - 1) << ORDER_AT).alias("context"))
        per = shard.groupBy("context").agg(F.sum("n").alias("total"), *[F.count_if(F.col("n") == i).alias(f"n{i}") for i in (1, 2)], F.count_if(F.col("n") > 2).alias("n3"))
        per = per.join(F.broadcast(discounts), F.col("context").bitwiseAND(1 << HALF_AT) == F.col("_half"))  # a row for each half
        back = per.select("context", ((F.col("d1") * F.col("n1") + F.col("d2") * F.col("n2") + F.col("d3") * F.col("n3")) / F.col("total")).alias("back"))
        cut = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        share = shard.join(per.select("context", "total", "d1", "d2", "d3"), "context").select(F.col("gram").bitwiseOR(order << ORDER_AT).alias("gram"), ((F.col("n") - cut) / F.col("total")).alias("share"), F.lit(None).cast("double").alias("back"))
        rows = share.unionByName(back.select(F.col("context").alias("gram"), F.lit(None).cast("double").alias("share"), "back"))
        out = rows if out is None else out.unionByName(rows)
        if order > 1:
            table = materialise(table.select(half.bitwiseOR(own.bitwiseAND((1 << 8 * (order - 1)) - 1)).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n")), "counts")
    logs = lambda c: F.coalesce(F.rint(-F.ln(F.max(c)) * FINE).cast("long"), F.lit(NONE))
    return out.groupBy("gram").agg((logs("share") * (1 << 32) + logs("back")).alias("packed"))


def _unpacked(value: np.ndarray) -> np.ndarray:
    return np.where(value == NONE, np.nan, np.exp(value / -FINE))


def costs(code: np.ndarray, half: int, table: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """Negative log-probabilities in 1/UNIT nats of n-grams of the highest order under the model of ``half``, from the found (grams in order, shares, backs)."""
    grams_, shares, backs = table
    last = max(0, len(grams_) - 1)

    def find(order: int, of: np.ndarray, values: np.ndarray, missing: float) -> np.ndarray:
        if not len(grams_):
            return np.full(len(of), missing)
        want = (of & np.uint64((1 << 8 * order) - 1)) | tag(half, order)
        at = np.minimum(np.searchsorted(grams_, want), last)
        got = np.where(grams_[at] == want, values[at], np.nan)
        return np.where(np.isnan(got), missing, got)

    p = np.full(len(code), 1 / 256)
    for order in range(1, ORDER + 1):
        p = find(order, code, shares, 0.0) + find(order - 1, code >> np.uint64(8), backs, 1.0) * p
    return np.rint(-UNIT * np.log(np.maximum(p, 1e-12))).astype(np.int64)


class Lookup:
    """The costs of a block's n-grams by a table of hashes; n-grams whose slot another one has are searched."""

    def __init__(self, code: np.ndarray, cost: np.ndarray):
        self.code, self.cost, self.bits = code, cost, max(4, (8 * len(code)).bit_length())
        self.in_slot = np.zeros(1 << self.bits, np.int32)
        self.in_slot[self._slot(code)] = np.arange(len(code), dtype=np.int32)

    def _slot(self, code: np.ndarray) -> np.ndarray:
        return (code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)

    def costs(self, code: np.ndarray) -> np.ndarray:
        """The costs of some of the block's n-grams."""
        if not len(code):
            return np.zeros(0, np.int64)
        at = self.in_slot[self._slot(code)]
        other = np.flatnonzero(self.code[at] != code)
        at[other] = np.minimum(np.searchsorted(self.code, code[other]), len(self.code) - 1)
        if (self.code[at[other]] != code[other]).any():
            raise KeyError("an n-gram that is not the block's")
        return self.cost[at]


def scores(rows: DataFrame, learnt: DataFrame) -> DataFrame:
    """(id, lang, n, cost, repeated) of every document: block n-grams joined to the model, answers returned to their block."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, found, marks, known = None, [], [], None
        for f in frames:
            for block, g in f.groupby("block", sort=True):
                if block != at:
                    at, found, marks = block, [], []
                answers = g[g["page"] == -2]
                if len(answers):
                    code, value = answers["gram"].to_numpy(np.int64), answers["value"].to_numpy(np.int64)
                    found.append((code.view(np.uint64), _unpacked(value >> 32), _unpacked(value & 0xFFFFFFFF)))
                    marks = value[code == NO_GRAM].tolist() or marks
                for page in g[g["page"] >= -1].itertuples():
                    if page.page >= 0:
                        yield read_page(page, known)
                        continue
                    found = found or [(np.zeros(0, np.uint64), np.zeros(0), np.zeros(0))]
                    codes, shares, backs = (np.concatenate([x[i] for x in found]) for i in range(3))
                    order, asked = np.argsort(codes), np.frombuffer(zlib.decompress(page.data), np.uint64)
                    if marks != [checksum(asked)]:
                        raise RuntimeError("the documents were dealt differently when they were read again; give a table or a plan that always deals them alike")
                    table, low = (codes[order], shares[order], backs[order]), np.uint64((1 << ORDER_AT) - 1)
                    of = asked >> np.uint64(HALF_AT)
                    cost = np.zeros(len(asked), np.int64)
                    for h in (0, 1):
                        cost[of == h] = costs(asked[of == h] & low, h, table)
                    known, found = Lookup(asked, cost), []

    def read_page(page, known: Lookup) -> pd.DataFrame:  # noqa: ANN001
        data = zlib.decompress(page.data)
        meta, data = json.loads(data[: page.value]), data[page.value :]
        size, half = np.array(meta["sizes"], np.int64), np.array(meta["halves"], np.uint64)
        ends, total, i = np.cumsum(size), np.zeros(len(size), np.int64), 0
        while i < len(size):  # some of the page's texts at a time
            j = max(i + 1, int(np.searchsorted(ends, ends[i] - size[i] + WINDOW)))
            code, at = _answering([data[e - n : e] for e, n in zip(ends[i:j].tolist(), size[i:j].tolist(), strict=True)], half[i:j])
            sums = np.concatenate([[0], np.cumsum(known.costs(code))])
            total[i:j] = sums[at[1:]] - sums[at[:-1]]
            i = j
        return pd.DataFrame({"id": pd.array(meta["ids"], "Int64"), "lang": meta["langs"], "n": size, "cost": total, "repeated": meta["repeated"]})

    n = partitions(rows.sparkSession)
    learnt = learnt.unionByName(learnt.sparkSession.range(1).select(F.lit(NO_GRAM).cast("long").alias("gram")), allowMissingColumns=True)
    rows = rows.withColumn("block", F.spark_partition_id().cast("long") * F.lit(1 << 32) + F.col("sub")).drop("sub")
    rows = rows.select("id", "lang", "text", "half", "block")  # both readings need the same columns: a shuffle below may deal by them
    requests = rows.mapInPandas(asks, "block long, gram long, mark long")
    value = F.when(F.col("gram") == NO_GRAM, F.col("mark")).otherwise(F.col("packed"))
    answers = requests.join(learnt, "gram").select("block", F.lit(-2).alias("page"), "gram", value.alias("value"))
    texts = rows.mapInPandas(pages, PAGES)
    met = answers.unionByName(texts, allowMissingColumns=True).repartition(n, "block").sortWithinPartitions("block", "page")
    return met.mapInPandas(run, "id long, lang string, n long, cost long, repeated long")


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row for each document: id, lang, n_symbols, perplexity, score, threshold, repetition, repetition_limit, kept."""
    spark: SparkSession = docs.sparkSession
    ship(spark)
    trusted = labels.where("quality = 1").select(F.col("doc_id").cast("long").alias("_trusted")).where("_trusted is not null").distinct()
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shares = max(1, -(-size // (BLOCK * max(1, rows.rdd.getNumPartitions()))))
    rows = rows.select("id", "lang", "text", F.expr(HALF).alias("half"), F.pmod(F.xxhash64("id", "text", F.lit(1)), F.lit(shares)).alias("sub"))
    learnt = materialise(model(materialise(count(among(rows.select("id", "text", "half"), trusted)), "counts")), "model")
    scored = materialise(scores(rows, learnt), "scores")
    of = scored.join(trusted, F.col("id") == F.col("_trusted"), "left").withColumn("good", F.col("_trusted").isNotNull()).drop("_trusted")
    mean = of.where("good and n > 0").withColumn("step", F.rint(F.col("cost") * F.lit(STEP / UNIT) / F.col("n")).cast("long"))
    # tables of a few rows, written so that plans stay small
    middle = materialise(quantiles(mean, "step", {"median": 0.5}).drop("rows"), "medians")
    near = lambda df, q: df.join(F.broadcast(q.where("not every").drop("every").withColumnRenamed("lang", "_lang")), F.col("lang").eqNullSafe(F.col("_lang")), "left").drop("_lang")  # noqa: E731  one row for each language
    whole = lambda q: F.broadcast(q.where("every").select([F.col(c).alias(f"all_{c}") for c in q.columns if c not in ("lang", "every")]))  # noqa: E731  one row
    drawn = near(of, middle).join(whole(middle), how="left").withColumn("median", F.coalesce("median", "all_median", F.lit(0.0)))
    drawn = drawn.withColumn("score", F.rint((F.col("cost") * F.lit(STEP / UNIT) + PRIOR * F.col("median")) / (F.col("n") + PRIOR)).cast("long")).drop("all_median")
    drawn = materialise(drawn, "drawn")
    limits = materialise(bounds(drawn.where("good and n > 0"), "score", HIGH, "limit"), "limits")
    most = materialise(bounds(drawn.where("good and n > 0"), "repeated", MOST, "most"), "limits")
    judged = near(drawn, limits).join(whole(limits), how="left").withColumn("limit", F.coalesce("limit", "all_limit"))
    judged = near(judged, most).join(whole(most), how="left").withColumn("most", F.coalesce("most", "all_most"))
    return judged.select(
        F.col("id").alias(id_col), "lang", F.col("n").alias("n_symbols"),
        F.when(F.col("n") > 0, F.exp(F.col("cost") / F.lit(UNIT) / F.col("n"))).alias("perplexity"),
        (F.col("score") / STEP).alias("score"), (F.col("limit") / STEP).alias("threshold"),
        (F.col("repeated") / STEP).alias("repetition"), (F.col("most") / STEP).alias("repetition_limit"),
        F.coalesce((F.col("n") == 0) | ((F.col("score") <= F.col("limit")) & (F.col("repeated") <= F.col("most"))), F.lit(True)).alias("kept"),
    )


def quantiles(df: DataFrame, value: str, of: dict[str, float]) -> DataFrame:
    """(lang, every, rows, quantiles): exact quantiles of whole numbers for each language, null among them, and for all rows where ``every``; from counts by value."""
    counts = df.groupBy("lang", value).agg(F.count(F.lit(1)).alias("n"))
    together = counts.groupBy(value).agg(F.sum("n").alias("n")).select(F.lit(None).cast("string").alias("lang"), value, "n", F.lit(True).alias("every"))
    counts = counts.withColumn("every", F.lit(False)).unionByName(together)
    by = Window.partitionBy("lang", "every")
    seen = counts.select("lang", "every", value, F.sum("n").over(by.orderBy(value)).alias("upto"), F.sum("n").over(by).alias("total"))
    return seen.groupBy("lang", "every").agg(F.max("total").alias("rows"), *[F.min(F.when(F.col("upto") >= q * F.col("total"), F.col(value))).cast("double").alias(name) for name, q in of.items()])


def bounds(df: DataFrame, value: str, q: float, name: str) -> DataFrame:
    """The quantile ``q`` for each language; with fewer than FEW rows, where no quantile bounds it, twice as far from the median."""
    seen = quantiles(df, value, {"mid": 0.5, "top": q})
    few = F.when(F.col("rows") < FEW, F.col("top") - F.col("mid")).otherwise(0.0)
    return seen.select("lang", "every", (F.col("top") + few).alias(name))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` that are not rejected, with all their columns; rows with a null id stay."""
    names = [f"_c{i}" for i in range(len(docs.columns))]
    bad = score(docs, labels, id_col, text_col, lang_col).where("not kept").select(F.col(id_col).alias("_bad")).where("_bad is not null").distinct()
    own = docs.select(*[F.col(c).alias(n) for c, n in zip(docs.columns, names, strict=True)], F.col(id_col).cast("long").alias("_id"))
    good = own.join(bad, F.col("_id") == F.col("_bad"), "left_anti")
    return good.select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)])
