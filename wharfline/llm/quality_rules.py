"""Quality rules: hashed n-grams that are likelier in trusted texts than in the corpus, and counts that no good text has.

Two multinomials over hashed n-grams (words as they are, and pairs of neighbouring words) are counted: the target's over the trusted documents, the raw
corpus's over all documents. An n-gram weighs log((1 - MIX) p_target / p_raw + MIX), the log-likelihood ratio of a target that is
interpolated with the corpus; its least value, of n-grams that trusted texts do not have, is log(MIX) at every size of corpus. A document's score is the mean weight
of its n-grams. It is rejected below the LOW quantile of the scores of trusted documents in its language that pass the base rules.

Texts fall into two halves by a hash, and each half has multinomials of its own; a text is scored by those of the half it is not in. So
neither a trusted text nor any number of copies of one tells the model about itself.

Buckets are a power of two, one for PER_BUCKET bytes of the corpus, at most MOST_BUCKETS: one row for each of either half, which is broadcast (at most
2 * MOST_BUCKETS rows of two numbers). Everything is DataFrame functions. N-grams are exploded, met with their weights and summed within a task,
for rows of a document follow one another: one row for each document and task is shuffled, and no text. Only trusted texts
move, to be met with the labels; before that a bitmap of their ids leaves other texts out.

Weights are whole numbers of 1/UNIT nats and quantiles are exact ones of whole numbers, so no result depends on the order of
rows. Quantiles come from counts by language and score, and scores have at most UNIT * log(1 / MIX) + 20 * UNIT steps, whatever the number of rows.

Base counts: n_repeat_words counts the words in windows of REPEATED words that occur twice or more in the text; windows are ordered by
hash and words, so equal ones are neighbours and hashes decide nothing.

Defined results: null and empty texts have no words and fail the base rules. Rows that repeat id and text are scored each. A null
language is a language of its own, apart from the empty one. A language with fewer than FEW trusted documents has a limit twice as far from
the median; one without any takes the limit of all trusted documents; without trusted documents at all nothing is rejected but by the base rules. A document counts as trusted if any label of its
id says so. A null id has no label. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import among, materialise

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
LEAST_WORDS, REPEATED, MOST_REPEATED = 50, 3, 50
#: Words of an n-gram at most.
GRAMS = 2
#: The corpus's share in the target, bytes of the corpus for each bucket, and the bounds of the number of buckets.
MIX, PER_BUCKET, LEAST_BUCKETS, MOST_BUCKETS = 0.1, 16, 1 << 14, 1 << 18
UNIT = 1 << 16
#: Scores of trusted documents below this quantile are rejected; as many values are needed for the lowest to be below it with a confidence of 0.95.
LOW, FEW = 0.005, 598
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def _let(value: Column, use) -> Column:  # noqa: ANN001
    """``use`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def repeat_words(words: Column, size: int = REPEATED) -> Column:
    """Words in windows of ``size`` words that occur twice or more."""
    at = lambda w, i, j: F.get(w, i + j)
    window = lambda w, i: F.struct(F.xxhash64(*[at(w, i, j) for j in range(size)]).alias("h"), *[at(w, i, j).alias(f"w{j}") for j in range(size)], i.alias("at"))
    same = lambda a, b: (a["h"] == b["h"]) & _all([a[f"w{j}"] == b[f"w{j}"] for j in range(size)])

    def repeated(s: Column) -> Column:  # places of the windows whose neighbour in order is equal
        twice = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda k: F.coalesce(same(F.get(s, k), F.get(s, k - 1)), F.lit(False)) | F.coalesce(same(F.get(s, k), F.get(s, k + 1)), F.lit(False)))
        return F.sort_array(F.transform(twice, lambda k: F.get(s, k)["at"]))

    def covered(p: Column) -> Column:  # a window adds what the one after it does not begin with
        return F.aggregate(F.transform(p, lambda x, k: F.least(F.lit(size), F.coalesce(F.get(p, k + 1) - x, F.lit(size)))), F.lit(0).cast("long"), lambda n, x: n + x)

    def counted(w: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(w) - size)
        hashes = F.transform(places, lambda i: F.xxhash64(*[at(w, i, j) for j in range(size)]))
        # texts without equal hashes, most of them, are not ordered
        found = _let(F.sort_array(F.transform(places, lambda i: window(w, i))), lambda s: _let(repeated(s), covered))
        return F.when(F.size(w) < size, F.lit(0).cast("long")).otherwise(F.when(F.size(F.array_distinct(hashes)) == F.size(w) - size + 1, F.lit(0).cast("long")).otherwise(found))

    return _let(words, counted)


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def base_counts(text: Column) -> list[Column]:
    """The five counts of a text that is not null, by their names."""
    words = words_of(text)
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return [
        F.size(words).cast("long").alias("n_words"),
        F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(text, f"[^{SYMBOLS}]++", "")).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        repeat_words(words).alias("n_repeat_words"),
    ]


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def _neighbours(words: Column) -> Column:
    """Every word with those after it, as an array of structs; fields beyond the end are null."""
    return F.arrays_zip(*[(F.slice(words, i + 1, F.greatest(F.size(words) - i, F.lit(0))) if i else words).alias(f"w{i}") for i in range(GRAMS)])


def _buckets(buckets: int, half: Column) -> list[Column]:
    """The buckets of the n-grams of up to GRAMS words that begin with a row's first (null where the text ends before), those of half 1 behind those of half 0."""
    at = lambda i: F.pmod(F.xxhash64(*[F.col(f"w{j}") for j in range(i + 1)]), F.lit(buckets)).cast("int") + half * F.lit(buckets)
    return [F.when(F.col(f"w{i}").isNotNull(), at(i)).alias(f"b{i}") for i in range(GRAMS)]


def _counts(texts: DataFrame, buckets: int, name: str) -> DataFrame:
    """(bucket, count) of the n-grams of texts (half, text). No lambda: the whole way to the first sums is generated code."""
    words = texts.select("half", F.inline(_neighbours(words_of(F.col("text")))))
    each = words.select(F.explode(F.array(*_buckets(buckets, F.col("half")))).alias("bucket")).where("bucket is not null")
    return each.groupBy("bucket").agg(F.count(F.lit(1)).alias(name))


def weights(raw: DataFrame, target: DataFrame, buckets: int) -> DataFrame:
    """(bucket, w): the weight of each bucket under the multinomials of its half, of counts (bucket, raw) and (bucket, target).

    A bucket that a half does not have has the least weight there.
    """
    met = raw.join(target, "bucket", "left").select("bucket", F.floor(F.col("bucket") / buckets).alias("half"), "raw", F.coalesce("target", F.lit(0)).alias("target"))
    met = materialise(met, "counts")
    total = met.groupBy("half").agg(F.sum("raw").cast("double").alias("all_raw"), F.sum("target").cast("double").alias("all_target"))
    ratio = (F.col("target") / F.greatest("all_target", F.lit(1.0))) / (F.col("raw") / F.col("all_raw"))
    weight = F.rint(F.ln((1 - MIX) * ratio + MIX) * UNIT).cast("int")
    return met.join(F.broadcast(total), "half").select("bucket", weight.alias("w"))  # two rows


def least_weight() -> int:
    return round(math.log(MIX) * UNIT)


def buckets_for(size: int) -> int:
    """The number of buckets for so many bytes of text."""
    return min(MOST_BUCKETS, max(LEAST_BUCKETS, 1 << max(0, size // PER_BUCKET - 1).bit_length()))


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row for each document: id, the base counts, base_failed, the score and its limit in nats, kept."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(lang_col).cast("string").alias("lang"), text.alias("text"))
    rows = rows.select("id", "lang", "text", F.pmod(F.xxhash64("text"), F.lit(2)).cast("int").alias("half"))
    trusted = labels.where("quality = 1").select(F.col("doc_id").cast("long").alias("_trusted")).where("_trusted is not null").distinct()
    trusted = materialise(trusted, "trusted")
    buckets = buckets_for(rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0)
    raw = materialise(_counts(rows.select("half", "text"), buckets, "raw"), "raw")
    known = among(rows.select("id", "text", "half"), trusted)
    target = materialise(_counts(known.select("half", "text"), buckets, "target"), "target")
    table = materialise(weights(raw, target, buckets), "weights")

    measured = rows.select("id", "lang", "half", F.xxhash64("text").alias("_x"), F.xxhash64("text", F.lit(1)).alias("_y"), words_of(F.col("text")).alias("words"), *base_counts(F.col("text")))
    own = ["id", "lang", "_x", "_y", *BASE]
    # a row without words, in front, counts the rows of a document; those that repeat it fall into one
    marker = F.array(F.struct(*[F.lit(None).cast("string").alias(f"w{i}") for i in range(GRAMS)]))
    each = measured.select(*own, "half", F.inline(F.concat(marker, _neighbours(F.col("words"))))).select(*own, *_buckets(buckets, 1 - F.col("half")))
    weight, met = F.lit(0), F.lit(0)
    for i in range(GRAMS):  # each a broadcast of at most 2 * MOST_BUCKETS rows
        each = each.join(F.broadcast(table.select(F.col("bucket").alias(f"_b{i}"), F.col("w").alias(f"_w{i}"))), F.col(f"b{i}") == F.col(f"_b{i}"), "left")
        weight, met = weight + F.when(F.col(f"b{i}").isNotNull(), F.coalesce(f"_w{i}", F.lit(least_weight()))).otherwise(0), met + F.col(f"b{i}").isNotNull().cast("int")
    summed = each.groupBy(*own).agg(F.sum(weight.cast("long")).alias("sum"), F.sum(met.cast("long")).alias("n"), F.count_if(F.col("b0").isNull()).alias("rows"))
    score = F.when(F.col("n") > 0, F.rint(F.col("sum") / F.col("n")).cast("long"))
    failed = base_failed().alias("base_failed")
    scored = materialise(summed.select("id", "lang", *BASE, failed, score.alias("score"), F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))).alias("_row")).drop("_row"), "scores")

    good = scored.where("not base_failed").join(trusted, F.col("id") == F.col("_trusted"))
    limits = materialise(limit_of(good), "limits")
    each_lang = limits.where("not every").select(F.col("lang").alias("_lang"), "limit")
    whole = limits.where("every").select(F.col("limit").alias("_limit"))
    judged = scored.join(F.broadcast(each_lang), F.col("lang").eqNullSafe(F.col("_lang")), "left").join(F.broadcast(whole), how="left")  # a row for each language; one row
    limit = F.coalesce("limit", "_limit")
    kept = ~F.col("base_failed") & F.coalesce(F.col("score") >= limit, F.lit(True))
    return judged.select(F.col("id").alias(id_col), *BASE, "base_failed", kept.alias("kept"), (F.col("score") / UNIT).alias("log_ratio"), (limit / UNIT).alias("limit"))


def limit_of(good: DataFrame) -> DataFrame:
    """(lang, every, limit): of trusted documents (lang, score), for each language and (where every) for all."""
    counts = good.groupBy("lang", "score").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.withColumn("every", F.lit(False)).unionByName(counts.groupBy("score").agg(F.sum("n").alias("n")).select(F.lit(None).cast("string").alias("lang"), "score", "n", F.lit(True).alias("every")))
    by = Window.partitionBy("lang", "every")
    seen = counts.select("lang", "every", "score", F.sum("n").over(by.orderBy("score")).alias("upto"), F.sum("n").over(by).alias("rows"))
    first = lambda q: F.min(F.when(F.col("upto") >= q * F.col("rows"), F.col("score")))
    found = seen.groupBy("lang", "every").agg(first(LOW).alias("low"), first(0.5).alias("mid"), F.max("rows").alias("rows"))
    return found.select("lang", "every", F.when(F.col("rows") < FEW, 2 * F.col("low") - F.col("mid")).otherwise(F.col("low")).alias("limit"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` that are not rejected, with all their columns; rows with a null id stay."""
    names = [f"_c{i}" for i in range(len(docs.columns))]
    bad = judge(docs, labels, id_col, text_col, lang_col).where("not kept").select(F.col(id_col).alias("_bad")).where("_bad is not null").distinct()
    own = docs.select(*[F.col(c).alias(n) for c, n in zip(docs.columns, names, strict=True)], F.col(id_col).cast("long").alias("_id"))
    return own.join(bad, F.col("_id") == F.col("_bad"), "left_anti").select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)])
