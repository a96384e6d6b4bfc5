"""How filters interact: what each removes, and how often, in every order in which they can be applied.

The orders of n filters form a trie of permutations: a node is a prefix, an edge applies one filter more. What is left after a
prefix does not depend on the order within it, so the prefixes of one set of filters share one state. The trie is walked
depth first. A state's survivors are a DataFrame, persisted when it is first reached, filtered from the survivors of the
state that the walk came from; later visits find it in the memo. At every state one aggregation counts, for each part, the
survivors and what each further filter (each edge) removes from them. A state is given back when all its edges are walked,
so at most one path of the trie and the siblings beside it are held; a lost executor's share is filtered again from the table of
verdicts, which lies in the shared folder.

Texts are read once, for that table: one narrow row for each document with its part, what each filter says of it, and
its labels. A filter that needs other rows (``first_of_text``) is settled before the walk. Counts of a part are one row of at most
n 2^(n-1) edges, from which the n! orders are read off; nothing is collected.

The copies filter compares SHA-256 and length of the texts: smallest ids are found for each salt of ids and digest, then for each digest, and
returned to (salt, digest), so a text that a third of all rows share is no task's work.

Defined results: null texts are empty; a null part is the empty string; a filter that is null for a row does not fail it.
Rows that repeat an id do not fail one another as copies; a null id fails nobody and is failed by no copy, and has no labels. Labels that
repeat an id count if any of them says so. Each row counts, repeated rows too. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import json
from functools import reduce
from itertools import permutations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialise

#: White space that parts words, as a class of a regular expression.
SPACE = r"[\x20\x09-\x0D]+"
#: The n! orders of more filters than these are too many rows for each part.
MOST_FILTERS = 7
#: Salts of the copies filter.
SALTS = 256


def text_filters(text: Column) -> dict[str, Column]:
    """The four filters that look at one text alone; true where the text fails."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    words = F.array_remove(F.split(text, SPACE), "")
    capitals = F.length(F.regexp_replace(text, "[^A-Z]++", ""))
    return {
        "A": F.size(words) < 50,
        "B": 100 * F.size(F.array_distinct(words)) < 65 * F.size(words),
        "C": 100 * capitals > 5 * F.length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }


def verdicts(docs: DataFrame, filters: dict[str, Column], copies: str | None, labels: DataFrame, id_col: str, text_col: str, part_col: str) -> DataFrame:
    """(part, what each filter says, good, toxic) of every row, as a table."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
        *[F.coalesce(c, F.lit(False)).alias(f"fails_{n}") for n, c in filters.items()],
        *([F.unhex(F.sha2(text, 256)).alias("_sha"), F.octet_length(text).alias("_bytes"), F.pmod(F.xxhash64(F.col(id_col).cast("long")), F.lit(SALTS)).cast("int").alias("_salt")] if copies else []),
    )
    rows = materialise(rows, "texts_judged")
    if copies:
        digest = ["_sha", "_bytes"]
        held = rows.groupBy("_salt", *digest).agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
        # texts that occur once are nobody's copies and need no answer
        first = held.groupBy(*digest).agg(F.min("_first").alias("_first"), F.sum("_n").alias("_n")).where("_n > 1").drop("_n")
        answer = held.drop("_first", "_n").join(first, digest)
        rows = rows.join(answer, ["_salt", *digest], "left").withColumn(f"fails_{copies}", F.coalesce(F.col("_first") < F.col("_id"), F.lit(False)))
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("_labelled")).agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    judged = rows.join(marks, F.col("_id") == F.col("_labelled"), "left")
    flags = [f"fails_{n}" for n in (*filters, *([copies] if copies else []))]
    return materialise(judged.select("part", *flags, *[F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")]), "verdicts")


def walk(table: DataFrame, names: list[str]) -> DataFrame:
    """(part, state, kept, removed, good_lost, toxic_lost) of each state of the trie: the counts of its edges by their filter's number.

    A state is the set of the filters applied so far, as bits.
    """
    counts: dict[int, DataFrame] = {}

    def edges(survivors: DataFrame, state: int) -> DataFrame:
        def lost(also: Column | None) -> Column:
            def of(i: int, name: str) -> Column:
                if state >> i & 1:
                    return F.lit(0).cast("long")
                fails = F.col(f"fails_{name}")
                return F.count_if(fails if also is None else fails & also)

            return F.array(*[of(i, n) for i, n in enumerate(names)])

        return survivors.groupBy("part").agg(F.count(F.lit(1)).alias("kept"), lost(None).alias("removed"), lost(F.col("good")).alias("good_lost"), lost(F.col("toxic")).alias("toxic_lost")).withColumn("state", F.lit(state))

    def visit(survivors: DataFrame, state: int) -> None:
        held = survivors.persist(StorageLevel.MEMORY_AND_DISK)
        counts[state] = materialise(edges(held, state), "edges")  # fills what was persisted
        for i, name in enumerate(names):
            after = state | 1 << i
            if after not in counts:
                visit(held.where(f"not fails_{name}"), after)
        held.unpersist()

    visit(table, 0)
    return reduce(DataFrame.unionByName, counts.values())


def orders(names: list[str]) -> list[dict]:
    """Every step of every order: the order, the step, the number of its filter, the state before it and the state of all other filters."""
    out, full = [], (1 << len(names)) - 1
    for order in permutations(range(len(names))):
        state = 0
        for step, i in enumerate(order, 1):
            out.append({"name": "".join(names[j] for j in order), "step": step, "filter": i, "before": state, "others": full ^ 1 << i})
            state |= 1 << i
    return out


def audit(
    docs: DataFrame, labels: DataFrame, filters: dict[str, Column] | None = None, copies: str | None = "E", id_col: str = "doc_id", text_col: str = "text", part_col: str = "source"
) -> DataFrame:
    """One row for each part, order of the filters and step.

    ``filters`` are conditions over the columns of ``docs`` that are true where a row fails, by one-letter names; ``copies`` names one more, which
    fails a row whose text a smaller id has. ``labels`` has doc_id, quality and toxic.
    """
    filters = text_filters(F.col(text_col)) if filters is None else filters
    names = [*filters, *([copies] if copies else [])]
    if not 0 < len(names) <= MOST_FILTERS or len(set(names)) < len(names):
        raise ValueError(f"1 to {MOST_FILTERS} filters of different names are needed, not {names}")
    found = walk(verdicts(docs, filters, copies, labels, id_col, text_col, part_col), names)
    # the states of a part in one row: 2^n of them at most
    state = F.map_from_entries(F.collect_list(F.struct("state", F.struct("kept", "removed", "good_lost", "toxic_lost")))).alias("states")
    parts = materialise(found.groupBy("part").agg(state), "states")
    steps = F.from_json(F.lit(json.dumps(orders(names))), "array<struct<name: string, step: int, filter: int, before: int, others: int>>")
    every = parts.select("part", "states", F.explode(steps).alias("x"))
    at = F.try_element_at(F.col("states"), F.col("x.before"))  # no state where nobody of the part is left
    alone = F.try_element_at(F.col("states"), F.col("x.others"))
    pick = lambda state, count: F.coalesce(F.get(state[count], F.col("x.filter")), F.lit(0).cast("long"))
    failing = pick(F.try_element_at(F.col("states"), F.lit(0)), "removed")
    rows = every.select(
        "part", F.col("x.name").alias("filter_order"), F.col("x.step").alias("step"), F.element_at(F.array(*map(F.lit, names)), F.col("x.filter") + 1).alias("filter"),
        (F.coalesce(at["kept"], F.lit(0).cast("long")) - pick(at, "removed")).alias("kept"), pick(at, "removed").alias("removed"),
        (failing - pick(at, "removed")).alias("redundant"), pick(alone, "removed").alias("unique_fails"), pick(at, "good_lost").alias("good_lost"), pick(at, "toxic_lost").alias("toxic_lost"),
    )
    return rows.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "filter")))
