"""Chat formatting by multi-party perspective rotation.

A dialogue is rendered once for every participant: that speaker's turns as the assistant's, all others' as turns
of named users, system turns as they are. The mask has one entry for each message: 1 where the text is the
assistant's and is trained on, else 0; ``trained_chars`` counts the rendered characters under it.

A dialogue of up to ``part_size`` messages is one row for each participant. Of a longer one, the row's rendering and mask
are part 0, 1, 2, ... of ``n_parts``; joined in that order they are the rendering and the mask of the whole dialogue,
byte for byte. Parts are cut by the rank of a message, never by its turn number, so that missing, null and repeated
turn numbers change nothing. Ranks come from one range sort of all messages: its tasks number their own rows, and a
table with a row for each dialogue and task moves them up, so that no dialogue, however long, meets in one task.

The markers of the format cannot be forged: in texts and roles, ``<|`` is written ``<\\|`` and ``|>`` is written ``|\\>``, and
where backslashes stand between the two characters there is one more (:func:`unescape` takes it away again).

Defined results: turns sort by number, nulls first, then by role, then by the MD5 of the text; a null role is the participant
``unknown``; a null text is empty; roles are told apart by their exact spelling; rows with a null conversation id
form one dialogue; a dialogue with only system turns is not rendered; rows that repeat are rendered repeatedly; an
empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialise, partitions

OPEN, CLOSE = "<|", "<|end|>\n"
#: Messages of a part.
PART = 256
#: (pattern, replacement) that keep texts from holding markers.
ESCAPES = [(r"<(\\*)\|", r"<\\$1|"), (r"\|(\\*)>", r"|\\$1>")]


def escape(text: Column) -> Column:
    for pattern, by in ESCAPES:
        text = F.regexp_replace(text, pattern, by)
    return text


def unescape(rendered: str) -> str:
    """The text of a message as it was before :func:`escape`."""
    return re.sub(r"<\\(\\*)\|", r"<\1|", re.sub(r"\|\\(\\*)>", r"|\1>", rendered))


def numbered(turns: DataFrame, keys: list[str], part_size: int) -> DataFrame:
    """The rows of ``turns`` (conv_id and ``keys``) with their rank in the dialogue and the dialogue's number of messages."""
    order = ["conv_id", *keys]
    dealt = turns.repartitionByRange(partitions(turns.sparkSession), *order).sortWithinPartitions(*order).withColumn("_row", F.monotonically_increasing_id())
    dealt = materialise(dealt.withColumn("_task", F.shiftright("_row", 33)), "turns")
    runs = dealt.groupBy("conv_id", "_task").agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_n"))
    own = Window.partitionBy("conv_id")
    before = own.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(F.col("conv_id").alias("_conv"), F.col("_task").alias("_t"), "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(own).alias("_all"))
    joined = dealt.join(runs, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("_task") == F.col("_t")))
    rank = F.col("_row") - F.col("_first") + F.col("_before")
    return joined.select(*turns.columns, rank.alias("rank"), F.floor(rank / part_size).cast("long").alias("part"), F.ceil(F.col("_all") / part_size).cast("long").alias("n_parts"))


def rotate(conversations: DataFrame, part_size: int = PART, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row for each dialogue, participant and part: conv_id, part, n_parts, speaker, n_messages, mask, trained_chars, rendered."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    turns = conversations.select(
        F.col(conv_col).alias("conv_id"),
        F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("unknown")).alias("role"),
        F.md5(text).alias("_tie"),
        escape(text).alias("text"),
    )
    ranked = numbered(turns, ["turn", "role", "_tie"], part_size)
    parts = ranked.groupBy("conv_id", "part", "n_parts").agg(F.sort_array(F.collect_list(F.struct("rank", "role", "text"))).alias("messages"))
    speakers = turns.where(F.col("role") != "system").select(F.col("conv_id").alias("_conv"), F.col("role").alias("speaker")).distinct()
    faced = parts.join(speakers, F.col("conv_id").eqNullSafe(F.col("_conv")))
    own = lambda m: m["role"] == F.col("speaker")
    head = lambda m: F.when(own(m), "assistant").when(m["role"] == "system", "system").otherwise(F.concat(F.lit("user:"), escape(m["role"])))
    return faced.select(
        "conv_id",
        "part",
        "n_parts",
        "speaker",
        F.size("messages").cast("long").alias("n_messages"),
        F.array_join(F.transform("messages", lambda m: F.when(own(m), "1").otherwise("0")), "").alias("mask"),
        F.aggregate("messages", F.lit(0).cast("long"), lambda n, m: n + F.when(own(m), F.length(m["text"])).otherwise(0)).alias("trained_chars"),
        F.array_join(F.transform("messages", lambda m: F.concat(F.lit(OPEN), head(m), F.lit("|>\n"), m["text"], F.lit(CLOSE))), "").alias("rendered"),
    )
