"""Queries of this subpackage over the driver's tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.layout import spread
from . import ann_forest, bpe, chat, exact_dedup, filter_audit, hard_negatives, licenses, ngram_join, packing, quality_kn, quality_rules, sharding, token_files


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(spread(_read(spark, sf_dir, "documents")))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_kn.score(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.duplicate_groups(_read(spark, sf_dir, "documents"), keep="max")


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_components(_read(spark, sf_dir, "documents"), k=4, num=85, den=100)


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(spread(_read(spark, sf_dir, "documents")))


def op6_ann_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann_forest.search(_read(spark, sf_dir, "embeddings"), every=100, k=10)


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(_read(spark, sf_dir, "documents"))


def op8_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotate(_read(spark, sf_dir, "conversations"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(spread(_read(spark, sf_dir, "documents")))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(_read(spark, sf_dir, "documents"), tree := sharding.uniform_tree(24), sharding.grown(tree))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(spread(_read(spark, sf_dir, "documents")), _read(spark, sf_dir, "labels"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _read(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(vectors.select("vec_id", moved.alias("label"), "embedding"), every=50, positives=5, negatives=3)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = [op1_license_scan, op2_quality_classifier, op3_exact_dedup, op4_ngram_join, op5_bpe, op6_ann_forest, op7_token_files, op8_chat_rotation, op9_packing, op10_sharding, op11_filter_audit, op12_quality_rules, op13_hard_negatives]
    return {f.__name__: f for f in named}


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _lower(column: str) -> str:
    return f"translate({column}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _canonical(line: str) -> str:
    out = f"regexp_replace({_lower(line)}, {_quote(licenses.COPYRIGHT_LINE)}, '')"
    for pattern, by in licenses.EQUIVALENT:
        out = f"regexp_replace({out}, {_quote(pattern)}, {_quote(by)}, 'g')"
    return rf"trim(regexp_replace({out}, '[\x00-\x2f\x3a-\x60\x7b-\x7f]+', ' ', 'g'))"


def license_sql() -> str:
    lines = lambda t: f"list_transform(string_split(coalesce({t}, ''), chr(10)), lambda x: {_canonical('x')})"

    def whole(c: str) -> str:
        out = f"array_to_string(list_filter({c}, lambda y: y <> ''), ' ')"
        for pattern, by in licenses.WRAPPED:
            out = f"regexp_replace({out}, {_quote(pattern)}, {_quote(by)}, 'g')"
        return f"sha256({out})"

    known = ", ".join(f"({_quote(i)}, {_quote(t)})" for i, t in licenses.KNOWN)
    return f"""
WITH k AS (SELECT {whole("c")} AS digest, min(id) AS license_id FROM (SELECT id, {lines("t")} AS c FROM (VALUES {known}) v(id, t)) GROUP BY 1),
d AS (SELECT doc_id, {lines("text")} AS c FROM documents),
hit AS (SELECT doc_id, license_id FROM (SELECT doc_id, sha256(unnest(c)) AS digest FROM d) JOIN k USING (digest)),
per AS (SELECT doc_id, count(*) AS n_lines, array_to_string(list_sort(list_distinct(list(license_id))), ',') AS line_licenses FROM hit GROUP BY doc_id)
SELECT d.doc_id, {whole("d.c")} AS digest, k.license_id, coalesce(n_lines, 0) AS n_lines, coalesce(line_licenses, '') AS line_licenses
FROM d LEFT JOIN k ON k.digest = {whole("d.c")} LEFT JOIN per USING (doc_id)"""


DEDUP_SQL = f"""
WITH d AS (SELECT doc_id, sha256({_lower("coalesce(text, '')")}) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY 1)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)"""

_ESCAPED = r"regexp_replace(regexp_replace({}, '<(\\*)\|', '<\\\1|', 'g'), '\|(\\*)>', '|\\\1>', 'g')".format
CHAT_SQL = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS raw FROM conversations),
n AS (SELECT conv_id, role, {_ESCAPED('raw')} AS text, {_ESCAPED('role')} AS named, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(raw)) - 1 AS rank, count(*) OVER (PARTITION BY conv_id) AS n_all FROM t),
s AS (SELECT DISTINCT conv_id, role AS speaker FROM t WHERE role <> 'system')
SELECT n.conv_id, rank // {chat.PART} AS part, (n_all + {chat.PART - 1}) // {chat.PART} AS n_parts, speaker, count(*) AS n_messages,
  string_agg(CASE WHEN role = speaker THEN '1' ELSE '0' END, '' ORDER BY rank) AS mask,
  sum(CASE WHEN role = speaker THEN length(text) ELSE 0 END)::BIGINT AS trained_chars,
  string_agg('<|' || CASE WHEN role = speaker THEN 'assistant' WHEN role = 'system' THEN 'system' ELSE 'user:' || named END || '|>' || chr(10) || text || '<|end|>' || chr(10), '' ORDER BY rank) AS rendered
FROM n JOIN s ON n.conv_id IS NOT DISTINCT FROM s.conv_id GROUP BY n.conv_id, part, n_parts, speaker"""


#: Documents of a part are counted by what fails; an order's step keeps those that none of its filters so far fails.
AUDIT_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
first AS (SELECT t, min(doc_id) AS id FROM d GROUP BY t),
marks AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id),
judged AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, len(w) < 50 AS a, 100 * len(list_distinct(w)) < 65 * len(w) AS b,
  100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) AS c, regexp_matches(t, '[#$%&*|]') AS dd, coalesce(first.id < d.doc_id, false) AS e
  FROM d JOIN first USING (t) LEFT JOIN marks ON marks.doc_id = d.doc_id),
kinds AS (SELECT part, good, toxic, a::INT + 2 * b::INT + 4 * c::INT + 8 * dd::INT + 16 * e::INT AS fails, count(*) AS n FROM judged GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l, unnest([1, 2, 4, 8, 16]) AS bit),
orders AS (SELECT v.l || w.l || x.l || y.l || z.l AS filter_order, [v.bit, w.bit, x.bit, y.bit, z.bit] AS bits FROM letters v, letters w, letters x, letters y, letters z WHERE v.bit + w.bit + x.bit + y.bit + z.bit = 31 AND len(list_distinct([v.l, w.l, x.l, y.l, z.l])) = 5),
steps AS (SELECT filter_order, step, substr(filter_order, step, 1) AS filter, bits[step] AS bit, list_sum([0] || bits[1:step - 1])::INT AS before FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
counted AS (SELECT part, filter_order, step, filter, sum(CASE WHEN fails & (before | bit) = 0 THEN n ELSE 0 END)::BIGINT AS kept, sum(CASE WHEN fails & before = 0 AND fails & bit <> 0 THEN n ELSE 0 END)::BIGINT AS removed,
  sum(CASE WHEN fails & before <> 0 AND fails & bit <> 0 THEN n ELSE 0 END)::BIGINT AS redundant, sum(CASE WHEN fails = bit THEN n ELSE 0 END)::BIGINT AS unique_fails,
  sum(CASE WHEN good AND fails & before = 0 AND fails & bit <> 0 THEN n ELSE 0 END)::BIGINT AS good_lost, sum(CASE WHEN toxic AND fails & before = 0 AND fails & bit <> 0 THEN n ELSE 0 END)::BIGINT AS toxic_lost
  FROM kinds, steps GROUP BY ALL)
SELECT *, (sum(removed) OVER (PARTITION BY part, filter))::BIGINT AS shapley FROM counted"""


NEGATIVES_SQL = """
WITH v AS (SELECT vec_id AS id, (CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END)::BIGINT AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.id AS anchor_id, b.id, a.label = b.label AS own, list_dot_product(a.x, b.x)::BIGINT AS score FROM v a, v b WHERE a.id % 50 = 0 AND a.id <> b.id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE own QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, positive_id, (row_number() OVER w)::INT AS rank, s.id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT own AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.id) QUALIFY rank <= 3"""


def oracle_sql() -> dict[str, str]:
    return {"op11_filter_audit": AUDIT_SQL, "op13_hard_negatives": NEGATIVES_SQL, "op1_license_scan": license_sql(), "op3_exact_dedup": DEDUP_SQL, "op8_chat_rotation": CHAT_SQL}
