"""Reference datasets: keyed tables that enrichment and rules look rows up in.

Keys are compared upper-cased and stripped, the last row of a key counts. Lookups are equi-joins; Spark broadcasts
the dataset when its statistics are under the session's threshold and sorts and merges beyond it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_blank, plain, strip, trimmed
from .mapping import PLACEHOLDER

#: Keys of the shipped datasets; fixed values.
TEMPLATES = {"po": "{poNumber}", "po-line": "{poNumber}|{sku}", "catalog": "{sku}", "ship-to": "{customerId}|{shipToCode}", "fx": "{currency}"}


def reference_key(c: Column) -> Column:
    return F.upper(strip(c))


def keyed(rows: DataFrame, template: str, order: str | None = None) -> DataFrame:
    """(ref_key, row): one row for each key, the last by ``order`` or, without one, as read; rows with a blank key part are left out."""
    kinds = dict(rows.dtypes)
    text = lambda n: plain(F.col(n)) if kinds[n].startswith("decimal") else strip(F.col(n).cast("string"))
    parts, at, ok = [], 0, F.lit(True)
    for m in PLACEHOLDER.finditer(template):
        parts += [F.lit(template[at : m.start()]), text(m[1])]
        ok = ok & ~is_blank(text(m[1]))
        at = m.end()
    key = reference_key(F.concat(*parts, F.lit(template[at:])))
    whole = F.struct(*[c for c in rows.columns if c != order])
    out = rows.where(ok).select(key.alias("ref_key"), whole.alias("row"), (F.col(order) if order else F.monotonically_increasing_id()).alias("_order"))
    return out.groupBy("ref_key").agg(F.max_by("row", "_order").alias("row"))


class Reference:
    """Named datasets, each (ref_key, row struct)."""

    def __init__(self, datasets: dict[str, DataFrame] | None = None):
        self.datasets = dict(datasets or {})

    @classmethod
    def load(cls, tables: dict[str, DataFrame], order: str | None = None) -> Reference:
        """Datasets from plain tables; names without a known key are left out."""
        return cls({n: keyed(t, TEMPLATES[n], order) for n, t in tables.items() if n in TEMPLATES})

    def columns(self, dataset: str) -> list[str]:
        return self.datasets[dataset].schema["row"].dataType.names if dataset in self.datasets else []

    def join(self, df: DataFrame, dataset: str, key: Column, into: str) -> DataFrame:
        """Left join the dataset's row as the struct column ``into``; null where there is none."""
        if dataset not in self.datasets:
            return df.withColumn(into, F.lit(None).cast("struct<_none:int>"))
        right = self.datasets[dataset].select(F.col("ref_key").alias("_ref_key"), F.col("row").alias(into))
        # rows without a key would all meet in one task; the lower-case texts that stand for it are no key, as keys are upper-cased
        row = [c for c in ("file_id", "seq", "line", "record_id") if c in df.columns]
        none = F.concat(F.lit("none "), F.pmod(F.xxhash64(*row), F.lit(4096)).cast("string")) if row else F.lit(None).cast("string")
        df = df.withColumn("_key", key).withColumn("_key", F.coalesce(F.upper(trimmed(F.col("_key"))), none))  # in two steps: naming the key again costs nothing
        return df.join(right, F.col("_key") == F.col("_ref_key"), "left").drop("_key", "_ref_key")
