"""Replay of recorded transactions: valid rows once each, in time order, up to a number."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.operators.validate import FIELDS, problem
from skein.sources.transactions import production

#: Rows that a replay has at most.
CAP = 500


def replay(tx: DataFrame, cap: int = CAP) -> DataFrame:
    """transaction_id, ts_us and cursor of the first ``cap`` valid rows; ground truth and columns beside a transaction's are dropped.

    Of valid rows that repeat an id the first by (time, content) counts, whatever invalid rows share the id.
    """
    t = production(tx).select(*FIELDS, "ts_us")
    once = Window.partitionBy("transaction_id").orderBy("ts_us", F.xxhash64(*FIELDS))
    good = t.where(problem(list(FIELDS)).isNull()).withColumn("__n", F.row_number().over(once)).where("__n = 1")
    first = good.orderBy("ts_us", "transaction_id").limit(cap)
    return first.select("transaction_id", "ts_us", F.row_number().over(Window.orderBy("ts_us", "transaction_id")).cast("long").alias("cursor"))
