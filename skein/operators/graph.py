"""The temporal graph of transactions and the entities they use, as two tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.operators.related import probe_buckets, time_bucket
from skein.plans.config import ENTITIES, ENTITY_COLUMN, CandidateConfig


def edges(tx: DataFrame, types: tuple[str, ...] = ENTITIES) -> DataFrame:
    """One row a transaction and entity.  ``tx`` is in causal order (ts_us, ok)."""
    one = F.explode(F.array(*[F.struct(F.lit(t).alias("entity_type"), F.col(ENTITY_COLUMN[t]).alias("entity_id")) for t in types]))
    e = tx.select("transaction_id", "ts_us", "ok", one.alias("e")).select("transaction_id", "ts_us", "ok", "e.*").where("entity_id IS NOT NULL")
    return e.withColumn("entity_key", F.concat_ws(":", "entity_type", "entity_id"))


def nodes(tx: DataFrame) -> DataFrame:
    """node_key, node_type, node_id, ts_us: transactions, and each entity once (without a time)."""
    t = tx.select(F.concat(F.lit("transaction:"), "transaction_id").alias("node_key"), F.lit("transaction").alias("node_type"), F.col("transaction_id").alias("node_id"), "ts_us")
    e = edges(tx).select(F.col("entity_key").alias("node_key"), F.col("entity_type").alias("node_type"), F.col("entity_id").alias("node_id")).distinct()
    return t.unionByName(e.withColumn("ts_us", F.lit(None).cast("long")))


def summary(tx: DataFrame) -> DataFrame:
    """One row: transactions, edges, distinct entities by type, first and last time."""
    counts = [F.count_distinct(ENTITY_COLUMN[t]).alias(f"n_{t}s") for t in ENTITIES]
    n_edges = sum((F.count(ENTITY_COLUMN[t]) for t in ENTITIES), F.lit(0))
    return tx.agg(F.count(F.lit(1)).alias("n_transactions"), n_edges.cast("long").alias("n_edges"), *counts, F.min("ts_us").alias("first_ts_us"), F.max("ts_us").alias("last_ts_us"))


def entity_counts(tx: DataFrame) -> DataFrame:
    return edges(tx).groupBy("entity_type").agg(F.count_distinct("entity_id").alias("n_entities"), F.count(F.lit(1)).alias("n_edges"))


def history(tx: DataFrame, entity_type: str, entity_id: str, start_us: int | None = None, end_us: int | None = None) -> DataFrame:
    """Transactions of an entity within an inclusive time range, with their place in its causal order."""
    rows = tx.where(F.col(ENTITY_COLUMN[entity_type]) == entity_id)
    if start_us is not None:
        rows = rows.where(F.col("ts_us") >= start_us)
    if end_us is not None:
        rows = rows.where(F.col("ts_us") <= end_us)
    return rows.select("transaction_id", "ts_us", (F.row_number().over(Window.orderBy("ok"))).cast("long").alias("nth"))


def lookup(tx: DataFrame, transaction_id: str) -> DataFrame:
    """The entities of one transaction."""
    return edges(tx.where(F.col("transaction_id") == transaction_id)).select("transaction_id", "entity_type", "entity_id")


def neighbours(tx: DataFrame, config: CandidateConfig | None = None, causal: bool = True) -> DataFrame:
    """(transaction_id, neighbour_id, entity_type, entity_id, delta_us): pairs that share an entity within the window.

    causal: the neighbour is earlier in (time, id); else both directions.  An equi-join
    on (entity, time bucket): a hot entity is dealt over its buckets.
    """
    config = config or CandidateConfig()
    w = config.window_seconds
    e = edges(tx, config.connectivity)
    a = e.withColumn("b", F.explode(probe_buckets(F.col("ts_us"), w)))
    p = e.select("entity_key", F.col("transaction_id").alias("neighbour_id"), F.col("ts_us").alias("pts"), F.col("ok").alias("pok")).withColumn("b", time_bucket(F.col("pts"), w))
    pairs = a.join(p, ["entity_key", "b"]).where((F.col("pok") < F.col("ok")) & (F.col("pts") >= F.col("ts_us") - w * 1_000_000))
    back = pairs.select("transaction_id", "neighbour_id", "entity_type", "entity_id", (F.col("pts") - F.col("ts_us")).alias("delta_us"))
    if causal:
        return back
    return back.unionByName(back.select(F.col("neighbour_id").alias("transaction_id"), F.col("transaction_id").alias("neighbour_id"), "entity_type", "entity_id", (-F.col("delta_us")).alias("delta_us")))


def shared_entities(tx: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, entity_types) of pairs of transactions: the entity types whose id they share, in order, joined by |."""
    types = list(ENTITIES)
    side = lambda x: tx.select(F.col("transaction_id").alias(x), *[F.col(ENTITY_COLUMN[t]).alias(f"{x}_{t}") for t in types])
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    same = F.array_compact(F.array(*[F.when(F.col(f"a_{t}") == F.col(f"b_{t}"), t) for t in types]))
    return both.select("a", "b", F.array_join(same, "|").alias("entity_types"))


def fanout(tx: DataFrame) -> DataFrame:
    """By entity type: distinct entities and mean, median and most transactions of one."""
    per = edges(tx).groupBy("entity_type", "entity_id").count()
    return per.groupBy("entity_type").agg(F.count(F.lit(1)).alias("n_distinct"), F.round(F.avg("count"), 6).alias("mean_fanout"), F.percentile("count", F.lit(0.5)).alias("median_fanout"), F.max("count").alias("max_fanout"))


def chain_edges(tx: DataFrame, window_seconds: int | None = None, types: tuple[str, ...] = ("card", "device", "ip")) -> DataFrame:
    """(entity_type, entity_id, src, dst, gap_us): each transaction and the one before it of the same entity.

    Within a window they have the same components as all pairs, in at most a row an edge.
    """
    order = Window.partitionBy("entity_key").orderBy("ok")
    e = edges(tx, types)
    e = e.withColumn("prev", F.lag(F.struct("transaction_id", "ts_us", "ok")).over(order)).where("prev IS NOT NULL")
    out = e.select("entity_type", "entity_id", F.col("prev.transaction_id").alias("src"), F.col("transaction_id").alias("dst"), (F.col("ts_us") - F.col("prev.ts_us")).alias("gap_us"), F.col("prev.ok").alias("src_ok"), F.col("ok").alias("dst_ok"))
    return out if window_seconds is None else out.where(F.col("gap_us") <= window_seconds * 1_000_000)
