"""Descriptive features of candidates: timing, topology, spread, amounts, outcomes, flags, buckets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.numbers import bucket, over
from skein.operators.graph import edges
from skein.plans.config import ENTITY_COLUMN


def members(tx: DataFrame, assigned: DataFrame, least: int = 2) -> DataFrame:
    return tx.join(assigned.where(F.col("candidate_size") >= least).select("transaction_id", "candidate_id"), "transaction_id")


def timing(m: DataFrame) -> DataFrame:
    """Gaps between neighbours in time, and transactions a minute (null at span 0)."""
    order = Window.partitionBy("candidate_id").orderBy("ok")
    g = m.withColumn("gap", (F.col("ts_us") - F.lag("ts_us").over(order)) / F.lit(1_000_000.0))
    t = g.groupBy("candidate_id").agg(
        F.avg("gap").alias("gap_mean"), F.percentile("gap", F.lit(0.5)).alias("gap_median"), F.min("gap").alias("gap_min"), F.max("gap").alias("gap_max"), F.stddev_samp("gap").alias("gap_std"),
        F.count(F.lit(1)).alias("n"), ((F.max("ts_us") - F.min("ts_us")) / F.lit(1_000_000.0)).alias("span"),
    )
    t = t.withColumn("gap_cv", over(F.col("gap_std"), F.col("gap_mean"))).withColumn("burstiness", over(F.col("gap_max"), F.col("gap_median")))
    return t.withColumn("transactions_per_minute", over((F.col("n") - 1) * 60.0, F.col("span"))).drop("n", "span")


def topology(frame: DataFrame) -> DataFrame:
    """Link density, links by transaction, shares by type and the type that dominates."""
    n, e = F.col("size"), F.col("link_edge_count")
    c, d, i = (F.col(f"links_{t}") for t in ("card", "device", "ip"))
    top = F.greatest(c, d, i)
    ties = (c == top).cast("int") + (d == top).cast("int") + (i == top).cast("int")
    kind = F.when(top == 0, "none").when(ties > 1, "mixed").when(c == top, "card").when(d == top, "device").otherwise("ip")
    return frame.select(
        "candidate_id", over(e.cast("double"), n * (n - 1) / 2.0).alias("link_density"), (e / n).alias("links_per_transaction"), over(F.col("links_multi_entity").cast("double"), e).alias("multi_entity_link_fraction"),
        *[over(F.col(f"links_{t}").cast("double"), e).alias(f"{t}_link_share") for t in ("card", "device", "ip")], ((c > 0).cast("long") + (d > 0).cast("long") + (i > 0).cast("long")).alias("n_link_entity_types_used"), kind.alias("dominant_link_type"),
    )


def spread(m: DataFrame) -> DataFrame:
    """Distinct entities, by transaction and by one another."""
    n = F.count(F.lit(1))
    t = m.groupBy("candidate_id").agg(n.alias("size"), *[F.count_distinct(c).alias(f"distinct_{e}s") for e, c in ENTITY_COLUMN.items()])
    per = [(F.col(f"distinct_{e}s") / F.col("size")).alias(f"{e}s_per_transaction") for e in ENTITY_COLUMN]
    ratio = lambda a, b, name: over(F.col(f"distinct_{a}s").cast("double"), F.col(f"distinct_{b}s")).alias(name)
    return t.select("candidate_id", *[f"distinct_{e}s" for e in ENTITY_COLUMN], *per, ratio("card", "device", "cards_per_device"), ratio("card", "ip", "cards_per_ip"), ratio("merchant", "card", "merchants_per_card"))


def amounts(m: DataFrame, low: float) -> DataFrame:
    """Level, spread, repetition and roundness of amounts.  ``low``: a small amount of the whole population, inclusive."""
    x = F.col("amount")
    base = m.groupBy("candidate_id").agg(
        F.avg(x).alias("amount_mean"), F.percentile(x, F.lit(0.5)).alias("amount_median"), F.stddev_samp(x).alias("amount_std"), F.min(x).alias("amount_min"), F.max(x).alias("amount_max"),
        F.avg((x <= low).cast("double")).alias("low_amount_share"), F.avg((F.bround(x, 2) % 10 == 0).cast("double")).alias("round_amount_share"), F.count(F.lit(1)).alias("n"),
    )
    same = m.groupBy("candidate_id", F.bround(x, 2).alias("a")).count().groupBy("candidate_id").agg(F.max("count").alias("most"), F.count(F.lit(1)).alias("kinds"))
    t = base.join(same, "candidate_id")
    t = t.withColumns({"amount_range": F.col("amount_max") - F.col("amount_min"), "amount_cv": over(F.col("amount_std"), F.col("amount_mean")), "distinct_amounts_per_transaction": F.col("kinds") / F.col("n"), "max_identical_amount_share": F.col("most") / F.col("n")})
    return t.drop("n", "most", "kinds")


def outcomes(m: DataFrame, values: tuple[str, ...] = ("approved", "declined")) -> DataFrame:
    """Share of each outcome."""
    token = F.lower(F.trim("auth_outcome"))
    slug = lambda v: "auth_" + "".join(ch if ch.isalnum() else "_" for ch in v.lower()) + "_share"
    return m.groupBy("candidate_id").agg(*[F.avg((token == v).cast("double")).alias(slug(v)) for v in values])


def flags(frame: DataFrame, topo: DataFrame, shared: DataFrame) -> DataFrame:
    """Fifteen yes-or-no features."""
    f = frame.join(topo.select("candidate_id", "link_density", "n_link_entity_types_used"), "candidate_id").join(shared, "candidate_id", "left")
    f = f.na.fill(0, ["max_transactions_per_shared_device", "max_transactions_per_shared_ip", "n_shared_cards"])
    c = F.col
    rules = {
        "has_card_links": c("links_card") > 0, "has_device_links": c("links_device") > 0, "has_ip_links": c("links_ip") > 0, "has_multi_entity_link": c("links_multi_entity") > 0,
        "uses_multiple_link_types": c("n_link_entity_types_used") >= 2, "has_shared_device": c("max_transactions_per_shared_device") >= 2, "has_shared_ip": c("max_transactions_per_shared_ip") >= 2,
        "has_shared_card": c("n_shared_cards") >= 1, "single_device_group": c("distinct_devices") == 1, "single_ip_group": c("distinct_ips") == 1, "single_card_group": c("distinct_cards") == 1,
        "all_distinct_cards": c("distinct_cards") == c("size"), "spans_multiple_bins": c("distinct_bins") > 1, "spans_multiple_merchants": c("distinct_merchants") > 1,
        "fully_connected": F.coalesce(F.abs(c("link_density") - 1.0) <= 1e-5, F.lit(False)),
    }
    return f.select("candidate_id", *[v.alias(k) for k, v in rules.items()])


#: Right-closed upper edges and names.
SIZE_BUCKETS = ((2, "2"), (3, "3"), (5, "4-5"), (10, "6-10"), (20, "11-20"), (50, "21-50"), (None, "50+"))
SPAN_BUCKETS = ((60, "<=1m"), (300, "1-5m"), (900, "5-15m"), (1800, "15-30m"), (3600, "30-60m"), (None, ">60m"))


def buckets(frame: DataFrame) -> DataFrame:
    return frame.select("candidate_id", bucket(F.col("size"), SIZE_BUCKETS).alias("size_bucket"), bucket(F.col("time_span_seconds"), SPAN_BUCKETS).alias("span_bucket"))


def shared_counts(tx: DataFrame, assigned: DataFrame) -> DataFrame:
    """Entities that two or more transactions of a candidate use, and the most of one, by type."""
    own = assigned.where("candidate_size > 1").select("transaction_id", "candidate_id")
    e = edges(tx, ("card", "device", "ip")).join(own, "transaction_id").groupBy("candidate_id", "entity_type", "entity_id").count().where("count > 1")
    of = lambda t, x: F.when(F.col("entity_type") == t, x)
    return e.groupBy("candidate_id").agg(F.count(of("card", F.lit(1))).alias("n_shared_cards"), *[F.coalesce(F.max(of(t, F.col("count"))), F.lit(0)).alias(f"max_transactions_per_shared_{t}") for t in ("device", "ip")])
