"""Seeded perturbations of transactions, by hashes of ids: the same rows on any cluster."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.numbers import uniform
from skein.operators.order import running
from skein.plans.config import ENTITY_COLUMN


def _shift(tx: DataFrame, ts_us: Column) -> DataFrame:
    return tx.withColumn("ts_us", ts_us).withColumn("timestamp", F.timestamp_micros("ts_us"))


def _attack(tx: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Campaign rows and the others: only campaigns are grouped, whatever the share of the rest."""
    attack = F.coalesce(F.col("campaign_id"), F.lit("")) != ""
    return tx.where(attack), tx.where(~attack)


def scale_cadence(tx: DataFrame, factor: float, anchor: str = "start") -> DataFrame:
    """Campaign rows with their distances from the campaign's start, end or median time scaled."""
    mine, rest = _attack(tx)
    pick = {"start": F.min("ts_us"), "end": F.max("ts_us"), "median": F.percentile("ts_us", F.lit(0.5))}[anchor]
    at = mine.groupBy(F.col("campaign_id").alias("__c")).agg(pick.alias("__at"))
    moved = (F.col("__at") + F.rint((F.col("ts_us") - F.col("__at")) * factor)).cast("long")
    return _shift(mine.join(at, F.col("campaign_id") == F.col("__c")), moved).select(*tx.columns).unionByName(rest)


def jitter(tx: DataFrame, seconds: float, seed: int) -> DataFrame:
    """Campaign rows moved by a normal of the given deviation, within the times observed."""
    u, v = uniform(seed, "transaction_id"), uniform(seed + 1, "transaction_id")
    z = F.sqrt(-2 * F.log(F.greatest(u, F.lit(1e-12)))) * F.cos(2 * 3.141592653589793 * v)
    ends = tx.agg(F.min("ts_us").alias("__low"), F.max("ts_us").alias("__high"))
    moved = F.least(F.col("__high"), F.greatest(F.col("__low"), (F.col("ts_us") + F.rint(z * seconds * 1_000_000)).cast("long")))
    return _shift(tx.crossJoin(F.broadcast(ends)), F.when(F.coalesce(F.col("campaign_id"), F.lit("")) != "", moved).otherwise(F.col("ts_us"))).select(*tx.columns)


def weaken_reuse(tx: DataFrame, entity: str, share: float, seed: int) -> DataFrame:
    """A seeded share of campaign rows, exactly, with a fresh entity each."""
    mine, rest = _attack(tx)
    mine = mine.withColumn("__h", F.sha2(F.concat_ws(":", F.lit(str(seed)), "transaction_id"), 256))
    # the first eight digits order the rows but for ties, which the whole hash settles among themselves
    short = F.conv(F.substring("__h", 1, 8), 16, 10).cast("long")
    mine = mine.withColumn("__short", short)
    place = running(mine, "__short", {"n": F.count(F.lit(1))}).select(F.col("__short").alias("__s"), "n_before")
    total = mine.agg(F.rint(F.count(F.lit(1)) * share).alias("__k"))
    among = F.row_number().over(Window.partitionBy("__short").orderBy("__h"))
    chosen = mine.withColumn("__in", among).join(place, F.col("__short") == F.col("__s")).crossJoin(F.broadcast(total))
    column = ENTITY_COLUMN[entity]
    fresh = F.when(F.col("n_before") + F.col("__in") <= F.col("__k"), F.concat(F.lit(f"fresh-{entity}-"), "transaction_id")).otherwise(F.col(column))
    return chosen.withColumn(column, fresh).select(*tx.columns).unionByName(rest)


def align_time(tx: DataFrame, to_us: int) -> DataFrame:
    """Each campaign moved so that it starts at a time."""
    mine, rest = _attack(tx)
    start = mine.groupBy(F.col("campaign_id").alias("__c")).agg(F.min("ts_us").alias("__at"))
    return _shift(mine.join(start, F.col("campaign_id") == F.col("__c")), F.col("ts_us") - F.col("__at") + to_us).select(*tx.columns).unionByName(rest)


def right_censor(tx: DataFrame, share: float) -> DataFrame:
    """Rows up to the given quantile of time, inclusive."""
    cut = tx.agg(F.percentile("ts_us", F.lit(share)).cast("long").alias("cut")).first()["cut"]
    return tx.where(F.col("ts_us") <= F.lit(cut)) if cut is not None else tx


def truncate_tails(tx: DataFrame, share: float) -> DataFrame:
    """The first max(1, floor(n * share)) rows of each campaign; campaigns of one row and other rows stay."""
    mine, rest = _attack(tx)
    w = Window.partitionBy("campaign_id")
    t = mine.withColumns({"__n": F.count(F.lit(1)).over(w), "__r": F.row_number().over(w.orderBy("ok"))})
    keep = (F.col("__n") < 2) | (F.col("__r") <= F.greatest(F.lit(1), F.floor(F.col("__n") * share)))
    return t.where(keep).select(*tx.columns).unionByName(rest)


def resample_legitimate(tx: DataFrame, multiple: float, seed: int) -> DataFrame:
    """``tx`` with copies of legitimate rows under new ids and fresh cards, devices and addresses, ``multiple`` times as many
    on average; times are drawn evenly from those observed."""
    ends = tx.agg(F.min("ts_us").alias("__low"), F.max("ts_us").alias("__high"))
    more = _attack(tx)[1].crossJoin(F.broadcast(ends)).withColumn("__copies", F.floor(F.lit(multiple) + uniform(seed, "transaction_id")).cast("int"))
    more = more.where("__copies > 0").withColumn("__i", F.explode(F.sequence(F.lit(1), F.col("__copies")))).withColumn("transaction_id", F.concat(F.lit("new-"), "transaction_id", F.lit("-"), F.col("__i").cast("string")))
    fresh = {ENTITY_COLUMN[e]: F.concat(F.lit(f"fresh-{e}-"), "transaction_id") for e in ("card", "device", "ip")}
    more = _shift(more.withColumns(fresh), F.col("__low") + F.floor(uniform(seed + 1, "transaction_id") * (F.col("__high") - F.col("__low") + 1)))
    return tx.unionByName(more.select(*tx.columns))


def inject_bursts(tx: DataFrame, bursts: int, rows: int, seconds: int, seed: int) -> DataFrame:
    """``tx`` with benign bursts: donors of one legitimate device, by hash, repeated within ``seconds`` on that device."""
    legit = tx.where("campaign_id = ''").orderBy(F.xxhash64(F.lit(seed), "transaction_id"), "transaction_id").limit(bursts)
    one = legit.withColumn("__i", F.explode(F.sequence(F.lit(1), F.lit(rows)))).withColumn("transaction_id", F.concat(F.lit("burst-"), "transaction_id", F.lit("-"), F.col("__i").cast("string")))
    one = one.withColumn("card_fingerprint", F.concat(F.lit("fresh-card-"), "transaction_id"))
    one = _shift(one, F.col("ts_us") + F.floor(uniform(seed + 1, "transaction_id") * seconds * 1_000_000))
    return tx.unionByName(one.select(*tx.columns))


def summary(before: DataFrame, after: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """One row: rows kept, added and removed, and changed values by column."""
    a = before.select("transaction_id", *[F.col(c).alias(f"a_{c}") for c in columns], F.lit(1).alias("in_a"))
    b = after.select("transaction_id", *[F.col(c).alias(f"b_{c}") for c in columns], F.lit(1).alias("in_b"))
    both = F.col("in_a").isNotNull() & F.col("in_b").isNotNull()
    counts = [F.count_if(both & ~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}"))).alias(f"changed_{c}") for c in columns]
    return a.join(b, "transaction_id", "full_outer").agg(F.count_if(both).alias("n_kept"), F.count_if(F.col("in_a").isNull()).alias("n_added"), F.count_if(F.col("in_b").isNull()).alias("n_removed"), *counts)


def run_arm(tx: DataFrame, transform: Callable[[DataFrame], DataFrame], profile: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """A perturbed world and its profile."""
    world = transform(tx)
    return world, profile(world)


def cadence_profile(tx: DataFrame) -> DataFrame:
    """By campaign: rows, span and median gap."""
    gap = (F.col("ts_us") - F.lag("ts_us").over(Window.partitionBy("campaign_id").orderBy("ts_us", "transaction_id"))) / F.lit(1_000_000.0)
    t = tx.where("campaign_id <> ''").withColumn("gap", gap)
    return t.groupBy("campaign_id").agg(F.count(F.lit(1)).alias("n"), ((F.max("ts_us") - F.min("ts_us")) / F.lit(1_000_000.0)).alias("span_seconds"), F.percentile("gap", F.lit(0.5)).alias("median_gap"))


def reuse_profile(tx: DataFrame) -> DataFrame:
    """By campaign: 1 - distinct / rows of cards, devices and addresses."""
    n = F.count(F.lit(1))
    return tx.where("campaign_id <> ''").groupBy("campaign_id").agg(n.alias("n"), *[(1 - F.count_distinct(ENTITY_COLUMN[e]) / n).alias(f"{e}_reuse") for e in ("card", "device", "ip")])
