"""Running sums, ranks and exact quantiles over a global order, without a task that sorts everything.

Rows are first summed by value, so ties are one row.  Approximate quantiles cut the values
of each group into buckets; sums of whole buckets come from a table of that many rows, and
only what is inside a bucket is ordered by a window.  The cuts need not be exact: they
only say how even the tasks are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.plans.durable import durable

BUCKETS = 128


def running(df: DataFrame, value: str, sums: dict[str, Column], by: tuple[str, ...] = (), buckets: int = BUCKETS) -> DataFrame:
    """One row a (by, value): the sums of its rows, and of all rows of smaller values as ``{name}_before``.

    Null values come first.  ``sums``: aggregates that add up, such as counts.
    """
    # read several times below, so it is written once
    one = durable(df.groupBy(*by, value).agg(*[c.alias(n) for n, c in sums.items()]), "order")
    keys = [F.col(b) for b in by]
    shares = F.array(*[F.lit((i + 1) / buckets) for i in range(buckets - 1)])
    cuts = one.groupBy(*by).agg(F.percentile_approx(F.col(value).cast("double"), shares, F.lit(20 * buckets)).alias("__cuts"))
    cuts = cuts.select(*[F.col(b).alias(f"__by_{b}") for b in by], F.array_distinct("__cuts").alias("__cuts"))
    same = F.lit(True)
    for b in by:
        same = same & F.col(b).eqNullSafe(F.col(f"__by_{b}"))
    # as many rows as there are groups, each of at most ``buckets`` numbers
    cut = one.join(F.broadcast(cuts), same, "left") if by else one.crossJoin(F.broadcast(cuts))
    inside = F.when(F.col(value).isNull(), -1).otherwise(F.size(F.filter("__cuts", lambda c: c < F.col(value).cast("double"))))
    cut = cut.withColumn("__bucket", inside).select(*one.columns, "__bucket")
    whole = cut.groupBy(*by, "__bucket").agg(*[F.sum(n).alias(f"__all_{n}") for n in sums])
    earlier = Window.partitionBy(*keys).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = whole.select(*[F.col(b).alias(f"__by_{b}") for b in by], F.col("__bucket").alias("__of"), *[F.coalesce(F.sum(f"__all_{n}").over(earlier), F.lit(0)).alias(f"__base_{n}") for n in sums])
    within = Window.partitionBy(*keys, "__bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    out = cut.withColumns({f"{n}_before": F.coalesce(F.sum(n).over(within), F.lit(0)) for n in sums})
    out = out.join(F.broadcast(base), same & (F.col("__bucket") == F.col("__of")))
    return out.select(*one.columns, *[(F.col(f"{n}_before") + F.col(f"__base_{n}")).alias(f"{n}_before") for n in sums])


def ranks(df: DataFrame, value: str, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, value, n, n_before, rank): rank from 1 with the mean for ties."""
    return running(df, value, {"n": F.count(F.lit(1))}, by).withColumn("rank", F.col("n_before") + (F.col("n") + 1) / 2.0)


def quantiles(ranked: DataFrame, value: str, shares: tuple[float, ...], by: tuple[str, ...] = ()) -> DataFrame:
    """(by, share, value) of a table of :func:`ranks`: exact, linear between neighbours.  Nulls are no values."""
    known = ranked.where(F.col(value).isNotNull())
    keys = [F.col(b) for b in by]
    sized = known.groupBy(*by).agg(F.sum("n").alias("__n"), F.min("n_before").alias("__first"))
    want = sized.select(*[F.col(b).alias(f"__by_{b}") for b in by], "__n", "__first", F.explode(F.array(*map(F.lit, shares))).alias("share"))
    want = want.withColumn("__at", F.col("share") * (F.col("__n") - 1))
    same = F.lit(True)
    for b in by:
        same = same & F.col(b).eqNullSafe(F.col(f"__by_{b}"))
    low, high = F.floor("__at") + F.col("__first"), F.ceil("__at") + F.col("__first")
    covers = lambda k: (F.col("n_before") <= k) & (k < F.col("n_before") + F.col("n"))
    met = known.join(F.broadcast(want), same & (covers(low) | covers(high)))
    got = met.groupBy(*keys, "share", "__at", "__first").agg(F.min(F.col(value).cast("double")).alias("__lo"), F.max(F.col(value).cast("double")).alias("__hi"))
    return got.select(*by, "share", (F.col("__lo") + (F.col("__hi") - F.col("__lo")) * (F.col("__at") - F.floor("__at"))).alias(value))
