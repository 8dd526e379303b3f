"""Actors at a merchant that also use other merchants, seen from each transaction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.operators.causal import SLICE, before, swept
from skein.plans.durable import durable


def time_bucket(ts: Column, seconds: int) -> Column:
    return F.floor(ts / F.lit(seconds * 1_000_000)).cast("long")


def probe_buckets(ts: Column, seconds: int) -> Column:
    """The buckets in which what is at most ``seconds`` before ``ts`` can lie."""
    b = time_bucket(ts, seconds)
    return F.array(b - 1, b)


def _turns(rows: DataFrame, windows: tuple[int, ...], least: int) -> DataFrame:
    """(m, t, kind, ok, c{i}): when an actor starts (1) or stops (-1) to count at merchant m for window i.

    It counts while it has rows at m and ``least`` distinct merchants in the window.  An event of an actor changes that at its
    own merchant, and at others only where the number of merchants passes ``least``: there are least - 1 others then, so
    there are at most as many turns as ``least`` times the events, however many actors a merchant has.
    """
    every = range(len(windows))
    events = swept(rows, windows, "a").withColumns({f"k{i}": F.coalesce(F.sum(f"d{i}").over(before("a", "s", "m")), F.lit(0)) for i in every})
    had, has = (lambda i: F.col(f"k{i}") > 0), (lambda i: F.col(f"k{i}") + F.col(f"d{i}") > 0)
    events = events.withColumns({f"v{i}": has(i).cast("int") - had(i).cast("int") for i in every})
    last = F.last(F.when(F.col("leaves") == -1, F.col("m")), True).over(before("a", "s"))
    events = events.withColumns({f"u{i}": F.coalesce(F.sum(f"v{i}").over(before("a", "s")), F.lit(0)) for i in every} | {"last": last})
    wide, turned = (lambda i: F.col(f"u{i}") >= least), (lambda i: F.col(f"u{i}") + F.col(f"v{i}") >= least)
    events = events.withColumns({f"own{i}": (has(i) & turned(i)).cast("int") - (had(i) & wide(i)).cast("int") for i in every} | {f"turn{i}": turned(i).cast("int") - wide(i).cast("int") for i in every})
    # a slice's halo comes again: an event counts in the slice of its own time
    width = SLICE * max(windows) * 1_000_000
    here = F.floor(F.col("t") / F.lit(width)).cast("long") == F.col("s")
    some = lambda name: F.greatest(*[F.abs(F.col(f"{name}{i}")) for i in every], F.lit(0)) > 0
    own = events.where(here & some("own")).select("m", "t", "kind", "ok", *[F.col(f"own{i}").alias(f"c{i}") for i in every])
    if least < 2:
        return own
    if least == 2:  # rows leave in the order in which they came, so the one other merchant is that of the last row
        others = events.where(here & some("turn")).select(F.col("last").alias("m"), "t", "kind", "ok", *[F.col(f"turn{i}").alias(f"c{i}") for i in every])
        return own.unionByName(others)
    # turns are numbered; between two events of (actor, merchant) its presence is constant, and it meets the turns in between
    for i in every:
        at = events.withColumn("j", F.coalesce(F.sum(F.abs(f"turn{i}")).over(before("a", "s")), F.lit(0)))
        upto = F.coalesce(F.lead("j").over(Window.partitionBy("a", "s", "m").orderBy("t", "kind", "ok")), F.max(F.col("j") + F.abs(f"turn{i}")).over(Window.partitionBy("a", "s")))
        first = F.col("j") + F.abs(F.col(f"turn{i}")) + 1
        held = at.withColumn("upto", upto).where(has(i)).where(first <= F.col("upto")).select("a", "s", "m", F.explode(F.sequence(first, F.col("upto"))).alias("j"))
        turns = at.where(here & (F.col(f"turn{i}") != 0)).select("a", "s", (F.col("j") + 1).alias("j"), "t", "kind", "ok", *[(F.col(f"turn{i}") if i == x else F.lit(0)).alias(f"c{x}") for x in every])
        own = own.unionByName(held.join(turns, ["a", "s", "j"]).select(*own.columns))
    return own


def related(rows: DataFrame, actor: str, windows: tuple[int, ...], least: int = 2) -> DataFrame:
    """(transaction_id, ok, related_{w}): actors with an earlier row at the row's merchant within w seconds that have ``least``
    distinct merchants in that same time.  0 without any; null without a merchant.

    Two sweeps, no pairs: an actor's rows say when it starts and stops to count at a merchant, and running sums of that by
    merchant are what its rows see.  A merchant's time line is cut into slices, whose totals are summed in a small table.
    """
    every = range(len(windows))
    past = rows.select("ok", "ts_us", F.col("merchant_id").alias("m"), F.col(actor).alias("a")).where("m IS NOT NULL AND a IS NOT NULL")
    # read twice below, so they are written once
    turns = durable(_turns(past, windows, least), "turns").withColumn("seen", F.lit(False))
    seen = rows.where("merchant_id IS NOT NULL").select(F.col("merchant_id").alias("m"), F.col("ts_us").alias("t"), F.lit(0).alias("kind"), "ok", *[F.lit(0).alias(f"c{i}") for i in every], F.lit(True).alias("seen"))
    line = turns.unionByName(seen).withColumn("s", F.floor(F.col("t") / F.lit(max(windows) * 1_000_000)))
    # a row comes before what its own entering changes
    within = Window.partitionBy("m", "s").orderBy("t", "kind", "ok", F.col("seen").desc()).rowsBetween(Window.unboundedPreceding, -1)
    line = line.withColumns({f"in{i}": F.coalesce(F.sum(f"c{i}").over(within), F.lit(0)) for i in every})
    # a row a merchant and slice of time
    earlier = Window.partitionBy("m").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    whole = turns.groupBy("m", F.floor(F.col("t") / F.lit(max(windows) * 1_000_000)).alias("s")).agg(*[F.sum(f"c{i}").alias(f"c{i}") for i in every])
    slices = seen.groupBy("m", F.floor(F.col("t") / F.lit(max(windows) * 1_000_000)).alias("s")).agg(*[F.lit(0).alias(f"c{i}") for i in every])
    base = whole.unionByName(slices).groupBy("m", "s").agg(*[F.sum(f"c{i}").alias(f"c{i}") for i in every])
    base = base.select("m", "s", *[F.coalesce(F.sum(f"c{i}").over(earlier), F.lit(0)).alias(f"base{i}") for i in every])
    got = line.where("seen").join(base, ["m", "s"]).select("ok", *[(F.col(f"in{i}") + F.col(f"base{i}")).alias(f"__{i}") for i in every])
    return rows.select("transaction_id", "ok", "merchant_id").join(got, "ok", "left").select("transaction_id", "ok", *[F.when(F.col("merchant_id").isNotNull(), F.coalesce(f"__{i}", F.lit(0))).cast("long").alias(f"related_{w}") for i, w in enumerate(windows)])


def related_counts(rows: DataFrame, actor: str, seconds: int, least: int = 2) -> DataFrame:
    """:func:`related` for one window: (transaction_id, ok, related)."""
    return related(rows, actor, (seconds,), least).withColumnRenamed(f"related_{seconds}", "related")
