"""Strictly causal windows: what a transaction may know of its entity's past.

Order is (timestamp, transaction_id).  A window of W seconds before a row holds the rows
of its entity that come earlier in that order and whose time is at least t - W.  Range
frames over the time give what is strictly earlier; rows of the same time are added by
their place in the order, so any number of rows may share a timestamp.

Distinct values and entropies come from a sweep: each row enters the window at its own
place and leaves it when it expires, and running sums of what that changes replace
gathering the values of each frame.

An entity's time line is cut into slices (``sliced``): no entity's history is one task's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.plans.config import ENTITY_COLUMN

#: More than the rows of any table: (time, position) as one decimal number.
POSITIONS = 10**15
#: Slices are so many windows long; one window of each is repeated in the next.
SLICE = 8


def micros(df: DataFrame, column: str = "timestamp") -> Column:
    """Microseconds since 1970; a time without a zone is taken as UTC, whatever the session's zone."""
    if dict(df.dtypes)[column] == "timestamp_ntz":
        return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', `{column}`)")
    return F.unix_micros(column)


def ordered(tx: DataFrame) -> DataFrame:
    """``tx`` with ts_us and ok, the position in causal order from 0.

    Rows are counted by minute, minutes are summed, and rows are numbered within a minute,
    so no task sorts the whole table.  Rows without a time come first.
    """
    t = tx.withColumn("ts_us", micros(tx)).withColumn("__minute", F.coalesce(F.floor(F.col("ts_us") / F.lit(60_000_000)), F.lit(-(2**62))))
    # a row a minute: as many as the time has, however many rows there are
    earlier = Window.orderBy("__minute").rowsBetween(Window.unboundedPreceding, -1)
    minutes = t.groupBy("__minute").count().select(F.col("__minute").alias("__m"), F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("__before"))
    within = F.row_number().over(Window.partitionBy("__minute").orderBy("ts_us", "transaction_id")) - 1
    return t.withColumn("__in", within).join(minutes, F.col("__minute") == F.col("__m")).select(*tx.columns, "ts_us", (F.col("__in") + F.col("__before")).cast("long").alias("ok"))


def causal_order(tx: DataFrame) -> DataFrame:
    """transaction_id and its dense position from 0."""
    return tx.select("transaction_id", F.col("ok").alias("position"))


def channels(tx: DataFrame, low_value: float = 5.0) -> DataFrame:
    """Numeric channels: declined (0, 1 or null; unknown outcomes are an error) and low_value."""
    token = F.lower(F.trim("auth_outcome"))
    declined = F.when(token == "approved", 0.0).when(token == "declined", 1.0).when(token.isNull(), None).otherwise(F.raise_error(F.concat(F.lit("unknown outcome: "), token)).cast("double"))
    return tx.withColumn("declined", declined).withColumn("low_value", F.when(F.col("amount").isNotNull(), (F.col("amount") < low_value).cast("double")))


class Past:
    """Aggregates over the window of ``seconds`` before a row, by entity (or columns); None: all its past.

    Rows without the entity know nothing: null.
    """

    def __init__(self, entity: str | list[str], seconds: int | None, *by: str) -> None:
        keys = [ENTITY_COLUMN.get(e, e) for e in ([entity] if isinstance(entity, str) else entity)]
        self.known = F.lit(True)
        for k in keys:
            self.known = self.known & F.col(k).isNotNull()
        # rows without the entity are dealt over many partitions
        part = [*keys, *by, F.when(~self.known, F.pmod(F.col("ok"), F.lit(4096)))]
        low = Window.unboundedPreceding if seconds is None else -seconds * 1_000_000
        self.earlier = Window.partitionBy(*part).orderBy("ts_us").rangeBetween(low, -1)
        self.ties = Window.partitionBy(*part, "ts_us").orderBy("ok").rowsBetween(Window.unboundedPreceding, -1)
        self.names, self.by, self.seconds = keys, by, seconds

    def _both(self, c: Column) -> Column:
        return F.coalesce(c.over(self.earlier), F.lit(0)) + F.coalesce(c.over(self.ties), F.lit(0))

    def count(self) -> Column:
        return F.when(self.known, self._both(F.count(F.lit(1))))

    def sum(self, x: str) -> Column:
        return F.when(self.known, self._both(F.sum(x)).cast("double"))

    def mean(self, x: str) -> Column:
        n = self._both(F.count(x))
        return F.when(self.known & (n > 0), self._both(F.sum(x)) / n)

    def std(self, x: str) -> Column:
        """Sample deviation: both parts' squares, and that of the distance of their means."""
        n1, n2 = F.count(x).over(self.earlier), F.count(x).over(self.ties)
        n = n1 + n2
        apart = F.coalesce(F.avg(x).over(self.earlier) - F.avg(x).over(self.ties), F.lit(0.0))
        squares = F.coalesce(F.var_pop(x).over(self.earlier) * n1, F.lit(0.0)) + F.coalesce(F.var_pop(x).over(self.ties) * n2, F.lit(0.0)) + apart * apart * n1 * n2 / F.nullif(n, F.lit(0))
        return F.when(self.known & (n > 1), F.sqrt(squares / (n - 1)))

    def median(self, x: str) -> Column:
        """Over (time, position) as one decimal number, whose range frame is exact among equal times too."""
        keys = ", ".join(f"`{c}`" for c in (*self.names, *self.by))
        gone = " OR ".join(f"`{c}` IS NULL" for c in self.names)
        low = "UNBOUNDED" if self.seconds is None else f"CAST('{self.seconds * 1_000_000 * POSITIONS + POSITIONS - 1}' AS DECIMAL(38, 0))"
        at = f"CAST(ts_us AS DECIMAL(22, 0)) * CAST('{POSITIONS}' AS DECIMAL(16, 0)) + ok"
        over = f"(PARTITION BY {keys}, CASE WHEN {gone} THEN pmod(ok, 4096) END ORDER BY CAST({at} AS DECIMAL(38, 0)) RANGE BETWEEN {low} PRECEDING AND CAST('1' AS DECIMAL(38, 0)) PRECEDING)"
        return F.when(self.known, F.expr(f"percentile(`{x}`, 0.5D) OVER {over}"))


def sliced(tx: DataFrame, seconds: int, column: str = "slice", halo: str = "halo") -> DataFrame:
    """Rows by slice of their time line; those of its last ``seconds`` also in the next slice, as halo.

    With windows of at most ``seconds`` partitioned by (entity, slice) the rows that
    aren't halo see all of their past, and no entity's history is one task's.
    """
    width = SLICE * seconds * 1_000_000
    own = F.floor(F.col("ts_us") / F.lit(width)).cast("long")
    late = F.col("ts_us") - own * F.lit(width) >= F.lit(width - seconds * 1_000_000)
    places = F.array_compact(F.array(F.struct(own.alias("s"), F.lit(False).alias("h")), F.when(late, F.struct((own + 1).alias("s"), F.lit(True).alias("h")))))
    return tx.withColumn("__s", F.explode(places)).select(*tx.columns, F.col("__s.s").alias(column), F.col("__s.h").alias(halo))


def swept(rows: DataFrame, windows: tuple[int, ...], *by: str) -> DataFrame:
    """Rows (ok, ts_us, ...) as events in slices of their time: each enters at its own time ``t`` (kind 0, leaves -1) and
    leaves window i after t + windows[i] (kind 1, leaves i).  d{i} is what an event adds to the rows in window i.

    Events of a slice, by ``by`` and s, are in order by (t, kind, ok), and hold all that is needed at its own times.
    """
    cut = sliced(rows, max(windows), "s", "halo")
    ends = F.array(F.struct(F.lit(-1).alias("leaves"), F.col("ts_us").alias("t")), *[F.struct(F.lit(i).alias("leaves"), (F.col("ts_us") + F.lit(w * 1_000_000)).alias("t")) for i, w in enumerate(windows)])
    # one task has all of an entity's slice: what is partitioned by more columns needs no further exchange
    out = cut.repartition(*by, "s").withColumn("__l", F.explode(ends)).select(*[c for c in cut.columns if c != "ts_us"], "__l.leaves", "__l.t", (F.col("__l.leaves") >= 0).cast("int").alias("kind"))
    return out.withColumns({f"d{i}": F.when(F.col("leaves") == -1, 1).when(F.col("leaves") == i, -1).otherwise(0) for i in range(len(windows))})


def before(*by: str) -> Window:
    """The events of :func:`swept` that come before one."""
    return Window.partitionBy(*by).orderBy("t", "kind", "ok").rowsBetween(Window.unboundedPreceding, -1)


def history(tx: DataFrame, entity: str, windows: tuple[int, ...], of: tuple[str, ...] = (), kinds: tuple[str, ...] = (), least: int = 2) -> DataFrame:
    """What each row's entity did in each window before it, by running sums over one sweep; only rows with the entity are there.

    (ok, n_{w}); for columns of whole numbers in ``of`` (sum_{x}_{w}, count_{x}_{w}), for columns in ``kinds``
    (distinct_{x}_{w}, entropy_{x}_{w}).  Entropy is normalised, 0 to 1, and null for fewer than ``least`` distinct values.
    Null values don't count.  First running sums count a value's rows, the second add what each event changes, so an
    entity with many rows in a window costs no more for each than one with few.
    """
    at = {x: ENTITY_COLUMN.get(x, x) for x in kinds}
    rows = tx.select("ok", "ts_us", F.col(ENTITY_COLUMN.get(entity, entity)).alias("e"), *[F.col(x).cast("long").alias(f"of_{x}") for x in of], *[F.col(c).alias(f"x_{x}") for x, c in at.items()]).where("e IS NOT NULL")
    events, every = swept(rows, windows, "e"), range(len(windows))
    g = lambda k: F.when(k > 0, k * F.log(k.cast("double"))).otherwise(0.0)
    sums = {f"n_{w}": F.sum(f"d{i}") for i, w in enumerate(windows)}
    for x in of:
        v = F.col(f"of_{x}")
        for i, w in enumerate(windows):
            sums |= {f"sum_{x}_{w}": F.sum(F.coalesce(v, F.lit(0)) * F.col(f"d{i}")), f"count_{x}_{w}": F.sum(v.isNotNull().cast("int") * F.col(f"d{i}"))}
    for x in kinds:
        step = lambda i, x=x: F.when(F.col(f"x_{x}").isNull(), 0).otherwise(F.col(f"d{i}"))
        events = events.withColumns({f"k{i}": F.coalesce(F.sum(step(i)).over(before("e", "s", f"x_{x}")), F.lit(0)) for i in every})
        changes = {}
        for i in every:
            k, d = F.col(f"k{i}"), step(i)
            changes |= {f"d_{x}_{i}": d, f"u_{x}_{i}": (k + d > 0).cast("int") - (k > 0).cast("int"), f"g_{x}_{i}": F.when(d != 0, g(k + d) - g(k)).otherwise(0.0)}
        events = events.withColumns(changes).drop(f"x_{x}", *[f"k{i}" for i in every])
        sums |= {f"{c}_{x}_{i}_": F.sum(f"{c}_{x}_{i}") for c in "dug" for i in every}
    done = events.withColumns({n: F.coalesce(c.over(before("e", "s")), F.lit(0)) for n, c in sums.items()}).where("leaves = -1 AND NOT halo")
    out = [F.col(n) for n in sums if not n.endswith("_")]
    for x in kinds:
        for i, w in enumerate(windows):
            n, u, h = F.col(f"d_{x}_{i}_").cast("double"), F.col(f"u_{x}_{i}_"), F.col(f"g_{x}_{i}_")
            flat = (F.log(n) - h / n) / F.log(u.cast("double"))
            out += [u.cast("long").alias(f"distinct_{x}_{w}"), F.when(u >= max(2, least), F.least(F.lit(1.0), F.greatest(F.lit(0.0), flat))).alias(f"entropy_{x}_{w}")]
    return done.select("ok", *out)


def variety(tx: DataFrame, entity: str, x: str, windows: tuple[int, ...], least: int = 2) -> DataFrame:
    """(ok, distinct_{w}, entropy_{w}) of the values of ``x`` in each window before a row, as in :func:`history`."""
    return history(tx, entity, windows, (), (x,), least).select("ok", *[F.col(f"{m}_{x}_{w}").alias(f"{m}_{w}") for w in windows for m in ("distinct", "entropy")])


def lifetime(tx: DataFrame, entity: str, seconds: int = 86_400) -> DataFrame:
    """(ok, n): all rows of the entity before a row; whole slices are summed, rows are numbered within one."""
    rows = tx.select("ok", "ts_us", F.col(ENTITY_COLUMN.get(entity, entity)).alias("e")).where("e IS NOT NULL").withColumn("s", F.floor(F.col("ts_us") / F.lit(seconds * 1_000_000)))
    earlier = Window.partitionBy("e").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    base = rows.groupBy("e", "s").count().select("e", "s", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("base"))
    within = F.row_number().over(Window.partitionBy("e", "s").orderBy("ok")) - 1
    return rows.withColumn("i", within).join(base, ["e", "s"]).select("ok", (F.col("i") + F.col("base")).cast("long").alias("n"))
