"""The causal feature columns: six groups, declared and computed from one list."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions.numbers import gate, safe_div
from skein.operators.causal import Past, channels, history, lifetime, ordered, sliced
from skein.operators.related import related
from skein.operators.scoring import stacked
from skein.plans.config import ENTITY_COLUMN, GROUND_TRUTH, GROUPS, FeatureConfig
from skein.plans.durable import durable, settle


class Known:
    """What is known of each entity's past, as columns that are asked for by name and computed once."""

    #: Columns of whole numbers, whose sums are exact whatever is added and taken away.
    WHOLE = ("declined", "low_value")

    def __init__(self, config: FeatureConfig) -> None:
        self.config = config
        self.windows: dict[str, Callable[[str], Column]] = {}
        self.entity: dict[str, str] = {}
        self.swept: dict[str, dict[str, str]] = {}
        self.lives: set[str] = set()
        self.related: dict[str, set[int]] = {}

    def _ask(self, name: str, entity: str, make: Callable[[str], Column]) -> Column:
        self.windows[name], self.entity[name] = make, entity
        return F.col(name)

    def _sweep(self, e: str, what: str) -> Column:
        """A column of :func:`history`."""
        self.swept.setdefault(e, {})[what] = f"__{e}_{what}"
        return F.col(f"__{e}_{what}")

    def n(self, e: str, w: int) -> Column:
        return self._sweep(e, f"n_{w}")

    def of(self, kind: str, e: str, w: int, x: str = "amount") -> Column:
        """``kind``: sum, mean, std or median of a numeric column."""
        if x in self.WHOLE and kind in ("sum", "mean"):
            total = self._sweep(e, f"sum_{x}_{w}").cast("double")
            return total if kind == "sum" else total / F.nullif(self._sweep(e, f"count_{x}_{w}"), F.lit(0))
        return self._ask(f"__{kind}_{x}_{e}_{w}", e, lambda s: getattr(Past(e, w, s), kind)(x))

    def distinct(self, e: str, x: str, w: int) -> Column:
        return self._sweep(e, f"distinct_{x}_{w}")

    def entropy(self, e: str, x: str, w: int) -> Column:
        return self._sweep(e, f"entropy_{x}_{w}")

    def life(self, e: str) -> Column:
        self.lives.add(e)
        return F.col(f"__life_{e}")

    def others(self, e: str, w: int) -> Column:
        self.related.setdefault(e, set()).add(w)
        return F.col(f"__related_{e}_{w}")


@dataclass(frozen=True)
class Feature:
    """One column: how it is computed and what it means."""

    name: str
    group: str
    entity: str
    window: int | None
    value: Callable[[Known], Column]
    low: float | None
    high: float | None
    purpose: str


def _amounts(c: FeatureConfig, e: str, w: int) -> Iterator[Feature]:
    x = F.col
    f = lambda part, v, lo, why: Feature(f"amt_{e}_{part}_{w}s", "amount", e, w, v, lo, None, why)
    yield f("mean", lambda k: k.of("mean", e, w), None, "mean amount before")
    yield f("median", lambda k: k.of("median", e, w), None, "median amount before")
    yield f("std", lambda k: gate(k.of("std", e, w), k.n(e, w), c.min_history), 0.0, "spread of amounts before")
    yield f("dev", lambda k: F.when(x("amount").isNotNull(), x("amount") - k.of("mean", e, w)), None, "distance from the mean before")
    yield f("z", lambda k: gate(safe_div(x("amount") - k.of("mean", e, w), k.of("std", e, w), c.eps), k.n(e, w), c.min_history), None, "distance in deviations")
    yield f("cv", lambda k: gate(safe_div(k.of("std", e, w), k.of("mean", e, w), c.eps), k.n(e, w), c.min_history), None, "relative spread before")


def _amount(c: FeatureConfig) -> Iterator[Feature]:
    for w in c.of("amount"):
        for e in ("card", "device"):
            yield from _amounts(c, e, w)
        yield Feature(f"amt_card_low_value_ratio_{w}s", "amount", "card", w, lambda k, w=w: gate(k.of("mean", "card", w, "low_value"), k.n("card", w), c.min_history), 0.0, 1.0, "share of small amounts before")


def _bin(c: FeatureConfig) -> Iterator[Feature]:
    kinds = (("bin_distinct_cards", "bin", "card", "cards"), ("bin_distinct_merchants", "bin", "merchant", "merchants"), ("dev_distinct_bins", "device", "bin", "bins"), ("ip_distinct_bins", "ip", "bin", "bins"))
    for w in c.of("bin"):
        yield Feature(f"bin_txn_count_{w}s", "bin", "bin", w, lambda k, w=w: k.n("bin", w), 0, None, "rows of the bin before")
        for name, e, x, what in kinds:
            yield Feature(f"{name}_{w}s", "bin", e, w, lambda k, e=e, x=x, w=w: k.distinct(e, x, w), 0, None, f"{what} of the {e} before")


def _decline(c: FeatureConfig) -> Iterator[Feature]:
    for w in c.of("decline"):
        for e in ("card", "device", "ip", "merchant"):
            yield Feature(f"dec_{e}_rate_{w}s", "decline", e, w, lambda k, e=e, w=w: gate(safe_div(k.of("sum", e, w, "declined"), k.n(e, w).cast("double"), c.eps), k.n(e, w), c.min_history), 0.0, 1.0, "share of declines before")


def _device(c: FeatureConfig) -> Iterator[Feature]:
    yield Feature("dev_reuse_prior_total", "device", "device", None, lambda k: k.life("device"), 0, None, "all rows of the device before")
    for w in c.of("device"):
        yield Feature(f"dev_distinct_cards_{w}s", "device", "device", w, lambda k, w=w: k.distinct("device", "card", w), 0, None, "cards of the device before")


def _merchant(c: FeatureConfig) -> Iterator[Feature]:
    for w in c.of("merchant"):
        yield Feature(f"mer_txn_count_{w}s", "merchant", "merchant", w, lambda k, w=w: k.n("merchant", w), 0, None, "rows of the merchant before")
        for e in ("card", "device", "ip"):
            yield Feature(f"{e}_distinct_merchants_{w}s", "merchant", e, w, lambda k, e=e, w=w: k.distinct(e, "merchant", w), 0, None, "merchants of the entity before")
            yield Feature(f"{e}_merchant_spread_{w}s", "merchant", e, w, lambda k, e=e, w=w: gate(k.distinct(e, "merchant", w) / F.nullif(k.n(e, w), F.lit(0)), k.n(e, w), c.min_prior_for_ratio), 0.0, 1.0, "merchants by row before")
            yield Feature(f"{e}_merchant_entropy_{w}s", "merchant", e, w, lambda k, e=e, w=w: k.entropy(e, "merchant", w), 0.0, 1.0, "evenness over merchants before")
        for e in ("device", "ip"):
            yield Feature(f"merchant_related_{e}s_{w}s", "merchant", "merchant", w, lambda k, e=e, w=w: k.others(e, w), 0, None, "entities of this merchant that also use others")


def _velocity(c: FeatureConfig) -> Iterator[Feature]:
    w = c.of("velocity")
    narrow, wide = w[0], w[-1]
    for e in ("card", "device", "ip"):
        for x in w:
            yield Feature(f"vel_{e}_count_{x}s", "velocity", e, x, lambda k, e=e, x=x: k.n(e, x), 0, None, "rows of the entity before")
            if c.emit_rate_per_min:
                yield Feature(f"vel_{e}_rate_per_min_{x}s", "velocity", e, x, lambda k, e=e, x=x: k.n(e, x) * 60.0 / x, 0.0, None, "rows a minute before")
        yield Feature(f"vel_{e}_burst_density_{narrow}s_{wide}s", "velocity", e, wide, lambda k, e=e: safe_div(k.n(e, narrow).cast("double"), k.n(e, wide) * float(narrow) / float(wide), c.eps), 0.0, None, "late rows against an even pace")


_BUILD = dict(zip(GROUPS, (_amount, _bin, _decline, _device, _merchant, _velocity), strict=True))


def declared(config: FeatureConfig, groups: tuple[str, ...] = GROUPS) -> list[Feature]:
    """All features of the groups; a name that is declared twice is an error."""
    out = [f for g in groups for f in _BUILD[g](config)]
    names = [f.name for f in out]
    if len(set(names)) < len(names):
        raise ValueError(f"declared twice: {sorted({n for n in names if names.count(n) > 1})}")
    return out


def feature_table(tx: DataFrame, config: FeatureConfig, groups: tuple[str, ...] = GROUPS, only: tuple[str, ...] | None = None) -> DataFrame:
    """transaction_id and every feature of ``groups``, or ``only`` some of them; ground truth columns are never read.

    Windows are partitioned by (entity, slice of time).  What is known of an entity is computed on the few columns that it
    needs and written, so no plan is larger than one entity's; at last these tables are joined by position.
    """
    base = channels(ordered(tx.drop(*GROUND_TRUTH)), config.low_value_amount)
    # every part below starts from these few columns, so they are written once
    base = durable(base.select("ok", "transaction_id", "ts_us", *ENTITY_COLUMN.values(), "amount", "declined", "low_value"), "causal")
    feats, known = [f for f in declared(config, groups) if only is None or f.name in only], Known(config)
    values = {f.name: f.value(known) for f in feats}
    every = tuple(sorted({w for g in groups for w in config.of(g)}))
    part = lambda t, names: durable(t.select(F.col("ok").alias("__ok"), *[F.col(a).alias(b) for a, b in names.items()]), "part")
    parts = []
    for entity in ENTITY_COLUMN:
        own = {name: make("__slice") for name, make in known.windows.items() if known.entity[name] == entity}
        if own:
            cut = sliced(base, every[-1], "__slice", "__halo")
            parts.append(part(cut.withColumns(own).where("NOT __halo"), {n: n for n in own}))
        asked = known.swept.get(entity, {})
        if asked:
            kinds = tuple(x for x in ENTITY_COLUMN if any(a.startswith((f"distinct_{x}_", f"entropy_{x}_")) for a in asked))
            of = tuple(x for x in Known.WHOLE if any(a.startswith(f"sum_{x}_") for a in asked))
            parts.append(part(history(base, entity, every, of, kinds, config.min_distinct_for_entropy), asked))
    parts += [part(lifetime(base, e), {"n": f"__life_{e}"}) for e in sorted(known.lives)]
    for e, windows in sorted(known.related.items()):
        parts.append(part(related(base, ENTITY_COLUMN[e], tuple(sorted(windows)), config.related_entity_min_merchants), {f"related_{w}": f"__related_{e}_{w}" for w in sorted(windows)}))
    out = base.select("ok", "transaction_id", "amount")
    for p in parts:
        # both sides grow with the input: never gathered at the driver for a broadcast
        out = out.join(p.hint("merge"), out["ok"] == p["__ok"], "left").drop("__ok")
    return out.select("transaction_id", *[v.alias(n) for n, v in values.items()])


def dictionary(spark: SparkSession, config: FeatureConfig) -> DataFrame:
    """One row a feature: its declaration."""
    rows = [(f.name, f.group, f.entity, f.window, f.low, f.high, f.purpose) for f in declared(config)]
    rows = [(n, g, e, w, None if lo is None else float(lo), None if hi is None else float(hi), p) for n, g, e, w, lo, hi, p in rows]
    return spark.createDataFrame(rows, "name string, `group` string, entity string, window int, range_low double, range_high double, purpose string")


def chunks(names: list[str], size: int = 13) -> list[list[str]]:
    """``names`` in parts, so that neither a plan nor what a step sets aside grows with all columns at once."""
    return [names[i : i + size] for i in range(0, len(names), size)]


def observed(features: DataFrame) -> DataFrame:
    """One row a feature: name, n, n_null, min, max and n_unique, the number of distinct values.

    Rows are first summed by (feature, value), a few features at a time, as there may be as many values as rows.
    """
    out = None
    for names in chunks([c for c in features.columns if c != "transaction_id"]):
        none = features.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, names))).alias("name"), F.lit(None).cast("double").alias("value"), F.lit(0).cast("long").alias("n"))  # of an empty table
        by = stacked(features, names).groupBy("name", "value").agg(F.count(F.lit(1)).alias("n")).unionByName(none)
        one = by.groupBy("name").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("value").isNull(), F.col("n")).otherwise(0)).alias("n_null"), F.min("value").alias("min"), F.max("value").alias("max"), F.count("value").alias("n_unique"))
        one = durable(one, "observed")
        settle(features.sparkSession)
        out = one if out is None else out.unionByName(one)
    return out


def out_of_range(features: DataFrame, config: FeatureConfig) -> DataFrame:
    """One row a feature with a declared range: how many values leave it."""
    feats = {f.name: f for f in declared(config) if f.name in features.columns and (f.low is not None or f.high is not None)}
    bad = lambda f: (F.col(f.name) < f.low if f.low is not None else F.lit(False)) | (F.col(f.name) > f.high if f.high is not None else F.lit(False))
    return by_feature(features, list(feats), lambda n: {"n_bad": F.count_if(bad(feats[n]))})


def by_feature(features: DataFrame, names: list[str], make: Callable[[str], dict[str, Column]]) -> DataFrame:
    """One row a feature: its name and aggregates, from one pass over each few columns."""
    out = None
    for part in chunks(names, 26):
        one = features.agg(*[F.struct(F.lit(n).alias("name"), *[c.alias(k) for k, c in make(n).items()]).alias(n) for n in part])
        one = one.select(F.explode(F.array(*[F.col(n) for n in part])).alias("f")).select("f.*")
        out = one if out is None else out.unionByName(one)
    return out
