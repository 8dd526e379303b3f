"""Groupings and scores against ground truth.  Nothing here feeds a feature or a score."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.numbers import cliffs_delta, effect, two_proportion_z, two_sided
from skein.operators.order import BUCKETS, ranks, running
from skein.operators.order import quantiles as quantiles_of
from skein.operators.scoring import stacked


def truth(df: DataFrame) -> DataFrame:
    """transaction_id, label, campaign_id: blank, NaN, None and <NA> all mean no campaign."""
    c = F.trim(F.coalesce(F.col("campaign_id").cast("string"), F.lit("")))
    none = F.lower(c).isin("", "nan", "none", "<na>")
    return df.select("transaction_id", F.col("label").cast("string").try_cast("int").alias("label"), F.when(none, "").otherwise(c).alias("campaign_id"))


def align(assigned: DataFrame, gt: DataFrame) -> DataFrame:
    """One row: ids on one side only, and repeated on either."""
    a, g = assigned.select("transaction_id"), gt.select("transaction_id")
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    again = lambda df, name: df.groupBy("transaction_id").count().agg(F.count_if(F.col("count") > 1).alias(name))
    return count(a.join(g, "transaction_id", "left_anti"), "only_assigned").crossJoin(count(g.join(a, "transaction_id", "left_anti"), "only_truth")).crossJoin(again(a, "repeated_assigned")).crossJoin(again(g, "repeated_truth"))


def group_table(joined: DataFrame) -> DataFrame:
    """One row a group: what campaigns it holds and how pure it is.  ``joined``: group_id, transaction_id, campaign_id."""
    by = joined.where("campaign_id <> ''").groupBy("group_id", "campaign_id").agg(F.count(F.lit(1)).alias("n"))
    first = F.min_by(F.struct("campaign_id", "n"), F.struct(-F.col("n"), F.col("campaign_id")))
    dom = by.groupBy("group_id").agg(F.sum("n").alias("campaign_transactions"), F.count(F.lit(1)).alias("n_distinct_campaigns"), first.alias("d"))
    t = joined.groupBy("group_id").agg(F.count(F.lit(1)).alias("size")).join(dom, "group_id", "left")
    t = t.select("group_id", "size", F.coalesce("campaign_transactions", F.lit(0)).alias("campaign_transactions"), F.coalesce("n_distinct_campaigns", F.lit(0)).alias("n_distinct_campaigns"), F.coalesce("d.campaign_id", F.lit("")).alias("dominant_campaign_id"), F.coalesce("d.n", F.lit(0)).alias("dominant_campaign_transactions"))
    t = t.withColumn("non_campaign_transactions", F.col("size") - F.col("campaign_transactions"))
    purity = F.when(F.col("campaign_transactions") == 0, "non_campaign").when(F.col("n_distinct_campaigns") >= 2, "mixed_campaign").when(F.col("non_campaign_transactions") > 0, "pure_campaign_with_normal").otherwise("pure_campaign")
    return t.withColumn("dominant_fraction_of_group", F.col("dominant_campaign_transactions") / F.col("size")).withColumn("largest_class_transactions", F.greatest("dominant_campaign_transactions", "non_campaign_transactions")).withColumn("purity_class", purity)


def campaign_table(joined: DataFrame) -> DataFrame:
    """One row a campaign: how much of it groups cover, over how many, and the group that holds most."""
    sizes = joined.groupBy("group_id").agg(F.count(F.lit(1)).alias("size"))
    per = joined.where("campaign_id <> ''").groupBy("campaign_id", "group_id").agg(F.count(F.lit(1)).alias("n")).join(sizes, "group_id")
    multi = F.col("size") >= 2
    best = F.min_by(F.when(multi, F.struct("group_id", "n")), F.when(multi, F.struct(-F.col("n"), F.col("group_id"))))
    t = per.groupBy("campaign_id").agg(F.sum("n").alias("campaign_transactions"), F.sum(F.when(multi, F.col("n")).otherwise(0)).alias("transactions_in_multi_groups"), F.count_if(multi).alias("n_multi_groups"), F.count(F.lit(1)).alias("n_groups_including_isolated"), best.alias("b"))
    t = t.select("*", F.coalesce("b.group_id", F.lit("")).alias("best_group_id"), F.coalesce("b.n", F.lit(0)).alias("best_group_transactions")).drop("b")
    share = F.col("best_group_transactions") / F.col("campaign_transactions")
    return t.withColumns({"transactions_isolated": F.col("campaign_transactions") - F.col("transactions_in_multi_groups"), "best_group_share": share, "is_represented": F.col("n_multi_groups") >= 1, "is_majority_captured": share >= 0.5})


def grouping_metrics(groups: DataFrame, campaigns: DataFrame) -> DataFrame:
    """One row: purity of groups and coverage of campaigns."""
    multi = F.col("size") >= 2
    g = groups.agg(F.count(F.lit(1)).alias("n_groups"), F.count_if(multi).alias("n_multi_groups"), F.count_if(multi & (F.col("campaign_transactions") > 0)).alias("n_attack_groups"), *[F.count_if(multi & (F.col("purity_class") == p)).alias(f"n_{p}") for p in ("non_campaign", "pure_campaign", "pure_campaign_with_normal", "mixed_campaign")], (F.sum("largest_class_transactions") / F.sum("size")).alias("purity"))
    c = campaigns.agg(F.count(F.lit(1)).alias("n_campaigns"), F.count_if("is_represented").alias("n_represented"), F.count_if("is_majority_captured").alias("n_majority_captured"), (F.sum("transactions_in_multi_groups") / F.sum("campaign_transactions")).alias("transaction_recall"), F.avg("n_multi_groups").alias("mean_fragmentation"))
    return g.crossJoin(c)


def sessions(tx: DataFrame, key: str, seconds: int) -> DataFrame:
    """(transaction_id, group_id): runs of a key's transactions with no gap over ``seconds``."""
    order = Window.partitionBy(key).orderBy("ok")
    gap = F.col("ts_us") - F.lag("ts_us").over(order)
    t = tx.select("transaction_id", key, "ts_us", "ok", gap.alias("gap")).withColumn("run", F.sum(F.when(F.col("gap").isNull() | (F.col("gap") > seconds * 1_000_000), 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return t.select("transaction_id", F.concat_ws("#", key, F.col("run").cast("string")).alias("group_id"))


def rank_auc(df: DataFrame, value: str = "value", label: str = "label", by: tuple[str, ...] = ()) -> DataFrame:
    """Area under the curve by average ranks, with its normal deviate corrected for ties; null values take no part.

    Ranks are of distinct values: what is summed is a row a value.
    """
    d = df.where(F.col(value).isNotNull() & F.col(label).isNotNull())
    r = running(d, value, {"n": F.count(F.lit(1)), "pos": F.count_if(F.col(label) == 1)}, by)
    rank, size = F.col("n_before") + (F.col("n") + 1) / 2.0, F.col("n").cast("double")
    t = r.groupBy(*by).agg(F.sum("pos").cast("double").alias("p"), F.sum(F.col("n") - F.col("pos")).cast("double").alias("q"), F.sum(rank * F.col("pos")).alias("s"), F.sum(size * (size * size - 1)).alias("ties"))
    u, m, n = F.col("s") - F.col("p") * (F.col("p") + 1) / 2, F.col("p") * F.col("q"), F.col("p") + F.col("q")
    sd = F.sqrt(m / 12 * ((n + 1) - F.col("ties") / F.nullif(n * (n - 1), F.lit(0.0))))
    return t.select(*by, F.when(m > 0, u / F.nullif(m, F.lit(0.0))).alias("auc"), F.when((m > 0) & (sd > 0), (u - m / 2) / F.nullif(sd, F.lit(0.0))).alias("z"), F.col("p").cast("long").alias("n_pos"), F.col("q").cast("long").alias("n_neg"))


def univariate_audit(features: DataFrame, names: list[str], flag: float = 0.75, support: int = 200) -> DataFrame:
    """By feature: AUC, its distance from chance in either direction, the AUC of being missing, and whether it is suspect."""
    long = stacked(features, names, "transaction_id", "label")
    a = rank_auc(long, by=("name",)).select("name", "auc", F.greatest("auc", 1 - F.col("auc")).alias("directed_auc"), (F.col("n_pos") + F.col("n_neg")).alias("support"))
    # two values have an area in closed form
    gone, pos = F.col("value").isNull(), F.col("label") == 1
    of = lambda c: F.count_if(c).cast("double")
    t = long.where("label IS NOT NULL").groupBy("name").agg(of(pos).alias("p"), of(~pos).alias("q"), of(pos & gone).alias("pg"), of(~pos & gone).alias("qg"))
    share = 0.5 + (F.col("pg") / F.nullif(F.col("p"), F.lit(0.0)) - F.col("qg") / F.nullif(F.col("q"), F.lit(0.0))) / 2
    return a.join(t.select("name", share.alias("missing_auc")), "name", "right").withColumn("suspect", F.coalesce((F.col("directed_auc") >= flag) & (F.col("support") >= support), F.lit(False)))


def ks(df: DataFrame, value: str = "value", label: str = "label") -> DataFrame:
    """Largest distance between the two distribution functions."""
    pos = F.col(label) == 1
    t = running(df.where(F.col(value).isNotNull()), value, {"p": F.count_if(pos), "q": F.count_if(~pos)})
    every = t.agg(F.sum("p").alias("__p"), F.sum("q").alias("__q"))
    share = lambda c: (F.col(f"{c}_before") + F.col(c)) / F.nullif(F.col(f"__{c}"), F.lit(0))
    return t.crossJoin(F.broadcast(every)).select(F.abs(share("p") - share("q")).alias("d")).agg(F.max("d").alias("ks"))


def _curve(df: DataFrame, score: str, label: str) -> DataFrame:
    """A row a distinct score: p and n there, tp and seen at or above it, and all positives."""
    t = running(df.withColumn("__down", -F.col(score)), "__down", {"p": F.sum(label), "n": F.count(F.lit(1))})
    every = t.agg(F.sum("p").cast("double").alias("all"))
    t = t.crossJoin(F.broadcast(every))
    d = lambda c: c.cast("double")
    return t.select((-F.col("__down")).alias(score), d(F.col("p")).alias("p"), d(F.col("n")).alias("n"), d(F.col("p_before") + F.col("p")).alias("tp"), d(F.col("n_before") + F.col("n")).alias("seen"), "all")


def average_precision(df: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """Precision at each distinct score weighted by the recall it adds, with the positives and all rows."""
    return _curve(df, score, label).agg(F.sum(F.col("p") / F.nullif(F.col("all"), F.lit(0.0)) * F.col("tp") / F.col("seen")).alias("average_precision"), F.max("all").cast("long").alias("n_pos"), F.sum("n").cast("long").alias("n"))


def average_precision_by(df: DataFrame, by: tuple[str, ...], score: str = "score", label: str = "label") -> DataFrame:
    """(by, ap): average precision of each group; 0 without positives."""
    t = running(df.withColumn("__down", -F.col(score)), "__down", {"p": F.sum(label), "n": F.count(F.lit(1))}, by)
    part = F.col("p") * (F.col("p_before") + F.col("p")) / (F.col("n_before") + F.col("n"))
    return t.groupBy(*by).agg(F.coalesce(F.sum(part) / F.nullif(F.sum("p"), F.lit(0)), F.lit(0.0)).alias("ap"))


def confusion(df: DataFrame, threshold: float, score: str = "score", label: str = "label") -> DataFrame:
    """Counts and rates at an inclusive threshold."""
    hit, pos = F.col(score) >= threshold, F.col(label) == 1
    t = df.agg(F.count_if(hit & pos).alias("tp"), F.count_if(hit & ~pos).alias("fp"), F.count_if(~hit & pos).alias("fn"), F.count_if(~hit & ~pos).alias("tn"))
    div = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))
    t = t.withColumns({"precision": div(F.col("tp").cast("double"), F.col("tp") + F.col("fp")), "recall": div(F.col("tp").cast("double"), F.col("tp") + F.col("fn"))})
    return t.withColumn("f1", F.coalesce(2 * F.col("precision") * F.col("recall") / F.nullif(F.col("precision") + F.col("recall"), F.lit(0.0)), F.lit(0.0)))


def precision_at(df: DataFrame, k: int, score: str = "score", label: str = "label", key: str = "candidate_id") -> DataFrame:
    top = df.orderBy(F.col(score).desc(), key).limit(k)
    return top.agg(F.lit(k).alias("k"), F.avg(F.col(label).cast("double")).alias("precision_at_k"))


def select_threshold(df: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """The score of best F1, the smallest of equals."""
    t = _curve(df, score, label)
    f1 = F.round(2 * F.col("tp") / F.nullif(F.col("seen") + F.col("all"), F.lit(0.0)), 12)
    return t.select(F.col(score).alias("threshold"), f1.alias("f1")).orderBy(F.col("f1").desc(), "threshold").limit(1)


def best_threshold(df: DataFrame, value: str = "value", label: str = "label", by: tuple[str, ...] = (), grid: int = 200) -> DataFrame:
    """By group: the single cut of largest Youden index (recall + specificity - 1; the smallest cut of equals) among ``grid`` + 1
    quantiles, on the side that rank order favours.  A description of these rows, not a rule that was validated."""
    d = df.where(F.col(value).isNotNull() & F.col(label).isNotNull()).withColumn("__x", F.col(value).cast("double"))
    pos = F.col(label) == 1
    cuts = quantiles_of(ranks(d, "__x", by), "__x", tuple(i / grid for i in range(grid + 1)), by).select(*by, "__x").distinct()
    # cuts join the values with counts of 0, and running sums say what lies below them
    both = d.select(*by, "__x", pos.cast("int").alias("p"), (~pos).cast("int").alias("q"), F.lit(0).alias("cut")).unionByName(cuts.select(*by, "__x", F.lit(0).alias("p"), F.lit(0).alias("q"), F.lit(1).alias("cut")))
    r = running(both, "__x", {c: F.sum(c) for c in ("p", "q", "cut")}, by)
    side = rank_auc(d, "__x", label, by).select(*by, (F.col("auc") >= 0.5).alias("above"), F.col("n_pos").alias("__p"), F.col("n_neg").alias("__q")).where("__p > 0 AND __q > 0")
    t = (r.join(F.broadcast(side), list(by)) if by else r.crossJoin(F.broadcast(side))).where("cut > 0")
    tp = F.when(F.col("above"), F.col("__p") - F.col("p_before")).otherwise(F.col("p_before") + F.col("p"))
    fp = F.when(F.col("above"), F.col("__q") - F.col("q_before")).otherwise(F.col("q_before") + F.col("q"))
    t = t.select(*by, "__x", "above", tp.alias("tp"), fp.alias("fp"), (tp / F.col("__p")).alias("recall"), (1 - fp / F.col("__q")).alias("specificity"))
    j = F.round(F.col("recall") + F.col("specificity") - 1, 12)
    best = F.max_by(F.struct(F.col("__x").alias("threshold"), F.when(F.col("above"), ">=").otherwise("<=").alias("rule"), F.col("tp").cast("long").alias("n_hits"), (F.col("tp") + F.col("fp")).cast("long").alias("n_flagged"), "recall", "specificity", j.alias("youden_j")), F.struct(j, -F.col("__x")))
    return t.groupBy(*by).agg(best.alias("b")).select(*by, "b.*")


def compare_numeric(df: DataFrame, names: list[str], flag: str, key: str = "candidate_id") -> DataFrame:
    """By column, rows with ``flag`` against those without: counts, means, medians, area under the curve, Cliff's delta and its
    word, p of the rank test and its false discovery rate."""
    long = stacked(df.withColumn("label", F.col(flag).cast("int")), names, key, "label")
    pos = F.col("label") == 1
    one = lambda f, c, n: f(F.when(c, F.col("value"))).alias(n)
    t = long.groupBy("name").agg(one(F.count, pos, "n_flagged"), one(F.count, ~pos, "n_other"), one(F.avg, pos, "mean_flagged"), one(F.avg, ~pos, "mean_other"))
    mid = quantiles_of(ranks(long.where("value IS NOT NULL"), "value", ("name", "label")), "value", (0.5,), ("name", "label"))
    m = mid.groupBy("name").agg(F.max(F.when(pos, F.col("value"))).alias("median_flagged"), F.max(F.when(~pos, F.col("value"))).alias("median_other"))
    a = rank_auc(long, by=("name",)).withColumn("cliffs_delta", cliffs_delta(F.col("auc"))).withColumn("effect", effect(F.col("cliffs_delta")))
    out = t.join(m, "name", "left").join(a.select("name", "auc", "cliffs_delta", "effect", two_sided(F.col("z")).alias("p")), "name", "left")
    return benjamini_hochberg(out)


def compare_boolean(df: DataFrame, names: list[str], flag: str, key: str = "candidate_id") -> DataFrame:
    """By yes-or-no column: its rates with and without ``flag``, their difference, the two-proportion test and its false discovery rate."""
    rows = F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).cast("boolean").alias("x")) for n in names])
    long = df.select(F.col(flag).cast("boolean").alias("f"), F.explode(rows).alias("r")).select("f", "r.*")
    f, x = F.col("f"), F.col("x")
    t = long.groupBy("name").agg(F.count_if(f & x).alias("a"), F.count_if(f).alias("n_flagged"), F.count_if(~f & x).alias("b"), F.count_if(~f).alias("n_other"))
    t = t.withColumns({"rate_flagged": F.col("a") / F.nullif(F.col("n_flagged"), F.lit(0)), "rate_other": F.col("b") / F.nullif(F.col("n_other"), F.lit(0)), "z": two_proportion_z(F.col("a"), F.col("n_flagged"), F.col("b"), F.col("n_other"))})
    return benjamini_hochberg(t.withColumn("difference", F.col("rate_flagged") - F.col("rate_other")).withColumn("p", two_sided(F.col("z"))).drop("a", "b"))


def prevalence_lift(df: DataFrame, names: list[str], flag: str) -> DataFrame:
    """By yes-or-no column: how many rows have it, the share of those with ``flag``, and its lift over all rows."""
    rows = F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).cast("boolean").alias("x")) for n in names])
    every = df.agg(F.avg(F.col(flag).cast("double")).alias("base"))
    t = df.select(F.col(flag).cast("double").alias("f"), F.explode(rows).alias("r")).select("f", "r.*").groupBy("name").agg(F.count_if("x").alias("n"), F.avg(F.when(F.col("x"), F.col("f"))).alias("rate"))
    return t.crossJoin(F.broadcast(every)).select("name", "n", "rate", (F.col("rate") / F.nullif(F.col("base"), F.lit(0.0))).alias("lift"))


def quantiles(df: DataFrame, column: str, by: str, shares: tuple[float, ...] = (0.05, 0.25, 0.5, 0.75, 0.95)) -> DataFrame:
    q = F.percentile(F.col(column).cast("double"), F.array(*map(F.lit, shares)))
    t = df.groupBy(by).agg(F.count(column).alias("n"), q.alias("q"))
    return t.select(by, "n", *[F.col("q")[i].alias(f"q{round(s * 100):02d}") for i, s in enumerate(shares)])


def rate_by(df: DataFrame, by: str, label: str = "label") -> DataFrame:
    """Share of positives by value and its lift over the whole."""
    t = df.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.sum(label).alias("n_attack"))
    every = Window.partitionBy()
    rate = F.col("n_attack") / F.col("n")
    return t.withColumn("rate", rate).withColumn("lift", rate / F.nullif(F.sum("n_attack").over(every) / F.sum("n").over(every), F.lit(0.0)))


def benjamini_hochberg(df: DataFrame, p: str = "p") -> DataFrame:
    """``df`` with q: the smallest false discovery rate at which a row is found; null p have none and count for none.

    Equal p are found together, so a row a distinct p is enough: its q is the least
    p * m / rank of it and of all larger ones.
    """
    place = running(df.where(F.col(p).isNotNull()), p, {"n": F.count(F.lit(1))})
    total = place.agg(F.sum("n").alias("__m"))
    raw = place.crossJoin(F.broadcast(total)).select(F.col(p).alias("__p"), (F.col(p) * F.col("__m") / (F.col("n_before") + F.col("n"))).alias("__raw"))
    # least of all larger p: whole buckets by a small table, the rest within
    return df.join(_least_after(raw, "__p", "__raw"), F.col(p) == F.col("__p"), "left").withColumn("q", F.when(F.col("__least").isNotNull(), F.least(F.lit(1.0), F.col("__least")))).drop("__p", "__least")


def _least_after(df: DataFrame, key: str, value: str, buckets: int = BUCKETS) -> DataFrame:
    """(key, __least): the least ``value`` of rows with that key or a larger one."""
    shares = F.array(*[F.lit((i + 1) / buckets) for i in range(buckets - 1)])
    cuts = df.agg(F.percentile_approx(key, shares, F.lit(20 * buckets)).alias("__cuts"))
    t = df.crossJoin(F.broadcast(cuts)).withColumn("__bucket", F.size(F.filter("__cuts", lambda c: c < F.col(key)))).drop("__cuts")
    later = Window.partitionBy(F.lit(0)).orderBy(F.col("__b").desc()).rowsBetween(Window.unboundedPreceding, -1)
    whole = t.groupBy(F.col("__bucket").alias("__b")).agg(F.min(value).alias("__low")).withColumn("__low", F.min("__low").over(later))
    within = Window.partitionBy("__bucket").orderBy(F.col(key).desc()).rowsBetween(Window.unboundedPreceding, 0)
    t = t.withColumn("__in", F.min(value).over(within)).join(F.broadcast(whole), F.col("__bucket") == F.col("__b"))
    return t.select(key, F.least("__in", "__low").alias("__least"))


def bootstrap_ci(scores: np.ndarray, labels: np.ndarray, clusters: np.ndarray, stat: Callable, n: int = 500, seed: int = 7) -> tuple[float, float]:
    """Percentile interval of ``stat`` over resampled clusters; for scored candidates, of which there are thousands."""
    g, names = np.random.default_rng(seed), np.unique(clusters)
    rows = {c: np.flatnonzero(clusters == c) for c in names}
    out = []
    for _ in range(n):
        at = np.concatenate([rows[c] for c in g.choice(names, len(names))])
        out.append(stat(scores[at], labels[at]))
    return float(np.nanquantile(out, 0.025)), float(np.nanquantile(out, 0.975))


def chronological_split(df: DataFrame, key: str, time: str, shares: tuple[float, float] = (0.70, 0.15)) -> DataFrame:
    """``df`` with split: train, validation or test by order of time; equal times stay together, on the side of their first."""
    place = running(df, time, {"__n": F.count(F.lit(1))}).select(F.col(time).alias("__t"), (F.col("__n_before") + 1).alias("__r"))
    n = df.agg(F.count(F.lit(1)).alias("__all"))
    t = df.join(place, F.col(time).eqNullSafe(F.col("__t"))).crossJoin(F.broadcast(n))
    a, b = F.round(F.col("__all") * shares[0]), F.round(F.col("__all") * (shares[0] + shares[1]))
    return t.withColumn("split", F.when(F.col("__r") <= a, "train").when(F.col("__r") <= b, "validation").otherwise("test")).select(*df.columns, "split")


def compare_groupings(primary: DataFrame, baseline: DataFrame) -> DataFrame:
    """(measure, primary, baseline, delta) of two rows of :func:`grouping_metrics`."""
    rows = F.array(*[F.struct(F.lit(c).alias("measure"), F.col(c).cast("double").alias("value")) for c in primary.columns])
    long = lambda df, name: df.select(F.explode(rows).alias("r")).select("r.measure", F.col("r.value").alias(name))
    return long(primary, "primary").join(long(baseline, "baseline"), "measure").withColumn("delta", F.col("primary") - F.col("baseline"))


def interval_overlaps(df: DataFrame, key: str, first: str, last: str) -> DataFrame:
    """Pairs (a, b), a before b by key, whose inclusive intervals overlap.

    An interval is dealt to the days it touches; a pair meets in the first day of both.
    """
    day = 86_400_000_000
    s = df.select(F.col(key).alias("k"), F.col(first).alias("f"), F.col(last).alias("l")).withColumn("d", F.explode(F.sequence(F.floor(F.col("f") / day), F.floor(F.col("l") / day))))
    a, b = (s.select(*[F.col(c).alias(f"{x}_{c}") for c in ("k", "f", "l")], "d") for x in "ab")
    meet = F.floor(F.greatest("a_f", "b_f") / day) == F.col("d")
    return a.join(b, "d").where((F.col("a_k") < F.col("b_k")) & (F.col("a_f") <= F.col("b_l")) & (F.col("b_f") <= F.col("a_l")) & meet).select(F.col("a_k").alias("a"), F.col("b_k").alias("b"))


def group_summary(groups: DataFrame) -> DataFrame:
    """Groups of two or more by purity: how many, their transactions, their share."""
    t = groups.where("size >= 2").groupBy("purity_class").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("n_transactions"))
    return t.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def campaign_metrics(members: DataFrame, scored: DataFrame, threshold: float) -> DataFrame:
    """One row: campaigns, those that an alert touches, alerts, and alerts that touch none.

    ``members``: candidate_id and campaign_id by transaction.
    """
    hit = members.join(scored, "candidate_id", "left").withColumn("hit", F.coalesce(F.col("score") >= threshold, F.lit(False)))
    real = F.col("campaign_id") != ""
    of = lambda cond, c: F.count_distinct(F.when(cond, F.col(c)))
    t = hit.agg(of(real, "campaign_id").alias("n_campaigns"), of(real & F.col("hit"), "campaign_id").alias("n_detected"), of(F.col("hit"), "candidate_id").alias("n_alerts"), of(F.col("hit") & real, "candidate_id").alias("n_true"))
    return t.select("n_campaigns", "n_detected", (F.col("n_detected") / F.nullif(F.col("n_campaigns"), F.lit(0))).alias("campaign_recall"), "n_alerts", (F.col("n_alerts") - F.col("n_true")).alias("n_false_alerts"))


def comparators(features: DataFrame, by: dict[str, str], seed: int | None = None) -> DataFrame:
    """candidate_id and, for each name, the average rank of a column as a share; with a seed also ``by_chance``, a random ranker."""
    if seed is not None:
        features, by = features.withColumn("__chance", F.xxhash64(F.lit(seed), "candidate_id")), {**by, "by_chance": "__chance"}
    long = stacked(features, list(by.values()), "candidate_id")
    place = ranks(long, "value", ("name",)).select(F.col("name").alias("__name"), F.col("value").alias("__value"), "rank")
    n = features.agg(F.count(F.lit(1)).alias("__n"))
    got = long.join(place, (F.col("name") == F.col("__name")) & F.col("value").eqNullSafe(F.col("__value"))).crossJoin(F.broadcast(n))
    wide = got.withColumn("share", F.col("rank") / F.col("__n")).groupBy("candidate_id").pivot("name", list(by.values())).agg(F.first("share"))
    return wide.select("candidate_id", *[F.col(c).alias(name) for name, c in by.items()])


def recall_exchange(df: DataFrame, budgets: tuple[float, ...] = (0.01, 0.02, 0.05, 0.10), score: str = "score", label: str = "label") -> DataFrame:
    """By alert budget: the score that it buys, alerts and hits."""
    cut = df.agg(F.percentile(score, F.array(*[F.lit(1 - b) for b in budgets])).alias("t"))
    rows = cut.select(F.explode(F.arrays_zip(F.array(*map(F.lit, budgets)).alias("budget"), F.col("t").alias("threshold"))).alias("x")).select("x.budget", "x.threshold")
    hit = F.col(score) >= F.col("threshold")
    return df.crossJoin(F.broadcast(rows)).groupBy("budget", "threshold").agg(F.count_if(hit).alias("n_alerts"), F.count_if(hit & (F.col(label) == 1)).alias("n_hits"))


def attach_groups(assigned: DataFrame, gt: DataFrame) -> DataFrame:
    """By candidate: its campaign and other transactions, campaigns and positives."""
    j = assigned.select("transaction_id", "candidate_id").join(gt, "transaction_id")
    real = F.col("campaign_id") != ""
    return j.groupBy("candidate_id").agg(F.count_if(real).alias("campaign_transactions"), F.count_if(~real).alias("non_campaign_transactions"), F.count_distinct(F.when(real, F.col("campaign_id"))).alias("n_distinct_campaigns"), F.sum("label").alias("label1_transactions"), (F.count_if(real) > 0).alias("is_attack_containing"))
