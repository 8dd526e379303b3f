"""Weights of the scorer by coordinate ascent, on training rows only; folds that keep campaigns whole."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.operators import evaluation, scoring
from skein.plans.durable import durable

#: The weights that are tried, and how often all features are gone through.
WEIGHT_GRID, PASSES = (0.0, 0.5, 1.0, 1.5, 2.0), 3


def grouped_folds(df: DataFrame, group: str = "dominant_campaign_id", folds: int = 5, seed: int = 0) -> DataFrame:
    """``df`` with fold: rows of a campaign never part; rows without one are dealt by a hash of their candidate."""
    own = F.when(F.coalesce(F.col(group), F.lit("")) != "", F.concat(F.lit("g:"), F.col(group))).otherwise(F.concat(F.lit("c:"), F.col("candidate_id")))
    return df.withColumn("fold", F.pmod(F.xxhash64(F.lit(seed), own), F.lit(folds)).cast("int"))


def tune_weights(train: DataFrame, signs: dict[str, float], label: str = "label", grid: tuple[float, ...] = WEIGHT_GRID, passes: int = PASSES) -> dict[str, float]:
    """Weights of largest average precision over ``train`` (candidate_id, features, label), from equal ones.

    Percentiles are computed once: a trial only weighs them anew, and all trials of a
    feature are one job.  A weight changes only if it gains more than 1e-12, so equal inputs give equal weights.
    """
    names = list(signs)
    ref, table = scoring.fit(train.drop(label), signs)
    s = scoring.transform(train, ref, table).select("candidate_id", *[(F.col(f"contrib_{n}") * len(names)).alias(n) for n in names])
    p = durable(s.join(train.select("candidate_id", F.col(label).cast("int").alias("label")), "candidate_id"), "tuning")

    def worth(trials: list[dict[str, float]]) -> list[float]:
        score = lambda w: F.round(sum((F.col(n) * F.lit(w[n]) for n in names), F.lit(0.0)) / sum(w.values()), 12)
        rows = F.array(*[F.struct(F.lit(i).alias("trial"), score(w).alias("score")) for i, w in enumerate(trials)])
        long = p.select("label", F.explode(rows).alias("t")).select("label", "t.*")
        got = {r["trial"]: r["ap"] for r in evaluation.average_precision_by(long, ("trial",)).collect()}  # a row a trial
        return [got.get(i) or 0.0 for i in range(len(trials))]

    weights = dict.fromkeys(names, 1.0)
    best = worth([weights])[0]
    for _ in range(passes):
        changed = False
        for n in names:
            trials = [t for w in grid if w != weights[n] and sum((t := {**weights, n: w}).values()) > 0]
            for trial, value in zip(trials, worth(trials), strict=True):
                if value > best + 1e-12:
                    best, weights, changed = value, trial, True
        if not changed:
            break
    return weights


def out_of_fold(features: DataFrame, signs: dict[str, float], folds: int = 5, seed: int = 0, weights: dict[str, float] | None = None, group: str = "dominant_campaign_id") -> DataFrame:
    """(candidate_id, fold, score): each candidate scored against a reference of the other folds only."""
    dealt = durable(grouped_folds(features, group, folds, seed), "folds")
    out = None
    for k in range(folds):
        rest = dealt.where(F.col("fold") != k).select("candidate_id", *signs)
        ref, table = scoring.fit(rest, signs, weights)
        s = scoring.transform(dealt.where(F.col("fold") == k), ref, table).select("candidate_id", F.lit(k).alias("fold"), "score")
        out = s if out is None else out.unionByName(s)
    return out
