"""Perturbed worlds: a table after a perturbation, proof of what it changed, and what the detector makes of it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.operators import candidates, causal, evaluation, scoring, validate
from skein.plans.config import CandidateConfig
from skein.plans.durable import durable


class WorldError(ValueError):
    """A perturbation that changed what it may not."""


@dataclass(frozen=True)
class World:
    """A perturbed table with the counts of what was removed, added and relabelled."""

    name: str
    rows: DataFrame
    removed: int
    added: int
    relabelled: int
    added_positive: int


def compose(*steps: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    """One perturbation of several, in order."""

    def run(df: DataFrame) -> DataFrame:
        for s in steps:
            df = s(df)
        return df

    return run


def build(baseline: DataFrame, name: str, transform: Callable[[DataFrame], DataFrame], removals: bool = False, additions: bool = True, positives: bool = False) -> World:
    """The world of a perturbation; an error if columns change, ids repeat, labels change, or rows come and go unasked."""
    after = durable(transform(baseline), f"world-{name}")
    if after.columns != baseline.columns:
        raise WorldError(f"{name}: columns changed from {baseline.columns} to {after.columns}")
    if after.groupBy("transaction_id").count().where("count > 1").limit(1).count():
        raise WorldError(f"{name}: an id repeats")
    r = validate.labels_preserved(baseline, after).first()
    world = World(name, after, r["n_removed"], r["n_added"], r["n_relabelled"], r["n_added_positive"])
    wrong = [w for w, bad in (("labels", world.relabelled), ("removals", world.removed and not removals), ("additions", world.added and not additions), ("new positives", world.added_positive and not positives)) if bad]
    if wrong:
        raise WorldError(f"{name}: not allowed to change {wrong}")
    return world


def rebuild(rows: DataFrame, ref: scoring.ScorerReference, table: DataFrame, config: CandidateConfig | None = None) -> tuple[DataFrame, DataFrame]:
    """(assignments, scored candidates) of a table by the engine's own functions, against a frozen reference."""
    t = causal.ordered(rows.drop("ok", "ts_us"))
    a = durable(candidates.assignments(candidates.components(t, config), config), "world-assigned")
    return a, scoring.transform(scoring.scoring_features(t, a, config=config), ref, table)


def outcome(world: World, ref: scoring.ScorerReference, table: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row: the arm, its rows and candidates, and campaign metrics at a threshold."""
    a, scored = rebuild(world.rows, ref, table)
    truth = evaluation.truth(world.rows)
    members = truth.join(a.select("transaction_id", "candidate_id"), "transaction_id")
    sizes = a.groupBy("candidate_id").count().agg(F.sum("count").alias("n_transactions"), F.count(F.lit(1)).alias("n_candidates"), F.count_if(F.col("count") > 1).alias("n_multi"), F.max("count").alias("largest"))
    m = evaluation.campaign_metrics(members, scored.select("candidate_id", F.round("score", 6).alias("score")), threshold)
    mean = scored.agg(F.avg("score").alias("mean_score"))
    return sizes.crossJoin(m).crossJoin(mean).withColumn("arm", F.lit(world.name))


def parity(rows: DataFrame, assigned: DataFrame, config: CandidateConfig | None = None) -> DataFrame:
    """One row: assignments that rebuilding the unperturbed table gives differently.  Must be 0."""
    t = causal.ordered(rows.drop("ok", "ts_us"))
    again = candidates.assignments(candidates.components(t, config), config)
    j = assigned.select("transaction_id", F.col("candidate_id").alias("a")).join(again.select("transaction_id", F.col("candidate_id").alias("b")), "transaction_id", "full_outer")
    return j.agg(F.count_if(~F.col("a").eqNullSafe(F.col("b"))).alias("n_differ"))


def deltas(arms: DataFrame, control: str) -> DataFrame:
    """(arm, measure, value, control, delta): each arm's numbers against the control arm's."""
    names = [c for c, t in arms.dtypes if c != "arm"]
    rows = F.array(*[F.struct(F.lit(c).alias("measure"), F.col(c).cast("double").alias("value")) for c in names])
    long = arms.select("arm", F.explode(rows).alias("r")).select("arm", "r.*")
    base = long.where(F.col("arm") == control).select("measure", F.col("value").alias("control"))
    return long.where(F.col("arm") != control).join(F.broadcast(base), "measure").select("arm", "measure", "value", "control", (F.col("value") - F.col("control")).alias("delta"))
