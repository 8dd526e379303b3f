"""Audits that come after the fact: leakage, alignment, invariance.  Each returns counts or named checks as rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.operators.features import by_feature, declared, feature_table
from skein.plans.config import GROUND_TRUTH, GROUPS, FeatureConfig
from skein.plans.durable import durable


def alignment(features: DataFrame, dataset: DataFrame) -> DataFrame:
    """One row: rows, repeated ids, ids on one side only, missing and non-binary labels.  All but the first two must be 0."""
    f = features.groupBy("transaction_id").agg(F.count(F.lit(1)).alias("nf"))
    label = F.col("label").cast("string").try_cast("double")
    d = dataset.groupBy("transaction_id").agg(F.count(F.lit(1)).alias("nd"), F.count_if(label.isNull()).alias("missing"), F.count_if(label.isNotNull() & ~label.isin(0.0, 1.0)).alias("odd"))
    j = f.join(d, "transaction_id", "full_outer")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return j.agg(
        total("nf").alias("n_features"), total("nd").alias("n_dataset"), total(F.col("nf") - 1).alias("repeated_features"), total(F.col("nd") - 1).alias("repeated_dataset"),
        F.count_if(F.col("nd").isNull()).alias("only_features"), F.count_if(F.col("nf").isNull()).alias("only_dataset"), total("missing").alias("missing_labels"), total("odd").alias("non_binary_labels"),
    )


def aligned_load(features: DataFrame, dataset: DataFrame, carry: tuple[str, ...] = ("label", "timestamp")) -> DataFrame:
    """Features with the columns of the dataset that training needs, one to one; an error if the ids don't match one to one."""
    row = alignment(features, dataset).first()
    bad = {k: row[k] for k in row.asDict() if not k.startswith("n_") and row[k]}
    if bad:
        raise ValueError(f"features and dataset are not aligned: {bad}")
    return features.join(dataset.select("transaction_id", *[c for c in carry if c in dataset.columns]), "transaction_id")


def finite(features: DataFrame) -> DataFrame:
    """(name, n_null, n_nan, n_inf) by feature."""
    x = lambda n: F.col(n).cast("double")
    counts = lambda n: {"n_null": F.count_if(x(n).isNull()), "n_nan": F.count_if(F.isnan(x(n))), "n_inf": F.count_if(F.abs(x(n)) == float("inf"))}
    return by_feature(features, [c for c in features.columns if c != "transaction_id"], counts)


def leakage_audit(features: DataFrame, dataset: DataFrame, split: DataFrame, config: FeatureConfig, suspects: DataFrame | None = None, predictors: list[str] | None = None) -> DataFrame:
    """(check, n_bad, ok): seven checks of a feature table before a model may be trust in it.

    forbidden_inputs: ground truth or time among the columns or predictors; alignment: what
    :func:`alignment` counts against; declared_features: columns that are not declared,
    declared ones that are missing, and infinite cells; temporal_order: rows of an earlier part
    that are later than one of a later part (``split``: transaction_id, ts_us, split);
    split_once: ids in no or several parts; ground_truth_in_names: features named after
    ground truth; suspicious_signal: features that :func:`univariate_audit` suspects.
    """
    spark = features.sparkSession
    columns = [c for c in features.columns if c != "transaction_id"]
    banned = {*GROUND_TRUTH, "timestamp", "ts_us"}
    wanted = {f.name for f in declared(config)}
    forbidden = len(banned & {*columns, *(predictors or [])})
    undeclared = len(set(columns) ^ wanted)
    named = sum(any(w in c for w in ("label", "campaign")) for c in columns)
    fixed = spark.createDataFrame([("forbidden_inputs", forbidden), ("ground_truth_in_names", named)], "check string, n_bad long")
    a = alignment(features, dataset)
    aligned = a.select(F.lit("alignment").alias("check"), sum((F.col(c) for c in a.columns if not c.startswith("n_")), F.lit(0)).cast("long").alias("n_bad"))
    infinite = finite(features).agg((F.coalesce(F.sum("n_inf"), F.lit(0)) + F.lit(undeclared)).cast("long").alias("n_bad")).select(F.lit("declared_features").alias("check"), "n_bad")
    part = F.when(F.col("split") == "train", 0).when(F.col("split") == "validation", 1).otherwise(2)
    first = split.groupBy(part.alias("part")).agg(F.min("ts_us").alias("first")).agg(*[F.min(F.when(F.col("part") > i, F.col("first"))).alias(f"after_{i}") for i in (0, 1)])
    late = split.crossJoin(F.broadcast(first)).agg(F.count_if(((part == 0) & (F.col("ts_us") >= F.col("after_0"))) | ((part == 1) & (F.col("ts_us") >= F.col("after_1")))).alias("n_bad")).select(F.lit("temporal_order").alias("check"), "n_bad")
    parts = split.groupBy("transaction_id").agg(F.count(F.lit(1)).alias("n"))
    once = features.select("transaction_id").join(parts, "transaction_id", "full_outer").agg(F.count_if(F.coalesce(F.col("n"), F.lit(0)) != 1).alias("n_bad")).select(F.lit("split_once").alias("check"), "n_bad")
    out = fixed.unionByName(aligned).unionByName(infinite).unionByName(late).unionByName(once)
    if suspects is not None:
        out = out.unionByName(suspects.agg(F.count_if("suspect").alias("n_bad")).select(F.lit("suspicious_signal").alias("check"), "n_bad"))
    return out.withColumn("ok", F.col("n_bad") == 0)


def differing(a: DataFrame, b: DataFrame, key: str, tolerance: float = 0.0, relative: float = 0.0) -> DataFrame:
    """(name, n_differ): by column of ``a``, rows of ``a`` whose value in ``b`` differs by more than the tolerances, or is missing."""
    names = [c for c in a.columns if c != key]
    j = a.join(b.select(F.col(key).alias("__key"), *[F.col(c).alias(f"__{c}") for c in names]), F.col(key) == F.col("__key"), "left")

    def same(c: str) -> Column:
        x, y = F.col(c), F.col(f"__{c}")
        if dict(a.dtypes)[c] in ("double", "float"):
            return (x.isNull() & y.isNull()) | F.coalesce(F.abs(x - y) <= tolerance + relative * F.abs(y), F.lit(False))
        return x.eqNullSafe(y)

    one = j.agg(*[F.count_if(F.col("__key").isNull() | ~same(c)).alias(c) for c in names])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("n_differ")) for c in names])).alias("x")).select("x.*")


def causality_prefix(tx: DataFrame, config: FeatureConfig, upto_us: int, groups: tuple[str, ...] = GROUPS) -> DataFrame:
    """(name, n_differ): features of the rows up to a time, computed from those rows alone, against the whole table's."""
    whole = durable(feature_table(tx, config, groups), "features")
    prefix = tx.where(F.unix_micros(F.col("timestamp").cast("timestamp")) <= upto_us)
    return differing(durable(feature_table(prefix, config, groups), "prefix"), whole, "transaction_id", 1e-4, 1e-5)


def invariance(tx: DataFrame, assign: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """One row: assignments that are there only with ground truth, and only without it.  Both must be 0."""
    a, b = (assign(t).select("transaction_id", "candidate_id") for t in (tx, tx.drop(*GROUND_TRUTH)))
    j = a.withColumn("a", F.lit(1)).join(b.withColumn("b", F.lit(1)), ["transaction_id", "candidate_id"], "full_outer")
    return j.agg(F.count_if(F.col("b").isNull()).alias("only_with_labels"), F.count_if(F.col("a").isNull()).alias("only_without_labels"))


def membership(assigned: DataFrame, truth: DataFrame) -> DataFrame:
    """One row, after candidates are formed: attack transactions, those in candidates of two or more, isolated, not assigned, and campaigns."""
    j = truth.join(assigned.select("transaction_id", "candidate_size"), "transaction_id", "left")
    attack = F.col("label") == 1
    return j.agg(
        F.count_if(attack).alias("n_attack"), F.count_if(attack & (F.col("candidate_size") > 1)).alias("n_attack_in_multi"), F.count_if(attack & (F.col("candidate_size") == 1)).alias("n_attack_isolated"),
        F.count_if(attack & F.col("candidate_size").isNull()).alias("n_attack_unassigned"), F.count_distinct(F.when(F.col("campaign_id") != "", F.col("campaign_id"))).alias("n_campaigns"),
    )
