"""Global orders, comparisons, audits, tuning, worlds and stored artifacts against plain Python."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.functions import numbers
from skein.operators import audit, candidates, causal, evaluation, order, perturb, scoring, tuning, worlds
from skein.sources import artifacts, transactions

from .test_candidates import micro
from .test_causal import SCHEMA, rows


def test_running_sums_ranks_and_quantiles(spark):
    g = random.Random(1)
    data = [(g.choice("ab"), float(g.choice([1, 1, 2, 3, 3, 3, g.randrange(50)])), g.randrange(9)) for _ in range(300)]
    df = spark.createDataFrame(data, "k string, v double, w int")
    got = {(r["k"], r["v"]): r for r in order.running(df, "v", {"s": F.sum("w"), "n": F.count(F.lit(1))}, ("k",), buckets=5).collect()}
    for (k, v), r in got.items():
        assert r["s"] == sum(w for a, x, w in data if a == k and x == v) and r["s_before"] == sum(w for a, x, w in data if a == k and x < v) and r["n_before"] == sum(a == k and x < v for a, x, _ in data)
    q = {(r["k"], r["share"]): r["v"] for r in order.quantiles(order.ranks(df, "v", ("k",)), "v", (0.0, 0.01, 0.5, 0.9, 1.0), ("k",)).collect()}
    for (k, s), v in q.items():
        assert abs(v - np.quantile([x for a, x, _ in data if a == k], s)) < 1e-9
    assert len(q) == 10 and order.ranks(df.limit(0), "v").count() == 0


def test_two_sided_p(spark):
    z = [0.0, 0.5, 1.0, 1.96, -3.0, 6.0, 10.0]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in z], "z double").select(numbers.two_sided(F.col("z"))).collect()]
    assert all(abs(p / math.erfc(abs(x) / math.sqrt(2)) - 1) < 3e-7 for p, x in zip(got, z, strict=True))


def test_false_discovery_rates(spark):
    p = [0.01, 0.02, 0.02, 0.5, 0.04, None, 0.9, 0.03]
    got = {(r["i"]): r["q"] for r in evaluation.benjamini_hochberg(spark.createDataFrame(list(enumerate(p)), "i int, p double")).collect()}
    known = [x for x in p if x is not None]
    for i, x in enumerate(p):
        want = None if x is None else min(1.0, min(y * len(known) / sum(z <= y for z in known) for y in known if y >= x))
        assert (got[i] is None) == (want is None) and (want is None or abs(got[i] - want) < 1e-12)


@pytest.mark.parametrize("turn", [1, -1])
def test_best_threshold(spark, turn):
    g = random.Random(3)
    data = [(turn * (g.gauss(2, 1) if i % 4 == 0 else g.gauss(0, 1)), int(i % 4 == 0)) for i in range(400)]
    r = evaluation.best_threshold(spark.createDataFrame(data, "value double, label int")).first()
    x, y = np.array([v for v, _ in data]), np.array([t for _, t in data])
    best = (-2, None)
    for t in np.unique(np.quantile(x, np.linspace(0, 1, 201))):
        flag = x >= t if turn > 0 else x <= t
        j = flag[y == 1].mean() - flag[y == 0].mean()
        if j > best[0] + 1e-12:
            best = (j, t)
    assert r["rule"] == (">=" if turn > 0 else "<=") and abs(r["youden_j"] - best[0]) < 1e-9 and abs(r["threshold"] - best[1]) < 1e-9


def test_audit_finds_what_is_planted(spark):
    from skein.operators.features import feature_table
    from skein.plans.config import FeatureConfig

    config = FeatureConfig(windows=(20, 50))
    base = spark.createDataFrame(rows(40), SCHEMA).withColumn("label", F.when(F.col("bin") == "40", 1).otherwise(0))
    f = feature_table(base, config).cache()
    split = evaluation.chronological_split(base.withColumn("ts_us", causal.micros(base)).select("transaction_id", "ts_us"), "transaction_id", "ts_us")
    bad = lambda *a: {r["check"]: r["n_bad"] for r in audit.leakage_audit(*a, config).collect()}
    clean = bad(f, base, split)
    assert set(clean.values()) == {0} and len(clean) == 6
    wrong = bad(f.withColumn("label", F.lit(1)).drop("vel_ip_count_20s"), base.limit(39), split.limit(39).withColumn("split", F.lit("train")))
    assert wrong["forbidden_inputs"] == 1 and wrong["ground_truth_in_names"] == 1 and wrong["alignment"] == 1 and wrong["declared_features"] == 2 and wrong["split_once"] == 1
    late = split.withColumn("split", F.when(F.col("split") == "train", "test").when(F.col("split") == "test", "train").otherwise("validation"))
    assert bad(f, base, late)["temporal_order"] > 0
    with pytest.raises(ValueError, match="not aligned"):
        audit.aligned_load(f, base.limit(39))


def test_candidates_do_not_depend_on_labels_and_features_not_on_the_future(spark):
    from skein.plans.config import FeatureConfig

    base = spark.createDataFrame(rows(40), SCHEMA).withColumn("label", F.lit(1)).withColumn("campaign_id", F.lit("CMP-1"))
    r = audit.invariance(base, lambda t: candidates.assignments(candidates.components(causal.ordered(t)))).first()
    assert tuple(r) == (0, 0)
    half = base.select(F.percentile(F.unix_micros(F.col("timestamp").cast("timestamp")), F.lit(0.5)).cast("long")).first()[0]
    got = audit.causality_prefix(base, FeatureConfig(windows=(20, 50)), half, ("velocity", "merchant")).collect()
    assert len(got) > 20 and all(x["n_differ"] == 0 for x in got)


def test_weights_follow_the_feature_that_tells(spark):
    g = random.Random(2)
    data = [(f"c{i}", float(i % 5 == 0) + g.random(), g.random(), int(i % 5 == 0)) for i in range(100)]
    df = spark.createDataFrame(data, "candidate_id string, good double, noise double, label int")
    w = tuning.tune_weights(df, {"good": 1.0, "noise": 1.0})
    assert w["good"] > w["noise"] and w == tuning.tune_weights(df, {"good": 1.0, "noise": 1.0})
    folds = {r["candidate_id"]: r["fold"] for r in tuning.grouped_folds(df.withColumn("dominant_campaign_id", F.when(F.col("label") == 1, "one"))).collect()}
    assert len({folds[f"c{i}"] for i in range(0, 100, 5)}) == 1 and len(set(folds.values())) == 5


def test_worlds_and_artifacts(spark, tmp_path):
    g = random.Random(4)
    tx = micro(spark, [(g.randrange(20000), f"C{g.randrange(9)}", f"D{g.randrange(9)}", f"I{g.randrange(9)}", f"M{g.randrange(5)}") for _ in range(80)]).drop("declined", "low_value")
    tx = tx.withColumn("campaign_id", F.when(F.col("card_fingerprint") == "C1", "CMP-1").otherwise("")).withColumn("label", (F.col("campaign_id") != "").cast("int")).cache()
    a = candidates.assignments(candidates.components(tx))
    f = scoring.scoring_features(tx, a).cache()
    ref, table = scoring.fit(f)
    with pytest.raises(worlds.WorldError):
        worlds.build(tx, "cut", lambda d: perturb.truncate_tails(d, 0.3))
    with pytest.raises(worlds.WorldError):
        worlds.build(tx, "relabelled", lambda d: d.withColumn("label", F.lit(1)))
    w = worlds.build(tx, "cut", lambda d: perturb.truncate_tails(d, 0.3), removals=True)
    assert w.removed > 0 and w.added == 0 and worlds.parity(tx, a).first()["n_differ"] == 0
    path = str(tmp_path / "ref")
    artifacts.save_reference(spark, ref, table, path)
    assert artifacts.same_reference((ref, table), artifacts.load_reference(spark, path))
    artifacts.write_table(table.withColumn("n", F.col("n") + 1), f"{path}/values-new")
    with pytest.raises(artifacts.ArtifactError, match="frozen"):
        artifacts.write_table(table, f"{path}/values", frozen=(path,))
    artifacts.write_table(tx, f"{path}/tx")
    with pytest.raises(artifacts.ArtifactError, match="ground truth"):
        artifacts.read_table(spark, f"{path}/tx", ("transaction_id",))
    plain = transactions.production(tx).select(*transactions.REQUIRED)
    artifacts.write_table(plain, f"{path}/csv", "csv")
    assert transactions.read_csv(spark, f"{path}/csv").exceptAll(plain).count() == 0
