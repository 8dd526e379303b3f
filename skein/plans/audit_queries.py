"""Named queries: audits over planted faults, comparison tables, tuning, worlds, stored artifacts and the stream."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import functions as F

from skein.functions import numbers
from skein.operators import audit, evaluation, features, ml, perturb, scoring, tuning, validate, worlds
from skein.operators import candidates as cand
from skein.plans import oracle as q
from skein.plans.config import FIXTURE
from skein.plans.durable import durable, shared_dir
from skein.plans.more_queries import _GT
from skein.plans.queries import _EVERY, _assigned, _feature_query, _features, _scored, r6, register, rounded, tx
from skein.sources import artifacts, transactions
from skein.streaming import online

# a check is only worth something where it finds faults: these are planted by merchant or bin


@register(q.query("SELECT count(*) FILTER (merchant_id = 'M5') AS only_assigned, count(*) FILTER (merchant_id = 'M7') AS only_truth, count(*) FILTER (merchant_id = 'M11') AS repeated_assigned, count(*) FILTER (merchant_id = 'M13') AS repeated_truth FROM o"))
def align_audit(spark, sf):
    t = tx(spark, sf)
    again = lambda df, m: df.unionByName(df.where(F.col("merchant_id") == m))
    return evaluation.align(again(t.where("merchant_id <> 'M7'"), "M11"), again(t.where("merchant_id <> 'M5'"), "M13"))


@register(q.query("""SELECT count(*) FILTER (m = 'M3') AS n_self, count(*) FILTER (m IN ('M3', 'M4')) AS n_future, count(*) FILTER (m = 'M6') AS n_outside_window, count(*) FILTER (m = 'M8') AS n_without_evidence, count(*) FILTER (m = 'M9') AS n_unknown
 FROM (SELECT o.merchant_id AS m FROM lk JOIN o ON o.transaction_id = anchor_transaction_id)""", q.EDGES, q.PAIRS, q.LINKS))
def graph_checks(spark, sf):
    t = tx(spark, sf)
    l = cand.causal_links(t).join(t.select(F.col("transaction_id").alias("anchor_transaction_id"), F.col("merchant_id").alias("m")), "anchor_transaction_id")  # noqa: E741
    a, p, m = F.col("anchor_transaction_id"), F.col("prior_transaction_id"), F.col("m")
    bad = l.withColumns({
        "anchor_transaction_id": F.when(m == "M4", p).otherwise(a), "prior_transaction_id": F.when(m == "M3", a).when(m == "M4", a).when(m == "M9", "nowhere").otherwise(p),
        "age_seconds": F.when(m == "M6", 7200.0).otherwise(F.col("age_seconds")), "n_link_entity_types": F.when(m == "M8", 0).otherwise(F.col("n_link_entity_types")),
    })
    return validate.graph_checks(t, bad.drop("m"))


_FAULTY = """fa AS (SELECT transaction_id, CASE WHEN merchant_id = 'M3' THEN 'elsewhere' ELSE candidate_id END AS c, candidate_size AS s FROM t UNION ALL SELECT transaction_id, candidate_id, candidate_size FROM t WHERE merchant_id = 'M4')"""


@register(q.assigned("""SELECT (SELECT count(*) FROM lk JOIN fa x ON x.transaction_id = anchor_transaction_id JOIN fa y ON y.transaction_id = prior_transaction_id WHERE x.c <> y.c) AS n_links_across,
 (SELECT count(*) FROM (SELECT transaction_id FROM fa GROUP BY 1 HAVING count(*) > 1)) AS n_assigned_twice, (SELECT count(*) FROM (SELECT c FROM fa GROUP BY 1 HAVING count(*) <> max(s))) AS n_wrong_size""", q.PAIRS, q.LINKS, _FAULTY))
def candidate_checks(spark, sf):
    t, a = _assigned(spark, sf)
    a = a.join(t.select("transaction_id", "merchant_id"), "transaction_id")
    bad = a.withColumn("candidate_id", F.when(F.col("merchant_id") == "M3", "elsewhere").otherwise(F.col("candidate_id"))).unionByName(a.where("merchant_id = 'M4'"))
    return validate.candidate_checks(bad, cand.causal_links(t))


def _spoiled(t):
    """Rows of one bin are gone, of another changed, of a third relabelled, and bursts are added."""
    t = t.where("bin <> '400003'").withColumn("amount", F.when(F.col("bin") == "400004", F.col("amount") + 1).otherwise(F.col("amount")))
    return perturb.inject_bursts(t.withColumn("label", F.when(F.col("bin") == "400005", 1 - F.col("label")).otherwise(F.col("label"))), 3, 8, 300, 9)


_ADDED = "8 * least(3, count(*) FILTER (campaign_id = '' AND bin <> '400003'))"


@register(q.query(f"SELECT count(*) FILTER (bin = '400003') AS n_missing, count(*) FILTER (bin IN ('400004', '400005')) AS n_changed, {_ADDED} AS n_added FROM o"))
def rows_preserved(spark, sf):
    t = tx(spark, sf)
    return validate.rows_preserved(t, _spoiled(t), ("ts_us", "card_fingerprint", "amount", "label"))


@register(q.query(f"SELECT count(*) FILTER (bin = '400003') AS n_removed, {_ADDED} AS n_added, count(*) FILTER (bin = '400005') AS n_relabelled FROM o"))
def labels_preserved(spark, sf):
    t = tx(spark, sf)
    return validate.labels_preserved(t, _spoiled(t)).drop("n_added_positive")


@register(q.query(f"SELECT count(*) FILTER (bin <> '400003') AS n_kept, {_ADDED} AS n_added, count(*) FILTER (bin = '400003') AS n_removed, count(*) FILTER (bin = '400004') AS changed_amount, count(*) FILTER (bin = '400005') AS changed_label FROM o"))
def perturb_summary(spark, sf):
    t = tx(spark, sf)
    return perturb.summary(t, _spoiled(t), ("amount", "label"))


@register(q.query("""SELECT count(*) FILTER (a IS NOT NULL AND try_cast(a AS DOUBLE) IS NULL) AS bad_amount, count(*) FILTER (s IS NOT NULL AND try_cast(s AS TIMESTAMP) IS NULL) AS bad_timestamp, count(*) FILTER (a IS NULL) AS no_amount
 FROM (SELECT CASE WHEN bin = '400001' THEN 'x' || amount::VARCHAR WHEN bin = '400002' THEN NULL ELSE amount::VARCHAR END AS a, CASE WHEN bin = '400006' THEN 'never' ELSE "timestamp"::VARCHAR END AS s FROM tx)"""))
def dq_parse(spark, sf):
    t = transactions.from_events(spark, sf)
    a, b = F.col("amount").cast("string"), F.col("bin")
    return validate.parse_failures(t.select(F.when(b == "400001", F.concat(F.lit("x"), a)).when(b == "400002", None).otherwise(a).alias("amount"), F.when(b == "400006", "never").otherwise(F.col("timestamp").cast("string")).alias("timestamp")))


@register(q.query("""SELECT count(*) FILTER (merchant_id <> 'M7') AS n_features, count(*) FILTER (merchant_id <> 'M5') + count(*) FILTER (merchant_id = 'M13') AS n_dataset, (sum(nf) FILTER (nf > 0) - count(*) FILTER (nf > 0))::BIGINT AS repeated_features, count(*) FILTER (merchant_id = 'M13') AS repeated_dataset,
 count(*) FILTER (merchant_id = 'M5') AS only_features, count(*) FILTER (merchant_id = 'M7') AS only_dataset, count(*) FILTER (merchant_id IN ('M1', 'M2') AND bin = '400001') AS missing_labels, count(*) FILTER (merchant_id NOT IN ('M5', 'M13') AND bin = '400002') + 2 * count(*) FILTER (merchant_id = 'M13' AND bin = '400002') AS non_binary_labels
 FROM (SELECT *, (merchant_id <> 'M7')::INT AS nf FROM o)"""))
def alignment(spark, sf):
    t = tx(spark, sf)
    label = F.when((F.col("bin") == "400001") & F.col("merchant_id").isin("M1", "M2"), None).when(F.col("bin") == "400002", F.lit("2")).otherwise(F.col("label").cast("string"))
    d = t.where("merchant_id <> 'M5'").select("transaction_id", "merchant_id", label.alias("label"))
    return audit.alignment(t.where("merchant_id <> 'M7'"), d.unionByName(d.where("merchant_id = 'M13'")))


@register(q.query("SELECT transaction_id, amount, label, epoch_us(\"timestamp\") AS ts_us FROM tx"))
def aligned_load(spark, sf):
    t = transactions.from_events(spark, sf)
    got = audit.aligned_load(t.select("transaction_id", "amount"), t)
    return got.withColumn("ts_us", F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST(timestamp AS TIMESTAMP_NTZ))")).drop("timestamp")


@register(q.query("SELECT count(*) FILTER (label = 1) AS n_attack, count(*) FILTER (label = 1 AND candidate_size > 1) AS n_attack_in_multi, count(*) FILTER (label = 1 AND candidate_size = 1) AS n_attack_isolated, count(*) FILTER (label = 1 AND candidate_size IS NULL) AS n_attack_unassigned, count(DISTINCT campaign_id) FILTER (campaign_id <> '') AS n_campaigns FROM o LEFT JOIN (SELECT transaction_id, candidate_size FROM t WHERE merchant_id <> 'M3') USING (transaction_id)", q.EDGES, q.CHAIN, q.COMP, q.ASSIGN))
def gt_audit(spark, sf):
    t, a = _assigned(spark, sf)
    known = a.join(t.where("merchant_id <> 'M3'").select("transaction_id"), "transaction_id", "left_semi")
    return audit.membership(known, evaluation.truth(t))


@register(q.query("SELECT count(*) FILTER (campaign_id <> '') AS only_with_labels, count(*) FILTER (campaign_id <> '') AS only_without_labels FROM o"))
def label_invariance(spark, sf):
    """An assignment that does look at labels, so that the check has something to find; the engine's own is in the tests."""
    peeks = lambda t: t.withColumn("candidate_id", F.when(F.col("campaign_id") != "", F.col("campaign_id")).otherwise(F.col("transaction_id")) if "campaign_id" in t.columns else F.col("transaction_id"))
    return audit.invariance(transactions.from_events(spark, sf), peeks)


@register()
def label_invariance_of_candidates(spark, sf):
    from skein.operators import causal

    return audit.invariance(transactions.from_events(spark, sf), lambda t: cand.assignments(cand.components(causal.ordered(t))))


@register()
def causality_prefix(spark, sf):
    t = transactions.from_events(spark, sf)
    half = tx(spark, sf).agg(F.percentile("ts_us", F.lit(0.5)).cast("long")).first()[0] or 0
    return audit.causality_prefix(t, FIXTURE, half)


@register()
def leakage_audit(spark, sf):
    t = tx(spark, sf)
    f = _features(spark, sf, False)
    split = durable(evaluation.chronological_split(t.select("transaction_id", "ts_us"), "transaction_id", "ts_us"), "split")
    suspects = evaluation.univariate_audit(f.join(t.select("transaction_id", "label"), "transaction_id"), _EVERY)
    return audit.leakage_audit(f, t, split, FIXTURE, suspects, _EVERY)


@register(q.query(" UNION ALL ".join(f"SELECT '{n}' AS name, (count(*) - count({n}))::BIGINT AS n_null, count(*) FILTER (isnan({n}::DOUBLE)) AS n_nan, count(*) FILTER (isinf({n}::DOUBLE)) AS n_inf FROM ft" for n in _EVERY), f"\nft AS MATERIALIZED ({_feature_query(_EVERY)})"))
def dq_finite(spark, sf):
    return audit.finite(_features(spark, sf, False))


# comparisons

def _erfc(z: str) -> str:
    """The published expansion over |z| / sqrt(2), as SQL over a column x and t."""
    poly = f"{numbers.ERFC[-1]}::DOUBLE"
    for c in reversed(numbers.ERFC[:-1]):
        poly = f"({c}::DOUBLE + t * {poly})"
    return f"least(1.0, t * exp(-x * x + {poly}))"


def _tail(rows: str, z: str = "z") -> str:
    return f"(SELECT *, {_erfc(z)} AS p FROM (SELECT *, 1 / (1 + 0.5::DOUBLE * x) AS t FROM (SELECT *, abs({z}) / {math.sqrt(2)!r}::DOUBLE AS x FROM {rows})))"


def _bh(rows: str) -> str:
    return f"(SELECT *, least(1.0, min(p * m / r) OVER (ORDER BY p DESC)) AS q FROM (SELECT *, count(p) OVER (ORDER BY p) AS r, count(p) OVER () AS m FROM {rows}))"


_PROP = """(SELECT merchant_id, coalesce((a / n::DOUBLE - b / k::DOUBLE) / nullif(sqrt((a + b) / (n + k)::DOUBLE * (1 - (a + b) / (n + k)::DOUBLE) * (1.0 / n + 1.0 / k)), 0), 0) AS z FROM (
 SELECT merchant_id, sum(declined) AS a, count(*) AS n, (SELECT sum(declined) FROM o) - sum(declined) AS b, (SELECT count(*) FROM o) - count(*) AS k FROM o GROUP BY 1))"""


@register(q.query(f"SELECT merchant_id, {r6('z')} AS z, {r6('p')} AS p, {r6('q')} AS q FROM {_bh(_tail(_PROP))}"))
def bh_fdr(spark, sf):
    """Each merchant's share of declines against that of all others, corrected for the number of merchants."""
    t = tx(spark, sf)
    per = t.groupBy("merchant_id").agg(F.sum("declined").alias("a"), F.count(F.lit(1)).alias("n"))
    every = t.agg(F.sum("declined").alias("sa"), F.count(F.lit(1)).alias("sn"))
    z = numbers.two_proportion_z(F.col("a"), F.col("n"), F.col("sa") - F.col("a"), F.col("sn") - F.col("n"))
    p = per.crossJoin(F.broadcast(every)).select("merchant_id", z.alias("z")).withColumn("p", numbers.two_sided(F.col("z")))
    return rounded(evaluation.benjamini_hochberg(p))


_NUMERIC = [n for n in q.FEATURES]
_FLAG = "fg AS (SELECT f.*, (g.campaign_transactions > 0)::INT AS label FROM f JOIN gt g ON g.group_id = f.candidate_id)"


def _flagged(spark, sf):
    t, a = _assigned(spark, sf)
    f = scoring.scoring_features(t, a)
    groups = evaluation.attach_groups(a, evaluation.truth(t)).select("candidate_id", "is_attack_containing")
    return durable(f.join(groups, "candidate_id"), "flagged")


def _numeric_sql(n: str) -> str:
    rank = f"(SELECT label, {q._rank(n)} AS r, {n}::DOUBLE AS v FROM fg)"
    return f"""SELECT '{n}' AS name, count(*) FILTER (label = 1) AS n_flagged, count(*) FILTER (label = 0) AS n_other, avg(v) FILTER (label = 1) AS mean_flagged, avg(v) FILTER (label = 0) AS mean_other, median(v) FILTER (label = 1) AS median_flagged, median(v) FILTER (label = 0) AS median_other,
 (sum(r) FILTER (label = 1) - sum(label) * (sum(label) + 1) / 2.0::DOUBLE) / nullif(sum(label) * sum(1 - label), 0) AS auc FROM {rank}"""


@register(q.assigned(f"SELECT name, n_flagged, n_other, {', '.join(f'{r6(c)} AS {c}' for c in ('mean_flagged', 'mean_other', 'median_flagged', 'median_other', 'auc'))}, {r6('2 * auc - 1')} AS cliffs_delta, CASE WHEN abs(2 * auc - 1) < 0.147 THEN 'negligible' WHEN abs(2 * auc - 1) < 0.33 THEN 'small' WHEN abs(2 * auc - 1) < 0.474 THEN 'medium' ELSE 'large' END AS effect FROM ({' UNION ALL '.join(map(_numeric_sql, _NUMERIC))})", q.FEATS, _GT, _FLAG))
def compare_numeric(spark, sf):
    return rounded(evaluation.compare_numeric(_flagged(spark, sf), _NUMERIC, "is_attack_containing").drop("p", "q"))


_YES = {"many_merchants": "distinct_merchants_per_transaction > 0.9", "many_bins": "distinct_bins_per_transaction > 0.4", "repeated_amount": "max_identical_amount_share > 0.6", "dense": "link_density >= 1"}
_BOOL = " UNION ALL ".join(f"SELECT '{n}' AS name, count(*) FILTER (label = 1 AND {c}) AS a, count(*) FILTER (label = 1) AS n_flagged, count(*) FILTER (label = 0 AND {c}) AS b, count(*) FILTER (label = 0) AS n_other FROM fg" for n, c in _YES.items())
_BOOLZ = f"(SELECT *, a / nullif(n_flagged, 0)::DOUBLE AS rate_flagged, b / nullif(n_other, 0)::DOUBLE AS rate_other, coalesce((a / nullif(n_flagged, 0)::DOUBLE - b / nullif(n_other, 0)::DOUBLE) / nullif(sqrt((a + b) / (n_flagged + n_other)::DOUBLE * (1 - (a + b) / (n_flagged + n_other)::DOUBLE) * (1.0 / nullif(n_flagged, 0) + 1.0 / nullif(n_other, 0))), 0), 0) AS z FROM ({_BOOL}))"


@register(q.assigned(f"SELECT name, n_flagged, n_other, {', '.join(f'{r6(c)} AS {c}' for c in ('rate_flagged', 'rate_other', 'z', 'p', 'q'))}, {r6('rate_flagged - rate_other')} AS difference FROM {_bh(_tail(_BOOLZ))}", q.FEATS, _GT, _FLAG))
def compare_boolean(spark, sf):
    f = _flagged(spark, sf).withColumns({n: F.expr(c) for n, c in _YES.items()})
    return rounded(evaluation.compare_boolean(f, list(_YES), "is_attack_containing"))


@register(q.assigned(" UNION ALL ".join(f"SELECT '{n}' AS name, count(*) FILTER ({c}) AS n, {r6(f'avg(label) FILTER ({c})')} AS rate, {r6(f'avg(label) FILTER ({c}) / avg(label)')} AS lift FROM fg" for n, c in _YES.items()), q.FEATS, _GT, _FLAG))
def prevalence_lift(spark, sf):
    f = _flagged(spark, sf).withColumns({n: F.expr(c) for n, c in _YES.items()})
    return rounded(evaluation.prevalence_lift(f, list(_YES), "is_attack_containing"))


_CUTS = "cu AS (SELECT DISTINCT unnest(quantile_cont(round(amount, 2), [" + ", ".join(f"{i / 200}::DOUBLE" for i in range(201)) + "])) AS c FROM o)"
_SIDE = f"sd AS (SELECT (sum(r) FILTER (label = 1) - sum(label) * (sum(label) + 1) / 2.0::DOUBLE) / (sum(label) * sum(1 - label)) >= 0.5 AS above, sum(label)::DOUBLE AS p, sum(1 - label)::DOUBLE AS n FROM (SELECT label, {q._rank('round(amount, 2)')} AS r FROM o))"


@register(q.query("""SELECT round(c, 6) + 0.0::DOUBLE AS threshold, CASE WHEN above THEN '>=' ELSE '<=' END AS rule, tp::BIGINT AS n_hits, (tp + fp)::BIGINT AS n_flagged, round(tp / p, 6) + 0.0::DOUBLE AS recall, round(1 - fp / n, 6) + 0.0::DOUBLE AS specificity, round(tp / p - fp / n, 6) + 0.0::DOUBLE AS youden_j FROM (
 SELECT c, above, p, n, count(*) FILTER (label = 1 AND CASE WHEN above THEN x >= c ELSE x <= c END) AS tp, count(*) FILTER (label = 0 AND CASE WHEN above THEN x >= c ELSE x <= c END) AS fp FROM cu, sd, (SELECT label, round(amount, 2) AS x FROM o) GROUP BY 1, 2, 3, 4) ORDER BY round(tp / p - fp / n, 12) DESC, c LIMIT 1""", _CUTS, _SIDE))
def best_threshold(spark, sf):
    return rounded(evaluation.best_threshold(tx(spark, sf).withColumn("value", F.bround("amount", 2))))


@register()
def compare_groupings(spark, sf):
    t, a = _assigned(spark, sf)
    truth = evaluation.truth(t)
    measure = lambda groups: evaluation.grouping_metrics(evaluation.group_table(j := groups.join(truth, "transaction_id")), evaluation.campaign_table(j))
    return rounded(evaluation.compare_groupings(measure(a.select("transaction_id", F.col("candidate_id").alias("group_id"))), measure(evaluation.sessions(t, "bin", 3600))))


# tuning and worlds

@register()
def tuned_weights(spark, sf):
    f = _flagged(spark, sf).withColumn("label", F.col("is_attack_containing").cast("int"))
    signs = dict(scoring.SIGNS)
    train = f.select("candidate_id", *signs, "label")
    return spark.createDataFrame(sorted(tuning.tune_weights(train, signs).items()), "name string, weight double")


@register()
def out_of_fold_scores(spark, sf):
    t, a = _assigned(spark, sf)
    f = scoring.scoring_features(t, a)
    groups = evaluation.group_table(a.select("transaction_id", F.col("candidate_id").alias("group_id")).join(evaluation.truth(t), "transaction_id"))
    f = f.join(groups.select(F.col("group_id").alias("candidate_id"), "dominant_campaign_id"), "candidate_id")
    return rounded(tuning.out_of_fold(f, dict(scoring.SIGNS)))


def _arms():
    return {
        "control": lambda d: d.select("*"),
        "faster": lambda d: perturb.scale_cadence(d, 0.5),
        "fresh_devices": lambda d: perturb.weaken_reuse(d, "device", 0.5, 11),
        "truncated": lambda d: perturb.truncate_tails(d, 0.5),
        "bursts": worlds.compose(lambda d: perturb.inject_bursts(d, 3, 8, 300, 9), lambda d: perturb.jitter(d, 60, 3)),
    }


@register()
def world_deltas(spark, sf):
    """Five arms, each rebuilt and scored against the reference of the unperturbed table, and their differences from the control."""
    t, _, _, ref, table = _scored(spark, sf)
    base = t.drop("declined", "low_value")
    rows = None
    for name, f in _arms().items():
        one = worlds.outcome(worlds.build(base, name, f, removals=name == "truncated"), ref, table)
        rows = one if rows is None else rows.unionByName(one)
    return rounded(worlds.deltas(durable(rows, "arms"), "control"))


@register(q.query("SELECT 0::BIGINT + count(*) FILTER (merchant_id = 'M3') AS n_differ FROM o"))
def baseline_parity(spark, sf):
    """Rebuilding gives the same candidates, but for those renamed here."""
    t, a = _assigned(spark, sf)
    renamed = a.join(t.select("transaction_id", "merchant_id"), "transaction_id").withColumn("candidate_id", F.when(F.col("merchant_id") == "M3", F.concat("candidate_id", F.lit("?"))).otherwise(F.col("candidate_id")))
    return worlds.parity(t.drop("declined", "low_value"), renamed)


# stored artifacts: written, read back, and compared

def _place(spark) -> str:
    return f"{shared_dir(spark)}/skein/artifact-{uuid.uuid4().hex}"


@register(q.query('SELECT transaction_id, merchant_id, card_fingerprint, bin, amount, device_fingerprint, ip_signature, auth_outcome, epoch_us("timestamp") AS ts_us FROM tx'))
def csv_roundtrip(spark, sf):
    """Written as CSV and read again as text, then typed."""
    from skein.operators import causal

    path = _place(spark)
    artifacts.write_table(transactions.production(transactions.from_events(spark, sf)), path, "csv")
    t = transactions.read_csv(spark, path)
    return t.withColumn("ts_us", causal.micros(t)).drop("timestamp")


@register(q.query('SELECT transaction_id, merchant_id, card_fingerprint, bin, amount, device_fingerprint, ip_signature, auth_outcome, epoch_us("timestamp") AS ts_us FROM tx'))
def json_roundtrip(spark, sf):
    from skein.operators import causal

    path = _place(spark)
    artifacts.write_table(transactions.production(transactions.from_events(spark, sf)), path, "json")
    t = transactions.read_json(spark, path)
    return t.withColumn("ts_us", causal.micros(t)).drop("timestamp")


@register(q.assigned("SELECT candidate_id, size, (max_ts - min_ts) / 1000000.0::DOUBLE AS time_span_seconds FROM (SELECT candidate_id, count(*) AS size, min(ts_us) AS min_ts, max(ts_us) AS max_ts FROM a GROUP BY 1)"))
def candidate_artifacts(spark, sf):
    t, a = _assigned(spark, sf)
    path = _place(spark)
    artifacts.save_candidates(cand.candidate_frame(t, a), a, path)
    return artifacts.load_candidates(spark, path)[0].select("candidate_id", "size", "time_span_seconds")


@register(q.assigned(f"SELECT candidate_id, {r6('score')} AS score FROM ss", q.FEATS, q.SCORED))
def scorer_ref_roundtrip(spark, sf):
    """Scores by a reference that was stored and loaded."""
    _, _, f, ref, table = _scored(spark, sf)
    path = _place(spark)
    artifacts.save_reference(spark, ref, table, path)
    loaded = artifacts.load_reference(spark, path)
    return rounded(scoring.transform(f, *loaded).select("candidate_id", "score"))


@register()
def model_roundtrip(spark, sf):
    """How a stored and loaded model's scores of the test part compare with the model's own: one row of its evaluation."""
    t = tx(spark, sf)
    f = features.feature_table(transactions.from_events(spark, sf), FIXTURE, ("velocity",))
    names = [c for c in f.columns if c != "transaction_id"]
    f = durable(evaluation.chronological_split(f.join(t.select("transaction_id", "label", "ts_us"), "transaction_id"), "transaction_id", "ts_us"), "split")
    model, plan = ml.train(f.where("split = 'train'"), names, max_iter=20)
    path = _place(spark)
    artifacts.save_model(model, plan, spark, path)
    test = f.where("split = 'test'")
    return ml.score_block(ml.predict(*artifacts.load_model(spark, path), test).join(test.select("transaction_id", "label"), "transaction_id"))


# the stream

@register(q.query("SELECT 'ok' AS status, count(*) FILTER (amount > 0) AS n_transactions FROM o"))
def stream_detect(spark, sf):
    """All transactions as micro-batches into a store; then the detection's summary over what it accepted."""
    _, _, _, ref, table = _scored(spark, sf)
    place = _place(spark)
    data = transactions.production(transactions.from_events(spark, sf)).withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    data.select(*online.COLUMNS).repartition(3).write.parquet(f"{place}/in")
    store = online.Store(spark, f"{place}/store")
    stream = spark.readStream.schema(online.SCHEMA).option("maxFilesPerTrigger", 2).parquet(f"{place}/in")
    online.run(stream, store, f"{place}/checkpoint").awaitTermination()
    return online.snapshot(store, ref, table)[1].select("status", "n_transactions")
