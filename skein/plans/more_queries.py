"""More named queries: candidate features, evaluation, perturbation, models, checks and the online surface."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.operators import candidate_features as cf
from skein.operators import evaluation, features, ml, perturb, validate
from skein.operators import candidates as cand
from skein.operators import scoring as sco
from skein.plans import oracle as q
from skein.plans.config import ENTITY_COLUMN, FIXTURE
from skein.plans.durable import durable
from skein.plans.queries import _EVERY, _assigned, _scored, r6, register, rounded, tx
from skein.sources import replay, transactions
from skein.streaming import online

_M = "m AS (SELECT * FROM t WHERE candidate_size > 1)"


def r7(x: str) -> str:
    """Seven places, as a mean of two whole microseconds may end in a half."""
    return f"(round({x}, 7) + 0.0::DOUBLE)"


@register(q.assigned(f"""SELECT candidate_id, {r7('gap_mean')} AS gap_mean, {r7('gap_median')} AS gap_median, {r7('gap_min')} AS gap_min, {r7('gap_max')} AS gap_max, {r7('gap_std')} AS gap_std,
 {r7('gap_std / nullif(gap_mean, 0)')} AS gap_cv, {r7('gap_max / nullif(gap_median, 0)')} AS burstiness, {r7('(n - 1) * 60.0::DOUBLE / nullif(span, 0)')} AS transactions_per_minute FROM (
 SELECT candidate_id, avg(gap) AS gap_mean, median(gap) AS gap_median, min(gap) AS gap_min, max(gap) AS gap_max, stddev_samp(gap) AS gap_std, count(*) AS n, (max(ts_us) - min(ts_us)) / 1000000.0::DOUBLE AS span FROM (
 SELECT candidate_id, ts_us, (ts_us - lag(ts_us) OVER (PARTITION BY candidate_id ORDER BY ok)) / 1000000.0::DOUBLE AS gap FROM m) GROUP BY 1)""", _M))
def cand_timing(spark, sf):
    return rounded(cf.timing(cf.members(*_assigned(spark, sf))), 7)


_FR = f"""fr AS (SELECT candidate_id, count(*) AS size, {', '.join(f'count(DISTINCT {ENTITY_COLUMN[e]}) AS distinct_{e}s' for e in ('card', 'device', 'ip', 'merchant', 'bin'))}, any_value(e) AS e, any_value(mu) AS mu, any_value(lc) AS lc, any_value(ld) AS ld, any_value(li) AS li,
 (max(ts_us) - min(ts_us)) / 1000000.0::DOUBLE AS span FROM m JOIN (SELECT candidate_id, count(*) AS e, count(*) FILTER (n_link_entity_types > 1) AS mu, count(*) FILTER (shares_card) AS lc, count(*) FILTER (shares_device) AS ld, count(*) FILTER (shares_ip) AS li FROM lk JOIN a ON a.transaction_id = anchor_transaction_id GROUP BY 1) USING (candidate_id) GROUP BY 1)"""
_KINDS = "((lc > 0)::BIGINT + (ld > 0)::BIGINT + (li > 0)::BIGINT)"


def _multi_frame(spark, sf):
    t, a = _assigned(spark, sf)
    a = a.where("candidate_size > 1")
    return t, a, cand.candidate_frame(t, a)


@register(q.assigned(f"""SELECT candidate_id, {r6('e / (size * (size - 1) / 2.0::DOUBLE)')} AS link_density, {r6('e::DOUBLE / size')} AS links_per_transaction, {r6('mu::DOUBLE / e')} AS multi_entity_link_fraction, {r6('lc::DOUBLE / e')} AS card_link_share,
 {r6('ld::DOUBLE / e')} AS device_link_share, {r6('li::DOUBLE / e')} AS ip_link_share, {_KINDS} AS n_link_entity_types_used, CASE WHEN greatest(lc, ld, li) = 0 THEN 'none' WHEN (lc = greatest(lc, ld, li))::INT + (ld = greatest(lc, ld, li))::INT + (li = greatest(lc, ld, li))::INT > 1 THEN 'mixed'
 WHEN lc = greatest(lc, ld, li) THEN 'card' WHEN ld = greatest(lc, ld, li) THEN 'device' ELSE 'ip' END AS dominant_link_type FROM fr""", q.PAIRS, q.LINKS, _M, _FR))
def cand_topology(spark, sf):
    return rounded(cf.topology(_multi_frame(spark, sf)[2]))


_D = {e: f"count(DISTINCT {c})" for e, c in ENTITY_COLUMN.items()}


@register(q.assigned(f"SELECT candidate_id, {', '.join(f'{d} AS distinct_{e}s' for e, d in _D.items())}, {', '.join(f'{r6(f"{d}::DOUBLE / count(*)")} AS {e}s_per_transaction' for e, d in _D.items())}, {r6(_D['card'] + '::DOUBLE / ' + _D['device'])} AS cards_per_device, {r6(_D['card'] + '::DOUBLE / ' + _D['ip'])} AS cards_per_ip, {r6(_D['merchant'] + '::DOUBLE / ' + _D['card'])} AS merchants_per_card FROM m GROUP BY 1", _M))
def cand_spread(spark, sf):
    return rounded(cf.spread(cf.members(*_assigned(spark, sf))))


@register(q.assigned(f"""SELECT candidate_id, {r6('avg(amount)')} AS amount_mean, {r6('median(amount)')} AS amount_median, {r6('stddev_samp(amount)')} AS amount_std, {r6('min(amount)')} AS amount_min, {r6('max(amount)')} AS amount_max, {r6('avg((amount <= low)::INT)')} AS low_amount_share,
 {r6('avg((round(amount, 2) % 10 = 0)::INT)')} AS round_amount_share, {r6('max(amount) - min(amount)')} AS amount_range, {r6('stddev_samp(amount) / nullif(avg(amount), 0)')} AS amount_cv, {r6('count(DISTINCT round(amount, 2))::DOUBLE / count(*)')} AS distinct_amounts_per_transaction, {r6('any_value(most)::DOUBLE / count(*)')} AS max_identical_amount_share
 FROM m JOIN (SELECT candidate_id, max(c) AS most FROM (SELECT candidate_id, round(amount, 2), count(*) AS c FROM m GROUP BY 1, 2) GROUP BY 1) USING (candidate_id), (SELECT quantile_cont(amount, 0.10) AS low FROM o) GROUP BY 1""", _M))
def cand_amount(spark, sf):
    t, a = _assigned(spark, sf)
    low = t.agg(F.percentile("amount", F.lit(0.10))).first()[0]
    return rounded(cf.amounts(cf.members(t, a), low))


@register(q.assigned(f"SELECT candidate_id, {r6('avg(1 - declined)')} AS auth_approved_share, {r6('avg(declined)')} AS auth_declined_share FROM m GROUP BY 1", _M))
def cand_auth(spark, sf):
    return rounded(cf.outcomes(cf.members(*_assigned(spark, sf))))


@register(q.assigned(f"""SELECT candidate_id, lc > 0 AS has_card_links, ld > 0 AS has_device_links, li > 0 AS has_ip_links, mu > 0 AS has_multi_entity_link, {_KINDS} >= 2 AS uses_multiple_link_types, max_transactions_per_shared_device >= 2 AS has_shared_device, max_transactions_per_shared_ip >= 2 AS has_shared_ip,
 max_transactions_per_shared_card >= 2 AS has_shared_card, distinct_devices = 1 AS single_device_group, distinct_ips = 1 AS single_ip_group, distinct_cards = 1 AS single_card_group, distinct_cards = size AS all_distinct_cards, distinct_bins > 1 AS spans_multiple_bins, distinct_merchants > 1 AS spans_multiple_merchants,
 abs(e / (size * (size - 1) / 2.0::DOUBLE) - 1) <= 1e-5 AS fully_connected FROM fr JOIN sx USING (candidate_id)""", q.PAIRS, q.LINKS, _M, _FR, q.FEATS))
def cand_flags(spark, sf):
    t, a, f = _multi_frame(spark, sf)
    return cf.flags(f, cf.topology(f), cf.shared_counts(t, a))


@register(q.assigned("SELECT candidate_id, CASE WHEN size <= 2 THEN '2' WHEN size <= 3 THEN '3' WHEN size <= 5 THEN '4-5' WHEN size <= 10 THEN '6-10' WHEN size <= 20 THEN '11-20' WHEN size <= 50 THEN '21-50' ELSE '50+' END AS size_bucket, CASE WHEN span <= 60 THEN '<=1m' WHEN span <= 300 THEN '1-5m' WHEN span <= 900 THEN '5-15m' WHEN span <= 1800 THEN '15-30m' WHEN span <= 3600 THEN '30-60m' ELSE '>60m' END AS span_bucket FROM fr", q.PAIRS, q.LINKS, _M, _FR))
def cand_buckets(spark, sf):
    return cf.buckets(_multi_frame(spark, sf)[2])


# evaluation against ground truth

_GT = """
gj AS (SELECT a.candidate_id AS group_id, o.transaction_id, o.campaign_id, o.label FROM o JOIN a USING (transaction_id)),
gc AS (SELECT group_id, campaign_id, count(*) AS n FROM gj WHERE campaign_id <> '' GROUP BY 1, 2),
gs AS (SELECT group_id, count(*) AS size FROM gj GROUP BY 1),
gt AS (SELECT group_id, size, coalesce(ct, 0)::BIGINT AS campaign_transactions, coalesce(nc, 0) AS n_distinct_campaigns, coalesce(d, '') AS dominant_campaign_id, coalesce(dn, 0) AS dominant_campaign_transactions, (size - coalesce(ct, 0))::BIGINT AS non_campaign_transactions,
  coalesce(dn, 0)::DOUBLE / size AS dominant_fraction_of_group, greatest(coalesce(dn, 0), size - coalesce(ct, 0))::BIGINT AS largest_class_transactions,
  CASE WHEN coalesce(ct, 0) = 0 THEN 'non_campaign' WHEN nc >= 2 THEN 'mixed_campaign' WHEN size > ct THEN 'pure_campaign_with_normal' ELSE 'pure_campaign' END AS purity_class
  FROM gs LEFT JOIN (SELECT group_id, sum(n) AS ct, count(*) AS nc, arg_min(campaign_id, (-n, campaign_id)) AS d, max(n) AS dn FROM gc GROUP BY 1) USING (group_id)),
ca AS (SELECT campaign_id, sum(n)::BIGINT AS campaign_transactions, coalesce(sum(n) FILTER (size >= 2), 0)::BIGINT AS transactions_in_multi_groups, count(*) FILTER (size >= 2) AS n_multi_groups, count(*) AS n_groups_including_isolated,
  coalesce(arg_min(group_id, (-n, group_id)) FILTER (size >= 2), '') AS best_group_id, coalesce(max(n) FILTER (size >= 2), 0) AS best_group_transactions FROM gc JOIN gs USING (group_id) GROUP BY 1)"""
_CA = "campaign_transactions - transactions_in_multi_groups AS transactions_isolated, best_group_transactions::DOUBLE / campaign_transactions AS best_group_share, n_multi_groups >= 1 AS is_represented, best_group_transactions::DOUBLE / campaign_transactions >= 0.5 AS is_majority_captured"


def _joined(spark, sf):
    t, a = _assigned(spark, sf)
    gt = evaluation.truth(t)
    return t, a, a.select("transaction_id", F.col("candidate_id").alias("group_id")).join(gt, "transaction_id")


@register(q.query("SELECT transaction_id, label, campaign_id FROM o"))
def ground_truth_norm(spark, sf):
    return evaluation.truth(tx(spark, sf))


@register(q.query("SELECT count(*) FILTER (label = 1 AND campaign_id = '') AS positive_without_campaign, count(*) FILTER (label = 0 AND campaign_id <> '') AS negative_with_campaign FROM o"))
def label_consistency(spark, sf):
    t = evaluation.truth(tx(spark, sf))
    return t.agg(F.count_if((F.col("label") == 1) & (F.col("campaign_id") == "")).alias("positive_without_campaign"), F.count_if((F.col("label") == 0) & (F.col("campaign_id") != "")).alias("negative_with_campaign"))


@register(q.assigned(f"SELECT * REPLACE ({r6('dominant_fraction_of_group')} AS dominant_fraction_of_group) FROM gt", _GT))
def group_table(spark, sf):
    return rounded(evaluation.group_table(_joined(spark, sf)[2]))


@register(q.assigned(f"SELECT * REPLACE ({r6('best_group_share')} AS best_group_share) FROM (SELECT *, {_CA} FROM ca)", _GT))
def campaign_table(spark, sf):
    return rounded(evaluation.campaign_table(_joined(spark, sf)[2]))


@register(q.assigned(f"""SELECT g.*, c.* FROM (SELECT count(*) AS n_groups, count(*) FILTER (size >= 2) AS n_multi_groups, count(*) FILTER (size >= 2 AND campaign_transactions > 0) AS n_attack_groups, {', '.join(f"count(*) FILTER (size >= 2 AND purity_class = '{p}') AS n_{p}" for p in ('non_campaign', 'pure_campaign', 'pure_campaign_with_normal', 'mixed_campaign'))}, {r6('sum(largest_class_transactions)::DOUBLE / sum(size)')} AS purity FROM gt) g,
 (SELECT count(*) AS n_campaigns, count(*) FILTER (is_represented) AS n_represented, count(*) FILTER (is_majority_captured) AS n_majority_captured, {r6('sum(transactions_in_multi_groups)::DOUBLE / sum(campaign_transactions)')} AS transaction_recall, {r6('avg(n_multi_groups)')} AS mean_fragmentation FROM (SELECT *, {_CA} FROM ca)) c""", _GT))
def grouping_metrics(spark, sf):
    j = _joined(spark, sf)[2]
    return rounded(evaluation.grouping_metrics(evaluation.group_table(j), evaluation.campaign_table(j)))


@register(q.query("SELECT transaction_id, bin || '#' || (sum(CASE WHEN gap IS NULL OR gap > 3600000000 THEN 1 ELSE 0 END) OVER (PARTITION BY bin ORDER BY ok ROWS UNBOUNDED PRECEDING))::BIGINT::VARCHAR AS group_id FROM (SELECT *, ts_us - lag(ts_us) OVER (PARTITION BY bin ORDER BY ok) AS gap FROM o)"))
def bin_sessions(spark, sf):
    return evaluation.sessions(tx(spark, sf), "bin", 3600)


@register(q.query(f"SELECT bin, count(*) AS n, count(DISTINCT card_fingerprint) AS n_cards, count(DISTINCT merchant_id) AS n_merchants, sum(label)::BIGINT AS n_attack, {r6('avg(label)')} AS rate FROM o GROUP BY 1"))
def bin_informativeness(spark, sf):
    return rounded(tx(spark, sf).groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("card_fingerprint").alias("n_cards"), F.count_distinct("merchant_id").alias("n_merchants"), F.sum("label").alias("n_attack"), F.avg("label").alias("rate")))


_AVG = "rank() OVER (ORDER BY {x}) + (count(*) OVER (PARTITION BY {x}) - 1) / 2.0::DOUBLE"


def _auc_sql(rows: str, x: str) -> str:
    return f"""SELECT {r6('(s - p * (p + 1) / 2.0::DOUBLE) / (p * q)')} AS auc, {r6('((s - p * (p + 1) / 2.0::DOUBLE) - p * q / 2.0::DOUBLE) / sqrt(p * q / 12.0::DOUBLE * ((p + q + 1) - t / ((p + q) * (p + q - 1))))')} AS z, p::BIGINT AS n_pos, q::BIGINT AS n_neg
 FROM (SELECT sum(label)::DOUBLE AS p, sum(1 - label)::DOUBLE AS q, sum(r * label) AS s, sum(c::DOUBLE * c - 1) AS t FROM (SELECT label, {_AVG.format(x=x)} AS r, count(*) OVER (PARTITION BY {x}) AS c FROM {rows}))"""


@register(q.query(_auc_sql("o", "round(amount, 0)")))
def rank_auc(spark, sf):
    return rounded(evaluation.rank_auc(tx(spark, sf).withColumn("value", F.round("amount", 0))))


@register()
def univariate_audit(spark, sf):
    t = transactions.from_events(spark, sf)
    f = durable(features.feature_table(t, FIXTURE).join(t.select("transaction_id", "label"), "transaction_id"), "features")
    return rounded(evaluation.univariate_audit(f, _EVERY))


@register(q.query(f"SELECT {r6('max(abs(p / sp - q / sq))')} AS ks FROM (SELECT sum(p) OVER (ORDER BY amount) AS p, sum(q) OVER (ORDER BY amount) AS q, sum(p) OVER () AS sp, sum(q) OVER () AS sq FROM (SELECT amount, sum(label)::DOUBLE AS p, sum(1 - label)::DOUBLE AS q FROM o GROUP BY 1))"))
def ks_stat(spark, sf):
    return rounded(evaluation.ks(tx(spark, sf).withColumnRenamed("amount", "value")))


@register(q.query(f"SELECT merchant_id, count(*) AS n, sum(label)::BIGINT AS n_attack, {r6('avg(label)')} AS rate, {r6('avg(label) / (SELECT avg(label) FROM o)')} AS lift FROM o GROUP BY 1"))
def attack_rate(spark, sf):
    return rounded(evaluation.rate_by(tx(spark, sf), "merchant_id"))


@register(q.query(f"SELECT merchant_id, count(amount) AS n, {', '.join(f'{r6(f"quantile_cont(amount, {s})")} AS q{round(s * 100):02d}' for s in (0.05, 0.25, 0.5, 0.75, 0.95))} FROM o GROUP BY 1"))
def quantile_summary(spark, sf):
    return rounded(evaluation.quantiles(tx(spark, sf), "amount", "merchant_id"))


_SL = "sl AS (SELECT candidate_id, round(score, 6) AS score, label FROM ss JOIN (SELECT candidate_id, max(label) AS label FROM t GROUP BY 1) USING (candidate_id))"
_CUM = "SELECT score, p, n, sum(p) OVER w AS tp, sum(n) OVER w AS seen, sum(p) OVER () AS al FROM (SELECT score, sum(label)::DOUBLE AS p, count(*)::DOUBLE AS n FROM sl GROUP BY 1) WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING)"


def _labelled(spark, sf):
    t, a, f, ref, table = _scored(spark, sf)
    lab = t.join(a.select("transaction_id", "candidate_id"), "transaction_id").groupBy("candidate_id").agg(F.max("label").alias("label"))
    return sco.transform(f, ref, table).select("candidate_id", F.round("score", 6).alias("score")).join(lab, "candidate_id")


@register(q.assigned(f"SELECT {r6('sum(p / nullif(al, 0) * tp / seen)')} AS average_precision, max(al)::BIGINT AS n_pos, sum(n)::BIGINT AS n FROM ({_CUM})", q.FEATS, q.SCORED, _SL))
def average_precision(spark, sf):
    return rounded(evaluation.average_precision(_labelled(spark, sf)))


@register(q.assigned(f"SELECT tp, fp, fn, tn, {r6('coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0)')} AS precision, {r6('coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0)')} AS recall, {r6('coalesce(2.0::DOUBLE * tp / nullif(2 * tp + fp + fn, 0), 0)')} AS f1 FROM (SELECT count(*) FILTER (score >= 0.5 AND label = 1) AS tp, count(*) FILTER (score >= 0.5 AND label = 0) AS fp, count(*) FILTER (score < 0.5 AND label = 1) AS fn, count(*) FILTER (score < 0.5 AND label = 0) AS tn FROM sl)", q.FEATS, q.SCORED, _SL))
def confusion(spark, sf):
    return rounded(evaluation.confusion(_labelled(spark, sf), 0.5))


@register(q.assigned(f"SELECT score AS threshold, round(2 * tp / nullif(seen + al, 0), 6) AS f1 FROM ({_CUM}) ORDER BY round(2 * tp / nullif(seen + al, 0), 12) DESC, score LIMIT 1", q.FEATS, q.SCORED, _SL))
def select_threshold(spark, sf):
    return rounded(evaluation.select_threshold(_labelled(spark, sf)))


@register(q.assigned("SELECT candidate_id, split FROM (SELECT candidate_id, CASE WHEN r <= round(n * 0.7) THEN 'train' WHEN r <= round(n * 0.85) THEN 'validation' ELSE 'test' END AS split FROM (SELECT *, min(r0) OVER (PARTITION BY last_ts_us) AS r FROM (SELECT candidate_id, last_ts_us, row_number() OVER (ORDER BY last_ts_us, candidate_id) AS r0, count(*) OVER () AS n FROM f)))", q.FEATS))
def chrono_split(spark, sf):
    return evaluation.chronological_split(_scored(spark, sf)[2], "candidate_id", "last_ts_us").select("candidate_id", "split")


@register(q.query("SELECT x.campaign_id AS a, y.campaign_id AS b FROM (SELECT campaign_id, min(ts_us) AS f, max(ts_us) AS l FROM o WHERE campaign_id <> '' GROUP BY 1) x JOIN (SELECT campaign_id, min(ts_us) AS f, max(ts_us) AS l FROM o WHERE campaign_id <> '' GROUP BY 1) y ON x.campaign_id < y.campaign_id AND x.f <= y.l AND y.f <= x.l"))
def campaign_overlap(spark, sf):
    t = tx(spark, sf).where("campaign_id <> ''").groupBy("campaign_id").agg(F.min("ts_us").alias("f"), F.max("ts_us").alias("l"))
    return evaluation.interval_overlaps(t, "campaign_id", "f", "l")


# rows over time, models

@register(q.query("SELECT transaction_id, CASE WHEN r <= round(n * 0.7) THEN 'train' WHEN r <= round(n * 0.85) THEN 'validation' ELSE 'test' END AS split FROM (SELECT *, min(r0) OVER (PARTITION BY ts_us) AS r FROM (SELECT transaction_id, ts_us, row_number() OVER (ORDER BY ts_us, transaction_id) AS r0, count(*) OVER () AS n FROM o))"))
def chrono_split_rows(spark, sf):
    return evaluation.chronological_split(tx(spark, sf), "transaction_id", "ts_us").select("transaction_id", "split")


@register(q.query(f"SELECT h AS hour_us, count(transaction_id) AS n, coalesce(sum(label), 0)::BIGINT AS n_positive, {r6('avg(label)')} AS rate FROM (SELECT unnest(range((SELECT min(ts_us) // 3600000000 FROM o), (SELECT max(ts_us) // 3600000000 FROM o) + 1)) * 3600000000 AS h) LEFT JOIN o ON ts_us // 3600000000 * 3600000000 = h GROUP BY 1"))
def hourly_profile(spark, sf):
    return rounded(ml.hourly_profile(tx(spark, sf)))


@register()
def baseline_model(spark, sf):
    t = evaluation.chronological_split(tx(spark, sf).select("transaction_id", "label", "ts_us"), "transaction_id", "ts_us")
    f = durable(features.feature_table(transactions.from_events(spark, sf), FIXTURE).join(t, "transaction_id"), "features")
    model, plan = ml.train(f.where("split = 'train'"), _EVERY, max_iter=30)
    test = f.where("split = 'test'")
    return ml.score_block(ml.predict(model, plan, test).join(test.select("transaction_id", "label"), "transaction_id"))


# perturbations

_C = "WHERE campaign_id <> ''"


@register(q.query("SELECT transaction_id, CASE WHEN campaign_id <> '' THEN s + round_even((ts_us - s) * 0.5::DOUBLE, 0)::BIGINT ELSE ts_us END AS ts_us FROM (SELECT *, min(ts_us) OVER (PARTITION BY campaign_id) AS s FROM o)"))
def scale_cadence(spark, sf):
    return perturb.scale_cadence(tx(spark, sf), 0.5).select("transaction_id", "ts_us")


@register(q.query("SELECT transaction_id, CASE WHEN campaign_id <> '' AND r <= round_even(n * 0.25::DOUBLE, 0) THEN 'fresh-device-' || transaction_id ELSE device_fingerprint END AS device_fingerprint FROM (SELECT *, row_number() OVER (PARTITION BY campaign_id <> '' ORDER BY sha256('11:' || transaction_id)) AS r, count(*) OVER (PARTITION BY campaign_id <> '') AS n FROM o)"))
def weaken_reuse(spark, sf):
    return perturb.weaken_reuse(tx(spark, sf), "device", 0.25, 11).select("transaction_id", "device_fingerprint")


@register(q.query("SELECT transaction_id, CASE WHEN campaign_id <> '' THEN ts_us - s + 1704067200000000 ELSE ts_us END AS ts_us FROM (SELECT *, min(ts_us) OVER (PARTITION BY campaign_id) AS s FROM o)"))
def align_time(spark, sf):
    return perturb.align_time(tx(spark, sf), 1704067200000000).select("transaction_id", "ts_us")


@register(q.query("SELECT transaction_id, ts_us FROM o WHERE ts_us <= (SELECT floor(quantile_cont(ts_us, 0.5))::BIGINT FROM o)"))
def right_censor(spark, sf):
    return perturb.right_censor(tx(spark, sf), 0.5).select("transaction_id", "ts_us")


@register(q.query("SELECT transaction_id FROM (SELECT *, count(*) OVER (PARTITION BY campaign_id) AS n, row_number() OVER (PARTITION BY campaign_id ORDER BY ok) AS r FROM o) WHERE campaign_id = '' OR n < 2 OR r <= greatest(1, floor(n * 0.5))"))
def truncate_tails(spark, sf):
    return perturb.truncate_tails(tx(spark, sf), 0.5).select("transaction_id")


@register(q.query(f"SELECT campaign_id, count(*) AS n, round((max(ts_us) - min(ts_us)) / 1000000.0::DOUBLE, 7) AS span_seconds, {r7('median(gap)')} AS median_gap FROM (SELECT *, (ts_us - lag(ts_us) OVER (PARTITION BY campaign_id ORDER BY ts_us, transaction_id)) / 1000000.0::DOUBLE AS gap FROM o {_C}) GROUP BY 1"))
def cadence_profile(spark, sf):
    return rounded(perturb.cadence_profile(tx(spark, sf)), 7)


@register(q.query(f"SELECT campaign_id, count(*) AS n, {', '.join(f'{r6(f"1 - count(DISTINCT {ENTITY_COLUMN[e]})::DOUBLE / count(*)")} AS {e}_reuse' for e in ('card', 'device', 'ip'))} FROM o {_C} GROUP BY 1"))
def reuse_profile(spark, sf):
    return rounded(perturb.reuse_profile(tx(spark, sf)))


@register(q.query("SELECT s AS share, (SELECT count(*) FROM o WHERE ts_us <= c) AS n, c >= coalesce(lag(c) OVER (ORDER BY s), c) AS nested FROM (SELECT unnest([0.25, 0.5, 0.75, 0.9]) AS s, unnest((SELECT [floor(quantile_cont(ts_us, 0.25)), floor(quantile_cont(ts_us, 0.5)), floor(quantile_cont(ts_us, 0.75)), floor(quantile_cont(ts_us, 0.9))] FROM o)) AS c)".replace("[0.25, 0.5, 0.75, 0.9]", "[0.25::DOUBLE, 0.5::DOUBLE, 0.75::DOUBLE, 0.9::DOUBLE]")))
def censor_nesting(spark, sf):
    t = tx(spark, sf)
    shares = (0.25, 0.5, 0.75, 0.9)
    cuts = t.agg(F.percentile("ts_us", F.array(*map(F.lit, shares)))).first()[0]
    one = t.agg(*[F.count_if(F.col("ts_us") <= int(c)).alias(f"n{i}") for i, c in enumerate(cuts)])
    rows = F.array(*[F.struct(F.lit(s).alias("share"), F.col(f"n{i}").alias("n"), (F.col(f"n{i}") >= (F.col(f"n{i - 1}") if i else F.lit(0))).alias("nested")) for i, s in enumerate(shares)])
    return one.select(F.explode(rows).alias("x")).select("x.*")


@register()
def perturbed_worlds(spark, sf):
    t = tx(spark, sf)
    arms = {"jitter": lambda d: perturb.jitter(d, 60, 3), "resample": lambda d: perturb.resample_legitimate(d, 0.5, 5), "bursts": lambda d: perturb.inject_bursts(d, 3, 8, 300, 9)}
    out = None
    for name, f in arms.items():
        s = perturb.summary(t, f(t), ("ts_us", "device_fingerprint")).withColumn("arm", F.lit(name))
        out = s if out is None else out.unionByName(s)
    return out


# checks

@register(q.query("SELECT count(*) FILTER (c > 1) AS n_repeated, count(*) AS n_ids FROM (SELECT transaction_id, count(*) AS c FROM o GROUP BY 1)"))
def dq_unique(spark, sf):
    return validate.repeated_ids(tx(spark, sf))


@register(q.query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) FILTER ({c} IS NULL OR trim({c}) = '') AS n_blank FROM o" for c in validate.IDS)))
def dq_blank(spark, sf):
    return validate.blanks(tx(spark, sf))


@register(q.query("SELECT transaction_id, CASE WHEN amount <= 0 THEN 'amount must be finite and positive' END AS problem FROM o"))
def validate_transactions(spark, sf):
    """Over the rows as they come: the strict check has no place for columns of the engine's own."""
    return validate.row_problems(transactions.production(transactions.from_events(spark, sf)))


@register()
def frame_fingerprint(spark, sf):
    return validate.fingerprint(transactions.from_events(spark, sf))


# online surface

@register(q.assigned("SELECT candidate_id, md5(count(*)::VARCHAR || ':' || sum(('0x' || substr(md5(transaction_id), 1, 15))::BIGINT::HUGEINT)::VARCHAR || ':' || sum(('0x' || substr(md5(transaction_id), 16, 15))::BIGINT::HUGEINT)::VARCHAR) AS candidate_key FROM a WHERE candidate_size > 1 GROUP BY 1"))
def candidate_key(spark, sf):
    return online.candidate_key(_assigned(spark, sf)[1])


@register(q.query("SELECT transaction_id, CASE WHEN len(transaction_id) > 8 THEN left(transaction_id, 8) || '…' ELSE transaction_id END AS masked FROM o"))
def mask_identifier(spark, sf):
    return tx(spark, sf).select("transaction_id", online.masked("transaction_id").alias("masked"))


# more of the evaluation and sources

@register(q.query("SELECT transaction_id, ts_us, row_number() OVER (ORDER BY ts_us, transaction_id) AS cursor FROM o WHERE amount > 0 ORDER BY ts_us, transaction_id LIMIT 500"))
def replay_source(spark, sf):
    """The first 500 valid rows in time order: the cap is what a replay is."""
    return replay.replay(tx(spark, sf))


@register(q.assigned(f"SELECT purity_class, count(*) AS n, sum(size)::BIGINT AS n_transactions, {r6('count(*)::DOUBLE / sum(count(*)) OVER ()')} AS share FROM gt WHERE size >= 2 GROUP BY 1", _GT))
def group_summary(spark, sf):
    return rounded(evaluation.group_summary(evaluation.group_table(_joined(spark, sf)[2])))


_HIT = "hc AS (SELECT t.campaign_id, t.candidate_id, score >= 0.5 AS hit FROM t JOIN (SELECT candidate_id, round(score, 6) AS score FROM ss) USING (candidate_id))"


@register(q.assigned(f"SELECT n_campaigns, n_detected, {r6('n_detected::DOUBLE / n_campaigns')} AS campaign_recall, n_alerts, n_false_alerts FROM (SELECT (SELECT count(DISTINCT campaign_id) FROM o WHERE campaign_id <> '') AS n_campaigns, count(DISTINCT campaign_id) FILTER (hit AND campaign_id <> '') AS n_detected, count(DISTINCT candidate_id) FILTER (hit) AS n_alerts, (count(DISTINCT candidate_id) FILTER (hit) - count(DISTINCT candidate_id) FILTER (hit AND campaign_id <> ''))::BIGINT AS n_false_alerts FROM hc)", q.FEATS, q.SCORED, _HIT))
def campaign_metrics(spark, sf):
    t, a, f, ref, table = _scored(spark, sf)
    s = sco.transform(f, ref, table).select("candidate_id", F.round("score", 6).alias("score"))
    return rounded(evaluation.campaign_metrics(t.join(a.select("transaction_id", "candidate_id"), "transaction_id"), s, 0.5))


@register(q.assigned(f"SELECT candidate_id, {r6('(rank() OVER (ORDER BY size) + (count(*) OVER (PARTITION BY size) - 1) / 2.0::DOUBLE) / count(*) OVER ()')} AS by_size, {r6('(rank() OVER (ORDER BY burst_rate_per_minute) + (count(*) OVER (PARTITION BY burst_rate_per_minute) - 1) / 2.0::DOUBLE) / count(*) OVER ()')} AS by_rate FROM f", q.FEATS))
def comparators(spark, sf):
    f = _scored(spark, sf)[2]
    return rounded(evaluation.comparators(f, {"by_size": "size", "by_rate": "burst_rate_per_minute"}))


@register(q.assigned(f"SELECT budget, {r6('threshold')} AS threshold, count(*) FILTER (score >= threshold) AS n_alerts, count(*) FILTER (score >= threshold AND label = 1) AS n_hits FROM sl, (SELECT unnest([0.01::DOUBLE, 0.02::DOUBLE, 0.05::DOUBLE, 0.1::DOUBLE]) AS budget, unnest((SELECT [quantile_cont(score, 0.99), quantile_cont(score, 0.98), quantile_cont(score, 0.95), quantile_cont(score, 0.9)] FROM sl)) AS threshold) GROUP BY 1, threshold", q.FEATS, q.SCORED, _SL))
def recall_exchange(spark, sf):
    return rounded(evaluation.recall_exchange(_labelled(spark, sf)))


@register(q.assigned("SELECT candidate_id, count(*) FILTER (campaign_id <> '') AS campaign_transactions, count(*) FILTER (campaign_id = '') AS non_campaign_transactions, count(DISTINCT campaign_id) FILTER (campaign_id <> '') AS n_distinct_campaigns, sum(label)::BIGINT AS label1_transactions, count(*) FILTER (campaign_id <> '') > 0 AS is_attack_containing FROM t GROUP BY 1"))
def attach_groups(spark, sf):
    t, a = _assigned(spark, sf)
    return evaluation.attach_groups(a, evaluation.truth(t))


@register()
def explain_campaign(spark, sf):
    _, _, f, ref, table = _scored(spark, sf)
    return sco.explain_campaigns(sco.transform(f, ref, table), ref)
