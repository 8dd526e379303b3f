"""Named queries over the fixture tables, each with its SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.operators import candidates, causal, features, graph, related, scoring
from skein.plans import oracle as q
from skein.plans.config import ENTITIES, ENTITY_COLUMN, FIXTURE, FeatureConfig
from skein.plans.durable import durable
from skein.sources import transactions

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def register(sql: str | None = None, name: str | None = None):
    def put(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLE_SQL[name or f.__name__] = sql
        return f

    return put


def tx(spark: SparkSession, sf: str) -> DataFrame:
    """The transaction view with its causal key and channels."""
    return causal.channels(causal.ordered(transactions.from_events(spark, sf)))


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles rounded, and without negative zeros."""
    return df.select(*[(F.round(c, places) + F.lit(0.0)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


def r6(x: str) -> str:
    return f"(round({x}, 6) + 0.0::DOUBLE)"


# sources and checks

@register(q.query('SELECT transaction_id, merchant_id, card_fingerprint, bin, amount, device_fingerprint, ip_signature, auth_outcome, epoch_us("timestamp") AS ts_us FROM tx'))
def scan_typed(spark, sf):
    t = transactions.from_events(spark, sf)
    raw = t.select(*[F.col(c).cast("string").alias(c) for c in t.columns])
    t = transactions.production(transactions.typed(raw))
    return t.withColumn("ts_us", causal.micros(t)).drop("timestamp")


@register(q.query("SELECT transaction_id, card_fingerprint, device_fingerprint, ip_signature FROM tx"))
def scan_allowlist(spark, sf):
    return transactions.from_events(spark, sf).select("transaction_id", "card_fingerprint", "device_fingerprint", "ip_signature")


@register(q.query("SELECT transaction_id, trim(card_fingerprint) AS card, amount, lower(trim(auth_outcome)) AS auth FROM tx"))
def scan_attributes(spark, sf):
    return transactions.from_events(spark, sf).select("transaction_id", F.trim("card_fingerprint").alias("card"), "amount", F.lower(F.trim("auth_outcome")).alias("auth"))


@register(q.query("SELECT transaction_id, declined FROM o", ))
def declined_channel(spark, sf):
    return tx(spark, sf).select("transaction_id", "declined")


@register(q.query("SELECT transaction_id, amount, declined, low_value FROM o"))
def channels(spark, sf):
    return tx(spark, sf).select("transaction_id", "amount", "declined", "low_value")


@register(q.query("SELECT transaction_id, row_number() OVER (ORDER BY ok) - 1 AS position FROM o"))
def causal_order(spark, sf):
    return causal.causal_order(tx(spark, sf))


# causal windows: card, device and merchant over a day

_DAY = 86400


def _window(name: str, make, sql: str, entity: str = "card", seconds: int | None = _DAY) -> None:
    w = q.window(entity, seconds)

    @register(q.query(f"SELECT transaction_id, {q.known(entity, sql.format(w=w))} AS value FROM o"), name)
    def run(spark, sf):
        return rounded(tx(spark, sf).select("transaction_id", make(causal.Past(entity, seconds)).alias("value")))


_window("win_count", lambda p: p.count(), "count(*) OVER {w}")
_window("win_sum", lambda p: p.sum("amount"), r6("coalesce(sum(amount) OVER {w}, 0.0)"), "device")
_window("win_mean", lambda p: p.mean("amount"), r6("avg(amount) OVER {w}"))
_window("win_std", lambda p: p.std("amount"), r6("stddev_samp(amount) OVER {w}"))
_window("win_median", lambda p: p.median("amount"), r6("median(amount) OVER {w}"))
_window("win_lifetime_count", lambda p: p.count(), "count(*) OVER {w}", "device", None)


def _variety(name: str, kind: str, sql: str) -> None:
    @register(q.query(f"SELECT transaction_id, {sql.format(w=q.window('card', _DAY))} AS value FROM o"), name)
    def run(spark, sf):
        t = tx(spark, sf)
        got = causal.variety(t, "card", "merchant", (_DAY,)).select("ok", F.col(f"{kind}_{_DAY}").alias("value"))
        return rounded(t.select("ok", "transaction_id").join(got, "ok", "left").drop("ok"))


_variety("win_nunique", "distinct", "count(DISTINCT merchant_id) OVER {w}")
_variety("win_entropy", "entropy", r6(q.entropy("merchant_id", "{w}")))


def _related_sql(actor: str, seconds: int) -> str:
    c, us = ENTITY_COLUMN[actor], seconds * 1_000_000
    return f"""(SELECT transaction_id, count(*) AS n FROM (
      SELECT m.transaction_id, m.a FROM (SELECT DISTINCT x.transaction_id, x.ok, x.ts_us, y.{c} AS a FROM o x JOIN o y ON x.merchant_id = y.merchant_id AND y.ok < x.ok AND y.ts_us >= x.ts_us - {us}) m
      JOIN o z ON z.{c} = m.a AND z.ok < m.ok AND z.ts_us >= m.ts_us - {us} GROUP BY 1, 2 HAVING count(DISTINCT z.merchant_id) >= 2) GROUP BY 1)"""


@register(q.query(f"SELECT o.transaction_id, coalesce(n, 0) AS related FROM o LEFT JOIN {_related_sql('device', _DAY)} USING (transaction_id)"))
def related_entities(spark, sf):
    return related.related_counts(tx(spark, sf), "device_fingerprint", _DAY).drop("ok")


# feature groups

def _feature_sql(config: FeatureConfig) -> dict[str, str]:
    """Each feature as a DuckDB expression over ``o``."""
    out: dict[str, str] = {}
    n = lambda e, w: f"count(*) OVER {q.window(e, w)}"
    gate = lambda v, s, k: f"CASE WHEN {s} >= {k} THEN {v} END"
    div = lambda a, b: f"CASE WHEN abs({b}) > 1e-12 THEN ({a}) / ({b}) END"
    for w in config.of("amount"):
        for e in ("card", "device"):
            x = q.window(e, w)
            mean, std = f"avg(amount) OVER {x}", f"stddev_samp(amount) OVER {x}"
            out |= {f"amt_{e}_mean_{w}s": mean, f"amt_{e}_median_{w}s": f"median(amount) OVER {x}", f"amt_{e}_std_{w}s": gate(std, n(e, w), 3), f"amt_{e}_dev_{w}s": f"amount - {mean}",
                    f"amt_{e}_z_{w}s": gate(div(f"amount - {mean}", std), n(e, w), 3), f"amt_{e}_cv_{w}s": gate(div(std, mean), n(e, w), 3)}
        out[f"amt_card_low_value_ratio_{w}s"] = gate(f"avg(low_value) OVER {q.window('card', w)}", n("card", w), 3)
    d = lambda e, c, w: f"count(DISTINCT {c}) OVER {q.window(e, w)}"
    for w in config.of("bin"):
        out |= {f"bin_txn_count_{w}s": n("bin", w), f"bin_distinct_cards_{w}s": d("bin", "card_fingerprint", w), f"bin_distinct_merchants_{w}s": d("bin", "merchant_id", w), f"dev_distinct_bins_{w}s": d("device", "bin", w), f"ip_distinct_bins_{w}s": d("ip", "bin", w)}
    for w in config.of("decline"):
        for e in ("card", "device", "ip", "merchant"):
            out[f"dec_{e}_rate_{w}s"] = gate(f"avg(declined) OVER {q.window(e, w)}", n(e, w), 3)
    out["dev_reuse_prior_total"] = n("device", None)
    for w in config.of("device"):
        out[f"dev_distinct_cards_{w}s"] = d("device", "card_fingerprint", w)
    for w in config.of("merchant"):
        out[f"mer_txn_count_{w}s"] = n("merchant", w)
        for e in ("card", "device", "ip"):
            k = d(e, "merchant_id", w)
            out |= {f"{e}_distinct_merchants_{w}s": k, f"{e}_merchant_spread_{w}s": gate(f"({k})::DOUBLE / ({n(e, w)})", n(e, w), 2), f"{e}_merchant_entropy_{w}s": q.entropy("merchant_id", q.window(e, w))}
    v = config.of("velocity")
    for e in ("card", "device", "ip"):
        out |= {f"vel_{e}_count_{w}s": n(e, w) for w in v}
        out[f"vel_{e}_burst_density_{v[0]}s_{v[-1]}s"] = div(f"({n(e, v[0])})::DOUBLE", f"({n(e, v[-1])}) * {float(v[0])}::DOUBLE / {float(v[-1])}::DOUBLE")
    return out


_SQL = _feature_sql(FIXTURE)
_LONG = ("count(", "CASE WHEN abs")


def _typed_sql(names: list[str]) -> str:
    whole = {f.name for f in features.declared(FIXTURE) if "distinct" in f.name or "count" in f.name or f.name == "dev_reuse_prior_total"}
    return ", ".join(f"{_SQL[n]} AS {n}" if n in whole and "spread" not in n else f"{r6(_SQL[n])} AS {n}" for n in names)


def _is_related(f: features.Feature) -> bool:
    return f.name.startswith("merchant_related_")


def _related_joins(names: list[str]) -> tuple[str, str]:
    """Columns and joins of related features, which SQL computes as tables of their own."""
    mine = [n for n in names if n.startswith("merchant_related_")]
    parts = [n.removeprefix("merchant_related_").split("s_") for n in mine]
    return "".join(f", coalesce(r{i}.n, 0) AS {n}" for i, n in enumerate(mine)), "".join(f" LEFT JOIN {_related_sql(e, int(w.rstrip('s')))} r{i} ON r{i}.transaction_id = o.transaction_id" for i, (e, w) in enumerate(parts))


def _feature_query(names: list[str]) -> str:
    more, joins = _related_joins(names)
    return f"SELECT o.transaction_id, {_typed_sql([n for n in names if n in _SQL])}{more} FROM o{joins}"


def _group(group: str) -> None:
    names = [f.name for f in features.declared(FIXTURE, (group,))]

    @register(q.query(_feature_query(names)), f"feat_{group}")
    def run(spark, sf):
        return rounded(features.feature_table(transactions.from_events(spark, sf), FIXTURE, (group,)))


for _g in ("amount", "bin", "decline", "device", "merchant", "velocity"):
    _group(_g)

_EVERY = [f.name for f in features.declared(FIXTURE)]
_RELATED = [f.name for f in features.declared(FIXTURE, ("merchant",)) if _is_related(f)]


@register(q.query(f"SELECT o.transaction_id{_related_joins(_RELATED)[0]} FROM o{_related_joins(_RELATED)[1]}"))
def feat_related(spark, sf):
    return features.feature_table(transactions.from_events(spark, sf), FIXTURE, ("merchant",), tuple(_RELATED))


@register(q.query(_feature_query(_EVERY)))
def feature_table(spark, sf):
    """All 156 columns."""
    return rounded(features.feature_table(transactions.from_events(spark, sf), FIXTURE))


def _features(spark, sf, round_: bool = True):
    """All feature columns as a written table, for what reads it column by column."""
    f = features.feature_table(transactions.from_events(spark, sf), FIXTURE)
    return durable(rounded(f) if round_ else f, "features")


@register()
def feature_dictionary(spark, sf):
    return features.dictionary(spark, FIXTURE)


_STATS = " UNION ALL ".join(f"SELECT '{n}' AS name, count(*) AS n, (count(*) - count({n}))::BIGINT AS n_null, {r6(f'min({n})::DOUBLE')} AS min, {r6(f'max({n})::DOUBLE')} AS max, count(DISTINCT {n}) AS n_unique FROM ft" for n in _EVERY)


@register(q.query(_STATS, f"\nft AS MATERIALIZED ({_feature_query(_EVERY)})"))
def feature_dictionary_stats(spark, sf):
    return rounded(features.observed(_features(spark, sf)))


_RANGED = [f for f in features.declared(FIXTURE) if f.low is not None or f.high is not None]


@register(q.query(" UNION ALL ".join(f"SELECT '{f.name}' AS name, count(*) FILTER ({' OR '.join([*([f'{f.name} < {f.low}'] if f.low is not None else []), *([f'{f.name} > {f.high}'] if f.high is not None else [])])}) AS n_bad FROM ft" for f in _RANGED), f"\nft AS MATERIALIZED ({_feature_query(_EVERY)})"))
def dq_ranges(spark, sf):
    return features.out_of_range(_features(spark, sf, False), FIXTURE)


# graph

@register(q.query("SELECT transaction_id, ts_us, entity_type, entity_id, entity_type || ':' || entity_id AS entity_key FROM ed", q.EDGES))
def graph_edges(spark, sf):
    return graph.edges(tx(spark, sf)).drop("ok")


@register(q.query("SELECT 'transaction:' || transaction_id AS node_key, 'transaction' AS node_type, transaction_id AS node_id, ts_us FROM o UNION ALL SELECT DISTINCT entity_type || ':' || entity_id, entity_type, entity_id, -1::BIGINT FROM ed", q.EDGES))
def graph_nodes(spark, sf):
    return graph.nodes(tx(spark, sf)).withColumn("ts_us", F.coalesce("ts_us", F.lit(-1).cast("long")))


@register(q.query(f"SELECT count(*) AS n_transactions, ({' + '.join(f'count({c})' for c in ENTITY_COLUMN.values())})::BIGINT AS n_edges, {', '.join(f'count(DISTINCT {ENTITY_COLUMN[t]}) AS n_{t}s' for t in ENTITIES)}, min(ts_us) AS first_ts_us, max(ts_us) AS last_ts_us FROM o"))
def graph_summary(spark, sf):
    return graph.summary(tx(spark, sf))


@register(q.query("SELECT transaction_id, entity_type, entity_id FROM ed WHERE transaction_id = '000000000007'", q.EDGES))
def txn_lookup(spark, sf):
    return graph.lookup(tx(spark, sf), "000000000007")


@register(q.query("SELECT entity_type, count(DISTINCT entity_id) AS n_entities, count(*) AS n_edges FROM ed GROUP BY 1", q.EDGES))
def entity_counts(spark, sf):
    return graph.entity_counts(tx(spark, sf))


@register(q.query("SELECT transaction_id, ts_us, row_number() OVER (ORDER BY ok) AS nth FROM o WHERE card_fingerprint = 'C3'"))
def entity_history(spark, sf):
    return graph.history(tx(spark, sf), "card", "C3")


@register(q.query("SELECT * FROM nb", q.EDGES, q.PAIRS))
def neighbors_causal(spark, sf):
    return graph.neighbours(tx(spark, sf))


@register(q.query("SELECT * FROM nb UNION ALL SELECT neighbour_id, transaction_id, entity_type, entity_id, -delta_us FROM nb", q.EDGES, q.PAIRS))
def neighbors_symmetric(spark, sf):
    return graph.neighbours(tx(spark, sf), causal=False)


@register(q.query("SELECT nb2.a, nb2.b, string_agg(x.entity_type, '|' ORDER BY list_position(['card', 'device', 'ip', 'bin', 'merchant'], x.entity_type)) AS entity_types FROM (SELECT DISTINCT transaction_id AS a, neighbour_id AS b FROM nb) nb2 JOIN ed x ON x.transaction_id = nb2.a JOIN ed y ON y.transaction_id = nb2.b AND x.entity_type = y.entity_type AND x.entity_id = y.entity_id GROUP BY 1, 2", q.EDGES, q.PAIRS))
def shared_entities(spark, sf):
    t = tx(spark, sf)
    return graph.shared_entities(t, graph.neighbours(t).select(F.col("transaction_id").alias("a"), F.col("neighbour_id").alias("b")).distinct())


@register(q.query(f"SELECT entity_type, count(*) AS n_distinct, {r6('avg(c)')} AS mean_fanout, median(c)::DOUBLE AS median_fanout, max(c) AS max_fanout FROM (SELECT entity_type, entity_id, count(*) AS c FROM ed GROUP BY 1, 2) GROUP BY 1", q.EDGES))
def entity_fanout(spark, sf):
    return graph.fanout(tx(spark, sf))


@register(q.query("SELECT entity_type, entity_id, src, dst, gap_us FROM ch", q.EDGES, q.CHAIN))
def chain_edges(spark, sf):
    return graph.chain_edges(tx(spark, sf)).drop("src_ok", "dst_ok")


# candidates

def _assigned(spark, sf):
    t = durable(tx(spark, sf), "transactions")
    return t, durable(candidates.assignments(candidates.components(t)), "assignments")


@register(q.query("SELECT * FROM lk", q.EDGES, q.PAIRS, q.LINKS))
def causal_links(spark, sf):
    return candidates.causal_links(tx(spark, sf))


@register(q.query("SELECT transaction_id AS anchor_transaction_id, neighbour_id AS prior_transaction_id, entity_type AS link_entity_type, entity_id AS link_entity_id FROM nb", q.EDGES, q.PAIRS))
def links_exploded(spark, sf):
    return candidates.explode_links(candidates.causal_links(tx(spark, sf)))


@register(q.query("SELECT anchor_transaction_id, count(*) AS n_priors, string_agg(prior_transaction_id, '|' ORDER BY prior_transaction_id) AS prior_ids, min(delta_seconds) AS oldest_delta FROM lk GROUP BY 1", q.EDGES, q.PAIRS, q.LINKS))
def causal_candidate(spark, sf):
    return candidates.causal_candidate(candidates.causal_links(tx(spark, sf)))


@register(q.query("SELECT transaction_id, co.root FROM o JOIN co USING (ok)", q.EDGES, q.CHAIN, q.COMP))
def components(spark, sf):
    return candidates.components(tx(spark, sf)).select("transaction_id", "root")


@register(q.assigned("SELECT DISTINCT candidate_id, candidate_size FROM a"))
def candidate_ids(spark, sf):
    return _assigned(spark, sf)[1].select("candidate_id", "candidate_size").distinct()


@register(q.assigned("SELECT transaction_id, ts_us, candidate_id, candidate_size, is_isolated FROM a"))
def assignments(spark, sf):
    return _assigned(spark, sf)[1].drop("ok")


_IDS = lambda c: f"string_agg(DISTINCT {c}, '|' ORDER BY {c})"
_FRAME = f"""SELECT candidate_id, count(*) AS size, min(ts_us) AS first_ts_us, max(ts_us) AS last_ts_us, {', '.join(f'count(DISTINCT {ENTITY_COLUMN[e]}) AS distinct_{e}s' for e in ('card', 'device', 'ip', 'merchant', 'bin'))},
 {_IDS('bin')} AS bin_ids_context, {_IDS('transaction_id')} AS transaction_ids, coalesce(any_value(e), 0) AS link_edge_count, coalesce(any_value(m), 0) AS links_multi_entity, coalesce(any_value(lc), 0) AS links_card, coalesce(any_value(ld), 0) AS links_device,
 coalesce(any_value(li), 0) AS links_ip, (max(ts_us) - min(ts_us)) / 1000000.0::DOUBLE AS time_span_seconds, count(*) = 1 AS is_isolated
 FROM t LEFT JOIN (SELECT candidate_id, count(*) AS e, count(*) FILTER (n_link_entity_types > 1) AS m, count(*) FILTER (shares_card) AS lc, count(*) FILTER (shares_device) AS ld, count(*) FILTER (shares_ip) AS li FROM lk JOIN a ON a.transaction_id = anchor_transaction_id GROUP BY 1) USING (candidate_id) GROUP BY candidate_id"""


@register(q.assigned(_FRAME, q.PAIRS, q.LINKS))
def candidate_frame(spark, sf):
    t, a = _assigned(spark, sf)
    return candidates.candidate_frame(t, a, list_ids=True)


_OV = ", ".join(f"count(*) FILTER (entity_type = '{t}') AS n_shared_{t}s, coalesce(string_agg(entity_id, '|' ORDER BY entity_id) FILTER (entity_type = '{t}'), '') AS shared_{t}_ids, coalesce(max(c) FILTER (entity_type = '{t}'), 0) AS max_transactions_per_shared_{t}" for t in ("card", "device", "ip"))


@register(q.assigned(f"SELECT candidate_id, {_OV} FROM sh WHERE c > 1 GROUP BY 1", q.FEATS))
def candidate_overlap(spark, sf):
    return candidates.overlap(*_assigned(spark, sf))


@register(q.assigned(f"SELECT count(*) AS n_candidates, count(*) FILTER (s > 1) AS n_multi, coalesce(sum(s) FILTER (s > 1), 0)::BIGINT AS n_multi_transactions, max(s) AS max_size, (median(s) FILTER (s > 1))::DOUBLE AS median_multi_size, {r6('median(p) FILTER (s > 1)')} AS median_multi_span FROM (SELECT candidate_id, count(*) AS s, (max(ts_us) - min(ts_us)) / 1000000.0::DOUBLE AS p FROM a GROUP BY 1)"))
def candidate_summary(spark, sf):
    return candidates.summary(_assigned(spark, sf)[1])


# scoring

_NUM = list(scoring.SIGNS)


@register(q.assigned(f"SELECT candidate_id, size, first_ts_us, last_ts_us, {', '.join(f'{r6(n)} AS {n}' for n in q.FEATURES if n != 'max_transactions_per_shared_card')}, max_transactions_per_shared_card FROM f", q.FEATS))
def scoring_features(spark, sf):
    return rounded(scoring.scoring_features(*_assigned(spark, sf)))


def _scored(spark, sf):
    t, a = _assigned(spark, sf)
    f = durable(scoring.scoring_features(t, a), "scoring-features")
    ref, table = scoring.fit(f)
    return t, a, f, ref, table


def _all_contributions(scored):
    """Features that pruning left out have null contributions, so the columns are always the same."""
    return scored.select("candidate_id", "score", *[F.col(f"contrib_{n}") if f"contrib_{n}" in scored.columns else F.lit(None).cast("double").alias(f"contrib_{n}") for n in _NUM])


@register(q.assigned("SELECT name, lo, hi, n FROM fb", q.FEATS, q.SCORED))
def scorer_fit(spark, sf):
    *_, ref, _table = _scored(spark, sf)
    return spark.createDataFrame([(k, float(lo), float(hi), ref.n) for k, (lo, hi) in ref.bounds.items()], "name string, lo double, hi double, n long")


@register(q.assigned(f"SELECT candidate_id, {r6('score')} AS score, {', '.join(f'{r6(f"contrib_{n}")} AS contrib_{n}' for n in _NUM)} FROM ss", q.FEATS, q.SCORED))
def scorer_transform(spark, sf):
    _, _, f, ref, table = _scored(spark, sf)
    return rounded(_all_contributions(scoring.transform(f, ref, table)))


_TIER = "CASE WHEN round(score, 12) >= 0.7 THEN 'HIGH' WHEN round(score, 12) >= 0.4 THEN 'MEDIUM' ELSE 'LOW' END"
_ACTION = "CASE tier WHEN 'HIGH' THEN 'block' WHEN 'MEDIUM' THEN 'review' ELSE 'flag' END"


@register(q.assigned(f"SELECT candidate_id, tier, {_ACTION} AS action FROM (SELECT candidate_id, {_TIER} AS tier FROM ss)", q.FEATS, q.SCORED))
def risk_tiers(spark, sf):
    _, _, f, ref, table = _scored(spark, sf)
    s = scoring.transform(f, ref, table).select("candidate_id", scoring.tier(F.round("score", 12)).alias("tier"))
    return s.withColumn("action", scoring.action(F.col("tier")))


_LONGC = " UNION ALL ".join(f"SELECT candidate_id, '{n}' AS feature, contrib_{n} AS c FROM ss" for n in _NUM)


@register(q.assigned(f"SELECT candidate_id, rank, feature, {r6('c')} AS contribution FROM (SELECT *, (row_number() OVER (PARTITION BY candidate_id ORDER BY round(c, 12) DESC, feature))::INTEGER AS rank FROM ({_LONGC}) WHERE c IS NOT NULL) WHERE rank <= 3", q.FEATS, q.SCORED))
def top_signals(spark, sf):
    _, _, f, ref, table = _scored(spark, sf)
    return rounded(scoring.top_signals(rounded(scoring.transform(f, ref, table), 12)))


@register(q.assigned(f"SELECT candidate_id, feature, {r6('p')} AS suspicion_percentile, CASE WHEN round(p, 9) >= 0.9 THEN 'strong' WHEN round(p, 9) < 0.6 THEN 'ordinary' ELSE 'elevated' END AS strength FROM (SELECT candidate_id, name AS feature, p FROM fp)", q.FEATS, q.SCORED))
def explain_signals(spark, sf):
    _, _, f, ref, table = _scored(spark, sf)
    x = scoring.explained(scoring.transform(f, ref, table), ref)
    p = F.round("suspicion_percentile", 9)
    return rounded(x.withColumn("strength", F.when(p >= 0.9, "strong").when(p < 0.6, "ordinary").otherwise("elevated")))


_DETECTED = f"de AS (SELECT candidate_id, score, tier, {_ACTION} AS action, size, row_number() OVER (ORDER BY round(score, 12) DESC, candidate_id) AS rank FROM (SELECT candidate_id, score, {_TIER} AS tier FROM ss) JOIN (SELECT candidate_id, count(*) AS size FROM a GROUP BY 1) USING (candidate_id))"


@register(q.assigned(f"SELECT candidate_id, {r6('score')} AS score, tier, action, size, rank FROM de", q.FEATS, q.SCORED, _DETECTED))
def detect_campaigns(spark, sf):
    t, a, f, ref, table = _scored(spark, sf)
    return rounded(scoring.detect(t, a, ref, table, feats=f))


@register(q.assigned("SELECT candidate_id, rank, transaction_id FROM de JOIN a USING (candidate_id)", q.FEATS, q.SCORED, _DETECTED))
def detected_members(spark, sf):
    t, a, f, ref, table = _scored(spark, sf)
    return scoring.campaign_members(a, scoring.detect(t, a, ref, table, feats=f))


@register(q.assigned("SELECT 'ok' AS status, (SELECT count(*) FROM o) AS n_transactions, (SELECT count(DISTINCT candidate_id) FROM a) AS n_candidates, count(*) AS n_scored, count(*) FILTER (tier = 'HIGH') AS n_high_risk, count(*) FILTER (tier = 'MEDIUM') AS n_medium_risk, count(*) FILTER (tier = 'LOW') AS n_low_risk FROM de", q.FEATS, q.SCORED, _DETECTED))
def detection_summary(spark, sf):
    t, a, f, ref, table = _scored(spark, sf)
    return scoring.detection_summary(a, scoring.detect(t, a, ref, table, feats=f))


_RHO = " UNION ALL ".join(f"SELECT '{x}' AS a, '{y}' AS b, corr(rx, ry) AS rho FROM (SELECT {q._rank(x)} AS rx, {q._rank(y)} AS ry FROM f)" for i, x in enumerate(_NUM) for y in _NUM[i:])


@register(q.assigned(f"SELECT a || ' ' || b AS pair, CASE WHEN isfinite(rho) THEN round(rho, 6) + 0.0::DOUBLE END AS rho FROM ({_RHO})", q.FEATS))
def spearman(spark, sf):
    m = scoring.spearman(scoring.scoring_features(*_assigned(spark, sf)), _NUM)
    return rounded(m.select(F.concat_ws(" ", "a", "b").alias("pair"), "rho"))


@register(q.assigned("SELECT name FROM kn WHERE keep", q.FEATS, q.SCORED))
def scored_features(spark, sf):
    """The features that pruning keeps."""
    kept = scoring.scored_features(scoring.scoring_features(*_assigned(spark, sf)))
    return spark.createDataFrame([(n,) for n in kept], "name string")
