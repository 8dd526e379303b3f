"""The queries' equivalents in DuckDB SQL, put together from shared common table expressions."""

from __future__ import annotations

from skein.plans.config import ENTITY_COLUMN

#: More than twice the rows of one time in the fixture tables; the SQL's window key is time and place in it.
TIES, STEP = 2048, 4096
#: The scored features by the definitions of the detector's scorer, in the order in which the earlier of two that correlate stays.
FEATURES = {
    "multi_entity_link_fraction": "coalesce(any_value(mu)::DOUBLE / nullif(any_value(e), 0), 0.0)",
    "link_density": "coalesce(any_value(e), 0)::DOUBLE / (count(*) * (count(*) - 1) / 2.0::DOUBLE)",
    "burst_rate_per_minute": "(count(*) - 1) * 60.0::DOUBLE / greatest((max(ts_us) - min(ts_us)) / 1000000.0::DOUBLE, 1.0::DOUBLE)",
    "max_transactions_per_shared_card": "any_value(same_card)",
    "distinct_merchants_per_transaction": "count(DISTINCT merchant_id)::DOUBLE / count(*)",
    "max_identical_amount_share": "any_value(most)::DOUBLE / count(*)",
    "distinct_bins_per_transaction": "count(DISTINCT bin)::DOUBLE / count(*)",
}


def reach(seconds: int) -> int:
    return seconds * 1_000_000 * STEP + TIES - 1


TX = f"""
tx AS (SELECT lpad(event_id::VARCHAR, 12, '0') AS transaction_id, ts AS "timestamp", 'M' || (event_id % 40)::VARCHAR AS merchant_id, 'C' || user_id::VARCHAR AS card_fingerprint,
   (400000 + user_id % 20)::VARCHAR AS bin, value AS amount, 'D' || ((user_id // 2) * 10 + k % 10)::VARCHAR AS device_fingerprint,
   'I' || ((user_id // 3) * 10 + k // 10)::VARCHAR AS ip_signature, CASE WHEN event_type = 'error' THEN 'declined' ELSE 'approved' END AS auth_outcome,
   CASE WHEN event_id % 16 = 0 THEN 1 ELSE 0 END AS label, CASE WHEN event_id % 16 = 0 THEN 'CMP-' || lpad((user_id % 45)::VARCHAR, 3, '0') ELSE '' END AS campaign_id
   FROM (SELECT *, json_extract_string(props, '$.k')::INTEGER AS k FROM events)),
o AS (SELECT *, row_number() OVER (ORDER BY ts_us, transaction_id) - 1 AS ok, ts_us * {STEP} + row_number() OVER (PARTITION BY ts_us ORDER BY transaction_id) - 1 AS wk,
   CASE WHEN auth_outcome = 'declined' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS declined, (amount < 5.0)::INTEGER::DOUBLE AS low_value
   FROM (SELECT *, epoch_us("timestamp") AS ts_us FROM tx))"""
EDGES = f"""
ed AS ({' UNION ALL '.join(f"SELECT transaction_id, ts_us, ok, '{t}' AS entity_type, {c} AS entity_id FROM o WHERE {c} IS NOT NULL" for t, c in ENTITY_COLUMN.items())})"""
CHAIN = """
ch AS (SELECT * FROM (SELECT entity_type, entity_id, lag(transaction_id) OVER w AS src, transaction_id AS dst, ts_us - lag(ts_us) OVER w AS gap_us, lag(ok) OVER w AS src_ok, ok AS dst_ok
   FROM ed WHERE entity_type IN ('card', 'device', 'ip') WINDOW w AS (PARTITION BY entity_type, entity_id ORDER BY ok)) WHERE src IS NOT NULL)"""
COMP = """
sy AS (SELECT src_ok AS a, dst_ok AS b FROM ch WHERE gap_us <= 3600000000 UNION SELECT dst_ok, src_ok FROM ch WHERE gap_us <= 3600000000),
rc(ok, root) AS (SELECT ok, ok FROM o UNION SELECT sy.b, rc.root FROM rc JOIN sy ON sy.a = rc.ok),
co AS (SELECT ok, min(root) AS root FROM rc GROUP BY ok)"""
ASSIGN = """
rt AS (SELECT root, count(*) AS candidate_size, row_number() OVER (ORDER BY root) AS i, count(*) OVER () AS n FROM co GROUP BY root),
nm AS (SELECT root, candidate_size, 'CAND-' || lpad(i::VARCHAR, greatest(6, len(n::VARCHAR))::INTEGER, '0') AS candidate_id FROM rt),
a AS (SELECT o.transaction_id, o.ts_us, o.ok, nm.candidate_id, nm.candidate_size, nm.candidate_size = 1 AS is_isolated FROM o JOIN co USING (ok) JOIN nm USING (root)),
t AS (SELECT o.*, a.candidate_id, a.candidate_size FROM o JOIN a USING (transaction_id))"""
PAIRS = """
nb AS (SELECT x.transaction_id, y.transaction_id AS neighbour_id, x.entity_type, x.entity_id, y.ts_us - x.ts_us AS delta_us
   FROM (SELECT *, unnest([ts_us // 3600000000 - 1, ts_us // 3600000000]) AS hour FROM ed WHERE entity_type IN ('card', 'device', 'ip')) x
   JOIN (SELECT *, ts_us // 3600000000 AS hour FROM ed WHERE entity_type IN ('card', 'device', 'ip')) y
   ON x.entity_type = y.entity_type AND x.entity_id = y.entity_id AND x.hour = y.hour AND y.ok < x.ok AND y.ts_us >= x.ts_us - 3600000000)"""
LINKS = """
lk AS (SELECT transaction_id AS anchor_transaction_id, neighbour_id AS prior_transaction_id, string_agg(entity_type, '|' ORDER BY entity_type) AS link_entity_types,
   count(*) AS n_link_entity_types, max(delta_us) / 1000000.0::DOUBLE AS delta_seconds, -(max(delta_us) / 1000000.0::DOUBLE) + 0.0 AS age_seconds,
   bool_or(entity_type = 'card') AS shares_card, coalesce(max(entity_id) FILTER (entity_type = 'card'), '') AS card_entity_id,
   bool_or(entity_type = 'device') AS shares_device, coalesce(max(entity_id) FILTER (entity_type = 'device'), '') AS device_entity_id,
   bool_or(entity_type = 'ip') AS shares_ip, coalesce(max(entity_id) FILTER (entity_type = 'ip'), '') AS ip_entity_id FROM nb GROUP BY 1, 2)"""
FEATS = """
sh AS (SELECT candidate_id, entity_type, entity_id, count(*) AS c FROM ed JOIN a USING (transaction_id) WHERE candidate_size > 1 AND entity_type IN ('card', 'device', 'ip') GROUP BY 1, 2, 3),
sm AS (SELECT candidate_id, max(c) AS most FROM (SELECT candidate_id, round(amount, 2) AS x, count(*) AS c FROM t WHERE candidate_size > 1 GROUP BY 1, 2) GROUP BY 1),
sx AS (SELECT candidate_id, coalesce(max(c) FILTER (entity_type = 'card' AND c > 1), 0) AS max_transactions_per_shared_card, coalesce(max(c) FILTER (entity_type = 'device' AND c > 1), 0) AS max_transactions_per_shared_device,
   coalesce(max(c) FILTER (entity_type = 'ip' AND c > 1), 0) AS max_transactions_per_shared_ip, max(c) FILTER (entity_type = 'card') AS same_card FROM sh GROUP BY 1),
le AS (SELECT candidate_id, count(*) AS e, count(*) FILTER (n_link_entity_types > 1) AS mu FROM lk JOIN a ON a.transaction_id = anchor_transaction_id GROUP BY 1),
f AS (SELECT candidate_id, count(*) AS size, min(ts_us) AS first_ts_us, max(ts_us) AS last_ts_us, """ + ", ".join(f"{x} AS {n}" for n, x in FEATURES.items()) + """
   FROM t JOIN sx USING (candidate_id) JOIN sm USING (candidate_id) LEFT JOIN le USING (candidate_id) GROUP BY candidate_id)"""


def _rank(x: str) -> str:
    return f"rank() OVER (ORDER BY {x}) + (count(*) OVER (PARTITION BY {x}) - 1) / 2.0::DOUBLE"


def _kept() -> str:
    """One row: whether each feature is scored, i.e. no kept one before it correlates over 0.70 (at four places) with it."""
    names, steps = list(FEATURES), []
    for i, n in enumerate(names):
        clash = " OR ".join(f"(keep_{m} AND abs(coalesce(rho_{m}_{n}, 0)) > 0.70)" for m in names[:i]) or "false"
        steps.append(f"kp{i} AS (SELECT *, NOT ({clash}) AS keep_{n} FROM {'rh' if i == 0 else f'kp{i - 1}'})")
    rho = ", ".join(f"CASE WHEN isfinite(corr(r_{m}, r_{n})) THEN round(corr(r_{m}, r_{n}), 4) END AS rho_{m}_{n}" for i, n in enumerate(names) for m in names[:i])
    return f"rk AS (SELECT {', '.join(f'{_rank(n)} AS r_{n}' for n in names)} FROM f),\nrh AS (SELECT {rho} FROM rk),\n" + ",\n".join(steps)


SCORED = f"""
{_kept()},
kn AS (SELECT unnest([{', '.join(f"'{n}'" for n in FEATURES)}]) AS name, unnest([{', '.join(f'keep_{n}' for n in FEATURES)}]) AS keep FROM kp{len(FEATURES) - 1}),
fl AS (SELECT x.* FROM ({' UNION ALL '.join(f"SELECT candidate_id, '{n}' AS name, {n}::DOUBLE AS value FROM f" for n in FEATURES)}) x JOIN kn USING (name) WHERE keep),
fb AS (SELECT name, quantile_cont(value, 0.01) AS lo, quantile_cont(value, 0.99) AS hi, count(*) AS n FROM fl GROUP BY name),
fc AS (SELECT candidate_id, name, least(hi, greatest(lo, value)) AS v, n FROM fl JOIN fb USING (name)),
fp AS (SELECT candidate_id, name, ((rank() OVER (PARTITION BY name ORDER BY v) - 1) * 2 + count(*) OVER (PARTITION BY name, v)) / (2.0::DOUBLE * n) AS p FROM fc),
sc AS (SELECT candidate_id, {', '.join(f"max(p) FILTER (name = '{n}') / (SELECT count(*) FROM kn WHERE keep) AS contrib_{n}" for n in FEATURES)} FROM fp GROUP BY candidate_id),
ss AS (SELECT *, least(1.0, greatest(0.0, {' + '.join(f'coalesce(contrib_{n}, 0)' for n in FEATURES)})) AS score FROM sc)"""
ALL = ",".join([TX, EDGES, CHAIN, COMP, ASSIGN])


def query(select: str, *parts: str) -> str:
    if FEATS in parts:  # what candidates' features are made of, if it isn't there yet
        parts = tuple(p for x in parts for p in ((*[y for y in (PAIRS, LINKS) if y not in parts], x) if x is FEATS else (x,)))
    return "WITH RECURSIVE " + ",".join([TX, *parts]) + "\n" + select


def assigned(select: str, *parts: str) -> str:
    return query(select, EDGES, CHAIN, COMP, ASSIGN, *parts)


def window(entity: str, seconds: int | None) -> str:
    frame = "UNBOUNDED PRECEDING" if seconds is None else f"{reach(seconds)} PRECEDING"
    return f"(PARTITION BY {ENTITY_COLUMN[entity]} ORDER BY wk RANGE BETWEEN {frame} AND 1 PRECEDING)"


def known(entity: str, x: str) -> str:
    return f"CASE WHEN {ENTITY_COLUMN[entity]} IS NOT NULL THEN {x} END"


def entropy(x: str, w: str) -> str:
    """Normalised: base 2 entropy by the logarithm of the number of kinds."""
    return f"CASE WHEN count(DISTINCT {x}) OVER {w} >= 2 THEN least(1.0, greatest(0.0, entropy({x}) OVER {w} / log2(count(DISTINCT {x}) OVER {w}))) END"
