import math
import random
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from skein.operators import causal, features, related
from skein.plans.config import ENTITY_COLUMN, ConfigError, ConnectivityError, CandidateConfig, FeatureConfig, RiskThresholds

SCHEMA = "transaction_id string, timestamp timestamp_ntz, merchant_id string, card_fingerprint string, bin string, amount double, device_fingerprint string, ip_signature string, auth_outcome string"
W = 50


def rows(n=120, seed=3):
    g, t0 = random.Random(seed), datetime(2026, 1, 1)
    out = []
    for i in range(n):
        ts = t0 + timedelta(seconds=g.randrange(200))  # many ties
        out.append((f"T{g.random():.9f}", ts, f"M{g.randrange(4)}" if i % 17 else None, f"C{g.randrange(5)}" if i % 13 else None, f"4{g.randrange(3)}", round(g.choice([1.0, 4.5, 20.0, g.random() * 100]), 2), f"D{g.randrange(4)}", f"I{g.randrange(4)}", g.choice(["approved", " Declined "])))
    return out


@pytest.fixture(scope="module")
def tx(spark):
    return causal.channels(causal.ordered(spark.createDataFrame(rows(), SCHEMA))).cache()


def past(data, i, key, w=W):
    me = data[i]
    if me[key] is None:
        return None
    return [r for r in data if r[key] == me[key] and (r["timestamp"], r["transaction_id"]) < (me["timestamp"], me["transaction_id"]) and (w is None or r["timestamp"] >= me["timestamp"] - timedelta(seconds=w))]


def close(a, b):
    return (a is None and b is None) or (a is not None and b is not None and abs(a - b) < 1e-9)


def test_windows_match_brute_force_with_ties(tx):
    p = causal.Past("card", W)
    got = tx.select("transaction_id", p.count().alias("n"), p.sum("amount").alias("s"), p.mean("amount").alias("m"), p.std("amount").alias("sd"), p.median("amount").alias("md"), causal.Past("device", None).count().alias("life"), "ok")
    kinds = causal.variety(tx, "card", "merchant", (W,)).select("ok", F.col(f"distinct_{W}").alias("k"), F.col(f"entropy_{W}").alias("h"))
    lives = causal.lifetime(tx, "device", 30).select("ok", F.col("n").alias("life2"))
    got = got.join(kinds, "ok", "left").join(lives, "ok", "left").collect()
    data = [r.asDict() for r in tx.collect()]
    at = {r["transaction_id"]: i for i, r in enumerate(data)}
    for g in got:
        i = at[g["transaction_id"]]
        seen = past(data, i, "card_fingerprint")
        assert g["life"] == len(past(data, i, "device_fingerprint", None)) == g["life2"]
        if seen is None:
            assert all(g[c] is None for c in "nskmh") and g["sd"] is None and g["md"] is None
            continue
        x = sorted(r["amount"] for r in seen)
        n = len(x)
        mean = sum(x) / n if n else None
        std = math.sqrt(sum((v - mean) ** 2 for v in x) / (n - 1)) if n > 1 else None
        med = None if not n else (x[(n - 1) // 2] + x[n // 2]) / 2
        ms = [r["merchant_id"] for r in seen if r["merchant_id"] is not None]
        counts = [ms.count(v) for v in set(ms)]
        h = (math.log(len(ms)) - sum(c * math.log(c) for c in counts) / len(ms)) / math.log(len(counts)) if len(counts) > 1 else None
        assert g["n"] == n and close(g["s"], sum(x)) and close(g["m"], mean) and close(g["sd"], std) and close(g["md"], med) and g["k"] == len(counts) and close(g["h"], h)


def test_slices_give_the_same_counts(tx):
    whole = {r[0]: r[1] for r in tx.select("transaction_id", causal.Past("merchant", W).count().alias("n")).collect()}
    parts = causal.sliced(tx, W).select("transaction_id", "halo", causal.Past("merchant", W, "slice").count().alias("n")).where("NOT halo").collect()
    assert {r["transaction_id"]: r["n"] for r in parts} == whole


def test_thousands_of_rows_of_one_second_and_times_after_2041(spark):
    """One entity holds all rows, 5,000 of them in one second, far in the future."""
    t0 = datetime(2055, 1, 1)
    data = [(f"T{i:05d}", t0 if i < 5000 else t0 + timedelta(seconds=i - 4999), f"M{i % 3}", "C", "4", float(i % 7), "D", "I", "approved") for i in range(5010)]
    tx = causal.channels(causal.ordered(spark.createDataFrame(data, SCHEMA)))
    f = {r["transaction_id"]: r for r in features.feature_table(spark.createDataFrame(data, SCHEMA), FeatureConfig(windows=(5,)), ("velocity", "merchant", "amount", "device")).collect()}
    assert len(f) == 5010 and tx.agg(F.max("ok")).first()[0] == 5009
    for i in (0, 1, 2, 4999, 5000, 5004, 5009):
        first = 0 if i < 5005 else i - 5
        seen = [r for r in data[first if i < 5005 else 0 : i] if r[1] >= data[i][1] - timedelta(seconds=5)]
        r = f[data[i][0]]
        assert r["vel_card_count_5s"] == len(seen) and r["card_distinct_merchants_5s"] == len({x[2] for x in seen}) and r["dev_reuse_prior_total"] == i
        assert close(r["amt_card_mean_5s"], sum(x[5] for x in seen) / len(seen) if seen else None)
        xs = sorted(x[5] for x in seen)
        assert close(r["amt_card_median_5s"], (xs[(len(xs) - 1) // 2] + xs[len(xs) // 2]) / 2 if xs else None)


def test_variety_over_slices_and_nulls(spark):
    """Windows much shorter than the table, so that slices and halos matter."""
    data = rows(200, 11)
    tx = causal.ordered(spark.createDataFrame(data, SCHEMA)).cache()
    got = {r["ok"]: r for r in causal.variety(tx, "ip", "merchant", (3, 9)).collect()}
    all_rows = [r.asDict() for r in tx.collect()]
    for i, r in enumerate(all_rows):
        for w in (3, 9):
            ms = [x["merchant_id"] for x in past(all_rows, i, "ip_signature", w) if x["merchant_id"] is not None]
            counts = [ms.count(v) for v in set(ms)]
            h = (math.log(len(ms)) - sum(c * math.log(c) for c in counts) / len(ms)) / math.log(len(counts)) if len(counts) > 1 else None
            assert got[r["ok"]][f"distinct_{w}"] == len(counts) and close(got[r["ok"]][f"entropy_{w}"], h)


def test_related_counts_match_brute_force(tx):
    data = [r.asDict() for r in tx.collect()]
    got = {r["transaction_id"]: r["related"] for r in related.related_counts(tx, "device_fingerprint", W).collect()}
    for i, r in enumerate(data):
        seen = past(data, i, "merchant_id")
        if seen is None:
            assert got[r["transaction_id"]] is None
            continue
        n = 0
        for a in {x["device_fingerprint"] for x in seen}:
            own = {x["merchant_id"] for x in data if x["device_fingerprint"] == a and x["merchant_id"] and (x["timestamp"], x["transaction_id"]) < (r["timestamp"], r["transaction_id"]) and x["timestamp"] >= r["timestamp"] - timedelta(seconds=W)}
            n += len(own) >= 2
        assert got[r["transaction_id"]] == n


def test_causal_order_is_dense(tx):
    got = [r[0] for r in causal.causal_order(tx).orderBy("position").collect()]
    want = [r["transaction_id"] for r in sorted(tx.collect(), key=lambda r: (r["timestamp"], r["transaction_id"]))]
    assert got == want


def test_feature_table_is_a_prefix_of_itself(spark):
    config = FeatureConfig(windows=(20, 50))
    base = spark.createDataFrame(rows(60), SCHEMA)
    half = base.orderBy("timestamp", "transaction_id").limit(30)
    a = features.feature_table(base, config, ("velocity", "decline"))
    b = features.feature_table(half, config, ("velocity", "decline"))
    assert b.exceptAll(a).count() == 0 and b.count() == 30


def test_declares_156_columns_and_no_truth():
    names = [f.name for f in features.declared(FeatureConfig())]
    assert len(names) == 156
    groups = {g: sum(f.group == g for f in features.declared(FeatureConfig())) for g in ("amount", "bin", "decline", "device", "merchant", "velocity")}
    assert groups == {"amount": 52, "bin": 20, "decline": 16, "device": 5, "merchant": 48, "velocity": 15}


def test_unknown_outcome_is_an_error(spark):
    bad = [(*rows(1)[0][:8], "maybe")]
    with pytest.raises(Exception, match="unknown outcome"):
        causal.channels(causal.ordered(spark.createDataFrame(bad, SCHEMA))).collect()


def test_empty_table(spark):
    assert features.feature_table(spark.createDataFrame([], SCHEMA), FeatureConfig(windows=(30,))).count() == 0


def test_settings_check_themselves():
    with pytest.raises(ConfigError):
        FeatureConfig(windows=(30, 20))
    with pytest.raises(ConfigError):
        FeatureConfig.from_mapping({"window": [30]})
    with pytest.raises(ConnectivityError):
        CandidateConfig(connectivity=("card", "bin"))
    with pytest.raises(ConfigError):
        RiskThresholds(0.8, 0.7)
    assert FeatureConfig.from_mapping({"windows": [30, 60]}).of("amount") == (30, 60)
    assert set(ENTITY_COLUMN) == {"card", "device", "ip", "bin", "merchant"} and F is not None


def test_related_counts_over_slices_and_least(spark):
    """Windows much shorter than the table, several at once, and more merchants than two."""
    data = rows(160, 5)
    tx = causal.ordered(spark.createDataFrame(data, SCHEMA)).cache()
    every = [r.asDict() for r in tx.orderBy("ok").collect()]
    for least in (1, 2, 3):
        got = {r["ok"]: r for r in related.related(tx, "ip_signature", (3, 9, 30), least).collect()}
        for i, r in enumerate(every):
            for w in (3, 9, 30):
                seen = past(every, i, "merchant_id", w)
                own = lambda a: {x["merchant_id"] for x in every[:i] if x["ip_signature"] == a and x["merchant_id"] and x["timestamp"] >= r["timestamp"] - timedelta(seconds=w)}  # noqa: B023, E731
                want = None if seen is None else sum(len(own(a)) >= least for a in {x["ip_signature"] for x in seen})
                assert got[r["ok"]][f"related_{w}"] == want


def test_work_grows_with_rows_not_with_pairs(spark):
    """Thousands of rows of a merchant in one window, each of another actor: neither joins nor frames may meet them in pairs."""
    n = 24_000
    tx = spark.range(n).selectExpr("lpad(string(id), 9, '0') AS transaction_id", "timestamp_micros(id * 1000) AS timestamp", "id * 1000 AS ts_us", "id AS ok", "concat('M', id % 2) AS merchant_id", "concat('D', id div 4) AS device_fingerprint", "1.0D AS declined")
    began = time.time()
    r = {x["ok"]: x["related"] for x in related.related_counts(tx, "device_fingerprint", 1000).where(f"ok >= {n - 4}").collect()}
    # a device has four rows in turn at both merchants, and counts at a merchant from its second row on
    assert r == {n - 4: n // 4 - 1, n - 3: n // 4 - 1, n - 2: n // 4, n - 1: n // 4}
    h = causal.history(tx, "merchant", (1000,), ("declined",)).where(f"ok = {n - 1}").first()
    assert h["n_1000"] == h["sum_declined_1000"] == n // 2 - 1
    assert time.time() - began < 60
