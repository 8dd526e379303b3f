import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from skein.operators import candidates, causal, graph, scoring
from skein.operators.components import connected_components
from skein.streaming import online

from .test_causal import SCHEMA


def micro(spark, rows):
    """Rows by offset in seconds with defaults."""
    t0 = datetime(2026, 8, 26)
    full = [(f"T{i:03d}", t0 + timedelta(seconds=s), m, c, "400001", 10.0, d, ip, "approved") for i, (s, c, d, ip, m) in enumerate(rows)]
    return causal.channels(causal.ordered(spark.createDataFrame(full, SCHEMA)))


def test_components_of_a_long_chain(spark):
    e = spark.range(3000).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    got = connected_components(e)
    assert got.count() == 3001 and [r[0] for r in got.select("component").distinct().collect()] == [0]


def test_components_of_random_graphs(spark):
    g = random.Random(5)
    pairs = [(g.randrange(200), g.randrange(200)) for _ in range(120)] + [(7, 7), (None, 3)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(pairs, "src long, dst long")).collect()}
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        if a is not None:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    assert got == {x: find(x) for x in root}


def test_no_edges(spark):
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_links_respect_the_window_and_the_order(spark):
    tx = micro(spark, [(0, "C1", "D1", "I1", "M1"), (3600, "C1", "D2", "I2", "M2"), (7201, "C1", "D3", "I3", "M1"), (7201, "C9", "D3", "I9", "M3")])
    links = {(r[0], r[1]): r["link_entity_types"] for r in candidates.causal_links(tx).collect()}
    assert links == {("T001", "T000"): "card", ("T003", "T002"): "device"}
    a = candidates.assignments(candidates.components(tx))
    by = {r["transaction_id"]: r["candidate_id"] for r in a.collect()}
    assert by == {"T000": "CAND-000001", "T001": "CAND-000001", "T002": "CAND-000002", "T003": "CAND-000002"}


def test_merchants_never_connect(spark):
    tx = micro(spark, [(0, "C1", "D1", "I1", "M1"), (1, "C2", "D2", "I2", "M1")])
    assert candidates.causal_links(tx).count() == 0
    assert candidates.assignments(candidates.components(tx)).where("is_isolated").count() == 2


def test_chain_edges_have_the_components_of_all_pairs(spark):
    g = random.Random(1)
    tx = micro(spark, [(g.randrange(40000), f"C{g.randrange(12)}", f"D{g.randrange(12)}", f"I{g.randrange(30)}", "M") for _ in range(150)])
    pairs = graph.neighbours(tx).join(tx.select("transaction_id", "ok"), "transaction_id").join(tx.select(F.col("transaction_id").alias("neighbour_id"), F.col("ok").alias("pok")), "neighbour_id")
    want = {r["node"]: r["component"] for r in connected_components(pairs.select(F.col("pok").alias("src"), F.col("ok").alias("dst"))).collect()}
    got = {r["ok"]: r["root"] for r in candidates.components(tx).collect()}
    assert got == {k: want.get(k, k) for k in got}


@pytest.fixture(scope="module")
def scored(spark):
    g = random.Random(2)
    tx = micro(spark, [(g.randrange(90000), f"C{g.randrange(25)}", f"D{g.randrange(25)}", f"I{g.randrange(40)}", f"M{g.randrange(5)}") for _ in range(250)])
    a = candidates.assignments(candidates.components(tx))
    f = scoring.scoring_features(tx, a)
    ref, table = scoring.fit(f, {**scoring.scored_features(f), "distinct_merchants_per_transaction": 1.0})
    return tx, a, f.cache(), ref, table.cache()


def test_scores_are_mid_rank_percentiles(scored):
    _, _, f, ref, table = scored
    rows = f.collect()
    got = {r["candidate_id"]: r for r in scoring.transform(f, ref, table).collect()}
    for name in ref.signs:
        lo, hi = ref.bounds[name]
        x = {r["candidate_id"]: min(hi, max(lo, float(r[name]))) for r in rows}
        v = list(x.values())
        for c, y in x.items():
            p = (sum(z < y for z in v) + sum(z <= y for z in v)) / (2 * len(v))
            assert abs(got[c][f"contrib_{name}"] - p / len(ref.signs)) < 1e-9


def test_values_outside_the_reference_take_the_next_smaller(spark, scored):
    _, _, f, ref, table = scored
    name = "distinct_merchants_per_transaction"
    between = f.limit(1).withColumn(name, F.lit(0.77))
    got = scoring.transform(between, ref, table).first()[f"contrib_{name}"] * len(ref.signs)
    lo, hi = ref.bounds[name]
    v = [min(hi, max(lo, float(r[0]))) for r in f.select(name).collect()]
    y = min(hi, max(lo, 0.77))
    assert abs(got - (sum(z < y for z in v) + sum(z <= y for z in v)) / (2 * len(v))) < 1e-9


def test_reference_survives_json_and_refuses_truth(scored):
    _, _, f, ref, _ = scored
    assert scoring.ScorerReference.from_json(ref.to_json()) == ref
    with pytest.raises(ValueError):
        scoring.fit(f.withColumn("label", F.lit(1)))


def test_scored_features_by_their_definitions(spark, scored):
    """Every scored feature of every candidate from its pairs, and the correlated ones left out."""
    tx, a, f, _, _ = scored
    t = {r["transaction_id"]: r for r in tx.collect()}
    groups = {}
    for r in a.where("candidate_size > 1").collect():
        groups.setdefault(r["candidate_id"], []).append(t[r["transaction_id"]])
    got = {r["candidate_id"]: r for r in f.collect()}
    assert set(got) == set(groups)
    for c, g in groups.items():
        g.sort(key=lambda r: r["ok"])
        pairs = [[x[e] == y[e] for e in ("card_fingerprint", "device_fingerprint", "ip_signature")] for i, x in enumerate(g) for y in g[:i] if x["ts_us"] - y["ts_us"] <= 3600_000_000]
        linked = [sum(p) for p in pairs if any(p)]
        n, r = len(g), got[c]
        most = lambda k: max(sum(k(x) == k(y) for y in g) for x in g)
        want = {
            "link_density": len(linked) / (n * (n - 1) / 2), "multi_entity_link_fraction": sum(k > 1 for k in linked) / len(linked), "burst_rate_per_minute": (n - 1) * 60 / max(1, (g[-1]["ts_us"] - g[0]["ts_us"]) / 1e6),
            "max_transactions_per_shared_card": most(lambda x: x["card_fingerprint"]), "distinct_merchants_per_transaction": len({x["merchant_id"] for x in g}) / n,
            "distinct_bins_per_transaction": len({x["bin"] for x in g}) / n, "max_identical_amount_share": most(lambda x: round(x["amount"], 2)) / n,
        }
        assert set(want) == set(scoring.SIGNS) and all(abs(r[k] - v) < 1e-9 for k, v in want.items()), (c, want, r)


def test_links_over_nothing_are_nothing(spark):
    tx = micro(spark, [(0, "C1", "D1", "I1", "M")]).limit(0)
    a = candidates.assignments(candidates.components(tx))
    f = scoring.scoring_features(tx, a)
    ref, table = scoring.fit(f, scoring.SIGNS)
    d = scoring.detect(tx, a, ref, table)
    assert d.count() == 0 and scoring.detection_summary(a, d).first().asDict() == {"status": "ok", "n_transactions": 0, "n_candidates": 0, "n_scored": 0, "n_high_risk": 0, "n_medium_risk": 0, "n_low_risk": 0}


def test_tiers_have_inclusive_lower_edges(spark):
    d = spark.createDataFrame([(0.39999,), (0.4,), (0.69999,), (0.7,)], "score double")
    assert [r[0] for r in d.select(scoring.tier(F.col("score"))).collect()] == ["LOW", "MEDIUM", "MEDIUM", "HIGH"]


def test_pruning_keeps_precedence():
    assert scoring.prune_correlated({("a", "b"): 0.9, ("a", "c"): 0.1, ("b", "c"): 0.2}, ["a", "b", "c"]) == ["a", "c"]


def test_micro_batches_give_what_one_batch_gives(spark, scored, tmp_path):
    tx, _, _, ref, table = scored
    cols = [c.split()[0] for c in online.SCHEMA.split(", ")]
    data = tx.withColumn("timestamp", F.col("timestamp").cast("timestamp")).select(*cols)
    bad = data.limit(1).withColumns({"transaction_id": F.lit("bad"), "amount": F.lit(-1.0)})
    for i in range(3):
        part = data.where(F.pmod(F.hash("transaction_id"), F.lit(3)) == i)
        (part if i else part.unionByName(bad)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    data.limit(5).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))  # sent twice
    stream = spark.readStream.schema(online.SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    store = online.Store(spark, str(tmp_path / "store"))
    online.run(stream, store, str(tmp_path / "checkpoint")).awaitTermination()
    assert store.read().count() == data.count() and [r["problem"] for r in store.rejected().collect()] == ["amount must be finite and positive"]
    key = lambda df: {r["candidate_id"]: (r["size"], r["rank"], round(r["score"], 9)) for r in df.collect()}
    assert key(online.rescore(store.read(), ref, table)) == key(online.rescore(data, ref, table))


def test_store_keeps_the_valid_row_of_a_repeated_id(spark, tmp_path):
    good = ("T1", datetime(2026, 1, 1), "M", "C", "400001", 5.0, "D", "I", "approved")
    rows_ = [good, (*good[:5], -1.0, *good[6:]), (None, *good[1:]), (" ", *good[1:]), ("T2", *good[1:])]
    store = online.Store(spark, str(tmp_path / "s"))
    assert store.read().count() == 0 and store.health().first()["n_transactions"] == 0
    store.append(spark.createDataFrame(rows_, online.SCHEMA), 0)
    store.append(spark.createDataFrame([(*good[:5], 7.0, *good[6:])], online.SCHEMA), 1)
    assert {(r["transaction_id"], r["amount"]) for r in store.read().collect()} == {("T1", 5.0), ("T2", 5.0)}
    assert sorted(r["problem"] for r in store.rejected().collect()) == ["amount must be finite and positive", "blank transaction_id", "blank transaction_id"]
    with pytest.raises(ValueError, match="unknown columns"):
        store.append(spark.createDataFrame(rows_, online.SCHEMA).withColumn("more", F.lit(1)), 2)
    with pytest.raises(ValueError, match="ground truth"):
        store.append(spark.createDataFrame(rows_, online.SCHEMA).withColumn("label", F.lit(1)), 2)
    store.reset()
    assert store.read().count() == 0 and store.rejected().count() == 0


def test_messages(spark):
    said = ['{"type": "ping"}', "no json", '{"type": "dance"}', '{"type": "snapshot"}', '{"type": "transaction"}', '{"type": "transaction", "transaction": {"transaction_id": "T1", "timestamp": "2026-01-01T00:00:00Z", "amount": 1.5}}']
    got = [(r["kind"], r["reply"]) for r in online.messages(spark.createDataFrame([(x,) for x in said], "value string")).collect()]
    assert got == [("ping", "pong"), ("error", "error"), ("error", "error"), ("snapshot", "campaigns"), ("error", "error"), ("transaction", "campaigns")]
