"""Operators against brute force, over odd tables and small random ones."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from skein.llm import jaccard, merkle, mixing, packing, secrets, suffix_dedup, topk

from .conftest import rows


# mixing

def words(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def test_mix_meets_targets(spark, odd):
    got = mixing.mix_to_weights(odd).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(r[0] for r in rows())
    size = {r[0]: words(r[1]) for r in rows()}
    by = {}
    for r in got:
        assert r["size"] == size[r["doc_id"]] and r["taken"] == r["size"] * r["copies"] <= 3 * r["size"]
        by.setdefault(r["source"], []).append(r)
    total = sum(size.values())
    assert abs(sum(v[0]["target"] for v in by.values()) - total) < 1e-6
    for v in by.values():
        assert v[0]["source_size"] == sum(r["size"] for r in v) and v[0]["target"] <= 3 * v[0]["source_size"] + 1e-9
        largest = max(r["size"] for r in v)
        assert abs(sum(r["taken"] for r in v) - v[0]["target"]) <= largest / 2 + 1e-9


def test_targets_are_reshared_until_none_is_above(spark):
    g = random.Random(4)
    sizes = [(f"s{i:02d}" if i else None, g.choice([0, 1, 5, 50, 1000])) for i in range(12)]
    got = {r["__source"]: r["__target"] for r in mixing.targets(spark.createDataFrame(sizes, "__source string, __source_size long")).collect()}
    order = sorted(sizes, key=lambda s: (s[0] is None, s[0]))
    w = {s: i % 3 + 1 for i, (s, _) in enumerate(order)}
    cap, left, share, open_ = {s: 3.0 * n for s, n in sizes}, float(sum(n for _, n in sizes)), {}, dict(w)
    while True:
        share = {s: left * x / sum(open_.values()) for s, x in open_.items()}
        over = [s for s in open_ if share[s] > cap[s]]
        if not over:
            break
        for s in over:
            left -= cap[s]
            open_.pop(s)
    want = {s: share.get(s, cap[s]) for s, _ in sizes}
    assert all(abs(got[s] - want[s]) < 1e-6 for s in want)


def test_mix_twice_is_the_same_and_empty_is_empty(odd, none, again):
    a, b = (sorted(map(tuple, mixing.mix_to_weights(odd).collect()), key=str) for _ in range(2))
    assert a == b and mixing.mix_to_weights(none).count() == 0 and mixing.mix_to_weights(again).count() == 18
    assert mixing.apply_mix(odd).columns == odd.columns


def test_many_sources_are_salted(odd, monkeypatch):
    want = sorted(map(tuple, mixing.mix_to_weights(odd).collect()), key=str)
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 1)
    assert sorted(map(tuple, mixing.mix_to_weights(odd).collect()), key=str) == want


# repeated strings

def removed(texts):
    """n_removed, n_spans and the rest of each text, by definition."""
    seen, out = set(), []
    for t in texts:
        hits = []
        for i in range(len(t) - 99):
            hits.append(t[i : i + 100] in seen)
            seen.add(t[i : i + 100])
        gone = np.zeros(len(t), bool)
        for i in np.flatnonzero(hits):
            gone[i : i + 100] = True
        out.append((int(gone.sum()), int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum()), bytes(np.frombuffer(t, np.uint8)[~gone])))
    return out


def check_removed(got, docs):
    """``got`` by id against ``docs`` (id, text), in order."""
    want = removed([(t or "").encode() for _, t in docs])
    for (i, t), (n, s, rest) in zip(docs, want, strict=True):
        r = got[i]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (len((t or "").encode()), n, s, hashlib.sha256(rest).hexdigest()), i


def texts(seed, n=60):
    g = random.Random(seed)
    pool = ["".join(g.choice("abcdé \n") for _ in range(g.randrange(80, 400))) for _ in range(8)] + ["ab" * 150, "x" * 300]
    return [(i, "".join(g.choice(pool) if g.random() < 0.6 else "".join(g.choice("abcd ") for _ in range(g.randrange(150))) for _ in range(g.randrange(5)))) for i in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_repeats_of_random_texts(spark, seed):
    docs = texts(seed)
    got = {r["doc_id"]: r for r in suffix_dedup.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    check_removed(got, docs)


def test_repeats_with_crowded_anchors_and_small_blocks(spark, monkeypatch):
    docs = texts(3)
    want = {r["doc_id"]: r for r in suffix_dedup.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    check_removed(want, docs)
    kernel = suffix_dedup.owned
    assert kernel([b"a" * 120, b"a" * 110], np.array([2, 1]), np.array([0, 5])).sum() == 1


def test_crowded_anchors(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CROWD", 2)
    docs = texts(5, 40)
    check_removed({r["doc_id"]: r for r in suffix_dedup.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect()}, docs)


def test_repeats_in_odd_tables(spark, odd, none, again):
    check_removed({r["doc_id"]: r for r in suffix_dedup.remove_repeats(odd).collect()}, [r[:2] for r in rows()])
    assert suffix_dedup.remove_repeats(none).count() == 0
    got = suffix_dedup.remove_repeats(again).collect()
    assert len(got) == 18 and sum(r["n_removed"] for r in got if r["doc_id"] == 9) > 100


def test_suffix_order_is_sorted_with_its_prefixes():
    g = random.Random(9)
    ts = [bytes(g.choice(b"ab") for _ in range(g.randrange(0, 30))) for _ in range(25)] + [b"", b"abab"]
    who, length, lcp = suffix_dedup.suffix_order(ts)
    s = [ts[w][len(ts[w]) - n :] for w, n in zip(who.tolist(), length.tolist(), strict=True)]
    assert s == sorted(s) and len(s) == sum(len(t) + 1 for t in ts)
    for i in range(1, len(s)):
        n = next((k for k, (a, b) in enumerate(zip(s[i - 1], s[i], strict=False)) if a != b), min(len(s[i - 1]), len(s[i])))
        assert lcp[i] == n


# top-k

def test_top_k_matches_brute_force(spark):
    g = np.random.default_rng(1)
    v = g.normal(size=(300, 8)).round(1)
    data = [(i, [float(x) for x in v[i]]) for i in range(300)] + [(400, None), (500, [1.0, None]), (600, [float("nan")] * 8), (700, [1.0, 2.0]), (None, [1.0] * 8)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>").withColumns({"id": F.lit(0), "v": F.lit("x"), "score": F.lit(None).cast("int")})
    got = [tuple(r) for r in topk.top_k(df, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect()]
    q = np.floor(256 * v).astype(int)
    want = []
    for i in range(0, 300, 50):
        s = sorted((-int(q[i] @ q[j]), j) for j in range(300) if j != i)[:5]
        want += [(i, r + 1, j, -n) for r, (n, j) in enumerate(s)]
    assert got == want
    assert topk.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_repeated_ids_are_rows_of_their_own(spark):
    df = spark.createDataFrame([(50, [1.0, 0.0]), (50, [2.0, 0.0]), (1, [3.0, 0.0]), (1, [3.0, 0.0])], "vec_id long, embedding array<double>")
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(df, F.col("vec_id") % 50 == 0, k=2).collect())
    one = 256 * 256
    assert got == sorted([(50, 1, 1, 3 * one), (50, 2, 1, 3 * one), (50, 1, 1, 6 * one), (50, 2, 1, 6 * one)])


def test_scores_beyond_doubles_are_exact():
    x = np.array([[2**29, 1], [2**29, 0]], np.int64)
    rows_, scores, *_ = topk.nra(topk.Lists(x, topk._exact(2**29, 2**29, 2)), x[0], 2)
    assert dict(zip(rows_.tolist(), scores.tolist(), strict=True)) == {0: 2**58 + 1, 1: 2**58}


@pytest.mark.parametrize("seed", range(6))
def test_bounds_never_lose_a_row(seed):
    g = np.random.default_rng(seed)
    x = (g.normal(size=(400, 7)) * g.choice([1, 10, 100], 7)).astype(np.int64)
    lists = topk.Lists(x, np.float64)
    for j in range(20):
        q, own = x[j] if j % 2 else -x[j], j if j % 3 else None
        score = x @ q
        others = [i for i in range(len(x)) if i != own]
        best = sorted(others, key=lambda i: -score[i])[:5]
        rows_, scores, read, _ = topk.nra(lists, q, 5, None, own)
        assert set(score[rows_]) >= {score[i] for i in best} and (score[rows_] == scores).all() and own not in rows_ and read <= x.size


def test_separable_sets_stop_early():
    """Most queries of a set with a few long directions stop, and read a part of the lists."""
    g = np.random.default_rng(3)
    x = np.zeros((4000, 16), np.int64)
    x[np.arange(4000), g.integers(0, 16, 4000)] = g.integers(1, 100_000, 4000)
    x += g.integers(0, 3, x.shape)
    lists = topk.Lists(x, np.float64)
    got = [topk.nra(lists, x[j], 5, None, j) for j in range(0, 4000, 100)]
    stopped, entries = np.mean([s for *_, s in got]), np.mean([r for *_, r, _ in got]) / x.size
    assert stopped > 0.9 and entries < 0.5, (stopped, entries)


# packing

def test_packing_holds_every_token_once(spark, odd, none, again):
    enc = packing.Encoder()
    for df, n in ((odd, 14), (again, 18)):
        got = packing.pack_documents(df).toPandas()
        bins = got.sort_values(["sequence_id", "offset"])
        before = bins.groupby("sequence_id")["length"].cumsum() - bins["length"]
        assert (before == bins["offset"]).all() and bins.groupby("sequence_id")["length"].sum().max() <= 2048
        assert got["piece"].eq(0).sum() == n
    got = packing.pack_documents(odd).toPandas()
    for i, t, *_ in rows():
        ids = np.array([*enc(t or ""), 0], "<u4")
        p = got[got.doc_id == i].sort_values("piece")
        assert p["piece"].tolist() == list(range(len(p))) and p["length"].sum() == len(ids)
        for r in p.itertuples():
            assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
        assert (p["length"].iloc[1:] == 2048).all()
    assert got["sequence_id"].nunique() == math.ceil(got["length"].sum() / 2048)
    assert packing.pack_documents(none).count() == 0


def test_fast_ids_are_the_tokenizers_ids():
    from tokenizers import Tokenizer

    enc, g = packing.Encoder(), random.Random(6)
    slow = Tokenizer.from_file(enc.json_path)
    chars = "ab Z9'’é漢🙂\n\t  \x1c\x85<|endoftext|>don't  "
    for _ in range(300):
        t = "".join(g.choice(chars) for _ in range(g.randrange(60)))
        assert enc(t) == slow.encode(t, add_special_tokens=False).ids, t
    assert enc("a<|endoftext|>b") == slow.encode("a<|endoftext|>b", add_special_tokens=False).ids


def test_best_fit_and_later_rounds(spark, monkeypatch):
    bins, at, fill = packing.best_fit(np.array([5, 4, 3, 8]), 10)
    assert sorted(fill.tolist()) == [3, 8, 9] or sum(fill) == 20 and len(fill) <= 3
    monkeypatch.setattr(packing, "GROUP", 5)
    df = spark.range(60).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), F.pmod(F.hash("id"), F.lit(1500))).alias("text")).repartition(6)
    got = packing.pack_documents(df).toPandas()
    assert got.groupby("sequence_id")["length"].sum().max() <= 2048 and got["piece"].eq(0).sum() == 60


# Jaccard

def components(docs, words_, num, den):
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = []
    for _, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))
        sets.append({tuple(w[k : k + words_]) for k in range(len(w) - words_ + 1)} if len(w) >= words_ else {tuple(w)} if w else set())
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {d[0]: (len(s), docs[find(i)][0]) for i, (d, s) in enumerate(zip(docs, sets, strict=True))}


def near_copies(seed, n=150):
    g = random.Random(seed)
    bases = [[f"w{g.randrange(3000)}" for _ in range(g.choice([1, 2, 5, 12, 60, 300]))] for _ in range(25)]
    out = []
    for i in range(n):
        w = list(g.choice(bases))
        for _ in range(int(len(w) * g.choice([0, 0.005, 0.01, 0.02, 0.04]))):
            w[g.randrange(len(w))] = f"W{g.randrange(3000)}"
        out.append((i, " ".join(w)))
    return out


@pytest.mark.parametrize(("words_", "num", "den", "seed"), [(3, 90, 100, 1), (5, 80, 100, 2)])
def test_jaccard_matches_brute_force(spark, words_, num, den, seed):
    docs = near_copies(seed)
    got = {r[0]: (r[1], r[2]) for r in jaccard.jaccard_components(spark.createDataFrame(docs, "doc_id long, text string"), words_, num, den).collect()}
    assert got == components(docs, words_, num, den)


def grown(seed):
    """Chains of texts that extend one another, prefixes of longer texts, and texts with appended ones."""
    g = random.Random(seed)
    out = []
    for _ in range(12):
        w = [f"w{g.randrange(10**6)}" for _ in range(90)]
        n = g.randrange(10, 40)
        while n <= 90:
            out.append(w[:n])
            n = int(n * g.choice([1.04, 1.08, 1.1, 1.2])) + 1
    g.shuffle(out)
    return [(i, " ".join(w)) for i, w in enumerate(out)]


@pytest.mark.parametrize(("words_", "num", "den"), [(3, 90, 100), (5, 80, 100)])
def test_jaccard_of_size_chains(spark, words_, num, den):
    """Members of a signature whose sizes rule out its pivot are still compared with one another."""
    w = [f"v{i}" for i in range(16)]
    docs = grown(3) + [(1000 + n, " ".join(w[:n])) for n in (13, 14, 16)]
    got = {r[0]: (r[1], r[2]) for r in jaccard.jaccard_components(spark.createDataFrame(docs, "doc_id long, text string"), words_, num, den).collect()}
    assert got == components(docs, words_, num, den)


def test_jaccard_of_several_large_groups_of_a_family(spark):
    """Groups whose shared tokens are all common have the same signatures of empty segments, and one pivot; none is lost."""
    g = random.Random(5)
    docs = []
    for size in (40, 52, 66):
        base = [f"g{g.randrange(10**9)}" for _ in range(size + 4)]
        docs += [[f"h{g.randrange(10**9)}", *base[1:-1], f"t{g.randrange(10**9)}"] for _ in range(20)]
    docs += [[f"u{g.randrange(10**9)}" for _ in range(60)] for _ in range(200)]
    docs = [(i, " ".join(w)) for i, w in enumerate(docs)]
    got = {r[0]: (r[1], r[2]) for r in jaccard.jaccard_components(spark.createDataFrame(docs, "doc_id long, text string"), 5, 80, 100).collect()}
    assert got == components(docs, 5, 80, 100)


@pytest.mark.parametrize(("words_", "num", "den", "every"), [(3, 90, 100, True), (5, 80, 100, True), (5, 80, 100, False)])
def test_both_ways_find_every_link(spark, monkeypatch, words_, num, den, every):
    """Open bands all by one-deletion neighbourhoods, or none."""
    chosen = []

    def all_or_none(shape, pairs, sets):
        chosen.append(set(pairs) if every else set())
        return chosen[-1]

    monkeypatch.setattr(jaccard, "allot", all_or_none)
    docs = crowded(7)
    got = {r[0]: (r[1], r[2]) for r in jaccard.jaccard_components(spark.createDataFrame(docs, "doc_id long, text string"), words_, num, den).collect()}
    assert got == components(docs, words_, num, den) and chosen and (chosen[0] or not every)


def crowded(seed):
    """Documents around a few shared passages, with copies that drift apart."""
    g = random.Random(seed)
    word = lambda: f"w{g.randrange(4000)}"
    passages, out = [[word() for _ in range(n)] for n in (20, 60, 60, 150)], []
    for _ in range(220):
        p = g.choice(passages)
        ws = [word() for _ in range(int(len(p) * g.choice((0.05, 0.1, 0.25, 0.5))))] + p
        for _ in range(g.choice((0, 0, 1, 3, 8))):
            ws[g.randrange(len(ws))] = word()
        out.append(" ".join(ws))
    return list(enumerate(out))


def test_neighbourhoods_are_chosen_where_pairs_cost_more():
    shape = jaccard.Shape(90, 100)
    band = shape.band(400)
    sets = {band: (100, 40_000)}
    assert jaccard.allot(shape, {band: 50_000.0}, sets) == {band} and jaccard.allot(shape, {band: 1_000.0}, sets) == set()


def test_shared_runs_are_found_over_batches():
    rows_ = sorted([(1, 5), (2, 5), (2, 5), (2, 6), (3, 1), (4, 1), (4, 2), (4, 3), (5, 9), (5, 9)])
    for size in (1, 2, 3, 10):
        parts = [pa.RecordBatch.from_pylist([{"sig": a, "key": b} for a, b in rows_[i : i + size]]) for i in range(0, len(rows_), size)]
        assert [tuple(r.values()) for b in jaccard._shared(parts) for r in b.to_pylist()] == [(2, 5), (2, 6), (4, 1), (4, 2), (4, 3)]


def test_jaccard_of_odd_tables(odd, none, again):
    got = {r[0]: (r[1], r[2]) for r in jaccard.jaccard_components(odd).collect()}
    assert got == components([r[:2] for r in rows()], 3, 90, 100)
    assert jaccard.jaccard_components(none).count() == 0
    more = jaccard.jaccard_components(again).collect()
    assert len(more) == 18 and {r[2] for r in more if r[0] is None} == {1, None}


def test_keep_one(odd, again, none):
    kept = jaccard.keep_one(odd)
    first = {i for i, (_, c) in components([r[:2] for r in rows()], 5, 80, 100).items() if i == c}
    assert kept.columns == odd.columns and {r["doc_id"] for r in kept.collect()} == first and not {2, 6} & first
    assert sorted(r["doc_id"] for r in jaccard.keep_one(again).collect() if r["doc_id"]) == sorted(first)
    assert jaccard.keep_one(none).count() == 0


def test_sketches_never_exceed_the_difference():
    g = np.random.default_rng(3)
    for n in (10, 900, 5000):
        a = np.unique(g.integers(0, 2**63, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[n // 10 :], g.integers(0, 2**63, n // 20 + 1).astype(np.uint64)]))
        d = len(np.setxor1d(a, b))
        assert jaccard.differ_at_least(np.frombuffer(jaccard.wide_sketch(a), np.uint8), np.frombuffer(jaccard.wide_sketch(b), np.uint8)) <= d
        assert int(np.bitwise_count((jaccard.sketch(a) ^ jaccard.sketch(b)).view(np.uint64)).sum()) <= d


# secrets

def secret_spans(t):
    t = t or ""
    names = "(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    out = [(m.start(), 0, m.end()) for m in re.finditer(names + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t) if len(m[1]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 24]
    return sorted(out)


def test_spans_match_brute_force(spark, odd, none, again):
    g = random.Random(8)
    bits = ["password", "TOKEN", "api_key", "apikey", "secret", "=", ": ", '"', "'", " ", "hunter2x", "abc", "AKIA", "ABCDEFGHIJKLMNOPQRST", "0f" * 13, "é", "🙂", "\n", "zz"]
    docs = [(i, "".join(g.choice(bits) for _ in range(g.randrange(30)))) for i in range(200)] + [(i + 1000, t) for i, t, *_ in rows()]
    got = {r["doc_id"]: r for r in secrets.digest(secrets.scan(spark.createDataFrame(docs, "doc_id long, text string"))[0]).collect()}
    for i, t in docs:
        want = ",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in secret_spans(t))
        assert got[i]["spans"] == want, t
        assert got[i]["base_sha256"] == hashlib.sha256(want.encode()).hexdigest()
    assert secrets.scan(none)[0].count() == 0 and secrets.scan(again)[0].count() == 18
    assert "doc_id" in secrets.drop_leaking(odd).columns and {r["doc_id"] for r in secrets.drop_leaking(odd).collect()} == set(range(1, 15)) - {11}


def test_ledger_scans_only_what_is_new(spark, odd):
    first, ledger = secrets.scan(odd.where("doc_id < 9"))
    _, more = secrets.scan(odd, ledger)
    fresh = {r["blob"] for r in more.select("blob").collect()}
    old = {r["blob"] for r in ledger.select("blob").collect()}
    assert fresh and not fresh & old
    newer = [(n, "2" if n == "hex" else v, *rest) for n, v, *rest in secrets.RULES]
    _, again_ = secrets.scan(odd, ledger.unionByName(more), newer)
    assert {(r["rule"], r["rule_version"]) for r in again_.collect()} == {("hex", "2")}


# Merkle trees

def test_fingerprints(spark, odd, none, again):
    got = {r["doc_id"]: r for r in merkle.fingerprints(odd).collect()}
    data = sorted(((i, t or "") for i, t, *_ in rows()), reverse=True)
    for k, (i, t) in enumerate(data):
        nxt = data[(k + 1) % len(data)][1]
        cut = len(t) // 3
        edited = t[: len(t) - cut] + nxt[:cut]
        r = got[i]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert (r["near_edited"] == 1.0) == (edited == t) or r["near_edited"] <= 1
        assert r["fingerprint"].startswith(r["edited_fingerprint"][:64]) == (edited == t)
    assert got[1]["fingerprint"] == got[2]["fingerprint"] != got[5]["fingerprint"] and got[2]["near_next"] == 1.0
    assert got[5]["near_edited"] > 0.5 and got[14]["near_edited"] > got[14]["near_next"]
    assert merkle.fingerprints(none).count() == 0 and merkle.fingerprints(again).count() == 18
    assert merkle.fingerprints(odd.where("doc_id = 1")).first()["near_next"] == 1.0


def test_next_is_the_next_by_descending_id(spark):
    g = random.Random(2)
    ids = g.sample(range(-(10**6), 10**9), 700)
    df = spark.createDataFrame([(i, str(i)) for i in ids], "doc_id long, text string")
    got = {r["doc_id"]: r["next_text"] for r in merkle.with_next(df).collect()}
    order = sorted(ids, reverse=True)
    assert got == {i: str(order[(k + 1) % len(order)]) for k, i in enumerate(order)}


def test_edits_touch_their_own_branches(spark):
    lines = [f"This is line {i}, about topic {i * 7}." for i in range(40)]
    other = lines[:]
    other[20] = "Something else altogether."
    df = spark.createDataFrame([(1, "\n".join(lines)), (2, "\n".join(other))], "doc_id long, text string")
    a, b = (r["t"] for r in df.select(merkle.tree(F.col("text")).alias("t")).collect())
    assert a["root"] != b["root"] and len(set(a["sections"]) ^ set(b["sections"])) <= 4 and len(a["sections"]) > 1


def leaves(text):
    """The tree by definition: root, section nodes, phrase texts."""
    import regex

    paragraphs, sections, run = (text or "").split("\n"), [], []
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    chain = []
    for p in paragraphs:
        run.append(sha(p))
        if not p or run[-1][0] in "01":
            chain.append(run)
            run = []
    chain.append(run)
    # a closed section's node is of its paragraph nodes joined by commas
    sections = [sha(",".join(r)) for r in chain]
    phrases = set()
    for p in paragraphs:
        for x in regex.split(r"(?<=[aeiouyAEIOUY0-9\p{P}\p{S}])\x20+", p):
            phrases |= set(regex.findall(r"(?s).{1,64}", x)) if len(x) > 64 else {x}
    return sha("|".join([",".join(sections), str(len(paragraphs))])), sections, phrases


def test_fingerprints_match_the_definition(spark, odd):
    """Root, sections and both likenesses, from plain Python."""
    got = {r["doc_id"]: r for r in merkle.fingerprints(odd).collect()}
    text = {i: t or "" for i, t, *_ in rows()}
    order = sorted(text, reverse=True)
    dice = lambda a, b: 1.0 if a[0] == b[0] else 2 * len(a[2] & b[2]) / (len(a[2]) + len(b[2]))
    for k, i in enumerate(order):
        after = text[order[(k + 1) % len(order)]]
        cut = len(text[i]) // 3
        edited = text[i][: len(text[i]) - cut] + after[:cut]
        a, b, c = leaves(text[i]), leaves(edited), leaves(after)
        root, sections, phrases = got[i]["fingerprint"].split(":")
        assert root == a[0] and sections == "".join(s[:16] for s in a[1]) and len(phrases) == 8 * len(a[2])
        assert got[i]["edited_fingerprint"].split(":")[0] == b[0]
        assert abs(got[i]["near_edited"] - dice(a, b)) < 1e-6 and abs(got[i]["near_next"] - dice(a, c)) < 1e-6


def test_differing_branches_hold_the_edit(spark):
    g = random.Random(5)
    lines = [" ".join(g.choice("lorem ipsum dolor sit amet".split()) + str(g.randrange(99)) for _ in range(8)) for _ in range(60)]
    other = [*lines]
    other[33] = "this line is new"
    df = spark.createDataFrame([("\n".join(lines), "\n".join(other))], "a string, b string").select("a", "b", merkle.tree(F.col("a")).alias("ta"), merkle.tree(F.col("b")).alias("tb"))
    r = df.select(merkle.differing_branches(F.col("tb"), F.col("ta")).alias("at"), merkle.section_texts(F.col("b")).alias("s"), F.size("tb.sections").alias("n"), merkle.differing_branches(F.col("ta"), F.col("ta")).alias("none")).first()
    assert r["none"] == [] and len(r["s"]) == r["n"] and 1 <= len(r["at"]) <= 3 and any("this line is new" in r["s"][i] for i in r["at"])
    assert "\n".join(r["s"]).rstrip("\n") == "\n".join(other)


def test_one_outlying_id_leaves_buckets_even(spark):
    docs = spark.createDataFrame([(i, "x") for i in range(3000)] + [(10**15, "y")], "doc_id long, text string")
    cells, cell, buckets = merkle._cells(docs.select("doc_id"))
    sizes = [r["count"] for r in docs.withColumn("c", cell).join(cells, F.col("c") == F.col("__cell")).groupBy("__bucket").count().collect()]
    assert buckets > 8 and max(sizes) < 3000 / 8


def test_many_matches_of_one_text(spark):
    text = " ".join(f"{i:024x}" for i in range(3000))
    r = secrets.scan(spark.createDataFrame([(1, text)], "doc_id long, text string"))[0].first()
    assert [(s["start"], s["end"]) for s in r["found"]] == [(25 * i, 25 * i + 24) for i in range(3000)]
