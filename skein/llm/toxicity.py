"""Toxicity by non-negative positive-unlabelled learning.

A document is the set of its lower-cased letter runs and their first 4, 5 and 6 bytes,
hashed.  A linear classifier is trained in numpy from confirmed toxic documents and
unlabelled ones.  With class prior ``p`` the risk of scores g is

    p E+[l(g)] + max(0, Eu[l(-g)] - p E+[l(-g)])

where l is the logistic loss: the second part is the risk on clean text that the
unlabelled text implies, which is never let below zero.  A proximal step keeps few
features, so that long clean texts gather no score from noise.

The sample is bounded: ``POSITIVES`` toxic and ``UNLABELLED`` documents of any kind, by
a hash of the id.  The prior is the toxic share of all labelled rows of the training side.

Defined results: null and empty texts have no features and score as the bias says; a
document labelled twice is toxic if one label says so; without toxic examples every score is
0; repeated rows each get a row; rows without an id are scored but not learned from; a text of
any length is scored whole; equal texts score the same, and ties in the draw of the sample go by
id; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import one_thread, split_batches, text_bytes
from .words import LETTER, LOWER, hashes, spans

BITS, PREFIXES, POSITIVES, UNLABELLED = 20, (4, 5, 6), 2000, 6000
#: Features that fewer sampled toxic documents have take no part.
LEAST = 4
STEPS, RATE, SPARSE = 250, 0.1, 4e-4
SCORES = "doc_id long, score double"


def features(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text number and feature of each word and of its beginnings."""
    low = LOWER[raw]
    start, end, doc = spans(low, offsets, LETTER)
    found, owner = [hashes(low, start, end)], [doc]
    for n in PREFIXES:
        long = end - start > n
        found.append(hashes(low, start[long], start[long] + n) + np.uint64(n))
        owner.append(doc[long])
    h = np.concatenate(found)
    return np.concatenate(owner), ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)).astype(np.int64)


def _sampled(batches):
    import pyarrow as pa

    one_thread()
    for whole in batches:
        for batch in split_batches(whole):
            raw, off = text_bytes(batch.column("text"))
            doc, f = features(raw, off)
            both = np.unique((doc << BITS) | f)
            edges = np.searchsorted(both >> BITS, np.arange(len(off)))
            ids = pa.array((both & ((1 << BITS) - 1)).astype(np.int32))
            lists = pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), ids)
            yield pa.RecordBatch.from_arrays([batch.column("kind"), lists], names=["kind", "f"])


def fit_nnpu(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray, float]:
    """Features, their weights and the bias."""
    seen = np.bincount(np.concatenate(positive), minlength=1 << BITS)
    vocabulary = np.flatnonzero(seen >= min(LEAST, max(1, len(positive) // 4)))
    slot = np.full(1 << BITS, -1)
    slot[vocabulary] = np.arange(len(vocabulary))

    def matrix(rows):
        owner, col = np.repeat(np.arange(len(rows)), [len(r) for r in rows]), slot[np.concatenate(rows)]
        return owner[col >= 0], col[col >= 0]

    (po, pc), (uo, uc) = matrix(positive), matrix(unlabelled)
    w, b, n, mu = np.zeros(len(vocabulary)), float(np.log(prior / (1 - prior))), len(vocabulary), (len(positive), len(unlabelled))
    sig = lambda x: 1 / (1 + np.exp(-np.clip(x, -30, 30)))
    m, v = np.zeros(n + 1), np.zeros(n + 1)
    for s in range(1, steps + 1):
        gp = b + np.bincount(po, w[pc], mu[0])
        gu = b + np.bincount(uo, w[uc], mu[1])
        clean = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
        # slope of each part by the scores
        up, uu = -prior * sig(-gp) / mu[0], np.zeros(mu[1])
        if clean > 0:
            up, uu = up - prior * sig(gp) / mu[0], sig(gu) / mu[1]
        grad = np.append(np.bincount(pc, up[po], n) + np.bincount(uc, uu[uo], n), up.sum() + uu.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        step = RATE / (np.sqrt(v / (1 - 0.999**s)) + 1e-5)
        move = step * m / (1 - 0.9**s)
        w, b = w - move[:-1], b - move[-1]
        w = np.sign(w) * np.maximum(0, np.abs(w) - np.minimum(step[:-1], 200) * SPARSE)
    kept = np.flatnonzero(np.abs(w) > 0.02)
    return vocabulary[kept], w[kept], b


def fit(docs: DataFrame, labels: DataFrame, eligible: Column, positives: int = POSITIVES, unlabelled: int = UNLABELLED):
    """The classifier, or None without toxic examples.  ``eligible`` is a condition on doc_id."""
    marks = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & eligible).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = marks.agg(F.avg(F.col("toxic").cast("double"))).first()[0]
    if not share:
        return None
    some = lambda df, n: df.select("doc_id").orderBy(F.xxhash64("doc_id", F.lit(5)), "doc_id").limit(n)
    p = some(marks.where("toxic = 1"), positives).withColumn("kind", F.lit(1))
    u = some(docs.where(F.col("doc_id").isNotNull() & eligible), unlabelled).withColumn("kind", F.lit(0))
    rows = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(p.unionByName(u)), "doc_id").select("kind", F.coalesce("text", F.lit("")).alias("text"))
    got = rows.mapInArrow(_sampled, "kind int, f array<int>").toArrow()
    kinds, lists = got.column("kind").to_numpy(), got.column("f").combine_chunks()
    flat, edges = lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())]).astype(int)
    take = lambda k: [flat[edges[i] : edges[i + 1]] for i in np.flatnonzero(kinds == k)]
    positive, rest = take(1), take(0)
    if not positive or not sum(map(len, positive)):
        return None
    return fit_nnpu(positive, rest or positive, min(0.9, max(0.001, float(share))))


def _score(model):
    def run(batches):
        import pyarrow as pa

        one_thread()
        if model is not None:
            weight = np.zeros(1 << BITS)
            weight[model[0]] = model[1]
        for whole in batches:
            for batch in split_batches(whole):
                raw, off = text_bytes(batch.column("text"))
                n = len(off) - 1
                if model is None:
                    score = np.zeros(n)
                else:
                    doc, f = features(raw, off)
                    live = weight[f] != 0
                    both = np.unique((doc[live] << BITS) | f[live])
                    g = model[2] + np.bincount(both >> BITS, weight[both & ((1 << BITS) - 1)], n)
                    score = 1 / (1 + np.exp(-np.clip(g, -30, 30)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score)], names=["doc_id", "score"])

    return run


def score(docs: DataFrame, model) -> DataFrame:
    """doc_id and score of every row."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_score(model), SCORES)
