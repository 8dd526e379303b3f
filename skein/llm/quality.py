"""Quality by nearest-neighbour voting in a latent-semantic space.

Terms are lower-cased words, hashed; what words look like: case, last character, length,
whether the word repeats the one before; and pairs of neighbouring looks.  Term weights are
log counts by inverse document frequency, the latter counted over all documents; words
weigh ``WORD_WEIGHT`` of it, as there are so many of them.  A
bounded sample of labelled documents gives the latent space, by a randomised singular value
decomposition, and the labelled vectors, which are broadcast (``LABELLED`` x ``RANK``
numbers at most).  Every document's exact cosines with all of them come from blocked
matrix products; its nearest ``NEIGHBOURS`` vote, weighted by similarity.

Defined results: null and empty texts have no terms and score the share of good labels;
a document labelled twice counts as good if one label says so; without labels every score is
that of no opinion, 0.5; repeated rows each get a row; of equally near neighbours (at five
places) those of smaller ids vote; a text of any length is scored whole; an empty table gives
no rows; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import one_thread, split_batches, text_bytes
from .words import LOWER, SPACE, hashes, spans

PAIRS = 2048
SHAPES = 4 * 8 * 4 * 2
WORD_BITS, WORD_WEIGHT = 11, 0.5
TERMS, RANK, LABELLED, NEIGHBOURS = SHAPES + PAIRS + (1 << WORD_BITS), 64, 4000, 15
SCORES = "doc_id long, score double"

_LAST = np.full(256, 6, np.uint8)
for _i, _chars in enumerate((b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", b".", b",", b"!?", b"#*$%&@^~", b"|0123456789")):
    _LAST[list(_chars)] = _i
_LAST[0x80:] = 0
_UPPER, _LOWER = np.zeros(256, bool), np.zeros(256, bool)
_UPPER[0x41:0x5B] = _LOWER[0x61:0x7B] = True


def counts(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Term counts (texts, TERMS)."""
    n = len(offsets) - 1
    start, end, doc = spans(raw, offsets, ~SPACE)
    if not len(start):
        return np.zeros((n, TERMS), np.float32)
    total = lambda table: np.concatenate([[0], np.cumsum(table[raw])])
    up, low = total(_UPPER), total(_LOWER)
    ups, lows, size = up[end] - up[start], low[end] - low[start], end - start
    case = np.where(ups == 0, np.where(lows == 0, 3, 0), np.where((ups == 1) & (lows > 0), 1, 2))
    h = hashes(raw, start, end)
    again = np.zeros(len(h), np.int64)
    again[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    length = np.searchsorted([3, 7, 13], size)
    shape = ((case * 8 + _LAST[raw[end - 1]]) * 4 + length) * 2 + again
    pair = doc[1:] == doc[:-1]
    coarse = (case * 8 + _LAST[raw[end - 1]]) * 2 + again
    second = (coarse[:-1] * 64 + coarse[1:])[pair].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(53)
    word = (hashes(LOWER[raw], start, end) >> np.uint64(64 - WORD_BITS)).astype(np.int64)
    key = np.concatenate([doc * TERMS + shape, doc[1:][pair] * TERMS + SHAPES + second.astype(np.int64), doc * TERMS + SHAPES + PAIRS + word])
    return np.bincount(key, minlength=n * TERMS).reshape(n, TERMS).astype(np.float32)


def _blocks(batch):
    """Term counts of a slice, in blocks of few enough texts for dense rows."""
    for part in split_batches(batch, 4 << 20):
        for a in range(0, part.num_rows, 512):
            one = part.slice(a, 512)
            yield one, counts(*text_bytes(one.column("text")))


def _document_counts(batches):
    import pyarrow as pa

    one_thread()
    rows, df = 0, np.zeros(TERMS, np.int64)
    for whole in batches:
        for one, c in _blocks(whole):
            rows += one.num_rows
            df += (c > 0).sum(axis=0)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(TERMS + 1, dtype=np.int32)), pa.array(np.append(df, rows))], names=["term", "n"])


def idf(docs: DataFrame) -> np.ndarray:
    """Inverse document frequency of each term, over all rows; one row a term and task is shuffled."""
    got = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(_document_counts, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toPandas()
    n = np.zeros(TERMS + 1)
    n[got["term"]] = got["n"]
    return np.log((1 + n[-1]) / (1 + n[:-1])).astype(np.float32)


def _weighted(c: np.ndarray, by: np.ndarray) -> np.ndarray:
    x = np.log1p(c) * by
    x[:, SHAPES + PAIRS :] *= WORD_WEIGHT
    x /= np.linalg.norm(x, axis=1, keepdims=True) + 1e-9
    return x


def _unit(x: np.ndarray) -> np.ndarray:
    return (x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-9)).astype(np.float32)


def _sampled(batches):
    import pyarrow as pa

    one_thread()
    for whole in batches:
        for one, c in _blocks(whole):
            yield pa.RecordBatch.from_arrays([one.column("doc_id"), one.column("quality"), pa.array([np.minimum(r, 65_535).astype("<u2").tobytes() for r in c], pa.binary())], names=["doc_id", "quality", "c"])


def fit(docs: DataFrame, labels: DataFrame, eligible: Column, most: int = LABELLED):
    """(idf, projection, labelled vectors, labels, prior), or None without labels.  ``eligible`` is a condition on doc_id."""
    marks = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & eligible).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    share = marks.agg(F.avg(F.col("quality").cast("double"))).first()[0]
    if share is None:
        return None
    picked = marks.orderBy(F.xxhash64("doc_id", F.lit(3)), "doc_id").limit(most)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(picked), "doc_id").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"), F.coalesce("text", F.lit("")).alias("text"))
    # at most ``most`` ids are picked; the order of rows decides ties
    got = rows.mapInArrow(_sampled, "doc_id long, quality int, c binary").orderBy("doc_id", "c").toArrow()
    if not got.num_rows:
        return None
    y = got.column("quality").to_numpy().astype(np.float32)
    by = idf(docs)
    x = _weighted(np.stack([np.frombuffer(b, "<u2") for b in got.column("c").to_pylist()]).astype(np.float32), by)
    top = latent(x)
    return by, top, _unit(x @ top), y, float(share)


def latent(x: np.ndarray, rank: int = RANK, rounds: int = 6) -> np.ndarray:
    """The leading right singular vectors of ``x`` (terms, rank), by subspace iteration from fixed random vectors."""
    q = np.random.default_rng(5).standard_normal((x.shape[1], min(rank + 16, *x.shape))).astype(np.float32)
    for _ in range(rounds):
        q, _ = np.linalg.qr(x.T @ (x @ q))
    _, _, turn = np.linalg.svd(x @ q, full_matrices=False)
    return np.ascontiguousarray((q @ turn.T)[:, :rank], np.float32)


def vote(model, c: np.ndarray, neighbours: int = NEIGHBOURS) -> np.ndarray:
    """Shares of good among each text's nearest labelled ones, by similarity; of equally near ones the first in order vote."""
    by, top, known, y, prior = model
    cos = np.round(_unit(_weighted(c, by) @ top) @ known.T, 5)
    k = min(neighbours, len(y))
    edge = np.partition(cos, len(y) - k, axis=1)[:, len(y) - k, None]
    near, tied = cos > edge, cos == edge
    near |= tied & (np.cumsum(tied, axis=1, dtype=np.int32) <= k - near.sum(axis=1, keepdims=True))
    w = np.where(near, np.clip(cos, 0, None) ** 4, 0)
    total = w.sum(axis=1)
    return np.where(total > 1e-6, w @ y / np.maximum(total, 1e-6), prior)


def _score(model):
    def run(batches):
        import pyarrow as pa

        one_thread()
        for whole in batches:
            for one, c in _blocks(whole):
                s = np.full(one.num_rows, 0.5) if model is None else np.clip(vote(model, c), 0, 1).astype(np.float64)
                yield pa.RecordBatch.from_arrays([one.column("doc_id"), pa.array(s)], names=["doc_id", "score"])

    return run


def score(docs: DataFrame, model) -> DataFrame:
    """doc_id and score of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded by LABELLED x RANK and TERMS x RANK

    def run(batches):
        yield from _score(sent.value)(batches)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCORES)
