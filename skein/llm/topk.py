"""Exact top-k by inner product, without random access.

A block of candidates keeps one sorted list a dimension.  A query reads each list in
chunks from the end its own sign favours, always the chunk that takes most off the bounds
for what it costs, and adds what it reads to the candidates' partial sums.  What it has not read
of a candidate is at most the next value of that list and at least its last one: an upper and
a lower score.  Reading stops when all but a few candidates have upper scores below the
k-th lower score, or below the k-th score that earlier blocks of the task gave; those few
are resolved.  Where bounds never part the lists are read to their ends, and the partial sums are the scores.

Rows are read where they lie, a batch of them a block; queries are sent to them in chunks
of bounded size, a pass over the rows each.  A task keeps k rows a query, and the best k of
all are the result.

Defined results: vectors that are null, empty or hold a null or non-finite component
take no part, nor do rows without an id; rows that repeat an id are queries and candidates
of their own, none of itself; vectors of different lengths are never compared; ties go to
the smaller id; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, one_thread

#: Bytes of query vectors of a pass; shares of a list at which chunks end; bounds are tested when as many chunks are read as PATIENCE of the lists.
QUERY_BYTES, CHUNKS, PATIENCE = 32 << 20, (1 / 64, 1 / 8, 1.0), 1 / 4
HITS = "q long, query_id long, c long, vec_id long, score long"


def quantized(embedding: Column, scale: int = 256) -> Column:
    return F.transform(embedding, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long"))


def usable(embedding: Column) -> Column:
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf"))
    return embedding.isNotNull() & (F.size(embedding) > 0) & ~F.exists(embedding, bad)


def _exact_kind(x: np.ndarray, q: np.ndarray) -> type:
    """A number type in which every inner product is exact."""
    most = max(1, int(np.abs(x).max(initial=0))) * max(1, int(np.abs(q).max(initial=0))) * x.shape[1]
    if most < 2**24:
        return np.float32
    if most < 2**53:
        return np.float64
    if most < 2**64:
        return np.int64
    raise ValueError("a score may not fit 64 bits")


class Lists:
    """Sorted lists of a block of candidates, a list a dimension."""

    def __init__(self, x: np.ndarray, kind: type) -> None:
        self.x, self.n = x, len(x)
        self.columns = np.ascontiguousarray(x.T).astype(kind)
        self.order = np.argsort(self.columns, axis=1, kind="stable")
        self.values = np.take_along_axis(self.columns, self.order, 1)
        self.ends = sorted({max(1, int(self.n * c)) for c in CHUNKS})


def nra(lists: Lists, q: np.ndarray, k: int, floor: float | None = None, own: int | None = None) -> tuple[np.ndarray, np.ndarray, int, bool]:
    """Rows of a block that may be among the k best of a query, their scores, the entries read, and whether reading stopped early.

    ``floor``: a score that k rows of other blocks reach; ``own``: the row that is the query itself.
    """
    n, kind = lists.n, lists.columns.dtype.type
    q = q.astype(kind)
    # positive components read their list from its top, negative ones from its bottom
    heads = {c: (lists.values[:, n - 1 - c], lists.values[:, c]) for c in {0, n - 1, *(e for e in lists.ends if e < n)}}
    at = {c: np.where(q >= 0, q * top, q * bottom) for c, (top, bottom) in heads.items()}
    bound, worst = at[0].copy(), at[n - 1]
    # what is not read of a row is over + upper[row] at most and under + lower[row] at least
    sums, upper, lower, over, under = np.zeros(n, kind), np.zeros(n, kind), np.zeros(n, kind), bound.sum(), worst.sum()
    live = np.flatnonzero(q)
    step, read, tested = np.zeros(len(q), int), 0, 0
    starts = [0, *lists.ends]
    gains = np.stack([(at[s if s < n else n - 1] - (at[e] if e < n else worst)) / (e - s) for s, e in zip(starts[:-1], lists.ends, strict=True)])
    ahead = np.full(len(q), -1.0)
    ahead[live] = gains[0][live]
    rest = np.flatnonzero(np.arange(n) != own) if own is not None else np.arange(n)
    patience, left = max(1, int(len(live) * PATIENCE)), len(live)
    while left:
        d = int(ahead.argmax())
        start, end = starts[step[d]], lists.ends[step[d]]
        places = lists.order[d][::-1] if q[d] >= 0 else lists.order[d]
        seen = places[:start]
        if end < n:
            new, after = places[start:end], at[end][d]
            sums[new] += q[d] * lists.columns[d, new]
            lower[new] -= worst[d]
            upper[new] -= after
            upper[seen] += bound[d] - after
            over += after - bound[d]
            bound[d], step[d] = after, step[d] + 1
            ahead[d] = gains[step[d], d]
        else:
            # the list's rest is read: all rows of the block, without what was read before
            part = q[d] * lists.columns[d]
            part[seen] = 0
            sums += part
            upper[seen] += bound[d]
            lower[seen] += worst[d]
            over, under = over - bound[d], under - worst[d]
            ahead[d], left = -1.0, left - 1
        read, tested = read + end - start, tested + 1
        if tested % patience == 0 or not left:
            lows = (sums + lower)[rest] + under
            least = np.partition(lows, len(lows) - k)[len(lows) - k] if len(lows) > k else None
            least = floor if least is None else least if floor is None else max(least, floor)
            if least is not None:
                rest = rest[(sums + upper)[rest] + over >= least]
            if left and len(rest) <= 4 * k:
                return rest, (lists.columns[:, rest].T @ q).astype(np.int64), read, True
    return rest, sums[rest].astype(np.int64), read, False


def _exact(a: int, b: int, size: int) -> type:
    """A number type in which every bound and score of components up to a and b is exact."""
    most = 4 * max(1, a) * max(1, b) * size
    if most < 2**24:
        return np.float32
    if most < 2**53:
        return np.float64
    if most < 2**63:
        return np.int64
    raise ValueError("a score may not fit 64 bits")


def _search(asked, k: int):
    """The k best of a task's rows for each query of a chunk: ``asked`` has its places, ids and vectors by length."""

    def run(batches):
        import pyarrow as pa

        one_thread()
        found = {size: [[] for _ in ids] for size, (_, ids, _) in asked.value.items()}
        for b in batches:
            lengths = np.diff(b.column("v").offsets.to_numpy()) if b.num_rows else np.zeros(0, int)
            for size in set(lengths.tolist()) & set(asked.value):
                part = b.filter(pa.array(lengths == size))
                x = part.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
                place, ids = part.column("place").to_numpy(), part.column("id").to_numpy()
                places, _, vectors = asked.value[size]
                lists = Lists(x, _exact(int(np.abs(x).max()), int(np.abs(vectors).max(initial=0)), size))
                mine = {p: i for i, p in enumerate(place.tolist())}
                for j, kept in enumerate(found[size]):
                    floor = kept[-1][0] if len(kept) == k else None
                    rows, scores, *_ = nra(lists, vectors[j], k, floor, mine.get(int(places[j])))
                    best = np.lexsort((place[rows], ids[rows], -scores))[:k]
                    new = [*kept, *((int(scores[i]), int(ids[rows[i]]), int(place[rows[i]])) for i in best)]
                    kept[:] = sorted(new, key=lambda r: (-r[0], r[1], r[2]))[:k]
        out = [(int(asked.value[size][0][j]), int(asked.value[size][1][j]), c, i, s) for size, every in found.items() for j, kept in enumerate(every) for s, i, c in kept]
        columns = list(zip(*out, strict=True)) or [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["q", "query_id", "c", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows for each row that ``is_query`` (of vec_id) holds for.

    ``vectors`` has vec_id and embedding.
    """
    spark = vectors.sparkSession
    v = vectors.where(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).select(F.col("vec_id").cast("long").alias("id"), quantized(F.col("embedding"), scale).alias("v"), is_query.alias("asks"))
    # a place tells rows that repeat an id apart; it is stored, so every pass sees the same
    v = durable(v.withColumn("place", F.monotonically_increasing_id()), "topk-vectors")
    queries = v.where("asks").select("place", "id", "v")
    sized = queries.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("size")).first()
    chunks = max(1, -(-sized["n"] * 8 * (sized["size"] or 1) // QUERY_BYTES))
    hits = None
    for i in range(chunks):
        # a chunk is of QUERY_BYTES or so, whatever the number of queries
        got = queries.where(F.pmod(F.xxhash64("place"), F.lit(chunks)) == i).toPandas()
        asked = {int(size): (g["place"].to_numpy(), g["id"].to_numpy(), np.stack(g["v"].to_numpy())) for size, g in got.groupby(got["v"].map(len))}
        sent = spark.sparkContext.broadcast(asked)
        found = v.select("place", "id", "v").mapInArrow(_search(sent, k), HITS)
        found = durable(found, "topk-hits") if chunks > 1 else found
        hits = found if hits is None else hits.unionByName(found)
    order = Window.partitionBy("q").orderBy(F.col("score").desc(), "vec_id", "c")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = """
WITH v AS (SELECT row_number() OVER () AS place, vec_id AS id, [floor(256 * x::DOUBLE)::BIGINT for x in embedding] AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
             AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
p AS (SELECT q.place AS q, q.id AS query_id, c.id AS vec_id, list_sum([z[1] * z[2] for z in list_zip(q.v, c.v)])::BIGINT AS score, c.place AS c
      FROM v q JOIN v c ON q.place <> c.place AND len(q.v) = len(c.v) WHERE q.id % 50 = 0)
SELECT query_id, rank, vec_id, score FROM (
  SELECT query_id, (row_number() OVER (PARTITION BY q ORDER BY score DESC, vec_id, c))::INTEGER AS rank, vec_id, score FROM p)
WHERE rank <= 5
"""
