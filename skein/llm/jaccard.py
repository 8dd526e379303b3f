"""Exact set-similarity self-join of word shingles, by universe partition and pigeonhole.

Sets of a size band, and of the sizes above it that can still be similar, are a family.
Two similar sets of a family differ in at most H tokens.  The universe of hashed tokens
is cut into m segments, more than the H + 1 that the pigeonhole needs.  Every segment of
every set is indexed by an exact signature.  Each set has a budget of H + 1: it goes
without as many segments as there are over that, first those that hold nothing, then those whose
signatures most sets share.  Two similar sets then agree in a segment that one of the two
hasn't left out, so a signature that only sets that left it out have makes no candidates:
what a passage fills alone doesn't tie its documents.

Equal sets are one class, known by a hash of the set.  Within the classes that share a
signature not all pairs are made: the class that shares most (a copies' original, as a
rule) is the pivot, all others are verified against it.  What is open then are signatures
whose other classes are of several components.  The cheapest way is taken, by
counts over all of them: those of different components meet under each signature, or, where one
pivot has many signatures with the same classes, once under the pivot; or all open sets of the
band are indexed again by half as many, longer segments with one-deletion neighbourhoods,
budget 2 a segment, full segments against full ones and against deletions.  All are exact.
Sizes and parity sketches (two sets differ in at least as many tokens as bits) are part of
these joins, so that what they rule out is never made.

Tokens are 64-bit hashes of shingles.  Class hashes are checked by a second hash; on a
collision the join starts again with another seed.

Defined results: null and empty texts have no tokens and are linked with nothing; a text
of fewer words than a shingle is one token; a text of any length is read whole, in a batch
of its own; repeated rows are one class; rows without an id take part and get the smallest
id that they reach, null if there is none; an empty table gives no rows; columns other than
doc_id and text are not read (``keep_one`` keeps them all; names that start with __jac are
an error there).
"""

from __future__ import annotations

import math
from bisect import bisect_left
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.operators.components import connected_components

from .common import durable, one_thread, refuse, settle, small_enough, split_batches, text_bytes
from .words import LOWER, SPACE, hashes, mix, shingles, spans

#: Rows that may be broadcast.
BROADCAST_ROWS = 1_000_000
ROWS = "doc_id long, h long, n long, key long, check long, bits array<long>, spare array<int>"
#: Words of 64 bits of a set's parity sketch.
SKETCH = 16
#: The low bits of a signature say its band.
BAND_BITS = 7
#: What a pair of classes, with two sketches, costs against a row of an index.
PAIR_COST = 4


class Shape:
    """Bands, families and segments for a similarity of num/den or more."""

    def __init__(self, num: int, den: int, seed: int = 0) -> None:
        self.num, self.den, self.seed = num, den, seed
        self.tops = [1]

    def band(self, n: int) -> int:
        while self.tops[-1] < n:
            top = self.tops[-1]
            self.tops.append(max(top + 1, top * self.den**3 // self.num**3))
        return bisect_left(self.tops, n)

    def differ(self, band: int) -> int:
        """The most tokens in which two similar sets of a family differ."""
        while len(self.tops) <= band:
            self.band(self.tops[-1] + 1)
        return (self.den - self.num) * self.tops[band] // self.num

    def segments(self, band: int, wide: bool = False) -> int:
        """Exact segments of a family, or its longer ones of budget 2; a quarter more than the pigeonhole needs."""
        h = self.differ(band)
        if h == 0:
            return 0
        need = (h + 2) // 2 if wide else h + 1
        return need + 1 + (h + 1) // 4

    def families(self, n: int) -> list[int]:
        """The bands whose families a set of n tokens is in; equal sets need none."""
        b = self.band(n)
        return [x for x in (b, b - 1) if x >= 0 and self.differ(x) and (x == b or n * self.num <= self.tops[x] * self.den)]

    @lru_cache(maxsize=512)
    def edges(self, band: int, wide: bool = False) -> np.ndarray:
        m = self.segments(band, wide)
        return np.array([-((-i << 64) // m) for i in range(1, m)], np.uint64) if m else np.zeros(0, np.uint64)

    def cuts(self, tokens: np.ndarray, band: int, wide: bool = False) -> np.ndarray:
        """Where the segments of a sorted token set begin, and its end."""
        return np.concatenate([[0], np.searchsorted(tokens, self.edges(band, wide)), [len(tokens)]])

    def over(self, tokens: np.ndarray, band: int) -> tuple[int, int]:
        """How many exact segments a set may go without, and how many of its own hold nothing."""
        at = self.cuts(tokens, band)
        return len(at) - 2 - self.differ(band), int((at[1:] == at[:-1]).sum())


def _named(values: np.ndarray, segment: np.ndarray, band: int, wide: bool) -> np.ndarray:
    """Hashes of segments' contents by band, segment and layout; the low bits are the band."""
    name = mix((np.uint64(2 * band + wide + 1) << np.uint64(32)) + segment.astype(np.uint64))
    return (mix(values ^ name) & ~np.uint64((1 << BAND_BITS) - 1)) | np.uint64(band)


def signatures(shape: Shape, tokens: np.ndarray, sums: np.ndarray, band: int) -> np.ndarray:
    """Signatures of the segments of a sorted token set.  ``sums``: running sums of mixed tokens, from 0.

    Empty segments have none if the set may go without all of its own.
    """
    at = shape.cuts(tokens, band)
    spare, empty = shape.over(tokens, band)
    segment = np.flatnonzero(at[1:] > at[:-1]) if empty <= spare else np.arange(len(at) - 1)
    return _named(sums[at[1:]][segment] - sums[at[:-1]][segment], segment, band, False)


def neighbourhoods(shape: Shape, tokens: np.ndarray, sums: np.ndarray, band: int) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of the long segments of a sorted token set, and of these without each of their tokens.

    A segment of one token counts 1 and an empty one 0, without the empty signature, if
    the set reaches H + 1 even so.
    """
    at = shape.cuts(tokens, band, True)
    size = np.diff(at)
    light = int(np.minimum(size, 2).sum()) >= shape.differ(band) + 1
    whole = sums[at[1:]] - sums[at[:-1]]
    segment = np.flatnonzero(size > 0) if light else np.arange(len(size))
    of = np.repeat(np.arange(len(size)), size)
    less = np.flatnonzero(size[of] > 1) if light else np.arange(len(tokens))
    own = sums[1:] - sums[:-1]
    return _named(whole[segment], segment, band, True), _named(whole[of[less]] - own[less], of[less], band, True)


def token_sets(batch, words: int):
    """Sorted distinct tokens of each text of a batch, sliced to bounded bytes."""
    for part in split_batches(batch, 4 << 20):
        raw, off = text_bytes(part.column("text"))
        low = LOWER[raw]
        start, end, doc = spans(low, off, ~SPACE)
        h, edges = shingles(hashes(low, start, end), doc, len(off) - 1, words)
        yield part, [np.unique(h[edges[i] : edges[i + 1]]) for i in range(len(off) - 1)]


def _class(tokens: np.ndarray, sums: np.ndarray, seed: int) -> tuple[int, int]:
    total = np.array([sums[-1] + np.uint64(len(tokens)), (tokens * np.uint64(0x9FB21C651E98DF25) + np.uint64(seed)).sum(dtype=np.uint64) if len(tokens) else 0], np.uint64)
    a, b = mix(mix(total) + np.uint64(seed)).view(np.int64).tolist()
    return a, b


def _sums(tokens: np.ndarray, seed: int) -> np.ndarray:
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(tokens + np.uint64(seed)), dtype=np.uint64)])


def _index(num: int, den: int, seed: int, words: int):
    """A row a text: its set's size, hashes and sketch, and what each of its families can go without of segments that hold something."""

    def run(batches):
        import pyarrow as pa

        one_thread()
        shape = Shape(num, den, seed)
        for whole in batches:
            for part, sets in token_sets(whole, words):
                found = [(len(t), *_class(t, _sums(t, seed), seed), sketch(t).tolist(), [s - e if e <= s else s for s, e in (shape.over(t, b) for b in shape.families(len(t)))] if len(t) else []) for t in sets]
                arrays = [part.column("doc_id"), part.column("h"), *(pa.array([f[i] for f in found], pa.int64()) for i in range(3)), pa.array([f[3] for f in found], pa.list_(pa.int64())), pa.array([f[4] for f in found], pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "h", "n", "key", "check", "bits", "spare"])

    return run


def _signed(num: int, den: int, seed: int, words: int):
    """(sig, key) of the segments of every set in its families; equal sets of a task once, as far as it remembers."""

    def run(batches):
        import pyarrow as pa

        one_thread()
        shape, none, seen = Shape(num, den, seed), np.zeros(0, np.int64), set()
        for whole in batches:
            for _, sets in token_sets(whole, words):
                keys, sigs = [none], [none]
                for tokens in sets:
                    if not len(tokens):
                        continue
                    sums = _sums(tokens, seed)
                    key = _class(tokens, sums, seed)[0]
                    if key in seen:
                        continue
                    if len(seen) < 100_000:
                        seen.add(key)
                    for b in shape.families(len(tokens)):
                        g = signatures(shape, tokens, sums, b)
                        keys.append(np.full(len(g), key, np.int64))
                        sigs.append(g.view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sigs)), pa.array(np.concatenate(keys))], names=["sig", "key"])

    return run


def _wide(num: int, den: int, seed: int, bands: set[int]):
    """(sig, key, part) of the long segments of sets (part 0) and of their one-deletion neighbourhoods (1), in ``bands``."""

    def run(batches):
        import pyarrow as pa

        one_thread()
        shape = Shape(num, den, seed)
        for batch in batches:
            sigs, keys, parts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
            for key, raw in zip(batch.column("key").to_pylist(), batch.column("tokens"), strict=True):
                tokens = np.frombuffer(raw.as_buffer(), np.uint64)
                sums = _sums(tokens, seed)
                for b in set(shape.families(len(tokens))) & bands:
                    for part, g in enumerate(neighbourhoods(shape, tokens, sums, b)):
                        sigs.append(g.view(np.int64))
                        keys.append(np.full(len(g), key, np.int64))
                        parts.append(np.full(len(g), part, np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (sigs, keys, parts)], names=["sig", "key", "part"])

    return run


def _shared(batches):
    """Of rows sorted by (sig, key, ...), the first of each key under a signature that several keys have.

    Only the last row of a batch is kept for the next, however many rows a signature has.
    """
    import pyarrow as pa

    held, before = None, False  # the last row, and whether one of another key is before it in its run
    for b in batches:
        if b.num_rows == 0:
            continue
        t = pa.Table.from_batches([b] if held is None else [held, b]).combine_chunks()
        sig, key = (t.column(c).to_numpy() for c in ("sig", "key"))
        new = np.append(True, (sig[1:] != sig[:-1]) | (key[1:] != key[:-1]))
        t, sig = t.filter(pa.array(new)), sig[new]
        same = sig[1:] == sig[:-1]
        prior = np.append(before, same)
        keep = prior[:-1] | same
        yield from t.slice(0, len(sig) - 1).filter(pa.array(keep)).to_batches()
        held, before = t.slice(len(sig) - 1).to_batches()[0], bool(prior[-1])
    if held is not None and before:
        yield held


def sketch(tokens: np.ndarray) -> np.ndarray:
    """Parities of the tokens that fall on each of 64 * SKETCH bits: two sets differ in at least as many tokens as bits."""
    at = (tokens * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - 10)
    odd = np.bincount(at.astype(np.int64), minlength=64 * SKETCH) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def wide_sketch(tokens: np.ndarray) -> bytes:
    """Like :func:`sketch`, with as many bits as the set has tokens, or more."""
    power = max(10, int(len(tokens) - 1).bit_length())
    at = (tokens * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - power)
    odd = np.bincount(at.astype(np.int64), minlength=1 << power) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def differ_at_least(x: np.ndarray, y: np.ndarray) -> int:
    """Tokens in which two sets differ at the least, by their wide sketches; the wider is folded to the other's bits."""
    while len(x) != len(y):
        if len(x) < len(y):
            x, y = y, x
        pairs = np.unpackbits(x, bitorder="little").reshape(-1, 2)
        x = np.packbits(pairs[:, 0] ^ pairs[:, 1], bitorder="little")
    return int(np.bitwise_count(x ^ y).sum())


def _sets(seed: int, words: int):
    def run(batches):
        import pyarrow as pa

        one_thread()
        for whole in batches:
            for _, sets in token_sets(whole, words):
                keep = [t for t in sets if len(t)]
                keys = [_class(t, _sums(t, seed), seed)[0] for t in keep]
                binary = lambda x: pa.array(x, pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([len(t) for t in keep], pa.int64()), binary([wide_sketch(t) for t in keep]), binary([t.tobytes() for t in keep])], names=["key", "n", "wide", "tokens"])

    return run


def _plausible(num: int, den: int):
    def run(batches):
        import pyarrow as pa

        for b in batches:
            keep = []
            for x, y, m, n in zip(b.column("wa"), b.column("wb"), b.column("na").to_pylist(), b.column("nb").to_pylist(), strict=True):
                odd = differ_at_least(np.frombuffer(x.as_buffer(), np.uint8), np.frombuffer(y.as_buffer(), np.uint8))
                keep.append(odd * (den + num) <= (m + n) * (den - num))
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _intersect(batches):
    import pyarrow as pa

    for b in batches:
        inter, union = [], []
        for x, y in zip(b.column("ta"), b.column("tb"), strict=True):
            p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            both = np.concatenate([p, q])
            both.sort(kind="stable")  # two sorted runs: a merge
            same = int((both[1:] == both[:-1]).sum())
            inter.append(same)
            union.append(len(both) - same)
        yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(inter, pa.int64()), pa.array(union, pa.int64())], names=["a", "b", "inter", "uni"])


def allot(shape: Shape, pairs: dict[int, float], sets: dict[int, tuple[int, int]]) -> set[int]:
    """The bands in which one-deletion neighbourhoods of long segments are the cheaper index.

    ``pairs``: by band the pairs that open signatures make; ``sets``: how many sets are open, and their tokens.
    """
    return {b for b, n in pairs.items() if n * PAIR_COST > sets[b][0] * shape.segments(b, True) + sets[b][1]}


def _read_sets(docs: DataFrame, classes: DataFrame, keys: DataFrame, seed: int, words: int) -> DataFrame:
    """(key, n, wide, tokens) of the classes in ``keys``; only texts that one needs are read into sets."""
    ids = durable(classes.join(keys, "key", "left_semi").select(F.col("rep").alias("__rep")), "jac-need")
    ids = F.broadcast(ids) if small_enough(ids, BROADCAST_ROWS) else ids.hint("shuffle_hash")
    texts = docs.join(ids, docs["doc_id"].eqNullSafe(ids["__rep"]), "left_semi").select("text")
    sets = texts.mapInArrow(_sets(seed, words), "key long, n long, wide binary, tokens binary").join(keys, "key", "left_semi").dropDuplicates(["key"])
    return durable(sets, "jac-sets")


def _odd(x: str, y: str):
    """Bits in which two sketches (columns w0x and so on) differ."""
    return sum((F.bit_count(F.col(f"w{i}{x}").bitwiseXOR(F.col(f"w{i}{y}"))) for i in range(1, SKETCH)), F.bit_count(F.col(f"w0{x}").bitwiseXOR(F.col(f"w0{y}"))))


def _possible(x: str, y: str, num: int, den: int):
    """Whether sizes and sketches of two sets let them be similar."""
    nx, ny = F.col(f"n{x}"), F.col(f"n{y}")
    return (nx * den >= ny * num) & (ny * den >= nx * num) & (_odd(x, y) * (den + num) <= (nx + ny) * (den - num))


def _size_class(n, num: int, den: int):
    """Sizes that let two sets be similar are in the same class or in neighbouring ones."""
    return F.floor(F.log(n.cast("double")) / (math.log(den / num) * 1.0001)).cast("int")


def _verify(sets: DataFrame, pairs: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b, inter, uni) of pairs (a, b) of classes, without those that wide sketches rule out."""
    side = lambda x, c, short: sets.select(F.col("key").alias(x), F.col(c).alias(f"{short}{x}"), *([F.col("n").alias(f"n{x}")] if short == "w" else []))
    joined = lambda p, c, short: p.join(side("b", c, short), "b").join(side("a", c, short), "a")
    left = durable(joined(pairs, "wide", "w").select("a", "b", "wa", "wb", "na", "nb").mapInArrow(_plausible(num, den), "a long, b long"), "jac-plausible")
    both = joined(left, "tokens", "t").select("a", "b", "ta", "tb")
    return durable(both.mapInArrow(_intersect, "a long, b long, inter long, uni long"), "jac-verified")


def _linked(docs: DataFrame, words: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, h, n, key, ...) of ``docs`` (doc_id, text), and the component of each class that has a link (key, component)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    docs = docs.withColumn("h", F.xxhash64("text"))
    for seed in range(8):
        rows = durable(docs.mapInArrow(_index(num, den, seed, words), ROWS), "jac-rows")
        classes = rows.where("n > 0").groupBy("key").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n"), F.min("check").alias("low"), F.max("check").alias("high"), F.first("spare").alias("spare"))
        classes = durable(classes, "jac-classes")
        if classes.where("low <> high").limit(1).count() == 0:
            break
    shape = Shape(num, den, seed)
    shape.band(int(classes.agg(F.max("n")).first()[0] or 1))
    sorted_runs = lambda df: df.repartition("sig").sortWithinPartitions(*df.columns).mapInArrow(_shared, df.schema)
    members = durable(sorted_runs(docs.select("text").mapInArrow(_signed(num, den, seed, words), "sig long, key long")), "jac-members")
    settle(docs.sparkSession)
    rated = durable(_rated(members, classes, shape), "jac-rated")
    pivot = rated.groupBy("sig").agg(F.max(F.struct("shares", "key")).alias("pivot"), F.max("probes").alias("probes")).where("probes").select("sig", F.col("pivot.key").alias("a"))
    stars = rated.join(pivot, "sig").where(F.col("a") != F.col("key"))
    pairs = stars.select("a", F.col("key").alias("b")).distinct()
    sketches = rows.where("n > 0").select("key", "n", *[F.col("bits")[i].alias(f"w{i}") for i in range(SKETCH)])
    links = _similar(docs, classes, sketches, pairs, seed, words, num, den)
    settle(docs.sparkSession)
    named = connected_components(links, "a", "b")
    rest = _unlinked(stars, named, classes, sketches, docs, shape, words)
    if rest is not None:
        more = _exact(docs, classes, durable(rest, "jac-rest"), seed, words, num, den)
        settle(docs.sparkSession)
        if more.limit(1).count():
            named = connected_components(links.unionByName(more), "a", "b")
    return rows, named.select(F.col("node").alias("key"), "component")


def _rated(members: DataFrame, classes: DataFrame, shape: Shape) -> DataFrame:
    """(sig, key, probes, shares): whether a class probes a signature or leaves it out, and how much it shares in all."""
    band = F.col("sig").bitwiseAND((1 << BAND_BITS) - 1).cast("int")
    own = _band(F.col("n"), shape)
    spare = classes.select("key", own.alias("own"), "spare")
    sized = members.join(members.groupBy("sig").agg(F.count(F.lit(1)).alias("size")), "sig").join(spare, "key")
    # families are the own band and the one below it; bands without a family have no signatures
    sized = sized.withColumn("band", band).withColumn("spare", F.when(F.col("band") == F.col("own"), F.col("spare")[0]).otherwise(F.element_at("spare", -1)))
    rank = F.row_number().over(Window.partitionBy("key", "band").orderBy(F.col("size").desc(), "sig"))
    return sized.withColumn("probes", rank > F.col("spare")).withColumn("shares", F.sum("size").over(Window.partitionBy("key"))).select("sig", "key", "probes", "shares")


def _band(n, shape: Shape):
    """The band of a size, as a column; bands are as many as the logarithm of the largest set."""
    tops = F.array(*map(F.lit, shape.tops))
    return F.size(F.filter(tops, lambda t: t < n))


def _similar(docs, classes, sketches, pairs, seed, words, num, den) -> DataFrame:
    """The pairs (a, b) of classes that are similar: by sizes and sketches, then as :func:`_exact` says."""
    pairs = durable(pairs, "jac-pairs")
    known = durable(sketches.join(_keys(pairs), "key", "left_semi").dropDuplicates(["key"]), "jac-sketches")
    of = lambda x: known.select(F.col("key").alias(x), *[F.col(c).alias(c + x) for c in known.columns if c != "key"])
    near = durable(pairs.join(of("a"), "a").join(of("b"), "b").where(_possible("a", "b", num, den)).select("a", "b"), "jac-near")
    return _exact(docs, classes, near, seed, words, num, den)


def _keys(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("key")).union(pairs.select(F.col("b").alias("key"))).distinct()


def _exact(docs, classes, pairs, seed, words, num, den) -> DataFrame:
    """The pairs of a stored table that are similar, by wide sketches and then by their sets."""
    found = _verify(_read_sets(docs, classes, _keys(pairs), seed, words), pairs, num, den)
    return found.where(F.col("inter") * den >= F.col("uni") * num).select("a", "b")


def _unlinked(stars, named, classes, sketches, docs, shape, words) -> DataFrame | None:
    """Pairs that may still link components, by the cheapest of three ways; without those that sizes and sketches rule out."""
    num, den = shape.num, shape.den
    comp = named.select(F.col("node").alias("key"), "component")
    inside = stars.select("sig", "a", "key", "probes").join(comp, "key", "left").withColumn("comp", F.coalesce("component", "key")).drop("component")
    open_ = _several(inside, "sig")
    left = inside.join(open_, "sig").join(classes.select("key", "n"), "key").withColumn("band", F.col("sig").bitwiseAND((1 << BAND_BITS) - 1).cast("int"))
    left = durable(left, "jac-open")
    of_pivot = _several(left.select("band", "a", "key", "comp").distinct(), "band", "a")
    by_sig = left.select("band", "a", "sig", "cost").distinct().groupBy("band", "a").agg(F.sum("cost").alias("by_sig"))
    ways = durable(of_pivot.withColumnsRenamed({"cost": "by_pivot", "big": "big_of_pivot"}).join(by_sig, ["band", "a"]), "jac-ways")
    costs = ways.groupBy("band").agg(F.sum(F.least("by_pivot", "by_sig")).cast("double").alias("pairs"))
    open_sets = left.select("band", "key", "n").distinct().groupBy("band").agg(F.count(F.lit(1)).alias("sets"), F.sum("n").alias("tokens"))
    counted = costs.join(open_sets, "band").collect()  # a row a band
    if not counted:
        return None
    bands = allot(shape, {r["band"]: r["pairs"] for r in counted}, {r["band"]: (r["sets"], r["tokens"]) for r in counted})
    known = sketches.join(left.select("key").distinct(), "key", "left_semi").dropDuplicates(["key"])
    known = durable(known.join(left.select("key", "comp").distinct(), "key"), "jac-sides")
    side = lambda df, x: df.select(*[F.col(k).alias(f"{k}{x}") for k in df.columns])
    apart = (F.col("compx") != F.col("compy")) & _possible("x", "y", num, den)
    ordered = (F.least("keyx", "keyy").alias("a"), F.greatest("keyx", "keyy").alias("b"))
    here = left.where(~F.col("band").isin(sorted(bands))) if bands else left
    chosen = ways.select("band", "a", "big_of_pivot", (F.col("by_pivot") <= F.col("by_sig")).alias("at_pivot"))
    here = here.join(chosen, ["band", "a"])
    once = here.where("at_pivot").select(F.xxhash64("band", "a").alias("g"), "key", F.lit(True).alias("probes"), F.col("big_of_pivot").alias("big")).distinct()
    each = here.where("NOT at_pivot").select(F.col("sig").alias("g"), "key", "probes", "big")
    groups = once.unionByName(each).join(known, "key")
    near = _size_class(F.col("n"), num, den)
    x = side(groups.where("comp <> big").withColumn("c", F.explode(F.array(near - 1, near, near + 1))), "x")
    y = side(groups.withColumn("c", near), "y")
    pairs = x.join(y, (F.col("gx") == F.col("gy")) & (F.col("cx") == F.col("cy")) & (F.col("probesx") | F.col("probesy")) & apart).select(*ordered)
    if bands:
        keys = left.where(F.col("band").isin(sorted(bands))).select("key").distinct()
        sets = _read_sets(docs, classes, keys, shape.seed, words).select("key", "tokens")
        index = sets.mapInArrow(_wide(num, den, shape.seed, bands), "sig long, key long, part int")
        met = index.repartition("sig").sortWithinPartitions("sig", "key", "part").mapInArrow(_shared, index.schema)
        met = durable(met, "jac-wide").join(known, "key")
        x, y = side(met.where("part = 0"), "x"), side(met, "y")
        pairs = pairs.unionByName(x.join(y, (F.col("sigx") == F.col("sigy")) & apart).select(*ordered))
    return pairs.distinct()


def _several(rows: DataFrame, *by: str) -> DataFrame:
    """(by, big, cost): groups with classes (key) of several components (comp), the component of most, and the pairs that
    the others make with all."""
    kinds = rows.groupBy(*by, "comp").count().groupBy(*by).agg(F.max(F.struct("count", "comp")).alias("top"), F.sum("count").alias("size"), F.count(F.lit(1)).alias("kinds"))
    return kinds.where("kinds > 1").select(*by, F.col("top.comp").alias("big"), ((F.col("size") - F.col("top.count")) * F.col("size")).alias("cost"))


def jaccard_components(docs: DataFrame, words: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs`` (doc_id, text).

    Two texts link if den * |intersection| >= num * |union| of their sets of shingles of ``words`` words.
    """
    rows, named = _linked(docs, words, num, den)
    grouped = rows.select("doc_id", "n", "key").join(named, "key", "left").withColumn("component", F.coalesce("component", "key"))
    smallest = durable(grouped.where("n > 0").groupBy("component").agg(F.min("doc_id").alias("component_id")), "jac-named")
    out = grouped.join(smallest, "component", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``docs`` with one document of each group of linked texts, the one of the smallest id (null last); all columns kept.

    Rows are told apart by id and text: of rows that repeat both one stays, which costs a
    pass over the texts only if there are any; of those that repeat an id alone each is judged by its text.
    """
    refuse(docs, "__jac")
    rows, named = _linked(docs, words, num, den)
    grouped = rows.select("doc_id", "h", "n", "key").join(named, "key", "left").withColumn("component", F.coalesce("component", "key"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")).alias("first")
    kept = grouped.where("n > 0").groupBy("component").agg(first).select(F.col("first.doc_id").alias("__jac_id"), F.col("first.h").alias("__jac_h"))
    kept = durable(kept.unionByName(grouped.where("n = 0").select(F.col("doc_id").alias("__jac_id"), F.col("h").alias("__jac_h")).distinct()), "jac-keep")
    seen = grouped.join(kept, grouped["doc_id"].eqNullSafe(kept["__jac_id"]) & (grouped["h"] == kept["__jac_h"]), "left_semi")
    again = seen.groupBy("doc_id", "h").count().where("count > 1").limit(1).count()
    same = docs["doc_id"].cast("long").eqNullSafe(kept["__jac_id"]) & (F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit(""))) == kept["__jac_h"])
    out = docs.join(kept.hint("shuffle_hash"), same, "left_semi")
    return out.dropDuplicates(["doc_id", "text"]) if again else out
