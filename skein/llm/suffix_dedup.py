"""Removal of repeated byte strings by column-wise suffix sorting of many texts.

A byte goes if it lies in a string of ``SPAN`` bytes that also starts earlier: in a
smaller document, or before it in the same one.

Which strings meet.  The smallest hash of the ``GRAM``-byte grams of a string is its
anchor; equal strings have equal anchors at equal places.  Neighbouring strings of a
document with one anchor are a piece of at most ``SPAN + WINDOW - 1`` bytes, and each
string is in one piece.  Anchors that occur once can't hold repeats, so only pieces
with repeated anchors go on (a Bloom filter of fixed size lets a few others through).
Equal pieces, by two
64-bit hashes of their anchor and bytes, are one class, held by its earliest place.

How they are compared.  The classes of an anchor go to one collection.  Its suffix order
is built column by column: each round inserts the next symbol of every piece, from the
right, into the Burrows-Wheeler transform of the collection, together with the lengths of
common prefixes; transform and prefixes are a sequential file that a round reads once, to
write the next.  Runs of common prefixes of ``SPAN`` or more are the equal strings,
and the earliest of each run owns it.  Anchors with very many classes are dealt over
several collections; the owners of these are then compared by 128-bit hashes of their strings.
A class that is alone with its anchor has nothing to be compared with.

Defined results: null and empty texts have no bytes; texts of under ``SPAN`` bytes lose
nothing; a table with repeated or missing ids is ordered by id (missing last), then by
a hash of the text, and each of its rows counts as a document; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import os
import tempfile

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bloom import bloom, passes
from .common import durable, one_thread, partitions, settle, text_bytes
from .words import mix

SPAN, GRAM = 100, 64
WINDOW = SPAN - GRAM + 1
#: Bytes worked on at once, which a core's cache should hold; pieces of a collection; collections of a task, one after the other, where
#: there is work for all; classes of an anchor from which it is dealt over collections.
BLOCK, COLLECTION, TASK, CROWD = 1 << 16, 2048, 8, 4096
HALF = 32
#: More than the bytes of any text.
PLACES = 10**11
_RNG = np.random.default_rng(77)
_TABLE = _RNG.integers(0, 2**32, 256, dtype=np.uint32)
_FACTORS = _RNG.integers(0, 2**31, 8, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
PIECES = "h1 long, h2 long, doc long, start long, starts int"
OWNED = "h1 long, h2 long, lo long, hi long, crowded boolean, content binary, doc long, start long"


def _grams(raw: np.ndarray) -> np.ndarray:
    """A 32-bit hash of each gram, by doubling."""
    h, size = _TABLE[raw], 1
    for f in _FACTORS:
        if size == GRAM:
            break
        g = h[:-size] * f
        g += h[size:]
        h, size = g, size * 2
    return h


def _words(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the grams at the given places, from eight bytes at a time."""
    eight = np.ndarray(len(raw) - 7, "<u8", raw.data, strides=(1,))
    h = np.zeros(len(at), np.uint64)
    for i in range(0, GRAM, 8):
        h = (h ^ eight[at + np.uint32(i)]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def _least(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each string start: the place of its gram of least hash (the leftmost); and all these hashes.

    Hash and place are one number, so a window's least gram is a minimum.
    """
    h = _grams(raw)
    h *= _FACTORS[7]
    h ^= h >> np.uint32(15)
    low = h.astype(np.uint64)
    low <<= np.uint64(32)
    low |= np.arange(len(h), dtype=np.uint64)
    reach = 1
    while reach * 2 <= WINDOW:
        low = np.minimum(low[reach:], low[:-reach])
        reach *= 2
    rest = WINDOW - reach
    if rest:
        low = np.minimum(low[rest:], low[:-rest])
    return (low & np.uint64(0xFFFFFFFF)).astype(np.uint32), h


def pieces(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last string start of each piece, and its anchor's hash; places are in ``raw``."""
    if len(raw) < SPAN:
        none = np.zeros(0, np.int64)
        return none, none, none.astype(np.uint64)
    at, h = _least(raw)
    n = len(at)
    ok = np.zeros(n, bool)
    edge = np.zeros(n + 1, np.int8)
    begin, end = offsets[:-1], offsets[1:] - SPAN + 1
    long = end > begin
    np.add.at(edge, begin[long], 1)
    np.add.at(edge, end[long], -1)
    ok = np.cumsum(edge[:-1], dtype=np.int8) > 0
    new = ok.copy()
    new[1:] &= ~(ok[:-1] & (at[1:] == at[:-1]))
    new[begin[long]] = True
    last = ok.copy()
    last[:-1] &= ~ok[1:] | new[1:]
    first = np.flatnonzero(new)
    spot = at[first]
    return first, np.flatnonzero(last), mix(_words(raw, spot) ^ h[spot])


def _blocks(batch):
    """(doc ids, place of the block in its document, bytes, offsets): runs of whole texts, or parts of a long one that
    overlap by SPAN - 1 bytes, so that each string starts in one part."""
    raw, off = text_bytes(batch.column("text"))
    docs = batch.column("doc").to_numpy(zero_copy_only=False)
    i, n = 0, len(docs)
    while i < n:
        if off[i + 1] - off[i] > BLOCK:
            for a in range(int(off[i]), int(off[i + 1]), BLOCK):
                part = raw[a : min(a + BLOCK + SPAN - 1, int(off[i + 1]))]
                yield docs[i : i + 1], a - int(off[i]), part, np.array([0, len(part)])
            i += 1
        else:
            j = min(max(int(np.searchsorted(off, off[i] + BLOCK, side="right")) - 1, i + 1), n)
            yield docs[i:j], 0, raw[off[i] : off[j]], off[i : j + 1] - off[i]
            i = j


def _gathered(parts, names: list[str], rows: int = 1 << 17):
    """Record batches of about ``rows`` rows from small column tuples."""
    import pyarrow as pa

    held, n = [], 0

    def out():
        cols = [pa.array(np.concatenate(c)) if isinstance(c[0], np.ndarray) else pa.chunked_array(c).combine_chunks() for c in zip(*held, strict=True)]
        return pa.RecordBatch.from_arrays(cols, names=names)

    for p in parts:
        held.append(p)
        n += len(p[0])
        if n >= rows:
            yield out()
            held, n = [], 0
    if held:
        yield out()


def _anchors(batches):
    one_thread()
    found = ((pieces(raw, off)[2].view(np.int64),) for batch in batches for _, _, raw, off in _blocks(batch))
    yield from _gathered(found, ["anchor"])


def _key(h2, doc, start):
    """Tells a class at a place from any other, as numpy and Spark both compute it."""
    return h2 ^ (doc << 21) ^ (start << 5)


def _walk(batch, flt, places: bool):
    """Pieces of a batch that the filter lets through: bytes, anchors, hashes, documents, starts and ends in the bytes."""
    import xxhash

    for docs, moved, raw, off in _blocks(batch):
        first, last, h = pieces(raw, off)
        keep = passes(flt, h)
        first, last, h = first[keep], last[keep], h[keep]
        if not len(first):
            continue
        whole = raw.tobytes()
        ends = last + SPAN
        h2 = np.array([xxhash.xxh3_64_intdigest(whole[a:b]) for a, b in zip(first.tolist(), ends.tolist(), strict=True)], np.uint64).view(np.int64)
        owner = np.searchsorted(off, first, side="right") - 1
        doc, start = docs[owner], first - off[owner] + moved
        if places:
            keep = passes(flt, _key(h2, doc, start).view(np.uint64))
            first, ends, h, h2, doc, start = first[keep], ends[keep], h[keep], h2[keep], doc[keep], start[keep]
        yield whole, h.view(np.int64), h2, doc, start, first, ends


def _emit(sent):
    def run(batches):
        one_thread()
        found = ((h, h2, doc, start, (end - first - SPAN + 1).astype(np.int32)) for batch in batches for _, h, h2, doc, start, first, end in _walk(batch, sent.value, False))
        yield from _gathered(found, ["h1", "h2", "doc", "start", "starts"])

    return run


def _contents(sent):
    """Bytes of the classes that are compared, each from its earliest place."""

    def run(batches):
        import pyarrow as pa

        one_thread()
        cut = lambda whole, first, end: pa.array([whole[a:b] for a, b in zip(first.tolist(), end.tolist(), strict=True)], pa.binary())
        found = ((h, h2, doc, start, cut(whole, first, end)) for batch in batches for whole, h, h2, doc, start, first, end in _walk(batch, sent.value, True))
        yield from _gathered(found, ["h1", "h2", "doc", "start", "content"], 1 << 15)

    return run


class Column:
    """A column that a round reads from one file and writes to another, each once and in order."""

    def __init__(self, folder: str) -> None:
        self.files, self.size = [os.open(os.path.join(folder, f"column.{i}"), os.O_RDWR | os.O_CREAT | os.O_TRUNC) for i in range(2)], 0

    def write(self, column: np.ndarray) -> None:
        self.files.reverse()
        self.size, done, raw = column.nbytes, 0, memoryview(column).cast("B")
        while done < self.size:
            done += os.pwrite(self.files[0], raw[done:], done)

    def read(self) -> np.ndarray:
        parts, done = [], 0
        while done < self.size:
            parts.append(os.pread(self.files[0], self.size - done, done))
            done += len(parts[-1])
        return np.frombuffer(b"".join(parts), np.uint16)

    def close(self) -> None:
        for f in self.files:
            os.close(f)


def suffix_order(texts: list[bytes], folder: str | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, suffix length, common prefix with the suffix before) of all suffixes of ``texts`` in order.

    Texts have under 256 bytes and no byte 0xFF.  Round j inserts the suffixes of length
    j: the one of a text whose last suffix has symbol c before it stands, within the
    suffixes that start with c, where that symbol stands among the c of the transform.
    """
    with tempfile.TemporaryDirectory(dir=folder) as own:
        k, end = len(texts), np.uint8(0xFF)
        size = np.array([len(t) for t in texts])
        # an end mark stands before each text, where its full suffix finds it
        data = np.frombuffer(b"".join(b"\xff" + t for t in texts), np.uint8)
        stop = np.cumsum(size + 1)
        column = Column(own)  # transform in the low byte, common prefix in the high one
        first = data[stop - 1]
        column.write(first.astype(np.uint16))
        counts = np.bincount(first, minlength=256)
        # the suffixes of the last round: their places, in order, and whose they are
        place, owner = np.arange(k), np.arange(k, dtype=np.int32)
        for j in range(1, int(size.max(initial=0)) + 1):
            have = column.read()
            bwt, lcp = have.astype(np.uint8), (have >> 8).astype(np.uint8)
            order = np.argsort(bwt, kind="stable")  # by symbol, then place: entry t is where suffix k + t will stand
            live = len(bwt) - int(counts[end])
            goes = bwt[place] != end
            place, owner = place[goes], owner[goes]
            mark = np.zeros(len(bwt), bool)
            mark[place] = True
            whose = np.empty(len(bwt), np.int32)
            whose[place] = owner
            fresh = mark[order[:live]]
            rank = np.flatnonzero(fresh)
            owner = whose[order[rank]]
            # common prefixes change at new suffixes and at those that follow one, but for the first of a symbol
            fresh[1:] |= mark[order[: live - 1]]
            starts = np.cumsum(counts) - counts
            fresh[starts[starts < live]] = False
            touched = np.flatnonzero(fresh)[::-1]  # backwards, so that reduceat skips most of what lies between ranges
            ranges = np.empty(2 * len(touched), np.int64)
            ranges[::2], ranges[1::2] = order[touched - 1], order[touched]
            ranges += 1
            low = np.minimum.reduceat(np.append(lcp, np.uint8(0)), ranges)[::2] if len(ranges) else np.zeros(0, np.uint8)
            before = data[stop[owner] - 1 - j]
            counts = counts + np.bincount(before, minlength=256)
            place = k + rank
            old = np.ones(k + live, bool)
            old[place] = False
            counts[end] = np.count_nonzero(before == end) + (len(bwt) - live)
            grown = np.empty(k + live, np.uint16)
            grown[old], grown[place] = have, before
            spot = k + touched
            grown[spot] = (grown[spot] & 0xFF) | ((low.astype(np.uint16) + 1) << 8)
            column.write(grown)
        have = column.read()
        column.close()
        bwt, lcp = have.astype(np.uint8), (have >> 8).astype(np.uint8)
        # whose suffix stands where: from the empty suffixes on, the transform leads from each to the one longer by a symbol
        forth = np.empty(len(bwt), np.int64)
        forth[np.argsort(bwt, kind="stable")] = np.arange(k, k + len(bwt))
        who, length = np.empty(len(bwt), np.int32), np.empty(len(bwt), np.uint8)
        place, owner, j = np.arange(k), np.arange(k), 0
        while len(place):
            who[place], length[place] = owner, j
            goes = bwt[place] != end
            place, owner, j = forth[place[goes]], owner[goes], j + 1
        return who, length, lcp


def owned(texts: list[bytes], doc: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Whether each string (text, offset) is the earliest of its equals; (texts, WINDOW), for texts at (doc, start)."""
    who, length, lcp = suffix_order(texts)
    run = np.cumsum(lcp < SPAN)
    full = length >= SPAN
    who, run = who[full], run[full]
    at = np.array([len(t) for t in texts])[who] - length[full]
    order = np.lexsort((start[who] + at, doc[who], run))
    first = np.ones(len(order), bool)
    first[1:] = run[order][1:] != run[order][:-1]
    out = np.zeros((len(texts), WINDOW), bool)
    out[who[order][first], at[order][first]] = True
    return out


_LO, _HI = 1 << np.arange(HALF, dtype=np.int64), 1 << np.arange(WINDOW - HALF, dtype=np.int64)


def _collections(batches):
    import pyarrow as pa

    one_thread()
    rows = [b for b in batches if b.num_rows]
    if not rows:
        return
    t = pa.Table.from_batches(rows).sort_by([("h1", "ascending"), ("salt", "ascending"), ("h2", "ascending")])
    anchor, salt = (t.column(c).to_numpy() for c in ("h1", "salt"))
    breaks = np.concatenate([[0], np.flatnonzero((anchor[1:] != anchor[:-1]) | (salt[1:] != salt[:-1])) + 1, [len(anchor)]])
    a = 0
    while a < len(anchor):
        b = int(breaks[max(np.searchsorted(breaks, a + COLLECTION, side="right") - 1, np.searchsorted(breaks, a, side="right"))])
        part = t.slice(a, b - a)
        content, doc, start = part.column("content").to_pylist(), part.column("doc").to_numpy(), part.column("start").to_numpy()
        mine = owned(content, doc, start)
        crowded = part.column("salts").to_numpy() > 1
        held = pa.array([c if x else None for c, x in zip(content, crowded, strict=True)], pa.binary())
        arrays = [part.column("h1").combine_chunks(), part.column("h2").combine_chunks(), pa.array(mine[:, :HALF] @ _LO), pa.array(mine[:, HALF:] @ _HI), pa.array(crowded), held, pa.array(doc), pa.array(start)]
        yield pa.RecordBatch.from_arrays(arrays, names=["h1", "h2", "lo", "hi", "crowded", "content", "doc", "start"])
        a = b


def _dealt(total: int, least: int) -> int:
    """Partitions for ``total`` pieces: ``least`` at least, unless that leaves them under a collection each.

    A partition is a task and a file; on a local store each file also costs several processes that set its permissions.
    """
    ceil = lambda n: max(1, -(-total // n))
    return min(ceil(COLLECTION), max(least, ceil(TASK * COLLECTION)))


def _strings(batches):
    """The strings that crowded classes own, by 128-bit hash."""
    import pyarrow as pa
    import xxhash

    for b in batches:
        rows = []
        for h1, h2, lo, hi, c, doc, start in zip(*(b.column(n).to_pylist() for n in ("h1", "h2", "lo", "hi", "content", "doc", "start")), strict=True):
            bits = lo | hi << HALF
            while bits:
                o = (bits & -bits).bit_length() - 1
                bits &= bits - 1
                d = xxhash.xxh3_128_digest(c[o : o + SPAN])
                rows.append((int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True), h1, h2, o, doc, start + o))
        names = ["s1", "s2", "h1", "h2", "o", "doc", "at"]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int32() if n == "o" else pa.int64()) for i, n in enumerate(names)], names=names)


def _cut(keep: bool):
    """Lengths, removals and the rest of each text; the rest itself only if it is asked for."""

    def run(batches):
        import pyarrow as pa

        one_thread()
        for batch in batches:
            out = []
            for text, found in zip(batch.column("text"), batch.column("gone"), strict=True):
                buf = text.as_buffer() if text.is_valid else None
                raw = np.frombuffer(buf, np.uint8) if buf is not None and buf.size else np.zeros(0, np.uint8)
                if not found.is_valid or not len(raw):
                    out.append((len(raw), 0, 0, hashlib.sha256(raw).hexdigest(), raw.tobytes() if keep else None))
                    continue
                v = found.values
                start, starts, lo, hi = (v.field(i).to_numpy(zero_copy_only=False) for i in range(4))
                bits = np.concatenate([(lo[:, None] & _LO) != 0, (hi[:, None] & _HI) != 0], axis=1)
                bits &= np.arange(WINDOW) < starts[:, None]
                piece, o = np.nonzero(bits)
                at = start[piece] + o
                edge = np.bincount(at, minlength=len(raw) + 1) - np.bincount(at + SPAN, minlength=len(raw) + 1)
                gone = np.cumsum(edge[:-1]) > 0
                spans = int(gone[0]) + int(np.count_nonzero(gone[1:] & ~gone[:-1]))
                rest = raw[~gone].tobytes()
                out.append((len(raw), int(np.count_nonzero(gone)), spans, hashlib.sha256(rest).hexdigest(), rest if keep else None))
            cols = list(zip(*out, strict=True)) or [[]] * 5
            arrays = [batch.column("doc_id"), *(pa.array(cols[i], pa.int64()) for i in range(3)), pa.array(cols[3], pa.string()), pa.array(cols[4], pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return run


def _numbered(docs: DataFrame) -> DataFrame:
    """doc_id, doc, text: ``doc`` orders the rows and is unique.  It is the id, unless ids repeat or are missing."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    ids = d.select("doc_id").groupBy("doc_id").count()
    if ids.where("doc_id IS NULL OR count > 1").limit(1).count() == 0:
        return d.withColumn("doc", F.col("doc_id"))
    return durable(d.orderBy(F.col("doc_id").asc_nulls_last(), F.md5("text")).withColumn("doc", F.monotonically_increasing_id()), "suffix-numbered")


def repeated_strings(docs: DataFrame) -> DataFrame:
    """(doc, start, starts, lo, hi): pieces with strings that also start earlier; bit o of lo, then hi, is the string at start + o.

    ``docs`` has doc (unique, in order) and text.
    """
    spark = docs.sparkSession
    texts = docs.select("doc", "text")
    anchors = texts.mapInArrow(_anchors, "anchor long").groupBy("anchor").count().where("count > 1")
    # filters of a fixed size, whatever the input
    sent = spark.sparkContext.broadcast(bloom(anchors, F.col("anchor")))
    settle(spark)
    rows = durable(texts.mapInArrow(_emit(sent), PIECES), "suffix-pieces")
    # a place is one number, so that the aggregation is by hash
    place = F.col("doc").cast("decimal(20,0)") * F.lit(PLACES) + F.col("start").cast("decimal(11,0)")
    classes = rows.select("h1", "h2", place.cast("decimal(38,0)").alias("place")).groupBy("h1", "h2").agg(F.min("place").alias("place"), F.count(F.lit(1)).alias("n"))
    classes = durable(classes.select("h1", "h2", "n", F.expr(f"CAST(floor(place / {PLACES}BD) AS BIGINT)").alias("doc"), F.expr(f"CAST(pmod(place, {PLACES}BD) AS BIGINT)").alias("start")), "suffix-classes")
    met = durable(classes.groupBy("h1").agg(F.count(F.lit(1)).alias("met")).where("met > 1"), "suffix-met")
    settle(spark)
    total = met.agg(F.sum("met")).first()[0] or 0
    salts = F.ceil(F.col("met") / CROWD).cast("int")
    compared = classes.drop("n").join(met.hint("shuffle_hash"), "h1").withColumn("salts", salts).withColumn("salt", F.pmod("h2", F.col("salts")).cast("int")).drop("met")
    compared = durable(compared, "suffix-compared")
    key = F.col("h2").bitwiseXOR(F.shiftleft("doc", 21)).bitwiseXOR(F.shiftleft("start", 5))
    wanted = compared.select("h1").distinct().unionByName(compared.select(key.alias("h1")))
    chosen = spark.sparkContext.broadcast(bloom(wanted, F.col("h1")))
    content = texts.mapInArrow(_contents(chosen), "h1 long, h2 long, doc long, start long, content binary")
    content = content.join(compared.hint("shuffle_hash"), ["h1", "h2", "doc", "start"])
    own = durable(content.repartition(_dealt(total, partitions(spark)), "h1", "salt").mapInArrow(_collections, OWNED), "suffix-owned")
    settle(spark)
    bits = own.select("h1", "h2", "lo", "hi")
    if own.where("crowded").limit(1).count():
        strings = durable(own.where("crowded").mapInArrow(_strings, "s1 long, s2 long, h1 long, h2 long, o int, doc long, at long"), "suffix-strings")
        best = strings.groupBy("s1", "s2").agg(F.min(F.struct("doc", "at")).alias("best"), F.count(F.lit(1)).alias("c")).where("c > 1")
        lost = strings.join(best, ["s1", "s2"]).where(F.struct("doc", "at") != F.col("best"))
        one = lambda low, shift: F.expr(f"CASE WHEN {low} THEN shiftleft(1L, o - {shift}) ELSE 0L END")
        lost = lost.select("h1", "h2", one(f"o < {HALF}", 0).alias("l"), one(f"o >= {HALF}", HALF).alias("h")).groupBy("h1", "h2").agg(F.bit_or("l").alias("l"), F.bit_or("h").alias("h"))
        keep = lambda x, y: F.col(x).bitwiseAND(F.bitwise_not(F.coalesce(y, F.lit(0).cast("long"))))
        bits = bits.join(lost, ["h1", "h2"], "left").select("h1", "h2", keep("lo", "l").alias("lo"), keep("hi", "h").alias("hi"))
    every = (F.lit((1 << HALF) - 1), F.lit((1 << (WINDOW - HALF)) - 1))
    known = classes.select("h1", "h2", "n", F.col("doc").alias("fd"), F.col("start").alias("fs")).join(bits, ["h1", "h2"], "left")
    known = durable(known.select("h1", "h2", "fd", "fs", F.coalesce("lo", every[0]).alias("lo"), F.coalesce("hi", every[1]).alias("hi"), "n").where((F.col("n") > 1) | (F.col("lo") != every[0]) | (F.col("hi") != every[1])).drop("n"), "suffix-known")
    mine = (F.col("doc") == F.col("fd")) & (F.col("start") == F.col("fs"))
    flip = lambda c, e: F.when(mine, F.col(c).bitwiseXOR(e)).otherwise(e)
    places = rows.select("h1", "h2", "doc", "start", "starts").join(known.hint("shuffle_hash"), ["h1", "h2"])
    return places.select("doc", "start", "starts", flip("lo", every[0]).alias("lo"), flip("hi", every[1]).alias("hi")).where("lo <> 0 OR hi <> 0")


def remove_repeats(docs: DataFrame, keep: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (the remaining bytes, if ``keep``) of every row of ``docs`` (doc_id, text)."""
    rows = _numbered(docs)
    gone = repeated_strings(rows).groupBy(F.col("doc").alias("__doc")).agg(F.collect_list(F.struct("start", "starts", "lo", "hi")).alias("gone"))
    gone = durable(gone, "suffix-gone")
    settle(docs.sparkSession)
    joined = rows.join(gone.hint("shuffle_hash"), rows["doc"] == gone["__doc"], "left").select("doc_id", "text", "gone")
    return joined.mapInArrow(_cut(keep), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
