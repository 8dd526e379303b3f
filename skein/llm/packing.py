"""Best-fit packing of tokenized documents into sequences, by hierarchical residual packing.

Each task packs the pieces it has tokenized by best fit, largest first.  Bins that are
nearly full are final.  Underfull bins become items of the next round: they meet in
groups, a tree over the partitions, and best fit runs again.  A round that hardly
shrinks what is open makes the bins of over half the capacity final (no two of them
fit together) and goes on with the small ones, of which each group leaves one at most;
so the rounds end, and no task has more than a group's bins.

Defined results: a null text is empty and has the end token alone; repeated rows are
packed each; ties in length go by doc_id and piece; an empty table gives no rows; a text of
any length is tokenized whole; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, split_batches

CAPACITY, END = 2048, 0
#: Bins that a task of a later round gets, about; the fill from which a bin is final.
GROUP, NEARLY_FULL = 50_000, 0.99
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = PIECES + ", sequence_id long, offset long, used long"


class Encoder:
    """Token ids of texts by the public byte-level vocabulary.

    ``json_path`` is read by tokenizers.  ``ranks_path`` is the same vocabulary as
    ranks, which gives the same ids three times as fast; texts that hold one of the
    vocabulary's added tokens are left to tokenizers.
    """

    def __init__(self, json_path: str | None = None, ranks_path: str | None = None) -> None:
        import base64
        import json

        import public_tokenizers
        import tiktoken

        self.json_path = json_path or public_tokenizers.path("byte_bpe_50k.json")
        ranks_path = ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken")
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("public", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        with open(self.json_path, encoding="utf-8") as f:
            self.added = [t["content"] for t in json.load(f)["added_tokens"]]
        self.slow = None

    def __call__(self, text: str) -> list[int]:
        if any(a in text for a in self.added):
            if self.slow is None:
                from tokenizers import Tokenizer

                self.slow = Tokenizer.from_file(self.json_path)
            return self.slow.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


def cut(ids: list[int], capacity: int = CAPACITY) -> list[tuple[int, int, int]]:
    """(start, length, crc32) of each piece of a document's ids with the end token; the first may be the shorter one."""
    a = np.array([*ids, END], dtype="<u4")
    first = len(a) % capacity or capacity
    edges = [0, *range(first, len(a) + 1, capacity)]
    return [(s, e - s, zlib.crc32(a[s:e].tobytes())) for s, e in zip(edges, edges[1:], strict=False)]


def best_fit(sizes: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and place in it of each item, and each bin's fill, by best fit in decreasing order.

    Open bins hang on their free space; an integer's bits say which spaces have bins,
    so the tightest fit is its lowest bit from the item's size on.
    """
    order = np.argsort(-sizes, kind="stable")
    bins, places, fill = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64), []
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    have = 0
    for i, size in zip(order.tolist(), sizes[order].tolist(), strict=True):
        fits = have >> size
        if fits:
            space = size + (fits & -fits).bit_length() - 1
            b = free[space].pop()
            if not free[space]:
                have &= ~(1 << space)
        else:
            space, b = capacity, len(fill)
            fill.append(0)
        bins[i], places[i] = b, fill[b]
        fill[b] += size
        left = space - size
        if left:
            free[left].append(b)
            have |= 1 << left
    return bins, places, np.array(fill, np.int64)


def _tokenize_and_pack(json_path, ranks_path, capacity):
    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        encode, rows = Encoder(json_path, ranks_path), []
        at, round_ = TaskContext.get().partitionId(), 0

        def packed():
            nonlocal rows, round_
            docs, cols = [r[0] for r in rows], np.array([r[1:] for r in rows], np.int64).reshape(-1, 4)
            rows = []
            bins, places, fill = best_fit(cols[:, 2], capacity)
            ids = (np.int64(at) << 36) + (np.int64(round_) << 24) + bins
            round_ += 1
            arrays = [pa.array(docs, pa.int64()), pa.array(cols[:, 0].astype(np.int32)), *map(pa.array, (cols[:, 1], cols[:, 2], cols[:, 3], ids, places, fill[bins]))]
            return pa.RecordBatch.from_arrays(arrays, names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "used"])

        for whole in batches:
            for batch in split_batches(whole):
                for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                    rows += [(doc, i, *p) for i, p in enumerate(cut(encode(text or ""), capacity))]
                if len(rows) >= 4 * GROUP:
                    yield packed()
        if rows:
            yield packed()

    return run


def _repack(round_: int, capacity: int):
    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["used", "sequence_id", "offset"], ascending=[False, True, True], kind="stable", ignore_index=True)
        old, first, member = np.unique(pdf["sequence_id"].to_numpy(), return_index=True, return_inverse=True)
        bins, places, fill = best_fit(pdf["used"].to_numpy()[first], capacity)
        pdf["offset"] = pdf["offset"].to_numpy() + places[member]
        pdf["sequence_id"] = (np.int64(round_) << 56) + (np.int64(key[0]) << 26) + bins[member]
        pdf["used"] = fill[bins[member]]
        return pdf

    return run


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, json_path: str | None = None, ranks_path: str | None = None) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    now = durable(texts.mapInArrow(_tokenize_and_pack(json_path, ranks_path, capacity), PACKED), "pack-0")
    full, done, round_ = int(capacity * NEARLY_FULL), [], 0
    done.append(now.where(F.col("used") >= full))
    open_ = now.where(F.col("used") < full)
    bins = open_.where("offset = 0").count()
    while bins:
        round_ += 1
        groups = -(-bins // GROUP)
        dealt = open_.groupBy(F.pmod(F.xxhash64("sequence_id"), F.lit(groups)).alias("__group"))
        now = durable(dealt.applyInPandas(_repack(round_, capacity), PACKED), f"pack-{round_}")
        if groups == 1:
            done.append(now)
            break
        left = now.where((F.col("used") < full) & (F.col("offset") == 0)).count()
        limit = full if left <= 0.8 * bins else capacity // 2 + 1
        done.append(now.where(F.col("used") >= limit))
        open_ = now.where(F.col("used") < limit)
        bins = left if limit == full else open_.where("offset = 0").count()
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
