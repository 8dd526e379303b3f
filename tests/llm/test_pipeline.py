"""The pipeline's stages, each against its own input."""

import re
from collections import Counter

import corpus_pipeline
from skein.llm import mixing
from skein.llm.common import durable, read
from skein.llm.secrets import ASSIGN

from .test_exact import components

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = read(spark, SF, "documents")
    assert len(corpus_pipeline.STAGES) == 5
    for name, stage in corpus_pipeline.STAGES:
        out = durable(stage(spark, docs, SF), f"test-{name}")
        before, after = ({r["doc_id"]: r["text"] for r in df.collect()} for df in (docs, out)) if name != "best_fit_packing" else (None, None)
        if name == "language_id":
            assert all(re.search(r"[^\W\d_]", t) for t in after.values())
            assert len(after) >= 0.99 * sum(bool(re.search(r"[^\W\d_]", t or "")) for t in before.values())
        if name == "ngram_jaccard":
            want = {i for i, (_, c) in components(sorted(before.items()), 5, 80, 100).items() if i == c}
            assert set(after) == want
        if name == "secret_scan":
            leak = lambda t: any(len(m[2]) >= 6 for m in re.finditer(ASSIGN, t)) or re.search(r"AKIA[A-Z0-9]{16,}|[0-9a-f]{24,}", t)
            assert set(after) == {i for i, t in before.items() if not leak(t or "")}
        if name == "mix_sources":
            plan = {r["doc_id"]: r for r in mixing.mix_to_weights(docs, read(spark, SF, "labels")).collect()}
            taken = Counter(r["doc_id"] for r in out.select("doc_id").collect())
            assert taken == Counter({i: r["copies"] for i, r in plan.items() if r["copies"]})
            for s in {r["source"] for r in plan.values()}:
                mine = [r for r in plan.values() if r["source"] == s]
                assert abs(sum(r["size"] * taken[r["doc_id"]] for r in mine) - mine[0]["target"]) <= max(r["size"] for r in mine)
        if name == "best_fit_packing":
            p = out.toPandas()
            assert p["piece"].eq(0).sum() == docs.count() and p.groupby("sequence_id")["length"].sum().max() <= 2048
        else:
            assert out.columns == docs.columns
        docs = out
    rows = lambda df: sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in df.select("doc_id", "piece", "start", "length", "ids_crc32").collect())
    assert rows(corpus_pipeline.run(spark, SF)) == rows(docs)


def test_stages_take_odd_tables(spark, odd, none, again):
    """Nulls, empty and very long texts, ties, repeats, and columns with the operators' own names."""
    for df in (odd, none, again):
        for name, stage in corpus_pipeline.STAGES[1:4]:
            out = stage(spark, df, SF)
            assert out.columns == df.columns and out.count() <= 3 * df.count(), name
    kept = {r["doc_id"] for r in corpus_pipeline.drop_secrets(spark, odd, SF).collect()}
    assert 11 not in kept and {1, 3, 4, 5} <= kept
    copies = [r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, again, SF).collect()]
    assert len(copies) == len(set(copies)) + (copies.count(None) - 1 if None in copies else 0) and {1, 2} & set(copies) == {1}
