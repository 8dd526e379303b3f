"""The thin queries over each operator and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import jaccard, langid, merkle, mixing, packing, quality, secrets, suffix_dedup, topk, toxicity
from .common import read


def op1_mix_sources(spark, sf_dir):
    return mixing.mix_to_weights(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op2_suffix_dedup(spark, sf_dir):
    return suffix_dedup.remove_repeats(read(spark, sf_dir, "documents"), keep=False).drop("kept")


def op3_exact_top_k(spark, sf_dir):
    return topk.top_k(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op4_best_fit_packing(spark, sf_dir):
    return packing.pack_documents(read(spark, sf_dir, "documents"))


def _predicted(scored, of, rest):
    held = langid.held_out(F.col("doc_id"), of, rest)
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op5_quality_neighbours(spark, sf_dir):
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    model = quality.fit(docs, labels, ~langid.held_out(F.col("doc_id"), 5, 0))
    return _predicted(quality.score(docs, model), 5, 0)


def op6_toxicity_nnpu(spark, sf_dir):
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels, ~langid.held_out(F.col("doc_id"), 4, 2))
    return _predicted(toxicity.score(docs, model), 4, 2)


def op7_ngram_jaccard(spark, sf_dir):
    return jaccard.jaccard_components(read(spark, sf_dir, "documents"), words=3, num=90, den=100)


def op8_language_id(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    held = langid.held_out(F.col("doc_id"), 4, 2)
    net = langid.fit(docs, ~held)
    return langid.identify(docs, net).select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op9_secret_scan(spark, sf_dir):
    found, _ = secrets.scan(read(spark, sf_dir, "documents"))
    return secrets.digest(found)


def op10_merkle_fingerprints(spark, sf_dir):
    return merkle.fingerprints(read(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_mix_sources, op2_suffix_dedup, op3_exact_top_k, op4_best_fit_packing, op5_quality_neighbours, op6_toxicity_nnpu, op7_ngram_jaccard, op8_language_id, op9_secret_scan, op10_merkle_fingerprints)}
ORACLE_SQL = {"op1_mix_sources": mixing.ORACLE, "op3_exact_top_k": topk.ORACLE, "op9_secret_scan": secrets.ORACLE}
