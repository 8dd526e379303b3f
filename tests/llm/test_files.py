"""How much operators write at once: files and tasks follow the rows, not the input's partitions."""

from pyspark.sql import functions as F

from skein.llm import mixing, suffix_dedup
from skein.plans import durable


def written(spark, kind, before):
    """Files of the tables of one kind that were written since ``before``."""
    tables = [p for p in durable._KEPT.get(spark.sparkContext.applicationId, ())[before:] if f"/{kind}-" in p]
    assert tables
    return sum(len(spark.read.parquet(p).inputFiles()) for p in tables)


def test_words_are_counted_as_matches(spark):
    odd = [None, "", " ", "X", "XX X\tX", " a b \x0b\x0cc\r\nd ", "　", "\x00 \x1c \x85", "é" * 3 + " 漢字 😀", "\n\n", "a" * 70000 + " b"]
    t = spark.createDataFrame([(x,) for x in odd], "text string")
    want = F.coalesce(F.regexp_count("text", F.lit(mixing.WORD)), F.lit(0)).cast("long")
    assert t.where(mixing.word_count(F.col("text")) != want).count() == 0
    assert [r[0] for r in t.select(mixing.word_count(F.col("text"))).collect()] == [0, 0, 0, 1, 3, 3, 1, 3, 3, 0, 2]


def test_keys_of_the_mix_are_few_files(spark):
    docs = spark.range(400).repartition(40).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("a"), F.col("id")).alias("text"), (F.col("id") % 3).cast("string").alias("source"))
    before = durable.mark(spark)
    got = mixing.apply_mix(docs).groupBy("doc_id").count()
    assert written(spark, "mix-keys", before) <= 4
    want = mixing.mix_to_weights(docs).where("copies > 0").select("doc_id", "copies")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_a_task_takes_several_collections():
    n = suffix_dedup.COLLECTION
    assert suffix_dedup._dealt(0, 12) == suffix_dedup._dealt(n, 12) == 1
    assert suffix_dedup._dealt(5 * n, 12) == 5 and suffix_dedup._dealt(50 * n, 12) == 12
    assert suffix_dedup._dealt(1000 * n, 12) == 1000 // suffix_dedup.TASK


def test_removal_is_the_same_however_pieces_are_dealt(spark, monkeypatch):
    shared = [bytes((i * 37 + k * (k + i) * 11) % 94 + 33 for k in range(400)).decode() for i in range(12)]
    rows = [(i, shared[i % 12][i % 50 : 300 + i] + f"{i:05d}" * 10 + shared[(i * 5 + 1) % 12]) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {tuple(r) for r in suffix_dedup.remove_repeats(docs, keep=False).collect()}
    monkeypatch.setattr(suffix_dedup, "COLLECTION", 8)
    monkeypatch.setattr(suffix_dedup, "TASK", 1)
    assert {tuple(r) for r in suffix_dedup.remove_repeats(docs, keep=False).collect()} == got
    monkeypatch.setattr(suffix_dedup, "TASK", 50)
    assert {tuple(r) for r in suffix_dedup.remove_repeats(docs, keep=False).collect()} == got
    assert sum(r[2] for r in got) > 0
