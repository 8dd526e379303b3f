"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document gets an exponential key ``-ln(u) / w`` (``u`` a hash of its id and
text, ``w`` its quality weight).  Within a source documents are taken in the order
of their keys until the source's word target is met; whole epochs come before the
fractional selection.

Instead of sorting a source as a whole, which would put a hot source into one task,
keys fall into a fixed number of buckets.  Sums by (source, bucket) tell in which
bucket a source's remainder ends; only that bucket is sorted, which gives one cutoff
key a source.  All documents are then decided map-side against a table with a row a
source.

Defined results: null or empty texts have size 0 and take 0 words; a null source is a
source of its own, last in order; rows that repeat the same id and text have one key
and are taken or left together; an empty table gives no rows; words are counted over texts of any
length; ``apply_mix`` keeps all columns (names that start with __ are an error there).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, refuse, small_enough

#: A word: a run of bytes other than space and the five ASCII line and tab controls.
WORD = r"[^\x20\x09-\x0D]+"
#: Sampling weights by quality label: 1, 0, none.
QUALITY_WEIGHTS = (4.0, 1.0, 2.0)
BUCKETS = 4096
#: Tables of at most so many rows are broadcast; larger ones are joined by a shuffle.
BROADCAST_SOURCES, BROADCAST_LABELS, SALTS = 100_000, 1_000_000, 64


def word_count(text: Column) -> Column:
    """Each word becomes one X, so the X are its number; a count by matches would hold every word of a text as an object."""
    marks = F.regexp_replace(text, F.lit(WORD), F.lit("X"))
    return F.coalesce(F.length(marks) - F.length(F.replace(marks, F.lit("X"))), F.lit(0)).cast("long")


def _uniform(doc_id: Column, text: Column, seed: str) -> Column:
    """52 bits of a SHA-256 as a number strictly between 0 and 1."""
    said = F.concat_ws(":", F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit(""))))
    bits = F.conv(F.substring(F.sha2(said, 256), 1, 13), 16, 10).cast("long")
    return (bits + F.lit(0.5)) / F.lit(float(2**52))


def with_quality(docs: DataFrame, labels: DataFrame | None) -> DataFrame:
    """``docs`` with ``__w``: the weight of its quality label.  A document labelled twice has the higher label."""
    if labels is None:
        return docs.withColumn("__w", F.lit(QUALITY_WEIGHTS[2]))
    marks = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").alias("__lid")).agg(F.max("quality").alias("__q"))
    if small_enough(marks, BROADCAST_LABELS):
        marks = F.broadcast(marks)
    w = F.when(F.col("__q") == 1, QUALITY_WEIGHTS[0]).when(F.col("__q") == 0, QUALITY_WEIGHTS[1]).otherwise(QUALITY_WEIGHTS[2])
    return docs.join(marks, docs["doc_id"] == marks["__lid"], "left").withColumn("__w", w).drop("__lid", "__q")


def keyed(docs: DataFrame, labels: DataFrame | None = None, seed: str = "mix-1", buckets: int = BUCKETS) -> DataFrame:
    """``docs`` with ``__size``, ``__key`` (exponential, scaled by quality) and ``__bucket`` (monotone in the key)."""
    out = with_quality(docs, labels)
    out = out.withColumn("__size", word_count(F.col("text"))).withColumn("__key", -F.log(_uniform(F.col("doc_id"), F.col("text"), seed)) / F.col("__w"))
    return out.withColumn("__bucket", F.least(F.floor((1 - F.exp(-F.col("__key"))) * buckets), F.lit(buckets - 1)).cast("int")).drop("__w")


def targets(sizes: DataFrame, cycle: tuple[int, ...] = (1, 2, 3), cap: float = 3.0) -> DataFrame:
    """Word targets from rows (__source, __source_size): a share of all words by weight, at most ``cap`` sizes each.

    What a capped source can't take is shared again by weight.  That is water filling:
    in the order of cap/weight the capped sources are a prefix, so two running sums
    give the level.
    """
    order = Window.orderBy(F.col("__source").asc_nulls_last())
    pick = F.element_at(F.array(*[F.lit(float(x)) for x in cycle]), ((F.row_number().over(order) - 1) % len(cycle) + 1).cast("int"))
    s = sizes.withColumn("__weight", pick).withColumn("__cap", F.col("__source_size") * F.lit(float(cap)))
    fill = Window.orderBy(F.col("__cap") / F.col("__weight"), F.col("__source").asc_nulls_last())
    upto, every = fill.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy()
    s = (
        s.withColumn("__total", F.sum("__source_size").over(every).cast("double"))
        .withColumn("__cap_before", F.sum("__cap").over(upto) - F.col("__cap"))
        .withColumn("__weight_left", F.sum("__weight").over(every) - F.sum("__weight").over(upto) + F.col("__weight"))
    )
    s = s.withColumn("__capped", (F.col("__total") - F.col("__cap_before")) * F.col("__weight") >= F.col("__cap") * F.col("__weight_left"))
    s = s.withColumn("__spent", F.sum(F.when(F.col("__capped"), F.col("__cap")).otherwise(0.0)).over(every)).withColumn("__sharing", F.sum(F.when(F.col("__capped"), 0.0).otherwise(F.col("__weight"))).over(every))
    level = (F.col("__total") - F.col("__spent")) / F.when(F.col("__sharing") > 0, F.col("__sharing"))
    return s.select("__source", "__source_size", F.when(F.col("__capped"), F.col("__cap")).otherwise(level * F.col("__weight")).alias("__target"))


def plan(sampled: DataFrame, cycle: tuple[int, ...] = (1, 2, 3), cap: float = 3.0) -> DataFrame:
    """One row a source: size, target, whole epochs and the cutoff key of the fractional epoch.

    ``sampled`` has __source, __id, __size, __key and __bucket.
    """
    sums = durable(sampled.groupBy("__source", "__bucket").agg(F.sum("__size").alias("__words")), "mix-sums")
    goal = targets(sums.groupBy("__source").agg(F.sum("__words").alias("__source_size")), cycle, cap)
    goal = goal.withColumn("__epochs", F.when(F.col("__source_size") > 0, F.floor(F.col("__target") / F.col("__source_size"))).otherwise(0).cast("long"))
    goal = durable(goal.withColumn("__rest", F.col("__target") - F.col("__epochs") * F.col("__source_size")), "mix-goal")
    so_far = Window.partitionBy("__source").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, 0)
    ends = sums.withColumn("__upto", F.sum("__words").over(so_far)).join(F.broadcast(goal) if small_enough(goal, BROADCAST_SOURCES) else goal, sums["__source"].eqNullSafe(goal["__source"])).drop(goal["__source"])
    ends = ends.where("__rest > 0 AND __upto > __rest").groupBy("__source", "__rest").agg(F.min_by(F.struct("__bucket", (F.col("__upto") - F.col("__words")).alias("before")), "__bucket").alias("end"))
    ends = ends.select(F.col("__source").alias("__esource"), "__rest", F.col("end.__bucket").alias("__ebucket"), F.col("end.before").alias("__before"))
    if small_enough(goal, BROADCAST_SOURCES):
        ends = F.broadcast(ends)
    last = sampled.join(ends, sampled["__source"].eqNullSafe(ends["__esource"]) & (sampled["__bucket"] == ends["__ebucket"]))
    run = Window.partitionBy("__source").orderBy("__key", "__id", "__size")
    last = last.withColumn("__upto", F.col("__before") + F.sum("__size").over(run))
    last = last.withColumn("__from", F.col("__upto") - F.col("__size"))
    near = (F.col("__upto") <= F.col("__rest")) | ((F.col("__upto") - F.col("__rest")) < (F.col("__rest") - F.col("__from")))
    cut = last.groupBy("__source").agg(F.max(F.when(near, F.struct("__key", "__id", "__size"))).alias("__cut"), F.min("__ebucket").alias("__cut_bucket"))
    both = goal.join(cut, goal["__source"].eqNullSafe(cut["__source"]), "left").drop(cut["__source"])
    return durable(both, "mix-plan")


def decide(sampled: DataFrame, planned: DataFrame) -> DataFrame:
    """``sampled`` with ``copies``, ``__target`` and ``__source_size``.

    The plan has a row a source: it is broadcast when it is proven small.  Otherwise
    the documents of a source are dealt over salts so that no source is one task's.
    """
    p = planned.withColumnRenamed("__source", "__psource")
    match = sampled["__source"].eqNullSafe(p["__psource"])
    if small_enough(planned, BROADCAST_SOURCES):
        joined = sampled.join(F.broadcast(p), match)
    else:
        p = p.withColumn("__psalt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salted = sampled.withColumn("__salt", F.pmod(F.xxhash64("__id", "__key"), F.lit(SALTS)).cast("int"))
        joined = salted.join(p, salted["__source"].eqNullSafe(p["__psource"]) & (salted["__salt"] == p["__psalt"])).drop("__salt", "__psalt")
    here = F.struct("__key", "__id", "__size")
    extra = F.when(F.col("__rest") <= 0, False).when(F.col("__bucket") < F.col("__cut_bucket"), True).when(F.col("__bucket") > F.col("__cut_bucket"), False).otherwise(F.coalesce(here <= F.col("__cut"), F.lit(False)))
    return joined.withColumn("copies", F.col("__epochs") + extra.cast("long")).drop("__psource", "__epochs", "__rest", "__cut", "__cut_bucket")


def mix_to_weights(docs: DataFrame, labels: DataFrame | None = None, cycle: tuple[int, ...] = (1, 2, 3), cap: float = 3.0, seed: str = "mix-1") -> DataFrame:
    """doc_id, source, size, source_size, target, taken (words, repeats counted) and copies of every row of ``docs``."""
    narrow = keyed(docs.select("doc_id", "text", "source"), labels, seed).select(F.col("doc_id").alias("__id"), F.col("source").alias("__source"), "__size", "__key", "__bucket")
    narrow = durable(narrow, "mix-keys")
    out = decide(narrow, plan(narrow, cycle, cap))
    return out.select(F.col("__id").alias("doc_id"), F.col("__source").alias("source"), F.col("__size").alias("size"), F.col("__source_size").cast("long").alias("source_size"), F.col("__target").alias("target"), (F.col("__size") * F.col("copies")).alias("taken"), "copies")


def apply_mix(docs: DataFrame, labels: DataFrame | None = None, cycle: tuple[int, ...] = (1, 2, 3), cap: float = 3.0, seed: str = "mix-1") -> DataFrame:
    """The mixed corpus: every row of ``docs`` as often as the mix takes it, all columns kept; texts aren't shuffled."""
    refuse(docs, "__")
    if "copies" in docs.columns:  # a name of the mix's own, given back at the end
        return apply_mix(docs.withColumnRenamed("copies", "own_copies_of_docs"), labels, cycle, cap, seed).withColumnRenamed("own_copies_of_docs", "copies")
    sampled = keyed(docs, labels, seed).withColumns({"__id": F.col("doc_id"), "__source": F.col("source")})
    # a row a document, of a few bytes: rebalanced into files of the advised size instead of one a task
    narrow = durable(sampled.select("__id", "__source", "__size", "__key", "__bucket").hint("rebalance"), "mix-keys")
    out = decide(sampled, plan(narrow, cycle, cap)).where("copies > 0")
    return out.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*docs.columns)


ORACLE = rf"""
WITH marks AS (SELECT doc_id AS lid, max(quality) AS q FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY 1),
d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS size,
         -ln((('0x' || substr(sha256('mix-1:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE)
         / (CASE WHEN q = 1 THEN 4.0 WHEN q = 0 THEN 1.0 ELSE 2.0 END)::DOUBLE AS k
  FROM documents LEFT JOIN marks ON doc_id = lid),
s AS (SELECT source, sum(size)::BIGINT AS source_size, (3.0 * sum(size))::DOUBLE AS cap,
             (1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3)::DOUBLE AS w FROM d GROUP BY source),
f AS (SELECT *, (sum(source_size) OVER ())::DOUBLE AS total,
             sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS UNBOUNDED PRECEDING) - cap AS cap_before,
             sum(w) OVER () - sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS UNBOUNDED PRECEDING) + w AS w_left FROM s),
g AS (SELECT *, (total - cap_before) * w >= cap * w_left AS capped FROM f),
h AS (SELECT *, sum(CASE WHEN capped THEN cap ELSE 0 END) OVER () AS spent, sum(CASE WHEN capped THEN 0 ELSE w END) OVER () AS sharing FROM g),
t AS (SELECT source, source_size, CASE WHEN capped THEN cap ELSE (total - spent) / nullif(sharing, 0) * w END AS target FROM h),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS epochs FROM t),
r AS (SELECT d.doc_id, d.size, e.source_size, e.target, e.epochs, e.target - e.epochs * e.source_size AS rest, d.source,
             sum(d.size) OVER (PARTITION BY d.source ORDER BY k, d.doc_id, d.size ROWS UNBOUNDED PRECEDING)::DOUBLE AS upto
      FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, source, size, source_size, target::DOUBLE AS target,
       (size * (epochs + (rest > 0 AND (upto <= rest OR upto - rest < rest - (upto - size)))::BIGINT))::BIGINT AS taken,
       (epochs + (rest > 0 AND (upto <= rest OR upto - rest < rest - (upto - size)))::BIGINT)::BIGINT AS copies
FROM r
"""
