"""Document fingerprints: a Merkle tree over paragraphs and sections.

Paragraphs are lines.  A paragraph's node is the SHA-256 of its text; a section is a
run of paragraphs that a blank line or a paragraph with a hash below 1/8 of the range
closes, its node the SHA-256 of the paragraph nodes; the root is the SHA-256 of the
section nodes.  Equal roots mean equal texts.  Under each paragraph hang 32-bit digests
of its phrases, so that differing branches locate an edit within it.  Section and
phrase borders depend on nearby content alone: an edit changes only the branches it
touches.

A fingerprint is text: root, then sections (16 hex digits each), then phrases (8 each).
Likeness is 1 for equal roots, else the Dice coefficient of the distinct leaves, the phrase
digests; ``differing_branches`` names the sections of one tree that the other lacks, with
their leaves that it lacks, which is where an edit is.

Defined results: a null text is empty; an empty text has one empty paragraph; repeated
rows are one another's neighbours in the order of text; a table of one row is its own
next document; an empty table gives no rows; null ids come last; a text of any length is
fingerprinted whole; other columns are not read; two trees without a leaf are of likeness 0
unless their roots are equal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, partitions

#: White space after these ends a phrase; a phrase of more characters than that is cut.
PHRASE_END, PHRASE = r"(?<=[aeiouyAEIOUY0-9\p{P}\p{S}])\x20+", 64
#: Quantiles of the ids, and even slices between two of them: cells, counted once; buckets of about equal row counts are runs of cells.
QUANTILES, SLICES = 128, 512


def tree(text: Column) -> Column:
    """struct(root string, sections array<string>, phrases array<int>) of a text."""
    text = F.coalesce(text, F.lit(""))
    paragraphs = F.split(text, "\n", -1)
    closing = lambda h, p: F.when((F.length(p) == 0) | h.rlike("^[01]"), F.concat(h, F.lit(";"))).otherwise(h)
    chain = F.array_join(F.transform(paragraphs, lambda p: closing(F.sha2(p, 256), p)), ",")
    sections = F.transform(F.split(chain, ";,?", -1), lambda s: F.sha2(s, 256))
    short = lambda x: F.when(F.length(x) > PHRASE, F.regexp_extract_all(x, F.lit(f"(?s).{{1,{PHRASE}}}"), F.lit(0))).otherwise(F.array(x))
    cut = lambda p: F.flatten(F.transform(F.split(p, PHRASE_END, -1), short))
    phrases = F.array_distinct(F.flatten(F.transform(paragraphs, lambda p: F.transform(cut(p), lambda x: F.hash(x)))))
    # the number of paragraphs is part of the root, as an empty last section leaves no other trace
    root = F.sha2(F.concat_ws("|", F.array_join(sections, ","), F.size(paragraphs).cast("string")), 256)
    return F.struct(root.alias("root"), sections.alias("sections"), phrases.alias("phrases"))


def fingerprint(t: Column) -> Column:
    hexed = lambda x: F.lpad(F.lower(F.hex(x.cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))), 8, "0")
    return F.concat_ws(":", t["root"], F.array_join(F.transform(t["sections"], lambda s: F.substring(s, 1, 16)), ""), F.array_join(F.transform(t["phrases"], hexed), ""))


def likeness(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a["phrases"], b["phrases"]))
    leaves = F.size(a["phrases"]) + F.size(b["phrases"])
    return F.when(a["root"] == b["root"], F.lit(1.0)).otherwise(F.coalesce(2.0 * both / F.nullif(leaves, F.lit(0)), F.lit(0.0)))


def differing_branches(a: Column, b: Column) -> Column:
    """Where tree ``a`` differs from tree ``b``: places (from 0) of its sections that ``b`` has not, in order; none for equal roots."""
    numbered = F.transform(a["sections"], lambda s, i: F.struct(s.alias("node"), i.alias("place")))
    apart = F.filter(numbered, lambda s: ~F.array_contains(b["sections"], s["node"]))
    return F.when(a["root"] == b["root"], F.array().cast("array<int>")).otherwise(F.transform(apart, lambda s: s["place"]))


def section_texts(text: Column) -> Column:
    """The text of each section of :func:`tree`, in its order, so that a place names a passage."""
    paragraphs = F.split(F.coalesce(text, F.lit("")), "\n", -1)
    closes = lambda p: (F.length(p) == 0) | F.sha2(p, 256).rlike("^[01]")

    def step(acc, p):
        grown = F.concat(F.slice(acc["out"], 1, F.size(acc["out"]) - 1), F.array(F.concat(F.element_at(acc["out"], -1), F.array(p))))
        opened = F.concat(grown, F.array(F.array().cast("array<string>")))
        return F.struct(F.when(closes(p), opened).otherwise(grown).alias("out"))

    start = F.struct(F.array(F.array().cast("array<string>")).alias("out"))
    return F.transform(F.aggregate(paragraphs, start, step, lambda acc: acc["out"]), lambda s: F.array_join(s, "\n"))


def _cells(docs: DataFrame) -> tuple[DataFrame, Column, int]:
    """A map from cells of the id range to buckets of about equal row counts, the cell of a row, and the number of buckets."""
    spark = docs.sparkSession
    shares = F.array(*[F.lit(i / QUANTILES) for i in range(QUANTILES + 1)])
    cuts, n = docs.agg(F.percentile_approx(F.col("doc_id").cast("double"), shares, F.lit(20 * QUANTILES)), F.count(F.lit(1))).first()
    cuts = sorted(cuts or [0.0] * (QUANTILES + 1))
    buckets = max(1, min(4 * partitions(spark), -(-n // 32)))
    # one outlying id stretches its own quantile alone; the bounds of the first and last are open
    x, edges = F.col("doc_id").cast("double"), F.array(*map(F.lit, cuts))
    part = F.greatest(F.lit(0), F.least(F.lit(QUANTILES - 1), F.size(F.filter(F.array(*map(F.lit, cuts[1:-1])), lambda c: c < x))))
    low, high = F.element_at(edges, part + 1), F.element_at(edges, part + 2)
    slice_ = F.floor((x - low) / (high - low + 1) * SLICES)
    cell = F.when(x.isNotNull(), part * SLICES + F.greatest(F.lit(0), F.least(F.lit(SLICES - 1), slice_))).otherwise(-1).cast("int")
    counts = docs.groupBy(cell.alias("__cell")).count()
    upto = Window.orderBy("__cell").rowsBetween(Window.unboundedPreceding, 0)
    bucket = F.floor((F.sum("count").over(upto) - 1) * buckets / max(n, 1)).cast("int")
    return durable(counts.select("__cell", bucket.alias("__bucket")), "merkle-cells"), cell, buckets


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, tree and next_text, next_tree of each row: the next by descending id, the first after the last.

    Rows go to buckets of neighbouring ids, in one shuffle.  The head of the bucket
    below is copied into a bucket as its last row, so the last document finds its
    successor without a global sort.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    cells, cell, _ = _cells(docs.select("doc_id"))
    # at most QUANTILES * SLICES + 1 rows, whatever the input
    placed = docs.withColumn("__c", cell).join(F.broadcast(cells), F.col("__c") == cells["__cell"]).drop("__c", "__cell")
    narrow = docs.select("doc_id").withColumn("__c", cell).join(F.broadcast(cells), F.col("__c") == cells["__cell"])
    heads = narrow.groupBy("__bucket").agg(F.max("doc_id").alias("__head"))
    down = Window.orderBy(F.col("__bucket").desc())
    top = F.max("__bucket").over(Window.partitionBy())
    bottom = F.min("__bucket").over(Window.partitionBy())
    above = F.coalesce(F.lag("__bucket").over(down), F.when(F.col("__bucket") == top, bottom))
    heads = durable(heads.select(F.col("__bucket").alias("__own"), "__head", above.alias("__into")), "merkle-heads")
    # at most a row for each of the buckets, whose number is a setting
    lent = placed.join(F.broadcast(heads), (F.col("__bucket") == F.col("__own")) & F.col("doc_id").eqNullSafe(F.col("__head")))
    one = Window.partitionBy("__own").orderBy(F.md5("text").desc())
    lent = lent.withColumn("__n", F.row_number().over(one)).where("__n = 1").select("doc_id", "text", F.col("__into").alias("__bucket"), F.lit(True).alias("__lent"))
    rows = placed.withColumn("__lent", F.lit(False)).unionByName(lent).withColumn("tree", tree(F.col("text")))
    order = Window.partitionBy("__bucket").orderBy("__lent", F.col("doc_id").desc_nulls_last(), F.md5("text").desc())
    rows = rows.select("doc_id", "text", "tree", "__lent", F.lead(F.struct("text", "tree")).over(order).alias("next"))
    return rows.where(~F.col("__lent")).select("doc_id", "text", "tree", F.col("next.text").alias("next_text"), F.col("next.tree").alias("next_tree"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """The digest of every row and of its edited text, as the query returns it."""
    rows = with_next(docs).withColumn("n_chars", F.length("text").cast("long"))
    rows = rows.withColumn("__k", F.floor(F.col("n_chars") / 3).cast("int"))
    edited = F.concat(F.expr("substring(text, 1, int(n_chars) - __k)"), F.expr("substring(next_text, 1, __k)"))
    rows = rows.withColumn("edited", edited).withColumn("edited_tree", tree(F.col("edited")))
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint(F.col("tree")).alias("fingerprint"),
        fingerprint(F.col("edited_tree")).alias("edited_fingerprint"),
        likeness(F.col("tree"), F.col("edited_tree")).alias("near_edited"),
        likeness(F.col("tree"), F.col("next_tree")).alias("near_next"),
    )
