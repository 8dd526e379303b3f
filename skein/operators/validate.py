"""Checks of tables: each returns counts as rows, so that a caller decides what is fatal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.plans.config import GROUND_TRUTH

IDS = ("transaction_id", "card_fingerprint", "device_fingerprint", "ip_signature", "merchant_id", "bin")


def parse_failures(raw: DataFrame) -> DataFrame:
    """One row: values of amount and timestamp that don't parse."""
    bad = lambda c, t: F.count_if(F.col(c).isNotNull() & F.col(c).cast("string").try_cast(t).isNull())
    return raw.agg(bad("amount", "double").alias("bad_amount"), bad("timestamp", "timestamp").alias("bad_timestamp"), F.count_if(F.col("amount").isNull()).alias("no_amount"))


def repeated_ids(tx: DataFrame) -> DataFrame:
    return tx.groupBy("transaction_id").count().agg(F.count_if(F.col("count") > 1).alias("n_repeated"), F.count(F.lit(1)).alias("n_ids"))


def blanks(tx: DataFrame) -> DataFrame:
    """(column, n_blank) of the structural ids."""
    one = tx.agg(*[F.count_if(F.col(c).isNull() | (F.trim(c) == "")).alias(c) for c in IDS])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("n_blank")) for c in IDS])).alias("x")).select("x.*")


FIELDS = (*IDS, "amount", "timestamp", "auth_outcome")


def problem(columns: list[str]) -> Column:
    """The first problem of a row, or null, as a column: what an online request is checked for.

    Ground truth and columns that a transaction has not are errors of the request as a whole.
    """
    if set(columns) & set(GROUND_TRUTH):
        raise ValueError("ground truth may not be sent for scoring")
    if set(columns) - set(FIELDS) or set(FIELDS) - set(columns):
        raise ValueError(f"unknown columns {sorted(set(columns) - set(FIELDS))}, missing columns {sorted(set(FIELDS) - set(columns))}")
    amount = F.col("amount").cast("string").try_cast("double")
    found = F.lit(None).cast("string")
    tests = [(F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == ""), f"blank {c}") for c in IDS]
    tests += [(amount.isNull() | F.isnan(amount) | (F.abs(amount) == float("inf")) | (amount <= 0), "amount must be finite and positive"), (F.col("timestamp").isNull(), "no timestamp"), (~F.coalesce(F.lower(F.trim("auth_outcome")).isin("approved", "declined"), F.lit(False)), "unknown outcome")]
    for bad, said in reversed(tests):
        found = F.when(bad, said).otherwise(found)
    return found


def row_problems(raw: DataFrame) -> DataFrame:
    """transaction_id and the first problem of each row, or null."""
    return raw.select("transaction_id", problem(raw.columns).alias("problem"))


def coerced(raw: DataFrame) -> DataFrame:
    """Ids as text without blanks around them; a bin that came as a number is its digits."""
    digits = F.regexp_replace(F.trim(F.col("bin").cast("string")), r"\.0+$", "")
    return raw.withColumns({c: F.trim(F.col(c).cast("string")) for c in IDS if c != "bin"} | {"bin": digits})


def labels_preserved(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: ids removed, added and relabelled, and positives among the added."""
    j = before.select("transaction_id", F.col("label").alias("a")).join(after.select("transaction_id", F.col("label").alias("b")), "transaction_id", "full_outer")
    return j.agg(F.count_if(F.col("b").isNull()).alias("n_removed"), F.count_if(F.col("a").isNull()).alias("n_added"), F.count_if(F.col("a") != F.col("b")).alias("n_relabelled"), F.count_if(F.col("a").isNull() & (F.col("b") == 1)).alias("n_added_positive"))


def fingerprint(df: DataFrame) -> DataFrame:
    """(n, hash, total): whatever the order of rows; rows that repeat count as often as they do."""
    h = F.xxhash64(*sorted(df.columns))
    return df.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(h).alias("hash"), F.sum(h.cast("decimal(20,0)")).cast("string").alias("total"))


def graph_checks(tx: DataFrame, links: DataFrame) -> DataFrame:
    """One row of counts that must be 0: links to oneself, to the future, out of the window, or without evidence."""
    t = lambda x: tx.select(F.col("transaction_id").alias(f"{x}_transaction_id"), F.col("ok").alias(f"{x}_ok"))
    j = links.join(t("anchor"), "anchor_transaction_id", "left").join(t("prior"), "prior_transaction_id", "left")
    return j.agg(
        F.count_if(F.col("anchor_transaction_id") == F.col("prior_transaction_id")).alias("n_self"), F.count_if(F.col("prior_ok") >= F.col("anchor_ok")).alias("n_future"), F.count_if((F.col("age_seconds") < 0) | (F.col("age_seconds") > 3600)).alias("n_outside_window"),
        F.count_if(F.col("n_link_entity_types") < 1).alias("n_without_evidence"), F.count_if(F.col("anchor_ok").isNull() | F.col("prior_ok").isNull()).alias("n_unknown"),
    )


def candidate_checks(assigned: DataFrame, links: DataFrame) -> DataFrame:
    """One row of counts that must be 0: links across candidates, ids assigned twice, sizes that don't add up."""
    own = lambda x: assigned.select(F.col("transaction_id").alias(f"{x}_transaction_id"), F.col("candidate_id").alias(x))
    across = links.join(own("anchor"), "anchor_transaction_id").join(own("prior"), "prior_transaction_id").agg(F.count_if(F.col("anchor") != F.col("prior")).alias("n_links_across"))
    twice = assigned.groupBy("transaction_id").count().agg(F.count_if(F.col("count") > 1).alias("n_assigned_twice"))
    sizes = assigned.groupBy("candidate_id").agg(F.count(F.lit(1)).alias("n"), F.max("candidate_size").alias("said")).agg(F.count_if(F.col("n") != F.col("said")).alias("n_wrong_size"))
    return across.crossJoin(twice).crossJoin(sizes)


def rows_preserved(before: DataFrame, after: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """One row: original rows that are missing or changed, and rows added."""
    a = before.select("transaction_id", F.xxhash64(*columns).alias("a"), F.lit(1).alias("in_a"))
    b = after.select("transaction_id", F.xxhash64(*columns).alias("b"), F.lit(1).alias("in_b"))
    j = a.join(b, "transaction_id", "full_outer")
    return j.agg(F.count_if(F.col("in_b").isNull()).alias("n_missing"), F.count_if((F.col("in_a") == 1) & (F.col("in_b") == 1) & (F.col("a") != F.col("b"))).alias("n_changed"), F.count_if(F.col("in_a").isNull()).alias("n_added"))
