"""The online surface: transactions arrive in micro-batches, are checked, stored once, and the population is scored again.

A late row needs no watermark: the store is ordered by time whenever it is read.  A
batch is written under its number, so that a batch that is run again after a failure
replaces itself; ids that the store has already are left out when it is read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.operators import candidates, causal, scoring
from skein.operators.validate import coerced, problem
from skein.plans.config import CandidateConfig
from skein.plans.durable import durable

SCHEMA = "transaction_id string, timestamp timestamp, merchant_id string, card_fingerprint string, bin string, amount double, device_fingerprint string, ip_signature string, auth_outcome string"


COLUMNS = tuple(c.split()[0] for c in SCHEMA.split(", "))
#: A message's kinds and the columns of a transaction in it.
MESSAGE = f"type string, transaction struct<{SCHEMA.replace(' ', ':').replace(',:', ',')}>"


class Store:
    """An append-only table of accepted transactions.

    Defined results: an id that is null or blank is a problem like any other, and its row is rejected;
    of valid rows that repeat an id the first by (batch, time, content) counts, whatever
    invalid rows share the id; ground truth or unknown columns refuse the batch as a whole.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def append(self, batch: DataFrame, number: int) -> None:
        """Rows without a problem, and the others with theirs, under the batch's number."""
        checked = coerced(batch).withColumn("problem", problem(batch.columns))
        checked.where("problem IS NULL").drop("problem").write.mode("overwrite").parquet(f"{self.path}/accepted/batch={number}")
        checked.where("problem IS NOT NULL").write.mode("overwrite").parquet(f"{self.path}/rejected/batch={number}")

    def read(self) -> DataFrame:
        """Each id once, as it first came; an empty table before the first batch and after a reset."""
        if not self._has("accepted"):
            return self.spark.createDataFrame([], SCHEMA)
        rows = self.spark.read.schema(SCHEMA + ", batch long").parquet(f"{self.path}/accepted")
        order = Window.partitionBy("transaction_id").orderBy("batch", "timestamp", F.xxhash64(*rows.columns))
        return rows.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n", "batch")

    def rejected(self) -> DataFrame:
        if not self._has("rejected"):
            return self.spark.createDataFrame([], SCHEMA + ", problem string, batch long")
        return self.spark.read.schema(SCHEMA + ", problem string, batch long").parquet(f"{self.path}/rejected")

    def reset(self) -> None:
        """Forgets everything that was accepted or rejected."""
        for kind in ("accepted", "rejected"):
            p = self._path(kind)
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)

    def health(self) -> DataFrame:
        """One row: status, accepted ids, rejected rows and the last time seen."""
        a = self.read().agg(F.count(F.lit(1)).alias("n_transactions"), F.max("timestamp").alias("last_timestamp"))
        return a.crossJoin(self.rejected().agg(F.count(F.lit(1)).alias("n_rejected"))).select(F.lit("ok").alias("status"), "*")

    def _path(self, kind: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}")

    def _has(self, kind: str) -> bool:
        p = self._path(kind)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)


def snapshot(store: Store, ref: scoring.ScorerReference, table: DataFrame, config: CandidateConfig | None = None) -> tuple[DataFrame, DataFrame]:
    """(campaigns, summary) of all that is stored, against a frozen reference; well formed over an empty store."""
    t = causal.ordered(store.read())
    a = durable(candidates.assignments(candidates.components(t, config), config), "snapshot")
    campaigns = scoring.detect(t, a, ref, table)
    return campaigns, scoring.detection_summary(a, campaigns)


def messages(raw: DataFrame) -> DataFrame:
    """Messages (``value``, JSON text) read: what each asks for (transaction, snapshot, ping, or error), its transaction, and the
    reply's kind.  A text that is no such message is an error of its own and stops nothing."""
    m = raw.select("value", F.from_json("value", MESSAGE, {"mode": "PERMISSIVE", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][XXX]"}).alias("m"))
    kind = F.when(F.col("m.type").isin("transaction", "snapshot", "ping"), F.col("m.type")).otherwise("error")
    kind = F.when((kind == "transaction") & F.col("m.transaction").isNull(), "error").otherwise(kind)
    reply = F.when(kind == "ping", "pong").when(kind == "error", "error").otherwise("campaigns")
    return m.select("value", kind.alias("kind"), reply.alias("reply"), "m.transaction")


def rescore(tx: DataFrame, ref: scoring.ScorerReference, table: DataFrame, config: CandidateConfig | None = None) -> DataFrame:
    """Campaigns of the whole population against a frozen reference."""
    t = causal.ordered(tx)
    return scoring.detect(t, candidates.assignments(candidates.components(t, config), config), ref, table)


def run(stream: DataFrame, store: Store, checkpoint: str, on_batch: Callable[[DataFrame, int], None] | None = None):
    """A started query that appends every micro-batch and then calls ``on_batch`` with the store and the batch's number."""

    def each(batch: DataFrame, number: int) -> None:
        store.append(batch, number)
        if on_batch is not None:
            on_batch(store.read(), number)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def candidate_key(assigned: DataFrame) -> DataFrame:
    """(candidate_id, candidate_key): a name that only the members decide, for following a candidate from run to run.

    Two sums of hashes of the members' ids and their number: of one length for any candidate.
    """
    total = lambda start: F.sum(F.conv(F.substring(F.md5("transaction_id"), start, 15), 16, 10).cast("decimal(20,0)")).cast("string")
    return assigned.where("candidate_size > 1").groupBy("candidate_id").agg(F.count(F.lit(1)).alias("n"), total(1).alias("a"), total(16).alias("b")).select("candidate_id", F.md5(F.concat_ws(":", "n", "a", "b")).alias("candidate_key"))


def masked(column: str):
    """The first eight characters of an identifier."""
    c = F.col(column)
    return F.when(F.length(c) > 8, F.concat(F.substring(c, 1, 8), F.lit("…"))).otherwise(c)
