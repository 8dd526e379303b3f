"""Stored tables and fitted state: what the engine writes, and what it checks before it trusts a file.

A path that is marked frozen is never written again.  Tables are written by Spark, so any
store that it reaches will do.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.operators import scoring
from skein.plans.config import GROUND_TRUTH

#: What stored candidates and assignments must have.
CANDIDATE_COLUMNS = ("candidate_id", "size", "time_span_seconds", "link_edge_count", "links_multi_entity")
ASSIGNMENT_COLUMNS = ("transaction_id", "candidate_id", "candidate_size")


class ArtifactError(ValueError):
    """A stored table that isn't what it should be, or one that may not be written."""


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def write_table(df: DataFrame, path: str, kind: str = "parquet", frozen: tuple[str, ...] = ()) -> str:
    """Writes a table as ``parquet``, ``csv`` (with a header) or ``json``, both with times to the microsecond."""
    if any(path.rstrip("/") == f.rstrip("/") or path.startswith(f.rstrip("/") + "/") for f in frozen):
        raise ArtifactError(f"{path} is frozen")
    w = (df if kind == "parquet" else rendered(df)).write.mode("overwrite")
    if kind not in ("parquet", "csv", "json"):
        raise ArtifactError(f"no such format: {kind}")
    (w.option("header", True).csv if kind == "csv" else getattr(w, kind))(path)
    return path


def rendered(df: DataFrame) -> DataFrame:
    """Times as text that reads back to the microsecond."""
    return df.select(*[F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias(c) if t == "timestamp_ntz" else F.date_format(F.to_utc_timestamp(c, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias(c) if t == "timestamp" else F.col(c) for c, t in df.dtypes])


def freeze(spark: SparkSession, path: str) -> None:
    """Marks a folder: :func:`read_table` says so, and writers that ask :func:`is_frozen` leave it alone."""
    spark.range(1).coalesce(1).write.mode("overwrite").json(f"{path.rstrip('/')}.frozen")


def is_frozen(spark: SparkSession, path: str) -> bool:
    return _exists(spark, f"{path.rstrip('/')}.frozen")


def read_table(spark: SparkSession, path: str, columns: tuple[str, ...] = (), kind: str = "parquet", allow_truth: bool = False) -> DataFrame:
    """A stored table; an error if a column that it must have is missing, or ground truth is in it."""
    df = spark.read.option("header", True).csv(path) if kind == "csv" else getattr(spark.read, kind)(path)
    missing = [c for c in columns if c not in df.columns]
    leaked = [] if allow_truth else [c for c in GROUND_TRUTH if c in df.columns]
    if missing or leaked:
        raise ArtifactError(f"{path}: missing {missing}, ground truth {leaked}")
    return df


def save_candidates(candidates: DataFrame, assigned: DataFrame, path: str) -> None:
    write_table(candidates, f"{path}/candidates")
    write_table(assigned, f"{path}/assignments")


def load_candidates(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Candidates and assignments that fit one another: every candidate of an assignment is there."""
    c, a = read_table(spark, f"{path}/candidates", CANDIDATE_COLUMNS), read_table(spark, f"{path}/assignments", ASSIGNMENT_COLUMNS)
    lost = a.join(c, "candidate_id", "left_anti").limit(1).count()
    if lost:
        raise ArtifactError(f"{path}: an assignment is to a candidate that isn't stored")
    return c, a


def save_reference(spark: SparkSession, ref: scoring.ScorerReference, table: DataFrame, path: str) -> None:
    """A scorer's reference: its numbers as one line of JSON, its values as a table."""
    spark.createDataFrame([(ref.to_json(),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/reference")
    write_table(table, f"{path}/values")


def load_reference(spark: SparkSession, path: str) -> tuple[scoring.ScorerReference, DataFrame]:
    """The reference, checked: every feature has its values, and as many of them as the population had rows."""
    lines = spark.read.text(f"{path}/reference").limit(2).collect()
    if len(lines) != 1:
        raise ArtifactError(f"{path}: one line was expected")
    ref = scoring.ScorerReference.from_json(lines[0]["value"])
    table = read_table(spark, f"{path}/values", ("name", "value", "n"))
    counted = {r["name"]: r["n"] for r in table.groupBy("name").agg(F.sum("n").alias("n")).limit(len(ref.signs) + 1).collect()}
    if ref.n and counted != {x: ref.n for x in ref.signs}:
        raise ArtifactError(f"{path}: values don't add up to the population")
    return ref, table


def same_reference(a: tuple[scoring.ScorerReference, DataFrame], b: tuple[scoring.ScorerReference, DataFrame]) -> bool:
    return a[0] == b[0] and a[1].exceptAll(b[1]).limit(1).count() == 0 and b[1].exceptAll(a[1]).limit(1).count() == 0


def save_model(model: PipelineModel, plan, spark: SparkSession, path: str) -> None:
    """A fitted model with its imputation: medians by column, and which columns have an indicator."""
    model.write().overwrite().save(f"{path}/model")
    medians, missing = plan
    write_table(spark.createDataFrame([(i, n, float(m), n in missing) for i, (n, m) in enumerate(medians.items())], "place int, name string, median double, indicated boolean"), f"{path}/imputation")


def load_model(spark: SparkSession, path: str):
    """(model, plan) as :func:`skein.operators.ml.predict` takes them."""
    rows = read_table(spark, f"{path}/imputation", ("place", "name", "median", "indicated")).orderBy("place").collect()  # a row a feature
    return PipelineModel.load(f"{path}/model"), ({r["name"]: r["median"] for r in rows}, [r["name"] for r in rows if r["indicated"]])
