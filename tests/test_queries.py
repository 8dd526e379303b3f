"""Queries against their SQL on the smallest tables, and the entry points with and without the llm subpackage."""

import subprocess
import sys
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from skein.operators import features
from skein.plans.config import FIXTURE
from skein.plans.durable import durable
from tools.compare import normal

SF = "/root/testdata/sf0.001"
REPO = Path(__file__).resolve().parents[1]
SOME = ["scan_typed", "causal_order", "win_median", "win_entropy", "related_entities", "feat_velocity", "graph_edges", "neighbors_symmetric", "causal_links", "assignments", "candidate_overlap", "scorer_transform", "detect_campaigns", "cand_flags", "cand_timing", "campaign_table", "rank_auc", "select_threshold", "campaign_overlap", "hourly_profile", "weaken_reuse", "right_censor", "validate_transactions", "candidate_key"]


@pytest.mark.parametrize("name", SOME)
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for p in Path(SF).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    got, want = normal(entry.queries()[name](spark, SF).toPandas()), normal(con.sql(entry.oracle_sql()[name]).df())
    assert list(got.columns) == list(want.columns)
    assert got.equals(want)


def test_audits_cover_every_declared_feature(spark):
    every = features.declared(FIXTURE)
    q = entry.queries()
    names = lambda n: sorted(r["name"] for r in q[n](spark, SF).select("name").collect())
    assert names("dq_ranges") == sorted(f.name for f in every if f.low is not None or f.high is not None)
    assert names("feature_dictionary_stats") == sorted(f.name for f in every)
    assert names("univariate_audit") == sorted(f.name for f in every)
    assert len(q["feature_table"](spark, SF).columns) == 157


def test_observed_counts_distinct_values(spark):
    df = spark.createDataFrame([("a", 1.0, 3, None), ("b", 1.0, 4, None), ("c", -0.0, 5, None), ("d", 0.0, None, None)], "transaction_id string, x double, y long, z double")
    got = {r["name"]: r for r in features.observed(df).collect()}
    assert {n: (r["n"], r["n_null"], r["min"], r["max"], r["n_unique"]) for n, r in got.items()} == {"x": (4, 0, 0.0, 1.0, 2), "y": (4, 1, 3.0, 5.0, 3), "z": (4, 4, None, None, 0)}
    assert {(r["name"], r["n"], r["n_unique"]) for r in features.observed(df.limit(0)).collect()} == {(n, 0, 0) for n in "xyz"}


def test_packed_tables_are_not_broadcast(spark):
    """Two million rows in a few MB of files take over 10 MB at the driver."""
    t = durable(spark.range(2_000_000).selectExpr("id DIV 2 AS id", "1 AS x").coalesce(1), "packed")
    plan = t.join(t.select("id", F.col("x").alias("y")), "id")._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert {"candidate_id", "score", "tier", "action"} <= set(entry.entry(spark).columns)


@pytest.mark.parametrize("pipeline", [False, True])
def test_imports_without_the_llm_subpackage(tmp_path, pipeline):
    """With and without corpus_pipeline.py, which can't be imported then."""
    for p in ("__spark_entry__.py", *(["corpus_pipeline.py"] if pipeline else [])):
        (tmp_path / p).symlink_to(REPO / p)
    copy = tmp_path / "skein"
    copy.mkdir()
    for p in (REPO / "skein").iterdir():
        if p.name not in ("llm", "__pycache__"):
            (copy / p.name).symlink_to(p)
    said = subprocess.run([sys.executable, "-B", "-c", "import sys; sys.path.insert(0, '.'); import __spark_entry__ as e; print(len(e.queries()), [q for q in e.queries() if q.startswith('op') or q == 'pipeline'])"], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "PYTHONDONTWRITEBYTECODE": "1"})
    assert said.returncode == 0, said.stderr
    assert said.stdout.strip().endswith("[]") and int(said.stdout.split()[0]) > 130


def test_core_never_imports_llm():
    for p in (REPO / "skein").rglob("*.py"):
        if "llm" not in p.parts:
            assert "skein.llm" not in p.read_text(), p
