"""The row-level baseline: median imputation with indicators, scaling, and a balanced logistic regression."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.operators.evaluation import average_precision, confusion, rank_auc
from skein.operators.features import chunks
from skein.operators.order import quantiles, ranks, running
from skein.operators.scoring import stacked


def hourly_profile(tx: DataFrame) -> DataFrame:
    """(hour_us, n, n_positive, rate) of every hour between the first and last, empty ones too."""
    hour = 3_600_000_000
    t = tx.groupBy((F.floor(F.col("ts_us") / hour) * hour).alias("hour_us")).agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("n_positive"))
    every = t.agg(F.min("hour_us").alias("a"), F.max("hour_us").alias("b")).where("a IS NOT NULL").select(F.explode(F.sequence("a", "b", F.lit(hour))).alias("hour_us"))
    return every.join(t, "hour_us", "left").na.fill(0, ["n", "n_positive"]).withColumn("rate", F.when(F.col("n") > 0, F.col("n_positive") / F.col("n")))


def impute_plan(train: DataFrame, names: list[str]) -> tuple[dict[str, float], list[str]]:
    """Medians by column (0 for a column without values), and the columns that have nulls in ``train``.

    Exact, by a global order of a few columns at a time: no task holds the values of a column.
    """
    medians, missing = dict.fromkeys(names, 0.0), set()
    for part in chunks(names):
        ranked = ranks(stacked(train, part), "value", ("name",))
        medians |= {r["name"]: r["value"] for r in quantiles(ranked, "value", (0.5,), ("name",)).collect()}  # a row a column
        missing |= {r["name"] for r in ranked.where("value IS NULL").select("name").collect()}
    return medians, [n for n in names if n in missing]


def imputed(df: DataFrame, plan: tuple[dict[str, float], list[str]]) -> DataFrame:
    medians, missing = plan
    return df.withColumns({f"miss_{n}": F.col(n).isNull().cast("double") for n in missing} | {f"x_{n}": F.coalesce(F.col(n).cast("double"), F.lit(m)) for n, m in medians.items()})


def train(df: DataFrame, names: list[str], c: float = 1.0, max_iter: int = 200) -> tuple[PipelineModel, tuple[dict[str, float], list[str]]]:
    """The fitted model and its imputation; ``df`` has the features and label.  Classes weigh the same in total."""
    plan = impute_plan(df, names)
    counts = {r["label"]: r["count"] for r in df.groupBy("label").count().collect()}
    total = sum(counts.values())
    weight = F.create_map(*[x for k, v in counts.items() for x in (F.lit(k), F.lit(total / (len(counts) * v)))])[F.col("label")]
    x = imputed(df, plan).withColumn("w", weight).withColumn("label", F.col("label").cast("double"))
    stages = [
        VectorAssembler(inputCols=[*[f"x_{n}" for n in plan[0]], *[f"miss_{n}" for n in plan[1]]], outputCol="raw"),
        StandardScaler(inputCol="raw", outputCol="features", withMean=True),
        LogisticRegression(weightCol="w", standardization=False, regParam=1.0 / (c * total), maxIter=max_iter),
    ]
    return Pipeline(stages=stages).fit(x), plan


def predict(model: PipelineModel, plan, df: DataFrame) -> DataFrame:
    """transaction_id and score."""
    missing = [n for n in plan[0] if n not in df.columns]
    if missing:
        raise ValueError(f"features are missing: {missing}")
    out = model.transform(imputed(df, plan))
    return out.select("transaction_id", vector_to_array("probability")[1].alias("score"))


def score_block(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row: ROC area, average precision, Brier score, confusion, and recall in the top 1 and 5 percent.

    Rows that share the score at the edge of the top count in part, as many as still fit.
    """
    t = running(df.withColumn("__down", -F.col("score")), "__down", {"n": F.count(F.lit(1)), "p": F.count_if(F.col("label") == 1)})
    every = t.agg(F.sum("n").alias("__n"), F.sum("p").alias("__p"))
    t = t.crossJoin(F.broadcast(every))
    fits = lambda share: F.least(F.col("n"), F.greatest(F.lit(0), F.ceil(F.col("__n") * share) - F.col("n_before")))
    top = t.agg(*[(F.sum(F.col("p") * fits(s) / F.col("n")) / F.nullif(F.max("__p"), F.lit(0))).alias(f"recall_top_{int(s * 100)}") for s in (0.01, 0.05)])
    brier = df.agg(F.avg(F.pow(F.col("score") - F.col("label"), 2)).alias("brier"))
    return rank_auc(df, "score").select("auc", "n_pos", "n_neg").crossJoin(average_precision(df).select("average_precision")).crossJoin(confusion(df, threshold)).crossJoin(top).crossJoin(brier)


def ablation(train_df: DataFrame, test_df: DataFrame, groups: dict[str, list[str]]) -> list[dict]:
    """ROC area and average precision of all features, of each group alone and of all without it."""
    every = [n for g in groups.values() for n in g]
    runs = {"full": every} | {f"only_{g}": v for g, v in groups.items()} | {f"without_{g}": [n for n in every if n not in v] for g, v in groups.items()}
    out = []
    for name, cols in runs.items():
        if cols:
            model, plan = train(train_df, cols)
            s = predict(model, plan, test_df).join(test_df.select("transaction_id", "label"), "transaction_id")
            out.append({"run": name, "n_features": len(cols), **score_block(s).first().asDict()})
    return out
