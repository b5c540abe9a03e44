"""Boosted trees with forward-chaining validation on MLlib."""
from __future__ import annotations

import itertools
from collections.abc import Iterator, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import Imputer, SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.ml.classification import GBTClassifier
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import clean_double
from ..session import materialize, shared_dir
from .evaluation import auc, regression_metrics
from .importance import importance_cum_bins, importance_knee

# Default tree parameters.
DEFAULTS = {"maxDepth": 6, "stepSize": 0.1, "maxIter": 200, "subsamplingRate": 0.8, "featureSubsetStrategy": "0.8", "seed": 42}


def helper_prefix(columns: Sequence[str]) -> str:
    """Start of the names of helper columns, such that no column of the table begins with it."""
    prefix = "_gbt_"
    while any(c.lower().startswith(prefix) for c in columns):
        prefix = f"_{prefix}"
    return prefix


def fit_gbt(
    train: DataFrame, features: Sequence[str], target: str = "target", task: str = "regression", checkpoint_every: int = 10,
    validation: DataFrame | None = None, tolerance: float = 0.0, **params,
) -> PipelineModel:
    """Fit boosted trees; lineage of the boosting rounds is cut in the shared folder.

    Missing features take the median of the rows fitted on, also when scoring, so no row is lost;
    a feature without any value counts as 0.  Rows without a target are not fitted on.

    With ``validation`` rows boosting ends early: once a round improves their error by no more than
    ``tolerance`` (a share of it), the model keeps the trees up to the best round.  Medians are still of
    the rows fitted on alone.
    """
    shared_dir(train.sparkSession)
    options = {**DEFAULTS, **params, "checkpointInterval": checkpoint_every}
    prefix = helper_prefix([*train.columns, *features])
    kind = GBTClassifier if task == "classification" else GBTRegressor
    model = kind(featuresCol=f"{prefix}features", labelCol=target, **options)
    doubles = [F.coalesce(clean_double(c), F.lit(float("nan"))).alias(c) for c in features]

    def fitted_on(df: DataFrame) -> DataFrame:
        return df.select(*doubles, F.col(target).cast("double").alias(target)).filter(F.col(target).isNotNull())

    rows = fitted_on(train)
    seen = rows.agg(*[F.max(F.when(~F.isnan(c), 1)).alias(c) for c in features]).first()  # one row
    some = [c for c in features if seen[c]]
    into, full = (lambda c: f"{prefix}in_{c}"), (lambda c: f"{prefix}full_{c}")
    whole = [SQLTransformer(statement="SELECT *, " + ", ".join(
        f"CAST({f'coalesce(`{c}`, double(\'NaN\'))' if c in some else '0'} AS DOUBLE) AS `{into(c)}`" for c in features) + " FROM __THIS__")]
    if some:
        whole.append(Imputer(inputCols=[into(c) for c in some], outputCols=[full(c) for c in some], strategy="median"))
    whole.append(VectorAssembler(inputCols=[full(c) if c in some else into(c) for c in features], outputCol=f"{prefix}features", handleInvalid="keep"))
    ready = Pipeline(stages=whole).fit(rows)
    if validation is None:
        return PipelineModel([*ready.stages, model.fit(ready.transform(rows))])
    marked = rows.withColumn(f"{prefix}held", F.lit(False)).unionByName(fitted_on(validation).withColumn(f"{prefix}held", F.lit(True)))
    model = model.setValidationIndicatorCol(f"{prefix}held")
    model.set(model.validationTol, float(tolerance))
    return PipelineModel([*ready.stages, model.fit(ready.transform(marked))])


def rounds(model: PipelineModel) -> int:
    """Trees that the model kept."""
    return model.stages[-1].getNumTrees


def score_batch(model: PipelineModel, df: DataFrame, task: str = "regression", name: str = "prediction") -> DataFrame:
    """Predictions for all parts in one pass; ``split`` stays a column."""
    prefix = model.stages[-1].getFeaturesCol().removesuffix("features")
    if clash := [c for c in df.columns if c.lower().startswith(prefix) or c in ("rawPrediction", "probability", "prediction")]:
        raise ValueError(f"columns named like the model's own: {', '.join(clash)}")
    scored = model.transform(df)
    if task == "classification":
        scored = scored.withColumn("probability_up", F.get(vector_to_array("probability"), F.lit(1)))
    drop = [c for c in scored.columns if c in ("rawPrediction", "probability") or c.startswith(prefix)]
    return scored.drop(*drop).withColumnRenamed("prediction", name)


def feature_importance(model: PipelineModel, features: Sequence[str]) -> DataFrame:
    """One row per feature; the vector is as wide as the model."""
    values = model.stages[-1].featureImportances.toArray()
    from pyspark.sql import SparkSession

    return SparkSession.active().createDataFrame(
        [(f, float(v)) for f, v in zip(features, values)], "feature string, importance double"
    )


def tune_grid_walk_forward(
    df: DataFrame, features: Sequence[str], grid: Mapping[str, Sequence], target: str = "target", task: str = "regression",
    folds: int = 3, parallel: int = 4, groups: Mapping[str, Sequence[str]] | None = None, early: bool = True, **fixed,
) -> DataFrame:
    """Fold scores per parameter set (and feature group), with the rounds that were boosted.

    With ``early``, a fold's test rows end its boosting (see :func:`fit_gbt`).

    ``df`` carries ``test_fold`` and ``train_from_fold`` from ``walk_forward_splits``: a fold
    is never trained on later rows.  Driver threads only submit jobs.
    """
    spark = df.sparkSession
    groups = groups or {"all": list(features)}
    names = list(grid)
    combos = [dict(zip(names, values)) for values in itertools.product(*grid.values())]
    jobs = [(g, cols, c, f) for g, cols in groups.items() for c in combos for f in range(folds)]

    def run(job):
        group, columns, params, fold = job
        train = df.filter(F.col("train_from_fold") <= fold)
        test = df.filter(F.col("test_fold") == fold)
        model = fit_gbt(train, columns, target, task, validation=test if early else None, **{**fixed, **params})
        scored = score_batch(model, test, task).withColumn("_all", F.lit(0))
        if task == "classification":
            row = auc(scored, ["_all"], "probability_up", target).first()
            score = row["auc"] if row else None
        else:
            row = regression_metrics(scored, ["_all"], "prediction", target).first()
            score = row["rmse"] if row else None
        label = ",".join(f"{k}={v}" for k, v in params.items())
        return (group, label, fold, None if score is None else float(score), rounds(model))

    with ThreadPoolExecutor(parallel) as pool:
        rows = list(pool.map(run, jobs))
    return spark.createDataFrame(rows, "feature_group string, params string, fold int, score double, rounds int")


def best_params(scores: DataFrame, minimize: bool = True) -> DataFrame:
    """Parameter set with the best mean fold score."""
    means = scores.groupBy("feature_group", "params").agg(F.avg("score").alias("mean_score"), F.stddev_pop("score").alias("std_score"))
    order = F.col("mean_score").asc_nulls_last() if minimize else F.col("mean_score").desc_nulls_last()
    return means.orderBy(order, "feature_group", "params").limit(1)


def groups_by_share(importance: DataFrame, minimum: int = 3) -> dict[str, list[str]]:
    """Nested feature groups by cumulative importance, and the features up to the knee.  Names only reach the driver."""
    out: dict[str, list[str]] = {}
    for r in importance_cum_bins(importance, minimum=minimum).collect():
        out.setdefault(r["group"], []).append(r["feature"])
    out["knee"] = [r["feature"] for r in importance_knee(importance).collect()]
    return {g: sorted(names) for g, names in out.items() if names}


def two_stage_tuning(
    df: DataFrame, features: Sequence[str], grid: Mapping[str, Sequence], importance_groups=groups_by_share, target: str = "target",
    task: str = "regression", folds: int = 3, **fixed,
) -> DataFrame:
    """First the parameters on all features, then the feature groups with the best parameters.

    ``importance_groups(importance)`` maps an importance table to {group: features}; the importance is that of
    a model with the best parameters on all rows that are trained on, boosted for the mean of its folds' rounds.
    One row per stage, feature group, parameter set and fold; ``chosen`` marks the best set of each stage.
    """
    minimize = task != "classification"
    first = materialize(tune_grid_walk_forward(df, features, grid, target, task, folds, **fixed), "stage-one")
    best = best_params(first, minimize).first()
    picked = dict(p.split("=") for p in best["params"].split(","))
    typed = {k: type(grid[k][0])(v) for k, v in picked.items()}
    mean_rounds = first.filter(F.col("params") == best["params"]).agg(F.ceil(F.avg("rounds"))).first()[0]
    model = fit_gbt(df.filter(F.col("train_from_fold").isNotNull()), features, target, task, **{**fixed, **typed, "maxIter": int(mean_rounds)})
    groups = {"all": list(features), **importance_groups(feature_importance(model, features))}
    second = materialize(tune_grid_walk_forward(df, features, {k: [v] for k, v in typed.items()}, target, task, folds, groups=groups, **fixed), "stage-two")
    last = best_params(second, minimize).first()
    both = first.withColumn("stage", F.lit(1)).unionByName(second.withColumn("stage", F.lit(2)))
    won = ((F.col("stage") == 1) & (F.col("params") == best["params"])) | ((F.col("stage") == 2) & (F.col("feature_group") == last["feature_group"]))
    sizes = F.create_map(*[F.lit(x) for g, names in groups.items() for x in (g, len(names))])
    return both.withColumn("n_features", sizes[F.col("feature_group")]).withColumn("chosen", won.cast("int"))


def pairwise_correlation(df: DataFrame, features: Sequence[str]) -> np.ndarray:
    """Pearson's correlation of each two features over the rows that hold both; NaN where there is none.

    Each task adds up the products of its rows by matrix products, one row of sums per task; values are
    taken relative to their mean, so that large levels cost no digits.
    """
    p = len(features)
    if not p:
        return np.empty((0, 0))
    values = df.select(*[F.coalesce(clean_double(c), F.lit(float("nan"))).alias(f"c{k}") for k, c in enumerate(features)])
    known = [F.when(~F.isnan(f"c{k}"), F.col(f"c{k}")) for k in range(p)]
    moments = values.agg(*[f(c) for c in known for f in (F.avg, F.stddev_pop)]).first()  # one row
    center = np.array([x or 0.0 for x in moments[::2]])
    scale = np.array([x or 1.0 for x in moments[1::2]])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((4, p, p))
        for b in batches:
            x = (np.column_stack([c.to_numpy() for c in b.columns]) - center) / scale
            there = (~np.isnan(x)).astype(np.float64)
            x = np.nan_to_num(x)
            # common rows; sum and sum of squares of the first over them; sum of products
            total += np.stack([there.T @ there, x.T @ there, (x * x).T @ there, x.T @ x])
        yield pa.RecordBatch.from_pydict({"at": pa.array(np.arange(total.size), pa.int32()), "total": total.ravel()})
    rows = values.mapInArrow(sums, "at int, total double").groupBy("at").agg(F.sum("total").alias("total")).collect()  # four per pair
    flat = np.zeros(4 * p * p)
    for r in rows:
        flat[r["at"]] = r["total"]
    n, s, q, xy = flat.reshape(4, p, p)
    with np.errstate(divide="ignore", invalid="ignore"):
        spread = q - s * s / n
        spread = np.where(spread > 1e-12 * q, spread, np.nan)
        return (xy - s * s.T / n) / np.sqrt(spread * spread.T)


def corr_feature_filter(
    df: DataFrame, importance: DataFrame, minimum: float = 0.001, max_correlation: float = 0.95, keep: int = 50
) -> DataFrame:
    """Features important enough and not strongly correlated with a more important one.

    Each correlation is over the rows in which both features are present (NaN and infinities are
    missing), so no row is lost to a third feature.  A pair without a correlation (fewer than two common
    rows, or no spread) drops neither.  The greedy pass handles names only.
    """
    ranked = [r["feature"] for r in importance.filter(F.col("importance") >= minimum).orderBy(F.col("importance").desc(), "feature").collect()]
    ranked = [f for f in ranked if f in df.columns]
    matrix = pairwise_correlation(df, ranked)
    kept: list[int] = []
    for i in range(len(ranked)):
        if all(not abs(matrix[i][j]) > max_correlation for j in kept) and len(kept) < keep:
            kept.append(i)
    names = [ranked[i] for i in kept]
    return importance.filter(F.col("feature").isin(names))
