"""Chosen models on shared storage, and their predictions for many jobs in one pass."""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.ml import Model
from pyspark.ml import classification as mlc
from pyspark.ml import regression as mlr
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_LOADERS = {
    "linear_regression": mlr.LinearRegressionModel,
    "decision_tree": mlr.DecisionTreeRegressionModel,
    "random_forest": mlr.RandomForestRegressionModel,
    "boosted_trees": mlr.GBTRegressionModel,
    "decision_tree_classifier": mlc.DecisionTreeClassificationModel,
    "random_forest_classifier": mlc.RandomForestClassificationModel,
}
_SCHEMA = "target string, horizon int, family string, candidate_id string, features string, version string, path string"


def save_models(spark: SparkSession, chosen: Sequence[dict], folder: str, version: str) -> DataFrame:
    """Write each model under ``folder/version`` and then the table that lists them.

    ``chosen`` has ``target, horizon, family, candidate_id, features, model``.  The table is written
    last, so a version that can be read is complete; a version is never written twice.
    """
    keys = Counter((c["target"], c["horizon"]) for c in chosen)
    twice = sorted(k for k, n in keys.items() if n > 1)
    if twice:
        raise ValueError(f"More than one model for {twice}")
    root = f"{folder.rstrip('/')}/{version}"

    def save(c: dict) -> tuple:
        path = f"{root}/{c['target']}_h{c['horizon']}"
        c["model"].save(path)
        return (c["target"], c["horizon"], c["family"], c["candidate_id"], c["features"], version, path)

    with ThreadPoolExecutor(8) as pool:
        rows = list(pool.map(save, chosen))
    spark.createDataFrame(rows, _SCHEMA).coalesce(1).write.parquet(f"{root}/entries")
    return load_entries(spark, folder, version)


def load_entries(spark: SparkSession, folder: str, version: str) -> DataFrame:
    return spark.read.schema(_SCHEMA).parquet(f"{folder.rstrip('/')}/{version}/entries")


def load_model(family: str, path: str) -> Model:
    return _LOADERS[family].load(path)


def predict_routed(rows: DataFrame, entries: DataFrame, keys: tuple[str, str] = ("target", "horizon"), out: str = "prediction") -> DataFrame:
    """``prediction``, ``model_version`` and ``routed`` of every row, by the one model of its key.

    Each model is a column expression over the same scan; the choice evaluates only the model of the
    row's own target and horizon.  A row whose key has no entry or more than one is not routed.
    """
    listed = entries.collect()  # one row per job
    count = Counter((e["target"], e["horizon"]) for e in listed)
    scored, prediction, version = rows, None, None
    columns = []
    for i, e in enumerate(sorted((e for e in listed if count[e["target"], e["horizon"]] == 1), key=lambda e: (e["target"], e["horizon"]))):
        column = f"_prediction_{i}"
        model = load_model(e["family"], e["path"]).setFeaturesCol(e["features"]).setPredictionCol(column)
        for unused in ("setProbabilityCol", "setRawPredictionCol"):
            if hasattr(model, unused):
                getattr(model, unused)("")
        scored = model.transform(scored)
        mine: Column = (F.col(keys[0]) == e["target"]) & (F.col(keys[1]) == e["horizon"])
        label = F.lit(f"{e['version']}/{e['target']}_h{e['horizon']}/{e['candidate_id']}")
        prediction = (F if prediction is None else prediction).when(mine, F.col(column))
        version = (F if version is None else version).when(mine, label)
        columns.append(column)
    none = F.lit(None)
    picked = scored.withColumns({
        out: none.cast("double") if prediction is None else prediction,
        "model_version": none.cast("string") if version is None else version,
    })
    return picked.drop(*columns).withColumn("routed", F.col("model_version").isNotNull())
