"""A trained model as a plain dictionary: training with calibration and a frozen threshold, checks, saving and loading.

The dictionary holds model_id, created_at, version, features, feature_hash, weights, bias, mean, std, threshold,
temperature, n_examples and figures. It is bounded by the number of features, so it lives on the driver.
"""

from __future__ import annotations

import json
import math
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.functions import vectors as v
from tesserae.functions.features import names_hash
from tesserae.operators import learn
from tesserae.operators.iterate import written
from tesserae.operators.order import placed

# The threshold of a model that no validation tuned, and the version of the format.
THRESHOLD, VERSION = 0.92, 1


def train(train: DataFrame, validation: DataFrame | None, features: list[str], least_precision: float = 0.9, steps: int = 50, created_at: str = "1970-01-01T00:00:00+00:00") -> dict:
    """A model of train (id, y, features); the first half of validation by id calibrates it, the second tunes its threshold.

    The threshold is the one of most f1 among those of least_precision (0.50 to 0.99), THRESHOLD if none has it or without
    validation rows. Features that are null count as their mean.
    """
    weights, bias, mean, std = learn.fit(_filled(train, features), features, steps=steps)
    m = {"created_at": created_at, "version": VERSION, "features": features, "feature_hash": names_hash(features), "weights": weights, "bias": bias, "mean": mean, "std": std, "threshold": THRESHOLD, "temperature": 1.0, "n_examples": train.count(), "figures": {}}
    m["model_id"] = names_hash([*features, *map(repr, weights)])
    if validation is None:
        return m
    rows = validation.select("id", "y", learn.predict((weights, bias, mean, std), features).alias("p")).filter("p is not null")
    rows = written(placed(rows, F.col("id"), F.col("y"), F.col("p")), "validation")
    half = rows.count() // 2
    best = learn.temperature_grid(rows.filter(F.col("place") <= half)).filter("loss is not null").orderBy("loss", "temperature").first()
    m["temperature"] = best["temperature"] if best else 1.0
    tuning = rows.filter(F.col("place") > half).select("id", "y", v.with_temperature(F.col("p"), m["temperature"]).alias("p"))
    chosen = learn.best_threshold(learn.threshold_grid(tuning, [t / 100 for t in range(50, 100)]), least_precision).first()
    if chosen and chosen["tp"]:
        m["threshold"], m["figures"] = chosen["threshold"], {k: chosen[k] for k in ("precision", "recall", "f1")}
    return m


def _filled(df: DataFrame, features: list[str]) -> DataFrame:
    holds_null = df.agg(*[F.max(F.col(f).isNull()).alias(f) for f in features]).first()
    gaps = [f for f in features if holds_null[f]]
    if not gaps:
        return df
    mean = df.agg(*[F.avg(f).alias(f) for f in gaps]).first()
    return df.fillna({f: mean[f] or 0.0 for f in gaps})


def score(model: dict) -> Column:
    """The calibrated probability over the model's features."""
    m = model
    return v.with_temperature(learn.predict((m["weights"], m["bias"], m["mean"], m["std"]), m["features"]), m["temperature"])


def problems(model: dict, schema: list[str] | None = None) -> tuple[list[str], list[str]]:
    """(issues, warnings): issues make a model unfit, warnings don't. `schema` are the features expected (None: its own)."""
    names, issues, warnings = model.get("features", []), [], []
    expected = names if schema is None else schema
    if names != expected or model.get("feature_hash", names_hash(names)) != names_hash(expected):
        issues.append("features differ from the schema")
    issues += [f"feature {i} has no name" for i, n in enumerate(names) if not n]
    if len(model["weights"]) != len(names):
        issues.append(f"{len(model['weights'])} weights for {len(names)} features")
    issues += [f"weight {i} is not finite" for i, w in enumerate(model["weights"]) if not math.isfinite(w)]
    if not math.isfinite(model["bias"]):
        issues.append("bias is not finite")
    if model.get("temperature", 1.0) <= 0:
        issues.append("temperature is not positive")
    if len(model.get("model_id", "")) < 8:
        warnings.append("model id is short")
    try:
        datetime.fromisoformat(model.get("created_at", ""))
    except ValueError:
        warnings.append("creation date is no date")
    if model.get("version", 0) == 0:
        warnings.append("model has no version")
    if not 0 < model.get("threshold", THRESHOLD) < 1:
        warnings.append("threshold is outside (0, 1)")
    warnings += [f"{k} is outside [0, 1]" for k, x in model.get("figures", {}).items() if not 0 <= x <= 1]
    if not model.get("n_examples"):
        warnings.append("no examples are recorded")
    return issues, warnings


def save(spark: SparkSession, model: dict, path: str) -> None:
    """Writes the model as one line of JSON, wherever Spark can write."""
    spark.createDataFrame([(json.dumps(model),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load(spark: SparkSession, path: str, schema: list[str] | None = None) -> dict:
    """A saved model; one of weights and bias alone gets the schema's names and defaults. A model with issues is an error."""
    m = json.loads("\n".join(r.value for r in spark.read.text(path, wholetext=True).filter("value <> ''").collect()))
    names = m.get("features", schema if schema is not None else [f"f{i}" for i in range(len(m["weights"]))])
    n = len(m["weights"])
    m = {"version": 0, "features": names, "feature_hash": names_hash(names), "mean": [0.0] * n, "std": [1.0] * n, "threshold": THRESHOLD, "temperature": 1.0, "n_examples": 0, "figures": {}, "model_id": "", "created_at": ""} | m
    issues = problems(m, schema)[0]
    if issues:
        raise ValueError(f"unfit model in {path}: {'; '.join(issues)}")
    return m


def feature_gaps(df: DataFrame, by: list[str], y: str, vector: str, features: list[str]) -> DataFrame:
    """by, name, alive, dead: each feature's mean where y is 1 and where it is 0, null without such rows. Sums are combined before the shuffle."""
    at = df.select(*by, F.col(y).alias("__y"), F.posexplode(vector).alias("__i", "__x"))
    g = at.groupBy(*by, "__i").agg(F.avg(F.when(F.col("__y") == 1, F.col("__x"))).alias("alive"), F.avg(F.when(F.col("__y") == 0, F.col("__x"))).alias("dead"))
    return g.select(*by, F.element_at(F.array(*map(F.lit, features)), F.col("__i") + 1).alias("name"), "alive", "dead")


def weight_by_category(weights: DataFrame) -> DataFrame:
    """category, n, mean_weight, strongest for rows (place, name, category, weight): means of absolute weights, ties to the smaller place."""
    size = F.abs("weight")
    return weights.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.avg(size).alias("mean_weight"), F.max_by("name", F.struct(size, -F.col("place"))).alias("strongest"))
