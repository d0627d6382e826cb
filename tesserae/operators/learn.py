"""Fitting, calibration and evaluation of a classifier, over frames (id, p, y): probability and 0/1 label.

Ranked measures need each row's place by falling score and the count of positives up to it. Rows are placed by ranges
as in `order.placed`; equal scores are told apart by id, so many of them don't meet in one task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.functions import vectors as v
from tesserae.operators.iterate import written
from tesserae.operators.order import placed

# Weights of label sources.
SOURCE_WEIGHTS = {"gold": 1.0, "silver": 0.7, "bronze": 0.4, "heuristic": 0.2}


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def confusion(df: DataFrame, cut: float = 0.5, by: list[str] | None = None) -> DataFrame:
    """tp, fp, fn, tn, accuracy, precision, recall, f1, fpr; in one pass."""
    hit, pos = F.col("p") >= cut, F.col("y") == 1
    n = lambda c: F.coalesce(F.sum(c.cast("bigint")), F.lit(0))
    c = df.groupBy(*(by or [])).agg(n(hit & pos).alias("tp"), n(hit & ~pos).alias("fp"), n(~hit & pos).alias("fn"), n(~hit & ~pos).alias("tn"))
    return with_rates(c)


def with_rates(c: DataFrame) -> DataFrame:
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    c = c.withColumns({"accuracy": ratio(tp + tn, tp + fp + fn + tn), "precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "fpr": ratio(fp, fp + tn)})
    return c.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def ranked(df: DataFrame) -> DataFrame:
    """df with place (from 1, by falling p, then id), tp and fp up to it, positives and total."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = (F.desc("p"), F.asc("id"))
    b = written(df.select("id", "p", "y").repartitionByRange(n, *order).withColumn("bucket", F.spark_partition_id()), "ranges")
    # one row for each range, of which there are as many as shuffle partitions
    sums = b.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("pos"))
    before, every = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1), Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    starts = sums.select(F.col("bucket").alias("b"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"), F.coalesce(F.sum("pos").over(before), F.lit(0)).alias("p0"), F.sum("n").over(every).alias("total"), F.sum("pos").over(every).alias("positives"))
    w = Window.partitionBy("bucket").orderBy(*order)
    b = b.withColumn("i", F.row_number().over(w)).withColumn("c", F.sum("y").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = b.join(F.broadcast(starts), F.col("bucket") == F.col("b")).withColumn("place", F.col("n0") + F.col("i")).withColumn("tp", F.col("p0") + F.col("c"))
    return out.select("id", "p", "y", "place", "tp", (F.col("place") - F.col("tp")).alias("fp"), "positives", "total")


def _area(df: DataFrame, x: Column, y: Column, x0: Column, y0: Column) -> Column:
    return F.coalesce(F.sum(F.when(F.col("place") > 1, (x - x0) * (y + y0) / 2)), F.lit(0.0))


def auc(df: DataFrame) -> DataFrame:
    """One row pr_auc, roc_auc: trapezoids between successive ranked rows, from the second on; 0 without both classes."""
    r = ranked(df)
    tp, fp, pos, neg = F.col("tp"), F.col("fp"), F.col("positives"), F.col("total") - F.col("positives")
    tp0 = tp - F.col("y")
    fp0 = fp - (1 - F.col("y"))
    pr = _area(r, ratio(tp, pos), tp / F.col("place"), ratio(tp0, pos), F.when(F.col("place") > 1, tp0 / F.nullif(F.col("place") - 1, F.lit(0))))
    roc = _area(r, ratio(fp, neg), ratio(tp, pos), ratio(fp0, neg), ratio(tp0, pos))
    both = (F.max("positives") > 0) & (F.max(neg) > 0)
    return r.agg(F.when(F.max("positives") > 0, pr).otherwise(0.0).alias("pr_auc"), F.when(both, roc).otherwise(0.0).alias("roc_auc"))


def topk_precision(df: DataFrame, ks: tuple[int, ...] = (10, 25, 50, 100)) -> DataFrame:
    """k, precision among the k first; fewer rows count as they are."""
    top = df.orderBy(F.desc("p"), "id").limit(max(ks))
    place = F.row_number().over(Window.orderBy(F.desc("p"), "id"))  # over max(ks) rows
    return top.withColumn("place", place).withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks]))).filter("place <= k").groupBy("k").agg(F.avg("y").alias("precision"))


def calibration_error(df: DataFrame, n: int = 10) -> DataFrame:
    """One row ece, max_ce, brier, log_loss over n equally wide bins."""
    q = v.clamp(F.col("p"), 1e-15, 1 - 1e-15)
    b = df.groupBy(F.least(F.floor(F.col("p") * n), F.lit(n - 1)).alias("bin")).agg(
        F.count(F.lit(1)).alias("m"), F.avg("p").alias("conf"), F.avg("y").alias("acc"), F.sum((F.col("p") - F.col("y")) ** 2).alias("sq"), F.sum(-F.col("y") * F.log(q) - (1 - F.col("y")) * F.log(1 - q)).alias("ll")
    )
    gap = F.abs(F.col("conf") - F.col("acc"))
    return b.agg((F.sum(gap * F.col("m")) / F.sum("m")).alias("ece"), F.max(gap).alias("max_ce"), (F.sum("sq") / F.sum("m")).alias("brier"), (F.sum("ll") / F.sum("m")).alias("log_loss"))


def reliability(df: DataFrame, n: int = 10) -> DataFrame:
    """bin, count, confidence, accuracy of n equally wide bins."""
    return df.groupBy(F.least(F.floor(F.col("p") * n), F.lit(n - 1)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("confidence"), F.avg("y").alias("accuracy"))


def equal_count_bins(df: DataFrame, bins: int = 10, remainder_last: bool = True) -> DataFrame:
    """bin, lower, upper, accuracy, n over rising scores: n div bins rows each, the rest in the last; or, rounded up, the rest short."""
    r = ranked(df).withColumn("i", F.col("total") - F.col("place"))  # 0-based from the least score
    size = F.floor(F.col("total") / bins) if remainder_last else F.ceil(F.col("total") / F.least(F.lit(bins), F.col("total")))
    which = F.least(F.floor(F.col("i") / F.greatest(size, F.lit(1))), F.lit(bins - 1)).cast("int")
    return r.groupBy(which.alias("bin")).agg(F.min("p").alias("lower"), F.max("p").alias("upper"), F.avg("y").alias("accuracy"), F.count(F.lit(1)).alias("n"))


def isotonic_bins(bins: DataFrame) -> list[tuple[float, float, float]]:
    """(lower, upper, value) with falling neighbours pooled, from a table of bins (20 rows or so)."""
    pooled: list[list[float]] = []
    for r in bins.orderBy("bin").collect():
        pooled.append([r["lower"], r["upper"], r["accuracy"] * r["n"], r["n"]])
        while len(pooled) > 1 and pooled[-2][2] / pooled[-2][3] > pooled[-1][2] / pooled[-1][3]:
            last = pooled.pop()
            pooled[-1] = [pooled[-1][0], last[1], pooled[-1][2] + last[2], pooled[-1][3] + last[3]]
    return [(lo, hi, s / n) for lo, hi, s, n in pooled]


def calibrated(p: Column, bins: list[tuple[float, float, float]]) -> Column:
    """The value of the first bin with lower <= p < upper, else p."""
    out = p
    for lo, hi, value in reversed(bins):
        out = F.when((p >= lo) & (p < hi), value).otherwise(out)
    return out


def temperature_grid(df: DataFrame) -> DataFrame:
    """temperature, loss for 0.5 to 2.0 by 0.1: the sum of log losses."""
    q = v.clamp(F.col("p"), 1e-6, 1 - 1e-6)
    z = F.log(q / (1 - q))
    sums = []
    for i in range(5, 21):
        c = 1 / (1 + F.exp(-z / (i / 10)))
        sums.append(F.sum(-F.col("y") * F.log(c) - (1 - F.col("y")) * F.log(1 - c)).alias(f"l{i}"))
    one = df.agg(*sums)
    return one.select(F.explode(F.array(*[F.struct(F.lit(i / 10).alias("temperature"), F.col(f"l{i}").alias("loss")) for i in range(5, 21)])).alias("r")).select("r.*")


def threshold_grid(df: DataFrame, cuts: list[float]) -> DataFrame:
    """threshold, tp, fp, fn, precision, recall, f1 for each cut; in one pass without a join."""
    pos = F.col("y") == 1
    n = lambda c: F.coalesce(F.sum(c.cast("bigint")), F.lit(0))
    one = df.agg(*[x for i, t in enumerate(cuts) for x in (n((F.col("p") >= t) & pos).alias(f"tp{i}"), n((F.col("p") >= t) & ~pos).alias(f"fp{i}"))], n(pos).alias("pos"))
    rows = one.select(F.explode(F.array(*[F.struct(F.lit(t).alias("threshold"), F.col(f"tp{i}").alias("tp"), F.col(f"fp{i}").alias("fp"), (F.col("pos") - F.col(f"tp{i}")).alias("fn")) for i, t in enumerate(cuts)])).alias("r")).select("r.*")
    rows = rows.withColumns({"precision": ratio(F.col("tp"), F.col("tp") + F.col("fp")), "recall": ratio(F.col("tp"), F.col("tp") + F.col("fn"))})
    return rows.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def best_threshold(grid: DataFrame, least_precision: float) -> DataFrame:
    """The row of the grid with the best f1 among those of enough precision; the smaller threshold of equals."""
    return grid.filter(F.col("precision") >= least_precision).orderBy(F.desc("f1"), "threshold").limit(1)


def moments(df: DataFrame, vector: str) -> DataFrame:
    """i, mean, std of each position of a vector column; population deviation, 1 where it is below 1e-10."""
    flat = df.select(F.posexplode(vector).alias("i", "x"))
    return flat.groupBy("i").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("s")).select("i", "mean", F.when(F.col("s") < 1e-10, 1.0).otherwise(F.col("s")).alias("std"))


def fit(df: DataFrame, features: list[str], weight: str | None = None, steps: int = 50, rate: float = 0.5) -> tuple[list[float], float, list[float], list[float]]:
    """(weights, bias, mean, std) of a logistic model by full-batch gradient descent on standardized features; y is the label.

    Each step is one aggregate over all rows; the driver holds a number for each feature. Repeatable, whatever the partitions.
    """
    w0 = F.col(weight) if weight else F.lit(1.0)
    m = df.agg(*[x for f in features for x in (F.avg(f).alias(f"m_{f}"), F.stddev_pop(f).alias(f"s_{f}"))]).first()
    mean = [m[f"m_{f}"] or 0.0 for f in features]
    std = [m[f"s_{f}"] if (m[f"s_{f}"] or 0) >= 1e-10 else 1.0 for f in features]
    z = df.select(w0.alias("w"), F.col("y").cast("double").alias("y"), *[((F.col(f) - mu) / sd).alias(f"z{i}") for i, (f, mu, sd) in enumerate(zip(features, mean, std, strict=True))])
    z = written(z, "standardized")  # each step reads it again
    weights, bias = [0.0] * len(features), 0.0
    for _ in range(steps):
        s = F.lit(bias)
        for i, b in enumerate(weights):
            s = s + F.col(f"z{i}") * b
        err = (v.sigmoid(s) - F.col("y")) * F.col("w")
        g = z.select(err.alias("e"), "w", *[f"z{i}" for i in range(len(features))]).agg(F.sum("w").alias("n"), F.sum("e").alias("b"), *[F.sum(F.col("e") * F.col(f"z{i}")).alias(f"g{i}") for i in range(len(features))]).first()
        if not g["n"]:
            break
        grad = [max(-5.0, min(5.0, g[f"g{i}"] / g["n"])) for i in range(len(features))]
        weights, bias = [b - rate * x for b, x in zip(weights, grad, strict=True)], bias - rate * max(-5.0, min(5.0, g["b"] / g["n"]))
    return weights, bias, mean, std


def predict(model: tuple[list[float], float, list[float], list[float]], features: list[str]) -> Column:
    weights, bias, mean, std = model
    s = F.lit(bias)
    for f, b, mu, sd in zip(features, weights, mean, std, strict=True):
        s = s + (F.col(f) - mu) / sd * b
    return v.sigmoid(s)


def split_groups(df: DataFrame, key: str, shares: tuple[float, float] = (0.7, 0.15), seed: str = "0") -> DataFrame:
    """key, split (train, val, test): groups go to splits as a whole, by the order of a hash of key and seed, cut by the number of groups."""
    groups = df.select(key).filter(F.col(key).isNotNull()).distinct().withColumn("h", F.md5(F.concat(F.lit(seed), F.lit(":"), F.col(key).cast("string"))))
    r = placed(groups, F.asc("h"), F.asc(key), name="i")
    n = r.count()
    first, second = math.floor(n * shares[0]), math.floor(n * (shares[0] + shares[1]))
    return r.select(key, F.when(F.col("i") <= first, "train").when(F.col("i") <= second, "val").otherwise("test").alias("split"))


def overlap(train: DataFrame, test: DataFrame, columns: list[str]) -> DataFrame:
    """test (name), n_shared, leaked: for each column the distinct values that both sides hold."""
    out = None
    for c in columns:
        shared = train.select(c).filter(F.col(c).isNotNull()).distinct().intersect(test.select(c).filter(F.col(c).isNotNull()).distinct())
        row = shared.agg(F.count(F.lit(1)).alias("n_shared")).select(F.lit(c).alias("test"), "n_shared", (F.col("n_shared") > 0).alias("leaked"))
        out = row if out is None else out.unionAll(row)
    return out


def hard_negatives(facts: DataFrame) -> DataFrame:
    """node, kind for each of the kinds of hard negatives that a function is: rows are alive, though they look dead."""
    c = F.col
    kinds = {"uncalled_public": c("is_public") & (c("fan_in") == 0), "trait_impl": c("trait_impl").isNotNull(), "documented_uncalled": c("doc").isNotNull() & (c("fan_in") == 0), "unreachable_called": ~c("reachable") & (c("fan_in") > 0), "complex_uncalled": (c("complexity") > 20) & (c("fan_in") == 0)}
    return facts.select("node", F.explode(F.array_compact(F.array(*[F.when(cond, F.lit(k)) for k, cond in kinds.items()]))).alias("kind"))


def compare(df: DataFrame, static: str = "static", model: str = "model", share: float = 0.6) -> DataFrame:
    """name (static, model, fused) with the confusion's columns, for a frame (static, model, y); in one pass."""
    fused = F.col(model) * share + F.col(static) * (1 - share)
    rows = df.select("y", F.explode(F.array(*[F.struct(F.lit(n).alias("name"), c.alias("p")) for n, c in (("static", F.col(static)), ("model", F.col(model)), ("fused", fused))])).alias("r")).select("y", "r.*")
    return confusion(rows, by=["name"])


def ablation(df: DataFrame, features: list[str], steps: int = 15) -> DataFrame:
    """left_out (none, or a feature) with the confusion's columns of a model fitted without it."""
    out = None
    for gone in [None, *features]:
        kept = [f for f in features if f != gone]
        c = confusion(df.select("y", predict(fit(df, kept, steps=steps), kept).alias("p"))).withColumn("left_out", F.lit(gone or "none"))
        out = c if out is None else out.unionAll(c)
    return out
