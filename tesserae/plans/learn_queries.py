"""Queries of evaluation and calibration, over labelled documents with a fixed score."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.functions import text as t
from tesserae.operators import learn
from tesserae.plans.registry import query, table

S = "s AS (SELECT doc_id AS id, lang, source, round((n_chars % 1000) / 1000.0 * 0.6 + ((doc_id * 37) % 100) / 100.0 * 0.4, 6)::DOUBLE AS p, quality::INTEGER AS y FROM labels JOIN documents USING (doc_id))"
C = "c AS (SELECT sum((p >= 0.5 AND y = 1)::BIGINT)::BIGINT AS tp, sum((p >= 0.5 AND y = 0)::BIGINT)::BIGINT AS fp, sum((p < 0.5 AND y = 1)::BIGINT)::BIGINT AS fn, sum((p < 0.5 AND y = 0)::BIGINT)::BIGINT AS tn FROM s)"


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    p = (F.col("n_chars") % 1000) / 1000.0 * 0.6 + ((F.col("doc_id") * 37) % 100) / 100.0 * 0.4
    return table(spark, sf_dir, "labels").join(d, "doc_id").select(F.col("doc_id").alias("id"), "lang", "source", F.round(p, 6).alias("p"), F.col("quality").alias("y"))


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


@query(f"WITH {S}, {C}, r AS (SELECT *, (tp + tn) / (tp + fp + fn + tn) AS accuracy, tp / (tp + fp) AS precision, tp / (tp + fn) AS recall, fp / (fp + tn) AS fpr FROM c) SELECT tp, fp, fn, tn, round(accuracy, 6) AS accuracy, round(precision, 6) AS precision, round(recall, 6) AS recall, round(fpr, 6) AS fpr, round(2 * precision * recall / (precision + recall), 6) AS f1 FROM r")
def confusion_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(learn.confusion(scored(spark, sf_dir)), "accuracy", "precision", "recall", "fpr", "f1")


RANKED = f"{S}, r AS (SELECT *, row_number() OVER w AS place, sum(y) OVER (ORDER BY p DESC, id ROWS UNBOUNDED PRECEDING) AS tp, count(*) OVER () AS total, sum(y) OVER () AS pos FROM s WINDOW w AS (ORDER BY p DESC, id))"


@query(f"""WITH {RANKED}, t AS (SELECT place, tp / pos AS rec, tp / place AS prec, (place - tp) / (total - pos) AS fpr FROM r),
a AS (SELECT place, (rec - lag(rec) OVER o) * (prec + lag(prec) OVER o) / 2 AS pr, (fpr - lag(fpr) OVER o) * (rec + lag(rec) OVER o) / 2 AS roc FROM t WINDOW o AS (ORDER BY place)) SELECT round(sum(pr), 6) AS pr_auc, round(sum(roc), 6) AS roc_auc FROM a""")
def pr_roc_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(learn.auc(scored(spark, sf_dir)), "pr_auc", "roc_auc")


@query(f"WITH {RANKED}, k AS (SELECT unnest([10, 25, 50, 100]) AS k) SELECT k::INTEGER AS k, round(avg(y), 6) AS precision FROM k JOIN r ON place <= k GROUP BY k")
def topk_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(learn.topk_precision(scored(spark, sf_dir)), "precision")


@query(f"WITH {RANKED}, b AS (SELECT *, least((total - place) // (total // 10), 9)::INTEGER AS bin FROM r) SELECT bin, min(p) AS lower, max(p) AS upper, round(avg(y), 6) AS accuracy, count(*)::BIGINT AS n FROM b GROUP BY bin")
def calibration_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(learn.equal_count_bins(scored(spark, sf_dir)), "accuracy")


@query(f"WITH {RANKED}, b AS (SELECT *, floor((total - place) / ceil(total / 20.0))::INTEGER AS bin FROM r) SELECT bin, min(p) AS lower, max(p) AS upper, round(avg(y), 6) AS accuracy, count(*)::BIGINT AS n FROM b GROUP BY bin")
def isotonic_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(learn.equal_count_bins(scored(spark, sf_dir), 20, remainder_last=False), "accuracy")


@query(f"WITH {S} SELECT least(floor(p * 10), 9)::INTEGER AS bin, count(*)::BIGINT AS n, round(avg(p), 6) AS confidence, round(avg(y), 6) AS accuracy FROM s GROUP BY 1")
def reliability_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(learn.reliability(scored(spark, sf_dir)), "confidence", "accuracy")


@query(f"""WITH {S}, t AS (SELECT unnest(range(5, 21)) / 10.0::DOUBLE AS temperature), z AS (SELECT y, ln(greatest(least(p, 1 - 1e-6), 1e-6) / (1 - greatest(least(p, 1 - 1e-6), 1e-6))) AS z FROM s),
c AS (SELECT temperature, y, 1 / (1 + exp(-z / temperature)) AS c FROM z, t) SELECT temperature, round(sum(-y * ln(c) - (1 - y) * ln(1 - c)), 6) AS loss FROM c GROUP BY temperature""")
def temperature_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(learn.temperature_grid(scored(spark, sf_dir)), "loss")


@query(f"""WITH {S}, t AS (SELECT (unnest(range(50, 100)) / 100.0)::DOUBLE AS threshold), g AS (SELECT threshold, sum((p >= threshold AND y = 1)::BIGINT)::BIGINT AS tp, sum((p >= threshold AND y = 0)::BIGINT)::BIGINT AS fp, sum((p < threshold AND y = 1)::BIGINT)::BIGINT AS fn FROM s, t GROUP BY 1),
r AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS recall FROM g)
SELECT threshold, tp, fp, fn, round(precision, 6) AS precision, round(recall, 6) AS recall, round(CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END, 6) AS f1 FROM r""")
def threshold_tuning(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(learn.threshold_grid(scored(spark, sf_dir), [t / 100 for t in range(50, 100)]), "precision", "recall", "f1")


@query(f"""WITH {S}, b AS (SELECT least(floor(p * 10), 9) AS bin, count(*) AS m, abs(avg(p) - avg(y)) AS gap, sum((p - y) * (p - y)) AS sq, sum(-y * ln(greatest(least(p, 1 - 1e-15), 1e-15)) - (1 - y) * ln(1 - greatest(least(p, 1 - 1e-15), 1e-15))) AS ll FROM s GROUP BY 1)
SELECT round(sum(gap * m) / sum(m), 6) AS ece, round(max(gap), 6) AS max_ce, round(sum(sq) / sum(m), 6) AS brier, round(sum(ll) / sum(m), 6) AS log_loss FROM b""")
def ece_brier_logloss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(learn.calibration_error(scored(spark, sf_dir)), "ece", "max_ce", "brier", "log_loss")


@query(f"WITH {S}, g AS (SELECT lang, avg(((p >= 0.5)::INTEGER = y)::INTEGER) AS a, count(*) AS n FROM s GROUP BY lang) SELECT round(avg(a), 6) AS mean, round(stddev_pop(a), 6) AS std, count(*)::BIGINT AS n_groups, sum(n)::BIGINT AS n FROM g")
def group_metrics_std(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = learn.confusion(scored(spark, sf_dir), by=["lang"])
    return g.agg(F.round(F.avg("accuracy"), 6).alias("mean"), F.round(F.stddev_pop("accuracy"), 6).alias("std"), F.count(F.lit(1)).alias("n_groups"), F.sum(F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")).alias("n"))


@query("""WITH e AS (SELECT unnest(range(64)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings), m AS (SELECT i, avg(x) AS m, stddev_pop(x) AS s FROM e GROUP BY i)
SELECT i::INTEGER AS i, round(m, 6) AS mean, round(CASE WHEN s < 1e-10 THEN 1 ELSE s END, 6) AS std FROM m""")
def standardize_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(learn.moments(table(spark, sf_dir, "embeddings"), "embedding"), "mean", "std")


SPLIT = "g AS (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL), o AS (SELECT source, row_number() OVER (ORDER BY md5('0:' || source), source) - 1 AS i, count(*) OVER () AS n FROM g), sp AS (SELECT source, CASE WHEN i < floor(n * 0.7) THEN 'train' WHEN i < floor(n * 0.85) THEN 'val' ELSE 'test' END AS split FROM o)"


@query(f"WITH {SPLIT} SELECT source, split FROM sp")
def repo_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learn.split_groups(table(spark, sf_dir, "documents"), "source")


_WORDS = "list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda x: x <> '')"
_SHINGLES = "CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) ELSE [] END"
_BOTH = "SELECT '{0}' AS test, count(*) AS n FROM (SELECT {1} FROM tr WHERE {1} IS NOT NULL INTERSECT SELECT {1} FROM te)"


@query(f"""WITH {SPLIT}, d AS (SELECT split, source, source || '/' || lang AS file, substr(text, 1, instr(text || ' ', ' ') - 1) AS symbol, md5(text) AS body, CASE WHEN contains(text, 'All rights reserved') THEN md5(text) END AS generated FROM documents JOIN sp USING (source)),
tr AS (SELECT * FROM d WHERE split = 'train'), te AS (SELECT * FROM d WHERE split <> 'train'),
s AS (SELECT DISTINCT unnest({_SHINGLES}) AS x FROM (SELECT {_WORDS} AS w FROM documents)), b AS (SELECT DISTINCT unnest({_SHINGLES}) AS x FROM (SELECT {_WORDS} AS w FROM benchmark)),
x AS ({" UNION ALL ".join(_BOTH.format(*c) for c in (("repository", "source"), ("file", "file"), ("symbol", "symbol"), ("duplicate", "body"), ("generated", "generated")))} UNION ALL SELECT 'benchmark', count(*) FROM (SELECT x FROM s INTERSECT SELECT x FROM b))
SELECT test, n::BIGINT AS n_shared, n > 0 AS leaked FROM x""")
def leakage_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five tests between the splits, and the three-word shingles that documents share with the benchmark."""
    d = table(spark, sf_dir, "documents")
    runs = lambda df: df.select(F.explode(F.array(t.plain_words(F.col("text")))).alias("w")).select(F.explode(t.word_runs("w", 3)).alias("benchmark")).distinct()
    every, asked = runs(d), runs(table(spark, sf_dir, "benchmark"))
    d = d.join(learn.split_groups(d, "source"), "source")
    symbol = F.substring_index("text", " ", 1)
    generated = F.when(F.col("text").contains("All rights reserved"), F.md5("text"))
    d = d.select("split", F.col("source").alias("repository"), F.concat("source", F.lit("/"), "lang").alias("file"), symbol.alias("symbol"), F.md5("text").alias("duplicate"), generated.alias("generated"))
    return learn.overlap(d.filter("split = 'train'"), d.filter("split != 'train'"), ["repository", "file", "symbol", "duplicate", "generated"]).unionAll(learn.overlap(every, asked, ["benchmark"]))


@query(f"WITH {SPLIT} SELECT source, count(*)::BIGINT AS n_docs FROM documents JOIN sp USING (source) WHERE split = 'test' GROUP BY source")
def unseen_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of the test split, none of which is in training."""
    d, split = table(spark, sf_dir, "documents"), learn.split_groups(table(spark, sf_dir, "documents"), "source")
    train = split.filter("split = 'train'").select("source")
    return d.join(split.filter("split = 'test'").select("source"), "source", "left_semi").join(train, "source", "left_anti").groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"))


@query(f"WITH {S}, w AS (SELECT CASE lang WHEN 'en' THEN 1.0 WHEN 'fr' THEN 0.7 WHEN 'de' THEN 0.4 ELSE 0.2 END::DOUBLE AS w, ((p >= 0.5)::INTEGER = y)::INTEGER AS ok FROM s) SELECT round(sum(w * ok) / sum(w), 6) AS weighted, round(avg(ok), 6) AS plain FROM w")
def weighted_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages stand for label sources."""
    w = list(learn.SOURCE_WEIGHTS.values())
    weight = F.when(F.col("lang") == "en", w[0]).when(F.col("lang") == "fr", w[1]).when(F.col("lang") == "de", w[2]).otherwise(w[3])
    ok = ((F.col("p") >= 0.5).cast("int") == F.col("y")).cast("int")
    return scored(spark, sf_dir).agg(F.round(F.sum(weight * ok) / F.sum(weight), 6).alias("weighted"), F.round(F.avg(ok), 6).alias("plain"))


@query()
def logistic_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality from length facts: a fitted model's confusion on its own rows."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.length("text").alias("n"), F.size(F.array_distinct(F.split("text", " "))).alias("w"), F.length(F.regexp_replace("text", "[A-Za-z ]", "")).alias("odd"))
    rows = table(spark, sf_dir, "labels").join(d, "doc_id").select(F.col("doc_id").alias("id"), F.col("quality").alias("y"), F.log1p("n").alias("n"), (F.col("w") / (F.col("n") + 1)).alias("w"), (F.col("odd") / (F.col("n") + 1)).alias("odd"))
    features = ["n", "w", "odd"]
    model = learn.fit(rows, features, steps=15)
    return rounded(learn.confusion(rows.select("id", "y", learn.predict(model, features).alias("p"))), "accuracy", "precision", "recall", "fpr", "f1")
