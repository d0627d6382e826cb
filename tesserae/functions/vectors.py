"""Expressions over arrays of doubles and over scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tesserae.functions import text as t

# Languages of the one-hot encoding, weights of label sources.
LANGUAGES = ("rust", "python", "javascript", "typescript", "go", "java", "dart", "php", "cpp", "csharp")
STATES = ("DefinitelyDead", "ProbablyDead", "Unknown", "ProbablyAlive", "DefinitelyAlive")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 if a norm is 0, an array is empty, or the lengths differ."""
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0) & (norm(a) > 0) & (norm(b) > 0), dot(a, b) / (norm(a) * norm(b))).otherwise(0.0)


def euclid(a: Column, b: Column) -> Column:
    """1 if an array is empty or the lengths differ."""
    d = F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0), F.sqrt(dot(d, d))).otherwise(1.0)


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 1 if both are empty."""
    return F.when(F.size(F.array_union(a, b)) == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def standardized(v: Column, mean: Column, std: Column) -> Column:
    return F.zip_with(F.zip_with(v, mean, lambda x, m: x - m), std, lambda x, s: x / s)


def min_capped(v: Column, most: float) -> Column:
    return F.least(v / most, F.lit(1.0))


def one_hot(value: Column, values: tuple[str, ...] = LANGUAGES) -> Column:
    return F.array(*[(value == x).cast("double") for x in values])


def sigmoid(z: Column) -> Column:
    """1 / (1 + e^-z), z kept within 20 of 0."""
    return 1 / (1 + F.exp(-F.least(F.greatest(z, F.lit(-20.0)), F.lit(20.0))))


def clamp(x: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(x, F.lit(lo)), F.lit(hi))


def with_temperature(p: Column, temperature: Column | float) -> Column:
    """The probability p with its logit divided by a temperature."""
    q = clamp(p, 1e-7, 1 - 1e-7)
    return sigmoid(F.log(q / (1 - q)) / temperature)


def effective_threshold(temperature: Column) -> Column:
    return clamp(F.lit(0.92) / temperature, 0.5, 0.95)


def state(score: Column, dead: float = 0.80, alive: float = 0.15) -> Column:
    """One of five states by cut-offs relative to two thresholds, in this order."""
    return (
        F.when(score >= dead, "DefinitelyDead").when(score >= 0.8 * dead, "ProbablyDead").when(score <= alive, "DefinitelyAlive").when(score <= 1.5 * alive, "ProbablyAlive").otherwise("Unknown")
    )


def mean_present(*scores: Column) -> Column:
    """The mean of the scores that aren't null; null if all are."""
    total, n = F.lit(0.0), F.lit(0)
    for s in scores:
        total, n = total + F.coalesce(s, F.lit(0.0)), n + s.isNotNull().cast("int")
    return F.when(n > 0, total / n)


def text_features(source: Column, name: Column, complexity: Column, n_params: Column, n_returns: Column, is_async: Column, is_public: Column) -> Column:
    """The 13 features by which bodies are compared."""
    rows = t.lines(source)
    comments = F.size(F.filter(rows, lambda x: F.ltrim(x).startswith("//") | F.ltrim(x).startswith("/*")))
    words = F.size(F.array_remove(F.split(source, "[ \t\n\r\f]+"), ""))
    return F.array(
        words / 1000.0, F.size(rows) / 100.0, complexity / 50.0, n_params / 10.0, n_returns / 5.0, is_async.cast("double"), is_public.cast("double"), (n_params + n_returns) / 10.0,
        t.counts_of(source, t.CONTROL_FLOW) / 20.0, t.counts_of(source, t.ERRORS) / 10.0, comments / 50.0, t.counts_of(source, t.TYPES) / 10.0, F.length(name) / 50.0,
    )


def structural_score(n_params: tuple, n_returns: tuple, same_returns: Column, complexity: tuple, same_flags: Column, names: tuple) -> Column:
    """Parameters .20, returns .15, complexity .20, flags .05, names .40; 0 for two trivial functions."""
    (pa, pb), (ra, rb), (ca, cb) = n_params, n_returns, complexity
    params = F.when((pa == 0) & (pb == 0), 0.0).when(pa == pb, 0.20).otherwise(F.greatest(1 - F.abs(pa - pb) / 10.0, F.lit(0.0)) * 0.20)
    returns = F.when((ra > 0) & (rb > 0), same_returns / F.greatest(ra, rb) * 0.15).otherwise(0.0)
    diff = F.abs(ca - cb)
    close = F.when((diff <= 1) & (ca > 1), 0.20).when((diff <= 3) & (ca > 1), 0.10).otherwise(0.0)
    score = params + returns + close + same_flags.cast("double") * 0.05 + t.levenshtein_ratio(*names) * 0.40
    return F.when((ca <= 1) & (cb <= 1) & (pa == 0) & (pb == 0), 0.0).otherwise(score)


def semantic_score(n_params: tuple, return_similarity: Column, names: tuple) -> Column:
    """Parameters .25, returns .15, names .30, category .30; 0 if the names' purposes differ."""
    diff = F.abs(n_params[0] - n_params[1])
    params = F.when(diff <= 1, 0.25).when(diff <= 2, 0.12).otherwise(0.0)
    same = (t.category(names[0]) == t.category(names[1])).cast("double")
    return F.when(t.purpose(names[0]) == t.purpose(names[1]), params + return_similarity * 0.15 + t.levenshtein_ratio(*names) * 0.30 + same * 0.30).otherwise(0.0)


def pair_vector(a: Column, b: Column, *equal: Column) -> Column:
    """Both vectors, their absolute differences and flags as one vector."""
    return F.concat(a, b, F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.array(*[e.cast("double") for e in equal]))


def valid_vector(v: Column, length: int) -> Column:
    """Whether a feature vector has its length and only finite numbers."""
    return (F.size(v) == length) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
