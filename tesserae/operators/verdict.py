"""From facts about functions to verdicts: signals, static score, fusion, state, conflicts, recommendation, risk.

One projection over functions joined with their reachability and dynamic references; no row leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.functions import vectors as v
from tesserae.operators.order import placed

# Weights of the signals and of fusion.
CORE = {"fan_in": 0.4, "reachability": 0.3, "is_public": 0.2}
OPTIONAL = {"trait_impl": 0.15, "complexity": 0.1, "documentation": 0.1, "dynamic_reference": 0.4}
STATIC_SHARE, ML_SHARE = 0.6, 0.4
FORCED = 0.1


def _signal(name: str, value: Column, dead: Column, weight: float, why: Column) -> Column:
    return F.struct(F.lit(name).alias("name"), value.cast("double").alias("value"), F.when(dead, "dead").otherwise("alive").alias("direction"), F.lit(weight).alias("weight"), why.alias("explanation"))


def signals(fan_in: Column, reachable: Column, is_public: Column, trait_impl: Column, complexity: Column, doc: Column, dynamic: Column) -> Column:
    """The signals that are present, as an array."""
    return F.array_compact(
        F.array(
            _signal("fan_in", F.when(fan_in == 0, 1.0).otherwise(F.least(fan_in / 10.0, F.lit(1.0))), fan_in == 0, 0.4, F.when(fan_in == 0, "No callers found").otherwise(F.concat(fan_in.cast("string"), F.lit(" callers")))),
            _signal("reachability", F.lit(1.0), ~reachable, 0.3, F.when(reachable, "Reachable from entry points").otherwise("Unreachable from entry points")),
            _signal("is_public", F.lit(1.0), ~is_public, 0.2, F.when(is_public, "Public API").otherwise("Private function")),
            F.when(trait_impl.isNotNull(), _signal("trait_impl", F.lit(1.0), F.lit(False), 0.15, F.lit("Trait implementation"))),
            F.when(complexity > 10, _signal("complexity", F.least(complexity / 50, F.lit(1.0)), F.lit(False), 0.1, F.format_string("High complexity (%.1f)", complexity))),
            F.when(doc.isNotNull(), _signal("documentation", F.lit(1.0), F.lit(False), 0.1, F.lit("Has documentation"))),
            F.when(dynamic, _signal("dynamic_reference", F.lit(1.0), F.lit(False), 0.4, F.lit("Dynamically referenced"))),
        )
    )


def static_score(found: Column) -> Column:
    """0 alive to 1 dead: the core signals' signed share mapped to 0..1, less half of the optional ones' share."""
    sized = lambda s: s["weight"] * v.clamp(s["value"], 0.0, 1.0)
    core = F.aggregate(F.filter(found, lambda s: s["name"].isin(*CORE)), F.lit(0.0), lambda a, s: a + F.when(s["direction"] == "dead", sized(s)).otherwise(-sized(s)))
    pull = F.aggregate(F.filter(found, lambda s: s["name"].isin(*OPTIONAL)), F.lit(0.0), lambda a, s: a + sized(s))
    base = v.clamp((core / sum(CORE.values()) + 1) / 2, 0.0, 1.0)
    return v.clamp(base - pull / sum(OPTIONAL.values()) * 0.5, 0.0, 1.0)


def fused(static: Column, ml_dead: Column, dynamic: Column) -> Column:
    """A dynamic reference forces 0.1; with a model, 0.6 static and 0.4 model; else static."""
    return F.when(dynamic, FORCED).when(ml_dead.isNotNull(), static * STATIC_SHARE + ml_dead * ML_SHARE).otherwise(static)


def conflicts(static: Column, ml_dead: Column, dynamic: Column) -> Column:
    """array of struct(description, severity)."""
    said = lambda text, how: F.struct(F.lit(text).alias("description"), F.lit(how).alias("severity"))
    return F.array_compact(
        F.array(
            F.when(dynamic & (ml_dead > 0.7), said("the model says dead, a dynamic reference exists", "Critical")),
            F.when((static > 0.7) & (ml_dead < 0.3), said("static analysis says dead, the model alive", "High")),
        )
    )


def recommendation(state: Column, dynamic: Column, n_critical: Column, n_conflicts: Column) -> Column:
    return (
        F.when(dynamic | (n_critical > 0), "DoNotDelete").when((state == "DefinitelyDead") & (n_conflicts == 0), "SafeToDelete").when(state.isin("DefinitelyDead", "ProbablyDead", "Unknown"), "ReviewRequired").otherwise("DoNotDelete")
    )


def risk(fan_in: Column, fan_out: Column, is_public: Column, complexity: Column) -> Column:
    """struct(removal, complexity, dependency, overall)."""
    removal = F.when(fan_in > 0, "Medium").when(is_public, "High").otherwise("Low")
    impact = F.when(complexity > 20, "High").when(complexity > 10, "Medium").otherwise("Low")
    dependency = F.when(fan_out > 10, "High").when(fan_out > 5, "Medium").otherwise("Low")
    overall = F.when((removal == "High") | (impact == "High"), "High").when((removal == "Medium") | (impact == "Medium"), "Medium").otherwise("Low")
    return F.struct(removal.alias("removal"), impact.alias("complexity"), dependency.alias("dependency"), overall.alias("overall"))


def effort(loc: Column, complexity: Column) -> Column:
    return F.when((loc > 100) | (complexity > 20), "High (1-2 days)").when((loc > 50) | (complexity > 10), "Medium (2-4 hours)").otherwise("Low (30 min - 1 hour)")


def explanation(found: Column, state: Column, score: Column) -> Column:
    return F.concat_ws(" | ", state, F.format_string("score %.2f", score), F.array_join(F.transform(found, lambda s: F.concat(s["name"], F.lit(": "), s["explanation"])), "; "))


def verdicts(functions: DataFrame, dead: float = 0.80, alive: float = 0.15) -> DataFrame:
    """functions (node, fan_in, fan_out, reachable, is_public, trait_impl, complexity, doc, dynamic, ml_dead) with all of a verdict's columns."""
    c = F.col
    out = functions.withColumn("signals", signals(c("fan_in"), c("reachable"), c("is_public"), c("trait_impl"), c("complexity"), c("doc"), c("dynamic")))
    out = out.withColumn("static_score", static_score(c("signals")))
    out = out.withColumn("dead_score", fused(c("static_score"), c("ml_dead"), c("dynamic"))).withColumn("state", v.state(c("dead_score"), dead, alive))
    out = out.withColumn("conflicts", conflicts(c("static_score"), c("ml_dead"), c("dynamic")))
    n_critical = F.size(F.filter("conflicts", lambda x: x["severity"] == "Critical"))
    out = out.withColumn("recommendation", recommendation(c("state"), c("dynamic"), n_critical, F.size("conflicts")))
    out = out.withColumn("confidence", F.when(c("state") == "Unknown", 0.5).when(c("state").endswith("Dead"), c("dead_score")).otherwise(1 - c("dead_score")))
    return out.withColumn("risk", risk(c("fan_in"), c("fan_out"), c("is_public"), c("complexity"))).withColumn("explanation", explanation(c("signals"), c("state"), c("dead_score")))


def stats(v_: DataFrame) -> DataFrame:
    """One row: totals by state, ratio of dead, counts by recommendation."""
    is_state = lambda s: F.coalesce(F.sum((F.col("state") == s).cast("bigint")), F.lit(0))
    dead = F.coalesce(F.sum(F.col("state").isin("DefinitelyDead", "ProbablyDead").cast("bigint")), F.lit(0))
    n = F.count(F.lit(1))
    return v_.agg(
        n.alias("total"), is_state("DefinitelyDead").alias("definitely_dead"), is_state("ProbablyDead").alias("probably_dead"), is_state("Unknown").alias("unknown"), is_state("ProbablyAlive").alias("probably_alive"),
        is_state("DefinitelyAlive").alias("definitely_alive"), F.when(n > 0, dead / n).otherwise(0.0).alias("dead_ratio"), F.coalesce(F.sum((F.col("recommendation") == "SafeToDelete").cast("bigint")), F.lit(0)).alias("safe"),
    )


def impact(dead: DataFrame, edges: DataFrame, facts: DataFrame) -> DataFrame:
    """node, impact: a dead function's complexity and a tenth of its callees'; facts: (node, complexity)."""
    callee = facts.select(F.col("node").alias("dst"), F.col("complexity").alias("c"))
    tail = edges.join(callee, "dst").groupBy(F.col("src").alias("node")).agg(F.sum(0.1 * F.col("c")).alias("tail"))
    return dead.join(facts, "node").join(tail, "node", "left").select("node", (F.col("complexity") + F.coalesce("tail", F.lit(0.0))).alias("impact"))


def removal_order(v_: DataFrame, key: str = "node") -> DataFrame:
    """key, place: every dead function, by falling score and then by key."""
    dead = v_.filter(F.col("state").isin("DefinitelyDead", "ProbablyDead")).select(key, F.round("dead_score", 6).alias("s"))
    return placed(dead, F.desc("s"), F.asc(key)).select(key, "place")


def gate(v_: DataFrame, most_dead: int, most_ratio: float) -> DataFrame:
    """One row: n_dead, ratio, passed."""
    dead = F.coalesce(F.sum(F.col("state").isin("DefinitelyDead", "ProbablyDead").cast("bigint")), F.lit(0))
    one = v_.agg(dead.alias("n_dead"), F.when(F.count(F.lit(1)) > 0, dead / F.count(F.lit(1))).otherwise(0.0).alias("ratio"))
    return one.withColumn("passed", (F.col("n_dead") <= most_dead) & (F.col("ratio") <= most_ratio))
