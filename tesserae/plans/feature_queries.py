"""Queries of the feature registry: every function's whole vector, the registry itself, and what is learned from both."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.functions import features as f
from tesserae.functions.vectors import LANGUAGES
from tesserae.operators import graph, model
from tesserae.plans.frames import CALLS_SQL, FAN_SQL, FUNCTIONS_SQL, calls, functions
from tesserae.plans.registry import query, table

# What the made-up facts take turns in, so that every feature is met: texts in sources, parts and ends of files.
SNIPPETS = [" ".join(way) for ways in f.SOURCE_SHOWS.values() for way in ways] + ["fn a() {\nif x {\n}}\n} {\n", "private", ""]
FILES = [f"src{part}a.rs" for parts, _ in f.FILE_PARTS.values() for part in parts] + [f"src/a{tail}" for _, tails in f.FILE_PARTS.values() for tail in tails] + ["Button.tsx", "a.go", "a.dart"]
NAMES = ["init", "build", "useState", "dispose", "Panel", "static_self"]
MARKS = [f"@{w.title()}" for w in f.DECORATORS] + ["abstract", "override"]
TYPES = ["Result<X>", "int", "Widget"]


def _pick(values: list[str], by) -> F.Column:  # noqa: ANN001
    return F.element_at(F.array(*map(F.lit, values)), (by % len(values) + 1).cast("int"))


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as functions with all facts that features are made of; a document with the part's number is the source."""
    node = F.col("node")
    own = functions(spark, sf_dir).join(graph.fan(calls(spark, sf_dir)), "node", "left").join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("node"), "text", "lang"), "node", "left")
    name = F.when(node % 3 == 0, _pick(NAMES, node)).otherwise(F.col("name"))
    made = own.withColumns({
        "name": name, "file": _pick(FILES, node), "language": _pick([*LANGUAGES, "zig"], node), "source": F.concat(F.col("text"), F.lit("\n"), _pick(SNIPPETS, node)), "trait_impl": F.when(node % 4 == 0, _pick(TYPES, node)),
        "container": F.when(node % 5 < 2, _pick(TYPES, node)), "params": F.when(node % 2 == 0, F.array(_pick(["self", "&mut self", "*x"], node), F.lit("y"))), "returns": F.when(node % 7 == 0, F.array(_pick(TYPES, node))),
        "decorators": F.when(node % 2 == 1, F.array(_pick(MARKS, node))), "depth": node % 14, "is_cycle": node % 6 == 0, "is_async": node % 8 == 0, "is_method": node % 5 < 2, "is_trait_method": node % 9 == 0,
    })
    return f.with_facts(made)


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _pick_sql(values: list[str], by: str = "node") -> str:
    return f"([{', '.join(map(_q, values))}])[{by} % {len(values)} + 1]"


FACTS_SQL = f"""{CALLS_SQL}, {FAN_SQL}, {FUNCTIONS_SQL}, raw AS (SELECT functions.node, CASE WHEN node % 3 = 0 THEN {_pick_sql(NAMES)} ELSE name END AS name, {_pick_sql(FILES)} AS file, {_pick_sql([*LANGUAGES, "zig"])} AS language, lang, complexity, is_public, doc,
  coalesce(text || chr(10) || {_pick_sql(SNIPPETS)}, '') AS source, CASE WHEN node % 4 = 0 THEN {_pick_sql(TYPES)} END AS trait_impl, CASE WHEN node % 5 < 2 THEN {_pick_sql(TYPES)} END AS container, CASE WHEN node % 7 = 0 THEN {_pick_sql(TYPES)} ELSE '' END AS ret,
  CASE WHEN node % 2 = 0 THEN {_pick_sql(["self", "&mut self", "*x"])} ELSE '' END AS param, CASE WHEN node % 2 = 1 THEN {_pick_sql(MARKS)} ELSE '' END AS mark, coalesce(fan_in, 0) AS i, coalesce(fan_out, 0) AS o
  FROM functions LEFT JOIN fan USING (node) LEFT JOIN documents ON doc_id = node),
x AS (SELECT *, list_filter(list_transform(CASE WHEN source = '' THEN []::VARCHAR[] ELSE regexp_split_to_array(regexp_replace(source, '\\r?\\n$', ''), '\\r?\\n') END, lambda l: contains(l, '{{')::INT - contains(l, '}}')::INT), lambda s: s <> 0) AS steps FROM raw)"""


def _shows_sql(name: str) -> str:
    ways = " OR ".join("(" + " AND ".join(f"contains(source, {_q(p)})" for p in way) + ")" for way in f.SOURCE_SHOWS[name])
    return f"({ways}) AND NOT contains(source, {_q(f.SOURCE_EXCLUDES[name])})" if name in f.SOURCE_EXCLUDES else ways


def _file_sql(name: str) -> str:
    parts, tails = f.FILE_PARTS[name]
    return " OR ".join([f"contains(file, {_q(p)})" for p in parts] + [f"ends_with(file, {_q(p)})" for p in tails])


def _registry_sql() -> list[tuple[str, str, str]]:
    """Name, category and SQL of each feature in the vector's order; only the lists of words and patterns are the registry's own."""
    cap = lambda e, most: f"least(({e}) / {most}.0, 1)"
    shown = lambda category, names: [(n, category, _shows_sql(n)) for n in names.split()]
    never = lambda category, names: [(n, category, "false") for n in names.split()]
    sums = "list_transform(range(1, len(steps) + 1), lambda i: list_sum(steps[1:i]))"
    received = "param IN ('self', '&mut self')"
    out = [("fan_in", "Graph", cap("i", 50)), ("fan_out", "Graph", cap("o", 50)), ("call_depth", "Graph", cap("node % 14", 10)), ("is_cycle", "Graph", "node % 6 = 0")]
    out += [("param_count", "Signature", cap("CASE WHEN param <> '' THEN 2 ELSE 0 END", 10)), ("return_count", "Signature", cap("(ret <> '')::INT", 5)), ("is_public", "Signature", "is_public"), ("is_async", "Signature", "node % 8 = 0"), *shown("Signature", "is_generator")]
    out += [("is_static", "Signature", "contains(mark, 'staticmethod') OR contains(mark, 'classmethod') OR contains(name, 'static')"), ("is_abstract", "Signature", "contains(mark, 'abstract') OR node % 9 = 0"), ("is_override", "Signature", "contains(mark, 'override') OR trait_impl IS NOT NULL OR node % 9 = 0")]
    deepest = f"coalesce(list_max(list_transform(range(1, len(steps) + 1), lambda i: list_sum(steps[1:i]) - least(0, list_min(({sums})[1:i])))), 0)"
    line_count = "CASE WHEN source = '' THEN 0 ELSE len(regexp_split_to_array(regexp_replace(source, '\\r?\\n$', ''), '\\r?\\n')) END"
    out += [("cyclomatic_complexity", "Complexity", cap("complexity", 50)), ("cognitive_complexity", "Complexity", cap(deepest, 20)), ("line_count", "Complexity", cap(line_count, 100)), ("token_count", "Complexity", cap("len(list_filter(regexp_split_to_array(source, '[ \\t\\n\\r\\f]+'), lambda w: w <> ''))", 500))]
    out += [(f"contains_{w}", "Name", f"contains(lower(name), '{w}')") for w in f.NAME_HOLDS] + [(f"starts_with_{w}", "Name", f"starts_with(name, '{w}')") for w in f.NAME_STARTS] + [(f"ends_with_{w}", "Name", f"ends_with(name, '{w}')") for w in f.NAME_ENDS]
    out += [("name_length", "Name", cap("strlen(name)", 50))] + [(f"is_{x}", "Language", f"language = '{x}'") for x in LANGUAGES]
    out += shown("Framework", "is_flask_route is_fastapi_route is_express_route is_nextjs_route is_spring_controller is_aspnet_controller is_laravel_controller is_django_view is_rails_action")
    out += [("is_react_component", "Framework", "regexp_matches(name, '^[A-Z]') AND ends_with(file, '.tsx')"), ("is_react_hook", "Framework", "regexp_matches(name, '^use[A-Z]')"), *never("Framework", "is_vue_component is_svelte_component")]
    out += [("is_flutter_widget", "Framework", "name = 'build' AND ends_with(file, '.dart') AND coalesce(contains(trait_impl, 'Widget'), false)"), ("is_flutter_state", "Framework", "name = 'dispose' AND ends_with(file, '.dart')"), ("is_go_init", "Framework", "name = 'init' AND ends_with(file, '.go')")]
    out += [("is_go_interface", "Framework", "trait_impl IS NOT NULL AND ends_with(file, '.go')"), *shown("Framework", "is_go_goroutine"), ("is_rust_trait_impl", "Framework", "trait_impl IS NOT NULL AND ends_with(file, '.rs')"), *shown("Framework", "is_rust_ffi")]
    out += [("is_method", "Type", "node % 5 < 2"), ("is_trait_impl", "Type", "container IS NOT NULL"), ("is_associated", "Type", "trait_impl IS NOT NULL"), ("has_receiver", "Type", f"{received} OR (ends_with(file, '.go') AND contains(param, '*'))"), ("has_self", "Type", f"{received} OR contains(name, 'self')")]
    out += [("type_name_length", "Type", "coalesce(strlen(container), 0) / 20.0"), ("trait_name_length", "Type", "coalesce(strlen(trait_impl), 0) / 20.0"), ("type_and_trait_match", "Type", "coalesce(container = trait_impl, false)"), *shown("Generics", "has_generics")]
    out += [("generic_count", "Generics", cap("length(source) - length(replace(source, '<', ''))", 5)), *shown("Type", "has_type_annotation has_lifetime")] + [(n, "File", _file_sql(n)) for n in f.FILE_PARTS] + [(f"has_decorator_{w}", "Decorator", f"contains(lower(mark), '{w}')") for w in f.DECORATORS]
    out += shown("Dynamic", "has_dynamic_call has_ffi has_macro has_closure has_yield has_await") + shown("Concurrency", "has_thread") + shown("ErrorHandling", "has_try_catch") + [("has_result_type", "ErrorHandling", "contains(ret, 'Result')")]
    out += shown("ErrorHandling", "has_throw has_panic has_question_mark has_error_propagation") + [("has_doc_comment", "Documentation", "doc IS NOT NULL"), ("doc_comment_length", "Documentation", cap("coalesce(strlen(doc), 0)", 100)), *never("Documentation", "has_attr_doc")]
    out += never("Visibility", "vis_pub_crate vis_pub_super vis_pub_self") + [("vis_private", "Visibility", "NOT is_public"), *never("Visibility", "vis_protected")] + shown("Ownership", "has_borrow has_mut_ref has_move has_clone")
    return out + never("Pattern", "pattern_singleton pattern_factory pattern_builder pattern_observer pattern_strategy pattern_decorator") + shown("Concurrency", "has_channel has_mutex has_atomic has_parallel")


REGISTRY = _registry_sql()
_ALL = ", ".join(f"round(({e})::DOUBLE, 6) AS {n}" for n, _, e in REGISTRY)
_PLACES = "r(place, name, category) AS (VALUES " + ", ".join(f"({i}, '{n}', '{c}')" for i, (n, c, _) in enumerate(REGISTRY)) + ")"


@query(f"WITH {FACTS_SQL} SELECT node, {_ALL} FROM x")
def feature_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 224 features of every function, a column each."""
    return facts(spark, sf_dir).select("node", *[F.round(x.value, 6).alias(x.name) for x in f.registry()])


def registered(spark: SparkSession) -> DataFrame:
    """place, name, category of each feature."""
    return spark.createDataFrame([(i, x.name, x.category) for i, x in enumerate(f.registry())], "place int, name string, category string")


@query(f"WITH {_PLACES} SELECT place::INTEGER AS place, name, category FROM r")
def feature_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registered(spark)


@query(f"WITH {_PLACES} SELECT place::INTEGER AS place, name || ':' || category AS ours, CASE WHEN place < 220 THEN 'old_' || name || ':' || category END AS theirs FROM r WHERE category = 'Pattern' OR place >= 220")
def schema_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registry against an older one with other names of patterns and without the last four features."""
    old = registered(spark).filter("place < 220").withColumn("name", F.when(F.col("category") == "Pattern", F.concat(F.lit("old_"), "name")).otherwise(F.col("name")))
    return f.incompatible(registered(spark), old)


_UNPIVOTED = f"v AS (SELECT lang, node % 2 AS y, {_ALL} FROM x WHERE lang IS NOT NULL), u AS (UNPIVOT v ON COLUMNS(* EXCLUDE (lang, y)) INTO NAME name VALUE value)"


@query(f"""WITH {FACTS_SQL}, {_UNPIVOTED}, g AS (SELECT lang, name, round(avg(value) FILTER (WHERE y = 1), 6) AS alive, round(avg(value) FILTER (WHERE y = 0), 6) AS dead FROM u GROUP BY ALL) SELECT *, round(coalesce(alive, 0) - coalesce(dead, 0), 6) AS gap FROM g""")
def feature_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By language and feature: the mean of living functions, of dead ones, and what lies between."""
    registry = f.registry()
    values = facts(spark, sf_dir).filter("lang is not null").select("lang", (F.col("node") % 2).alias("y"), f.feature_vector(registry).alias("vector"))
    g = model.feature_gaps(values, ["lang"], "y", "vector", [x.name for x in registry])
    return g.select("lang", "name", F.round("alive", 6).alias("alive"), F.round("dead", 6).alias("dead")).withColumn("gap", F.round(F.coalesce("alive", F.lit(0.0)) - F.coalesce("dead", F.lit(0.0)), 6))


_WEIGHT = "((place * 37 % 101) - 50) / 50.0"


@query(f"WITH {_PLACES} SELECT category, count(*)::BIGINT AS n, round(avg(abs({_WEIGHT}::DOUBLE)), 6) AS mean_weight, arg_max(name, (abs({_WEIGHT}), -place)) AS strongest FROM r GROUP BY category")
def weight_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean absolute weight and strongest feature of each category, for a made-up model."""
    weights = registered(spark).withColumn("weight", (F.col("place") * 37 % 101 - 50) / 50.0)
    return model.weight_by_category(weights).withColumn("mean_weight", F.round("mean_weight", 6))


@query(f"WITH {_PLACES} SELECT name, abs({_WEIGHT})::DOUBLE AS size FROM r ORDER BY size DESC, place LIMIT 20")
def strongest_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 features of most absolute weight."""
    weights = registered(spark).withColumn("weight", (F.col("place") * 37 % 101 - 50) / 50.0)
    return weights.select("name", F.abs("weight").alias("size"), "place").orderBy(F.desc("size"), "place").limit(20).drop("place")


@query()
def train_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fits on one part of the functions, calibrates on half of another, tunes the threshold on its rest; the frozen model's figures."""
    names = ["line_count", "token_count", "name_length", "cyclomatic_complexity"]
    of = {x.name: x.value for x in f.registry()}
    rows = facts(spark, sf_dir).select(F.col("node").alias("id"), (F.col("complexity") > 25).cast("int").alias("y"), *[of[n].alias(n) for n in names])
    held = F.pmod(F.xxhash64("id"), F.lit(4)) == 0
    m = model.train(rows.filter(~held), rows.filter(held), names, least_precision=0.9, steps=15)
    ok = not model.problems(m)[0]
    return spark.createDataFrame([(len(m["weights"]), m["threshold"], m["temperature"], ok)], "n_weights int, threshold double, temperature double, passed boolean")
