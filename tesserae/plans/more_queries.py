"""Queries of hierarchies, histories, references and comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.functions import frameworks
from tesserae.operators import hierarchy, learn, references
from tesserae.plans.frames import FUNCTIONS_SQL, functions
from tesserae.plans.learn_queries import S, rounded, scored
from tesserae.plans.registry import query, table

EXTENDS = "e AS (SELECT c_custkey AS src, c_custkey // 3 AS dst FROM customer WHERE c_custkey > 0 AND c_custkey % 7 <> 0)"


def extends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as types; each extends the one of a third of its number."""
    return table(spark, sf_dir, "customer").filter("c_custkey > 0 and c_custkey % 7 != 0").select(F.col("c_custkey").alias("src"), F.floor(F.col("c_custkey") / 3).alias("dst"))


@query(f"""WITH RECURSIVE {EXTENDS}, w AS (SELECT dst AS node, 0 AS depth FROM e WHERE dst NOT IN (SELECT src FROM e) UNION SELECT e.src, depth + 1 FROM w JOIN e ON e.dst = w.node)
SELECT node, min(depth)::INTEGER AS depth FROM w GROUP BY node""")
def inheritance_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.inheritance_depth(extends(spark, sf_dir))


@query(f"WITH {EXTENDS} SELECT dst AS node, count(DISTINCT src)::BIGINT AS n_direct FROM e GROUP BY dst")
def subtype_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.subtype_counts(extends(spark, sf_dir))


@query(f"WITH {EXTENDS} SELECT src AS node FROM e EXCEPT SELECT dst FROM e")
def leaf_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.leaves(extends(spark, sf_dir))


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as commits of customers' files by priority."""
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_custkey").alias("file"), F.col("o_orderpriority").alias("author"), F.col("o_orderdate").alias("at"), (F.col("o_orderkey") % 100).alias("added"), (F.col("o_orderkey") % 7).alias("removed"))


@query("""SELECT o_custkey AS file, count(*)::BIGINT AS n_commits, count(DISTINCT o_orderpriority)::BIGINT AS n_authors, strftime(min(o_orderdate), '%Y-%m-%d') AS first, strftime(max(o_orderdate), '%Y-%m-%d') AS last, sum(o_orderkey % 100 + o_orderkey % 7)::BIGINT AS churn FROM orders GROUP BY 1""")
def file_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.history(commits(spark, sf_dir)).withColumns({c: F.date_format(c, "yyyy-MM-dd") for c in ("first", "last")})


@query("SELECT o_orderpriority AS author, count(*)::BIGINT AS n FROM orders GROUP BY 1 ORDER BY n DESC, author LIMIT 3")
def top_authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.top_authors(commits(spark, sf_dir), 3)


@query(f"WITH {FUNCTIONS_SQL} SELECT file, count(*)::BIGINT AS n FROM functions GROUP BY file HAVING NOT bool_or(is_public)")
def dead_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.dead_modules(functions(spark, sf_dir))


@query(r"""WITH r AS (SELECT page_id, 'registration' AS kind, unnest(regexp_extract_all(html, 'register\w*\(\s*[''"]?(\w+)', 1)) AS target FROM pages UNION ALL SELECT page_id, 'event', unnest(regexp_extract_all(html, '\.(?:on|addEventListener|subscribe)\(\s*[''"](\w+)[''"]', 1)) FROM pages
UNION ALL SELECT page_id, 'link', unnest(regexp_extract_all(html, 'href="/([^"]+)"', 1)) FROM pages UNION ALL SELECT page_id, 'table', unnest(regexp_extract_all(html, '[''"]\w+[''"]\s*:\s*([A-Za-z_]\w*)\s*[,}]', 1)) FROM pages UNION ALL SELECT page_id, 'dynamic_import', unnest(regexp_extract_all(html, '(?:import|require)\(\s*[''"]([^''"]+)[''"]\s*\)', 1)) FROM pages)
SELECT page_id AS file, kind, target, count(*)::BIGINT AS n FROM r WHERE target <> '' GROUP BY ALL""")
def dynamic_reference_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").select(F.col("page_id").alias("path"), F.lit("javascript").alias("language"), F.col("html").alias("source"))
    rules = (*references.RULES, ("link", "*", 'href="/([^"]+)"', 0.5))
    return references.found(p, rules).select("file", "kind", "target", "n")


@query(f"""WITH {FUNCTIONS_SQL}, r AS (SELECT DISTINCT replace(p_name, ' ', '_') AS name FROM part WHERE p_partkey % 100 = 0) SELECT node, 'reflection' AS kind, 0.9::DOUBLE AS confidence FROM functions JOIN r USING (name)""")
def dynamic_ref_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts' functions that a made-up reference of every hundredth part names."""
    refs = table(spark, sf_dir, "part").filter("p_partkey % 100 = 0").select(F.concat(F.lit("a.b."), F.replace("p_name", F.lit(" "), F.lit("_"))).alias("target"), F.lit("reflection").alias("kind"), F.lit(0.9).alias("confidence"))
    return references.matched(refs, functions(spark, sf_dir))


@query(f"""WITH {S}, m AS (SELECT y, p AS model, round((id * 13) % 100 / 100.0, 6)::DOUBLE AS static FROM s), n AS (SELECT 'static' AS name, y, static AS p FROM m UNION ALL SELECT 'model', y, model FROM m UNION ALL SELECT 'fused', y, model * 0.6::DOUBLE + static * 0.4::DOUBLE FROM m)
SELECT name, sum((p >= 0.5 AND y = 1)::BIGINT)::BIGINT AS tp, sum((p >= 0.5 AND y = 0)::BIGINT)::BIGINT AS fp, sum((p < 0.5 AND y = 1)::BIGINT)::BIGINT AS fn, sum((p < 0.5 AND y = 0)::BIGINT)::BIGINT AS tn, round(avg(((p >= 0.5)::INTEGER = y)::INTEGER), 6) AS accuracy FROM n GROUP BY name""")
def model_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = scored(spark, sf_dir).select("y", F.col("p").alias("model"), F.round((F.col("id") * 13) % 100 / 100.0, 6).alias("static"))
    return rounded(learn.compare(d), "accuracy").select("name", "tp", "fp", "fn", "tn", "accuracy")


@query()
def ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.log1p(F.length("text")).alias("n"), (F.length(F.regexp_replace("text", "[A-Za-z ]", "")) / (F.length("text") + 1)).alias("odd"))
    rows = table(spark, sf_dir, "labels").join(d, "doc_id").select(F.col("quality").alias("y"), "n", "odd")
    from tesserae.operators.iterate import written

    return rounded(learn.ablation(written(rows, "examples"), ["n", "odd"], steps=8), "accuracy", "precision", "recall", "fpr", "f1")


# What paths and names take turns in: every pattern of every framework, under its own language and others.
_KINDS = ("roots", "decorators", "annotations", "registrations", "generated", "dynamic")
_PATTERNS = [(f.language, kind, p) for f in frameworks.FRAMEWORKS for kind in _KINDS for p in getattr(f, kind)]
_SHOWN = [p for _, _, p in _PATTERNS]
_SPOKEN = sorted({f.language for f in frameworks.FRAMEWORKS})
_CALLED = [*frameworks.CALLBACKS[:5], "_closed", *[p for _, kind, p in _PATTERNS if kind == "generated"]]


def _listed(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


@query(f"""WITH p(language, kind, pattern) AS (VALUES {", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in _PATTERNS)}),
f AS (SELECT p_partkey AS node, CASE WHEN p_partkey % 2 = 0 THEN ({_listed([a for a, _, _ in _PATTERNS])})[p_partkey % {len(_PATTERNS)} + 1] ELSE ({_listed(_SPOKEN)})[p_partkey % {len(_SPOKEN)} + 1] END AS language, 'src/' || ({_listed(_SHOWN)})[p_partkey % {len(_PATTERNS)} + 1] || '/x' AS file, ({_listed(_CALLED)})[p_partkey % {len(_CALLED)} + 1] AS name FROM part)
SELECT node, EXISTS (SELECT 1 FROM p WHERE p.language = f.language AND ((kind NOT IN ('generated', 'dynamic') AND contains(file, pattern)) OR (kind = 'generated' AND contains(name, pattern)))) AS framework_root, EXISTS (SELECT 1 FROM p WHERE p.language = f.language AND kind IN ('roots', 'decorators') AND contains(file, pattern)) AS marked,
  EXISTS (SELECT 1 FROM p WHERE p.language = f.language AND kind = 'dynamic' AND contains(file, pattern)) AS dynamic, list_contains({_listed(frameworks.CALLBACKS)}, name) AS callback FROM f""")
def framework_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as functions whose paths and names hold the frameworks' patterns in turn, half of them in the pattern's own language."""
    node, c = F.col("p_partkey"), F.col
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (node % len(values) + 1).cast("int"))
    f = table(spark, sf_dir, "part").select(node.alias("node"), F.when(node % 2 == 0, pick([a for a, _, _ in _PATTERNS])).otherwise(pick(_SPOKEN)).alias("language"), F.concat(F.lit("src/"), pick(_SHOWN), F.lit("/x")).alias("file"), pick(_CALLED).alias("name"))
    root, marked, dynamic = frameworks.is_root(c("language"), c("file"), c("name")), frameworks.is_marked(c("language"), c("file")), frameworks.is_dynamic(c("language"), c("file"))
    return f.select("node", root.alias("framework_root"), marked.alias("marked"), dynamic.alias("dynamic"), frameworks.is_callback(c("name")).alias("callback"))
