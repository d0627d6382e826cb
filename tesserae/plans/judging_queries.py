"""Queries of the small judgements: names, reasons, labels, comments, confidences, styles, and the counts over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.functions import judging as j
from tesserae.functions import rules
from tesserae.functions import text as t
from tesserae.operators import dedup, graph, hierarchy, state
from tesserae.plans.dedup_queries import CLUSTER_SQL, _lsh_sql, docs
from tesserae.plans.frames import CALLS_SQL, FAN_SQL, FUNCTIONS_SQL, calls, functions
from tesserae.plans.more_queries import EXTENDS, extends
from tesserae.plans.registry import query, table
from tesserae.plans.state_queries import MUTATIONS, mutations
from tesserae.plans.verdict_queries import VERDICT_SQL, verdicts


def _first_sql(text: str, rows: list[tuple[str, tuple[str, ...]]], fits: str, otherwise: str) -> str:
    whens = " ".join(f"WHEN {' OR '.join(f'{fits}({text}, {chr(39)}{w}{chr(39)})' for w in words)} THEN '{value}'" for value, words in rows)
    return f"CASE {whens} ELSE '{otherwise}' END"


def _holds_sql(text: str, words: tuple[str, ...], fits: str = "contains") -> str:
    return "(" + " OR ".join(f"{fits}({text}, '{w}')" for w in words) + ")"


@query(f"""WITH {FUNCTIONS_SQL}, n AS (SELECT node, name, {_first_sql('lower(name)', j.ROLES, 'contains', 'Unknown')} AS role, {_first_sql('lower(name)', j.ACTIONS, 'starts_with', 'Performs')} AS action, nullif(split_part(name, '_', 2), '') AS subject FROM functions)
SELECT node, role, action, subject, action || ' ' || coalesce(subject, 'data') || ' and returns text' AS purpose, {_holds_sql('name', j.SNIPPETS)} AS snippet, {_holds_sql('name', j.GENERATORS)} OR ends_with(name, 'Factory') AS generator,
  {_holds_sql('name', j.COMMANDS)} AS command, {_holds_sql('name', j.TEST_NAMES, 'starts_with')} AS test_name FROM n""")
def name_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("name")
    return functions(spark, sf_dir).select("node", j.role(n).alias("role"), j.action(n).alias("action"), j.subject(n).alias("subject"), j.purpose(n, F.lit("text")).alias("purpose"), j.is_snippet(n).alias("snippet"), j.is_generator(n).alias("generator"), j.is_command(n).alias("command"), j.is_test_name(n).alias("test_name"))


LEVEL_SQL = """CASE WHEN file LIKE '%\\_test.rs' ESCAPE '\\' THEN 'Protected' WHEN trait_impl IS NOT NULL THEN 'Protected' WHEN is_public THEN 'LikelyAlive' WHEN starts_with(name, 'get_') THEN 'LikelyAlive' ELSE 'Candidate' END"""


@query(f"""WITH {CALLS_SQL}, {FAN_SQL}, {FUNCTIONS_SQL}, f AS (SELECT functions.*, coalesce(fan_in, 0) AS i, coalesce(fan_out, 0) AS o, {LEVEL_SQL} AS level FROM functions LEFT JOIN fan USING (node))
SELECT node, level, CASE WHEN level = 'Protected' THEN 'protected: ' || CASE WHEN trait_impl IS NOT NULL THEN 'trait_implementation' ELSE 'ffi_or_framework' END
  WHEN level = 'LikelyAlive' THEN 'likely_alive: ' || CASE WHEN is_public THEN 'public_api' WHEN i > 0 THEN 'has_callers' WHEN o > 0 THEN 'participates_in_call_flow' ELSE 'conventional_api_shape' END END AS reason,
  level = 'Protected' AS never_dead, level <> 'Candidate' AS likely_alive, level = 'Candidate' AS actionable, level = 'Candidate' AND (is_public OR complexity > 10) AS review_first FROM f""")
def review_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    f = functions(spark, sf_dir).join(graph.fan(calls(spark, sf_dir)), "node", "left").withColumn("level", rules.protection(c("name"), c("file"), c("is_test"), c("trait_impl"), c("is_public"), c("doc")))
    why = j.protection_reason(c("level"), c("file"), c("name"), c("is_test"), c("trait_impl"), c("is_public"), F.coalesce("fan_in", F.lit(0)), F.coalesce("fan_out", F.lit(0)))
    return f.select("node", "level", why.alias("reason"), j.is_never_dead(c("level")).alias("never_dead"), j.is_likely_alive(c("level")).alias("likely_alive"), j.is_actionable(c("level")).alias("actionable"), j.review_first(c("level"), c("is_public"), c("complexity")).alias("review_first"))


_SOURCE_NAMES = [r[0] for r in j.LABEL_SOURCES]
_SOURCES_SQL = ", ".join(f"({i}, '{n}', {w}::DOUBLE, {m}::DOUBLE, {p})" for i, (n, w, m, p) in enumerate(j.LABEL_SOURCES))
EXAMPLES_SQL = f"""k(i, label_source, weight, multiplier, priority) AS (VALUES {_SOURCES_SQL}),
ex AS (SELECT doc_id, k.*, CASE WHEN toxic = 1 THEN 'Unknown' WHEN quality = 1 THEN 'Alive' ELSE 'Dead' END AS label, lang FROM labels JOIN documents USING (doc_id) JOIN k ON doc_id % 7 = k.i)"""


def examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents as training examples; the source of a label goes by doc_id."""
    d = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    source = F.element_at(F.array(*map(F.lit, _SOURCE_NAMES)), (F.col("doc_id") % 7 + 1).cast("int"))
    label = F.when(F.col("toxic") == 1, "Unknown").when(F.col("quality") == 1, "Alive").otherwise("Dead")
    return d.select("doc_id", source.alias("label_source"), label.alias("label"), "lang")


@query(f"""WITH {EXAMPLES_SQL} SELECT label_source, weight, multiplier, priority::INTEGER AS priority, count(*)::BIGINT AS n, sum((label = 'Unknown')::BIGINT)::BIGINT AS n_unknown, sum((label <> 'Unknown' AND priority >= 4)::BIGINT)::BIGINT AS n_trainable, sum((label <> 'Unknown' AND priority >= 3)::BIGINT)::BIGINT AS n_experimental,
  priority >= 4 AS verified, priority < 4 AS heuristic FROM ex GROUP BY ALL""")
def label_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, label = F.col("label_source"), F.col("label")
    n = lambda cond: F.sum(cond.cast("bigint"))
    g = examples(spark, sf_dir).groupBy("label_source").agg(F.count(F.lit(1)).alias("n"), n(label == "Unknown").alias("n_unknown"), n(j.is_trainable(s, label)).alias("n_trainable"), n(j.is_trainable(s, label, silver=True)).alias("n_experimental"))
    return g.select("*", j.training_weight(s).alias("weight"), j.confidence_multiplier(s).alias("multiplier"), j.label_priority(s).alias("priority"), j.is_verified(s).alias("verified"), (~j.is_verified(s)).alias("heuristic"))


@query(f"""WITH {EXAMPLES_SQL} SELECT label, lang, count(*)::BIGINT AS n, round(avg(weight), 6) AS mean_weight FROM ex GROUP BY CUBE (label, lang)""")
def training_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Examples by label, by language, by both and in all."""
    return examples(spark, sf_dir).cube("label", "lang").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(j.training_weight(F.col("label_source"))), 6).alias("mean_weight"))


@query(f"""WITH {EXAMPLES_SQL} SELECT count(*) FILTER (WHERE priority >= 4)::BIGINT AS n_verified, count(*) FILTER (WHERE priority >= 4) >= 100 AS enough FROM ex""")
def verified_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.coalesce(F.sum(j.is_verified(F.col("label_source")).cast("bigint")), F.lit(0))
    return examples(spark, sf_dir).agg(n.alias("n_verified")).withColumn("enough", F.col("n_verified") >= 100)


@query(f"""WITH l AS (SELECT lang, unnest(string_split(lower(text), chr(10))) AS line FROM documents WHERE text IS NOT NULL), k AS (SELECT lang, {_first_sql('line', j.COMMENTS, 'contains', 'Line')} AS kind FROM l)
SELECT lang, kind, count(*)::BIGINT AS n, kind IN ('Todo', 'FIXME', 'HACK') AS action_item FROM k GROUP BY ALL""")
def comment_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents as comments by language and kind, and whether the kind asks for action."""
    lines = table(spark, sf_dir, "documents").filter("text is not null").select("lang", F.explode(F.split("text", "\n")).alias("line"))
    return lines.groupBy("lang", j.comment_kind(F.col("line")).alias("kind")).agg(F.count(F.lit(1)).alias("n")).withColumn("action_item", F.col("kind").isin(*j.ACTION_ITEMS))


@query(f"""WITH {FUNCTIONS_SQL}, g AS (SELECT file, sum(is_public::INTEGER) AS exports FROM functions GROUP BY file) SELECT file, round(0.8::DOUBLE * CASE WHEN exports > 5 THEN 0.9 ELSE 1 END * CASE WHEN ends_with(file, '_test.rs') THEN 0.5 ELSE 1 END, 6) AS confidence FROM g""")
def file_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = functions(spark, sf_dir).groupBy("file").agg(F.sum(F.col("is_public").cast("int")).alias("exports"))
    return g.select("file", F.round(j.file_dead_confidence(F.col("file"), F.col("exports")), 6).alias("confidence"))


@query(f"""WITH RECURSIVE {VERDICT_SQL} SELECT node, (10 + floor(dead_score * 20) + floor(complexity / 5))::INTEGER AS size, CASE WHEN trait_impl IS NOT NULL THEN '#2ecc71' WHEN state IN ('DefinitelyDead', 'ProbablyDead') THEN '#e74c3c' WHEN is_public THEN '#3498db' WHEN dead_score > 0.7 THEN '#f39c12' ELSE '#95a5a6' END AS colour,
  CASE WHEN state IN ('DefinitelyDead', 'ProbablyDead') THEN CASE WHEN complexity > 20 OR (fan_in = 0 AND is_public) THEN 'Proceed with caution: high risk, requires careful review' WHEN complexity > 10 OR fan_in > 0 THEN 'Consider removing: medium risk, review dependencies' ELSE 'Safe to remove: low risk, low impact' END
  WHEN state IN ('DefinitelyAlive', 'ProbablyAlive') THEN 'Function is alive: keep as is' ELSE 'Unknown: investigate manually' END AS advice FROM v""")
def node_styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    dead = c("state").endswith("Dead")
    colour = j.node_colour(F.lit(False), c("trait_impl"), dead, c("is_public"), c("dead_score"), F.lit(""))
    return verdicts(spark, sf_dir).select("node", j.node_size(c("dead_score"), c("complexity")).alias("size"), colour.alias("colour"), j.advice(c("state"), c("risk.overall")).alias("advice"))


@query(f"""WITH RECURSIVE {VERDICT_SQL} SELECT state, count(*)::BIGINT AS n, round(avg(dead_score), 6) AS mean_score, round(sum(complexity), 6) AS complexity, max(fan_in)::BIGINT AS most_callers FROM v GROUP BY state""")
def analysis_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts(spark, sf_dir).groupBy("state").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("dead_score"), 6).alias("mean_score"), F.round(F.sum("complexity"), 6).alias("complexity"), F.max("fan_in").alias("most_callers"))


@query(f"""WITH {FUNCTIONS_SQL} SELECT split_part(file, '/', 2) AS layer, count(*)::BIGINT AS n, round(avg(complexity), 6) AS mean_complexity, max(complexity) AS most, sum((complexity > 10)::BIGINT)::BIGINT AS n_complex FROM functions GROUP BY ALL""")
def complexity_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = functions(spark, sf_dir).select(rules.layer_of(F.col("file")).alias("layer"), "complexity")
    return f.groupBy("layer").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("complexity"), 6).alias("mean_complexity"), F.max("complexity").alias("most"), F.sum((F.col("complexity") > 10).cast("bigint")).alias("n_complex"))


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.round(part / whole, 6)).otherwise(0.0)


@query(f"""WITH {MUTATIONS}, o AS (SELECT CASE kind WHEN 'analyse' THEN 'Pending' WHEN 'remove' THEN 'Removed' WHEN 'keep' THEN 'Kept' ELSE 'FalsePositive' END AS outcome FROM l),
s AS (SELECT count(*)::BIGINT AS total, count(*) FILTER (WHERE outcome = 'Removed')::BIGINT AS removed, count(*) FILTER (WHERE outcome = 'Kept')::BIGINT AS kept, count(*) FILTER (WHERE outcome = 'FalsePositive')::BIGINT AS false_positives, count(*) FILTER (WHERE outcome = 'Pending')::BIGINT AS pending FROM o)
SELECT *, CASE WHEN removed + false_positives > 0 THEN round(removed / (removed + false_positives), 6) ELSE 0 END::DOUBLE AS "precision", CASE WHEN total > 0 THEN round((total - pending) / total, 6) ELSE 0 END::DOUBLE AS decided FROM s""")
def feedback_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = lambda o: F.coalesce(F.sum((F.col("outcome") == o).cast("bigint")), F.lit(0))
    s = state.folded(mutations(spark, sf_dir)).agg(F.count(F.lit(1)).alias("total"), n("Removed").alias("removed"), n("Kept").alias("kept"), n("FalsePositive").alias("false_positives"), n("Pending").alias("pending"))
    c = F.col
    return s.select("*", _share(c("removed"), c("removed") + c("false_positives")).alias("precision"), _share(c("total") - c("pending"), c("total")).alias("decided"))


@query(f"""WITH RECURSIVE {_lsh_sql()}, {CLUSTER_SQL}, f AS (SELECT cluster, len(string_split(regexp_replace(text, '\\n$', ''), chr(10))) < 5 OR len(list_filter(regexp_split_to_array(text, '[ \\t\\n\\r\\f]+'), lambda x: x <> '')) < 18 AS fp FROM clusters JOIN documents ON id = doc_id)
SELECT cluster, count(*)::BIGINT AS size, bool_or(fp) AS dismissed FROM f GROUP BY cluster""")
def dismissed_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of duplicates; one with any member that is boilerplate is dismissed as a whole."""
    d = docs(spark, sf_dir)
    n_tokens = F.size(F.array_remove(F.split("text", "[ \t\n\r\f]+"), ""))
    fp = rules.false_positive(F.lit("f"), F.lit(None).cast("string"), F.size(t.lines(F.col("text"))), n_tokens)
    of = dedup.clusters(d, "doc_id", "text").join(d.select(F.col("doc_id").alias("id"), fp.alias("fp")), "id")
    return of.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"), F.max("fp").alias("dismissed"))


@query("SELECT o_custkey AS file, count(*)::BIGINT AS n FROM orders GROUP BY 1 ORDER BY n DESC, file LIMIT 10")
def most_modified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten files with most commits."""
    return table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("file")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "file").limit(10)


@query(f"""WITH RECURSIVE {EXTENDS}, w AS (SELECT src AS node, dst AS top, 1 AS steps, dst::VARCHAR AS chain FROM e UNION ALL SELECT node, dst, steps + 1, chain || '>' || dst FROM w JOIN e ON e.src = w.top)
SELECT node, max_by(chain, steps) AS chain, max(steps)::INTEGER AS depth FROM w GROUP BY node""")
def inheritance_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.chains(extends(spark, sf_dir)).select("node", F.array_join("chain", ">").alias("chain"), "depth")


@query(f"WITH {EXTENDS} SELECT dst AS node FROM e EXCEPT SELECT src FROM e")
def root_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.tops(extends(spark, sf_dir))
