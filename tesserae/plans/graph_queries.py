"""Queries of the graph operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesserae.functions import rules
from tesserae.operators import graph
from tesserae.plans.frames import CALLS_SQL, EVERY_CALL_SQL, FAN_SQL, FUNCTIONS_SQL, calls, every_call, functions
from tesserae.plans.registry import query, table

ROOTS_SQL = f"{FUNCTIONS_SQL}, roots AS (SELECT node FROM functions WHERE is_public OR file LIKE '%\\_test.rs' ESCAPE '\\')"


def roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The functions that a rule makes a root: those of test files and exported ones."""
    c = F.col
    kind = rules.root_kind(c("is_test"), c("name"), c("file"), c("is_public"), c("doc"))
    return functions(spark, sf_dir).filter(kind.isNotNull()).select("node")


@query(f"WITH {EVERY_CALL_SQL}, {FAN_SQL} SELECT node, fan_in, fan_out FROM fan")
def fan_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.fan(every_call(spark, sf_dir))


@query(f"""WITH RECURSIVE {CALLS_SQL}, {ROOTS_SQL}, r AS (SELECT node FROM roots),
reached AS (SELECT node FROM r UNION SELECT dst FROM reached JOIN calls ON src = node)
SELECT node, node IN (SELECT node FROM r) AS is_root FROM reached""")
def reachability(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = calls(spark, sf_dir)
    r = roots(spark, sf_dir)
    return graph.depth(e, r).select("node", (F.col("depth") == 0).alias("is_root"))


@query(f"""WITH RECURSIVE {CALLS_SQL}, {ROOTS_SQL}, r AS (SELECT node FROM roots),
reached AS (SELECT node FROM r UNION SELECT dst FROM reached JOIN calls ON src = node),
every AS (SELECT src AS node FROM calls UNION SELECT dst FROM calls)
SELECT node FROM every EXCEPT SELECT node FROM reached""")
def unreachable(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = calls(spark, sf_dir)
    return graph.nodes(e).join(graph.reach(e, roots(spark, sf_dir)), "node", "left_anti")


@query(f"""WITH RECURSIVE {CALLS_SQL}, {ROOTS_SQL},
walk AS (SELECT node, 0 AS depth FROM roots UNION SELECT dst, depth + 1 FROM walk JOIN calls ON src = node WHERE depth < 40),
every AS (SELECT src AS node FROM calls UNION SELECT dst FROM calls)
SELECT every.node, coalesce(min(depth), 0)::INTEGER AS depth FROM every LEFT JOIN walk USING (node) GROUP BY every.node""")
def call_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = calls(spark, sf_dir)
    return graph.nodes(e).join(graph.depth(e, roots(spark, sf_dir)), "node", "left").select("node", F.coalesce("depth", F.lit(0)).alias("depth"))


@query(f"""WITH RECURSIVE {CALLS_SQL}, twoway AS (SELECT src AS a, dst AS b FROM calls UNION SELECT dst, src FROM calls),
walk AS (SELECT a AS node, a AS root FROM twoway UNION SELECT b, root FROM walk JOIN twoway ON a = node WHERE root <= b)
SELECT node, min(root) AS root FROM walk GROUP BY node""")
def graph_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.components(calls(spark, sf_dir))


@query(f"""WITH RECURSIVE {CALLS_SQL}, e AS (SELECT DISTINCT src, dst FROM calls),
walk AS (SELECT src AS a, dst AS b FROM e UNION SELECT a, dst FROM walk JOIN e ON src = b)
SELECT x.a AS node, min(x.b) AS scc FROM walk x JOIN walk y ON x.a = y.b AND x.b = y.a GROUP BY x.a HAVING count(DISTINCT x.b) > 1""")
def scc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.scc(calls(spark, sf_dir))


@query(f"""WITH RECURSIVE {CALLS_SQL}, e AS (SELECT DISTINCT least(src, dst) AS src, greatest(src, dst) AS dst FROM calls),
every AS (SELECT src AS node FROM e UNION SELECT dst FROM e),
walk AS (SELECT node, 0 AS level FROM every EXCEPT SELECT dst, 0 FROM e), up AS (SELECT * FROM walk UNION SELECT dst, level + 1 FROM up JOIN e ON src = node WHERE level < 200)
SELECT every.node, max(level)::INTEGER AS level FROM every LEFT JOIN up USING (node) GROUP BY every.node""")
def topological_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls turned towards the greater part, so that none is on a cycle."""
    return graph.levels(calls(spark, sf_dir).select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")))


@query(f"""WITH RECURSIVE {CALLS_SQL}, twoway AS (SELECT src AS a, dst AS b FROM calls UNION SELECT dst, src FROM calls),
{FUNCTIONS_SQL}, c AS (SELECT node FROM functions WHERE trait_impl IS NOT NULL UNION SELECT b FROM c JOIN twoway ON a = node) SELECT node FROM c""")
def affected_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = calls(spark, sf_dir)
    changed = functions(spark, sf_dir).filter("trait_impl is not null")
    return graph.closure(e, changed.select("node"))


@query(f"""WITH RECURSIVE {CALLS_SQL}, {ROOTS_SQL}, walk AS (SELECT node, node AS root FROM roots UNION SELECT dst, root FROM walk JOIN calls ON src = node)
SELECT node, min(root) AS root FROM walk GROUP BY node""")
def reachable_from(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = calls(spark, sf_dir)
    return graph.lineage(e, roots(spark, sf_dir))


@query(f"""WITH {EVERY_CALL_SQL}, {FAN_SQL}, {FUNCTIONS_SQL},
f AS (SELECT node, complexity, coalesce(fan_in, 0) AS i, coalesce(fan_out, 0) AS o, CASE WHEN is_public THEN 1.0 ELSE 0.5 END AS w FROM functions LEFT JOIN fan USING (node)),
m AS (SELECT greatest(max(i), 1) AS mi, greatest(max(i + o), 1) AS md FROM f)
SELECT node, round(least(greatest(0.15 * least(complexity / 50, 1) + 0.25 * (i + o) / md + 0.20 * least((i + o) / 50.0, 1) + 0.30 * i / mi + 0.10 * w, 0), 1), 6)::DOUBLE AS importance FROM f, m""")
def importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = functions(spark, sf_dir).join(graph.fan(every_call(spark, sf_dir)), "node", "left").select(
        "node", "complexity", F.coalesce("fan_in", F.lit(0)).alias("fan_in"), F.coalesce("fan_out", F.lit(0)).alias("fan_out"), F.when(F.col("is_public"), 1.0).otherwise(0.5).alias("layer_weight")
    )
    return graph.importance(f).select("node", F.round("importance", 6).alias("importance"))


@query("""WITH t AS (SELECT rc.r_name AS src_layer, rs.r_name AS dst_layer, count(*)::BIGINT AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN supplier ON l_suppkey = s_suppkey JOIN nation nc ON c_nationkey = nc.n_nationkey JOIN nation ns ON s_nationkey = ns.n_nationkey JOIN region rc ON nc.n_regionkey = rc.r_regionkey JOIN region rs ON ns.n_regionkey = rs.r_regionkey GROUP BY 1, 2)
SELECT src_layer, dst_layer, n, row_number() OVER (PARTITION BY src_layer ORDER BY n DESC, dst_layer)::INTEGER AS place FROM t QUALIFY place <= 3""")
def layer_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trade between regions, customers' to suppliers', the three most of each."""
    region = F.broadcast(table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name"))
    c = table(spark, sf_dir, "customer").join(region, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("r_name").alias("src_layer"))
    s = table(spark, sf_dir, "supplier").join(region, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("r_name").alias("dst_layer"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(c, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "src_layer")
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey").join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    n = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("src_layer", "dst_layer").agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.partitionBy("src_layer").orderBy(F.desc("n"), "dst_layer"))
    return n.withColumn("place", place).filter("place <= 3")


@query(f"""WITH {EVERY_CALL_SQL} SELECT '  "' || src || '" -> "' || dst || '";' AS line FROM (SELECT DISTINCT src, dst FROM calls)""")
def graph_dot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.dot(every_call(spark, sf_dir))


@query(f"""WITH {EVERY_CALL_SQL}, callers AS (SELECT dst AS node, list_sort(list(DISTINCT src)) AS l FROM calls GROUP BY dst), callees AS (SELECT src AS node, list_sort(list(DISTINCT dst)) AS l FROM calls GROUP BY src)
SELECT node, coalesce(array_to_string(callers.l, ','), '') AS callers, coalesce(array_to_string(callees.l, ','), '') AS callees FROM callers FULL JOIN callees USING (node)""")
def callers_callees(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = every_call(spark, sf_dir).distinct()
    up = e.groupBy(F.col("dst").alias("node")).agg(F.array_join(F.sort_array(F.collect_set("src")), ",").alias("callers"))
    down = e.groupBy(F.col("src").alias("node")).agg(F.array_join(F.sort_array(F.collect_set("dst")), ",").alias("callees"))
    return up.join(down, "node", "full").select("node", F.coalesce("callers", F.lit("")).alias("callers"), F.coalesce("callees", F.lit("")).alias("callees"))


@query(f"""WITH {FUNCTIONS_SQL}, {EVERY_CALL_SQL}, l AS (SELECT node, split_part(file, '/', 2) AS layer FROM functions)
SELECT a.layer AS src_layer, b.layer AS dst_layer, count(*)::BIGINT AS n FROM calls JOIN l a ON src = a.node JOIN l b ON dst = b.node GROUP BY 1, 2""")
def layer_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    layers = functions(spark, sf_dir).select("node", rules.layer_of(F.col("file")).alias("layer"))
    return graph.layer_matrix(every_call(spark, sf_dir), layers)
