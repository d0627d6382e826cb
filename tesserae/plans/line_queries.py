"""Queries of the texts about functions, files, layers and types, and of single decisions on the ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.functions import lines as li
from tesserae.operators import report, state
from tesserae.plans.frames import CALLS_SQL, FUNCTIONS_SQL, calls, functions
from tesserae.plans.registry import query, table
from tesserae.plans.state_queries import MUTATIONS, mutations


def _names(edges: DataFrame, named: DataFrame, of: str, other: str, alias: str) -> DataFrame:
    """node and the sorted distinct names at the other ends of its edges; a text about a function holds all of them."""
    return edges.join(named.select(F.col("node").alias(other), "name"), other).groupBy(F.col(of).alias("node")).agg(F.array_sort(F.collect_set("name")).alias(alias))


def told(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as functions with places, marks, parameters and the names of their callees and callers."""
    own, edges, node = functions(spark, sf_dir), calls(spark, sf_dir), F.col("node")
    f = own.join(_names(edges, own, "src", "dst", "callees"), "node", "left").join(_names(edges, own, "dst", "src", "callers"), "node", "left")
    empty = F.array().cast("array<string>")
    return f.withColumns({
        "line": node % 100, "importance": F.col("complexity") / 50, "is_async": node % 8 == 0, "params": F.when(node % 2 == 0, F.array(F.lit("a:int"), F.lit("b"))).otherwise(empty),
        "returns": F.when(node % 3 == 0, F.array(F.lit("Result<Order"), F.lit("u8>"))).otherwise(empty), "callees": F.coalesce("callees", empty), "callers": F.coalesce("callers", empty),
    })


TOLD_SQL = f"""{CALLS_SQL}, {FUNCTIONS_SQL}, ce AS (SELECT src AS node, list_sort(list(DISTINCT name)) AS callees FROM calls JOIN functions ON node = dst GROUP BY src), cr AS (SELECT dst AS node, list_sort(list(DISTINCT name)) AS callers FROM calls JOIN functions ON node = src GROUP BY dst),
told AS (SELECT functions.*, node % 100 AS line, complexity / 50 AS importance, node % 8 = 0 AS is_async, CASE WHEN node % 2 = 0 THEN ['a:int', 'b'] ELSE [] END AS params, CASE WHEN node % 3 = 0 THEN ['Result<Order', 'u8>'] ELSE [] END AS returns, coalesce(callees, []) AS callees, coalesce(callers, []) AS callers
  FROM functions LEFT JOIN ce USING (node) LEFT JOIN cr USING (node))"""


@query(f"""WITH {TOLD_SQL} SELECT node, concat('ƒ ', name, CASE WHEN importance > 0.7 THEN ' 🔥' WHEN importance > 0.3 THEN ' 📌' ELSE '' END, CASE WHEN is_async THEN ' ∂' ELSE '' END, chr(10), CASE WHEN doc IS NOT NULL THEN '  ' || doc || chr(10) END, '  📍 ', regexp_extract(file, '[^/]*$'), ':', line, chr(10),
  CASE WHEN len(params) > 0 THEN '  📥 a:int, b' || chr(10) END, CASE WHEN len(returns) > 0 THEN '  📤 Result<Order, u8>' || chr(10) END, CASE WHEN len(callees) > 0 THEN '  📞 ' || array_to_string(callees, ' → ') || chr(10) END, chr(10)) AS compressed,
  concat('- File: ', file, chr(10), '- Line: ', line, chr(10), '- Public: ', is_public, chr(10), '- Async: ', is_async, chr(10), '- Complexity: ', printf('%.2f', complexity), chr(10), CASE WHEN len(params) > 0 THEN '- Parameters:' || chr(10) || '  - a:int' || chr(10) || '  - b' || chr(10) END,
  CASE WHEN len(returns) > 0 THEN '- Returns: Result<Order, u8>' || chr(10) END, CASE WHEN doc IS NOT NULL THEN '- Documentation: ' || doc || chr(10) END, CASE WHEN len(callees) > 0 THEN '- Calls:' || chr(10) || array_to_string(list_transform(callees, lambda c: '  - ' || c || chr(10)), '') END,
  CASE WHEN len(callers) > 0 THEN '- Called by:' || chr(10) || array_to_string(list_transform(callers, lambda c: '  - ' || c || chr(10)), '') END) AS context,
  concat('Function ', name, ' in file ', file, ' ', CASE WHEN doc IS NOT NULL THEN 'with documentation: ' || doc || ' ' END, CASE WHEN is_public THEN 'public ' END, CASE WHEN is_async THEN 'async ' END, 'with ', len(params), ' parameters ', CASE WHEN len(returns) > 0 THEN 'returning Result<Order, u8>' END) AS embedded,
  sha256(concat('sig:', name, '|', len(params), '|', len(returns), '|', is_public, '|', is_async)) AS signature FROM told""")
def function_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each function's compressed text, context for a chunk, sentence for an embedding, and signature hash."""
    c = F.col
    return told(spark, sf_dir).select(
        "node", li.compressed_function(c("name"), c("file"), c("line"), c("importance"), c("is_async"), c("doc"), c("params"), c("returns"), c("callees")).alias("compressed"),
        li.function_context(c("file"), c("line"), c("is_public"), c("is_async"), c("complexity"), c("params"), c("returns"), c("doc"), c("callees"), c("callers")).alias("context"),
        li.embedding_context(c("name"), c("file"), c("doc"), c("is_public"), c("is_async"), F.size("params"), c("returns")).alias("embedded"),
        li.signature_hash(c("name"), F.size("params"), F.size("returns"), c("is_public"), c("is_async")).alias("signature"),
    )


@query(f"""WITH {TOLD_SQL} SELECT node, file, concat('ƒ ', name, '(', array_to_string(params, ', '), ')', CASE WHEN len(returns) > 0 THEN '→' || array_to_string(returns, ', ') END, ' {{', CASE WHEN len(callees) > 0 THEN ' 📞' || array_to_string(callees, '→') END, ' }}') AS line FROM told""")
def file_skeletons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of each file's skeleton: signatures with calls."""
    c = F.col
    returned = F.when(F.size("returns") > 0, F.array_join("returns", ", "))
    return told(spark, sf_dir).select("node", "file", li.skeleton_line(c("name"), c("params"), returned, c("callees")).alias("line"))


@query(f"""WITH {TOLD_SQL}, p AS (SELECT DISTINCT src, dst FROM calls) SELECT src, dst, round(CASE WHEN len(a.callees) + len(b.callees) > 0 THEN len(list_intersect(a.callees, b.callees)) / len(list_distinct(list_concat(a.callees, b.callees))) ELSE 0 END, 6)::DOUBLE AS callees,
  CASE WHEN len(a.returns) = 0 AND len(b.returns) = 0 THEN 1 WHEN len(a.returns) = 0 OR len(b.returns) = 0 THEN 0 ELSE 1 END::DOUBLE AS returns FROM p JOIN told a ON a.node = src JOIN told b ON b.node = dst""")
def callee_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each pair of caller and callee, how much they call and return alike."""
    own = told(spark, sf_dir)
    a, b = (own.select(F.col("node").alias(n), F.col("callees").alias(f"c_{n}"), F.col("returns").alias(f"r_{n}")) for n in ("src", "dst"))
    pairs = calls(spark, sf_dir).distinct().join(a, "src").join(b, "dst")
    return pairs.select("src", "dst", F.round(li.callee_overlap(F.col("c_src"), F.col("c_dst")), 6).alias("callees"), li.return_overlap(F.col("r_src"), F.col("r_dst")).alias("returns"))


@query(f"""WITH {FUNCTIONS_SQL}, s AS (SELECT node, 'Map<' || replace(name, '_', ', ') || ', u8, ' || node || ', Vec<Order' || node % 5 || '>>' AS signature FROM functions)
SELECT name, count(*)::BIGINT AS n, min(node) AS first FROM (SELECT node, unnest(list_distinct(list_filter(regexp_extract_all(signature, '[A-Za-z0-9_]+'), lambda w: NOT regexp_full_match(w, '[0-9]+') AND NOT list_contains([{', '.join(f"'{w}'" for w in li.NO_TYPES)}], w)))) AS name FROM s) GROUP BY name""")
def types_used(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each type named in a signature, by how many functions, and the first of them."""
    n = F.col("node").cast("string")
    signature = F.concat(F.lit("Map<"), F.replace("name", F.lit("_"), F.lit(", ")), F.lit(", u8, "), n, F.lit(", Vec<Order"), (F.col("node") % 5).cast("string"), F.lit(">>"))
    used = functions(spark, sf_dir).select("node", F.explode(li.type_names(signature)).alias("name"))
    return used.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("first"))


_LAYER = "CASE WHEN node % 3 = 0 THEN ['handler', 'service', 'core', 'test', 'cli'][(node % 5) + 1] ELSE split_part(file, '/', 2) END"


def _layer_sql(at: int) -> str:
    return " ".join(f"WHEN '{n}' THEN '{v[at]}'" for n, v in li.LAYERS.items())


@query(f"""WITH {FUNCTIONS_SQL}, l AS (SELECT {_LAYER} AS layer, name, node, complexity, row_number() OVER (PARTITION BY {_LAYER} ORDER BY complexity DESC, node) AS r FROM functions),
g AS (SELECT layer, count(*)::BIGINT AS n, string_agg(name, ', ' ORDER BY r) FILTER (WHERE r <= 3) AS top FROM l GROUP BY layer)
SELECT layer, n, top, CASE layer {_layer_sql(1)} ELSE 'Code under the `' || layer || '` module' END AS description, CASE layer {_layer_sql(0)} ELSE 'hsl(' || (list_reduce(list_prepend(5381::BIGINT, list_transform(string_split(layer, ''), lambda c: ascii(c)::BIGINT)), lambda h, c: (h * 33 + c) % 4294967296) % 360) || ', 70%, 54%)' END AS colour FROM g""")
def layer_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each layer with its size, its three functions of most complexity, description and colour."""
    node = F.col("node")
    layer = F.when(node % 3 == 0, F.element_at(F.array(*map(F.lit, ["handler", "service", "core", "test", "cli"])), (node % 5 + 1).cast("int"))).otherwise(F.split_part("file", F.lit("/"), F.lit(2)))
    return report.layers(functions(spark, sf_dir).withColumn("layer", layer), F.col("complexity"))


@query("""WITH c AS (SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN (1700000000 + o_orderkey)::VARCHAR WHEN 1 THEN sha1(o_orderkey::VARCHAR) WHEN 2 THEN o_orderkey::VARCHAR ELSE 'x' || o_orderkey END AS "commit", o_orderkey % 8 AS k FROM orders),
t AS (SELECT *, CASE WHEN regexp_full_match("commit", '[0-9]{1,18}') THEN "commit"::BIGINT WHEN regexp_full_match("commit", '[0-9a-f]{40}') AND k <> 1 THEN 1600000000 + id END AS seconds FROM c) SELECT id, seconds, strftime(make_timestamp(seconds * 1000000), '%Y-%m-%d') AS day, least(greatest(id // 16, 1), 1000)::BIGINT AS chunk FROM t""")
def commit_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as commits named by times, hashes, short numbers and words: when they were made, as far as that is known."""
    k = F.col("o_orderkey")
    s = k.cast("string")
    commit = F.when(k % 4 == 0, (k + 1700000000).cast("string")).when(k % 4 == 1, F.sha1(s)).when(k % 4 == 2, s).otherwise(F.concat(F.lit("x"), s))
    seconds = li.commit_time(commit, F.when(k % 8 != 1, k + 1600000000))
    return table(spark, sf_dir, "orders").select(k.alias("id"), seconds.alias("seconds")).select("id", "seconds", li.shown_time(F.col("seconds")).alias("day"), li.chunk_size(F.col("id"), 8).alias("chunk"))


_OUTCOME = "CASE kind WHEN 'analyse' THEN 'Pending' WHEN 'remove' THEN 'Removed' WHEN 'keep' THEN 'Kept' ELSE 'FalsePositive' END"
DECIDED_SQL = f"""{MUTATIONS}, d0 AS (SELECT id, 'fn_' || id AS name, {_OUTCOME} AS outcome, CASE WHEN kind = 'keep' AND id % 2 = 0 THEN 'was a false positive' END AS notes, confidence FROM l),
d1 AS (SELECT * REPLACE (CASE WHEN hit THEN 'Removed' ELSE outcome END AS outcome, CASE WHEN hit THEN 'Removed by developer' ELSE notes END AS notes) FROM (SELECT *, coalesce(id = (SELECT min(id) FROM d0 WHERE outcome = 'Pending' AND contains(name, '1')), false) AS hit FROM d0)),
d2 AS (SELECT * REPLACE (CASE WHEN hit2 THEN 'Kept' ELSE outcome END AS outcome, CASE WHEN hit2 THEN 'False positive: called by name' ELSE notes END AS notes) FROM (SELECT *, coalesce(id = (SELECT min(id) FROM d1 WHERE outcome = 'Pending' AND contains(name, '2')), false) AS hit2 FROM d1))"""


def decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger after two decisions: the first pending entry with a 1 in its name removed, then that with a 2 kept."""
    ledger = state.folded(mutations(spark, sf_dir)).select("id", F.concat(F.lit("fn_"), F.col("id").cast("string")).alias("name"), "outcome", F.when((F.col("outcome") == "Kept") & (F.col("id") % 2 == 0), "was a false positive").alias("notes"), F.col("outcome_date"), "confidence")
    at = F.lit("2024-02-01 00:00:00").cast("timestamp")
    return state.resolve_first(state.resolve_first(ledger, "1", True, "abc", at), "2", False, "called by name", at)


@query(f"WITH {DECIDED_SQL} SELECT id, name, outcome, notes FROM d2")
def ledger_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decided(spark, sf_dir).select("id", "name", "outcome", "notes")


@query(f"""WITH {DECIDED_SQL} SELECT id, CASE outcome WHEN 'Removed' THEN 'Dead' ELSE 'Alive' END AS label, CASE outcome WHEN 'Removed' THEN 'Removed by developer via dashboard' ELSE 'Kept as false positive via dashboard' END AS reason, confidence FROM d2 WHERE outcome = 'Removed' OR (outcome = 'Kept' AND contains(notes, 'false positive'))""")
def decision_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the ledger's decisions teach."""
    return state.examples(decided(spark, sf_dir))
