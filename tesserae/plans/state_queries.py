"""Queries of resolution, snapshots, the ledger, text reports and event series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesserae.functions import text as t
from tesserae.functions import vectors as v
from tesserae.operators import report, resolve, state
from tesserae.operators.order import placed
from tesserae.plans.registry import query, table

ESTIMATE = "(length(regexp_replace({0}, '[^!-/0-9:-@\\[-`{{-~]', '', 'g')) // 3 + length(regexp_replace({0}, '[^\\p{{L}}\\s]', '', 'g')) // 4)::BIGINT"


def _symbols_sql(x: str) -> str:
    for a, b in t.SYMBOLS:
        x = f"replace({x}, '{a}', '{b}')"
    return x


@query(f"SELECT doc_id, {ESTIMATE.format('text')} AS tokens FROM documents WHERE text IS NOT NULL")
def token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", t.token_estimate(F.col("text")).alias("tokens"))


@query(f"WITH c AS (SELECT doc_id, text, {_symbols_sql('text')} AS short FROM documents WHERE text IS NOT NULL) SELECT doc_id, length(text)::BIGINT AS n_before, length(short)::BIGINT AS n_after, md5(short) AS digest FROM c")
def compress_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    short = t.symbols(F.col("text"))
    d = table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", F.length("text").cast("bigint").alias("n_before"), short.alias("short"))
    return d.select("doc_id", "n_before", F.length("short").cast("bigint").alias("n_after"), F.md5("short").alias("digest"))


@query(f"""WITH RECURSIVE t AS (SELECT conv_id, turn, {ESTIMATE.format("coalesce(text, '')")} AS tokens, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations),
w AS (SELECT conv_id, turn, tokens, i, 0::BIGINT AS chunk, tokens AS used FROM t WHERE i = 1
  UNION ALL SELECT t.conv_id, t.turn, t.tokens, t.i, chunk + (used + t.tokens > 200)::BIGINT, CASE WHEN used + t.tokens > 200 THEN t.tokens ELSE used + t.tokens END FROM w JOIN t ON t.conv_id = w.conv_id AND t.i = w.i + 1)
SELECT conv_id, turn, tokens, chunk FROM w""")
def chunk_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns packed in order into chunks of at most 200 tokens; a longer turn has a chunk of its own."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", t.token_estimate(F.coalesce("text", F.lit(""))).alias("tokens"))
    return report.packed(c, "conv_id", "turn", "tokens", 200)


_LAST_LINE = "(2049 - strpos(reverse(substr({0}, 1, 2048)), chr(10)))"
_CUT = f"CASE WHEN length({{0}}) <= 2048 THEN length({{0}}) WHEN contains(substr({{0}}, 2, 2047), chr(10)) THEN {_LAST_LINE} ELSE 2048 END"


@query(f"""WITH RECURSIVE c AS (SELECT doc_id AS id, 0 AS chunk, text AS rest, {_CUT.format("text")} AS n, lang, source FROM documents WHERE text IS NOT NULL
  UNION ALL SELECT id, chunk + 1, substr(rest, n + 1), {_CUT.format("substr(rest, n + 1)")}, lang, source FROM c WHERE length(rest) > n),
d AS (SELECT id, chunk, CASE WHEN length(rest) > n AND substr(rest, n, 1) = chr(10) THEN substr(rest, 1, n - 1) ELSE substr(rest, 1, n) END AS content, 'lang:' || coalesce(lang, '-') || ',source:' || coalesce(source, '-') AS tags FROM c)
SELECT id, chunk, md5(content) AS content, {ESTIMATE.format('content')} AS tokens, tags, 'chunk ' || id || ' [' || tags || ']' AS context FROM d""")
def rag_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole texts in chunks."""
    chunks = report.rag_chunks(table(spark, sf_dir, "documents").filter("text is not null"), "doc_id", "text", ["lang", "source"])
    return chunks.withColumn("content", F.md5("content"))


@query("""SELECT '{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '","n_regionkey":' || n_regionkey || '}' AS line FROM nation""")
def json_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.jsonl(table(spark, sf_dir, "nation"))


@query("""SELECT '| ' || s_suppkey || ' | ' || s_name || ' | ' || s_nationkey || ' |' AS line FROM supplier""")
def markdown_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.markdown(table(spark, sf_dir, "supplier"), ["s_suppkey", "s_name", "s_nationkey"])


@query("""WITH e AS (SELECT o_totalprice AS p FROM orders WHERE o_totalprice IS NOT NULL) SELECT (CASE WHEN p >= 400000 THEN 5 WHEN p >= 200000 THEN 4 WHEN p >= 100000 THEN 3 WHEN p >= 50000 THEN 2 WHEN p >= 10000 THEN 1 ELSE 0 END)::INTEGER AS bucket, count(*)::BIGINT AS n FROM e GROUP BY 1""")
def hist_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.histogram(table(spark, sf_dir, "orders"), "o_totalprice", [10000, 50000, 100000, 200000, 400000])


TOKENS = "list_distinct(list_filter(regexp_split_to_array(lower(text), '[ \\t\\n\\r\\f(){}\\[\\];,]+'), lambda x: x <> ''))"


@query(f"WITH t AS (SELECT doc_id, unnest({TOKENS}) AS token FROM documents WHERE text IS NOT NULL) SELECT token, count(*)::BIGINT AS n_docs, min(doc_id) AS first_doc, max(doc_id) AS last_doc FROM t GROUP BY token")
def inverted_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per token its number of documents, the first and the last; the rows behind it are state.inverted."""
    rows = state.inverted(table(spark, sf_dir, "documents").filter("text is not null"), "doc_id", "text")
    return rows.groupBy("token").agg(F.count(F.lit(1)).alias("n_docs"), F.min("id").alias("first_doc"), F.max("id").alias("last_doc"))


@query("SELECT event_id, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS INTEGER), -1) AS k, event_type FROM events")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").try_cast("int")
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(k, F.lit(-1)).alias("k"), "event_type")


@query("""WITH a AS (SELECT replace(p_name, ' ', '_') AS x, min(p_partkey) AS id FROM part GROUP BY 1), p AS (SELECT q.x AS a, c.x AS b FROM a q JOIN a c ON q.id % 100 = 0 AND q.x <> c.x),
d AS (SELECT a, b, levenshtein(a, b)::INTEGER AS distance, round(1 - levenshtein(a, b) / greatest(length(a), length(b)), 6) AS ratio FROM p) SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY a ORDER BY distance, b) <= 5""")
def levenshtein_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each distinct part name whose least part is divisible by 100 the five names nearest to it of all."""
    names = table(spark, sf_dir, "part").groupBy(F.replace("p_name", F.lit(" "), F.lit("_")).alias("x")).agg(F.min("p_partkey").alias("id"))
    asked = names.filter("id % 100 = 0").select(F.col("x").alias("a"))
    blocks = max(1, -(-asked.count() // 8192))
    out = None
    for i in range(blocks):
        met = names.join(F.broadcast(asked.filter(F.pmod(F.xxhash64("a"), F.lit(blocks)) == i)), F.col("a") != F.col("x")).select("a", F.col("x").alias("b"), F.levenshtein("a", "x").alias("distance"))
        out = met if out is None else out.unionAll(met)
    near = out.withColumn("place", F.row_number().over(Window.partitionBy("a").orderBy("distance", "b"))).filter("place <= 5")
    return near.select("a", "b", "distance", F.round(t.levenshtein_ratio(F.col("a"), F.col("b")), 6).alias("ratio"))


def _counts_sql(words: tuple[str, ...]) -> str:
    return "(" + " + ".join(f"(length(text) - length(replace(text, '{w}', ''))) // {len(w)}" for w in words) + ")"


@query(f"""WITH d AS (SELECT doc_id, CASE WHEN text = '' THEN [] ELSE string_split(regexp_replace(text, '\\r?\\n$', ''), chr(10)) END AS rows, len(list_filter(regexp_split_to_array(text, '[ \\t\\n\\r\\f]+'), lambda x: x <> '')) AS w, text, lang, source FROM documents WHERE text IS NOT NULL),
c AS (SELECT *, len(rows) AS l, len(list_filter(rows, lambda x: starts_with(ltrim(x), '//') OR starts_with(ltrim(x), '/*'))) AS comments, length(source) AS params, length(lang) AS returns FROM d)
SELECT doc_id, round(w / 1000.0, 6)::DOUBLE AS f0, round(l / 100.0, 6)::DOUBLE AS f1, round(l / 50.0, 6)::DOUBLE AS f2, round(params / 10.0, 6)::DOUBLE AS f3, round(returns / 5.0, 6)::DOUBLE AS f4, (lang = 'de')::INTEGER::DOUBLE AS f5, (lang = 'en')::INTEGER::DOUBLE AS f6,
  round((params + returns) / 10.0, 6)::DOUBLE AS f7, round({_counts_sql(t.CONTROL_FLOW)} / 20.0, 6)::DOUBLE AS f8, round({_counts_sql(t.ERRORS)} / 10.0, 6)::DOUBLE AS f9, round(comments / 50.0, 6)::DOUBLE AS f10, round({_counts_sql(t.TYPES)} / 10.0, 6)::DOUBLE AS f11, round(returns / 50.0, 6)::DOUBLE AS f12 FROM c""")
def feature_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 13 text features by place; lines stand for complexity, the names of source and language for parameters and returns."""
    d, lang = table(spark, sf_dir, "documents").filter("text is not null"), F.col("lang")
    f = v.text_features(F.col("text"), lang, F.size(t.lines(F.col("text"))), F.length("source"), F.length("lang"), lang == "de", lang == "en")
    return d.select("doc_id", f.alias("f")).select("doc_id", *[F.round(F.col("f")[i], 6).alias(f"f{i}") for i in range(13)])


@query("""WITH c AS (SELECT l_orderkey * 10 + l_linenumber AS call, l_orderkey, l_linenumber, l_suppkey, l_partkey FROM lineitem), k AS (SELECT call, min(l_suppkey) AS file, min('Supplier#' || lpad((l_partkey % 150)::VARCHAR, 9, '0')) AS name, min(l_partkey % 25) AS import FROM c GROUP BY call),
d AS (SELECT s_suppkey AS target, s_suppkey AS file, s_name AS name, s_nationkey AS module FROM supplier),
r AS (SELECT call, 1 AS rank, 'same_file' AS method, 0.95::DOUBLE AS confidence, target FROM k JOIN d USING (file, name) UNION ALL SELECT call, 2, 'import', 0.90::DOUBLE, d.target FROM k JOIN d ON k.import = d.module AND k.name = d.name UNION ALL SELECT call, 3, 'global', 0.70::DOUBLE, d.target FROM k JOIN d ON k.name = d.name),
b AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY call ORDER BY rank) = 1)
SELECT coalesce(method, 'none') AS method, CASE WHEN target IS NULL THEN 'unresolved' ELSE 'resolved' END AS status, count(*)::BIGINT AS n, coalesce(sum(target), 0)::BIGINT AS targets FROM k LEFT JOIN b USING (call) GROUP BY 1, 2""")
def resolve_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines' made-up names resolved to suppliers: in the same file, by import, anywhere."""
    li = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("call"), "l_suppkey", "l_partkey")
    name = F.concat(F.lit("Supplier#"), F.lpad((F.col("l_partkey") % 150).cast("string"), 9, "0"))
    k = li.groupBy("call").agg(F.min("l_suppkey").alias("file"), F.min(name).alias("name"), F.min(F.col("l_partkey") % 25).alias("import"))
    d = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("target"), F.col("s_suppkey").alias("file"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("module"))
    r = resolve.resolved(k, d, resolve.DEFAULT[1:])
    return r.groupBy(F.coalesce("method", F.lit("none")).alias("method"), "status").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("target"), F.lit(0)).alias("targets"))


LINKS = "h AS (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS target FROM pages), f AS (SELECT DISTINCT split_part(regexp_replace(url, '^[a-z]+://[^/]*/', ''), '/', 1) AS key FROM pages)"


@query(f"WITH {LINKS}, k AS (SELECT page_id AS src, target, unnest([trim(target, '/'), split_part(trim(target, '/'), '/', 1)]) AS key, unnest([0, 1]) AS rank FROM h), m AS (SELECT src, target, arg_min(key, rank) AS dst FROM k JOIN f USING (key) WHERE key <> '' GROUP BY ALL) SELECT DISTINCT src, dst FROM m")
def import_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages to the sections of pages that their links name."""
    p = table(spark, sf_dir, "pages")
    imports = p.select(F.col("page_id").alias("src"), F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("target"))
    section = F.element_at(F.split(F.regexp_replace("url", "^[a-z]+://[^/]*/", ""), "/"), 1)
    return resolve.import_edges(imports, p.select(section.alias("key"), section.alias("file"))).select("src", "dst").distinct()


@query(f"WITH {LINKS}, k AS (SELECT page_id, target, split_part(trim(target, '/'), '/', 1) AS key FROM h) SELECT page_id, count(*)::BIGINT AS n_unresolved FROM k WHERE key NOT IN (SELECT key FROM f) GROUP BY page_id")
def unresolved_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    keys = p.select(F.element_at(F.split(F.regexp_replace("url", "^[a-z]+://[^/]*/", ""), "/"), 1).alias("key")).distinct()
    links = p.select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("target"))
    links = links.withColumn("key", F.element_at(F.split(F.regexp_replace("target", "^/+|/+$", ""), "/"), 1))
    return links.join(keys, "key", "left_anti").groupBy("page_id").agg(F.count(F.lit(1)).alias("n_unresolved"))


@query("""WITH o AS (SELECT doc_id AS path, md5(text) AS was FROM documents WHERE doc_id % 10 <> 0), n AS (SELECT doc_id AS path, md5(CASE WHEN doc_id % 7 = 0 THEN text || '!' ELSE text END) AS now FROM documents WHERE doc_id % 11 <> 0)
SELECT CASE WHEN was IS NULL THEN 'added' WHEN now IS NULL THEN 'removed' WHEN was <> now THEN 'changed' ELSE 'same' END AS change, count(*)::BIGINT AS n, sum(path)::BIGINT AS paths FROM o FULL JOIN n USING (path) GROUP BY 1""")
def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    old = d.filter("doc_id % 10 != 0").select(F.col("doc_id").alias("path"), F.md5("text").alias("hash"))
    new = d.filter("doc_id % 11 != 0").select(F.col("doc_id").alias("path"), F.md5(F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))).alias("hash"))
    return state.diff(old, new).groupBy("change").agg(F.count(F.lit(1)).alias("n"), F.sum("path").alias("paths"))


@query("""WITH o AS (SELECT doc_id AS path, md5(text) AS was FROM documents WHERE doc_id % 10 <> 0), n AS (SELECT doc_id AS path, md5(text) AS now FROM documents),
c AS (SELECT was IS NULL AS changed FROM o FULL JOIN n USING (path)) SELECT sum(changed::BIGINT)::BIGINT AS n_changed, round(avg(changed::INTEGER), 6) AS ratio, sum(changed::BIGINT) > 10 OR avg(changed::INTEGER) > 0.3 AS "full" FROM c""")
def rebuild_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.md5("text").alias("hash"))
    return state.scope(state.diff(d.filter("path % 10 != 0"), d)).withColumn("ratio", F.round("ratio", 6))


MUTATIONS = """m AS (SELECT user_id AS id, ts AS tm, event_id AS seq, CASE event_type WHEN 'view' THEN 'analyse' WHEN 'click' THEN 'analyse' WHEN 'purchase' THEN 'remove' WHEN 'signup' THEN 'keep' ELSE 'false_positive' END AS kind, value AS confidence FROM events),
l AS (SELECT id, arg_max(kind, {a: tm, b: seq}) AS kind, arg_max(confidence, {a: tm, b: seq}) FILTER (WHERE kind = 'analyse') AS confidence, count(*) FILTER (WHERE kind <> 'analyse') AS n_res, count(*)::BIGINT AS n_mutations, max(tm) AS tm FROM m GROUP BY id)"""


def mutations(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type").isin("view", "click"), "analyse").when(F.col("event_type") == "purchase", "remove").when(F.col("event_type") == "signup", "keep").otherwise("false_positive")
    return e.select(F.col("user_id").alias("id"), F.col("ts").alias("at"), F.col("event_id").alias("seq"), kind.alias("kind"), F.col("value").alias("confidence"), F.lit(None).cast("string").alias("note"))


@query(f"""WITH {MUTATIONS} SELECT id, CASE kind WHEN 'analyse' THEN 'Pending' WHEN 'remove' THEN 'Removed' WHEN 'keep' THEN 'Kept' ELSE 'FalsePositive' END AS outcome, confidence,
CASE WHEN kind = 'analyse' AND n_res > 0 THEN '{state.NOTE}' END AS notes, n_mutations FROM l""")
def ledger_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.folded(mutations(spark, sf_dir)).drop("outcome_date")


@query(f"""WITH {MUTATIONS} SELECT CASE kind WHEN 'analyse' THEN 'Pending' WHEN 'remove' THEN 'Removed' WHEN 'keep' THEN 'Kept' ELSE 'FalsePositive' END AS outcome, count(*)::BIGINT AS n, round(avg(confidence), 6) AS mean_confidence FROM l GROUP BY 1""")
def ledger_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.stats(state.folded(mutations(spark, sf_dir))).withColumn("mean_confidence", F.round("mean_confidence", 6))


@query("""WITH g AS (SELECT user_id AS file, count(*)::BIGINT AS n, max(ts) AS last FROM events GROUP BY 1) SELECT file, n, round(n / max(n) OVER () * 0.7 + 0.3 / (floor((epoch(TIMESTAMP '2024-02-01') - floor(epoch(last))) / 86400) + 1), 6) AS score FROM g""")
def activity_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "events").select(F.col("user_id").alias("file"), F.col("ts").alias("at"))
    return state.activity(c, F.lit("2024-02-01 00:00:00").cast("timestamp")).withColumn("score", F.round("score", 6))


@query("""WITH r AS (SELECT (row_number() OVER (ORDER BY ts, event_id) - 1) AS i, count(*) OVER () AS n, event_type FROM events), w AS (SELECT least(i // (n // 5), 4)::INTEGER AS "window", event_type FROM r)
SELECT "window", count(*)::BIGINT AS n_test, (sum(count(*)) OVER (ORDER BY "window") - count(*))::BIGINT AS n_train, sum((event_type = 'error')::BIGINT)::BIGINT AS n_errors FROM w GROUP BY "window" """)
def temporal_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five windows of equal counts by time, the rest in the last; each is tested on what came before."""
    e = table(spark, sf_dir, "events").select("ts", "event_id", "event_type")
    n = e.count()
    win = F.least(F.floor((F.col("place") - 1) / max(n // 5, 1)), F.lit(4)).cast("int")
    g = placed(e, F.asc("ts"), F.asc("event_id")).groupBy(win.alias("window")).agg(F.count(F.lit(1)).alias("n_test"), F.sum((F.col("event_type") == "error").cast("bigint")).alias("n_errors"))
    return g.select("window", "n_test", F.coalesce(F.sum("n_test").over(Window.orderBy("window").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("n_train"), "n_errors")


@query("""SELECT doc_id, (CASE WHEN text = '' THEN 1 ELSE least(1 + list_sum(list_transform(string_split(text, chr(10)), lambda x: (contains(x, 'if') OR contains(x, 'else if'))::INTEGER + contains(x, 'else if')::INTEGER + contains(x, 'for')::INTEGER + contains(x, 'while')::INTEGER + contains(x, 'loop')::INTEGER + contains(x, 'match')::INTEGER + contains(x, 'switch')::INTEGER
 + contains(x, 'case')::INTEGER + contains(x, '&&')::INTEGER + contains(x, '||')::INTEGER + contains(x, '?')::INTEGER + contains(x, 'catch')::INTEGER + contains(x, 'try')::INTEGER + contains(x, 'unwrap')::INTEGER + contains(x, 'expect')::INTEGER)), 50) END)::DOUBLE AS cyclomatic FROM documents WHERE text IS NOT NULL""")
def line_complexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", t.line_complexity(F.col("text"))["cyclomatic"].alias("cyclomatic"))


@query("SELECT s_suppkey, CASE WHEN s_acctbal <= 5 THEN 'low' WHEN s_acctbal <= 10 THEN 'medium' WHEN s_acctbal <= 20 THEN 'high' ELSE 'very_high' END AS bucket, 'id_' || substr(sha256(s_name || '|' || s_nationkey), 1, 16) AS id FROM supplier")
def stable_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select("s_suppkey", t.complexity_bucket(F.col("s_acctbal")).alias("bucket"), t.stable_id("id_", 16, F.col("s_name"), F.col("s_nationkey")).alias("id"))
