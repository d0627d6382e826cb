"""The analysis of source files from end to end: parse, resolve calls, reach, score, judge."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserae.functions import frameworks, rules
from tesserae.functions import text as t
from tesserae.operators import graph, learn, references, resolve, verdict
from tesserae.operators.iterate import written
from tesserae.sources import code


# (pattern, group of the variable, group of its type)
TYPED = (
    (r"\b(\w+)\s*:\s*&?\s*(?:mut\s+|dyn\s+)*([A-Z]\w*)", 1, 2),
    (r"\b(\w+)\s*(?::=|=)\s*&?\s*(?:await\s+)?(?:new\s+)?([A-Z]\w*)\s*(?:\(|\{|::\w+\s*\()", 1, 2),
    (r"\b([A-Z]\w*)(?:<[^<>]*>)?[&*\s]+(\w+)\s*(?:=|;)", 2, 1),
)


def variables(functions: DataFrame) -> DataFrame:
    """caller, variable, type: variables and parameters whose type their function tells, by annotation or constructor; those of more than one type are left out."""
    text = F.concat_ws("\n", F.array_join("params", "\n"), "body")
    rows = [functions.select(F.col("full_path").alias("caller"), F.explode(F.arrays_zip(F.regexp_extract_all(text, F.lit(p), F.lit(v)).alias("variable"), F.regexp_extract_all(text, F.lit(p), F.lit(k)).alias("type"))).alias("x")) for p, v, k in TYPED]
    every = rows[0]
    for r in rows[1:]:
        every = every.unionAll(r)
    g = every.select("caller", "x.variable", "x.type").distinct().groupBy("caller", "variable").agg(F.count(F.lit(1)).alias("n"), F.min("type").alias("type"))
    return g.filter("n = 1").select("caller", "variable", "type")


def call_edges(functions: DataFrame, imports: DataFrame) -> DataFrame:
    """src, dst, method, confidence, line of resolved calls.

    Methods on self are looked up in their own container, members by the qualifier: a type, a module that the file imports, or
    a variable of known type; bare names in the file, by import, in modules imported as a whole, and anywhere.
    """
    last = lambda c: F.element_at(F.split(F.regexp_replace(c, "::|[./\\\\]+", "/"), "/"), -1)
    sites = code.call_sites(functions).withColumn("call", F.concat_ws("#", "caller", F.col("ord").cast("string")))
    sites = sites.withColumns({"last": last(F.col("qualifier")), "is_self": F.col("kind") == "SelfMethod"})
    of = imports.select(F.col("file").alias("f"), F.col("item").alias("i"), last(F.col("module")).alias("import"))
    named = of.filter("i is not null and i != '*'").groupBy("f", "i").agg(F.min("import").alias("import"))
    whole = of.filter("i = '*'").groupBy(F.col("f").alias("wf")).agg(F.collect_set("import").alias("wildcards"))
    known = of.select(F.col("f").alias("kf"), F.explode(F.array_compact(F.array("i", "import"))).alias("qualifier_module")).distinct()
    typed = variables(functions).select(F.col("caller").alias("c"), F.col("variable").alias("v"), F.col("type").alias("receiver_type"))
    sites = sites.join(named, (F.col("file") == F.col("f")) & (F.col("name") == F.col("i")) & F.col("qualifier").isNull(), "left")
    sites = sites.join(whole, F.col("file") == F.col("wf"), "left").join(known, (F.col("file") == F.col("kf")) & (F.col("last") == F.col("qualifier_module")), "left")
    sites = sites.join(typed, (F.col("caller") == F.col("c")) & (F.col("qualifier") == F.col("v")), "left")
    own = F.when(F.col("is_self"), F.col("container"))
    sites = sites.select("call", "caller", "file", own.alias("container"), own.alias("self_type"), "name", "import", "line", F.when(~F.col("is_self"), F.col("last")).alias("qualifier"), "qualifier_module", "receiver_type", F.when(F.col("qualifier").isNull(), F.col("wildcards")).alias("wildcards"))
    sites = written(sites, "sites")  # each strategy reads it
    stem = F.regexp_extract("file", "([^/]+?)(\\.[^./]+)?$", 1)
    definitions = functions.select(F.col("full_path").alias("target"), "file", "container", "name", stem.alias("module"))
    res = resolve.resolved(sites, definitions, resolve.FULL)
    return res.filter("target is not null").join(sites.select("call", "caller", "line"), "call").select(F.col("caller").alias("src"), F.col("target").alias("dst"), "method", "confidence", "line")


def facts(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(functions with fan, reachability, depth and protection; edges) of source files (path, language, source)."""
    p = written(code.parsed(files), "parsed")
    f = code.functions(p)
    # overloads and others of one path are told apart by their order in the file
    same = Window.partitionBy("full_path")
    f = f.withColumns({"times": F.count(F.lit(1)).over(same), "nth": F.row_number().over(same.orderBy("line", "end_line", "body"))})
    f = f.withColumn("full_path", F.when(F.col("times") > 1, F.concat_ws("@", "full_path", F.col("nth").cast("string"))).otherwise(F.col("full_path"))).drop("times", "nth")
    e = written(call_edges(f, code.imports(p)), "calls")
    c = F.col
    by_framework = frameworks.is_root(c("language"), c("file"), c("name")) | frameworks.is_marked(c("language"), F.array_join("decorators", "\n"))
    f = f.withColumn("root_kind", F.coalesce(rules.root_kind(c("is_test"), c("name"), c("file"), c("is_public"), c("doc")), F.when(by_framework, "framework")))
    roots = f.filter("root_kind is not null").select(c("full_path").alias("node"))
    reached = graph.depth(e, roots).select(c("node").alias("n"), c("depth"))
    out = f.join(graph.fan(e).select(c("node").alias("m"), "fan_in", "fan_out"), c("full_path") == c("m"), "left").join(reached, c("full_path") == c("n"), "left")
    out = out.select(
        c("full_path").alias("node"), "name", "file", "language", "container", "line", "end_line", "is_public", "is_async", "is_test", "trait_impl", "complexity", "doc", "body", "root_kind", F.coalesce("fan_in", F.lit(0)).alias("fan_in"),
        F.coalesce("fan_out", F.lit(0)).alias("fan_out"), c("n").isNotNull().alias("reachable"), F.coalesce("depth", F.lit(0)).alias("depth"),
    )
    level = rules.protection(c("name"), c("file"), c("is_test"), c("trait_impl"), c("is_public"), c("doc"))
    return out.withColumn("protection", level).withColumn("layer", rules.layer_of(c("file"))).withColumn("body_hash", t.body_hash(c("body"), c("node"), 20)), e


def verdicts_of(files: DataFrame, dead: float = 0.80, model: tuple | None = None, features: list[str] | None = None, least: float = 0.6) -> DataFrame:
    """node, state, dead_score, recommendation, protection, fan_in, reachable. Protected functions are alive, whatever their score.

    A function whose name a source refers to dynamically, with a confidence of `least` or more, counts as referenced. model: a
    fitted one (learn.fit) over numeric columns of the facts, `features`, which gives the model's share of the score.
    """
    f, _ = facts(files)
    named = references.matched(references.found(files), f.select("node", "name")).filter(F.col("confidence") >= least).select(F.col("node").alias("named")).distinct()
    f = f.join(named, F.col("node") == F.col("named"), "left").withColumn("dynamic", F.col("named").isNotNull()).drop("named")
    f = f.withColumn("ml_dead", learn.predict(model, features or []) if model else F.lit(None).cast("double"))
    v = verdict.verdicts(f, dead)
    safe = F.col("protection") == "Protected"
    return v.select("node", F.when(safe, "DefinitelyAlive").otherwise(F.col("state")).alias("state"), F.when(safe, 0.0).otherwise(F.round("dead_score", 6)).alias("dead_score"), F.when(safe, "DoNotDelete").otherwise(F.col("recommendation")).alias("recommendation"), "protection", "fan_in", "reachable")


def made_files(parts: DataFrame) -> DataFrame:
    """Python files from a parts table: a function for each part, which calls the brand's next."""
    w = Window.partitionBy("p_brand", F.floor(F.col("p_partkey") / 500)).orderBy("p_partkey")
    name = lambda k: F.concat(F.lit("part_"), k.cast("string"))
    nxt = F.lead("p_partkey").over(w)
    head = F.concat(F.when(F.col("p_size") % 3 == 0, "def ").otherwise("def _"), name(F.col("p_partkey")), F.lit("(x):\n"))
    called = F.lead(F.concat(F.when(F.col("p_size") % 3 == 0, "").otherwise("_"), name(F.col("p_partkey")))).over(w)
    body = F.when(nxt.isNotNull() & (F.col("p_size") % 4 != 0), F.concat(F.lit("    return "), called, F.lit("(x)\n"))).otherwise("    return x\n")
    rows = parts.select("p_brand", F.floor(F.col("p_partkey") / 500).alias("block"), "p_partkey", F.concat(head, body).alias("code"))
    g = rows.groupBy("p_brand", "block").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("p_partkey", "code"))), lambda s: s["code"]), "\n").alias("source"))
    path = F.concat(F.lit("pkg/"), F.lower(F.replace("p_brand", F.lit("#"), F.lit("_"))), F.lit("_"), F.col("block").cast("string"), F.lit(".py"))
    return g.select(path.alias("path"), F.lit("python").alias("language"), "source")
