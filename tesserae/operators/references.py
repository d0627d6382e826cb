"""Dynamic references (reflection, imports and dispatch by name) in sources, and their match with functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# (kind, language or * for all, pattern whose first group is what is referred to, confidence)
RULES = (
    ("reflection", "python", r"getattr\(\s*[\w.]+\s*,\s*['\"](\w+)['\"]", 0.9),
    ("dynamic_import", "python", r"import_module\(\s*['\"]([\w.]+)['\"]", 0.9),
    ("dynamic_import", "javascript", r"(?:import|require)\(\s*['\"]([^'\"]+)['\"]\s*\)", 0.9),
    ("dynamic_import", "typescript", r"(?:import|require)\(\s*['\"]([^'\"]+)['\"]\s*\)", 0.9),
    ("reflection", "java", r"getMethod\(\s*\"(\w+)\"", 0.9),
    ("reflection", "java", r"Class\.forName\(\s*\"([\w.]+)\"", 0.9),
    ("reflection", "csharp", r"GetMethod\(\s*(?:nameof\()?\"?(\w+)\"?", 0.9),
    ("reflection", "go", r"MethodByName\(\s*\"(\w+)\"", 0.9),
    ("trait_object", "rust", r"dyn\s+(\w+)", 0.6),
    ("callback", "php", r"call_user_func(?:_array)?\(\s*['\"](\w+)['\"]", 0.9),
    ("registration", "*", r"register\w*\(\s*['\"]?(\w+)", 0.7),
    ("event", "*", r"\.(?:on|addEventListener|subscribe)\(\s*['\"](\w+)['\"]", 0.6),
    ("table", "*", r"['\"]\w+['\"]\s*:\s*([A-Za-z_]\w*)\s*[,}]", 0.5),
)


def found(files: DataFrame, rules: tuple = RULES) -> DataFrame:
    """file, kind, target, confidence, n: each reference once, from files (path, language, source)."""
    def of(kind: str, lang: str, pattern: str, confidence: float) -> Column:
        hits = F.regexp_extract_all("source", F.lit(pattern), F.lit(1))
        rows = F.transform(hits, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("target"), F.lit(confidence).alias("confidence")))
        return F.when(F.lit(lang == "*") | (F.col("language") == lang), rows)

    tries = [of(*r) for r in rules]
    flat = files.select(F.col("path").alias("file"), F.explode(F.flatten(F.array_compact(F.array(*tries)))).alias("r")).select("file", "r.*")
    return flat.filter("target != ''").groupBy("file", "kind", "target").agg(F.max("confidence").alias("confidence"), F.count(F.lit(1)).alias("n"))


def matched(refs: DataFrame, functions: DataFrame, contained: bool = False) -> DataFrame:
    """node, kind, confidence: functions (node, name) whose name a reference's last part is; contained: or that any part of it is."""
    parts = F.split("target", "[./:]+")
    key = F.explode(F.array_distinct(parts) if contained else F.array(F.element_at(parts, -1)))
    keyed = refs.select(key.alias("name"), "kind", "confidence").groupBy("name", "kind").agg(F.max("confidence").alias("confidence"))
    return functions.select("node", "name").join(keyed, "name").select("node", "kind", "confidence")
