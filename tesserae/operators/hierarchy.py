"""Types and their supertypes, files and their imports, commits and their authors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.operators import graph
from tesserae.operators.iterate import written


def inheritance_depth(extends: DataFrame) -> DataFrame:
    """node, depth: the number of steps up to a type without supertypes, each to the first supertype.

    extends: (src sub, dst super, and ord, the supertype's place; without ord the least counts as first). Types that only lead into a cycle are left out.
    """
    first = F.min(F.struct("ord", "dst") if "ord" in extends.columns else F.struct("dst")).alias("f")
    extends = extends.groupBy("src").agg(first).select("src", F.col("f.dst").alias("dst"))
    down = graph.reversed_edges(extends)
    tops = extends.select(F.col("dst").alias("node")).distinct().join(extends.select(F.col("src").alias("node")).distinct(), "node", "left_anti")
    return graph.depth(down, tops)


def tops(extends: DataFrame) -> DataFrame:
    """node: the types that others extend and that extend none."""
    return extends.select(F.col("dst").alias("node")).distinct().join(extends.select(F.col("src").alias("node")).distinct(), "node", "left_anti")


def chains(extends: DataFrame, most: int = 64) -> DataFrame:
    """node, chain (array, from the first supertype up to the top), depth: each type with a supertype, up its first supertypes.

    extends as for inheritance_depth. Chains double in length each round: a chain's end is followed by that end's chain. One that
    meets a type again (a cycle), or that reaches `most`, ends there.
    """
    first = F.min(F.struct("ord", "dst") if "ord" in extends.columns else F.struct("dst")).alias("f")
    cur = written(extends.groupBy("src").agg(first).select(F.col("src").alias("node"), F.array("f.dst").alias("chain")), "chains")
    size = 1
    while size < most:
        tail = cur.select(F.col("node").alias("end"), F.col("chain").alias("tail"))
        nxt = cur.join(tail, F.element_at("chain", -1) == F.col("end"), "left").select("node", F.col("chain").alias("was"), F.coalesce("tail", F.array().cast(cur.schema["chain"].dataType)).alias("tail"))
        nxt = nxt.select("node", F.slice(F.array_distinct(F.concat("was", "tail")), 1, most).alias("chain"), "was")
        grown = written(nxt.withColumn("more", F.size("chain") > F.size("was")).drop("was"), "chains")
        cur, size = grown.select("node", "chain"), size * 2
        if not grown.filter("more").head(1):
            break
    return cur.select("node", "chain", F.size("chain").alias("depth"))


def leaves(extends: DataFrame) -> DataFrame:
    return extends.select(F.col("src").alias("node")).distinct().join(extends.select(F.col("dst").alias("node")).distinct(), "node", "left_anti")


def subtype_counts(extends: DataFrame) -> DataFrame:
    """node, n_direct."""
    return extends.groupBy(F.col("dst").alias("node")).agg(F.countDistinct("src").alias("n_direct"))


def unused_types(types: DataFrame, mentions: DataFrame) -> DataFrame:
    """types (name) that no mention (name, of signatures, fields, supertypes) names."""
    return types.join(mentions.select("name").distinct(), "name", "left_anti")


def unimported(files: DataFrame, imports: DataFrame) -> DataFrame:
    """files (file) that no import (src, dst) leads to."""
    return files.join(imports.select(F.col("dst").alias("file")).distinct(), "file", "left_anti")


def circular(imports: DataFrame) -> DataFrame:
    """node, scc of files that import each other."""
    return graph.scc(imports)


def dead_modules(functions: DataFrame) -> DataFrame:
    """file, n: files that have functions and none that is public."""
    g = functions.groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.max("is_public").alias("any"))
    return g.filter("not any").select("file", "n")


def history(commits: DataFrame) -> DataFrame:
    """file, n_commits, n_authors, first, last, churn from commits (file, author, at, added, removed)."""
    return commits.groupBy("file").agg(F.count(F.lit(1)).alias("n_commits"), F.countDistinct("author").alias("n_authors"), F.min("at").alias("first"), F.max("at").alias("last"), F.sum(F.col("added") + F.col("removed")).alias("churn"))


def top_authors(commits: DataFrame, k: int = 10) -> DataFrame:
    """author, n: the k with most commits, by name among equals."""
    return commits.groupBy("author").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "author").limit(k)
