"""Commands over a source tree: python -m tesserae COMMAND ROOT [options]."""

from __future__ import annotations

import argparse
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.functions import text as t
from tesserae.operators import analyze, dedup, graph, report, state, verdict
from tesserae.operators.iterate import ship
from tesserae.sources import code, files


def judged(src: DataFrame, threshold: float) -> DataFrame:
    return analyze.verdicts_of(src, threshold)


def important(src: DataFrame, k: int) -> DataFrame:
    f, _ = analyze.facts(src)
    facts = f.select("node", "complexity", "fan_in", "fan_out", F.when(F.col("is_public"), 1.0).otherwise(0.5).alias("layer_weight"))
    return graph.importance(facts).orderBy(F.desc("importance"), "node").limit(k)


def duplicates(src: DataFrame, threshold: float) -> DataFrame:
    f = code.functions(code.parsed(src)).select("full_path", "body", "complexity", F.length("body").alias("length"))
    f = f.filter(F.size(t.lines(F.col("body"))) >= 5)
    members = dedup.clusters(f, "full_path", "body", threshold).join(f.select(F.col("full_path").alias("id"), "complexity", "length"), "id").withColumn("fan_in", F.lit(0))
    return dedup.facts(members).orderBy(F.desc("priority"), "cluster")


def decide(spark: SparkSession, ledger: str, name: str | None, removed: bool, why: str | None, out: str | None) -> int:
    """Writes the ledger with one decision to another folder, as it can't be read and replaced at once; 1 if nothing is pending under the name."""
    if not name or not out:
        print("remove and keep need --name and --out")
        return 2
    rows = files.ledger(spark, ledger)
    at = F.lit(int(time.time())).cast("long")
    left = rows.withColumnRenamed("function_name", "name")
    found = not left.filter((F.col("outcome") == "Pending") & F.col("name").contains(name)).isEmpty()
    report.write_jsonl(state.resolve_first(left, name, removed, why, at).withColumnRenamed("name", "function_name"), out)
    print(f"{'marked' if found else 'no pending function holds'} '{name}'")
    return int(not found)


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="tesserae", description=__doc__)
    p.add_argument("command", choices=["analyze", "list", "deadcode", "dedup", "important", "graph", "report", "stats", "check", "remove", "keep"])
    p.add_argument("root", help="the source tree; for remove and keep the ledger")
    p.add_argument("--name", help="remove, keep: a part of the function's name; the first pending entry by id that holds it is decided")
    p.add_argument("--why", help="remove: the commit; keep: the reason")
    p.add_argument("--threshold", type=float, help="dead from this score on (0.80); for dedup, similar from this on (0.80)")
    p.add_argument("--max-dead", type=int, default=0)
    p.add_argument("--max-ratio", type=float, default=1.0)
    p.add_argument("--top", type=int, default=20)
    p.add_argument("--out", help="folder for JSON lines in place of the terminal")
    a = p.parse_args(args)
    threshold = 0.80 if a.threshold is None else a.threshold
    spark = SparkSession.builder.appName("tesserae").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    if a.command in ("remove", "keep"):
        return decide(spark, a.root, a.name, a.command == "remove", a.why, a.out)
    src = files.scan(spark, a.root)
    if a.command == "list":
        out = code.functions(code.parsed(src)).select("full_path", "language", "line", "is_public", "complexity").orderBy("full_path")
    elif a.command == "dedup":
        out = duplicates(src, threshold)
    elif a.command == "important":
        out = important(src, a.top)
    elif a.command == "graph":
        out = graph.dot(analyze.facts(src)[1])
    else:
        v = judged(src, threshold)
        if a.command == "check":
            row = verdict.gate(v, a.max_dead, a.max_ratio).first()
            print(f"dead: {row.n_dead}, ratio: {row.ratio:.3f}, {'passed' if row.passed else 'failed'}")
            return int(not row.passed)
        dead = v.filter(F.col("state").isin("DefinitelyDead", "ProbablyDead")).orderBy(F.desc("dead_score"), "node")
        out = {"analyze": v.orderBy("node"), "deadcode": dead, "report": report.markdown(dead, ["node", "state", "dead_score", "recommendation"]), "stats": verdict.stats(v)}[a.command]
    if a.out:
        report.write_jsonl(out, a.out)
    else:
        for row in out.limit(a.top).toJSON().collect() if a.command != "report" else [report.markdown_head(["node", "state", "dead_score", "recommendation"]), *(r.line for r in out.limit(a.top).collect())]:
            print(row)
    return 0


if __name__ == "__main__":
    sys.exit(main())
