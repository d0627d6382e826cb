"""Scanning source trees, and readers of records: commit logs, ledgers, training examples, configuration."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.functions import rules

# Directories that a scan leaves out, and the extensions it takes.
SKIP = (".git", "node_modules", "target", "build", "dist", ".dart_tool", "__pycache__", "vendor", ".venv", "venv", "coverage", ".idea", ".vscode")


@dataclass(frozen=True)
class ScanConfig:
    extensions: tuple[str, ...] = tuple(rules.LANGUAGE_OF)
    skip: tuple[str, ...] = SKIP
    exclude: tuple[str, ...] = ()
    exclude_names: tuple[str, ...] = field(default=(".min.js", ".bundle.js", ".d.ts"))
    most_bytes: int = 1_000_000


def scan(spark: SparkSession, root: str, config: ScanConfig = ScanConfig()) -> DataFrame:
    """path, language, source, hash of the source files under root. The size and path filters act before contents are read."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    ext = F.element_at(F.split("path", "\\."), -1)
    df = df.filter((F.col("length") > 0) & (F.col("length") <= config.most_bytes) & ext.isin(*config.extensions))
    df = df.filter(~F.col("path").rlike("/(" + "|".join(map(re.escape, config.skip)) + ")/"))
    for part in config.exclude:
        df = df.filter(~F.col("path").contains(part))
    for tail in config.exclude_names:
        df = df.filter(~F.col("path").endswith(tail))
    source = F.decode("content", "UTF-8")
    return df.select("path", rules.language_of(F.col("path")).alias("language"), source.alias("source"), F.sha2("content", 256).alias("hash"))


def commits(spark: SparkSession, path: str) -> DataFrame:
    """file, hash, author, at, added, removed from the text of `git log --numstat --format=@%H|%an|%ct`.

    The log is read as a whole text for each file, cut at commit marks and then at lines; a commit of any size is one row's array.
    """
    raw = spark.read.option("lineSep", "\n@").text(path)
    head = F.split(F.regexp_replace("value", "^@", ""), "\n")
    # the author's name is what stands between the first and the last bar
    first = F.element_at(head, 1)
    h = F.array(F.substring_index(first, "|", 1), F.regexp_extract(first, "^[^|]*\\|(.*)\\|[^|]*$", 1), F.substring_index(first, "|", -1))
    rows = raw.select(h.alias("h"), F.explode(F.slice(head, 2, F.size(head))).alias("line")).filter("line like '%\t%\t%'")
    cells = F.split("line", "\t")
    number = lambda c: F.coalesce(c.try_cast("long"), F.lit(0))
    at = F.element_at("h", -1).try_cast("long")
    return rows.select(F.element_at(cells, 3).alias("file"), F.element_at("h", 1).alias("hash"), F.element_at("h", 2).alias("author"), F.timestamp_seconds(at).alias("at"), number(F.element_at(cells, 1)).alias("added"), number(F.element_at(cells, 2)).alias("removed"))


LEDGER = "id string, function_name string, full_path string, file string, line long, confidence double, project string, verdict_date long, outcome string, outcome_date long, notes string, removed_commit string"
EXAMPLE = "function_name string, full_path string, file string, language string, label string, confidence double, source string, repository_id string, commit_hash string, dataset_split string, label_source string, created_at long"


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """A ledger written as JSON lines or as a JSON array, whose objects may each take several lines; missing fields are null, a missing outcome is Pending.

    Lines are read line by line, so files of any size can be split; only files that start with [ are read as a whole.
    """
    lines = spark.read.text(path).withColumn("of", F.input_file_name())
    arrays = [r[0] for r in lines.filter(F.ltrim("value").startswith("[")).select("of").distinct().toLocalIterator()]
    whole = spark.read.schema(LEDGER).option("multiLine", True).json(arrays) if arrays else None
    rows = lines.filter(~F.col("of").isin(*arrays)) if arrays else lines
    df = rows.filter(F.trim("value") != "").select(F.from_json("value", LEDGER).alias("r")).select("r.*")
    df = df if whole is None else df.unionAll(whole)
    return df.withColumn("outcome", F.coalesce("outcome", F.lit("Pending")))


def examples(spark: SparkSession, path: str) -> DataFrame:
    """Training examples as JSON lines; the repository's id is the file's stem where a row has none, the label Unknown where it has none."""
    df = spark.read.schema(EXAMPLE).json(path).withColumn("stem", F.regexp_extract(F.input_file_name(), "([^/]+?)(\\.jsonl?)?$", 1))
    out = df.withColumn("repository_id", F.coalesce("repository_id", "stem")).withColumn("label", F.coalesce("label", F.lit("Unknown"))).withColumn("confidence", F.coalesce("confidence", F.lit(1.0)))
    return out.drop("stem")
