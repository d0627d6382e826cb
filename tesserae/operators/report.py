"""Reports as tables of lines and rows, and their writing: JSON, JSONL, markdown, DOT, RAG chunks."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.functions import lines as li
from tesserae.functions import text as t
from tesserae.operators.iterate import ship


def jsonl(df: DataFrame) -> DataFrame:
    """line: each row as JSON, fields in the order of the columns."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("line"))


def write_jsonl(df: DataFrame, path: str) -> None:
    jsonl(df).write.mode("overwrite").text(path)


def markdown(df: DataFrame, columns: list[str]) -> DataFrame:
    """line: each row as a line of a markdown table (the head is `markdown_head`)."""
    cells = [F.coalesce(F.regexp_replace(F.col(c).cast("string"), "[|\n]", " "), F.lit("")) for c in columns]
    return df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))


def markdown_head(columns: list[str]) -> str:
    return f"| {' | '.join(columns)} |\n|{' --- |' * len(columns)}"


def rag_chunks(df: DataFrame, id_col: str, text: str, tags: list[str], most_tokens: int = 512) -> DataFrame:
    """id, chunk (from 0), content (the text's chunks in order, up to the token limit, cut at line ends), tokens, tags, context."""
    shown = [F.concat(F.lit(f"{c}:"), F.coalesce(F.col(c).cast("string"), F.lit("-"))) for c in tags]
    rows = df.select(F.col(id_col).alias("id"), F.array_join(F.array(*shown), ",").alias("tags"), F.posexplode_outer(t.chunked(F.col(text), most_tokens)).alias("chunk", "content"))
    return rows.select("id", F.coalesce("chunk", F.lit(0)).alias("chunk"), "content", t.token_estimate(F.col("content")).alias("tokens"), "tags", F.concat(F.lit("chunk "), F.col("id").cast("string"), F.lit(" ["), F.col("tags"), F.lit("]")).alias("context"))


def packed(df: DataFrame, group: str, order: str, size: str, most: int) -> DataFrame:
    """df's columns with chunk (from 0 in each group): rows in order are packed until the next would go over `most`; a larger row is alone.

    Where a chunk ends depends on where all before it did, so a group's rows pass through one task, one by one: nothing is held but the running sum.
    """
    import pandas as pd

    names = df.columns
    ship(df.sparkSession)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, chunk, used = object(), 0, 0
        for p in parts:
            chunks = []
            for g, n in zip(p[group], p[size], strict=True):
                if g != last and not (pd.isna(g) and last is None):
                    last, chunk, used = None if pd.isna(g) else g, 0, n
                elif used + n > most:
                    chunk, used = chunk + 1, n
                else:
                    used += n
                chunks.append(chunk)
            yield p.assign(chunk=chunks)[[*names, "chunk"]]

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.repartition(group).sortWithinPartitions(group, order).mapInPandas(run, f"{kinds}, chunk bigint")


def layers(f: DataFrame, importance: Column, k: int = 3) -> DataFrame:
    """layer, n, top, description, colour for functions (layer, name, node): size and the k names of most importance, ties to the smaller node.

    Ranks are limited to k in each task before rows of a layer meet, so that a large layer is no burden.
    """
    named = f.select("layer", "name", "node", importance.alias("i"))
    rank = F.row_number().over(Window.partitionBy("layer").orderBy(F.desc("i"), "node"))
    best = named.withColumn("r", rank).filter(F.col("r") <= k)
    top = best.groupBy("layer").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "name"))), lambda x: x["name"]), ", ").alias("top"))
    sizes = named.groupBy("layer").agg(F.count(F.lit(1)).alias("n"))
    return sizes.join(top, "layer").select("layer", "n", "top", li.layer_description(F.col("layer")).alias("description"), li.layer_colour(F.col("layer")).alias("colour"))


def histogram(df: DataFrame, column: str, edges: list[float]) -> DataFrame:
    """bucket, n: rows between successive edges, half open; 0 is below the first."""
    b = F.lit(0)
    for i, e in enumerate(edges, 1):
        b = F.when(F.col(column) >= e, i).otherwise(b)
    return df.filter(F.col(column).isNotNull()).groupBy(b.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
