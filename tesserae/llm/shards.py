"""Rendezvous hashing of record keys over weighted shards, with DataFrame functions only.

Each shard scores each key by weight / -ln(u), where u in (0, 1) comes from a hash of key and shard, and the key
goes to the shard with the greatest score. A shard's share is its weight's share, and a further shard only
takes keys to itself: nothing moves between the others.

Slots number the rows of each shard from 0 without gaps. Rows are put into (shard, bucket) groups by a hash of
the key and the text's checksum; each group is numbered by itself behind the sum of the groups before it. So no
shard, which holds a fixed part of all rows however many there are, is gathered in one task. The table of
groups has MOST_GROUPS rows at most, however many shards there are (more than that are an error), and that bounds what is
broadcast.

Defined results: a null key counts as a key of its own (all null keys go to one shard); a null text has size 1
and checksum 0; an empty table gives an empty result. Rows that repeat a key go to the same shard with slots of
their own. Rows equal in key, size and checksum share a group. Other columns, whatever their names, are
not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 4096
MOST_GROUPS = 1 << 18


def _score(key: Column, shard: int, weight: float) -> Column:
    # 52 bits of the hash, so that u is exact in a double and neither 0 nor 1
    u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(shard)), 12).cast("double") + 0.5) / float(1 << 52)
    return F.lit(float(weight)) / -F.log(u)


def shard_of(key: Column, weights: list[float]) -> Column:
    """The shard, from 0, to which key belongs; ties, of which there are practically none, go to the smaller shard."""
    if not weights or any(not w > 0 for w in weights):
        raise ValueError("weights must be given and above 0")
    scored = [F.struct(_score(key, s, w).alias("score"), F.lit(-s).alias("shard")) for s, w in enumerate(weights)]
    return -(F.greatest(*scored) if len(scored) > 1 else scored[0]).getField("shard")


def sharded(docs: DataFrame, weights: list[float], key: str = "doc_id", text: str = "text", grown_weight: float = 1.0) -> DataFrame:
    """doc_id (the key), size, text_crc32, law, shard, slot and grown_shard (with one more shard of grown_weight) of each row."""
    n = len(weights)
    if n > MOST_GROUPS:
        raise ValueError(f"more than {MOST_GROUPS} shards")
    buckets = max(1, min(BUCKETS, MOST_GROUPS // n)) if n else 1
    rows = docs.select(
        F.col(key).alias("doc_id"),
        (F.coalesce(F.octet_length(F.col(text)), F.lit(0)) + 1).cast("bigint").alias("size"),
        F.coalesce(F.crc32(F.col(text)), F.lit(0)).cast("bigint").alias("text_crc32"),
    )
    # nulls pass through xxhash64 without changing the seed: a key's own flag keeps them apart
    k = F.struct(F.col("doc_id").isNull(), F.col("doc_id"))
    placed = rows.withColumn("grown_shard", shard_of(k, [*weights, grown_weight]))
    placed = placed.withColumn("shard", shard_of(k, weights)).withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(buckets)).cast("int"))
    groups = placed.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    starts = groups.select(F.col("shard").alias("s"), F.col("bucket").alias("b"), F.coalesce(before, F.lit(0)).alias("start"))
    within = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size"))
    out = placed.withColumn("within", within).join(F.broadcast(starts), (F.col("shard") == F.col("s")) & (F.col("bucket") == F.col("b")))
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), F.col("shard").cast("int").alias("shard"),
        (F.col("start") + F.col("within") - 1).cast("bigint").alias("slot"), F.col("grown_shard").cast("int").alias("grown_shard"), F.lit(n).alias("n_shards"),
    )
