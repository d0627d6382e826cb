"""The ledger of reviews and the snapshot diff as streams over files of mutations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tesserae.operators import state

MUTATION = "id long, at timestamp, seq long, kind string, confidence double, note string"


def mutations(spark: SparkSession, folder: str, schema: str = MUTATION, files_a_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(folder)


def follow(stream: DataFrame, log: str, ledger: str, checkpoint: str) -> StreamingQuery:
    """Appends each batch of mutations to `log`, in a folder of its own number, and writes the ledger folded from it.

    A batch that is run again writes the same folder again, and the ledger's versions are folders too, so the result is
    the same after any failure. The latest version is the one with the greatest number.
    """

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{log}/batch={number}")
        every = spark.read.option("basePath", log).schema(f"{MUTATION}, batch long").parquet(log).filter(F.col("batch") <= number).drop("batch")
        state.folded(every).write.mode("overwrite").parquet(f"{ledger}/version={number}")

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, ledger: str) -> DataFrame:
    df = spark.read.option("basePath", ledger).parquet(ledger)
    top = df.agg(F.max("version")).first()[0]
    return df.filter(F.col("version") == top).drop("version")


def counts(stream: DataFrame, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Mutations by window of event time and kind, rows later than `late` left out."""
    return stream.withWatermark("at", late).groupBy(F.window("at", window), "kind").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "kind", "n")
