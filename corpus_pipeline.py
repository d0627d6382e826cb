"""From raw documents to token counts: language ID, near-duplicates, decontamination, encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tesserae.llm import bpe, decontam, langid, neardup
from tesserae.llm.common import table, written
from tesserae.llm.queries import vocabulary

#: What language_id keeps: these languages (None: all that are learned), if the prediction has this score.
LANGUAGES: list[str] | None = None
LEAST_SCORE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents in one of LANGUAGES (None: all that the labelled ones teach) with LEAST_SCORE or more.

    A text without letters goes, and so does one of 40 letters or more of which less than 0.45 stand in words that fit the
    predicted language: it is in none that was learned. A null text or an empty one has no letters; repeated rows
    are judged alike, and columns stay whatever their names. Without any labelled document all go.
    """
    return langid.accepted(docs, vocabulary("piece_bpe_32k.model"), LANGUAGES, LEAST_SCORE)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of near-duplicates, linked at 0.85 or more, one row of the least doc_id.

    Texts without words (null, empty) are in no group. Of rows that repeat a doc_id one stays; rows without doc_id are
    told apart by their texts. Columns stay whatever their names.
    """
    return neardup.deduplicated(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the rows that hold at least half of a benchmark item's words in place, or the whole of a short item.

    Each row is judged by itself, so repeated or null doc_ids change nothing. Null or empty texts stay, and so do columns
    whatever their names.
    """
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document its token count and the digests of its ids and of the decoded text; a null text counts as empty."""
    return bpe.digests(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("bpe", encode)]

#: The stages fit models, hash and tokenize; tests/llm holds them against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
