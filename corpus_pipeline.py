"""A corpus pipeline of five stages, each calling one operator of ``orrery.llm``.

Every stage takes (spark, docs, sf_dir) and works on all that the one before it
kept; its result is written as Parquet in the shared folder and read again as
the next one's docs. All but the last return the columns of ``documents``.

Rows are judged one by one: where an id stands on several rows with different
texts, each row has its own verdict.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm import bpe, decontam, linededup, simhash, toxicity
from orrery.llm.common import table, written
from orrery.llm.registry import VOCABULARY

#: Words of a shingle and percent of similarity that make near-duplicates beside SimHash's bits.
SIMILAR = (5, 80)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under one half; the model is trained on ``docs`` and ``labels``.

    Null and empty texts stay, as do null ids; repeated rows share their fate;
    an empty table stays empty; other columns pass through.
    """
    return toxicity.without_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that five rows or more hold stay in one document only; ``n_chars`` follows the text.

    Of a line's holders that with the largest id keeps it, in all of its rows; a
    null id is the smallest. No row goes; null and empty texts stay as they are;
    an empty table stays empty; other columns pass through.
    """
    kept = linededup.dedup_lines(docs)
    return kept.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else kept


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group linked by SimHash, or by five-word shingles of a similarity of 0.8 or more: that with the smallest id.

    Of several rows with that id the one with the smallest hash of its text
    stays, of repeated rows one. Null and empty texts link like any others; rows
    with a null id stay; an empty table stays empty; other columns pass through.
    """
    return simhash.without_near_duplicates(docs, similar=SIMILAR)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text holds no item of ``benchmark``.

    Null and empty texts stay, and all rows if there are no items; repeated rows
    share their fate; an empty table stays empty; other columns pass through.
    """
    return decontam.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number and digests of the ids of each document, and of the text decoded from them.

    A row for each row; null and empty texts have no ids; an empty table gives
    an empty one; other columns are left out.
    """
    return bpe.digests(docs, public_tokenizers.path(VOCABULARY))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("simhash", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("bpe", encode),
]

#: Some stages have no form in SQL; the tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
