"""Registered queries ``opN_<name>`` and, where SQL can express them, their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from orrery.llm import bpe, decontam, divergence, lexical, licenses, linededup, minhash, pii, quality, secrets, simhash, tokenfile, toxicity
from orrery.llm.common import shared_folder, table

#: The vocabulary file that the token queries use.
VOCABULARY = "word_bpe_49k.json"
#: The key of the registered query; a real job passes a secret of its own.
PSEUDONYM_KEY = "registered-query"


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of each text, their digest and that of the text decoded from them; see ``bpe.digests``."""
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text with pseudonyms for personal data; see ``pii.pseudonymised``."""
    return pii.pseudonymised(table(spark, sf_dir, "documents"), PSEUDONYM_KEY)


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints and components at three bits; see ``simhash.near_duplicates``."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License notices and texts with their places; see ``licenses.scan``."""
    return licenses.scan(table(spark, sf_dir, "documents"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and spans of secrets; see ``secrets.scan``."""
    return secrets.scan(table(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, and which; see ``decontam.contaminated``."""
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repetition and the other rules of quality; see ``quality.verdicts``."""
    return quality.verdicts(table(spark, sf_dir, "documents"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines before and after those that others keep are dropped; see ``linededup.digests``."""
    return linededup.digests(table(spark, sf_dir, "documents"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token files written and read back; see ``tokenfile.write`` and ``read_all``."""
    to = shared_folder(spark)
    tokenfile.write(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), to)
    return tokenfile.read_all(spark, to)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of a model that is trained on the rows that aren't held out; see ``toxicity.predictions``."""
    return toxicity.predictions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of each item, over an index built for it; see ``lexical.build`` and ``search``."""
    return lexical.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), shared_folder(spark))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the sources of each language differ; see ``divergence.audit``."""
    return divergence.audit(table(spark, sf_dir, "documents"))


def op13_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of three-word shingle sets at a similarity of 0.85; see ``minhash.near_duplicates``."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_bpe": op1_bpe,
    "op2_pii": op2_pii,
    "op3_simhash": op3_simhash,
    "op4_licenses": op4_licenses,
    "op5_secrets": op5_secrets,
    "op6_decontamination": op6_decontamination,
    "op7_quality": op7_quality,
    "op8_line_dedup": op8_line_dedup,
    "op9_token_files": op9_token_files,
    "op10_toxicity": op10_toxicity,
    "op11_ranked_search": op11_ranked_search,
    "op12_source_divergence": op12_source_divergence,
    "op13_minhash": op13_minhash,
}
ORACLES: dict[str, str] = {
    "op7_quality": quality.ORACLE,
    "op8_line_dedup": linededup.ORACLE,
    "op11_ranked_search": lexical.ORACLE,
    "op12_source_divergence": divergence.ORACLE,
    "op13_minhash": minhash.ORACLE,
}
