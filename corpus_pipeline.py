"""A corpus pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir); what it returns is written as Parquet
and read again as the next one's ``docs``. All but the last return the columns
of ``documents``.

Defined results: null texts and texts without a letter go in the first stage;
repeated rows and copies become one row in the second, the first by id (null
last); null ids and null sources stay, a null source is a source of its own in
the mix; very long texts are handled whole; an empty table gives no rows; extra
columns, also such with the names of operators' own, are carried through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm import jaccard, langid, mixing, packing, secrets
from folioflow.llm.common import documents, is_held_out, written


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reject documents without any language: null texts and those without a letter.

    Where no language can be learned, texts with letters stay.
    """
    samples = langid.training_texts(docs.where(~is_held_out()))
    spoken = (F.col("lang_pred") != "und") | F.col("text").rlike(r"\p{L}")
    return langid.identify(docs, samples).where(spoken).select(*docs.columns)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document, the one with the smallest id, of each group of near copies."""
    return jaccard.deduplicated(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace secrets and linked credential parts; keep all documents."""
    clean = secrets.redact(docs)
    if "n_chars" not in docs.columns:
        return clean
    return clean.withColumn("n_chars", F.char_length(F.coalesce("text", F.lit(""))).cast("long"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Draw documents so that the sources' words come near their targets."""
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces in windows of up to 4096 tokens."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", language_id),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("secret_scan", secret_scan),
    ("source_mix", source_mix),
    ("packing", pack),
]

#: Tokenisation and near-duplicate search are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
