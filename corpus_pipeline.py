"""The corpus pipeline: five stages over ``documents``, each on all that the stage before kept.

Toxic documents go, one document of each near-duplicate group stays, personal data are masked, sources
are mixed to their target weights (a document stands as often as it is taken), and texts become
SentencePiece ids. All stages but the last return the columns of ``documents``. ``run`` writes each stage's rows as
Parquet below the cluster's shared folder and reads them again, so a lost executor costs one stage at most; a stage's
folder goes when the next one is written.

Defined results, for every stage: a null text stays null and counts as an empty one, which isn't toxic unless the model's bias
says so, is a copy of every other text without words, holds no personal data, has size 0 in the mix and no ids. A null doc_id is a
value like any other, but the last choice in a group of copies. Repeated rows are one group of copies; which of equal rows
stays doesn't matter. Ties go to the smaller doc_id, then to the smaller hash of the text. Very long texts are read whole.
Further columns pass through all stages but the last, whatever their names. Empty tables give empty results; without labels nothing is toxic.

No stage but the mix can be put in SQL (a trained model, XXH64 fingerprints, parsers, Viterbi), so ORACLE_SQL is
None; tests hold each stage against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spanmill.llm import mixing, pieces, pii, simhash, toxicity
from spanmill.llm.common import remove, scratch, table

MODEL = "piece_bpe_32k.model"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.deduplicate(docs)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.emit(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pieces.encode(docs, public_tokenizers.path(MODEL))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", mask_personal_data),
    ("mixing", mix_sources),
    ("sentencepiece", encode_pieces),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder, done = table(spark, sf_dir, "documents"), scratch(spark, "pipeline"), None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if done:
            remove(spark, done)
        done = f"{folder}/{name}"
    return docs
