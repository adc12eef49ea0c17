"""A corpus from raw documents to token ids: five stages, each applying one operator to all that the last one kept.

Stages take and give the columns of documents, but for the last, which gives ids. ``run`` writes each stage's rows as
Parquet to the shared folder and reads them again, so a lost executor costs one stage at most; what a stage stored on its
way, and its input, is deleted once its rows are written.

Defined results: a null text is an empty one that stays null until the last stage, whose ids for it are none; null and
empty texts are near-duplicates of each other, so one such document stays; of documents of one component the least doc_id
stays, a null one if there is any, and of rows that share that doc_id one; texts of any length are taken whole; labels of
unknown or null documents are not learnt from, and without labels of both kinds no document is toxic; an empty table gives
no rows; columns that documents has beside its own are kept by all stages but the last, whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from seine.llm import bpe, common, decontaminate, resemblance, secrets, toxicity
from seine.session import table


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score of 0.5 or more go; the model learns from labels as op1's does."""
    model = toxicity.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), lambda k: ~toxicity.held_out(k))
    return toxicity.reject(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of texts with five-word-shingle similarity 0.8 or more the document with the least doc_id stays.

    Candidates by SimHash fingerprints and the generalised pigeonhole, links by their exact similarity."""
    return resemblance.keep_one(docs)


def contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents into which a benchmark item leaked go, partly edited or case-changed copies included."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"), verbatim=True)


def credentials(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; secrets in their texts are masked by what ownership says of them."""
    return secrets.redact(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, ids, n_tokens, and whether decoding gives the text back."""
    return bpe.round_trip(docs, public_tokenizers.path(bpe.VOCABULARY), public_tokenizers.PATTERN, ["doc_id", "lang", "source"])


STAGES = [
    ("toxicity", toxic),
    ("simhash_near_dedup", near_duplicates),
    ("decontamination", contaminated),
    ("secret_scan", credentials),
    ("byte_bpe", tokens),
]

#: A trained model, fingerprints and merges have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with common.scratch():
            kept = common.store(stage(spark, docs, sf_dir), name, keep=True)
        common.discard(docs)  # the last stage's rows; documents itself was not stored
        docs = kept
    return docs
