"""Five stages from documents to token ids: language, near-duplicates, secrets, mixture, pieces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vaaksetu.llm import jaccard, langid, mixing, pieces, secrets


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of no language (null and empty texts and texts without a letter) and labels the others with the predicted one. Profiles are learned from the folds that op8 learns from.

    Repeated rows and null ids stay; an empty table gives an empty one.
    """
    return langid.keep_known(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of linked documents the one with the smallest id; a link is a similarity of 0.8 or more of the sets of 5-word shingles.

    Texts without words are copies of each other; of rows that repeat an id one is kept; rows with a null id stay; an empty table gives an empty one.
    """
    return jaccard.jaccard_dedup(docs, shingle=5, similarity=0.8)


def credentials(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks secrets and identifiers within texts; every row stays, null texts, null ids and repeated rows included; an empty table gives an empty one."""
    return secrets.redact(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that a mixture of op3's weights uses, of at most one epoch.

    Null languages and sources are the node 'none'; documents without tokens stay, as they cost nothing; rows that share an id, a
    null one too, stay or go together; ties in the order of an epoch can't be told apart. An empty table gives an empty one.
    """
    return mixing.mix_documents(docs, mixing.driver_levels(), mixing.WEIGHTS, mixing.BUDGET, mixing.SEED)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of each row, with whether they decode to its text; null and empty texts have none; an empty table gives an empty one."""
    out = pieces.encode_pieces(docs.select("doc_id", "lang", "source", "text"), remember=250_000)
    return out.select("doc_id", "lang", "source", "piece_ids", F.size("piece_ids").cast("long").alias("n_pieces"), "decoded")


STAGES = [("languages", languages), ("near_duplicates", near_duplicates), ("credentials", credentials), ("mixture", mixture), ("tokens", tokens)]

#: Fingerprints, rank-order profiles and piece ids have no SQL counterpart; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over the whole documents table, each stage's rows being staged in the shared folder until the next one's are there."""
    from vaaksetu.llm.common import read, stage, unstage

    docs, staged = read(spark, sf_dir, "documents"), []
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
        unstage(*staged)
        staged = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
