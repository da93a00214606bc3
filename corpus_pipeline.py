"""A corpus from raw documents to packed training sequences, stage by stage.

Each stage works on all rows that the stage before kept, written and read
again in between.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rigspan.llm import common, decontaminate, neardup, packing, pii, queries, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.3 or more go. The labels may name documents that are no longer there.

    A null or empty text has no words and stays; repeated rows share their fate;
    an empty table stays empty. All columns stay, whatever their names.
    """
    labels = queries.table(spark, sf_dir, "labels").where(~queries.held_out())
    return toxicity.keep_clean(docs, toxicity.train(docs, labels))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: sets of five-word shingles, similarity of 0.8.

    Null and empty texts and null ids stay; of rows that repeat id and words
    one stays; an id's rows with other texts are documents of their own. All
    columns stay, whatever their names.
    """
    return neardup.drop_near_duplicates(docs, shingle=5, percent=80)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, edited or not, go.

    Null and empty texts hold none and stay, and so do null ids, which nothing
    can name; rows that share an id go together. All columns stay.
    """
    return decontaminate.drop_contaminated(docs, queries.table(spark, sf_dir, "benchmark"))


def replace_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Entities get surrogates; n_chars follows the new text.

    Null and empty texts, null ids and repeated rows stay as they are. All
    columns stay, whatever their names.
    """
    out = pii.replace_entities(docs, queries.pii_key(spark), report=False).select(docs.columns)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token windows of 2048 with the least slack: every piece with its ids and its place.

    Null and empty texts are the end id alone; repeated rows and null ids are
    documents of their own; an empty table has no windows.
    """
    return packing.pack(docs, queries.tokenizer_file("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_copies),
    ("decontamination", drop_leaks),
    ("pii", replace_pii),
    ("packing", pack_windows),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = queries.table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = common.materialize(docs)
    return docs


#: Models, connected components and packing have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None
