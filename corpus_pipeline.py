"""From raw documents to packed sequences, in five stages; each is written as Parquet and read again by the next.

In every stage rows that repeat a doc_id are documents of their own, an empty table gives an empty table, whole texts
are used however long, and columns with names of the stage's own (in any case of letters) come through unchanged.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hoptrace.llm import mixing, near_copies, packing, quality_fm, secret_scan
from hoptrace.llm.common import delete, new_name, new_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorisation machine rejects go.

    Null and empty texts have the score of a text without words. Rows with equal texts have equal scores, so they stay
    or go together. Without labels the score is 0.5 and all stay.
    """
    model = quality_fm.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    name = new_name(docs, "_score")
    return quality_fm.with_score(docs, model, name).filter(F.col(name) >= 0.3).drop(name)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one row stays: that of the least doc_id.

    Links are all pairs with a Jaccard similarity of 0.8 or more over five-word shingles; the SimHash index is a first
    source of them, and an index of rare shingles finds all others. Null, empty and word-less texts are one group. Rows that repeat
    each other are too, whatever their other columns; of equal doc_ids the least text hash stays, nulls come last.
    """
    return near_copies.deduplicated(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All found spans are covered; every document stays. Null texts stay null, and equal rows are covered alike."""
    return secret_scan.masked(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents come as often as the mixture takes them.

    A null source is a source of its own. Null texts and texts without words take part in whole repetitions alone.
    Rows that repeat a doc_id share their place in the seeded order.
    """
    return mixing.sample(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, each with its ids, its sequence and its place there.

    Null and empty texts are one piece, the end id. Sequences in order of ``sequence_id`` and ``offset`` are the ids to
    train on; :func:`hoptrace.llm.packing.sequences` puts each together in a row.
    """
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), keep_ids=True)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("secrets", secrets), ("mixture", mixture), ("packed", packed)]

#: SQL has no factorisation machine, XXH64 or tokenizer; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    root, read = new_path(spark, "pipeline"), None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.option("compression", "zstd").parquet(f"{root}/{k}-{name}")
            if read:  # nothing returned reads the stage before
                delete(spark, read)
            read = f"{root}/{k}-{name}"
            docs = spark.read.parquet(read)
    return docs
