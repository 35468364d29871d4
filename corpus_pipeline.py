"""A training corpus from raw documents: quality classifier, quality rules, line dedup, near-dedup, best-fit packing.

Each stage works on all rows that the one before it kept, and its decisions take effect.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strokelake.llm import classifier, common, lines, neardup, packing, rules, tokens


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text scores at least the threshold; columns as given."""
    model = classifier.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return classifier.filter_quality(docs, model)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that pass the base and every rule; columns as given."""
    return rules.keep_passing(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that stand earlier in the corpus, ``n_chars`` counted again; documents left without a line go."""
    cleaned = lines.dedup_documents(docs)
    return cleaned.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that of the smallest id. Rows without id stay, columns as given."""
    return neardup.first_of_group(docs, neardup.Settings(words=5, percent=80, bands=32, rows=5))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` of all pieces in sequences of 2048 tokens."""
    pieces = tokens.token_pieces(docs, common.vocabulary("word_bpe_49k.json"), limit=2048, end_id=0)
    return packing.place(common.checkpoint(pieces), capacity=2048)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("best_fit_packing", best_fit_packing),
]

#: The classifier and the packing plan aren't SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``; between them rows stand in the shared checkpoint folder until the next stage is written.

    The last stage reads its own checkpoint, so its input goes with the others.
    """
    common.ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    rows = common.documents(spark, sf_dir)
    written = None
    for name, stage in STAGES[:-1]:
        stage(spark, rows, sf_dir).write.parquet(f"{folder}/{name}")
        rows = spark.read.parquet(f"{folder}/{name}")
        if written:
            common.delete_folder(spark, written)
        written = f"{folder}/{name}"
    packed = STAGES[-1][1](spark, rows, sf_dir)
    common.delete_folder(spark, folder)
    return packed
