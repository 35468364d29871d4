"""One query for each operator, as registered by the driver's entry module."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, classifier, clusters, common, fingerprints, licences, lines, neardup, negatives, packing, pieces, rules, token_files, tokens
from .oracles import ORACLES  # noqa: F401


def op1_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(common.documents(spark, sf_dir)).withColumn("licences", F.array_join("licences", ","))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, settings = common.documents(spark, sf_dir), classifier.Settings()
    model = classifier.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), settings)
    rows = classifier.score(docs, model)
    return rows.select("doc_id", classifier.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= settings.threshold).cast("int").alias("predicted"))


def op3_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(common.documents(spark, sf_dir), neardup.Settings(words=3, percent=85)).drop("text_hash")


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pieces.encode_pieces(common.documents(spark, sf_dir), common.vocabulary("piece_bpe_32k.model"))
    return rows.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        F.coalesce(F.try_element_at("ends", F.lit(-1)), F.lit(0)).cast("long").alias("last_byte"),
    )


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    added = spark.createDataFrame([(-1, i, r, "</s>[INST] ok [/INST]") for i, r in enumerate(("user", "assistant"))], "conv_id long, turn long, role string, text string")
    rows = chat.read_back(chat.format_conversations(turns.unionByName(added)))
    return rows.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.expr(r"array_join(transform(turns, t -> concat(t.role, '\n', t.text, '\n')), '')"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        "formatted_chars",
    )


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tokens.token_counts(common.documents(spark, sf_dir), common.vocabulary("byte_bpe_50k.json"))
    return rows.withColumn("over_limit", F.col("n_tokens") > 1024)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines.dedup_lines(common.documents(spark, sf_dir).select("doc_id", "text"))
    return rows.select("doc_id", "n_lines", "n_dropped", F.length("text").cast("long").alias("clean_chars"), F.sha2("text", 256).alias("clean_sha256"))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_fingerprints(common.documents(spark, sf_dir))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.apply_rules(common.documents(spark, sf_dir))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tokens.token_pieces(common.documents(spark, sf_dir), common.vocabulary("word_bpe_49k.json"), limit=2048, end_id=0)
    return packing.place(common.checkpoint(found), capacity=2048)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = rows.withColumn("label", F.expr("if(vec_id % 7 = 0, (label + 1) % 10, label)"))
    return negatives.mine_negatives(rows, F.expr("vec_id % 100 = 0"))


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = token_files.files_folder(spark)
    shards = token_files.write_token_files(common.documents(spark, sf_dir), common.vocabulary("word_bpe_49k.json"), folder, end_id=1)
    return token_files.read_token_files(shards, folder)


def op13_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.cluster_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), k=16, rounds=3, dims=64, scale=64, seed=1)


QUERIES = {f.__name__: f for f in (op1_licences, op2_quality_classifier, op3_neardup, op4_sentencepiece, op5_chat, op6_token_counts, op7_line_dedup, op8_fingerprints, op9_quality_rules, op10_packing, op11_hard_negatives, op12_token_files, op13_clusters)}
