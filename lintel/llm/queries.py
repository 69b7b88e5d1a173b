"""The queries opN_<name>: each applies its operator with production parameters to a whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintel.llm import crosspolytope, dartminhash, debruijn, gru_lm, langid, line_dedup, mcd, oracles, packing, rff_quality, sentencepieces
from lintel.llm.common import fold, table


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op2_mcd_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mcd.judge(table(spark, sf_dir, "documents"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = sentencepieces.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), check=True)
    return coded.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(fold("doc_id", 4) != 2))
    found = langid.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.drop_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    digest = F.sha2(F.coalesce("kept_text", F.lit("")), 256)
    return kept.select("doc_id", "n_lines", "n_removed", digest.alias("kept_sha256"))


def op8_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crosspolytope.near_vectors(table(spark, sf_dir, "embeddings"))


def op9_rff_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = rff_quality.document_statistics(table(spark, sf_dir, "documents"))
    labels = table(spark, sf_dir, "labels")
    model = rff_quality.fit(seen, labels.where(fold("doc_id", 5) != 0))
    found = rff_quality.score(seen, model)
    return found.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op10_debruijn_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = debruijn.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), with_text=False)
    return kept.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op4_gru_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gru_lm.score(table(spark, sf_dir, "documents").withColumn("held_out", fold("doc_id", 7) == 2))


def op5_dart_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dartminhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


QUERIES = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_mcd_outliers": op2_mcd_outliers,
    "op3_sentencepiece": op3_sentencepiece,
    "op4_gru_lm": op4_gru_lm,
    "op5_dart_near_dedup": op5_dart_near_dedup,
    "op6_language_id": op6_language_id,
    "op7_line_dedup": op7_line_dedup,
    "op8_cross_polytope": op8_cross_polytope,
    "op9_rff_quality": op9_rff_quality,
    "op10_debruijn_dedup": op10_debruijn_dedup,
}

#: The other queries aren't SQL: learned models, robust estimates, library encodings and fuzzy lines.
ORACLES: dict[str, str] = {
    "op5_dart_near_dedup": oracles.OP5,
    "op8_cross_polytope": oracles.OP8,
    "op10_debruijn_dedup": oracles.OP10,
}
