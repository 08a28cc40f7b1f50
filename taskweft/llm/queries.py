"""The ``opN_`` queries, one for each operator, and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from taskweft.llm import op1_grid_join, op2_mixing, op3_url_trust, op4_quality, op5_minhash, op6_secrets, op7_token_counts, op8_pieces, op9_media, op10_line_dedup, op11_licenses, op12_divergence, op13_collocations
from taskweft.sources import table

#: Names of the vocabulary files; their folder is found at run time.
WORD_TOKENIZER = "word_bpe_49k.json"
PIECE_MODEL = "piece_bpe_32k.model"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_grid_join_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op1_grid_join.linked_vectors(table(spark, sf_dir, "embeddings"), min_cosine=0.95)


#: The mix's word shares by domain.
MIX = {"good": 0.95, "low": 0.05, "toxic": 0.0}


def op2_mixing_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return op2_mixing.mixing_rates(docs, op2_mixing.train_domains(docs, table(spark, sf_dir, "labels")), MIX)


def op3_url_trust_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op3_url_trust.judge_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op4_quality_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    machine = op4_quality.train(docs, labels, training=lambda doc_id: ~held_out(doc_id))
    return op4_quality.score_documents(docs, machine).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op5_minhash_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op5_minhash.near_duplicates(table(spark, sf_dir, "documents"), words=3, percent=85, rows=7)


def op6_secrets_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op6_secrets.digest(op6_secrets.scan_secrets(table(spark, sf_dir, "documents")))


def op7_token_counts_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op7_token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path(WORD_TOKENIZER))


def op8_pieces_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op8_pieces.encode_and_check(table(spark, sf_dir, "documents"), tokenizer_path(PIECE_MODEL))


def op9_media_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op9_media.media_features(op9_media.store_texts(table(spark, sf_dir, "documents")))


#: A line is boilerplate on more than this share of its host's pages.
LINE_RATIO = 0.1


def op10_line_dedup_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = op10_line_dedup.drop_boilerplate(table(spark, sf_dir, "documents"), LINE_RATIO, count_col="n_dropped")
    return out.select("doc_id", "n_dropped", "text")


def op11_licenses_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op11_licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op12_divergence_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op12_divergence.divergence(table(spark, sf_dir, "documents"))


def op13_collocations_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op13_collocations.collocations(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_grid_join": op1_grid_join_query,
        "op2_mixing": op2_mixing_query,
        "op3_url_trust": op3_url_trust_query,
        "op4_quality": op4_quality_query,
        "op5_minhash": op5_minhash_query,
        "op6_secrets": op6_secrets_query,
        "op7_token_counts": op7_token_counts_query,
        "op8_pieces": op8_pieces_query,
        "op9_media_columns": op9_media_query,
        "op10_line_dedup": op10_line_dedup_query,
        "op11_licenses": op11_licenses_query,
        "op12_divergence": op12_divergence_query,
        "op13_collocations": op13_collocations_query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_grid_join": op1_grid_join.oracle(0.95),
        "op3_url_trust": op3_url_trust.oracle(),
        "op5_minhash": op5_minhash.oracle(3, 85),
        "op10_line_dedup": op10_line_dedup.oracle(LINE_RATIO),
        "op12_divergence": op12_divergence.oracle(),
        "op13_collocations": op13_collocations.oracle(),
    }
