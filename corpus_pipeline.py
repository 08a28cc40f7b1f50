"""A training corpus from ``documents``: quality, line dedup, near-dedup, mixing, pieces.

Each stage takes (spark, docs, sf_dir), with all that the stage before kept, and returns a DataFrame; all but
the last return the columns of ``documents``.  ``run`` writes each stage's result as Parquet and reads it
for the next.

Nulls: a null text is an empty one; it stays or goes by its score, has no lines, no duplicates and no
pieces.  Rows with null or repeated ids are judged each, except that near-duplicates go by doc_id.  Extra
columns pass through every stage.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from taskweft.llm import op2_mixing, op4_quality, op5_minhash, op8_pieces, op10_line_dedup
from taskweft.llm.queries import LINE_RATIO, MIX, PIECE_MODEL, tokenizer_path
from taskweft.plans.scratch import Scratch
from taskweft.sources import table

#: A line on one page alone repeats nothing, however few pages its host has: its document is a clean one.
LINE_PAGES = 2


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorisation machine scores 0.5 or more."""
    return op4_quality.keep_good(docs, op4_quality.train(docs, table(spark, sf_dir, "labels")), 0.5)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the boilerplate lines of their source; n_chars follows.

    Equal texts of a source count as one page here: copies are for the next stage to drop, not their lines.
    """
    return op10_line_dedup.drop_boilerplate(docs, LINE_RATIO, LINE_PAGES, distinct_pages=True, chars_col="n_chars")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each group of near copies (five words, similarity 0.8)."""
    judged = op5_minhash.near_duplicates(docs, words=5, percent=80, rows=6)
    gone = judged.where(~F.col("kept") & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that get a copy or more by their fitted rate and the draw of their doc_id, once each."""
    return op2_mixing.mix(docs, op2_mixing.train_domains(docs, table(spark, sf_dir, "labels")), MIX, repeat=False)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their piece ids."""
    return op8_pieces.encode_pieces(docs, tokenizer_path(PIECE_MODEL))


STAGES = [
    ("quality", quality),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("mixing", mixing),
    ("pieces", pieces),
]

#: Two stages are trained models, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        made = scratch.cut(stage(spark, docs, sf_dir))
        scratch.drop(docs)
        docs = made
    return STAGES[-1][1](spark, docs, sf_dir)
