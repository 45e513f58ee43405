"""The corpus pipeline: five stages over ``documents``, each written as Parquet and reread as the next one's input.

language ID -> n-gram Jaccard join -> secret scan -> mixing to target weights -> best-fit packing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm import jaccard, langid, mixing, packing, secrets
from lodestar.llm.common import ROW, dropped, made, row_ids, scratch, table
from lodestar.llm.queries import tokenizer_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised go on; lang becomes the prediction. Null and letterless texts, and texts like no language learned, go.

    With no labelled rows to learn from, nothing can be rejected for its language: all rows go on as they are.
    """
    model = langid.train(docs)
    if not model.langs:
        return docs
    found = langid.identified(docs, model)
    return found.filter("lang_accepted").withColumn("lang", F.col("lang_pred")).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates one row stays: the one with the least doc_id, rows without one last (see jaccard.deduplicated)."""
    return jaccard.deduplicated(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; secrets in its text are replaced, and n_chars follows."""
    return secrets.redacted(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it (0 to 3 times). Rows are told apart by their place in their files, so null and repeated doc_ids are rows like others."""
    rows = row_ids(docs)
    copies = mixing.entropy_mix(rows, keep=ROW).filter("copies > 0").select(*ROW, F.col("copies").alias("__copies"))
    return rows.join(copies, ROW).withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int")))).select(docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every row, placed in sequences of 2048 ids: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return packing.packed_documents(docs, tokenizer_path(), keep_ids=False).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES: list[tuple[str, Stage]] = [
    ("language_id", identify_language),
    ("jaccard_join", drop_near_duplicates),
    ("secret_scan", redact_secrets),
    ("entropy_mix", mix_sources),
    ("best_fit_packing", pack_sequences),
]

#: SQL can express neither the language models nor the dual's solution; the tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``; each result is written to the shared folder and reread.

    What a stage wrote on its way, and the result before it, are deleted once its own result is written.
    """
    docs, before = table(spark, sf_dir, "documents"), len(made())
    for name, stage in STAGES:
        path = scratch(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        dropped(spark, before, (path,))
    return docs
