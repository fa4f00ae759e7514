"""A training-data pipeline: five stages, each of which works on all rows that the last one kept.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame. The filters keep the columns of
``documents``; the last stage returns the encoded documents.
"""

from __future__ import annotations

from uuid import uuid4

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casetrail.llm import bpe, contamination, langid, ngram_join, toxicity
from casetrail.llm.common import table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
# A document whose letters fit no language better than this is rejected by the language stage.
LEAST_LANGUAGE_SCORE = 0.4


def _carried() -> dict:
    """The columns of documents besides id and text; the text is handed through once, as ``was_text``."""
    kept = {"was_" + c: F.col(c) for c in COLUMNS if c not in ("doc_id", "text")}
    return {"keep": kept, "text_as": "was_text"}


def _restored(judged: DataFrame) -> DataFrame:
    return judged.select(*[F.col(c if c == "doc_id" else "was_" + c).alias(c) for c in COLUMNS])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reject texts without a letter and those whose language stays open."""
    judged = langid.identify(docs, docs, **_carried())
    clear = (F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= LEAST_LANGUAGE_SCORE)
    return _restored(judged.filter(clear))


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reject texts that are predicted to be toxic; labels of all documents teach."""
    labels = table(spark, sf_dir, "labels")
    judged = toxicity.score_toxicity(docs, docs, labels, F.lit(True), **_carried())
    return _restored(judged.filter("predicted = 0"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each group, once. Rows without an id get a key above all
    ids that depends on their text, so of a group that has no id one text stays, too."""
    above = F.lit(1 << 62)
    of_text = F.xxhash64(F.coalesce("text", F.lit(""))).bitwiseAND(F.lit((1 << 62) - 1))
    keyed = docs.withColumn("_key", F.coalesce(F.col("doc_id").cast("long"), above + of_text))
    groups = ngram_join.ngram_join(keyed, id_col="_key")
    first = groups.filter("doc_id = component_id").select(F.col("doc_id").alias("_key")).distinct()
    kept = keyed.join(first, "_key", "left_semi").dropDuplicates(["_key", "text"])
    return kept.select(*COLUMNS)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reject documents that hold test items."""
    items = table(spark, sf_dir, "benchmark")
    judged = contamination.decontaminate(docs, items, **_carried())
    return _restored(judged.filter(~F.col("contaminated")))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the remaining documents, checked by decoding them again."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.encode(docs, path, public_tokenizers.PATTERN).select(
        "doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256", "lossless"
    )


STAGES = [
    ("language_id", language),
    ("toxicity", toxic),
    ("ngram_join", near_duplicates),
    ("decontamination", decontaminated),
    ("byte_bpe", encoded),
]

# The encoding can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. Each result is written to the shared checkpoint folder as
    Parquet and read again, so that no stage computes an earlier one twice."""
    from casetrail.session import ensure_checkpoint_dir

    docs = table(spark, sf_dir, "documents")
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid4().hex}"
    for number, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{number}-{name}")
            docs = spark.read.parquet(f"{folder}/{number}-{name}")
    return docs
