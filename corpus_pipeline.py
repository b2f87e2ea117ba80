"""The corpus pipeline: language ID, exact dedup, near dedup, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and
read again as the docs of the next one. All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelake.llm import exact_dedup, langid, packing, probminhash
from sitelake.llm.queries import remainder, table
from sitelake.runtime import materialize


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can't be told (null, or no letter) go. The model learns from the documents given."""
    model = langid.train_model(docs, train=F.coalesce(remainder("doc_id", 4) != 2, F.lit(False)))
    if not model.langs:  # no label to learn from rejects no text
        return docs.filter(langid.has_letter(docs["text"]))
    marked = langid.predict_language(docs, model)
    return marked.filter(F.col("lang_pred") != langid.UNDETERMINED).select(*docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest doc_id stays."""
    return exact_dedup.keep_first_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near duplicates, the row with the smallest doc_id stays."""
    return probminhash.keep_one_of_each(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences."""
    packed = packing.pack_documents(docs)
    return packed.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("exact_dedup", exact),
    ("near_dedup", near),
    ("packing", pack),
]

#: Near duplicates and packing are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline_{k}_{name}")
    return docs
