"""Exact deduplication by skew-safe combining, in DataFrame operations only.

Copies are merged in three steps, and every step groups by the digest *and* the
full content, so that a digest alone never merges two texts:

1. locally: the map side of the first aggregation folds the copies that one
   task reads into one row,
2. by salted groups: the folded rows of a digest are spread over ``salts``
   groups by the task they came from,
3. globally: at most ``salts`` winners of each content meet.

A hot group of any size therefore sends one row per task to step 2 and ``salts``
rows to step 3. Winners go back to all documents by digest and a second hash of the
content; that join sees only ids and hashes, both sides are shuffled right below it, and so
adaptive execution splits a hot digest there.

Defined results: a null text is the empty text, and all such rows are one group.
``keep_id`` is the largest id of a group; null ids never win over an id. Rows that
repeat an id and its text are one document: each is reported, with the same
verdict, and ``group_size`` counts rows. An empty table gives an empty result.
Only the two named columns are read, so others may have any name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SALTS = 64


def _base(docs: DataFrame, id_col: str, text_col: str, digest: Callable[[Column], Column]) -> DataFrame:
    text = F.coalesce(docs[text_col], F.lit(""))
    return docs.select(docs[id_col].cast("long").alias("doc_id"), text.alias("content")).withColumn("digest", digest(F.col("content")))


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def contents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """One row per different content: digest, content, keep_id, group_size."""
    salted = (
        _base(docs, id_col, text_col, digest)
        .withColumn("salt", F.spark_partition_id() % salts)
        .groupBy("salt", "digest", "content")
        .agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    )
    return salted.groupBy("digest", "content").agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    check = F.xxhash64("content")  # beside the digest, so that even texts that share a digest find their own winner
    winners = contents(docs, id_col, text_col, salts, digest).select("digest", check.alias("check"), "keep_id", "group_size")
    return (
        _base(docs, id_col, text_col, digest)
        .select("doc_id", "digest", check.alias("check"))
        .join(winners, ["digest", "check"])
        .select(
            "doc_id",
            "keep_id",
            "group_size",
            F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
            F.lower(F.hex("digest")).alias("text_sha256"),
        )
    )


def keep_first_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """The rows of docs that stay, with all their columns in order; a repeated row stays once.

    The text of a winner comes out of the combining itself; only the other columns are joined to it, by id and
    digest, as an id (or its lack) may stand on different texts. Of rows that repeat both and differ elsewhere,
    the one whose other columns come first as JSON stays.
    """
    at = [i for i, c in enumerate(docs.columns) if c != text_col]
    rest = F.struct(*[docs[docs.columns[i]].alias(f"c{i}") for i in at], docs[text_col].isNull().alias("was_null"))
    others = docs.select(docs[id_col].cast("long").alias("id"), sha256(F.coalesce(docs[text_col], F.lit(""))).alias("of"), rest.alias("rest"))
    others = others.groupBy("id", "of").agg(F.min_by("rest", F.to_json("rest")).alias("rest"))
    won = contents(docs, id_col, text_col, salts).select("digest", "content", "keep_id")
    joined = won.join(others, F.col("keep_id").eqNullSafe(F.col("id")) & (F.col("digest") == F.col("of")))
    text = F.when(F.col("rest.was_null") & (F.col("content") == ""), F.lit(None)).otherwise(F.col("content"))
    named = {i: F.col(f"rest.c{i}").alias(docs.columns[i]) for i in at}
    return joined.select(*[named.get(i, text.alias(c)) for i, c in enumerate(docs.columns)])
