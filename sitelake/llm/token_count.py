"""Token counts through a cache of digests.

The key of a count is the SHA-256 of the normalised text and that of the tokenizer's file. A
run joins the digests of its documents to the cache, encodes one document of each
digest that the cache lacks, appends those counts, and joins all documents to
the cache again. Copies and reruns cost a join, not an encoding.

Normalisation must not change a count: a null is empty, and where the tokenizer drops white space (which is
found out when it is loaded), ASCII white space at either end goes.

Counting: such a tokenizer never lets a token span white space, so the count
of a text is the sum over its space-separated chunks, and a worker keeps the counts of
chunks that it has seen, up to a fixed number. Any other tokenizer encodes whole texts.

The cache is a Parquet table that only ever grows by committed appends. A lost task
repeats its texts; a run that fails appends nothing. Two runs at once may append
the same digest twice, which reading folds.

Defined results: a null text counts 0 bytes and 0 tokens. Null ids and repeated rows are
counted like any other. An empty table gives no rows. Only the named columns are read.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelake.runtime import ship

CACHE_SCHEMA = "tokenizer string, digest binary, n_tokens long"
TOKENIZER = "word_bpe_49k.json"
REMEMBERED = 1_000_000
_loaded: dict = {}


def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def drops_space(tokenizer) -> bool:
    """Whether no token holds white space, so that a text's count is that of its chunks."""
    counts = lambda x: len(tokenizer.encode(x, add_special_tokens=False))
    added = any(c.isspace() for t in tokenizer.get_added_tokens_decoder().values() for c in t.content)
    return not added and not counts(" \n \t\r\v\f ") and counts("a \n b") == counts("a") + counts("b")


def counter(path: str):
    """texts -> counts as the tokenizers library gives them, special strings as its default, nothing added."""
    if path in _loaded:
        return _loaded[path]
    tokenizer = load(path)
    if not drops_space(tokenizer):
        _loaded[path] = lambda texts: list(map(len, tokenizer.encode_batch_fast(texts, add_special_tokens=False)))
        return _loaded[path]
    known: dict[str, int] = {"": 0}

    def count(texts: list[str]) -> list[int]:
        chunks = [t.replace("\n", " ").split(" ") for t in texts]
        new = list({c for cs in chunks for c in cs if c not in known})
        if len(known) + len(new) > REMEMBERED:
            for c in list(known)[REMEMBERED // 2 :]:  # the common chunks came first
                del known[c]
            new = list({c for cs in chunks for c in cs if c not in known})
        for k in range(0, len(new), 8192):
            part = new[k : k + 8192]
            known.update(zip(part, map(len, tokenizer.encode_batch_fast(part, add_special_tokens=False)), strict=True))
        return [sum(map(known.__getitem__, cs)) for cs in chunks]

    _loaded[path] = count
    return count


def file_digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def read_cache(spark, cache_path: str, version: str) -> DataFrame:
    """digest, n_tokens of one tokenizer."""
    try:
        cache = spark.read.schema(CACHE_SCHEMA).parquet(cache_path)
    except AnalysisException:
        cache = spark.createDataFrame([], CACHE_SCHEMA)
    return cache.filter(F.col("tokenizer") == version).select("digest", "n_tokens")


def count_tokens(docs: DataFrame, cache_path: str, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens of every row; appends what the cache at cache_path lacked."""
    spark = docs.sparkSession
    ship(spark)
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path(TOKENIZER)
    version = file_digest(tokenizer)
    text = F.coalesce(docs[text_col], F.lit(""))
    trimmed = F.trim(text, F.lit(" \t\n\r\v\f")) if drops_space(load(tokenizer)) else text
    base = docs.select(docs[id_col].cast("long").alias("doc_id"), text.alias("content"), F.octet_length(text).cast("long").alias("n_bytes"), F.unhex(F.sha2(trimmed, 256)).alias("digest"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(tokenizer)
        for batch in batches:
            for k in range(0, batch.num_rows, 1024):
                part = batch.slice(k, 1024)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(count(part.column(1).to_pylist()), pa.int64())], ["digest", "n_tokens"])

    chosen = base.select("doc_id", "digest").groupBy("digest").agg(F.min("doc_id").alias("chosen"))
    misses = chosen.join(read_cache(spark, cache_path, version), "digest", "left_anti").withColumnRenamed("digest", "missing")
    texts = base.join(misses, (F.col("digest") == F.col("missing")) & F.col("doc_id").eqNullSafe(F.col("chosen")))
    counted = texts.select("digest", "content").mapInArrow(encode, "digest binary, n_tokens long")
    counted = counted.distinct()  # a repeated row is chosen with its repetitions
    counted.select(F.lit(version).alias("tokenizer"), "digest", "n_tokens").write.mode("append").parquet(cache_path)

    # a digest has one count; distinct over both columns leaves the shuffle by digest to the join, where a hot digest is split
    counts = read_cache(spark, cache_path, version).distinct()
    return base.select("doc_id", "n_bytes", "digest").join(counts, "digest").select("doc_id", "n_bytes", "n_tokens")
