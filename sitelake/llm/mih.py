"""Approximate nearest neighbours by inner product: multi-index hashing.

Codes: vectors are widened by one component so that the largest inner product is the
smallest angle (norms may differ), centred, turned by rotations that are learned to suit
their signs (iterative quantisation from several starts), and cut to bits. A
code is ``bits`` long and split into 8-bit substrings; each substring has a table from
value to rows. By the pigeonhole principle, a code within ``radius`` of a query's agrees
with it up to ``radius // substrings`` bits in one substring at least, so probing all
values that near in every table finds every code within the radius. Those are reranked
by the inner product in double precision.

The radius is learned with the rotations: on a bounded sample, it is the distance that
holds ``target`` of the pairs that are as near as the k nearest will be among all rows.
Vectors without any structure have codes that are far apart even for the nearest rows;
then the radius is large and so is the share of rows that is reranked.

Every row is indexed. Queries meet all rows in blocks of fixed size, (query block, row
block) by (query block, row block); a block's tables live in one task only while it works,
and each pair of blocks returns k rows a query at most. A block that has fewer than k codes
within the radius adds its nearest codes beyond, so no query runs short.

Defined results: null or zero vectors, vectors with a null or non-finite component or of
another dimension than most, and rows without an id take no part. Rows that repeat an id
are one, with the least of their vectors. Ties in score go to the smaller id. An empty table gives no rows; only
the two named columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitelake.runtime import materialize, ship

K, STARTS, SAMPLE, TARGET = 20, 2, 8192, 0.975
ROW_BLOCK, QUERY_BLOCK = 8192, 4096
POPCOUNT = np.array([bin(i).count("1") for i in range(256)], np.uint8)


@dataclass
class Codes:
    """mean and rotation of the widened vectors; top: the largest norm; radius in bits."""

    mean: np.ndarray
    rotation: np.ndarray
    top: float
    radius: int

    def widen(self, x: np.ndarray, query: bool) -> np.ndarray:
        norm = np.linalg.norm(x, axis=1, keepdims=True)
        if query:
            return np.hstack([x / np.maximum(norm, 1e-300), np.zeros_like(norm)])
        return np.hstack([x, np.sqrt(np.maximum(self.top**2 - norm**2, 0))]) / self.top

    def bytes(self, x: np.ndarray, query: bool) -> np.ndarray:
        return np.packbits((self.widen(x, query) - self.mean) @ self.rotation > 0, axis=1)


def learn_rotation(z: np.ndarray, bits: int, seed: int, rounds: int = 25) -> np.ndarray:
    """Principal axes, then the rotation that brings them nearest to their signs."""
    _, axes = np.linalg.eigh(np.cov(z.T) if len(z) > 1 else np.eye(z.shape[1]))
    axes = axes[:, ::-1][:, :bits]
    v = z @ axes
    r = np.linalg.qr(np.random.default_rng(seed).normal(size=(v.shape[1], v.shape[1])))[0]
    for _ in range(rounds):
        u, _, w = np.linalg.svd(np.where(v @ r > 0, 1.0, -1.0).T @ v)
        r = (u @ w).T
    return axes @ r


def hamming(codes: np.ndarray, q: np.ndarray) -> np.ndarray:
    return POPCOUNT[codes ^ q].sum(1, dtype=np.int32)


def learn_codes(sample: np.ndarray, top: float, n_rows: int, k: int = K, starts: int = STARTS, target: float = TARGET) -> Codes:
    """From a bounded sample of vectors; n_rows: of the whole table."""
    codes = Codes(np.zeros(0), np.zeros(0), top, 0)
    wide = codes.widen(sample, query=False)
    bits = max(8, (sample.shape[1] // 8) * 8)
    codes.mean = wide.mean(0)
    parts = [learn_rotation(wide - codes.mean, bits, s) for s in range(starts)]
    codes.rotation = np.hstack(parts)
    if pad := -codes.rotation.shape[1] % 8:
        codes.rotation = np.hstack([codes.rotation, np.zeros((len(codes.rotation), pad))])
    own, asked = codes.bytes(sample, query=False), codes.bytes(sample[:512], query=True)
    near = max(1, round(k * len(sample) / max(n_rows, 1)))
    found = []
    for i, q in enumerate(asked):
        s = sample @ sample[i]
        s[i] = -np.inf
        best = np.argpartition(-s, min(near, len(s) - 1))[:near]
        found.append(hamming(own[best], q))
    codes.radius = int(np.ceil(np.quantile(np.concatenate(found), target)))
    return codes


class SubstringTables:
    """One table a substring: rows in order of its value, and where each value begins."""

    def __init__(self, codes: np.ndarray) -> None:
        self.codes = codes
        self.rows = [np.argsort(codes[:, j], kind="stable") for j in range(codes.shape[1])]
        self.begin = [np.searchsorted(codes[r, j], np.arange(257)) for j, r in enumerate(self.rows)]

    def within(self, q: np.ndarray, radius: int) -> np.ndarray:
        """Every row whose code is within the radius of q."""
        found = np.zeros(len(self.codes), bool)
        each = radius // len(self.rows)
        for j, (rows, begin) in enumerate(zip(self.rows, self.begin, strict=True)):
            probes = np.flatnonzero(POPCOUNT[np.arange(256) ^ int(q[j])] <= each)
            size = begin[probes + 1] - begin[probes]
            at = np.repeat(begin[probes] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
            found[rows[at]] = True
        hits = np.flatnonzero(found)
        return hits[hamming(self.codes[hits], q) <= radius]


def search_block(codes: Codes, ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """query_id, vec_id, score: k rows a query at most, of one block."""
    tables = SubstringTables(codes.bytes(x, query=False))
    asked = codes.bytes(queries, query=True)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for i, q in enumerate(asked):
        hits = tables.within(q, codes.radius)
        if len(hits) <= k < len(ids):
            far = hamming(tables.codes, q)
            hits = np.argpartition(far, k)[: k + 1]
        hits = hits[ids[hits] != query_ids[i]] if len(ids) > k else np.flatnonzero(ids != query_ids[i])
        score = x[hits] @ queries[i]
        if len(hits) > k:
            cut = np.partition(score, len(score) - k)[len(score) - k]
            keep = score >= cut
            hits, score = hits[keep], score[keep]
        order = np.lexsort((ids[hits], -score))[:k]
        out.append((np.full(len(order), query_ids[i]), ids[hits[order]], score[order]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def _vectors(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)


def valid_vectors(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    vec = rows[vec_col].cast("array<double>")
    fine = F.forall(vec, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(vec, lambda v: v != 0)
    return rows.filter(rows[id_col].isNotNull() & F.coalesce(fine, F.lit(False))).select(rows[id_col].cast("long").alias("vec_id"), vec.alias("vec"))


def nearest(rows: DataFrame, is_query: Callable[[Column], Column], k: int = K, id_col: str = "vec_id", vec_col: str = "embedding", row_block: int = ROW_BLOCK, query_block: int = QUERY_BLOCK, sample: int = SAMPLE, starts: int = STARTS, target: float = TARGET) -> DataFrame:
    """query_id, rank, vec_id, score: of each query's row (is_query of its id) the k nearest found among all other rows."""
    spark = rows.sparkSession
    ship(spark)
    empty = "query_id long, rank int, vec_id long, score double"
    vectors = valid_vectors(rows, id_col, vec_col)
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, v: a + v * v))
    kinds = vectors.groupBy(F.size("vec").alias("d")).agg(F.count(F.lit(1)).alias("n"), F.max(norm).alias("top")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    if not kinds:
        return spark.createDataFrame([], empty)
    d, _, top = kinds[0]
    vectors = materialize(vectors.filter(F.size("vec") == d).groupBy("vec_id").agg(F.min("vec").alias("vec")), "nearest_vectors")
    n, q = vectors.agg(F.count(F.lit(1)), F.count_if(is_query(F.col("vec_id")))).first()
    # the ids of lowest hash: about as many as the sample asks for at any size of the table, however it is laid out
    share = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) < math.ceil(min(1.0, sample / n) * (1 << 30))
    chosen = vectors.filter(share).select("vec_id", "vec").toArrow().sort_by("vec_id")
    codes = learn_codes(_vectors(chosen.column("vec")), top, n, k, starts, target)
    shared = spark.sparkContext.broadcast(codes)
    row_blocks, query_blocks = math.ceil(n / row_block), max(1, math.ceil(q / query_block))
    block = lambda m: F.pmod(F.xxhash64("vec_id"), F.lit(m)).cast("int")
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    index = vectors.select("vec_id", "vec", block(row_blocks).alias("rb"), every(query_blocks).alias("qb"))
    asked = vectors.filter(is_query(F.col("vec_id"))).select("vec_id", "vec", block(query_blocks).alias("qb"), every(row_blocks).alias("rb"))

    def search(a: pa.Table, b: pa.Table) -> pa.Table:
        schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
        if not a.num_rows or not b.num_rows:
            return schema.empty_table()
        found = search_block(shared.value, a.column("vec_id").to_numpy(), _vectors(a.column("vec")), b.column("vec_id").to_numpy(), _vectors(b.column("vec")), k)
        return pa.table([pa.array(c) for c in found], schema=schema)

    found = index.groupBy("qb", "rb").cogroup(asked.groupBy("qb", "rb")).applyInArrow(search, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
