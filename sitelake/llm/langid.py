"""Language identification by prediction by partial matching (PPM).

For each language a context tree over bytes: a node is a context of 0 to ``order``
bytes, with counts of the bytes that follow it. Method C gives a byte seen n times in a
context of total T and D different bytes the share n / (T + D) and the escape the share
D / (T + D); on an escape the next shorter context decides among the bytes that longer
ones have not seen (full exclusion), and after the empty context all bytes left are
equal. The statistics are frozen, so each (context, byte) has one exact code length
in each language. A text's score is the sum over all its bytes; the shortest code wins.

The trees of all languages are laid out as two tables: context -> node, and (node,
byte) -> code length in each language, so a batch of texts is scored by two gathers in
numpy. Texts are lower-cased first.

Learning: ``sample_per_lang`` rows of each language at most (a documented bound; the
rows of lowest hash in ``BUCKETS`` hash buckets; a row that repeats id, language and text counts
once), whole texts. More than ``MAX_LANGUAGES`` languages are an error. The counts of those are
summed on the executors, and their number is bounded by the sample. Prediction reads
every row and whole text, in one pass without a shuffle.

Defined results: a null text or one without a letter is ``und`` with score 0; so is
every text if nothing could be learned. A null lang teaches nothing. Ties go to the
language that sorts first. score is the posterior share of the language predicted,
under equal priors. Repeated rows give repeated results; an empty table gives none.
Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitelake.runtime import materialize, ship

ORDER, SAMPLE_PER_LANG, BUCKETS, MAX_LANGUAGES = 3, 1024, 64, 256
UNDETERMINED = "und"
_STEP = 1 << 19


def _bytes(text: str | None) -> bytes:
    return (text or "").lower().encode("utf-8", "surrogatepass")


def ngrams(texts: list[bytes], order: int) -> dict[bytes, int]:
    """Counts of (context + byte) of full order; a text begins in a context of line feeds."""
    out: dict[bytes, int] = {}
    pad = b"\n" * order
    for t in texts:
        if not t:
            continue
        b = np.frombuffer(pad + t, np.uint8).astype(np.uint64)
        key = np.zeros(len(t), np.uint64)
        for k in range(order + 1):
            key = (key << np.uint64(8)) | b[k : k + len(t)]
        for g, n in zip(*np.unique(key, return_counts=True), strict=True):
            g = int(g).to_bytes(order + 1, "big")
            out[g] = out.get(g, 0) + int(n)
    return out


@dataclass
class Model:
    """langs; byte -> class; packed context -> node; code length in bits of (node, class) in each language."""

    langs: list[str]
    order: int
    classes: np.ndarray
    nodes: np.ndarray
    bits: np.ndarray

    @property
    def size(self) -> int:
        return self.bits.shape[1]


def build(counts: dict[str, dict[bytes, int]], order: int) -> Model:
    langs = sorted(counts)
    seen = sorted({b for g in counts.values() for x in g for b in x} | {10})
    k = len(seen) + (len(seen) < 256)  # the last class: all bytes never seen
    classes = np.full(256, k - 1, np.int32)
    classes[seen] = np.arange(len(seen))
    others = 256 - len(seen)
    # for each language and order, the packed contexts and their counts by class
    grams = {}
    for lang in langs:
        keys = np.frombuffer(b"".join(counts[lang]), np.uint8).reshape(-1, order + 1)
        grams[lang] = classes[keys].astype(np.int64), np.array(list(counts[lang].values()), np.float64)
    pack = lambda c: sum((c[:, i] * k ** (c.shape[1] - 1 - i) for i in range(c.shape[1])), np.zeros(len(c), np.int64))
    contexts = {d: np.unique(np.concatenate([np.zeros(0, np.int64), *(pack(g[:, order - d : order]) for g, _ in grams.values())])) for d in range(1, order + 1)}
    contexts[0] = np.zeros(1, np.int64)
    first = np.cumsum([0] + [len(contexts[d]) for d in range(order + 1)])
    # packed context of full order -> its longest suffix that is a node
    nodes = np.zeros(1, np.int32)
    for d in range(1, order + 1):
        nodes = np.tile(nodes, k)
        nodes[contexts[d]] = first[d] + np.arange(len(contexts[d]), dtype=np.int32)
    table = np.zeros((first[-1], k, len(langs)), np.float32)
    for j, lang in enumerate(langs):
        g, n = grams[lang]
        by = []
        for d in range(order + 1):
            c = np.zeros((len(contexts[d]), k))
            np.add.at(c, (np.searchsorted(contexts[d], pack(g[:, order - d : order])), g[:, order]), n)
            by.append(c)
        for d in range(order + 1):
            p = np.zeros((len(contexts[d]), k))
            free, mass = np.ones_like(p, bool), np.ones((len(p), 1))
            for e in range(d, -1, -1):
                c = by[e][np.searchsorted(contexts[e], contexts[d] % k**e)] * free
                total, kinds = c.sum(1, keepdims=True), (c > 0).sum(1, keepdims=True)
                with np.errstate(invalid="ignore", divide="ignore"):
                    p += np.where(c > 0, mass * c / (total + kinds), 0)
                    mass = np.where(kinds > 0, mass * kinds / (total + kinds), mass)
                free &= c == 0
            left = free.sum(1, keepdims=True) + (others - 1 if others else 0)
            p += np.where(free, mass / np.maximum(left, 1), 0)
            table[first[d] : first[d + 1], :, j] = -np.log2(np.maximum(p, 1e-30))
    return Model(langs, order, classes, nodes, table)


def code_lengths(model: Model, texts: list[bytes]) -> np.ndarray:
    """Bits of each text in each language."""
    order, k, pad = model.order, model.size, b"\n" * model.order
    flat = model.classes[np.frombuffer(pad.join([b"", *texts]) if texts else b"", np.uint8)]
    sizes = np.array([len(t) + order for t in texts], np.int64)
    ends = np.cumsum(sizes)
    out = np.zeros((len(texts), len(model.langs)))
    rows = model.bits.reshape(-1, len(model.langs))
    for a in range(0, len(flat), _STEP):
        b = min(a + _STEP, len(flat))
        lo = max(a, order)
        if lo >= b:
            continue
        ctx = np.zeros(b - lo, np.int32)
        for i in range(order):
            ctx = ctx * k + flat[lo - order + i : b - order + i]
        bits = rows[model.nodes[ctx].astype(np.int64) * k + flat[lo:b]]
        t0, t1 = np.searchsorted(ends, [lo, b - 1], "right")
        for_text = np.arange(t0, min(t1, len(texts) - 1) + 1)
        begin = np.maximum(np.where(for_text > 0, ends[for_text - 1], 0) + order, lo) - lo  # the padding isn't scored
        stop = np.minimum(ends[for_text], b) - lo
        full = begin < stop
        if full.any():
            edges = np.stack([begin[full], stop[full]], 1).ravel()
            drop = edges[-1] == len(bits)
            out[for_text[full]] += np.add.reduceat(bits, edges[:-1] if drop else edges, axis=0, dtype=np.float64)[::2]
    return out


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def train_rows(docs: DataFrame, train: Column, id_col: str, text_col: str, lang_col: str, per_lang: int) -> DataFrame:
    """lang, content of the rows to learn from: at most per_lang of a language. Raises beyond MAX_LANGUAGES languages."""
    rows = docs.filter(train & docs[lang_col].isNotNull() & docs[text_col].isNotNull()).select(docs[id_col].alias("key"), docs[lang_col].alias("lang"), docs[text_col].alias("content"))
    rows = rows.withColumn("check", F.xxhash64("content"))
    ids = rows.select("key", "lang", "check", F.xxhash64(F.col("key").cast("string")).alias("h")).distinct()
    window = Window.partitionBy("lang", F.pmod("h", F.lit(BUCKETS))).orderBy("h", "key", "check")
    chosen = ids.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= max(1, per_lang // BUCKETS))
    chosen = materialize(chosen.select("key", "lang", "check"), "lang_sample")
    if chosen.select("lang").distinct().count() > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    # at most per_lang rows for each of MAX_LANGUAGES languages: a size that does not grow with the table
    return rows.join(F.broadcast(chosen), ["key", "lang", "check"], "left_semi").dropDuplicates(["key", "lang", "check"]).select("lang", "content")


def train_model(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", order: int = ORDER, per_lang: int = SAMPLE_PER_LANG) -> Model:
    ship(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by: dict[str, list[bytes]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                by.setdefault(lang, []).append(_bytes(text))
            for lang, texts in by.items():
                found = ngrams(texts, order)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], ["lang", "gram", "n"])

    rows = train_rows(docs, train, id_col, text_col, lang_col, per_lang)
    summed = rows.select("lang", "content").mapInArrow(count, "lang string, gram binary, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counts: dict[str, dict[bytes, int]] = {}
    for r in summed.toLocalIterator():  # bounded by the sample
        counts.setdefault(r["lang"], {})[bytes(r["gram"])] = r["n"]
    return build(counts, order)


def predict_language(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of docs in order, then lang_pred, lang_score (columns of these names are replaced)."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            rest, letters = batch.column(0), batch.column(1).to_pylist()
            texts = rest.field(text_at)
            langs, scores, at = [], [], 0
            while at < len(letters):
                group, size = [], 0
                while at < len(letters) and size < 4 * _STEP:
                    group.append(_bytes(texts[at].as_py()))
                    size += len(group[-1])
                    at += 1
                bits = code_lengths(model, group) if model.langs else np.zeros((len(group), 1))
                best = bits.argmin(1)
                share = 1 / np.exp2(np.clip(bits.min(1, keepdims=True) - bits, -1000, 0)).sum(1)
                for i, has in enumerate(letters[at - len(group) : at]):
                    ok = has and model.langs
                    langs.append(model.langs[best[i]] if ok else UNDETERMINED)
                    scores.append(float(share[i]) if ok else 0.0)
            yield pa.RecordBatch.from_arrays([rest, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["row", "lang_pred", "lang_score"])

    kept = [c for c in docs.columns if c not in ("lang_pred", "lang_score")]
    text_at = kept.index(text_col)
    row = F.struct(*[docs[c].alias(f"c{i}") for i, c in enumerate(kept)]).alias("row")
    given = docs.select(row, has_letter(docs[text_col]).alias("has_letter"))
    kind = given.schema["row"].dataType.simpleString()
    made = given.mapInArrow(score, f"row {kind}, lang_pred string, lang_score double")
    return made.select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(kept)], "lang_pred", "lang_score")
