"""Near duplicates by ProbMinHash over weighted word shingles.

Shingles are runs of five words (a shorter text is one shingle); the weight of a
shingle is 1 + ln(times). Each shingle sends a Poisson process of arrivals at a rate of its
weight, each arrival to a random one of m registers; a register keeps the shingle that arrives
first. Shingles stop once they arrive later than the slowest register was reached, so a
long text costs little more than a draw per shingle. Two texts agree in a register
with the probability J_P(x, y), the probability Jaccard similarity, which is the plain Jaccard
similarity where all weights are equal.

Registers form bands; texts that share a band are candidates. Candidates are verified by
the exact J_P of their shingles. Two texts of similarity 0.8 miss each other in all of 26
bands of 6 registers with probability 4e-4.

No bucket is expanded into pairs. Identical texts are one numbered representative first, and buckets of the same
members are one bucket. A bucket is divided into chunks of about CHUNK members, each with the bucket's
least one besides; a task bounds J_P for all pairs of a chunk in matrix products, computes it for those that the
bounds leave open, and returns the links of a spanning forest: fewer than there are texts, however many pairs
are similar. A bucket of one chunk is done with that. Where a larger one still holds several components,
its members outside the largest component meet all others, chunk by chunk, so that no link is lost; members
of one component never meet again.

Words are runs of ASCII letters and digits and of anything outside ASCII, lower-cased.

Defined results: a null text is empty. Texts without words are near duplicates of identical
texts only. Every row is classified by its text, rows without an id or that repeat one as well, and each is reported.
class_id is the least id of a class, null where no row of it has one. An empty
table gives no rows. Only the two named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelake.llm.components import components
from sitelake.runtime import materialize, ship

WORDS, THRESHOLD, BANDS, ROWS, CHUNK = 5, 0.8, 26, 6, 256
_BATCH = 1 << 19
_HASH = np.uint64((1 << 48) - 1)
_WORD = np.array([chr(i).isalnum() or i >= 128 for i in range(256)])
_BASE = 0x9E3779B97F4A7C15
_powers: dict[str, np.ndarray] = {}


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers["up"]) < n:
        size = max(n, 2 * _BATCH)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def shingles(texts: list[str | None], k: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all texts: which text, shingle hash (48 bits), times; each text's shingles once, in order of text and hash."""
    data = [(t or "").lower().encode("utf-8", "surrogatepass") for t in texts]
    sizes = np.array([len(d) + 1 for d in data], np.int64)
    buf = np.frombuffer(b" ".join([*data, b""]), np.uint8)
    up, down = _power_tables(len(buf) + 1)
    inside = _WORD[buf]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]])))
    start, stop = edge[::2], edge[1::2]
    prefix = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * up[: len(buf)], out=prefix[1:])
    word = _mix((prefix[stop] - prefix[start]) * down[start])
    of = np.searchsorted(np.cumsum(sizes), start, "right")
    n = len(word)
    salt = _mix(np.arange(1, k + 1, dtype=np.uint64)) | np.uint64(1)
    per = np.bincount(of, minlength=len(texts))
    hashes, owner = [], []
    if n >= k:
        run = np.zeros(n - k + 1, np.uint64)
        for i in range(k):
            run += word[i : n - k + 1 + i] * salt[i]
        same = of[: n - k + 1] == of[k - 1 :]
        hashes.append(run[same])
        owner.append(of[: n - k + 1][same])
    first = np.concatenate([[0], np.cumsum(per)[:-1]])
    for t in np.flatnonzero((per > 0) & (per < k)):  # a short text: all its words
        w = word[first[t] : first[t] + per[t]]
        hashes.append(np.array([(w * salt[: len(w)]).sum(dtype=np.uint64)]))
        owner.append(np.array([t]))
    if not hashes:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    key = np.sort((np.concatenate(owner).astype(np.uint64) << np.uint64(48)) | (_mix(np.concatenate(hashes)) & _HASH))
    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    times = np.diff(np.append(new, len(key)))
    key = key[new]
    return (key >> np.uint64(48)).astype(np.int64), key & _HASH, times


def weight(times: np.ndarray) -> np.ndarray:
    return 1 + np.log(times)


def sketch(of: np.ndarray, h: np.ndarray, w: np.ndarray, n_texts: int, m: int) -> np.ndarray:
    """Registers (n_texts, m): the shingle that arrives first; 0 in all of a text without shingles."""
    arrival, holder = np.full(n_texts * m, np.inf), np.zeros(n_texts * m, np.uint64)
    t, wave = np.zeros(len(h)), 0
    while len(h):
        wave += 1
        draw = _mix(h + np.uint64(wave * 0x9E3779B97F4A7C15 & (2**64 - 1)))
        t = t - np.log(((draw >> np.uint64(12)).astype(np.float64) + 0.5) / 2**52) / w
        at = of * m + (_mix(draw + np.uint64(wave)) % np.uint64(m)).astype(np.int64)
        ahead = np.flatnonzero(t < arrival[at])
        ahead = ahead[np.argsort(-t[ahead], kind="stable")]  # of those to one register, the earliest is written last
        arrival[at[ahead]], holder[at[ahead]] = t[ahead], h[ahead]
        slowest = arrival.reshape(n_texts, m).max(1)
        alive = np.flatnonzero(t < slowest[of])
        of, h, w, t = of[alive], h[alive], w[alive], t[alive]
    return holder.reshape(n_texts, m)


def band_keys(registers: np.ndarray, bands: int, rows: int) -> np.ndarray:
    out = np.zeros((len(registers), bands), np.uint64)
    for b in range(bands):
        x = np.full(len(registers), b + 1, np.uint64)
        for r in range(rows):
            x = _mix(x * np.uint64(3) + registers[:, b * rows + r])
        out[:, b] = x
    return out.view(np.int64)


def probability_jaccard(ha: np.ndarray, wa: np.ndarray, hb: np.ndarray, wb: np.ndarray) -> float:
    """Exact J_P of two weighted sets, given as sorted hashes and weights."""
    if not len(ha) or not len(hb):
        return 0.0
    all_ = np.union1d(ha, hb)
    x, y = np.zeros(len(all_)), np.zeros(len(all_))
    x[np.searchsorted(all_, ha)], y[np.searchsorted(all_, hb)] = wa, wb
    with np.errstate(divide="ignore"):
        ratio = np.where(y > 0, x / np.where(y > 0, y, 1), np.inf)
    order = np.argsort(ratio, kind="stable")
    r, x, y = ratio[order], x[order], y[order]
    below_y = np.concatenate([[0], np.cumsum(y)])
    above_x = np.concatenate([np.cumsum(x[::-1])[::-1], [0]])
    at = np.searchsorted(r, r, "left")  # those before have a smaller ratio
    both = (x > 0) & (y > 0)
    total = above_x[at[both]] / x[both] + below_y[at[both]] / y[both]
    return float((1 / total).sum())


def _grouped(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, list]]:
    """(first row, texts) of parts of about _BATCH characters."""
    at, texts = 0, batch.column(column)
    while at < batch.num_rows:
        part, size = [], 0
        while at + len(part) < batch.num_rows and size < _BATCH and len(part) < 4096:
            part.append(texts[at + len(part)].as_py())
            size += len(part[-1] or "")
        yield at, part
        at += len(part)


def signatures(docs: DataFrame, bands: int, rows: int, words: int) -> DataFrame:
    """doc_id, digest, keys: the band keys of each row (none without words)."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in _grouped(batch, 2):
                of, h, times = shingles(texts, words)
                keys = band_keys(sketch(of, h, weight(times), len(texts), bands * rows), bands, rows)
                has = np.bincount(of, minlength=len(texts)) > 0
                offsets = np.concatenate([[0], np.cumsum(np.where(has, bands, 0))]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys[has].ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), batch.column(1).slice(at, len(texts)), lists], ["doc_id", "digest", "keys"])

    return docs.select("doc_id", "digest", "content").mapInArrow(sign, "doc_id long, digest binary, keys array<long>")


def _beside(key: str) -> Column:
    """A second grouping key that the first one determines: the groups are the same, but a join on the first one
    alone then shuffles both sides right below it, where adaptive execution can split a hot key."""
    return F.pmod(F.col(key), F.lit(7)).alias("beside")


def _pair_sums(of: np.ndarray, h: np.ndarray, w: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Over the shingles that texts i and j share: (n, n) sums of i's weights; of those weights that are the same in both.

    Shingles that many texts hold go through matrix products, the others along runs of equal shingles.
    """
    own, same = np.zeros((n, n)), np.zeros((n, n))
    order = np.lexsort((w, h))
    hs, of_s, w_s = h[order], of[order], w[order]
    first = np.flatnonzero(np.concatenate([[True], hs[1:] != hs[:-1]])) if len(hs) else np.zeros(0, np.int64)
    size = np.diff(np.append(first, len(hs)))
    wide = (size > 1) & (size * 16 > n)
    at = np.flatnonzero(np.repeat(wide, size))
    if len(at):
        column = np.cumsum(np.concatenate([[0], np.diff(hs[at]) != 0]))
        step = max(1, _BATCH // n)
        for c in range(0, int(column[-1]) + 1, step):
            part = slice(*np.searchsorted(column, [c, c + step]))
            t, col, x = of_s[at[part]], column[part] - c, w_s[at[part]]
            held, weights = np.zeros((n, step)), np.zeros((n, step))
            held[t, col], weights[t, col] = 1, x
            own += weights @ held.T
            for v in np.unique(x):  # few different numbers of times
                equal = np.where(weights == v, 1.0, 0.0)
                equal = equal[:, equal.any(0)]
                same += v * (equal @ equal.T)
    first, size = first[(size > 1) & ~wide], size[(size > 1) & ~wide]
    ends = np.cumsum(size * size)
    edges = np.searchsorted(ends, np.arange(0, int(ends[-1]) + _BATCH, _BATCH), "left") if len(ends) else []
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        f, c = first[a:b], size[a:b]
        if not len(f):
            continue
        pairs = c * c
        k = np.arange(pairs.sum()) - np.repeat(np.cumsum(pairs) - pairs, pairs)
        each = np.repeat(c, pairs)
        x, y = np.repeat(f, pairs) + k // each, np.repeat(f, pairs) + k % each
        cell = of_s[x] * n + of_s[y]
        own += np.bincount(cell, weights=w_s[x], minlength=n * n).reshape(n, n)
        same += np.bincount(cell, weights=np.where(w_s[x] == w_s[y], w_s[x], 0), minlength=n * n).reshape(n, n)
    return own, same


def bounds(of: np.ndarray, h: np.ndarray, w: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(n, n) each: at least and at most the J_P of different texts i and j; the same where no shared shingle differs in weight.

    With X and Y the sums of all weights, x and y those of the shared shingles and e that of the shared
    shingles of one weight in both: such a shingle adds its weight over X + Y - m, where m, the sum of the
    smaller weights, is between e and min(x, y). The others add no more than the smaller of their shares,
    (x - e) / X and (y - e) / Y, together.
    """
    total = np.maximum(np.bincount(of, weights=w, minlength=n), 1e-300)
    x, e = _pair_sums(of, h, w, n)
    y, both = x.T, total[:, None] + total[None, :]
    other = np.maximum(np.minimum((x - e) / total[:, None], (y - e) / total[None, :]), 0)
    high = e / np.maximum(both - np.minimum(x, y), 1e-300) + other
    return np.where(np.maximum(x, y) - e < 1e-9, high, e / np.maximum(both - e, 1e-300)), high


def spanning_links(root: np.ndarray, of: np.ndarray, h: np.ndarray, w: np.ndarray, threshold: float) -> list[tuple[int, int]]:
    """(i, j): similar pairs of texts that join all components (given by root) which any similar pair joins.

    J_P is computed for pairs that the bounds leave open, and only while they are in different components.
    """
    n = len(root)
    begin = np.searchsorted(of, np.arange(n + 1))
    low, high = bounds(of, h, w, n)
    label = np.unique(root, return_inverse=True)[1]
    out = []

    def join(i: int, j: int) -> None:
        out.append((i, j))
        label[label == label[j]] = label[i]

    sure = low >= threshold + 1e-9
    for i in np.flatnonzero(sure.any(1)):
        while len(others := np.flatnonzero(sure[i] & (label != label[i]))):
            join(int(i), int(others[0]))
    own = lambda t: slice(begin[t], begin[t + 1])
    open_ = np.triu((high >= threshold - 1e-9) & ~sure & (label[:, None] != label[None, :]), 1)
    for i, j in zip(*(x.tolist() for x in np.nonzero(open_)), strict=True):
        if label[i] != label[j] and probability_jaccard(h[own(i)], w[own(i)], h[own(j)], w[own(j)]) >= threshold - 1e-12:
            join(i, j)
    return out


def linked(cells: DataFrame, texts: DataFrame, threshold: float, words: int) -> DataFrame:
    """a, b: links of a spanning forest in each cell. cells: key, lo, hi (which name the cell), num, root; texts: num, content."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(nums: list[int], roots: list[int], texts: list[str]) -> pa.RecordBatch:
            of, h, times = shingles(texts, words)
            found = spanning_links(np.array(roots), of, h, weight(times), threshold)
            return pa.RecordBatch.from_arrays([pa.array([nums[i] for i, _ in found], pa.int64()), pa.array([nums[j] for _, j in found], pa.int64())], ["a", "b"])

        now, held = None, ([], [], [])
        for batch in batches:
            keys = list(zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True))
            for k, key in enumerate(keys):
                if key != now:
                    if len(set(held[1])) > 1:
                        yield links(*held)
                    now, held = key, ([], [], [])
                for values, column in zip(held, (3, 4, 5), strict=True):
                    values.append(batch.column(column)[k].as_py())
        if len(set(held[1])) > 1:
            yield links(*held)

    rows = cells.join(texts, "num").select("key", "lo", "hi", "num", "root", "content")
    met = rows.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi").mapInArrow(compare, "a long, b long")
    return met.distinct()


def _dealt(parts: Column) -> Column:
    """A chunk of a bucket's member: another one in each bucket, so that chunks of different buckets overlap at random."""
    return F.pmod(F.xxhash64("num", "key"), parts)


def own_cells(buckets: DataFrame, chunk: int) -> DataFrame:
    """Each member in one chunk of its bucket, and the least member in all. buckets: key, num, hub, n."""
    parts = F.ceil(F.col("n") / chunk)
    at = F.when(F.col("num") == F.col("hub"), F.sequence(F.lit(0).cast("long"), parts - 1)).otherwise(F.array(_dealt(parts)))
    return buckets.select("key", F.explode(at).alias("lo"), "num").select("key", "lo", F.col("lo").alias("hi"), "num", F.col("num").alias("root"))


def open_cells(buckets: DataFrame, found: DataFrame, chunk: int) -> DataFrame:
    """Of buckets of several chunks and components: every chunk outside the largest component with every other chunk.

    buckets: key, num, n; found: node, root. With a members in the largest component and b outside, a row goes to about b / chunk
    cells, those outside to (a + b) / chunk.
    """
    large = buckets.filter(F.col("n") > chunk)
    labelled = materialize(large.join(found, large["num"] == found["node"], "left").select("key", "num", "n", F.coalesce("root", "num").alias("root")), "near_labelled")
    sizes = labelled.groupBy("key", "root").agg(F.count(F.lit(1)).alias("held"))
    most = sizes.groupBy("key", _beside("key")).agg(F.max(F.struct("held", "root")).alias("top"), F.count(F.lit(1)).alias("roots")).filter("roots > 1")
    rows = labelled.join(most.select("key", F.col("top.held").alias("a"), F.col("top.root").alias("main")), "key")
    inner, outer = F.ceil(F.col("a") / chunk), F.ceil((F.col("n") - F.col("a")) / chunk)
    inside = F.col("root") == F.col("main")
    rows = rows.withColumn("own", F.when(inside, _dealt(inner)).otherwise(inner + _dealt(outer)))
    rows = rows.withColumn("other", F.explode(F.sequence(F.when(inside, inner).otherwise(F.lit(0)), inner + outer - 1)))
    return rows.select("key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "num", "root")


def _members(docs: DataFrame, threshold: float, words: int, bands: int, rows: int, chunk: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, digest, class_id, class_size, first (the digest that stays with class_id) of every row."""
    ship(docs.sparkSession)
    text = F.coalesce(docs[text_col], F.lit(""))
    base = docs.select(docs[id_col].cast("long").alias("doc_id"), text.alias("content"), F.unhex(F.sha2(text, 256)).alias("digest"))
    signed = materialize(signatures(base, bands, rows, words), "near_signatures")
    # numbers of different texts: fixed once the table is written
    ones = signed.groupBy("digest").agg(F.min("doc_id").alias("least"), F.first("keys").alias("keys"))
    ones = materialize(ones.select("digest", "least", "keys", F.monotonically_increasing_id().alias("num")), "near_ones")
    members = ones.select("num", F.explode("keys").alias("key"))
    # grouped by more than the join needs, so that the join shuffles both sides right below it
    sets = members.groupBy("key", _beside("key")).agg(F.min("num").alias("hub"), F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("num")).alias("x"), F.bit_xor(F.xxhash64("num", F.lit(1))).alias("y"))
    sets = sets.filter("n > 1").groupBy("n", "hub", "x", "y").agg(F.min("key").alias("key")).select("key", "hub", "n")  # of buckets with the same members, one
    buckets = materialize(members.join(sets, "key").select("key", "num", "hub", "n"), "near_buckets")
    wanted = ones.join(buckets.select("num").distinct(), "num", "left_semi").select(F.col("digest").alias("of"), "least", "num")
    texts = base.join(wanted, (base["digest"] == wanted["of"]) & base["doc_id"].eqNullSafe(wanted["least"]))
    texts = materialize(texts.select("num", "content").dropDuplicates(["num"]), "near_texts")
    links = materialize(linked(own_cells(buckets, chunk), texts, threshold, words), "near_links")
    cells = materialize(open_cells(buckets, components(links), chunk), "near_cells")
    more = materialize(linked(cells, texts, threshold, words), "near_more")
    found = materialize(components(links.unionByName(more)), "near_components")
    named = ones.select("digest", "num").join(found, F.col("num") == F.col("node"), "left").select(F.col("digest").alias("of"), F.coalesce("root", "num").alias("root"))
    placed = materialize(signed.join(named, F.col("digest") == F.col("of")).select("doc_id", "digest", "root"), "near_placed")
    least = F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id").alias("id"), F.col("digest").alias("of"))).alias("least")
    classes = placed.groupBy("root", _beside("root")).agg(least, F.count(F.lit(1)).alias("class_size"))
    classes = classes.select("root", "class_size", F.col("least.id").alias("class_id"), F.col("least.of").alias("first"))
    return placed.join(classes, "root").select("doc_id", "digest", "class_id", "class_size", "first")


def near_duplicate_classes(docs: DataFrame, threshold: float = THRESHOLD, words: int = WORDS, bands: int = BANDS, rows: int = ROWS, chunk: int = CHUNK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, class_id, class_size of every row."""
    return _members(docs, threshold, words, bands, rows, chunk, id_col, text_col).select("doc_id", "class_id", "class_size")


def keep_one_of_each(docs: DataFrame, threshold: float = THRESHOLD, words: int = WORDS, bands: int = BANDS, rows: int = ROWS, chunk: int = CHUNK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that are the first of their class, by id (rows without one last) and then digest.

    Rows that repeat an id and text stay or go together; rows that share an id alone are different ones.
    """
    every = _members(docs, threshold, words, bands, rows, chunk, id_col, text_col)
    goes = ~(F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("digest") == F.col("first")))
    dropped = materialize(every.filter(goes).select(F.col("doc_id").alias("dropped_id"), F.col("digest").alias("dropped_digest")).distinct(), "near_dropped")
    digest = F.unhex(F.sha2(F.coalesce(docs[text_col], F.lit("")), 256))
    return docs.join(dropped, (digest == dropped["dropped_digest"]) & docs[id_col].cast("long").eqNullSafe(dropped["dropped_id"]), "left_anti")
