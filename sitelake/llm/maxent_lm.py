"""Language-model scoring with a hashed maximum-entropy model.

The ``OWN`` most frequent words are targets of their own; every other word falls, by a hash of its last
``SUFFIX`` bytes, into one of ``SHARED`` targets. Targets lie in ``CLASSES`` classes of ``MEMBERS``, and

    P(word | history) = P(class | history) * P(target | class, history) * P(word | target).

The first two are softmaxes over features of the two words before, which are told apart likewise,
as ``HISTORY`` histories: bias, last word (bigram), the word before it (skip), and for classes also both (trigram,
hashed to ``TRIGRAMS`` rows). The third is the word's share of its target in the training counts, with 0.1 added
to every known word and to the unknown.

The gradient is observed minus expected counts. The observed ones are gathered from all training tokens: (last,
target), (skip, target) and (last, skip, class). The last of them is also all that the expected ones depend on, so a
step is one job over it, a row per skip word: tasks return expected counts of a fixed size, and the driver
moves each weight by the logarithm of observed over expected counts, damped and with a penalty. A step costs the same at every
corpus size.

Scoring: the normalisers of all histories and classes make a table, so a token's score is three gathers in a numpy
batch over the distinct tables, and sums by text.

Exact word counts are one aggregation with local combining. At most ``FREQUENT`` words, the most frequent, are broadcast:
a histogram of counts gives the count from which words are that frequent, so nothing is sorted and nothing else is collected. The others
of a document are joined to the counts by word and summed back, so no word is left out and no word that is joined is hot.

Defined results: a null text is empty and has one token, its end. Rows with a null id teach
nothing and are not held out. Repeated rows count and are scored each. Without training rows
every unknown token has base probability 1 and the model is uniform over targets. An empty
table gives no rows. Only the named columns are read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelake.runtime import materialize, ship

CLASSES, MEMBERS, SHARED, SUFFIX = 32, 64, 256, 2
TARGETS = CLASSES * MEMBERS
OWN = TARGETS - SHARED
HISTORY, HISTORY_SHARED = 256, 128
HISTORY_OWN = HISTORY - HISTORY_SHARED
TRIGRAMS = 1 << 15
LAST, SKIP, BOTH = 1, 1 + HISTORY, 1 + 2 * HISTORY  # first rows of the features; row 0 is the bias
FREQUENT, FLUSH, REMEMBERED = 1 << 17, 200_000, 150_000
STEPS, RATE, PENALTY, DAMP, TASKS = 12, 0.4, 2.0, 1.0, 8
ADD = 0.1
END = b""  # the end of a text; no word is empty


def words(text: bytes | None) -> list[bytes]:
    """A-Z lower-cased, split at ASCII white space, and the end."""
    out = (text or b"").lower().split()
    out.append(END)
    return out


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def trigram_rows(skip: np.ndarray, last: np.ndarray) -> np.ndarray:
    return BOTH + (_mix(skip.astype(np.uint64) * np.uint64(HISTORY) + last.astype(np.uint64)) % np.uint64(TRIGRAMS)).astype(np.int64)


def _log_softmax(x: np.ndarray) -> np.ndarray:
    x = x - x.max(-1, keepdims=True)
    return x - np.log(np.exp(x).sum(-1, keepdims=True))


@dataclass
class Weights:
    """Rows of features (bias, last, skip; by_class: also both) by classes, and by targets."""

    by_class: np.ndarray
    member: np.ndarray

    def scores(self, skip: int) -> tuple[np.ndarray, np.ndarray]:
        """Of all last words after one skip word: (HISTORY, CLASSES) and (HISTORY, CLASSES, MEMBERS)."""
        last = np.arange(HISTORY)
        c = self.by_class[0] + self.by_class[LAST:SKIP] + self.by_class[SKIP + skip] + self.by_class[trigram_rows(np.full(HISTORY, skip), last)]
        m = self.member[0] + self.member[LAST:SKIP] + self.member[SKIP + skip]
        return c, m.reshape(HISTORY, CLASSES, MEMBERS)

    def logs(self, skip: int) -> tuple[np.ndarray, np.ndarray]:
        """Natural logs of P(class | history) and P(member | class, history) of all last words."""
        c, m = self.scores(skip)
        return _log_softmax(c), _log_softmax(m)

    @cached_property
    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """log10 P(target | skip, last) = a[skip, last, class] + b[last, target] + c[skip, target]."""
        a = np.empty((HISTORY, HISTORY, CLASSES), np.float32)
        for skip in range(HISTORY):
            c, m = self.scores(skip)
            top = m.max(2, keepdims=True)
            a[skip] = _log_softmax(c) - top[:, :, 0] - np.log(np.exp(m - top).sum(2))
        ten = np.float32(1 / np.log(10))
        return a * ten, (self.member[0] + self.member[LAST:SKIP]) * ten, self.member[SKIP:BOTH] * ten

    def log10(self, skip: np.ndarray, last: np.ndarray, target: np.ndarray) -> np.ndarray:
        a, b, c = (t.ravel() for t in self.tables)
        history = skip * HISTORY + last
        return a[history * CLASSES + target // MEMBERS].astype(np.float64) + b[last * TARGETS + target] + c[skip * TARGETS + target]


def expected(w: Weights, skip: int, seen: np.ndarray, by_class: np.ndarray, member: np.ndarray) -> float:
    """Adds to by_class and member the expected counts of all last words after one skip word.

    seen: (HISTORY, CLASSES) counts of the class that follows. Returns the log likelihood of the classes.
    """
    c, m = w.logs(skip)
    of_class = seen.sum(1, keepdims=True) * np.exp(c)
    of_target = (seen[:, :, None] * np.exp(m)).reshape(HISTORY, TARGETS)
    for out, e in ((by_class, of_class), (member, of_target)):
        out[0] += e.sum(0)
        out[LAST:SKIP] += e
        out[SKIP + skip] += e.sum(0)
    np.add.at(by_class, trigram_rows(np.full(HISTORY, skip), np.arange(HISTORY)), of_class)
    return float((seen * c).sum())


@dataclass
class Vocabulary:
    """ids: frequent word -> number in order of frequency; the others get len(ids) + a hash of their suffix."""

    ids: dict[bytes, int]
    target: np.ndarray  # of each number
    history: np.ndarray  # of each number
    log_count: np.ndarray  # log10(count + 0.1) of each frequent word
    target_log: np.ndarray  # log10 of what a count in the target is divided by; 0 and -log_count cancel for own targets

    def lookup(self) -> dict[bytes, int]:
        first = len(self.ids)

        class Numbers(dict):
            def __missing__(self, word: bytes) -> int:
                if len(self) > first + REMEMBERED:
                    for w in [w for w, i in self.items() if i >= first]:
                        del self[w]
                self[word] = i = first + suffix(word)
                return i

        return Numbers(self.ids)


def suffix(word: bytes) -> int:
    return zlib.crc32(word[-SUFFIX:]) % SHARED


def _sequence(vocabulary: Vocabulary, numbers: dict, texts: list[bytes | None]) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All tokens of the texts, their numbers and targets, the histories skip and last, and where each text starts."""
    split = [words(t) for t in texts]
    tokens = list(chain.from_iterable(split))
    ids = np.fromiter(map(numbers.__getitem__, tokens), np.int64, len(tokens))
    starts = np.concatenate([[0], np.cumsum([len(s) for s in split])[:-1]]).astype(np.int64)
    history, end = vocabulary.history[ids], vocabulary.history[numbers[END]]
    last = np.concatenate([[end], history[:-1]])  # a text before ends with its end
    skip = np.concatenate([[end, end], history[:-2]])[: len(ids)]
    skip[starts] = end
    return tokens, ids, vocabulary.target[ids], skip, last, starts


def word_counts(docs: DataFrame) -> DataFrame:
    """word, n over the column content of docs; the end is the empty word."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(found: Counter) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], ["word", "n"])

        found: Counter = Counter()
        for batch in batches:
            for text in batch.column(0):
                found.update(words(text.as_py()))
                if len(found) > FLUSH:
                    yield out(found)
                    found = Counter()
        yield out(found)

    return docs.select("content").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(counts: DataFrame) -> list[tuple[bytes, int]]:
    """(word, n) in order of frequency: all words of the highest counts, FREQUENT at most."""
    level = F.floor(F.log2("n") * 64)  # few thousand levels at most
    least, room = None, FREQUENT
    for r in sorted(counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("v")).collect(), reverse=True):
        room -= r["v"]
        if room < 0:
            break
        least = r["level"]
    if least is None:
        return []
    found = counts.filter(level >= least).select("word", "n").toArrow()
    return sorted(zip(*(c.to_pylist() for c in found.columns), strict=True), key=lambda x: (-x[1], x[0]))


def make_vocabulary(counts: DataFrame) -> tuple[Vocabulary, int, int, np.ndarray]:
    """Also the number of training tokens, of different ones, and the tokens of each target."""
    n, v = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    top = frequent_words(counts)
    own, history_own = min(OWN, len(top)), min(HISTORY_OWN, len(top))
    hashed = np.array([suffix(w) for w, _ in top], np.int64)
    every = np.arange(SHARED)
    target = np.concatenate([np.arange(own), OWN + hashed[own:], OWN + every])
    history = np.concatenate([np.arange(history_own), HISTORY_OWN + hashed[history_own:] % HISTORY_SHARED, HISTORY_OWN + every % HISTORY_SHARED])
    held = np.array([n for _, n in top], np.float64)
    tokens, kinds = np.zeros(TARGETS), np.zeros(TARGETS)
    tokens[:own] = held[:own]
    least = counts.join(F.broadcast(counts.sparkSession.createDataFrame([(w,) for w, _ in top[:own]], "word binary")), "word", "left_anti")
    ending = F.when(F.length("word") > SUFFIX, F.substring("word", -SUFFIX, SUFFIX)).otherwise(F.col("word"))
    for r in least.groupBy((F.crc32(ending) % SHARED).alias("b")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect():
        tokens[OWN + r["b"]], kinds[OWN + r["b"]] = r["n"], r["v"]
    divide = np.log10(tokens + ADD * (kinds + 1))
    divide[:OWN] = 0.0
    return Vocabulary({w: i for i, (w, _) in enumerate(top)}, target, history, np.log10(held + ADD), divide), int(n), int(v), tokens


#: Cells of the observed counts: (last, target), (skip, target), (skip, last, class).
_BY_LAST, _BY_SKIP, _BY_BOTH = HISTORY * TARGETS, HISTORY * TARGETS, HISTORY * HISTORY * CLASSES


def observed_counts(docs: DataFrame, vocabulary) -> DataFrame:
    """cell, n over the column content of docs; a cell of no count has no row."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary.value
        numbers, cells = vocab.lookup(), np.zeros(_BY_LAST + _BY_SKIP + _BY_BOTH, np.int32)
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                _, _, target, skip, last, _ = _sequence(vocab, numbers, batch.column(0).slice(k, 512).to_pylist())
                for at in (last * TARGETS + target, _BY_LAST + skip * TARGETS + target, _BY_LAST + _BY_SKIP + (skip * HISTORY + last) * CLASSES + target // MEMBERS):
                    at, n = np.unique(at, return_counts=True)
                    cells[at] += n.astype(np.int32)
        at = np.flatnonzero(cells)
        for k in range(0, len(at), 1 << 17):
            part = at[k : k + (1 << 17)]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(cells[part].astype(np.int64))], ["cell", "n"])

    return docs.select("content").mapInArrow(count, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n"))


def observed(counts: DataFrame) -> np.ndarray:
    """All cells; their number is fixed."""
    cells = np.zeros(_BY_LAST + _BY_SKIP + _BY_BOTH)
    packed = counts.select("cell", "n").coalesce(TASKS)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.column(0).to_numpy().tobytes()]), pa.array([b.column(1).to_numpy().tobytes()])], ["cell", "n"])

    for r in packed.mapInArrow(pack, "cell binary, n binary").toLocalIterator():
        cells[np.frombuffer(r["cell"], np.int32)] = np.frombuffer(r["n"], np.int64)
    return cells


def train(spark, cells: np.ndarray, tokens: np.ndarray, steps: int = STEPS, rate: float = RATE) -> tuple[Weights, list[float]]:
    """Weights, and the mean log likelihood of the classes before each step."""
    prior = np.log(tokens + 0.5).reshape(CLASSES, MEMBERS)
    w = Weights(np.zeros((BOTH + TRIGRAMS, CLASSES), np.float32), np.zeros((BOTH, TARGETS), np.float32))
    w.by_class[0] = np.log(np.exp(prior).sum(1))
    w.member[0] = prior.ravel()
    by_last = cells[:_BY_LAST].reshape(HISTORY, TARGETS)
    by_skip = cells[_BY_LAST : _BY_LAST + _BY_SKIP].reshape(HISTORY, TARGETS)
    seen = cells[_BY_LAST + _BY_SKIP :].reshape(HISTORY, HISTORY, CLASSES)
    member = np.concatenate([by_last.sum(0)[None], by_last, by_skip])
    by_class = np.concatenate([member.reshape(BOTH, CLASSES, MEMBERS).sum(2), np.zeros((TRIGRAMS, CLASSES))])
    for skip in range(HISTORY):
        np.add.at(by_class, trigram_rows(np.full(HISTORY, skip), np.arange(HISTORY)), seen[skip])
    used = [k for k in range(HISTORY) if seen[k].any()]
    given = pa.table([pa.array(used, pa.int32()), pa.array([seen[k].astype(np.float32).tobytes() for k in used], pa.binary())], ["skip", "seen"])
    rows = materialize(spark.createDataFrame(given).repartition(TASKS), "lm_histories")
    total, past = max(float(tokens.sum()), 1.0), []
    for _ in range(steps if used else 0):
        shared = spark.sparkContext.broadcast(w)

        def step(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            w, likelihood = shared.value, 0.0
            by_class, member = np.zeros_like(w.by_class), np.zeros_like(w.member)
            for b in batches:
                for skip, counted in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    likelihood += expected(w, skip, np.frombuffer(counted, np.float32).reshape(HISTORY, CLASSES), by_class, member)
            for name, table in (("c", by_class), ("m", member)):  # rows of histories that the task has not met stay out
                at = np.flatnonzero(table.any(1))
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([at.astype(np.int32).tobytes()]), pa.array([table[at].tobytes()]), pa.array([likelihood if name == "c" else 0.0])], ["name", "at", "counts", "ll"])

        of_class, of_target, ll = np.zeros_like(w.by_class), np.zeros_like(w.member), 0.0
        made = rows.coalesce(TASKS).mapInArrow(step, "name string, at binary, counts binary, ll double").toArrow()  # two rows a task
        for name, at, counted, part in zip(*(c.to_pylist() for c in made.columns), strict=True):
            table = of_class if name == "c" else of_target
            table[np.frombuffer(at, np.int32)] += np.frombuffer(counted, np.float32).reshape(-1, table.shape[1])
            ll += part
        del made
        shared.destroy()
        past.append(ll / total)
        w = Weights(w.by_class.copy(), w.member.copy())
        for weights, have, want in ((w.by_class, of_class, by_class), (w.member, of_target, member)):
            have[1:] += PENALTY * weights[1:]
            weights += rate * np.log((want + DAMP) / (np.maximum(have, 0) + DAMP))
    return w, past


@dataclass
class Model:
    """vocabulary, weights; tokens of training and different ones among them."""

    vocabulary: Vocabulary
    weights: Weights
    n: int
    v: int

    @property
    def whole(self) -> float:
        """log10 of what a count is divided by in the base."""
        return float(np.log10(self.n + ADD * (self.v + 1)))

    @cached_property
    def inside(self) -> np.ndarray:
        """log10 P(word | target) of each number, but for the count of a word that isn't frequent."""
        vocab = self.vocabulary
        counts = np.concatenate([vocab.log_count, np.zeros(SHARED)])
        return np.where(vocab.target >= OWN, counts, 0.0) - vocab.target_log[vocab.target]


def learn(docs: DataFrame, steps: int = STEPS) -> tuple[Model, DataFrame]:
    """The model of the column content of docs, and its word counts."""
    spark = docs.sparkSession
    counts = materialize(word_counts(docs), "lm_counts")
    vocabulary, n, v, tokens = make_vocabulary(counts)
    shared = spark.sparkContext.broadcast(vocabulary)
    cells = observed(materialize(observed_counts(docs, shared), "lm_observed"))
    weights, _ = train(spark, cells, tokens, steps)
    return Model(vocabulary, weights, n, v), counts


def score_documents(docs: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text", steps: int = STEPS) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of every row, learning from the rows where training holds."""
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("binary").alias("content"), F.coalesce(training, F.lit(False)).alias("training"))
    model, counts = learn(rows.filter("training"), steps)
    shared = spark.sparkContext.broadcast(model)
    n = model.n
    fields = [("row", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("model", pa.float64()), ("rare", pa.list_(pa.binary()))]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        vocab = model.vocabulary
        numbers, first, context = vocab.lookup(), len(vocab.ids), TaskContext.get()
        log_count = np.concatenate([vocab.log_count, np.zeros(SHARED)])
        row = (context.partitionId() if context else 0) << 36
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                words_, ids, target, skip, last, starts = _sequence(vocab, numbers, part.column(1).to_pylist())
                ends = np.append(starts[1:], len(ids))
                base = np.add.reduceat(log_count[ids], starts) - (ends - starts) * model.whole
                total = np.add.reduceat(model.weights.log10(skip, last, target) + model.inside[ids], starts)
                rare = np.flatnonzero(ids >= first)
                offsets = np.searchsorted(rare, np.append(starts, len(ids))).astype(np.int32)
                known = (ends - starts) - np.diff(offsets)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array([words_[i] for i in rare], pa.binary()))
                numbers_ = np.arange(row, row + part.num_rows)
                row += part.num_rows
                yield pa.RecordBatch.from_arrays([pa.array(numbers_), part.column(0), pa.array(ends - starts), pa.array(known), pa.array(base), pa.array(total), lists], schema=pa.schema(fields))

    made = rows.select(F.col("doc_id").cast("long"), "content").mapInArrow(score, "row long, doc_id long, n_tokens long, n_known long, base double, model double, rare array<binary>")
    scored = materialize(made, "lm_scored")
    # words that aren't broadcast: to the counts and back
    rare = scored.select("row", F.explode("rare").alias("word"))
    found = rare.join(counts, "word", "left").select("row", F.coalesce("n", F.lit(0)).alias("n"))
    sums = found.groupBy("row").agg(F.sum(F.log10(F.col("n") + ADD)).alias("more"), F.count_if(F.col("n") > 0).alias("known"))
    joined = scored.drop("rare").join(sums, "row", "left")
    more = F.coalesce("more", F.lit(0.0))
    return joined.select("doc_id", "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), (F.col("base") + more).alias("base_score"), (F.col("model") + more).alias("score"))
