"""Best-two-fit packing of tokenised documents into sequences of fixed capacity.

A document is its token ids and an end id. One that is longer than a sequence is cut
into pieces of exactly the capacity, of which the first may be shorter. Pieces are
packed as they come off the tokenizer, inside the task that read them, in blocks of
``block_tokens``: texts and ids are not shuffled, and memory is bounded by the block. A block's sequences that are not full hand their
pieces on to the next block, the emptiest first, up to half a block of tokens. What a task
hands on at its end, of all tasks together, is packed once more, in as many tasks as it has blocks. So short sequences are left
by those few tasks only, however small the parts of the table are, unless more than half a block waits at once.
The pieces of the first packing are written to the shared folder, so that a lost task can't change them afterwards.

Packing: fill a sequence greedily with the longest piece that fits. When none fits,
take its smallest piece out and look for the two unpacked pieces that fill the widened
gap best; if they are longer than the piece, they replace it. Lengths are kept as a bit
set, so "the longest that fits" is one mask and one bit_length.

Defined results: a null text is empty and becomes one piece of just the end id. Null ids
and repeated rows are packed like any other. An empty table packs to nothing. Texts of
any length are encoded whole. Only the two named columns are read.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelake.runtime import materialize, ship

CAPACITY, END_ID, BLOCK_TOKENS = 1024, 2, 1 << 22
CARRIED = 2  # a block hands on at most the tokens of a block divided by this
_AGAIN = 1 << 62  # sequences of the second packing
TOKENIZER = "byte_bpe_50k"
SCHEMA = "doc_id long, piece int, start long, length long, ids binary, sequence_id long, offset long"
_ARROW = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("sequence_id", pa.int64()), ("offset", pa.int64())])
_encoders: dict = {}


def best_two_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of indexes into lengths; every length is between 1 and capacity."""
    of: list[list[int]] = [[] for _ in range(capacity + 1)]
    for i, n in enumerate(lengths):
        of[n].append(i)
    free = sum(1 << n for n in range(1, capacity + 1) if of[n])

    def take(n: int) -> int:
        nonlocal free
        i = of[n].pop()
        if not of[n]:
            free ^= 1 << n
        return i

    def longest(limit: int) -> int:
        return (free & ((2 << limit) - 1)).bit_length() - 1

    bins = []
    while free:
        n = longest(capacity)
        bin_, gap, least = [take(n)], capacity - n, n
        while gap and (n := longest(gap)) > 0:
            bin_.append(take(n))
            gap, least = gap - n, n
        if gap and free:
            room, best, pair = gap + least, least, None
            a = longest(room - 1)
            while a > 0 and 2 * a > best:
                b = longest(min(a, room - a))
                if b == a and len(of[a]) < 2:
                    b = longest(a - 1)
                if b > 0 and a + b > best:
                    best, pair = a + b, (a, b)
                    if best == room:
                        break
                a = longest(a - 1)
            if pair:
                back = bin_.pop()
                bin_ += [take(pair[0]), take(pair[1])]
                of[least].append(back)
                free |= 1 << least
        bins.append(bin_)
    return bins


#: Texts for the tokenizers library: those with characters beyond the ones on which the rank file's library is shown to agree,
#: and with runs of white space, for which the expression of that library recurses.
_OTHER = re.compile("[^\\x00-\\u036f\\u2010-\\u2027\\u20ac]|\\s{256}")


def encoder(path: str):
    """text -> array of ids, as the tokenizers library gives them for the file, without added tokens.

    The rank file of the same vocabulary encodes plain texts faster; its ids are the same.
    """
    if path in _encoders:
        return _encoders[path]
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    full = Tokenizer.from_file(path)
    ranks = path.removesuffix(".json") + ".tiktoken"
    special = [t.content for t in full.get_added_tokens_decoder().values()]
    if os.path.exists(ranks):
        import tiktoken
        from public_tokenizers import PATTERN

        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(ranks, "rb"))}
        quick = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=table, special_tokens={}).encode_ordinary
    else:
        quick = None

    def encode(text: str) -> array:
        if quick and not _OTHER.search(text) and not any(s in text for s in special):
            return array("I", quick(text))
        return array("I", full.encode(text, add_special_tokens=False).ids)

    _encoders[path] = encode
    return encode


def pieces_of(n: int, capacity: int) -> Iterator[tuple[int, int]]:
    """(start, length) of the pieces of a document of n tokens."""
    at = 0
    while at < n:
        step = n if n <= capacity else (n - at) % capacity or capacity
        yield at, step
        at += step


class Packer:
    """Packs pieces (doc_id, piece, start, length, ids) in blocks; numbers sequences from first on."""

    def __init__(self, capacity: int, block_tokens: int, first: int) -> None:
        self.capacity, self.block, self.sequence = capacity, block_tokens, first
        self.held: list[tuple] = []
        self.tokens = 0

    def add(self, piece: tuple) -> Iterator[pa.RecordBatch]:
        self.held.append(piece)
        self.tokens += piece[3]
        if self.tokens >= self.block:
            yield from self.packed(self.block // CARRIED)

    def packed(self, room: int) -> Iterator[pa.RecordBatch]:
        """Rows of the sequences of what is held; the emptiest, up to room tokens, are held on."""
        bins = [[self.held[i] for i in b] for b in best_two_fit([p[3] for p in self.held], self.capacity)]
        short = []
        for n, b in sorted(((sum(p[3] for p in b), b) for b in bins), key=lambda x: x[0]):
            room -= n
            if n == self.capacity or room < 0:
                break
            short.append(b)
        skip, rows = {id(b) for b in short}, []
        for b in bins:
            if id(b) not in skip:
                at = 0
                for p in b:
                    rows.append((*p, self.sequence, at))
                    at += p[3]
                self.sequence += 1
        self.held = [p for b in short for p in b]
        self.tokens = sum(p[3] for p in self.held)
        yield from _rows(rows)

    def left(self) -> Iterator[pa.RecordBatch]:
        """Rows of what is held, without a place."""
        yield from _rows([(*p, None, None) for p in self.held])


def _rows(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    for k in range(0, len(rows), 4096):
        columns = zip(*rows[k : k + 4096], strict=True)
        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, _ARROW, strict=True)], schema=_ARROW)


def _first_sequence() -> int:
    context = TaskContext.get()
    return (context.partitionId() if context else 0) << 32


def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, block_tokens: int = BLOCK_TOKENS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids (little-endian unsigned 32 bit), sequence_id, offset."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path(f"{TOKENIZER}.json")
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer = encoder(tokenizer), Packer(capacity, block_tokens, _first_sequence())
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode(text.as_py() or "")
                ids.append(end_id)
                for k, (start, length) in enumerate(pieces_of(len(ids), capacity)):
                    yield from packer.add((doc, k, start, length, ids[start : start + length].tobytes()))
        yield from packer.packed(block_tokens // CARRIED)
        yield from packer.left()

    def run_again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(capacity, block_tokens, _AGAIN + _first_sequence())
        for batch in batches:
            for piece in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                yield from packer.add(piece)
        yield from packer.packed(0)

    given = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("content"))
    first = materialize(given.mapInArrow(run, SCHEMA), "packed")
    left = first.filter("sequence_id is null")
    waiting = left.agg(F.sum("length")).first()[0] or 0
    again = left.select("doc_id", "piece", "start", "length", "ids").repartition(waiting // block_tokens + 1).mapInArrow(run_again, SCHEMA)
    return first.filter("sequence_id is not null").union(again)
