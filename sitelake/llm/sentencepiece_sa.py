"""SentencePiece encoding and decoding with a suffix array over the text of a batch.

The text of a batch, one copy of each different unit, is concatenated and its
suffixes are sorted. Every piece of the vocabulary is binary-searched for the range of suffixes
that it begins: its occurrences. Each is an edge from where it starts to where it
ends; edges are sorted by position and relaxed from left to right.

The model is a byte-pair model: merges in order of score, leftmost first. There each prefix
of a text has one encoding, and its last piece is the one that ends there, is itself stable, and
is *compatible* with the last piece at its start: merging the characters of the two
together gives just these two. So relaxing an edge is one test against the piece that ends
where it starts, and at most one edge into a position holds. A byte of a character that is in no piece
is an edge of its byte piece, which fits beside any other.

Two pieces are compatible if no merge crosses their border: from the two backwards in order of
score, the piece made last is divided into the parts that it was merged from, and whenever the two parts at the border
make a piece, that must come later than the merges that use them up. This is done for all edges
that end at one offset of their units at once, in numpy; offsets that only few units reach go edge by edge.

Units are runs of spaces with the word that follows, and line feeds; no piece of the
model spans two of them (which is verified when it is loaded), so the encoding of a text is
that of its units in order. Units that begin with several spaces are merged directly, by a heap: the
model gives its space runs one and the same score, for which the rule above is not proven.

Results equal the sentencepiece library's, in encoding and decoding (tested).

Defined results: a null or empty text has no pieces, and decodes to the empty text.
Null ids and repeated rows are encoded like any other; an empty table gives no rows. Any
id sequence decodes; each byte that isn't part of UTF-8 becomes U+FFFD. Only the named columns are read.
"""

from __future__ import annotations

import codecs
import heapq
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelake.runtime import ship

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
REMEMBERED, PAIR_BITS, BATCH_BYTES = 400_000, 20, 1 << 19
PART_BYTES = 1 << 22  # of texts at once, or one longer text
LONG_UNIT = 64  # longer units are not remembered
FEW = 48  # edges at an offset that are relaxed one by one
_BREAK = b"\xf8"  # in no UTF-8 text
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
_UNIT = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+$")
_loaded: dict[str, "Pieces"] = {}
codecs.register_error("sentencepiece_bytes", lambda e: ("\ufffd" * (e.end - e.start), e.end))


class Pieces:
    """The vocabulary of a model file."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        n = m.get_piece_size()
        plain = [i for i in range(n) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))]
        self.text = [m.id_to_piece(i) for i in range(n)]
        self.id = {self.text[i]: i for i in plain}
        self.score = {self.text[i]: m.get_score(i) for i in plain}
        self.byte_id = {int(self.text[i][3:5], 16): i for i in range(n) if m.is_byte(i)}
        if any(SPACE in p[1:] and p.strip(SPACE) or "\n" in p for p in self.id) or any(c not in self.id for p in self.id for c in p):
            raise ValueError("a piece spans units, or holds a character that is no piece")
        self.byte_of = [b""] * n
        for i in plain:
            self.byte_of[i] = self.text[i].replace(SPACE, " ").encode()
        for b, i in self.byte_id.items():
            self.byte_of[i] = bytes([b])
        made = {q: self.merge(q) for q in self.id if not q.startswith(SPACE * 2)}
        searched = sorted((q.encode(), self.id[q]) for q, (parts, _) in made.items() if len(parts) == 1)
        self.searched = np.array([q for q, _ in searched])
        self.searched_id = np.array([i for _, i in searched], np.int64)
        self.searched_len = np.array([len(q) for q, _ in searched], np.int64)
        self.window = int(self.searched_len.max()) + 1
        self.after = np.array([q + b"\xff" for q, _ in searched])
        self.single = np.array([len(t) == 1 for t in self.text])
        self.bytes = np.zeros(n, bool)
        self.bytes[list(self.byte_id.values())] = True
        self.byte_ids = np.array([self.byte_id.get(b, 0) for b in range(256)])
        # rank: the order of merges; the parts that a piece was merged from
        whole = [i for i in self.searched_id.tolist() if len(self.text[i]) > 1]
        scores = np.unique([-x for x in self.score.values()])
        self.rank = np.full(n + 1, -1, np.int64)
        self.rank[whole] = np.searchsorted(scores, [-self.score[self.text[i]] for i in whole])
        self.left, self.right = np.full(n, n), np.full(n, n)
        for i in whole:
            x, y = (self.id[q] for q in made[self.text[i]][1])
            self.left[i], self.right[i] = x, y
        if len(np.unique(self.rank[whole])) < len(whole) or (np.maximum(self.rank[self.left[whole]], self.rank[self.right[whole]]) >= self.rank[whole]).any():
            raise ValueError("pieces share a score, or come before their parts")
        two = [(self.id[q[:k]] << 20 | self.id[q[k:]], self.score[q]) for q in self.id for k in range(1, len(q)) if q[:k] in self.id and q[k:] in self.id]
        two.sort()
        self.pairs = np.array([k for k, _ in two], np.int64)
        self.pair_rank = np.searchsorted(scores, [-x for _, x in two])
        self.known, self.known_fit = np.full(1 << PAIR_BITS, -1), np.zeros(1 << PAIR_BITS, bool)
        self.units: dict[str, bytes] = {}

    def merge(self, text: str) -> tuple[list[str], tuple[str, str] | None]:
        """Byte-pair merging of one string, the best score first, then the leftmost; also the last two parts merged."""
        n = len(text)
        part, after, before, final = [*text, ""], list(range(1, n + 2)), list(range(-1, n)), None
        heap = [(-self.score[text[k : k + 2]], k, text[k : k + 2], k + 1) for k in range(n - 1) if text[k : k + 2] in self.score]
        heapq.heapify(heap)
        while heap:
            _, k, both, j = heapq.heappop(heap)
            if not part[k] or after[k] != j or part[k] + part[j] != both:
                continue  # used up since
            final = part[k], part[j]
            part[k], part[j] = both, ""
            after[k] = j = after[j]
            if j < n:
                before[j] = k
            for x, y in ((before[k], k), (k, j)):
                if x >= 0 and y < n and (both := part[x] + part[y]) in self.score:
                    heapq.heappush(heap, (-self.score[both], x, both, y))
        return [q for q in part if q], final

    def fit(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether no merge crosses the border of pieces a and b."""
        out, late = np.ones(len(a), bool), np.iinfo(np.int64).max
        at, x, y = np.arange(len(a)), a.copy(), b.copy()
        use_x, use_y = np.full(len(a), late), np.full(len(a), late)  # when a merge uses x up, and y
        while len(at):
            key = x << 20 | y
            found = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
            rank = np.where(self.pairs[found] == key, self.pair_rank[found], late)
            crossed = (rank < use_x) & ((rank < use_y) | ((rank == use_y) & (rank < late)))
            out[at[crossed]] = False
            rx, ry = self.rank[x], self.rank[y]
            go = ~crossed & ((rx >= 0) | (ry >= 0))
            at, x, y, use_x, use_y, rx, ry = (c[go] for c in (at, x, y, use_x, use_y, rx, ry))
            first = rx > ry
            use_x, use_y = np.where(first, rx, use_x), np.where(first, use_y, ry)
            x, y = np.where(first, self.right[x], x), np.where(first, y, self.left[y])
        return out

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """fit, remembered, a pair in the place that its hash gives; a is -2 where nothing is before b."""
        out = (a < 0) | self.bytes[a] | self.bytes[b]
        ask = np.flatnonzero(~out)
        key = a[ask] << 20 | b[ask]
        place = (key.astype(np.uint64) * _SPREAD) >> np.uint64(64 - PAIR_BITS)
        out[ask] = self.known_fit[place]
        new = np.flatnonzero(self.known[place] != key)
        if len(new):
            keys, first, where = np.unique(key[new], return_index=True, return_inverse=True)
            fits = self.fit(keys >> 20, keys & ((1 << 20) - 1))
            out[ask[new]] = fits[where]
            place = place[new[first]]
            _, once = np.unique(place, return_index=True)  # of pairs that share a place, one is remembered
            self.known[place[once]], self.known_fit[place[once]] = keys[once], fits[once]
        return out

    def ids_of(self, parts: list[str]) -> list[int]:
        return [i for p in parts for i in ([self.id[p]] if p in self.id else map(self.byte_id.__getitem__, p.encode("utf-8", "surrogatepass")))]


def pieces(path: str) -> Pieces:
    if path not in _loaded:
        _loaded[path] = Pieces(path)
    return _loaded[path]


def suffix_order(p: Pieces, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The starts of the suffixes in order, and the first bytes of each.

    Sorted by the first eight bytes as one number; only suffixes that are alike there and don't end there are
    sorted further. What comes after a break is in no order, as no piece reaches it.
    """
    words = -(-p.window // 8)
    padded = np.concatenate([text, np.frombuffer(_BREAK * (8 * words), np.uint8)])
    windows = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, 8 * words)[: len(text)])
    part = windows.view(">u8")
    head = part[:, 0].astype(np.uint64)
    suffixes = np.argsort(head)
    ordered = head[suffixes]
    alike = np.concatenate([[False], ordered[1:] == ordered[:-1]])
    # how far the next break is: beyond the first eight bytes
    stops = np.append(np.flatnonzero(text == _BREAK[0]), len(text) + 8)
    far = (stops[np.searchsorted(stops, np.arange(len(text)))] - np.arange(len(text)) >= 8)[suffixes]
    again = np.flatnonzero((alike | np.append(alike[1:], False)) & far)
    rest = suffixes[again]
    suffixes[again] = rest[np.lexsort([*(part[rest, k] for k in range(words - 1, 0, -1)), ordered[again]])]
    return suffixes, windows.view(f"S{8 * words}").ravel()[suffixes]


def occurrences(p: Pieces, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, piece) of every occurrence of every piece."""
    suffixes, ordered = suffix_order(p, text)
    lo, hi = np.searchsorted(ordered, p.searched, "left"), np.searchsorted(ordered, p.after, "left")
    n = hi - lo
    at = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
    start = suffixes[at]
    end = start + np.repeat(p.searched_len, n)
    return start, end, np.repeat(p.searched_id, n)


def encode_units(p: Pieces, units: list[str]) -> dict[str, bytes]:
    """The ids of every unit."""
    out, data = {}, []
    for u in units:
        if u.startswith(SPACE * 2):
            out[u] = array("I", p.ids_of(p.merge(u)[0])).tobytes()
        else:
            data.append((u, u.encode("utf-8", "surrogatepass")))
    at = 0
    while at < len(data):
        part, size = [], 0
        while at < len(data) and (not part or size < BATCH_BYTES):
            part.append(data[at])
            size += len(data[at][1]) + 1
            at += 1
        out.update(zip((u for u, _ in part), relax(p, [d for _, d in part]), strict=True))
    return out


def relax(p: Pieces, data: list[bytes]) -> list[bytes]:
    """The ids of each unit: edges of all units together, by where they end in their unit."""
    text = np.frombuffer(_BREAK.join([*data, b""]), np.uint8)
    start, end, piece = occurrences(p, text)
    covered = np.zeros(len(text) + 1, bool)
    covered[start[p.single[piece]]] = True
    loose = _bytes_outside(text, covered)
    start, end, piece = np.concatenate([start, loose]), np.concatenate([end, loose + 1]), np.concatenate([piece, p.byte_ids[text[loose]]])
    size = np.array([len(d) + 1 for d in data])
    begin = np.cumsum(size) - size
    offset = end - np.repeat(begin, size)[start]
    order = np.argsort(offset.astype(np.uint16) if size.max() < 1 << 16 else offset, kind="stable")
    start, end, piece = start[order], end[order], piece[order]
    # last[k]: the piece that ends at k; back[k]: where it starts; -1: not reached; -2: the start of a unit
    last, back = np.full(len(text) + 1, -1), np.zeros(len(text) + 1, np.int64)
    last[begin] = -2
    steps, k = np.bincount(offset), 0
    many = np.flatnonzero(steps >= FEW)
    for stop in np.cumsum(steps)[: many[-1] + 1 if len(many) else 0].tolist():
        if stop == k:
            continue
        now = slice(k, stop)
        k = stop
        before = last[start[now]]
        reached = np.flatnonzero(before != -1)
        ok = reached[p.compatible(before[reached], piece[now][reached])]
        last[end[now][ok]], back[end[now][ok]] = piece[now][ok], start[now][ok]
    if k < len(start):
        remembered: dict[int, bool] = {}
        for s, e, i in zip(start[k:].tolist(), end[k:].tolist(), piece[k:].tolist(), strict=True):
            if last[e] == -1 and (before := int(last[s])) != -1:  # one edge into a position holds, so the others needn't be tried
                key = before << 20 | i
                if before == -2:
                    ok = True
                elif (ok := remembered.get(key)) is None:
                    ok = remembered[key] = bool(p.bytes[before] or p.bytes[i]) or p.merge(p.text[before] + p.text[i])[0] == [p.text[before], p.text[i]]
                if ok:
                    last[e], back[e] = i, s
    # from the ends back to the starts, all units at once
    at, ends = [], begin + size - 1
    while len(ends := ends[last[ends] != -2]):
        at.append(ends)
        ends = back[ends]
    at = np.sort(np.concatenate(at)) if at else np.zeros(0, np.int64)
    ids = last[at].astype("<u4").tobytes()
    edges = (4 * np.searchsorted(at, np.append(begin, len(text)), "right")).tolist()
    return [ids[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]


def _bytes_outside(text: np.ndarray, covered: np.ndarray) -> np.ndarray:
    """Where the bytes are of characters that are no piece."""
    heads = np.flatnonzero(((text & 0xC0) != 0x80) & (text != _BREAK[0]))
    lone = heads[~covered[heads]]
    size = np.select([text[lone] < 0x80, text[lone] < 0xE0, text[lone] < 0xF0], [1, 2, 3], 4)
    return np.repeat(lone - (np.cumsum(size) - size), size) + np.arange(size.sum())


def units_of(text: str) -> list[str]:
    """The units of a text, spaces marked, with the space that the model puts in front."""
    if not text:
        return []
    marked = SPACE + text.replace(" ", SPACE)
    lines = marked.split("\n")
    if SPACE * 2 not in marked and len(lines) == 1 and not marked.endswith(SPACE):
        return [SPACE + w for w in marked[1:].split(SPACE)]
    out: list[str] = []
    for k, line in enumerate(lines):
        if k:
            out.append("\n")
        out += _UNIT.findall(line)
    return out


def split_units(texts: pa.ChunkedArray | pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The different units of some texts, which of them comes where, and where each text ends among these.

    Spaces become marks with a border before them and line feeds get borders on both sides, so one split at the borders
    gives the units (and empty strings, which have no ids). Only texts in which marks would meet take units_of.
    """
    given = pc.fill_null(texts.cast(pa.large_string()), "")
    given = given.combine_chunks() if isinstance(given, pa.ChunkedArray) else given
    odd = pc.or_(pc.match_substring_regex(given, f"^ |  |{SPACE}"), pc.equal(given, "")).to_numpy(zero_copy_only=False)
    mark, none = pa.scalar(SPACE, pa.large_string()), pa.scalar("", pa.large_string())
    marked = pc.binary_join_element_wise(mark, pc.replace_substring(pc.replace_substring(given, " ", " " + SPACE), "\n", " \n "), none)
    cut = pc.split_pattern(pc.if_else(pa.array(odd), none, marked), " ")
    count = pc.list_value_length(cut).to_numpy().astype(np.int64)
    words = cut.flatten()
    if odd.any():
        of = [units_of(t) for t in given.filter(pa.array(odd)).to_pylist()]
        fine, each = words.filter(pa.array(np.repeat(~odd, count))), np.array([len(u) for u in of], np.int64)
        # both kinds side by side, taken in the order of the texts
        count[odd] = each
        kind = np.repeat(odd, count)
        place = np.where(kind, len(fine) + np.cumsum(kind) - 1, np.cumsum(~kind) - 1)
        words = pa.concat_arrays([fine, pa.array([u for s in of for u in s], pa.large_string())])
        coded = words.dictionary_encode()
        which = coded.indices.to_numpy()[place]
    else:
        coded = words.dictionary_encode()
        which = coded.indices.to_numpy()
    return coded.dictionary, which, np.cumsum(count)


def encode_texts(p: Pieces, texts: list[str | None] | pa.Array) -> list[bytes]:
    """Ids of each text, little-endian unsigned 32 bit."""
    different, which, ends = split_units(pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts)
    units = different.to_numpy(zero_copy_only=False).tolist()
    if len(p.units) > REMEMBERED:
        for u in list(p.units)[REMEMBERED // 2 :]:  # the common units came first
            del p.units[u]
    of = list(map(p.units.get, units))
    new = [i for i, known in enumerate(of) if known is None]
    found = encode_units(p, [units[i] for i in new])
    for i in new:
        of[i] = found[units[i]]
    p.units.update((u, ids) for u, ids in found.items() if len(u) <= LONG_UNIT)
    # the ids of the units one after another, then gathered for the texts
    ids = np.frombuffer(b"".join(of), "<u4")
    size = np.fromiter(map(len, of), np.int64, len(of)) // 4
    begin, each = np.cumsum(size) - size, size[which]
    upto = np.cumsum(each)
    made = ids[np.repeat(begin[which] - (upto - each), each) + np.arange(upto[-1] if len(upto) else 0)].tobytes()
    edges = (4 * np.concatenate([[0], upto])[np.concatenate([[0], ends])]).tolist()
    return [made[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]


def decode_ids(p: Pieces, ids: bytes | None) -> str:
    text = b"".join(map(p.byte_of.__getitem__, array("I", ids or b""))).decode("utf-8", "sentencepiece_bytes")
    return text.removeprefix(" ")


def parts_of(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in order, parted where the texts (its second column) would pass PART_BYTES."""
    size = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    upto, at = np.cumsum(size), 0
    while at < len(size):
        stop = max(at + 1, int(np.searchsorted(upto, upto[at] - size[at] + PART_BYTES, "right")))
        yield batch.slice(at, stop - at)
        at = stop


def _path(model: str | None) -> str:
    if model is None:
        import public_tokenizers

        return public_tokenizers.path(MODEL)
    return model


def encode_documents(docs: DataFrame, model: str | None = None, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """doc_id, content, ids (little-endian unsigned 32 bit); with decoded, also what the ids decode to, in the same pass."""
    ship(docs.sparkSession)
    path = _path(model)
    names = ["doc_id", "content", "ids", *["decoded"] * decoded]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(path)
        for batch in batches:
            for part in parts_of(batch):
                ids = encode_texts(p, part.column(1))
                back = [pa.array([decode_ids(p, x) for x in ids], pa.string())] if decoded else []
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(ids, pa.binary()), *back], names)

    given = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("content"))
    return given.mapInArrow(run, "doc_id long, content string, ids binary" + ", decoded string" * decoded)


def decode_documents(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """encoded with a column decoded for its ids; the other columns stay as they are (a column of that name is replaced)."""
    ship(encoded.sparkSession)
    path = _path(model)
    kept = [c for c in encoded.columns if c != "decoded"]
    given = encoded.select(encoded["ids"].alias("packed"), F.struct(*[encoded[c].alias(f"c{i}") for i, c in enumerate(kept)]).alias("row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(path)
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                yield pa.RecordBatch.from_arrays([part.column(1), pa.array([decode_ids(p, x) for x in part.column(0).to_pylist()], pa.string())], ["row", "decoded"])

    made = given.mapInArrow(run, f"row {given.schema['row'].dataType.simpleString()}, decoded string")
    return made.select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(kept)], "decoded")
