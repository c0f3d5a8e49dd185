"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie.

A vocabulary file gives pieces with log scores. The best segmentation of a text
is found by dynamic programming over a double-array trie of the pieces' bytes;
a character without a piece falls back to the pieces of its bytes. The
white-space marker stands for a space in the trie, so a marker character that is
in the text itself falls back to bytes too and every text decodes to itself.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tomeweave.llm.base import pieces, text_bytes
from tomeweave.session import ship_package

MARKER = "▁"
UNKNOWN_PENALTY = 10.0  # below the lowest piece, as in the public unigram model
PIECE_BYTES = 1 << 20
MAX_CACHED = 100_000  # segmented words a task remembers at a time
LONG_WORD = 96  # bytes; longer words are segmented one by one
BATCH_WORDS = 8_192
SCAN = 4_096  # places looked at together when the trie is laid out
NORMAL, UNKNOWN, CONTROL, BYTE = range(4)


class DoubleArray:
    """A trie in two arrays: from state s, byte c leads to ``base[s] + c`` if ``check`` there is s."""

    def __init__(self, keys: dict[bytes, int]):
        children: list[dict[int, int]] = [{}]
        ends: dict[int, int] = {}
        for key, value in sorted(keys.items()):
            node = 0
            for c in key:
                if c not in children[node]:
                    children[node][c] = len(children)
                    children.append({})
                node = children[node][c]
            ends[node] = value
        size = 4 * len(children) + 3 * SCAN
        self.base = np.zeros(size, np.int64)
        self.check = np.full(size, -1, np.int64)
        self.value = np.full(size, -1, np.int64)
        used = np.zeros(size, bool)
        used[0] = True
        first_free = 1
        waiting = [(0, 0)]
        for node, state in waiting:  # grows while it runs: breadth first
            if node in ends:
                self.value[state] = ends[node]
            codes = sorted(children[node])
            if not codes:
                continue
            while used[first_free]:
                first_free += 1
            at = max(1, first_free - codes[0])
            while True:  # the first place from which all children are free, a stretch at a time
                if at + SCAN + 256 > len(used):
                    more = len(used)
                    used = np.append(used, np.zeros(more, bool))
                    self.base = np.append(self.base, np.zeros(more, np.int64))
                    self.check = np.append(self.check, np.full(more, -1))
                    self.value = np.append(self.value, np.full(more, -1))
                taken = used[at + codes[0] : at + codes[0] + SCAN].copy()
                for c in codes[1:]:
                    taken |= used[at + c : at + c + SCAN]
                spot = int(taken.argmin())
                if not taken[spot]:
                    at += spot
                    break
                at += SCAN
            self.base[state] = at
            for c in codes:
                used[at + c] = True
                self.check[at + c] = state
                waiting.append((children[node][c], at + c))
        last = int(np.flatnonzero(used)[-1]) + 1
        self.base, self.check, self.value = self.base[:last], self.check[:last], self.value[:last]
        # Any state can be followed by any byte without leaving the arrays.
        self.check = np.append(self.check, np.full(512, -1))
        self.value = np.append(self.value, np.full(512, -1))
        self.depth = max(map(len, keys), default=0)

    def prefixes(self, text: bytes, at: int) -> Iterator[tuple[int, int]]:
        """(end, value) of all keys that begin at ``at``, shorter ones first."""
        state = 0
        for k in range(at, len(text)):
            follow = int(self.base[state]) + text[k]
            if self.check[follow] != state:
                return
            state = follow
            if self.value[state] >= 0:
                yield k + 1, int(self.value[state])


@dataclass
class Vocabulary:
    """Pieces (with spaces for the marker), their log scores and kinds, and the trie of the normal ones."""

    texts: list[bytes]
    scores: np.ndarray
    kinds: list[int]

    def __post_init__(self) -> None:
        normal = {t: k for k, t in enumerate(self.texts) if self.kinds[k] == NORMAL and t}
        self.trie = DoubleArray(normal)
        used = self.scores[sorted(normal.values())]
        self.unknown_score = float(used.min() if len(used) else 0.0) - UNKNOWN_PENALTY
        self.byte_ids = np.full(256, -1, np.int64)
        for k, kind in enumerate(self.kinds):
            if kind == BYTE:
                self.byte_ids[self.texts[k][0]] = k
        if (self.byte_ids < 0).any():
            raise ValueError("the vocabulary has no pieces for some bytes")
        several = [t.decode() for t in normal if len(t.decode()) > 1]
        inside = {c for t in several for c in t}
        # Where no piece reaches across, a text may be cut, and each part is segmented by itself.
        if any(re.search("[^ ] ", t) for t in several):
            self.cuts = re.compile("(?s).+")
        elif "\n" in inside:
            self.cuts = re.compile("(?s) *[^ ]+| +")
        else:
            self.cuts = re.compile("(?s) *[^ \n]+| +|\n")


    def encoder(self) -> Encoder:
        """One for every Python worker, so what it has learnt serves all its tasks."""
        self._encoder = getattr(self, "_encoder", None) or Encoder(self)
        return self._encoder


def rank_scores(scores: list[float]) -> np.ndarray:
    """Log scores for a vocabulary that only ranks its pieces (merge order): Zipf's law over the ranks."""
    order = np.lexsort((np.arange(len(scores)), -np.asarray(scores)))
    rank = np.empty(len(scores))
    rank[order] = np.arange(1, len(scores) + 1)
    return -np.log(rank) - math.log(sum(1 / r for r in range(1, len(scores) + 1)))


def load(path: str, log_scores: bool = False) -> Vocabulary:
    """Read a model file. ``log_scores``: its scores are log probabilities; else they are ranks."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    kinds = [
        BYTE if model.is_byte(k) else UNKNOWN if model.is_unknown(k) else CONTROL if model.is_control(k) or model.is_unused(k) else NORMAL
        for k in range(n)
    ]
    names = [model.id_to_piece(k) for k in range(n)]
    texts = [
        bytes([int(t[3:-1], 16)]) if kind == BYTE else t.replace(MARKER, " ").encode() if kind == NORMAL else b""
        for t, kind in zip(names, kinds, strict=True)
    ]
    scores = [model.get_score(k) for k in range(n)]
    if log_scores:
        return Vocabulary(texts, np.asarray(scores), kinds)
    normal = [k for k in range(n) if kinds[k] == NORMAL]
    out = np.zeros(n)
    out[normal] = rank_scores([scores[k] for k in normal])
    return Vocabulary(texts, out, kinds)


# ------------------------------------------------------------------ encoding
def char_bytes(lead: int) -> int:
    return 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4


def segment_one(text: bytes, vocab: Vocabulary) -> list[int]:
    """The best segmentation of one word; of equal ones, that whose last pieces are longer."""
    n = len(text)
    best: list[float] = [0.0] + [-math.inf] * n
    back: list[tuple[int, int]] = [(0, 0)] * (n + 1)
    for at in range(n):
        if best[at] == -math.inf:
            continue
        step = char_bytes(text[at])
        single = False
        for end, piece in vocab.trie.prefixes(text, at):
            single |= end - at == step
            score = best[at] + vocab.scores[piece]
            if score > best[end]:
                best[end], back[end] = score, (at, piece)
        if not single and best[at] + vocab.unknown_score > best[at + step]:
            best[at + step], back[at + step] = best[at] + vocab.unknown_score, (at, -1)
    out: list[int] = []
    while n:
        at, piece = back[n]
        out += [piece] if piece >= 0 else [int(vocab.byte_ids[c]) for c in reversed(text[at:n])]
        n = at
    return out[::-1]


def segment_words(words: list[bytes], vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """(counts, ids) of many words at once: the same programme with the words side by side."""
    trie, n = vocab.trie, len(words)
    length = np.fromiter(map(len, words), np.int64, n)
    flat = np.frombuffer(b"".join(words) + bytes(8), np.uint8).astype(np.int64)
    start = np.concatenate([[0], np.cumsum(length)])[:-1]
    width = int(length.max())
    best = np.full((n, width + 1), -np.inf)
    best[:, 0] = 0
    back = np.zeros((n, width + 1), np.int64)
    piece_of = np.full((n, width + 1), -1, np.int64)
    for at in range(width):
        live = np.flatnonzero((length > at) & (best[:, at] > -np.inf))
        lead = flat[start[live] + at]
        step = 1 + (lead >= 0xC0) + (lead >= 0xE0) + (lead >= 0xF0)
        single = np.zeros(n, bool)
        step_of = np.zeros(n, np.int64)
        step_of[live] = step
        rows, state = live, np.zeros(len(live), np.int64)
        for depth in range(1, trie.depth + 1):
            inside = length[rows] >= at + depth
            rows, state = rows[inside], state[inside]
            follow = trie.base[state] + flat[start[rows] + at + depth - 1]
            ok = trie.check[follow] == state
            rows, state = rows[ok], follow[ok]
            if not len(rows):
                break
            piece = trie.value[state]
            ends = piece >= 0
            r, p = rows[ends], piece[ends]
            single[r[step_of[r] == depth]] = True
            score = best[r, at] + vocab.scores[p]
            better = score > best[r, at + depth]
            r, p = r[better], p[better]
            best[r, at + depth], back[r, at + depth], piece_of[r, at + depth] = score[better], at, p
        rest = live[~single[live]]
        if len(rest):
            end = at + step_of[rest]
            score = best[rest, at] + vocab.unknown_score
            better = score > best[rest, end]
            rest, end = rest[better], end[better]
            best[rest, end], back[rest, end], piece_of[rest, end] = score[better], at, -1
    # Walk back, all words at once. A fallback character gives its bytes, last one first.
    columns = []
    place, left = length.copy(), np.zeros(n, np.int64)
    while (live := np.flatnonzero(place > 0)).size:
        column = np.full(n, -1, np.int64)
        piece = piece_of[live, place[live]]
        plain = live[piece >= 0]
        column[plain] = piece[piece >= 0]
        place[plain] = back[plain, place[plain]]
        other = live[piece < 0]
        if len(other):
            began = back[other, place[other]]
            column[other] = vocab.byte_ids[flat[start[other] + place[other] - 1 - left[other]]]
            left[other] += 1
            done = place[other] - left[other] == began
            left[other[done]] = 0
            place[other[done]] = began[done]
        columns.append(column)
    table = np.stack(columns[::-1], 1) if columns else np.zeros((n, 0), np.int64)
    real = table >= 0
    return real.sum(1), table[real]


class Encoder:
    """Segments words once and remembers them, up to ``MAX_CACHED`` of them."""

    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.counts = np.zeros(0, np.int64)
        self.starts = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.int32)

    def _learn(self, words: list[str]) -> None:
        raw = [w.encode() for w in words]
        order = sorted(range(len(raw)), key=lambda k: len(raw[k]))
        counts = np.zeros(len(raw), np.int64)
        found: list[np.ndarray] = []
        for k in range(0, len(order), BATCH_WORDS):
            rows = order[k : k + BATCH_WORDS]
            short = [r for r in rows if len(raw[r]) <= LONG_WORD]
            if short:
                counts[short], ids = segment_words([raw[r] for r in short], self.vocab)
                found.append(ids)
            for r in rows[len(short) :]:
                ids = segment_one(raw[r], self.vocab)
                counts[r] = len(ids)
                found.append(np.asarray(ids))
        starts = np.empty(len(raw), np.int64)
        starts[order] = np.concatenate([[0], np.cumsum(counts[order])[:-1]]) + len(self.ids)
        for w in words:
            self.known[w] = len(self.known)
        self.counts = np.concatenate([self.counts, counts])
        self.starts = np.concatenate([self.starts, starts])
        self.ids = np.concatenate([self.ids, *found]).astype(np.int32)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(pieces per text, all piece ids)."""
        split = [self.vocab.cuts.findall(" " + t) if t else [] for t in texts]
        words = [*chain.from_iterable(split)]
        rows = [*map(self.known.get, words)]
        if None in rows:
            fresh = dict.fromkeys(w for w, row in zip(words, rows, strict=True) if row is None)
            if len(self.known) + len(fresh) > MAX_CACHED and self.known:
                self.clear()
                fresh = dict.fromkeys(words)
            self._learn([*fresh])
            rows = [*map(self.known.__getitem__, words)]
        sizes = np.fromiter(map(len, split), np.int64, len(split))
        rows = np.array(rows, np.int64)
        counts = self.counts[rows]
        ends = np.cumsum(counts)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.ids[np.repeat(self.starts[rows] - ends + counts, counts) + np.arange(total)]
        upto = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(sizes)])]
        return np.diff(upto), ids


def encode(
    docs: DataFrame, vocab: Vocabulary, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (),
) -> DataFrame:
    """(doc_id, *keep, ids array<int>) for every row; a null or empty text has no pieces. Repeated rows repeat."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(vocab)
    ship_package(spark)
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("_text"), *keep)
    names = ["doc_id", *keep]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in names) + ", ids array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared.value.encoder()
        for batch in batches:
            ends, raw = text_bytes(batch.column(1))
            for first, last in pieces(ends, PIECE_BYTES):
                texts = [raw[ends[k] : ends[k + 1]].tobytes().decode() for k in range(first, last)]
                counts, ids = encoder.encode(texts)
                offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                part = batch.slice(first, last - first)
                columns = [part.column(0), *[part.column(2 + k) for k in range(len(keep))]]
                yield pa.record_batch([*columns, pa.ListArray.from_arrays(offsets, pa.array(ids))], [*names, "ids"])

    return rows.mapInArrow(run, schema)


def decode(encoded: DataFrame, vocab: Vocabulary) -> DataFrame:
    """``encoded`` with the column ``decoded``: bytes of the pieces end to end, without the leading space.

    Ids outside the vocabulary and control pieces stand for nothing; bytes that
    are not UTF-8 become the replacement character. Null ids give a null.
    """
    shared = encoded.sparkSession.sparkContext.broadcast(vocab.texts)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema) + ", decoded string"
    place = encoded.columns.index("ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = [*shared.value, b""]  # the last stands for ids outside
        width = np.array([*map(len, table)])
        begin = np.cumsum(width) - width
        joined = np.frombuffer(b"".join(table), np.uint8)
        for batch in batches:
            ids = batch.column(place)
            ends, valid = ids.offsets.to_numpy(), ids.is_valid().to_pylist()
            for first, last in pieces(ends, PIECE_BYTES // 8):
                flat = ids.values[int(ends[first]) : int(ends[last])].fill_null(-1).to_numpy(zero_copy_only=False)
                flat = np.where((flat >= 0) & (flat < len(table)), flat, len(table) - 1)
                size = width[flat]
                upto = np.concatenate([[0], np.cumsum(size)])
                data = joined[np.repeat(begin[flat] - upto[:-1], size) + np.arange(upto[-1])].tobytes()
                cuts = upto[ends[first : last + 1] - ends[first]].tolist()
                texts = [
                    data[a:b].removeprefix(b" ").decode(errors="replace") if valid[first + k] else None
                    for k, (a, b) in enumerate(zip(cuts, cuts[1:]))  # noqa: B905 - the second is one shorter
                ]
                part = batch.slice(first, last - first)
                yield pa.record_batch([*part.columns, pa.array(texts, pa.string())], [*batch.schema.names, "decoded"])

    return encoded.mapInArrow(run, schema)
