"""Cross-tokenizer alignment with an associative fragment monoid.

A text is encoded twice, and the byte offsets where a token of both encodings
ends cut it into groups. What a byte range of the text shows of this is a
fragment: the token ids in order, and how many of them each group takes, where
the first group (the open prefix) may have begun before the range and the last
one (the open suffix) may end after it; those between are closed. Two fragments
compose by concatenation, the suffix of one and the prefix of the next becoming
one group. That is associative, so fragments of a very long text, made by many
tasks, are put together by a tree of reductions.

How many documents hold a pair of ids linked is counted over the corpus. Common
pairs, a bounded number of them, are looked up in every task; the long tail of
rare ones is joined.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tomeweave.llm.base import broadcast_counted, pieces, text_bytes
from tomeweave.scale import once
from tomeweave.session import cut_lineage, ship_package

CHUNK_BYTES = 65_536  # texts beyond it are encoded in byte ranges of this size, by many tasks
FAN_IN = 8  # fragments that one step of the tree composes
ENCODE_BYTES = 1 << 20  # of texts that a tokenizer gets at once
BLOCK_LINKS = 1 << 19  # links expanded at a time
HOT_PAIRS = 1 << 18  # most common pairs that every task may hold
ID_BITS = 20
ID_MASK = (1 << ID_BITS) - 1
GRADES = 8  # of a doubling of the count, for the threshold of hot pairs

Step = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]
FRAGMENT = "ok boolean, a array<int>, b array<int>, ga array<int>, gb array<int>"
_LISTS = pa.list_(pa.int32())

# Characters that count as white space beyond ASCII, in UTF-8.
_WIDE = (rb"\xc2\x85", rb"\xc2\xa0", rb"\xe1\x9a\x80", rb"\xe2\x80[\x80-\x8a\xa8\xa9\xaf]", rb"\xe2\x81\x9f", rb"\xe3\x80\x80")
# Fixed value: how byte-level tokenizers split a text before they merge.
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A single space between two other characters: both tokenizers begin a token there whatever stands around it.
CUT = re.compile(
    rb"(?<=[\x21-\x7e\x80-\xff])" + b"".join(b"(?<!" + w + b")" for w in _WIDE) + b" " + b"(?!" + b"|".join(_WIDE) + rb")(?=[\x21-\x7e\x80-\xff])"
)


# ------------------------------------------------------------------ fragments
@dataclass(frozen=True)
class Fragment:
    """Ids of a byte range and how many of them each group takes; the first and the last group are open.

    A range without a common token end is one open group. ``ok`` is false if the
    tokens' bytes are not those of the text.
    """

    a: np.ndarray
    b: np.ndarray
    ga: np.ndarray
    gb: np.ndarray
    ok: bool = True


_NONE, _ZERO = np.zeros(0, np.int32), np.zeros(1, np.int32)
EMPTY = Fragment(_NONE, _NONE, _ZERO, _ZERO)


def _touching(parts: Iterable[np.ndarray]) -> np.ndarray:
    """Concatenation in which the last number of one part and the first of the next are added."""
    out: list[np.ndarray] = []
    for part in parts:
        if out:
            out[-1] = out[-1].copy()
            out[-1][-1] += part[0]
            out.append(part[1:]) if len(part) > 1 else None
        else:
            out.append(part)
    return np.concatenate(out) if out else _ZERO


def compose(fragments: Iterable[Fragment]) -> Fragment:
    """The fragment of adjacent ranges; ``EMPTY`` of none."""
    parts = list(fragments) or [EMPTY]
    return Fragment(
        np.concatenate([p.a for p in parts]), np.concatenate([p.b for p in parts]),
        _touching(p.ga for p in parts), _touching(p.gb for p in parts), all(p.ok for p in parts),
    )


def fragment_of(a: np.ndarray, b: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray, ok: bool = True) -> Fragment:
    """From ids and rising token ends of a range."""
    if not len(a) or not len(b):
        return Fragment(a, b, np.array([len(a)], np.int32), np.array([len(b)], np.int32), ok)
    at = np.minimum(np.searchsorted(ends_b, ends_a), len(ends_b) - 1)
    both = ends_b[at] == ends_a
    last_a, last_b = np.flatnonzero(both), at[both]
    ga = np.diff(np.concatenate([[-1], last_a, [len(a) - 1]])).astype(np.int32)
    gb = np.diff(np.concatenate([[-1], last_b, [len(b) - 1]])).astype(np.int32)
    return Fragment(a, b, ga, gb, ok)


# ----------------------------------------------------------------- tokenizers
def _byte_letters() -> dict[str, int]:
    """The byte-level alphabet: printable characters stand for themselves, the others follow from 256 on."""
    shown = [c for c in range(256) if 33 <= c <= 126 or 161 <= c <= 172 or 174 <= c <= 255]
    return {chr(c): c for c in shown} | {chr(256 + k): c for k, c in enumerate(c for c in range(256) if c not in shown)}


def merges_follow_ids(byte_level: bytes) -> bool:
    """Whether merging by the lowest id of the result is the same as merging by the list of merges.

    It is if the merges' results have rising ids and every entry encodes to itself.
    A pair (x, y) that makes an entry z but is not in the list could tell the two
    apart only where x and y stand side by side; then z's own bytes would end there as
    well, and not as z, because what is inside does not depend on what is around.
    """
    from tokenizers import Tokenizer

    model = json.loads(byte_level)["model"]
    vocab, merges = model["vocab"], [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    results = [vocab[a + b] for a, b in merges]
    if any(a >= b for a, b in zip(results, results[1:], strict=False)) or model.get("ignore_merges") or model.get("dropout"):
        return False
    special = {t["content"] for t in json.loads(byte_level).get("added_tokens", [])}
    known = {z: k for z, k in vocab.items() if z not in special}
    words = Tokenizer.from_str(byte_level.decode()).model
    return {len(z) for z in known} >= {1} and all([t.id for t in words.tokenize(z)] == [k] for z, k in known.items())


class Pair:
    """Both tokenizers with the bytes of every id.

    ``by_id`` (see ``merges_follow_ids``) lets a quicker library do the first
    tokenizer's merges; the ids are the same.
    """

    def __init__(self, byte_level: bytes, sentence_pieces: bytes, by_id: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        file = json.loads(byte_level)
        steps = file["pre_tokenizer"]
        if steps.get("type") != "ByteLevel" or not steps.get("use_regex", True) or steps.get("add_prefix_space") or file.get("normalizer"):
            raise ValueError("the first tokenizer must be byte-level, with words split by its pattern and nothing else done to a text")
        letters, special = _byte_letters(), {t["content"] for t in file.get("added_tokens", [])}
        vocab = file["model"]["vocab"]
        self.raw_a = [b""] * (max([*vocab.values(), *(t["id"] for t in file.get("added_tokens", []))]) + 1)
        for token, k in vocab.items():
            self.raw_a[k] = token.encode() if token in special else bytes(letters[c] for c in token)
        if by_id:
            ranks = {self.raw_a[k]: k for token, k in vocab.items() if token not in special}
            coder = tiktoken.Encoding("byte-level", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})
            self.encode_a = lambda texts: [coder.encode_ordinary(t) for t in texts]
        else:
            plain = Tokenizer.from_str(byte_level.decode())
            plain.encode_special_tokens = True
            self.encode_a = lambda texts: [e.ids for e in plain.encode_batch_fast(texts, add_special_tokens=False)]
        self.b = sentencepiece.SentencePieceProcessor(model_proto=sentence_pieces)
        names = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        if any(re.search("[^▁]▁", n) for n in names):
            raise ValueError("a piece spans a space between words, so texts cannot be cut there")
        self.raw_b = [bytes([int(n[3:5], 16)]) if self.b.is_byte(k) else n.replace("▁", " ").encode() for k, n in enumerate(names)]
        if max(len(self.raw_a), len(self.raw_b)) > ID_MASK:
            raise ValueError(f"vocabularies of more than {ID_MASK} entries")
        self.length_a = np.array([len(r) for r in self.raw_a], np.int64)
        self.length_b = np.array([len(r) for r in self.raw_b], np.int64)

    def encode(self, texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
        """(ids, ids, whether both give back the bytes) of texts that each begin with a space."""
        strings = [t.decode() for t in texts]
        first, second = self.encode_a(strings), self.b.encode([s[1:] for s in strings], num_threads=1)
        for text, a, b in zip(texts, first, second, strict=True):
            ok = b"".join(map(self.raw_a.__getitem__, a)) == text and b"".join(map(self.raw_b.__getitem__, b)) == text
            yield np.array(a, np.int32), np.array(b, np.int32), ok

    def fragments(self, ranges: list[tuple[bytes, int, int, int]]) -> Iterator[Fragment]:
        """Of (text between safe cuts, its place, range start, range end): tokens that end within (start, end]."""
        for (_, place, low, high), (a, b, ok) in zip(ranges, self.encode([r[0] for r in ranges]), strict=True):
            ends_a, ends_b = place + np.cumsum(self.length_a[a]), place + np.cumsum(self.length_b[b])
            in_a, in_b = (ends_a > low) & (ends_a <= high), (ends_b > low) & (ends_b <= high)
            yield fragment_of(a[in_a], b[in_b], ends_a[in_a], ends_b[in_b], ok)


_LOADED: dict[str, Pair] = {}


def loaded(files: tuple[bytes, bytes, bool]) -> Pair:
    """The tokenizers of these files, made once in a Python worker."""
    key = hashlib.sha256(files[0] + files[1] + bytes([files[2]])).hexdigest()
    if key not in _LOADED:
        _LOADED[key] = Pair(*files)
    return _LOADED[key]


def ranges_of(text: bytes, size: int) -> Iterator[tuple[bytes, int, int, int]]:
    """Byte ranges of a text (which begins with a space), each with the text between the safe cuts around it.

    What stands between two safe cuts is encoded as in the whole text. A range that
    ends in a run without safe cuts takes whole further ranges of that run in, so no
    run is encoded more than twice.
    """
    n, low = len(text), 0
    while low < n:
        high = min(n, low + size)
        begin, back = 0, 1_024
        while low and not begin:
            found = [m.start() for m in CUT.finditer(text, max(0, low - back), min(n, low + 2)) if m.start() <= low]
            begin = found[-1] if found else 0
            if back >= low:
                break
            back *= 4
        after = CUT.search(text, high) if high < n else None
        stop = after.start() if after else n
        high = n if stop == n else high + (stop - high) // size * size
        yield text[begin:stop], begin, low, high
        low = high


# ------------------------------------------------------------------ encoding
def _records(fragments: list[Fragment], **first: pa.Array) -> pa.RecordBatch:
    columns = [pa.array([f.ok for f in fragments], pa.bool_())]
    columns += [pa.array([getattr(f, name) for f in fragments], _LISTS) for name in ("a", "b", "ga", "gb")]
    return pa.RecordBatch.from_arrays([*first.values(), *columns], [*first, "ok", "a", "b", "ga", "gb"])


def _short(files):
    """Whole texts: (doc_id, _text) to (doc_id, fragment), about ``ENCODE_BYTES`` of text at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pair = loaded(files.value)
            ends, raw = text_bytes(batch.column("_text"))
            for i, j in pieces(ends, ENCODE_BYTES):
                texts = [b" " + raw[s:e].tobytes() for s, e in zip(ends[i:j].tolist(), ends[i + 1 : j + 1].tolist(), strict=True)]
                made = list(pair.fragments([(t, 0, 0, len(t)) for t in texts]))
                yield _records(made, doc_id=batch.column("doc_id").slice(i, j - i))

    return run


def _cut(size: int):
    """Long texts: (_key, _text) to rows of (_key, k, part, place, low, high)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.binary(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
        names = ("_key", "k", "part", "place", "low", "high")
        for batch in batches:
            ends, raw = text_bytes(batch.column("_text"))
            for i, key in enumerate(batch.column("_key").to_pylist()):
                text = b" " + raw[ends[i] : ends[i + 1]].tobytes()
                rows = [(key, k, *r) for k, r in enumerate(ranges_of(text, size))]
                for first in range(0, len(rows), 64):
                    columns = zip(*rows[first : first + 64], strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], list(names))

    return run


def _parts(files):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pair = loaded(files.value)
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                part, place, low, high = (row.column(c)[0].as_py() for c in ("part", "place", "low", "high"))
                yield _records(list(pair.fragments([(part, place, low, high)])), _key=row.column("_key"), k=row.column("k"))

    return run


def _composed(table: pa.Table) -> pa.Table:
    """One step of the tree: at most ``FAN_IN`` adjacent fragments of one text."""
    table = table.sort_by("k").combine_chunks()
    lists = {c: [np.asarray(x.values) for x in table.column(c)] for c in ("a", "b", "ga", "gb")}
    oks = table.column("ok").to_pylist()
    whole = compose(Fragment(*(lists[c][i] for c in ("a", "b", "ga", "gb")), oks[i]) for i in range(table.num_rows))
    first = table.slice(0, 1)
    parent = pa.array([first.column("k")[0].as_py() // FAN_IN], pa.int64())
    return pa.Table.from_batches([_records([whole], _key=pa.array(first.column("_key").to_pylist(), pa.binary()), k=parent)])


def _encoded(docs: DataFrame, byte_level: str, sentence_pieces: str, chunk_bytes: int, after: Step | None, schema: str) -> DataFrame:
    """Fragments of all rows, passed on to ``after`` (in the same Python worker where the text is short)."""
    spark = docs.sparkSession
    ship_package(spark)
    with open(byte_level, "rb") as one, open(sentence_pieces, "rb") as two:
        first = one.read()
        files = spark.sparkContext.broadcast((first, two.read(), merges_follow_ids(first)))
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("_text"))
    whole = _short(files)
    short = rows.where(F.octet_length("_text") <= chunk_bytes).mapInArrow(
        (lambda batches: after(whole(batches))) if after else whole, f"doc_id {kind}, {schema}"
    )
    long = rows.where(F.octet_length("_text") > chunk_bytes).withColumn("_key", F.unhex(F.sha2("_text", 256)))
    size = long.agg(F.max(F.octet_length("_text"))).first()[0]
    if not size:
        return short
    cut = long.groupBy("_key").agg(F.first("_text").alias("_text")).mapInArrow(
        _cut(chunk_bytes), "_key binary, k bigint, part binary, place bigint, low bigint, high bigint"
    )
    made = f"_key binary, k bigint, {FRAGMENT}"
    tree = cut.repartition("_key", "k").mapInArrow(_parts(files), made)
    count = -(-(size + 1) // chunk_bytes)
    while count > 1:
        tree = tree.withColumn("_parent", F.floor(F.col("k") / FAN_IN)).groupBy("_key", "_parent").applyInArrow(
            lambda table: _composed(table.drop_columns("_parent")), made
        )
        count = -(-count // FAN_IN)
    each = tree.drop("k").withColumnRenamed("_key", "doc_id")
    each = (each.mapInArrow(after, f"doc_id binary, {schema}") if after else each).withColumnRenamed("doc_id", "_key")
    return short.unionByName(long.select("doc_id", "_key").join(each, "_key").drop("_key"))


def encode(docs: DataFrame, byte_level: str, sentence_pieces: str, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """``doc_id`` and the fragment of every row's whole text.

    ``a`` and ``b`` are the ids, ``ga`` and ``gb`` say how many each group takes; both
    end with an open suffix, which is empty when ``ok``. A null or empty text, and one
    whose tokens do not give back its bytes, has ``ok`` false. Rows with a null or
    repeated id stay as they are. Equal long texts are encoded once. The files are read by the
    driver and sent to the tasks (their size is that of the vocabularies).
    """
    return _encoded(docs, byte_level, sentence_pieces, chunk_bytes, None, FRAGMENT).withColumn("ok", F.col("ok") & (F.size("a") > 0))


# --------------------------------------------------------------------- links
def _flat(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    column = batch.column(name)
    offsets = column.offsets.to_numpy().astype(np.int64)
    return column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]].astype(np.int64), offsets - offsets[0]


class Groups:
    """Groups of some encoded rows; a row that is not ok has none."""

    def __init__(self, batch: pa.RecordBatch):
        self.rows = batch.num_rows
        ok = batch.column("ok").to_numpy(zero_copy_only=False).astype(bool) & (np.diff(batch.column("a").offsets.to_numpy()) > 0)
        (a, at_a), (b, at_b) = _flat(batch, "a"), _flat(batch, "b")
        (ga, at_g), (gb, _) = _flat(batch, "ga"), _flat(batch, "gb")
        row = np.repeat(np.arange(self.rows), np.diff(at_g))
        keep = ok[row]
        if len(at_g) > 1:
            keep[at_g[1:] - 1] = False  # the open suffix, empty here
        self.row, self.ga, self.gb = row[keep], ga[keep], gb[keep]
        self.a = a[np.repeat(ok, np.diff(at_a))]
        self.b = b[np.repeat(ok, np.diff(at_b))]
        self.from_a, self.from_b = np.cumsum(self.ga) - self.ga, np.cumsum(self.gb) - self.gb
        self.links = self.ga * self.gb

    def per_row(self, values: np.ndarray) -> np.ndarray:
        out = np.zeros(self.rows, np.int64)
        np.add.at(out, self.row, values)
        return out

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, code, times): every pair of ids that a row links, once, with the number of its links."""
        found: list[tuple[np.ndarray, np.ndarray]] = []
        first, ends = 0, np.cumsum(self.links)
        while first < len(self.links):
            done = ends[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(ends, done + BLOCK_LINKS, side="right")))
            if self.links[first] > BLOCK_LINKS:
                found += self._large(first)
                first += 1
                continue
            total = int(ends[last - 1] - done)
            group = np.repeat(np.arange(first, last), self.links[first:last])
            t = np.arange(total) - np.repeat(ends[first:last] - self.links[first:last] - done, self.links[first:last])
            a = self.a[self.from_a[group] + t // self.gb[group]]
            b = self.b[self.from_b[group] + t % self.gb[group]]
            found.append(np.unique((self.row[group] << 2 * ID_BITS) | (a << ID_BITS) | b, return_counts=True))
            first = last
        if not found:
            return (np.zeros(0, np.int64),) * 3
        keys = np.concatenate([k for k, _ in found])
        times = np.concatenate([n for _, n in found])
        if len(found) > 1:
            order = np.argsort(keys, kind="stable")
            keys, times = keys[order], times[order]
            starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            keys, times = keys[starts], np.add.reduceat(times, starts)
        return keys >> 2 * ID_BITS, keys & ((1 << 2 * ID_BITS) - 1), times

    def _large(self, g: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """A group with very many links: its different ids with their numbers, some of them against all others at a time."""
        a, na = np.unique(self.a[self.from_a[g] : self.from_a[g] + self.ga[g]], return_counts=True)
        b, nb = np.unique(self.b[self.from_b[g] : self.from_b[g] + self.gb[g]], return_counts=True)
        step = max(1, BLOCK_LINKS // len(b))
        for i in range(0, len(a), step):
            keys = (self.row[g] << 2 * ID_BITS) | (a[i : i + step, None] << ID_BITS) | b[None, :]
            yield keys.ravel(), (na[i : i + step, None] * nb[None, :]).ravel()

    def digests(self) -> list[str]:
        """SHA-256 of each row's groups as text; rows without groups have an empty one."""
        width = len(str(ID_MASK)) + 1
        size = max(1, int(self.a.max(initial=0)) + 1, int(self.b.max(initial=0)) + 1)
        digits, lengths = _digits(size, width)
        ids = np.empty(len(self.a) + len(self.b), np.int64)
        marks = np.full(len(ids), ord(","), np.uint8)
        at_a = np.arange(len(self.a)) + np.repeat(self.from_b, self.ga)
        at_b = np.arange(len(self.b)) + np.repeat(self.from_a + self.ga, self.gb)
        ids[at_a], ids[at_b] = self.a, self.b
        marks[at_a[self.from_a + self.ga - 1]] = ord("|")
        marks[at_b[self.from_b + self.gb - 1]] = ord(";")
        tokens = np.concatenate([[0], np.cumsum(self.per_row(self.ga + self.gb))])
        out = []
        for r in range(self.rows):
            one = ids[tokens[r] : tokens[r + 1]]
            if not len(one):
                out.append("")
                continue
            cells, n = digits[one], lengths[one]
            cells[np.arange(len(one)), n] = marks[tokens[r] : tokens[r + 1]]
            text = cells[np.arange(width) <= n[:, None]].tobytes()
            out.append(hashlib.sha256(text[:-1]).hexdigest())
        return out


_DIGITS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _digits(size: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Decimal digits of the numbers below ``size``, left-justified, and how many each has."""
    size = 1 << (size - 1).bit_length()
    if size not in _DIGITS:
        numbers = np.arange(size)
        text = numbers.astype(f"S{width}")
        _DIGITS[size] = text.view(np.uint8).reshape(size, width), np.char.str_len(text)
    return _DIGITS[size]


def _row_slices(batch: pa.RecordBatch, column: str = "a") -> Iterator[pa.RecordBatch]:
    """Some rows of a batch at a time, by the lists of ``column``, so that what is made of them stays small."""
    ends = batch.column(column).offsets.to_numpy().astype(np.int64)
    for i, j in pieces(ends, BLOCK_LINKS // 8):
        yield batch.slice(i, j - i)


FIGURES = ("n_a", "n_b", "n_groups", "n_links")
KEPT = ("doc_id", "_row", *FIGURES, "groups_sha256")
LINKED = ", ".join([*(f"{f} bigint" for f in FIGURES), "groups_sha256 string", "codes array<bigint>", "times array<int>"])


def _figures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in _row_slices(batch):
            groups = Groups(part)
            row, code, times = groups.pairs()
            at = pa.array(np.searchsorted(row, np.arange(groups.rows + 1)), pa.int32())
            figures = [groups.per_row(groups.ga), groups.per_row(groups.gb), groups.per_row(np.ones(len(groups.row), np.int64)), groups.per_row(groups.links)]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0), *[pa.array(f, pa.int64()) for f in figures], pa.array(groups.digests(), pa.string()),
                    pa.ListArray.from_arrays(at, pa.array(code, pa.int64())), pa.ListArray.from_arrays(at, pa.array(times, pa.int32())),
                ],
                ["doc_id", *FIGURES, "groups_sha256", "codes", "times"],
            )


def link(docs: DataFrame, byte_level: str, sentence_pieces: str, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """``doc_id``, its figures and the pairs of ids (``codes``) that its groups link, each once, with how often (``times``).

    As ``encode``, of which it keeps what the corpus-wide counts need: a row that is
    not ok has zeros, an empty digest and no pairs.
    """
    return _encoded(docs, byte_level, sentence_pieces, chunk_bytes, _figures, LINKED)


def pair_counts(linked: DataFrame) -> DataFrame:
    """(code, n, best): in how many rows a pair of ids is linked, and whether no pair of its first id has more."""
    counts = linked.select(F.explode(once(F.col("codes"))).alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("n"))
    counts = cut_lineage(counts.withColumn("a", F.shiftright("code", ID_BITS)), "pair-counts")
    # One row for each id of the first vocabulary at most.
    most = broadcast_counted(cut_lineage(counts.groupBy("a").agg(F.max("n").alias("most")), "most"))
    return counts.join(most, "a").select("code", "n", (F.col("n") == F.col("most")).alias("best"))


def _hot_threshold(counts: DataFrame, limit: int) -> int:
    """The least count such that at most ``limit`` pairs have it or more, up to an eighth of a doubling."""
    grade = F.floor(F.log2("n") * GRADES).cast("int")
    left, lowest = limit, None
    for row in counts.groupBy(grade.alias("g")).agg(F.count(F.lit(1)).alias("pairs"), F.min("n").alias("least")).orderBy(F.desc("g")).collect():
        left -= row["pairs"]
        if left < 0:
            break
        lowest = row["least"]
    return lowest if lowest is not None else (1 << 62)


def _told(table):
    """Rows of pairs to their sums over the hot pairs of ``table``, with the pairs that are left, some rows at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, numbers, best = table.value
        for batch in (part for whole in batches for part in _row_slices(whole, "codes")):
            (code, ends), (times, _) = _flat(batch, "codes"), _flat(batch, "times")
            row = np.repeat(np.arange(batch.num_rows), np.diff(ends))
            at = np.minimum(np.searchsorted(known, code), max(0, len(known) - 1))
            seen = known[at] == code if len(known) else np.zeros(len(code), bool)
            sums, bests = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            np.add.at(sums, row[seen], times[seen] * numbers[at[seen]])
            np.add.at(bests, row[seen], times[seen] * best[at[seen]])
            rest = pa.array(np.searchsorted(row[~seen], np.arange(batch.num_rows + 1)), pa.int32())
            lists = [pa.ListArray.from_arrays(rest, pa.array(v[~seen], pa.int64())) for v in (code, times)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in KEPT] + [pa.array(bests, pa.int64()), pa.array(sums, pa.int64()), *lists],
                [*KEPT, "n_best", "count_sum", "_codes", "_times"],
            )

    return run


def align(linked: DataFrame, hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """Groups, links and corpus-wide counts of every row of ``link``'s result.

    ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best``, ``count_sum`` (long) and
    ``groups_sha256``. A row that is not ok has zeros and an empty digest and is in
    no count. Ties for the highest count are all best. Repeated rows count each.
    ``hot_pairs`` bounds what tasks hold and does not change the result; an empty table
    gives no rows.
    """
    spark = linked.sparkSession
    kind = linked.schema["doc_id"].dataType.simpleString()
    # Row numbers are fixed by writing them.
    written = cut_lineage(linked.withColumn("_row", F.monotonically_increasing_id()), "linked")
    counts = cut_lineage(pair_counts(written), "pairs")
    threshold = _hot_threshold(counts, hot_pairs)
    hot = counts.where(F.col("n") >= threshold).toArrow().combine_chunks()
    codes = hot["code"].to_numpy()
    order = np.argsort(codes)
    table = spark.sparkContext.broadcast(
        (codes[order], hot["n"].to_numpy()[order], hot["best"].to_numpy()[order].astype(bool))
    )

    schema = (
        f"doc_id {kind}, _row bigint, {', '.join(f'{f} bigint' for f in FIGURES)}, groups_sha256 string, n_best bigint, count_sum bigint, "
        "_codes array<bigint>, _times array<bigint>"
    )
    found = cut_lineage(written.select(*KEPT, "codes", "times").mapInArrow(_told(table), schema), "aligned")
    # Pairs below the threshold: none of them is in a large share of the rows.
    asked = found.where(F.size("_codes") > 0).select("_row", F.explode(once(F.arrays_zip("_codes", "_times"))).alias("p"))
    rare = counts.where(F.col("n") < threshold)
    told = asked.select("_row", F.col("p._codes").alias("code"), F.col("p._times").alias("times")).join(rare, "code")
    more = told.groupBy("_row").agg(
        F.sum(F.col("times") * F.col("n")).alias("_sum"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("_best")
    )
    joined = found.drop("_codes", "_times").join(more, "_row", "left")
    zero = F.lit(0).cast("bigint")
    return joined.select(
        "doc_id", *FIGURES, (F.col("n_best") + F.coalesce("_best", zero)).alias("n_best"),
        (F.col("count_sum") + F.coalesce("_sum", zero)).alias("count_sum"), "groups_sha256",
    )
