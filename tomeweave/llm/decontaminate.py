"""Benchmark decontamination with suffix arrays over the training texts.

Every Arrow batch of documents is a shard. Its words become numbers of the
benchmark's vocabulary, other words a break. A suffix array over what can match
is built by prefix doubling, and every suffix of every benchmark item is looked
up in it by binary search, which gives the longest verbatim matches and all
places of each window of an item. Nothing is shuffled: the benchmark, in blocks
of a bounded size, is what travels.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tomeweave.llm.base import pieces, text_bytes
from tomeweave.llm.bytewords import Words
from tomeweave.session import cut_lineage, ship_package

WINDOW_WORDS = 10
BLOCK_BYTES = 32 * 1024 * 1024
PIECE_BYTES = 4 * 1024 * 1024
SPANS = "array<struct<start: bigint, end: bigint>>"
BEST = "array<struct<item: string, words: bigint, at: bigint>>"
SCHEMA = f"text string, n_words bigint, spans {SPANS}, items array<string>, best {BEST}"


@dataclass
class Benchmark:
    """One block of items: word numbers end to end with a 0 after each item, and the distinct windows."""

    vocabulary: dict[bytes, int]
    keys: np.ndarray  # sorted keys of the vocabulary
    key_ids: np.ndarray  # class of words with that key
    tokens: np.ndarray
    item_of: np.ndarray  # item row per token
    items: list[str]
    windows: np.ndarray  # token places where a window begins
    widths: np.ndarray  # words per window
    least: int


def benchmark_block(rows: list[tuple[str, str | None]], window: int = WINDOW_WORDS) -> Benchmark:
    data = [(t or "").encode() for _, t in rows]
    ends = np.concatenate([[0], np.cumsum([len(d) for d in data])]).astype(np.int64)
    words = Words(np.frombuffer(b"".join(data), np.uint8), ends)
    vocabulary: dict[bytes, int] = {}
    ids = np.array([vocabulary.setdefault(words.word(k), len(vocabulary) + 1) for k in range(len(words))], np.int64)
    keys = words.keys()
    tokens, item_of, windows, widths = [], [], [], []
    at = 0
    for row in range(len(rows)):
        mine = ids[words.first[row] : words.first[row + 1]]
        if len(mine):
            width = min(window, len(mine))
            count = len(mine) - width + 1
            windows.append(at + np.arange(count))
            widths.append(np.full(count, width))
        tokens += [mine, [0]]
        item_of.append(np.full(len(mine) + 1, row))
        at += len(mine) + 1
    known, where = np.unique(keys, return_index=True)
    widths = np.concatenate(widths) if widths else np.zeros(0, np.int64)
    return Benchmark(
        vocabulary, known, ids[where] if len(ids) else np.zeros(0, np.int64),
        np.concatenate([*tokens, []]).astype(np.int64), np.concatenate([*item_of, []]).astype(np.int64),
        [i for i, _ in rows], np.concatenate(windows) if windows else np.zeros(0, np.int64), widths,
        int(widths.min()) if len(widths) else 0,
    )


# ------------------------------------------------------------------- shards
def number_words(words: Words, bench: Benchmark) -> tuple[np.ndarray, np.ndarray]:
    """(places, ids): the words that the benchmark has too, in stretches long enough to hold its shortest window.

    Keys find the candidates; within such stretches every word is then compared in full.
    """
    if not len(words) or not len(bench.keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    keys = words.keys()
    at = np.searchsorted(bench.keys, keys)
    at[at == len(bench.keys)] = 0
    hit = bench.keys[at] == keys
    hit = long_runs(hit, words.first, bench.least)
    places = np.flatnonzero(hit)
    ids = np.fromiter((bench.vocabulary.get(words.word(k), 0) for k in places.tolist()), np.int64, len(places))
    exact = np.zeros(len(words), bool)
    exact[places[ids > 0]] = True
    keep = long_runs(exact, words.first, bench.least)[places]
    return places[keep], ids[keep]


def long_runs(hit: np.ndarray, first: np.ndarray, least: int) -> np.ndarray:
    """Only those stretches of ``hit`` within one text that have ``least`` words or more."""
    edge = np.zeros(len(hit) + 1, bool)
    edge[first[first <= len(hit)]] = True
    before = np.concatenate([[False], hit[:-1]])
    starts = np.flatnonzero(hit & (~before | edge[:-1]))
    after = np.concatenate([hit[1:], [False]])
    stops = np.flatnonzero(hit & (~after | edge[1:])) + 1
    out = np.zeros(len(hit) + 1, np.int64)
    fits = stops - starts >= least
    np.add.at(out, starts[fits], 1)
    np.add.at(out, stops[fits], -1)
    return np.cumsum(out[:-1]) > 0


def suffix_array(tokens: np.ndarray, longest: int) -> np.ndarray:
    """Suffix starts in order, by prefix doubling until stretches of ``longest`` words are told apart."""
    n = len(tokens)
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64)
    order = np.argsort(rank, kind="stable")
    step = 1
    while step < longest and n > 1:
        ahead = np.zeros(n, np.int64)
        ahead[: n - step] = rank[step:] + 1
        order = np.lexsort((ahead, rank))
        new = np.ones(n, np.int64)
        same = (rank[order[1:]] == rank[order[:-1]]) & (ahead[order[1:]] == ahead[order[:-1]])
        new[1:] = ~same
        new[0] = 0
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new)
        if rank[order[-1]] == n - 1:
            break
        step *= 2
    return order


def common_prefix(a: np.ndarray, i: np.ndarray, b: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
    """How many words from a[i] and b[j] agree, up to ``most``; a 0 agrees with nothing."""
    length = np.zeros(len(i), np.int64)
    live = np.flatnonzero(most > 0)
    while len(live):
        at = length[live]
        x, y = i[live] + at, j[live] + at
        inside = (x < len(a)) & (y < len(b))
        x, y = np.minimum(x, len(a) - 1), np.minimum(y, len(b) - 1)
        live = live[inside & (a[x] == b[y]) & (a[x] > 0)]
        length[live] += 1
        live = live[length[live] < most[live]]
    return length


def lower_bound(train: np.ndarray, order: np.ndarray, test: np.ndarray, at: np.ndarray, width: np.ndarray, after: bool = False) -> np.ndarray:
    """First place in the suffix array that is not below (``after``: above) each test suffix of ``width`` words."""
    low, high = np.zeros(len(at), np.int64), np.full(len(at), len(order), np.int64)
    while True:
        live = np.flatnonzero(low < high)
        if not len(live):
            return low
        mid = (low[live] + high[live]) // 2
        same = common_prefix(train, order[mid], test, at[live], width[live])
        done = same == width[live]
        x = np.minimum(order[mid] + same, len(train) - 1)
        y = np.minimum(at[live] + same, len(test) - 1)
        below = np.where(done, after, train[x] < test[y])
        low[live] = np.where(below, mid + 1, low[live])
        high[live] = np.where(below, high[live], mid)


@dataclass
class Found:
    hit: np.ndarray  # words of the shard inside an occurrence
    doc_items: np.ndarray  # rows (document, item)
    best: np.ndarray  # rows (item, words, place in the shard): the longest match of each item's suffixes


def search(places: np.ndarray, ids: np.ndarray, doc_of: np.ndarray, n_words: int, bench: Benchmark) -> Found:
    """Look up all suffixes and windows of the benchmark in one shard."""
    hit = np.zeros(n_words + 1, np.int64)
    none = np.zeros((0, 2), np.int64)
    if not len(places):
        return Found(hit[:-1] > 0, none, np.zeros((0, 3), np.int64))
    # Stretches end to end, with a 0 after each: a stretch ends where places jump or the document changes.
    ends = np.flatnonzero((np.diff(places) != 1) | (np.diff(doc_of) != 0))
    train = np.insert(ids, ends + 1, 0)
    train = np.append(train, 0)
    place = np.append(np.insert(places, ends + 1, -1), -1)
    doc = np.append(np.insert(doc_of, ends + 1, -1), -1)
    cuts = np.flatnonzero(train == 0)
    order = suffix_array(train, int(np.diff(np.concatenate([[-1], cuts])).max()))

    suffixes = np.flatnonzero(bench.tokens > 0)
    zeros = np.flatnonzero(bench.tokens == 0)
    left = zeros[np.searchsorted(zeros, suffixes)] - suffixes
    at = lower_bound(train, order, bench.tokens, suffixes, left)
    best = np.zeros((len(suffixes), 2), np.int64)
    for near in (at - 1, at):
        ok = np.flatnonzero((near >= 0) & (near < len(order)))
        got = common_prefix(train, order[near[ok]], bench.tokens, suffixes[ok], left[ok])
        better = got > best[ok, 0]
        best[ok[better]] = np.stack([got[better], order[near[ok[better]]]], 1)
    some = np.flatnonzero(best[:, 0] > 0)
    items = bench.item_of[suffixes[some]]
    some = some[np.lexsort((best[some, 1], -best[some, 0], items))]
    items = bench.item_of[suffixes[some]]
    some, items = (x[np.flatnonzero(np.diff(items, prepend=-1))] for x in (some, items))
    longest = np.stack([items, best[some, 0], place[best[some, 1]]], 1)

    first = lower_bound(train, order, bench.tokens, bench.windows, bench.widths)
    last = lower_bound(train, order, bench.tokens, bench.windows, bench.widths, after=True)
    met = np.flatnonzero(last > first)
    pairs = []
    if len(met):
        # Windows with the same words have the same range: mark and expand each range once.
        ranges, of = np.unique(np.stack([first[met], last[met], bench.widths[met]], 1), axis=0, return_inverse=True)
        items = np.unique(np.stack([of.ravel(), bench.item_of[bench.windows[met]]], 1), axis=0)
        starts = np.searchsorted(items[:, 0], np.arange(len(ranges) + 1))
        for k, (a, b, width) in enumerate(ranges.tolist()):
            spots = order[a:b]
            np.add.at(hit, place[spots], 1)
            np.add.at(hit, place[spots] + width, -1)
            docs = np.unique(doc[spots])
            mine = items[starts[k] : starts[k + 1], 1]
            pairs.append(np.stack([np.repeat(docs, len(mine)), np.tile(mine, len(docs))], 1))
    return Found(np.cumsum(hit[:-1]) > 0, np.unique(np.concatenate(pairs), axis=0) if pairs else none, longest)


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int) -> Iterator[list[tuple[str, str]]]:
    """The benchmark's items in blocks of about ``block_bytes``, one after the other."""
    size = F.octet_length(F.coalesce(text_col, F.lit("")))
    rows = cut_lineage(
        benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), F.col(text_col).cast("string").alias("text"), size.alias("size")).where("size > 0"),
        "benchmark",
    )
    total = rows.agg(F.sum("size")).first()[0] or 0
    parts = max(1, -(-int(total) // block_bytes))
    for part in range(parts):
        block = rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(parts)) == part).select("item", "text")
        if got := sorted(tuple(r) for r in block.collect()):
            yield got


def matches(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW_WORDS, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES, id_type: str = "bigint",
) -> DataFrame:
    """(doc_id, n_words, spans, items, best) for every row of ``docs``.

    ``spans`` are the word ranges inside any occurrence of a window of ``window``
    words, and ``items`` the ids of the items these windows belong to, sorted as
    strings. ``best`` has the longest verbatim match of an item in a shard, with
    the document that holds it; see ``longest_matches``. Stretches shorter than
    the benchmark's shortest window are not looked at.
    An item of fewer words is one window; an item without words, or with a null
    text, has none. A null document text has no words. A null item id counts as
    the empty string; equal item ids are one item. Repeated documents repeat,
    other columns are ignored. A benchmark of more than ``block_bytes`` is taken
    in several passes over each task's rows, within one stage.
    """
    return _searched(docs, benchmark, window, id_col, text_col, item_col, item_text_col, block_bytes, id_type).drop("text")


def _searched(
    docs: DataFrame, benchmark: DataFrame, window: int, id_col: str, text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", block_bytes: int = BLOCK_BYTES, id_type: str | None = None,
) -> DataFrame:
    """``matches`` with the text; without ``id_type`` an id is of any type and comes back as it is."""
    spark = docs.sparkSession
    ship_package(spark)
    own = F.col(id_col) if id_type is None else F.col(id_col).cast(id_type)
    rows = docs.select(
        own.alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.lit(-1).cast("bigint").alias("n_words"),
        F.array().cast(SPANS).alias("spans"), F.array().cast("array<string>").alias("items"),
        F.array().cast(BEST).alias("best"),
    )
    blocks = _blocks(benchmark, item_col, item_text_col, block_bytes)
    rows = _one_pass(spark, rows, next(blocks, []), window)
    for block in blocks:
        rows = _one_pass(spark, rows, block, window)
    return rows


def longest_matches(found: DataFrame) -> DataFrame:
    """(item, words, doc_id, at) from ``matches``: each item's longest verbatim match; of equal ones the smallest id and place."""
    each = found.select("doc_id", F.explode("best").alias("b")).select("b.item", "b.words", "doc_id", "b.at")
    first = F.struct(F.col("words"), (-F.col("doc_id")).alias("d"), (-F.col("at")).alias("a"))
    return each.groupBy("item").agg(F.max_by(F.struct("words", "doc_id", "at"), first).alias("m")).select("item", "m.*")


def _one_pass(spark: SparkSession, rows: DataFrame, block: list[tuple[str, str]], window: int) -> DataFrame:
    shared = spark.sparkContext.broadcast(benchmark_block(block, window))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bench = shared.value
        for batch in batches:
            if batch.num_rows:
                yield _scan(batch, bench)

    return rows.mapInArrow(run, StructType([StructField("doc_id", rows.schema["doc_id"].dataType), *StructType.fromDDL(SCHEMA).fields]))


def _scan(batch: pa.RecordBatch, bench: Benchmark) -> pa.RecordBatch:
    """One shard: its words are numbered piece by piece, then searched as a whole."""
    ends, raw = text_bytes(batch.column(1))
    n_docs = len(ends) - 1
    counts = np.zeros(n_docs, np.int64)
    places, ids, docs, total = [], [], [], 0
    for first, last in pieces(ends, PIECE_BYTES):
        words = Words(raw, ends[first : last + 1])
        counts[first:last] = np.diff(words.first)
        at, found = number_words(words, bench)
        places.append(at + total)
        ids.append(found)
        docs.append(first + np.searchsorted(words.first, at, side="right") - 1)
        total += len(words)
    starts = np.concatenate([[0], np.cumsum(counts)])
    empty = np.zeros(0, np.int64)
    found = search(np.concatenate([empty, *places]), np.concatenate([empty, *ids]), np.concatenate([empty, *docs]), total, bench)
    return _merge(batch, counts, starts, found, bench)


def _merge(batch: pa.RecordBatch, counts: np.ndarray, starts: np.ndarray, found: Found, bench: Benchmark) -> pa.RecordBatch:
    """Add what a pass found to what earlier passes did."""
    edges = np.diff(np.concatenate([[0], found.hit.astype(np.int8), [0]]))
    begin, stop = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    spans: dict[int, list[tuple[int, int]]] = {}
    for a, b in zip(begin.tolist(), stop.tolist(), strict=True):
        row = int(np.searchsorted(starts, a, side="right")) - 1
        while a < b:  # a stretch of hits may go on into the next documents
            cut = min(b, int(starts[row + 1]))
            if cut > a:
                spans.setdefault(row, []).append((a - int(starts[row]), cut - int(starts[row])))
            a, row = max(a, cut), row + 1
    items: dict[int, set[str]] = {}
    for row, item in found.doc_items.tolist():
        items.setdefault(row, set()).add(bench.items[item])
    old = {c: batch.column(c).to_pylist() for c in ("spans", "items", "best")}
    for row, new in spans.items():
        old["spans"][row] = _union([*((s["start"], s["end"]) for s in old["spans"][row]), *new])
    for row, new in items.items():
        old["items"][row] = sorted({*old["items"][row], *new})
    rows = np.searchsorted(starts, found.best[:, 2], side="right") - 1
    for (item, length, at), row in zip(found.best.tolist(), rows.tolist(), strict=True):
        old["best"][row] = [*old["best"][row], {"item": bench.items[item], "words": length, "at": at - int(starts[row])}]
    kinds = batch.schema
    return pa.record_batch(
        [batch.column(0), batch.column(1), pa.array(counts), *[pa.array(old[c], kinds.field(c).type) for c in old]], ["doc_id", "text", "n_words", *old]
    )


def _union(ranges: list[tuple[int, int]]) -> list[dict[str, int]]:
    out: list[dict[str, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1]["end"]:
            out[-1]["end"] = max(b, out[-1]["end"])
        else:
            out.append({"start": a, "end": b})
    return out


def removed(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW_WORDS, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose own text holds no window of an item, with all their columns.

    Whole rows pass through the search, so no text is shuffled, and null and repeated ids
    do not matter: of rows that share an id only those with an affected text go. Rows with a null text stay.
    """
    # A string comes back as the text itself; a text of another type travels beside its string.
    held = text_col in docs.columns and isinstance(docs.schema[text_col].dataType, StringType)
    others = [c for c in docs.columns if not held or c != text_col]
    fields = [F.col(f"`{c}`").alias(f"_{k}") for k, c in enumerate(others)] or [F.lit(True).alias("_0")]
    rows = docs.select(F.struct(*fields).alias("_row"), F.col(text_col).alias("text"))
    kept = _searched(rows, benchmark, window, "_row").where(F.size("spans") == 0)
    own = {c: F.col("doc_id")[f"_{k}"] for k, c in enumerate(others)}
    return kept.select(*[own.get(c, F.col("text")).alias(c) for c in docs.columns])
