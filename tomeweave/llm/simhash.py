"""SimHash near-duplicates by tiled exact comparison.

Fingerprints are compared all against all, in tiles: exclusive-or and bit
counts over numpy blocks. Two fingerprints that differ in at most r bits have
population counts that differ by at most r, so tiles hold fingerprints of one
population count and only tiles of counts within r meet. Inside a pair of tiles
the same bound on the counts of the four 16-bit words skips most blocks.
A pair of tiles gives a spanning forest of its links, never the links
themselves: a group of m copies leaves at most m - 1 edges.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tomeweave.llm.base import map_batches, pieces, rows_named, text_bytes
from tomeweave.operators.graph import components
from tomeweave.session import cut_lineage, ship_package

SHINGLE_WORDS = 4
RADIUS = 4
SEED = 42
STAGE_WORDS, SIMILARITY = 5, 0.8  # of near-duplicate texts, decided exactly
COUNTED, COMMON_LEAST, COMMON_ROWS = 1 << 21, 2, 1 << 18  # of shingles that are compared last
LEAST, LEAST_PER = 3, 64  # shingles that prefixes share
TILE_ROWS = 131_072
BLOCK_ROWS = 512
PIECE_BYTES = 1 << 20
BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def shingle_hashes(text: bytes, size: int = SHINGLE_WORDS) -> list[int]:
    """Hashes of the shingles of one text, repeats included."""
    words = text.lower().split()
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= size:
        return [xxhash.xxh64_intdigest(joined, SEED)]
    ends = (np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1).tolist()
    starts = [0, *[e + 1 for e in ends]]
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], SEED) for a, b in zip(starts, ends[size - 1 :])]  # noqa: B905 - there are more starts


def fingerprints_of(texts: list[bytes], size: int = SHINGLE_WORDS) -> np.ndarray:
    """One 64-bit majority of shingle hashes per text; no words give zero."""
    each = [shingle_hashes(t, size) for t in texts]
    counts = np.fromiter(map(len, each), np.int64, len(each))
    hashes = np.fromiter((h for hs in each for h in hs), np.uint64, int(counts.sum()))
    owner = np.repeat(np.arange(len(each)), counts) * 256
    lanes = hashes.astype("<u8").view(np.uint8).reshape(-1, 8)
    out = np.zeros((len(each), 8), np.uint8)
    for lane in range(8):
        seen = np.bincount(owner + lanes[:, lane], minlength=256 * len(each)).reshape(-1, 256)
        out[:, lane] = np.packbits(2 * (seen @ BITS) > counts[:, None], axis=1, bitorder="little")[:, 0]
    return out.view("<u8")[:, 0].astype(np.uint64)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, fp): a row per row of ``docs``; a null text has no words, so its fingerprint is zero."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        ends, raw = text_bytes(batch.column(1))
        found = [
            fingerprints_of([raw[ends[i] : ends[i + 1]].tobytes() for i in range(first, last)], size)
            for first, last in pieces(ends, PIECE_BYTES)
        ]
        return pa.record_batch([batch.column(0), pa.array(np.concatenate(found).view(np.int64))], ["doc_id", "fp"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return map_batches(rows, work, "doc_id bigint, fp bigint")


# ---------------------------------------------------------------- comparison
class Forest:
    """Union-find over row numbers, with the smallest row as root."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def roots(self, rows: np.ndarray) -> np.ndarray:
        found = self.parent[rows]
        while True:
            above = self.parent[found]
            if np.array_equal(above, found):
                return found
            found = above

    def join(self, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
        """Link rows pairwise; returns those pairs that joined two trees."""
        a, b = self.roots(left), self.roots(right)
        differ = np.flatnonzero(a != b)
        if not len(differ):
            return []
        joined = []
        trees, first = np.unique(np.stack([a[differ], b[differ]], 1), axis=0, return_index=True)
        for (x, y), at in zip(trees.tolist(), differ[first].tolist(), strict=True):
            while self.parent[x] != x:
                x = int(self.parent[x])
            while self.parent[y] != y:
                y = int(self.parent[y])
            if x != y:
                self.parent[max(x, y)] = min(x, y)
                joined.append((int(left[at]), int(right[at])))
        touched = np.concatenate([left, right])
        self.parent[touched] = self.roots(touched)
        return joined


def quarter_counts(fps: np.ndarray) -> np.ndarray:
    return np.bitwise_count(np.ascontiguousarray(fps).view(np.uint16).reshape(-1, 4)).astype(np.int16)


def _link_blocks(forest: Forest, left: np.ndarray, right: np.ndarray | None, radius: int, block: int, levels: tuple[int, ...]) -> list[tuple[int, int]]:
    """Join all rows within ``radius``, in each pair of blocks those within smaller ``levels`` first; the pairs that joined trees."""
    same = right is None
    joined: list[tuple[int, int]] = []
    every = left if same else np.concatenate([left, right])
    sides = [(0, len(left)), (0, len(left)) if same else (len(left), len(every))]
    counts = quarter_counts(every)
    blocks = []
    for first, last in sides:
        order = first + np.lexsort(counts[first:last].T[::-1])
        cut = [order[i : i + block] for i in range(0, len(order), block)]
        low = np.array([counts[c].min(0) for c in cut])
        high = np.array([counts[c].max(0) for c in cut])
        blocks.append((cut, low, high))
    (cut_a, low_a, high_a), (cut_b, low_b, high_b) = blocks
    for i, rows in enumerate(cut_a):
        start = i if same else 0
        # The least difference of population counts that two rows of these blocks can have.
        gap = np.maximum(0, np.maximum(low_b[start:] - high_a[i], low_a[i] - high_b[start:])).sum(1)
        mine = every[rows]
        for j in (start + np.flatnonzero(gap <= radius)).tolist():
            bits = np.bitwise_count(mine[:, None] ^ every[cut_b[j]][None, :])
            x, y = np.nonzero(bits <= radius)
            if same and i == j and len(x) <= len(rows):
                continue
            far = bits[x, y] if len(levels) > 1 else None
            for level in levels:
                at = slice(None) if far is None else far <= level
                joined += forest.join(rows[x[at]], cut_b[j][y[at]])
    return joined


def pairs_of(left: np.ndarray, right: np.ndarray | None, radius: int, block: int = BLOCK_ROWS) -> list[tuple[int, int]]:
    """Linked pairs of rows that make a spanning forest, nearer pairs preferred: first all within ``RADIUS``, then the others."""
    forest = Forest(len(left) if right is None else len(left) + len(right))
    found = _link_blocks(forest, left, right, min(RADIUS, radius), block, (min(RADIUS, radius),))
    if radius > RADIUS:
        found += _link_blocks(forest, left, right, radius, block, tuple(range(RADIUS + 2, radius, 2)) + (radius,))
    return found


def forest_of(left: np.ndarray, right: np.ndarray | None, radius: int = RADIUS, block: int = BLOCK_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Edges (row, root) of a spanning forest over the links of one tile, or of one tile with another.

    Rows of ``right`` are numbered after those of ``left``.
    """
    forest = Forest(len(left) if right is None else len(left) + len(right))
    _link_blocks(forest, left, right, radius, block, (radius,))
    every = np.arange(len(forest.parent))
    roots = forest.roots(every)
    linked = np.flatnonzero(roots != every)
    return linked, roots[linked]


def links(nodes: DataFrame, radius: int = RADIUS, tile_rows: int = TILE_ROWS, as_pairs: bool = False) -> DataFrame:
    """(src, dst) edges whose components are those of all links between distinct fingerprints.

    ``nodes`` is a written table (node, fp) with each fingerprint once. What
    reaches the driver are the 65 numbers of fingerprints by population count;
    they give the number of tiles of each count. A tile number is a hash of the
    fingerprint, so a lost task makes the same tiles again. With ``as_pairs`` every
    edge is a link itself, for which ``pairs_of`` prefers near fingerprints.
    """
    size = dict(nodes.groupBy(F.bit_count("fp").cast("int")).count().collect())
    if not size:
        return nodes.sparkSession.createDataFrame([], "src bigint, dst bigint")
    tiles = {p: -(-n // tile_rows) for p, n in size.items()}
    known = F.create_map(*[F.lit(x) for p, t in sorted(tiles.items()) for x in (p, t)])
    pop = F.bit_count("fp").cast("int")
    tiled = nodes.select("node", "fp", pop.alias("p")).select(
        "node", "fp", "p", F.pmod(F.xxhash64("fp"), F.element_at(known, F.col("p"))).cast("int").alias("t")
    )
    # A tile meets itself, later tiles of its count, and all tiles of the next few counts.
    partners = F.flatten(
        F.transform(
            F.sequence(F.lit(-radius), F.lit(radius)),
            lambda d: F.transform(
                F.sequence(F.lit(0), F.coalesce(F.try_element_at(known, F.col("p") + d), F.lit(0))),
                lambda k: F.struct((F.col("p") + d).alias("p"), k.alias("t")),
            ),
        )
    )
    me = F.struct("p", "t")
    placed = (
        tiled.select("node", "fp", me.alias("me"), F.explode(partners).alias("other"))
        .where(F.col("other.t") < F.coalesce(F.try_element_at(known, F.col("other.p")), F.lit(0)))
        .select("node", "fp", F.least("me", "other").alias("a"), F.greatest("me", "other").alias("b"), (F.col("me") <= F.col("other")).alias("first"))
    )

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        one = frame[frame["first"]]
        two = frame[~frame["first"]]
        ids = np.concatenate([one["node"].to_numpy(), two["node"].to_numpy()])
        left, right = (x["fp"].to_numpy().view(np.uint64) for x in (one, two))
        itself = frame["pa"].iat[0] == frame["pb"].iat[0] and frame["ta"].iat[0] == frame["tb"].iat[0]
        if not len(left) or not (itself or len(right)):
            return pd.DataFrame({"src": ids[:0], "dst": ids[:0]})
        if as_pairs:
            found = np.array(pairs_of(left, None if itself else right, radius), np.int64).reshape(-1, 2)
            return pd.DataFrame({"src": ids[found[:, 0]], "dst": ids[found[:, 1]]})
        rows, roots = forest_of(left, None if itself else right, radius)
        return pd.DataFrame({"src": ids[rows], "dst": ids[roots]})

    flat = placed.select("node", "fp", "first", F.col("a.p").alias("pa"), F.col("a.t").alias("ta"), F.col("b.p").alias("pb"), F.col("b.t").alias("tb"))
    return flat.groupBy("pa", "ta", "pb", "tb").applyInPandas(compare, "src bigint, dst bigint")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS,
    size: int = SHINGLE_WORDS, tile_rows: int = TILE_ROWS,
) -> DataFrame:
    """(doc_id, fp, component_id) per row: the smallest id reachable over links of at most ``radius`` bits.

    Equal fingerprints fold into one node, numbered by the fingerprint, before
    anything is compared, so rows that share an id but not a text stay apart. Texts
    without words, null ones too, share the fingerprint zero, which is linked
    like any other. Rows with a null id link like all others; a group in which no row
    has an id has a null component. Repeated rows repeat in the result. ``group_fp``,
    the smallest fingerprint of the group, names every group.
    """
    found = cut_lineage(fingerprints(docs, id_col, text_col, size), "fingerprints")
    nodes = cut_lineage(found.groupBy("fp").agg(F.min("doc_id").alias("first")), "nodes")
    groups = components(cut_lineage(links(nodes.select(F.col("fp").alias("node"), "fp"), radius, tile_rows), "links"))
    placed = nodes.join(groups.withColumnRenamed("id", "fp"), "fp", "left").select("fp", "first", F.coalesce("component", "fp").alias("group_fp"))
    placed = cut_lineage(placed, "groups")
    # A node is one row here, so a group of copies is as many rows as it has different fingerprints.
    least = placed.groupBy("group_fp").agg(F.min("first").alias("component_id"))
    classes = placed.join(least, "group_fp").select("fp", "group_fp", "component_id")
    return found.join(classes, "fp", "left").select("doc_id", "fp", "component_id", "group_fp")


# ------------------------------------------------------- groups of similar texts
def _sets(column: pa.Array, size: int) -> Iterator[np.ndarray]:
    """The distinct shingle hashes of every text; texts without words all have the one set of zero."""
    ends, raw = text_bytes(column)
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        found = np.unique(np.array(shingle_hashes(raw[a:b].tobytes(), size), np.uint64)).view(np.int64)
        yield found if len(found) else np.zeros(1, np.int64)


def _common_shingles(docs: DataFrame, text: Column, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Rising hashes and ranks of shingles that many texts have, the most common last: what ``similar_groups`` compares last.

    Every text is read. A shingle counts where ``COMMON_LEAST`` of so many texts in a row as have
    ``COUNTED`` shingles hold it, and the ``COMMON_ROWS`` highest counts come to the driver. Any ranks give the same groups.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        total = 0
        for batch in batches:
            for found in _sets(batch.column(0), size):
                held.append(found)
                total += len(found)
                if total >= COUNTED:
                    yield counted(held)
                    held, total = [], 0
        if held:
            yield counted(held)

    def counted(held: list[np.ndarray]) -> pa.RecordBatch:
        found, times = np.unique(np.concatenate(held), return_counts=True)
        many = times >= COMMON_LEAST
        return pa.record_batch([pa.array(found[many]), pa.array(times[many].astype(np.int64))], ["h", "n"])

    ship_package(docs.sparkSession)
    each = docs.select(text.alias("text")).mapInArrow(count, "h bigint, n bigint")
    top = each.groupBy("h").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "h").limit(COMMON_ROWS).toArrow()["h"].to_numpy()
    order = np.argsort(top)
    return top[order], (len(top) - 1 - order).astype(np.int32)


def _least(n: int | Column) -> int | Column:
    """How many shingles the prefixes of similar sets share at least, if the smaller set has ``n`` and the overlap is not less."""
    return LEAST + n // LEAST_PER if isinstance(n, int) else F.lit(LEAST) + F.floor(n / LEAST_PER)


def prefix_of(found: np.ndarray, similarity: float, hashes: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """The first shingles of a set, common ones last: two sets of at least this similarity share ``_least`` of them.

    Their overlap is at least ``similarity`` times the size of either, and the k-th shingle of
    the overlap has all of it but k behind it, so a set may leave out all but k of that.
    """
    if len(hashes):
        at = np.minimum(np.searchsorted(hashes, found), len(hashes) - 1)
        order = np.where(hashes[at] == found, ranks[at], -1)
        found = found[np.argsort(order, kind="stable")]
    return found[: len(found) - math.ceil(similarity * len(found) - 1e-9) + _least(len(found))]


def _postings(texts: DataFrame, similarity: float, size: int, common: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(h, node, at, n): the prefix of every text of ``texts`` (node, text), each shingle's place in it from 1 on, and how many shingles the text has."""
    hashes, ranks = common

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        every = [(prefix_of(s, similarity, hashes, ranks), len(s)) for s in _sets(batch.column(1), size)]
        counts = np.array([len(p) for p, _ in every])
        rows = pa.array(np.repeat(np.arange(len(every)), counts))
        places = np.concatenate([np.arange(1, c + 1, dtype=np.int32) for c in counts])
        sizes = np.repeat(np.array([n for _, n in every], np.int32), counts)
        return pa.record_batch(
            [pa.array(np.concatenate([p for p, _ in every])), batch.column(0).take(rows), pa.array(places), pa.array(sizes)],
            ["h", "node", "at", "n"],
        )

    return map_batches(texts, work, "h bigint, node bigint, at int, n int")


def _across(shared: DataFrame, similarity: float, star: bool) -> DataFrame:
    """(src, dst): pairs of texts of different groups that may be of this similarity by their sizes and the postings they share.

    All of them, or with ``star`` only pairs with the first text of a posting. Of a pair that must share k
    of an overlap of at least m, the k-th shared shingle has m - k others behind it in either text, so
    postings that stand later do not meet.
    """
    other = F.struct("group", "node", "n", "at")
    if star:
        both = shared.withColumn("o", F.min(other).over(Window.partitionBy("h"))).where(F.col("group") != F.col("o.group"))
    else:
        both = shared.join(shared.select("h", other.alias("o")), "h").where(F.col("group") < F.col("o.group"))
    less, more = F.least("n", "o.n"), F.greatest("n", "o.n")
    overlap = F.ceil(similarity / (1 + similarity) * (less + more) - 1e-6)
    enough = F.least(_least(less), overlap)
    fits = (less >= similarity * more - 1e-6) & (F.least(F.col("n") - F.col("at"), F.col("o.n") - F.col("o.at")) >= overlap - enough)
    pairs = both.where(fits).groupBy(F.col("node").alias("src"), F.col("o.node").alias("dst"), enough.alias("enough"))
    return pairs.agg(F.count("*").alias("hits")).where(F.col("hits") >= F.col("enough")).select("src", "dst")


def parities(found: np.ndarray) -> np.ndarray:
    """Bits that say of a set's shingles, dealt out by hash, whether their number is odd; two to four bits a shingle, a power of two, 64 at least.

    Two sets differ in at least as many shingles as bits. The halves of the bits, put together by exclusive-or, are those of half as many.
    """
    size = max(64, 1 << (2 * len(found) - 1).bit_length())
    odd = (np.bincount(found.view(np.uint64) & np.uint64(size - 1), minlength=size) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view(np.int64)


def _halved(bits: Column, size: Column) -> Column:
    """``bits`` as ``size`` numbers, if they are twice as many."""
    half = F.zip_with(F.slice(bits, F.lit(1), size), F.slice(bits, size + 1, size), lambda x, y: x.bitwiseXOR(y))
    return F.when(F.size(bits) > size, half).otherwise(bits)


def _possible(texts: DataFrame, pairs: DataFrame, similarity: float, size: int) -> DataFrame:
    """Those of the written ``pairs`` whose texts may have the similarity by their ``parities``, none of those that have it left out."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        every = list(_sets(batch.column(1), size))
        lists = pa.array([parities(s) for s in every], pa.list_(pa.int64()))
        return pa.record_batch([batch.column(0), pa.array([len(s) for s in every], pa.int32()), lists], ["node", "n", "p"])

    bits = cut_lineage(map_batches(_ends_of(texts, pairs), work, "node bigint, n int, p array<bigint>"), "parities")
    sides = [bits.select(F.col("node").alias(end), F.struct("n", "p").alias(name)) for end, name in (("src", "a"), ("dst", "b"))]
    both = pairs.join(sides[0], "src").join(sides[1], "dst")
    words = F.least(F.size("a.p"), F.size("b.p"))
    # Sizes that fit are nearer than one to two, so bits are at most halved once.
    differ = F.zip_with(_halved(F.col("a.p"), words), _halved(F.col("b.p"), words), lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    near = F.aggregate(differ, F.lit(0), lambda t, x: t + x) <= (1 - similarity) / (1 + similarity) * (F.col("a.n") + F.col("b.n")) + 1e-6
    fits = F.least("a.n", "b.n") >= similarity * F.greatest("a.n", "b.n") - 1e-6
    return both.where(F.when(fits, near).otherwise(False)).select("src", "dst")


def _ends_of(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """The rows of ``texts`` (node, text) that the written ``pairs`` name."""
    asked = cut_lineage(pairs.select(F.explode(F.array("src", "dst")).alias("node")).distinct(), "asked")
    return rows_named(texts, asked, "node").select("node", "text")


def _similar(texts: DataFrame, pairs: DataFrame, similarity: float, size: int) -> DataFrame:
    """Those of the written ``pairs`` whose texts have the similarity, exactly; ``texts`` is (node, text).

    Sets of shingles travel only for pairs that their parities, a thirtieth of that size, leave possible.
    """

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.record_batch([batch.column(0), pa.array(list(_sets(batch.column(1), size)), pa.list_(pa.int64()))], ["node", "s"])

    pairs = cut_lineage(_possible(texts, pairs, similarity, size), "possible")
    sets = cut_lineage(map_batches(_ends_of(texts, pairs), work, "node bigint, s array<bigint>"), "shingles")
    both = pairs.join(sets.withColumnsRenamed({"node": "src", "s": "a"}), "src").join(sets.withColumnsRenamed({"node": "dst", "s": "b"}), "dst")
    overlap = F.size(F.array_intersect("a", "b"))
    return both.where(overlap >= similarity * (F.size("a") + F.size("b") - overlap)).select("src", "dst")


def _shared(held: DataFrame, by: str) -> DataFrame:
    """Postings whose shingle more than one ``by`` holds."""
    same = Window.partitionBy("h")
    ends = held.withColumns({"_low": F.min(by).over(same), "_high": F.max(by).over(same)})
    return ends.where("_low <> _high").drop("_low", "_high")


def _several(shared: DataFrame, similarity: float) -> DataFrame:
    """Postings of texts that have as many of them as any pair they could be in must share."""
    smallest = F.ceil(similarity * F.col("n") - 1e-6)
    enough = shared.groupBy("node", "n").count().where(F.col("count") >= F.least(_least(smallest), smallest))
    return shared.join(enough.select("node"), "node", "left_semi")


def _merged(known: DataFrame, found: DataFrame) -> DataFrame:
    """``known`` (node, group) after the links of ``found`` have joined groups; a group is its smallest node."""
    ends = [known.select(F.col("node").alias(end), F.col("group").alias(name)) for end, name in (("src", "a"), ("dst", "b"))]
    moved = components(found.join(ends[0], "src").join(ends[1], "dst").select("a", "b"), "a", "b")
    joined = known.join(moved.withColumnRenamed("id", "group"), "group", "left")
    return cut_lineage(joined.select("node", F.coalesce("component", "group").alias("group")), "groups")


def similar_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, size: int = STAGE_WORDS,
    radius: int = RADIUS, tile_rows: int = TILE_ROWS,
) -> DataFrame:
    """(id, group): rows whose texts are near-duplicates by the exact Jaccard similarity of their shingles, in classes.

    ``id_col`` must be unique; ``group`` is the smallest id of the class. Classes are those of all pairs
    of texts that reach the similarity. Equal texts are one node; texts without words are all equal, null ones too.

    First, fingerprints within ``radius`` bits propose links as a spanning forest, each decided by the
    exact similarity of its texts: this joins most near copies at about one comparison a text. What these
    leave apart is found by prefixes: texts of the similarity share some of the first shingles of
    their sets in any common order, here rarer ones first. Of these only pairs of texts in different groups are
    compared, twice with the first text of each shingle, so that a large group is not all its pairs, then every pair left.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    texts = docs.select(F.col(id_col).cast("bigint").alias("node"), text.alias("text"))
    rows = cut_lineage(fingerprints(docs, id_col, text_col, size).join(docs.select(F.col(id_col).alias("doc_id"), F.sha2(text, 256).alias("sha")), "doc_id"), "fingerprints")
    nodes = cut_lineage(rows.groupBy("sha", "fp").agg(F.min("doc_id").alias("node")), "texts")
    prints = cut_lineage(nodes.groupBy("fp").agg(F.min("node").alias("node")), "nodes")
    proposed = links(prints, radius, tile_rows, as_pairs=True)
    # Texts of one fingerprint are proposed to its first one.
    equal = nodes.join(prints.withColumnRenamed("node", "dst"), "fp").where(F.col("node") != F.col("dst")).select(F.col("node").alias("src"), "dst")
    proposed = cut_lineage(proposed.select("src", "dst").unionByName(equal).distinct(), "proposed")
    known = _merged(nodes.select("node", F.col("node").alias("group")), _similar(texts, proposed, similarity, size))

    common = _common_shingles(docs, text, size)
    held = _postings(rows_named(texts, known.select("node"), "node").select("node", "text"), similarity, size, common)
    shared = cut_lineage(_shared(held, "node"), "shared-shingles")
    shared = cut_lineage(_several(shared, similarity), "shared-shingles")
    star = 2
    while star >= 0:
        # Postings that groups share meet where they are dealt by shingle: they are not written and dealt once more.
        pairs = cut_lineage(_across(_shared(shared.join(known, "node"), "group"), similarity, star > 0), "proposed")
        found = cut_lineage(_similar(texts, pairs, similarity, size), "similar")
        some = not found.isEmpty()
        if some:
            known = _merged(known, found)
        # Where first texts bring nothing more, all pairs that are left are next.
        star = star - 1 if some or not star else 0
    return rows.select("doc_id", "sha").join(nodes.join(known, "node").select("sha", "group"), "sha").select(F.col("doc_id").alias(id_col), "group")
