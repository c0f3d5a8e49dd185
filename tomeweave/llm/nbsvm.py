"""Quality classifier: naive Bayes features in a linear support vector machine.

A text is the set of its n-grams: byte runs of one to three, and runs of one and
two words, where a word that repeats the one before it stands as a mark of
repetition. Indicators are scaled by the log ratio of their smoothed counts in
the two classes, brought to unit length, and a linear model with hinge loss is
fitted to them by dual coordinate descent. Margins become scores by a sigmoid
that is fitted to margins of texts the model had not seen.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tomeweave.llm.base import map_batches, text_bytes
from tomeweave.session import cut_lineage

BUCKETS = 1 << 18
PER_CLASS = 2_000  # labelled texts of each class that the model is fitted to, at most
SMOOTHING = 1.0
COST = 1.0
ROUNDS = 60
FOLDS = 3
TOLERANCE = 1e-3
THRESHOLD = 0.7
SEED = 42
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
ODD = np.uint64(0x9E3779B97F4A7C15)
REPEAT = np.uint64(0x5BD1E995)


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def _mixed(keys: np.ndarray, order: int) -> np.ndarray:
    keys = (keys ^ np.uint64(order)) * ODD
    return ((keys ^ (keys >> np.uint64(29))) * ODD >> np.uint64(40)).astype(np.int64)


def ngrams(raw: np.ndarray, buckets: int = BUCKETS) -> np.ndarray:
    """Buckets of all n-grams of one text's bytes, repeats included."""
    if not len(raw):
        return np.zeros(0, np.int64)
    byte = raw.astype(np.uint64)
    runs = [byte]
    for k in (1, 2):
        if len(raw) > k:
            runs.append(runs[-1][:-1] << np.uint64(8) | byte[k:])
    found = [_mixed(run, k + 1) for k, run in enumerate(runs)]
    inside = np.concatenate([[False], ~SPACE[raw], [False]])
    starts, ends = np.flatnonzero(inside[1:] & ~inside[:-1]), np.flatnonzero(inside[:-1] & ~inside[1:])
    if len(starts):
        # A word's key: its bytes as digits of a polynomial, summed between its ends.
        with np.errstate(over="ignore"):
            power = np.full(len(raw), ODD | np.uint64(1))
            power[0] = 1
            power = np.multiply.accumulate(power)
            sums = np.concatenate([np.zeros(1, np.uint64), np.add.accumulate((byte + np.uint64(1)) * power)])
            # Divided by the power of its place, so that equal words have equal keys wherever they stand.
            inverse = np.uint64(pow(int(ODD), -1, 1 << 64))
            back = np.full(len(raw), inverse)
            back[0] = 1
            back = np.multiply.accumulate(back)
            words = (sums[ends] - sums[starts]) * back[starts]
        same = np.zeros(len(words), bool)
        same[1:] = words[1:] == words[:-1]
        words = np.where(same, REPEAT, words)
        found.append(_mixed(words, 4))
        if len(words) > 1:
            found.append(_mixed(words[:-1] * ODD ^ (words[1:] + (words[1:] >> np.uint64(31))), 5))
    return np.concatenate(found) % buckets


def indicators(raw: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Every bucket of a text once. ``last`` is scratch space of one number a bucket; what it holds does not matter."""
    keys = ngrams(raw, len(last))
    at = np.arange(len(keys))
    last[keys] = at
    return keys[last[keys] == at]


@dataclass(frozen=True)
class Model:
    """Weight of each bucket's indicator, squared lengths, bias, and the sigmoid; no weights stand for no labels of one class."""

    weights: np.ndarray | None  # ratio times fitted weight
    squares: np.ndarray | None  # squared ratio: what an indicator adds to a text's squared length
    bias: float
    slope: float
    shift: float
    prior: float

    def score(self, keys: np.ndarray) -> float:
        if self.weights is None:
            return self.prior
        length = float(self.squares[keys].sum())
        margin = self.bias + (float(self.weights[keys].sum()) / length**0.5 if length else 0.0)
        return float(1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -500, 500))))


def log_ratios(rows: list[np.ndarray], labels: np.ndarray, buckets: int) -> np.ndarray:
    """log((p / |p|) / (q / |q|)) of the smoothed indicator counts p, q of the classes."""
    counts = [np.full(buckets, SMOOTHING) for _ in range(2)]
    for keys, y in zip(rows, labels, strict=True):
        counts[int(y > 0)][keys] += 1
    q, p = counts
    return np.log(p / p.sum()) - np.log(q / q.sum())


def dual_descent(rows: list[np.ndarray], values: list[np.ndarray], labels: np.ndarray, buckets: int, cost: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
    """(weights, bias, dual variables) that minimise |w|^2 / 2 + sum of cost * max(0, 1 - y w x).

    One dual variable at a time is set to its best value within its box, texts in
    a new order each round; the bias is the weight of one more entry that is 1 in
    every text.
    """
    w, bias, alpha = np.zeros(buckets), 0.0, np.zeros(len(rows))
    norm = np.array([float(v @ v) + 1.0 for v in values])
    rng = np.random.default_rng(SEED)
    for _ in range(ROUNDS):
        worst = 0.0
        for i in rng.permutation(len(rows)):
            y = labels[i]
            gradient = y * (float(w[rows[i]] @ values[i]) + bias) - 1.0
            free = min(gradient, 0.0) if alpha[i] <= 0 else max(gradient, 0.0) if alpha[i] >= cost[i] else gradient
            worst = max(worst, abs(free))
            if free:
                new = min(max(alpha[i] - gradient / norm[i], 0.0), cost[i])
                step = (new - alpha[i]) * y
                alpha[i] = new
                w[rows[i]] += step * values[i]
                bias += step
        if worst < TOLERANCE:
            break
    return w, bias, alpha


def _sigmoid_of(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """(slope, shift) of the most likely sigmoid, targets drawn in by the class sizes; Newton steps."""
    pos, neg = float((labels > 0).sum()), float((labels < 0).sum())
    target = np.where(labels > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -500, 500)))
        v = p * (1 - p) + 1e-12
        g = np.array([((p - target) * margins).sum(), (p - target).sum()])
        h = np.array([[(v * margins * margins).sum(), (v * margins).sum()], [(v * margins).sum(), v.sum()]]) + 1e-6 * np.eye(2)
        step = np.linalg.solve(h, g)
        step *= min(1.0, 4.0 / max(1e-12, np.abs(step).max()))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return max(a, 1e-3), b


def train(rows: list[np.ndarray], labels: np.ndarray, buckets: int = BUCKETS) -> Model:
    """Fit to sets of buckets with labels 1 and -1."""
    pos, neg = int((labels > 0).sum()), int((labels < 0).sum())
    if not pos or not neg:
        return Model(None, None, 0.0, 1.0, 0.0, 1.0 if pos else 0.0 if neg else 0.5)

    def fitted(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        some, y = [rows[i] for i in at], labels[at]
        ratio = log_ratios(some, y, buckets)
        lengths = [float((ratio[k] ** 2).sum()) ** 0.5 or 1.0 for k in some]
        values = [ratio[k] / n for k, n in zip(some, lengths, strict=True)]
        share = np.where(y > 0, len(y) / (2 * max(1, (y > 0).sum())), len(y) / (2 * max(1, (y < 0).sum())))
        w, bias, _ = dual_descent(some, values, y, buckets, COST * share)
        return ratio * w, ratio**2, bias

    fold = np.random.default_rng(SEED).permutation(len(rows)) % FOLDS
    margins = np.zeros(len(rows))
    for f in range(FOLDS):
        learn = np.flatnonzero(fold != f)
        if len({*labels[learn].tolist()}) < 2:
            learn = np.arange(len(rows))
        weights, squares, bias = fitted(learn)
        plain = Model(weights, squares, bias, 1.0, 0.0, 0.5)
        for i in np.flatnonzero(fold == f):
            p = plain.score(rows[i])
            margins[i] = np.log(max(p, 1e-12)) - np.log(max(1 - p, 1e-12))
    slope, shift = _sigmoid_of(margins, labels)
    weights, squares, bias = fitted(np.arange(len(rows)))
    return Model(weights, squares, bias, slope, shift, 0.5)


def _texts(batch: pa.RecordBatch, name: str) -> Iterator[np.ndarray]:
    ends, raw = text_bytes(batch.column(name))
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        yield raw[a:b]


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = PER_CLASS, buckets: int = BUCKETS) -> Model:
    """Learn from labelled rows outside the held-out quarter.

    At most ``per_class`` labels of each class are used, those with the smallest
    hash of their id; their texts are whole. Labels that are neither 0 nor 1, null ids
    and ids without a text are passed over. An id with two labels, or two texts, counts
    for each. Labels of one class alone give a constant score, none at all 0.5.
    """
    usable = labels.select(F.col("doc_id").alias("_id"), F.col(label).alias("_y")).where(~held_out(F.col("_id")) & F.col("_id").isNotNull())
    order = (F.xxhash64("_id"), F.col("_id"))
    classes = [usable.where(F.col("_y") == y).orderBy(*order).limit(per_class) for y in (0, 1)]
    # Written, and 2 * per_class rows at most: safe to broadcast whatever the labels' size.
    chosen = F.broadcast(cut_lineage(classes[0].unionByName(classes[1]), "chosen-labels"))
    texts = docs.select(F.col("doc_id").alias("_id"), F.coalesce("text", F.lit("")).alias("_text")).join(chosen, "_id").select("_y", "_text")

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        last = np.zeros(buckets, np.int64)
        keys = pa.array([indicators(raw, last).astype(np.int32) for raw in _texts(batch, "_text")], pa.list_(pa.int32()))
        return pa.RecordBatch.from_arrays([batch.column("_y").cast(pa.int32()), keys], ["y", "keys"])

    found = map_batches(texts, work, "y int, keys array<int>").toArrow()
    # The same order however tasks end: by label and the set itself.
    rows = sorted(
        ((int(y), np.sort(np.asarray(k, np.int64))) for y, k in zip(found["y"].to_pylist(), found["keys"].to_pylist(), strict=True)),
        key=lambda row: (row[0], row[1].tobytes()),
    )
    return train([k for _, k in rows], np.array([1.0 if y else -1.0 for y, _ in rows]), buckets)


def predict(docs: DataFrame, model: Model, buckets: int = BUCKETS, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id``, ``score`` (0 to 1, higher: label 1 is likelier) and ``predicted`` of every row.

    Only the text is looked at. A null or empty text has no n-grams and gets the score
    of the bias alone. Equal texts have equal scores; a score equal to the threshold
    is predicted 1. Other columns do not matter; an empty table gives no rows.
    """

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        last = np.zeros(buckets, np.int64)
        scores = pa.array([model.score(indicators(raw, last)) for raw in _texts(batch, "_text")], pa.float64())
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), scores], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("_text"))
    found = map_batches(texts, work, f"doc_id {kind}, score double")
    return found.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
