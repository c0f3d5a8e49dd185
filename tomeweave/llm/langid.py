"""Language identification with a bidirectional gated recurrent network over bytes.

The network is trained in numpy by backpropagation through time on a bounded
sample of labelled texts. It gives every byte of a text a distribution over the
languages; a document's probabilities are their mean over its letters. Texts are
read whole, in stretches that overlap so that each position has seen its
surroundings.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tomeweave.llm.base import map_batches, text_bytes

UNKNOWN = "und"
MAX_LANGUAGES = 1_000
STRETCH = 120  # bytes that a stretch answers for
MARGIN = 8  # bytes read before and after them
BATCH = 1_024  # stretches side by side
LETTERS = np.zeros(256, bool)
LETTERS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


@dataclass(frozen=True)
class Settings:
    texts_per_language: int = 150  # bound of the training sample
    stretches_per_text: int = 6
    length: int = 48  # bytes of a training stretch
    hidden: int = 8
    steps: int = 240
    batch: int = 128
    rate: float = 0.02
    seed: int = 7


@dataclass
class Network:
    """Weights of both directions; gates in the order reset, update, candidate."""

    languages: list[str]
    inputs: list[np.ndarray]  # per direction (256, 3h): what each byte adds to the gates
    recurrent: list[np.ndarray]  # per direction (3h, h)
    out: np.ndarray  # (languages, 2h + 1), the last column is the bias


def run_direction(codes: np.ndarray, inputs: np.ndarray, recurrent: np.ndarray, keep: bool = False):
    """States (time, h, batch) of one direction over codes (time, batch); ``keep`` also what backpropagation needs.

    The batch is the last axis, so each gate is a contiguous block. Sigmoids are
    taken as 0.5 + 0.5 tanh(x / 2).
    """
    steps, n = codes.shape
    h = recurrent.shape[1]
    by_gate = np.ascontiguousarray(inputs.T)
    states = np.empty((steps, h, n), np.float32)
    state = np.zeros((h, n), np.float32)
    given, own = np.empty((3 * h, n), np.float32), np.empty((3 * h, n), np.float32)
    kept = []
    for t in range(steps):
        np.take(by_gate, codes[t], axis=1, out=given, mode="clip")
        np.matmul(recurrent, state, out=own)
        gates = given[: 2 * h]
        gates += own[: 2 * h]
        gates *= 0.5
        np.tanh(gates, out=gates)
        gates *= 0.5
        gates += 0.5
        candidate = given[2 * h :]
        candidate += gates[:h] * own[2 * h :]
        np.tanh(candidate, out=candidate)
        if keep:
            kept.append((state, own[2 * h :].copy(), gates[:h].copy(), gates[h:].copy(), candidate.copy()))
        after = states[t]
        np.subtract(state, candidate, out=after)
        after *= gates[h:]
        after += candidate
        state = after
    return (states, kept) if keep else states


def back_direction(codes, grads, kept, inputs, recurrent):
    """Gradients of the inputs table and the recurrent weights by backpropagation through time."""
    d_inputs, d_recurrent = np.zeros_like(inputs), np.zeros_like(recurrent)
    carry = np.zeros_like(grads[0])
    for t in range(len(codes) - 1, -1, -1):
        before, own, reset, update, candidate = kept[t]
        d_state = grads[t] + carry
        d_candidate = d_state * (1 - update) * (1 - candidate**2)
        d_update = d_state * (before - candidate) * update * (1 - update)
        d_reset = d_candidate * own * reset * (1 - reset)
        d_own = np.concatenate([d_reset, d_update, d_candidate * reset])
        np.add.at(d_inputs, codes[t], np.concatenate([d_reset, d_update, d_candidate]).T)
        d_recurrent += d_own @ before.T
        carry = d_state * update + recurrent.T @ d_own
    return d_inputs, d_recurrent


def probabilities(net: Network, ahead: np.ndarray, behind: np.ndarray) -> np.ndarray:
    """(languages, batch) at one place, from the states of both directions there."""
    h = len(ahead)
    score = net.out[:, :h] @ ahead
    score += net.out[:, h:-1] @ behind
    score += net.out[:, -1:]
    score -= score.max(0)
    np.exp(score, out=score)
    score /= score.sum(0)
    return score


def both_directions(net: Network, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    ahead = run_direction(codes, net.inputs[0], net.recurrent[0])
    behind = run_direction(codes[::-1], net.inputs[1], net.recurrent[1])[::-1]
    return ahead, behind


def train(stretches: np.ndarray, labels: np.ndarray, languages: list[str], settings: Settings = Settings()) -> Network:
    """Fit on stretches (n, length) of bytes with a language number each; every position carries the label."""
    rng = np.random.default_rng(settings.seed)
    h, k = settings.hidden, len(languages)
    draw = lambda *shape: rng.normal(0, 0.3, shape).astype(np.float32)
    net = Network(languages, [draw(256, 3 * h), draw(256, 3 * h)], [draw(3 * h, h), draw(3 * h, h)], draw(k, 2 * h + 1))
    weights = [*net.inputs, *net.recurrent, net.out]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    groups = [np.flatnonzero(labels == c) for c in range(k)]
    groups = [g for g in groups if len(g)]
    for step in range(1, settings.steps + 1):
        # The same number of stretches of each language, however unlike their shares are.
        rows = np.concatenate([rng.choice(g, -(-settings.batch // len(groups))) for g in groups])
        codes, truth = np.ascontiguousarray(stretches[rows].T), labels[rows]
        ahead, kept_a = run_direction(codes, net.inputs[0], net.recurrent[0], keep=True)
        behind, kept_b = run_direction(codes[::-1], net.inputs[1], net.recurrent[1], keep=True)
        states = np.concatenate([ahead, behind[::-1]], 1)
        grad = np.stack([probabilities(net, x[:h], x[h:]) for x in states])
        grad[:, truth, np.arange(len(rows))] -= 1
        grad /= codes.size
        d_out = np.concatenate([np.einsum("tkn,thn->kh", grad, states), grad.sum((0, 2))[:, None]], 1)
        d_states = net.out[:, :-1].T @ grad
        a_in, a_rec = back_direction(codes, d_states[:, :h], kept_a, net.inputs[0], net.recurrent[0])
        b_in, b_rec = back_direction(codes[::-1], d_states[::-1, h:], kept_b, net.inputs[1], net.recurrent[1])
        rate = settings.rate * min(1.0, 2 * (1 - step / (settings.steps + 1)))
        for w, g, m, v in zip(weights, [a_in, b_in, a_rec, b_rec, d_out], first, second, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return net


# ------------------------------------------------------------------ sampling
def held_out(id_col: Column) -> Column:
    """Documents that training never sees."""
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def fit(docs: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Network | None:
    """Train on at most ``texts_per_language`` texts of every language that are not held out; None without any.

    All labelled documents are counted and hashed; those with the smallest hashes of a language are taken.
    """
    text = F.col(text_col)
    rows = docs.where(~held_out(F.col(id_col)) & F.col(lang_col).isNotNull() & (F.length(text) >= 60))
    rows = rows.select(F.col(lang_col).alias("lang"), F.col(id_col).alias("id"), F.xxhash64(F.col(id_col).cast("string")).alias("h"))
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().limit(MAX_LANGUAGES + 1).collect()}
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not counts:
        return None
    # A share of the hash range that holds about twice the texts wanted; a language with few texts is taken whole.
    top = {lang: int((min(1.0, 2 * settings.texts_per_language / n) - 0.5) * (2**64 - 1)) for lang, n in counts.items()}
    bound = F.create_map(*[F.lit(x) for lang, b in sorted(top.items()) for x in (lang, max(-(2**63), min(b, 2**63 - 1)))])
    few = rows.where(F.col("h") <= F.element_at(bound, F.col("lang")))
    chosen: dict[str, list[tuple[int, int]]] = {}
    for r in few.dropDuplicates(["id"]).collect():
        chosen.setdefault(r["lang"], []).append((r["h"], r["id"]))
    wanted = [i for found in chosen.values() for _, i in sorted(found)[: settings.texts_per_language]]
    taken = docs.where(F.col(id_col).isin(wanted)).select(
        F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.left(text, F.lit(20_000)).alias("text")
    ).dropDuplicates(["id"]).toPandas().sort_values("id")
    languages = sorted(chosen)
    rng = np.random.default_rng(settings.seed)
    stretches, labels = [], []
    for lang, text_ in zip(taken["lang"], taken["text"], strict=True):
        data = np.frombuffer((text_ or "").encode(), np.uint8)
        for at in rng.integers(0, max(1, len(data) - settings.length + 1), settings.stretches_per_text):
            part = data[at : at + settings.length]
            stretches.append(np.pad(part, (0, settings.length - len(part)), constant_values=32))
            labels.append(languages.index(lang))
    return train(np.array(stretches), np.array(labels), languages, settings)


# ---------------------------------------------------------------- prediction
def read_stretches(net: Network, texts: list[bytes]) -> Iterator[tuple[np.ndarray, ...]]:
    """Batches of stretches: (text, first place, bytes (time, batch), whether inside the text, states ahead, behind).

    Every byte of every text is inside exactly one stretch.
    """
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    owner = np.repeat(np.arange(len(texts)), -(-sizes // STRETCH))
    begin = np.concatenate([np.zeros(0, np.int64), *[np.arange(0, n, STRETCH) for n in sizes]])
    flat = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    reach = np.minimum(sizes[owner] - begin, STRETCH)
    # Short stretches together, so that little time goes into what is past the end of a text.
    order = np.argsort(reach, kind="stable")
    for k in range(0, len(order), BATCH):
        rows = order[k : k + BATCH]
        width = int(reach[rows].max())
        place = begin[rows] + np.arange(-MARGIN, width + MARGIN)[:, None]
        there = (place >= 0) & (place < sizes[owner[rows]])
        codes = np.where(there, flat[np.clip(starts[owner[rows]] + place, 0, len(flat) - 1)], 32)
        ahead, behind = both_directions(net, codes)
        own = slice(MARGIN, MARGIN + width)
        yield owner[rows], begin[rows], codes[own], there[own] & (np.arange(width)[:, None] < reach[rows]), ahead[own], behind[own]


def pooled(net: Network, texts: list[bytes]) -> np.ndarray:
    """Mean probabilities over the letters of each text; zeros for a text without."""
    total = np.zeros((len(texts), len(net.languages)))
    count = np.zeros(len(texts))
    for owner, _, codes, inside, ahead, behind in read_stretches(net, texts):
        letter = (LETTERS[codes] & inside).astype(np.float32)
        summed = np.zeros((len(net.languages), len(owner)))
        for t in range(len(codes)):
            summed += probabilities(net, ahead[t], behind[t]) * letter[t]
        count += np.bincount(owner, letter.sum(0), len(texts))
        for c in range(len(net.languages)):
            total[:, c] += np.bincount(owner, summed[c], len(texts))
    return total / np.maximum(count, 1)[:, None]


def predict(docs: DataFrame, net: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) for every row; only the text is looked at.

    ``und`` with score 0 for a null text, one without letters, or without a
    network. Of equal probabilities the language that sorts first wins. Repeated
    rows are answered alike; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net)
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.when(text.rlike("\\p{L}"), text).alias("text"))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        model = shared.value
        ends, raw = text_bytes(batch.column(1))
        texts = [raw[ends[k] : ends[k + 1]].tobytes() for k in range(batch.num_rows)]
        names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        some = [k for k, t in enumerate(texts) if t] if model else []
        for first in range(0, len(some), 256):
            part = some[first : first + 256]
            for k, p in zip(part, pooled(model, [texts[k] for k in part]), strict=True):
                best = int(p.argmax())
                names[k], scores[k] = model.languages[best], min(1.0, float(p[best]))
        return pa.record_batch([batch.column(0), pa.array(names), pa.array(scores)], ["doc_id", "lang_pred", "score"])

    return map_batches(rows, work, "doc_id bigint, lang_pred string, score double")


def label_spans(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, end, lang): runs of bytes with one label; every position of every text is in one run."""
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for frame in frames:
            for doc, text in zip(frame["doc_id"], frame["text"], strict=True):
                data = text.encode()
                label = np.zeros(len(data), np.int64)
                for _, begin, codes, inside, ahead, behind in read_stretches(model, [data]):
                    for t in range(len(codes)):
                        best = probabilities(model, ahead[t], behind[t]).argmax(0)
                        label[begin[inside[t]] + t] = best[inside[t]]
                cuts = np.concatenate([[0], np.flatnonzero(np.diff(label)) + 1])
                ends = np.append(cuts[1:], len(data))
                yield pd.DataFrame({"doc_id": doc, "start": cuts, "end": ends, "lang": [model.languages[x] for x in label[cuts]]})

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("text <> ''")
    return rows.mapInPandas(work, "doc_id bigint, start bigint, end bigint, lang string")
