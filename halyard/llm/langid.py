"""Language identification by a bidirectional gated recurrent network over bytes.

The network labels every byte position of a text with a distribution over the
learned languages; a document's probabilities are the mean over its positions.
It is trained in numpy by backpropagation through time on windows from a
bounded sample of labelled documents. A text is read whole, in segments whose
states start anew, many segments side by side.

Defined results
    null text or one without a letter: ``und`` with score 0; null lang: not
    learned from, but predicted; no labelled row: everything ``und``; one
    label: that one with score 1; ties: the first label in text order;
    repeated rows: predicted each, learned from once; rows that share a doc_id:
    like any others; very long texts: read whole, in segments; null doc_id:
    held_out as for empty text;
    empty table: no rows; further columns: left out by ``predict``, kept by
    ``keep_identified``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import crc_mod

UNKNOWN = "und"
#: Labelled rows of each language that are learned from, windows taken from each and their characters.
SAMPLE_DOCS, SAMPLE_WINDOWS, WINDOW = 400, 4, 96
#: Bytes of a segment and segments read side by side.
SEGMENT, LANES = 128, 2048
LETTER = r"\p{L}"
PREDICTED = "doc_id long, held_out boolean, lang_pred string, score double"


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.multiply(x, 0.5, out=x)
    np.tanh(x, out=x)
    x += 1
    x *= 0.5
    return x


@dataclass
class Model:
    """inputs[d]: 256 x 3H contributions of a byte to update, reset and candidate; states[d]: H x 3H; both for d = forward, backward."""

    inputs: list[np.ndarray]
    states: list[np.ndarray]
    out: np.ndarray
    bias: np.ndarray
    labels: list[str]

    def parameters(self) -> list[np.ndarray]:
        return [*self.inputs, *self.states, self.out, self.bias]


def new_model(labels: list[str], hidden: int, rng: np.random.Generator) -> Model:
    draw = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
    inputs = [draw(256, 3 * hidden, scale=0.3) for _ in range(2)]
    states = [draw(hidden, 3 * hidden, scale=hidden**-0.5) for _ in range(2)]
    return Model(inputs, states, draw(2 * hidden, len(labels), scale=0.3), np.zeros(len(labels), np.float32), labels)


def _run(x: np.ndarray, mask: np.ndarray | None, inputs: np.ndarray, states: np.ndarray, back: bool, keep: list | None):
    """States after each position, T x lanes x H; x is T x lanes bytes, mask 1 where a byte stands."""
    steps, lanes = x.shape
    hidden = states.shape[0]
    out = np.empty((steps, lanes, hidden), np.float32)
    h = np.zeros((lanes, hidden), np.float32)
    for t in range(steps - 1, -1, -1) if back else range(steps):
        a = inputs[x[t]]
        u = h @ states
        gates = _sigmoid(a[:, : 2 * hidden] + u[:, : 2 * hidden])
        z, r = gates[:, :hidden], gates[:, hidden:]
        q = u[:, 2 * hidden :]
        n = r * q
        n += a[:, 2 * hidden :]
        np.tanh(n, out=n)
        new = h - n
        new *= z
        new += n
        if mask is not None:
            new = h + mask[t][:, None] * (new - h)
        if keep is not None:
            keep.append((t, h, z, r, q, n))
        out[t] = h = new
    return out


def _softmax(logits: np.ndarray) -> np.ndarray:
    logits -= logits.max(axis=-1, keepdims=True)
    np.exp(logits, out=logits)
    logits /= logits.sum(axis=-1, keepdims=True)
    return logits


def probabilities(model: Model, x: np.ndarray, mask: np.ndarray | None) -> np.ndarray:
    """T x lanes x labels."""
    states = [_run(x, mask, model.inputs[d], model.states[d], bool(d), None) for d in range(2)]
    hidden = model.states[0].shape[0]
    logits = states[0] @ model.out[:hidden]
    logits += states[1] @ model.out[hidden:]
    logits += model.bias
    return _softmax(logits)


def gradients(model: Model, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean loss over positions and its gradient for each parameter."""
    hidden, (steps, lanes) = model.states[0].shape[0], x.shape
    keeps: list[list] = [[], []]
    states = [_run(x, mask, model.inputs[d], model.states[d], bool(d), keeps[d]) for d in range(2)]
    both = np.concatenate(states, axis=2)
    prob = _softmax(both @ model.out + model.bias)
    total = mask.sum()
    picked = prob[:, np.arange(lanes), y]
    loss = float(-(np.log(picked + 1e-9) * mask).sum() / total)
    d_logit = prob
    d_logit[:, np.arange(lanes), y] -= 1
    d_logit *= (mask / total)[:, :, None]
    flat = d_logit.reshape(-1, d_logit.shape[2])
    d_out, d_bias = both.reshape(-1, 2 * hidden).T @ flat, flat.sum(axis=0)
    d_both = d_logit @ model.out.T
    d_inputs, d_states = [], []
    for d in range(2):
        u, d_in = model.states[d], np.zeros((steps, lanes, 3 * hidden), np.float32)
        d_u, dh = np.zeros_like(u), np.zeros((lanes, hidden), np.float32)
        for t, h, z, r, q, n in reversed(keeps[d]):
            dh = dh + d_both[t][:, d * hidden : (d + 1) * hidden]
            m = mask[t][:, None]
            new = dh * m
            da = d_in[t]
            da[:, 2 * hidden :] = new * (1 - z) * (1 - n * n)
            da[:, :hidden] = new * (h - n) * z * (1 - z)
            da[:, hidden : 2 * hidden] = da[:, 2 * hidden :] * q * r * (1 - r)
            du = da.copy()
            du[:, 2 * hidden :] *= r
            d_u += h.T @ du
            dh = dh * (1 - m) + new * z + du @ u.T
        byte, cells = x.ravel(), d_in.reshape(-1, 3 * hidden)
        d_inputs.append(np.stack([np.bincount(byte, weights=c, minlength=256) for c in cells.T], axis=1).astype(np.float32))
        d_states.append(d_u)
    return loss, [*d_inputs, *d_states, d_out, d_bias]


def padded(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Texts, cut to width, as columns of bytes, and where bytes stand."""
    x = np.zeros((width, len(texts)), np.uint8)
    mask = np.zeros((width, len(texts)), np.float32)
    for i, t in enumerate(texts):
        x[: len(t), i] = np.frombuffer(t[:width], np.uint8)
        mask[: len(t), i] = 1
    return x, mask


def train(
    windows: list[tuple[str, bytes]], hidden: int = 8, steps: int = 350, batch: int = 256, rate: float = 0.02,
    seed: int = 7, width: int = 64,
) -> Model:
    """Fit a model to (label, bytes) windows, languages drawn evenly, by Adam."""
    labels = sorted({lang for lang, _ in windows})
    rng = np.random.default_rng(seed)
    model = new_model(labels, hidden, rng)
    by = [[t for lang, t in windows if lang == label and t] or [b" "] for label in labels]
    params = model.parameters()
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, steps + 1):
        y = rng.integers(len(labels), size=batch)
        texts = []
        for k in y:
            t = by[k][rng.integers(len(by[k]))]
            at = rng.integers(max(1, len(t) - width + 1))
            texts.append(t[at : at + width])
        x, mask = padded(texts, width)
        _, grads = gradients(model, x, mask, y)
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
        now = rate * min(1.0, 3.0 * (steps - step + 1) / steps) * min(1.0, 1.0 / (norm + 1e-9))
        for p, g, a, b in zip(params, grads, first, second, strict=True):
            a += 0.1 * (g - a)
            b += 0.005 * (g * g - b)
            p -= now * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.995**step)) + 1e-8)
    return model


def document_probabilities(model: Model, texts: list[bytes]) -> np.ndarray:
    """Mean position probabilities of each text, texts x labels; rows of empty texts are 0."""
    sums = np.zeros((len(texts), len(model.labels)))
    parts = [-(-len(t) // SEGMENT) for t in texts]
    doc = np.repeat(np.arange(len(texts)), parts)
    data = np.zeros((len(doc), SEGMENT), np.uint8)
    size = np.full(len(doc), SEGMENT, np.int64)
    at = 0
    for t, n in zip(texts, parts, strict=True):
        if n:
            data[at : at + n].reshape(-1)[: len(t)] = np.frombuffer(t, np.uint8)
            size[at + n - 1] = len(t) - (n - 1) * SEGMENT
            at += n
    for whole in (True, False):
        chosen = np.flatnonzero((size == SEGMENT) == whole)
        chosen = chosen[np.argsort(size[chosen], kind="stable")]
        for k in range(0, len(chosen), LANES):
            rows = chosen[k : k + LANES]
            width = int(size[rows].max())
            x = np.ascontiguousarray(data[rows, :width].T)
            mask = None if whole else (np.arange(width)[:, None] < size[rows]).astype(np.float32)
            prob = probabilities(model, x, mask)
            prob = prob.sum(axis=0) if whole else (prob * mask[:, :, None]).sum(axis=0)
            np.add.at(sums, doc[rows], prob)
    return sums / np.maximum(1, np.array([len(t) for t in texts]))[:, None]


def sample_windows(
    labelled: DataFrame, docs_per_label: int = SAMPLE_DOCS, windows: int = SAMPLE_WINDOWS, width: int = WINDOW
) -> list[tuple[str, bytes]]:
    """Windows of at most docs_per_label distinct rows of each lang, those with the smallest hashes of doc_id and text.

    A share of the distinct rows by hash, three times as many as wanted, is cut
    out before rows are ranked, so that what meets of a language is bounded too.
    Rows that repeat don't count, or a language of few rows repeated often would
    have no share; the number of distinct rows is estimated within some 5 %.
    """
    rows = labelled.filter("lang is not null and text is not null").select("lang", "text", F.xxhash64("doc_id", "text").alias("h"))
    counts = rows.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).collect()
    if not counts:
        return []
    pairs = [F.lit(x) for r in counts for x in (r["lang"], min(1.0, 3.0 * docs_per_label / r["n"]))]
    room = F.greatest(F.char_length("text") - width, F.lit(0)) + 1
    cuts = [
        F.substring(F.col("text"), (F.pmod(F.xxhash64("h", F.lit(j)), room) + 1).cast("int"), F.lit(width))
        for j in range(windows)
    ]
    share = F.pmod(F.col("h"), F.lit(1 << 50)) / (1 << 50)
    few = (
        rows
        .filter(share < F.element_at(F.create_map(*pairs), F.col("lang"))).select("lang", "h", F.array(*cuts).alias("w"))
        .groupBy("lang", "h").agg(F.first("w").alias("w"))
    )
    order = Window.partitionBy("lang").orderBy("h")
    taken = few.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= docs_per_label).collect()
    taken.sort(key=lambda r: (r["lang"], r["k"]))
    return [(r["lang"], w.encode()) for r in taken for w in r["w"]]


def _labeller(windows: list[tuple[str, bytes]], **how):
    """A function from texts and whether they have a letter to languages and scores."""
    model = train(windows, **how) if len({w[0] for w in windows}) > 1 else None
    only = windows[0][0] if windows else UNKNOWN

    def label(texts: list[bytes | None], letter: list[bool]) -> tuple[list[str], np.ndarray]:
        if model is None:
            return [only if ok else UNKNOWN for ok in letter], np.array([float(ok and only != UNKNOWN) for ok in letter])
        prob = document_probabilities(model, [t if ok else b"" for t, ok in zip(texts, letter, strict=True)])
        names = [model.labels[k] if ok else UNKNOWN for k, ok in zip(prob.argmax(axis=1), letter, strict=True)]
        return names, np.where(np.array(letter, bool), np.minimum(prob.max(axis=1, initial=0.0), 1.0), 0.0)

    return label


def _held(fold: int, test_fold: int):
    return crc_mod(F.col("doc_id"), fold) == test_fold


def predict(docs: DataFrame, fold: int = 5, test_fold: int = 0, **how) -> DataFrame:
    """Learn from the documents outside the test fold and label every document."""
    label = _labeller(sample_windows(docs.filter(~_held(fold, test_fold))), **how)

    def run(batches):
        for batch in batches:
            lang, score = label(batch.column("text").to_pylist(), batch.column("letter").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(lang, pa.string()), pa.array(score, pa.float64())],
                ["doc_id", "held_out", "lang_pred", "score"],
            )

    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), _held(fold, test_fold).alias("held_out"),
        F.col("text").cast("binary").alias("text"), F.coalesce(F.col("text").rlike(LETTER), F.lit(False)).alias("letter"),
    ).mapInArrow(run, PREDICTED)


def keep_identified(docs: DataFrame, least: float = 0.5, fold: int = 5, test_fold: int = 0, **how) -> DataFrame:
    """docs without those whose language is not identified with at least the given score; no row moves."""
    label = _labeller(sample_windows(docs.filter(~_held(fold, test_fold))), **how)
    place, letter = docs.columns.index("text"), len(docs.columns)

    def run(batches):
        for batch in batches:
            texts = [None if t is None else t.encode("utf-8", "replace") for t in batch.column(place).to_pylist()]
            lang, score = label(texts, batch.column(letter).to_pylist())
            keep = pa.array([x != UNKNOWN and s >= least for x, s in zip(lang, score, strict=True)], pa.bool_())
            rows = batch.filter(keep)
            yield pa.RecordBatch.from_arrays(rows.columns[:letter], rows.schema.names[:letter])

    marked = docs.select("*", F.coalesce(F.col("text").rlike(LETTER), F.lit(False)).alias("_has_letter"))
    return marked.mapInArrow(run, docs.schema)
