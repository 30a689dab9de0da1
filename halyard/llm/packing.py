"""Vector best-fit packing of tokenized documents into sequences.

Bins have three residual capacities: tokens, documents and attention cost (the
sum of squared piece lengths). Pieces are placed by falling length into the bin
that fits under every capacity and scores best, by smallest weighted residual
norm or largest weighted dot product.

All pieces of a length are alike, so the bins are chosen on the histogram of
lengths, which has no more entries than a sequence has tokens whatever the size
of the corpus; bins in the same state form one class with a count. The plan
says which ranks of a length go where; pieces are ranked in their partitions
and find their place by rank, so that no group of pieces meets in one task.

Defined results
    null or empty text: the end token alone; null doc_id: packed as it is;
    repeated rows and repeated doc_ids: packed each; ties: by class age; empty
    table: no rows; further columns, also those named like the result's: left
    out. Texts longer than a sequence, or than its attention cost allows, are
    cut into pieces of that length and a last one, however many they are.
"""

from __future__ import annotations

import os
import zlib
from collections import defaultdict
from functools import lru_cache
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed

END_ID = 0
#: Distinct words whose ids a worker keeps, over all its tasks; longer words are encoded anew.
CACHED_WORDS, CACHED_LENGTH = 500_000, 40
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, pid int, local long"


@lru_cache(maxsize=2)
def encoder_of(path: str) -> WordEncoder:
    """The process's encoder: tasks that follow each other in a worker share its words."""
    return WordEncoder(path)


class WordEncoder:
    """Token ids of a text as little-endian 32-bit bytes.

    The tokenizer lower-cases and never joins characters across white space,
    so a text's ids are those of its lower-case words, and each distinct word
    is encoded once. A full stop or comma between a letter and white space is a
    token of its own.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.known = Tokenizer.from_file(path), {}

    def _learn(self, missing: set[bytes]) -> list[bytes]:
        """Encode words; the overlong ones among them are returned."""
        base = {w: w[:-1] for w in missing if w[-1:] in (b".", b",") and w[:-1].decode("utf-8", "replace")[-1:].isalpha()}
        new = list(({base.get(w, w) for w in missing} | {b".", b","}).difference(self.known))
        texts = [w.decode("utf-8", "replace") for w in new]
        for w, e in zip(new, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False), strict=True):
            self.known[w] = np.array(e.ids, dtype="<u4").tobytes()
        for w, b in base.items():
            self.known[w] = self.known[b] + self.known[w[-1:]]
        return [w for w in (*new, *base) if len(w) > CACHED_LENGTH]

    def ids(self, text: bytes) -> bytes:
        if b"<|" not in text:  # special tokens are found before letters are lowered
            text = text.lower()
        words, known, long = text.split(), self.known, ()
        if missing := set(words).difference(known):
            if len(known) > CACHED_WORDS:
                known.clear()
                missing = set(words)
            long = self._learn(missing)
        out = b"".join(map(known.__getitem__, words))
        for w in long:
            known.pop(w, None)
        return out


def tokenize_pieces(docs: DataFrame, vocab_path: str, longest: int) -> DataFrame:
    """Pieces of every document, each with its partition and its rank among the partition's pieces of that length."""

    def pieces(batches):
        encoder, pid = encoder_of(vocab_path), TaskContext.get().partitionId()
        seen: dict[int, int] = defaultdict(int)
        end, step = np.array([END_ID], dtype="<u4").tobytes(), 4 * longest
        for batch in batches:
            cols: list[list] = [[] for _ in range(7)]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encoder.ids(text.as_py() or b"") + end
                for k, at in enumerate(range(0, len(ids), step)):
                    part = ids[at : at + step]
                    n = len(part) // 4
                    for c, v in zip(cols, (doc_id, k, at // 4, n, zlib.crc32(part), pid, seen[n]), strict=True):
                        c.append(v)
                    seen[n] += 1
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            names = [x.split()[0] for x in PIECES.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(pieces, PIECES)


def plan_bins(
    counts: dict[int, int], capacity: int = 2048, max_docs: int | None = None, max_attention: int | None = None,
    weights: tuple[float, float, float] = (1.0, 0.01, 0.01), rule: str = "norm",
) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Where the pieces of each length go.

    Returns (length, first rank, count, first bin, offset) placements, each of
    which gives the next count ranks one bin each, and the number of bins.
    """
    cap = np.array([capacity, max_docs or capacity, max_attention or capacity * capacity], dtype=np.float64)
    w = np.asarray(weights, dtype=np.float64)
    state = np.zeros((0, 3))  # residuals of each class
    spans: list[list[list[int]]] = []  # of each class: [first bin, count]
    index: dict[tuple, int] = {}
    placements: list[tuple[int, int, int, int, int]] = []
    bins = 0

    def add(residual: np.ndarray, first: int, count: int) -> None:
        nonlocal state
        if residual[0] < 1 or residual[1] < 1 or residual[2] < 1:
            return
        key = tuple(residual)
        if (k := index.get(key)) is None:
            k = index[key] = len(spans)
            spans.append([])
            if k >= len(state):
                state = np.vstack([state, np.full((max(64, len(state)), 3), -1.0)])
            state[k] = residual
        spans[k].append([first, count])

    for length in sorted((n for n in counts if counts[n]), reverse=True):
        need = np.array([length, 1, length * length], dtype=np.float64)
        if (need > cap).any():
            raise ValueError(f"a piece of {length} tokens exceeds a capacity")
        left, rank = counts[length], 0
        while left:
            room = state - need
            fits = (room >= 0).all(axis=1)
            if not fits.any():
                break
            if rule == "dot":
                score = -((state / cap) @ (w * need / cap))
            else:
                score = (w * (room / cap) ** 2).sum(axis=1)
            k = int(np.where(fits, score, np.inf).argmin())
            residual = state[k] - need
            offset = capacity - int(state[k][0])
            while left and spans[k]:
                span = spans[k][-1]
                n = min(left, span[1])
                placements.append((length, rank, n, span[0], offset))
                add(residual, span[0], n)
                span[0], span[1], left, rank = span[0] + n, span[1] - n, left - n, rank + n
                if not span[1]:
                    spans[k].pop()
            if not spans[k]:
                del index[tuple(state[k])]
                state[k] = -1.0
        if left:
            each = int(min(cap // need))
            full, rest = divmod(left, each)
            for first, count, per in ((bins, full, each), (bins + full, 1 if rest else 0, rest)):
                for j in range(per if count else 0):
                    placements.append((length, rank, count, first, j * length))
                    rank += count
                if count:
                    add(cap - per * need, first, count)
                    bins += count
        if len(spans) > 4 * max(64, len(index)):
            keep = sorted(index.values())
            state, spans = state[keep].copy(), [spans[k] for k in keep]
            index = {tuple(s): k for k, s in enumerate(state)}
    return placements, bins


def assign(pieces: DataFrame, placements: list[tuple[int, int, int, int, int]]) -> DataFrame:
    """Give each piece, by its rank among those of its length, its bin and offset."""
    by: dict[int, list] = defaultdict(list)
    for length, rank, count, first, offset in placements:
        by[length].append((rank, first, offset))
    plan = {k: tuple(np.array(c) for c in zip(*sorted(v), strict=True)) for k, v in by.items()}
    before = Window.partitionBy("length").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    counts = pieces.groupBy("length", "pid").agg(F.count("*").alias("n"))
    counts = counts.select("length", "pid", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ranked = pieces.join(counts, ["length", "pid"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("local")).alias("rank")
    )

    def place(batches):
        for batch in batches:
            length, rank = (batch.column(k).to_numpy() for k in (3, 5))
            seq, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            for n in np.unique(length):
                at = np.flatnonzero(length == n)
                ranks, first, off = plan[int(n)]
                k = np.searchsorted(ranks, rank[at], side="right") - 1
                seq[at], offset[at] = first[k] + rank[at] - ranks[k], off[k]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(seq), pa.array(offset)],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return ranked.mapInArrow(
        place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )


def pack_documents(
    docs: DataFrame, vocab_path: str, capacity: int = 2048, max_docs: int | None = None,
    max_attention: int | None = None, weights: tuple[float, float, float] = (1.0, 0.01, 0.01), rule: str = "norm",
) -> DataFrame:
    """Pack doc_id, text: one row per piece with its sequence and offset."""
    longest = min(capacity, isqrt(max_attention)) if max_attention else capacity
    pieces = checkpointed(tokenize_pieces(docs, vocab_path, longest))
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    placements, _ = plan_bins(counts, capacity, max_docs, max_attention, weights, rule)
    return assign(pieces, placements)
