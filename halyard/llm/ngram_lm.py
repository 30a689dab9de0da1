"""Language-model scores by deleted interpolation of n-grams.

Texts are dealt into blocks by a hash of doc_id and text. A block sends its distinct
n-grams with their counts, once each, to the shards that add them up; a shard
answers with the totals in the order it was asked, so a block can look up every
n-gram of its own texts, and a frequent n-gram costs a shard one entry a block.
Words travel as sorted 64-bit hashes packed in arrays. Longer n-grams have
shorter hashes, of 12 bits more than the corpus has n-grams need: one in 4096
shares its count with another, at any size of the corpus. Texts are dealt out
as compressed Arrow tables.

A token's probability mixes the maximum-likelihood estimates of all orders and
a uniform one. The weights depend on how often the context was seen (its
bucket) and are learned by expectation-maximisation: one block in
``held_out_every`` is held out, its counts are deleted from the estimates, and
the weights make its tokens most likely. The held-out tokens enter as a
histogram of bucket and of the estimates' logarithms in steps of 1/2, whose
size does not grow with the corpus. The scores then use all training counts.
A block and a shard are one task's each, so ``block_bytes`` and ``shard_bytes``
are what a task can hold; on a large cluster both should be as large as its
memory allows, since blocks times shards cells travel.

Defined results
    null or empty text: the end token alone; no training text: every estimate
    is 0 and the uniform one counts; repeated rows: counted and scored each;
    null doc_id: taken as empty text by the fold rule; very long texts: whole
    in their block; ties: none, scores are numbers; empty table: no rows;
    further columns: left out.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import checkpointed, crc_mod

BLOCK_BYTES = SHARD_BYTES = 12_000_000
#: How hard dealt texts are compressed: 2.8 to 1 in place of 2.3 to 1.
ZSTD_LEVEL = 6
#: Logarithm steps of the held-out histogram; estimates below the last count as the last.
STEPS, LOWEST = 2, 30
CELLS = "ord int, shard int, block int, keys binary, counts binary"
ANSWERS = "ord int, shard int, block int, totals binary, deleted binary, n long, v long, dn long, dv long"
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
BEGIN, END = np.uint64(0x5BD1E9955BD1E995), np.uint64(0x9E3779B185EBCA87)


def pack(keys: np.ndarray) -> bytes:
    """Sorted keys: the first, then differences in as few bytes as the largest needs, as the first byte says."""
    step = np.diff(keys)
    width = max(1, (int(step.max(initial=0)).bit_length() + 7) // 8)
    small = np.ascontiguousarray(step.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width])
    return bytes([width]) + keys[:1].astype("<u8").tobytes() + small.tobytes()


def unpack(data: bytes) -> np.ndarray:
    small = np.frombuffer(data, np.uint8, offset=9).reshape(-1, data[0])
    full = np.zeros((len(small) + 1, 8), np.uint8)
    full[0] = np.frombuffer(data, np.uint8, count=8, offset=1)
    full[1:, : data[0]] = small
    return np.cumsum(full.view("<u8")[:, 0], dtype=np.uint64)


def shrink(counts: np.ndarray) -> bytes:
    """Counts in a byte each, those of 255 and more behind them in full, compressed."""
    most = counts[counts >= 255].astype("<u8").tobytes()
    return len(counts).to_bytes(4, "little") + zlib.compress(np.minimum(counts, 255).astype(np.uint8).tobytes() + most, 5)


def grow(data: bytes) -> np.ndarray:
    n, plain = int.from_bytes(data[:4], "little"), zlib.decompress(data[4:])
    small, most = np.frombuffer(plain, np.uint8, count=n), np.frombuffer(plain, "<u8", offset=n)
    out = small.astype(np.uint64 if most.max(initial=0) >> 32 else np.uint32)
    out[small == 255] = most
    return out


def gram_bits(size: int) -> int:
    """Bits of the hashes of n-grams in a corpus of the given bytes."""
    return min(64, 12 + max(24, math.ceil(math.log2(max(size, 1) / 4 + 1))))


class Block:
    """The token sequences of a block's texts and their distinct n-grams.

    grams[n - 1] holds the sorted hashes of the n-grams (of order 1 also the
    begin mark), at[n - 1] each token's place in it, context[n - 1] the place of
    its context among the n-grams one shorter.
    """

    def __init__(self, texts: Iterable[bytes | None], order: int, bits: int):
        known: dict[bytes, int] = {}
        ids, sizes = [], []
        for text in texts:
            words = (text or b"").lower().split()
            for w in set(words).difference(known):
                known[w] = len(known) + 2
            ids.append(np.fromiter(map(known.__getitem__, words), dtype=np.int32, count=len(words)))
            sizes.append(len(words) + 1)
        hashes = np.empty(len(known) + 2, np.uint64)
        hashes[0], hashes[1] = BEGIN, END
        hashes[2:] = np.fromiter((xxh64_intdigest(w) for w in known), dtype=np.uint64, count=len(known))
        del known
        self.sizes = np.array(sizes, dtype=np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        total = int(self.sizes.sum())
        token = np.ones(total, np.int32)
        for i, start in zip(ids, self.starts, strict=True):
            token[start : start + len(i)] = i
        del ids
        position = np.arange(total) - np.repeat(self.starts, self.sizes)
        self.grams, self.at, self.context = [], [], []
        rank = np.argsort(hashes)
        place = np.empty(len(hashes), np.int32)
        place[rank] = np.arange(len(hashes), dtype=np.int32)
        self.grams.append(hashes[rank])
        self.at.append(place[token])
        self.context.append(np.zeros(0, np.int64))
        self.begin = int(place[0])
        # ids of each token's n-gram, one order after the other; begin marks fill up what lies before a text
        last, before = hashes[token], np.r_[0, token[:-1]]
        before = np.where(position == 0, 0, before)
        gram, gram_at = last, self.at[0]
        for n in range(2, order + 1):
            # the n-gram that ends here: the (n - 1)-gram that ends one token before, then this token
            if n == 2:
                ctx_hash, ctx_at = hashes[before], place[before]
            else:
                ctx_hash = np.where(position == 0, BEGIN, np.r_[BEGIN, gram[:-1]])
                ctx_at = np.where(position == 0, np.int32(-1), np.r_[np.int32(-1), gram_at[:-1]])
            gram = (ctx_hash * np.uint64(0x9E3779B97F4A7C15)) ^ (last + np.uint64(n))
            gram = (gram ^ (gram >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            gram ^= gram >> np.uint64(32)
            distinct, gram_at = np.unique(gram >> np.uint64(64 - bits), return_inverse=True)
            gram_at = gram_at.astype(np.int32)
            self.grams.append(distinct)
            self.at.append(gram_at)
            self.context.append(ctx_at)

    def counts(self, taken: np.ndarray) -> list[np.ndarray]:
        """How often each n-gram occurs in the texts that are taken (a flag each)."""
        flag = np.repeat(taken, self.sizes).astype(np.float64)
        out = [
            np.bincount(at, weights=flag, minlength=len(g)).astype(np.uint32)
            for g, at in zip(self.grams, self.at, strict=True)
        ]
        out[0][self.begin] = int(taken.sum())
        return out


@dataclass(frozen=True)
class Weights:
    """weights[bucket] of the estimates from the highest order down to the uniform one."""

    weights: np.ndarray
    order: int

    @staticmethod
    def buckets(order: int) -> int:
        return (order - 1) * 32 + 1


def estimates(block: Block, counts: list[np.ndarray], n: int, v: int) -> tuple[np.ndarray, np.ndarray]:
    """(orders + 1) x tokens estimates, the highest order first, and each token's bucket."""
    order = len(block.grams)
    out = np.zeros((order + 1, len(block.at[0])))
    bucket = np.zeros(len(block.at[0]), np.int64)
    out[order] = 1.0 / (v + 1)
    if n:
        out[order - 1] = counts[0][block.at[0]] / n
    for k in range(2, order + 1):
        own, below = counts[k - 1][block.at[k - 1]], block.context[k - 1]
        seen = counts[k - 2][np.maximum(below, 0)].astype(np.float64)
        seen[below < 0] = counts[0][block.begin]  # nothing but begin marks
        out[order - k] = np.divide(own, seen, out=np.zeros(len(own)), where=seen > 0)
        level = np.minimum(np.log2(np.maximum(seen, 1)).astype(np.int64), 31) + (k - 2) * 32 + 1
        bucket = np.where(seen > 0, level, bucket)
    return out, bucket


def histogram(est: np.ndarray, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cells (one number each) of bucket and quantised estimates, and how many tokens lie in each."""
    key = bucket.copy()
    for row in est[:-1]:
        with np.errstate(divide="ignore"):
            level = np.clip(np.rint(-np.log2(row) * STEPS), 0, LOWEST * STEPS)
        key = key * (LOWEST * STEPS + 2) + np.where(row > 0, level, LOWEST * STEPS + 1).astype(np.int64)
    return np.unique(key, return_counts=True)


def learn_weights(cells: np.ndarray, counts: np.ndarray, order: int, v: int, rounds: int = 60) -> np.ndarray:
    """Weights of each bucket by expectation-maximisation over the held-out histogram."""
    base, key, est = LOWEST * STEPS + 2, np.asarray(cells).copy(), []
    for _ in range(order):
        level = key % base
        key = key // base
        est.append(np.where(level > LOWEST * STEPS, 0.0, 2.0 ** (-level / STEPS)))
    p = np.stack([*est[::-1], np.full(len(key), 1.0 / (v + 1))])
    w = np.full((Weights.buckets(order), order + 1), 1.0 / (order + 1))
    for _ in range(rounds):
        part = w[key].T * p
        part *= np.asarray(counts) / part.sum(axis=0)
        new = np.zeros_like(w)
        np.add.at(new, key, part.T)
        new += 1e-3  # no estimate's weight becomes 0, and buckets without tokens keep even weights
        w = new / new.sum(axis=1, keepdims=True)
    return w


def _deal(batches):
    """Each batch's documents by block, as compressed tables."""
    write = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=ZSTD_LEVEL))
    for batch in batches:
        block = batch.column("block").to_numpy()
        table = batch.drop_columns(["block"])
        order = np.argsort(block, kind="stable")
        numbers, starts = np.unique(block[order], return_index=True)
        blobs = []
        for a, b in zip(starts, [*starts[1:], len(order)], strict=True):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema, options=write) as out:
                out.write_batch(table.take(pa.array(order[a:b])))
            blobs.append(sink.getvalue().to_pybytes())
        yield pa.RecordBatch.from_arrays([pa.array(numbers), pa.array(blobs, pa.binary())], ["block", "docs"])


def _documents(table: pa.Table) -> pa.Table:
    """The documents of a block's dealt tables; none without tables."""
    parts = [pa.ipc.open_stream(x.as_buffer()).read_all() for x in table.column("docs")]
    return pa.concat_tables(parts) if parts else None


def _cells(order: int, shards: int, bits: int):
    edges = {k: (np.arange(1, shards, dtype=object) * 2**k // shards).astype(np.uint64) for k in (64, bits)}

    def run(table: pa.Table) -> pa.Table:
        docs = _documents(table)
        block = Block((t.as_py() for t in docs.column("text")), order, bits)
        rows: list[tuple] = []
        number = table.column("block")[0].as_py()
        for k, (keys, counts) in enumerate(zip(block.grams, block.counts(docs.column("train").to_numpy()), strict=True)):
            cuts = [0, *np.searchsorted(keys, edges[bits if k else 64]), len(keys)]
            for s in range(shards):
                a, b = cuts[s], cuts[s + 1]
                if a < b:
                    rows.append((k + 1, s, number, pack(keys[a:b]), shrink(counts[a:b])))
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
        cols = zip(*rows, strict=True)
        names = ["ord", "shard", "block", "keys", "counts"]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names)

    return run


def _answers(every: int):
    def run(table: pa.Table) -> pa.Table:
        block, order = table.column("block").to_numpy(), table.column("ord")[0].as_py()
        keys = [unpack(x.as_py()) for x in table.column("keys")]
        counts = np.concatenate([grow(x.as_py()) for x in table.column("counts")])
        sizes = np.array([len(k) for k in keys])
        distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
        held = np.repeat(block % every == 0, sizes)
        total = np.bincount(at, weights=counts).astype(np.uint64)
        deleted = total - np.bincount(at, weights=counts * held).astype(np.uint64)
        sums = [0, 0, 0, 0]
        if order == 1:
            real = distinct != BEGIN
            sums = [int(x) for x in (total[real].sum(), (total[real] > 0).sum(), deleted[real].sum(), (deleted[real] > 0).sum())]
        ends = np.cumsum(sizes)
        rows = []
        for i, b in enumerate(block):
            part = at[ends[i] - sizes[i] : ends[i]]
            less = shrink(deleted[part]) if b % every == 0 else None
            rows.append((shrink(total[part]), less, *(x if i == 0 else 0 for x in sums)))
        kinds = (pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
        cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
        return pa.Table.from_arrays(
            [table.column("ord"), table.column("shard"), table.column("block"), *cols],
            ["ord", "shard", "block", "totals", "deleted", "n", "v", "dn", "dv"],
        )

    return run


def _looked_up(block: Block, answers: pa.Table, column: str) -> list[np.ndarray]:
    order, shard = answers.column("ord").to_numpy(), answers.column("shard").to_numpy()
    data, out = answers.column(column), []
    for k in range(len(block.grams)):
        rows = sorted(np.flatnonzero(order == k + 1), key=lambda i: shard[i])
        out.append(np.concatenate([grow(data[int(i)].as_py()) for i in rows]))
    return out


def _held_out(order: int, n: int, v: int, bits: int):
    def run(dealt: pa.Table, answers: pa.Table) -> pa.Table:
        cells = counts = np.zeros(0, np.int64)
        if dealt.num_rows:
            docs = _documents(dealt)
            block = Block((t.as_py() for t in docs.column("text")), order, bits)
            est, bucket = estimates(block, _looked_up(block, answers, "deleted"), n, v)
            used = np.repeat(docs.column("train").to_numpy(), block.sizes)
            cells, counts = histogram(est[:, used], bucket[used])
        return pa.Table.from_arrays([pa.array(cells), pa.array(counts)], ["cell", "n"])

    return run


def _scores(order: int, n: int, v: int, weights: np.ndarray, bits: int):
    def run(dealt: pa.Table, answers: pa.Table) -> pa.Table:
        names = [x.split()[0] for x in SCORES.split(", ")]
        if not dealt.num_rows:
            kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
            return pa.Table.from_arrays([pa.array([], t) for t in kinds], names)
        docs = _documents(dealt)
        block = Block((t.as_py() for t in docs.column("text")), order, bits)
        counts = _looked_up(block, answers, "totals")
        est, bucket = estimates(block, counts, n, v)
        score = np.zeros(est.shape[1])
        for k in range(order + 1):
            score += weights[bucket, k] * est[k]
        own = counts[0][block.at[0]].astype(np.float64)
        add = lambda x: np.add.reduceat(x, block.starts)
        return pa.Table.from_arrays(
            [
                docs.column("doc_id"), docs.column("held_out"), pa.array(block.sizes),
                pa.array(add((own > 0).astype(np.int64))), pa.array(np.full(len(block.sizes), n, np.int64)),
                pa.array(add(np.log10((own + 1) / (n + v + 1)))), pa.array(add(np.log10(score))),
            ],
            names,
        )

    return run


def score_documents(
    docs: DataFrame, order: int = 3, fold: int = 7, test_fold: int = 2, held_out_every: int = 8,
    block_bytes: int = BLOCK_BYTES, rounds: int = 60, shard_bytes: int = SHARD_BYTES,
) -> DataFrame:
    """Score every document by a model learned from those outside the test fold."""
    held = crc_mod(F.col("doc_id"), fold) == test_fold
    text = F.col("text").cast("binary")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks, shards, bits = max(held_out_every, -(-size // block_bytes)), max(1, -(-size // shard_bytes)), gram_bits(size)
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), held.alias("held_out"), (~held).alias("train"),
        F.pmod(F.xxhash64("doc_id", text), F.lit(blocks)).cast("int").alias("block"),
    )
    dealt = rows.mapInArrow(_deal, "block int, docs binary")
    cells = dealt.groupBy("block").applyInArrow(_cells(order, shards, bits), CELLS)
    answers = checkpointed(cells.groupBy("ord", "shard").applyInArrow(_answers(held_out_every), ANSWERS))
    sums = answers.agg(*(F.sum(c).alias(c) for c in ("n", "v", "dn", "dv"))).first()
    n, v, dn, dv = (x or 0 for x in sums)
    wanted = answers.select("block", "ord", "shard", "totals", "deleted")
    first = F.col("block") % held_out_every == 0
    seen = (
        rows.filter(first).mapInArrow(_deal, "block int, docs binary").groupBy("block").cogroup(wanted.filter(first).drop("totals").groupBy("block"))
        .applyInArrow(_held_out(order, dn, dv, bits), "cell long, n long")
        .groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    )
    weights = learn_weights(seen["cell"].to_numpy(np.int64), seen["n"].to_numpy(np.float64), order, dv, rounds)
    return (
        dealt.groupBy("block").cogroup(wanted.drop("deleted").groupBy("block"))
        .applyInArrow(_scores(order, n, v, weights, bits), SCORES)
    )
