"""Nearest neighbours by multi-index hashing.

Vectors get binary codes: signs after a rotation learned on a bounded sample
(iterative quantisation of the principal components; several rotations, one
after the other, give longer codes). A code is split into substrings, each
indexed. Two codes within a radius agree, by the pigeonhole principle, in some
substring up to a share of it, so probing every substring index retrieves every
code within the radius; these are reranked by the inner product of the original
vectors in double precision. Where fewer than wanted lie within the radius it
grows until enough do.

Every vector is indexed. Base and queries meet block by block, queries being a
stated set. Vectors of different dimensions have no inner product, so each
dimension is searched on its own. Equal vectors are searched once: of each only the smallest ids can
be among a query's nearest. Vectors of unequal norm are mapped to unit norm
with one further dimension, which keeps the order of inner products.

Defined results
    null, zero or non-finite vectors and rows without vec_id: take no part;
    vectors of several dimensions: each among those of its own; a repeated
    vec_id: its smallest vector counts; ties: the smaller vec_id; fewer
    candidates than wanted: all of them; very long vectors: like any others, 64
    principal components are coded; empty table: no rows; further columns: left
    out.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed

#: Vectors that the rotations and the radius are learned from; rows of a base block and queries of a query block.
SAMPLE, BLOCK_ROWS, QUERY_ROWS = 8192, 16_384, 4096
RESULT = "k1 long, k2 long, vec_id long, score double"


@dataclass
class Coder:
    """Binary codes of (scale * x, rest) after centring and projection."""

    mean: np.ndarray
    project: np.ndarray
    longest: float
    radius: int

    def base(self, x: np.ndarray) -> np.ndarray:
        unit = x / self.longest
        rest = np.sqrt(np.maximum(0.0, 1.0 - (unit * unit).sum(axis=1)))
        return self._codes(np.column_stack([unit, rest]))

    def queries(self, x: np.ndarray) -> np.ndarray:
        unit = x / np.linalg.norm(x, axis=1, keepdims=True)
        return self._codes(np.column_stack([unit, np.zeros(len(x))]))

    def _codes(self, x: np.ndarray) -> np.ndarray:
        bits = ((x - self.mean) @ self.project > 0).astype(np.uint8)
        return np.packbits(bits, axis=1, bitorder="little").view("<u2")


def fit(sample: np.ndarray, longest: float, total: int, wanted: int, bits: int, seed: int = 7, share: float = 0.97) -> Coder:
    """Learn rotations, and the radius that holds the given share of true neighbours in the sample."""
    rng = np.random.default_rng(seed)
    unit = sample / longest
    x = np.column_stack([unit, np.sqrt(np.maximum(0.0, 1.0 - (unit * unit).sum(axis=1)))])
    mean = x.mean(axis=0)
    centred = x - mean
    _, _, axes = np.linalg.svd(centred.T @ centred)
    axes = axes[: min(len(axes), 64)].T
    reduced, columns = centred @ axes, []
    while sum(c.shape[1] for c in columns) < bits:
        turn, _ = np.linalg.qr(rng.normal(size=(axes.shape[1],) * 2))
        for _ in range(25):
            u, _, v = np.linalg.svd(np.sign(reduced @ turn).T @ reduced)
            turn = (u @ v).T
        columns.append(axes @ turn)
    coder = Coder(mean, np.concatenate(columns, axis=1)[:, :bits], longest, bits)
    # neighbours in the sample that stand for the wanted ones among all
    near = max(1, -(-wanted * len(sample) // max(total, 1)))
    queries = rng.permutation(len(sample))[:400]
    scores = sample[queries] @ sample.T
    scores[np.arange(len(queries)), queries] = -np.inf
    best = np.argsort(-scores, axis=1)[:, : min(near, len(sample) - 1)]
    if best.size:
        codes = coder.base(sample)
        far = np.bitwise_count(coder.queries(sample[queries])[:, None, :] ^ codes[best]).sum(axis=2)
        coder.radius = int(np.quantile(far, share))
    return coder


class SubstringIndex:
    """One sorted table for each 16-bit substring of the codes."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.wide = np.ascontiguousarray(np.pad(codes, ((0, 0), (0, -codes.shape[1] % 4)))).view("<u8")
        self.rows = [np.argsort(c, kind="stable") for c in codes.T]
        self.values, self.starts = zip(
            *(np.unique(c[r], return_index=True) for c, r in zip(codes.T, self.rows, strict=True)), strict=True
        )
        self.ends = [np.r_[s[1:], len(codes)] for s in self.starts]

    def _buckets(self, table: int, value: np.uint16, radius: int) -> np.ndarray:
        """Numbers of the table's buckets within the radius of a value."""
        values = self.values[table]
        if radius <= 2:
            probes = value ^ _flips(radius)
            at = np.minimum(np.searchsorted(values, probes), len(values) - 1)
            return at[values[at] == probes]
        return np.flatnonzero(np.bitwise_count(values ^ value) <= radius)

    def within(self, code: np.ndarray, wide: np.ndarray, radius: int) -> np.ndarray:
        """All rows whose codes are within the radius of a code."""
        tables = self.codes.shape[1]
        each, extra = divmod(radius, tables)
        found = np.zeros(len(self.codes), bool)
        for t in range(tables):
            # of radius r, r mod tables + 1 substrings are probed to the rounded share and the others to one less
            own = each if t <= extra else each - 1
            if own < 0:
                continue
            hit = self._buckets(t, code[t], own)
            rows, begin, end = self.rows[t], self.starts[t][hit], self.ends[t][hit]
            sizes = end - begin
            found[rows[np.repeat(begin - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())]] = True
            if t % 4 == 3 and found.all():
                break
        rows = np.flatnonzero(found)
        return rows[np.bitwise_count(self.wide[rows] ^ wide).sum(axis=1) <= radius]


def _flips(radius: int) -> np.ndarray:
    return np.array(
        [sum(1 << b for b in bits) for n in range(radius + 1) for bits in combinations(range(16), n)], dtype=np.uint16
    )


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    flat = flat if isinstance(flat, pa.ListArray) else pa.concat_arrays(column.chunks)
    return flat.flatten().to_numpy().astype(np.float64).reshape(len(flat), -1)


def _search(coder: Coder, wanted: int):
    def run(base: pa.Table, queries: pa.Table) -> pa.Table:
        k1, k2, ids, scores = [], [], [], []
        if base.num_rows and queries.num_rows:
            vectors, asked = _matrix(base.column("embedding")), _matrix(queries.column("embedding"))
            index, codes = SubstringIndex(coder.base(vectors)), coder.queries(asked)
            wide = np.ascontiguousarray(np.pad(codes, ((0, 0), (0, -codes.shape[1] % 4)))).view("<u8")
            own = base.column("ids").combine_chunks()
            own = own if isinstance(own, pa.ListArray) else pa.concat_arrays(base.column("ids").chunks)
            flat, ends = own.flatten().to_numpy(), np.cumsum([len(x) for x in own])
            counts = np.diff(np.r_[0, ends])
            enough, most = min(wanted + 1, len(flat)), 16 * codes.shape[1]
            q1, q2 = queries.column("k1").to_numpy(), queries.column("k2").to_numpy()
            for i in range(len(asked)):
                radius = coder.radius
                while True:
                    rows = index.within(codes[i], wide[i], radius)
                    if counts[rows].sum() >= enough or radius >= most:
                        break
                    radius = min(most, radius + max(4, most // 16))
                score = (vectors[rows] * asked[i]).sum(axis=1)
                if len(rows) > enough:  # each row has one id at least
                    least = np.partition(score, len(score) - enough)[len(score) - enough]
                    rows, score = rows[score >= least], score[score >= least]
                n = counts[rows]
                at = np.repeat(ends[rows] - np.cumsum(n), n) + np.arange(n.sum())
                vec, score = flat[at], np.repeat(score, n)
                best = np.lexsort((vec, -score))[: wanted + 1]
                ids.append(vec[best])
                scores.append(score[best])
                k1.append(np.full(len(best), q1[i]))
                k2.append(np.full(len(best), q2[i]))
        cat = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
        return pa.Table.from_arrays(
            [pa.array(cat(k1, np.int64)), pa.array(cat(k2, np.int64)), pa.array(cat(ids, np.int64)), pa.array(cat(scores, np.float64))],
            ["k1", "k2", "vec_id", "score"],
        )

    return run


def valid_vectors(table: DataFrame) -> DataFrame:
    """vec_id, embedding (doubles) and two hashes that stand for the vector, of the vectors that take part."""
    x = F.col("embedding")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = table.filter(
        F.col("vec_id").isNotNull() & x.isNotNull() & (F.size(x) > 0) & fine & F.exists(x, lambda v: v != 0)
    ).select(F.col("vec_id").cast("long").alias("vec_id"), x.cast("array<double>").alias("embedding"))
    rows = rows.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    return rows.select("vec_id", "embedding", F.xxhash64("embedding").alias("k1"), F.xxhash64(F.lit(1), "embedding").alias("k2"))


def nearest(
    table: DataFrame, is_query: Column, wanted: int = 20, bits: int = 256, sample: int = SAMPLE,
    block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS,
) -> DataFrame:
    """query_id, rank, vec_id, score: the wanted nearest found of each query row, without itself."""
    rows = checkpointed(valid_vectors(table))
    dims = [r[0] for r in rows.select(F.size("embedding").alias("d")).distinct().orderBy("d").collect()]
    found = table.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    for d in dims:
        of = rows if len(dims) == 1 else rows.filter(F.size("embedding") == d)
        one = _nearest(of, is_query, wanted, bits, sample, block_rows, query_rows)
        found = one if len(dims) == 1 else found.unionByName(one)
    return found


def _nearest(
    rows: DataFrame, is_query: Column, wanted: int, bits: int, sample: int, block_rows: int, query_rows: int
) -> DataFrame:
    """The nearest among valid vectors of one dimension, of which there is one at least."""
    few = Window.partitionBy("k1", "k2").orderBy("vec_id")
    base = (
        rows.withColumn("n", F.row_number().over(few)).filter(F.col("n") <= wanted + 1)
        .groupBy("k1", "k2").agg(F.first("embedding").alias("embedding"), F.sort_array(F.collect_list("vec_id")).alias("ids"))
    )
    base = checkpointed(base)
    asked = rows.filter(is_query).groupBy("k1", "k2").agg(F.first("embedding").alias("embedding"))
    total = base.count()
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, v: s + v * v))
    longest = base.agg(F.max(norm)).first()[0] * (1 + 1e-12)
    taken = base.select("k1", "k2", "embedding").orderBy("k1", "k2").limit(sample).collect()
    coder = fit(np.array([r["embedding"] for r in taken]), longest, total, wanted, bits)
    blocks, query_blocks = -(-total // block_rows), max(1, -(-asked.count() // query_rows))
    deal = lambda n: F.pmod(F.xxhash64("k2"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = base.select("embedding", "ids", deal(blocks).alias("b"), every(query_blocks).alias("q"))
    right = asked.select("k1", "k2", "embedding", deal(query_blocks).alias("q"), every(blocks).alias("b"))
    found = left.groupBy("b", "q").cogroup(right.groupBy("b", "q")).applyInArrow(_search(coder, wanted), RESULT)
    best = Window.partitionBy("k1", "k2").orderBy(F.desc("score"), "vec_id")
    found = found.withColumn("n", F.row_number().over(best)).filter(F.col("n") <= wanted + 1).drop("n")
    queries = rows.filter(is_query).select(F.col("vec_id").alias("query_id"), "k1", "k2")
    own = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        queries.join(found, ["k1", "k2"]).filter("vec_id <> query_id")
        .withColumn("rank", F.row_number().over(own)).filter(F.col("rank") <= wanted)
        .select("query_id", "rank", "vec_id", "score")
    )
