"""Near copies by the Jaccard similarity of shingle sets: SimHash finds candidates, the sets decide.

Rows with equal sets of k-word shingles are one class. Classes whose SimHash
signatures, over distinct shingles, come near each other are candidates; the
sets of the classes that candidate links connect are then compared, and only
pairs whose sets are alike by ``LEAST`` are linked. Short texts, whose bits
say little, don't go by signatures: any two that are alike share one of the
smallest few hashes of their sets, so they meet by those, which is exact.
A group of classes is compared in pairs of parts of bounded size, so its work
grows with its square but is dealt out.

Defined results
    null, empty or blank text: the empty set, like any other such; fewer words
    than a shingle: one shingle of all; rows that share a doc_id: dropped only
    where linked by text, like any others; equal rows: one stays; no doc_id:
    dropped as a copy of any row with one, among themselves one text stays;
    neither doc_id nor text: stays; empty table: no rows; very long texts:
    whole; further columns, whatever their names: kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import checkpointed
from .components import connected_components
from .simhash import BROADCAST_BUCKETS, link_signatures, set_signature, shingle_hashes

#: Sets are alike if they share this part of their union: (4, 5) is 0.8.
LEAST = (4, 5)
#: Sets of fewer shingles meet by their smallest hashes, larger ones by signatures.
SHORT = 24
#: A part of a large group has about this many sets and shingles at most.
PART_SETS = 500
PART_SHINGLES = 200_000


def shingle_set(text: bytes, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles."""
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *shingle_hashes(text, k)]))


def prefix(n: int) -> int:
    """So many smallest hashes of a set of n hold one that each set alike also has among its own."""
    return n - -(-n * LEAST[0] // LEAST[1]) + 1


def linked(sets: list[np.ndarray]) -> np.ndarray:
    """For each sorted set the first set that it is connected to by pairs that are alike."""
    n, size = len(sets), np.array([len(s) for s in sets], np.int64)
    label = np.arange(n)
    _, token = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(label, size)[np.argsort(token, kind="stable")]
    begin = np.r_[0, np.cumsum(np.bincount(token))] if len(token) else np.zeros(1, np.int64)
    at = np.r_[0, np.cumsum(size)]
    for i in range(n - 1):
        if (label[i + 1 :] == label[i]).all():
            continue
        own = token[at[i] : at[i + 1]]
        left, count = begin[own], begin[own + 1] - begin[own]
        places = np.repeat(left - np.cumsum(count) + count, count) + np.arange(count.sum())
        both = np.bincount(owner[places], minlength=n)
        alike = both * LEAST[1] >= LEAST[0] * (size + size[i] - both)
        alike[: i + 1] = False
        for j in np.unique(label[alike]):
            x, y = int(label[i]), int(j)
            if x != y:
                label[label == max(x, y)] = min(x, y)
    return label


def _key(docs: DataFrame) -> list:
    """What rows are told apart by, those without doc_id last: no_id, doc_id, version (the text's hash)."""
    return [
        F.col("doc_id").isNull().alias("no_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("doc_id"),
        F.xxhash64("text").alias("version"),
    ]


KEY = ["no_id", "doc_id", "version"]


def _free_name(docs: DataFrame, name: str) -> str:
    """The name, lengthened until no column of docs has it."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def _prints(docs: DataFrame, k: int, words: int) -> DataFrame:
    """no_id, doc_id, version, node (hash of the set), n, the set of a short text, signature words."""
    names = [f"f{w}" for w in range(words)]
    most = SHORT * LEAST[1] // LEAST[0]

    def run(batches):
        for batch in batches:
            sets = [shingle_set(t.as_py() or b"", k) for t in batch.column(3)]
            node = pa.array([xxh64_intdigest(s.tobytes()) for s in sets], pa.uint64()).to_numpy(zero_copy_only=False).astype(np.int64)
            short = [s.tobytes() if len(s) <= most else None for s in sets]
            cols = np.array([set_signature(s, words) for s in sets], dtype=np.uint64).reshape(len(sets), words).astype(np.int64).T
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(node), pa.array([len(s) for s in sets], pa.int64()), pa.array(short, pa.binary()), *map(pa.array, cols)],
                [*KEY, "node", "n", "short", *names],
            )

    schema = "no_id boolean, doc_id long, version long, node long, n long, short binary, " + ", ".join(f"{x} long" for x in names)
    texts = docs.filter("doc_id is not null or text is not null").select(*_key(docs), F.col("text").cast("binary").alias("text"))
    return texts.mapInArrow(run, schema)


def _short_rows(classes: DataFrame) -> DataFrame:
    """(bunch, node, n, shingles): each short set under its smallest hashes."""

    def run(batches):
        for batch in batches:
            rows = [
                (int(h), node, n, s)
                for node, n, s in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True)
                for h in np.frombuffer(s, np.int64)[: prefix(n)]
            ]
            cols = zip(*rows, strict=True) if rows else [[]] * 4
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["bunch", "node", "n", "shingles"])

    short = classes.filter("short is not null and n > 0").select("node", "n", "short")
    return short.mapInArrow(run, "bunch long, node long, n long, shingles binary")


def _member_rows(docs: DataFrame, classes: DataFrame, candidates: DataFrame, k: int) -> DataFrame:
    """(bunch, node, n, shingles) of the classes that candidate links connect."""

    def run(batches):
        for batch in batches:
            sets = [shingle_set(t or b"", k) for t in batch.column(2).to_pylist()]
            n = pa.array([len(s) for s in sets], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), n, pa.array([s.tobytes() for s in sets], pa.binary())], ["bunch", "node", "n", "shingles"]
            )

    first = candidates.join(classes.select("node", "kept"), "node")
    first = first.select("node", F.col("component").alias("bunch"), "kept.*")
    texts = docs.select(*_key(docs), F.col("text").cast("binary").alias("text"))
    rows = texts.join(first, KEY).select("bunch", "node", "text")
    return rows.mapInArrow(run, "bunch long, node long, n long, shingles binary")


def _compare(batches):
    """Edges of each unit's spanning forest; rows come sorted by bunch and unit."""

    def edges(rows):
        sets = {node: np.frombuffer(s, np.uint64) for node, s in rows}
        if len(sets) < 2:
            return []
        nodes = list(sets)
        return [(nodes[i], nodes[j]) for i, j in enumerate(linked(list(sets.values())).tolist()) if i != j]

    held, at = [], None
    for batch in batches:
        out = []
        for bunch, unit, node, s in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
            if (bunch, unit) != at:
                out += edges(held)
                held, at = [], (bunch, unit)
            held.append((node, s))
        yield pa.RecordBatch.from_arrays([pa.array([e[i] for e in out], pa.int64()) for i in (0, 1)], ["a", "b"])
    out = edges(held)
    yield pa.RecordBatch.from_arrays([pa.array([e[i] for e in out], pa.int64()) for i in (0, 1)], ["a", "b"])


def _alike(rows: DataFrame) -> DataFrame:
    """Edges (a, b) that connect all sets that are alike inside each bunch."""
    parts = F.ceil(F.greatest(F.count("*") / PART_SETS, F.sum("n") / PART_SHINGLES)).cast("int")
    large = checkpointed(rows.groupBy("bunch").agg(parts.alias("parts")).filter("parts > 1"))
    if (found := large.count()) <= BROADCAST_BUCKETS:
        large = F.broadcast(large)
    rows = rows.join(large, "bunch", "left") if found else rows.withColumn("parts", F.lit(None).cast("int"))
    # Of a large bunch each row goes to all pairs of parts that hold its own.
    part = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    units = F.when(F.col("parts").isNull(), F.array(F.lit(0))).otherwise(
        F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: F.least(part, j) * F.col("parts") + F.greatest(part, j))
    )
    rows = rows.select("bunch", F.explode(units).alias("unit"), "node", "shingles")
    rows = rows.repartition(F.col("bunch"), F.col("unit")).sortWithinPartitions("bunch", "unit")
    return rows.mapInArrow(_compare, "a long, b long").distinct()


def drop_near_copies(docs: DataFrame, k: int = 5, words: int = 8, **how) -> DataFrame:
    """docs with one row of each group of near copies: that with the smallest doc_id."""
    names = [f"f{w}" for w in range(words)]
    prints = _prints(docs, k, words)
    classes = checkpointed(prints.groupBy("node").agg(
        F.min(F.struct(*KEY)).alias("kept"), F.min("n").alias("n"), F.min("short").alias("short"), *(F.min(x).alias(x) for x in names)
    ))
    candidates = connected_components(link_signatures(classes.filter(F.col("n") >= SHORT).select("node", *names), words, **how))
    rows = checkpointed(_member_rows(docs, classes, candidates, k).unionByName(_short_rows(classes)))
    found = connected_components(_alike(rows))
    keep = classes.select("node", "kept").join(found, "node", "left").groupBy(F.coalesce("component", "node").alias("c")).agg(F.min("kept").alias("kept"))
    name = _free_name(docs, "near_copies_key")
    keep = keep.select(F.col("kept").alias(name))
    known = docs.filter("doc_id is not null or text is not null").withColumn(name, F.struct(*_key(docs)))
    kept = known.join(keep, name, "left_semi").dropDuplicates([name])
    return kept.select(*(F.col(f"`{c}`") for c in docs.columns)).unionByName(docs.filter("doc_id is null and text is null"))
