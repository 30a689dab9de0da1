"""SimHash near-duplicates, compared in bit-sliced blocks.

Documents with equal fingerprints are one from the start. Candidates share
``agree`` of ``blocks`` bit blocks of a fingerprint word, so by the pigeonhole
principle every pair within ``blocks - agree`` bits meets. Inside such a bucket
fingerprints are stored as vertical bit planes; the planes, shifted by a lag,
give the distances of all pairs at that lag at once, counted by carry-save
adders, and a block of pairs is abandoned once all exceed the radius. A bucket
gives the edges of a spanning forest of its links, not all of them, and large
buckets are dealt out as pairs of parts.

Words are what lies between ASCII white space, after lower-casing A-Z.

Defined results
    null, empty or blank text: fingerprint zero, linked like any other; fewer
    words than a shingle: one shingle of all; ties: a bit set in exactly half
    is 0; very long texts: hashed in chunks; repeated rows and rows that share
    a doc_id: fingerprinted and linked each; rows without doc_id: likewise, they
    link others but name no component, and one that holds no other row has a
    null component; empty table: no rows; further columns: left out.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import checkpointed
from .components import connected_components

SEED = 42
#: Shingles hashed at a time, so that a very long text needs no more memory.
CHUNK = 65_536
#: A bucket of more fingerprints is compared as pairs of parts of about half this size.
BUCKET = 16_384
#: A table of at most this many large buckets is broadcast; a longer one is joined by shuffle.
BROADCAST_BUCKETS = 200_000
ONES = np.uint64(0x0101010101010101)


def shingle_hashes(text: bytes, k: int):
    """XXH64 of each k-word shingle, in arrays of up to CHUNK."""
    words = text.lower().split()
    if not words:
        return
    if len(words) <= k:
        yield np.array([xxh64_intdigest(b" ".join(words), SEED)], dtype=np.uint64)
        return
    for at in range(0, len(words) - k + 1, CHUNK):
        part = words[at : at + CHUNK + k - 1]
        n = len(part) - k + 1
        shingles = map(b" ".join, zip(*(part[i : i + n] for i in range(k)), strict=True))
        yield np.fromiter(map(xxh64_intdigest, shingles, repeat(SEED)), dtype=np.uint64, count=n)


def bit_counts(h: np.ndarray) -> np.ndarray:
    """How often each of the 64 bits is set; eight byte-wide counters are added in one word."""
    rows = -(-len(h) // 255)
    padded = np.zeros(rows * 255, dtype=np.uint64)
    padded[: len(h)] = h
    out = np.zeros((8, 8), dtype=np.int64)  # byte, bit
    for bit in range(8):
        packed = ((padded >> np.uint64(bit)) & ONES).reshape(rows, 255).sum(axis=1, dtype=np.uint64)
        out[:, bit] = packed.astype("<u8").view(np.uint8).reshape(rows, 8).sum(axis=0, dtype=np.int64)
    return out.reshape(64)


def _mixed(h: np.ndarray, word: int) -> np.ndarray:
    """Further hash words from the first; word 0 is the hash itself."""
    if not word:
        return h
    z = h + np.uint64((word * 0x9E3779B97F4A7C15) & (2**64 - 1))
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def signature(text: bytes, k: int, words: int = 1) -> list[int]:
    """Fingerprint words, each as an unsigned number."""
    counts, n = np.zeros((words, 64), dtype=np.int64), 0
    for h in shingle_hashes(text, k):
        n += len(h)
        for w in range(words):
            counts[w] += bit_counts(_mixed(h, w))
    bits = (counts * 2 > n).astype(np.uint8)
    return [int(x) for x in np.packbits(bits, axis=1, bitorder="little").view("<u8")[:, 0]]


def set_signature(h: np.ndarray, words: int) -> list[int]:
    """Fingerprint words of hashes that count once each."""
    counts = np.stack([bit_counts(_mixed(h, w)) for w in range(words)])
    return [int(x) for x in np.packbits((counts * 2 > len(h)).astype(np.uint8), axis=1, bitorder="little").view("<u8")[:, 0]]


def fingerprints(docs: DataFrame, k: int = 4, words: int = 1) -> DataFrame:
    """doc_id and f0, f1, ...: fingerprint words as signed numbers."""
    names = [f"f{w}" for w in range(words)]

    def run(batches):
        for batch in batches:
            sig = [signature(t.as_py() or b"", k, words) for t in batch.column(1)]
            cols = np.array(sig, dtype=np.uint64).reshape(len(sig), words).astype(np.int64).T
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, cols)], ["doc_id", *names])

    schema = "doc_id long, " + ", ".join(f"{n} long" for n in names)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text")).mapInArrow(run, schema)


def block_keys(word: Column, tag: int, blocks: int, agree: int) -> list[Column]:
    """One key for each choice of agree blocks of a fingerprint word."""
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    part = [
        F.shiftrightunsigned(word, cuts[i]).bitwiseAND(F.lit((1 << (cuts[i + 1] - cuts[i])) - 1)) for i in range(blocks)
    ]
    width = max(b - a for a, b in zip(cuts, cuts[1:], strict=False))
    keys = []
    for number, chosen in enumerate(combinations(range(blocks), agree)):
        key = F.lit(tag * 1000 + number).cast("long")
        for i in chosen:
            key = F.shiftleft(key, width).bitwiseOR(part[i])
        keys.append(key)
    return keys


def planes_of(words: np.ndarray) -> list[int]:
    """Bit planes of 64-bit words: plane p has bit i set if word i has bit p set."""
    bits = np.unpackbits(words.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    rows = np.packbits(bits.T, axis=1, bitorder="little")
    return [int.from_bytes(r.tobytes(), "little") for r in rows]


def within(planes: list[int], lag: int, lanes: int, radius: int) -> int:
    """Which of the given lanes i are within radius bits of lane i + lag, as a bit set.

    Three planes at a time go through a full adder; counters of weight 1, 2, 4
    and 8 stand side by side in four bit sets.
    """
    one = two = four = eight = over = 0
    for p in range(0, len(planes), 3):
        x, *rest = (v ^ (v >> lag) for v in planes[p : p + 3])
        y, z = (*rest, 0, 0)[:2]
        t = x ^ y
        low, high = t ^ z, (x & y) | (z & t)
        carry = one & low
        one ^= low
        both, two = two & high, two ^ high
        more, two = two & carry, two ^ carry
        up, four = four & both, four ^ both
        up2, four = four & more, four ^ more
        out, eight = eight & up, eight ^ up
        out2, eight = eight & up2, eight ^ up2
        over |= out | out2
        if p >= 12 and p % 6 == 0 and lanes & ~(over | _exceeds((eight, four, two, one), radius, lanes)) == 0:
            return 0
    return lanes & ~(over | _exceeds((eight, four, two, one), radius, lanes))


def _exceeds(counters: tuple[int, ...], radius: int, lanes: int) -> int:
    more, equal = 0, lanes
    for weight, c in zip((8, 4, 2, 1), counters, strict=True):
        if radius & weight:
            equal &= c
        else:
            more |= equal & c
            equal &= ~c
    return more


def _set_bits(bits: int, n: int) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(np.frombuffer(bits.to_bytes(-(-n // 8), "little"), np.uint8), bitorder="little"))


def forest(group: np.ndarray, sig: np.ndarray, word: np.ndarray, radius: int, total: int | None) -> np.ndarray:
    """For rows sorted by group, the first row of each row's linked set inside its group.

    sig has a row of words for each row; word says which of them the group's
    pairs are compared by; total bounds the distance over all words.
    """
    label = np.arange(len(group))
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else np.zeros(0, np.int64)
    sizes = np.diff(np.r_[starts, len(group)])
    for low in (2 ** i for i in range(1, max(2, int(sizes.max(initial=1)).bit_length() + 1))):
        chosen = (sizes >= low) & (sizes < 2 * low)
        at = np.flatnonzero(chosen)
        step = max(1, BUCKET // low)
        for k in range(0, len(at), step):
            part = at[k : k + step]
            rows = np.concatenate([np.arange(starts[g], starts[g] + sizes[g]) for g in part])
            _link(rows, np.repeat(np.arange(len(part)), sizes[part]), sig, sig[rows, word[rows]], radius, total, label)
    return label


def _link(rows, group, sig, words, radius, total, label) -> None:
    planes, n = planes_of(words), len(rows)
    own = label[rows]
    last = np.r_[np.flatnonzero(group[1:] != group[:-1]), n - 1]
    room = last[group] - np.arange(n)  # rows of the same group that follow
    for lag in range(1, int(room.max()) + 1):
        lanes = int.from_bytes(np.packbits((room >= lag).astype(np.uint8), bitorder="little").tobytes(), "little")
        found = within(planes, lag, lanes, radius)
        if not found:
            continue
        i = _set_bits(found, n)
        i = i[own[i] != own[i + lag]]
        if total is not None and len(i):
            far = np.bitwise_count(sig[rows[i]] ^ sig[rows[i + lag]]).sum(axis=1) > total
            i = i[~far]
        for a in i:
            x, y = own[a], own[a + lag]
            if x != y:
                own[own == max(x, y)] = min(x, y)
    label[rows] = own


def _compare(words: int, radius: int, total: int | None):
    """Edges of each bucket's spanning forest; rows come sorted by bucket."""
    names = ["key", "unit", "node", *(f"f{w}" for w in range(words))]

    def edges(table: pa.Table):
        cols = {n: table.column(n).to_numpy() for n in names}
        new = (np.diff(cols["key"]) != 0) | (np.diff(cols["unit"]) != 0)
        group = np.r_[0, np.cumsum(new)] if len(cols["key"]) else np.zeros(0, np.int64)
        sig = np.stack([cols[f"f{w}"] for w in range(words)], axis=1).astype(np.uint64)
        tag = table.column("tag").to_numpy()
        label = forest(group, sig, tag, radius, total)
        at = np.flatnonzero(label != np.arange(len(label)))
        return pa.RecordBatch.from_arrays([pa.array(cols["node"][at]), pa.array(cols["node"][label[at]])], ["a", "b"])

    def run(batches):
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            key, unit = held.column("key").to_numpy(), held.column("unit").to_numpy()
            same = (key == key[-1]) & (unit == unit[-1]) if len(key) else np.zeros(0, bool)
            cut = len(key) - int(same.sum())  # the last bucket may go on in the next batch
            if cut:
                yield edges(held.slice(0, cut))
                held = held.slice(cut)
        if held is not None and held.num_rows:
            yield edges(held)

    return run


def link_signatures(
    sigs: DataFrame, words: int = 1, index_words: int = 1, blocks: int = 6, agree: int = 2, radius: int = 4,
    total: int | None = None,
) -> DataFrame:
    """Edges (a, b) that connect all linked nodes; sigs has node and f0, f1, ..., each signature once.

    radius (up to 14) bounds the distance in an indexed word; total, if given,
    that over all words.
    """
    if not 0 <= radius <= 14:
        raise ValueError("the counters hold radii from 0 to 14")
    names = [f"f{w}" for w in range(words)]
    keys = [
        F.struct(key.alias("key"), F.lit(w).alias("tag"))
        for w in range(index_words)
        for key in block_keys(F.col(f"f{w}"), w + 1, blocks, agree)
    ]
    rows = sigs.select("node", *names, F.explode(F.array(*keys)).alias("k"))
    rows = rows.select("node", *names, F.col("k.key").alias("key"), F.col("k.tag").alias("tag"))
    large = rows.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > BUCKET)
    large = checkpointed(large.select("key", F.ceil(F.col("n") / (BUCKET // 2)).cast("int").alias("parts")))
    if (found := large.count()) <= BROADCAST_BUCKETS:
        large = F.broadcast(large)
    rows = rows.join(large, "key", "left") if found else rows.withColumn("parts", F.lit(None).cast("int"))
    # Of a large bucket each row goes to all pairs of parts that hold its own.
    part = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    units = F.when(F.col("parts").isNull(), F.array(F.lit(0))).otherwise(
        F.transform(
            F.sequence(F.lit(0), F.col("parts") - 1), lambda j: F.least(part, j) * F.col("parts") + F.greatest(part, j)
        )
    )
    rows = rows.select("key", F.explode(units).alias("unit"), "tag", "node", *names)
    rows = rows.repartition(F.col("key"), F.col("unit")).sortWithinPartitions("key", "unit")
    return rows.mapInArrow(_compare(words, radius, total), "a long, b long").distinct()


def key_shape(n: int, radius: int) -> tuple[int, int]:
    """Blocks of a fingerprint and how many of them a key joins, for n fingerprints.

    A pair within the radius differs in at most so many blocks, so the others
    agree whatever the shape; longer keys keep buckets small in a larger corpus.
    Up to 33 million fingerprints have 15 keys of 21 bits each for a radius of 4.
    """
    for agree in (2, 3, 4):
        if 64 * agree // (radius + agree) >= n.bit_length() - 4:
            return radius + agree, agree
    return radius + 4, 4


def near_duplicates(docs: DataFrame, k: int = 4, radius: int = 4) -> DataFrame:
    """doc_id, f0, component_id, class_size: one row per document.

    component_id is the smallest doc_id reachable over links of at most radius
    bits, class_size the number of documents with the same fingerprint.
    """
    prints = checkpointed(fingerprints(docs, k))
    # a fingerprint is its own node, whether or not a document that has it has an id
    sigs = checkpointed(prints.groupBy("f0").agg(F.min("doc_id").alias("least"), F.count("*").alias("class_size")))
    blocks, agree = key_shape(sigs.count(), radius)
    edges = link_signatures(sigs.select(F.col("f0").alias("node"), "f0"), blocks=blocks, agree=agree, radius=radius)
    found = connected_components(edges).withColumnRenamed("node", "f0")
    groups = sigs.join(found, "f0", "left").withColumn("component", F.coalesce("component", "f0"))
    least = groups.groupBy("component").agg(F.min("least").alias("component_id"))
    named = groups.join(least, "component").select("f0", "class_size", "component_id")
    return prints.join(named, "f0", "left").select("doc_id", "f0", "component_id", "class_size")


def hex_of(words: list[Column]) -> Column:
    return reduce(F.concat, (F.lower(F.lpad(F.hex(w), 16, "0")) for w in words))
