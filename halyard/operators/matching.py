"""Nearest fingerprints: the best group, the best of another group, and what to make of them."""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..functions.hashes import hamming_halves
from ..functions.text import let
from ..presets import Preset
from . import near
from .ranks import checkpointed

#: Index entries of a block, which a task compares with a block of frames; some MB of numbers.
BLOCK_ENTRIES = 100_000
#: Frames of a block at most.
BLOCK_FRAMES = 30_000
#: Pairs that are all compared, some 40 s of a core.
FEW_PAIRS = 2e10
#: Pairs that are worth a task of their own.
PAIRS_OF_TASK = 1e9
#: Cells that get partitions of their own; more even out.
MOST_APART = 500
#: First bits of a key by which frames are dealt, at most.
PREFIX = 12
#: Keys that a frame probes at most.
MOST_PROBES = 100_000
#: What best_two gives for each need.
NEEDED = {
    "second_id": ["best_id", "best_ord", "best_distance", "second_id", "second_distance"],
    "best_id": ["best_id", "best_ord", "best_distance", "second_distance"],
    "second_distance": ["best_distance", "second_distance"], "best_distance": ["best_distance"],
}
#: A distance beyond all, for entries that are passed over.
NONE = 255


def best_two(frames: DataFrame, index: DataFrame, block_entries: int = BLOCK_ENTRIES, not_own: bool = False, few: float = FEW_PAIRS, need: str = "second_id") -> DataFrame:
    """Best entry and best entry of another group for each frame.

    frames: frame_id, hi, lo; index: group_id, ord, hi, lo. The smallest
    distance wins, then the smallest ord. Frames without any entry are kept
    with nulls. With not_own an entry whose ord is the frame's id is passed over.
    need leaves out columns that cost more: of "second_id" all are given, of
    "best_id" all but second_id, of "second_distance" the two distances, of
    "best_distance" that alone.

    Up to a few pairs all are compared. Of more, a sample of frames tells within
    which radius nearly all have what is needed; that is found by bands (near),
    which finds every entry within the radius, so nothing is nearer. Frames that
    lack something there go on the same way, until their pairs are few. The bands
    also meet entries beyond: one at the next distance shows that distance is the
    least, though not that the entry has the smallest ord.
    """
    n, m = frames.count(), index.count()
    if float(n) * m <= few:
        return _of_all(frames, index, n, m, block_entries, not_own).select("frame_id", *NEEDED[need])
    frames, index = checkpointed(frames.select("frame_id", "hi", "lo")), checkpointed(index.select("group_id", "ord", "hi", "lo"))
    return _by_bands(frames, index, n, m, block_entries, not_own, few, need, *_even_and_length(frames, index)).select("frame_id", *NEEDED[need])


def _even_and_length(frames: DataFrame, index: DataFrame) -> tuple[bool, int]:
    """Whether all distances are even, and how many bits there are before the last ones that are the same everywhere."""
    odd = (F.bit_count("hi") + F.bit_count("lo")) % 2
    bits = F.shiftleft("hi", 32).bitwiseOR(F.col("lo"))
    both = frames.select(odd.alias("odd"), bits.alias("bits")).union(index.select(odd, bits))
    r = both.agg(F.count_distinct("odd") < 2, F.bit_or("bits").bitwiseXOR(F.bit_and("bits"))).first()
    differ = (r[1] or 0) & (2**64 - 1)
    return r[0], 64 - ((differ & -differ).bit_length() - 1 if differ else 0)


def _by_bands(frames: DataFrame, index: DataFrame, n: int, m: int, block_entries: int, not_own: bool, few: float, need: str, even: bool, length: int, again: bool = False) -> DataFrame:
    some = frames.orderBy(F.xxhash64("frame_id"), "frame_id").limit(near.SAMPLE)
    alone = index.select("group_id").distinct().limit(2).count() < 2  # no rivals
    best, second = F.col("best_distance"), F.col("best_distance" if alone else "second_distance")
    of_need = {"second_id": (second, second), "best_id": (F.greatest(best, second - 1 - int(even)), F.greatest(best, second)),
               "second_distance": (second - 1 - int(even), second), "best_distance": (best - 1 - int(even), best)}
    lucky, sure = of_need[need]
    met = _of_all(some, index, near.SAMPLE, m, block_entries, not_own).select((sure if again else lucky).alias("a"), sure.alias("b")).collect()
    tasks = 2 * frames.sparkSession.sparkContext.defaultParallelism
    chosen = near.plan(n, m, [None if d is None else max(d, 0) for r in met for d in r], tasks, length)
    if chosen is None:
        return _of_all(frames, index, n, m, block_entries, not_own)
    radius, bands = chosen
    reach = radius + (2 if even and radius % 2 == 0 else 1)
    cells = near.cells_of_bands(bands, n, m, tasks)
    two = checkpointed(_met_by_keys(frames, near.two_of_each(index), bands, *cells, near.nearest_within(reach, bands, not_own)))
    sure_best = best <= radius
    done = {"second_id": second <= radius, "best_id": sure_best & second.isNotNull(),
            "second_distance": second.isNotNull() & (sure_best | (second == best)), "best_distance": best.isNotNull()}[need]
    settled = two.filter(done)
    left = checkpointed(frames.join(settled, "frame_id", "left_anti"))
    k = left.count()
    if float(k) * m <= few or k > n // 2 * 1.9:  # a radius that settles next to none is no help
        return settled.unionByName(_of_all(left, index, k, m, block_entries, not_own))
    return settled.unionByName(_by_bands(left, index, k, m, block_entries, not_own, few, need, even, length, True))


def _of_all(frames: DataFrame, index: DataFrame, n: int, m: int, block_entries: int, not_own: bool) -> DataFrame:
    """best_two by comparing all: blocks of frames meet blocks of entries in tasks of their own."""
    spark = frames.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    tasks = min(tasks, max(1, int(n * m / PAIRS_OF_TASK)))  # as entries go to each block of frames, few pairs are not dealt to many
    return _met(frames, index, *blocks(n, m, block_entries, tasks), _nearest_of_blocks(not_own))


def _met(frames: DataFrame, index: DataFrame, f_blocks: int, i_blocks: int, nearest) -> DataFrame:
    """Each block of frames meets each block of entries in a task of its own, which gives two candidates a frame, so pairs are never rows."""
    n = f_blocks * i_blocks
    apart = F.lit(apart_keys(frames.sparkSession, n)).cast("array<bigint>") if n <= MOST_APART else None

    def cells(df: DataFrame, id_: str, own: int, other: int, cell) -> DataFrame:
        at = df.withColumn("own", F.pmod(F.xxhash64(id_), F.lit(own)).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(other - 1))))
        at = at.withColumn("cell", cell if apart is None else F.get(apart, cell)).drop("own", "other")
        return at.repartition(n, "cell").groupBy("cell")

    f = cells(frames.select("frame_id", "hi", "lo"), "frame_id", f_blocks, i_blocks, F.col("own") * i_blocks + F.col("other"))
    i = cells(index, "ord", i_blocks, f_blocks, F.col("other") * i_blocks + F.col("own"))
    return _best_of_cells(frames, index, f, i, nearest)


def _best_of_cells(frames: DataFrame, index: DataFrame, f, i, nearest) -> DataFrame:
    of = {c: df.schema[c].dataType for df, c in ((frames, "frame_id"), (index, "group_id"), (index, "ord"))}
    met = f.cogroup(i).applyInArrow(nearest, StructType([StructField(c, t) for c, t in (of | {"d": IntegerType()}).items()]))
    found = met.groupBy("frame_id").agg(F.array_sort(F.collect_list(F.struct("d", "ord", "group_id"))).alias("found"))
    both = found.select("frame_id", _first_and_rival(F.col("found")).alias("m")).select("frame_id", "m.*")
    return frames.select("frame_id").join(both, "frame_id", "left")


def _met_by_keys(frames: DataFrame, index: DataFrame, bands: list[tuple[int, int, int]], f_blocks: list[int], i_blocks: int, nearest) -> DataFrame:
    """As _met, but each band's frames are dealt by ranges of its keys, so that a task meets few keys and many frames of each.

    Ranges are told by how many frames share a key's first bits; frames of many copies, which share all, are dealt to more than one.
    """
    n = sum(f_blocks) * i_blocks
    spark, ordered = frames.sparkSession, Window.partitionBy("band").orderBy("prefix")
    apart = F.lit(apart_keys(spark, n)).cast("array<bigint>") if n <= MOST_APART else None
    at = lambda cell: cell if apart is None else F.get(apart, cell)
    bits = F.shiftleft("hi", 32).bitwiseOR(F.col("lo")).alias("bits")
    first = [F.shiftrightunsigned(F.shiftleft("bits", start), 64 - min(width, PREFIX)) for start, width, _ in bands]
    keyed = frames.filter("hi is not null and lo is not null").select("frame_id", bits).select(
        "*", F.explode(F.array(*[F.struct(F.lit(k).alias("band"), x.alias("prefix")) for k, x in enumerate(first)])).alias("key")
    ).select("frame_id", "bits", "key.*")
    counts = keyed.groupBy("band", "prefix").agg(F.count("*").alias("n")).select("*", (F.sum("n").over(ordered) - F.col("n")).alias("before"))
    counts = counts.select("*", F.sum("n").over(Window.partitionBy("band")).alias("all"))
    part, of = F.pmod(F.xxhash64("frame_id"), F.lit(1 << 20)) / (1 << 20), F.get(F.lit(f_blocks), F.col("band"))
    block = F.least(F.floor((F.col("before") + F.col("n") * part) / F.col("all") * of), of - 1).cast("int")
    base = F.get(F.lit([sum(f_blocks[:k]) for k in range(len(bands))]), F.col("band"))
    f = keyed.join(F.broadcast(counts), ["band", "prefix"]).select("frame_id", "bits", "band", (base + block).alias("own"))
    f = f.select("frame_id", "bits", "band", F.explode(F.transform(F.sequence(F.lit(0), F.lit(i_blocks - 1)), lambda j: at(F.col("own") * i_blocks + j))).alias("cell"))
    own = F.pmod(F.xxhash64("ord"), F.lit(i_blocks)).cast("int")
    i = index.select("group_id", "ord", "ord_2", bits, own.alias("own"))
    i = i.select("group_id", "ord", "ord_2", "bits", F.explode(F.transform(F.sequence(F.lit(0), F.lit(sum(f_blocks) - 1)), lambda j: at(j * i_blocks + F.col("own")))).alias("cell"))
    return _best_of_cells(frames, index, *(df.repartition(n, "cell").groupBy("cell") for df in (f, i)), nearest)


def apart_keys(spark: SparkSession, n: int) -> list[int]:
    """n keys that repartition deals to n partitions, one to each; of any n keys, a third of the partitions would get none."""
    keys = spark.range(n * 64).groupBy(F.pmod(F.hash("id"), F.lit(n)).alias("at")).agg(F.min("id").alias("key")).collect()
    found = [r["key"] for r in keys]
    return found + list(range(n * 64, n * 65 - len(found)))


def blocks(frames: int, entries: int, block_entries: int, tasks: int) -> tuple[int, int]:
    """Into how many blocks frames and entries are dealt: small enough for a task, and so many that all tasks have pairs of them."""
    of_entries = max(1, -(-entries // block_entries))
    return max(1, -(-frames // BLOCK_FRAMES), -(-2 * tasks // of_entries)), of_entries


def _nearest_of_blocks(not_own: bool):
    """The best entry of a block for each frame, and the best of another group, as rows frame_id, group_id, ord, d."""
    def bits(t: pa.Table) -> np.ndarray:
        return t["hi"].to_numpy().astype(np.uint64) << np.uint64(32) | t["lo"].to_numpy().astype(np.uint64)

    def whole(t: pa.Table) -> pa.Table:
        return t.filter(pc.and_(t["hi"].is_valid(), t["lo"].is_valid()))

    def run(frames: pa.Table, entries: pa.Table) -> pa.Table:
        frames, entries = whole(frames), whole(entries)
        entries = entries.sort_by([("ord", "ascending"), ("group_id", "ascending")])  # so the first of the nearest wins
        codes = pc.dictionary_encode(entries["group_id"].combine_chunks(), null_encoding="encode").indices.to_numpy()
        by_group = np.argsort(codes, kind="stable")
        edges = np.searchsorted(codes[by_group], np.arange(codes.max(initial=-1) + 2))
        of_frames, of_entries = bits(frames), bits(entries)
        n, m = len(of_frames), len(of_entries)
        if not_own:
            ids, ords = frames["frame_id"].to_numpy(), entries["ord"].to_numpy()
            own = np.stack([np.searchsorted(ords, ids, "left"), np.searchsorted(ords, ids, "right")], 1)
        first, d = np.full((2, n), -1), np.full((2, n), NONE, np.uint8)
        apart, differ = np.empty(m, np.uint64), np.empty(m, np.uint8)
        for k in range(n if m else 0):
            np.bitwise_count(np.bitwise_xor(of_entries, of_frames[k], out=apart), out=differ)
            if not_own:
                differ[own[k, 0] : own[k, 1]] = NONE
            best = first[0, k] = differ.argmin()
            if (nearest := differ[best]) == NONE:
                continue
            d[0, k] = nearest
            differ[by_group[edges[codes[best]] : edges[codes[best] + 1]]] = NONE
            first[1, k] = rival = differ.argmin()
            d[1, k] = differ[rival]
        found = [np.flatnonzero(x < NONE) for x in d]
        of, at = np.concatenate(found), np.concatenate([first[k][x] for k, x in enumerate(found)])
        taken, distance = entries.take(at), np.concatenate([d[k][x] for k, x in enumerate(found)])
        return pa.table({"frame_id": frames["frame_id"].take(of), "group_id": taken["group_id"], "ord": taken["ord"], "d": pa.array(distance, pa.int32())})

    return run


def band_width(radius: int, entries: int) -> int:
    """Into how many bands 64 bits are cut to find all entries within a radius with little work for each frame.

    The work of b bands of w bits is the keys that a frame probes, of which there
    are as many as a band has variants of radius // b changed bits, and the
    entries that meet it by chance: entries * keys / 2^w.
    """
    def work(b: int) -> float:
        w = 64 // b
        keys = sum(comb(-(-64 // b), k) for k in range(radius // b + 1))
        return b * keys * (1 + entries / 2**w)

    return min(range(1, min(radius + 1, 16) + 1), key=lambda b: (work(b), b))


def within(frames: DataFrame, index: DataFrame, radius: int, not_own: bool = False, bands: int | None = None) -> DataFrame:
    """frame_id, group_id, ord, d: every index entry within so many bits of each frame, found without comparing all with all.

    frames and index as in best_two. 64 bits are cut into bands; two fingerprints
    within the radius agree in some band up to radius // bands bits, so each frame
    probes the variants of its bands and meets the index entries of these keys by
    an equi-join. Of the bands that a pair meets in it counts at the first alone.
    Frames of one fingerprint probe once. Frames without an entry have no row.
    """
    if not 0 <= radius < 32:
        raise ValueError("a radius lies between 0 and 31 bits")
    bands = bands or band_width(radius, max(1, index.count()))
    changes = radius // bands
    edges = [64 * k // bands for k in range(bands + 1)]

    def band(hi: Column, lo: Column, k: int) -> Column:
        """Bits edges[k] to edges[k + 1] of the 64, the highest first, as a number."""
        a, b = edges[k], edges[k + 1]
        part = F.lit(0).cast("bigint")
        for half, at in ((hi, 0), (lo, 32)):
            low, high = max(a, at), min(b, at + 32)
            if low < high:
                bits = F.shiftright(half, at + 32 - high).bitwiseAND((1 << (high - low)) - 1)
                part = F.shiftleft(part, high - low).bitwiseOR(bits)
        return part

    keyed = lambda hi, lo: F.array(*[F.struct(F.lit(k).alias("band"), band(hi, lo, k).alias("key")) for k in range(bands)])
    entries = index.select("group_id", "ord", "hi", "lo", F.explode(keyed(F.col("hi"), F.col("lo"))).alias("at")).select("*", "at.band", "at.key").drop("at")
    masks = {n: [sum(1 << i for i in c) for k in range(changes + 1) for c in combinations(range(n), k)] for n in {b - a for a, b in zip(edges, edges[1:], strict=False)}}
    if sum(map(len, masks.values())) > MOST_PROBES:
        raise ValueError("the radius leaves too many keys to probe")
    wide = frames.sparkSession.createDataFrame(
        [(k, masks[edges[k + 1] - edges[k]]) for k in range(bands)], "band int, masks array<bigint>"
    )  # one row a band
    own = frames.select(F.col("hi").alias("f_hi"), F.col("lo").alias("f_lo")).distinct()
    probes = own.select("*", F.explode(keyed(F.col("f_hi"), F.col("f_lo"))).alias("at")).select("f_hi", "f_lo", "at.band", F.col("at.key").alias("own_key"))
    probes = probes.join(F.broadcast(wide), "band").select("f_hi", "f_lo", "band", "own_key", F.explode("masks").alias("mask"))
    probes = probes.select("f_hi", "f_lo", "band", F.col("own_key").bitwiseXOR(F.col("mask")).alias("key"))
    d = hamming_halves(F.col("f_hi"), F.col("f_lo"), F.col("hi"), F.col("lo"))
    met = probes.join(entries, ["band", "key"]).withColumn("d", d).filter(F.col("d") <= radius)
    apart = [F.bit_count(band(F.col("f_hi"), F.col("f_lo"), k).bitwiseXOR(band(F.col("hi"), F.col("lo"), k))) for k in range(bands)]
    earlier = F.lit(False)
    for k in range(bands - 1):
        earlier = earlier | ((F.col("band") > k) & (apart[k] <= changes))
    pairs = met.filter(~earlier).select("f_hi", "f_lo", "group_id", "ord", "d")
    out = frames.select("frame_id", F.col("hi").alias("f_hi"), F.col("lo").alias("f_lo")).join(pairs, ["f_hi", "f_lo"]).drop("f_hi", "f_lo")
    return out.filter(F.col("ord") != F.col("frame_id")) if not_own else out


def best_within(frames: DataFrame, index: DataFrame, radius: int, not_own: bool = False) -> DataFrame:
    """best_two for matches within the radius alone: a frame without an entry there has nulls, and so has a rival farther away.

    Nearest entries are compared, as the groups of all entries within a wide radius are more rows than that costs.
    """
    close = lambda c, d: F.when(F.col(d) <= radius, F.col(c)).alias(c)
    best, second = "best_distance", "second_distance"
    return best_two(frames, index, not_own=not_own).select(
        "frame_id", close("best_id", best), close("best_ord", best), close(best, best), close("second_id", second), close(second, second)
    )


def best_two_of_array(hi: Column, lo: Column, index: Column) -> Column:
    """best_two without join or aggregation, for streams: index is array<struct<group_id, ord, hi, lo>> on every row."""
    scored = F.array_sort(
        F.transform(
            index, lambda e: F.struct(hamming_halves(hi, lo, e["hi"], e["lo"]).alias("d"), e["ord"].alias("ord"), e["group_id"].alias("group_id"))
        )
    )
    return let(scored, _first_and_rival)


def _first_and_rival(scored: Column) -> Column:
    best = F.get(scored, F.lit(0))
    rival = F.get(F.filter(scored, lambda e: ~e["group_id"].eqNullSafe(best["group_id"])), F.lit(0))
    return F.struct(
        best["group_id"].alias("best_id"), best["ord"].alias("best_ord"), best["d"].alias("best_distance"),
        rival["group_id"].alias("second_id"), rival["d"].alias("second_distance"),
    )


def decide(matches: DataFrame, preset: Preset, threshold: Column | None = None, least_margin: Column | None = None) -> DataFrame:
    """Add margin, required_margin, within, active, ambiguous, run_quality, near_miss and outcome.

    Threshold and margin are the preset's, or those of each row where columns are given.
    """
    best, second = F.col("best_distance"), F.col("second_distance")
    limit = F.lit(preset.threshold) if threshold is None else threshold
    wanted = F.lit(preset.margin) if least_margin is None else least_margin
    boost = F.when(best >= F.greatest(limit - 1, F.lit(0)), 1).otherwise(0) if preset.boost_near_threshold else F.lit(0)
    within = F.coalesce(best <= limit, F.lit(False))
    margin = second - best
    enough = margin.isNull() | (margin >= wanted + boost)
    tie = F.coalesce(second == best, F.lit(False))
    active = within & enough & ~tie
    ambiguous = within & ~active
    return matches.select(
        *matches.columns,
        margin.alias("margin"),
        (wanted + boost).alias("required_margin"),
        within.alias("within"),
        active.alias("active"),
        ambiguous.alias("ambiguous"),
        (best.isNull() | ~active | (best > 12)).alias("run_quality"),
        F.coalesce((best > limit) & (best <= limit + 8), F.lit(False)).alias("near_miss"),
        F.when(active, "active").when(ambiguous, "ambiguous")
        .when(F.coalesce(best <= limit + 2, F.lit(False)), "near_threshold").otherwise("no_match").alias("outcome"),
    )


def failure_category(outcome: Column) -> Column:
    """collision for ambiguous and near-threshold frames, no-match for the other failures, null for matches."""
    return F.when(outcome.isin("ambiguous", "near_threshold"), "collision").when(outcome == "no_match", "no-match")


def match_outcome(expected: Column, got: Column, is_match: Column) -> Column:
    return F.when(~is_match | got.isNull(), "no-match").when(expected == got, "correct").otherwise("wrong")


def adaptive_delay(distance: Column, delay_ms: int) -> Column:
    half = F.greatest(F.lit(1), F.floor(F.lit(delay_ms) * 0.5 + 0.5))
    return F.when(distance <= 13, half).when(distance <= 16, F.lit(delay_ms)).otherwise(F.floor(F.lit(delay_ms) * 1.3 + 0.5)).cast("int")


def bucketed(frames: DataFrame, index: DataFrame, digits: int = 0) -> tuple[DataFrame, DataFrame]:
    """Frames and index with the hash prefix that they must share; with 0 digits all share one."""
    if not digits:
        return frames.withColumn("bucket", F.lit("")), index.withColumn("bucket", F.lit(""))
    return tuple(df.withColumn("bucket", F.lower(F.substring("hash", 1, digits))) for df in (frames, index))


def candidate_stats(candidates: DataFrame) -> DataFrame:
    """last, max, total and number of the candidates per frame (frame_id, n)."""
    return candidates.agg(
        F.max_by("n", "frame_id").alias("last"), F.max("n").alias("most"), F.sum("n").alias("total"), F.count("*").alias("frames")
    )
