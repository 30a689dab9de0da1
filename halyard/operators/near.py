"""The best two entries of each frame where all comparisons are too many: nearby entries are looked up by bands of bits, the few other frames meet all."""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Frames, and entries, of a cell at most; some hundred MB of numbers in a task.
CELL_ROWS = 3_000_000
#: Pairs that are compared at a time, and found ones that are kept before they are boiled down to two a frame.
AT_ONCE, KEPT = 1 << 15, 1 << 20
#: Frames whose distances are looked at to choose the radius.
SAMPLE = 1000
#: Nanoseconds, measured roughly: a pair of a band, a pair of a whole comparison, an entry or a key looked up, a call.
PAIR, WHOLE, LOOKED_UP, CALL = 2.0, 2.0, 6.0, 3_000.0
#: Changed keys that are looked up for a key, and bits of a key, at most.
MOST_MASKS, MOST_WIDTH = 20_000, 24
#: Nanoseconds of all cores that a round's shuffles and files cost.
ROUND = 4e10


def layout(radius: int, bands: int, wider: int, length: int = 64) -> list[tuple[int, int, int]]:
    """Bands as (first bit, width, changed bits), so that any two fingerprints within the radius agree in one up to its changed bits.

    Were all bands farther apart, the distance would be the sum of changed bits
    plus one for each band, which is radius + 1. Bands of more changed bits are wider.
    Bits from length on are the same in all fingerprints and lie in no band.
    """
    low, more = divmod(radius + 1, bands)
    widths = [length // bands] * bands
    widths[-1] += length - sum(widths)
    changes = [low - 1] * (bands - more) + [low] * more
    for k in range(bands - more, bands) if 0 < more < bands else ():
        for _ in range(wider):
            giver = max(range(bands - more), key=lambda j: widths[j])
            if widths[giver] < 2:
                break
            widths[giver] -= 1
            widths[k] += 1
    starts = np.cumsum([0, *widths[:-1]])
    return [(int(a), w, t) for a, w, t in zip(starts, widths, changes, strict=True) if t >= 0]


def variants(width: int, changes: int) -> int:
    return sum(comb(width, k) for k in range(changes + 1))


def work(bands: list[tuple[int, int, int]], frames: int, entries: int) -> float:
    """Nanoseconds in which frames meet a block of entries, roughly; frames of one key meet them together."""
    total = 0.0
    for _, width, changes in bands:
        keys, masks = min(frames, 2.0**width), variants(width, changes)
        met = entries * masks / 2.0**width
        total += keys * (5 * CALL + LOOKED_UP * (masks + met)) + frames * met * PAIR + max(keys, frames * met / AT_ONCE) * CALL
        total += 2.0**width * LOOKED_UP
        total += float("inf") if masks > MOST_MASKS or width > MOST_WIDTH else 0
    return total


def cells_of(frames: int, entries: int, tasks: int) -> tuple[int, int]:
    """Into how many blocks frames and entries are dealt; more of frames where there are fewer cells than tasks."""
    f, i = max(1, -(-frames // CELL_ROWS)), max(1, -(-entries // CELL_ROWS))
    return max(f, -(-tasks // i)), i


def cells_of_bands(bands: list[tuple[int, int, int]], frames: int, entries: int, tasks: int) -> tuple[list[int], int]:
    """Into how many blocks of keys the frames of each band are dealt, more where a band has more work, and entries."""
    f, i = cells_of(frames, entries, 1)
    costs = [work([b], frames, entries // i) for b in bands]
    return [max(f, -(-int(tasks * c) // int(sum(costs) * i + 1))) for c in costs], i


def plan(frames: int, entries: int, distances: list[int | None], tasks: int, length: int = 64) -> tuple[int, list[tuple[int, int, int]]] | None:
    """The radius and bands of least work, given the distances that a sample of frames needs; none where comparing all is less.

    Frames that the radius leaves may be looked up once more within a wider one.
    """
    i = cells_of(frames, entries, tasks)[1]
    shapes = {r: [x for k in range(1, 9) for w in range(4) if (x := layout(r, k, w, max(length, 8)))] for r in range(33)}
    left = [sum(d is None or d > r for d in distances) / max(1, len(distances)) for r in range(33)]

    def least(radius: int, n: float) -> tuple[float, list]:
        return min(((ROUND + work(x, n, entries / i) * i, x) for x in shapes[radius]), default=(float("inf"), []))

    whole = [x * frames * entries * WHOLE for x in left]
    best, chosen = float(frames) * entries * WHOLE, None
    for radius in range(33):
        first, bands = least(radius, frames)
        if first >= best:
            continue
        again = (least(r, left[radius] * frames)[0] + whole[r] for r in range(radius + 1, 33) if left[r] < left[radius])
        if (cost := first + min(whole[radius], *again, float("inf"))) < best:
            best, chosen = cost, (radius, bands)
    return chosen


def two_of_each(index: DataFrame) -> DataFrame:
    """hi, lo, group_id, ord, ord_2: each fingerprint of a group once, with the smallest ord and the next one, so that copies count no more than one."""
    place = F.dense_rank().over(Window.partitionBy("hi", "lo", "group_id").orderBy("ord"))
    least = index.filter("hi is not null and lo is not null").withColumn("_k", place).filter("_k <= 2")
    other = F.max(F.when(F.col("_k") == 2, F.col("ord")))
    return least.groupBy("hi", "lo", "group_id").agg(F.min("ord").alias("ord"), other.alias("ord_2"))


def masks_of(width: int, changes: int) -> np.ndarray:
    return np.array([sum(1 << b for b in c) for k in range(changes + 1) for c in combinations(range(width), k)], np.int64)


def firsts(x: np.ndarray) -> np.ndarray:
    """Where a sorted array's values begin."""
    return np.flatnonzero(np.r_[True, x[1:] != x[:-1]][: len(x)])


def keys_of(bits: np.ndarray, start: int, width: int) -> np.ndarray:
    return ((bits >> np.uint64(64 - start - width)) & np.uint64((1 << width) - 1)).astype(np.int64)


def nearest_within(radius: int, bands: list[tuple[int, int, int]], not_own: bool):
    """The best entry of a block within the radius for each frame of a band's block, and the best of another group, as rows frame_id, group_id, ord, d.

    frames: frame_id, bits, band, of one band; entries: group_id, ord, ord_2, bits. Frames that share
    the band's key meet their entries together, so many frames of few keys are cheaper than few of many.
    """

    def run(frames: pa.Table, entries: pa.Table) -> pa.Table:
        groups = pc.dictionary_encode(entries["group_id"].combine_chunks(), null_encoding="encode")
        rank = np.empty(len(groups.dictionary), np.int64)
        rank[pc.sort_indices(groups.dictionary).to_numpy()] = np.arange(len(rank))
        codes, ords = rank[groups.indices.to_numpy()], entries["ord"].to_numpy()
        by_ord = np.lexsort((codes, ords))  # so an entry's place tells which of equally near ones is taken
        codes, ords = codes[by_ord], ords[by_ord]
        ids = frames["frame_id"].to_numpy()
        if not_own:
            others = pc.if_else(entries["ord_2"].is_valid(), entries["ord_2"], entries["ord"]).to_numpy()[by_ord]
        of_frames, of_entries = frames["bits"].to_numpy().view(np.uint64), entries["bits"].to_numpy().view(np.uint64)[by_ord]
        done: list[tuple[np.ndarray, ...]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))]
        kept: list[tuple[np.ndarray, ...]] = []

        def boiled_down() -> None:
            """Leave of the found pairs two a frame: of each frame the nearest, and the nearest of another group. A frame's pairs are found together."""
            of, at, d = (np.concatenate(x) for x in zip(*kept, strict=True))
            kept.clear()
            at, place = e_order[at], 2 * e_order[at] + 1
            if not_own:
                own = np.flatnonzero(ords[at] == ids[f_order[of]])
                taken = others[at[own]]
                place[own] = 2 * np.searchsorted(ords, taken)
                fine = np.ones(len(of), bool)
                fine[own] = taken != ords[at[own]]
                of, at, d, place = of[fine], at[fine], d[fine], place[fine]
            order = np.argsort(of << 35 | d.astype(np.int64) << 28 | place)  # fewer than 2^27 entries
            of, at, d = of[order], at[order], d[order]
            first = firsts(of)
            best = np.repeat(codes[at[first]], np.diff(np.r_[first, len(of)]))
            rivals = np.flatnonzero(codes[at] != best)
            rivals = rivals[firsts(of[rivals])]
            two = np.r_[first, rivals]
            done.append((f_order[of[two]], at[two], d[two].astype(np.int64)))

        if len(of_frames) and len(of_entries):
            start, width, changes = bands[frames["band"][0].as_py()]
            keys, own_keys = keys_of(of_entries, start, width), keys_of(of_frames, start, width)
            f_order, e_order = np.argsort(own_keys, kind="stable"), np.argsort(keys, kind="stable")
            sorted_frames, sorted_entries, own_keys = of_frames[f_order], of_entries[e_order], own_keys[f_order]
            edges = np.zeros((1 << width) + 1, np.int64)
            np.cumsum(np.bincount(keys, minlength=1 << width), out=edges[1:])
            begins = firsts(own_keys)
            masks = masks_of(width, changes)
            upto, apart, differ, close, size, found = (np.arange(0),) * 4 + (0, 0)
            for key, low, high in zip(own_keys[begins].tolist(), begins.tolist(), [*begins[1:].tolist(), len(f_order)], strict=True):
                near = masks ^ key
                left = edges.take(near)
                n = edges.take(near + 1) - left
                ends = n.cumsum()
                total = int(ends[-1])
                if not total:
                    continue
                if total > len(upto):
                    size = max(AT_ONCE, 2 * total)
                    upto, apart, differ, close = np.arange(2 * total), np.empty(size, np.uint64), np.empty(size, np.uint8), np.empty(size, bool)
                places = np.repeat(left - ends + n, n)
                places += upto[:total]
                candidates = sorted_entries.take(places)
                rows = max(1, AT_ONCE // total)
                for k in range(low, high, rows):
                    some = sorted_frames[k : min(k + rows, high), None]
                    pairs, shape = len(some) * total, (len(some), total)
                    np.bitwise_xor(candidates, some, out=apart[:pairs].reshape(shape))
                    np.bitwise_count(apart[:pairs], out=differ[:pairs])
                    hits = np.flatnonzero(np.less_equal(differ[:pairs], radius, out=close[:pairs]))
                    if len(hits):
                        row = hits // total
                        kept.append((row + k, places.take(hits - row * total), differ.take(hits)))
                        found += len(hits)
                        if found > KEPT:
                            boiled_down()
                            found = 0
            if kept:
                boiled_down()
        of, at, d = (np.concatenate(x) for x in zip(*done, strict=True))
        taken = ords[at]
        if not_own:
            taken = np.where(taken == ids[of], others[at], taken)
        return pa.table({
            "frame_id": frames["frame_id"].take(of), "group_id": entries["group_id"].take(by_ord[at]), "ord": pa.array(taken, entries.schema.field("ord").type), "d": pa.array(d, pa.int32()),
        })

    return run
