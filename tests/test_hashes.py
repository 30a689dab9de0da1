import numpy as np
import pandas as pd
import pyarrow as pa
import pyspark
import pytest
from pyspark.sql import functions as F

from halyard.functions import hashes as H
from halyard.functions import images
from halyard.operators import matching, near, telemetry
from halyard.presets import APP, AUDIT, Preset


def one(spark, *cols):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()


def hexes(*values):
    return F.array(*map(F.lit, values))


ZERO, ONE, ALL = "0" * 16, "0" * 15 + "1", "f" * 16


def test_distances(spark):
    r = one(spark, H.hamming(F.lit(ZERO), F.lit(ONE)), H.hamming(F.lit(ZERO), F.lit(ALL)), H.hamming(F.lit("f" * 32), F.lit("0" * 32)), H.hamming(F.lit("FF"), F.lit("ff")))
    assert tuple(r) == (1, 64, 128, 0)
    assert tuple(one(spark, H.hamming_or_infinite(F.lit("00"), F.lit("000")), H.hamming_or_infinite(F.lit("0g"), F.lit("00")))) == (float("inf"),) * 2
    with pytest.raises(Exception, match="lengths differ"):
        one(spark, H.hamming(F.lit("00"), F.lit("0")))


def test_similarity(spark):
    r = one(spark, H.similarity(F.lit(1)), H.similarity(F.lit(10)), H.similarity_percent(F.lit(10)), H.similarity(F.lit(1), 32))
    assert tuple(r) == (98.44, 84.38, 84.375, 99.22)


def test_hex_and_bits(spark):
    r = one(spark, H.hex_to_binary(F.lit("a5")), H.binary_to_hex(F.lit("10100101")), H.binary_to_hex(F.lit("")), H.binary_to_hex(F.lit("101")))
    assert tuple(r) == ("10100101", "a5", "", "5")
    hi, lo = H.halves(F.lit("ffffffff00000001"))
    assert tuple(one(spark, hi, lo, H.halves_to_hex(hi, lo))) == (2**32 - 1, 1, "ffffffff00000001")


def test_near_duplicates_in_order(spark):
    h = hexes(ZERO, ZERO, ONE, ALL)
    r = one(spark, H.prune_near(h, 1), H.prune_near(h, 0), H.append_novel(hexes(ONE, ZERO), h, 1))
    assert r["c0"] == [ZERO, ALL] and r["c1"] == [ZERO, ONE, ALL] and r["c2"] == [ONE, ZERO, ALL]


def test_validity(spark):
    mixed = F.array(F.lit(ZERO), F.lit("xyz"), F.lit(ALL.upper()), F.lit(None).cast("string"))
    r = one(spark, H.valid_hashes(mixed), H.strictly_valid(mixed), H.strictly_valid(hexes(ZERO)), H.has_hashes(hexes("")), H.has_hashes(F.lit(None).cast("array<string>")))
    assert tuple(r) == ([ZERO, ALL.upper()], False, True, False, False)


def brute_two(frame, entries):
    best = min(((bin(frame ^ h).count("1"), o, g) for g, o, h in entries), default=None)
    if best is None:
        return None, None, None, None
    rival = min(((bin(frame ^ h).count("1"), o, g) for g, o, h in entries if g != best[2]), default=(None, None, None))
    return best[2], best[0], rival[2], rival[0]


@pytest.mark.parametrize("block", [10**6, 7])
def test_best_two_against_all_pairs(spark, block):
    rng = np.random.default_rng(1)
    values = [int(x) for x in rng.integers(0, 2**16, 60)]  # few bits, so that there are ties
    entries = [(int(rng.integers(5)), o, values[o]) for o in range(40)]
    frames = [(100 + i, values[i % 60] ^ int(rng.integers(4))) for i in range(50)]
    split = lambda v: (v >> 32, v & 0xFFFFFFFF)
    f = spark.createDataFrame([(i, *split(v)) for i, v in frames], "frame_id long, hi long, lo long")
    x = spark.createDataFrame([(g, o, *split(v)) for g, o, v in entries], "group_id int, ord int, hi long, lo long")
    got = {r["frame_id"]: (r["best_id"], r["best_distance"], r["second_id"], r["second_distance"]) for r in matching.best_two(f, x, block).collect()}
    wanted = {i: brute_two(v, entries) for i, v in frames}
    assert got == wanted
    index = F.array(*[F.struct(F.lit(g).alias("group_id"), F.lit(o).alias("ord"), F.lit(v >> 32).cast("long").alias("hi"), F.lit(v & 0xFFFFFFFF).cast("long").alias("lo")) for g, o, v in entries])
    again = f.select("frame_id", matching.best_two_of_array(F.col("hi"), F.col("lo"), index).alias("m")).collect()
    assert {r["frame_id"]: (r["m"]["best_id"], r["m"]["best_distance"], r["m"]["second_id"], r["m"]["second_distance"]) for r in again} == wanted
    assert matching.best_two(f, x.limit(0), block).filter("best_id is not null").count() == 0


CASES = [
    # best, second, preset, outcome
    (10, 30, APP, "active"), (18, 24, APP, "active"), (18, 23, APP, "ambiguous"), (17, 23, APP, "active"), (17, 22, APP, "ambiguous"), (16, 21, APP, "active"), (16, 20, APP, "ambiguous"),
    (18, 23, AUDIT, "active"), (12, 12, APP, "ambiguous"), (19, 40, APP, "near_threshold"), (20, 40, APP, "near_threshold"), (21, 40, APP, "no_match"), (14, None, Preset(), "active"), (None, None, APP, "no_match"),
]


@pytest.mark.parametrize(("best", "second", "preset", "outcome"), CASES)
def test_decisions(spark, best, second, preset, outcome):
    df = spark.createDataFrame([(best, second)], "best_distance int, second_distance int")
    assert matching.decide(df, preset).first()["outcome"] == outcome


def test_delays(spark):
    d = [one(spark, matching.adaptive_delay(F.lit(x), 150))["c0"] for x in (13, 14, 16, 17)]
    assert d == [75, 150, 150, 195]
    assert one(spark, matching.adaptive_delay(F.lit(3), 1))["c0"] == 1


def test_preset_sanity():
    with pytest.raises(ValueError):
        Preset(threshold=11)


def test_telemetry_pieces(spark):
    r = one(spark, telemetry.pair_key(F.lit("b"), F.lit("a")), telemetry.pair_key(F.lit("b"), F.lit(None)), telemetry.ordered_pair_key(F.lit("b"), F.lit("a")), telemetry.dominant_cause(F.lit(1), F.lit(2), F.lit(2)))
    assert tuple(r) == ("a vs b", "Unknown rival vs b", "b vs a", "glare")
    bins = [one(spark, telemetry.margin_bin(F.lit(m).cast("int")))["c0"] for m in (None, 0, 1, 2, 3, 4, 5)]
    assert bins == ["unknown", "0-1", "0-1", "2", "3-4", "3-4", "5+"]
    assert one(spark, telemetry.histogram_peak(hexes(0, 3, 3)))["c0"] == 1 and one(spark, telemetry.histogram_peak(hexes(0, 0)))["c0"] is None


def test_best_two_by_numbers_and_by_structs(spark):
    rng = np.random.default_rng(4)
    rows = [(int(g), int(o), int(h), int(x)) for g, o, h, x in zip(rng.integers(0, 5, 60), rng.permutation(60), rng.integers(0, 2**32, 60), rng.integers(0, 2**32, 60), strict=True)]
    index = spark.createDataFrame(rows, "group_id int, ord long, hi long, lo long")
    frames = index.select(F.col("ord").alias("frame_id"), "hi", "lo").limit(20)
    shift = lambda df, c: df.withColumn(c, F.col(c) - 1000)
    one = sorted(map(tuple, matching.best_two(frames, index, not_own=True).collect()))
    for other in (matching.best_two(shift(frames, "frame_id"), shift(index, "ord"), not_own=True), matching.best_two(shift(frames, "frame_id"), shift(index, "ord"), 7, True)):
        assert sorted((f + 1000, b, o + 1000, d, s, e) for f, b, o, d, s, e in other.collect()) == one
    of = {o: (g, h, x) for g, o, h, x in rows}
    for f, best, o, d, second, e in one:
        near = {}
        for k, (g, h, x) in of.items():
            if k != f:
                near[g] = min(near.get(g, (99, 0)), ((h ^ of[f][1]).bit_count() + (x ^ of[f][2]).bit_count(), k))
        first, then = sorted((m, g) for g, m in near.items())[:2]
        assert (best, d, o, second, e) == (first[1], *first[0], then[1], then[0][0])
    assert matching.best_two(frames, index.limit(0)).filter("best_id is null").count() == 20


@pytest.mark.parametrize(("radius", "bands"), [(0, 1), (3, 2), (10, None), (14, 5), (20, 13)])
def test_bands_find_all_within_the_radius(spark, radius, bands):
    import random

    from halyard.operators import matching

    rng = random.Random(radius)
    bases = [rng.getrandbits(64) for _ in range(6)]
    flip = lambda x: x ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 24)))
    index = [(i, i % 7, flip(rng.choice(bases))) for i in range(120)]
    frames = [(1000 + i, flip(rng.choice(bases))) for i in range(60)] + [(3, index[3][2]), (2000, index[5][2]), (2001, index[5][2])]
    idx = spark.createDataFrame([(g, o, h >> 32, h & 0xFFFFFFFF) for o, g, h in index], "group_id int, ord long, hi long, lo long")
    df = spark.createDataFrame([(i, h >> 32, h & 0xFFFFFFFF) for i, h in frames], "frame_id long, hi long, lo long")
    got = sorted((r["frame_id"], r["ord"], r["d"]) for r in matching.within(df, idx, radius, True, bands).collect())
    assert got == sorted((i, o, d) for i, h in frames for o, _, x in index if o != i and (d := (h ^ x).bit_count()) <= radius)
    assert matching.within(df, idx.limit(0), radius).count() == 0 and matching.best_within(df, idx.limit(0), radius).count() == len(frames)


def test_bands_grow_with_the_index():
    from halyard.operators import matching

    assert matching.band_width(10, 10) >= matching.band_width(10, 10**9) and matching.band_width(0, 5) == 1


def test_pairs_are_compared_in_blocks_for_all_tasks(spark):
    f, i = matching.blocks(150_000, 150_000, matching.BLOCK_ENTRIES, 12)
    assert (f * i >= 24) and 150_000 / f <= matching.BLOCK_FRAMES and matching.blocks(0, 0, 7, 4) == (8, 1)
    rows = spark.range(40).select(F.col("id").alias("frame_id"), F.xxhash64("id").bitwiseAND(2**32 - 1).alias("hi"), F.col("id").alias("lo"))
    index = rows.select(F.col("frame_id").alias("ord"), F.when(F.col("frame_id") % 3 > 0, F.col("frame_id") % 3).alias("group_id"), "hi", "lo")
    out = matching.best_two(rows, index, 9, True)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan and "FlatMapCoGroupsInArrow" in plan
    of = {r["ord"]: (r["group_id"], r["hi"] << 32 | r["lo"]) for r in index.collect()}
    for r in out.collect():  # a group may be null
        near = sorted(((of[r["frame_id"]][1] ^ h).bit_count(), o, g) for o, (g, h) in of.items() if o != r["frame_id"])
        assert (r["best_distance"], r["best_ord"], r["best_id"]) == near[0]
        assert (r["second_distance"], r["second_id"]) == next((d, g) for d, _, g in near if g != near[0][2])


def test_fingerprints_without_halves_have_no_entry(spark):
    df = spark.createDataFrame([(1, 5, 6), (2, None, 6), (3, 5, 7)], "frame_id long, hi long, lo long")
    index = df.select(F.col("frame_id").alias("ord"), F.lit("g").alias("group_id"), "hi", "lo")
    got = {r["frame_id"]: r["best_ord"] for r in matching.best_two(df, index, not_own=True).collect()}
    assert got == {1: 3, 2: None, 3: 1}


def test_coefficients_are_sorted_once(spark):
    values = [float((i * 37) % 64) for i in range(64)]
    row = spark.createDataFrame([(values,), ([None] * 3 + values[3:],)], "v array<float>").select(*(x.alias(n) for x, n in zip(H.quantise(F.col("v")), ("hi", "lo"), strict=True)))
    got = row.collect()
    for r, v in zip(got, (values, [None] * 3 + values[3:]), strict=True):
        median = sorted(x for x in v[:63] if x is not None)[31]
        bits = "".join("1" if x is not None and x > median else "0" for x in v[:63]) + "0"
        assert (r["hi"], r["lo"]) == (int(bits[:32], 2), int(bits[32:], 2))
    step = row._jdf.queryExecution().optimizedPlan().toString().split("lambdafunction", 1)[1].split(" AS hi")[0]
    assert "sort" not in step


def test_near_duplicates_of_long_lists(spark):
    import random

    rng = random.Random(3)
    bases = [rng.getrandbits(64) for _ in range(300)]
    flip = lambda x: x ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 9)))
    odd = [None, "", "", "xy", "xy", "ABCDEF0123456789", "abcdef0123456789", "0f", "0F", "1f", "f" * 33, "f" * 32 + "e", "0" * 33]
    lists = [[f"{flip(rng.choice(bases)):016x}" for _ in range(2500)] + odd + [None], odd, []]

    def plain(base, more, most):
        kept = list(base)
        fine = lambda s: s is not None and all(c in "0123456789abcdefABCDEF" for c in s)
        for x in more:
            if not any(fine(x) and fine(y) and len(x) == len(y) and (int(x or "0", 16) ^ int(y or "0", 16)).bit_count() <= most for y in kept):
                kept.append(x)
        return kept

    df = spark.createDataFrame([(i, x) for i, x in enumerate([*lists, None])], "i int, h array<string>")
    out = df.select("i", H.prune_near(F.col("h"), 6).alias("kept"), H.append_novel(F.slice("h", 1, 3), F.col("h"), 2).alias("more")).collect()
    for r in out:
        x = [*lists, None][r["i"]]
        assert r["kept"] == (None if x is None else plain([], x, 6)) and r["more"] == (None if x is None else plain(x[:3], x, 2))


@pytest.mark.parametrize(("groups", "rows"), [(3, 400), (1, 150)])
def test_best_two_by_bands_against_all_pairs(spark, monkeypatch, groups, rows):
    rng = np.random.default_rng(rows)
    bases = rng.integers(0, 2**63, 40)
    values = [int(bases[rng.integers(40)]) ^ sum(1 << int(b) for b in rng.integers(0, 64, rng.integers(0, 6))) for _ in range(rows - 60)] + [int(bases[0])] * 50 + [int(x) for x in rng.integers(0, 2**63, 10)]
    of = {o: (int(rng.integers(groups)), v) for o, v in enumerate(values)}
    index = spark.createDataFrame([(g, o, v >> 32, v & 0xFFFFFFFF) for o, (g, v) in of.items()], "group_id int, ord long, hi long, lo long")
    frames = index.select(F.col("ord").alias("frame_id"), "hi", "lo").unionByName(spark.createDataFrame([(rows, None, 5)], "frame_id long, hi long, lo long"))
    for name, value in (("ROUND", 0.0), ("CALL", 0.0), ("LOOKED_UP", 0.0), ("KEPT", 100), ("CELL_ROWS", 150)):
        monkeypatch.setattr(near, name, value)
    made = []
    monkeypatch.setattr(near, "nearest_within", lambda *how, true=near.nearest_within: made.append(how) or true(*how))
    got = {r["frame_id"]: tuple(r)[1:] for r in matching.best_two(frames, index, not_own=True, few=100).collect()}
    assert made and len(got) == rows + 1 and got[rows] == (None,) * 5
    for f, (_, v) in of.items():
        others = sorted(((v ^ h).bit_count(), o, g) for o, (g, h) in of.items() if o != f)
        d, o, g = others[0]
        rival = next(((x, e) for x, _, e in others if e != g), (None, None))
        assert got[f] == (g, o, d, rival[1], rival[0])


def test_bands_miss_nothing_and_their_work_grows_slowly():
    for radius, bands, wider in ((12, 4, 2), (14, 5, 3), (3, 6, 0), (16, 7, 1)):
        made = near.layout(radius, bands, wider)
        assert sum(t + 1 for _, _, t in made) == radius + 1 and (bands > radius + 1 or sum(w for _, w, _ in made) == 64)
    assert near.plan(2000, 2000, [14] * 10, 24) is None
    radius, bands = near.plan(15_000_000, 15_000_000, [10] * 400 + [12] * 598 + [14] * 2, 24)
    f, i = near.cells_of(15_000_000, 15_000_000, 24)
    assert near.work(bands, 15_000_000 // f, 15_000_000 // i) * f * i < 15_000_000**2 * near.WHOLE / 25


def test_quantised_as_quantise_for_odd_vectors(spark):
    rng, nan = np.random.default_rng(1), float("nan")
    rows = [(0, None)]
    for k in range(1, 200):
        v = [float(x) for x in rng.integers(-6, 6, rng.choice([0, 1, 31, 32, 33, 40, 62, 63, 64, 70]))]
        odd = [None, nan, float("inf"), -0.0][k % 4]
        rows.append((k, [odd if rng.random() < 0.2 else x for x in v]))
    for kind in ("float", "double"):
        df = spark.createDataFrame(rows, f"k int, v array<{kind}>")
        of = lambda made: {tuple(r) for r in df.select("k", *made(F.col("v"))).collect()}  # noqa: B023, E731
        assert of(H.quantised) == of(H.quantise)
    assert "lambdafunction" not in df.select(*H.quantised(F.col("v")))._jdf.queryExecution().optimizedPlan().toString()


def test_cells_get_partitions_of_their_own(spark):
    for n in (1, 24, 60):
        keys = spark.createDataFrame([(k,) for k in matching.apart_keys(spark, n)], "cell bigint")
        assert keys.repartition(n, "cell").select(F.spark_partition_id().alias("p")).distinct().count() == n
    frames = spark.range(40).select(F.col("id").alias("frame_id"), F.col("id").alias("hi"), F.lit(0).cast("bigint").alias("lo"))
    index = frames.select(F.col("frame_id").alias("ord"), F.lit(0).alias("group_id"), "hi", "lo")

    def where(f, e):
        return pa.table({"frame_id": [pyspark.TaskContext.get().partitionId()], "group_id": pa.array([0], pa.int32()), "ord": [0], "d": pa.array([0], pa.int32())})

    assert matching._met(frames, index, 3, 4, where).filter("best_distance = 0").count() == 12


def test_made_images_go_on_in_pieces(spark):
    made = images._image_of(images.letterbox)
    whole = lambda n: (pd.Series([4] * n), pd.Series([4] * n), pd.Series([bytes([k % 251] * 64) if k % 7 else None for k in range(n)]))
    pieces = list(made.func(iter([whole(3000), whole(0), whole(5)])))
    assert max(sum(len(x or b"") for x in p) for p in pieces) < images.PIECE + 4096 and len(pieces) > 4
    out = [x for p in pieces for x in p]
    assert len(out) == 3005 and [x is None for x in out] == [k % 7 == 0 for k in [*range(3000), *range(5)]] and out[1][:4] == bytes([1] * 4)
    rows = spark.range(3000, numPartitions=1).select("id", F.lit(4).alias("h"), F.when(F.col("id") % 7 > 0, F.expr("unhex(repeat(lpad(hex(id % 251), 2, '0'), 64))")).alias("d"))
    got = rows.select("id", made("h", "h", "d").alias("x")).collect()
    assert all((r["x"] is None) == (r["id"] % 7 == 0) and (r["x"] is None or bytes(r["x"]) == out[r["id"]]) for r in got) and len(got) == 3000


@pytest.mark.parametrize("need", ["second_id", "best_id", "second_distance", "best_distance"])
@pytest.mark.parametrize("even", [True, False])
def test_needs_by_bands_against_all_pairs(spark, monkeypatch, need, even):
    rng = np.random.default_rng(7)
    bases = [int(x) for x in rng.integers(0, 2**62, 30)]
    values = [(bases[rng.integers(30)] ^ sum(1 << int(b) for b in rng.choice(60, rng.integers(0, 6), replace=False))) << 1 for _ in range(200)] + [bases[0] << 1] * 40
    values = [v ^ (v.bit_count() % 2 << 63) if even else v for v in values]
    index = spark.createDataFrame([(int(rng.integers(4)), o, v >> 32, v & 0xFFFFFFFF) for o, v in enumerate(values)], "group_id int, ord long, hi long, lo long")
    frames = index.select(F.col("ord").alias("frame_id"), "hi", "lo")
    assert matching._even_and_length(frames, index) == (even, 63)
    for name, value in (("ROUND", 0.0), ("CALL", 0.0), ("LOOKED_UP", 0.0), ("KEPT", 100), ("CELL_ROWS", 150)):
        monkeypatch.setattr(near, name, value)
    made = []
    monkeypatch.setattr(near, "nearest_within", lambda *how, true=near.nearest_within: made.append(how) or true(*how))
    out = matching.best_two(frames, index, not_own=True, few=100, need=need)
    columns = matching.NEEDED[need]
    assert made and out.columns == ["frame_id", *columns] and all(start + width <= 63 for _, bands, _ in made for start, width, _ in bands)
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, matching.best_two(frames, index, not_own=True).select("frame_id", *columns).collect()))


def test_frames_of_near_keys_meet_in_one_cell(spark):
    rng = np.random.default_rng(2)
    values = [int(x) for x in rng.integers(0, 2**63, 3000)] + [5] * 1500
    index = spark.createDataFrame([(0, o, v >> 32, v & 0xFFFFFFFF, None) for o, v in enumerate(values)], "group_id int, ord long, hi long, lo long, ord_2 long")
    bands = [(0, 20, 1), (20, 44, 2)]

    def seen(frames, entries):
        x = frames["bits"].to_numpy().view(np.uint64)
        k = set(near.keys_of(x, *bands[frames["band"][0].as_py()][:2]).tolist())
        return pa.table({"frame_id": [frames["band"][0].as_py() * 100 + pyspark.TaskContext.get().partitionId()], "group_id": pa.array([len(k)], pa.int32()), "ord": [len(x)], "d": pa.array([len(entries)], pa.int32())})

    f, rows = index.select(F.col("ord").alias("frame_id"), "hi", "lo"), []
    monkey = pytest.MonkeyPatch()
    monkey.setattr(matching, "_first_and_rival", lambda found: rows.append(1) or F.struct(F.get(found, F.lit(0)).alias("m")))
    met = matching._met_by_keys(f, index, bands, [3, 3], 2, seen)
    monkey.undo()
    cells = [r["m"] for r in met.filter("m is not null").collect()]
    assert len(cells) == 12 and sum(c["ord"] for c in cells) == 2 * 2 * 4500 and sum(c["d"] for c in cells) == 2 * 3 * 4500
    assert max(c["ord"] for c in cells) < 1.2 * 1500 and sum(c["group_id"] for c in cells) < 2 * 2 * 3100
