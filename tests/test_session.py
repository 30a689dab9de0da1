import numpy as np
import pytest

from halyard.functions import images, rectangles
from halyard.presets import APP, HOOK
from halyard.schemas import FRAME
from halyard.streaming import session

GOOD = {"sharpness": 500.0, "glare_percent": 0.0, "brightness": 130.0}


def frame(i, best=None, d=None, second=40, session_id="s", **q):
    return {"session_id": session_id, "frame_id": i, "best_id": best, "best_distance": d, "second_id": 99, "second_distance": second if d is not None else None, "pre_hash_sharpness": None} | GOOD | q


def events(frames, preset=HOOK):
    state = session.State()
    return [session.step(state, f, preset)["event"] for f in frames]


BLUR, GLARE, DARK = {"sharpness": 1.0}, {"glare_percent": 90.0}, {"brightness": 5.0}


@pytest.mark.parametrize(("frames", "wanted"), [
    ([(1, 8)], ["confirmed_instant"]),
    ([(1, 13), (1, 13)], ["candidate", "confirmed"]),
    ([(1, 13), (2, 13), (1, 13), (1, 13)], ["candidate", "candidate", "candidate", "confirmed"]),
    ([(1, 13), (1, 13, BLUR), (1, 13)], ["candidate", "blur_ignored", "confirmed"]),
    ([(1, 13), (1, 13, BLUR), (1, 13, BLUR), (1, 13)], ["candidate", "blur_ignored", "blur_rejected", "confirmed"]),
    ([(1, 13), *[(1, 13, BLUR)] * 3, (1, 13)], ["candidate", "blur_ignored", "blur_rejected", "blur_rejected", "candidate"]),
    ([(1, 13), (1, 13, GLARE), (1, 13)], ["candidate", "glare_rejected", "candidate"]),
    ([(1, 13), (1, 13, DARK), (1, 13)], ["candidate", "lighting_rejected", "candidate"]),
    ([(1, 13), (None, None), (1, 13)], ["candidate", "no_match", "candidate"]),
    ([(1, 8), (1, 8)], ["confirmed_instant", "dropped"]),
    ([(1, 12, BLUR)], ["candidate"]),  # close matches skip the quality check
    ([(1, 40), (1, 30, BLUR)], ["no_match", "improving"]),
])
def test_scripts(frames, wanted):
    rows = [frame(i, *f[:2], **(f[2] if len(f) > 2 else {})) for i, f in enumerate(frames)]
    assert events(rows) == wanted


def test_continuous_and_inline():
    again = [frame(0, 1, 8), frame(1, 1, 8), frame(2, 2, 9), frame(2, 2, 9)]
    assert events(again, HOOK.with_(continuous=True)) == ["confirmed_instant", "already_recognized", "confirmed_instant", "dropped"]
    gated = [frame(i, 1, 8, pre_hash_sharpness=49.0) for i in range(2)] + [frame(2, 1, 8, pre_hash_sharpness=50.0)]
    assert events(gated, HOOK.with_(path="inline")) == ["blur_ignored", "blur_rejected", "confirmed_instant"]
    lost = session.State()
    rows = [session.step(lost, f, HOOK) for f in (frame(0, 1, 13), frame(1, 1, 15))]
    assert rows[1]["failed_attempt"] and rows[1]["category"] == "collision" and rows[1]["near_miss"]


def test_batch_and_stream_decide_alike(spark, tmp_path):
    rng = np.random.default_rng(0)
    rows = []
    for s in ("a", "b", "c"):
        for i in range(40):
            d = int(rng.integers(5, 30))
            rows.append((s, i, None, None, int(rng.integers(3)), d, 9, d + int(rng.integers(0, 9)), float(rng.integers(0, 300)), float(rng.integers(0, 50)), float(rng.integers(0, 256)), None))
    df = spark.createDataFrame(rows, FRAME)
    batch = {(r["session_id"], r["frame_id"]): r for r in session.recognize(df, APP).collect()}
    path = str(tmp_path / "frames")
    for k in range(4):
        df.filter(f"frame_id >= {10 * k} and frame_id < {10 * k + 10}").coalesce(1).write.mode("append").parquet(path)
        if k < 3:
            import time

            time.sleep(1.1)  # files are taken in order of their time
    stream = spark.readStream.schema(FRAME).option("maxFilesPerTrigger", 1).parquet(path)
    query = session.recognize_stream(stream, APP).writeStream.format("memory").queryName("decisions").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    query.stop()
    got = {(r["session_id"], r["frame_id"]): r for r in spark.table("decisions").collect()}
    assert got == batch and len(got) == 120


def test_held_rectangles():
    got = session.hold_rectangles([(True, 0.9, "a"), (True, 0.2, "b"), (False, 0, None), (False, 0, None), (True, 0.2, "c")])
    assert got == ["a", "a", "a", None, None]


def picture(f, h=32, w=32):
    ys, xs = np.mgrid[0:h, 0:w]
    v = np.clip(f(xs, ys), 0, 255).astype(np.uint8)
    return np.dstack([v, v, v, np.full_like(v, 255)])


def test_fingerprints_of_pixels():
    across, down = picture(lambda x, y: np.floor(x / 31 * 255)), picture(lambda x, y: np.floor(y / 31 * 255))
    checks = picture(lambda x, y: (x // 4 + y // 4) % 2 * 255)
    hashes = [images.phash(p) for p in (across, down, checks)]
    assert len(set(hashes)) == 3 and all(len(h) == 16 and int(h, 16) % 2 == 0 for h in hashes)
    noise = np.random.default_rng(0).integers(0, 256, (32, 32, 4)).astype(np.uint8)
    c = images.coefficients(noise)
    g = images.gray(noise).astype(float)
    k = np.arange(32)
    plain = [(2**-0.5 if u == 0 else 1) * (2**-0.5 if v == 0 else 1) / 2 * sum(g[a, b] * np.cos((2 * a + 1) * u * np.pi / 64) * np.cos((2 * b + 1) * v * np.pi / 64) for a in k for b in k) for u in range(8) for v in range(8)][1:]
    assert np.allclose(c, plain) and bin(int(images.phash(noise), 16)).count("1") == 31
    assert images.dhash(across) == "0" * 32 and images.dhash(across[:, ::-1]) == "f" * 32


def test_variants_and_crops():
    p = picture(lambda x, y: (x * 7 + y * 13) % 251, 60, 90)
    v = images.hash_variants(p)
    assert 1 <= len(v["phash"]) <= 15 and all(len(h) == 32 for h in v["dhash"])
    assert set(images.crop_hash_variants(p)) == set(images.CROPS) and images.crop(p, "center-50").shape[:2] == (30, 45)
    assert images.clean_angles([8, 8.001, 0, -3.456]) == [8.0, -3.46] and len(images.exposures_and_rotations(p)) == 15
    assert (images.gamma(p, 1.0) == p).all() and images.gamma(p, 2.0).mean() < p.mean() < images.gamma(p, 0.5).mean() and images.brightness(p, 300)[..., :3].min() == 255


def test_quality():
    flat, checks = picture(lambda x, y: x * 0 + 128), picture(lambda x, y: (x + y) % 2 * 255)
    assert images.quality(flat)["sharpness"] == 0 and images.quality(checks)["is_sharp"] and images.quality(picture(lambda x, y: x * 0 + 255))["glare_percent"] == 100
    assert images.quality(picture(lambda x, y: x * 0 + 10))["light"] == "underexposed" and images.laplacian_variance(np.zeros((2, 9), np.uint8)) == 0
    assert images.changed_pixels(flat, checks, 100) == 1024 and images.motion_blur(checks).std() < checks.std() and images.low_light(flat)[..., 0].mean() < 50


def test_warp_and_letterbox():
    p = picture(lambda x, y: x * 2, 64, 96)
    corners = np.array([(0, 0), (95, 0), (95, 63), (0, 63)], float)
    assert (images.warp(p, corners, "3:2") == p).all() and images.warp(p, np.zeros((4, 2)), "3:2") is None
    assert images.letterbox(p).shape == (32, 32, 4) and images.letterbox(p)[0, 0, 0] == 0


def test_rectangles():
    scene = np.full((120, 160, 4), 20, np.uint8)
    scene[30:90, 35:125, :3] = 220
    r = rectangles.detect(scene)
    assert r["detected"] and r["confidence"] > 0.6 and abs(r["aspect"] - 1.5) < 0.1 and np.allclose(r["top_left"], (35 / 160, 30 / 120), atol=0.02)
    assert not rectangles.detect(np.full((50, 50, 4), 90, np.uint8))["detected"]
    assert rectangles.order_corners(np.array([(0, 0)] * 4)) is None
    ring = rectangles.hull(np.array([(0, 0), (4, 0), (4, 4), (0, 4), (2, 2), (2, 0)]))
    assert ring.tolist() == [[0, 0], [4, 0], [4, 4], [0, 4]]
    assert [len(x) for x in rectangles.regions(np.array([[1, 1, 0, 0], [0, 0, 1, 1], [0, 0, 0, 0], [1, 1, 1, 0]], bool))] == [4]


def test_pixel_columns(spark):
    p = picture(lambda x, y: x * 5 + y, 20, 30)
    df = spark.createDataFrame([("a", 20, 30, bytearray(p.tobytes())), ("bad", 3, 3, bytearray(b"xx"))], "id string, h int, w int, d binary")
    from pyspark.sql import functions as F

    c = (F.col("h"), F.col("w"), F.col("d"))
    rows = {r["id"]: r for r in df.select("id", images.phash_column(*c).alias("p"), images.quality_column(*c).alias("q"), images.hash_variants_column(*c).alias("v"), images.crop_hashes_column(*c).alias("k")).collect()}
    assert rows["a"]["p"] == images.phash(p) and rows["a"]["q"]["brightness"] == pytest.approx(images.quality(p)["brightness"])
    assert rows["a"]["v"]["phash"] == images.hash_variants(p)["phash"] and len(rows["a"]["k"]) == 7 and rows["bad"]["p"] is None


def test_sessions_are_walked_in_batches(spark):
    from pyspark.sql import functions as F

    from halyard.streaming.walk import walk

    rows = spark.range(3000).select((F.col("id") % 700).cast("string").alias("s"), F.col("id").alias("n")).union(spark.createDataFrame([(None, 5), (None, 4)], "s string, n bigint"))

    def step(seen, row):
        seen.append(row["n"])
        return {"s": row["s"], "n": row["n"], "k": len(seen), "last": seen[-2] if len(seen) > 1 else None}

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)  # sessions go on in the next batch
    try:
        out = walk(rows, "s", "n", list, step, "s string, n bigint, k int, last bigint")
        assert "FlatMapGroupsInPandas" not in out._jdf.queryExecution().executedPlan().toString()
        got = sorted(map(tuple, out.collect()), key=str)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    wanted = [(str(i % 700), i, i // 700 + 1, i - 700 if i >= 700 else None) for i in range(3000)] + [(None, 4, 1, None), (None, 5, 2, 4)]
    assert got == sorted(wanted, key=str)


def test_decisions_share_no_row_and_numbers_pass_as_they_are():
    import pyarrow as pa

    from halyard.streaming import session
    from halyard.streaming.walk import plain

    blank = dict(session.UNDECIDED)
    frame = {"session_id": "a", "frame_id": 1, "best_id": 2, "best_distance": 5, "second_id": 3, "second_distance": 30}
    state = session.State()
    first, then = (session.step(state, frame | {"frame_id": k}, session.Preset()) for k in (1, 2))
    assert first["event"] == "confirmed_instant" and then["event"] == "dropped" and then["best_id"] is None and session.UNDECIDED == blank
    for column in (pa.array([1, 2**62]), pa.array([1, None]), pa.array([0.5, 2.0]), pa.array([None, 0.5]), pa.array(["a", None]), pa.array([True, False]), pa.array([], pa.int32())):
        got = plain(column)
        assert got == column.to_pylist() and list(map(type, got)) == list(map(type, column.to_pylist()))
