import datetime as dt
import random
import time

import pytest
from pyspark.sql import functions as F

from halyard.operators.asof import as_of
from halyard.operators.tracking import hold_rectangles
from halyard.presets import APP, HOOK
from halyard.streaming import playback, session

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
START = dt.datetime(2024, 1, 1)


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    yield spark
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


@pytest.mark.parametrize("span", [None, 7, 1])
def test_as_of_is_the_last_version_before(spark, span):
    rng = random.Random(3)
    key = lambda: rng.choice(["a", "a", "a", "b", None])
    rows = [(k, key(), rng.choice([None, *range(60)])) for k in range(200)]
    versions = [(key(), rng.choice([None, *range(60)]), rng.randrange(9)) for _ in range(60)]
    left = spark.createDataFrame(rows, "id int, key string, at int")
    right = spark.createDataFrame(versions, "key string, at int, v int")
    got = as_of(left, right, ["key"], "at", F.col("v"), "version", F.floor(F.coalesce("at", F.lit(-1)) / span) if span else None)
    assert got.columns == ["id", "key", "at", "version"]
    place = lambda x: -1 if x is None else x
    for r in got.collect():
        known = [(place(a), v) for k, a, v in versions if k == r["key"] and place(a) <= place(r["at"])]
        assert r["version"] == (max(known)[1] if known else None), r
    assert got.count() == 200 and as_of(left.limit(0), right, ["key"], "at", F.col("v"), "version").count() == 0
    assert {r["version"] for r in as_of(left, right.limit(0), ["key"], "at", F.col("v"), "version").collect()} == {None}


def test_held_rectangles_are_those_of_the_loop(spark):
    rng = random.Random(5)
    rows = []
    for s in ("a", "b"):
        for k in range(150):
            found = rng.random() < 0.4
            rows.append((s, k, rng.choice([found, found, None]), rng.choice([0.2, 0.6, 0.9, None]), k if rng.random() < 0.9 else None))
    df = spark.createDataFrame(rows, "s string, k int, detected boolean, confidence double, rect int")
    got = {(r["s"], r["k"]): r for r in hold_rectangles(df, ["s"], ["k"], F.col("rect")).collect()}
    for s in ("a", "b"):
        own = [r for r in rows if r[0] == s]
        wanted = session.hold_rectangles([(bool(d) and rect is not None, c or 0, rect) for *_, d, c, rect in own])
        assert [got[s, k]["used"] for k in range(150)] == wanted
        for (_, k, d, _, rect), used in zip(own, wanted, strict=True):
            assert got[s, k]["shown"] == (rect if d and rect is not None else used)
            assert got[s, k]["held_for"] == (None if used is None else k - used)


def test_throttle_skips_every_second_frame_until_something_is_tracked():
    frame = lambda i, best, d: {"session_id": "s", "frame_id": i, "best_id": best, "best_distance": d, "second_id": 9, "second_distance": 40, "sharpness": 500.0, "glare_percent": 0.0, "brightness": 130.0}
    state, preset = session.State(), HOOK.with_(throttle=True, continuous=True)
    rows = [(1, 13)] * 4 + [(None, None)] * 4 + [(2, 8)] * 3
    got = [session.step(state, frame(i, *r), preset)["event"] for i, r in enumerate(rows)]
    assert got == ["skipped", "candidate", "confirmed", "already_recognized", "skipped", "no_match", "skipped", "no_match", "skipped", "confirmed_instant", "skipped"]
    assert session.step(state, frame(3, 2, 8), preset)["event"] == "dropped" and state.presented == 11  # late frames aren't presented


def messages():
    rng = random.Random(1)
    out = []
    for s in ("a", "b", "c"):
        for i in range(60):
            at = START + dt.timedelta(seconds=i)
            d = rng.randint(5, 30)
            if (s != "c" and i == 0) or rng.random() < 0.15:
                threshold = rng.choice([None, 14, 18, 20, 5])
                out.append((s, i, at, "init" if i == 0 else "config-update", (threshold, rng.choice([None, 1, 8]), rng.choice([None, 10.0, 200.0]), None, None, None), *[None] * 8))
            elif i % 17 != 9 or s != "c":
                out.append((s, i, at, "frame", None, rng.randrange(3), d, 9, d + rng.randint(0, 9), rng.uniform(0, 300), rng.uniform(0, 50), rng.uniform(0, 256), None))
    return out


def test_settings_in_a_stream_that_is_restarted_and_expires(rocks, tmp_path):
    spark, rows, path = rocks, messages(), str(tmp_path / "in")
    df = spark.createDataFrame(rows, session.MESSAGE)
    batch = {(r["session_id"], r["frame_id"]): r for r in session.recognize_messages(df, APP).collect()}
    assert len(batch) == sum(r[3] == "frame" for r in rows) and {"not_initialized", "confirmed_instant"} <= {r["event"] for r in batch.values()}

    def feed(*parts):
        for part in parts:
            part.coalesce(1).write.mode("append").parquet(path)
            time.sleep(1.1)  # files are taken in order of their time

    def drain():
        stream = spark.readStream.schema(session.MESSAGE).option("maxFilesPerTrigger", 1).parquet(path)
        out = session.recognize_messages_stream(stream, APP, "1 seconds", 30_000)
        query = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        query.awaitTermination()
        return query

    feed(df.filter("frame_id < 20"), df.filter("frame_id >= 20 and frame_id < 40"))
    drain()
    feed(df.filter("frame_id >= 40"))
    drain()  # restarted from its checkpoint
    got = spark.read.schema(session.DECISION).parquet(str(tmp_path / "out"))
    assert {(r["session_id"], r["frame_id"]): r for r in got.filter("event <> 'session_closed'").collect()} == batch
    # another session's messages, much later, move the watermark past the others' timers
    later = [("z", k, START + dt.timedelta(minutes=10 * k), "init", (14, None, None, None, None, None), *[None] * 8) for k in (1, 2)]
    for row in later:
        feed(spark.createDataFrame([row], session.MESSAGE))
    query = drain()
    closed = {r["session_id"]: r for r in spark.read.schema(session.DECISION).parquet(str(tmp_path / "out")).filter("event = 'session_closed'").collect()}
    last = {s: max((k, r) for (x, k), r in batch.items() if x == s and r["event"] != "not_initialized")[1] for s in "abc"}
    assert {s: (r["frame_id"], r["recognized"]) for s, r in closed.items() if s in "abc"} == {s: (r["frame_id"], r["recognized"]) for s, r in last.items()}
    assert query.exception() is None
    again = ("a", 0, START + dt.timedelta(minutes=21), "frame", None, 1, 8, 9, 20, 100.0, 0.0, 130.0, None)
    feed(spark.createDataFrame([again], session.MESSAGE))
    drain()
    fresh = spark.read.schema(session.DECISION).parquet(str(tmp_path / "out")).filter("session_id = 'a' and frame_id = 0").collect()
    assert "not_initialized" in {r["event"] for r in fresh}  # its settings went with its state


SONGS = [{"id": 1, "audio": "x"}, {"id": 2, "audio": "y"}, {"id": 3, "audio": None}, {"id": 4, "audio": "x"}]


def happens(*concerts, songs=SONGS, band="b", state=None):
    state, out = state or playback.Playback(), []
    for k, c in enumerate(concerts):
        audio = next((s["audio"] for s in songs if s["id"] == c), None)
        event = {"session_id": "s", "seq": k, "concert_id": c, "is_active": True, "band": band, "audio": audio, "songs": songs}
        out.append(playback.switch(state, event))
    return out, state


def test_switching():
    out, state = happens(1, 1, None, 1, 2, 3, 4)
    # 2, then 4, are recognized while another of the band plays: each moves on to a track of other sound
    assert [r["action"] for r in out] == ["started", "same", "cleared", "already_playing", "advanced", "silent", "advanced"]
    assert out[4]["playing"] == 2 and out[6]["playing"] in (1, 4)
    only = [{"id": 1, "audio": "x"}, {"id": 4, "audio": "x"}]
    out, _ = happens(1, 4, songs=only)
    assert out[1]["action"] == "kept" and out[1]["tries"] == 4 and out[1]["playing"] == 1
    out, _ = happens(1, 7, songs=[{"id": 1, "audio": "x"}, {"id": 7, "audio": "x"}][:1] + [])
    assert out[1]["action"] == "silent"
    _, state = happens(1)
    out, state = happens(1, 9, songs=[{"id": 9, "audio": "q"}], band="other", state=state)
    assert [r["action"] for r in out] == ["same", "started"] and state.band == "other" and state.playlist == [9]


def test_playlists_of_batches_and_streams(rocks, tmp_path):
    spark, rng = rocks, random.Random(9)
    concerts = spark.createDataFrame([(i, f"b{i % 3}", None if i % 5 == 0 else f"a{i % 4}") for i in range(1, 20)], "id int, band string, audio string")
    rows = [(s, k, rng.random() < 0.9, rng.choice([None, 99, *range(1, 20)])) for s in "ab" for k in range(120)]
    events = playback.with_songs(spark.createDataFrame(rows, "session_id string, seq int, is_active boolean, concert_id int"), concerts)
    batch = sorted(map(tuple, playback.play(events).collect()))
    assert {"started", "advanced", "same", "silent", "cleared", "inactive"} <= {r[2] for r in batch} and {r[5] for r in batch} >= {0, 1, 2}
    path = str(tmp_path / "events")
    for k in range(3):
        events.filter(f"seq >= {40 * k} and seq < {40 * k + 40}").coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.1)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(path)
    query = playback.play_stream(stream).writeStream.format("memory").queryName("played").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    query.stop()
    assert sorted(map(tuple, spark.table("played").collect())) == batch


def test_a_quiet_session_is_forgotten(rocks, tmp_path):
    spark, path = rocks, str(tmp_path / "events")
    concerts = spark.createDataFrame([(1, "b", "x"), (2, "b", "y")], "id int, band string, audio string")
    events = playback.with_songs(spark.createDataFrame([("s", 0, True, 1), ("s", 1, True, 2)], "session_id string, seq int, is_active boolean, concert_id int"), concerts)
    events.filter("seq = 0").coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(events.schema).parquet(path)
    query = playback.play_stream(stream, 1000).writeStream.format("memory").queryName("quiet").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()

    def wait(n):
        until = time.time() + 60
        while spark.table("quiet").count() < n and time.time() < until:
            time.sleep(0.5)

    try:  # a query with processing-time state has a next batch always, so it is not waited for to end
        wait(1)
        time.sleep(2)
        events.filter("seq = 1").coalesce(1).write.mode("append").parquet(path)
        wait(2)
    finally:
        query.stop()
    assert [(r["seq"], r["action"]) for r in spark.table("quiet").orderBy("seq").collect()] == [(0, "started"), (1, "started")]
