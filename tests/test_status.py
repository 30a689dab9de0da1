import pytest
from pyspark.sql import functions as F

from halyard.functions import status as S
from halyard.plans import phases


def one(spark, c):
    return spark.range(1).select(c.alias("c")).first()["c"]


def test_statuses(spark):
    t, f = F.lit(True), F.lit(False)
    assert one(spark, S.experience_status(f, t, t, f, f)) == "switch-available" and one(spark, S.experience_status(f, f, f, f, f)) == "idle"
    none = F.lit(None).cast("int")
    assert one(spark, S.recognition_status(none, f, none)) == "IDLE" and one(spark, S.recognition_status(none, t, none)) == "MATCHING"


def test_logs(spark):
    log = F.lit("ERROR: [youtube] abc-1: Video unavailable \nx\nERROR: [youtube:tab] d_2: other\nERROR: [youtube:music] e: Private video. Sign in")
    assert [tuple(e) for e in one(spark, S.unavailable_entries(log))] == [("abc-1", "Video unavailable"), ("e", "Private video. Sign in")]
    assert one(spark, S.already_archived(F.lit("x has already been recorded in the archive"))) and not one(spark, S.already_archived(F.lit(None).cast("string")))


def test_thumbnails_and_choices(spark):
    kind = "array<struct<url:string,width:int,height:int>>"
    thumbs = F.from_json(F.lit('[{"url":"a","width":2,"height":2},{"url":"b","width":4,"height":1},{"width":9,"height":9},{"url":"c"}]'), kind)
    assert one(spark, S.best_thumbnail(thumbs, F.lit("d"))) == "a" and one(spark, S.best_thumbnail(F.from_json(F.lit("[]"), kind), F.lit("d"))) == "d"
    assert one(spark, S.one_of(F.lit("ON"), ["on", "off"], "constrained")) == "on" and one(spark, S.one_of(F.lit(None).cast("string"), ["on"], "constrained")) == "constrained"
    assert tuple(one(spark, S.freshness(F.lit("2024.01.01"), F.lit("2024-01-31").cast("date"), 30))) == (30, True)
    assert tuple(one(spark, S.freshness(F.lit("v1"), F.lit("2024-01-31").cast("date"), 30))) == (None, False)
    flags = spark.createDataFrame([("a", True), ("b", None), ("z", True)], "id string, enabled boolean")
    assert [tuple(r) for r in S.saved_flags(flags, ["a", "b"]).collect()] == [("a", True)]
    ids = spark.createDataFrame([(3,), (1,), (3,), (None,)], "i int")
    assert S.id_list(ids, "i").first()["ids"] == "1,3" and S.id_list(ids.limit(0), "i").first()["ids"] is None


def test_phases():
    assert phases.phase_range("encode", "apply-cdn") == ("encode", "upload", "build-data")
    with pytest.raises(ValueError):
        phases.phase_range("validate", "encode")
    records = []
    steps = {"download": lambda: 3, "encode": lambda: 0, "upload": lambda: 1}
    log = phases.run_phases(steps, ("download", "encode", "upload"), lambda x: records.append(len(x)))
    assert [r["status"] for r in log] == ["completed", "failed"] and records == [1, 2]
    assert phases.download_plans([], ["web", "tv"]) == ["opus@web", "opus@tv", "mp3@web", "mp3@tv"] and phases.download_plans(["mp4", "x"], ["web"], True) == ["mp4@web"]
    assert phases.playlist_items("1:5:2,9") == [1, 3, 5, 9] and phases.playlist_items("all") is None
