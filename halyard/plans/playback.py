"""Queries of versioned settings, throttled sessions, held rectangles and playlists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import matching, tracking
from ..operators.asof import as_of
from ..operators.counters import Counters
from ..presets import APP
from ..streaming import playback, session
from .sessions import frames_of_events, sessions_sql
from .tables import table


def q73(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The settings in force at each frame: error events are a user's settings, the other events its frames."""
    e = table(spark, sf_dir, "events")
    frames = frames_of_events(spark, sf_dir).join(e.select(F.col("event_id").alias("frame_id"), "ts", "event_type"), "frame_id")
    versions = e.filter("event_type = 'error'").select(F.col("user_id").cast("string").alias("session_id"), "ts", "event_id")
    settings = F.struct(F.col("event_id").alias("version"), (F.lit(12) + F.col("event_id") % 9).cast("int").alias("threshold"), (F.lit(2) + F.col("event_id") % 5).cast("int").alias("margin"))
    span = F.datediff("ts", F.lit("1970-01-01")) * 4 + F.floor(F.hour("ts") / 6)  # a user's events lie in many
    rows = as_of(frames.filter("event_type <> 'error'"), versions, ["session_id"], "ts", settings, "settings", span)
    threshold, margin = F.coalesce("settings.threshold", F.lit(APP.threshold)), F.coalesce("settings.margin", F.lit(APP.margin))
    d = matching.decide(rows.withColumns({"threshold": threshold, "least_margin": margin}), APP, F.col("threshold"), F.col("least_margin"))
    return d.select(
        "session_id", "frame_id", F.col("settings.version").alias("version"), "threshold", "least_margin", "best_distance", "margin", "required_margin",
        "within", "active", "ambiguous", "near_miss", "outcome",
    )


def q74(spark: SparkSession, sf_dir: str) -> DataFrame:
    return session.recognize(frames_of_events(spark, sf_dir), APP.with_(throttle=True))


def q75(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    frames = table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("session_id"), n.alias("frame_id"), (n * 7 % 5 < 3).alias("detected"), ((n * 31 % 100) / 100).alias("confidence"),
    )
    return tracking.hold_rectangles(frames, ["session_id"], ["frame_id"], F.col("frame_id") % 640)


def _tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as concerts: their nation is the band, some have no audio and some the same."""
    s = table(spark, sf_dir, "supplier").filter("s_suppkey <= 200")
    audio = F.when(F.col("s_suppkey") % 7 != 0, F.concat(F.lit("a"), (F.col("s_suppkey") % 60).cast("string")))
    return s.select(F.col("s_suppkey").cast("int").alias("id"), (F.col("s_nationkey") % 8).cast("string").alias("band"), audio.alias("audio"))


def q76(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    concert = F.when(F.col("event_type") != "error", 1 + F.floor(n / 2) * 13 % 9)
    events = table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("session_id"), n.alias("seq"), (n % 11 != 0).alias("is_active"), concert.alias("concert_id")
    )
    return playback.play(playback.with_songs(events, _tracks(spark, sf_dir)))


def q78(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the events that pass, observed while their users' sums are written."""
    e = table(spark, sf_dir, "events")
    load = Counters(
        {"attempts": F.lit(True), "failures": F.col("event_type") == "error", "purchases": F.col("event_type") == "purchase", "no_props": F.col("props").isNull()},
        {"props_length": F.length("props"), "event_ids": F.col("event_id")},
    )
    load.watch(e).groupBy("user_id").agg(F.count("*").alias("n")).write.format("noop").mode("overwrite").save()
    return load.row(spark)


QUERIES = {"q73_settings_as_of": q73, "q74_idle_throttle": q74, "q75_rectangle_hold": q75, "q76_autoplay_switch": q76, "q78_observed_counters": q78}
KEY = "(x.id * 7919 + ({turn}) * 104729) % 10007"
LIST = "list_transform(list_sort(list_transform(songs, lambda x: {'key': " + KEY + ", 'id': x.id, 'audio': x.audio})), lambda y: {'id': y.id, 'audio': y.audio})"
ORACLE_SQL = {
    "q78_observed_counters": """SELECT count(*) AS attempts, count(*) FILTER (event_type = 'error') AS failures, count(*) FILTER (event_type = 'purchase') AS purchases,
        count(*) FILTER (props IS NULL) AS no_props, coalesce(sum(length(props)), 0)::DOUBLE AS props_length, coalesce(sum(event_id), 0)::DOUBLE AS event_ids FROM events""",
    "q73_settings_as_of": """WITH v AS (
          SELECT user_id, ts, max(event_id) AS version FROM events WHERE event_type = 'error' GROUP BY ALL
        ), f AS (
          SELECT e.user_id::VARCHAR AS session_id, e.event_id AS frame_id, v.version, CASE WHEN v.version IS NULL THEN 18 ELSE 12 + v.version % 9 END::INT AS threshold,
            CASE WHEN v.version IS NULL THEN 5 ELSE 2 + v.version % 5 END::INT AS least_margin, CASE WHEN e.event_id % 11 <> 0 THEN 4 + e.event_id * 7 % 25 END::INT AS best_distance,
            CASE WHEN e.event_id % 11 <> 0 THEN e.event_id % 13 END::INT AS margin
          FROM (SELECT * FROM events WHERE event_type <> 'error') e ASOF LEFT JOIN v ON e.user_id = v.user_id AND e.ts >= v.ts
        ), g AS (SELECT *, least_margin + CASE WHEN best_distance >= threshold - 1 THEN 1 ELSE 0 END AS required_margin, coalesce(best_distance <= threshold, false) AS within FROM f
        ), h AS (SELECT *, within AND margin >= required_margin AND margin <> 0 AS active FROM g)
        SELECT *, within AND NOT active AS ambiguous, coalesce(best_distance > threshold AND best_distance <= threshold + 8, false) AS near_miss,
          CASE WHEN active THEN 'active' WHEN within THEN 'ambiguous' WHEN best_distance <= threshold + 2 THEN 'near_threshold' ELSE 'no_match' END AS outcome FROM h""",
    "q74_idle_throttle": f"WITH {sessions_sql(throttle=True)} SELECT * FROM decisions",
    "q75_rectangle_hold": """WITH RECURSIVE f AS (
          SELECT user_id::VARCHAR AS session_id, event_id AS frame_id, event_id * 7 % 5 < 3 AS detected, (event_id * 31 % 100) / 100 AS confidence, event_id % 640 AS rect,
            row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events
        ), s AS (
          SELECT session_id, 0::BIGINT AS k, NULL::BIGINT AS held, 0 AS used, NULL::BIGINT AS frame_id, NULL::BOOLEAN AS detected, NULL::DOUBLE AS confidence, NULL::BIGINT AS use, NULL::BIGINT AS own, 0 AS since FROM f WHERE k = 1
          UNION ALL
          SELECT f.session_id, f.k, CASE WHEN sure THEN rect WHEN f.detected OR s.used < 2 THEN s.held END, CASE WHEN sure THEN 0 WHEN s.held IS NULL THEN 0 WHEN s.used < 2 THEN s.used + 1 WHEN f.detected THEN s.used ELSE 0 END,
            f.frame_id, f.detected, f.confidence, CASE WHEN sure THEN rect WHEN s.used < 2 THEN s.held END, CASE WHEN f.detected THEN rect END,
            CASE WHEN sure THEN 0 ELSE s.used + 1 END
          FROM s JOIN (SELECT *, detected AND confidence >= 0.6 AS sure FROM f) f ON f.session_id = s.session_id AND f.k = s.k + 1
        ) SELECT session_id, frame_id, detected, confidence::DOUBLE AS confidence, use AS used, coalesce(own, use) AS shown, CASE WHEN use IS NOT NULL THEN since END::INT AS held_for FROM s WHERE k > 0""",
    "q76_autoplay_switch": f"""WITH RECURSIVE c AS (
          SELECT s_suppkey::INT AS id, (s_nationkey % 8)::VARCHAR AS band, CASE WHEN s_suppkey % 7 <> 0 THEN 'a' || (s_suppkey % 60) END AS audio FROM supplier WHERE s_suppkey <= 200
        ), b AS (SELECT band, list({{'id': id, 'audio': audio}} ORDER BY id) AS songs FROM c GROUP BY band
        ), e AS (
          SELECT user_id::VARCHAR AS session_id, event_id AS seq, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k, event_id % 11 <> 0 AS is_active, c.id, c.band, c.audio, b.songs
          FROM (SELECT *, CASE WHEN event_type <> 'error' THEN 1 + event_id // 2 * 13 % 9 END AS wanted FROM events) x LEFT JOIN c ON c.id = x.wanted LEFT JOIN b ON b.band = c.band
        ), s AS (
          SELECT session_id, 0::BIGINT AS k, NULL::BIGINT AS seq, NULL::VARCHAR AS action, NULL::INT AS previous, NULL::INT AS playing, NULL::VARCHAR AS sound, NULL::VARCHAR AS band,
            []::STRUCT(id INT, audio VARCHAR)[] AS songs, 0 AS place, 0 AS turns, 0 AS tries FROM e WHERE k = 1
          UNION ALL
          SELECT session_id, k, seq, CASE WHEN action <> 'move' THEN action WHEN moved IS NULL THEN 'kept' ELSE 'advanced' END,
            CASE WHEN action = 'cleared' THEN NULL WHEN action = 'inactive' THEN previous ELSE id END,
            CASE WHEN action = 'started' THEN id WHEN moved IS NOT NULL THEN cands[moved].id ELSE playing END, CASE WHEN action = 'started' THEN audio WHEN moved IS NOT NULL THEN cands[moved].audio ELSE sound END,
            CASE WHEN action = 'started' THEN new_band ELSE band END,
            CASE WHEN action = 'started' THEN list_concat([{{'id': id, 'audio': audio}}], list_filter({LIST.replace("{turn}", "turns + 1")}, lambda z: z.id <> id))
              WHEN steps > 0 AND (place + steps) // n > 0 THEN {LIST.replace("{turn}", "turns + (place + steps) // n")} ELSE held END,
            CASE WHEN action = 'started' THEN 0 WHEN steps > 0 THEN (place + steps) % n ELSE place END,
            CASE WHEN action = 'started' THEN turns + 1 WHEN steps > 0 THEN turns + (place + steps) // n ELSE turns END,
            CASE WHEN action <> 'move' THEN 0 WHEN n < 2 THEN 1 ELSE steps END
          FROM (
            SELECT *, CASE WHEN action = 'move' AND n > 1 THEN coalesce(moved, 4) ELSE 0 END AS steps FROM (
              SELECT *, CASE WHEN action = 'move' AND n > 1 THEN list_filter(range(1, 5), lambda t: cands[t].audio IS NOT NULL AND cands[t].id <> playing AND cands[t].audio <> sound)[1] END AS moved FROM (
                SELECT *, CASE WHEN action = 'move' AND n > 1 THEN list_transform(range(1, 5), lambda t: CASE WHEN place + t < n THEN held[(place + t + 1)::INT]
                  WHEN (place + t) // n = 1 THEN ({LIST.replace("{turn}", "turns + 1")})[((place + t) % n + 1)::INT] WHEN (place + t) // n = 2 THEN ({LIST.replace("{turn}", "turns + 2")})[((place + t) % n + 1)::INT]
                  ELSE ({LIST.replace("{turn}", "turns + 3")})[((place + t) % n + 1)::INT] END) END AS cands FROM (
                  SELECT s.previous, s.playing, s.sound, s.band, s.songs AS held, s.place, s.turns, len(s.songs) AS n, e.session_id, e.k, e.seq, e.id, e.audio, e.band AS new_band, e.songs,
                    CASE WHEN e.id IS NULL THEN 'cleared' WHEN NOT e.is_active THEN 'inactive' WHEN e.id = s.previous THEN 'same' WHEN e.audio IS NULL THEN 'silent' WHEN e.id = s.playing THEN 'already_playing'
                      WHEN e.band = s.band THEN 'move' ELSE 'started' END AS action
                  FROM s JOIN e ON e.session_id = s.session_id AND e.k = s.k + 1))))
        ) SELECT session_id, seq, action, playing, place::INT AS place, tries::INT AS tries FROM s WHERE k > 0""",
}
