"""Queries of sessions of frames and of pixels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import images, rectangles
from ..operators import telemetry
from ..presets import APP
from ..streaming import session
from .tables import table


def frames_of_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A session per user, a frame per event; distances and quality come from the event's number and value."""
    e, n = table(spark, sf_dir, "events"), F.col("event_id")
    return e.select(
        F.col("user_id").cast("string").alias("session_id"), n.alias("frame_id"), F.pmod(F.floor(n / 3), F.lit(5)).cast("int").alias("best_id"),
        F.when(n % 11 != 0, 4 + F.pmod(n * 7, F.lit(25))).cast("int").alias("best_distance"), F.lit(99).alias("second_id"),
        F.when(n % 11 != 0, 4 + F.pmod(n * 7, F.lit(25)) + F.pmod(n, F.lit(13))).cast("int").alias("second_distance"),
        F.pmod(n * 37, F.lit(220)).cast("double").alias("sharpness"), F.pmod(n * 13, F.lit(45)).cast("double").alias("glare_percent"),
        F.pmod(n * 17, F.lit(256)).cast("double").alias("brightness"), F.lit(None).cast("double").alias("pre_hash_sharpness"),
    )


def q31(spark: SparkSession, sf_dir: str) -> DataFrame:
    return session.recognize(frames_of_events(spark, sf_dir), APP)


def q31b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry.session_counters(q31(spark, sf_dir))


def _images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """8 by 8 images whose pixels are the vectors' components."""
    byte = lambda x: F.substring(F.hex(F.greatest(F.lit(0), F.least(F.lit(255), F.floor(x * 400 + 128))).cast("int")), -2, 2)
    rgba = F.transform("embedding", lambda x: F.concat(*[F.lpad(byte(x), 2, "0")] * 3, F.lit("FF")))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.lit(8).alias("h"), F.lit(8).alias("w"), F.unhex(F.array_join(rgba, "")).alias("data"))


def q32(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = (F.col("h"), F.col("w"), F.col("data"))
    return _images(spark, sf_dir).select("vec_id", images.phash_column(*d).alias("phash"), images.dhash_column(*d).alias("dhash"), F.sha2("data", 256).alias("sha256"))


def q33(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = images.quality_column(F.col("h"), F.col("w"), F.col("data"))
    rows = _images(spark, sf_dir).select("vec_id", q.alias("q")).select("vec_id", "q.*")
    return rows.withColumns({c: F.round(c, 6) for c in ("sharpness", "glare_percent", "brightness")})


def q33b(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = rectangles.detect_column(F.col("h"), F.col("w"), F.col("data"))
    return _images(spark, sf_dir).select("vec_id", r.alias("r")).select("vec_id", "r.detected", "r.confidence")


QUERIES = {
    "q31_session_confirm": q31, "q31b_session_counters": q31b, "q32_phash_pixels": q32, "q33_quality_metrics": q33, "q33b_rectangles": q33b,
}
PIXELS = "list_transform(embedding, lambda x: greatest(0, least(255, floor(x::DOUBLE * 400 + 128))))"
GRAY = f"list_transform({PIXELS}, lambda v: floor(0.299::DOUBLE * v + 0.587::DOUBLE * v + 0.114::DOUBLE * v))"
# The state machine as a recursion over the frames of all sessions at once: what frame k of a session meets is the row of its frame k - 1.
SESSIONS = """RECURSIVE f AS (
  SELECT user_id::VARCHAR AS session_id, event_id AS frame_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k, (event_id // 3 % 5)::INT AS best,
    CASE WHEN event_id % 11 <> 0 THEN 4 + event_id * 7 % 25 END::INT AS d, CASE WHEN event_id % 11 <> 0 THEN event_id % 13 END::INT AS margin,
    (event_id * 37 % 220)::DOUBLE AS sharp, (event_id * 13 % 45)::DOUBLE AS glare, (event_id * 17 % 256)::DOUBLE AS light FROM events
), g AS (
  SELECT *, coalesce(d <= 18, false) AS within, coalesce(d <= 18 AND margin >= 5 + CASE WHEN d >= 17 THEN 1 ELSE 0 END AND margin <> 0, false) AS active FROM f
), frames AS (SELECT *, d IS NULL OR NOT active OR d > 12 AS checked FROM g
), s AS (
  SELECT session_id, 0::BIGINT AS k, NULL::BIGINT AS frame_id, NULL::VARCHAR AS event, NULL::INT AS recognized, NULL::INT AS candidate, 0 AS run, NULL::DOUBLE AS amb, NULL::DOUBLE AS amb_glare,
    0 AS blur_run, NULL::INT AS last_d, false AS lost FROM frames WHERE k = 1
  UNION ALL
  SELECT session_id, k, frame_id, event,
    CASE WHEN event IN ('confirmed', 'confirmed_instant') THEN best ELSE recognized END,
    CASE WHEN event = 'candidate' THEN best WHEN event IN ('improving', 'blur_ignored', 'skipped') OR event = 'blur_rejected' AND blurs < 3 THEN candidate END,
    CASE WHEN event = 'candidate' THEN runs WHEN event IN ('improving', 'blur_ignored', 'skipped') OR event = 'blur_rejected' AND blurs < 3 THEN run ELSE 0 END,
    amb, amb_glare, CASE WHEN event IN ('blur_ignored', 'blur_rejected') THEN blurs WHEN event = 'skipped' THEN blurs - 1 ELSE 0 END,
    CASE WHEN event = 'skipped' THEN last_d WHEN NOT checked THEN NULL WHEN event IN ('glare_rejected', 'lighting_rejected') THEN last_d ELSE d END, event = 'no_match' AND candidate IS NOT NULL
  FROM (
    SELECT *, CASE WHEN {skip} THEN 'skipped'
      WHEN checked AND sharp < 85 THEN CASE WHEN last_d - d >= 4 THEN 'improving' WHEN blurs < 2 THEN 'blur_ignored' ELSE 'blur_rejected' END
      WHEN checked AND glare > most THEN 'glare_rejected' WHEN checked AND NOT light BETWEEN low AND high THEN 'lighting_rejected'
      WHEN active THEN CASE WHEN best = recognized THEN 'already_recognized' WHEN d <= 10 THEN 'confirmed_instant' WHEN runs >= 2 THEN 'confirmed' ELSE 'candidate' END
      ELSE 'no_match' END AS event
    FROM (
      SELECT *, least(greatest(50 + (amb - 135) * 0.35::DOUBLE, 20), 80) AS low, least(greatest(220 + (amb - 135) * 0.35::DOUBLE, 190), 245) AS high,
        least(greatest(20 + (greatest(0, (160 - amb) / 8) + amb_glare * 0.2::DOUBLE), 20), 40) AS most
      FROM (
        SELECT n.*, s.recognized, s.candidate, s.run, s.last_d, s.blur_run + 1 AS blurs, CASE WHEN n.best = s.candidate THEN s.run + 1 ELSE 1 END AS runs,
          CASE WHEN NOT n.checked OR {skip_n} THEN s.amb WHEN s.amb IS NULL THEN n.light ELSE s.amb * 0.85::DOUBLE + n.light * 0.15::DOUBLE END AS amb,
          CASE WHEN NOT n.checked OR {skip_n} THEN s.amb_glare WHEN s.amb_glare IS NULL THEN n.glare ELSE s.amb_glare * 0.85::DOUBLE + n.glare * 0.15::DOUBLE END AS amb_glare
        FROM s JOIN frames n ON n.session_id = s.session_id AND n.k = s.k + 1)))
), decisions AS (
  SELECT f.session_id, f.frame_id, event, CASE WHEN event = 'blur_rejected' THEN 'motion-blur' WHEN event = 'glare_rejected' THEN 'glare' WHEN event = 'lighting_rejected' THEN 'poor-quality'
      WHEN event = 'no_match' THEN CASE WHEN within OR d <= 20 THEN 'collision' ELSE 'no-match' END END AS category,
    CASE WHEN seen THEN best END AS best_id, CASE WHEN seen THEN d END AS best_distance, CASE WHEN seen THEN margin END AS margin, seen AND within AND NOT active AS ambiguous,
    event IN ('already_recognized', 'confirmed', 'confirmed_instant', 'candidate', 'no_match') AS passed, coalesce(passed AND d > 18 AND d <= 26, false) AS near_miss,
    seen AND checked AS quality_checked, seen AND NOT checked AS quality_bypassed, lost AS failed_attempt, recognized,
    CASE WHEN seen AND checked THEN sharp END AS sharpness, CASE WHEN seen AND checked THEN glare END AS glare_percent, CASE WHEN seen AND checked THEN light END AS brightness,
    amb AS ambient_brightness, amb_glare AS ambient_glare
  FROM (SELECT *, event <> 'skipped' AS seen FROM s) s JOIN frames f ON f.session_id = s.session_id AND f.k = s.k
)"""


def sessions_sql(throttle: bool = False) -> str:
    """The recursion; under a throttle odd frames are skipped while there is no candidate. No frame comes late here, so a frame's number counts those presented."""
    skip = "candidate IS NULL AND k % 2 = 1" if throttle else "false"
    return SESSIONS.replace("{skip}", skip).replace("{skip_n}", skip.replace("candidate", "s.candidate").replace("k %", "n.k %"))


COUNTERS = {
    "blur_rejections": "event = 'blur_rejected'", "glare_rejections": "event = 'glare_rejected'", "lighting_rejections": "event = 'lighting_rejected'",
    "quality_frames": "quality_checked AND passed", "quality_bypass_frames": "quality_bypassed", "successful_recognitions": "event IN ('confirmed', 'confirmed_instant')",
    "instant_confirmations": "event = 'confirmed_instant'", "failed_attempts": "failed_attempt", "distance_count": "passed AND best_distance IS NOT NULL",
} | {"failures_" + c.replace("-", "_"): f"category = '{c}'" for c in telemetry.CATEGORIES}
SUMS = {"blur_sum": ("sharpness", "blur_rejected"), "glare_sum": ("glare_percent", "glare_rejected"), "brightness_sum": ("brightness", "lighting_rejected")}
ORACLE_SQL = {
    "q31_session_confirm": f"WITH {sessions_sql()} SELECT * FROM decisions",
    "q31b_session_counters": f"WITH {sessions_sql()} SELECT session_id, count(*) AS total_frames, " + ", ".join(f"count(*) FILTER ({c}) AS {n}" for n, c in COUNTERS.items()) + ", "
        + ", ".join(f"coalesce(sum({c}) FILTER (event = '{e}'), 0)::DOUBLE AS {n}" for n, (c, e) in SUMS.items())
        + ", min(best_distance) FILTER (passed) AS distance_min, max(best_distance) FILTER (passed) AS distance_max, coalesce(sum(best_distance) FILTER (passed), 0)::BIGINT AS distance_sum FROM decisions GROUP BY 1",
    "q33_quality_metrics": f"""WITH g AS (SELECT vec_id, {GRAY} AS g FROM embeddings),
        m AS (SELECT vec_id, list_aggregate(list_transform(list_filter(range(1, 65), lambda i: (i - 1) // 8 BETWEEN 1 AND 6 AND (i - 1) % 8 BETWEEN 1 AND 6), lambda i: g[i - 8] + g[i + 8] + g[i - 1] + g[i + 1] - 4 * g[i]), 'var_pop') AS s,
          len(list_filter(g, lambda v: v > 250)) / 64 * 100 AS p, list_aggregate(g, 'sum') / 64 AS b FROM g)
        SELECT vec_id, round(s, 6) AS sharpness, s >= 100 AS is_sharp, round(p, 6) AS glare_percent, p > 20 AS has_glare, round(b, 6) AS brightness, b < 50 OR b > 220 AS poor_light,
          CASE WHEN b < 50 THEN 'underexposed' WHEN b > 220 THEN 'overexposed' ELSE 'ok' END AS light FROM m""",
}
