"""Counts and statistics over decision rows, and the recommendations that follow from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashes import js_round
from ..presets import FAILURES_KEPT, NEAR_MISSES_KEPT

CATEGORIES = ("motion-blur", "glare", "poor-quality", "no-match", "collision", "unknown")
MARGIN_BINS = ("0-1", "2", "3-4", "5+", "unknown")
MILESTONES = ("recognitionEnabledAt", "artifactsReadyAt", "streamReadyAt", "workerReadyAt", "firstFrameAt", "firstMatchAt")
#: Durations between milestones: name, from, to.
DURATIONS = (
    ("enabledToArtifactsReady", "recognitionEnabledAt", "artifactsReadyAt"),
    ("enabledToStreamReady", "recognitionEnabledAt", "streamReadyAt"),
    ("enabledToWorkerReady", "recognitionEnabledAt", "workerReadyAt"),
    ("enabledToFirstFrame", "recognitionEnabledAt", "firstFrameAt"),
    ("enabledToFirstMatch", "recognitionEnabledAt", "firstMatchAt"),
    ("firstFrameToFirstMatch", "firstFrameAt", "firstMatchAt"),
)


def margin_bin(margin: Column) -> Column:
    return (
        F.when(margin.isNull(), "unknown").when(margin <= 1, "0-1").when(margin == 2, "2").when(margin <= 4, "3-4").otherwise("5+")
    )


def pair_key(best: Column, rival: Column) -> Column:
    """The two names in order, whichever was better."""
    other = F.coalesce(rival, F.lit("Unknown rival"))
    return F.concat_ws(" vs ", F.least(best, other), F.greatest(best, other))


def ordered_pair_key(best: Column, rival: Column) -> Column:
    """The two names as they were ranked."""
    return F.concat_ws(" vs ", best, F.coalesce(rival, F.lit("Unknown rival")))


def distance_histogram(frames: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """keys, distance (0 to 64), n, with a row for every distance; frames without a distance don't count."""
    keys = keys or []
    counts = frames.filter("best_distance is not null").groupBy(*keys, F.least("best_distance", F.lit(64)).alias("distance"))
    counts = counts.agg(F.count("*").alias("n"))
    bins = frames.select(*keys).distinct() if keys else frames.sparkSession.range(1).select()
    bins = bins.select(*keys, F.explode(F.sequence(F.lit(0), F.lit(64))).alias("distance"))
    return bins.join(counts, [*keys, "distance"], "left").select(*keys, "distance", F.coalesce("n", F.lit(0)).alias("n"))


def histogram_array(histogram: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The 65 counts as one array for each key."""
    rows = F.array_sort(F.collect_list(F.struct("distance", "n")))
    return histogram.groupBy(*(keys or [])).agg(F.transform(rows, lambda r: r["n"]).alias("distance_histogram"))


def histogram_peak(histogram: Column) -> Column:
    """The first distance with the largest count; null where all are 0."""
    top = F.array_max(histogram)
    return F.when(top > 0, (F.array_position(histogram, top) - 1).cast("int"))


def session_counters(decisions: DataFrame, key: str = "session_id") -> DataFrame:
    """One row of counters per session from decision rows with event, category, best_distance, quality values and passed."""
    count = lambda event: F.count_if(F.col("event") == event)
    passed = F.col("passed") & F.col("best_distance").isNotNull()
    when = lambda event, col: F.coalesce(F.sum(F.when(F.col("event") == event, F.col(col))), F.lit(0.0))
    return decisions.groupBy(key).agg(
        F.count_if(F.col("event") != "dropped").alias("total_frames"),
        count("blur_rejected").alias("blur_rejections"),
        count("glare_rejected").alias("glare_rejections"),
        count("lighting_rejected").alias("lighting_rejections"),
        F.count_if(F.col("quality_checked") & F.col("passed")).alias("quality_frames"),
        F.count_if(F.col("quality_bypassed")).alias("quality_bypass_frames"),
        F.count_if(F.col("event").isin("confirmed", "confirmed_instant")).alias("successful_recognitions"),
        count("confirmed_instant").alias("instant_confirmations"),
        F.count_if(F.col("failed_attempt")).alias("failed_attempts"),
        *(F.count_if(F.col("category") == c).alias("failures_" + c.replace("-", "_")) for c in CATEGORIES),
        when("blur_rejected", "sharpness").alias("blur_sum"),
        when("glare_rejected", "glare_percent").alias("glare_sum"),
        when("lighting_rejected", "brightness").alias("brightness_sum"),
        F.min(F.when(passed, F.col("best_distance"))).alias("distance_min"),
        F.max(F.when(passed, F.col("best_distance"))).alias("distance_max"),
        F.coalesce(F.sum(F.when(passed, F.col("best_distance"))), F.lit(0)).alias("distance_sum"),
        F.count_if(passed).alias("distance_count"),
    )


def collision_stats(decisions: DataFrame) -> DataFrame:
    """margin_bin, n over ambiguous rows, with a row for every bin."""
    spark = decisions.sparkSession
    counts = decisions.filter("ambiguous").groupBy(margin_bin(F.col("margin")).alias("margin_bin")).agg(F.count("*").alias("n"))
    bins = spark.createDataFrame([(b,) for b in MARGIN_BINS], "margin_bin string")
    return bins.join(counts, "margin_bin", "left").select("margin_bin", F.coalesce("n", F.lit(0)).alias("n"))


def top_pairs(decisions: DataFrame, best: str, rival: str, k: int = 10) -> DataFrame:
    """The k pairs that are confused most often."""
    pairs = decisions.filter("ambiguous").groupBy(pair_key(F.col(best), F.col(rival)).alias("pair")).agg(F.count("*").alias("n"))
    return pairs.orderBy(F.desc("n"), "pair").limit(k)


def last_rows(rows: DataFrame, key: str, order: list[Column], keep: int) -> DataFrame:
    """The last rows of each key, the window of a ring buffer."""
    return rows.withColumn("from_end", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col("from_end") <= keep)


def last_failures(decisions: DataFrame) -> DataFrame:
    return last_rows(decisions.filter("category is not null"), "session_id", [F.desc("frame_id")], FAILURES_KEPT)


def last_near_misses(decisions: DataFrame) -> DataFrame:
    return last_rows(decisions.filter("near_miss"), "session_id", [F.desc("frame_id")], NEAR_MISSES_KEPT)


def accuracy_summary(audit: DataFrame) -> DataFrame:
    """Counts, accuracy in percent and timings over rows of outcome, ambiguous, near_threshold and ms."""
    correct, attempts = F.count_if(F.col("outcome") == "correct"), F.count("*")
    return audit.agg(
        attempts.alias("attempts"), correct.alias("correct"),
        F.count_if(F.col("outcome") == "wrong").alias("wrong"),
        F.count_if(F.col("outcome") == "no-match").alias("no_match"),
        F.count_if("ambiguous").alias("ambiguous"), F.count_if("near_threshold").alias("near_threshold"),
        F.when(attempts == 0, 0.0).otherwise(correct / attempts * 100).alias("accuracy_percent"),
        F.avg("ms").alias("ms_avg"), F.min("ms").alias("ms_min"), F.max("ms").alias("ms_max"),
    )


def first_milestones(events: DataFrame, key: str, kind: str, at: str, kinds: list[str]) -> DataFrame:
    """The first time of each kind of event, as one column a kind."""
    return events.groupBy(key).agg(*(F.min(F.when(F.col(kind) == k, F.col(at))).alias(k) for k in kinds))


def duration_ms(start: Column, end: Column) -> Column:
    """Milliseconds between two times, 0 at least; null where either is missing."""
    ms = F.unix_millis(end.cast("timestamp")) - F.unix_millis(start.cast("timestamp"))
    return F.when(start.isNotNull() & end.isNotNull(), F.greatest(F.lit(0), ms))


def startup_durations(milestones: DataFrame) -> DataFrame:
    return milestones.select("*", *(duration_ms(F.col(a), F.col(b)).alias(n) for n, a, b in DURATIONS))


def dominant_cause(blur: Column, glare: Column, lighting: Column) -> Column:
    """The largest of three counts; on ties blur goes before glare and glare before lighting."""
    return F.when((blur >= glare) & (blur >= lighting), "blur").when(glare >= lighting, "glare").otherwise("lighting")


def _percent(x: Column) -> Column:
    return F.concat(F.format_string("%.1f", js_round(x * 1000) / 10), F.lit("%"))


def recommendations(
    telemetry: DataFrame, threshold: int = 18, margin: int = 5, sharpness: float = 85.0, glare_percent: float = 20.0,
    key: str = "session_id",
) -> DataFrame:
    """Ordered advice per session: key, rule (its place), priority, issue, parameter_change.

    telemetry has total_frames, the rejections, quality_frames,
    successful_recognitions, failures_no_match, failures_collision, blur_sum,
    glare_sum, near_miss_avg, ambiguous_low, ambiguous_high, ambiguous_unknown,
    ambiguous_count, top_pair and histogram_peak.
    """
    c, total = F.col, F.col("total_frames")
    rate = {k: c(v) / total for k, v in (
        ("blur", "blur_rejections"), ("glare", "glare_rejections"), ("none", "failures_no_match"),
        ("collision", "failures_collision"), ("quality", "quality_frames"),
    )}
    level = lambda x, high: F.when(x > high, "high").otherwise("medium")
    whole = lambda x: x.cast("int").cast("string")
    advice = lambda on, rule, priority, issue, change: F.when(
        on, F.struct(F.lit(rule).alias("rule"), priority.alias("priority"), issue.alias("issue"), change.alias("parameter_change"))
    )
    # Conditions first: the later rules depend on whether earlier ones spoke.
    on_blur, on_glare = rate["blur"] > 0.2, rate["glare"] > 0.15
    on_none, on_collision = rate["none"] > 0.15, rate["collision"] > 0.1
    peak = c("histogram_peak")
    on_border = peak.between(16, 18) & ~on_none
    on_strong = (peak <= 8) & (c("successful_recognitions") == 0) & (c("quality_frames") > 5)
    said = F.coalesce(on_blur | on_glare | on_none | on_collision | F.coalesce(on_border, F.lit(False)) | F.coalesce(on_strong, F.lit(False)), F.lit(False))
    blur_avg = c("blur_sum") / F.nullif(c("blur_rejections"), F.lit(0))
    glare_avg = c("glare_sum") / F.nullif(c("glare_rejections"), F.lit(0))
    new_sharp = F.coalesce(js_round(blur_avg * 0.85), js_round(F.lit(sharpness * 0.8)))
    factor = F.when(glare_avg >= glare_percent + 8, 1.15).otherwise(1.3)
    new_glare = F.least(F.coalesce(F.greatest(F.lit(glare_percent + 4), js_round(glare_avg * factor)), F.lit(glare_percent + 10)), F.lit(60.0))
    new_limit = F.coalesce(js_round(c("near_miss_avg") * 1.1), F.lit(threshold + 3))
    low, high = c("ambiguous_low"), c("ambiguous_high")
    raise_margin = (c("ambiguous_count") > 0) & F.when(low + high + c("ambiguous_unknown") > 0, low > high).otherwise(True)
    border_limit = F.greatest(F.lit(threshold - 2), peak - 2)
    cause = dominant_cause(c("blur_rejections"), c("glare_rejections"), c("lighting_rejections"))
    rules = [
        advice(on_blur, 1, level(rate["blur"], 0.4), F.concat(F.lit("blur rejections: "), _percent(rate["blur"])),
               F.concat(F.lit("sharpnessThreshold: "), whole(new_sharp))),
        advice(on_glare, 2, level(rate["glare"], 0.3), F.concat(F.lit("glare rejections: "), _percent(rate["glare"])),
               F.concat(F.lit("glarePercentageThreshold: "), whole(new_glare))),
        advice(on_none, 3, level(rate["none"], 0.25), F.concat(F.lit("frames without a match: "), _percent(rate["none"])),
               F.concat(F.lit("similarityThreshold: "), whole(new_limit))),
        advice(on_collision, 4, level(rate["collision"], 0.2),
               F.concat(F.lit("collisions: "), _percent(rate["collision"]), F.coalesce(F.concat(F.lit(", most often "), c("top_pair")), F.lit(""))),
               F.when(raise_margin, F.lit(f"matchMarginThreshold: {margin + 1}")).otherwise("refreshHashes: true")),
        advice(on_border, 5, F.lit("medium"), F.concat(F.lit("distances peak near the threshold, at "), whole(peak)),
               F.concat(F.lit("similarityThreshold: "), whole(border_limit))),
        advice(on_strong, 6, F.lit("high"), F.concat(F.lit("close matches are never confirmed; distances peak at "), whole(peak)),
               F.lit(f"matchMarginThreshold: {max(margin - 1, 1)}")),
        advice((rate["quality"] < 0.3) & ~said, 7, F.lit("high"),
               F.concat(F.lit("few frames pass the quality checks: "), _percent(rate["quality"]), F.lit("; mostly "), cause),
               F.concat(F.lit("Check "), cause, F.lit(" threshold settings"))),
    ]
    found = telemetry.filter(total > 0).select(key, F.explode(F.array_compact(F.array(*rules))).alias("r"))
    return found.select(key, "r.rule", "r.priority", "r.issue", "r.parameter_change")


def first_recommendation(advice: DataFrame, key: str = "session_id") -> DataFrame:
    """The most urgent of each session's, the earlier rule first."""
    urgency = F.when(F.col("priority") == "high", 0).when(F.col("priority") == "medium", 1).otherwise(2)
    best = F.min_by(F.struct("rule", "priority", "issue", "parameter_change"), F.struct(urgency, "rule"))
    return advice.groupBy(key).agg(best.alias("r")).select(key, "r.*")
