"""Queries on fingerprints of the embeddings table; every vector is a frame and, for the others, an index entry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import hashes as H
from ..operators import matching, telemetry
from ..presets import APP, AUDIT, HOOK
from .tables import table


def _index(spark: SparkSession, sf_dir: str) -> DataFrame:
    hi, lo = H.quantised(F.col("embedding"))
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("ord"), F.col("label").alias("group_id"), hi.alias("hi"), lo.alias("lo")
    )


def best_second(spark: SparkSession, sf_dir: str, need: str = "second_id") -> DataFrame:
    index = _index(spark, sf_dir)
    return matching.best_two(index.withColumnRenamed("ord", "frame_id"), index, not_own=True, need=need)


def decisions(spark: SparkSession, sf_dir: str, preset=APP, need: str = "second_id") -> DataFrame:
    return matching.decide(best_second(spark, sf_dir, need), preset)


def q01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_second(spark, sf_dir)


def q02(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = decisions(spark, sf_dir)
    return d.select(
        "frame_id", "best_id", "best_distance", "second_distance", "margin", "required_margin", "within", "active",
        "ambiguous", "run_quality", "near_miss", "outcome", matching.failure_category(F.col("outcome")).alias("category"),
        matching.adaptive_delay(F.col("best_distance"), APP.delay_ms).alias("delay_ms"),
    )


def q03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry.distance_histogram(best_second(spark, sf_dir, "best_distance"))


def q04(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = lambda c: F.concat(F.lit("label "), F.col(c).cast("string"))
    d = decisions(spark, sf_dir).select("*", name("best_id").alias("best_name"), name("second_id").alias("second_name"))
    return telemetry.top_pairs(d, "best_name", "second_name", 10)


def q04b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry.collision_stats(decisions(spark, sf_dir))


def q05(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("frame_id"), F.col("label").alias("expected"))
    d = matching.decide(best_second(spark, sf_dir), AUDIT).join(labels, "frame_id")
    audit = d.select(
        matching.match_outcome(F.col("expected"), F.col("best_id"), F.col("active")).alias("outcome"), "ambiguous",
        (F.col("outcome") == "near_threshold").alias("near_threshold"), F.col("best_distance").cast("double").alias("ms"),
    )
    return telemetry.accuracy_summary(audit)


def q06(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = _index(spark, sf_dir).select("ord", H.halves_to_hex(F.col("hi"), F.col("lo")).alias("hash"))
    frames, entries = matching.bucketed(index.withColumnRenamed("ord", "frame_id"), index, 1)
    sizes = entries.groupBy("bucket").agg(F.count("*").alias("n"))
    return matching.candidate_stats(frames.join(sizes, "bucket", "left").select("frame_id", F.coalesce("n", F.lit(0)).alias("n")))


def q77(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches within the strictest threshold, and rivals as near, by bands instead of all comparisons."""
    index = _index(spark, sf_dir)
    return matching.best_within(index.withColumnRenamed("ord", "frame_id"), index, HOOK.threshold, not_own=True)


def q26(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _index(spark, sf_dir).select("group_id", "ord", H.halves_to_hex(F.col("hi"), F.col("lo")).alias("hash"))
    ordered = F.array_sort(F.collect_list(F.struct("ord", "hash")))
    lists = rows.groupBy("group_id").agg(F.transform(ordered, lambda r: r["hash"]).alias("hashes"))
    # pairs of 63 informative bits in near-duplicate distance are rare here, so the bound is wide
    kept = H.prune_near(F.col("hashes"), 16)
    return lists.select(
        "group_id", F.size("hashes").alias("n"), kept.alias("kept"),
        F.size(H.append_novel(F.slice("hashes", 1, 3), F.col("hashes"), 12)).alias("appended"),
    )


def q34(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scalar functions of fingerprints, from md5 sums of the documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("m"))
    a, b = F.substring("m", 1, 16), F.substring("m", 17, 16)
    d = H.hamming(a, b)
    (hi_a, lo_a), (hi_b, lo_b) = H.halves(a), H.halves(b)
    return docs.select(
        "doc_id", d.alias("distance"), H.hamming_halves(hi_a, lo_a, hi_b, lo_b).alias("by_halves"),
        H.similarity(d).alias("similarity"), H.similarity_percent(d).alias("similarity_percent"),
        H.hex_to_binary(a).alias("bits"), H.binary_to_hex(H.hex_to_binary(b)).alias("hex_again"),
        H.hamming_or_infinite(F.col("m"), b).alias("unequal"),
    )


def q35(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per label: counters of decisions, the array of distances and its peak."""
    d = decisions(spark, sf_dir).withColumn("group_id", F.coalesce("best_id", F.lit(-1)))
    arrays = telemetry.histogram_array(telemetry.distance_histogram(d, ["group_id"]), ["group_id"])
    counts = d.groupBy("group_id").agg(
        F.count("*").alias("frames"), F.count_if("active").alias("active"), F.count_if("near_miss").alias("near_misses"),
        F.min("best_distance").alias("least"), F.max("best_distance").alias("most"), F.sum("best_distance").alias("total"),
    )
    return counts.join(arrays, "group_id").select(
        "*", telemetry.histogram_peak(F.col("distance_histogram")).alias("peak")
    )


def q29(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recommendations per label as session; every third frame by id stands for blur, every fifth for glare."""
    d = decisions(spark, sf_dir).withColumn("session_id", F.coalesce("best_id", F.lit(-1)))
    blur, glare = F.col("frame_id") % 3 == 0, (F.col("frame_id") % 3 != 0) & (F.col("frame_id") % 5 == 0)
    rejected, distance = blur | glare, F.col("best_distance").cast("double")
    bin_ = telemetry.margin_bin(F.col("margin"))
    amb = F.col("ambiguous") & ~rejected
    rows = d.groupBy("session_id").agg(
        F.count("*").alias("total_frames"), F.count_if(blur).alias("blur_rejections"), F.count_if(glare).alias("glare_rejections"),
        F.lit(0).cast("bigint").alias("lighting_rejections"), F.count_if(~rejected).alias("quality_frames"),
        F.count_if(F.col("active") & ~rejected).alias("successful_recognitions"),
        F.count_if((F.col("outcome") == "no_match") & ~rejected).alias("failures_no_match"),
        F.count_if(F.col("outcome").isin("ambiguous", "near_threshold") & ~rejected).alias("failures_collision"),
        F.sum(F.when(blur, distance)).alias("blur_sum"), F.sum(F.when(glare, distance)).alias("glare_sum"),
        F.avg(F.when(F.col("near_miss") & ~rejected, distance)).alias("near_miss_avg"),
        F.count_if(amb).alias("ambiguous_count"), F.count_if(amb & bin_.isin("0-1", "2")).alias("ambiguous_low"),
        F.count_if(amb & bin_.isin("3-4", "5+")).alias("ambiguous_high"),
        F.count_if(amb & (bin_ == "unknown")).alias("ambiguous_unknown"),
    )
    pairs = d.filter(amb).groupBy("session_id", telemetry.pair_key(F.col("best_id").cast("string"), F.col("second_id").cast("string")).alias("pair"))
    first = Window.partitionBy("session_id").orderBy(F.desc("n"), "pair")
    top = pairs.agg(F.count("*").alias("n")).withColumn("k", F.row_number().over(first)).filter("k = 1")
    arrays = telemetry.histogram_array(telemetry.distance_histogram(d, ["session_id"]), ["session_id"])
    peaks = arrays.select("session_id", telemetry.histogram_peak(F.col("distance_histogram")).alias("histogram_peak"))
    rows = rows.join(top.select("session_id", F.col("pair").alias("top_pair")), "session_id", "left").join(peaks, "session_id", "left")
    return telemetry.recommendations(rows)


FINGERPRINTS = """
fp AS (
  SELECT vec_id, label, list_slice(embedding, 1, 63) AS c, list_sort(list_slice(embedding, 1, 63))[32] AS med FROM embeddings
), bits AS (
  SELECT vec_id, label, list_transform(c, lambda x: CASE WHEN x > med THEN 1::BIGINT ELSE 0::BIGINT END) AS b FROM fp
), idx AS (
  SELECT vec_id AS ord, label AS group_id,
    list_reduce(list_slice(b, 1, 32), lambda s, x: s * 2 + x) AS hi, 2 * list_reduce(list_slice(b, 33, 63), lambda s, x: s * 2 + x) AS lo
  FROM bits
)"""
BEST_TWO = FINGERPRINTS + """, near AS (
  SELECT f.ord AS frame_id, i.group_id, min((bit_count(xor(f.hi, i.hi)) + bit_count(xor(f.lo, i.lo)))::BIGINT * 1000000000 + i.ord) AS m
  FROM idx f JOIN idx i ON f.ord <> i.ord GROUP BY ALL
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY m) AS k FROM near
), best AS (
  SELECT x.ord AS frame_id, a.group_id AS best_id, a.m % 1000000000 AS best_ord, (a.m // 1000000000)::INT AS best_distance,
    s.group_id AS second_id, (s.m // 1000000000)::INT AS second_distance
  FROM idx x LEFT JOIN ranked a ON a.frame_id = x.ord AND a.k = 1 LEFT JOIN ranked s ON s.frame_id = x.ord AND s.k = 2
)"""


def _decided(threshold: int, margin: int, boost: bool) -> str:
    more = f"CASE WHEN best_distance >= {threshold - 1} THEN 1 ELSE 0 END" if boost else "0"
    return BEST_TWO + f""", dec0 AS (
  SELECT *, second_distance - best_distance AS margin, {margin} + {more} AS required_margin,
    coalesce(best_distance <= {threshold}, false) AS within FROM best
), dec1 AS (
  SELECT *, within AND (margin IS NULL OR margin >= required_margin) AND NOT coalesce(margin = 0, false) AS active FROM dec0
), dec AS (
  SELECT *, within AND NOT active AS ambiguous, best_distance IS NULL OR NOT active OR best_distance > 12 AS run_quality,
    coalesce(best_distance > {threshold} AND best_distance <= {threshold + 8}, false) AS near_miss,
    CASE WHEN active THEN 'active' WHEN within THEN 'ambiguous' WHEN best_distance <= {threshold + 2} THEN 'near_threshold' ELSE 'no_match' END AS outcome
  FROM dec1
)"""


DECIDED = _decided(18, 5, True)
MARGIN_BIN = "CASE WHEN margin IS NULL THEN 'unknown' WHEN margin <= 1 THEN '0-1' WHEN margin = 2 THEN '2' WHEN margin <= 4 THEN '3-4' ELSE '5+' END"
HEX = "lower(printf('%08x', hi)) || lower(printf('%08x', lo))"
XHEX = "(bit_count(xor(('0x' || a[1:8])::BIGINT, ('0x' || b[1:8])::BIGINT)) + bit_count(xor(('0x' || a[9:16])::BIGINT, ('0x' || b[9:16])::BIGINT)))::INT"
PRUNE = """list_reduce({list}, lambda kept, x: CASE WHEN len(list_filter(kept, lambda y:
    bit_count(xor(('0x' || x[1:8])::BIGINT, ('0x' || y[1:8])::BIGINT)) + bit_count(xor(('0x' || x[9:16])::BIGINT, ('0x' || y[9:16])::BIGINT)) <= {most})) > 0
    THEN kept ELSE list_append(kept, x) END, {start})"""

QUERIES = {
    "q01_hamming_best_second": q01, "q02_match_decisions": q02, "q03_distance_histogram_65": q03,
    "q04_collision_pairs_topk": q04, "q04b_collision_margins": q04b, "q05_accuracy_audit": q05, "q06_candidate_stats": q06,
    "q26_neardup_greedy": q26, "q29_recommendations": q29, "q34_hash_functions": q34, "q35_label_telemetry": q35, "q77_matches_within": q77,
}
ORACLE_SQL = {
    "q01_hamming_best_second": f"WITH {BEST_TWO} SELECT * FROM best",
    "q77_matches_within": f"""WITH {BEST_TWO} SELECT frame_id, CASE WHEN best_distance <= 14 THEN best_id END AS best_id, CASE WHEN best_distance <= 14 THEN best_ord END AS best_ord,
        CASE WHEN best_distance <= 14 THEN best_distance END AS best_distance, CASE WHEN second_distance <= 14 THEN second_id END AS second_id,
        CASE WHEN second_distance <= 14 THEN second_distance END AS second_distance FROM best""",
    "q02_match_decisions": f"""WITH {DECIDED} SELECT frame_id, best_id, best_distance, second_distance, margin, required_margin, within,
        active, ambiguous, run_quality, near_miss, outcome,
        CASE WHEN outcome IN ('ambiguous', 'near_threshold') THEN 'collision' WHEN outcome = 'no_match' THEN 'no-match' END AS category,
        CASE WHEN best_distance <= 13 THEN 90 WHEN best_distance <= 16 THEN 180 ELSE 234 END AS delay_ms FROM dec""",
    "q03_distance_histogram_65": f"""WITH {BEST_TWO} SELECT d::INT AS distance, count(best_distance) AS n
        FROM range(65) r(d) LEFT JOIN best ON least(best_distance, 64) = d GROUP BY d""",
    "q04_collision_pairs_topk": f"""WITH {DECIDED}, names AS (SELECT 'label ' || best_id AS a, coalesce('label ' || second_id, 'Unknown rival') AS b FROM dec WHERE ambiguous)
        SELECT least(a, b) || ' vs ' || greatest(a, b) AS pair, count(*) AS n FROM names GROUP BY 1 ORDER BY n DESC, pair LIMIT 10""",
    "q04b_collision_margins": f"""WITH {DECIDED}, amb AS (SELECT {MARGIN_BIN} AS margin_bin FROM dec WHERE ambiguous)
        SELECT b AS margin_bin, count(amb.margin_bin) AS n FROM (VALUES ('0-1'), ('2'), ('3-4'), ('5+'), ('unknown')) v(b)
        LEFT JOIN amb ON margin_bin = b GROUP BY b""",
    "q05_accuracy_audit": f"""WITH {_decided(18, 5, False)}, a AS (
        SELECT CASE WHEN NOT active OR best_id IS NULL THEN 'no-match' WHEN best_id = label THEN 'correct' ELSE 'wrong' END AS o, ambiguous,
          outcome = 'near_threshold' AS near_threshold, best_distance::DOUBLE AS ms FROM dec JOIN embeddings ON vec_id = frame_id)
        SELECT count(*) AS attempts, count(*) FILTER (o = 'correct') AS correct, count(*) FILTER (o = 'wrong') AS wrong,
          count(*) FILTER (o = 'no-match') AS no_match, count(*) FILTER (ambiguous) AS ambiguous, count(*) FILTER (near_threshold) AS near_threshold,
          CASE WHEN count(*) = 0 THEN 0 ELSE count(*) FILTER (o = 'correct') / count(*) * 100 END::DOUBLE AS accuracy_percent,
          avg(ms) AS ms_avg, min(ms) AS ms_min, max(ms) AS ms_max FROM a""",
    "q06_candidate_stats": f"""WITH {FINGERPRINTS}, h AS (SELECT ord, left({HEX}, 1) AS p FROM idx), n AS (SELECT p, count(*) AS n FROM h GROUP BY p),
        f AS (SELECT ord, n FROM h JOIN n USING (p))
        SELECT arg_max(n, ord) AS last, max(n) AS most, sum(n)::BIGINT AS total, count(*) AS frames FROM f""",
    "q26_neardup_greedy": f"""WITH {FINGERPRINTS}, l AS (SELECT group_id, list({HEX} ORDER BY ord) AS h FROM idx GROUP BY group_id)
        SELECT group_id, len(h)::INT AS n, {PRUNE.format(list='h', most=16, start="[]::VARCHAR[]")} AS kept,
          len({PRUNE.format(list='h', most=12, start='h[1:3]')})::INT AS appended FROM l""",
    "q29_recommendations": f"""WITH {DECIDED}, r AS (
          SELECT *, coalesce(best_id, -1) AS session_id, frame_id % 3 = 0 AS blur, frame_id % 3 <> 0 AND frame_id % 5 = 0 AS glare,
            ambiguous AND frame_id % 3 <> 0 AND frame_id % 5 <> 0 AS amb, {MARGIN_BIN} AS bin FROM dec),
        t AS (SELECT session_id, count(*) AS total, count(*) FILTER (blur) AS blur, count(*) FILTER (glare) AS glare,
            count(*) FILTER (NOT blur AND NOT glare) AS quality, count(*) FILTER (active AND NOT blur AND NOT glare) AS ok,
            count(*) FILTER (outcome = 'no_match' AND NOT blur AND NOT glare) AS none,
            count(*) FILTER (outcome IN ('ambiguous', 'near_threshold') AND NOT blur AND NOT glare) AS coll,
            sum(best_distance::DOUBLE) FILTER (blur) / count(*) FILTER (blur) AS blur_avg,
            sum(best_distance::DOUBLE) FILTER (glare) / count(*) FILTER (glare) AS glare_avg,
            avg(best_distance::DOUBLE) FILTER (near_miss AND NOT blur AND NOT glare) AS near_avg, count(*) FILTER (amb) AS na,
            count(*) FILTER (amb AND bin IN ('0-1', '2')) AS low, count(*) FILTER (amb AND bin IN ('3-4', '5+')) AS high,
            count(*) FILTER (amb AND bin = 'unknown') AS unk FROM r GROUP BY 1),
        p AS (SELECT session_id, arg_min(pair, (-n, pair)) AS top_pair FROM (
            SELECT session_id, least(best_id::VARCHAR, coalesce(second_id::VARCHAR, 'Unknown rival')) || ' vs ' || greatest(best_id::VARCHAR, coalesce(second_id::VARCHAR, 'Unknown rival')) AS pair,
              count(*) AS n FROM r WHERE amb GROUP BY 1, 2) GROUP BY 1),
        h AS (SELECT session_id, arg_min(d, (-n, d)) AS peak FROM (SELECT session_id, least(best_distance, 64) AS d, count(*) AS n FROM r WHERE best_distance IS NOT NULL GROUP BY 1, 2) GROUP BY 1),
        x AS (SELECT t.*, top_pair, peak, blur / total > 0.2 AS b1, glare / total > 0.15 AS b2, none / total > 0.15 AS b3, coll / total > 0.1 AS b4,
            coalesce(peak BETWEEN 16 AND 18 AND NOT none / total > 0.15, false) AS b5, coalesce(peak <= 8 AND ok = 0 AND quality > 5, false) AS b6
            FROM t LEFT JOIN p USING (session_id) LEFT JOIN h USING (session_id)),
        pct AS (SELECT * FROM x)
        SELECT session_id, 1 AS rule, CASE WHEN blur / total > 0.4 THEN 'high' ELSE 'medium' END AS priority,
          'blur rejections: ' || printf('%.1f', floor(blur / total * 1000 + 0.5) / 10) || '%' AS issue,
          'sharpnessThreshold: ' || coalesce(floor(blur_avg * 0.85 + 0.5), 68)::INT AS parameter_change FROM pct WHERE b1
        UNION ALL SELECT session_id, 2, CASE WHEN glare / total > 0.3 THEN 'high' ELSE 'medium' END,
          'glare rejections: ' || printf('%.1f', floor(glare / total * 1000 + 0.5) / 10) || '%',
          'glarePercentageThreshold: ' || least(coalesce(greatest(24, floor(glare_avg * CASE WHEN glare_avg >= 28 THEN 1.15 ELSE 1.3 END::DOUBLE + 0.5)), 30), 60)::INT FROM pct WHERE b2
        UNION ALL SELECT session_id, 3, CASE WHEN none / total > 0.25 THEN 'high' ELSE 'medium' END,
          'frames without a match: ' || printf('%.1f', floor(none / total * 1000 + 0.5) / 10) || '%',
          'similarityThreshold: ' || coalesce(floor(near_avg * 1.1::DOUBLE + 0.5), 21)::INT FROM pct WHERE b3
        UNION ALL SELECT session_id, 4, CASE WHEN coll / total > 0.2 THEN 'high' ELSE 'medium' END,
          'collisions: ' || printf('%.1f', floor(coll / total * 1000 + 0.5) / 10) || '%' || coalesce(', most often ' || top_pair, ''),
          CASE WHEN na > 0 AND CASE WHEN low + high + unk > 0 THEN low > high ELSE true END THEN 'matchMarginThreshold: 6' ELSE 'refreshHashes: true' END FROM pct WHERE b4
        UNION ALL SELECT session_id, 5, 'medium', 'distances peak near the threshold, at ' || peak, 'similarityThreshold: ' || greatest(16, peak - 2) FROM pct WHERE b5
        UNION ALL SELECT session_id, 6, 'high', 'close matches are never confirmed; distances peak at ' || peak, 'matchMarginThreshold: 4' FROM pct WHERE b6
        UNION ALL SELECT session_id, 7, 'high', 'few frames pass the quality checks: ' || printf('%.1f', floor(quality / total * 1000 + 0.5) / 10) || '%; mostly ' || c, 'Check ' || c || ' threshold settings'
          FROM (SELECT *, CASE WHEN blur >= glare AND blur >= 0 THEN 'blur' WHEN glare >= 0 THEN 'glare' ELSE 'lighting' END AS c FROM pct)
          WHERE quality / total < 0.3 AND NOT (b1 OR b2 OR b3 OR b4 OR b5 OR b6)""",
    "q34_hash_functions": f"""WITH m AS (SELECT doc_id, md5(text) AS m FROM documents), h AS (SELECT *, m[1:16] AS a, m[17:32] AS b FROM m), d AS (SELECT *, {XHEX} AS d FROM h)
        SELECT doc_id, d AS distance, d AS by_halves, floor((64 - d) / 64 * 100 * 100 + 0.5) / 100 AS similarity, (64 - d) / 64 * 100 AS similarity_percent,
          array_to_string(list_transform(string_split(a, ''), lambda x: lpad(bin(('0x' || x)::INT), 4, '0')), '') AS bits, b AS hex_again,
          'inf'::DOUBLE AS unequal FROM d""",
    "q35_label_telemetry": f"""WITH {DECIDED}, g AS (SELECT *, coalesce(best_id, -1) AS group_id FROM dec),
        c AS (SELECT group_id, count(*) AS frames, count(*) FILTER (active) AS active, count(*) FILTER (near_miss) AS near_misses,
          min(best_distance) AS least, max(best_distance) AS most, sum(best_distance)::BIGINT AS total FROM g GROUP BY 1),
        h AS (SELECT group_id, list(n ORDER BY d) AS distance_histogram FROM (SELECT c.group_id, r.d, count(g.frame_id) AS n FROM c CROSS JOIN range(65) r(d)
          LEFT JOIN g ON g.group_id = c.group_id AND least(g.best_distance, 64) = r.d GROUP BY 1, 2) GROUP BY 1)
        SELECT c.*, distance_histogram, CASE WHEN list_max(distance_histogram) > 0 THEN (list_position(distance_histogram, list_max(distance_histogram)) - 1)::INT END AS peak
        FROM c JOIN h USING (group_id)""",
}
