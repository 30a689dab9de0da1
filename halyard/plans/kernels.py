"""Queries of pixel kernels and of small rules, with SQL that gets them by another road."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import images
from ..functions import text as X
from ..operators import catalog, telemetry
from ..sources import readers
from .sessions import GRAY, PIXELS, _images
from .tables import table


def q79(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = (F.col("h"), F.col("w"), F.col("data"))
    return _images(spark, sf_dir).select("vec_id", images.phash_column(*d).alias("phash"), F.sha2("data", 256).alias("sha256"))


def q80(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of failed playback and what to fall back on: error events fail, every fifth says what to do."""
    n = F.col("event_id")
    said = F.concat(F.lit("Playback of "), n.cast("string"), F.lit(" failed."), F.when(n % 5 == 0, " Tap PLAY to retry.").otherwise(""))
    url = F.concat(F.lit("https://host/audio/"), n.cast("string"), F.when(n % 3 == 0, ".m4a").when(n % 3 == 1, ".opus").otherwise(".opus.mp3"))
    rows = table(spark, sf_dir, "events").filter("event_type = 'error'")
    return rows.select("event_id", X.with_retry_hint(said, F.lit("Check the net and try again.")).alias("message"), F.array_join(X.audio_sources(url), "|").alias("sources"))


def q81(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_partkey")
    cover = F.when(n % 4 == 1, "").when(n % 4 > 1, F.concat(F.lit("c"), n.cast("string"), F.lit(".jpg")))
    return catalog.cover_stats(table(spark, sf_dir, "part").select(n.alias("id"), cover.alias("coverFile")))


def q82(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of kinds of events that follow each other, in their order, as the audit counts rivals."""
    n = F.col("event_id")
    rival = F.when(n % 7 != 0, F.concat(F.lit("user "), (F.col("user_id") % 4).cast("string")))
    return table(spark, sf_dir, "events").groupBy(telemetry.ordered_pair_key(F.col("event_type"), rival).alias("pair")).agg(F.count("*").alias("n"))


def q83(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every other customer goes by an alias."""
    names, n = sorted(X.BAND_ALIASES), F.col("c_custkey")
    known = F.element_at(F.array(*map(F.lit, names)), ((n / 2).cast("int") % len(names) + 1).cast("int"))
    normal = F.when(n % 2 == 0, known).otherwise(X.normalize_band(F.col("c_name")))
    return table(spark, sf_dir, "customer").select("c_custkey", X.resolve_alias(normal).alias("band_key"))


def q84(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rate of a stream, else of its container, else what its size and duration give."""
    k, n = F.col("l_linenumber"), F.col("l_orderkey")
    stream = F.when(n % 3 == 0, (k * 1000 + n % 977).cast("double"))
    held = F.when(n % 3 == 1, (k * 2500 + n % 501).cast("double"))
    rate = readers.bitrate_kbps(stream, held, (n * 8 + k).cast("double"), (k - 1).cast("double"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", rate.alias("kbps"))


def q85(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sheared quadrilaterals of the images, made flat."""
    n = F.col("vec_id")
    left, top, shear = n % 3, F.floor(n / 3) % 2, n % 2
    corners = F.array(*(x.cast("double") for x in (left + shear, top, left + shear + 5, top, left + 5, top + 5, left, top + 5)))
    flat = images.warp_column(F.col("h"), F.col("w"), F.col("data"), corners, F.when(n % 5 > 0, "3:2").otherwise("2:3"))
    return _images(spark, sf_dir).select("vec_id", F.sha2(flat, 256).alias("flat_sha256"))


def q86(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All seven crops of each image."""
    keys = F.explode(F.array(*map(F.lit, images.CROPS))).alias("region")
    rows = _images(spark, sf_dir).select("vec_id", "h", "w", "data", keys)
    return rows.select("vec_id", "region", F.sha2(images.region_column(F.col("h"), F.col("w"), F.col("data"), F.col("region")), 256).alias("crop_sha256"))


def q87(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The images' pixels as 16 by 4 or 4 by 16, in a square."""
    wide = F.col("vec_id") % 2 == 0
    boxed = images.letterbox_column(F.when(wide, 4).otherwise(16), F.when(wide, 16).otherwise(4), F.col("data"))
    return _images(spark, sf_dir).select("vec_id", F.sha2(boxed, 256).alias("boxed_sha256"))


QUERIES = {
    "q79_cosine_hash": q79, "q80_retry_and_sources": q80, "q81_cover_stats": q81, "q82_pairs_as_ranked": q82, "q83_aliases": q83, "q84_bitrate_chain": q84,
    "q85_rectify": q85, "q86_crops": q86, "q87_letterbox": q87,
}
_ALIAS = ", ".join(f"('{a}', '{b}', {i})" for i, (a, b) in enumerate(sorted(X.BAND_ALIASES.items())))
HEX_PIXEL = "repeat(printf('%02x', {v}::INT), 3) || 'ff'"
#: A fraction of an image's side, and the cells that it makes, as whole numbers.
_SIDES = ", ".join("('" + k + "', " + ", ".join(str(int(v * 8 + 0.5)) for v in box) + ")" for k, box in images.CROPS.items())
ORACLE_SQL = {
    # the map of a parallelogram is linear: no system of equations is solved
    "q85_rectify": f"""WITH img AS (
          SELECT vec_id, {PIXELS} AS px, vec_id % 3 AS x0, vec_id // 3 % 2 AS y0, vec_id % 2 AS s, CASE WHEN vec_id % 5 > 0 THEN 96 ELSE 64 END AS w, CASE WHEN vec_id % 5 > 0 THEN 64 ELSE 96 END AS h FROM embeddings
        ), places AS (
          SELECT vec_id, px, y, x, x0 + s + 5 * x / (w - 1) - s * y / (h - 1) AS u, y0 + 5 * y / (h - 1) AS v FROM (SELECT *, unnest(range(h)) AS y FROM img) CROSS JOIN range(96) r(x) WHERE x < w
        ), near AS (
          SELECT *, greatest(0, least(7, floor(u)))::INT AS a, greatest(0, least(7, floor(v)))::INT AS b, u - floor(u) AS p, v - floor(v) AS q FROM places
        ), mixed AS (
          SELECT vec_id, y, x, round_even((px[b * 8 + a + 1] * (1 - p) + px[b * 8 + least(a + 1, 7) + 1] * p) * (1 - q) + (px[least(b + 1, 7) * 8 + a + 1] * (1 - p) + px[least(b + 1, 7) * 8 + least(a + 1, 7) + 1] * p) * q, 0) AS v FROM near
        ) SELECT vec_id, sha256(unhex(string_agg({HEX_PIXEL.format(v='v')}, '' ORDER BY y, x))) AS flat_sha256 FROM mixed GROUP BY vec_id""",
    "q86_crops": f"""WITH k(region, x, y, w, h) AS (VALUES {_SIDES}), img AS (SELECT vec_id, {PIXELS} AS px FROM embeddings),
        cells AS (SELECT vec_id, region, j, i, CASE WHEN y + j < 8 AND x + i < 8 THEN {HEX_PIXEL.format(v='px[((y + j) * 8 + x + i + 1)::INT]')} ELSE '00000000' END AS c
          FROM img CROSS JOIN k CROSS JOIN range(8) a(j) CROSS JOIN range(8) b(i) WHERE j < h AND i < w)
        SELECT vec_id, region, sha256(unhex(string_agg(c, '' ORDER BY j, i))) AS crop_sha256 FROM cells GROUP BY ALL""",
    "q87_letterbox": f"""WITH img AS (SELECT vec_id, {PIXELS} AS px, vec_id % 2 = 0 AS wide FROM embeddings),
        cells AS (SELECT vec_id, y, x, CASE WHEN wide AND y BETWEEN 12 AND 19 THEN px[((y - 12) // 2 * 16 + x // 2 + 1)::INT] WHEN NOT wide AND x BETWEEN 12 AND 19 THEN px[(y // 2 * 4 + (x - 12) // 2 + 1)::INT] ELSE 0 END AS v
          FROM img CROSS JOIN range(32) a(y) CROSS JOIN range(32) b(x))
        SELECT vec_id, sha256(unhex(string_agg({HEX_PIXEL.format(v='v')}, '' ORDER BY y, x))) AS boxed_sha256 FROM cells GROUP BY vec_id""",
    # the transform as two joins with a table of cosines over the 32 x 32 cells, each pixel being 4 x 4 of them
    "q79_cosine_hash": f"""WITH img AS (SELECT vec_id, {GRAY} AS g, {PIXELS} AS px FROM embeddings),
        cells AS (SELECT vec_id, y, x, g[y // 4 * 8 + x // 4 + 1] AS v FROM img CROSS JOIN range(32) a(y) CROSS JOIN range(32) b(x)),
        cosines AS (SELECT u, k, cos((2 * k + 1) * u * pi() / 64) AS c FROM range(8) a(u) CROSS JOIN range(32) b(k)),
        rows_ AS (SELECT vec_id, y, u, sum(v * c ORDER BY x) AS s FROM cells JOIN cosines ON k = x GROUP BY ALL),
        both_ AS (SELECT vec_id, w.u AS v, r.u, sum(s * c ORDER BY y) AS s FROM rows_ r JOIN cosines w ON w.k = y GROUP BY ALL),
        coef AS (SELECT vec_id, v * 8 + u AS k, s * CASE WHEN u = 0 THEN sqrt(0.5) ELSE 1 END * CASE WHEN v = 0 THEN sqrt(0.5) ELSE 1 END / 2 AS c FROM both_ WHERE u + v > 0),
        bits AS (SELECT vec_id, k, c > list_sort(list(c) OVER (PARTITION BY vec_id))[32] AS b FROM coef),
        nibbles AS (SELECT vec_id, (k - 1) // 4 AS pos, sum(CASE WHEN b THEN 8 // (1 << ((k - 1) % 4)::INT) ELSE 0 END)::INT AS d FROM bits GROUP BY ALL),
        hashes AS (SELECT vec_id, string_agg(substr('0123456789abcdef', d + 1, 1), '' ORDER BY pos) AS phash FROM nibbles GROUP BY vec_id),
        raw AS (SELECT vec_id, list_aggregate(list_transform(px, lambda v: repeat(printf('%02x', v::INT), 3) || 'ff'), 'string_agg', '') AS hx FROM img)
        SELECT vec_id, phash, sha256(unhex(hx)) AS sha256
        FROM hashes JOIN raw USING (vec_id)""",
    "q80_retry_and_sources": """SELECT event_id, 'Playback of ' || event_id || ' failed.' || CASE WHEN event_id % 5 = 0 THEN ' Tap PLAY to retry.' ELSE ' Check the net and try again.' END AS message,
        CASE event_id % 3 WHEN 0 THEN 'https://host/audio/' || event_id || '.m4a' WHEN 1 THEN 'https://host/audio/' || event_id || '.opus|https://host/audio/' || event_id || '.m4a'
          ELSE 'https://host/audio/' || event_id || '.opus.mp3' END AS sources FROM events WHERE event_type = 'error'""",
    "q81_cover_stats": "SELECT count(*) FILTER (p_partkey % 4 < 2) AS missing_covers, coalesce(max(p_partkey), 0) AS max_id FROM part",
    "q82_pairs_as_ranked": """SELECT event_type || ' vs ' || CASE WHEN event_id % 7 = 0 OR user_id IS NULL THEN 'Unknown rival' ELSE 'user ' || (user_id % 4) END AS pair, count(*) AS n
        FROM events GROUP BY 1""",
    "q83_aliases": f"""WITH a(name, stands_for, i) AS (VALUES {_ALIAS}),
        c AS (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN (SELECT name FROM a WHERE i = c_custkey // 2 % {len(X.BAND_ALIASES)}) ELSE trim(regexp_replace(lower(c_name), '[^a-z0-9]+', ' ', 'g')) END AS name FROM customer)
        SELECT c_custkey, coalesce(stands_for, c.name) AS band_key FROM c LEFT JOIN a ON a.name = c.name""",
    "q84_bitrate_chain": """SELECT l_orderkey, l_linenumber, floor(CASE l_orderkey % 3 WHEN 0 THEN l_linenumber * 1000 + l_orderkey % 977 WHEN 1 THEN l_linenumber * 2500 + l_orderkey % 501
        ELSE CASE WHEN l_linenumber > 1 THEN (l_orderkey * 8 + l_linenumber)::DOUBLE * 8 / (l_linenumber - 1) END END / 1000::DOUBLE + 0.5)::INT AS kbps FROM lineitem""",
}
