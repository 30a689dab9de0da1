"""Queries of joins, look-ups and catalog building.

Orders stand for entries, customers for artists, nations for tracks and regions
for photos; parts and suppliers stand for names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import assign, catalog, verify
from .tables import table

MISSPELT = ("smal brushed stel", "larg polished copper", "medium nickle", "economy anodized tin", "standart plated brass", "promo burnished stel", "xyz")


def _flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their customer, nation and region as flat concert rows."""
    t = lambda n: table(spark, sf_dir, n)
    return (
        t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    )


def q07(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    entries = t("orders").select(
        F.col("o_orderkey").cast("int").alias("id"), F.col("o_custkey").alias("artistId"), (F.col("o_custkey") % 25).cast("int").alias("trackId"),
        F.col("o_orderpriority").alias("venue"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"),
        F.when(F.col("o_orderstatus") != "P", (F.col("o_orderkey") % 7).cast("int")).alias("photoId"),
        F.when(F.col("o_orderstatus") == "F", False).alias("recognitionEnabled"),
    )
    artists = t("customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_custkey").alias("ord"))
    tracks = t("nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("audioFile"), F.lit(None).cast("string").alias("songTitle"), F.lit(None).cast("string").alias("albumCoverUrl"), F.col("n_nationkey").alias("ord"))
    none = lambda c: F.lit(None).cast("string").alias(c)
    photos = t("region").select(
        F.col("r_regionkey").alias("id"), F.col("r_name").alias("imageFile"), none("photoUrl"), (F.col("r_regionkey") != 2).alias("recognitionEnabled"),
        none("camera"), none("aperture"), none("focalLength"), none("shutterSpeed"), none("iso"), none("photoHashes"), F.col("r_regionkey").alias("ord"),
    )
    out = catalog.denormalize({"entries": entries, "artists": artists, "tracks": tracks, "photos": photos}, strict=False)
    return out.select("id", "band", "venue", "date", "audioFile", "imageFile", "recognitionEnabled")


def q08(spark: SparkSession, sf_dir: str) -> DataFrame:
    entry = F.struct(F.col("o_custkey").alias("concertId"), F.array(F.col("o_orderstatus")).alias("phash"))
    index = table(spark, sf_dir, "orders").select(F.array(entry).alias("entries"))
    concerts = table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "id")
    return catalog.eligible(concerts, index).select(F.col("id").alias("c_custkey"), "c_name")


def q09(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"))
    right = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"))
    side = lambda df, name: df.select("key", F.lit(name).alias("side"))
    return side(verify.only_in_left(left, right, "key"), "no order").unionByName(side(verify.only_in_left(right, left, "key"), "no customer"))


def q10(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value")
    last = catalog.last_of_each(rows, ["user_id", "event_type"], "event_id")
    first = catalog.first_of_each(rows, ["user_id", "event_type"], "event_id").select("user_id", "event_type", F.col("event_id").alias("first_id"))
    return last.join(first, ["user_id", "event_type"]).select("user_id", "event_type", F.col("event_id").alias("last_id"), "value", "first_id")


def q11(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = spark.createDataFrame([(m,) for m in MISSPELT], "name string")
    parts = table(spark, sf_dir, "part").groupBy(F.lower("p_name").alias("candidate")).agg(F.min("p_partkey").alias("id"))
    best = assign.most_similar(names, parts)
    return best.select("name", "id", "candidate", F.round("score", 6).alias("score"), (F.col("score") >= 0.45).alias("accepted"))


def q11b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similarity of every part's name with its brand and type."""
    a, b = F.lower("p_name"), F.lower(F.concat_ws(" ", "p_type", "p_name"))
    return table(spark, sf_dir, "part").select(
        "p_partkey", F.round(X.similarity_score(a, b), 6).alias("score"), F.round(X.similarity_score(a, F.lower("p_type")), 6).alias("by_type"),
        F.round(X.token_overlap(a, b), 6).alias("overlap"), F.round(X.edit_similarity(a, b), 6).alias("edits"),
    )


def _groups(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("g"), F.col("c_custkey").alias("row_id"))
    tracks = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("g"), F.col("s_suppkey").alias("track_id"), "s_name")
    return rows, tracks


def q12(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, tracks = _groups(spark, sf_dir)
    out = assign.assign_in_turn(rows, tracks, "g", [F.col("row_id")], [F.col("track_id")])
    return out.select("g", "row_id", "row_rank", "track_id", "s_name")


def q13(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, tracks = _groups(spark, sf_dir)
    # customers outnumber suppliers, so they take the part of the tracks
    extra = assign.extra_tracks(tracks.drop("s_name"), rows, "g", [F.col("track_id")], [F.col("row_id")])
    out = extra.select("g", F.col("row_id").alias("extra_id"), F.col("track_id").alias("copied_id"), "track_rank")
    top = tracks.agg(F.max("track_id")).first()[0] or 0
    return assign.number_from(out, top + 1, [F.col("g"), F.col("track_rank")], "new_id").select("g", "extra_id", "copied_id", "new_id")


def q14(spark: SparkSession, sf_dir: str) -> DataFrame:
    concerts = _flat(spark, sf_dir).select(
        F.col("o_orderkey").alias("id"), F.col("n_name").alias("band"), F.concat(F.lit("song "), F.col("c_mktsegment")).alias("songTitle"),
        F.col("o_orderpriority").alias("venue"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"), F.lower("o_orderstatus").alias("audioFile"),
        F.lit(None).cast("string").alias("albumCoverUrl"), F.when(F.col("o_orderkey") % 5 != 0, F.col("c_mktsegment")).alias("imageFile"),
        F.lit(None).cast("string").alias("photoUrl"), F.when(F.col("o_orderkey") % 3 == 0, False).alias("recognitionEnabled"),
        F.when(F.col("o_orderkey") % 4 == 0, F.struct(F.array(F.substring(F.md5(F.col("o_orderkey").cast("string")), 1, 16)).alias("phash"), F.lit(None).cast("map<string,array<string>>").alias("cropPhashes"))).alias("photoHashes"),
        *(F.lit("").alias(c) for c in ("camera", "focalLength", "aperture", "shutterSpeed", "iso")),
    )
    t = catalog.normalize_catalog(concerts)
    row = lambda df, kind, ref, extra: df.select(F.lit(kind).alias("kind"), F.col("id").cast("string").alias("id"), ref.cast("string").alias("ref"), extra.cast("string").alias("extra"))
    return (
        row(t["artists"], "artist", F.lit(None), F.col("name"))
        .unionByName(row(t["photos"], "photo", F.col("artistId"), F.concat_ws("|", "imageFile", F.col("photoHashes.phash")[0])))
        .unionByName(row(t["tracks"], "track", F.col("artistId"), F.concat_ws("|", "songTitle", "audioFile")))
        .unionByName(row(t["entries"], "entry", F.col("trackId"), F.coalesce("photoId", F.lit("none"))))
    )


def q15(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.md5(F.col("text").cast("binary"))
    hashes = F.filter(F.array(F.substring(h, 1, 16), F.when(F.col("doc_id") % 3 == 0, ""), F.substring(h, 17, 16)), lambda x: x.isNotNull())
    crops = F.create_map(F.lit("center"), F.array(F.substring(h, 5, 16)), F.lit("left"), F.array(F.lit("")))
    concerts = table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("int").alias("id"), F.when(F.col("lang") == "fr", False).when(F.col("lang") == "de", True).alias("recognitionEnabled"),
        F.struct(F.when(F.col("lang") != "es", hashes).alias("phash"), crops.alias("cropPhashes")).alias("photoHashes"),
    )
    index = catalog.build_recognition_index(concerts)
    return index.select("concertId", F.array_join("phash", ",").alias("phash"), F.array_join(F.map_keys("cropPhashes"), ",").alias("crops"))


def q30(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = _flat(spark, sf_dir)
    scheme = F.when(F.col("o_orderkey") % 7 == 0, "/local/").when(F.col("o_orderkey") % 5 == 0, "https://cdn.example.net/other/").otherwise("https://cdn.example.net/prod/audio/")
    name = F.when(F.col("o_orderkey") % 11 == 0, "concert-4.opus").otherwise(F.concat(F.lower("n_name"), F.lit(".opus")))
    concerts = flat.select(
        F.col("o_orderkey").cast("int").alias("id"), F.col("n_name").alias("band"), F.concat(scheme, name).alias("audioFile"),
        F.col("r_name").alias("imageFile"), F.when(F.col("o_orderstatus") == "F", False).alias("recognitionEnabled"),
    )
    photo_rows = flat.filter("o_orderkey % 10 <> 3").select(
        F.col("o_orderkey").cast("string").alias("id"), F.when(F.col("o_orderkey") % 13 == 0, F.col("r_name")).otherwise(F.lower("n_name")).alias("band"),
        F.when(F.col("o_orderkey") % 17 == 0, "x.jpg").otherwise(F.col("r_name")).alias("imageFile"),
    )
    audio = table(spark, sf_dir, "lineitem").filter("l_linenumber <= 2").select(
        F.col("l_orderkey").alias("photoId"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"), F.lit("germany.opus").alias("fileName"), F.col("l_linenumber").alias("ord")
    )
    return verify.summary_of(verify.parts_of_findings(concerts, photo_rows, audio, "prod/audio"))


def q36(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact and most similar matches of suppliers' names among customers', with their counts."""
    key = lambda c: X.normalize_plain(F.regexp_replace(c, "(?i)customer|supplier", "band "))
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), key(F.col("s_name")).alias("band_key"))
    tracks = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.concat(F.lit("band 0000000"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0")).alias("band_key"), F.col("n_name").alias("fileName"))
    out = assign.match_tracks(rows, tracks, 0.8, [F.col("id")], [F.col("id")])
    return out.select("id", "status", "match_type", F.round("score", 6).alias("score"), F.col("track.fileName").alias("file"))


def q37(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What differs between two versions of the parts."""
    parts = table(spark, sf_dir, "part")
    after = parts.withColumn("p_name", F.when(F.col("p_size") % 9 == 0, F.upper("p_name")).otherwise(F.col("p_name"))).withColumn("p_size", F.when(F.col("p_partkey") % 10 == 0, F.col("p_size") + 1).otherwise(F.col("p_size")))
    return catalog.changed(parts, after, "p_partkey", ["p_name", "p_size"])


def q38(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next supplier of each nation, the first after the last."""
    s = table(spark, sf_dir, "supplier").select("s_nationkey", "s_suppkey", "s_name")
    return catalog.next_in_list(s, "s_nationkey", "s_suppkey", "s_name")


def q39(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events without views of a user less than an hour after their last kind of purchase."""
    e = table(spark, sf_dir, "events")
    views = e.filter("event_type = 'view'").select("event_id", F.col("user_id").alias("concert_id"), "ts")
    buys = e.filter("event_type = 'purchase'").select(F.col("user_id").alias("concert_id"), "ts")
    return catalog.suppress_closed(views, buys, 3600).select("event_id", "concert_id")


SCORE = """CASE WHEN coalesce({a}, '') = '' OR coalesce({b}, '') = '' THEN 0 WHEN {a} = {b} THEN 1 ELSE greatest(0, least(1, greatest(
  CASE WHEN contains({a}, {b}) OR contains({b}, {a}) THEN 0.75::DOUBLE ELSE 0 END,
  0.5::DOUBLE * ({overlap}) + 0.2::DOUBLE * (1 - levenshtein({a}, {b}) / greatest(length({a}), length({b})))
  + 0.3::DOUBLE * (1 - levenshtein(replace({a}, ' ', ''), replace({b}, ' ', '')) / greatest(length(replace({a}, ' ', '')), length(replace({b}, ' ', ''))))))) END"""
OVERLAP = """len(list_intersect(list_distinct(string_split({a}, ' ')), list_distinct(string_split({b}, ' ')))) /
  greatest(len(list_distinct(string_split({a}, ' '))), len(list_distinct(string_split({b}, ' '))))"""


def _score(a: str, b: str) -> str:
    return SCORE.format(a=a, b=b, overlap=OVERLAP.format(a=a, b=b))


FLAT = "orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"
QUERIES = {
    "q07_star_denormalize": q07, "q08_eligible_semi": q08, "q09_missing_anti": q09, "q10_last_wins_dedupe": q10, "q11_fuzzy_best_name": q11,
    "q11b_similarity_scores": q11b, "q12_positional_assign": q12, "q13_extra_expansion": q13, "q14_normalize_dims": q14, "q15_index_build": q15,
    "q30_verify_summary": q30, "q36_track_matching": q36, "q37_changed_fields": q37, "q38_next_in_list": q38, "q39_suppress_after_close": q39,
}
ORACLE_SQL = {
    "q07_star_denormalize": """SELECT o_orderkey::INT AS id, c_name AS band, o_orderpriority AS venue, strftime(o_orderdate, '%Y-%m-%d') AS date, n_name AS "audioFile",
        r_name AS "imageFile", coalesce(CASE WHEN o_orderstatus = 'F' THEN false END, r_regionkey <> 2) AS "recognitionEnabled"
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON n_nationkey = o_custkey % 25
        LEFT JOIN region ON o_orderstatus <> 'P' AND r_regionkey = o_orderkey % 7""",
    "q08_eligible_semi": "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)",
    "q09_missing_anti": """SELECT c_custkey AS key, 'no order' AS side FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)
        UNION ALL SELECT DISTINCT o_custkey, 'no customer' FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)""",
    "q10_last_wins_dedupe": "SELECT user_id, event_type, max(event_id) AS last_id, arg_max(value, event_id) AS value, min(event_id) AS first_id FROM events GROUP BY 1, 2",
    "q11_fuzzy_best_name": f"""WITH n(name) AS (VALUES {', '.join(f"('{m}')" for m in MISSPELT)}), p AS (SELECT lower(p_name) AS candidate, min(p_partkey) AS id FROM part GROUP BY 1),
        s AS (SELECT name, id, candidate, {_score('name', 'candidate')} AS score FROM n CROSS JOIN p)
        SELECT name, id, candidate, round(score, 6) AS score, score >= 0.45 AS accepted FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY score DESC, id) AS k FROM s) WHERE k = 1""",
    "q11b_similarity_scores": f"""WITH x AS (SELECT p_partkey, lower(p_name) AS a, lower(p_type || ' ' || p_name) AS b, lower(p_type) AS t FROM part)
        SELECT p_partkey, round({_score('a', 'b')}, 6) AS score, round({_score('a', 't')}, 6) AS by_type, round({OVERLAP.format(a='a', b='b')}, 6) AS overlap,
          round(1 - levenshtein(a, b) / greatest(length(a), length(b)), 6) AS edits FROM x""",
    "q12_positional_assign": """WITH r AS (SELECT c_nationkey AS g, c_custkey AS row_id, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS row_rank FROM customer),
        t AS (SELECT s_nationkey AS g, s_suppkey AS track_id, s_name, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS k, count(*) OVER (PARTITION BY s_nationkey) AS n FROM supplier)
        SELECT r.g, row_id, row_rank::INT AS row_rank, track_id, s_name FROM r LEFT JOIN t ON t.g = r.g AND row_rank % n = k""",
    "q13_extra_expansion": """WITH r AS (SELECT s_nationkey AS g, s_suppkey AS id, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS k, count(*) OVER (PARTITION BY s_nationkey) AS n FROM supplier),
        t AS (SELECT c_nationkey AS g, c_custkey AS id, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS k FROM customer),
        e AS (SELECT t.g, t.id AS extra_id, r.id AS copied_id, t.k FROM t JOIN r ON r.g = t.g AND t.k >= r.n AND (t.k - r.n) % r.n = r.k)
        SELECT g, extra_id, copied_id, (SELECT max(s_suppkey) FROM supplier) + row_number() OVER (ORDER BY g, k) AS new_id FROM e""",
    "q14_normalize_dims": f"""WITH c AS (SELECT o_orderkey AS id, n_name AS band, lower(n_name) AS k, 'song ' || c_mktsegment AS song, lower(o_orderstatus) AS audio,
          CASE WHEN o_orderkey % 5 <> 0 THEN c_mktsegment END AS image, CASE WHEN o_orderkey % 4 = 0 THEN md5(o_orderkey::VARCHAR)[1:16] END AS h FROM {FLAT}),
        k AS (SELECT *, 'artist-' || trim(regexp_replace(regexp_replace(lower(band), '[^a-z0-9]+', '-', 'g'), '(^|-)the(-|$)', '-', 'g'), '-') AS artist FROM c),
        p AS (SELECT artist, image, min(id) AS first, arg_min(h, id) FILTER (h IS NOT NULL) AS h FROM k WHERE image IS NOT NULL GROUP BY 1, 2),
        t AS (SELECT artist, audio, song, row_number() OVER (ORDER BY min(id), artist, audio, song) AS n FROM k GROUP BY 1, 2, 3)
        SELECT 'artist' AS kind, artist AS id, NULL AS ref, arg_min(band, id) AS extra FROM k GROUP BY artist
        UNION ALL SELECT 'photo', 'photo-' || first, artist, concat_ws('|', image, h) FROM p
        UNION ALL SELECT 'track', 'track-' || n, artist, song || '|' || audio FROM t
        UNION ALL SELECT 'entry', k.id::VARCHAR, 'track-' || n, coalesce('photo-' || first, 'none') FROM k JOIN t USING (artist, audio, song) LEFT JOIN p USING (artist, image)""",
    "q15_index_build": """SELECT doc_id::INT AS "concertId", md5(text)[1:16] || ',' || md5(text)[17:32] AS phash, 'center' AS crops FROM documents WHERE lang NOT IN ('fr', 'es')""",
    "q30_verify_summary": f"""WITH c AS (SELECT o_orderkey AS id, n_name AS band, r_name AS image, o_orderstatus <> 'F' AS on_, o_orderkey % 7 = 0 AS local, o_orderkey % 5 = 0 AND o_orderkey % 7 <> 0 AS other,
          CASE WHEN o_orderkey % 11 = 0 THEN 'concert-4.opus' ELSE lower(n_name) || '.opus' END AS file FROM {FLAT}),
        r AS (SELECT id AS rid, CASE WHEN id % 13 = 0 THEN image ELSE lower(band) END AS rband, CASE WHEN id % 17 = 0 THEN 'x.jpg' ELSE image END AS rimage FROM c WHERE id % 10 <> 3),
        tw AS (SELECT DISTINCT rimage, trim(regexp_replace(lower(rband), '[^a-z0-9]+', ' ', 'g')) AS b FROM r),
        a AS (SELECT l_orderkey AS aid, count(*) AS n FROM lineitem WHERE l_linenumber <= 2 GROUP BY 1),
        j AS (SELECT c.*, rid, trim(regexp_replace(lower(band), '[^a-z0-9]+', ' ', 'g')) AS norm, trim(regexp_replace(lower(rband), '[^a-z0-9]+', ' ', 'g')) AS rnorm, r.rimage, aid, tw.b AS twin
          FROM c LEFT JOIN r ON rid = id LEFT JOIN a ON aid = id LEFT JOIN tw ON tw.rimage = image AND tw.b = trim(regexp_replace(lower(band), '[^a-z0-9]+', ' ', 'g')))
        SELECT count(*) FILTER (local) + count(*) FILTER (other) AS url,
          count(*) FILTER (NOT local AND rid IS NOT NULL AND norm <> rnorm) + count(*) FILTER (NOT local AND rid IS NOT NULL AND image <> rimage) + count(*) FILTER (NOT local AND rid IS NULL AND (on_ OR twin IS NULL)) AS mapping,
          (SELECT sum(n - 1)::BIGINT FROM a) AS duplicate_photo_id,
          (SELECT count(*) FROM c WHERE on_ AND id NOT IN (SELECT rid FROM r)) AS missing_in_csv, (SELECT count(*) FROM r WHERE rid NOT IN (SELECT id FROM c WHERE on_)) AS missing_in_data,
          count(*) FILTER (NOT local AND file = 'concert-4.opus') AS placeholder, count(*) FILTER (NOT local AND aid IS NOT NULL AND file <> 'germany.opus') AS audio_index, true AS has_failures FROM j""",
    "q36_track_matching": f"""WITH r AS (SELECT s_suppkey AS id, trim(regexp_replace(lower(regexp_replace(s_name, '(?i)customer|supplier', 'band ')), '[^a-z0-9]+', ' ', 'g')) AS k FROM supplier),
        t AS (SELECT n_nationkey AS tid, 'band 0000000' || lpad(n_nationkey::VARCHAR, 2, '0') AS tk, n_name FROM nation),
        e AS (SELECT r.*, tid, n_name FROM r LEFT JOIN t ON k = tk), s AS (SELECT id, k, t.tid AS ftid, t.n_name AS fname, {_score('k', 'tk')} AS score FROM e CROSS JOIN t WHERE e.tid IS NULL),
        b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, ftid) AS n FROM s) WHERE n = 1)
        SELECT e.id, CASE WHEN k = '' THEN 'unmatched_missing_band' WHEN tid IS NOT NULL THEN 'matched_exact' WHEN score >= 0.8 THEN 'matched_fuzzy' ELSE 'unmatched_no_audio_match' END AS status,
          CASE WHEN tid IS NOT NULL THEN 'exact' WHEN score >= 0.8 THEN 'fuzzy' ELSE 'none' END AS match_type, CASE WHEN tid IS NOT NULL THEN 1 WHEN score >= 0.8 THEN round(score, 6) END::DOUBLE AS score,
          CASE WHEN tid IS NOT NULL THEN n_name WHEN score >= 0.8 THEN fname END AS file FROM e LEFT JOIN (SELECT id, score, fname FROM b) b USING (id)""",
    "q37_changed_fields": """SELECT p_partkey, 'p_name' AS "column", p_name AS was, upper(p_name) AS "is" FROM part WHERE p_size % 9 = 0 AND p_name <> upper(p_name)
        UNION ALL SELECT p_partkey, 'p_size', p_size::VARCHAR, (p_size + 1)::VARCHAR FROM part WHERE p_partkey % 10 = 0""",
    "q38_next_in_list": """SELECT s_nationkey, s_suppkey, s_name, coalesce(lead(s_name) OVER (PARTITION BY s_nationkey ORDER BY s_suppkey),
        first_value(s_name) OVER (PARTITION BY s_nationkey ORDER BY s_suppkey)) AS next FROM supplier""",
    "q39_suppress_after_close": """SELECT event_id, user_id AS concert_id FROM events v WHERE event_type = 'view' AND NOT EXISTS (SELECT 1 FROM events b
        WHERE b.event_type = 'purchase' AND b.user_id = v.user_id AND v.ts >= b.ts AND v.ts < b.ts + INTERVAL 3600 SECOND)""",
}
