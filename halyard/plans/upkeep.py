"""Queries of catalog upkeep: strict look-ups, overrides, hashes put back, urls rewritten, captures chosen, pixels adjusted.

Orders stand for entries, customers for photos or artists, parts for tracks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import images
from ..operators import assign, catalog, telemetry, verify
from ..sources import readers
from .sessions import _images
from .tables import table

HASHES = "struct<phash:array<string>,cropPhashes:map<string,array<string>>>"
BASE, AUDIO, PHOTO = "https://cdn.example.net", "prod/audio", "prod/photos"


def _none(c: str, kind: str = "string"):
    return F.lit(None).cast(kind).alias(c)


def _text(c: str):
    return F.col(c).cast("string")


def q48(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries whose artists and tracks all exist, with every column that the strict form gives."""
    t = lambda n: table(spark, sf_dir, n)
    key = F.col("o_orderkey")
    entries = t("orders").select(
        key.alias("id"), F.col("o_custkey").alias("artistId"), F.pmod(key, F.lit(25)).cast("int").alias("trackId"), F.col("o_orderpriority").alias("venue"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"), F.when(key % 4 != 0, F.pmod(key, F.lit(7)).cast("int")).alias("photoId"),
        F.when(F.col("o_orderstatus") == "F", False).alias("recognitionEnabled"),
    )
    # customers occur twice, the later row with another name
    later = lambda n: t("customer").select(F.col("c_custkey").alias("id"), F.when(F.lit(n == 0), "old").otherwise(F.col("c_name")).alias("name"), F.lit(n).alias("ord"))
    artists = later(0).unionByName(later(1))
    tracks = t("nation").select(
        F.col("n_nationkey").alias("id"), F.lower("n_name").alias("audioFile"), F.col("n_name").alias("songTitle"), _none("albumCoverUrl"), F.col("n_nationkey").alias("ord")
    )
    r = F.col("r_regionkey")
    photos = t("region").select(
        r.alias("id"), F.col("r_name").alias("imageFile"), F.lower("r_name").alias("photoUrl"), (r != 2).alias("recognitionEnabled"), _none("camera"), F.concat(F.lit("f/"), r).alias("aperture"),
        _none("focalLength"), _none("shutterSpeed"), (r * 100).cast("string").alias("iso"), _none("photoHashes"), r.alias("ord"),
    )
    out = catalog.denormalize({"entries": entries, "artists": artists, "tracks": tracks, "photos": photos})
    return out.select("id", "band", "venue", "date", "audioFile", "songTitle", "imageFile", "photoUrl", "recognitionEnabled", "aperture", "iso", "photoId", "trackId", "artistId")


def _index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index document per order, of one entry with up to three hashes."""
    md5 = F.md5(_text("o_orderkey"))
    hashes = F.slice(F.array(F.substring(md5, 1, 16), F.substring(md5, 17, 16), F.lit("none")), F.lit(1), (F.pmod("o_orderkey", F.lit(3)) + 1).cast("int"))
    return table(spark, sf_dir, "orders").select(F.array(F.struct(F.col("o_orderkey").alias("concertId"), hashes.alias("phash"))).alias("entries"))


def q49(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashes of the concerts that exist, in the index's order."""
    concerts = table(spark, sf_dir, "lineitem").filter("l_linenumber = 3").select(F.col("l_orderkey").alias("id"), F.col("l_returnflag").alias("band"))
    return catalog.index_of_catalog(_index(spark, sf_dir), concerts)


def q50(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata put over parts by id, else by file."""
    rows = table(spark, sf_dir, "part").select(_text("p_partkey").alias("id"), F.concat(F.lit("f"), "p_partkey").alias("file"), F.col("p_name").alias("title"), F.col("p_brand").alias("album"))
    s = table(spark, sf_dir, "supplier")
    title = F.when(F.col("s_suppkey") % 3 != 0, F.col("s_name"))
    by_id = s.filter("s_suppkey % 2 = 0").select(_text("s_suppkey").alias("key"), title.alias("title"), F.lit("by id").alias("album"))
    by_file = s.filter("s_suppkey % 5 <> 1").select(F.concat(F.lit("f"), "s_suppkey").alias("key"), F.lit("filed").alias("title"), title.alias("album"))
    return catalog.override(rows, by_id.unionByName(by_file), "id", "file")


def q51(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracks that nothing plays."""
    tracks = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_partkey") % 9 != 0, F.concat(F.lit("p"), "p_partkey", F.lit(".opus"))).alias("fileName"))
    played = F.concat(F.lit(BASE + "/audio/p"), "l_partkey", F.lit(".opus"))
    concerts = table(spark, sf_dir, "lineitem").filter("l_quantity < 3").select(F.when(F.col("l_linenumber") > 1, played).alias("audioFile"))
    return verify.unmapped(tracks, concerts).select("p_partkey", "fileName")


def _photos(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = F.named_struct(F.lit("phash"), F.array(F.lit("old")), F.lit("cropPhashes"), F.lit(None).cast("map<string,array<string>>")).cast(HASHES)
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 2 == 0, old).alias("photoHashes"))


def _fresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    md5 = F.md5(_text("o_orderkey"))
    new = F.named_struct(F.lit("phash"), F.array(F.substring(md5, 1, 16)), F.lit("cropPhashes"), F.create_map(F.lit("center-80"), F.array(F.substring(md5, 17, 16)))).cast(HASHES)
    return table(spark, sf_dir, "orders").filter("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("concertId"), new.alias("photoHashes"))


def q52(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regenerated hashes in the photos of their entries; of several, those of the latest entry."""
    entries = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") != "P", F.col("o_custkey")).alias("photoId"))
    photos = catalog.update_hashes({"photos": _photos(spark, sf_dir), "entries": entries}, _fresh(spark, sf_dir))["photos"]
    return photos.select("id", F.col("photoHashes.phash")[0].alias("phash"), F.col("photoHashes.cropPhashes")["center-80"][0].alias("crop"))


def q53(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same in the index, whose missing ids stay missing."""
    index = table(spark, sf_dir, "orders").filter("o_orderkey % 2 = 0").select(
        F.col("o_orderkey").alias("concertId"), F.array(F.col("o_orderstatus")).alias("phash"), _none("cropPhashes", "map<string,array<string>>")
    )
    out = catalog.update_index(index, _fresh(spark, sf_dir))
    return out.select("concertId", F.col("phash")[0].alias("phash"), F.col("cropPhashes")["center-80"][0].alias("crop"))


def q54(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Remote urls of the tracks and photos in use."""
    used = table(spark, sf_dir, "lineitem").filter("l_quantity > 40").select(F.col("l_partkey").alias("trackId"), F.when(F.col("l_linenumber") == 1, F.col("l_suppkey")).alias("photoId"))
    tracks = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 6 == 0, "").otherwise(F.concat(F.lit("/media/audio/"), "p_partkey", F.lit(".opus"))).alias("audioFile"))
    photos = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.concat(F.lit("img/"), "s_suppkey", F.lit(".jpg")).alias("imageFile"), _none("photoUrl"))
    out = catalog.apply_cdn({"entries": used, "tracks": tracks, "photos": photos}, BASE + "/", "/" + AUDIO + "/", PHOTO)
    return out["tracks"].select(F.lit("track").alias("kind"), "id", F.col("audioFile").alias("url")).unionByName(
        out["photos"].select(F.lit("photo").alias("kind"), "id", F.col("photoUrl").alias("url"))
    )


def q55(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most urgent advice of each user, the earlier rule first."""
    kind = F.col("event_type")
    priority = F.when(kind == "purchase", "high").when(kind == "click", "medium").otherwise("low")
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("session_id"), F.col("event_id").alias("rule"), priority.alias("priority"), kind.alias("issue"), F.col("props").alias("parameter_change"))
    return telemetry.first_recommendation(rows)


def q56(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The placeholder for wanted brands and types: both, the type alone, the brand alone, none."""
    tracks = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("ord"), F.col("p_brand").alias("norm_band"), F.col("p_type").alias("norm_title"))
    wanted = [(n, *pair) for n, pair in enumerate((("Brand#11", "PROMO"), ("no brand", "ECONOMY"), ("Brand#22", "no type"), ("no brand", "no type")))]
    parts = [catalog.placeholder_track(tracks, band, title).withColumn("wanted", F.lit(n)) for n, band, title in wanted]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def q57(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as photo rows, made concerts with the defaults for what is missing."""
    k = F.col("p_partkey")
    track = F.when(k % 2 == 0, F.named_struct(F.lit("fileName"), F.concat(k, F.lit(".opus")), F.lit("songTitle"), F.col("p_type"), F.lit("coverFile"), F.when(k % 4 == 0, F.concat(k, F.lit(".jpg")))))
    spare = F.when(k % 3 != 0, F.named_struct(F.lit("fileName"), F.lit("spare.opus"), F.lit("songTitle"), F.lit(""), F.lit("coverFile"), F.lit("")))
    rows = table(spark, sf_dir, "part").select(
        k.alias("id"), F.concat(F.lit("\t"), "p_brand", F.lit(" ")).alias("band"), F.when(k % 5 == 0, F.col("p_name")).otherwise("  ").alias("songTitle"),
        _none("venue"), F.lit("2024-05-01").alias("date"), F.when(k % 7 != 0, F.lit("i.jpg")).alias("imageFile"), F.lit("C").alias("camera"), _none("focalLength"), F.lit("f/2").alias("aperture"),
        F.concat(F.lit('="1/'), "p_size", F.lit('"')).alias("shutterSpeed"), F.concat("p_size", F.lit(" ISO")).alias("iso"), track.alias("track"), spare.alias("placeholder"),
    )
    return catalog.concerts_of_rows(rows, BASE, AUDIO, "default.opus")


def _manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document of the nations as samples; some have two captures, ask for another photo or lie outside."""
    n = F.col("n_nationkey")
    capture = lambda c, photo: F.struct(F.concat(F.lit(c), n).alias("captureId"), n.alias("concertId"), photo.alias("photoId"))
    one = capture("a", F.concat(F.lit("p"), F.when(n % 5 == 1, n + 1).otherwise(n)))
    captures = F.when(n % 8 == 0, F.array(one, capture("b", F.concat(F.lit("p"), n + 90)))).otherwise(F.array(one))
    name = F.when(n % 9 == 2, F.concat(F.lit("../"), "n_name")).when(n % 11 == 3, F.concat(F.lit("/"), "n_name")).otherwise(F.col("n_name"))
    sample = F.struct(n.alias("nr"), F.lower("n_name").alias("sampleId"), name.alias("filename"), captures.alias("captures"))
    return table(spark, sf_dir, "nation").agg(F.sort_array(F.collect_list(sample)).alias("samples"))


def q58(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven usable captures, of different regions as long as there are any."""
    n = F.col("n_nationkey")
    concerts = table(spark, sf_dir, "nation").select(
        n.alias("id"), F.col("n_name").alias("band"), F.col("n_regionkey").alias("artistId"), F.concat(F.lit("p"), n).alias("photoId"), (n % 6 != 0).alias("recognitionEnabled"),
        F.named_struct(F.lit("phash"), F.when(n % 13 != 0, F.array(F.lit("h"))), F.lit("cropPhashes"), F.lit(None).cast("map<string,array<string>>")).alias("photoHashes"),
    )
    return catalog.demo_targets(_manifest(spark, sf_dir), concerts, 7)


def q59(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captures with whether their concert and their photo exist."""
    entries = table(spark, sf_dir, "nation").filter("n_regionkey <> 2").select(F.col("n_nationkey").alias("id"))
    photos = table(spark, sf_dir, "nation").filter("n_regionkey <> 3").select(F.concat(F.lit("p"), "n_nationkey").alias("id"))
    return catalog.manifest_captures(_manifest(spark, sf_dir), {"entries": entries, "photos": photos})


def q60(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty rows of a report from the fortieth on."""
    return verify.page(table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_name"), [F.col("p_size").desc(), F.col("p_partkey")], 40, 20)


def q61(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of a segment, letter case and all, and those of listed ids."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    kind = lambda df, k: df.select(F.lit(k).alias("kind"), "c_custkey")
    found = kind(verify.search(c, "c_mktsegment", F.lit("BUILDING")), "segment").unionByName(kind(verify.search(c, "c_mktsegment", F.lit("building")), "lower"))
    return found.unionByName(kind(readers.by_ids(c, "c_custkey", [3, 5, 8, 10**9]), "listed"))


def q62(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which concerts get new hashes, and why the others don't."""
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(
        k.alias("id"), F.when(k % 3 != 0, k % 3 == 1).alias("recognitionEnabled"), F.when(k % 5 == 0, "\t ").when(k % 5 != 1, F.lit("i.jpg")).alias("imageFile"),
        F.when(k % 7 != 0, F.lit("/i.jpg")).alias("resolved_path"), F.when(k % 11 == 0, F.lit("bad")).alias("error"),
    )
    return catalog.refresh_status(rows).select("id", "status")


def q63(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index whose hashes are all valid, as the strict form lets it pass."""
    index = _index(spark, sf_dir).select(F.col("entries")[0]["concertId"].alias("concertId"), F.slice(F.col("entries")[0]["phash"], 1, 2).alias("phash"))
    return catalog.strict_hashes(index).select("concertId", F.array_join("phash", ",").alias("hashes"))


def q64(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a step kept rows and fields."""
    before = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")
    steps = [("fewer", before.filter("p_size > 25")), ("narrower", before.drop("p_size", "p_name")), ("same", before.withColumn("extra", F.lit(1)))]
    shapes = [(name, catalog.same_shape(before, after)) for name, after in steps]
    return spark.createDataFrame([(n, s["same_count"], ",".join(s["lost"])) for n, s in shapes], "step string, same_count boolean, lost string")


def q65(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of how rows were matched."""
    kind = F.col("l_linenumber") % 5
    status = F.when(kind == 0, "matched_exact").when(kind == 1, "matched_fuzzy").when(kind == 2, "unmatched_missing_source_row").when(kind == 3, "unmatched_missing_band").otherwise("kept")
    return assign.match_counts(table(spark, sf_dir, "lineitem").select(status.alias("status")))


def q66(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels made brighter and darker, by gamma, and cut to a region."""
    d = (F.col("h"), F.col("w"), F.col("data"))
    hexed = lambda c: F.lower(F.hex(c))
    return _images(spark, sf_dir).select(
        "vec_id", hexed(images.adjusted_column(*d, delta=40)).alias("brighter"), hexed(images.adjusted_column(*d, delta=-200)).alias("darker"),
        hexed(images.adjusted_column(*d, exponent=2.0)).alias("squared"), hexed(images.crop_column(*d, key="center-50")).alias("center"),
    )


QUERIES = {
    "q48_star_strict": q48, "q49_index_of_catalog": q49, "q50_metadata_override": q50, "q51_unmapped_tracks": q51, "q52_hash_updates": q52,
    "q53_index_updates": q53, "q54_remote_urls": q54, "q55_first_advice": q55, "q56_placeholder_track": q56, "q57_concert_rows": q57, "q58_demo_targets": q58,
    "q59_manifest_captures": q59, "q60_report_page": q60, "q61_lookups": q61, "q62_refresh_status": q62, "q63_strict_index": q63, "q64_same_shape": q64,
    "q65_match_counts": q65, "q66_pixel_adjustments": q66,
}
FRESH = "fresh AS (SELECT o_orderkey AS cid, md5(o_orderkey::VARCHAR) AS h FROM orders WHERE o_orderkey % 3 = 0)"
ENTRY_HASHES = "list_slice([md5(o_orderkey::VARCHAR)[1:16], md5(o_orderkey::VARCHAR)[17:32], 'none'], 1, o_orderkey % 3 + 1)"
SAMPLES = """s AS (SELECT n_nationkey AS n, n_regionkey AS r, lower(n_name) AS "sampleId", n_name AS band,
        CASE WHEN n_nationkey % 9 = 2 THEN '../' WHEN n_nationkey % 11 = 3 THEN '/' ELSE '' END || n_name AS filename, 'p' || CASE WHEN n_nationkey % 5 = 1 THEN n_nationkey + 1 ELSE n_nationkey END AS photo FROM nation)"""
BYTES = "list_transform(embedding, lambda x: greatest(0, least(255, floor(x::DOUBLE * 400 + 128)))::INT)"
SHOWN = "array_to_string(list_transform({v}, lambda v: repeat(printf('%02x', v::INT), 3) || 'ff'), '')"
ORACLE_SQL = {
    "q48_star_strict": """SELECT o_orderkey AS id, c_name AS band, o_orderpriority AS venue, strftime(o_orderdate, '%Y-%m-%d') AS date, lower(n_name) AS "audioFile", n_name AS "songTitle",
        r_name AS "imageFile", lower(r_name) AS "photoUrl", CASE WHEN o_orderstatus = 'F' THEN false ELSE r_regionkey <> 2 END AS "recognitionEnabled", 'f/' || r_regionkey AS aperture, (r_regionkey * 100)::VARCHAR AS iso,
        CASE WHEN o_orderkey % 4 <> 0 THEN o_orderkey % 7 END::INT AS "photoId", (o_orderkey % 25)::INT AS "trackId", o_custkey AS "artistId"
        FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = o_orderkey % 25 LEFT JOIN region ON o_orderkey % 4 <> 0 AND r_regionkey = o_orderkey % 7""",
    "q49_index_of_catalog": f"""WITH i AS (SELECT o_orderkey AS cid, {ENTRY_HASHES} AS hs FROM orders), u AS (SELECT cid, unnest(hs) AS hash, unnest(range(len(hs))) AS ord FROM i)
        SELECT cid AS "concertId", ord, hash, l_returnflag AS band FROM u JOIN lineitem ON l_orderkey = cid AND l_linenumber = 3""",
    "q50_metadata_override": """SELECT p_partkey::VARCHAR AS id, 'f' || p_partkey AS file,
        coalesce(CASE WHEN i.s_suppkey IS NOT NULL THEN CASE WHEN i.s_suppkey % 3 <> 0 THEN i.s_name END WHEN f.s_suppkey IS NOT NULL THEN 'filed' END, p_name) AS title,
        coalesce(CASE WHEN i.s_suppkey IS NOT NULL THEN 'by id' WHEN f.s_suppkey % 3 <> 0 THEN f.s_name END, p_brand) AS album
        FROM part LEFT JOIN supplier i ON i.s_suppkey = p_partkey AND i.s_suppkey % 2 = 0 LEFT JOIN supplier f ON f.s_suppkey = p_partkey AND f.s_suppkey % 5 <> 1""",
    "q51_unmapped_tracks": """SELECT p_partkey, 'p' || p_partkey || '.opus' AS "fileName" FROM part WHERE p_partkey % 9 <> 0 AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_quantity < 3 AND l_linenumber > 1 AND l_partkey = p_partkey)""",
    "q52_hash_updates": f"""WITH {FRESH}, n AS (SELECT o_custkey AS pid, arg_max(h, cid) AS h FROM fresh JOIN orders ON o_orderkey = cid WHERE o_orderstatus <> 'P' GROUP BY 1)
        SELECT c_custkey AS id, coalesce(h[1:16], CASE WHEN c_custkey % 2 = 0 THEN 'old' END) AS phash, h[17:32] AS crop FROM customer LEFT JOIN n ON pid = c_custkey""",
    "q53_index_updates": f"""WITH {FRESH} SELECT o_orderkey AS "concertId", coalesce(h[1:16], o_orderstatus) AS phash, h[17:32] AS crop FROM orders LEFT JOIN fresh ON cid = o_orderkey WHERE o_orderkey % 2 = 0""",
    "q54_remote_urls": f"""SELECT 'track' AS kind, p_partkey AS id, CASE WHEN p_partkey % 6 = 0 THEN '' WHEN p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 40) THEN '{BASE}/{AUDIO}/' || p_partkey || '.opus'
          ELSE '/media/audio/' || p_partkey || '.opus' END AS url FROM part
        UNION ALL SELECT 'photo', s_suppkey, CASE WHEN s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_quantity > 40 AND l_linenumber = 1) THEN '{BASE}/{PHOTO}/' || s_suppkey || '.jpg' END FROM supplier""",
    "q55_first_advice": """SELECT user_id AS session_id, event_id AS rule, priority, event_type AS issue, props AS parameter_change FROM (
          SELECT *, CASE event_type WHEN 'purchase' THEN 'high' WHEN 'click' THEN 'medium' ELSE 'low' END AS priority,
            row_number() OVER (PARTITION BY user_id ORDER BY CASE event_type WHEN 'purchase' THEN 0 WHEN 'click' THEN 1 ELSE 2 END, event_id) AS k FROM events) WHERE k = 1""",
    "q56_placeholder_track": """WITH w(wanted, band, title) AS (VALUES (0, 'Brand#11', 'PROMO'), (1, 'no brand', 'ECONOMY'), (2, 'Brand#22', 'no type'), (3, 'no brand', 'no type')),
        r AS (SELECT wanted, p_partkey AS ord, p_brand AS norm_band, p_type AS norm_title, row_number() OVER (PARTITION BY wanted ORDER BY CASE WHEN p_brand = band AND p_type = title THEN 0 WHEN p_type = title THEN 1 ELSE 2 END, p_partkey) AS k
          FROM w JOIN part ON p_brand = band OR p_type = title)
        SELECT wanted, ord, norm_band, norm_title FROM r WHERE k = 1""",
    "q57_concert_rows": f"""SELECT p_partkey AS id, p_brand AS band, CASE WHEN p_partkey % 5 = 0 THEN p_name WHEN p_partkey % 2 = 0 THEN p_type END AS "songTitle", '' AS venue, '2024-05-01' AS date,
        '{BASE}/{AUDIO}/' || CASE WHEN p_partkey % 2 = 0 THEN p_partkey || '.opus' WHEN p_partkey % 3 <> 0 THEN 'spare.opus' ELSE 'default.opus' END AS "audioFile",
        CASE WHEN p_partkey % 4 = 0 THEN '{BASE}/{AUDIO}/' || p_partkey || '.jpg' END AS "albumCoverUrl", CASE WHEN p_partkey % 7 <> 0 THEN 'i.jpg' ELSE '' END AS "imageFile",
        'C' AS camera, '' AS "focalLength", 'f/2' AS aperture, '1/' || p_size AS "shutterSpeed", p_size::VARCHAR AS iso FROM part""",
    "q58_demo_targets": f"""WITH {SAMPLES}, u AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY n) AS k FROM s
          WHERE n % 8 <> 0 AND NOT contains(filename, '..') AND NOT starts_with(filename, '/') AND n % 13 <> 0 AND n % 6 <> 0 AND photo = 'p' || n)
        SELECT n AS ord, "sampleId", filename, n AS id, band, r AS "artistId", photo AS "photoId" FROM u ORDER BY k > 1, n LIMIT 7""",
    "q59_manifest_captures": f"""WITH {SAMPLES}, c AS (SELECT n, "sampleId", filename, 'a' || n AS cid, photo FROM s UNION ALL SELECT n, "sampleId", filename, 'b' || n, 'p' || (n + 90) FROM s WHERE n % 8 = 0)
        SELECT "sampleId", filename, cid AS "captureId", n AS "concertId", photo AS "photoId", n IN (SELECT n_nationkey FROM nation WHERE n_regionkey <> 2) AS has_concert,
          photo IN (SELECT 'p' || n_nationkey FROM nation WHERE n_regionkey <> 3) AS has_photo FROM c""",
    "q60_report_page": "SELECT p_partkey, p_size, p_name FROM part ORDER BY p_size DESC, p_partkey LIMIT 20 OFFSET 40",
    "q61_lookups": "SELECT 'segment' AS kind, c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' UNION ALL SELECT 'listed', c_custkey FROM customer WHERE c_custkey IN (3, 5, 8)",
    "q62_refresh_status": """SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 2 THEN 'disabled' WHEN c_custkey % 5 < 2 THEN 'no-image' WHEN c_custkey % 7 = 0 THEN 'unresolved'
        WHEN c_custkey % 11 = 0 THEN 'error' ELSE 'ok' END AS status FROM customer""",
    "q63_strict_index": f"""SELECT o_orderkey AS "concertId", array_to_string(list_slice({ENTRY_HASHES}, 1, 2), ',') AS hashes FROM orders""",
    "q64_same_shape": "SELECT 'fewer' AS step, (SELECT count(*) FROM part WHERE p_size > 25) = (SELECT count(*) FROM part) AS same_count, '' AS lost UNION ALL SELECT 'narrower', true, 'p_name,p_size' UNION ALL SELECT 'same', true, ''",
    "q65_match_counts": """SELECT count(*) FILTER (l_linenumber % 5 = 0) AS exact, count(*) FILTER (l_linenumber % 5 = 1) AS fuzzy, count(*) FILTER (l_linenumber % 5 IN (2, 3)) AS unmatched,
        count(*) FILTER (l_linenumber % 5 = 2) AS missing_source_rows FROM lineitem""",
    "q66_pixel_adjustments": f"""WITH x AS (SELECT vec_id, {BYTES} AS b FROM embeddings)
        SELECT vec_id, {SHOWN.format(v='list_transform(b, lambda v: least(255, v + 40))')} AS brighter, {SHOWN.format(v='list_transform(b, lambda v: greatest(0, v - 200))')} AS darker,
          {SHOWN.format(v='list_transform(b, lambda v: floor((v / 255) ** 2 * 255 + 0.5))')} AS squared,
          {SHOWN.format(v='list_transform(list_filter(range(64), lambda i: i // 8 BETWEEN 2 AND 5 AND i % 8 BETWEEN 2 AND 5), lambda i: b[i + 1])')} AS center FROM x""",
}
