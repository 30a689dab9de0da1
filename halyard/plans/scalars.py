"""Queries of scalar functions: URLs, dates, numbers, descriptions, and of ordered folds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import geometry as G
from ..functions import text as X
from ..operators import catalog, telemetry, verify
from .tables import table

EVENT_KINDS = ["signup", "view", "purchase", "error", "click"]
PREFIX = "en"


def q16(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    shape = X.url_shape(url, PREFIX)
    return table(spark, sf_dir, "pages").select(
        "page_id", shape["type"].alias("type"), shape["key"].alias("key"), shape["inferred_id"].alias("inferred_id"),
        X.is_remote(url).alias("remote"), X.has_prefix(X.path_name(url), F.lit(PREFIX)).alias("prefixed"), X.file_name(url).alias("file"),
        F.size(X.placeholder_hits(url)).alias("placeholders"),
    )


def q17(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.regexp_replace(F.lower("p_name"), " ", "-"), F.lit(".opus"))
    local = F.concat(F.lit("/assets//audio/"), name)
    return table(spark, sf_dir, "part").select(
        "p_partkey", X.join_url(F.lit("https://cdn.example.net//"), F.lit("/prod/audio/"), name).alias("joined"),
        X.build_url(local, F.lit("https://cdn.example.net"), F.lit("")).alias("built"), X.migrated_url(local, F.lit("https://cdn.example.net/"), "r2").alias("migrated"),
        X.replace_file_name(local, F.lit("x.opus")).alias("replaced"), X.content_type(local).alias("kind"),
        X.joined_slug(F.col("p_name"), F.col("p_brand"), F.lit(None).cast("string")).alias("slug"),
    )


def q18(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("event_type") == "error", F.when(F.col("event_id") % 3 == 0, 403).when(F.col("event_id") % 3 == 1, 404).otherwise(0)).otherwise(200)
    probes = table(spark, sf_dir, "events").select("user_id", status.alias("status")).withColumn("accessible", X.accessible(F.col("status")))
    reasons = probes.select(X.likely_failure(F.col("accessible"), F.col("status"), F.lit("Timeout reached")).alias("reason"), "accessible")
    per = reasons.groupBy("reason").agg(F.count("*").alias("total")).select(
        "reason", "total", F.lit(None).cast("bigint").alias("successful"), F.lit(None).cast("bigint").alias("failed"), F.lit(None).cast("double").alias("success_rate")
    )
    return per.unionByName(verify.probe_stats(probes).select(F.lit("all").alias("reason"), "*"))


def q19(spark: SparkSession, sf_dir: str) -> DataFrame:
    iso = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", D.display_timestamp(iso).alias("shown"), D.search_text(iso).alias("searched"),
        D.display_timestamp(F.concat(F.lit("not "), iso)).alias("unknown"), D.central_timestamp(F.col("o_orderdate")).alias("central"),
        D.normalize_date(F.date_format("o_orderdate", "MMM d, yyyy")).alias("by_month"), D.normalize_date(F.date_format("o_orderdate", "yyyyMMdd")).alias("compact"),
        D.find_date(F.concat(F.lit("recorded on "), F.date_format("o_orderdate", "yyyy/M/d"), F.lit(" live"))).alias("found"),
        D.version_age(F.date_format("o_orderdate", "yyyy.MM.dd"), F.lit("2000-01-01").cast("date")).alias("age"),
    )


def q20(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    iso = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ssXXX")
    p = X.palette(F.concat(F.lit(" "), F.col("c_name")), D.day_of_week(iso))
    return rows.select("o_orderkey", X.fnv1a(F.col("c_name")).alias("hash"), p["bg"].alias("bg"), p["main"].alias("main"), p["accent"].alias("accent"))


def q21(spark: SparkSession, sf_dir: str) -> DataFrame:
    size, price = F.col("p_size"), F.col("p_retailprice")
    shutter = F.when(size % 3 == 0, F.concat(F.lit("1/"), size.cast("string"))).when(size % 3 == 1, F.concat(size.cast("string"), F.lit("s"))).otherwise("bulb")
    f_number = F.concat(F.lit("f/"), (size / 10).cast("string"))
    seconds = F.when(size % 2 == 0, size.cast("double")).otherwise(1 / size)
    r6 = lambda x: F.round(x, 6)
    return table(spark, sf_dir, "part").select(
        "p_partkey", r6(X.parse_shutter(shutter)).alias("shutter"), r6(X.parse_aperture(f_number)).alias("aperture"),
        X.parse_iso(F.concat(F.lit("ISO "), (size * 100).cast("string"))).alias("iso"), X.parse_int(F.concat(size.cast("string"), F.lit("abc"))).alias("number"),
        X.unwrap_excel(F.concat(F.lit('="'), shutter, F.lit('"'))).alias("unwrapped"), X.format_shutter(seconds).alias("shown_shutter"),
        X.format_aperture(F.floor(size / 3) * 1.0).alias("shown_aperture"), X.format_iso(price).alias("shown_iso"),
        X.format_camera(F.col("p_brand"), F.lit("  ")).alias("camera"), X.format_focal_length(size * 1.0, F.when(size % 2 == 0, size * 1.5)).alias("focal"),
        r6(X.grain_opacity(size * 100.0)).alias("grain"), r6(X.transition_scale(seconds)).alias("transition"), X.target_bitrate(price / 8).alias("bitrate"),
    )


def q22(spark: SparkSession, sf_dir: str) -> DataFrame:
    firsts = telemetry.first_milestones(table(spark, sf_dir, "events"), "user_id", "event_type", "ts", EVENT_KINDS)
    return firsts.select("user_id", *(telemetry.duration_ms(F.col("signup"), F.col(k)).alias(f"signup_to_{k}") for k in EVENT_KINDS[1:]))


def q23(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    return telemetry.last_rows(rows, "user_id", [F.desc("event_id")], 20).select("user_id", "event_id", "event_type", "from_end")


def q24(spark: SparkSession, sf_dir: str) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct("event_id", "value")))
    rows = table(spark, sf_dir, "events").groupBy("user_id").agg(F.transform(ordered, lambda r: r["value"]).alias("values"))
    smooth = G.smoothed(F.col("values"))
    return rows.select("user_id", F.size("values").alias("n"), F.round(F.element_at(smooth, -1), 6).alias("last"), F.round(F.aggregate(smooth, F.lit(0.0), lambda s, x: s + x), 5).alias("total"))


def q25(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = G.adaptive_thresholds(F.when(F.col("event_id") % 9 != 0, F.col("value")), F.when(F.col("event_id") % 4 != 0, F.col("value") / 3))
    m = G.motion_limits(F.col("event_id") % 101)
    s = G.stability(F.col("event_id") % 300, F.lit(180))
    return table(spark, sf_dir, "events").select(
        "event_id", *(F.round(t[k], 6).alias(k) for k in ("min_brightness", "max_brightness", "glare_percent")), m["pixel"].alias("pixel"), m["pixels"].alias("pixels"),
        s["remaining_ms"].alias("remaining_ms"), F.round(s["progress"], 6).alias("progress"),
    )


def q27(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.split("text", r"\s+")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(X.ordered_distinct(words), " ").alias("tags"), F.size(X.ordered_distinct(words)).alias("n"))


def q28(spark: SparkSession, sf_dir: str) -> DataFrame:
    word = F.element_at(F.array(*map(F.lit, ("indie", "hip hop", "post-punk", "alt. rock", "music", "noise"))), (F.col("doc_id") % 6 + 1).cast("int"))
    text = F.concat_ws(" ", "text", word)
    tags = F.array(F.col("source"))
    return table(spark, sf_dir, "documents").select(
        "doc_id", X.genre_of_text(text).alias("genre"), X.genre(tags, F.array(F.lit("Music"), F.when(F.col("doc_id") % 5 == 0, "new wave").otherwise("MUSIC")), text).alias("by_category"),
        X.clean_band(F.concat(F.initcap("source"), F.lit(" & the Rest feat. Nobody"))).alias("band"),
    )


def q40(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions and shapes of frames whose sizes come from parts."""
    w, h = (F.col("p_size") * 20 + 100).cast("double"), F.col("p_retailprice")
    ratio = F.when(F.col("p_partkey") % 4 == 0, 0.0).otherwise((F.col("p_partkey") % 4) / 2)
    view, framed = G.visible_viewport(w, h, ratio), G.framed_region(w, h, "3:2")
    corners = [(F.lit(0.1), F.lit(0.2)), (F.lit(0.9), F.lit(0.2)), (F.lit(0.9), F.lit(0.7)), (F.lit(0.1), F.lit(0.7))]
    pixels = [(x * w, y * h) for x, y in corners]
    rect = G.rectangle_region(corners, w, h)
    return table(spark, sf_dir, "part").select(
        "p_partkey", *(view[k].alias(f"view_{k}") for k in ("x", "y", "width", "height")), *(framed[k].cast("double").alias(f"framed_{k}") for k in ("x", "y", "width", "height")),
        G.perspective_ok(pixels, w, h).alias("fine"), G.quadrilateral_ok(pixels[::-1], 1.0).alias("turned"), rect["aspect"].alias("aspect"), rect["width"].cast("double").alias("rect_width"),
    )


def q41(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Credits, key-value lines and JSON found in texts, from turns of conversations."""
    text = F.concat(
        F.lit("Provided to YouTube by Label "), F.col("role"), F.lit("\nGenre: Folk\n℗ 2020 House\nWriter: A"), F.col("turn").cast("string"),
        F.lit("\nWriter: B\nMix : C\nWriter: B\nGenre: Rock\n\nno colon"),
    )
    c = X.description_credits(text)
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", c["distributor"].alias("distributor"), c["label"].alias("label"), c["genre"].alias("genre"),
        F.array_join(c["credits"]["Writer"], ",").alias("writers"), F.array_join(c["credits"]["Mix"], ",").alias("mixers"), F.array_join(c["credits"]["Genre"], ",").alias("genres"),
        F.element_at(X.key_values(F.concat(F.lit("a=1\nb="), F.col("role"))), "b").alias("value"),
        F.get_json_object(X.json_in_text(F.concat(F.lit("log {\"i\": "), F.col("turn").cast("string"), F.lit("} end"))), "$.i").alias("json"),
        X.matches_any(F.col("role"), ["^user$", "sys"]).alias("any"),
    )


def q42(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which files an upload skips: suppliers' are there, remote ones are of customers."""
    local = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), F.floor("s_acctbal").cast("bigint").alias("size"), F.sha2("s_name", 256).alias("sha256"))
    remote = table(spark, sf_dir, "supplier").filter("s_suppkey % 3 <> 0").select(
        F.col("s_suppkey").alias("key"), F.floor(F.col("s_acctbal") + F.when(F.col("s_suppkey") % 5 == 0, 1).otherwise(0)).cast("bigint").alias("size"),
        F.when(F.col("s_suppkey") % 2 == 0, F.sha2(F.when(F.col("s_suppkey") % 4 == 0, F.lit("other")).otherwise(F.col("s_name")), 256)).alias("sha256"),
    )
    return verify.upload_decision(local, remote).select("key", "status")


def q43(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that are repeated, with the first, and a reuse of old fields in new rows."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("name"), F.struct("l_linenumber", "l_partkey").alias("ord"))
    return verify.duplicate_keys(rows, "l_orderkey", "name", "ord")


def q44(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")
    old = table(spark, sf_dir, "part").filter("p_size < 20").select("p_partkey", F.upper("p_name").alias("p_name"))
    return catalog.reuse_existing(parts, old, "p_partkey")


ENDINGS = ["opus", "OPUS", "m4a", "webp", "jpg", "Jpeg", "png", "avif", "json", "md", "markdown", "mp3", "tar.gz", "d/x"]


def q45(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Media types, cache rules, object keys, tags and ranges of files named after parts."""
    ending = F.element_at(F.array(*map(F.lit, ENDINGS)), (F.col("p_partkey") % len(ENDINGS) + 1).cast("int"))
    path = F.concat(F.lit("/audio/./x/../"), F.regexp_replace("p_name", " ", "%20"), F.when(F.col("p_size") % 2 == 0, "/.").otherwise("."), ending)
    size = F.col("p_size").cast("bigint")
    header = F.concat(F.lit(" bytes="), F.when(F.col("p_partkey") % 3 == 0, "").otherwise("5"), F.lit("-"), F.when(F.col("p_partkey") % 4 == 0, "").otherwise("20"))
    r = F.col("range")
    return table(spark, sf_dir, "part").select("*", X.byte_range(header, size).alias("range")).select(  # a column of its own is read once
        "p_partkey", X.content_type(path).alias("kind"), X.cache_control(path).alias("cache"), X.object_key(path, ["audio", "photos"]).alias("key"),
        X.object_key(F.concat(F.lit("/audio/../"), F.when(F.col("p_partkey") % 2 == 0, "photos/").otherwise("other/"), "p_brand"), ["audio", "photos"]).alias("moved"),
        X.quoted_etag(F.concat(F.when(F.col("p_partkey") % 5 == 0, 'W/"').otherwise(" "), "p_brand", F.when(F.col("p_partkey") % 5 == 0, '"').otherwise(" "))).alias("etag"),
        r["valid"].alias("range_ok"), r["first"].alias("range_first"), r["length"].alias("range_length"),
        X.allowed_origin(F.concat(F.lit("https://S"), "p_partkey", F.when(F.col("p_partkey") % 3 == 0, ".example.net:443/x").otherwise(".example.org")), ["https://*.example.net", "https://s1.example.org"]).alias("origin"),
    )


def q46(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key-value lines with repeated keys and loudness reports in logs, numbers from events."""
    e, n = table(spark, sf_dir, "events"), F.col("event_id").cast("string")
    lines = F.concat(F.lit("BIT_RATE=12\r\n bit_rate = "), n, F.lit("\nbit_rate=N/A\nsize="), F.when(F.col("event_id") % 2 == 0, "0").otherwise(n), F.lit("\n\nnone\nduration=1e3=2"))
    log = F.concat(F.lit("[x] {\n\"input_i\" : \"-"), n, F.lit(".5\", \"output_tp\": -1, \"target_offset\": \"inf\", \"mode\": \"dynamic\"}\nend"))
    s, k, loud = X.format_stats(lines), X.key_values(lines), X.loudness(log)
    return e.select(
        "event_id", s["bit_rate"].alias("bit_rate"), s["size"].alias("size"), s["duration"].alias("duration"), k["bit_rate"].alias("last"), F.size(k).alias("n"),
        loud["input_i"].alias("input_i"), loud["output_tp"].alias("output_tp"), loud["target_offset"].alias("target_offset"), X.loudness(lines).isNull().alias("none"),
    )


def q47(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashes of names with signs beyond the basic plane and white space of all kinds around, and texts that are blank."""
    around = F.element_at(F.array(*map(F.lit, ["\t", "\u00a0", "\u3000 ", ""])), (F.col("c_custkey") % 4 + 1).cast("int"))
    mark = F.when(F.col("c_custkey") % 3 == 0, "\U0001f3b8").when(F.col("c_custkey") % 3 == 1, "é").otherwise("")
    return table(spark, sf_dir, "customer").select(
        "c_custkey", X.fnv1a(F.concat(around, "c_name", mark, F.lit("\n"))).alias("hash"), X.blank_to_null(F.concat(around, around)).alias("blank"),
        X.blank_to_null(F.concat("c_name", F.lit(" "))).alias("kept"), X.normalize_plain(F.concat("c_name", mark)).alias("plain"),
    )


SLUG = "trim(regexp_replace(regexp_replace(regexp_replace(lower({x}), '[^a-z0-9\\s-]', '', 'g'), '\\s+', '-', 'g'), '-+', '-', 'g'), '-')"
FNV = "list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split(lower({x}), ''), lambda c: ascii(c)::BIGINT)), lambda h, c: (xor(h, c)::HUGEINT * 16777619 % 4294967296)::BIGINT)"
LOCAL = "(timezone('America/Chicago', timezone('UTC', o_orderdate::TIMESTAMP)))"
ZONE = f"CASE WHEN epoch({LOCAL}) - epoch(o_orderdate::TIMESTAMP) = -18000 THEN 'CDT' ELSE 'CST' END"
PATH = "coalesce(nullif(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1), ''), '/')"
EMA = "list_reduce(v, lambda s, x: s * 0.85::DOUBLE + x * 0.15::DOUBLE)"
QUERIES = {
    "q16_url_shape": q16, "q17_url_build": q17, "q18_success_rate": q18, "q19_date_display": q19, "q20_day_palette": q20, "q21_exif_parse": q21,
    "q22_first_milestones": q22, "q23_last_n_ring": q23, "q24_ema": q24, "q25_adaptive_thresholds": q25, "q27_ordered_distinct_tags": q27,
    "q28_genre_keywords": q28, "q40_frame_regions": q40, "q41_credits": q41, "q42_upload_decision": q42, "q43_duplicate_keys": q43, "q44_reuse_existing": q44,
    "q45_media_headers": q45, "q46_key_lines": q46, "q47_text_edges": q47,
}
ORACLE_SQL = {
    "q16_url_shape": f"""WITH p AS (SELECT page_id, url, {PATH} AS path FROM pages), k AS (SELECT *, regexp_replace(path, '^/+', '') AS key FROM p),
        s AS (SELECT *, list_filter(string_split(key[4:], '/'), lambda x: x <> '') AS parts FROM k)
        SELECT page_id, CASE WHEN NOT starts_with(key, 'en/') THEN 'non-worker-or-non-prefix' WHEN len(parts) <= 1 THEN 'flat' WHEN regexp_full_match(parts[1], '\\d+') THEN 'id-scoped' ELSE 'nested-non-numeric' END AS type,
          key, CASE WHEN starts_with(key, 'en/') AND len(parts) > 1 AND regexp_full_match(parts[1], '\\d+') THEN parts[1]::BIGINT END AS inferred_id,
          regexp_matches(url, '(?i)^https?://') AS remote, starts_with(key, 'en/') AS prefixed, string_split(path, '/')[-1] AS file, 0 AS placeholders FROM s""",
    "q17_url_build": f"""WITH x AS (SELECT *, replace(lower(p_name), ' ', '-') || '.opus' AS n FROM part)
        SELECT p_partkey, 'https://cdn.example.net/prod/audio/' || n AS joined, 'https://cdn.example.net/' || n AS built, 'https://cdn.example.net/' || n AS migrated,
          '/assets//audio/x.opus' AS replaced, 'audio/ogg; codecs=opus' AS kind, {SLUG.format(x='p_name')} || '-' || {SLUG.format(x='p_brand')} AS slug FROM x""",
    "q18_success_rate": """WITH x AS (SELECT event_type <> 'error' AS ok, event_id % 3 AS m FROM events)
        SELECT CASE WHEN ok THEN 'reachable' WHEN m = 0 THEN 'forbidden' WHEN m = 1 THEN 'missing' ELSE 'timeout' END AS reason, count(*) AS total, NULL::BIGINT AS successful, NULL::BIGINT AS failed, NULL::DOUBLE AS success_rate FROM x GROUP BY 1
        UNION ALL SELECT 'all', count(*), count(*) FILTER (ok), count(*) FILTER (NOT ok), floor(count(*) FILTER (ok) / count(*) * 100 * 10 + 0.5) / 10 FROM x""",
    "q19_date_display": f"""SELECT o_orderkey, strftime({LOCAL}, '%B %-d, %Y at %-I:%M %p ') || {ZONE} AS shown, lower(strftime({LOCAL}, '%B %-d, %Y at %-I:%M %p')) AS searched, 'Date unavailable' AS unknown,
        strftime({LOCAL}, '%Y-%m-%dT%H:%M:%S') || CASE WHEN {ZONE} = 'CDT' THEN '-05:00' ELSE '-06:00' END AS central,
        strftime(o_orderdate, '%Y-%m-%d') AS by_month, strftime(o_orderdate, '%Y-%m-%d') AS compact, strftime(o_orderdate, '%Y-%m-%d') AS found, date_diff('day', o_orderdate::DATE, DATE '2000-01-01')::INT AS age FROM orders""",
    "q20_day_palette": f"""WITH x AS (SELECT o_orderkey, {FNV.format(x='c_name')} AS hash, [0, 51, 103, 154, 205, 257, 308][dayofweek(o_orderdate) + 1] AS base FROM orders JOIN customer ON o_custkey = c_custkey),
        y AS (SELECT *, (base + hash % 51) % 360 AS hue, 62 + (hash >> 8) % 11 AS l FROM x)
        SELECT o_orderkey, hash, 'hsl(' || (hue + 20) % 360 || ', 75%, 5%)' AS bg, 'hsl(' || hue || ', 100%, ' || l || '%)' AS main, 'hsl(' || (hue + 137) % 360 || ', 100%, 58%)' AS accent FROM y""",
    "q21_exif_parse": """WITH x AS (SELECT *, CASE WHEN p_size % 3 = 0 THEN '1/' || p_size WHEN p_size % 3 = 1 THEN p_size || 's' ELSE 'bulb' END AS sh,
          CASE WHEN p_size % 2 = 0 THEN p_size::DOUBLE ELSE 1 / p_size END AS sec FROM part)
        SELECT p_partkey, round(CASE WHEN p_size % 3 = 0 THEN 1 / p_size WHEN p_size % 3 = 1 THEN p_size END, 6)::DOUBLE AS shutter, round(p_size / 10, 6) AS aperture, (p_size * 100)::DOUBLE AS iso, p_size::BIGINT AS number,
          sh AS unwrapped, CASE WHEN sec >= 1 THEN printf('%.2f', sec) || 's' ELSE '="1/' || floor(1 / sec + 0.5)::INT || '"' END AS shown_shutter,
          CASE WHEN p_size // 3 = 0 THEN '' ELSE 'f/' || (p_size // 3) || '.0' END AS shown_aperture, floor(p_retailprice + 0.5)::BIGINT::VARCHAR AS shown_iso, p_brand AS camera,
          p_size || '.0mm' || CASE WHEN p_size % 2 = 0 THEN ' ' || floor(p_size * 1.5::DOUBLE + 0.5)::INT || 'mm eq' ELSE '' END AS focal,
          round(least(0.28::DOUBLE, greatest(0.06::DOUBLE, 0.06::DOUBLE + (p_size * 100 - 100) / 3100 * 0.22::DOUBLE)), 6) AS grain,
          round(least(1.4::DOUBLE, greatest(0.6::DOUBLE, 0.6::DOUBLE + (sec - 0.001::DOUBLE) / (1 / 15 - 0.001::DOUBLE) * 0.8::DOUBLE)), 6) AS transition, least(160, floor(p_retailprice / 8 + 0.5))::INT AS bitrate FROM x""",
    "q22_first_milestones": "WITH f AS (SELECT user_id, " + ", ".join(f"min(ts) FILTER (event_type = '{k}') AS {k}" for k in EVENT_KINDS) + " FROM events GROUP BY 1) SELECT user_id, "
        + ", ".join(f"CASE WHEN signup IS NOT NULL AND {k} IS NOT NULL THEN greatest(0, epoch_us({k}) // 1000 - epoch_us(signup) // 1000) END AS signup_to_{k}" for k in EVENT_KINDS[1:]) + " FROM f",
    "q23_last_n_ring": "SELECT * FROM (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC)::INT AS from_end FROM events) WHERE from_end <= 20",
    "q24_ema": f"""WITH l AS (SELECT user_id, list(value ORDER BY event_id) AS v FROM events GROUP BY 1),
        e AS (SELECT user_id, v, {EMA} AS last, list_transform(range(1, len(v) + 1), lambda k: list_reduce(v[1:k], lambda s, x: s * 0.85::DOUBLE + x * 0.15::DOUBLE)) AS all_ FROM l)
        SELECT user_id, len(v)::INT AS n, round(last, 6) AS last, round(list_reduce(list_prepend(0::DOUBLE, all_), lambda s, x: s + x), 5) AS total FROM e""",
    "q25_adaptive_thresholds": """WITH x AS (SELECT event_id, CASE WHEN event_id % 9 <> 0 THEN value END AS b, CASE WHEN event_id % 4 <> 0 THEN value / 3 END AS g FROM events), y AS (SELECT *, (b - 135) * 0.35::DOUBLE AS s FROM x)
        SELECT event_id, round(CASE WHEN b IS NULL THEN 50 ELSE least(greatest(50 + s, 20), 80) END, 6)::DOUBLE AS min_brightness, round(CASE WHEN b IS NULL THEN 220 ELSE least(greatest(220 + s, 190), 245) END, 6)::DOUBLE AS max_brightness,
          round(CASE WHEN b IS NULL THEN 20 ELSE least(greatest(20 + greatest(0, (160 - b) / 8) + coalesce(g * 0.2::DOUBLE, 0), 20), 40) END, 6)::DOUBLE AS glare_percent,
          30 + (100 - event_id % 101) / 2 AS pixel, 500 + 10 * (100 - event_id % 101) AS pixels, greatest(180 - event_id % 300, 0) AS remaining_ms, round(least(event_id % 300 / 180, 1), 6)::DOUBLE AS progress FROM y""",
    "q27_ordered_distinct_tags": """WITH w AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w FROM conversations),
        d AS (SELECT conv_id, turn, list_filter(w, lambda x, i: list_position(list_transform(w, lambda y: lower(y)), lower(x)) = i) AS t FROM w)
        SELECT conv_id, turn, array_to_string(t, ' ') AS tags, len(t)::INT AS n FROM d""",
    "q28_genre_keywords": "WITH x AS (SELECT doc_id, source, source || ' ' || text || ' ' || ['indie', 'hip hop', 'post-punk', 'alt. rock', 'music', 'noise'][doc_id % 6 + 1] AS t FROM documents), g AS (SELECT *, CASE "
        + " ".join("WHEN regexp_matches(t, '(?i)" + p + f"') THEN '{g}'" for p, g in X.GENRES) + """ END AS genre FROM x)
        SELECT doc_id, genre, CASE WHEN doc_id % 5 = 0 THEN 'New Wave' ELSE genre END AS by_category, upper(source[1]) || source[2:] || ' and the Rest' AS band FROM g""",
    "q40_frame_regions": """WITH x AS (SELECT p_partkey, (p_size * 20 + 100)::DOUBLE AS w, p_retailprice AS h, CASE WHEN p_partkey % 4 = 0 THEN 0 ELSE (p_partkey % 4) / 2 END AS r FROM part),
        y AS (SELECT *, w / h AS own, CASE WHEN r > 0 THEN r ELSE w / h END AS want, w / h > 1.5::DOUBLE AS wide FROM x),
        z AS (SELECT *, floor(h * want + 0.5) AS nw, floor(w / want + 0.5) AS nh, CASE WHEN wide THEN h * 0.8::DOUBLE * 1.5::DOUBLE ELSE w * 0.8::DOUBLE END AS fw, CASE WHEN wide THEN h * 0.8::DOUBLE ELSE w * 0.8::DOUBLE / 1.5::DOUBLE END AS fh, abs(own - want) < 0.001 AS same FROM y)
        SELECT p_partkey, CASE WHEN NOT same AND own > want THEN floor((w - nw) / 2 + 0.5) ELSE 0 END::DOUBLE AS view_x, CASE WHEN NOT same AND own <= want THEN floor((h - nh) / 2 + 0.5) ELSE 0 END::DOUBLE AS view_y,
          CASE WHEN NOT same AND own > want THEN nw ELSE w END::DOUBLE AS view_width, CASE WHEN NOT same AND own <= want THEN nh ELSE h END::DOUBLE AS view_height,
          floor((w - fw) / 2 + 0.5) AS framed_x, floor((h - fh) / 2 + 0.5) AS framed_y, floor(fw + 0.5) AS framed_width, floor(fh + 0.5) AS framed_height,
          0.4::DOUBLE * w * h >= 64 AS fine, false AS turned, CASE WHEN 0.8::DOUBLE * w >= 0.5::DOUBLE * h THEN '3:2' ELSE '2:3' END AS aspect, floor(0.9::DOUBLE * w - 0.1::DOUBLE * w + 0.5) AS rect_width FROM z""",
    "q41_credits": """SELECT conv_id, turn, 'Label ' || role AS distributor, '2020 House' AS label, 'Folk' AS genre, 'A' || turn || ',B' AS writers, 'C' AS mixers, 'Rock' AS genres, role AS value, turn::VARCHAR AS json,
        role IN ('user', 'system') AS "any" FROM conversations""",
    "q42_upload_decision": """SELECT s_suppkey AS key, CASE WHEN s_suppkey % 3 <> 0 AND s_suppkey % 5 <> 0 AND (s_suppkey % 2 <> 0 OR s_suppkey % 4 <> 0) THEN 'skipped' ELSE 'uploaded' END AS status FROM supplier""",
    "q43_duplicate_keys": """SELECT l_orderkey, existing, l_partkey AS duplicate, k::INT AS k FROM (SELECT l_orderkey, l_partkey, first_value(l_partkey) OVER w AS existing, row_number() OVER w AS k FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey)) WHERE k > 1""",
    "q45_media_headers": f"""WITH x AS (SELECT *, {ENDINGS}[p_partkey % {len(ENDINGS)} + 1] AS e, p_size % 2 = 0 AS dot,
          CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE 5 END AS a, CASE WHEN p_partkey % 4 = 0 THEN p_size - 1 ELSE 20 END::BIGINT AS b FROM part),
        y AS (SELECT *, CASE WHEN NOT dot OR contains(e, 'tar') THEN lower(string_split(e, '.')[-1]) ELSE '' END AS t, p_name || CASE WHEN dot THEN '/.' ELSE '.' END || e AS n FROM x),
        z AS (SELECT *, CASE WHEN t = 'opus' THEN 'audio/ogg; codecs=opus' WHEN t = 'm4a' THEN 'audio/mp4' WHEN t IN ('webp', 'png', 'avif', 'jpeg') THEN 'image/' || t WHEN t = 'jpg' THEN 'image/jpeg'
          WHEN t = 'json' THEN 'application/json; charset=utf-8' WHEN t IN ('md', 'markdown') THEN 'text/markdown; charset=utf-8' ELSE 'application/octet-stream' END AS kind FROM y)
        SELECT p_partkey, kind, CASE WHEN kind[1:5] IN ('audio', 'image') THEN 'public, max-age=31536000, immutable' ELSE 'public, max-age=300' END AS cache, 'audio/' || n AS key,
          CASE WHEN p_partkey % 2 = 0 THEN 'photos/' || p_brand END AS moved, CASE WHEN p_partkey % 5 = 0 THEN 'W/"' ELSE '"' END || p_brand || '"' AS etag,
          a <= b AND b < p_size AS range_ok, CASE WHEN a <= b AND b < p_size THEN a END::BIGINT AS range_first, CASE WHEN a <= b AND b < p_size THEN b - a + 1 END AS range_length,
          CASE WHEN p_partkey % 3 = 0 THEN 'https://s' || p_partkey || '.example.net' WHEN p_partkey = 1 THEN 'https://s1.example.org' END AS origin FROM z""",
    "q46_key_lines": """SELECT event_id, CASE WHEN event_id > 0 THEN event_id ELSE 12 END::DOUBLE AS bit_rate, CASE WHEN event_id % 2 = 1 THEN event_id END::DOUBLE AS size, 1000::DOUBLE AS duration, 'N/A' AS last, 3 AS n,
        ('-' || event_id || '.5')::DOUBLE AS input_i, -1::DOUBLE AS output_tp, NULL::DOUBLE AS target_offset, true AS none FROM events""",
    "q47_text_edges": f"""WITH x AS (SELECT c_custkey, c_name, lower(c_name) || CASE c_custkey % 3 WHEN 0 THEN chr(127928) WHEN 1 THEN 'é' ELSE '' END AS t FROM customer),
        u AS (SELECT *, flatten(list_transform(string_split(t, ''), lambda c: CASE WHEN unicode(c) > 65535 THEN [55296 + (unicode(c) - 65536) // 1024, 56320 + (unicode(c) - 65536) % 1024] ELSE [unicode(c)] END)) AS u FROM x)
        SELECT c_custkey, list_reduce(list_prepend(2166136261::BIGINT, list_transform(u, lambda c: c::BIGINT)), lambda h, c: (xor(h, c)::HUGEINT * 16777619 % 4294967296)::BIGINT) AS hash, NULL::VARCHAR AS blank,
          c_name AS kept, trim(regexp_replace(lower(c_name) || CASE WHEN c_custkey % 3 = 1 THEN 'e' ELSE '' END, '[^a-z0-9]+', ' ', 'g')) AS plain FROM u""",
    "q44_reuse_existing": "SELECT p_partkey, CASE WHEN p_size < 20 THEN upper(p_name) ELSE p_name END AS p_name, p_size FROM part",
}
