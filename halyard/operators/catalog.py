"""The star-schema catalog: denormalising, look-ups, building and updating it.

Dimensions are reduced to the last row of each id before they are joined, as
later rows replace earlier ones. Where rows have no order of their own the
column ``ord`` gives it. Join sides are left to the optimiser, which broadcasts
those that statistics prove to be small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashes import has_hashes, valid_hashes
from ..functions.text import blank_to_null, build_url, join_url, normalize_band, parse_int, strip, unwrap_excel
from .ranks import checkpointed, global_rank


def last_of_each(df: DataFrame, key: str | list[str], order: str = "ord") -> DataFrame:
    """The row with the largest order of each key; combined before the shuffle."""
    keys = [key] if isinstance(key, str) else key
    rest = [c for c in df.columns if c not in keys]
    last = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("r"))
    return last.select(*keys, *(F.col(f"r.{c}").alias(c) for c in rest)).select(*df.columns)


def first_of_each(df: DataFrame, key: str | list[str], order: str = "ord") -> DataFrame:
    keys = [key] if isinstance(key, str) else key
    rest = [c for c in df.columns if c not in keys]
    first = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("r"))
    return first.select(*keys, *(F.col(f"r.{c}").alias(c) for c in rest)).select(*df.columns)


def catalog_tables(document: DataFrame) -> dict[str, DataFrame]:
    """The four tables of a catalog document, each with its order; another version is an error."""
    checked = document.filter(
        F.when((F.col("version") == 2) & F.col("artists").isNotNull() & F.col("photos").isNotNull() & F.col("tracks").isNotNull()
               & F.col("entries").isNotNull(), True)
        .otherwise(F.raise_error(F.lit("invalid catalog: version 2 with artists, photos, tracks and entries is expected")).cast("boolean"))
    )
    return {
        n: checked.select(F.posexplode(n).alias("ord", "r")).select("ord", "r.*") for n in ("artists", "photos", "tracks", "entries")
    }


def denormalize(tables: dict[str, DataFrame], strict: bool = True) -> DataFrame:
    """One row per entry with its artist, track and, if any, photo.

    strict raises an error for an entry without artist or track; else it is dropped.
    """
    how = "left" if strict else "inner"
    a = last_of_each(tables["artists"], "id").select(F.col("id").alias("artistId"), F.col("name").alias("band"))
    t = last_of_each(tables["tracks"], "id").select(F.col("id").alias("trackId"), "audioFile", "songTitle", "albumCoverUrl")
    p = last_of_each(tables["photos"], "id").select(
        F.col("id").alias("photoId"), "imageFile", "photoUrl", F.col("recognitionEnabled").alias("photo_enabled"), "camera",
        "aperture", "focalLength", "shutterSpeed", "iso", "photoHashes",
    )
    rows = tables["entries"].join(a, "artistId", how).join(t, "trackId", how).join(p, "photoId", "left")
    if strict:
        missing = F.concat(F.lit("entry "), F.col("id").cast("string"), F.lit(" references a missing artist or track"))
        rows = rows.filter(
            F.when(F.col("band").isNotNull() & F.col("audioFile").isNotNull(), True).otherwise(F.raise_error(missing).cast("boolean"))
        )
    return rows.select(
        "id", "band", "venue", "date", "audioFile", "songTitle", "imageFile", "photoUrl",
        F.coalesce("recognitionEnabled", "photo_enabled").alias("recognitionEnabled"), "camera", "aperture", "focalLength",
        "shutterSpeed", "iso", "photoHashes", "albumCoverUrl", "photoId", "trackId", "artistId",
    )


def enabled(flag: Column) -> Column:
    """True unless the flag is false; null counts as enabled."""
    return ~flag.eqNullSafe(F.lit(False))


def index_entries(index: DataFrame) -> DataFrame:
    """concertId, ord, hash of a recognition index, in its order."""
    rows = index.select(F.posexplode("entries").alias("entry", "e")).select("entry", "e.concertId", F.posexplode("e.phash").alias("place", "hash"))
    return rows.withColumn("ord", F.shiftleft(F.col("entry").cast("bigint"), 32) + F.col("place")).select("concertId", "ord", "hash")


def index_of_catalog(index: DataFrame, concerts: DataFrame) -> DataFrame:
    """Index entries of known concerts; entries of unknown ones drop out."""
    return index_entries(index).join(concerts.select(F.col("id").alias("concertId"), "band"), "concertId")


def eligible(concerts: DataFrame, index: DataFrame) -> DataFrame:
    """Concerts that the index knows."""
    return concerts.join(index_entries(index).select(F.col("concertId").alias("id")).distinct(), "id", "left_semi")


def with_hashes(tables: dict[str, DataFrame], index: DataFrame) -> DataFrame:
    """id, band, imageFile and hashes, the valid ones of the recognition index, of every entry with an artist."""
    a = last_of_each(tables["artists"], "id").select(F.col("id").alias("artistId"), F.col("name").alias("band"))
    p = last_of_each(tables["photos"], "id").select(F.col("id").alias("photoId"), "imageFile")
    entries = index.select(F.posexplode("entries").alias("ord", "e")).select("ord", F.col("e.concertId").alias("id"), "e.phash")
    r = last_of_each(entries, "id").select("id", "phash")
    rows = tables["entries"].join(a, "artistId").join(p, "photoId", "left").join(r, "id", "left")
    none = F.array().cast("array<string>")
    return rows.select("id", "band", "imageFile", F.coalesce(valid_hashes(F.col("phash")), none).alias("hashes"))


def cover_stats(tracks: DataFrame) -> DataFrame:
    """One row: tracks without a cover file and the largest id, 0 without tracks."""
    return tracks.agg(
        F.count_if(F.coalesce("coverFile", F.lit("")) == "").alias("missing_covers"), F.coalesce(F.max("id"), F.lit(0)).alias("max_id")
    )


def shuffled(df: DataFrame, key: str, seed: int) -> DataFrame:
    """Rows in an order that looks random and depends on key and seed only."""
    return df.orderBy(F.xxhash64(F.lit(seed), key), key)


def build_recognition_index(concerts: DataFrame) -> DataFrame:
    """concertId, phash, cropPhashes of enabled concerts that have hashes."""
    full = lambda hs: F.filter(hs, lambda h: h.isNotNull() & (F.length(h) > 0))
    empty = F.array().cast("array<string>")
    phash = full(F.coalesce(F.col("photoHashes.phash"), empty))
    crops = F.map_filter(F.transform_values("photoHashes.cropPhashes", lambda _, hs: full(F.coalesce(hs, empty))), lambda _, hs: F.size(hs) > 0)
    return (
        concerts.filter(enabled(F.col("recognitionEnabled")) & F.col("id").isNotNull())
        .select(F.col("id").alias("concertId"), phash.alias("phash"), F.when(F.size(crops) > 0, crops).alias("cropPhashes"))
        .filter(F.size("phash") > 0)
    )


def normalize_catalog(concerts: DataFrame, band_key: Column | None = None) -> dict[str, DataFrame]:
    """Flat rows as artists, photos, tracks and entries.

    The row with the smallest id that has a key makes the dimension's row; empty
    hashes of a photo are filled from the first later row that has some. Tracks
    are numbered in the order in which they are first seen.
    """
    band = strip(F.coalesce("band", F.lit("")))
    key = normalize_band(band) if band_key is None else band_key
    text_id = F.col("id").cast("string")
    image, title = blank_to_null(F.col("imageFile")), blank_to_null(F.col("songTitle"))
    audio = strip(F.coalesce("audioFile", F.lit("")))
    # written once, as all four tables are made of it: names are folded in Python and the rows may come from joins
    rows = checkpointed(concerts.select(
        "*", band.alias("_band"), F.coalesce(F.nullif(key, F.lit("")), F.concat(F.lit("artist-"), text_id)).alias("_key"),
        image.alias("_image"), audio.alias("_audio"), title.alias("_title"),
    ))
    artists = first_of_each(rows.select("_key", "id", "_band"), "_key", "id").select(
        "_key",
        F.concat(F.lit("artist-"), F.when(F.col("_key").startswith("artist-") & (F.col("_band") == ""), F.col("id").cast("string"))
                 .otherwise(F.regexp_replace("_key", r"\s+", "-"))).alias("artistId"),
        F.when(F.col("_band") != "", F.col("_band")).otherwise(F.concat(F.lit("Unknown Artist "), F.col("id").cast("string"))).alias("name"),
    )
    rows = rows.join(artists.select("_key", "artistId"), "_key")
    details = ["photoUrl", "camera", "aperture", "focalLength", "shutterSpeed", "iso"]
    filled = F.col("photoHashes").isNotNull() & (F.col("photoHashes.phash").isNotNull() | F.col("photoHashes.cropPhashes").isNotNull())
    photos = rows.filter("_image is not null").groupBy("artistId", "_image").agg(
        F.min("id").alias("_first"),
        F.min_by(F.struct("recognitionEnabled", *(blank_to_null(F.col(c)).alias(c) for c in details)), "id").alias("d"),
        F.min_by("photoHashes", F.when(filled, F.col("id"))).alias("photoHashes"),
    )
    photos = photos.select(
        F.concat(F.lit("photo-"), F.col("_first").cast("string")).alias("id"), "artistId", F.col("_image").alias("imageFile"), "d.*", "photoHashes"
    )
    tracks = rows.groupBy("artistId", "_audio", "_title").agg(
        F.min("id").alias("_first"), F.min_by(F.struct(blank_to_null(F.col("albumCoverUrl")).alias("c")), "id").alias("c")
    )
    ranked = global_rank(tracks, [F.col(c) for c in ("_first", "artistId", "_audio", "_title")], "n")
    tracks = ranked.select(
        F.concat(F.lit("track-"), (F.col("n") + 1).cast("string")).alias("id"), "artistId", F.col("_title").alias("songTitle"),
        F.col("_audio").alias("audioFile"), F.col("c.c").alias("albumCoverUrl"),
    )
    entries = (
        rows.join(tracks.select(F.col("id").alias("trackId"), F.col("artistId").alias("ta"), F.col("audioFile").alias("tf"), F.col("songTitle").alias("tt")),
                  (F.col("artistId") == F.col("ta")) & (F.col("_audio") == F.col("tf")) & F.col("_title").eqNullSafe(F.col("tt")))
        .join(photos.select(F.col("id").alias("photoId"), F.col("artistId").alias("pa"), F.col("imageFile").alias("pf")),
              (F.col("artistId") == F.col("pa")) & (F.col("_image") == F.col("pf")), "left")
        .select("id", "artistId", "trackId", F.coalesce("venue", F.lit("")).alias("venue"), F.coalesce("date", F.lit("")).alias("date"), "photoId", "recognitionEnabled")
    )
    return {"artists": artists.select(F.col("artistId").alias("id"), "name"), "photos": photos, "tracks": tracks, "entries": entries}


def concerts_of_rows(rows: DataFrame, base: str, prefix: str, default_file: str, track: str = "track", placeholder: str = "placeholder") -> DataFrame:
    """Photo rows with structs of their track and of the placeholder track (fileName, songTitle, coverFile) as concerts."""
    used = {f: F.when(F.col(track).isNotNull(), F.col(track)[f]).otherwise(F.col(placeholder)[f]) for f in ("fileName", "songTitle", "coverFile")}
    url = lambda name: join_url(F.lit(base), F.lit(prefix), name)
    text = lambda c: F.coalesce(c, F.lit(""))
    return rows.select(
        "id", strip(text(F.col("band"))).alias("band"),
        F.coalesce(blank_to_null(F.col("songTitle")), F.nullif(used["songTitle"], F.lit(""))).alias("songTitle"),
        text(F.col("venue")).alias("venue"), text(F.col("date")).alias("date"),
        url(F.coalesce(used["fileName"], F.lit(default_file))).alias("audioFile"),
        F.when(F.coalesce(used["coverFile"], F.lit("")) != "", url(used["coverFile"])).alias("albumCoverUrl"),
        text(F.col("imageFile")).alias("imageFile"), text(F.col("camera")).alias("camera"), text(F.col("focalLength")).alias("focalLength"),
        text(F.col("aperture")).alias("aperture"), unwrap_excel(F.col("shutterSpeed")).alias("shutterSpeed"),
        F.coalesce(parse_int(F.col("iso")).cast("string"), F.lit("")).alias("iso"),
    )


def placeholder_track(tracks: DataFrame, band: str, title: str) -> DataFrame:
    """At most one of ord, norm_band, norm_title rows: by band and title, else by title, else by band."""
    b, t = F.col("norm_band") == band, F.col("norm_title") == title
    rank = F.when(b & t, 0).when(t, 1).when(b, 2)
    return tracks.filter(rank.isNotNull()).orderBy(rank, "ord").limit(1)


def apply_cdn(tables: dict[str, DataFrame], base: str, audio_prefix: str, photo_prefix: str) -> dict[str, DataFrame]:
    """Remote urls for the tracks and photos that some entry uses; the others stay."""
    used = lambda c: tables["entries"].select(F.col(c).alias("id"), F.lit(True).alias("used")).filter("id is not null").distinct()
    t = tables["tracks"].join(used("trackId"), "id", "left")
    audio = F.when(F.col("used") & (F.coalesce("audioFile", F.lit("")) != ""), build_url(F.col("audioFile"), F.lit(base), F.lit(audio_prefix)))
    p = tables["photos"].join(used("photoId"), "id", "left")
    photo = F.when(F.col("used") & (F.coalesce("imageFile", F.lit("")) != ""), build_url(F.col("imageFile"), F.lit(base), F.lit(photo_prefix)))
    return tables | {
        "tracks": t.withColumn("audioFile", F.coalesce(audio, "audioFile")).select(*tables["tracks"].columns),
        "photos": p.withColumn("photoUrl", F.coalesce(photo, "photoUrl")).select(*tables["photos"].columns),
    }


def update_hashes(tables: dict[str, DataFrame], new: DataFrame) -> dict[str, DataFrame]:
    """Put regenerated photoHashes (concertId, photoHashes) into the photos of those entries."""
    of_photo = new.join(tables["entries"].select(F.col("id").alias("concertId"), "photoId"), "concertId").filter("photoId is not null")
    latest = of_photo.groupBy("photoId").agg(F.max_by("photoHashes", "concertId").alias("new_hashes"))
    p = tables["photos"].join(latest.withColumnRenamed("photoId", "id"), "id", "left")
    return tables | {"photos": p.withColumn("photoHashes", F.coalesce("new_hashes", "photoHashes")).select(*tables["photos"].columns)}


def update_index(index: DataFrame, new: DataFrame) -> DataFrame:
    """Index rows (concertId, phash, cropPhashes) with regenerated hashes; ids that the index lacks are not added."""
    fresh = new.select("concertId", F.col("photoHashes.phash").alias("p"), F.col("photoHashes.cropPhashes").alias("c"))
    both = index.join(fresh, "concertId", "left")
    return both.select("concertId", F.coalesce("p", "phash").alias("phash"), F.coalesce("c", "cropPhashes").alias("cropPhashes"))


def reuse_existing(new: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """Field by field what exists, else what is new."""
    rest = [c for c in new.columns if c != key]
    old = existing.select(key, *(F.col(c).alias("_" + c) for c in rest if c in existing.columns))
    return new.join(old, key, "left").select(
        key, *(F.coalesce("_" + c, c).alias(c) if c in existing.columns else F.col(c) for c in rest)
    )


def override(rows: DataFrame, overrides: DataFrame, by_id: str, by_file: str) -> DataFrame:
    """Overrides (key and fields) by a row's id, else by its file name, put over the row's fields one by one."""
    fields = [c for c in overrides.columns if c != "key" and c in rows.columns]
    side = lambda n: overrides.select(F.col("key").alias(n), *(F.col(c).alias(f"{n}_{c}") for c in fields), F.lit(True).alias(f"{n}_hit"))
    both = rows.join(side("k1"), F.col(by_id) == F.col("k1"), "left").join(side("k2"), F.col(by_file) == F.col("k2"), "left")
    chosen = {c: F.when(F.col("k1_hit"), F.col(f"k1_{c}")).otherwise(F.col(f"k2_{c}")) for c in fields}
    return both.select(*(F.coalesce(chosen[c], rows[c]).alias(c) if c in fields else rows[c] for c in rows.columns))


def changed(before: DataFrame, after: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows whose values differ: key, column, was, is."""
    b = before.select(key, *(F.col(c).alias("b_" + c) for c in columns))
    both = b.join(after.select(key, *columns), key)
    pairs = F.array(*(F.struct(F.lit(c).alias("column"), F.col("b_" + c).cast("string").alias("was"), F.col(c).cast("string").alias("is")) for c in columns))
    return both.select(key, F.explode(pairs).alias("d")).select(key, "d.*").filter(~F.col("was").eqNullSafe(F.col("is")))


def same_shape(before: DataFrame, after: DataFrame) -> dict[str, object]:
    """Whether as many rows are there and which fields were lost."""
    return {"same_count": before.count() == after.count(), "lost": sorted(set(before.columns) - set(after.columns))}


def suppress_closed(matches: DataFrame, closes: DataFrame, seconds: int = 2) -> DataFrame:
    """Matches without those of a concert closed less than the given time before."""
    c = closes.select(F.col("concert_id").alias("closed_id"), F.col("ts").alias("closed_at"))
    soon = (F.col("concert_id") == F.col("closed_id")) & (F.col("ts") >= F.col("closed_at")) & (F.col("ts") < F.col("closed_at") + F.expr(f"interval {seconds} seconds"))
    return matches.join(c, soon, "left_anti")


def next_in_list(tracks: DataFrame, group: str, order: str, name: str) -> DataFrame:
    """Each row's successor in its group, the first after the last."""
    w = Window.partitionBy(group).orderBy(order)
    first = F.first(name).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return tracks.withColumn("next", F.coalesce(F.lead(name).over(w), first))


def demo_targets(manifest: DataFrame, concerts: DataFrame, n: int) -> DataFrame:
    """n usable captures of single-capture samples, of different artists as long as there are any."""
    usable = concerts.filter(has_hashes(F.col("photoHashes.phash")) & enabled(F.col("recognitionEnabled")))
    c = manifest.select(F.posexplode("samples").alias("ord", "s")).filter(F.size("s.captures") == 1).select(
        "ord", "s.sampleId", "s.filename", F.col("s.captures")[0]["concertId"].alias("id"), F.col("s.captures")[0]["photoId"].alias("wanted")
    ).filter(~F.col("filename").contains("..") & ~F.col("filename").startswith("/"))
    rows = c.join(usable.select("id", "band", "artistId", "photoId"), "id").filter("wanted = photoId")
    nth = F.row_number().over(Window.partitionBy("artistId").orderBy("ord"))
    return rows.withColumn("nth", nth).orderBy((F.col("nth") > 1).cast("int"), "ord").limit(n).drop("nth", "wanted")


def manifest_captures(manifest: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """Captures with whether their concert and photo exist."""
    rows = manifest.select(F.explode("samples").alias("s")).select("s.sampleId", "s.filename", F.explode("s.captures").alias("c")).select("sampleId", "filename", "c.*")
    e = tables["entries"].select(F.col("id").alias("concertId"), F.lit(True).alias("e")).distinct()
    p = tables["photos"].select(F.col("id").alias("photoId"), F.lit(True).alias("p")).distinct()
    return rows.join(e, "concertId", "left").join(p, "photoId", "left").select(
        "sampleId", "filename", "captureId", "concertId", "photoId", F.coalesce("e", F.lit(False)).alias("has_concert"), F.coalesce("p", F.lit(False)).alias("has_photo")
    )


def refresh_status(concerts: DataFrame) -> DataFrame:
    """Which concerts get new hashes, and why the others don't."""
    status = (
        F.when(~enabled(F.col("recognitionEnabled")), "disabled").when(blank_to_null(F.col("imageFile")).isNull(), "no-image")
        .when(F.col("resolved_path").isNull(), "unresolved").when(F.col("error").isNotNull(), "error").otherwise("ok")
    )
    return concerts.withColumn("status", status)


def strict_hashes(index: DataFrame) -> DataFrame:
    """The index, an error if an entry has no hash or an invalid one."""
    n = F.size(valid_hashes(F.col("phash")))
    bad = F.concat(F.lit("invalid hashes of concert "), F.col("concertId").cast("string"))
    return index.filter(F.when((n > 0) & (n == F.size("phash")), True).otherwise(F.raise_error(bad).cast("boolean")))
