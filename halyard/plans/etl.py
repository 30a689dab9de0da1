"""Building the catalog end to end: photo rows and audio tracks in, four tables and an index out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import join_url, normalize_band, normalize_plain, resolve_alias
from ..operators import assign, catalog


@dataclass(frozen=True)
class BuildOptions:
    base: str = "https://cdn.example.net"
    prefix: str = "prod/audio"
    least_score: float = 0.8
    #: Whether the rows that share a band's tracks are counted by alias (the remapping form) or by their own name (the building form).
    alias_siblings: bool = False
    default_file: str = "concert-4.opus"
    placeholder_band: str = "prince"
    placeholder_title: str = "i wanna be your lover"


def build_catalog(photo_rows: DataFrame, tracks: DataFrame, options: BuildOptions = BuildOptions()) -> dict[str, DataFrame]:
    """Match, project, expand and normalise. photo_rows has row_id and the photo columns; tracks come from an audio index.

    Returns matched (a status per row), concerts and the four tables. The index
    is built after hashing, from concerts with hashes.
    """
    key = normalize_band(F.col("band"))
    rows = photo_rows.drop("id").withColumnRenamed("row_id", "id").withColumn("own_key", key).withColumn("band_key", resolve_alias(key))
    track_order = [F.collate(F.col("id"), "UNICODE")]
    matched = assign.match_tracks(rows.select("id", "own_key", "band_key"), tracks.select("id", "band_key", "songTitle", "fileName", "coverFile", "band"),
                                  options.least_score, [F.col("id")], track_order)
    if not options.alias_siblings:
        # rows known by an alias are not among the siblings of that name and take its first track
        first = assign.rank_in_group(tracks, "band_key", track_order, "r").filter("r = 0").select("band_key", F.struct("id", "band_key", "songTitle", "fileName", "coverFile", "band").alias("first"))
        own = assign.match_tracks(rows.filter("own_key = band_key").select("id", "own_key", "band_key"), tracks.select("id", "band_key", "songTitle", "fileName", "coverFile", "band"),
                                  options.least_score, [F.col("id")], track_order)
        aliased = matched.filter("own_key <> band_key").join(first, "band_key", "left")
        aliased = aliased.withColumn("track", F.when(F.col("status") == "matched_exact", F.col("first")).otherwise(F.col("track"))).drop("first")
        matched = own.unionByName(aliased)
    spare = catalog.placeholder_track(
        tracks.select("ord", F.col("band_key").alias("norm_band"), normalize_plain(F.col("songTitle")).alias("norm_title"), "songTitle", "fileName", "coverFile"),
        options.placeholder_band, options.placeholder_title,
    ).select(F.struct("fileName", "songTitle", "coverFile").alias("placeholder"))
    full = rows.drop("own_key", "band_key").join(matched.select("id", "track"), "id").join(F.broadcast(spare), F.lit(True), "left")
    concerts = catalog.concerts_of_rows(full, options.base, options.prefix, options.default_file)

    extra = assign.extra_tracks(rows.withColumn("band_key", F.col("own_key")).select("band_key", F.struct(*[c for c in rows.columns if c not in ("own_key", "band_key")]).alias("row"), F.col("id").alias("rid")),
                                tracks.select("band_key", F.struct("songTitle", "fileName", "coverFile").alias("track"), "ord", F.col("id").alias("tid")), "band_key",
                                [F.col("rid")], [F.collate(F.col("tid"), "UNICODE")])
    seen = tracks.groupBy("band_key").agg(F.min("ord").alias("seen"))
    start = concerts.agg((F.coalesce(F.max("id"), F.lit(0)) + 1).alias("start")).first()["start"]
    extra = assign.number_from(extra.join(seen, "band_key"), F.lit(start), [F.col("seen"), F.col("track_rank")], "new_id")
    more = catalog.concerts_of_rows(extra.select(F.col("new_id").alias("id"), "row.band", F.lit("").alias("songTitle"), "row.venue", "row.date", "row.imageFile", "row.camera", "row.focalLength", "row.aperture", "row.shutterSpeed", "row.iso", "track", F.lit(None).cast("struct<fileName:string,songTitle:string,coverFile:string>").alias("placeholder")),
                                    options.base, options.prefix, options.default_file)
    none = F.lit(None).cast("boolean")
    concerts = concerts.withColumn("recognitionEnabled", none).unionByName(more.withColumn("recognitionEnabled", F.lit(False)))
    concerts = concerts.withColumn("photoUrl", F.lit(None).cast("string")).withColumn("photoHashes", F.lit(None).cast("struct<phash:array<string>,cropPhashes:map<string,array<string>>>"))
    return {"matched": matched, "concerts": concerts} | catalog.normalize_catalog(concerts)


def audio_url(options: BuildOptions, name: str):
    return join_url(F.lit(options.base), F.lit(options.prefix), F.lit(name))
