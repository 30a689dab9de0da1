"""Checks of a catalog against its sources, as tagged rows and a summary."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from .catalog import enabled
from .ranks import global_rank

#: Kinds of findings that make a verification fail.
CRITICAL = ("url", "mapping", "duplicate-photo-id", "missing-in-csv", "missing-in-data")
KINDS = (*CRITICAL, "placeholder", "audio-index")


def only_in_left(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    return left.select(key).distinct().join(right.select(key), key, "left_anti")


def duplicate_keys(df: DataFrame, key: str, name: str, order: str = "ord") -> DataFrame:
    """Rows after the first of a key with what the first was."""
    w = Window.partitionBy(key).orderBy(order)
    rows = df.filter(F.col(key).isNotNull()).select(
        key, F.first(name).over(w).alias("existing"), F.col(name).alias("duplicate"), F.row_number().over(w).alias("k")
    )
    return rows.filter("k > 1")


def unmapped(tracks: DataFrame, concerts: DataFrame) -> DataFrame:
    """Tracks with a file that no concert plays."""
    played = concerts.filter(F.coalesce("audioFile", F.lit("")) != "").select(F.element_at(F.split("audioFile", "/"), -1).alias("fileName")).distinct()
    return tracks.filter(F.coalesce("fileName", F.lit("")) != "").join(played, "fileName", "left_anti")


def _finding(kind: str, issue: Column | str, found: Column, wanted: Column, on: Column) -> Column:
    issue = F.lit(issue) if isinstance(issue, str) else issue
    row = F.struct(F.lit(kind).alias("kind"), issue.alias("issue"), found.cast("string").alias("found"), wanted.cast("string").alias("wanted"))
    return F.when(F.coalesce(on, F.lit(False)), row)


def findings(concerts: DataFrame, photo_rows: DataFrame, audio_index: DataFrame, prefix: str) -> DataFrame:
    """id, kind, issue, found, wanted.

    concerts: id, band, audioFile, imageFile, recognitionEnabled; photo_rows: id (text), band, imageFile;
    audio_index: photoId, id, fileName. A concert whose file isn't remote is reported for that only.
    """
    csv = photo_rows.select(F.col("id").alias("key"), F.col("band").alias("csv_band"), F.coalesce("imageFile", F.lit("")).alias("csv_image"), F.lit(True).alias("has_row"))
    order = F.col("ord" if "ord" in audio_index.columns else "id")
    audio = audio_index.filter("photoId is not null").groupBy("photoId").agg(F.min(F.struct(order.alias("at"), "fileName"))["fileName"].alias("index_file"))
    audio = audio.select(F.col("photoId").cast("string").alias("key"), "index_file")
    twins = photo_rows.filter(F.coalesce("imageFile", F.lit("")) != "").select(
        F.col("imageFile").alias("t_image"), X.normalize_plain(F.col("band")).alias("t_band"), F.lit(True).alias("has_twin")
    ).distinct()
    rows = concerts.select(
        "id", F.col("id").cast("string").alias("key"), F.coalesce("band", F.lit("")).alias("band"), F.coalesce("audioFile", F.lit("")).alias("url"),
        F.coalesce("imageFile", F.lit("")).alias("image"), enabled(F.col("recognitionEnabled")).alias("on"), X.normalize_plain(F.col("band")).alias("norm"),
    )
    rows = rows.join(csv.withColumn("csv_norm", X.normalize_plain(F.col("csv_band"))), "key", "left").join(audio, "key", "left")
    rows = rows.join(twins, (F.col("image") == F.col("t_image")) & (F.col("norm") == F.col("t_band")), "left")
    remote, has_row = X.is_remote(F.col("url")), F.coalesce("has_row", F.lit(False))
    path, name = X.path_name(F.col("url")), X.file_name(F.col("url"))
    hits = X.placeholder_hits(F.col("url"))
    wanted_path = F.regexp_replace(F.concat(F.lit("/" + prefix.strip("/") + "/"), name), "/+", "/")
    none = F.lit(None).cast("string")
    checks = [
        _finding("url", "not-remote", F.col("url"), none, ~remote),
        _finding("url", "non-prefixed-path", path, wanted_path, remote & ~X.has_prefix(path, F.lit(prefix))),
        _finding("placeholder", "placeholder", F.col("url"), F.array_join(hits, " "), remote & (F.size(hits) > 0)),
        _finding("mapping", "band", F.col("band"), F.col("csv_band"), remote & has_row & (F.col("norm") != F.col("csv_norm"))),
        _finding("mapping", "image", F.col("image"), F.col("csv_image"), remote & has_row & (F.col("image") != F.col("csv_image"))),
        _finding("mapping", "missing-row", F.col("image"), none, remote & ~has_row & (F.col("on") | ~F.coalesce("has_twin", F.lit(False)))),
        _finding("audio-index", "file-name", name, F.col("index_file"), remote & (F.col("index_file") != "") & (F.col("index_file") != name)),
    ]
    return rows.select("id", F.explode(F.array_compact(F.array(*checks))).alias("f")).select("id", "f.*")


def all_findings(concerts: DataFrame, photo_rows: DataFrame, audio_index: DataFrame, prefix: str) -> DataFrame:
    """Row checks, repeated photo ids and ids that only one side has."""
    return reduce(DataFrame.unionByName, parts_of_findings(concerts, photo_rows, audio_index, prefix))


def parts_of_findings(concerts: DataFrame, photo_rows: DataFrame, audio_index: DataFrame, prefix: str) -> list[DataFrame]:
    """The parts of all_findings."""
    row = lambda df, kind, found: df.select(F.lit(None).cast("int").alias("id"), F.lit(kind).alias("kind"), F.lit(kind).alias("issue"), found.cast("string").alias("found"), F.lit(None).cast("string").alias("wanted"))
    order = "ord" if "ord" in audio_index.columns else "id"
    data_ids = concerts.filter(enabled(F.col("recognitionEnabled"))).select(F.col("id").cast("string").alias("key"))
    csv_ids = photo_rows.select(F.col("id").alias("key"))
    return [
        findings(concerts, photo_rows, audio_index, prefix),
        row(duplicate_keys(audio_index, "photoId", "id", order), "duplicate-photo-id", F.col("photoId")),
        row(only_in_left(data_ids, csv_ids, "key"), "missing-in-csv", F.col("key")),
        row(only_in_left(csv_ids, data_ids, "key"), "missing-in-data", F.col("key")),
    ]


def summary_of(parts: list[DataFrame]) -> DataFrame:
    """The summary of parts that are counted each on its own, as a task of their union would hold the rows of all."""
    tallies = reduce(DataFrame.unionByName, [p.groupBy("kind").agg(F.count("*").alias("n")) for p in parts])
    count = lambda *k: F.coalesce(F.sum(F.when(F.col("kind").isin(*k), F.col("n"))), F.lit(0))
    return tallies.agg(*(count(k).alias(k.replace("-", "_")) for k in KINDS), (count(*CRITICAL) > 0).alias("has_failures"))


def summary(found: DataFrame) -> DataFrame:
    """One row of a count per kind and whether the verification failed."""
    count = lambda k: F.count_if(F.col("kind") == k)
    failed = F.count_if(F.col("kind").isin(*CRITICAL)) > 0
    return found.agg(*(count(k).alias(k.replace("-", "_")) for k in KINDS), failed.alias("has_failures"))


def probe_stats(probes: DataFrame) -> DataFrame:
    """total, successful, failed and the success rate in percent to one digit."""
    n, good = F.count("*"), F.count_if("accessible")
    rate = F.when(n == 0, 0.0).otherwise(F.floor(good / n * 100 * 10 + 0.5) / 10)
    return probes.agg(n.alias("total"), good.alias("successful"), (n - good).alias("failed"), rate.alias("success_rate"))


def upload_decision(local: DataFrame, remote: DataFrame, dry_run: bool = False) -> DataFrame:
    """local (key, size, sha256) with skipped where the remote has the same file, else uploaded (dry-run)."""
    r = remote.select("key", F.col("size").alias("r_size"), F.col("sha256").alias("r_sha"))
    same = (F.col("r_size") == F.col("size")) & (F.col("r_sha").isNull() | (F.col("r_sha") == F.col("sha256")))
    status = F.when(F.coalesce(same, F.lit(False)), "skipped").otherwise("dry-run" if dry_run else "uploaded")
    return local.join(r, "key", "left").select(*local.columns, status.alias("status"))


def chunks(df: DataFrame, order: list[Column], size: int = 1000) -> DataFrame:
    """Rows numbered into chunks of a size, for requests that take so many keys."""
    return global_rank(df, order, "chunk").withColumn("chunk", F.floor(F.col("chunk") / size))


def search(df: DataFrame, column: str, wanted: Column) -> DataFrame:
    """Rows whose column equals the value, case and all."""
    return df.filter(F.col(column) == wanted)


def page(df: DataFrame, order: list[Column], start: int, most: int) -> DataFrame:
    return df.orderBy(*order).offset(start).limit(most)
