"""Readers with explicit schemas. Paths may be in any store that Spark reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schemas
from ..functions import text as X
from ..functions.dates import central_timestamp
from ..functions.exif import exif
from ..functions.images import rgba_of_bgr
from ..functions.text import blank_to_null, normalize_band, parse_int

IMAGE_NAME = r"(?i)\.(jpg|jpeg|png|webp)$"
#: Audio file endings by preference.
AUDIO_ENDINGS = ("opus", "ogg", "oga", "webm", "m4a", "mp3", "aac", "flac", "wav")


def catalog(spark: SparkSession, path: str) -> DataFrame:
    """The catalog document, one row."""
    return spark.read.schema(schemas.CATALOG).option("multiLine", True).json(path)


def recognition_index(spark: SparkSession, path: str) -> DataFrame:
    doc = spark.read.schema(schemas.RECOGNITION_INDEX).option("multiLine", True).json(path)
    bad = F.raise_error(F.lit("invalid recognition index: version 2 with entries is expected")).cast("boolean")
    return doc.filter(F.when((F.col("version") == 2) & F.col("entries").isNotNull(), True).otherwise(bad))


def csv_rows(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """All-string rows of a CSV file with a header; empty and missing cells are empty strings, cells beyond are dropped."""
    read = spark.read.option("header", True).option("quote", '"').option("escape", '"').option("mode", "PERMISSIVE")
    read = read.option("enforceSchema", False) if columns is None else read.schema(", ".join(f"{c} string" for c in columns))
    df = read.csv(path)
    return df.toDF(*[c.strip() for c in df.columns]).na.fill("")


def photo_rows(spark: SparkSession, path: str) -> DataFrame:
    """Photo detail rows with an integer id; others are dropped."""
    rows = csv_rows(spark, path, schemas.PHOTO_CSV_COLUMNS)
    number = parse_int(F.col("id"))
    return rows.withColumn("row_id", number).filter("row_id is not null")


def audio_tracks(index: DataFrame) -> DataFrame:
    """Tracks of an audio index that have a band and a file, with their normalised band."""
    t = index.select(F.posexplode("tracks").alias("ord", "t")).select("ord", "t.*")
    text = lambda c: F.trim(F.coalesce(c, F.lit("")))
    full = (text(F.col("band")) != "") & (text(F.col("fileName")) != "")
    rows = t.filter(full).select(
        "ord", F.coalesce("id", F.lit("")).alias("id"), text(F.col("band")).alias("band"), text(F.coalesce("songTitle", "title")).alias("songTitle"),
        text(F.col("fileName")).alias("fileName"), blank_to_null(F.col("coverFile")).alias("coverFile"), "photoId",
        normalize_band(F.col("band")).alias("band_key"),
    )
    return rows.filter("band_key <> ''")


def audio_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.AUDIO_INDEX).option("multiLine", True).json(path)


def files(spark: SparkSession, paths: str | list[str], name: str | None = None, recursive: bool = False, content: bool = False) -> DataFrame:
    """path, length, modificationTime (and content) of files whose path matches, each once, in order of path."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(paths)
    df = df if content else df.drop("content")
    if name is not None:
        df = df.filter(F.col("path").rlike(name))
    return df.dropDuplicates(["path"]).orderBy("path")


def images(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Image files with content, as they are."""
    return files(spark, paths, IMAGE_NAME, content=True)


def decoded_images(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """image_id (the path), height, width, data (RGBA) of the images that Spark's image source decodes; others are left out."""
    read = spark.read.format("image").option("dropInvalid", True).load(paths).select("image.*")
    return read.select(F.col("origin").alias("image_id"), "height", "width", rgba_of_bgr(F.col("nChannels"), F.col("data")).alias("data"))


def photo_metadata(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """file_name and what the camera wrote, formatted, of ``.jpg`` files; empty texts where a file says nothing.

    A time without zone is taken as UTC. Files of no bytes don't show, as Spark's readers skip them.
    """
    rows = files(spark, paths, r"(?i)\.jpg$", content=True).select(F.element_at(F.split("path", "/"), -1).alias("file_name"), exif(F.col("content")).alias("x"))
    taken = F.try_to_timestamp("x.taken", F.lit("yyyy:MM:dd HH:mm:ss"))
    text = lambda c: F.coalesce(c, F.lit(""))
    return rows.select(
        "file_name", text(central_timestamp(taken)).alias("date"), text(X.format_shutter(F.col("x.exposure"))).alias("shutterSpeed"),
        X.format_camera(F.col("x.make"), F.col("x.model")).alias("camera"), text(X.format_aperture(F.col("x.f_number"))).alias("aperture"),
        text(X.format_focal_length(F.col("x.focal"), F.col("x.focal35"))).alias("focalLength"), text(X.format_iso(F.col("x.iso"))).alias("iso"),
    ).orderBy(F.collate("file_name", "UNICODE"))


def sidecars(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Metadata documents: ``*.metadata.json``, or ``*.info.json`` only if there are none; bad documents are skipped."""
    def read(suffix: str) -> DataFrame:
        return (
            spark.read.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED").option("pathGlobFilter", f"*{suffix}")
            .json(path).withColumn("source", F.input_file_name())
        )

    first = read(".metadata.json")
    return read(".info.json") if first.isEmpty() else first


def metadata_of_info(info: DataFrame) -> DataFrame:
    """Canonical fields of a downloader's info document, each from the first source that has it."""
    c = lambda n: F.col(n) if n in info.columns else F.lit(None).cast("string")
    artists = F.nullif(F.array_join("artists", ", "), F.lit("")) if "artists" in info.columns else F.lit(None).cast("string")
    return info.select(
        F.coalesce(c("track"), c("title"), F.lit("Unknown Title")).alias("title"),
        F.coalesce(c("artist"), artists, c("uploader"), c("channel"), F.lit("Unknown Artist")).alias("artist"),
        c("album").alias("album"), F.coalesce(c("release_date"), c("upload_date")).alias("date"), c("description").alias("description"),
        c("webpage_url").alias("url"),
    )


def audio_sibling(documents: DataFrame, audio: DataFrame) -> DataFrame:
    """Documents (stem) with the audio file (path) of their stem whose ending is preferred; documents without one drop out."""
    ending = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    rank = F.array_position(F.array(*map(F.lit, AUDIO_ENDINGS)), ending)
    found = audio.select(F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1).alias("stem"), "path", rank.alias("rank")).filter("rank > 0")
    best = found.withColumn("k", F.row_number().over(Window.partitionBy("stem").orderBy("rank", "path"))).filter("k = 1")
    return documents.join(best.select("stem", F.col("path").alias("audio_path")), "stem")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.MANIFEST).option("multiLine", True).json(path)


def by_ids(df: DataFrame, column: str, ids: list[int]) -> DataFrame:
    return df.filter(F.col(column).isin(list(ids)))


def probes(spark: SparkSession, path: str) -> DataFrame:
    """Recorded probe results: concert_id, url, method, status, status_text; a status from 200 to 399 counts as accessible."""
    df = spark.read.schema("concert_id int, url string, method string, status int, status_text string").json(path)
    return df.withColumn("accessible", (F.col("status") >= 200) & (F.col("status") < 400))


def frame_stream(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """Frames that arrive as Parquet files."""
    return spark.readStream.schema(schemas.FRAME).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def bitrate_kbps(stream: Column, container: Column, size: Column, seconds: Column) -> Column:
    """Of the stream, else of the container, else what size and duration give."""
    return F.floor(F.coalesce(stream, container, size * 8 / F.nullif(seconds, F.lit(0.0))) / 1000 + 0.5).cast("int")
