"""Explicit schemas of the documents that the engine reads, as DDL."""

from __future__ import annotations

HASHES = "struct<phash:array<string>,cropPhashes:map<string,array<string>>>"
ARTIST = "id string, name string"
PHOTO = (
    "id string, artistId string, imageFile string, photoUrl string, recognitionEnabled boolean, camera string, "
    f"aperture string, focalLength string, shutterSpeed string, iso string, photoHashes {HASHES}"
)
TRACK = "id string, artistId string, songTitle string, audioFile string, albumCoverUrl string"
ENTRY = "id int, artistId string, trackId string, venue string, date string, photoId string, recognitionEnabled boolean"


def _nested(fields: str) -> str:
    """The fields of a table as a struct type."""
    parts, depth, start = [], 0, 0
    for k, c in enumerate(fields + ","):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            parts.append(":".join(fields[start:k].strip().split(" ", 1)))
            start = k + 1
    return "struct<" + ",".join(parts) + ">"


CATALOG = (
    "version int, " + ", ".join(f"{n} array<{_nested(t)}>" for n, t in (("artists", ARTIST), ("photos", PHOTO), ("tracks", TRACK), ("entries", ENTRY)))
)
RECOGNITION_INDEX = ("version int, entries array<struct<concertId:int,phash:array<string>,cropPhashes:map<string,array<string>>>>")
PHOTO_CSV_COLUMNS = "id band songTitle venue date audioFile imageFile shutterSpeed camera aperture focalLength iso".split()
PHOTO_CSV = (", ".join(f"{c} string" for c in PHOTO_CSV_COLUMNS))
AUDIO_TRACK = (
    "id string, photoId int, band string, songTitle string, title string, album string, date string, releaseDate string, genre string, "
    "recordLabel string, distributor string, tags array<string>, categories array<string>, credits map<string,array<string>>, "
    "durationMs bigint, bitrateKbps int, sourceBitrateKbps int, sourceBitrateSource string, sampleRate int, lufsIntegrated double, "
    "truePeakDb double, lra double, fileName string, filePath string, coverFile string, checksum string"
)
AUDIO_INDEX = (
    "schemaVersion int, generatedAt string, config struct<targetLUFS:double,truePeakLimit:double,opusBitrate:int,opusBitrateFloor:int>, "
    f"tracks array<{_nested(AUDIO_TRACK)}>"
)
MANIFEST = ("version int, samples array<struct<sampleId:string,filename:string,captures:array<struct<captureId:string,concertId:int,photoId:string>>>>")
#: One frame of a session, as the recognition state machine reads it.
FRAME = (
    "session_id string, frame_id bigint, ts timestamp, hash string, best_id int, best_distance int, second_id int, second_distance int, "
    "sharpness double, glare_percent double, brightness double, pre_hash_sharpness double"
)
IMAGE = ("image_id string, height int, width int, data binary")
