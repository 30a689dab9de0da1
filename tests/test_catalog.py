import json
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from halyard import schemas
from halyard.operators import assign, catalog, verify
from halyard.plans import etl
from halyard.sources import readers, writers

DOC = {
    "version": 2,
    "artists": [{"id": "a1", "name": "Old"}, {"id": "a2", "name": "Two"}, {"id": "a1", "name": "One"}],
    "photos": [{"id": "p1", "artistId": "a1", "imageFile": "i.jpg", "recognitionEnabled": False, "photoHashes": {"phash": ["0" * 16]}}],
    "tracks": [{"id": "t1", "artistId": "a1", "audioFile": "x.opus", "songTitle": "S"}, {"id": "t2", "artistId": "a2", "audioFile": "y.opus"}],
    "entries": [
        {"id": 1, "artistId": "a1", "trackId": "t1", "venue": "V", "date": "D", "photoId": "p1"},
        {"id": 2, "artistId": "a2", "trackId": "t2", "venue": "W", "date": "E", "recognitionEnabled": True},
    ],
}


@pytest.fixture()
def tables(spark, tmp_path):
    path = tmp_path / "catalog.json"
    path.write_text(json.dumps(DOC))
    return catalog.catalog_tables(readers.catalog(spark, str(path)))


def test_denormalise_takes_the_last_row_of_an_id(tables):
    rows = {r["id"]: r for r in catalog.denormalize(tables).collect()}
    assert rows[1]["band"] == "One" and rows[1]["imageFile"] == "i.jpg" and rows[1]["recognitionEnabled"] is False
    assert rows[2]["imageFile"] is None and rows[2]["recognitionEnabled"] is True and len(rows) == 2


def test_missing_artist_is_an_error_or_drops(spark, tables):
    extra = spark.createDataFrame([(9, 3, "none", "t1", "", "", None, None)], tables["entries"].select("ord", "id", "artistId", "trackId", "venue", "date", "photoId", "recognitionEnabled").schema)
    broken = tables | {"entries": tables["entries"].unionByName(extra)}
    assert catalog.denormalize(broken, strict=False).count() == 2
    with pytest.raises(Exception, match="missing artist"):
        catalog.denormalize(broken).collect()


def test_other_versions_are_errors(spark, tmp_path):
    path = tmp_path / "c.json"
    path.write_text(json.dumps(DOC | {"version": 1}))
    with pytest.raises(Exception, match="invalid catalog"):
        catalog.catalog_tables(readers.catalog(spark, str(path)))["artists"].collect()


def test_enabled_flags(spark):
    df = spark.createDataFrame([(True,), (False,), (None,)], "f boolean")
    assert [r[0] for r in df.select(catalog.enabled(F.col("f"))).collect()] == [True, False, True]


def test_index_round_trip(spark, tables, tmp_path):
    concerts = catalog.denormalize(tables).withColumn("recognitionEnabled", F.lit(True))
    index = catalog.build_recognition_index(concerts)
    assert [r["concertId"] for r in index.collect()] == [1]
    path = str(tmp_path / "index")
    writers.write_document(writers.index_document(index), path)
    again = readers.recognition_index(spark, path)
    assert [(r["concertId"], r["hash"]) for r in catalog.index_of_catalog(again, concerts).collect()] == [(1, "0" * 16)]
    assert [r["id"] for r in catalog.eligible(concerts, again).collect()] == [1]


def test_document_is_written_in_order(tables, tmp_path, spark):
    path = str(tmp_path / "doc")
    writers.write_document(writers.catalog_document({k: catalog.last_of_each(v, "id") for k, v in tables.items()}), path)
    doc = json.loads(spark.read.text(path, wholetext=True).first()[0])
    assert [a["id"] for a in doc["artists"]] == ["a1", "a2"] and doc["version"] == 2 and "songTitle" not in doc["tracks"][1] and [e["id"] for e in doc["entries"]] == [1, 2]


def test_cdn_and_hash_updates(spark, tables):
    out = catalog.apply_cdn(tables, "https://cdn", "audio", "photo")
    assert {r["audioFile"] for r in out["tracks"].collect()} == {"https://cdn/audio/x.opus", "https://cdn/audio/y.opus"}
    new = spark.createDataFrame([(1, (["f" * 16], None))], "concertId int, photoHashes struct<phash:array<string>,cropPhashes:map<string,array<string>>>")
    assert catalog.update_hashes(tables, new)["photos"].first()["photoHashes"]["phash"] == ["f" * 16]


def _csv(path, rows):
    head = ",".join(schemas.PHOTO_CSV_COLUMNS)
    path.write_text("\n".join([head, *rows]) + "\n")
    return str(path)


def test_catalog_build(spark, tmp_path):
    rows = [
        '1,"Blue Mice",,"Hall, East",2020,,a.jpg,"=""1/60""",Cam,f/2,24mm,ISO 100', "2,Blue Mice,,Hall,2020,,b.jpg,,,,,200x", "3,Blu Mice,Own,Hall,2021,,c.jpg,,,,,", "4,Nobody Known,,Hall,2021,,d.jpg,,,,,", "x,Skipped,,,,,,,,,,",
    ]
    photos = readers.photo_rows(spark, _csv(tmp_path / "p.csv", rows))
    tracks = [{"id": f"t{i}", "band": "Blue Mice", "songTitle": f"S{i}", "fileName": f"f{i}.opus"} for i in (1, 2, 10)] + [{"id": "q", "band": "Prince", "songTitle": "I wanna be your lover!", "fileName": "p.opus"}, {"id": "z", "band": "", "fileName": "n"}]
    (tmp_path / "a.json").write_text(json.dumps({"schemaVersion": 1, "tracks": tracks}))
    audio = readers.audio_tracks(readers.audio_index(spark, str(tmp_path / "a.json")))
    assert audio.count() == 4
    out = etl.build_catalog(photos, audio, etl.BuildOptions(least_score=0.65))
    status = {r["id"]: (r["status"], r["track"]["id"] if r["track"] else None) for r in out["matched"].collect()}
    # by Unicode order t1, t10, t2; one exact name is close enough to match by likeness
    assert status == {1: ("matched_exact", "t1"), 2: ("matched_exact", "t10"), 3: ("matched_fuzzy", "t1"), 4: ("unmatched_no_audio_match", None)}
    c = {r["id"]: r for r in out["concerts"].collect()}
    assert c[1]["audioFile"] == "https://cdn.example.net/prod/audio/f1.opus" and c[1]["shutterSpeed"] == "1/60" and c[1]["venue"] == "Hall, East" and c[2]["iso"] == "200"
    assert c[3]["songTitle"] == "Own" and c[4]["audioFile"].endswith("/p.opus")
    assert c[5]["songTitle"] == "S2" and c[5]["imageFile"] == "a.jpg" and c[5]["recognitionEnabled"] is False and len(c) == 5
    assert {r["id"] for r in out["artists"].collect()} == {"artist-blue-mice", "artist-blu-mice", "artist-nobody-known"}
    assert out["entries"].count() == 5 and out["photos"].count() == 4 and {r["id"] for r in out["tracks"].collect()} == {f"track-{i}" for i in range(1, 6)}


def test_similar_names_in_blocks(spark):
    names = spark.createDataFrame([("abc def",), ("xyz",), ("abc def",)], "name string")
    cands = spark.createDataFrame([("b", "abc deg"), ("a", "abc deg"), ("c", "xyzz")], "id string, candidate string")
    key = lambda df: sorted((r["name"], r["id"]) for r in df.collect())
    assert key(assign.most_similar(names, cands)) == key(assign.most_similar(names, cands, block_names=1)) == [("abc def", "a"), ("xyz", "c")]


def test_verification(spark):
    concerts = spark.createDataFrame(
        [(1, "A", "https://h/prod/audio/x.opus", "i.jpg", None), (2, "B", "/local/x", "i.jpg", None), (3, "C", "https://h/other/concert-3.opus", "k.jpg", False), (4, "D", "https://h/prod/audio/x.opus", "q.jpg", True)],
        "id int, band string, audioFile string, imageFile string, recognitionEnabled boolean")
    rows = spark.createDataFrame([("1", "Other", "j.jpg"), ("2", "B", "i.jpg"), ("7", "c", "k.jpg")], "id string, band string, imageFile string")
    audio = spark.createDataFrame([(1, 1, "t1", "y.opus"), (2, 1, "t2", "z.opus")], "ord int, photoId int, id string, fileName string")
    found = verify.all_findings(concerts, rows, audio, "prod/audio")
    assert sorted((r["id"] or 0, r["issue"], r["found"]) for r in found.collect()) == sorted([
        (1, "band", "A"), (1, "image", "i.jpg"), (1, "file-name", "x.opus"), (2, "not-remote", "/local/x"), (3, "non-prefixed-path", "/other/concert-3.opus"), (3, "placeholder", "https://h/other/concert-3.opus"),
        (4, "missing-row", "q.jpg"), (0, "duplicate-photo-id", "1"), (0, "missing-in-csv", "4"), (0, "missing-in-data", "7"),
    ])
    s = verify.summary(found).first()
    assert s["mapping"] == 3 and s["has_failures"] is True
    assert verify.summary(found.limit(0)).first()["has_failures"] is False


def test_csv_writer(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a"b', ""), (2, None, "x,y")], "id int, a string, b string")
    writers.write_csv(df, ["id", "a", "b"], str(tmp_path / "o"), [F.col("id")])
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "o")).collect()) == ['"1","a""b",', '"2",,"x,y"', "id,a,b"]


def test_small_operators(spark):
    t = spark.createDataFrame([("x", "f.opus"), ("y", "g.opus"), ("z", "")], "id string, fileName string")
    c = spark.createDataFrame([("https://h/f.opus",), (None,)], "audioFile string")
    assert [r["id"] for r in verify.unmapped(t, c).collect()] == ["y"]
    rows = spark.createDataFrame([("1", "f", "old", None), ("2", "g", "old", "k")], "id string, file string, a string, b string")
    over = spark.createDataFrame([("1", "by-id", None), ("f", "by-file", "q"), ("g", "by-file", None)], "key string, a string, b string")
    assert sorted(tuple(r) for r in catalog.override(rows, over, "id", "file").collect()) == [("1", "f", "by-id", None), ("2", "g", "by-file", "k")]
    assert verify.page(t, [F.col("id")], 1, 1).first()["id"] == "y"
    p = spark.createDataFrame([], "accessible boolean")
    assert tuple(verify.probe_stats(p).first()) == (0, 0, 0, 0.0)


def test_hashes_covers_and_order(spark, tables):
    ids = [r["id"] for r in tables["entries"].select("id").collect()]
    index = spark.createDataFrame([(2, [(ids[0], ["0" * 16, "bad"], None)])], "version int, entries array<struct<concertId:int,phash:array<string>,cropPhashes:map<string,array<string>>>>")
    rows = {r["id"]: r for r in catalog.with_hashes(tables, index).collect()}
    assert set(rows) <= set(ids) and rows[ids[0]]["hashes"] == ["0" * 16] and all(r["hashes"] == [] for k, r in rows.items() if k != ids[0])
    tracks = spark.createDataFrame([(3, None), (9, ""), (4, "c.png")], "id int, coverFile string")
    assert tuple(catalog.cover_stats(tracks).first()) == (2, 9) and tuple(catalog.cover_stats(tracks.limit(0)).first()) == (0, 0)
    orders = [[r["id"] for r in catalog.shuffled(spark.range(50), "id", seed).collect()] for seed in (1, 1, 2)]
    assert orders[0] == orders[1] != orders[2] and sorted(orders[2]) == list(range(50)) != orders[0]


def _png(pixels: list[list[tuple[int, int, int, int]]]) -> bytes:
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    raw = b"".join(b"\0" + bytes(v for p in row for v in p) for row in pixels)
    head = struct.pack(">IIBBBBB", len(pixels[0]), len(pixels), 8, 6, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_images_are_decoded(spark, tmp_path):
    rows = [[(1, 2, 3, 255), (40, 50, 60, 128)], [(7, 8, 9, 255), (255, 0, 128, 255)]]
    (tmp_path / "a.png").write_bytes(_png(rows))
    (tmp_path / "b.png").write_bytes(b"no image")
    (found,) = readers.decoded_images(spark, str(tmp_path)).collect()
    assert (found["height"], found["width"]) == (2, 2) and found["image_id"].endswith("a.png")
    assert bytes(found["data"]) == bytes(v for row in rows for p in row for v in p)


def _jpeg(order: str, tags: list[tuple[int, int, object]]) -> bytes:
    """A file of a head with make and model in the first directory and the rest in the second."""
    def directory(start, entries):
        extra, out = b"", struct.pack(order + "H", len(entries))
        base = start + 2 + 12 * len(entries) + 4
        for tag, kind, value in entries:
            data = value.encode() + b"\0" if kind == 2 else struct.pack(order + "II", *value) if kind == 5 else struct.pack(order + ("H" if kind == 3 else "I"), value)
            count = len(data) if kind == 2 else 1
            where = data.ljust(4, b"\0") if len(data) <= 4 else struct.pack(order + "I", base + len(extra))
            extra += data if len(data) > 4 else b""
            out += struct.pack(order + "HHI", tag, kind, count) + where
        return out + struct.pack(order + "I", 0) + extra

    first = [t for t in tags if t[0] < 0x8000]
    size = len(directory(8, [*first, (0x8769, 4, 0)]))
    body = directory(8, [*first, (0x8769, 4, 8 + size)]) + directory(8 + size, [t for t in tags if t[0] >= 0x8000])
    block = b"Exif\0\0" + {"<": b"II", ">": b"MM"}[order] + struct.pack(order + "HI", 42, 8) + body
    return b"\xff\xd8\xff\xe0\0\x04ab\xff\xe1" + struct.pack(">H", len(block) + 2) + block + b"\xff\xda\0\x02\xff\xd9"


@pytest.mark.parametrize("order", ["<", ">"])
def test_photo_metadata(spark, tmp_path, order):
    tags = [(0x010F, 2, "NIKON"), (0x0110, 2, "Z 6"), (0x829A, 5, (1, 200)), (0x829D, 5, (28, 10)), (0x8827, 3, 3200),
            (0x9003, 2, "2024:05:01 20:10:05"), (0x920A, 5, (70, 1)), (0xA405, 3, 105)]
    data = _jpeg(order, tags)
    for name, content in {"a.jpg": data, "B.JPG": b"\xff\xd8\xff\xd9", "c.jpg": data[:60], "d.jpg": b"x", "e.png": data}.items():
        (tmp_path / name).write_bytes(content)
    rows = {r["file_name"]: r for r in readers.photo_metadata(spark, str(tmp_path)).collect()}
    assert sorted(rows) == ["B.JPG", "a.jpg", "c.jpg", "d.jpg"]
    assert rows["a.jpg"].asDict() == {
        "file_name": "a.jpg", "date": "2024-05-01T15:10:05-05:00", "shutterSpeed": '="1/200"', "camera": "NIKON Z 6", "aperture": "f/2.8",
        "focalLength": "70.0mm 105mm eq", "iso": "3200",
    }
    assert all(v == "" for n in ("B.JPG", "d.jpg", "c.jpg") for k, v in rows[n].asDict().items() if k != "file_name")


def test_pruned_search_of_names_finds_what_the_full_one_does(spark, monkeypatch):
    import random

    from halyard.functions.text import similarity_score

    rng, words = random.Random(4), "the a red blue band of night king queen x ab abc zed moon sun river".split()
    name = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(0, 4)))
    names = spark.createDataFrame([(name(),) for _ in range(120)] + [("redblue",), ("",), (None,)], "name string")
    candidates = spark.createDataFrame([(i, name()) for i in range(150)] + [(500, ""), (501, None)], "id int, candidate string")
    pairs = names.distinct().crossJoin(candidates).select("name", "id", "candidate", similarity_score(F.col("name"), F.col("candidate")).alias("score"))
    best = pairs.groupBy("name").agg(F.min(F.struct((-F.col("score")).alias("s"), "id", "candidate")).alias("b")).select("name", "b.id", "b.candidate", (-F.col("b.s")).alias("score"))
    wanted = sorted(map(repr, best.collect()))
    for guesses, block in ((100, 50_000), (0, 50_000), (3, 40)):
        monkeypatch.setattr(assign, "GUESS_CANDIDATES", guesses)
        assert sorted(map(repr, assign.most_similar(names, candidates, block).collect())) == wanted
    left = assign._described(names.distinct(), "name", "n")
    right = assign._described(candidates, "candidate", "c")
    scored = left.join(assign.first_guess(left, right), "name", "left").crossJoin(right).filter(assign.worth_scoring(0.45)).count()
    assert scored < 0.55 * left.count() * right.count()  # of 16 words most names share some


def test_summary_of_parts_is_that_of_their_union(spark):
    from halyard.operators import verify

    rows = "id int, kind string, issue string, found string, wanted string"
    part = lambda *kinds: spark.createDataFrame([(None, k, k, None, None) for k in kinds], rows)
    for parts in ([part("url", "url", "placeholder"), part("missing-in-csv")], [part("audio-index"), part()], [part()]):
        union = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        assert verify.summary_of(parts).collect() == verify.summary(union).collect()
        assert verify.summary_of(parts).columns == verify.summary(union).columns
