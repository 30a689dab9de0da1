import pytest
from pyspark.sql import functions as F

from halyard.functions import dates as D
from halyard.functions import geometry as G
from halyard.functions import text as X


def one(spark, c):
    return spark.range(1).select(c.alias("c")).first()["c"]


@pytest.mark.parametrize(("name", "wanted"), [
    ("Sigur Rós", "sigur ros"), ("The Beatles", "beatles"), ("Simon & Garfunkel", "simon and garfunkel"), (None, ""), ("  ", ""), ("a^b", "ab"), ("Ødd ß", "dd"), ("Über-Band!", "uber band"), ("Theory of the Deadman", "theory of deadman"),
])
def test_band_names(spark, name, wanted):
    assert one(spark, X.normalize_band(F.lit(name).cast("string"))) == wanted


def test_other_names(spark):
    assert one(spark, X.normalize_plain(F.lit("The A & B"))) == "the a b"
    assert one(spark, X.resolve_alias(F.lit("arya"))) == "araya" and one(spark, X.resolve_alias(F.lit("other"))) == "other"
    for raw, clean in (("Band - Topic", "Band"), ("Band Official", "Band"), ("A feat. B", "A"), ("A, B", "A"), ("A & B x C", "A and B"), ("  ", None), ("A (Official Video)", "A"), ("A | B", "A")):
        assert one(spark, X.clean_band(F.lit(raw))) == clean
    assert one(spark, X.band_name([F.lit(" "), F.lit(None).cast("string")])) == "Unknown Artist"


def test_similarity_score(spark):
    s = lambda a, b: one(spark, X.similarity_score(F.lit(a), F.lit(b)))
    assert s("abc", "abc") == 1 and s("", "abc") == 0 and s("abc", "abc def") >= 0.75 and s("a b", "b a") == pytest.approx(0.5 + 0.2 / 3)


def test_urls(spark):
    j = lambda *p: one(spark, X.join_url(*map(F.lit, p)))
    assert j("https://x.y//", "/a/b/", "c.opus") == "https://x.y/a/b/c.opus" and j("", "", "c") == "c" and j("https://x", "", "c") == "https://x/c"
    assert one(spark, X.replace_file_name(F.lit("a/b.c"), F.lit("n"))) == "a/n" and one(spark, X.replace_file_name(F.lit("b.c"), F.lit("n"))) == "n"
    shape = lambda u: tuple(one(spark, X.url_shape(F.lit(u), "prod/audio")))
    assert shape("https://h/prod/audio/x.opus") == ("flat", "prod/audio/x.opus", None)
    assert shape("https://h/prod/audio/12/x.opus") == ("id-scoped", "prod/audio/12/x.opus", 12)
    assert shape("/prod/audio/a/x.opus")[0] == "nested-non-numeric" and shape("https://h/other/x")[0] == "non-worker-or-non-prefix" and shape("") == ("unknown", None, None)
    assert len(one(spark, X.placeholder_hits(F.lit("http://localhost:5173/assets/test-audio/concert-3.opus")))) == 3
    assert one(spark, X.migrated_url(F.lit("/a/b.opus"), F.lit("https://x/"), "r2")) == "https://x/b.opus" and one(spark, X.migrated_url(F.lit("http://q/b"), F.lit("https://x/"), "r2")) == "http://q/b"
    with pytest.raises(ValueError):
        X.migrated_url(F.lit("a"), F.lit("b"), "ftp")
    assert one(spark, X.joined_slug(F.lit("A Band!"), F.lit(None).cast("string"), F.lit("An -- Album"))) == "a-band-an-album" and one(spark, X.joined_slug(F.lit("!"))) == "unknown-track"


def test_numbers(spark):
    assert one(spark, X.parse_int(F.lit("12abc"))) == 12 and one(spark, X.parse_int(F.lit("x1"))) is None
    assert one(spark, X.unwrap_excel(F.lit('="1/60"'))) == "1/60" and one(spark, X.unwrap_excel(F.lit(" 1/2 "))) == "1/2"
    for raw, value in (("1/30", 1 / 30), ("0.5s", 0.5), ("1/0", None), ("bulb", None), ("0", None)):
        assert one(spark, X.parse_shutter(F.lit(raw))) == (pytest.approx(value) if value else None)
    assert one(spark, X.parse_aperture(F.lit("F/2.8"))) == 2.8 and one(spark, X.parse_iso(F.lit("ISO 800"))) == 800
    assert one(spark, X.format_shutter(F.lit(1 / 250))) == '="1/250"' and one(spark, X.format_shutter(F.lit(2.0))) == "2.00s" and one(spark, X.format_shutter(F.lit(0.0))) == ""
    assert one(spark, X.format_focal_length(F.lit(24.0), F.lit(35.6))) == "24.0mm 36mm eq"
    assert [one(spark, X.target_bitrate(F.lit(x).cast("double"))) for x in (None, 320.0, 128.4, 64.0)] == [160, 160, 128, 64]


def test_dates(spark):
    n = lambda s: one(spark, D.normalize_date(F.lit(s)))
    assert [n(s) for s in ("2024-3-5", "20240305", "March 5th, 2024", "Sept. 5 2024", "2024-13-01", "2024-02-31", "x", "")] == ["2024-03-05", "2024-03-05", "2024-03-05", "2024-09-05", None, "2024-02-31", None, None]
    assert one(spark, D.find_date(F.lit("live on\nMay 1, 2020 at x"))) == "2020-05-01" and one(spark, D.find_date(F.lit("in 2020/99/1 then May 1, 2020"))) is None
    assert one(spark, D.display_timestamp(F.lit("2022-03-17T13:34:28-05:00"))) == "March 17, 2022 at 1:34 PM CDT"
    assert one(spark, D.display_timestamp(F.lit("2022-01-17"))) == "January 16, 2022" and one(spark, D.display_timestamp(F.lit("?"))) == "Date unavailable"
    assert one(spark, D.day_of_week(F.lit("2025-03-15T23:20:15-05:00"))) == 6


def test_descriptions(spark):
    assert one(spark, X.ordered_distinct(F.array(*map(F.lit, (" Rock", "rock", "", "A1", "a1 ", "Z"))))) == ["Rock", "A1", "Z"]
    assert one(spark, X.genre(F.array(F.lit("x")), F.array(F.lit("Music"), F.lit("new wave")), F.lit(""))) == "New Wave"
    assert one(spark, X.genre(F.array(F.lit("some shoegaze rock")), F.array(F.lit("Music")), F.lit(None).cast("string"))) == "Shoegaze"
    c = one(spark, X.description_credits(F.lit("Provided to YouTube by X\nGenre: Pop\n℗ L\nMix:  A3\nMix: A3\nDrums :B\nGenre: Folk")))
    assert (c["distributor"], c["label"], c["genre"]) == ("X", "L", "Pop") and c["credits"] == {"Mix": ["A3"], "Drums": ["B"], "Genre": ["Folk"]}


def test_palette(spark):
    def fnv(s):
        h = 2166136261
        for c in s.lower().strip():
            h = ((h ^ ord(c)) * 16777619) % 2**32
        return h

    for s in ("", "Abba ", "Hinds"):
        assert one(spark, X.fnv1a(F.lit(s))) == fnv(s)
    h = fnv("hinds")
    hue = (103 + h % 51) % 360
    assert one(spark, X.palette(F.lit("Hinds"), F.lit(2)))["main"] == f"hsl({hue}, 100%, {62 + (h >> 8) % 11}%)"


def test_geometry(spark):
    v = one(spark, G.visible_viewport(F.lit(1920.0), F.lit(1080.0), F.lit(1.0)))
    assert tuple(v) == (420, 0, 1080, 1080)
    f = one(spark, G.framed_region(F.lit(1920.0), F.lit(1080.0), "3:2"))
    assert (f["x"], f["y"], f["width"], f["height"]) == (312, 108, 1296, 864)
    square = [(F.lit(float(x)), F.lit(float(y))) for x, y in ((0, 0), (10, 0), (10, 10), (0, 10))]
    assert one(spark, G.perspective_ok(square, F.lit(10.0), F.lit(10.0))) and not one(spark, G.perspective_ok(square, F.lit(9.0), F.lit(10.0)))
    assert one(spark, G.quadrilateral_ok(square, 50.0)) and not one(spark, G.quadrilateral_ok(square[::-1], 50.0))
    t = one(spark, G.adaptive_thresholds(F.lit(None).cast("double"), F.lit(None).cast("double")))
    assert tuple(t) == (50, 220, 20)
    t = one(spark, G.adaptive_thresholds(F.lit(60.0), F.lit(10.0)))
    assert tuple(t) == pytest.approx((23.75, 193.75, 34.5))
    assert one(spark, G.smoothed(F.array(F.lit(100.0), F.lit(0.0)))) == [100.0, 85.0]


def test_media_types_and_headers(spark):
    kinds = {
        "a.opus": "audio/ogg; codecs=opus", "b/A.M4A": "audio/mp4", "c.webp": "image/webp", "c.jpeg": "image/jpeg", "c.avif": "image/avif",
        "d.json": "application/json; charset=utf-8", "README.md": "text/markdown; charset=utf-8", "x.markdown": "text/markdown; charset=utf-8",
        "x.mp3": "application/octet-stream", ".opus": "application/octet-stream", "a.opus/b": "application/octet-stream",
    }
    for path, kind in kinds.items():
        assert one(spark, X.content_type(F.lit(path))) == kind
    assert "immutable" in one(spark, X.cache_control(F.lit("a.png"))) and "300" in one(spark, X.cache_control(F.lit("a.json")))
    assert [one(spark, X.quoted_etag(F.lit(t))) for t in ("ab ", '"q"', 'W/"x"', "")] == ['"ab"', '"q"', 'W/"x"', None]
    r = lambda h: one(spark, X.byte_range(F.lit(h), F.lit(100).cast("bigint")))
    assert tuple(r("bytes=0-9")) == (True, 0, 10) and tuple(r("Bytes=5-")) == (True, 5, 95) and not r("bytes=90-100")["valid"] and not r("bytes=9-1")["valid"] and r("lines=1-2") is None
    assert not any(r(h)["valid"] for h in ("bytes=99999999999999999999-", "bytes=0-99999999999999999999", "bytes=99999999999999999999-99999999999999999999"))
    key = lambda p: one(spark, X.object_key(F.lit(p), ["audio", "photos"]))
    assert key("/audio/./a/../b.opus") == "audio/b.opus" and key("/audio/../../x") is None and key("/audio/%2e%2e/photos/a%20b+c") == "photos/a b+c"
    assert key("/other/x") is None and key("/audiox/y") is None and key("/audio") == "audio"
    o = lambda u: one(spark, X.allowed_origin(F.lit(u), ["https://a.example", "https://*.b.example", "https://pre-*.c.example", "https://*"]))
    assert o("https://A.example:443") == "https://a.example" and o("https://x.b.example/p") == "https://x.b.example" and o("https://pre-1.c.example") == "https://pre-1.c.example"
    assert [o(u) for u in ("https://b.example", "http://x.b.example", "https://q.c.example", "none", "https://zb.example.evil")] == [None] * 5
    assert one(spark, X.with_retry_hint(F.lit("No. Tap play to retry."), F.lit("x"))) == "No. Tap play to retry." and one(spark, X.with_retry_hint(F.lit("No."), F.lit("x"))) == "No. x"
    assert one(spark, X.audio_sources(F.lit("a.opus"))) == ["a.opus", "a.m4a"] and one(spark, X.audio_sources(F.lit("a.mp3"))) == ["a.mp3"]


def test_key_lines_and_loudness(spark):
    assert one(spark, X.key_values(F.lit("A=1\r\n a = 2 \nb==3\n\n=x\nq"))) == {"a": "2", "b": ""}
    s = one(spark, X.format_stats(F.lit("bit_rate=128\nbit_rate=N/A\nSIZE=0\nduration= 1.5 ")))
    assert tuple(s) == (128.0, None, 1.5)
    got = one(spark, X.loudness(F.lit('log {"input_i":"-14.2","output_tp":-1,"target_offset":"x","normalization_type":"d"} end')))
    assert got["input_i"] == -14.2 and got["output_tp"] == -1 and got["target_offset"] is None and one(spark, X.loudness(F.lit("no report"))) is None
    assert one(spark, X.loudness(F.lit(None).cast("string"))) is None and one(spark, X.format_stats(F.lit(None).cast("string")))["size"] is None


def test_white_space_and_hashes_of_utf16(spark):
    def plain(name):
        h, units = 2166136261, name.lower().strip().encode("utf-16-be")
        for i in range(0, len(units), 2):
            h = ((h ^ int.from_bytes(units[i : i + 2], "big")) * 16777619) % 2**32
        return h

    for name in ("abc", "\tAbc\u00a0", "\U0001f3b8 Band", "é", ""):
        assert one(spark, X.fnv1a(F.lit(name))) == plain(name)
    assert one(spark, X.blank_to_null(F.lit("\t\u00a0\n\ufeff"))) is None and one(spark, X.blank_to_null(F.lit(" a "))) == "a"


def test_a_range_is_read_once(spark):
    from pyspark.sql import functions as F

    from halyard.functions import text as X

    df = spark.createDataFrame([(" bytes=5-20", 30), ("bytes=-", 4), ("bytes=9-3", 30), ("bytes=99999999999999999999-", 9), ("items=1-2", 9), (None, 9)], "h string, n bigint")
    out = df.select("h", X.byte_range(F.col("h"), F.col("n")).alias("r"))
    got = [None if r["r"] is None else tuple(r["r"]) for r in out.collect()]
    assert got == [(True, 5, 16), (True, 0, 4), (False, None, None), (False, None, None), None, None]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract(") <= 2


def test_ends_are_stripped_without_a_pattern(spark):
    signs = [chr(c) for c in (9, 10, 11, 12, 13, 28, 32, 0x85, 0xA0, 0x1680, 0x2000, 0x2007, 0x200A, 0x200B, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF)]
    texts = [f"{a}{b}x{a}y{b}{a}" for a in signs for b in signs] + ["", " \u3000", None, "\U0001f3b8 "]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    blanks = "".join(c for c in signs if ord(c) not in (28, 0x85, 0x200B))  # a pattern's $ also stands before a last U+0085
    got = df.select("t", X.strip(F.col("t")).alias("s"))
    assert all(r["s"] == (r["t"] and r["t"].strip(blanks)) for r in got.collect())
    assert "regexp" not in got._jdf.queryExecution().optimizedPlan().toString()
