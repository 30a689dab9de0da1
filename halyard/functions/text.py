"""String functions: names, similarity, URLs, slugs, numbers and descriptions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .hashes import js_round

#: Normalised names that stand for others.
BAND_ALIASES = {
    "witworth": "whitworth",
    "sea n barna": "sen barna",
    "sean barna": "sen barna",
    "mamalarkey": "mamalarky",
    "thao and get down stay down": "thao",
    "arya": "araya",
}
#: Spacing marks that count as diacritics besides combining marks.
SPACING_DIACRITICS = "^`·¨¯´¸"
#: Genre labels by pattern, the first that matches counts.
GENRES = (
    (r"\bindie\b", "Indie"), (r"\bpsychedelic\b", "Psychedelic"), (r"\bshoegaze\b", "Shoegaze"), (r"\bgarage\b", "Garage"),
    (r"\bfunk\b", "Funk"), (r"\bsoul\b", "Soul"), (r"\br&b\b", "R&B"), (r"\bhip\s*hop\b", "Hip Hop"), (r"\brap\b", "Rap"),
    (r"\bjazz\b", "Jazz"), (r"\bblues\b", "Blues"), (r"\bfolk\b", "Folk"), (r"\bcountry\b", "Country"),
    (r"\bamericana\b", "Americana"), (r"\balt\.?\s*rock\b", "Alternative Rock"), (r"\brock\b", "Rock"), (r"\bmetal\b", "Metal"),
    (r"\bpost[-\s]?punk\b", "Post-punk"), (r"\bpost[-\s]?rock\b", "Post-rock"), (r"\belectronic\b", "Electronic"),
    (r"\bhouse\b", "House"), (r"\btechno\b", "Techno"), (r"\bambient\b", "Ambient"), (r"\bnoise\b", "Noise"),
    (r"\bexperimental\b", "Experimental"), (r"\blatin\b", "Latin"), (r"\bcumbia\b", "Cumbia"), (r"\breggae\b", "Reggae"),
)
#: What is cut from the end of a performer's name, in this order.
BAND_CUTS = (
    r"[\u200b-\u200d\ufeff]", r"(?i) - Topic$", r"(?i)\s+Official$", r"(?i)\s*\(Official.*?\)$", r"(?i)\s+\(feat\..*$",
    r"(?i)\s+feat\..*$", r"(?i)\s+ft\..*$", r"(?i)\s+with\s+.+$", r"(?i)\s+x\s+.+$", r"·.+$", r"\|.+$",
)
#: Paths and hosts of test data.
PLACEHOLDERS = (
    r"(?i)/assets/test-data/", r"(?i)/assets/test-audio/", r"(?i)/assets/example-real-songs/", r"(?i)localhost[:/]",
    r"(?i)concert(?:-song)?-\d+\.opus$",
)
#: Media types by file extension.
CONTENT_TYPES = {
    "opus": "audio/ogg; codecs=opus", "m4a": "audio/mp4", "webp": "image/webp", "jpg": "image/jpeg", "jpeg": "image/jpeg",
    "png": "image/png", "avif": "image/avif", "json": "application/json; charset=utf-8", "md": "text/markdown; charset=utf-8",
    "markdown": "text/markdown; charset=utf-8",
}
#: How long media and other files may be kept.
CACHE_MEDIA, CACHE_OTHER = "public, max-age=31536000, immutable", "public, max-age=300"
#: The numbers of a loudness report.
LOUDNESS = (
    "input_i", "input_tp", "input_lra", "input_thresh", "output_i", "output_tp", "output_lra", "output_thresh", "target_offset",
)
#: White space of all kinds, with the byte order mark, as a class of a pattern.
BLANKS = r"[\s\u000b\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"
#: The same signs one by one.
BLANK_SIGNS = "\t\n\u000b\f\r \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"


def let(value: Column, use) -> Column:
    """use(value) with the value computed once, also where it stands inside a lambda that runs many times."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip(x: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.trim(x, F.lit(BLANK_SIGNS))


def blank_to_null(x: Column) -> Column:
    return F.nullif(strip(x), F.lit(""))


# --- names ---------------------------------------------------------------------------------------


def fold_diacritics(s: str) -> str:
    """Compatibility decomposition without marks; letters that don't decompose stay."""
    return "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c) and c not in SPACING_DIACRITICS)


def _fold_series(values: pd.Series) -> pd.Series:
    return values.map(lambda s: None if s is None else s if s.isascii() and not set(s) & {"^", "`"} else fold_diacritics(s))


def _folded(x: Column) -> Column:
    return F.pandas_udf(_fold_series, "string")(x)


def _letters_and_digits(folded: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(folded), "[^a-z0-9]+", " "))


def normalize_band(name: Column, folded: Column | None = None) -> Column:
    """Lower-case letters and digits, ``and`` for &, without the word ``the``; null gives an empty string."""
    x = F.lower(_folded(F.coalesce(name, F.lit(""))) if folded is None else folded)
    x = F.regexp_replace(F.regexp_replace(x, "&", " and "), "[^a-z0-9]+", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(x, r"\bthe\b", " "), r"\s+", " "))


def normalize_plain(name: Column) -> Column:
    """As normalize_band, but & separates words and ``the`` stays: the form of titles and of verification."""
    return _letters_and_digits(_folded(F.coalesce(name, F.lit(""))))


def resolve_alias(normalized: Column) -> Column:
    pairs = [F.lit(x) for kv in BAND_ALIASES.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), normalized), normalized)


def clean_band(name: Column) -> Column:
    """A performer's name without notes about the release; null if nothing is left."""
    x = name
    for cut in BAND_CUTS:
        x = F.regexp_replace(x, cut, "")
    x = strip(x)
    first = strip(F.element_at(F.split(x, ","), 1))
    x = F.when(x.contains(",") & (F.instr(x, ",") > 1), first).otherwise(x)
    x = F.regexp_replace(F.regexp_replace(x, "&", " and "), r"[^a-zA-Z0-9\s-]", "")
    return F.nullif(F.trim(F.regexp_replace(x, r"\s+", " ")), F.lit(""))


def band_name(candidates: list[Column]) -> Column:
    return F.coalesce(*(clean_band(c) for c in candidates), F.lit("Unknown Artist"))


# --- similarity ----------------------------------------------------------------------------------


def token_overlap(a: Column, b: Column) -> Column:
    """Common words over the words of the richer side."""
    words = lambda x: F.array_distinct(F.filter(F.split(x, " "), lambda w: w != ""))
    wa, wb = words(a), words(b)
    most = F.greatest(F.size(wa), F.size(wb))
    return F.when((F.size(wa) == 0) | (F.size(wb) == 0), 0.0).otherwise(F.size(F.array_intersect(wa, wb)) / most)


def edit_similarity(a: Column, b: Column) -> Column:
    most = F.greatest(F.length(a), F.length(b))
    return F.when(most == 0, 0.0).otherwise(1 - F.levenshtein(a, b) / most)


def similarity_score(a: Column, b: Column) -> Column:
    """0 to 1: words in common, edits, and edits without blanks; 0.75 at least if one contains the other."""
    compact = lambda x: F.regexp_replace(x, r"\s+", "")
    score = token_overlap(a, b) * 0.5 + edit_similarity(a, b) * 0.2 + edit_similarity(compact(a), compact(b)) * 0.3
    held = F.contains(a, b) | F.contains(b, a)
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(held, F.greatest(score, F.lit(0.75))).otherwise(score)))
    empty = (F.coalesce(a, F.lit("")) == "") | (F.coalesce(b, F.lit("")) == "")
    return F.when(empty, 0.0).when(a == b, 1.0).otherwise(score)


# --- URLs and paths ------------------------------------------------------------------------------


def strip_slashes(x: Column) -> Column:
    return strip(F.regexp_replace(F.coalesce(x, F.lit("")), r"^/+|/+$", ""))


def strip_trailing_slash(x: Column) -> Column:
    return F.regexp_replace(F.coalesce(x, F.lit("")), r"/+$", "")


def join_url(base: Column, prefix: Column, name: Column) -> Column:
    """The non-empty parts with single slashes between them, but for that after a scheme."""
    parts = F.filter(F.array(strip_trailing_slash(base), strip_slashes(prefix), F.coalesce(name, F.lit(""))), lambda p: p != "")
    return F.regexp_replace(F.array_join(parts, "/"), r"(?<!:)/+", "/")


def file_name(url: Column) -> Column:
    """What follows the last slash of the path."""
    return F.element_at(F.split(path_name(url), "/"), -1)


def path_name(url: Column) -> Column:
    """The path of an absolute url, else the text itself."""
    return F.when(url.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*://"), F.coalesce(F.nullif(F.try_parse_url(url, F.lit("PATH")), F.lit("")), F.lit("/"))).otherwise(url)


def build_url(path: Column, base: Column, prefix: Column) -> Column:
    return join_url(base, prefix, F.element_at(F.split(path, "/"), -1))


def migrated_url(path: Column, base: Column, provider: str) -> Column:
    """The file under the base unless it is remote already; only known providers."""
    if provider not in ("github-release", "r2"):
        raise ValueError(f"unknown provider {provider}")
    target = F.concat(F.regexp_replace(base, "/$", ""), F.lit("/"), F.element_at(F.split(path, "/"), -1))
    return F.when((F.coalesce(path, F.lit("")) == "") | path.startswith("http://") | path.startswith("https://"), path).otherwise(target)


def replace_file_name(url: Column, name: Column) -> Column:
    kept = F.substring(url, F.lit(1), F.length(url) - F.length(F.element_at(F.split(url, "/"), -1)))
    empty = (F.coalesce(url, F.lit("")) == "") | (F.coalesce(name, F.lit("")) == "")
    return F.when(empty, url).otherwise(F.concat(kept, name))


def is_remote(url: Column) -> Column:
    return F.coalesce(url.rlike("(?i)^https?://"), F.lit(False))


def has_prefix(path: Column, prefix: Column) -> Column:
    return F.regexp_replace(path, "^/+", "").startswith(F.concat(strip_slashes(prefix), F.lit("/")))


def placeholder_hits(url: Column) -> Column:
    """The patterns of test data that the url matches."""
    return F.array_compact(F.array(*(F.when(url.rlike(p), F.lit(p)) for p in PLACEHOLDERS)))


def url_shape(url: Column, prefix: str) -> Column:
    """struct<type, key, inferred_id>: how a url is laid out below the prefix."""
    clean = prefix.strip("/")
    key = F.regexp_replace(path_name(url), "^/+", "")
    parts = F.filter(F.split(F.substring(key, F.lit(len(clean) + 2), F.length(key)), "/"), lambda p: p != "")
    first = F.get(parts, F.lit(0))
    kind = (
        F.when(F.coalesce(url, F.lit("")) == "", "unknown")
        .when(~key.startswith(clean + "/") if clean else F.lit(True), "non-worker-or-non-prefix")
        .when(F.size(parts) <= 1, "flat").when(first.rlike(r"^\d+$"), "id-scoped").otherwise("nested-non-numeric")
    )
    return F.struct(
        kind.alias("type"), F.when(kind != "unknown", key).alias("key"),
        F.when(kind == "id-scoped", F.try_to_number(first, F.lit("999999999")).cast("bigint")).alias("inferred_id"),
    )


def likely_failure(accessible: Column, status: Column, status_text: Column) -> Column:
    """reachable, forbidden, missing, timeout or unknown."""
    return (
        F.when(accessible, "reachable").when(status == 403, "forbidden").when(status == 404, "missing")
        .when((status == 0) & F.coalesce(status_text, F.lit("")).rlike("(?i)timeout"), "timeout").otherwise("unknown")
    )


def accessible(status: Column) -> Column:
    return (status >= 200) & (status < 400)


def extension(path: Column) -> Column:
    """Lower-case ending of a file name without its dot; none for names that begin with their only dot."""
    return F.lower(F.regexp_extract(path, r"[^/]\.([^./]*)$", 1))


def content_type(path: Column) -> Column:
    pairs = [F.lit(x) for kv in CONTENT_TYPES.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), extension(path)), F.lit("application/octet-stream"))


def cache_control(path: Column) -> Column:
    """Media are kept for a year, all else for five minutes."""
    return F.when(content_type(path).rlike("^(audio|image)/"), CACHE_MEDIA).otherwise(CACHE_OTHER)


def quoted_etag(tag: Column) -> Column:
    """An entity tag in quotes; weak and quoted ones stay; an empty one is null."""
    x = strip(tag)
    return F.when(F.coalesce(tag, F.lit("")) != "", F.when(x.rlike('^("|W/)'), x).otherwise(F.concat(F.lit('"'), x, F.lit('"'))))


def byte_range(header: Column, size: Column) -> Column:
    """struct<valid, first, length> of a ``bytes=a-b`` header; null if there is none or it is of another form."""
    form = r"(?i)^bytes=(\d*)-(\d*)$"
    # a number that no bigint holds is beyond any size
    part = lambda x, n: let(F.regexp_extract(x, form, n), lambda g: F.when(g != "", F.coalesce(g.try_cast("bigint"), F.lit((1 << 63) - 1))))

    def told(ends: Column) -> Column:
        first, last = ends["first"], ends["last"]
        fine = (first <= last) & (last < size)
        return F.struct(fine.alias("valid"), F.when(fine, first).alias("first"), F.when(fine, last - first + 1).alias("length"))

    def read(x: Column) -> Column:
        ends = F.struct(F.coalesce(part(x, 1), F.lit(0).cast("bigint")).alias("first"), F.coalesce(part(x, 2), size - 1).alias("last"))
        return F.when(x.rlike(form), let(ends, told))

    return let(strip(header), read)


def object_key(path: Column, prefixes: list[str]) -> Column:
    """The key that a url path names, dots resolved; null outside the prefixes or above the root."""
    decoded = F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))
    parts = F.filter(F.split(decoded, "/"), lambda p: ~p.isin("", "."))
    up = lambda kept: F.when(F.size(kept) > 0, F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0))))
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, p: F.when(p == "..", up(acc)).otherwise(F.concat(acc, F.array(p))))
    key = F.array_join(kept, "/")
    begins = lambda x, tail: F.coalesce(*(F.when(x.startswith(p + tail), True) for p in prefixes), F.lit(False))
    inside = (key.isin(*prefixes)) | begins(key, "/")
    return F.when(F.coalesce(*(F.when(decoded.startswith("/" + p), True) for p in prefixes), F.lit(False)) & inside, key)


def allowed_origin(origin: Column, allowed: list[str]) -> Column:
    """The origin in normal form if it is among those allowed; ``https://*.host`` and ``https://pre*.host`` allow what a star stands for."""
    low = F.lower(F.regexp_extract(origin, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+)", 1))
    shown = F.regexp_replace(F.regexp_replace(low, r"^(http://.*):80$", "$1"), r"^(https://.*):443$", "$1")
    host = F.regexp_replace(F.regexp_replace(shown, r"^[^/]*//", ""), r":\d+$", "")
    hit = F.lit(False)
    for a in allowed:
        scheme, _, rest = a.strip().lower().partition("://")
        head, star, tail = rest.partition("*")
        tail = tail.removeprefix(".")
        if not star:
            hit = hit | (shown == f"{scheme}://{rest.split('/')[0]}")
        elif scheme in ("http", "https") and tail and "*" not in tail:
            hit = hit | (
                shown.startswith(scheme + "://") & host.endswith(tail) & host.startswith(head) & (F.length(host) > len(head) + len(tail))
            )
    return F.when((shown != "") & hit, shown)


def with_retry_hint(message: Column, hint: Column, said: str = "tap play to retry.") -> Column:
    """The message with the hint behind it, unless it says so itself."""
    return F.when(F.contains(F.lower(message), F.lit(said)), message).otherwise(F.concat(message, F.lit(" "), hint))


def audio_sources(url: Column) -> Column:
    """The url and, for opus files, the m4a file beside it to fall back on."""
    return F.when(url.endswith(".opus"), F.array(url, F.regexp_replace(url, r"\.opus$", ".m4a"))).otherwise(F.array(url))


def slug(x: Column) -> Column:
    x = F.regexp_replace(F.lower(x), r"[^a-z0-9\s-]", "")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(x, r"\s+", "-"), "-+", "-"), "^-|-$", "")


def joined_slug(*parts: Column) -> Column:
    """Slugs of the parts that have one, joined; unknown-track if none has."""
    slugs = F.filter(F.array(*(slug(F.coalesce(p, F.lit(""))) for p in parts)), lambda s: s != "")
    return F.when(F.size(slugs) == 0, "unknown-track").otherwise(F.array_join(slugs, "-"))


def band_slug(name: Column) -> Column:
    return F.regexp_replace(normalize_band(name), r"\s+", "-")


# --- numbers -------------------------------------------------------------------------------------


def parse_int(x: Column) -> Column:
    """The integer that a text begins with, else null."""
    return F.nullif(F.regexp_extract(x, r"^\s*([+-]?\d+)", 1), F.lit("")).cast("bigint")


def to_fixed(x: Column, digits: int) -> Column:
    """The exact value of a double rounded half up, as text; null of null."""
    return F.when(x.isNotNull(), F.format_string(f"%.{digits}f", x))


def unwrap_excel(x: Column) -> Column:
    """Without the ="..." that keeps spreadsheets from reading a date."""
    x = strip(F.coalesce(x, F.lit("")))
    return F.when(x.rlike('^=".*"$') & (F.length(x) > 2), F.substring(x, F.lit(3), F.length(x) - 3)).otherwise(x)


def format_shutter(seconds: Column) -> Column:
    whole = js_round(1 / seconds)
    return (
        F.when(seconds.isNull() | (seconds <= 0), "").when(seconds >= 1, F.concat(to_fixed(seconds, 2), F.lit("s")))
        .otherwise(F.concat(F.lit('="1/'), whole.cast("bigint").cast("string"), F.lit('"')))
    )


def format_camera(make: Column, model: Column) -> Column:
    return F.array_join(F.filter(F.array(*(strip(F.coalesce(c, F.lit(""))) for c in (make, model))), lambda x: x != ""), " ")


def format_aperture(f_number: Column) -> Column:
    return F.when(f_number.isNull() | (f_number == 0), "").otherwise(F.concat(F.lit("f/"), to_fixed(f_number, 1)))


def format_focal_length(mm: Column, mm35: Column) -> Column:
    return F.concat_ws(" ", F.concat(to_fixed(mm, 1), F.lit("mm")), F.concat(js_round(mm35).cast("bigint").cast("string"), F.lit("mm eq")))


def format_iso(iso: Column) -> Column:
    return F.when(iso.isNull() | (iso == 0), "").otherwise(js_round(iso).cast("bigint").cast("string"))


def _positive(x: Column) -> Column:
    return F.when(x > 0, x)


def parse_iso(x: Column) -> Column:
    return _positive(F.nullif(F.regexp_extract(x, r"(\d+)", 1), F.lit("")).cast("double"))


def parse_aperture(x: Column) -> Column:
    return _positive(F.nullif(F.regexp_extract(strip(x), r"(?i)^f?/?(\d+(?:\.\d+)?)", 1), F.lit("")).cast("double"))


def parse_shutter(x: Column) -> Column:
    x = strip(x)
    part = lambda n: F.nullif(F.regexp_extract(x, r"^(\d+)/(\d+)", n), F.lit("")).cast("double")
    plain = F.nullif(F.regexp_extract(x, r"^(\d+(?:\.\d+)?)s?$", 1), F.lit("")).cast("double")
    return _positive(F.when(x.rlike(r"^\d+/\d+"), F.try_divide(part(1), part(2))).otherwise(plain))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), x))


def grain_opacity(iso: Column) -> Column:
    return clamp(F.lit(0.06) + ((iso - 100) / 3100) * 0.22, 0.06, 0.28)


def transition_scale(seconds: Column) -> Column:
    fast, slow = 1 / 1000, 1 / 15
    return clamp(F.lit(0.6) + ((seconds - fast) / (slow - fast)) * 0.8, 0.6, 1.4)


def target_bitrate(source: Column, most: int = 160, least: int = 96) -> Column:
    """At most the maximum; a source below the minimum keeps its own rate; none gives the maximum."""
    return F.when(source.isNull() | (source <= 0), F.lit(most)).otherwise(F.least(F.lit(most), js_round(source))).cast("int")


# --- descriptions --------------------------------------------------------------------------------


def ordered_distinct(values: Column) -> Column:
    """First spelling of each value, blanks dropped, case not counting."""
    trimmed = F.filter(F.transform(F.coalesce(values, F.array().cast("array<string>")), strip), lambda v: v.isNotNull() & (v != ""))
    keyed = F.array_sort(F.transform(trimmed, lambda v, i: F.struct(F.lower(v).alias("k"), i.alias("i"), v.alias("v"))))
    first = let(keyed, lambda s: F.filter(s, lambda p, i: (i == 0) | (F.get(s, i - 1)["k"] != p["k"])))
    places = F.array_sort(F.transform(first, lambda p: F.struct(p["i"].alias("i"), p["v"].alias("v"))))
    return F.transform(places, lambda p: p["v"])


def title_case(x: Column) -> Column:
    words = F.transform(F.split(x, r"\s+"), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, F.lit(2), F.length(w)))))
    return F.trim(F.array_join(words, " "))


def genre_of_text(text: Column) -> Column:
    out = F.lit(None).cast("string")
    for pattern, label in reversed(GENRES):
        out = F.when(text.rlike("(?i)" + pattern), F.lit(label)).otherwise(out)
    return out


def genre(tags: Column, categories: Column, description: Column) -> Column:
    """The first category but music, else the first genre word in tags and description."""
    other = F.get(F.filter(categories, lambda c: (c != "") & (F.lower(c) != "music")), F.lit(0))
    return F.coalesce(title_case(other), genre_of_text(F.concat_ws(" ", F.array_join(tags, " "), F.coalesce(description, F.lit("")))))


def _lines_like(lines: Column, pattern: str) -> Column:
    return F.filter(lines, lambda s: s.rlike(pattern))


def description_credits(description: Column) -> Column:
    """struct<distributor, label, genre, credits: map<string, array<string>>> from the lines of a description."""
    lines = F.filter(F.transform(F.split(F.coalesce(description, F.lit("")), r"\r?\n"), lambda s: F.trim(s)), lambda s: s != "")
    return let(lines, _credits)


def _credits(lines: Column) -> Column:
    patterns = {"distributor": r"(?i)^Provided to YouTube by\s+(.+)$", "label": r"^℗\s*(.+)$", "genre": r"(?i)^Genre:\s*(.+)$"}
    first = {k: F.get(_lines_like(lines, p), F.lit(0)) for k, p in patterns.items()}
    # A line that gave one of the three isn't a credit; a second one of the kind is.
    where = {k: F.array_position(lines, first[k]) for k in patterns}
    spoken = lambda s, i: F.coalesce(F.array(*where.values()), F.array().cast("array<bigint>"))
    rest = F.filter(lines, lambda s, i: ~F.coalesce(F.array_contains(spoken(s, i), (i + 1).cast("bigint")), F.lit(False)) & (F.instr(s, ":") > 1))
    pair = lambda s: F.struct(
        F.trim(F.regexp_replace(F.substring_index(s, ":", 1), r"\s+", " ")).alias("k"),
        F.trim(F.substring(s, F.instr(s, ":") + 1, F.length(s))).alias("v"),
    )
    pairs = F.filter(F.transform(rest, pair), lambda p: (p["k"] != "") & (p["v"] != ""))
    credits = let(pairs, _multi_map)
    found = [F.trim(F.regexp_extract(first[k], p, 1)).alias(k) for k, p in patterns.items()]
    return F.struct(*found, credits.alias("credits"))


def _multi_map(pairs: Column) -> Column:
    """Each key with its distinct values in order."""
    keys = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
    values = lambda k: F.array_distinct(F.transform(F.filter(pairs, lambda p: p["k"] == k), lambda p: p["v"]))
    return F.map_from_entries(F.transform(keys, lambda k: F.struct(k, values(k))))


def _key_value_pairs(text: Column) -> Column:
    """array<struct<k, v>> of the ``key=value`` lines; keys in lower case, what follows a second sign is left out."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), r"\r?\n"), strip)
    cut = lambda s: F.split(s, "=")
    pair = lambda s: F.struct(F.lower(strip(F.get(cut(s), F.lit(0)))).alias("k"), strip(F.get(cut(s), F.lit(1))).alias("v"))
    return F.filter(F.transform(F.filter(lines, lambda s: s.contains("=")), pair), lambda p: p["k"] != "")


def key_values(text: Column) -> Column:
    """map of ``key=value`` lines; of a repeated key the last line counts."""
    return let(_key_value_pairs(text), lambda pairs: F.map_from_entries(F.transform(
        F.array_distinct(F.transform(pairs, lambda p: p["k"])),
        lambda k: F.struct(k, F.element_at(F.transform(F.filter(pairs, lambda p: p["k"] == k), lambda p: p["v"]), -1)),
    )))


def number(x: Column) -> Column:
    """The number that a whole text is, else null; a blank one is 0."""
    return let(strip(x), lambda s: F.when(s == "", 0.0).when(s.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), s.try_cast("double")))


def format_stats(text: Column) -> Column:
    """struct<bit_rate, size, duration>: the last positive number of each in ``key=value`` lines."""
    def last(pairs: Column, key: str) -> Column:
        good = F.filter(F.transform(F.filter(pairs, lambda p: p["k"] == key), lambda p: number(p["v"])), lambda v: v > 0)
        return F.when(F.size(good) > 0, F.element_at(good, -1)).alias(key)

    return let(_key_value_pairs(text), lambda pairs: F.struct(*(last(pairs, k) for k in ("bit_rate", "size", "duration"))))


def loudness(text: Column) -> Column:
    """struct of the numbers of the loudness report that a log holds as JSON; null where there is none."""
    found = F.from_json(json_in_text(text), ", ".join(f"{k} string" for k in LOUDNESS))
    return let(found, lambda s: F.when(s.isNotNull(), F.struct(*(number(s[k]).alias(k) for k in LOUDNESS))))


def json_in_text(text: Column) -> Column:
    """The part from the first to the last brace."""
    return F.nullif(F.regexp_extract(text, r"(?s)(\{.*\})", 1), F.lit(""))


def matches_any(text: Column, patterns: list[str]) -> Column:
    return F.coalesce(text.rlike("(?i)" + "|".join(f"(?:{p})" for p in patterns)), F.lit(False))


# --- colours -------------------------------------------------------------------------------------


def fnv1a(name: Column) -> Column:
    """32-bit FNV-1a of the UTF-16 units of the lower-case text without white space around it."""
    return let(strip(F.lower(name)), _fnv1a)


def _fnv1a(text: Column) -> Column:
    start = F.lit(2166136261).cast("bigint")
    step = lambda h, c: F.pmod(h.bitwiseXOR(c) * 16777619, F.lit(4294967296))
    plain = F.aggregate(F.split(text, ""), start, lambda h, c: step(h, F.ascii(c).cast("bigint")))
    units = F.hex(F.encode(text, "UTF-16BE"))
    unit = lambda i: F.conv(F.substring(units, F.lit(4) * i - 3, F.lit(4)), 16, 10).cast("bigint")
    wide = F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(units) / 4, F.lit(1)).cast("int")), start, lambda h, i: step(h, unit(i)))
    return F.when(text == "", start).when(F.octet_length(text) == F.char_length(text), plain).otherwise(wide)


def palette(name: Column, day_of_week: Column) -> Column:
    """struct<bg, main, accent> of hsl colours; day 0 is Sunday."""
    h = fnv1a(name)
    base = F.element_at(F.array(*map(F.lit, (0, 51, 103, 154, 205, 257, 308))), day_of_week + 1)
    hue = (base + h % 51) % 360
    light = F.lit(62) + F.shiftrightunsigned(h, 8) % 11
    return F.struct(
        F.format_string("hsl(%d, 75%%, 5%%)", (hue + 20) % 360).alias("bg"),
        F.format_string("hsl(%d, 100%%, %d%%)", hue, light).alias("main"),
        F.format_string("hsl(%d, 100%%, 58%%)", (hue + 137) % 360).alias("accent"),
    )
