"""Camera data in the head of a JPEG file."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The tags read, by number, and the directory that most of them lie in.
TAGS = {
    0x010F: "make", 0x0110: "model", 0x829A: "exposure", 0x829D: "f_number", 0x8827: "iso", 0x9003: "taken", 0x920A: "focal", 0xA405: "focal35",
}
EXIF_DIRECTORY = 0x8769
#: Bytes of a value of each type: byte, text, short, long, rational, and the signed ones.
SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 7: 1, 9: 4, 10: 8}
TEXTS = ("make", "model", "taken")
FIELDS = "struct<make:string,model:string,exposure:double,f_number:double,iso:double,taken:string,focal:double,focal35:double>"


def exif_block(jpeg: bytes) -> bytes | None:
    """The block of tags, found by walking the segments up to the image data."""
    at = 2 if jpeg[:2] == b"\xff\xd8" else len(jpeg)
    while at + 4 <= len(jpeg) and jpeg[at] == 0xFF and jpeg[at + 1] != 0xDA:
        size = int.from_bytes(jpeg[at + 2 : at + 4], "big")
        if jpeg[at + 1] == 0xE1 and jpeg[at + 4 : at + 10] == b"Exif\0\0":
            return jpeg[at + 10 : at + 2 + size]
        at += 2 + size
    return None


def _value(block: bytes, order: str, kind: int, count: int, place: int) -> str | float | None:
    if kind == 2:
        return block[place : place + count].split(b"\0")[0].decode("utf-8", "replace")
    if kind in (5, 10):
        n, d = struct.unpack_from(order + ("II" if kind == 5 else "ii"), block, place)
        return n / d if d else None
    return float(struct.unpack_from(order + {1: "B", 3: "H", 4: "I", 7: "B", 9: "i"}[kind], block, place)[0])


def read_tags(jpeg: bytes) -> dict[str, str | float | None]:
    """The tags' values; none of a file without them or with a broken block."""
    block = exif_block(jpeg)
    if block is None or block[:2] not in (b"II", b"MM"):
        return {}
    order, found = "<" if block[:2] == b"II" else ">", {}
    directories = [struct.unpack_from(order + "I", block, 4)[0]]
    for at in directories:
        for k in range(struct.unpack_from(order + "H", block, at)[0]):
            tag, kind, count, place = struct.unpack_from(order + "HHII", block, at + 2 + 12 * k)
            size = SIZES.get(kind, 0) * count
            if tag == EXIF_DIRECTORY and len(directories) == 1:
                directories.append(place)
            elif tag in TAGS and size:
                value = _value(block, order, kind, count, place if size > 4 else at + 2 + 12 * k + 8)
                if isinstance(value, str) == (TAGS[tag] in TEXTS):
                    found[TAGS[tag]] = value
    return found


def exif(content: Column) -> Column:
    """The tags of each file as a struct; null fields where a file has none or can't be read."""
    names = [f.split(":")[0] for f in FIELDS[7:-1].split(",")]

    def run(files: pd.Series) -> pd.DataFrame:
        rows = []
        for data in files:
            try:
                rows.append(read_tags(bytes(data)))
            except (TypeError, KeyError, struct.error):
                rows.append({})
        return pd.DataFrame({n: [r.get(n) for r in rows] for n in names}, dtype=object)

    return F.pandas_udf(run, FIELDS)(content)
