"""Fingerprints as hexadecimal strings and as two 32-bit halves."""

from __future__ import annotations

import re
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

HEX_LENGTH = 16
BITS = 4 * HEX_LENGTH
VALID = r"(?i)^[0-9a-f]{16}$"


def valid_hashes(hashes: Column) -> Column:
    """The entries that are 16 hexadecimal digits; null counts as empty."""
    return F.filter(F.coalesce(hashes, F.array().cast("array<string>")), lambda h: F.coalesce(h.rlike(VALID), F.lit(False)))


def has_hashes(hashes: Column) -> Column:
    """Whether there are entries and none is empty."""
    full = F.forall(hashes, lambda h: h.isNotNull() & (F.length(h) > 0))
    return hashes.isNotNull() & (F.size(hashes) > 0) & full


def strictly_valid(hashes: Column) -> Column:
    """Whether there are entries and all are valid."""
    n = F.size(valid_hashes(hashes))
    return (n > 0) & (n == F.size(hashes))


def hex_to_number(digits: Column) -> Column:
    """Up to eight hexadecimal digits as a number."""
    return F.conv(digits, 16, 10).cast("bigint")


def halves(h: Column) -> tuple[Column, Column]:
    return hex_to_number(F.substring(h, 1, 8)), hex_to_number(F.substring(h, 9, 8))


def halves_to_hex(hi: Column, lo: Column) -> Column:
    digits = lambda x: F.lower(F.substring(F.lpad(F.hex(x), 16, "0"), 9, 8))
    return F.concat(digits(hi), digits(lo))


def hamming_halves(hi_a: Column, lo_a: Column, hi_b: Column, lo_b: Column) -> Column:
    return F.bit_count(hi_a.bitwiseXOR(hi_b)) + F.bit_count(lo_a.bitwiseXOR(lo_b))


def _hamming_hex(a: Column, b: Column) -> Column:
    """Differing bits of two digit strings of equal length, eight digits at a time."""
    at = lambda s, i: hex_to_number(F.substring(s, (i * 8 + 1).cast("int"), F.lit(8)))
    parts = F.sequence(F.lit(0), F.greatest(F.ceil(F.length(a) / 8).cast("int") - 1, F.lit(0)))
    return F.aggregate(parts, F.lit(0), lambda s, i: s + F.coalesce(F.bit_count(at(a, i).bitwiseXOR(at(b, i))), F.lit(0)))


def hamming(a: Column, b: Column) -> Column:
    """Distance of equally long hashes; an error otherwise."""
    wrong = F.raise_error(F.concat(F.lit("hash lengths differ: "), a, F.lit(", "), b)).cast("int")
    return F.when(F.length(a) != F.length(b), wrong).otherwise(_hamming_hex(a, b))


def hamming_or_infinite(a: Column, b: Column) -> Column:
    """Distance as a double, infinite for unequal lengths or other characters than hexadecimal digits."""
    fine = (F.length(a) == F.length(b)) & a.rlike("(?i)^[0-9a-f]*$") & b.rlike("(?i)^[0-9a-f]*$")
    return F.when(F.coalesce(fine, F.lit(False)), _hamming_hex(a, b).cast("double")).otherwise(F.lit(float("inf")))


def js_round(x: Column, digits: int = 0) -> Column:
    """Round halves up."""
    return F.floor(x * 10**digits + 0.5) / 10**digits if digits else F.floor(x + 0.5)


def similarity(distance: Column, hex_length: Column | int = HEX_LENGTH) -> Column:
    """Share of equal bits in percent, to two digits."""
    bits = (F.lit(hex_length) if isinstance(hex_length, int) else hex_length) * 4
    return js_round((bits - distance) / bits * 100, 2)


def similarity_percent(distance: Column) -> Column:
    """Share of equal bits of a 64-bit hash in percent, not rounded."""
    return (F.lit(BITS) - distance) / F.lit(BITS) * 100


def binary_to_hex(bits: Column) -> Column:
    """Digits of a string of bits, four bits each; a shorter last group stands for its own value."""
    groups = F.sequence(F.lit(0), F.greatest(F.ceil(F.length(bits) / 4).cast("int") - 1, F.lit(0)))
    digits = F.transform(groups, lambda i: F.lower(F.conv(F.substring(bits, i * 4 + 1, F.lit(4)), 2, 16)))
    return F.when(F.length(bits) == 0, "").otherwise(F.array_join(digits, ""))


def hex_to_binary(digits: Column) -> Column:
    groups = F.transform(F.split(digits, ""), lambda d: F.lpad(F.conv(d, 16, 2), 4, "0"))
    return F.when(F.length(digits) == 0, "").otherwise(F.array_join(groups, ""))


def quantise(values: Column) -> tuple[Column, Column]:
    """Halves of the fingerprint of 63 coefficients: bits of those above the 32nd smallest, then a 0 bit.

    The coefficients are sorted once, before the lambda that walks through them: inside it, they would be for each one.
    """
    coefficients = F.slice(values, 1, 63)

    def fold(first: int, n: int) -> Column:
        above = lambda x, median: F.when(x > median, 1).otherwise(0)
        seen = F.struct(F.get(F.sort_array(F.array_compact(coefficients)), F.lit(31)).alias("median"), F.lit(0).cast("bigint").alias("bits"))
        step = lambda s, x: F.struct(s["median"].alias("median"), (s["bits"] * 2 + above(x, s["median"])).alias("bits"))
        return F.aggregate(F.slice(coefficients, first, n), seen, step, lambda s: s["bits"])

    return fold(1, 32), fold(33, 31) * 2


def quantised(values: Column) -> tuple[Column, Column]:
    """What quantise gives, by numpy for whole batches of vectors."""
    bits = _bits_of(values)
    return F.shiftrightunsigned(bits, 32), bits.bitwiseAND(0xFFFFFFFF)


def _bits(vectors: pa.Array) -> pa.Array:
    flat, ends = vectors.values, vectors.offsets.to_numpy()
    places = ends[:-1, None] + np.arange(63)
    there = places < ends[1:, None]
    if not len(flat) or not len(vectors):
        x = np.zeros((len(vectors), 63))
    else:
        np.minimum(places, len(flat) - 1, out=places)
        x = flat.to_numpy(zero_copy_only=False)[places]
        there &= flat.is_valid().to_numpy(zero_copy_only=False)[places]
    median = np.sort(np.where(there, x, np.nan), axis=1)[:, 31, None]  # NaN is the largest value, as in Spark
    above = there & (there.sum(axis=1, keepdims=True) > 31) & ((x > median) | np.isnan(x) & ~np.isnan(median))
    n = np.diff(ends)
    hi = above[:, :32] @ (1 << np.arange(31, -1, -1))
    lo = (above[:, 32:] @ (1 << np.arange(30, -1, -1))) >> (63 - np.clip(n, 32, 63)) << 1  # a shorter vector's bits are no more than it has
    return pa.array(hi << 32 | lo, pa.int64(), mask=vectors.is_null().to_numpy(zero_copy_only=False))


@cache
def _bits_udf():
    def bits(vectors: pa.Array) -> pa.Array:
        return _bits(vectors)

    return F.arrow_udf(bits, "bigint")


def _bits_of(values: Column) -> Column:
    return _bits_udf()(values)


#: Hashes that are compared at a time with those kept before.
STRIDE = 512


def prune_near(hashes: Column, most: int = 1) -> Column:
    """Walk through the hashes and keep those more than ``most`` bits from every one kept before."""
    return _kept_apart(most)(F.array().cast("array<string>"), hashes)


def append_novel(base: Column, more: Column, most: int = 1) -> Column:
    """Append, in order, what is more than ``most`` bits from all that is there; the base stays as it is."""
    return _kept_apart(most)(base, more)


def _kept_apart(most: int):
    """A UDF of two lists: the first, and what of the second is more than ``most`` bits from all before it that are kept.

    A list is walked in strides, each compared with the kept numbers at once.
    Distances are those of hamming_or_infinite: only digit strings of one length
    have one, so each length has numbers of its own. A digit string that was
    seen before is near what kept it away, or near itself.
    """
    digits = re.compile("[0-9a-fA-F]*")
    known = lambda x: x is not None and digits.fullmatch(x) is not None

    def words(texts: list[str]) -> np.ndarray:
        """The bits of digit strings of one length, 16 digits a word."""
        wide = max(1, -(-len(texts[0]) // 16))
        raw = b"".join(int(x or "0", 16).to_bytes(8 * wide, "big") for x in texts)
        return np.frombuffer(raw, ">u8").astype(np.uint64).reshape(-1, wide)

    def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return sum(np.bitwise_count(a[:, None, k] ^ b[None, :, k]).astype(np.uint16) for k in range(a.shape[1]))

    def keep(base: list, more: list) -> list:
        kept: dict[int, list[np.ndarray]] = {}
        for n in {len(x) for x in base if known(x)}:
            kept[n] = [words([x for x in base if known(x) and len(x) == n])]
        places: dict[int, dict[str, int]] = {}
        for at, x in enumerate(more):
            if known(x):
                places.setdefault(len(x), {}).setdefault(x.lower(), at)
        near = {at for at, x in enumerate(more) if known(x) and (most >= 0 and places[len(x)][x.lower()] != at)}
        for n, firsts in places.items() if most >= 0 else ():
            order, bits = list(firsts.values()), words(list(firsts))
            for low in range(0, len(order), STRIDE):
                stride = bits[low : low + STRIDE]
                far = np.ones(len(stride), bool)
                for part in kept.get(n, ()):
                    for some in range(0, len(part), 1 << 14):
                        far[far] = (apart(stride[far], part[some : some + (1 << 14)]) > most).all(1)
                left = np.flatnonzero(far)
                close = apart(stride[left], stride[left]) <= most
                taken = np.zeros(len(left), bool)
                for k in range(len(left)):
                    taken[k] = not (close[k, :k] & taken[:k]).any()
                near.update(order[low + k] for k in np.flatnonzero(~far))
                near.update(order[low + k] for k in left[~taken])
                kept[n] = [np.concatenate([*kept.get(n, ()), stride[left[taken]]])]
        return [*base, *(x for at, x in enumerate(more) if at not in near)]

    def run(base: pd.Series, more: pd.Series) -> pd.Series:
        return pd.Series([None if a is None or b is None else keep(list(a), list(b)) for a, b in zip(base, more, strict=True)], dtype=object)

    return F.pandas_udf(run, "array<string>")
