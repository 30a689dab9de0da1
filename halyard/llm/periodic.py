"""Runs of repeated word groups: stretches that repeat with a period, at least four times over.

A run is a stretch of consecutive words with smallest period q that no
neighbouring word extends; those of max(6, 4 q) words and more are told. The
method is that of Lyndon roots: under one of the two orders of the words, the
smallest rotation of a run's period is, wherever it starts in the run, the
longest Lyndon word from there. So a stack is scanned from right to left under
both orders for the longest Lyndon word at each place, and each such word is
extended both ways by the longest common extension with its own successor.

Extensions are found by binary search over rolling hashes and then verified
word by word. What was verified once for a distance is kept, so the scan
verifies each word of a run about once for its period, and an unlucky hash costs time, never
a result: equal hashes are checked, unequal hashes are of unequal words.

Before the scan, words are left out that can't lie in a run: in all of a run but
its last period, each word comes again within q words. Stretches where each word
comes again within G and that are long enough for a period of G / 2 < q <= G are
looked for at G = 1, 2, 4, ...; together they hold every run whole.

Each document is handled on its own within a task, whose memory is some dozen
times the document.

Defined results
    null or wordless text: no runs, nulls, hashes of nothing; repeated rows and
    repeated or null doc_ids: each row is told; ties of exponent: smallest start,
    then period; empty table: no rows; very long texts: whole; further columns,
    also those named like the result's: left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A run has so many words and so many periods at least.
MIN_WORDS, MIN_PERIODS = 6, 4
FOUND = (
    "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
)
MASK = (1 << 61) - 1
BASE = 0x1B873593CC9E2D51 % MASK


def numbered(words: list[bytes]) -> np.ndarray:
    """A number for each word, equal for equal words."""
    known: dict[bytes, int] = {}
    number = known.setdefault
    return np.fromiter((number(w, len(known)) for w in words), np.int64, len(words))


def places_in_reach(ids: np.ndarray) -> list[tuple[int, int]]:
    """Disjoint stretches, from start to before end, that hold every run whole."""
    n = len(ids)
    if n < MIN_WORDS:
        return []
    order = np.argsort(ids, kind="stable")
    gap = np.full(n, n, np.int64)  # words until the same word comes again
    same = ids[order[1:]] == ids[order[:-1]]
    gap[order[:-1][same]] = np.diff(order)[same]
    zones, reach = [], 1
    while True:
        least = reach // 2 + 1  # the smallest period of this reach
        need = max(MIN_WORDS, MIN_PERIODS * least) - least
        edges = np.flatnonzero(np.diff(np.concatenate(([0], (gap <= reach).view(np.int8), [0]))))
        starts, ends = edges[::2], edges[1::2]
        long = ends - starts >= need
        zones += [(int(a), min(n, int(b) + reach)) for a, b in zip(starts[long], ends[long], strict=True)]
        reach *= 2
        if MIN_PERIODS * (reach // 2 + 1) > n:
            break
    merged: list[tuple[int, int]] = []
    for a, b in sorted(zones):
        if merged and a <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
        else:
            merged.append((a, b))
    return merged


class Extensions:
    """How far a sequence goes on alike from two of its places, to the right or (on the turned sequence) to the left."""

    def __init__(self, word: list[int]):
        self.word, self.n = word, len(word)
        self.power, self.sums = [1], [0]
        for x in word:
            self.sums.append((self.sums[-1] * BASE + x + 1) % MASK)
            self.power.append(self.power[-1] * BASE % MASK)
        self.verified: dict[int, tuple[int, int]] = {}  # by distance: a place and how far it is known to go on

    def _alike(self, i: int, j: int, size: int) -> bool:
        s, p = self.sums, self.power[size]
        return (s[i + size] - s[i] * p - s[j + size] + s[j] * p) % MASK == 0

    def length(self, i: int, j: int) -> int:
        """Words from i and from j > i on that are the same."""
        word, n, d = self.word, self.n, j - i
        if j >= n or word[i] != word[j]:
            return 0
        at, known = self.verified.get(d, (n, 0))
        if at <= i < at + known:
            return at + known - i
        if i < at < n and self._alike(i, j, at - i) and word[i:at] == word[j : at + d]:
            self.verified[d] = (i, at - i + known)  # up to what was verified before
            return at - i + known
        low, step, most = 1, 2, n - j  # alike for low words by hash; widened by doubling, then halved
        while step < most and self._alike(i, j, step):
            low, step = step, 2 * step
        high = step if step < most else most + 1  # not alike for so many, or too many
        while high - low > 1:
            mid = (low + high) // 2
            if self._alike(i, j, mid):
                low = mid
            else:
                high = mid
        if word[i : i + low] != word[j : j + low]:
            low = next(k for k in range(low) if word[i + k] != word[j + k])
        self.verified[d] = (i, low)
        return low


def lyndon_ends(word: list[int], ahead: Extensions, sign: int) -> list[int]:
    """Where the longest Lyndon word that starts at each place ends, words ordered by sign * number, a shorter one first."""
    n = len(word)
    end = [n] * (n + 1)
    for i in range(n - 1, -1, -1):
        j, x = i + 1, word[i]
        while j < n:
            y = word[j]
            if x == y:
                same = ahead.length(i, j)
                if j + same >= n:
                    break  # the later suffix is a prefix of this one
                a, b = word[i + same], word[j + same]
            else:
                a, b = x, y
            if (b - a) * sign < 0:
                break
            j = end[j]
        end[i] = j
    return end


def runs_between(word: list[int], offset: int = 0) -> set[tuple[int, int, int]]:
    """start, length, period of the runs of a sequence."""
    n = len(word)
    ahead, back = Extensions(word), Extensions(word[::-1])
    found: set[tuple[int, int, int]] = set()
    for sign in (1, -1):
        last: dict[int, int] = {}  # by period: where the last run begins, whose other roots needn't be extended again
        end = lyndon_ends(word, ahead, sign)
        for i in range(n - 1, -1, -1):
            j = end[i]
            # of a run's roots, one at least is followed by another whole one
            if j >= n or word[i] != word[j] or 2 * j - i > n or last.get(j - i, n) <= i or word[j - 1] != word[2 * j - i - 1]:
                continue
            p = j - i
            right = ahead.length(i, j)
            left = back.length(n - j, n - i) if i else 0  # the words before i and before j, backwards
            last[p] = i - left
            if p + left + right >= max(MIN_WORDS, MIN_PERIODS * p):
                found.add((i - left + offset, p + left + right, p))
    return found


def find_runs(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """start, length, period of every run, by start, then period."""
    found: set[tuple[int, int, int]] = set()
    for a, b in places_in_reach(ids):
        found |= runs_between(ids[a:b].tolist(), a)
    return sorted((s, n, p) for s, n, p in found)


def longest_by_period(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the greatest length / period, compared in whole numbers; the first of those that tie."""
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    return best


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that a run holds after its first period."""
    if not runs:
        return words
    drop = np.zeros(len(words) + 1, np.int32)
    for s, n, p in runs:
        drop[s + p] += 1
        drop[s + n] -= 1
    keep = (np.cumsum(drop)[:-1] == 0).tolist()
    return [w for w, k in zip(words, keep, strict=True) if k]


def detect(docs: DataFrame) -> DataFrame:
    """The digest of each document's runs, and of its text with each run cut down to one period."""

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[] for _ in range(8)]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = (text.as_py() or b"").split()
                runs = sorted(find_runs(numbered(words)), key=lambda r: (r[0], r[2]))
                start, length, period = longest_by_period(runs) or (None, None, None)
                said = "".join(f"{s},{n},{p}\n" for s, n, p in runs).encode()
                row = (
                    doc_id, len(runs), start, length, period, 1000 * length // period if runs else None,
                    hashlib.sha256(said).hexdigest(), hashlib.sha256(b" ".join(collapsed(words, runs))).hexdigest(),
                )
                for c, v in zip(cols, row, strict=True):
                    c.append(v)
            kinds = [pa.int64()] * 6 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], [x.split()[0] for x in FOUND.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(tell, FOUND)


def with_periods(doc_id: Column, text: Column) -> Column:
    """The text, made periodic from some word on where crc32(doc_id) is a multiple of ten.

    Word i >= a becomes word a + (i - a) mod p, with g = crc32 / 10, a = g mod n
    and p = 1 + (n - a) / (3 + g mod 8), all in whole numbers.
    """
    h = F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))
    g = F.call_function("div", h, F.lit(10))

    def change(words: Column) -> Column:
        n = F.size(words).cast("long")
        a = g % n
        p = F.lit(1) + F.call_function("div", n - a, F.lit(3) + g % 8)
        at = lambda i: F.when(i < a, i.cast("long")).otherwise(a + (i - a) % p).cast("int")
        return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(0), F.size(words) - 1), lambda i: F.get(words, at(i))), " ")).otherwise("")

    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return F.when(doc_id.isNotNull() & (h % 10 == 0) & text.isNotNull(), F.element_at(F.transform(F.array(words), change), 1)).otherwise(text)
