"""Benchmark decontamination by canonical templates.

Texts become templates: numbers, units after numbers and names are replaced by
typed placeholders, so a question with other values gives the same template.
Windows of ``window`` template words are hash-joined with those of the
benchmark items; a document that holds, close together, at least the given
share of an item's windows is then checked for consistent slots: a value that
occurs again must stand for the same value of the other side.

Numbers may be spelled out, and units may be attached to them ("5km"). Names are
capitalised words that are no common words, wherever they stand, and common
words inside sentences or before such a word; a run of them is one name. Where
a passage begins in a document decides whether a common first word counts as
one, so windows are also made with names left as words, and either may match.
Windows with fewer than three words besides placeholders match nothing, but an
item that has no others is matched by its literal words and values.

The benchmark is joined in parts of a bounded number of windows, each shipped to
the executors as sorted arrays; a larger benchmark takes more passes.

Defined results
    null or empty text: no windows; items shorter than a window: matched whole
    if they have three words or placeholders or more, else never; repeated rows:
    reported once a doc_id and item_id, by the best match; null item_id: one of
    its own; null doc_id: never reported, and kept by ``drop_contaminated`` unless
    told otherwise;
    ties: the match that begins first; very long texts: whole; empty tables: no
    rows; further columns: left out by ``find_contaminated``, kept by
    ``drop_contaminated``.
"""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

#: Items joined in one pass have at most about this many words.
PART_WORDS = 1_000_000
#: Distinct words that a worker remembers.
KNOWN_WORDS = 400_000
#: Units of measure after a number.
UNITS = (
    "mm cm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers "
    "kilometre kilometres centimeter centimeters g kg mg lb lbs oz gram grams kilogram kilograms pound pounds ounce ounces "
    "ton tons l ml liter liters litre litres gallon gallons cup cups s sec min h hr second seconds minute minutes hour hours "
    "day days week weeks month months year years km/h mph m/s degree degrees percent dollar dollars euro euros cent cents "
    "watt watts kw volt volts hz"
).split()
#: Words that stay words at the start of a sentence.
COMMON = frozenset((
    "a about above after again all almost along also although always am among an and another any are around as assume at away "
    "back be because been before began behind being below beside between beyond both but by calculate call can choose compare "
    "complete compute consider could count decide define describe determine did do does done down draw during each either "
    "enough estimate evaluate even every everyone everything evidently explain express far few finally find first for form from "
    "further get give given go had half has have he her here hers herself hi him himself his how however i if imagine in "
    "indeed initially inside instead into is it its itself just know last later least less let let's like list little long look "
    "made make many may maybe me meanwhile might more moreover most much must my name near neither never new next no nobody "
    "none nor not note nothing now of off often oh ok old on once only or other others otherwise our out outside over own part "
    "people perhaps please prove rather read really recently round same see select several shall she should show simplify "
    "simply since so solve some someone something sometimes soon start state still such suddenly suppose take tell than that "
    "that's the their them then there therefore these they things think this those though through throughout thus to today "
    "together tomorrow tonight too total toward true try under unless until up upon use using usually very want was we well were "
    "what what's when whenever where whether which while who whoever whole whom whose why will with within without work would "
    "write yes yesterday yet you your "
    "der die das ein eine einen einem einer und oder aber in im am an auf aus bei mit nach von zu zum zur für wie was wer wo "
    "wann warum wenn es er sie wir ihr ich ist sind war hat haben nicht kein keine dann da so als auch nur "
    "le la les un une des du de et ou mais dans sur avec pour par il elle ils elles nous vous je ce cette ces qui que quoi quand "
    "comment pourquoi où est sont si "
    "el los las una unos unas y o pero en con por para ella ellos ellas nosotros yo este esta estos estas qué quién cuándo "
    "cómo dónde cuánto cuántos cuántas es son"
).split())
#: Signs that count as words between numbers.
SIGNS = frozenset("-–—*")
LITERAL = np.uint64(xxh64_intdigest(b"<literal>"))
NUM, UNIT, NAME = (np.uint64(xxh64_intdigest(x)) for x in (b"<num>", b"<unit>", b"<name>"))
NUMBER = re.compile(r"[$€£]?[+-]?\d[\d.,:/]*(?:%|st|nd|rd|th)?")
MULTIPLIERS = np.array([pow(0x9E3779B97F4A7C15, 2 * k + 1, 2**64) for k in range(64)], dtype=np.uint64)
FOUND = "doc_id long, item_id long, n_windows long, n_matched long, coverage double, start_word long"


class Words(dict):
    """The row of each word in arrays of hashes and flags; a word that is new is added, one of two parts has the next row as well."""

    def __init__(self, parts):
        self.parts, self.rows = parts, 0
        self.value, self.kind, self.two = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, bool)
        self.new: tuple[list, list, list] = [], [], []

    def __missing__(self, w: str) -> int:
        value, kind, *second = self.parts(w)
        row = self[w] = self.rows
        values, kinds, two = self.new
        values.append(value)
        kinds.append(kind)
        two.append(bool(second))
        self.rows += 1
        if second:
            values.append(second[0])
            kinds.append(second[1])
            two.append(False)
            self.rows += 1
        return row

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes, flags and whether the next row belongs to the word; room grows by doubling."""
        n = len(self.new[0])
        if n:
            if self.rows > len(self.value):
                more = max(self.rows, 2 * len(self.value), 1024) - len(self.value)
                self.value, self.kind, self.two = (np.concatenate([x, np.zeros(more, x.dtype)]) for x in (self.value, self.kind, self.two))
            for x, new in zip((self.value, self.kind, self.two), self.new, strict=True):
                x[self.rows - n : self.rows] = np.array(new, x.dtype)
            self.new = [], [], []
        return self.value, self.kind, self.two


def before(x: np.ndarray) -> np.ndarray:
    """Of each place what is at the one before."""
    out = np.zeros_like(x)
    out[1:] = x[:-1]
    return out


def after(x: np.ndarray) -> np.ndarray:
    out = np.zeros_like(x)
    out[:-1] = x[1:]
    return out


class Templates:
    """Word sequences as arrays: hash of the lower-case core, and what kind the word is."""

    def __init__(self):
        self.known = Words(self._word)

    def _word(self, w: str) -> tuple[int, ...]:
        """Hash of the core and flags: 1 number, 2 unit, 4 capitalised, 8 ends a sentence, 16 nothing but punctuation,
        32 spelled number, 64 common word, 128 sign between numbers, 256 hundred and the like; a number with a unit gives both in turn."""
        core = w.strip("\"'“”‘’«»()[]{}<>.,;:!?…|*_-–—")
        low = core.lower() or w
        kind = 8 * w.rstrip("\"'”’»)]}").endswith((".", "!", "?", "…", ":"))
        if not core:
            kind |= 16 | 128 * (w in SIGNS)
        elif not (plain := core.isalpha()) and NUMBER.fullmatch(core):
            kind |= 1
        elif not plain and (m := _ATTACHED.fullmatch(low)) and m[2] in _UNITS:
            return xxh64_intdigest(m[1].encode()), 1, xxh64_intdigest(m[2].encode()), kind | 2
        elif low in _SPELLED:
            kind |= 1 | 32 | 256 * (low in _SCALES)
        elif low in _UNITS:
            kind |= 2
        if core[:1].isupper():
            kind |= 4
        if low in COMMON:
            kind |= 64
        return xxh64_intdigest(low.encode()), kind

    def arrays(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes, flags and word numbers."""
        if len(self.known) > KNOWN_WORDS:
            self.known = Words(self._word)
        words, known = text.split(), self.known
        row, at = np.fromiter(map(known.__getitem__, words), np.int64, len(words)), np.arange(len(words))
        value, kind, two = known.arrays()
        two = two[row]
        if two.any():
            n = 1 + two
            row, at = np.repeat(row, n), np.repeat(at, n)
            row[1:] += at[1:] == at[:-1]
        return value[row], kind[row], at

    def channels(self, text: str):
        """(template, word number, value, is a slot) of the plain template, and of that with names if it differs."""
        value, kind, at = self.arrays(text)
        number = kind & 1 > 0
        sign = (kind & 128 > 0) & before(number) & after(number)
        real = np.flatnonzero((kind & 16 == 0) | sign)
        ends = np.cumsum(before(kind & 8 > 0))  # sentences ended before each word
        value, kind, ends, at, number = value[real], kind[real], ends[real], at[real], number[real]
        if not len(real):
            return
        same = np.zeros(len(real), bool)
        same[1:] = ends[1:] == ends[:-1]  # in one sentence with the word before
        unit = (kind & 2 > 0) & before(number)
        plain = np.where(number, NUM, np.where(unit, UNIT, value))
        more = (kind & 32 > 0) & before(number) & same & (before(kind & 32 > 0) | (kind & 256 > 0))  # "two hundred" and "5 million" are one number
        part = number & (more | after(more))

        def joined(template, more, part, slot):
            if not more.any():
                return template, at, value, slot
            first = np.flatnonzero(~more)
            run = np.add.reduceat(np.where(part, value * np.uint64(31) + np.uint64(7), value), first)
            return template[first], at[first], run, slot[first]

        slot = number | unit | (kind & 128 > 0)  # signs stay as they are, but are no words
        yield joined(plain, more, part, slot)
        capital = (kind & 4 > 0) & ~number & ~unit
        inside = capital & same
        name = capital & (kind & 64 == 0) | inside | capital & after(inside)
        if name.any():
            more_names = more | name & before(name) & same
            yield joined(np.where(name, NAME, plain), more_names, part | name, slot | name)


_UNITS = frozenset(UNITS)
_ATTACHED = re.compile(r"([$€£]?[+-]?\d[\d.,:/]*)[-–]?([^\W\d_]+(?:/[^\W\d_]+)?)")
_ONES = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
_TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
_SCALES = frozenset(["hundred", "thousand", "million", "billion"])
_SPELLED = frozenset([*_ONES, *_TENS, *_SCALES, *(f"{t}-{o}" for t in _TENS for o in _ONES[1:10])])


def windows(template: np.ndarray, slot: np.ndarray, size: int) -> np.ndarray:
    """Hash of each window of the template; 0 where fewer than three are words."""
    n = len(template) - size + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    out, words = np.zeros(n, np.uint64), np.zeros(n, np.int64)
    for k in range(size):
        part = template[k : k + n]
        out += (part ^ (part >> np.uint64(31))) * MULTIPLIERS[k % 64]
        words += ~slot[k : k + n]
    out ^= out >> np.uint64(29)
    out[words < 3] = 0
    return out


def literal_windows(value: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Hash of the words and values of the windows that begin at the given places."""
    out = np.full(len(at), LITERAL)
    for k in range(size):
        part = value[at + k]
        out += (part ^ (part >> np.uint64(31))) * MULTIPLIERS[k % 64]
    return out ^ (out >> np.uint64(29))


class Index:
    """Windows of the benchmark items, sorted by hash."""

    def __init__(self, items: list[tuple[int, str]], size: int):
        made, self.items = Templates(), []
        hashes, item_of, at = [], [], []
        self.sizes, self.literal = {size}, False
        for item_id, text in items:
            for channel, (template, _, value, slot) in enumerate(made.channels(text or "")):
                own = min(size, len(template))
                h = windows(template, slot, own)
                if not h.any():
                    if channel or own < 3:
                        continue
                    h, self.literal = literal_windows(value, np.arange(len(h)), own), True
                self.sizes.add(own)
                keep = np.flatnonzero(h)
                hashes.append(h[keep] + np.uint64(own))
                item_of.append(np.full(len(keep), len(self.items)))
                at.append(keep)
                self.items.append((item_id, len(np.unique(h[keep])), value, slot, len(template)))
        cat = lambda x, t: np.concatenate(x).astype(t) if x else np.zeros(0, t)
        h = cat(hashes, np.uint64)
        order = np.argsort(h, kind="stable")
        self.hashes, self.item_of, self.at = h[order], cat(item_of, np.int64)[order], cat(at, np.int64)[order]
        self.bits = np.zeros(1 << 20, bool)  # a first filter: most windows of a text are in no item
        self.bits[(self.hashes >> np.uint64(44)).astype(np.int64)] = True

    def hits(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in h and in the index that agree."""
        may = np.flatnonzero(self.bits[(h >> np.uint64(44)).astype(np.int64)])
        left = np.searchsorted(self.hashes, h[may], side="left")
        n = np.searchsorted(self.hashes, h[may], side="right") - left
        where = np.repeat(may, n)
        return where, np.repeat(left - np.cumsum(n) + n, n) + np.arange(len(where))


def _consistent(pairs: list[tuple[int, int]], least: float) -> bool:
    """Whether values that repeat, in the item or the document, stand for one value of the other side in enough of their slots."""
    there, back = defaultdict(lambda: defaultdict(int)), defaultdict(lambda: defaultdict(int))
    for a, b in pairs:
        there[a][b] += 1
        back[b][a] += 1
    to = {a: max(sorted(v), key=v.get) for a, v in there.items()}
    of = {b: max(sorted(v), key=v.get) for b, v in back.items()}
    repeated = [(a, b) for a, b in pairs if sum(there[a].values()) > 1 or sum(back[b].values()) > 1]
    return sum(to[a] == b and of[b] == a for a, b in repeated) >= least * len(repeated)


def matches(index: Index, made: Templates, text: str, size: int, coverage: float, slots: float):
    """(item_id, windows, matched, first word) of the items that a text holds."""
    best: dict[int, tuple] = {}
    for channel, (template, word, value, slot) in enumerate(made.channels(text)):
        for own in index.sizes:
            h = windows(template, slot, own)
            if index.literal and not channel and len(dense := np.flatnonzero(h == 0)):
                h[dense] = literal_windows(value, dense, own)
            h = np.where(h > 0, h + np.uint64(own), 0).astype(np.uint64)
            where, place = index.hits(h)
            item = index.item_of[place]
            for k in np.unique(item):
                item_id, wanted, item_value, item_slot, length = index.items[k]
                chosen = item == k
                spot, at, key = where[chosen], index.at[place[chosen]], index.hashes[place[chosen]]
                if len(np.unique(key)) < coverage * wanted:
                    continue
                # the densest stretch: a span of half as many words again as the item has
                reach = np.searchsorted(spot, spot + length + length // 2)
                count, seen, low = 0, defaultdict(int), 0
                top, span = 0, (0, 0)
                for i in range(len(spot)):
                    while low < reach[i]:
                        seen[key[low]] += 1
                        count += seen[key[low]] == 1
                        low += 1
                    if count > top:
                        top, span = count, (i, low)
                    seen[key[i]] -= 1
                    count -= seen[key[i]] == 0
                if top < coverage * wanted:
                    continue
                pairs = {
                    (int(a) + j, int(s) + j) for a, s in zip(at[slice(*span)], spot[slice(*span)], strict=True) for j in range(own)
                    if slot[int(s) + j] and item_slot[int(a) + j]
                }
                values = [(int(item_value[a]), int(value[s])) for a, s in sorted(pairs)]
                if _consistent(values, slots):
                    row = (item_id, wanted, top, int(word[spot[span[0]]]))
                    if item_id not in best or top / wanted > best[item_id][2] / best[item_id][1]:
                        best[item_id] = row
    return list(best.values())


def _parts(benchmark: DataFrame) -> int:
    words = benchmark.agg(F.sum(F.size(F.split(F.coalesce("text", F.lit("")), r"\s+")))).first()[0] or 0
    return max(1, -(-words // PART_WORDS))


def _indexes(benchmark: DataFrame, window: int):
    """An index for each part of the benchmark."""
    bench = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text")
    parts = _parts(bench)
    for part in range(parts):
        of_part = F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part
        items = [(r[0], r[1] or "") for r in bench.filter(of_part).collect()]
        yield Index(sorted(items, key=lambda r: (r[0] is None, r[0] or 0, r[1])), window)


def find_contaminated(
    docs: DataFrame, benchmark: DataFrame, window: int = 5, coverage: float = 0.8, slots: float = 0.8
) -> DataFrame:
    """doc_id, item_id and how much of the item's windows the document holds, for contaminated documents only."""
    texts = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    names = [x.split()[0] for x in FOUND.split(", ")]
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64())
    found = None
    for index in _indexes(benchmark, window):

        def run(batches, index=index):
            made = Templates()
            for batch in batches:
                rows = []
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    for item_id, wanted, top, at in matches(index, made, text.as_py() or "", window, coverage, slots):
                        rows.append((doc_id, item_id, wanted, top, top / wanted, at))
                cols = zip(*rows, strict=True) if rows else [[]] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

        one = texts.mapInArrow(run, FOUND)
        found = one if found is None else found.unionByName(one)
    return found.groupBy("doc_id", "item_id").agg(
        F.max(F.struct("coverage", "n_windows", "n_matched", (-F.col("start_word")).alias("s"))).alias("m")
    ).select(
        "doc_id", "item_id", F.col("m.n_windows").alias("n_windows"), F.col("m.n_matched").alias("n_matched"),
        F.col("m.coverage").alias("coverage"), (-F.col("m.s")).alias("start_word"),
    )


def drop_contaminated(
    docs: DataFrame, benchmark: DataFrame, window: int = 5, coverage: float = 0.8, slots: float = 0.8, keep_without_id: bool = True
) -> DataFrame:
    """docs without the contaminated ones; no row moves. Rows without doc_id can't be reported and stay, unless they are to go as well."""
    name, place = docs.columns.index("doc_id"), docs.columns.index("text")
    for index in _indexes(benchmark, window):

        def run(batches, index=index):
            made = Templates()
            for batch in batches:
                clean = [
                    doc_id is None and keep_without_id or not matches(index, made, text or "", window, coverage, slots)
                    for doc_id, text in zip(batch.column(name).to_pylist(), batch.column(place).to_pylist(), strict=True)
                ]
                yield batch.filter(pa.array(clean, pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
