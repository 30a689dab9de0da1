import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from halyard.llm import periodic


def plain(w):
    """Every stretch of every period, and its smallest period by trial."""
    n, out = len(w), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            s = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            size = i - s + q
            x = w[s : s + size]
            if size >= max(6, 4 * q) and i > s and not any(x[d:] == x[:-d] for d in range(1, q)):
                out.append((s, size, q))
            i += i == s
    return sorted(out, key=lambda r: (r[0], r[2]))


def sequences(seed, count):
    rng = random.Random(seed)
    for _ in range(count):
        letters, n, w = rng.choice((1, 2, 2, 3, 6)), rng.randint(0, 90), []
        while len(w) < n:
            w += [rng.randrange(letters) for _ in range(rng.randint(1, 6))] * rng.choice((1, 1, 2, 4, 5, 7))
            if rng.random() < 0.2:
                w *= rng.randint(2, 4)
        yield w[:160]


def runs_of(w):
    return sorted(periodic.find_runs(np.array(w, dtype=np.int64)), key=lambda r: (r[0], r[2]))


def test_all_runs_of_small_sequences():
    assert sum(len(plain(w)) for w in sequences(1, 1500)) > 1000
    for w in sequences(1, 1500):
        assert runs_of(w) == plain(w), w


@pytest.mark.parametrize("base", [0, 1])
def test_hashes_that_collide_change_nothing(monkeypatch, base):
    monkeypatch.setattr(periodic, "BASE", base)
    for w in sequences(2, 700):
        assert runs_of(w) == plain(w), w


def test_zones_hold_every_run_and_the_scan_alone_finds_the_same():
    for w in sequences(3, 500):
        zones = periodic.places_in_reach(np.array(w, dtype=np.int64))
        assert all(any(a <= s and s + n <= b for a, b in zones) for s, n, _ in plain(w))
        assert sorted(periodic.runs_between(w)) == sorted(plain(w))


def test_long_sequences():
    fib = [[0], [0, 1]]
    while len(fib[-1]) < 20_000:
        fib.append(fib[-1] + fib[-2])
    assert runs_of(fib[-1]) == []
    assert runs_of([7] * 50_000) == [(0, 50_000, 1)]
    base = list(range(3000))
    assert runs_of([-1, *base * 5, -2]) == [(1, 15_000, 3000)]
    rng = random.Random(4)
    w = [rng.randrange(2) for _ in range(4000)]
    assert runs_of(w) == plain(w)


def test_exponents_are_compared_exactly():
    assert periodic.longest_by_period([(0, 13, 3), (20, 26, 6), (50, 9, 2)]) == (50, 9, 2)
    assert periodic.longest_by_period([(3, 8, 2), (1, 4, 1)][::-1]) == (1, 4, 1) and periodic.longest_by_period([]) is None


def made_periodic(doc_id, text):
    w, h = text.encode().split(), zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and w:
        n, g = len(w), h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    return w


def test_documents(spark):
    rng = random.Random(6)
    rows = [(k, " ".join(rng.choice("a b cc dd ee".split()) for _ in range(rng.randint(0, 80)))) for k in range(200)]
    rows += [(8, None), (9, ""), (10, "\t \n"), (None, "x " * 9), (7, " a b a b\x0ba b\x0c a b a b "), (7, "z y " * 30_000), rows[4], rows[4], (11, "a b c")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"n_runs": F.lit("x"), "period": F.lit(1), "words": F.lit(2)})
    got = periodic.detect(df.withColumn("text", periodic.with_periods(F.col("doc_id"), F.col("text")))).collect()
    assert len(got) == len(rows)
    wanted = []
    for doc_id, text in rows:
        w = (text or "").encode().split() if doc_id is None else made_periodic(doc_id, text or "")
        runs = plain(w) if len(w) < 1000 else [(0, 60_000, 2)]
        kept = [x for i, x in enumerate(w) if not any(s + q <= i < s + n for s, n, q in runs)]
        best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None, None, None))
        said = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        milli = 1000 * best[1] // best[2] if runs else None
        wanted.append((doc_id, len(runs), *best, milli, hashlib.sha256(said.encode()).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest()))
    assert sorted(map(tuple, got), key=repr) == sorted(wanted, key=repr)
    assert sum(r[1] for r in wanted) > 10
    assert periodic.detect(df.limit(0)).count() == 0
