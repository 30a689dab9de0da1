import numpy as np
import pytest
from pyspark.sql import functions as F

from halyard.llm import ann


def brute(vectors, query, wanted):
    ids, m = np.array(sorted(vectors)), np.array([vectors[i] for i in sorted(vectors)])
    s = m @ vectors[query]
    order = [k for k in np.lexsort((ids, -s)) if ids[k] != query][:wanted]
    return [(int(ids[k]), float(s[k])) for k in order]


def test_pigeonhole_finds_every_code_within_the_radius():
    rng = np.random.default_rng(0)
    codes = rng.integers(0, 2**16, (300, 4)).astype(np.uint16)
    codes[50:100] = codes[0] ^ (rng.random((50, 4)) < 0.5) * np.uint16(5)
    index = ann.SubstringIndex(codes)
    for radius in (0, 3, 8, 20, 30, 64):
        for q in (0, 1, 60):
            d = np.bitwise_count(codes ^ codes[q]).sum(axis=1)
            got = index.within(codes[q], np.ascontiguousarray(codes[q]).view("<u8"), radius)
            assert sorted(got) == np.flatnonzero(d <= radius).tolist()


@pytest.mark.parametrize("scaled", [False, True])
def test_recall_and_scores(spark, scaled):
    rng = np.random.default_rng(1)
    m = rng.normal(size=(700, 16)).astype(np.float32)
    m[100:160] = m[100] + 0.05 * rng.normal(size=(60, 16))
    m[200:300] = m[200]  # a hot group of equal vectors
    if not scaled:
        m /= np.linalg.norm(m, axis=1, keepdims=True)
    vectors = {i: m[i].astype(np.float64) for i in range(len(m))}
    df = spark.createDataFrame([(i, [float(x) for x in v], 7) for i, v in enumerate(m)], "vec_id long, embedding array<float>, score int")
    out = ann.nearest(df, F.col("vec_id") % 20 == 0, block_rows=200, query_rows=20).collect()
    got = {}
    for r in sorted(out, key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(got[r["query_id"]])
    hits = 0
    for q in range(0, 700, 20):
        wanted = brute(vectors, q, 20)
        assert len(got[q]) == 20 and got[q] == sorted(got[q], key=lambda p: (-p[1], p[0]))
        assert all(abs(s - vectors[v] @ vectors[q]) < 1e-9 for v, s in got[q])
        hits += len({v for v, _ in got[q]} & {v for v, _ in wanted})
    assert hits / (35 * 20) >= 0.9
    assert [v for v, _ in got[220]] == [i for i in range(200, 222) if i != 220][:20]


def test_rows_that_take_no_part(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0, [1.0, 0.0]), (1, [0.0, 0.0]), (2, None), (3, [1.0, None]), (4, [inf, 1.0]), (5, [nan, 1.0]), (6, [1.0]), (7, [0.5, 0.5]), (7, [0.5, 0.5]), (8, [0.0, 2.0]), (None, [1.0, 1.0]), (20, [1.0, 0.0]), (40, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    out = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in ann.nearest(df, F.col("vec_id") % 20 == 0).collect()]
    assert sorted(out) == [(0, 1, 20, 1.0), (0, 2, 7, 0.5), (0, 3, 8, 0.0), (20, 1, 0, 1.0), (20, 2, 7, 0.5), (20, 3, 8, 0.0)]
    assert ann.nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_each_dimension_is_searched_on_its_own(spark):
    rows = [(i, [float(i + 1), 1.0, 0.5]) for i in range(8)] + [(20, [1.0, 2.0]), (21, [2.0, 1.0]), (22, [0.0, 1.0]), (40, [3.0])]
    out = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0).collect()
    of = lambda q: [r["vec_id"] for r in sorted(out, key=lambda r: r["rank"]) if r["query_id"] == q]
    assert of(0) == [7, 6, 5, 4, 3, 2, 1] and of(20) == [21, 22] and of(40) == []
