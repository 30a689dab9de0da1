import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from halyard.llm import ngram_lm as L


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")), None]


def test_packed_keys():
    rng = np.random.default_rng(0)
    for n in (1, 2, 1000):
        for top in (2**63, 2**40, 300):
            keys = np.unique(rng.integers(0, top, n).astype(np.uint64))
            assert (L.unpack(L.pack(keys)) == keys).all()


def test_packed_counts():
    for counts in ([], [0, 1, 254, 255, 256, 2**32 - 1, 3], [255]):
        assert L.grow(L.shrink(np.array(counts, np.uint32))).tolist() == counts
    big = [2**32, 0, 6 * 10**9, 255, 7, 2**50]
    assert L.grow(L.shrink(np.array(big, np.uint64))).tolist() == big


def test_totals_beyond_32_bits():
    import pyarrow as pa

    keys, counts = L.pack(np.array([5, 9], np.uint64)), L.shrink(np.array([3_000_000_000, 4], np.uint32))
    cells = pa.table({"ord": pa.array([1] * 3, pa.int32()), "shard": pa.array([0] * 3, pa.int32()), "block": pa.array([0, 1, 2], pa.int32()), "keys": [keys] * 3, "counts": [counts] * 3})
    got = L._answers(8)(cells).to_pydict()
    assert [L.grow(x).tolist() for x in got["totals"]] == [[9_000_000_000, 12]] * 3
    assert L.grow(got["deleted"][0]).tolist() == [6_000_000_000, 8] and got["deleted"][1:] == [None, None]
    assert (sum(got["n"]), sum(got["v"]), sum(got["dn"]), sum(got["dv"])) == (9_000_000_012, 2, 6_000_000_008, 2)


@pytest.mark.parametrize("order", [1, 2, 3])
def test_estimates_are_those_of_plain_counts(order):
    texts = ["a b a b c", "a b c a", "", "c c c c"]
    block = L.Block([t.encode() for t in texts], order, 64)
    counts = block.counts(np.array([True, True, True, False]))
    seqs = [tokens(t) for t in texts]
    grams, contexts = [Counter() for _ in range(order)], [Counter() for _ in range(order)]
    for s in seqs[:3]:
        padded = ["<s>"] * (order - 1) + s
        for i in range(order - 1, len(padded)):
            for n in range(1, order + 1):
                grams[n - 1][tuple(padded[i - n + 1 : i + 1])] += 1
                contexts[n - 1][tuple(padded[i - n + 1 : i])] += 1
    n, v = sum(grams[0].values()), len(grams[0])
    est, _ = L.estimates(block, counts, n, v)
    at = 0
    for s in seqs:
        padded = ["<s>"] * (order - 1) + s
        for i in range(order - 1, len(padded)):
            for k in range(1, order + 1):
                g = tuple(padded[i - k + 1 : i + 1])
                c = contexts[k - 1][g[:-1]]
                assert abs(est[order - k][at] - (grams[k - 1][g] / c if c else 0)) < 1e-12
            at += 1
    assert at == est.shape[1] and np.allclose(est[order], 1 / (v + 1))


def test_weights_raise_the_likelihood():
    rng = np.random.default_rng(1)
    est = np.stack([rng.choice([0, 0.5, 0.01], 5000), rng.choice([0.1, 0.001], 5000), np.full(5000, 0.01)])
    bucket = rng.integers(0, 5, 5000)
    cells, counts = L.histogram(est, bucket)
    w = L.learn_weights(cells, counts.astype(float), 2, 99)
    assert np.allclose(w.sum(axis=1), 1) and (w > 0).all()
    like = lambda m: np.log((m[bucket].T * est).sum(axis=0)).sum()
    assert like(w) > like(np.full_like(w, 1 / 3))


@pytest.mark.parametrize("order", [2, 3])
def test_scores_of_documents(spark, order):
    rng = np.random.default_rng(2)
    words = ["w%d" % i for i in range(30)]
    data = [(i, " ".join(rng.choice(words[: 5 + i % 25], int(rng.integers(0, 30))))) for i in range(80)]
    data += [(100, None), (101, ""), (102, "Unknown WORDS only"), (3, data[3][1]), (None, "w1 w2"), (103, "w1 " * 20_000)]
    df = spark.createDataFrame([(i, t, "x") for i, t in data], "doc_id long, text string, block string")
    out = L.score_documents(df, order=order, block_bytes=400).collect()
    assert len(out) == len(data)
    crc = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7
    counts = Counter(t for i, text in data if crc(i) != 2 for t in tokens(text))
    n, v = sum(counts.values()), len(counts)
    text_of = dict(data)
    for r in out:
        seq = tokens(text_of[r["doc_id"]])
        base = sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in seq)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (crc(r["doc_id"]) == 2, len(seq), sum(counts[t] > 0 for t in seq), n)
        assert abs(r["base_score"] - base) < 1e-6 * max(1, abs(base)) and r["score"] < 0
    one = L.score_documents(df, order=order, block_bytes=10**9).collect()
    key = lambda rows: sorted((str(r["doc_id"]), round(r["base_score"], 6)) for r in rows)
    assert key(one) == key(out)


@pytest.mark.parametrize("order", [1, 2, 3])
def test_scores_are_those_of_plain_interpolation(spark, monkeypatch, order):
    rng = np.random.default_rng(8)
    weights = rng.dirichlet(np.ones(order + 1), L.Weights.buckets(order))
    monkeypatch.setattr(L, "learn_weights", lambda *a: weights)
    data = [(i, " ".join(f"w{j}" for j in rng.integers(0, 12, int(rng.integers(0, 25))))) for i in range(60)]
    data += [(60, data[0][1]), (None, "w1 w2 w3"), (None, "w3 w2"), (61, None)]
    df = spark.createDataFrame(data, "doc_id long, text string")
    grams, contexts = [Counter() for _ in range(order)], [Counter() for _ in range(order)]
    padded = lambda text: ["<s>"] * (order - 1) + tokens(text)
    for i, text in data:
        if zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2:
            continue
        s = padded(text)
        for at in range(order - 1, len(s)):
            for k in range(order):
                grams[k][tuple(s[at - k : at + 1])] += 1
                contexts[k][tuple(s[at - k : at])] += 1
    wanted = []
    for i, text in data:
        s, total = padded(text), 0.0
        for at in range(order - 1, len(s)):
            est, bucket = [1 / (len(grams[0]) + 1)], 0
            for k in range(order):
                seen = contexts[k][tuple(s[at - k : at])]
                est.append(grams[k][tuple(s[at - k : at + 1])] / seen if seen else 0.0)
                if k and seen:
                    bucket = min(seen.bit_length() - 1, 31) + (k - 1) * 32 + 1
            total += math.log10(float(weights[bucket] @ est[::-1]))
        wanted.append((str(i), round(total, 7)))
    got = [(str(r["doc_id"]), round(r["score"], 7)) for r in L.score_documents(df, order=order, block_bytes=300, shard_bytes=500).collect()]
    assert sorted(got) == sorted(wanted)


def test_no_training_text_and_empty(spark):
    held = [i for i in range(60) if zlib.crc32(str(i).encode()) % 7 == 2]
    out = L.score_documents(spark.createDataFrame([(i, "a b") for i in held], "doc_id long, text string")).collect()
    assert len(out) == len(held) and all(r["train_tokens"] == 0 and math.isfinite(r["score"]) for r in out)
    assert L.score_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0
