import zlib
from collections import Counter

import numpy as np
import pytest

from halyard.llm import packing
from halyard.llm.queries import vocab_path

public_tokenizers = pytest.importorskip("public_tokenizers")


def unpack(placements):
    bins = {}
    for length, rank, count, first, offset in placements:
        for k in range(count):
            bins.setdefault(first + k, []).append((offset, length, rank + k))
    return bins


def plain_best_fit(lengths, capacity):
    """Bins that best fit by falling length takes, piece by piece."""
    room = []
    for length in sorted(lengths.tolist(), reverse=True):
        fits = [k for k, r in enumerate(room) if r >= length]
        if fits:
            room[min(fits, key=lambda k: room[k])] -= length
        else:
            room.append(capacity - length)
    return len(room)


@pytest.mark.parametrize("rule", ["norm", "dot"])
@pytest.mark.parametrize("limits", [(64, None, None), (64, 5, None), (64, None, 900)])
def test_plan_keeps_every_capacity(rule, limits):
    rng = np.random.default_rng(3)
    capacity, docs, attention = limits
    lengths = rng.integers(1, 31 if attention else capacity + 1, 900)
    counts = dict(Counter(lengths.tolist()))
    placements, n = packing.plan_bins(counts, capacity, docs, attention, rule=rule)
    bins = unpack(placements)
    assert sorted(bins) == list(range(n))
    placed = Counter()
    for parts in bins.values():
        parts.sort()
        at = 0
        for offset, length, rank in parts:
            assert offset == at
            at += length
            placed[length] += 1
        assert at <= capacity and len(parts) <= (docs or capacity) and sum(p[1] ** 2 for p in parts) <= (attention or capacity**2)
    assert placed == counts
    for length in counts:
        assert sorted(r for p in bins.values() for _, le, r in p if le == length) == list(range(counts[length]))
    if not docs and not attention and rule == "norm":
        assert n == plain_best_fit(lengths, capacity)


def test_full_pieces_and_too_long_ones():
    assert packing.plan_bins({8: 5}, 8)[1] == 5 and packing.plan_bins({}, 8) == ([], 0) and packing.plan_bins({1: 20}, 8)[1] == 3
    with pytest.raises(ValueError):
        packing.plan_bins({9: 1}, 8)


def test_word_ids_are_those_of_the_whole_text():
    texts = ["Hello, World. It's 12.5kg!", "", "  ", "Éa é, ñ. ÀÉ, ß.", "a.b,c ... end.", "x" * 300 + ". y", "<|endoftext|> A<|startoftext|>b", "tab\tnew\nline\x0bv\x1cs nbsp\u00a0z", "don't. 'LL. i'm,", "e\u0301. o\u0308,", "1. 2, 3.", "日本。 𝄞."]
    encoder = packing.WordEncoder(vocab_path())
    for t in texts + texts:
        wanted = encoder.tokenizer.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(encoder.ids(t.encode()), "<u4").tolist() == wanted, t


def test_pieces_of_documents(spark):
    texts = [None, "", "a b c", "word " * 100, "the same", "the same"]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(5, "the same", "x"), (None, "q", "x")]
    out = packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string, length string").repartition(3), vocab_path(), capacity=16).collect()
    encoder = packing.WordEncoder(vocab_path())
    wanted = Counter()
    for i, t, _ in rows:
        ids = [*np.frombuffer(encoder.ids((t or "").encode()), "<u4").tolist(), 0]
        for k in range(0, len(ids), 16):
            part = np.array(ids[k : k + 16], "<u4")
            wanted[(i, k // 16, k, len(part), zlib.crc32(part.tobytes()))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out) == wanted
    bins = {}
    for r in out:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 16
    assert len(bins) == -(-sum(r["length"] for r in out) // 16)
    assert packing.pack_documents(spark.createDataFrame([], "doc_id long, text string"), vocab_path()).count() == 0


def test_the_residual_norm_chooses_by_every_capacity():
    # 50 and 45 cost 4525, 50 and 40 cost 4100
    dense = Counter({50: 1, 45: 1, 40: 1})
    plans = [unpack(packing.plan_bins(dense, 100, 2, attention, weights=w)[0]) for attention, w in ((None, (1.0, 0.0, 0.0)), (4200, (1.0, 0.0, 0.0)))]
    assert [sorted(sorted(le for _, le, _ in p) for p in bins.values()) for bins in plans] == [[[40], [45, 50]], [[40, 50], [45]]]
    # before the 20 is placed, the bin of 70 has 30 tokens and 5100 of attention left, that of two 40s has 20 and 6800
    mixed, cap = Counter({70: 1, 40: 2, 20: 1}), {"capacity": 100, "max_docs": 50}
    first, second = (packing.plan_bins(mixed, **cap, weights=w)[0] for w in ((1.0, 0.01, 0.01), (0.0, 0.0, 1.0)))
    place = lambda plan: next(p[3] for p in plan if p[0] == 20)
    assert place(first) == 1 and place(second) == 0


def test_attention_cost_bounds_the_pieces(spark):
    docs = spark.createDataFrame([(1, "word " * 100), (2, "a b c")], "doc_id long, text string")
    out = packing.pack_documents(docs, vocab_path(), capacity=16, max_docs=3, max_attention=150, weights=(1.0, 1.0, 1.0)).collect()
    assert max(r["length"] for r in out) == 12 and sum(r["length"] for r in out if r["doc_id"] == 1) == 101
    bins = {}
    for r in out:
        bins.setdefault(r["sequence_id"], []).append(r["length"])
    assert all(sum(v) <= 16 and len(v) <= 3 and sum(n * n for n in v) <= 150 for v in bins.values())
