import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from halyard.llm import simhash
from halyard.llm.components import connected_components

TEXTS = [
    None, "", "  \t", "one", "One two", "one two three four", "the quick brown fox jumps over the lazy dog again and again",
    "the quick brown fox jumps over the lazy dog again and again", "É é ß ñ Ä\x0bword \x85 next\x1cstill one two",
]


def brute_print(text, k=4):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    shingles = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints, radius):
    ids = sorted(prints)
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in ids:
        for j in ids:
            if i < j and bin(prints[i] ^ prints[j]).count("1") <= radius:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


@settings(max_examples=60, deadline=None)
@given(st.one_of(st.none(), st.text(max_size=80), st.lists(st.sampled_from(["a", "B", "é", "word", "\n"]), max_size=40).map(" ".join)))
def test_fingerprint_of_any_text(text):
    assert simhash.signature((text or "").encode("utf-8", "replace"), 4)[0] == brute_print((text or "").encode("utf-8", "replace").decode())


def test_long_text_in_chunks(monkeypatch):
    text = " ".join(str(i * i % 97) for i in range(1000))
    whole = simhash.signature(text.encode(), 4)
    monkeypatch.setattr(simhash, "CHUNK", 64)
    assert simhash.signature(text.encode(), 4) == whole == [brute_print(text)]


@pytest.mark.parametrize("radius", [0, 3, 4, 14])
def test_bit_sliced_distances(radius):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    words = np.concatenate([base, base ^ (np.uint64(1) << rng.integers(0, 64, 40).astype(np.uint64)), base ^ np.uint64(0x1F)])
    rng.shuffle(words)
    planes, n = simhash.planes_of(words), len(words)
    for lag in (1, 2, 17, n - 1):
        found = simhash.within(planes, lag, (1 << (n - lag)) - 1, radius)
        wanted = np.bitwise_count(words[:-lag] ^ words[lag:]) <= radius
        assert [found >> i & 1 for i in range(n - lag)] == wanted.astype(int).tolist()


def test_links_of_planted_fingerprints(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BUCKET", 8)  # so that large buckets are dealt as pairs of parts
    rng = np.random.default_rng(5)
    centre = int(rng.integers(0, 2**62))
    prints = {}
    for i in range(120):  # a dense cluster, chains and lone ones
        flips = rng.choice(64, size=int(rng.integers(0, 4)), replace=False)
        value = centre if i < 60 else int(rng.integers(0, 2**62))
        for f in flips:
            value ^= 1 << int(f)
        prints[i] = value
    for i in range(120, 140):
        prints[i] = prints[i - 1] ^ (0b1111 << (3 * (i - 120)))
    signed = [(i, v - 2**64 if v >= 2**63 else v) for i, v in prints.items()]
    distinct = {}
    for i, v in signed:
        distinct.setdefault(v, i)
    sigs = spark.createDataFrame([(i, v) for v, i in distinct.items()], "node long, f0 long")
    found = {r["node"]: r["component"] for r in connected_components(simhash.link_signatures(sigs)).collect()}
    wanted = brute_components({i: prints[i] for i in distinct.values()}, 4)
    assert {i: found.get(i, i) for i in distinct.values()} == wanted


def test_documents_with_nulls_repeats_and_clashing_columns(spark):
    rows = [(i, t, "x", 1, "c") for i, t in enumerate(TEXTS)] + [(3, "one", "x", 1, "c"), (None, "lone text of its own kind here", "x", 1, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string, node int, component string")
    found = simhash.near_duplicates(docs).collect()
    assert len(found) == len(rows)
    prints = {i: brute_print(t) for i, t in enumerate(TEXTS)}
    wanted = brute_components(prints, 4)
    assert {r["doc_id"]: r["component_id"] for r in found if r["doc_id"] is not None} == wanted
    assert {r["doc_id"]: r["f0"] % 2**64 for r in found if r["doc_id"] is not None} == prints


def test_rows_without_or_with_repeated_ids_link_others(spark):
    rng = np.random.default_rng(11)
    base = [f"w{i}" for i in rng.integers(0, 500, 300)]
    prints, texts = {}, [" ".join(base)]
    for _ in range(400):  # texts a, m, b: m near both, a and b apart
        words = list(base)
        for at in rng.integers(0, 300, int(rng.integers(1, 12))):
            words[at] = "other%d" % rng.integers(9)
        texts.append(" ".join(words))
    prints = [brute_print(t) for t in texts]
    near = lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 4
    a, m, b = next((i, j, k) for i in range(400) for j in range(400) if i != j and near(i, j) for k in range(i) if near(j, k) and not near(i, k))
    for middle in (None, 5, 9):
        rows = [(5, texts[a]), (middle, texts[m]), (9, texts[b]), (5, "a text of quite another kind, alone")]
        found = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        of = {(r["doc_id"], r["f0"] % 2**64): r["component_id"] for r in found}
        assert of == {(5, prints[a]): 5, (middle, prints[m]): 5, (9, prints[b]): 5, (5, brute_print(rows[3][1])): 5}


@pytest.mark.parametrize("n", [0, 10, 10**6, 10**9, 10**13])
def test_key_shapes_meet_every_pair(n):
    blocks, agree = simhash.key_shape(n, 4)
    assert blocks - agree == 4 and 64 * agree // blocks >= min(32, n.bit_length() - 4)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(docs).collect() == []


def test_components(spark):
    edges = [(5, 4), (4, 3), (3, 2), (2, 1), (10, 11), (11, 12), (7, 7), (4, 5), (20, 30), (30, 25)]
    found = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 10: 10, 11: 10, 12: 10, 20: 20, 25: 20, 30: 20}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_copies_of_longer_signatures(spark):
    from corpus_pipeline import NEAR

    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in range(3000)]
    rows, groups = [], {}
    for d in range(40):
        text = list(rng.choice(words, 400))
        rows.append((3 * d, " ".join(text)))
        text[int(rng.integers(400))] = "changed"
        rows.append((3 * d + 1, " ".join(text)))
        rows.append((3 * d + 2, " ".join(rng.choice(words, 400))))
        groups |= {3 * d: 3 * d, 3 * d + 1: 3 * d, 3 * d + 2: 3 * d + 2}
    how = dict(NEAR)
    prints = simhash.fingerprints(spark.createDataFrame(rows, "doc_id long, text string"), how.pop("k"), how["words"])
    found = {r["node"]: r["component"] for r in connected_components(simhash.link_signatures(prints.withColumnRenamed("doc_id", "node"), **how)).collect()}
    assert {i: found.get(i, i) for i in groups} == groups
