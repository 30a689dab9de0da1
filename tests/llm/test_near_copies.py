import numpy as np

from corpus_pipeline import NEAR
from halyard.llm import near_copies


def shingles(text, k=5):
    words = text.split()
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))}


def jaccard(a, b):
    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y)


def components(texts, least=0.8):
    own = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if own[i] != own[j] and jaccard(texts[i], texts[j]) >= least:
                own = [min(own[i], own[j]) if x in (own[i], own[j]) else x for x in own]
    return own


def kept(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, node int")
    out = near_copies.drop_near_copies(docs, **NEAR)
    assert out.columns == docs.columns
    return sorted((r["doc_id"], r["text"]) for r in out.collect())


def variants(rng, n, length, lowest, highest):
    """Pairs of texts that are alike by about the given share."""
    words = [f"w{i}" for i in range(5000)]
    out = []
    while len(out) < n:
        a = list(rng.choice(words, length))
        b = list(a)
        share = rng.uniform(lowest, highest)
        b[: int(length * (1 - share) / (1 + share))] = rng.choice(words, int(length * (1 - share) / (1 + share)))
        if lowest <= jaccard(" ".join(a), " ".join(b)) < highest:
            out.append((" ".join(a), " ".join(b)))
    return out


def test_pairs_below_the_threshold_stay(spark):
    pairs = variants(np.random.default_rng(5), 40, 200, 0.72, 0.795)
    texts = [t for p in pairs for t in p]
    assert len(kept(spark, [(i, t, 1) for i, t in enumerate(texts)])) == len(texts)


def test_parts_of_a_large_group_and_chains(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "PART_SETS", 7)
    rng = np.random.default_rng(6)
    words = [f"w{i}" for i in range(900)]
    text, texts = list(rng.choice(words, 120)), []
    for _ in range(60):
        at = int(rng.integers(110))
        text[at : at + int(rng.integers(1, 12))] = rng.choice(words, int(rng.integers(1, 12)))
        texts.append(" ".join(text))
    own = components(texts)
    assert 1 < len(set(own)) < 60
    links = near_copies.linked([near_copies.shingle_set(t.encode(), 5) for t in texts])
    assert links.tolist() == own
    sets = [near_copies.shingle_set(t.encode(), 5) for t in texts]
    rows = [(1, i, len(s), bytearray(s.tobytes())) for i, s in enumerate(sets)]
    edges = near_copies._alike(spark.createDataFrame(rows, "bunch long, node long, n long, shingles binary"))
    found = {r["node"]: r["component"] for r in near_copies.connected_components(edges).collect()}
    assert [found.get(i, i) for i in range(60)] == own


def test_rows_that_share_a_doc_id_and_copies(spark):
    a, b = "one text of a few words that stands here", "another one that has nothing in common with it at all"
    rows = [(1, a, 1), (1, b, 1), (1, a, 2), (2, a, 1), (3, b + " ", 1), (4, None, 1), (5, "", 1)]
    assert kept(spark, rows) == [(1, b), (1, a), (4, None)] or kept(spark, rows) == sorted([(1, a), (1, b)]) + [(4, None)]


def test_copies_at_the_threshold_go(spark):
    rng = np.random.default_rng(7)
    pairs = variants(rng, 100, 200, 0.8, 0.81)
    for n in range(8, 24):  # n + 4 words in n shingles; the shorter one lacks as many as may differ
        text = " ".join(f"s{n}x{i}" for i in range(n + 4))
        pairs.append((text, " ".join(text.split()[: 4 + -(-n * 4 // 5)])))
    pairs.append(("a b c d e f g h i", "a b c d e f g h"))
    assert all(jaccard(*p) >= 0.8 for p in pairs)
    assert len(kept(spark, [(i, t, 1) for i, t in enumerate(t for p in pairs for t in p)])) <= len(pairs) + 1
