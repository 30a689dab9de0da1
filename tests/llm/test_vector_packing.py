import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from halyard.llm import vector_packing as vp
from halyard.llm.queries import QUERIES, vocab_path

PATH = vocab_path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def ids_of(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


def test_ids_are_the_tokenizers(tokenizer):
    rng, encoder = random.Random(2), vp.ByteEncoder(PATH)
    parts = ["a", "B", "é", " ", " ", "\n", ".", ",", "'s", "'ll", "1", "23", "日", "\t", "<|endoftext|>", "<|", "-", "_", "\x00", "\x1c", "'", "\U0001f600", " ", "  ", "x" * 60]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert np.frombuffer(encoder.ids([text])[0], "<u4").tolist() == ids_of(tokenizer, text), text


def drained(pool):
    out = [pool.sequences()]
    return [[(pool.named[k][0], s, n, loss) for k, s, n, loss in pieces] for pieces in out[0]]


@pytest.mark.parametrize("limits", [(64, 5, 40), (64, 64, 64), (32, 2, 10), (16, 1, 16), (64, 3, 1)])
def test_limits_hold_and_nothing_is_padded(limits):
    rng = random.Random(sum(limits))
    pool, sizes, context = vp.Pool(*limits, (1.0, 0.1, 1.0)), {}, {}
    for k in range(300):
        sizes[k] = rng.choice((1, 2, 5, 30, 64, 65, rng.randint(1, 300)))
        context[k] = rng.choice((0, 1, sizes[k] // 2, sizes[k] - 1, sizes[k] + 5))
        pool.add(k, b"\0" * 4 * sizes[k], context[k])
    seen, bound = defaultdict(list), [0, 0, 0]
    for pieces in drained(pool):
        used = [sum(p[2] for p in pieces), len(pieces), sum(p[3] for p in pieces)]
        assert all(u <= m for u, m in zip(used, limits, strict=True)) and used[0] & (used[0] - 1) == 0 and used[0]
        bound = [b + (u == m) for b, u, m in zip(bound, used, limits, strict=True)]
        for k, s, n, loss in pieces:
            assert n and loss == max(0, min(n, s + n - context[k]))
            seen[k].append((s, n))
    for k, spans in seen.items():
        at = 0
        for s, n in sorted(spans):
            assert s == at
            at += n
        assert at == sizes[k]
    assert set(seen) == set(sizes) and (limits != (64, 5, 40) or all(bound))


def test_the_dot_product_chooses():
    pool = vp.Pool(64, 8, 32, (1.0, 0.1, 1.0))
    for name, n, context in (("much loss", 30, 0), ("little loss", 30, 28), ("long", 40, 10)):
        pool.add(name, b"\0" * 4 * n, context)
    # 40 tokens with 30 of loss weigh most; then only what needs 24 tokens and 2 of loss at most fits, cut from the example without loss
    assert drained(pool)[0] == [("long", 0, 40, 30), ("little loss", 0, 24, 0)]


def test_op13(spark, tokenizer):
    import pyarrow.parquet as pq

    docs = {d["doc_id"]: d["text"] for d in pq.read_table("/root/testdata/sf0.001/documents.parquet").to_pylist()}
    rows = QUERIES["op13_packing"](spark, "/root/testdata/sf0.001").collect()
    check(rows, {(k, 0): v for k, v in docs.items()}, tokenizer)


def check(rows, texts, tokenizer, copies=None):
    """Each id lies in one piece, sequences are gapless and not padded, and as few as the tokens ask for but for short ones at the end."""
    seqs, spans, total = defaultdict(list), defaultdict(list), 0
    ids = {k: ids_of(tokenizer, v) + [1] for k, v in texts.items()}
    for r in rows:
        seqs[r.sequence_id].append((r.offset, r.length))
        spans[r.doc_id].append(r)
    for pieces in seqs.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= 2048 and at & (at - 1) == 0 and len(pieces) <= 16
    for doc_id in {k[0] for k in ids}:
        own = sorted((i for k, i in ids.items() if k[0] == doc_id), key=len)
        total += sum(map(len, own))
        if len(own) > 1:  # rows that share an id: told apart by their length alone, so only counted
            assert sum(r.length for r in spans[doc_id]) == sum(map(len, own))
            continue
        at = 0
        for r in sorted(spans[doc_id], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(own[0])
            assert r.ids_crc32 == zlib.crc32(np.array(own[0][at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(own[0])
    assert set(spans) == {k[0] for k in ids} and len(seqs) <= total // 2048 + 12 * max(1, len({s >> vp.SEQUENCE_BITS for s in seqs}))


def test_odd_documents(spark, tokenizer, monkeypatch):
    monkeypatch.setattr(vp, "POOL_EXAMPLES", 20)
    rows = [(k, "word " * (k % 7) + "end") for k in range(100)]
    rows += [(200, None), (201, ""), (None, "no id"), (202, "  two  blanks\n\n"), (203, "ab cd\n" * 20_000), (204, "<|endoftext|>"), (5, "again"), (5, "again"), (205, "y" * 5000)]
    texts, seen = {}, defaultdict(int)
    for k, t in rows:
        texts[k, seen[k]] = t
        seen[k] += 1
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, start int, sequence_id string")
    check(vp.pack_examples(df, PATH).collect(), texts, tokenizer)
    assert vp.pack_examples(df.limit(0), PATH).collect() == []


def test_prompts_bear_no_loss(spark, tokenizer):
    rows = [(k, "yes it is " * (k % 5), "is it so? " * (k % 9) if k % 4 else None) for k in range(120)]
    got = vp.pack_examples(spark.createDataFrame(rows, "doc_id long, text string, prompt string"), PATH, 256, 8, 40).collect()
    loss, used = defaultdict(int), defaultdict(lambda: [0, 0, 0])
    for r in got:
        loss[r.doc_id] += r.loss_tokens
        for k, v in enumerate((r.length, 1, r.loss_tokens)):
            used[r.sequence_id][k] += v
    assert dict(loss) == {k: len(ids_of(tokenizer, t)) + 1 for k, t, _ in rows}
    assert all(a <= 256 and b <= 8 and c <= 40 for a, b, c in used.values()) and 20 < max(c for *_, c in used.values())
