"""The registered queries on whole small tables, against brute force or their SQL."""

import html
import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest
import xxhash

from halyard.llm.queries import ORACLE_SQL, QUERIES, vocab_path

SF = "/root/testdata/sf0.001"


def read(name):
    return pq.read_table(f"{SF}/{name}.parquet").to_pylist()


def run(spark, name):
    return QUERIES[name](spark, SF).collect()


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def test_every_operator_has_a_query():
    assert {re.match(r"op(\d+)_", n)[1] for n in QUERIES} == {str(n) for n in range(1, 14)} and set(ORACLE_SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    result = c.execute(ORACLE_SQL[name])
    cols = sorted(d[0] for d in result.description)
    at = [[d[0] for d in result.description].index(x) for x in cols]
    plain = lambda v: round(v, 9) if isinstance(v, float) else v
    wanted = sorted((tuple(plain(r[k]) for k in at) for r in result.fetchall()), key=repr)
    df = QUERIES[name](spark, SF)
    assert sorted(df.columns) == cols
    assert sorted((tuple(plain(r[x]) for x in cols) for r in df.collect()), key=repr) == wanted


def test_op1(spark):
    docs = {d["doc_id"]: d["text"] for d in read("documents")}
    prints = {}
    for i, text in docs.items():
        w = words(text)
        h = [xxhash.xxh64_intdigest(" ".join(w[k : k + 4]).encode(), 42) for k in range(max(1, len(w) - 3))] if w else []
        prints[i] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    group = {i: i for i in docs}
    for i in sorted(docs):
        for j in sorted(docs):
            if (prints[i] ^ prints[j]).bit_count() <= 4 and group[i] != group[j]:
                low, high = sorted((group[i], group[j]))
                group = {k: low if g == high else g for k, g in group.items()}
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in run(spark, "op1_simhash")}
    assert got == {i: (f"{prints[i]:016x}", group[i]) for i in docs}


def test_op2(spark):
    def article(page):
        inner = re.search(r"<article>(.*?)</article>", page, re.S)[1].replace("<br>", " ")
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]+>", " ", b)).split()) for b in re.split(r"</?(?:p|h\d|li|ul)>", inner)]
        return "\n\n".join(b for b in blocks if b)

    pages = {p["page_id"]: p for p in read("pages")}
    got = run(spark, "op2_html_extraction")
    assert {r["page_id"]: (r["url"], r["text"], r["n_chars"]) for r in got} == {i: (p["url"], t := article(p["html"]), len(t)) for i, p in pages.items()}


def test_op3(spark):
    docs = {d["doc_id"]: d["lang"] for d in read("documents")}
    got = run(spark, "op3_language_id")
    assert len(got) == len(docs) and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r["held_out"]]
    assert np.mean([r["lang_pred"] == docs[r["doc_id"]] for r in held]) >= 0.95


def test_op4(spark):
    norm = lambda t: " " + " ".join((t or "").lower().split()) + " "
    docs, items = read("documents"), read("benchmark")
    wanted = {(d["doc_id"], b["item_id"]) for d in docs for b in items if norm(b["text"]).strip() in norm(d["text"])}
    assert {(r["doc_id"], r["item_id"]) for r in run(spark, "op4_decontamination")} == wanted


def test_op5(spark):
    rows = read("embeddings")
    ids, m = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], dtype=np.float64)
    got = {}
    for r in run(spark, "op5_nearest_neighbours"):
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    hits = 0
    for k in np.flatnonzero(ids % 20 == 0):
        s = m @ m[k]
        best = [int(ids[x]) for x in np.lexsort((ids, -s)) if x != k][:20]
        mine = sorted(got[ids[k]])
        assert [r for r, *_ in mine] == list(range(1, 21)) and all(abs(s[ids == v][0] - x) < 1e-12 for _, v, x in mine)
        hits += len(set(best) & {v for _, v, _ in mine})
    assert hits >= 0.9 * 20 * len(got)


def test_op8(spark):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(vocab_path())
    wanted = {}
    for d in read("documents"):
        ids = [*t.encode(d["text"] or "", add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), 2048):
            part = np.array(ids[k : k + 2048], "<u4")
            wanted[(d["doc_id"], k // 2048)] = (k, len(part), zlib.crc32(part.tobytes()))
    got = run(spark, "op8_packing")
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in got} == wanted
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in bins.values():
        assert sum(n for _, n in parts) <= 2048 and all(o == sum(n for p, n in parts if p < o) for o, _ in parts)
    assert len(bins) <= math.ceil(sum(v[1] for v in wanted.values()) / 2048) + 1


def test_op9(spark):
    docs = {d["doc_id"]: [*words(d["text"]), None] for d in read("documents")}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in docs}
    counts = Counter(t for i, seq in docs.items() if not held[i] for t in seq)
    n, v = sum(counts.values()), len(counts)
    got = run(spark, "op9_lm_scoring")
    assert len(got) == len(docs)
    for r in got:
        seq = docs[r["doc_id"]]
        base = sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in seq)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[r["doc_id"]], len(seq), sum(counts[t] > 0 for t in seq), n)
        assert r["base_score"] == pytest.approx(base, rel=1e-9)
    assert sum(r["score"] for r in got if r["held_out"]) > sum(r["base_score"] for r in got if r["held_out"])
