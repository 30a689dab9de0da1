import numpy as np
from pyspark.sql import functions as F

from halyard.llm import langid


def test_gradients_by_differences():
    rng = np.random.default_rng(0)
    model = langid.new_model(["a", "b", "c"], 4, rng)
    for k, p in enumerate(model.parameters()):
        p[...] = p
    x = rng.integers(0, 256, (6, 5)).astype(np.uint8)
    mask = (np.arange(6)[:, None] < np.array([6, 6, 3, 1, 5])).astype(np.float32)
    y = np.array([0, 1, 2, 1, 0])
    _, grads = langid.gradients(model, x, mask, y)
    for p, g in zip(model.parameters(), grads, strict=True):
        flat = np.flatnonzero(np.abs(g.ravel()) > 1e-4)[:6]
        for k in flat:
            old = p.ravel()[k]
            step = 1e-2
            p.ravel()[k] = old + step
            up = langid.gradients(model, x, mask, y)[0]
            p.ravel()[k] = old - step
            down = langid.gradients(model, x, mask, y)[0]
            p.ravel()[k] = old
            assert abs((up - down) / (2 * step) - g.ravel()[k]) < 2e-3


def test_segments_give_what_whole_lanes_do():
    rng = np.random.default_rng(1)
    model = langid.new_model(["a", "b"], 4, rng)
    texts = [rng.integers(0, 256, n).astype(np.uint8).tobytes() for n in (0, 1, 127, 128, 129, 700)]
    got = langid.document_probabilities(model, texts)
    for t, row in zip(texts, got, strict=True):
        total = np.zeros(2)
        for a in range(0, len(t), langid.SEGMENT):
            x, mask = langid.padded([t[a : a + langid.SEGMENT]], len(t[a : a + langid.SEGMENT]))
            total += langid.probabilities(model, x, mask).sum(axis=(0, 1))
        assert np.allclose(row, total / max(1, len(t)), atol=1e-4)


def rows(n=160):
    rng = np.random.default_rng(2)
    words = {"en": "the and of that with this from are".split(), "de": "der die und nicht für über ein größe".split()}
    out = []
    for i in range(n):
        lang = "en" if i % 2 else "de"
        out.append((i, " ".join(rng.choice(words[lang], 30)), lang, "src", 0.5))
    return out


def test_held_out_accuracy_and_odd_rows(spark):
    data = rows() + [(1000, None, "en", "s", 0.1), (1001, "", None, "s", 0.1), (1002, "123 456 !!", "en", "s", 0.1), (1003, "the and of this " * 20_000, None, "s", 0.1), (3, "x", "en", "s", 0.1), (None, "und nicht der", None, "s", 0.1)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, score double")
    out = langid.predict(docs, steps=120).collect()
    assert len(out) == len(data)
    truth = {i: lang for i, _, lang, *_ in rows()}
    held = [r for r in out if r["held_out"] and r["doc_id"] in truth and r["doc_id"] != 3]
    assert len(held) > 10 and all(r["lang_pred"] == truth[r["doc_id"]] for r in held)
    by = {r["doc_id"]: r for r in out}
    assert all(by[k]["lang_pred"] == "und" and by[k]["score"] == 0 for k in (1000, 1001, 1002)) and by[1003]["lang_pred"] == "en"
    assert all(0 <= r["score"] <= 1 for r in out)
    kept = langid.keep_identified(docs, steps=120)
    assert kept.columns == docs.columns and {1000, 1001, 1002}.isdisjoint(r["doc_id"] for r in kept.collect())
    assert kept.filter("doc_id is null").count() == 1


def test_no_labels_one_label_and_empty(spark):
    schema = "doc_id long, text string, lang string"
    none = langid.predict(spark.createDataFrame([(1, "abc", None)], schema)).first()
    assert none["lang_pred"] == "und" and none["score"] == 0
    one = langid.predict(spark.createDataFrame([(1, "abc", "en"), (2, "12", "en"), (3, "x", "en")], schema)).collect()
    assert [r["lang_pred"] for r in sorted(one, key=lambda r: r["doc_id"])] == ["en", "und", "en"]
    assert langid.predict(spark.createDataFrame([], schema)).count() == 0


def test_sample_is_bounded(spark):
    many = spark.range(4000).selectExpr("7L as doc_id", "concat('text ', id) as text", "if(id % 4 = 0, 'a', 'b') as lang", "'c' as w", "1 as h")
    same = spark.range(3000).selectExpr("9L as doc_id", "'all the same' as text", "'a' as lang", "'c' as w", "1 as h")
    taken = langid.sample_windows(many.unionByName(same), docs_per_label=50)
    counts = {k: sum(lang == k for lang, _ in taken) for k in ("a", "b")}
    assert 0 < counts["a"] <= 200 and counts["b"] == 200
    assert sum(w == b"all the same" for _, w in taken) in (0, 4)
    assert taken == langid.sample_windows(many.unionByName(same), docs_per_label=50)


def test_a_language_of_rows_that_repeat_is_learned(spark):
    few = spark.range(40).selectExpr("id AS doc_id", "concat('zu pa li ', id % 7, ' ko mu ta zu li') AS text", "'xx' AS lang")
    few = few.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(2000)))).drop("k")
    more = spark.range(3000).selectExpr("1000 + id AS doc_id", "concat('the and of that ', id, ' with this') AS text", "'yy' AS lang")
    docs = few.unionByName(more)
    taken = langid.sample_windows(docs, docs_per_label=100)
    assert sum(lang == "xx" for lang, _ in taken) == 160 and sum(lang == "yy" for lang, _ in taken) == 400
    got = langid.predict(docs, steps=120).dropDuplicates(["doc_id", "lang_pred"]).collect()
    assert {(r["doc_id"] < 1000, r["lang_pred"]) for r in got} == {(True, "xx"), (False, "yy")}
