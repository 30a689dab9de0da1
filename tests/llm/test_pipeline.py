import numpy as np

import corpus_pipeline as P
from halyard.llm import packing
from halyard.llm.common import fresh_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node int, key string"
ITEM = "which of the seven lamps in the long hall is lit when the third bell rings at noon"


def rows():
    rng = np.random.default_rng(4)
    words = {"en": [f"{a}{b}th" for a in "bcdfgh" for b in "aeiou"] + ["the", "and"], "de": [f"{a}{b}ü" for a in "klmnrs" for b in "aeiou"] + ["und", "für"]}
    out, fate = [], {}
    for i in range(0, 90, 3):
        lang = "en" if i % 2 else "de"
        text = list(rng.choice(words[lang], 250))
        out.append((i, " ".join(text)))
        fate[i] = "stays"
        if i % 9 == 0:
            out.append((i + 1, " ".join(text)))
            fate[i + 1] = "copy"
        if i % 9 == 3:
            text[120] = "other"
            out.append((i + 1, " ".join(text)))
            fate[i + 1] = "near copy"
        if i % 9 == 6:
            text[100:100] = ITEM.split()
            out.append((i + 2, " ".join(rng.choice(words[lang], 200)) + " " + ITEM))
            fate[i + 2] = "leak"
    out += [(500, None), (501, ""), (502, "12 34 !!"), (0, out[0][1])]
    fate |= {500: "no letter", 501: "no letter", 502: "no letter"}
    table = [(i, t, "en" if i % 2 else "de", "s", None, 1, "k") for i, t in out]
    return table, fate


def test_fates_of_documents(spark, monkeypatch):
    table, fate = rows()
    docs = spark.createDataFrame(table, SCHEMA)
    folder = fresh_path(spark, "pipeline-test")
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, ITEM), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    assert [n for n, _ in P.STAGES] == ["language_id", "near_dedup", "decontamination", "packing"] and P.ORACLE_SQL is None
    for _, stage in P.STAGES[:-1]:
        before = docs
        docs = stage(spark, docs, folder)
        assert docs.columns == before.columns
        path = fresh_path(spark, "stage")
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
    kept = [r["doc_id"] for r in docs.collect()]
    assert sorted(kept) == sorted(i for i, f in fate.items() if f == "stays")
    encoder, texts = packing.WordEncoder(P.vocab_path()), dict((i, t) for i, t, *_ in table)
    out = P.run(spark, folder).collect()
    lengths = {}
    for r in out:
        lengths[r["doc_id"]] = lengths.get(r["doc_id"], 0) + r["length"]
    assert lengths == {i: len(encoder.ids(texts[i].encode())) // 4 + 1 for i in kept}


def test_stages_on_nothing_and_on_nulls(spark):
    folder = fresh_path(spark, "pipeline-empty")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    for data in ([], [(None,) * 7] * 3):
        docs = spark.createDataFrame(data, SCHEMA)
        for _, stage in P.STAGES:
            assert stage(spark, docs, folder).count() == (0 if not data or stage is P.identify_language else len(data))


def test_rows_without_doc_id_and_columns_that_clash(spark):
    table, _ = rows()
    text, leak = table[0][1], " ".join(f"w{k} x{k}" for k in range(200)) + " " + ITEM
    docs = spark.createDataFrame([(0, text, 5, 7), (None, text, 6, 8), (None, "alone " + text[:400], 1, 1), (None, "alone " + text[:400], 2, 2), (None, leak, 3, 3)], "doc_id long, text string, _version int, near_copies_key int")
    folder = fresh_path(spark, "pipeline-ids")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    kept = P.drop_near_duplicates(spark, docs, folder)
    assert kept.columns == docs.columns
    assert sorted((str(r["doc_id"]), r["text"] == leak, r["_version"] == 5) for r in kept.collect()) == [("0", False, True), ("None", False, False), ("None", True, False)]
    assert sorted((str(r["doc_id"]), r["text"] == leak) for r in P.decontaminate(spark, kept, folder).collect()) == [("0", False), ("None", False)]
