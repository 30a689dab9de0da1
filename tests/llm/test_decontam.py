import numpy as np

from halyard.llm import decontam

ITEMS = [
    (1, "Alice Brown has 12 apples and gives 5 kg of them to her friend Bob. How many apples does Alice Brown keep?"),
    (2, "the river runs past the old mill and then under the stone bridge toward the sea"),
    (3, "short one here"),
    (4, None),
    (5, "hi"),
]
FILL = "nothing to see in this part of the text , only words that stand around "


def found(spark, docs, items=ITEMS, **how):
    d = spark.createDataFrame(docs, "doc_id long, text string, item_id string")
    out = decontam.find_contaminated(d, spark.createDataFrame(items, "item_id long, text string"), **how)
    return {(r["doc_id"], r["item_id"]) for r in out.collect()}


def test_exact_changed_and_inconsistent_slots(spark):
    swapped = "Carol Smith has 37 apples and gives 8 kg of them to her friend Dave. How many apples does Carol Smith keep?"
    broken = "Carol Smith has 37 apples and gives 8 kg of them to her friend Dave. How many apples does Erin Jones keep?"
    docs = [
        (10, FILL + ITEMS[0][1] + " " + FILL, "x"), (11, FILL + swapped + " " + FILL, "x"), (12, FILL + broken, "x"), (13, FILL, "x"), (14, None, "x"), (15, "", "x"),
        (16, FILL + ITEMS[1][1].upper() + ".", "x"), (17, FILL + "the river runs past the old mill " + FILL + " under the stone bridge toward the sea", "x"),
        (18, FILL * 3000 + ITEMS[1][1] + FILL, "x"), (19, "short one here", "x"), (20, "hi", "x"), (None, ITEMS[1][1], "x"), (16, ITEMS[1][1], "x"),
    ]
    assert found(spark, docs) == {(10, 1), (11, 1), (16, 2), (18, 2), (19, 3)}


def test_parts_of_a_large_benchmark(spark, monkeypatch):
    docs = [(10, FILL + ITEMS[0][1], "x"), (16, ITEMS[1][1], "x")]
    monkeypatch.setattr(decontam, "PART_WORDS", 10)
    assert found(spark, docs) == {(10, 1), (16, 2)}


def test_against_all_windows(spark):
    rng = np.random.default_rng(8)
    words = [f"word{i}" for i in range(300)]
    items = [(i, " ".join(rng.choice(words, int(rng.integers(9, 40))))) for i in range(20)]
    docs = []
    for d in range(60):
        text = list(rng.choice(words, 80))
        if d % 3 == 0:
            item = items[int(rng.integers(20))][1].split()
            cut = int(len(item) * rng.choice([0.5, 1.0]))
            text[40:40] = item[:cut]
        docs.append((d, " ".join(text), "x"))
    grams = lambda t: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)}
    wanted = {(d, i) for d, t, _ in docs for i, b in items if len(grams(t) & grams(b)) >= 0.8 * len(grams(b))}
    assert wanted and found(spark, docs, items) == wanted


def test_drop_keeps_the_rest(spark):
    docs = spark.createDataFrame([(1, ITEMS[1][1], "a"), (2, FILL, "b"), (None, ITEMS[1][1], "c"), (2, FILL, "b")], "doc_id long, text string, item_id string")
    kept = decontam.drop_contaminated(docs, spark.createDataFrame(ITEMS, "item_id long, text string"))
    assert kept.columns == docs.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == ["2", "2", "None"]


def test_empty_tables(spark):
    assert found(spark, []) == set() and found(spark, [(1, FILL, "x")], []) == set()


def test_single_names_at_sentence_starts(spark):
    items = [(1, "Tom has 5 apples. Tom gives 2 to Mary. How many apples does Tom have left?")]
    other = "Anna has 7 apples. Anna gives 3 to Peter. How many apples does Anna have left?"
    broken = "Anna has 7 apples. Paul gives 3 to Peter. How many apples does Olga have left?"
    docs = [(1, FILL + ". " + other, "x"), (2, "He met Smith. " + other + " " + FILL, "x"), (3, broken, "x"), (4, FILL + items[0][1], "x")]
    assert found(spark, docs, items) == {(1, 1), (2, 1), (4, 1)}


def test_attached_units_and_spelled_numbers(spark):
    items = [
        (1, "A 5km run takes 30min for Ann. If she runs 10km at the same pace then how long does the run take her?"),
        (2, "the baker puts five trays with twenty-four rolls each into the oven and sells two hundred rolls before the shop closes"),
    ]
    docs = [
        (1, FILL + items[0][1].replace("5km", "7 km").replace("30min", "45min").replace("10km", "21km"), "x"),
        (2, FILL + items[1][1].replace("five", "7").replace("twenty-four", "thirty").replace("two hundred", "150"), "x"),
    ]
    assert found(spark, docs, items) == {(1, 1), (2, 2)}


def test_items_of_numbers_match_as_they_are(spark):
    items = [(1, "Compute 12 + 7 - 5 * 3"), (2, "12 7 9 4 5 6 1"), (3, "two 15 three")]
    docs = [
        (1, FILL + items[0][1] + " " + FILL, "x"), (2, FILL + "compute 12 + 8 - 5 * 3", "x"), (3, FILL + "compute 12 + 7 * 5 - 3", "x"),
        (4, FILL + items[1][1] + ".", "x"), (5, FILL + "12 7 9 4 8 6 1", "x"), (6, FILL + items[2][1], "x"), (7, "two 16 three", "x"),
    ]
    assert found(spark, docs, items) == {(1, 1), (4, 2), (6, 3)}


def test_null_and_repeated_item_ids(spark):
    first, second, third = (f"the quick {w} fox jumps over the lazy {w} dog near the {w} river bank" for w in ("brown", "green", "yellow"))
    items = [(None, first), (-1, second), (5, "an item of one id with another text that no document holds"), (5, third), (5, third)]
    docs = [(1, FILL + first, "x"), (2, FILL + second, "x"), (3, third, "x")]
    assert found(spark, docs, items) == {(1, None), (2, -1), (3, 5)}


def test_words_are_rows_of_arrays(monkeypatch):
    made = decontam.Templates()
    value, kind, at = made.arrays("Run 5km now, 5km 3 mi")
    assert at.tolist() == [0, 1, 1, 2, 3, 3, 4, 5] and (value[1], value[2]) == (value[4], value[5]) and kind[1] & 1 and kind[2] & 2
    assert isinstance(made.known["now,"], int) and made.known.rows == 6
    monkeypatch.setattr(decontam, "KNOWN_WORDS", 3)
    for text in ("a b c d e 7kg", " ".join(map(str, range(3000))), "", "a 7kg"):
        fresh = decontam.Templates().arrays(text)
        assert all((x == y).all() for x, y in zip(made.arrays(text), fresh, strict=True))
