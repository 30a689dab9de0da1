import random
import re
from collections import Counter, defaultdict

from halyard.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, lang string, source string"


def plain(rows, min_docs=10, top=10):
    """Every kept term of every group, one by one."""
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    seen, groups, of = defaultdict(Counter), set(), defaultdict(Counter)
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        terms = TERM.findall((text or "").translate(low))
        groups.add((lang, source))
        seen[lang, source].update(terms)
        of[lang].update(set(terms))
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in of[lang].items() if n >= min_docs]
        own = sorted(s for x, s in groups if x == lang)
        share = {}
        whole = Counter()
        for s in own:
            whole.update({t: seen[lang, s][t] for t in kept})
        for s in [*own, None]:
            c = whole if s is None else seen[lang, s]
            base = sum(c[t] for t in kept) + 2 * len(kept)
            share[s] = {t: 1 + 10**9 * (c[t] + 2) // base for t in kept}
        f = lambda p, q: (p - q) * (p - q) // (p + q)
        for s in own:
            pairs = sorted(((-sum(f(share[s][t], share[o][t]) for t in kept), o) for o in own if o != s), key=lambda x: (x[0], x[1].encode()))
            terms = [(-f(share[s][t], share[None][t]), t) for t in kept if seen[lang, s][t] and share[s][t] > share[None][t]]
            terms.sort(key=lambda x: (x[0], x[1].encode()))
            for part, found in (("pair", pairs), ("term", terms[:top])):
                out += [(lang, s, part, item, -v, k) for k, (v, item) in enumerate(found, 1)]
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


def test_equals_every_term_of_every_group(spark):
    rng = random.Random(3)
    words = [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(60)] + ["Äpfel", "ÄPFEL", "ſ", "K", "don't", "x1y", "日本"]
    rows = []
    for k in range(400):
        source = rng.choice([*"abcdef", *"a" * 6, None])
        text = " ".join(rng.choice(words[: rng.choice((5, 40, len(words)))]).title() for _ in range(rng.randint(0, 30)))
        rows.append((k % 300, rng.choice([text, text, text.upper(), None]), rng.choice(["en", "en", "en", "de", "", None]), source))
    rows += [rows[5]] * 3 + [(None, "zeta zeta", "en", "only"), (1, "", "en", "empty"), (1, None, "xx", "alone"), (2, "a", "yy", "p"), (3, "b", "yy", "q")]
    got = rows_of(divergence.audit(spark.createDataFrame(rows, SCHEMA)))
    assert got == plain(rows)
    assert {r[5] for r in got if r[:3] == ("yy", "p", "pair")} == {1} and [r[4] for r in got if r[:3] == ("yy", "p", "pair")] == [0]


def test_odd_tables(spark):
    assert rows_of(divergence.audit(spark.createDataFrame([], SCHEMA))) == []
    rows = [(k, "same words here " * 2000, "en", f"s{k % 3}") for k in range(30)]
    clash = spark.createDataFrame([(*r, 1, "v", 2, 3) for r in rows], SCHEMA + ", n int, item string, value int, rank int")
    assert rows_of(divergence.audit(clash)) == plain(rows)
    assert not [r for r in plain(rows) if r[4]]  # sources alike: no distance, ties go by item


def test_groups_beyond_the_broadcast_and_a_small_buffer(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(k, " ".join(rng.choice("abcdefghij") for _ in range(20)), "en", f"s{rng.randrange(12)}") for k in range(200)]
    monkeypatch.setattr(divergence, "BROADCAST_GROUPS", 0)
    monkeypatch.setattr(divergence, "HELD_ENTRIES", 5)
    assert rows_of(divergence.audit(spark.createDataFrame(rows, SCHEMA))) == plain(rows)


def test_shares_of_counts_beyond_64_bits(spark):
    big = spark.sql("SELECT 30000000000000L AS c, 90000000000000L AS t, 100L AS v")
    got = big.select(divergence.share(big.c, big.t, big.v).alias("p")).first().p
    assert got == 1 + 10**9 * (30000000000000 + 2) // (90000000000000 + 200)
