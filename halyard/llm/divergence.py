"""Audit of how far the sources of a language diverge from each other in their words.

Every (lang, source) group has a smoothed share p of each kept term, scaled to
whole numbers, and two groups differ by the sum of f = (p - q)^2 / (p + q) over
all kept terms. Most terms are missing from most groups, and a missing term's
share is one constant z of its group. So the sum over all V terms is taken over
the supports by inclusion and exclusion:

* V - |A| - |B| terms count as missing on both sides: a constant each;
* each side's terms count as missing on the other: priced from the histogram of
  the side's counts, as p depends on the count alone;
* terms of both sides were priced twice and subtracted twice: a join of the
  postings on the term puts their true value in the place of both prices.

Words are counted in Arrow batches per task and leave it summed per (lang,
source, term), so a common word or a hot source is a row per task and source.
Postings meet by term, of which a term has one per source; pairs are summed in
the tasks before they are shuffled.

Defined results
    null text, lang or source: '' (and '' is a lang and a source like others);
    repeated rows and repeated or null doc_ids: each row is a document; a
    group without kept terms: count 0 everywhere; a language without kept terms:
    its pairs have value 0; a language with one source: no pairs; empty table:
    no rows; ties: by item; very long texts: whole; further columns, also those
    named like the result's: left out.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed

#: Documents of a language that a kept term occurs in at least; what is added to every count; what shares are scaled to.
MIN_DOCS, SMOOTH, SCALE = 10, 2, 1_000_000_000
TOP_TERMS = 10
#: Distinct (group, term) entries that a task holds before it hands them on.
HELD_ENTRIES = 400_000
#: Groups up to this number are broadcast (some 100 bytes each); more meet the postings by shuffle.
BROADCAST_GROUPS = 50_000
COUNTED = "lang string, source string, term binary, n long, docs long"

#: What a byte of a text becomes: letters and bytes of longer characters stay, A to Z are lowered, the rest parts terms.
BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def count_terms(docs: DataFrame) -> DataFrame:
    """Occurrences of and documents with each term, by lang and source, summed within the tasks."""

    def count(batches):
        held: dict[tuple, tuple[Counter, Counter]] = {}

        def rows():
            for (lang, source), (n, of) in held.items():
                terms = list(n)
                k = len(terms)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([lang] * k, pa.string()), pa.array([source] * k, pa.string()), pa.array(terms, pa.binary()),
                        pa.array(list(n.values()), pa.int64()), pa.array([of[t] for t in terms], pa.int64()),
                    ],
                    ["lang", "source", "term", "n", "docs"],
                )
            held.clear()

        for batch in batches:
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                terms = text.as_py().translate(BYTES).split()
                n, of = held.get((lang, source)) or held.setdefault((lang, source), (Counter(), Counter()))
                n.update(terms)
                of.update(set(terms))
            if sum(len(n) for n, _ in held.values()) > HELD_ENTRIES:
                yield from rows()
        yield from rows()

    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text")
    return docs.select(_named("lang"), _named("source"), text).mapInArrow(count, COUNTED)


def _named(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit("")).alias(column)


def share(count: Column | int, total: Column, kept: Column) -> Column:
    """1 + floor(SCALE * (count + 2) / (N + 2 V)), in decimals, so that no count overflows; null where V is 0."""
    c = (F.lit(count) if isinstance(count, int) else count).cast("decimal(20,0)")
    base = (total + SMOOTH * kept).cast("decimal(20,0)")
    scaled = (F.lit(SCALE).cast("decimal(11,0)") * (c + F.lit(SMOOTH))).cast("decimal(32,0)")
    return F.when(kept > 0, F.call_function("div", scaled, base) + F.lit(1))


def gap(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)); shares are below 2^31, so nothing overflows."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def keep_terms(counted: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """Postings lang, term, source, n of the kept terms, with the language's count and whether it is the term's first posting."""
    by = Window.partitionBy("lang", "term")
    # dealt by (lang, term) once: sums and windows keep to it
    summed = counted.repartition(F.col("lang"), F.col("term")).groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    known = summed.select(
        "lang", F.col("term").cast("string").alias("term"), "source", "n", F.sum("n").over(by).alias("lang_n"),
        F.sum("docs").over(by).alias("lang_docs"), (F.min("source").over(by) == F.col("source")).alias("leads"),
    )
    return known.filter(F.col("lang_docs") >= min_docs).drop("lang_docs")


def describe_groups(docs: DataFrame, postings: DataFrame) -> DataFrame:
    """lang, source, total (N), terms (the support's size), kept (V), lang_total and zero (a missing term's share) of every group."""
    groups = docs.select(_named("lang"), _named("source")).distinct()
    sums = postings.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("terms"), F.count_if("leads").alias("leads"))
    # languages are summed from groups, not from postings: a language may hold most of the rows
    langs = sums.groupBy("lang").agg(F.sum("leads").alias("kept"), F.sum("total").alias("lang_total"))
    zero = F.lit(0).cast("long")
    out = groups.join(sums.drop("leads"), ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["total", "terms", "kept", "lang_total"])
    return out.withColumn("zero", F.coalesce(share(0, F.col("total"), F.col("kept")), zero))


def pair_groups(groups: DataFrame) -> DataFrame:
    """Each two groups of a language, a before b in the order of their names; dealt by language and salt, so that one language is many tasks."""
    salts = max(1, int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    side = lambda s: [F.col(c).alias(f"{s}_{c}") for c in ("source", "total", "terms", "zero")]
    a = groups.select("lang", "kept", *side("a"), F.pmod(F.xxhash64("source"), F.lit(salts)).alias("salt"))
    b = groups.select("lang", *side("b"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).alias("salt"))
    return a.join(b, ["lang", "salt"]).filter("a_source < b_source").drop("salt")


def divergences(postings: DataFrame, groups: DataFrame, known: DataFrame) -> DataFrame:
    """lang, a, b, value: the sum of f over all kept terms for every two groups of a language. known: postings with p and zero."""
    pairs = pair_groups(groups)
    both_zero = F.when(F.col("kept") > 0, (F.col("kept") - F.col("a_terms") - F.col("b_terms")) * gap(F.col("a_zero"), F.col("b_zero"))).otherwise(0)
    constants = pairs.select("lang", F.col("a_source").alias("a"), F.col("b_source").alias("b"), both_zero.cast("long").alias("value"))

    histogram = known.groupBy("lang", "source", "p").agg(F.count("*").alias("n"))
    sides = pairs.select("lang", "a_source", "b_source", "a_zero", "b_zero").withColumn(
        "side", F.explode(F.array(F.struct(F.col("a_source").alias("source"), F.col("b_zero").alias("other")), F.struct(F.col("b_source").alias("source"), F.col("a_zero").alias("other"))))
    )
    sides = sides.select("lang", F.col("a_source").alias("a"), F.col("b_source").alias("b"), "side.source", "side.other")
    one_sided = histogram.join(sides, ["lang", "source"]).select("lang", "a", "b", (F.col("n") * gap(F.col("p"), F.col("other"))).alias("value"))

    side = lambda s: known.select("lang", "term", F.col("source").alias(s), F.col("p").alias(f"p_{s}"), F.col("zero").alias(f"z_{s}"))
    p, q, y, z = (F.col(c) for c in ("p_a", "p_b", "z_a", "z_b"))
    met = side("a").join(side("b"), ["lang", "term"]).filter("a < b")
    overlaps = met.groupBy("lang", "a", "b").agg(F.sum(gap(p, q) - gap(p, z) - gap(y, q) + gap(y, z)).alias("value"))
    return constants.unionByName(one_sided).unionByName(overlaps).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def standing_out(known: DataFrame, top: int = TOP_TERMS) -> DataFrame:
    """The terms that a group uses more than its language does, by f, the first ``top`` of each group.

    Spark's limit per window group drops the rest within the tasks before the shuffle.
    """
    p, q = F.col("p"), F.col("q")
    over = known.filter(p > q).select("lang", "source", F.col("term").alias("item"), gap(p, q).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    return over.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """lang, source, part, item, value, rank: distances of each group to the others of its language, and its outstanding terms."""
    postings = checkpointed(keep_terms(count_terms(docs), min_docs))
    groups = checkpointed(describe_groups(docs, postings))
    small = groups.count() <= BROADCAST_GROUPS
    named = groups.select("lang", "source", "total", "kept", "lang_total", "zero")
    known = postings.join(F.broadcast(named) if small else named, ["lang", "source"]).select(
        "lang", "term", "source", share(F.col("n"), F.col("total"), F.col("kept")).alias("p"),
        share(F.col("lang_n"), F.col("lang_total"), F.col("kept")).alias("q"), "zero",
    )
    values = divergences(postings, groups, known)
    ways = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    pairs = values.select("lang", "value", ways.alias("way")).select("lang", "way.source", "way.item", "value").withColumn("rank", F.row_number().over(order))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.withColumn("part", F.lit("pair")).select(columns).unionByName(standing_out(known, top).withColumn("part", F.lit("term")).select(columns))
