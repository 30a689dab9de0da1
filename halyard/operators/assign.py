"""Assigning tracks to photo rows: exact by name, in turn; else the most similar name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import similarity_score
from .ranks import checkpointed, global_rank

#: Names compared at a time; at most this many are broadcast.
BLOCK_NAMES = 50_000
#: Words of more candidates than this don't give a first guess.
GUESS_CANDIDATES = 100


def rank_in_group(df: DataFrame, group: str, order: list[Column], name: str) -> DataFrame:
    """Add each row's place in its group, from 0, and the group's size as name and name_n."""
    w = Window.partitionBy(group)
    return df.select("*", (F.row_number().over(w.orderBy(*order)) - 1).alias(name), F.count("*").over(w).alias(f"{name}_n"))


def assign_in_turn(rows: DataFrame, tracks: DataFrame, group: str, row_order: list[Column], track_order: list[Column]) -> DataFrame:
    """Join rows with the track of their group whose place is theirs modulo the number of tracks; others get nulls."""
    r = rank_in_group(rows, group, row_order, "row_rank")
    t = rank_in_group(tracks, group, track_order, "track_rank")
    sizes = t.groupBy(group).agg(F.first("track_rank_n").alias("n_tracks"))
    r = r.join(sizes, group, "left").withColumn("track_rank", F.when(F.col("n_tracks") > 0, F.pmod("row_rank", "n_tracks")))
    return r.join(t.drop("track_rank_n"), [group, "track_rank"], "left").drop("row_rank_n", "n_tracks")


def _described(df: DataFrame, text: str, side: str) -> DataFrame:
    """df with the words of a text and the lengths that bound its score."""
    words = F.array_distinct(F.filter(F.split(text, " "), lambda w: w != ""))
    return df.withColumns({
        f"{side}_words": words, f"{side}_length": F.length(text), f"{side}_compact": F.length(F.regexp_replace(text, r"\s+", "")),
    }).withColumn(f"{side}_count", F.size(f"{side}_words"))


def _most(overlap: Column) -> Column:
    """What a pair's score is at most, given at most so much overlap: its edits are as many as its lengths differ at least."""
    near = lambda k: F.least(f"n_{k}", f"c_{k}") / F.greatest(f"n_{k}", f"c_{k}", F.lit(1))
    return overlap * 0.5 + near("length") * 0.2 + near("compact") * 0.3 + 1e-9


def first_guess(left: DataFrame, right: DataFrame) -> DataFrame:
    """name, found: the best score among the few candidates that share a name's rarest word, a floor for its best score.

    A word of more than ``GUESS_CANDIDATES`` candidates is no help and is left
    out, so no word brings many pairs together.
    """
    words = right.select(F.explode("c_words").alias("word"), "candidate")
    counted = words.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") <= GUESS_CANDIDATES)
    rare = words.join(counted, "word").groupBy("word").agg(F.first("n").alias("n"), F.collect_set("candidate").alias("candidates"))
    own = left.select("name", F.explode("n_words").alias("word")).join(rare, "word")
    best = own.groupBy("name").agg(F.min_by("candidates", F.struct("n", "word")).alias("candidates"))
    scored = best.select("name", F.explode("candidates").alias("candidate")).select("name", similarity_score(F.col("name"), F.col("candidate")).alias("score"))
    return scored.groupBy("name").agg(F.max("score").alias("found"))


def worth_scoring(least: float | None) -> Column:
    """Whether a pair can reach the name's first guess and the least score; edits are not counted for it."""
    floor = F.greatest(F.coalesce("found", F.lit(0.0)), F.lit(least or 0.0))
    by_size = F.least("n_count", "c_count") / F.greatest("n_count", "c_count", F.lit(1))
    overlap = F.size(F.array_intersect("n_words", "c_words")) / F.greatest("n_count", "c_count", F.lit(1))
    held = (floor <= 0.75) & (F.contains("name", "candidate") | F.contains("candidate", "name"))
    return F.coalesce(held | ((_most(by_size) >= floor) & (_most(overlap) >= floor)), F.lit(True))


def most_similar(names: DataFrame, candidates: DataFrame, block_names: int = BLOCK_NAMES, least: float | None = None) -> DataFrame:
    """The best candidate (id, candidate) of each distinct name; ties go to the smaller id.

    least drops matches with a smaller score. Up to ``block_names`` candidates
    are broadcast; more are dealt into blocks that the names meet by a shuffle.
    Distinct names only are compared, so a frequent name costs no more. A pair
    is scored only if it can still be the best: a floor comes from candidates that
    share the name's rarest word, a ceiling from words and lengths alone.
    """
    left = checkpointed(_described(names.select("name").distinct(), "name", "n"))
    right = _described(candidates.select("id", "candidate"), "candidate", "c")
    left = left.join(first_guess(left, right), "name", "left")
    blocks = max(1, -(-right.count() // block_names))
    if blocks == 1:
        pairs = left.crossJoin(F.broadcast(right))
    else:
        right = right.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
        pairs = left.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).join(right, "block")
    pairs = pairs.filter(worth_scoring(least))
    scored = pairs.select("name", "id", "candidate", similarity_score(F.col("name"), F.col("candidate")).alias("score"))
    best = scored.groupBy("name").agg(F.min(F.struct((-F.col("score")).alias("s"), "id", "candidate")).alias("b"))
    best = best.select("name", F.col("b.id").alias("id"), F.col("b.candidate").alias("candidate"), (-F.col("b.s")).alias("score"))
    return best if least is None else best.filter(F.col("score") >= least)


def match_tracks(rows: DataFrame, tracks: DataFrame, least: float, row_order: list[Column], track_order: list[Column]) -> DataFrame:
    """rows (id, band_key) with status, match_type, score and the struct track of their track (id, band_key, ...).

    An exact name takes the group's tracks in turn; another takes the first
    track of the most similar name, if it is similar enough.
    """
    exact = assign_in_turn(rows, tracks.select("band_key", F.struct(*tracks.columns).alias("track"), *[c.alias(f"_o{i}") for i, c in enumerate(track_order)]),
                           "band_key", row_order, [F.col(f"_o{i}") for i in range(len(track_order))])
    exact = exact.drop(*[f"_o{i}" for i in range(len(track_order))], "row_rank", "track_rank")
    open_names = exact.filter(F.col("track").isNull() & (F.col("band_key") != "")).select(F.col("band_key").alias("name"))
    near = most_similar(open_names, tracks.select("id", F.col("band_key").alias("candidate")))
    chosen = tracks.select(F.col("id").alias("near_id"), F.struct(*tracks.columns).alias("near_track"))
    near = near.select(F.col("name").alias("band_key"), F.col("id").alias("near_id"), F.col("score").alias("near_score")).join(chosen, "near_id")
    both = exact.join(near.drop("near_id"), "band_key", "left")
    fuzzy = F.col("track").isNull() & (F.col("near_score") >= least)
    return both.select(
        *rows.columns,
        F.when(F.col("band_key") == "", "unmatched_missing_band").when(F.col("track").isNotNull(), "matched_exact").when(fuzzy, "matched_fuzzy")
        .otherwise("unmatched_no_audio_match").alias("status"),
        F.when(F.col("track").isNotNull(), "exact").when(fuzzy, "fuzzy").otherwise("none").alias("match_type"),
        F.when(F.col("track").isNotNull(), 1.0).when(fuzzy, F.col("near_score")).alias("score"),
        F.coalesce("track", F.when(fuzzy, F.col("near_track"))).alias("track"),
        F.when(F.col("track").isNull() & ~F.coalesce(fuzzy, F.lit(False)), F.col("near_track")).alias("closest"),
        F.when(F.col("track").isNull() & ~F.coalesce(fuzzy, F.lit(False)), F.col("near_score")).alias("closest_score"),
    )


def match_counts(matched: DataFrame) -> DataFrame:
    count = lambda s: F.count_if(F.col("status") == s)
    return matched.agg(
        count("matched_exact").alias("exact"), count("matched_fuzzy").alias("fuzzy"),
        F.count_if(F.col("status").startswith("unmatched")).alias("unmatched"),
        count("unmatched_missing_source_row").alias("missing_source_rows"),
    )


def extra_tracks(rows: DataFrame, tracks: DataFrame, group: str, row_order: list[Column], track_order: list[Column]) -> DataFrame:
    """Tracks beyond a group's rows, each with the row it copies, rows taken in turn; groups without rows have none."""
    r = rank_in_group(rows, group, row_order, "row_rank")
    t = rank_in_group(tracks, group, track_order, "track_rank").drop("track_rank_n")
    sizes = r.groupBy(group).agg(F.first("row_rank_n").alias("n_rows"))
    t = t.join(sizes, group).filter(F.col("track_rank") >= F.col("n_rows"))
    t = t.withColumn("row_rank", F.pmod(F.col("track_rank") - F.col("n_rows"), F.col("n_rows")))
    return t.join(r.drop("row_rank_n"), [group, "row_rank"]).drop("n_rows")


def number_from(df: DataFrame, start: Column | int, order: list[Column], name: str = "id") -> DataFrame:
    """Consecutive numbers from a start in the given order."""
    return global_rank(df, order, name).withColumn(name, F.col(name) + start)
