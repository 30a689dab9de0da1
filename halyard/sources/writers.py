"""Writers. Tables are written by the executors; only documents that are one JSON object go through one task."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _ordered(df: DataFrame, order: str, name: str) -> DataFrame:
    pairs = F.collect_list(F.struct(F.col(order).alias("_o"), F.struct(*[c for c in df.columns if c != "ord"]).alias("r")))
    # by the key alone: maps, which rows may hold, have no order
    rows = F.array_sort(pairs, lambda a, b: F.when(a["_o"] < b["_o"], -1).when(a["_o"] > b["_o"], 1).otherwise(0))
    return df.groupBy().agg(F.transform(rows, lambda x: x["r"]).alias(name))


def catalog_document(tables: dict[str, DataFrame]) -> DataFrame:
    """The four tables as one row; ids in Unicode order, entries by number. A catalog is one document by its format."""
    out = None
    for name in ("artists", "photos", "tracks", "entries"):
        df = tables[name].drop("ord")
        order = F.col("id") if name == "entries" else F.collate(F.col("id"), "UNICODE")
        one = _ordered(df.withColumn("_k", order), "_k", name)
        one = one.select(F.transform(name, lambda r: r.dropFields("_k")).alias(name))
        out = one if out is None else out.crossJoin(one)
    return out.select(F.lit(2).alias("version"), "artists", "photos", "tracks", "entries")


def index_document(index: DataFrame) -> DataFrame:
    one = _ordered(index, "concertId", "entries")
    return one.select(F.lit(2).alias("version"), "entries")


def write_document(df: DataFrame, path: str, dry_run: bool = False) -> None:
    """One JSON object; fields that are null are left out."""
    if not dry_run:
        df.coalesce(1).write.mode("overwrite").json(path)


def quoted(cell: Column) -> Column:
    """A CSV cell: quotes doubled, in quotes unless empty."""
    text = F.coalesce(cell.cast("string"), F.lit(""))
    return F.when(text == "", "").otherwise(F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"')))


def csv_lines(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(F.concat_ws(",", *(quoted(F.col(c)) for c in columns)).alias("value"))


def write_csv(df: DataFrame, columns: list[str], path: str, order: list[Column] | None = None) -> None:
    """Lines under a header, every cell but empty ones in quotes."""
    spark = df.sparkSession
    head = spark.createDataFrame([(",".join(columns),)], "value string")
    lines = csv_lines(df.orderBy(*order) if order else df, columns)
    head.coalesce(1).unionByName(lines).write.mode("overwrite").text(path)


def write_report(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").option("sep", "\t").csv(path)


def versioned(path: str, now: datetime.datetime | None = None) -> str:
    """A new path beside the old, for a copy before it is overwritten."""
    at = (now or datetime.datetime.now(datetime.UTC)).strftime("%Y-%m-%dT%H-%M-%S")
    stem, dot, ending = path.rpartition(".")
    return f"{stem}.backup-{at}.{ending}" if dot and "/" not in ending else f"{path}.backup-{at}"


def audio_index_rows(encoded: DataFrame) -> DataFrame:
    """What goes into the audio index: successes that were not dry runs."""
    return encoded.filter(F.col("success") & ~F.coalesce("dry_run", F.lit(False)))


def encode_report(encoded: DataFrame) -> DataFrame:
    """Markdown lines: counts, then one line a file."""
    head = encoded.agg(F.count("*").alias("n"), F.count_if("success").alias("ok")).select(
        F.explode(F.array(F.lit("# Encoding report"), F.concat(F.lit("- files: "), F.col("n")), F.concat(F.lit("- succeeded: "), F.col("ok")), F.concat(F.lit("- failed: "), F.col("n") - F.col("ok")))).alias("value")
    )
    rows = encoded.orderBy("fileName").select(F.concat(F.lit("- "), "fileName", F.when(F.col("success"), ": ok").otherwise(F.concat(F.lit(": "), F.coalesce("error", F.lit("failed"))))).alias("value"))
    return head.unionByName(rows)
