"""Cross-site boilerplate lines by distinct-site spread, in DataFrame functions only.

A line's spread is the number of distinct sites (``source``) whose documents hold it.  HyperLogLog
sketches per line hash are filled before the shuffle and merged after it, so a line in a third of
all documents moves one sketch a task.  Estimates well below ``sites`` settle a line as ordinary,
well above as boilerplate; lines within ``MARGIN`` of the threshold are counted exactly.  Lines of
two sites or fewer cannot be near a threshold above four and drop out at the sketch.  Boilerplate
lines are then removed from every document.

Blank lines are never boilerplate and stay.  Nulls: a null text stays null; a null source is one
site of its own.  Ids may be null or repeat: lines are judged by their text alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm.common import materialize

SITES = 10
SKETCH_LOG2 = 9
MARGIN = 0.3  # over six standard errors of a sketch of 2**9 registers


def lines_of(docs: DataFrame) -> DataFrame:
    """line (64-bit hash), site: one row a nonblank line."""
    line = F.explode(F.split("text", "\n")).alias("line")
    return docs.select(F.coalesce("source", F.lit("")).alias("site"), F.col("source").isNull().alias("unknown"), line).where("trim(line) <> ''").select(F.xxhash64("line").alias("line"), F.xxhash64("site", "unknown").alias("site"))


def spread_lines(docs: DataFrame, sites: int = SITES) -> DataFrame:
    """line: hashes of the lines on at least ``sites`` distinct sites."""
    lines = lines_of(docs)
    sketched = lines.groupBy("line").agg(F.hll_sketch_agg("site", SKETCH_LOG2).alias("sketch"))
    estimated = sketched.select("line", F.hll_sketch_estimate("sketch").alias("estimate")).where(F.col("estimate") >= sites * (1 - MARGIN))
    estimated = materialize(estimated, "spread")
    sure = estimated.where(F.col("estimate") > sites * (1 + MARGIN)).select("line")
    near = estimated.where(F.col("estimate") <= sites * (1 + MARGIN)).select("line")
    exact = lines.join(near, "line", "left_semi").distinct().groupBy("line").agg(F.count("*").alias("n")).where(F.col("n") >= sites).select("line")
    return materialize(sure.union(exact), "boilerplate")


def stripped(rows: DataFrame, sites: int) -> DataFrame:
    """``rows`` (struct ``row`` of a document) with ``text`` free of boilerplate lines, n_lines and n_removed.

    Whole rows travel inside the struct, so no column of theirs clashes with one made here.
    """
    rows = rows.withColumn("place", F.xxhash64("row.doc_id", "row.text"))
    spread = spread_lines(rows.select("row.text", "row.source"), sites)
    held = rows.select("place", F.explode(F.array_distinct(F.transform(F.split("row.text", "\n"), lambda x: F.xxhash64(x)))).alias("line"))
    # only documents that hold boilerplate, with its hashes; distinct per document, so bounded by it
    hit = held.join(spread, "line").groupBy("place").agg(F.collect_set("line").alias("gone"))
    text = F.col("row.text")
    parts = F.split(text, "\n")
    kept = F.when(F.col("gone").isNull(), parts).otherwise(F.filter(parts, lambda x: ~F.array_contains("gone", F.xxhash64(x))))
    out = rows.join(hit, "place", "left").withColumn("kept", kept)
    out = out.withColumn("n_lines", F.coalesce(F.size(parts), F.lit(0)).cast("long")).withColumn("n_removed", F.coalesce(F.size(parts) - F.size("kept"), F.lit(0)).cast("long"))
    return out.withColumn("text", F.when(F.col("n_removed") == 0, text).otherwise(F.array_join("kept", "\n"))).select("row", "text", "n_lines", "n_removed")


def without_spread_lines(docs: DataFrame, sites: int = SITES) -> DataFrame:
    """doc_id, source, ``text`` free of boilerplate lines, n_lines, n_removed of each document."""
    return stripped(docs.select(F.struct("doc_id", "source", "text").alias("row")), sites).select("row.doc_id", "row.source", "text", "n_lines", "n_removed")


def clean_lines(docs: DataFrame, sites: int = SITES) -> DataFrame:
    """``docs`` without boilerplate lines, with their own columns; n_chars, if there, follows the text."""
    out = stripped(docs.select(F.struct("*").alias("row")), sites)
    value = {c: F.col("row")[c] for c in docs.columns} | {"text": F.col("text")}
    if "n_chars" in docs.columns:
        value["n_chars"] = F.when(F.col("n_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(value["n_chars"])
    return out.select(*(v.alias(c) for c, v in value.items()))
