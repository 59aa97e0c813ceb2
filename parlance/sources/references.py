"""Evaluation references: timed JSON, TextGrid, RTTM and plain transcripts, matched to predictions by name."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.functions import text as T
from parlance.sources.transcripts import clip_to, read_plain_transcripts, reference_name

REF = "REF"
ROW = "start: double, `end`: double, speaker: string, text: string, text_before_llm: string"


def cleaned(x: Column, language: str) -> Column:
    return T.eval_clean_zh(x) if language == "zh" else T.eval_clean_en(x)


def usable(rows: DataFrame, language: str, duration: float | None) -> DataFrame:
    """Rows with words, a length and, with a duration, a start before it; ends are cut at it."""
    rows = rows.where(cleaned(F.coalesce("text", F.lit("")), language) != "")
    return rows.where("`end` > start") if duration is None else clip_to(rows, duration)


def read_reference_json(spark: SparkSession, path: str, language: str = "en", duration: float | None = None) -> DataFrame:
    """file_id, start, end, speaker, text of timed references: objects with ``segments``, or bare arrays.

    A missing start is 0, a missing end the start, a missing speaker ``REF``.  Files that are no JSON give nothing.
    """
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(path, wholetext=True)
    files = files.select(F.col("_metadata.file_name").alias("file_id"), "value")
    bare = F.from_json("value", f"array<struct<{ROW}>>")
    inside = F.from_json("value", f"struct<segments: array<struct<{ROW}>>>")["segments"]
    found = files.select("file_id", F.explode(F.when(F.ltrim("value").startswith("["), bare).otherwise(inside)).alias("s"))
    start = F.coalesce("s.start", F.lit(0.0))
    rows = found.select("file_id", start.alias("start"), F.coalesce("s.end", start).alias("end"), F.coalesce("s.speaker", F.lit(REF)).alias("speaker"), T.strip(F.coalesce("s.text", F.lit(""))).alias("text"))
    return usable(rows, language, duration)


def textgrid_intervals(text: str) -> Iterator[tuple[str, float, float, str]]:
    """(tier, start, end, mark) of the long or the short form of a TextGrid; blank marks are left out.

    Values are read in order, names aside: quoted strings and numbers.  ``""`` inside a string is a quote.
    """
    value = re.compile(r'"((?:[^"]|"")*)"|<(exists)>|(?<![\w.\[])(-?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?)(?![\w\]])')
    found = [(m[1].replace('""', '"'), True) if m[1] is not None else (m[3], False) for m in value.finditer(text.lstrip("\ufeff")) if m[2] is None]
    at = next((k for k, (v, quoted) in enumerate(found) if quoted and v in ("IntervalTier", "TextTier")), len(found))
    while at < len(found):
        kind, tier, size = found[at][0], found[at + 1][0], int(float(found[at + 4][0]))
        at += 5
        for _ in range(size):
            if kind == "IntervalTier":
                low, high, mark = (found[at + k][0] for k in range(3))
                at += 3
                if mark.strip():
                    yield tier, float(low), float(high), mark.strip()
            else:
                at += 2


def read_textgrid_references(spark: SparkSession, path: str, language: str = "zh", duration: float | None = None, speaker: str | None = None) -> DataFrame:
    """file_id (without suffix), start, end, speaker (the tier's name, or one for all), text."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.TextGrid").text(path, wholetext=True)
    files = files.select(F.regexp_replace(F.col("_metadata.file_name"), r"\.TextGrid$", "").alias("file_id"), "value")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(f, s, e, t, m) for f, v in zip(pdf["file_id"], pdf["value"], strict=True) for t, s, e, m in textgrid_intervals(v)]
            yield pd.DataFrame(rows, columns=["file_id", "start", "end", "speaker", "text"])

    rows = files.mapInPandas(run, "file_id string, start double, `end` double, speaker string, text string")
    rows = rows if speaker is None else rows.withColumn("speaker", F.lit(speaker))
    return usable(rows, language, duration)


def read_rttm(spark: SparkSession, path: str) -> DataFrame:
    """file_id, start, end, speaker of SPEAKER lines."""
    cell = F.split(T.strip(F.col("value")), r"\s+")
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.rttm").text(path).where(F.col("value").rlike(r"^\s*SPEAKER\s"))
    start = cell[3].cast("double")
    return lines.select(cell[1].alias("file_id"), start.alias("start"), (start + cell[4].cast("double")).alias("end"), cell[7].alias("speaker"))


def reference_candidates(file_name: Column, far_field: bool = False) -> Column:
    """Names under which a prediction's reference may stand, the likelier first."""
    base = reference_name(file_name)
    parts = F.split(base, "_")
    if not far_field:
        return F.array(base)
    return F.array_distinct(F.when(F.size(parts) >= 2, F.array(base, F.concat_ws("_", parts[0], F.get(parts, F.lit(1))))).otherwise(F.array(base)))


def speaker_from_name(file_name: Column) -> Column:
    """The speaker in a near-field name (``..._N_SPK0001``), or null."""
    return F.nullif(F.regexp_extract(reference_name(file_name), r"_N_(SPK\d+)$", 1), F.lit(""))


def with_references(predictions: DataFrame, references: DataFrame, far_field: bool = False) -> DataFrame:
    """file_id of each prediction with the ref_id of the first candidate that exists; null if none does."""
    names = predictions.select("file_id").distinct().select("file_id", F.posexplode(reference_candidates(F.col("file_id"), far_field)).alias("k", "ref_id"))
    there = names.join(references.select(F.col("file_id").alias("ref_id")).distinct(), "ref_id", "left_semi")
    best = there.groupBy("file_id").agg(F.min_by("ref_id", "k").alias("ref_id"))
    return predictions.select("file_id").distinct().join(best, "file_id", "left")


def plain_references(predictions: DataFrame, transcripts: DataFrame, language: str, duration: float | None = None) -> DataFrame:
    """One reference row a prediction file, from plain transcripts (utt_id, text) by its name.

    It runs from 0 to the duration, else the file's last end, else 1 second; 0.01 at least.  Files
    without a transcript, or with one without words, have none.
    """
    last = predictions.groupBy("file_id").agg(F.max(F.coalesce("end", "start")).alias("last"))
    end = F.lit(duration) if duration is not None else F.coalesce("last", F.lit(1.0))
    named = last.withColumn("utt_id", reference_name(F.col("file_id"))).join(transcripts.groupBy("utt_id").agg(F.max("text").alias("text")), "utt_id")
    rows = named.select("file_id", F.lit(0.0).alias("start"), F.greatest(F.lit(0.01), end).alias("end"), F.lit(REF).alias("speaker"), "text")
    return rows.where(cleaned(F.col("text"), language) != "")


def read_transcripts(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """utt_id, text of plain transcripts; ``*.trans.txt`` for trees of them.  Lines without a text are left out."""
    return read_plain_transcripts(spark, path, pattern).where("text <> ''")


def reference_template(segments: DataFrame) -> DataFrame:
    """One row a file with the JSON of a reference to be edited by hand: the text before correction, if there is one."""
    before = F.coalesce(F.when(F.coalesce("text_before_llm", F.lit("")) != "", F.col("text_before_llm")), F.col("text"), F.lit(""))
    start = F.coalesce("start", F.lit(0.0))
    row = F.struct(start.alias("start"), F.coalesce("end", start).alias("end"), F.coalesce("speaker", F.lit(REF)).alias("speaker"), before.alias("text"))
    files = segments.groupBy("file_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seg_idx", row.alias("row")))), lambda x: x["row"]).alias("segments"))
    note = "Edit text, speaker, start and end by hand; keep reviewed segments only."
    return files.select("file_id", F.to_json(F.struct(F.col("file_id").alias("source_prediction"), F.lit(note).alias("note"), "segments")).alias("template"))
