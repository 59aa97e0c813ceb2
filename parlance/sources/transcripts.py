"""Readers and writers of transcript results, references and audio."""

from __future__ import annotations

import io
import re
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.functions.text import strip

#: columns of a segment, name -> type
SEGMENT = {
    "start": "double", "end": "double", "speaker": "string", "text": "string", "speaker_original": "string", "text_before_llm": "string", "correction_note": "string", "intent": "array<string>", "phase": "string",
    "avg_logprob": "double", "no_speech_prob": "double", "speech_overlap_s": "double", "speech_overlap_ratio": "double", "playback_start": "double", "playback_end": "double", "start_asr_raw": "double", "start_alignment_raw": "double",
    "low_confidence": "boolean", "low_confidence_reasons": "array<string>", "consistency_note": "string", "boundary_prefix_repaired": "boolean", "boundary_prefix_source": "struct<window_start:double,window_end:double,text:string>",
    "manual_edited": "boolean", "manual_speaker_edited": "boolean", "speaker_original_manual": "string", "text_original_asr": "string",
}
SUMMARY = "struct<topic:string,summary:string,key_points:array<string>,decisions:array<string>,action_items:array<string>,participants:array<string>>"
RESULT = {"file": "string", "num_speakers": "int", "timing": "map<string,double>", "meeting_summary": SUMMARY, "segments": f"array<struct<{','.join(f'`{k}`:{v}' for k, v in SEGMENT.items())}>>"}
AUDIO = ("wav", "flac", "mp3", "m4a", "ogg")


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Saved results, bare or wrapped in ``files``, one row a file; unreadable ones are skipped."""
    whole = ", ".join(f"`{k}` {v}" for k, v in RESULT.items()) + f", files array<struct<{','.join(f'`{k}`:{v}' for k, v in RESULT.items())}>>"
    raw = spark.read.schema(whole).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(path)
    raw = raw.where(~F.col("_metadata.file_name").startswith("manual_corrected"))
    return raw.select(F.explode(F.coalesce("files", F.array(F.struct(*RESULT)))).alias("r")).select("r.*").where(F.size("segments") > 0)


def explode_segments(results: DataFrame, dataset: str = "") -> DataFrame:
    """One row a segment with its place and uid; a missing end is the start, a missing start zero."""
    rows = results.select(F.col("file").alias("file_id"), F.posexplode("segments").alias("seg_idx", "s")).select("file_id", "seg_idx", "s.*")
    start = F.coalesce("start", F.lit(0.0))
    return rows.withColumn("start", start).withColumn("end", F.coalesce("end", start)).withColumn("uid", F.concat(F.lit(f"{dataset}/"), "file_id", F.lit("#"), "seg_idx"))


def corpus_segments(results: DataFrame, dataset: str, least: int = 4) -> DataFrame:
    """The retrieval corpus of a folder of results: segments of at least ``least`` characters, with
    their dataset and file, and uid numbered by place in the file."""
    rows = explode_segments(results, dataset).where(F.length(strip(F.coalesce("text", F.lit("")))) >= least)
    return rows.withColumn("dataset", F.lit(dataset)).withColumn("file", F.col("file_id"))


def clip_to(segments: DataFrame, duration: float) -> DataFrame:
    """Segments that start before ``duration``, ended there, in order; empty ones go."""
    return segments.where(F.col("start") < duration).withColumn("end", F.least("end", F.lit(duration))).where("`end` > start").orderBy("start", "end")


def read_plain_transcripts(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """Lines of ``id text`` of the files at or below a path, or of those of a name pattern."""
    found = F.split(F.trim("value"), r"\s+", 2)
    reader = spark.read.option("recursiveFileLookup", True)
    return (reader.option("pathGlobFilter", pattern) if pattern else reader).text(path).where("trim(value) <> ''").select(found[0].alias("utt_id"), F.coalesce(F.get(found, F.lit(1)), F.lit("")).alias("text"))


def parse_textgrid(text: str) -> Iterator[tuple[str, float, float, str]]:
    """(tier, start, end, mark) of the long TextGrid form; blank and placeholder marks are left out."""
    tier, low, high = "", None, None
    for line in text.splitlines():
        key, _, value = (x.strip() for x in line.partition("="))
        value = value.strip('"')
        if key == "name":
            tier = value
        elif key == "xmin":
            low = float(value)
        elif key == "xmax":
            high = float(value)
        elif key == "text" and value.strip() and value not in ("<%>", "<$>", "%", "$"):
            yield tier, low, high, value


def read_textgrids(spark: SparkSession, path: str, duration: float | None = None) -> DataFrame:
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.TextGrid").text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file_id"), "value")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([(f, *row) for f, v in zip(pdf["file_id"], pdf["value"], strict=True) for row in parse_textgrid(v)], columns=["file_id", "speaker", "start", "end", "text"])

    out = files.mapInPandas(run, "file_id string, speaker string, start double, `end` double, text string")
    return out if duration is None else clip_to(out, duration)


def reference_name(file_name):
    """File name without .json and one audio suffix, as the key of its reference."""
    return F.regexp_replace(F.regexp_replace(file_name, r"\.json$", ""), rf"(?i)\.({'|'.join(AUDIO)})$", "")


def decode_wav(content: bytes) -> tuple[np.ndarray, int]:
    """Mono float samples in [-1, 1] and the sample rate of a 16-bit PCM WAV."""
    with wave.open(io.BytesIO(content)) as w:
        if w.getsampwidth() != 2:
            raise ValueError("only 16-bit PCM is supported")
        raw = np.frombuffer(w.readframes(w.getnframes()), "<i2").reshape(-1, w.getnchannels())
        return (raw.mean(axis=1) / 32768).astype(np.float32), w.getframerate()


def read_audio(spark: SparkSession, path: str) -> DataFrame:
    """file_id, sample_rate, duration_s, rms per WAV file below ``path``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.wav").load(path).select(F.col("path").alias("file_id"), "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [decode_wav(c) for c in pdf["content"]]
            yield pd.DataFrame({"file_id": pdf["file_id"], "sample_rate": [r for _, r in found], "duration_s": [len(x) / r for x, r in found], "rms": [float(np.sqrt(np.mean(x * x))) if len(x) else 0.0 for x, _ in found]})

    return files.mapInPandas(run, "file_id string, sample_rate int, duration_s double, rms double")


def energy_regions(samples: np.ndarray, rate: int, frame: float = 0.08, hop: float = 0.04, least: float = 0.16, gap: float = 0.24) -> list[tuple[float, float]]:
    """Regions of activity by frame energy against an adaptive threshold."""
    size, step = int(frame * rate), int(hop * rate)
    if len(samples) < size:
        return []
    rms = np.sqrt(np.lib.stride_tricks.sliding_window_view(samples.astype(np.float64) ** 2, size)[::step].mean(axis=1))
    loud = rms >= max(rms.max() * 10 ** (-26 / 20), 3 * np.percentile(rms, 25), 0.18 * np.percentile(rms, 88), 0.0012)
    edges = np.flatnonzero(np.diff(np.concatenate([[0], loud.astype(int), [0]])))
    runs = [(a * hop, (b - 1) * hop + frame) for a, b in zip(edges[::2], edges[1::2], strict=True)]
    out: list[tuple[float, float]] = []
    for a, b in (r for r in runs if r[1] - r[0] >= least):
        if out and a - out[-1][1] <= gap:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def write_corrected(results: DataFrame, path: str) -> None:
    """All results as one row ``{"files": [...]}``, replacing what was written there before.

    For the hand-edited results of a session, which one person has gone through.
    """
    files = results.agg(F.array_sort(F.collect_list(F.struct(*results.columns)), lambda a, b: F.when(a["file"] < b["file"], -1).when(a["file"] > b["file"], 1).otherwise(0)).alias("files"))
    files.coalesce(1).write.mode("overwrite").json(path)


def write_results_json(results: DataFrame, path: str) -> None:
    """Results as JSON, a folder a file name; a file written again replaces its own folder only.

    The file's name stands in the JSON too, so a folder can be read by :func:`read_results`.
    """
    named = results.withColumn("name", F.regexp_replace(F.element_at(F.split("file", "/"), -1), r"[^\w.-]", "_"))
    named.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("name").json(path)


def write_results(results: DataFrame, path: str) -> None:
    """Results by file; a file written again replaces its own partition only."""
    results.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("file").parquet(path)
