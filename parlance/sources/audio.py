"""Audio: decoding, resampling, light denoising and energy regions, as DataFrames of whole files.

WAV (PCM of 8 to 32 bits and 32-bit float) is decoded here; other formats need the soundfile package
and raise ValueError without it.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.sources.files import AUDIO_SUFFIXES, has_suffix
from parlance.sources.transcripts import energy_regions

RATE = 16_000


def wav_parts(content: bytes) -> tuple[tuple[int, int, int, int], bytes]:
    """((format, channels, rate, bits), data) of a RIFF file; a data chunk that ends early is taken as far as it goes."""
    if content[:4] != b"RIFF" or content[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, head = 12, None
    while at + 8 <= len(content):
        name, size = content[at : at + 4], int.from_bytes(content[at + 4 : at + 8], "little")
        if name == b"fmt ":
            number = lambda lo, hi: int.from_bytes(content[at + 8 + lo : at + 8 + hi], "little")  # noqa: B023, E731
            kind = number(0, 2)
            head = (number(24, 26) if kind == 0xFFFE else kind), number(2, 4), number(4, 8), number(14, 16)
        elif name == b"data":
            if head is None:
                raise ValueError("WAV data before its format")
            return head, content[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("WAV file without data")


def decode(content: bytes) -> tuple[np.ndarray, int]:
    """Mono samples (float32, mean of the channels) and the sample rate."""
    if content[:4] != b"RIFF":
        try:
            import soundfile
        except ImportError as missing:
            raise ValueError("this audio format needs the soundfile package") from missing
        samples, rate = soundfile.read(io.BytesIO(content), dtype="float32", always_2d=True)
        return samples.mean(axis=1).astype(np.float32), int(rate)
    (kind, channels, rate, bits), data = wav_parts(content)
    width = bits // 8
    data = data[: len(data) // (width * channels) * width * channels]
    if kind == 3 and bits == 32:
        values = np.frombuffer(data, "<f4").astype(np.float32)
    elif kind == 1 and bits == 8:
        values = (np.frombuffer(data, np.uint8).astype(np.float32) - 128) / 128
    elif kind == 1 and bits in (16, 24, 32):
        # the sample's bytes at the top of a 32-bit number
        wide = np.zeros((len(data) // width, 4), np.uint8)
        wide[:, 4 - width :] = np.frombuffer(data, np.uint8).reshape(-1, width)
        values = (wide.view("<i4").ravel() / 2**31).astype(np.float32)
    else:
        raise ValueError(f"WAV format {kind} of {bits} bits")
    return values.reshape(-1, channels).mean(axis=1).astype(np.float32), rate


def encode(samples: np.ndarray, rate: int) -> bytes:
    """A mono WAV of 16-bit PCM."""
    data = (np.clip(samples, -1, 1) * 32767).round().astype("<i2").tobytes()
    head = b"WAVEfmt " + (16).to_bytes(4, "little") + b"".join(v.to_bytes(n, "little") for v, n in ((1, 2), (1, 2), (rate, 4), (2 * rate, 4), (2, 2), (16, 2)))
    return b"RIFF" + (len(head) + 8 + len(data)).to_bytes(4, "little") + head + b"data" + len(data).to_bytes(4, "little") + data


def resample(samples: np.ndarray, rate: int, to: int = RATE) -> np.ndarray:
    """Band-limited to another rate, by the spectrum; the length follows the rates."""
    if rate == to or not len(samples):
        return samples.astype(np.float32)
    n = max(1, round(len(samples) * to / rate))
    spectrum = np.fft.rfft(samples.astype(np.float64))
    out = np.zeros(n // 2 + 1, complex)
    shared = min(len(out), len(spectrum))
    out[:shared] = spectrum[:shared]
    return (np.fft.irfft(out, n) * (n / len(samples))).astype(np.float32)


def frames_of(samples: np.ndarray, size: int, step: int) -> np.ndarray:
    return np.lib.stride_tricks.sliding_window_view(samples, size)[::step]


def subtract_noise(samples: np.ndarray, reduction: float, size: int = 1024, step: int = 256) -> np.ndarray:
    """Spectral subtraction: each frequency's 20th percentile over time, times ``reduction``, goes."""
    window = np.hanning(size + 1)[:-1]
    padded = np.pad(samples.astype(np.float64), (size // 2, size // 2 + step))
    spectrum = np.fft.rfft(frames_of(padded, size, step) * window, axis=1)
    size_of = np.abs(spectrum)
    mask = np.maximum(size_of - reduction * np.percentile(size_of, 20, axis=0), 0) / (size_of + 1e-8)
    pieces = np.fft.irfft(spectrum * mask, size, axis=1) * window
    out, weight = np.zeros(len(padded)), np.zeros(len(padded))
    for k, piece in enumerate(pieces):
        out[k * step : k * step + size] += piece
        weight[k * step : k * step + size] += window * window
    return (out / np.maximum(weight, 1e-8))[size // 2 : size // 2 + len(samples)]


def light_denoise(samples: np.ndarray, rate: int, reduction: float = 1.6, floor: float = 0.18) -> np.ndarray:
    """Spectral subtraction, then a soft gate: quiet frames are turned down to ``floor`` at most, never off.

    Audio under half a second passes as it is.
    """
    if len(samples) < rate // 2:
        return samples.astype(np.float32)
    clean = subtract_noise(samples, reduction)
    size, step = max(1, int(0.08 * rate)), max(1, int(0.04 * rate))
    if len(clean) < size:
        return clean.astype(np.float32)
    rms = np.sqrt((frames_of(clean, size, step) ** 2).mean(axis=1))
    least = max(2.5 * np.percentile(rms, 25), 0.10 * np.percentile(rms, 85), 0.0008)
    gain = np.clip(rms / least, floor, 1.0)
    places = np.concatenate([[0], np.arange(len(rms)) * step + size // 2, [len(clean) - 1]])
    curve = np.interp(np.arange(len(clean)), places, np.concatenate([gain[:1], gain, gain[-1:]]))
    return np.clip(clean * curve, -1, 1).astype(np.float32)


def mapped(files: DataFrame, of_file, columns: str) -> DataFrame:
    """Rows of ``of_file(samples, rate)`` of each file (file_id, content); a file that cannot be read gives an error text."""
    names = [c.split()[0].strip("`") for c in columns.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for file_id, content in zip(pdf["file_id"], pdf["content"], strict=True):
                try:
                    rows += [(file_id, *row, None) for row in of_file(*decode(bytes(content)))]
                except (ValueError, TypeError) as problem:
                    rows.append((file_id, *[None] * len(names), str(problem)))
            yield pd.DataFrame(rows, columns=["file_id", *names, "problem"])

    return files.select("file_id", "content").mapInPandas(run, f"file_id string, {columns}, problem string")


def audio_files(spark: SparkSession, path: str) -> DataFrame:
    """file_id, content of the audio files at or below a path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.where(has_suffix(F.col("path"), AUDIO_SUFFIXES)).select(F.col("path").alias("file_id"), "content")


def waveforms(files: DataFrame, max_seconds: float | None = None, rate: int | None = RATE, denoise: bool = False) -> DataFrame:
    """file_id, sample_rate, samples of each file: mono, cut to its first seconds, resampled, denoised if asked for."""

    def of_file(samples: np.ndarray, own: int):
        samples = samples if max_seconds is None else samples[: int(max_seconds * own)]
        samples, own = (samples, own) if rate is None else (resample(samples, own, rate), rate)
        yield own, (light_denoise(samples, own) if denoise else samples).tolist()

    return mapped(files, of_file, "sample_rate int, samples array<float>")


def voice_activity(files: DataFrame, neural=None) -> DataFrame:
    """file_id, start, end of speech: by ``neural(samples, rate)`` where it gives regions, else by energy."""

    def of_file(samples: np.ndarray, rate: int):
        found = []
        if neural is not None:
            try:
                found = list(neural(samples, rate))
            except Exception:  # noqa: BLE001  a detector that fails leaves the work to energy
                found = []
        if not found and len(samples) >= 1024:  # stationary noise would pass for speech
            samples = subtract_noise(samples, 1.4)
        yield from found or energy_regions(samples, rate)

    return mapped(files, of_file, "start double, `end` double").where("start is not null").drop("problem")


def embedded(rows: DataFrame, column: str = "audio") -> DataFrame:
    """Rows with file_id and a struct column that holds ``bytes``: file_id, sample_rate, samples, problem.

    Rows without bytes have a problem and no samples.
    """
    return waveforms(rows.select("file_id", F.coalesce(F.col(column)["bytes"], F.lit(b"")).alias("content")), rate=None)
