"""Chat clients and speech recognisers behind small interfaces, chosen by name.

Network clients take an injected transport, so nothing here opens a connection by itself; the
scripted ones answer from a function or a table and are what tests and offline runs use.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.sources.audio import mapped
from parlance.sources.config import get_env

Messages = list[dict[str, str]]


class ChatClient(Protocol):
    model_name: str

    def chat(self, messages: Messages, *, temperature: float = 0.1, max_tokens: int = 4096) -> str: ...


class Recognizer(Protocol):
    def load(self) -> None: ...
    def transcribe(self, samples: np.ndarray, rate: int, language: str | None = None) -> dict: ...
    def unload(self) -> None: ...


class Diarizer(Protocol):
    def diarize(self, samples: np.ndarray, rate: int) -> dict: ...


# -- chat --------------------------------------------------------------------------------------


@dataclass
class Scripted:
    """Answers by a function of the messages, and remembers what it was asked."""

    answer: Callable[[Messages], str]
    model_name: str = "scripted"
    asked: list[Messages] = field(default_factory=list)

    def chat(self, messages: Messages, *, temperature: float = 0.1, max_tokens: int = 4096) -> str:
        self.asked.append(messages)
        return self.answer(messages)


@dataclass
class SystemApart:
    """A client of the kind that takes instructions apart from the conversation.

    All system messages are joined, a line each, and lifted out; the answer is the first text block, or
    an empty text.  ``send(model, system, messages, temperature, max_tokens)`` gives the blocks.
    """

    send: Callable[..., list[dict]]
    model_name: str

    def chat(self, messages: Messages, *, temperature: float = 0.1, max_tokens: int = 4096) -> str:
        system = "\n".join(m.get("content", "") for m in messages if m["role"] == "system").strip()
        rest = [m for m in messages if m["role"] != "system"]
        blocks = self.send(self.model_name, system or None, rest, temperature, max_tokens)
        return next((b["text"] for b in blocks if b.get("type") == "text"), "")


@dataclass
class SystemInside:
    """A client that passes all messages as they are; the answer is the first choice's text, or an empty one."""

    send: Callable[..., list[str | None]]
    model_name: str

    def chat(self, messages: Messages, *, temperature: float = 0.1, max_tokens: int = 4096) -> str:
        choices = self.send(self.model_name, messages, temperature, max_tokens)
        return (choices[0] if choices else "") or ""


# Backend name -> (kind of client, variable of its key, variable of its model)
BACKENDS = {
    "deepseek": (SystemInside, "DEEPSEEK_API_KEY", "DEEPSEEK_MODEL"),
    "claude": (SystemApart, "CLAUDE_API_KEY", "CLAUDE_MODEL"),
    "minimax": (SystemInside, "MINIMAX_API_KEY", "MINIMAX_MODEL"),
}


def chat_client(transport: Callable[[str, str], Callable], model: str | None = None, env: str = ".env") -> ChatClient:
    """The client named by ``ACTIVE_LLM`` (deepseek if unset); ``transport(backend, key)`` gives its ``send``.

    RuntimeError without the backend's key, ValueError for an unknown backend.
    """
    backend = (get_env("ACTIVE_LLM", path=env) or "deepseek").strip().lower()
    if backend not in BACKENDS:
        raise ValueError(f"unknown backend: {backend!r}")
    kind, key_name, model_name = BACKENDS[backend]
    key = get_env(key_name, path=env)
    if not key:
        raise RuntimeError(f"{key_name} is not set")
    return kind(transport(backend, key), model or get_env(model_name, path=env) or backend)


# -- speech --------------------------------------------------------------------------------------


@dataclass(frozen=True)
class LongForm:
    """Options of sequential decoding."""

    beam_size: int = 5
    condition_on_previous_text: bool = False
    hallucination_silence_threshold: float = 2.0


@dataclass(frozen=True)
class Chunked:
    """Options of decoding in chunks."""

    chunk_length_s: float = 30.0
    batch_size: int = 8
    compression_ratio_threshold: float = 1.35
    logprob_threshold: float = -1.0
    temperature: tuple[float, ...] = (0.0, 0.2, 0.4, 0.6, 0.8, 1.0)


#: backend name -> its options; those of None exist and are not enabled
RECOGNIZERS: dict[str, type | None] = {"transformers": Chunked, "openai-whisper": LongForm, "faster-whisper": None}
_MAKERS: dict[str, Callable[[dict, object], Recognizer]] = {}


def register_recognizer(backend: str, make: Callable[[dict, object], Recognizer]) -> None:
    """``make(settings, options)`` builds the recogniser of a backend."""
    _MAKERS[backend] = make


def recognizer(settings: dict) -> Recognizer:
    """The recogniser of ``settings["backend"]`` (transformers if unset).

    NotImplementedError for a backend that is not enabled or has no maker, ValueError for an unknown one.
    """
    backend = settings.get("backend", "transformers")
    if backend not in RECOGNIZERS and backend not in _MAKERS:
        raise ValueError(f"unknown ASR backend: {backend}")
    if backend not in _MAKERS:
        raise NotImplementedError(f"{backend} is not enabled")
    options = RECOGNIZERS.get(backend)
    return _MAKERS[backend](settings, options() if options else None)


def timed(segments: list[dict]) -> list[dict]:
    """Segments with missing times as 0.0; those without a length are dropped later by the artifact filter."""
    return [s | {"start": float(s.get("start") or 0.0), "end": float(s.get("end") or 0.0)} for s in segments]


_LOADED: dict[str, object] = {}


def held(name: str, make: Callable[[], object]):
    """One model a worker and name, made at first use."""
    if name not in _LOADED:
        _LOADED[name] = made = make()
        load = getattr(made, "load", None)
        if load:
            load()
    return _LOADED[name]


def transcribed(files: DataFrame, make: Callable[[], Recognizer], language: str | None = None, name: str = "asr") -> DataFrame:
    """file_id, seg_idx, start, end, text, avg_logprob, no_speech_prob of each file (file_id, content)."""

    def of_file(samples: np.ndarray, rate: int):
        for k, s in enumerate(timed(held(name, make).transcribe(samples, rate, language).get("segments", []))):
            yield k, s["start"], s["end"], s.get("text", ""), s.get("avg_logprob"), s.get("no_speech_prob")

    return mapped(files, of_file, "seg_idx int, start double, `end` double, text string, avg_logprob double, no_speech_prob double")


def diarized(files: DataFrame, make: Callable[[], Diarizer], name: str = "diar") -> DataFrame:
    """file_id, diar_idx, start, end, speaker, num_speakers, in order of start."""

    def of_file(samples: np.ndarray, rate: int):
        found = sorted(held(name, make).diarize(samples, rate).get("segments", []), key=lambda s: float(s["start"]))
        for k, s in enumerate(found):
            yield k, float(s["start"]), float(s["end"]), s["speaker"], len({x["speaker"] for x in found})

    return mapped(files, of_file, "diar_idx int, start double, `end` double, speaker string, num_speakers int")


def word_times(words: list[str], start: float, end: float) -> list[tuple[str, float, float]]:
    """Times in proportion to length: the double of a forced aligner."""
    total, at, out = sum(map(len, words)) or 1, start, []
    for word in words:
        step = (end - start) * len(word) / total
        out.append((word, at, at + step))
        at += step
    return out


def aligned(segments: DataFrame, align: Callable[[list[str], float, float], list[tuple[str, float, float]]] = word_times) -> DataFrame:
    """file_id, word_idx, word, start_ms, end_ms of the words of segments (file_id, seg_idx, start_ms, end_ms, text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for file_id, seg, start, end, text in zip(pdf["file_id"], pdf["seg_idx"], pdf["start_ms"], pdf["end_ms"], pdf["text"], strict=True):
                rows += [(file_id, 100_000 * seg + k, w, round(s), round(e)) for k, (w, s, e) in enumerate(align((text or "").split(), float(start), float(end)))]
            yield pd.DataFrame(rows, columns=["file_id", "word_idx", "word", "start_ms", "end_ms"])

    kind = dict(segments.dtypes)["file_id"]
    out = segments.select(F.col("file_id").cast("string").alias("file_id"), "seg_idx", "start_ms", "end_ms", "text").mapInPandas(run, "file_id string, word_idx long, word string, start_ms long, end_ms long")
    return out.withColumn("file_id", F.col("file_id").cast(kind))
