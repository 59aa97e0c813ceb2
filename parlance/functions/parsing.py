"""Tolerant parsing of model answers; plain Python, one value at a time, and a UDF for tables of them."""

from __future__ import annotations

import ast
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.functions.rewriting import parse_time_range, rewrite  # noqa: F401

# Names under which models give corrections
LISTS = ("segments", "corrections", "results", "items")
FIELDS = {"index": ("index", "id"), "text": ("text", "corrected_text", "correction"), "note": ("note", "reason")}
PLAIN_QUOTES = str.maketrans("\u201c\u201d\u2018\u2019", "\"\"''")
DANGLING = re.compile(r",(?=\s*[\]}])")
DECODER = json.JSONDecoder()
LITERALS = 20


def decoded(text: str) -> Iterator:
    """Every JSON value of a text that starts at a bracket and lies in no other."""
    at = 0
    while at < len(text):
        if text[at] in "{[":
            try:
                value, at = DECODER.raw_decode(text, at)
                yield value
                continue
            except ValueError:
                pass
        at += 1


def literals(text: str) -> Iterator:
    """The longest Python literal from a text's first bracket, if a closing one of the last ``LITERALS`` ends it."""
    starts = [k for k in (text.find("{"), text.find("[")) if k >= 0]
    ends = [m.end() for m in re.finditer(r"[\]}]", text)]
    for end in reversed(ends[-LITERALS:] if starts else []):
        try:
            yield ast.literal_eval(text[min(starts) : end])
            return
        except (ValueError, SyntaxError, MemoryError, RecursionError):
            continue


def values(answer: str | None) -> Iterator:
    """What can be read from an answer, the strictest readings first: as it is, without commas before a closing
    bracket, with plain quotes, and as a Python literal."""
    text = answer or ""
    quoted = text.translate(PLAIN_QUOTES)
    for form in dict.fromkeys((text, DANGLING.sub("", text), quoted, DANGLING.sub("", quoted))):
        yield from decoded(form)
    yield from literals(quoted)


def loose_json(answer: str | None):
    """The first value that can be read from an answer, or None."""
    return next(values(answer), None)


def entries(value) -> list[dict]:
    """Corrections in the shapes that models give: a list, a list under a known name, or numbered entries."""
    if isinstance(value, dict):
        named = [value[name] for name in LISTS if isinstance(value.get(name), list)]
        if named:
            value = named[0]
        elif all(isinstance(k, str) and k.isdigit() for k in value):
            value = [{"index": int(k)} | (v if isinstance(v, dict) else {"text": v}) for k, v in value.items()]
    return [x for x in value if isinstance(x, dict)] if isinstance(value, list) else []


def correction(entry: dict) -> tuple[int, str, str | None] | None:
    """(index, text, note) of an entry; None without a whole-number index of zero or more, or without text."""
    given = {field: [entry[n] for n in names if entry.get(n) is not None] for field, names in FIELDS.items()}
    index, text, notes = given["index"][:1], str(given["text"][0]).strip() if given["text"] else "", [n for n in given["note"] if n]
    if not text or not index or isinstance(index[0], bool) or not re.fullmatch(r"\d+", str(index[0])):
        return None
    return int(index[0]), text, str(notes[0]) if notes else None


def corrections(answer: str | None, count: int | None = None) -> list[tuple[int, str, str | None]]:
    """(index, text, note) of each correction below ``count``; of several for one index the last.

    The first value that holds a correction counts.
    """
    for value in values(answer):
        found = {c[0]: c for c in map(correction, entries(value)) if c}
        if found:
            return [found[k] for k in sorted(found) if count is None or k < count]
    return []


def parse_answers(answers: DataFrame) -> DataFrame:
    """Rows (answer_id, index, text, note) of a table of answers (answer_id, answer, count)."""
    kind = dict(answers.dtypes)["answer_id"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(i, *c) for i, a, n in zip(pdf["answer_id"], pdf["answer"], pdf["count"], strict=True) for c in corrections(a, None if pd.isna(n) else int(n))]
            yield pd.DataFrame(rows, columns=["answer_id", "index", "text", "note"])

    text = answers.select(F.col("answer_id").cast("string").alias("answer_id"), "answer", "count").mapInPandas(run, "answer_id string, index int, text string, note string")
    return text.withColumn("answer_id", F.col("answer_id").cast(kind))
