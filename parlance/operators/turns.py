"""Turns of words for SQL users: ``SELECT * FROM turns(TABLE(words))``."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn
from pyspark.sql.types import DoubleType, StringType, StructField, StructType
from pyspark.sql.udtf import UserDefinedTableFunction
from pyspark.sql.functions import udtf

from parlance.operators.folds import FIELDS, Turns, stripped

NEEDED = ("file_id", "word_idx", "word", "speaker", "start_ms", "end_ms")
MAX_GAP, MAX_DUR, MAX_CHARS, MAX_WORD, LEAST = 500, 15_000, 80, 2_500, 50


class WordTurns:
    """The words of a file, in order of time, as turns (``sequence.words_to_turns``).

    ``analyze`` asks Spark to deal the table by file and to order it; a word that lasts too long is evened out over its
    characters, which wait in a heap until no earlier one can follow.  So the state is the open turn and those characters.
    """

    def __init__(self) -> None:
        self.fold = Turns(MAX_GAP, MAX_DUR, MAX_CHARS, False, lambda a, b, both: len(a) + len(b))
        self.heap: list[tuple] = []
        self.file_id = None

    @staticmethod
    def analyze(words: AnalyzeArgument) -> AnalyzeResult:
        if not words.isTable:
            raise ValueError("turns() takes a table: turns(TABLE(words))")
        missing = set(NEEDED) - set(words.dataType.names)
        if missing:
            raise ValueError(f"turns() needs the columns {', '.join(sorted(missing))}")
        kind = words.dataType["file_id"].dataType
        schema = StructType([StructField("file_id", kind), *(StructField(n, DoubleType()) for n in ("start_ms", "end_ms")), *(StructField(n, StringType()) for n in ("speaker", "text"))])
        return AnalyzeResult(schema=schema, partitionBy=[PartitioningColumn("file_id")], orderBy=[OrderingColumn("start_ms"), OrderingColumn("end_ms"), OrderingColumn("word_idx")])

    def eval(self, row) -> Iterator[tuple]:
        self.file_id, start, end = row["file_id"], row["start_ms"], row["end_ms"]
        word = stripped(row["word"] or "")
        if start is None or end is None or end <= start or not word:
            return
        yield from self.given(start)
        speaker = "SPEAKER_UNKNOWN" if row["speaker"] is None else row["speaker"]
        long, n = end - start > MAX_WORD, len(word)
        if long and n > 2:
            share = (end - start) / n
            pieces = [(word[i], start + i * share, start + (i + 1) * share) for i in range(n)]
        else:
            pieces = [(word, start, start + MAX_WORD if long else end)]
        for i, (text, low, high) in enumerate(pieces):
            if stripped(text):
                heapq.heappush(self.heap, (float(low), float(high), row["word_idx"] * 1000 + i, speaker, text))

    def given(self, before: float | None = None) -> Iterator[tuple]:
        """Turns that the pieces which start ``before`` finish (all pieces, if it is None)."""
        while self.heap and (before is None or self.heap[0][0] < before):
            piece = heapq.heappop(self.heap)
            last = self.fold.open
            if last is not None and (last[FIELDS] != piece[FIELDS] or piece[0] - last[1] > MAX_GAP):
                yield from self.whole(self.fold.rest())
                self.fold.open = None
            yield from self.whole(self.fold.push(piece))

    def whole(self, turns) -> Iterator[tuple]:
        for start, end, _, speaker, text in turns:
            if stripped(text) and end - start >= LEAST:
                yield self.file_id, start, end, speaker, text

    def terminate(self) -> Iterator[tuple]:
        yield from self.given()
        yield from self.whole(self.fold.rest())


def register(spark: SparkSession, name: str = "turns") -> UserDefinedTableFunction:
    """Makes the table function known to the session's SQL."""
    return spark.udtf.register(name, udtf(WordTurns))
