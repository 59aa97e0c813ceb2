"""Language-model passes over transcripts: correction, intents, speaker consistency, summary.

Prompts are built by Column functions; a batch of segments is one row, so a pass is one call a row in
``mapInPandas``, however the files are spread.  Answers are parsed and applied by joins.  A client is
made once a worker by ``make()``, which travels to it with the task.

Nulls: a null text is blank and is not shown to the model; its number is not given to another.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StringType, StructField, StructType

from parlance.functions import parsing
from parlance.functions import text as T
from parlance.models.answers import AnswerLog, each_answered
from parlance.models.clients import ChatClient
from parlance.operators.predicates import accept_correction
from parlance.operators.relations import first_utterances, merge_speakers

CORRECTED_A_CALL, TAGGED_A_CALL, CONTEXT = 15, 20, 15

# Intent labels in both languages, in order; the first is the default
LABELS = {
    "zh": ("陈述", "提问", "回答", "同意", "反对", "提议", "总结", "命令", "澄清", "确认", "打断", "寒暄", "回应", "旁白", "引述", "转场", "介绍", "评论"),
    "en": ("statement", "question", "answer", "agree", "disagree", "proposal", "summary", "command", "clarification", "confirmation", "interruption", "smalltalk", "acknowledgment", "narration", "quotation", "transition", "introduction", "commentary"),
}

CORRECT = {
    "en": ("You correct speech recognition errors in transcripts. Answer with JSON: {\"segments\": [{\"index\": 0, \"text\": \"...\", \"note\": null}]}.", "Correct only clear recognition errors below and leave everything else as it is.\n\n"),
    "zh": ("你修正语音转写中的识别错误。只输出 JSON：{\"segments\": [{\"index\": 0, \"text\": \"...\", \"note\": null}]}。", "只修正下面明确的识别错误，其余保持原样。\n\n"),
}
TAG = {
    "en": "Give every utterance all intents that apply, of these: {labels}. Answer with JSON: {{\"intents\": [{{\"index\": 0, \"intents\": [\"statement\"]}}]}}.",
    "zh": "为每句话标注所有适用的意图，可选：{labels}。只输出 JSON：{{\"intents\": [{{\"index\": 0, \"intents\": [\"陈述\"]}}]}}。",
}
CONSISTENT = {
    "en": ("You check speaker labels. Answer with JSON: {\"merge_suggestions\": [{\"from\": \"A\", \"to\": \"B\"}]}.", "Are these speaker labels consistent?\n\n"),
    "zh": ("你检查说话人标注。只输出 JSON：{\"merge_suggestions\": [{\"from\": \"A\", \"to\": \"B\"}]}。", "以下说话人标注是否一致？\n\n"),
}
SUMMARY_KEYS = ("topic", "summary", "key_points", "decisions", "action_items", "participants")
SUMMARIZE = {
    "en": ("You summarise conversations. Answer with one JSON object of topic, summary, key_points, decisions, action_items, participants.", "Summarise this conversation:\n\n"),
    "zh": ("你为对话写摘要。只输出一个 JSON 对象：topic、summary、key_points、decisions、action_items、participants。", "请为以下对话写摘要：\n\n"),
}


def language_of(table: dict, language: str):
    return table["en" if language == "en" else "zh"]


def asked(calls: DataFrame, make: Callable[[], ChatClient], system: str, temperature: float, max_tokens: int, log: str | None = None) -> DataFrame:
    """``calls`` with ``answer`` and ``call_error`` in place of ``prompt``: one chat a row, answer null where the client fails.

    With ``log``, a folder that all machines share, answers are kept there before they are used (``answers.AnswerLog``), so
    a task that runs again asks only what has no answer.
    """
    rest = [f for f in calls.schema.fields if f.name != "prompt"]
    schema = StructType([*rest, StructField("answer", StringType()), StructField("call_error", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        client, kept = make(), AnswerLog(log) if log else None
        kind = to_arrow_schema(schema)
        for batch in batches:
            both = list(each_answered(batch.column("prompt").to_pylist(), client, system, kept, temperature=temperature, max_tokens=max_tokens))
            columns = [batch.column(f.name) for f in rest] + [pa.array([x[k] for x in both], pa.string()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(columns, kind.types, strict=True)], schema=kind)

    return calls.mapInArrow(run, schema)


def numbered(segments: DataFrame, size: int) -> DataFrame:
    """Segments with their batch of ``size`` in the file's order and their index in it."""
    place = F.row_number().over(W.partitionBy("file_id").orderBy("seg_idx")) - 1
    return segments.withColumn("_place", place).withColumn("batch", F.floor(F.col("_place") / size).cast("int")).withColumn("index", (F.col("_place") % size).cast("int")).drop("_place")


def lines(segments: DataFrame, line: Column, opening: str, keys: list[str]) -> DataFrame:
    """keys, prompt, count: the lines of each batch in order, blank texts left out without renumbering."""
    shown = F.when(T.strip(F.coalesce("text", F.lit(""))) != "", line)
    rows = segments.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("seg_idx", shown.alias("line")))).alias("rows"), F.count("*").cast("int").alias("count"))
    kept = F.filter(F.transform("rows", lambda x: x["line"]), lambda x: x.isNotNull())
    return rows.select(*keys, F.concat(F.lit(opening), F.array_join(kept, "\n")).alias("prompt"), "count")


def transcript_line() -> Column:
    return F.format_string("[%d] %s %s: %s", F.col("index"), T.stamp(F.col("start_ms") / 1000), F.coalesce("speaker", F.lit("UNKNOWN")), F.col("text"))


def correction_calls(segments: DataFrame, language: str = "zh") -> DataFrame:
    """file_id, batch, prompt, count: what the corrector is asked, 15 segments a call."""
    cleaned = numbered(segments, CORRECTED_A_CALL).withColumn("text", T.clean_hallucination(F.coalesce("text", F.lit(""))))
    return lines(cleaned, transcript_line(), language_of(CORRECT, language)[1], ["file_id", "batch"])


def correct(segments: DataFrame, make: Callable[[], ChatClient], language: str = "zh", log: str | None = None) -> DataFrame:
    """``segments`` with corrected ``text``, ``text_before_llm`` and ``correction_note``.

    A correction that loses a number, or rewrites a call-out, is turned down (Chinese only); so is an empty one.
    """
    answers = asked(correction_calls(segments, language), make, language_of(CORRECT, language)[0], 0.1, 4096, log)
    parsed = parsing.parse_answers(answers.select(F.to_json(F.struct("file_id", "batch")).alias("answer_id"), "answer", "count"))
    key = F.from_json("answer_id", answers.select("file_id", "batch").schema)
    said = parsed.select(key.alias("k"), "index", F.col("text").alias("_new"), F.col("note").alias("_note")).select("k.file_id", "k.batch", "index", "_new", "_note")
    out = numbered(segments, CORRECTED_A_CALL).join(said, ["file_id", "batch", "index"], "left")
    good = F.coalesce(accept_correction(T.strip(F.coalesce("text", F.lit(""))), F.col("_new"), language == "zh"), F.lit(False))
    out = out.withColumn("text_before_llm", F.col("text")).withColumn("correction_note", F.when(good, F.col("_note"))).withColumn("text", F.when(good, F.col("_new")).otherwise(F.col("text")))
    return out.drop("batch", "index", "_new", "_note")


def intents_of(answer: str | None, count: int, default: list[str], allowed: tuple[str, ...] | None) -> list[list[str]]:
    """The labels of each index; the default where the answer has none that is allowed."""
    out = [list(default) for _ in range(count)]
    found = re.search(r"\{.*\}", answer or "", re.DOTALL)
    try:
        value = json.loads(found[0]) if found else {}
    except ValueError:
        return out
    listed = value.get("intents") if isinstance(value, dict) else None
    for item in listed if isinstance(listed, list) else ():
        if not isinstance(item, dict):
            continue
        index, raw = item.get("index"), item.get("intents") or item.get("intent")
        labels = [s.strip() for s in ([raw] if isinstance(raw, str) else raw if isinstance(raw, list) else []) if isinstance(s, str) and s.strip()]
        labels = [s for s in labels if not allowed or s in allowed]
        if isinstance(index, int) and 0 <= index < count and labels:
            out[index] = labels
    return out


def tag_intents(segments: DataFrame, make: Callable[[], ChatClient], language: str = "zh", labels: tuple[str, ...] | None = None, log: str | None = None) -> DataFrame:
    """``segments`` with ``intent``: their labels, 20 segments a call."""
    labels = labels or language_of(LABELS, language)
    default = [language_of(LABELS, language)[0]]
    mine = numbered(segments, TAGGED_A_CALL)
    line = F.format_string("[%d] %s: %s", F.col("index"), F.coalesce("speaker", F.lit("UNKNOWN")), T.strip("text"))
    answers = asked(lines(mine, line, "", ["file_id", "batch"]), make, language_of(TAG, language).format(labels=", ".join(labels)), 0.0, 2048, log)

    @F.udf("array<struct<index:int,intent:array<string>>>", useArrow=True)
    def parsed(answer, count):
        return list(enumerate(intents_of(answer, count, default, labels)))

    said = answers.select("file_id", "batch", F.explode(parsed("answer", "count")).alias("x")).select("file_id", "batch", "x.index", "x.intent")
    return mine.drop("intent").join(said, ["file_id", "batch", "index"]).drop("batch", "index")


def merges_of(answer: str | None) -> list[tuple[str, str]]:
    found = re.search(r"\{.*\}", answer or "", re.DOTALL)
    try:
        value = json.loads(found[0]) if found else {}
    except ValueError:
        return []
    listed = value.get("merge_suggestions") if isinstance(value, dict) else None
    pairs = [(m.get("from"), m.get("to")) for m in listed or [] if isinstance(m, dict)]
    return [(a, b) for a, b in pairs if a and b and a != b]


def consistency_calls(segments: DataFrame, language: str = "zh") -> DataFrame:
    """file_id, prompt of the files with four segments or more: each speaker's first ten texts."""
    told = first_utterances(segments.where(T.strip(F.coalesce("text", F.lit(""))) != "").withColumn("text", T.strip("text")).withColumn("speaker", F.coalesce("speaker", F.lit("UNKNOWN"))))
    block = F.concat(F.lit("\n"), "speaker", F.lit(":\n"), F.array_join(F.transform("texts", lambda t: F.concat(F.lit("  - "), t)), "\n"))
    prompts = told.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("speaker", block.alias("block")))).alias("b"))
    prompts = prompts.select("file_id", F.concat(F.lit(language_of(CONSISTENT, language)[1] + "=== Speaker utterances ===\n"), F.array_join(F.transform("b", lambda x: x["block"]), "\n")).alias("prompt"))
    return prompts.join(segments.groupBy("file_id").agg(F.count("*").alias("n")).where("n >= 4").select("file_id"), "file_id", "left_semi")


def unify_speakers(segments: DataFrame, make: Callable[[], ChatClient], language: str = "zh", log: str | None = None) -> DataFrame:
    """``segments`` with speakers merged as a model suggests and ``consistency_note``; one pass, the last mapping of a speaker wins."""
    answers = asked(consistency_calls(segments, language), make, language_of(CONSISTENT, language)[0], 0.1, 2048, log)

    @F.udf("array<struct<from_speaker:string,to_speaker:string>>", useArrow=True)
    def parsed(answer):
        return merges_of(answer)

    merges = answers.select("file_id", F.posexplode(parsed("answer")).alias("merge_idx", "m")).select("file_id", "merge_idx", "m.*")
    out = merge_speakers(segments, merges)
    changed = F.col("speaker_original") != F.col("speaker")
    note = F.when(changed, F.concat(F.lit("merged "), "speaker_original", F.lit("→"), "speaker"))
    known = F.col("consistency_note") if "consistency_note" in segments.columns else F.lit(None).cast("string")
    return out.withColumn("consistency_note", F.coalesce(known, note))


def summary_of(answer: str | None, speakers: list[str]) -> dict:
    """The six parts of a summary; empty ones, and the speakers as participants, where the answer has none."""
    found = re.search(r"\{.*\}", answer or "", re.DOTALL)
    try:
        value = json.loads(found[0]) if found else {}
    except ValueError:
        value = {}
    value = value if isinstance(value, dict) else {}
    text = lambda v: v if isinstance(v, str) else "" if v is None else str(v)
    listed = lambda v: [text(x) for x in v] if isinstance(v, list) else []
    out = {k: text(value.get(k, "")) for k in SUMMARY_KEYS[:2]} | {k: listed(value.get(k)) for k in SUMMARY_KEYS[2:5]}
    return out | {"participants": listed(value["participants"]) if "participants" in value else speakers}


def summarize(segments: DataFrame, make: Callable[[], ChatClient], language: str = "zh", log: str | None = None) -> DataFrame:
    """file_id and the six parts; a file without segments has no row, one without texts empty parts."""
    rows = segments.withColumn("index", (F.row_number().over(W.partitionBy("file_id").orderBy("seg_idx")) - 1).cast("int"))
    line = F.format_string("[%d] %s: %s", F.col("index"), F.coalesce("speaker", F.lit("?")), F.col("text"))
    speakers = segments.where(T.strip(F.coalesce("text", F.lit(""))) != "").groupBy("file_id").agg(F.sort_array(F.collect_set(F.coalesce("speaker", F.lit("?")))).alias("speakers"))
    calls = lines(rows, line, language_of(SUMMARIZE, language)[1], ["file_id"]).join(speakers, "file_id", "left").withColumn("speakers", F.coalesce("speakers", F.array().cast("array<string>")))
    answers = asked(calls, make, language_of(SUMMARIZE, language)[0], 0.3, 2048, log)

    @F.udf("topic string, summary string, key_points array<string>, decisions array<string>, action_items array<string>, participants array<string>", useArrow=True)
    def parsed(answer, speakers):
        return summary_of(answer, list(speakers))

    return answers.select("file_id", parsed("answer", "speakers").alias("s")).select("file_id", "s.*")


class RollingContext:
    """Live correction with what was said before: up to ``CONTEXT`` segments a call, new ones last.

    History is cut to its last ``keep`` segments when it passes ``most``.
    """

    def __init__(self, client: ChatClient, language: str = "zh", context: int = 5, most: int = 200, keep: int = 100):
        self.client, self.language, self.context, self.most, self.keep = client, language, context, most, keep
        self.history: list[dict] = []

    def window(self, new: list[dict]) -> list[dict]:
        """The segments that one call shows."""
        n = max(0, min(self.context, CONTEXT - len(new)))
        return (self.history[-n:] if n else []) + new

    def process(self, new: list[dict]) -> list[dict]:
        """The new segments corrected and tagged; only they change, and they join the history."""
        if not new:
            return []
        shown = self.window(new)
        prompt = "\n".join(f"[{k}] {s.get('speaker') or 'UNKNOWN'}: {s.get('text') or ''}" for k, s in enumerate(shown) if (s.get("text") or "").strip())
        system, opening = language_of(CORRECT, self.language)
        out = [dict(s) for s in new]
        try:
            answer = self.client.chat([{"role": "system", "content": system}, {"role": "user", "content": opening + prompt}], temperature=0.1, max_tokens=4096)
            for index, text, note in parsing.corrections(answer, len(shown)):
                at = index - (len(shown) - len(new))
                if at >= 0:
                    out[at] |= {"text": text} | ({"correction_note": note} if note else {})
        except Exception:  # noqa: BLE001  a client that fails leaves the texts as they are
            out = [dict(s) for s in new]
        self.history += out
        if len(self.history) > self.most:
            self.history = self.history[-self.keep :]
        return out
