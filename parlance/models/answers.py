"""A log of what outside models answered, in the shared folder, so that a task that runs again asks nobody twice.

An answer is a file of its own, named by the hash of model, prompts and settings, and moved into place whole, before
anything is made of it.  A failed call leaves its error beside the answers and is asked again by the next run.  Two tasks
that ask the same at the same moment may both be answered; the later answer replaces an equal question's.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class AnswerLog:
    """Answers below a path that workers and driver reach (``file://``, ``hdfs://``, ``s3://`` ...)."""

    def __init__(self, path: str):
        self.path = path.rstrip("/")
        self.system, self.root = fs.FileSystem.from_uri(self.path)

    def __reduce__(self):
        return AnswerLog, (self.path,)

    @staticmethod
    def key(model: str, messages: list[dict], **settings) -> str:
        return hashlib.sha256(json.dumps([model, messages, settings], sort_keys=True, ensure_ascii=False).encode()).hexdigest()

    def known(self, key: str) -> str | None:
        at = f"{self.root}/answers/{key[:2]}/{key}.json"
        if self.system.get_file_info(at).type != fs.FileType.File:
            return None
        with self.system.open_input_stream(at) as f:
            return json.loads(f.read())["answer"]

    def keep(self, key: str, record: dict, kind: str = "answers") -> None:
        folder = f"{self.root}/{kind}/{key[:2]}"
        self.system.create_dir(folder, recursive=True)
        draft = f"{folder}/.{key}-{uuid.uuid4().hex}"
        with self.system.open_output_stream(draft) as f:
            f.write(json.dumps(record, ensure_ascii=False).encode())
        self.system.move(draft, f"{folder}/{key}.json" if kind == "answers" else f"{folder}/{key}-{uuid.uuid4().hex}.json")

    def read(self, spark: SparkSession, kind: str = "answers") -> DataFrame:
        """The records of a kind (answers: model, answer; errors: model, error) with their keys."""
        schema = "model string, answer string, error string"
        rows = spark.read.schema(schema).option("recursiveFileLookup", True).json(f"{self.path}/{kind}")
        return rows.withColumn("key", F.regexp_extract(F.col("_metadata.file_name"), "^[0-9a-f]{64}", 0))


def answered(client, messages: list[dict], log: AnswerLog | None, **settings) -> tuple[str | None, str | None]:
    """Answer and error of one call: from the log if it is there, else asked for and kept first."""
    model = str(getattr(client, "model_name", type(client).__name__))
    key = AnswerLog.key(model, messages, **settings)
    found = log.known(key) if log else None
    if found is not None:
        return found, None
    try:
        found = client.chat(messages, **settings)
    except Exception as error:  # noqa: BLE001  whatever a client raises: no answer, and the reason is kept
        reason = f"{type(error).__name__}: {error}"
        if log:
            log.keep(key, {"model": model, "error": reason}, "errors")
        return None, reason
    if log and found is not None:
        log.keep(key, {"model": model, "answer": found})
    return found, None


def each_answered(prompts: Iterator[str], client, system: str, log: AnswerLog | None, **settings) -> Iterator[tuple[str | None, str | None]]:
    for prompt in prompts:
        yield answered(client, [{"role": "system", "content": system}, {"role": "user", "content": prompt}], log, **settings)
