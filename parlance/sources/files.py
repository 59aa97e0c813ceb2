"""Finding files wherever Spark can read: listings, signatures, archives, datasets by name."""

from __future__ import annotations

import io
import tarfile
from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: the audio formats that are looked for
AUDIO_SUFFIXES = (".wav", ".flac", ".mp3", ".m4a", ".ogg")
#: dataset -> suffix of its audio files
DATASETS = {"aishell1": ".wav", "librispeech": ".flac"}


def listed(spark: SparkSession, path: str) -> DataFrame:
    """path, name, length, modified of the files at or below a path that are not empty; FileNotFoundError if there is no such path.

    Contents are not read: Spark prunes the column.
    """
    try:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    except AnalysisException as missing:
        raise FileNotFoundError(path) from missing
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "length", F.col("modificationTime").alias("modified"))


def has_suffix(name: Column, suffixes: tuple[str, ...]) -> Column:
    """Whether a name ends in one of the suffixes, whatever its case."""
    low = F.lower(name)
    out = F.lit(False)
    for suffix in suffixes:
        out = out | F.endswith(low, F.lit(suffix))
    return out


def find_audio(spark: SparkSession, path: str) -> DataFrame:
    """Audio files at or below a path in order of path; FileNotFoundError if there are none."""
    found = listed(spark, path).where(has_suffix(F.col("name"), AUDIO_SUFFIXES))
    if found.isEmpty():
        raise FileNotFoundError(f"no audio file at {path}")
    return found.orderBy("path")


def results_in(spark: SparkSession, path: str) -> DataFrame:
    return listed(spark, path).where(has_suffix(F.col("name"), (".json",)) & ~F.startswith("name", F.lit("manual_corrected")))


def history(spark: SparkSession, path: str) -> DataFrame:
    """Saved results, the latest first; files of one time by path."""
    return results_in(spark, path).orderBy(F.col("modified").desc(), "path")


def signature(spark: SparkSession, path: str) -> tuple[int, float]:
    """(number of results, time of the latest change); (0, 0.0) for no such folder.  Equal signatures: nothing to reload."""
    try:
        row = results_in(spark, path).agg(F.count("*").alias("n"), F.max(F.unix_micros("modified")).alias("at")).first()
    except FileNotFoundError:
        return 0, 0.0
    return row["n"], (row["at"] or 0) / 1e6


class ResultCache:
    """Results of folders, read again only when a folder's signature has changed."""

    def __init__(self, spark: SparkSession, read):
        self.spark, self.read, self.known = spark, read, {}

    def get(self, path: str) -> DataFrame:
        now = signature(self.spark, path)
        if path not in self.known or self.known[path][0] != now:
            self.known[path] = now, self.read(self.spark, path)
        return self.known[path][1]


def find_parquet(spark: SparkSession, path: str) -> list[str]:
    """Parquet files at or below a path, sorted; ValueError for a file of another kind, FileNotFoundError for none.

    A listing of a meetings folder, which the caller reads as one DataFrame; file names only.
    """
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(at):
        raise FileNotFoundError(path)
    if not system.getFileStatus(at).isDirectory():
        if not path.lower().endswith(".parquet"):
            raise ValueError(f"not a Parquet file: {path}")
        return [path]
    found, files = [], system.listFiles(at, True)
    while files.hasNext():
        name = files.next().getPath().toString()
        if name.lower().endswith(".parquet"):
            found.append(name)
    if not found:
        raise FileNotFoundError(f"no Parquet file below {path}")
    return sorted(found)


def dataset_files(spark: SparkSession, path: str, dataset: str, max_files: int) -> DataFrame:
    """The first ``max_files`` audio files of a dataset in order of path; ValueError for an unknown dataset."""
    if dataset not in DATASETS:
        raise ValueError(f"unsupported dataset: {dataset}")
    return listed(spark, path).where(has_suffix(F.col("name"), (DATASETS[dataset],))).orderBy("path").limit(max_files)


def tar_members(spark: SparkSession, path: str, suffix: str = ".wav") -> DataFrame:
    """archive, member, utt_id, content of the members of all tar archives below a path.

    An archive that cannot be read to its end gives the members before the fault.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for archive, content in zip(pdf["path"], pdf["content"], strict=True):
                rows = []
                try:
                    with tarfile.open(fileobj=io.BytesIO(content)) as tar:
                        for member in tar:
                            if member.isfile() and member.name.lower().endswith(suffix):
                                stem = member.name.rsplit("/", 1)[-1]
                                rows.append((archive, member.name, stem[: -len(suffix)], tar.extractfile(member).read()))
                except (tarfile.TarError, EOFError, OSError):
                    pass
                yield pd.DataFrame(rows, columns=["archive", "member", "utt_id", "content"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).where(has_suffix(F.col("path"), (".tar.gz", ".tgz", ".tar")))
    return files.select("path", "content").mapInPandas(run, "archive string, member string, utt_id string, content binary")


def corpus_subset(members: DataFrame, known: DataFrame | None, max_files: int) -> DataFrame:
    """The first members in order of archive and name whose id is known (all ids, if none is named); an id counts once."""
    if known is not None and not known.isEmpty():
        members = members.join(known.select("utt_id").distinct(), "utt_id", "left_semi")
    order = F.struct("archive", "member")
    first = members.groupBy("utt_id").agg(F.min(order).alias("at")).orderBy("at").limit(max_files)
    return members.join(first.select("utt_id", F.col("at.archive").alias("archive"), F.col("at.member").alias("member")), ["utt_id", "archive", "member"])
