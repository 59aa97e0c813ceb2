"""Deterministic transcript relations over the supplied tables.

Each view is one SQL text that Spark and DuckDB both run, so queries and their oracles start from
the same rows.  Times are whole milliseconds until the end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "segments": """
        SELECT conv_id AS file_id, CAST(turn AS INT) AS seg_idx, role AS speaker, text, clock - dur_ms AS start_ms, clock AS end_ms,
               (clock - dur_ms) / CAST(1000 AS DOUBLE) AS start_s, clock / CAST(1000 AS DOUBLE) AS end_s
        FROM (SELECT *, CAST(SUM(dur_ms + gap_ms) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS clock
              FROM (SELECT conv_id, turn, role, coalesce(text, '') AS text, CAST(greatest(300, length(coalesce(text, '')) * 60) AS BIGINT) AS dur_ms, (conv_id * 7 + turn * 13) % 2500 AS gap_ms FROM conversations) a) b""",
    "diar": """
        SELECT file_id, seg_idx AS diar_idx, speaker, start_ms - 400 + (seg_idx * 137) % 900 AS start_ms, end_ms - 300 + (seg_idx * 211) % 700 AS end_ms
        FROM segments WHERE (file_id + seg_idx) % 5 <> 0 AND end_ms - 300 + (seg_idx * 211) % 700 > start_ms - 400 + (seg_idx * 137) % 900""",
    "vad": """
        SELECT file_id, seg_idx AS vad_idx, start_ms + (seg_idx * 53) % 400 AS start_ms, start_ms + (seg_idx * 53) % 400 + 200 * (seg_idx % 4) AS end_ms
        FROM segments WHERE seg_idx % 4 > 0""",
    "probs": """
        SELECT file_id, seg_idx, -((file_id * 31 + seg_idx * 17) % 120) / CAST(100 AS DOUBLE) AS avg_logprob, ((file_id * 13 + seg_idx * 29) % 100) / CAST(100 AS DOUBLE) AS no_speech_prob,
               ((file_id * 5 + seg_idx * 7) % 50) / CAST(100 AS DOUBLE) AS ratio FROM segments""",
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view over ``<sf_dir>/conversations.parquet``."""
    sql = with_views(f"SELECT * FROM {name}", name).replace("WITH RECURSIVE", "WITH").replace("FROM conversations", "FROM {conversations}")
    return spark.sql(sql, conversations=spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def with_views(sql: str, *names: str) -> str:
    """An oracle's SQL with the views it names in front."""
    wanted = ["segments", *(n for n in names if n != "segments")]
    return "WITH RECURSIVE " + ", ".join(f"{n} AS ({VIEWS[n]})" for n in wanted) + (", " if sql.lstrip().startswith(",") else "\n") + sql.lstrip().lstrip(",")
