"""Report sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def memories_by_speaker(results: DataFrame, questions: DataFrame, first: str = "user", second: str = "assistant") -> DataFrame:
    """One row per question with its memories, joined by newlines in result order, the second speaker's apart. The
    speaker is what stands between the date header and the colon; who is not the second speaker counts as the first."""
    speaker = F.btrim(F.regexp_extract("content", r"\A\[[^\]]*\]\s+([^:]+):", 1))
    d = results.withColumn("__second", speaker == second)
    pick = lambda cond: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct("place", "content")))), lambda s: s["content"]), "\n")
    lists = d.groupBy("query_id").agg(pick(~F.col("__second")).alias("speaker_1_memories"), pick(F.col("__second")).alias("speaker_2_memories"))
    out = questions.join(lists, "query_id", "left")
    return out.withColumns({
        "speaker_1_name": F.lit(first), "speaker_2_name": F.lit(second),
        "speaker_1_memories": F.coalesce("speaker_1_memories", F.lit("")), "speaker_2_memories": F.coalesce("speaker_2_memories", F.lit("")),
    })


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON lines; null fields are written too."""
    df.write.mode(mode).option("ignoreNullFields", False).json(path)
