"""The stored memory (S01-S15): a ledger of requests, segments and vectors as Parquet, all append-only.

A batch is written under its own number, ledger last, so a batch that failed half-way leaves no trace that counts: readers
take segments and vectors only of batches that the ledger or the vector commits list. Writing a batch again replaces its files.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import constants as C
from ..operators import coerce as P
from ..operators import segments as G
from .scratch import cut

#: The stored schemas.
LEDGER_SCHEMA = "user_id string, request_id string, session_id string, payload_sha string, bucket int, batch long"
SEGMENT_SCHEMA = (
    "user_id string, id string, session_id string, request_id string, seq int, part int, total int, role string, speaker_name string, ts_value timestamp, "
    "ts_granularity string, ts_provenance string, text string, content_sha string, is_rule boolean, bucket int, batch long"
)
VECTOR_SCHEMA = "user_id string, id string, embedding array<float>, bucket int, batch long"
SCHEMAS = {"requests": LEDGER_SCHEMA, "segments": SEGMENT_SCHEMA, "vectors": VECTOR_SCHEMA}


class Store:
    """A folder with the tables requests, segments and vectors. All are split by a hash bucket of the user, so a scan for
    given users, and a batch of requests, read their buckets only. The schemas are stored beside them (S12): a store that was
    written with others is stale and refuses to be read or written until rebuild() drops its tables."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 16):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    # reading ----------------------------------------------------------------------------------------------------------

    def _exists(self, name: str) -> bool:
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(where)

    def stale(self) -> bool:
        """Whether the store was written with other schemas."""
        if not self._exists("schema"):
            return False
        held = {r["name"]: r["ddl"] for r in self.spark.read.parquet(f"{self.path}/schema").collect()}  # three rows
        return held != SCHEMAS

    def create(self) -> None:
        """Note the schemas of a new store."""
        if not self._exists("schema"):
            self.spark.createDataFrame(sorted(SCHEMAS.items()), "name string, ddl string").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/schema")
        elif self.stale():
            raise ValueError(f"{self.path} was written with other schemas; rebuild() drops its tables")

    def rebuild(self) -> None:
        """Drop the tables of a stale store, whose rows can be replayed, and begin anew."""
        if self.stale():
            jvm = self.spark.sparkContext._jvm
            for name in (*SCHEMAS, "schema"):
                where = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
                where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        self.create()

    def _table(self, name: str, schema: str) -> DataFrame:
        if self.stale():
            raise ValueError(f"{self.path} was written with other schemas; rebuild() drops its tables")
        if not self._exists(name):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/{name}").parquet(f"{self.path}/{name}")

    def ledger(self) -> DataFrame:
        """S07."""
        return self._table("requests", LEDGER_SCHEMA)

    def bucket(self, user: str | None = None):
        return F.pmod(F.hash(F.lit(user) if user is not None else F.col("user_id")), F.lit(self.buckets)).cast("int")

    def segments(self, users: list[str] | None = None) -> DataFrame:
        """The segments of all users, or of some, each with its newest vector or null."""
        seg, vec = self._table("segments", SEGMENT_SCHEMA), self._table("vectors", VECTOR_SCHEMA)
        if users is not None:
            held = self.spark.range(1).select(F.array_distinct(F.array(*[self.bucket(u) for u in users])).alias("b")).first()["b"] if users else []
            seg, vec = (t.where(F.col("bucket").isin(held) & F.col("user_id").isin(users)) for t in (seg, vec))
        seg = seg.join(self.ledger().select("batch").distinct(), "batch", "left_semi")
        newest = vec.withColumn("__n", F.row_number().over(W.partitionBy("user_id", "id").orderBy(F.desc("batch")))).where("__n = 1")
        return seg.join(newest.select("user_id", "id", "embedding"), ["user_id", "id"], "left").select(*G.SEGMENT_COLUMNS, "embedding")

    def pending_vectors(self, limit: int | None = None) -> DataFrame:
        """Segments without a vector; at most limit of them, if given."""
        pending = self.segments().where("embedding is null")
        return pending if limit is None else pending.limit(limit)

    def anchor_vectors(self, wanted: DataFrame) -> DataFrame:
        """Vectors of the segments (user_id, id) in wanted."""
        return self.segments().where("embedding is not null").join(wanted, ["user_id", "id"], "left_semi").select("user_id", "id", "embedding")

    def health(self) -> DataFrame:
        """Ok, whether the store is there and of the present schemas."""
        return self.spark.range(1).select(F.lit(self._exists("schema") and not self.stale()).alias("ok"))

    # writing ----------------------------------------------------------------------------------------------------------

    def _write(self, df: DataFrame, name: str, batch: int) -> None:
        parts = [c for c in ("bucket",) if c in df.columns]
        writer = df.write.mode("overwrite")
        (writer.partitionBy(*parts) if parts else writer).parquet(f"{self.path}/{name}/batch={batch}")

    def next_batch(self) -> int:
        return (self.ledger().agg(F.max("batch")).first()[0] or 0) + 1

    def add(self, requests: DataFrame, batch: int | None = None, embed: Callable[[DataFrame], DataFrame] | None = None, keep_pending: bool = False) -> DataFrame:
        """Requests (user_id, request_id, session_id, payload_sha, messages, arrival) -> a response for each:
        success, request_id, user_id, session_id, status. Accepted ones are stored; replays change nothing; conflicts are
        refused. embed (see embedder()) gives vectors at once; a request of which a vector fails is not stored and is
        unavailable, to be sent again. With keep_pending it is stored, and backfill() is to find the vectors."""
        self.create()
        batch = self.next_batch() if batch is None else batch
        held = [r["b"] for r in requests.select(self.bucket().alias("b")).distinct().collect()]  # at most self.buckets
        ledger = self.ledger().where(F.col("bucket").isin(held) & (F.col("batch") != batch))
        gated = cut(G.idempotency_gate(requests, ledger.select("user_id", "request_id", "payload_sha")), "gated")
        accepted = gated.where("status = 'accepted'")
        sessions = accepted.select("user_id", "session_id").distinct()
        old = self._table("segments", SEGMENT_SCHEMA).where(F.col("bucket").isin(held))
        state = G.session_state(old.join(ledger.select("batch").distinct(), "batch", "left_semi").join(sessions, ["user_id", "session_id"], "left_semi"))
        new = G.build_segments(accepted, state).withColumn("bucket", self.bucket())
        failed = None
        if embed is not None:
            new = cut(new, "new")
            vectors = cut(embed(G.embed_inputs(new)), "vectors")
            if not keep_pending:
                failed = cut(G.attach_vectors(new, vectors).where("embedding is null").select("user_id", "request_id").distinct(), "failed")
                if failed.isEmpty():
                    failed = None
                else:  # numbers and times are given as if the failed requests had not been sent
                    accepted = accepted.join(failed, ["user_id", "request_id"], "left_anti")
                    new = cut(G.build_segments(accepted, state).withColumn("bucket", self.bucket()), "new")
        self._write(new, "segments", batch)
        if embed is not None:
            found = G.attach_vectors(new, vectors).where("embedding is not null")
            self._write(found.select("user_id", "id", "embedding", "bucket"), "vectors", batch)
        done = accepted.select("user_id", "request_id", "session_id", "payload_sha").withColumn("bucket", self.bucket())
        if not done.isEmpty():
            self._write(done, "requests", batch)
        status = F.col("status")
        if failed is not None:  # a repeated request in the batch fails with the first
            gated = gated.join(failed.withColumn("__failed", F.lit(True)), ["user_id", "request_id"], "left")
            status = F.when(F.col("__failed") & F.col("status").isin("accepted", "replay"), F.lit("unavailable")).otherwise(status)
        out = gated.withColumn("status", status)
        return out.select((~F.col("status").isin("conflict", "unavailable")).alias("success"), "request_id", "user_id", "session_id", "status")

    def update_vectors(self, vectors: DataFrame, batch: int) -> None:
        """Newer vectors (user_id, id, embedding) take the place of older ones; batch must rise."""
        self._write(vectors.select("user_id", "id", "embedding").withColumn("bucket", self.bucket()), "vectors", batch)

    def backfill(self, embed: Callable[[DataFrame], DataFrame], batch: int, limit: int | None = None) -> int:
        """One round of the background job: embed pending segments, all of them unless there is a limit, and store what came
        back; the number stored."""
        pending = cut(self.pending_vectors(limit).drop("embedding"), "pending")
        found = cut(G.attach_vectors(pending, embed(G.embed_inputs(pending))).where("embedding is not null").select("user_id", "id", "embedding"), "found")
        n = found.count()
        if n:
            self.update_vectors(found, batch)
        return n


def embedder(encode: Callable[[list[str]], list[list[float] | None]], batch: int = C.EMBED_BATCH, clip: int = C.EMBED_CLIP, tries: int = 4, wait: float = 1.0, workers: int = 4) -> Callable[[DataFrame], DataFrame]:
    """Encode, which turns up to `batch` texts into vectors and may raise, as a step over distinct texts
    (embed_text) -> (embed_text, embedding). Texts are clipped; a task has `workers` batches under way at a time; a batch is
    tried again after 1, 2 and 4 times `wait` seconds, then its vectors are null."""

    def one(texts: list[str]) -> list[list[float] | None]:
        import time

        for k in range(tries):
            try:
                found = encode([t[:clip] for t in texts])
                if len(found) != len(texts):
                    raise ValueError("one vector a text is due")
                return list(found)
            except Exception:
                if k + 1 < tries:
                    time.sleep(wait * 2**k)
        return [None] * len(texts)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from concurrent.futures import ThreadPoolExecutor

        with ThreadPoolExecutor(workers) as pool:
            for frame in frames:
                texts = frame["embed_text"].tolist()
                out = [v for part in pool.map(one, [texts[at : at + batch] for at in range(0, len(texts), batch)]) for v in part]
                yield pd.DataFrame({"embed_text": texts, "embedding": out})

    return lambda texts: texts.mapInPandas(run, "embed_text string, embedding array<float>")


def reranker(score: Callable[[str, list[str]], list[float]]) -> Callable[[DataFrame], DataFrame]:
    """Score, which gives a number for each document of a query and may raise, as the scorer of search(). A failed
    query has no scores, and so keeps its order. Windows have 200 rows at most, which bounds a group."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("rank")
        try:
            found = [float(x) for x in score(frame["q"].iloc[0], frame["content"].tolist())]
            if len(found) != len(frame):
                raise ValueError("one score a document is due")
        except Exception:
            return pd.DataFrame({"query_id": [], "pos": [], "rs": []})
        return pd.DataFrame({"query_id": frame["query_id"], "pos": frame["pos"], "rs": found})

    def scorer(head: DataFrame) -> DataFrame:
        kinds = dict(head.dtypes)
        return head.select("query_id", "pos", "rank", "q", "content").groupBy("query_id").applyInPandas(run, f"query_id {kinds['query_id']}, pos {kinds['pos']}, rs double")

    return scorer


def add_lines(store: Store, lines: DataFrame, batch: int | None = None, embed: Callable[[DataFrame], DataFrame] | None = None, keep_pending: bool = False) -> tuple[DataFrame, DataFrame]:
    """S01 with P01-P14: raw JSON lines (value, arrival) -> (responses, errors)."""
    good, bad = P.add_requests(lines)
    return store.add(good, batch, embed, keep_pending), bad
