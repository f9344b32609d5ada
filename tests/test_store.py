"""The store, ingestion and search contract on small hand-written cases."""

import json
import time

import pytest
from pyspark.sql import functions as F

from tessera.operators import channels as CH
from tessera.operators import coerce as P
from tessera.operators import fusion as FU
from tessera.operators import index as I
from tessera.operators import segments as G
from tessera.sources.store import Store, add_lines, embedder, reranker
from tessera.streaming.ingest import add_stream, backfill_all


def lines(spark, *bodies):
    return spark.createDataFrame([(json.dumps(b), k) for k, b in enumerate(bodies)], "value string, arrival long")


def body(request, user="u", session="s", *messages):
    return {"request_id": request, "user_id": user, "session_id": session, "messages": [m if isinstance(m, dict) else {"role": "user", "content": m} for m in messages]}


def statuses(responses):
    return sorted((r["request_id"], r["status"], r["success"]) for r in responses.collect())


def test_replay_conflict_and_isolation(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    a = body("r1", "u", "s", {"role": "user", "content": "hello", "timestamp": 1683504000000}, "again")
    first, errors = add_lines(store, lines(spark, a, a, body("r1", "u", "s", "other")))
    assert statuses(first) == [("r1", "accepted", True), ("r1", "conflict", False), ("r1", "replay", True)] and errors.count() == 0
    second, _ = add_lines(store, lines(spark, a, body("r1", "v", "s", "mine"), body("r2", "u", "s", "later", "   ")))
    assert statuses(second) == [("r1", "accepted", True), ("r1", "replay", True), ("r2", "accepted", True)]
    rows = {(r["user_id"], r["id"]): r for r in store.segments().collect()}
    assert sorted(rows) == [("u", "s#1.1"), ("u", "s#2.1"), ("u", "s#3.1"), ("v", "s#1.1")]
    assert rows["u", "s#1.1"]["ts_granularity"] == "date" and rows["u", "s#2.1"]["ts_provenance"] == "inherited"
    assert rows["u", "s#3.1"]["ts_provenance"] == "inherited" and rows["v", "s#1.1"]["ts_granularity"] == "unknown"
    assert {r["id"] for r in store.segments(["v"]).collect()} == {"s#1.1"}


def test_a_repeated_batch_is_stored_once(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    batch = lines(spark, body("r1", "u", "s", "one"), body("r2", "u", "s", "two"))
    for _ in range(2):
        out, _ = add_lines(store, batch, 1)
        assert statuses(out) == [("r1", "accepted", True), ("r2", "accepted", True)]
    assert store.segments().count() == 2 and store.ledger().count() == 2


def test_half_written_batch_does_not_count(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    add_lines(store, lines(spark, body("r1", "u", "s", "one")), 1)
    good, _ = P.add_requests(lines(spark, body("r2", "u", "s", "lost")))
    store._write(G.build_segments(good).withColumn("bucket", store.bucket()), "segments", 2)
    assert [r["text"] for r in store.segments().collect()] == ["one"]


def test_stream_equals_batch(spark, tmp_path):
    bodies = [body(f"r{k}", f"u{k % 3}", "s", *[f"message {k} {j}." for j in range(4)]) | {"arrival": k} for k in range(12)]
    (tmp_path / "in").mkdir()
    for k in range(3):
        (tmp_path / "in" / f"{k}.txt").write_text("\n".join(json.dumps(b) for b in bodies[4 * k : 4 * k + 4]) + "\n{broken\n")
    stream, batch = Store(spark, str(tmp_path / "a")), Store(spark, str(tmp_path / "b"))
    for _ in range(2):  # a second run over the same checkpoint adds nothing
        add_stream(spark.readStream.text(str(tmp_path / "in")), stream, str(tmp_path / "check")).awaitTermination()
    add_lines(batch, lines(spark, *bodies))
    key = lambda s: sorted((r["user_id"], r["id"], r["text"]) for r in s.segments().collect())
    assert key(stream) == key(batch) and len(key(batch)) == 48
    assert spark.read.parquet(str(tmp_path / "a/errors")).where("loc = 'body'").count() == 3


def test_vectors_backfill_and_retry(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))

    def encode(texts):
        if any("bad" in t for t in texts):
            raise RuntimeError("no vectors")
        return [[float(len(t)), 1.0] for t in texts]

    embed = embedder(encode, batch=1, tries=2, wait=0.0)
    add_lines(store, lines(spark, body("r1", "u", "s", "one", "bad", "one")), 1, embed, keep_pending=True)
    got = {r["id"]: r["embedding"] for r in store.segments().collect()}
    assert got["s#1.1"] == got["s#3.1"] == [9.0, 1.0] and got["s#2.1"] is None
    assert [r["id"] for r in store.pending_vectors().collect()] == ["s#2.1"]
    assert backfill_all(store, embed, 2) == 0
    assert backfill_all(store, embedder(lambda ts: [[0.5, 0.5] for _ in ts]), 3) == 1
    assert store.pending_vectors().count() == 0 and store.segments().count() == 3
    wanted = spark.createDataFrame([("u", "s#2.1")], "user_id string, id string")
    assert store.anchor_vectors(wanted).first()["embedding"] == [0.5, 0.5]
    assert store.health().first()["ok"]


def test_add_without_all_vectors_is_refused(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))

    def encode(texts):
        if any("bad" in t for t in texts):
            raise RuntimeError("no vectors")
        return [[float(len(t))] for t in texts]

    requests = lines(spark, body("r1", "u", "s", "one"), body("r2", "u", "s", "two", "bad"), body("r2", "u", "s", "two", "bad"), body("r3", "u", "s", "three"))
    out, _ = add_lines(store, requests, 1, embedder(encode, batch=1, tries=1))
    assert statuses(out) == [("r1", "accepted", True), ("r2", "unavailable", False), ("r2", "unavailable", False), ("r3", "accepted", True)]
    assert sorted((r["id"], r["text"]) for r in store.segments().collect()) == [("s#1.1", "one"), ("s#2.1", "three")]
    assert store.pending_vectors().count() == 0
    out, _ = add_lines(store, requests, 2, embedder(lambda ts: [[1.0] for _ in ts]))
    assert statuses(out) == [("r1", "replay", True), ("r2", "accepted", True), ("r2", "replay", True), ("r3", "replay", True)]
    assert store.segments().count() == 4


def test_batches_of_vectors_run_side_by_side(spark):
    def encode(texts):
        time.sleep(0.5)
        return [[1.0] for _ in texts]

    texts = spark.createDataFrame([(f"t{k}",) for k in range(8)], "embed_text string").coalesce(1)
    texts.mapInPandas(lambda frames: frames, "embed_text string").collect()  # the worker is there
    began = time.time()
    assert embedder(encode, batch=1)(texts).count() == 8 and time.time() - began < 3.5


def test_stale_schema_is_found(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    assert not store.health().first()["ok"]
    add_lines(store, lines(spark, body("r1", "u", "s", "one")), 1)
    assert store.health().first()["ok"] and not store.stale()
    spark.createDataFrame([("segments", "id string")], "name string, ddl string").write.mode("overwrite").parquet(str(tmp_path / "store/schema"))
    assert store.stale() and not store.health().first()["ok"]
    for use in (store.segments, lambda: add_lines(store, lines(spark, body("r2", "u", "s", "two")), 2)):
        with pytest.raises(ValueError, match="rebuild"):
            use()
    store.rebuild()
    assert store.segments().count() == 0 and store.health().first()["ok"]


@pytest.fixture(scope="module")
def index(spark):
    rows = [
        ("c1", ["I met Caroline in Paris.", "Caroline: it rained", "From now on always be brief.", "nothing here"]),
        ("c2", ["the weather was fine", "did Caroline call on 2023-05-08?", "never write long answers"]),
    ]
    requests = [body(f"r-{s}", "u", s, *[{"role": "user", "content": t, "timestamp": 1683504000000 + 1000 * k + (0 if s == "c1" else 86400000 * 30)} for k, t in enumerate(texts)]) for s, texts in rows]
    good, _ = P.add_requests(lines(spark, *requests))
    return I.build_index(G.build_segments(good)).persist()


def ask(spark, index, query, k=20, options=None, user="u", **more):
    q = spark.createDataFrame([(1, user, query, options, k)], "query_id long, user_id string, query string, options array<string>, top_k int")
    return FU.search(q, index, **more).orderBy("place").collect()


def test_search_renders_and_orders(spark, index):
    got = ask(spark, index, "what about Caroline in Paris")
    assert got[0]["content"] == "[2023-05-08 (Mon)] user: I met Caroline in Paris." and got[0]["created_at"] == "2023-05-08"
    assert [r["place"] for r in got] == list(range(len(got)))
    spoken = [r for r in got if r["id"] == "c1#2.1"][0]
    assert spoken["content"] == "[2023-05-08 (Mon) 00:00:01] Caroline: it rained" and spoken["created_at"] == "2023-05-08T00:00:01Z"


def test_empty_and_unknown(spark, index):
    assert ask(spark, index, "") == [] and ask(spark, index, "anything", user="nobody") == []
    assert ask(spark, index, "", options=["Paris"])[0]["id"] == "c1#1.1"
    for q in ("when was 2023-02-30", "when 2023-99-01", "when 9999-12-31", "when 0001-01-01", "when 0999-01-01"):
        ask(spark, index, q)


def test_rules_only_for_tasks(spark, index):
    ids = lambda q: [r["id"] for r in ask(spark, index, q, k=10)]
    assert "c2#3.1" not in ids("what rained in Paris") and {"c1#3.1", "c2#3.1"} <= set(ids("please write about Paris"))


def test_neighbors_move_in(spark, index):
    assert len(ask(spark, index, "Paris", k=10)) == 1
    assert [r["id"] for r in ask(spark, index, "Paris", k=40)] == ["c1#1.1", "c1#2.1"]


def test_temporal_channel(spark, index):
    q = CH.prepare_queries(spark.createDataFrame([(1, "u", "when was May 10, 2023", None, 20)], "query_id long, user_id string, query string, options array<string>, top_k int"))
    got = {r["id"] for r in CH.date(q, index).join(index.rows.select("user_id", "pos", "id"), ["user_id", "pos"]).collect()}
    assert {"c1#1.1", "c1#4.1"} <= got and "c2#1.1" not in got


def test_budget_skips_whole_items(spark, index):
    one = ask(spark, index, "Caroline Paris rained call", budget=20)
    assert len(one) == 1 and one[0]["score"] > 0


def test_rerank_and_its_failure(spark, index):
    base = [r["id"] for r in ask(spark, index, "Caroline Paris rained")]
    admitted = [r["id"] for r in ask(spark, index, "Caroline Paris rained", k=10)]  # too few for neighbours, which come in after reranking
    turned = [r["id"] for r in ask(spark, index, "Caroline Paris rained", k=10, scorer=reranker(lambda q, docs: [float(k) for k in range(len(docs))]))]
    assert len(admitted) > 1 and turned == admitted[::-1]

    def broken(q, docs):
        raise RuntimeError

    for scorer in (reranker(broken), reranker(lambda q, docs: [float("nan")] * len(docs)), reranker(lambda q, docs: [1.0])):
        assert [r["id"] for r in ask(spark, index, "Caroline Paris rained", scorer=scorer)] == base


def test_rerank_must_rows_enter_the_window(spark):
    order = spark.createDataFrame([(1, "u", p, p, 1.0 - p / 10) for p in range(6)], "query_id long, user_id string, pos int, rank int, score double")
    must = spark.createDataFrame([(1, 5, 0)], "query_id long, pos int, seq int")
    rs = spark.createDataFrame([(1, p, float(p)) for p in (0, 1, 5)], "query_id long, pos int, rs double")
    got = [r["pos"] for r in FU.apply_rerank(order, rs, must, window=3).orderBy("rank").collect()]
    assert got == [5, 1, 0, 2, 3, 4]


def test_second_hop_with_reranker(spark, index):
    got = ask(spark, index, "how many times did Caroline call", hop=True, scorer=reranker(lambda q, docs: [float(len(d)) for d in docs]))
    assert got and len({r["id"] for r in got}) == len(got)


def test_index_write_and_read(spark, index, tmp_path):
    index.write(str(tmp_path / "i"))
    back = I.Index.read(spark, str(tmp_path / "i"), vectors=False)
    a, b = ([tuple(r) for r in ask(spark, i, "what about Caroline in Paris")] for i in (index, back))
    assert a == b


def test_bm25_of_a_hand_computed_corpus(spark, index):
    from math import log

    q = CH.prepare_queries(spark.createDataFrame([(1, "u", "rained", None, 5)], "query_id long, user_id string, query string, options array<string>, top_k int"))
    hit = CH.bm25(q, index).collect()
    stats = index.stats.first()
    dl = index.postings.where("term = 'rained'").first()["dl"]
    idf = log(stats["n_rows"] - 1 + 0.5) - log(1.5)
    assert len(hit) == 1 and abs(hit[0]["score"] - idf * 2.5 / (1 + 1.5 * (0.25 + 0.75 * dl / stats["avgdl"]))) < 1e-9


def test_sequence_and_time_across_batches(spark):
    state = spark.createDataFrame([("u", "s", 7)], "user_id string, session_id string, last_seq int").withColumns({"last_ts": F.lit("2024-01-01 00:00:00").cast("timestamp"), "last_granularity": F.lit("date")})
    good, _ = P.add_requests(lines(spark, body("r", "u", "s", "a", {"role": "user", "content": "b", "timestamp": 1704200000000}, "c"), body("q", "u", "s", "d"), body("p", "u", "t", "e")))
    got = {r["text"]: r for r in G.build_segments(good, state).collect()}
    assert [got[x]["seq"] for x in "abcd"] == [8, 9, 10, 11] and got["e"]["seq"] == 1
    assert got["a"]["ts_value"] == got["b"]["ts_value"] == got["c"]["ts_value"] == got["d"]["ts_value"] and got["e"]["ts_value"] is None
