"""Replay dataset readers and report sinks on files made here."""

import json

import pandas as pd

from tessera.functions import text as T
from tessera.sources import datasets as D
from tessera.sources import sinks

from pyspark.sql import functions as F


def test_sessions_json(spark, tmp_path):
    data = [
        {
            "conversation": {
                "speaker_a": "Ann", "speaker_b": "Bo", "session_2_date_time": "9:00 am on 9 May, 2023", "session_10_date_time": "1:56 pm on 10 May, 2023",
                "session_10": [{"speaker": "Ann", "text": "third", "dia_id": "D10:1"}],
                "session_2": [{"speaker": "Ann", "text": "first", "dia_id": "D2:1"}, {"speaker": "Bo", "text": "second", "blip_caption": "a cat", "dia_id": "D2:2"}],
            },
            "qa": [{"question": "q1", "answer": "x", "evidence": ["D2:1"], "category": 1}, {"question": "q2", "adversarial_answer": "no", "category": 5}],
        }
    ]
    (tmp_path / "a.json").write_text(json.dumps(data))
    m, q = D.read_sessions_json(spark, str(tmp_path / "a.json"))
    got = [(r["ord"], r["role"], r["content"], r["ref"]) for r in m.orderBy("ord").collect()]
    assert got == [(1, "user", "Ann: first", "D2:1"), (2, "assistant", "Bo: second [shared image: a cat]", "D2:2"), (3, "user", "Ann: third", "D10:1")]
    assert m.where("ord = 3").first()["timestamp_ms"] == 1683726960000.0
    rows = q.orderBy("qid").collect()
    assert (rows[0]["category"], rows[0]["answer"], rows[0]["gold"]) == ("multi-hop", "x", ["D2:1"]) and (rows[1]["answer"], rows[1]["gold"]) == ("no", [])


def test_haystack_json(spark, tmp_path):
    data = [
        {
            "question_id": "q", "question": "what", "question_type": "t", "question_date": "2023/05/30 (Tue) 10:00", "answer": 5, "answer_session_ids": ["b"], "haystack_session_ids": ["a", "b"],
            "haystack_dates": ["2023/05/20 (Sat) 02:21", "2023/05/21 (Sun) 02:21"], "haystack_sessions": [[{"role": "user", "content": "x"}, {"role": "user", "content": "  "}], [{"role": "assistant", "content": "y", "has_answer": True}]],
        }
    ]
    (tmp_path / "a.json").write_text(json.dumps(data))
    m, q = D.read_haystack_json(spark, str(tmp_path / "a.json"))
    assert [(r["ref"], r["content"], r["has_answer"], r["timestamp_ms"]) for r in m.orderBy("ord").collect()] == [("a", "x", False, 1684549260000.0), ("b", "y", True, 1684635660000.0)]
    assert q.first()["answer"] == "5" and q.first()["gold"] == ["b"]


def test_nested_parquet(spark, tmp_path):
    chat = [[{"role": "user", "content": "hi", "time_anchor": "March-15-2024"}, {"role": "system", "content": "no", "time_anchor": None}], [{"role": "assistant", "content": "yo", "time_anchor": None}]]
    probing = json.dumps({"recall": [{"question": "q", "rubric": ["r"]}, {"question": "", "rubric": ["r"]}], "order": [{"question": "o", "ideal_response": "i"}, {"question": "p"}]})
    pd.DataFrame({"conversation_id": ["c1"], "chat": [chat], "probing_questions": [probing]}).to_parquet(tmp_path / "a.parquet")
    m, q = D.read_nested_parquet(spark, str(tmp_path / "a.parquet"))
    assert [(r["session"], r["content"], r["timestamp_ms"]) for r in m.orderBy("ord").collect()] == [(0, "hi", 1710460800000.0), (1, "yo", None)]
    assert sorted((r["qid"], tuple(r["gold"])) for r in q.collect()) == [("c1:order:0", ("i",)), ("c1:recall:0", ("r",))]


def test_contexts(spark, tmp_path):
    turns = [{"role": "system", "content": "card"}, {"role": "user", "content": "a b"}, {"role": "tool", "content": "x"}, {"role": "assistant", "content": "c"}]
    (tmp_path / "c.jsonl").write_text(json.dumps({"ctx": turns}, ensure_ascii=False) + "\n")
    pd.DataFrame([{"question_id": "1", "question_type": "t", "user_question_or_message": "q", "all_options": "['yes', 'no']", "correct_answer": "yes", "shared_context_id": "ctx", "end_index_in_shared_context": 2}]).to_csv(tmp_path / "q.csv", index=False)
    m, q = D.read_contexts(spark, str(tmp_path / "q.csv"), str(tmp_path / "c.jsonl"))
    assert [(r["role"], r["content"]) for r in m.orderBy("ord").collect()] == [("user", "[System]: card"), ("user", "a b")]
    assert q.first()["options"] == ["yes", "no"] and q.first()["conv"] == "ctx:2"


def test_day_anchor(spark):
    cases = {"March-15-2024": "2024-03-15", "March 15, 2024": "2024-03-15", "2024-03-15": "2024-03-15", "Mar-05-2024": "2024-03-05", "soon": None, "": None}
    d = spark.createDataFrame([(k,) for k in cases], "x string").select("x", F.date_format(D.day_anchor(F.col("x")), "yyyy-MM-dd").alias("d"))
    assert {r["x"]: r["d"] for r in d.collect()} == cases


def test_jsonl_sinks(spark, tmp_path):
    results = spark.createDataFrame([(1, 0, "[2023] Bo: x"), (1, 1, "[2023] Ann: y"), (1, 2, "[2023] Bo: z")], "query_id long, place int, content string")
    questions = spark.createDataFrame([(1, "q"), (2, "none")], "query_id long, question string")
    out = sinks.memories_by_speaker(results, questions, "Ann", "Bo")
    sinks.write_jsonl(out, str(tmp_path / "o"))
    got = {r["query_id"]: r for r in D.read_jsonl(spark, str(tmp_path / "o")).collect()}
    assert got[1]["speaker_2_memories"] == "[2023] Bo: x\n[2023] Bo: z" and got[1]["speaker_1_memories"] == "[2023] Ann: y" and got[2]["speaker_1_memories"] == ""


def test_pieces_join_to_the_text(spark):
    texts = ["", " ", "a. b! c?", "x " * 2000, "One. " * 900, "。".join(["字" * 300] * 4) + "。 末", "tail  "]
    d = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "i long, t string").select("t", T.sentence_spans(F.col("t")).alias("s"), T.split_long(F.col("t")).alias("p"))
    for r in d.collect():
        assert "".join(r["s"]) == r["t"] and "".join(r["p"]) == r["t"]


def _texts(d):
    return [(r["conv"], r["t"]) for r in d.select("conv", F.to_json("v").alias("t")).orderBy("conv").collect()]


def test_array_in_parts(spark, tmp_path):
    """An array cut anywhere, with braces, quotes and backslashes in its texts, in one line, in several and over two files."""
    rows = [{"a": i, "t": ['x"}{', "\\", '{"q": "}"}', "é}\n", ""][i % 5] * (i % 7), "l": [{"b": {}}, []]} for i in range(40)]
    want = [(i, json.dumps(r, ensure_ascii=False, sort_keys=True, separators=(",", ":"))) for i, r in enumerate(rows + rows)]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for at, size in enumerate(("150", "3k", "128m")):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            d = tmp_path / str(at)
            d.mkdir()
            (d / "a.json").write_text(json.dumps(rows, indent=1))
            (d / "b.json").write_text(json.dumps(rows, ensure_ascii=False))
            assert _texts(D._documents(spark, str(d))) == want
            (d / "c.jsonl").write_text("\n".join(map(json.dumps, rows)))
            (d / "d.json").write_text("[]")
            (d / "e.json").write_text("")
            assert [t for _, t in _texts(D._documents(spark, str(d)))] == [t for _, t in want + want[:40]]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_array_beyond_a_variant(spark, tmp_path):
    """The whole array is larger than the 128 MB that one variant may hold."""
    turns = [{"speaker": "Ann", "text": "x" * 1_000_000, "dia_id": "D1:1"}]
    one = json.dumps({"conversation": {"session_1_date_time": "9:00 am on 9 May, 2023", "session_1": turns}, "qa": [{"question": "q", "category": 1}]})
    with open(tmp_path / "a.json", "w") as f:
        f.write("[" + ",".join([one] * 140) + "]")
    m, q = D.read_sessions_json(spark, str(tmp_path / "a.json"))
    assert m.select(F.count("*"), F.countDistinct("conv"), F.sum(F.length("content"))).first() == (140, 140, 140 * 1_000_005) and q.count() == 140


def test_long_conversation_dates(spark, tmp_path):
    """Sessions go on behind the end of the month."""
    from tessera.plans import catalog

    spark.createDataFrame([(1, t, "user", f"t{t}") for t in range(130)], "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r["ref"]: r["timestamp_ms"] for r in catalog.QUERIES["s16_sessions_json"](spark, str(tmp_path)).collect()}
    assert got == {f"D{t}": float(1683550560000 + t // 4 * 86400000) for t in range(130)}


def test_haystack_files(spark, tmp_path, monkeypatch):
    """The query writes an array for each partition, an empty one too, and reads all of them; the array of one is larger than a variant may be."""
    from tessera.plans import catalog

    monkeypatch.setattr(catalog, "new_path", lambda spark, name: str(tmp_path / name))
    one = json.dumps({"question_id": "q", "haystack_session_ids": ["a"], "haystack_dates": ["2023/05/20 (Sat) 02:21"], "haystack_sessions": [[{"role": "user", "content": "x" * 1_000_000}]]})
    rows = spark.range(0, 141, 1, 1).select(F.lit(one).alias("value")).union(spark.range(0, 1, 1, 2).select(F.lit('{"question_id": "r"}')))
    m, q = D.read_haystack_json(spark, catalog._array_file(spark, rows, "haystack"))
    arrays = [json.loads(f.read_text()) for f in (tmp_path / "haystack").glob("part-*")]
    assert sorted(map(len, arrays)) == [0, 1, 141]
    assert m.select(F.count("*"), F.countDistinct("conv"), F.sum(F.length("content"))).first() == (141, 141, 141_000_000)
    assert {r["qid"]: r["n"] for r in q.groupBy("qid").agg(F.countDistinct("conv").alias("n")).collect()} == {"q": 141, "r": 1}
