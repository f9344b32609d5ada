"""The corpus pipeline, stage by stage, against what each stage's input says."""

import collections

import corpus_pipeline
import numpy as np
from tessera.llm import line_crf, mixing, tokens

SF = "/root/testdata/sf0.01"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    held, columns = [docs], docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, held[-1], SF).write.parquet(str(tmp_path / str(k)))
        held.append(spark.read.parquet(str(tmp_path / str(k))))
    for h in held[:-1]:
        assert h.columns == columns
    rows = [[tuple(r) for r in h.collect()] for h in held]
    raw, good, exact, near, mixed = (r if k == 0 else r for k, r in enumerate(rows[:5]))

    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r[0] for r in good}
    assert np.mean([labels[r[0]] for r in raw if r[0] in labels and r[0] not in kept]) < 0.1
    assert np.mean([r[0] in kept for r in raw if labels.get(r[0]) == 1]) > 0.97
    model = line_crf.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    assert kept == {r[0] for r in raw if model.score(r[1] or "") >= 0.5}

    best = {}
    for r in good:
        best[r[1]] = max(best.get(r[1], r[0]), r[0])
    assert sorted(r[0] for r in exact) == sorted(best.values())

    from tests_llm_brute import components

    assert {r[0] for r in near} == set(components([(r[0], r[1]) for r in exact]).values())

    counts = collections.Counter(r[0] for r in mixed)
    assert set(counts) <= {r[0] for r in near} and 0.8 < len(mixed) / len(near) < 1.2

    enc = tokens.encoder(tokens.default_path())
    total = sum(len(enc.encode(r[1])) + 1 for r in mixed)
    assert sum(r[2] for r in rows[5]) == total


def test_run_equals_stages(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns[:7] == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert out.count() > 0
    assert corpus_pipeline.ORACLE_SQL is None and 4 <= len(corpus_pipeline.STAGES) <= 5


def test_packing_follows_mixing(spark, tmp_path):
    docs = spark.createDataFrame([(k, f"text {k} of a document .", "a" if k % 5 else None) for k in range(300)] + [(7, "another seven", "a"), (None, "no id", "a"), (None, "none too", "a")], "doc_id long, text string, source string")
    mixed = mixing.mix(docs, epochs=3.0)
    stages = dict(corpus_pipeline.STAGES)
    want = [r["doc_id"] for r in mixed.collect()]
    assert len(want) > 600 and max(collections.Counter(want).values()) > 3
    spark.createDataFrame(mixed.select(*docs.columns).collect(), docs.schema).repartition(5).write.parquet(str(tmp_path / "mixed"))
    got = stages["packing"](spark, spark.read.parquet(str(tmp_path / "mixed")), SF).collect()
    got = sorted(got, key=lambda r: (r["sequence_id"], r["offset"]))
    assert [r["doc_id"] for r in got if r["start"] == 0] == want
