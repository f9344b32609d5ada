"""A training corpus from documents: good ones, without exact and near copies, mixed and packed.

Counts as part of tessera.llm: without that subpackage this module cannot be imported. A stage's input is a written
table, so a stage begins by deleting the scratch tables of the stage before it.

Null and empty texts: rejected by the classifier as it scores them; where they get through, null and empty are equal for
the exact stage, have no shingles, and are packed as their end id. Null ids rank below all others in the exact stage and
last in the near one, and share one draw in the mixing. Null sources are one source. Ties and repeated rows leave one row
in the second stage. Empty tables stay empty. Further columns pass through, whatever their names, up to packing, which returns its own columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import exact_dedup, line_crf, mixing, ngram_join, packing
from tessera.llm.common import free_name, new_path, release, table, written

_scratch: set[str] = set()  # the scratch tables of the last stage


def _begin() -> set[str]:
    """Delete what the last stage has left behind; its result was written since."""
    release(_scratch)
    _scratch.clear()
    return written()


def _end(before: set[str], out: DataFrame) -> DataFrame:
    _scratch.update(written() - before)
    return out


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line field rejects go."""
    before = _begin()
    return _end(before, line_crf.keep_good(docs, line_crf.train(docs, table(spark, sf_dir, "labels"))))


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest id stays."""
    before = _begin()
    return _end(before, exact_dedup.drop_exact_duplicates(docs))


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    before = _begin()
    return _end(before, ngram_join.keep_one_of_each(docs))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every source repeated towards its target weight."""
    before = _begin()
    return _end(before, mixing.mix(docs).select(*docs.columns))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in windows of 4096 ids, in the order of the mixing; stages pass on the documents' columns only,
    so copies are numbered and their shuffle keys made again."""
    before = _begin()
    copy = free_name(docs, "__copy")
    return _end(before, packing.pack(mixing.number_copies(docs, name=copy), order=[mixing.shuffle_key(copy_col=copy), "doc_id", copy]))


STAGES = [
    ("quality classifier", quality_classifier),
    ("exact dedup", exact_dedup_stage),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("mixing sources to target weights", mixing_stage),
    ("packing", packing_stage),
]

#: The first stage is a trained model, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again."""
    docs, read = table(spark, sf_dir, "documents"), []
    for k, (_, stage) in enumerate(STAGES[:-1]):
        path = new_path(spark, f"stage-{k}")
        stage(spark, docs, sf_dir).write.parquet(path)
        release(read)
        docs, read = spark.read.parquet(path), [path]
    return STAGES[-1][1](spark, docs, sf_dir)
