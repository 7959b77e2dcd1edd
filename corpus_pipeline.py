"""A training corpus from ``documents``: quality, near-duplicates, benchmark leaks, personal
data, SentencePiece.

``STAGES`` lists (name, function); a function takes (spark, docs, folder) and returns the
next stage's ``docs``. :func:`run` writes each stage's result to the shared folder and re-reads
it, so a lost executor costs one stage at most.

Every stage keeps all columns of ``documents``, whatever else they are called, and only drops
or changes rows as follows; the last one adds ``piece_ids`` and ``pieces_lossless``:

* quality_rules drops rows whose text is judged unfit (null and empty texts among them);
* near_duplicates keeps the row with the smallest ``doc_id`` of each component, of equal rows
  one; ``doc_id`` null comes last;
* benchmark_leaks drops rows whose text holds a benchmark item within the edit budget;
* personal_data puts the kind in place of each span in ``text``; ``n_chars`` stays that of the
  row as it came;
* sentencepiece samples a segmentation, seeded by ``doc_id``, of the masked text.

An empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantframe.llm import decontam, pieces, pii, quality, simhash
from quantframe.llm.common import free_name, read, shared
from quantframe.llm.queries_text import SAMPLING_SEED, piece_model


def quality_rules(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    return quality.keep_fit(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    return simhash.keep_one(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    return decontam.drop_leaked(docs, read(spark, folder, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    return pii.mask_pii(docs)


def sentencepiece(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    held = free_name(docs, "sampled")
    key = pieces.row_key(SAMPLING_SEED, F.col("doc_id"))
    out = pieces.with_pieces(docs, piece_model(), key, out=held)
    ids, same = free_name(docs, "piece_ids"), free_name(docs, "pieces_lossless")
    return out.select(
        *docs.columns, F.col(held)["ids"].alias(ids), F.col(held)["lossless"].alias(same)
    )


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("benchmark_leaks", benchmark_leaks),
    ("personal_data", personal_data),
    ("sentencepiece", sentencepiece),
]

#: No SQL: the stages fit a latent-variable model, hash shingles with XXH64 and sample.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = shared(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs


QUERIES = {"pipeline": run}
ORACLES = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
