"""Registered queries that gather from the whole corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantframe.llm import lm, simhash
from quantframe.llm.common import documents, shared


def op1_simhash(spark: SparkSession, folder: str) -> DataFrame:
    hashed = simhash.with_fingerprint(documents(spark, folder), "text", "fp").drop("text")
    joined = simhash.with_components(shared(hashed, "simhash"), "doc_id", "fp", "component_id")
    return joined.select(
        "doc_id", simhash.hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id"
    )


def op9_class_lm(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder).withColumn("held_out", lm.held_out(F.col("doc_id")))
    model, rest = lm.train(docs, "text", ~F.col("held_out"))
    scored = lm.with_scores(docs, model, rest)
    return scored.select(
        "doc_id",
        "held_out",
        "n_tokens",
        "n_known",
        F.lit(model.tokens).cast("bigint").alias("train_tokens"),
        "base_score",
        "score",
    )


QUERIES = {"op1_simhash": op1_simhash, "op9_class_lm": op9_class_lm}
ORACLES: dict[str, str] = {}
