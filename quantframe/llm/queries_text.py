"""Registered queries that read a table row by row or conversation by conversation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quantframe.llm import chat, decontam, html_text, pieces, pii, quality, secret_scan, tokens
from quantframe.llm.common import documents, read, shared


def op5_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    rows = read(spark, folder, "conversations").select(
        F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), "role", "text"
    )
    says = "</s>[INST] ok [/INST]"
    fixed = spark.range(2).select(
        F.lit(-7).cast("bigint").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(says).alias("text"),
    )
    messages = rows.unionByName(fixed).withColumn("parts", chat.text_parts(F.col("text")))
    out = chat.format_conversations(messages)

    def line(t: Column) -> Column:
        return F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))

    return (
        out.withColumn("turns", chat.read_turns(F.col("formatted")))
        .withColumn("loss", F.array_join(chat.read_loss(F.col("formatted"), F.col("loss")), ""))
        .select(
            "conv_id",
            F.size("turns").cast("bigint").alias("n_turns"),
            F.sha2(F.array_join(F.transform("turns", line), ""), 256).alias("turns_sha256"),
            F.length("loss").cast("bigint").alias("loss_chars"),
            F.sha2("loss", 256).alias("loss_sha256"),
            F.length("formatted").cast("bigint").alias("formatted_chars"),
        )
    )


OP5_SQL = r"""
with rows as (
  select conv_id::bigint conv_id, turn::bigint turn, coalesce(role, '') as role, coalesce(text, '') as text
  from conversations
  union all
  select * from (values (-7::bigint, 0::bigint, 'user', '</s>[INST] ok [/INST]'),
                        (-7::bigint, 1::bigint, 'assistant', '</s>[INST] ok [/INST]'))
),
laid as (
  select *,
    regexp_replace(role, '(\\*(?:<s>|</s>|\[INST\]|\[/INST\]|<image>|<audio>|<document>))', '\\\1', 'g') as er,
    regexp_replace(text, '(\\*(?:<s>|</s>|\[INST\]|\[/INST\]|<image>|<audio>|<document>))', '\\\1', 'g') as et
  from rows
)
select conv_id, count(*)::bigint as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, et)) as turns_sha256,
  coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, role, et) filter (where role = 'assistant'), '')) as loss_sha256,
  sum(length(er) + length(et) + 24)::bigint as formatted_chars
from laid group by conv_id
"""


def op3_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    found = secret_scan.with_secrets(docs, secret_scan.train(docs)).drop("text")
    return found.select(
        "doc_id",
        *[pii.count_of(F.col("secret_spans"), k).alias(f"n_{k}") for k in secret_scan.BASE_KINDS],
        F.sha2(pii.rendered(F.col("secret_spans"), secret_scan.BASE_KINDS), 256).alias("base_sha256"),
        pii.rendered(F.col("secret_spans")).alias("spans"),
    )


def op6_pii(spark: SparkSession, folder: str) -> DataFrame:
    found = pii.with_pii(documents(spark, folder)).drop("text")
    return found.select(
        "doc_id",
        *[pii.count_of(F.col("pii_spans"), k).alias(f"n_{k}") for k in pii.BASE_KINDS],
        F.sha2(pii.rendered(F.col("pii_spans"), pii.BASE_KINDS), 256).alias("base_sha256"),
        pii.rendered(F.col("pii_spans")).alias("spans"),
    )


def op10_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    measured = quality.with_measures(documents(spark, folder), "text", "m").drop("text")
    measured = shared(measured, "quality")
    m = F.col("m")
    p = quality.posterior(quality.fit(measured, "m"), m)
    shown = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    failed = quality.base_failed(m)
    return measured.select(
        "doc_id",
        *[m[c].alias(c) for c in shown],
        failed.alias("base_failed"),
        (~failed & (p >= quality.THRESHOLD)).alias("kept"),
        p.alias("p_fit"),
    )


TOKENIZER = "byte_bpe_50k.json"


def op7_token_counts(spark: SparkSession, folder: str, tokenizer: str | None = None) -> DataFrame:
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path(TOKENIZER)
    with open(tokenizer, encoding="utf-8") as f:
        definition = f.read()
    counted = tokens.with_token_counts(documents(spark, folder), definition).drop("text")
    n = F.col("token_count")
    return counted.select(
        "doc_id",
        n["n_bytes"].alias("n_bytes"),
        n["n_tokens"].alias("n_tokens"),
        (n["n_tokens"] > tokens.LIMIT).alias("over_limit"),
    )


PIECE_MODEL, SAMPLING_SEED = "piece_bpe_32k.model", 8


def piece_model(path: str | None = None) -> bytes:
    """The model file's bytes, from ``path`` or from the installed public tokenizers."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(PIECE_MODEL)
    with open(path, "rb") as f:
        return f.read()


def op8_sentencepiece(spark: SparkSession, folder: str, path: str | None = None) -> DataFrame:
    key = pieces.row_key(SAMPLING_SEED, F.col("doc_id"))
    out = pieces.with_pieces(documents(spark, folder), piece_model(path), key).drop("text")
    p = F.col("pieces")
    return out.select(
        "doc_id",
        F.size(p["ids"]).cast("bigint").alias("n_pieces"),
        p["ids"].alias("piece_ids"),
        p["lossless"].alias("lossless"),
    )


def op4_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    found = decontam.with_leaks(documents(spark, folder), read(spark, folder, "benchmark"))
    rows = found.select("doc_id", F.explode("leaks").alias("m"))
    return rows.select(
        "doc_id",
        F.col("m.item_id").alias("item_id"),
        F.col("m.start").cast("bigint").alias("start"),
        F.col("m.end").cast("bigint").alias("end"),
        F.col("m.edits").cast("bigint").alias("edits"),
    )


def op2_html_text(spark: SparkSession, folder: str) -> DataFrame:
    pages = read(spark, folder, "pages").select(F.col("page_id").cast("bigint"), "url", "html")
    held = html_text.with_main_text(pages, html_text.train(pages)).drop("html")
    return held.select(
        "page_id",
        "url",
        F.col("main_text").alias("text"),
        F.length("main_text").cast("bigint").alias("n_chars"),
    )


QUERIES = {
    "op2_html_text": op2_html_text,
    "op3_secret_scan": op3_secret_scan,
    "op4_decontaminate": op4_decontaminate,
    "op5_chat_format": op5_chat_format,
    "op6_pii": op6_pii,
    "op7_token_counts": op7_token_counts,
    "op8_sentencepiece": op8_sentencepiece,
    "op10_quality_rules": op10_quality_rules,
}
ORACLES = {"op5_chat_format": OP5_SQL}
