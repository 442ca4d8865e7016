"""Registered queries of the training-data operators and the SQL they are checked against."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from rulespark.llm import (
    bpe, conversations, exact_dedup, html_text, language, lexical, masked_lm, mixing, neighbours, pii, simhash, toxicity, url_filter,
)
from rulespark.llm.common import documents, remainder, stored

QUERIES: dict = {}
ORACLE: dict = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


@query("op1_simhash")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", simhash.hex16(F.col("fp")).alias("fingerprint"), "component_id", "n_links")


@query("op2_mix_sources", mixing.ORACLE)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = stored(documents(spark, sf_dir).select("doc_id", "source", mixing.n_words(F.col("text")).alias("size")), "sizes")
    return mixing.mix(sizes).select("doc_id", "size", "source_size", "target", "taken")


@query("op3_toxicity")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = toxicity.train(docs, toxicity.training_labels(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op4_html_text")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_text.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return found.withColumn("n_chars", F.length("text").cast("long"))


@query("op5_language")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = language.train(language.training_rows(docs), public_tokenizers.path("piece_bpe_32k.model"))
    found = language.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


@query("op6_exact_dedup", """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, text_sha256
FROM (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
WINDOW w AS (PARTITION BY text_sha256)""")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(documents(spark, sf_dir))


def tokenizer() -> dict[bytes, int]:
    return bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))


def token_digests(docs: DataFrame) -> DataFrame:
    coded = bpe.encode(docs, tokenizer(), public_tokenizers.PATTERN, decoded=True)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2("bytes", 256).alias("decoded_sha256"),
    )


@query("op7_byte_bpe")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(documents(spark, sf_dir))


@query("op8_masked_lm")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masked_lm.pseudo_likelihood(documents(spark, sf_dir))


@query("op9_neighbours")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return neighbours.search(vectors, "vec_id", "embedding", F.col("vec_id") % 100 == 0)


@query("op10_personal_data")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.spans(documents(spark, sf_dir))
    return found.select(
        "doc_id", *[pii.count_of(F.col("base"), k).alias(f"n_{k}") for k in pii.KINDS],
        F.sha2(pii.joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), pii.joined(F.concat("base", "added")).alias("spans"),
    )


@query("op11_lexical_search", lexical.ORACLE)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


# The rules that the query judges by.
URL_RULES = [
    url_filter.Rule("com", "/", "allow"),
    url_filter.Rule("example.com", "/en/", "block"),
    url_filter.Rule("www.example.com", "/en/", "allow"),
    url_filter.Rule("net", "/es/", "block"),
    url_filter.Rule("net", "/fr/", "block"),
]


@query("op12_url_filter", url_filter.oracle(URL_RULES))
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = url_filter.judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), URL_RULES)
    return found.select("page_id", "host", "path", "rule", "verdict")


@query("op13_conversation_repair")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.audited(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
