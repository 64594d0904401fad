"""Registered queries of the corpus operators, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snapcount.llm import codes, decontam, html_text, licenses, oracles, packing, pii, quality, sharding, simhash, toxicity, trie, warc, winnow
from snapcount.llm.common import table
from snapcount.sources.stores import staging_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[function.__name__] = function
    return function


@query
def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


ORACLES["op1_licenses"] = oracles.LICENSES


@query
def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.described(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).drop("text")
    return sharding.assign(rows).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "source",
    )


ORACLES["op2_sharding"] = oracles.SHARDING


@query
def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), keep=["doc_id"])


@query
def op4_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnow.compared(table(spark, sf_dir, "documents"))


@query
def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


@query
def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.digest(pii.find(docs, pii.fit(docs)))


@query
def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    chain = quality.fit_on(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, chain).select(
        "doc_id",
        F.coalesce(quality.remainder("doc_id", 3) == 1, F.lit(False)).alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"),
    )


@query
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    index = toxicity.fit_on(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, index).select(
        "doc_id",
        F.coalesce(quality.remainder("doc_id", 5) == 0, F.lit(False)).alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"),
        F.transform("evidence", lambda e: e["doc_id"]).alias("nearest"),
    )


@query
def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


@query
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.nodes(table(spark, sf_dir, "conversations"))


ORACLES["op11_prefix_trie"] = oracles.PREFIX_TRIE


@query
def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    crawled, deduplicated = staging_folder(spark), staging_folder(spark)
    records = warc.write(table(spark, sf_dir, "pages"), crawled)
    warc.deduplicate(spark, crawled, deduplicated, records=records)
    return warc.read(spark, deduplicated).select(
        F.col("page_id").cast("long").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        F.col("refers_to_page").cast("long").alias("refers_to"),
    )


ORACLES["op12_warc"] = oracles.WARC


@query
def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    books = codes.fit(vectors)
    coded = codes.encode(vectors, books).drop("embedding")
    digest = F.lit(books.sha256() if books else None).cast("string")
    return codes.with_sum_over(coded, "label", "error", "label_error").select(
        "vec_id", "code", "error", "label_error", digest.alias("codebooks_sha256")
    )


ORACLES["op13_vector_codes"] = oracles.VECTOR_CODES
