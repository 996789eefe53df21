"""Queries of the text operators over the provided tables, and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statewalk.llm import (
    bpe,
    decontaminate,
    filter_audit,
    license_scan,
    near_vectors,
    packing,
    quality,
    run_detection,
    secret_scan,
    set_join,
    sql,
    token_store,
    toxicity,
    url_rules,
)
from statewalk.llm.common import table
from statewalk.session import shared_dir

BYTE_BPE = "byte_bpe_50k.json"
STORE_END = 0
WORD_BPE = "word_bpe_49k.json"
# Fixed values of the contract: rules and the end id of packed documents.
URL_RULES = [
    url_rules.Rule("allow", "com", "/"),
    url_rules.Rule("block", "example.com", "/en/"),
    url_rules.Rule("allow", "www.example.com", "/en/"),
    url_rules.Rule("block", "net", "/es/"),
    url_rules.Rule("block", "net", "/fr/"),
]
PACK_END = 2
TOXIC = 0.3


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = set_join.link_classes(table(spark, sf_dir, "documents"), join=set_join.SetJoin(3, 90))
    return classes.select(F.col("key").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"))


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/token-store-{uuid.uuid4().hex}"
    token_store.write_store(table(spark, sf_dir, "documents"), path, public_tokenizers.path(BYTE_BPE), STORE_END)
    return token_store.read_store(spark, path).withColumnRenamed("key", "doc_id")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score_documents(docs, table(spark, sf_dir, "labels"))
    score = F.col("toxicity.score")
    return scored.select(
        "doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), score.alias("score"),
        (score >= TOXIC).cast("int").alias("predicted"),
    )


def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_vectors.near_duplicates(table(spark, sf_dir, "embeddings"))
    return found.withColumnRenamed("key", "vec_id").withColumnRenamed("component", "component_id")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    pieces = packing.pack(docs, public_tokenizers.path(WORD_BPE), PACK_END)
    return pieces.withColumn("ids", F.crc32("ids")).withColumnRenamed("ids", "ids_crc32")


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES).drop("url")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encode_decode(docs, public_tokenizers.path(WORD_BPE), keep_text=False).drop("text")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.assess(table(spark, sf_dir, "documents").select("doc_id", "text"))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return judged.select("doc_id", *[F.col("quality")[n].alias(n) for n in names])


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = license_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = F.col("license")
    joined = lambda c: F.array_join(c, ",")
    return scanned.select(
        "doc_id",
        found["n_words"].alias("n_words"),
        F.size(found["base"]).cast("long").alias("n_base"),
        F.array_min(F.transform(found["base"], lambda x: x["start"])).alias("first_word"),
        F.array_max(F.transform(found["base"], lambda x: x["start"])).alias("last_word"),
        joined(found["base_labels"]).alias("base_labels"),
        joined(found["labels"]).alias("labels"),
        found["score"].alias("score"),
    )


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = secret_scan.RULES
    scanned = secret_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text"), rules=rules)
    spans = F.col("secrets")
    names = F.array(*[F.lit(r.kind) for r in rules])
    base = [i for i, r in enumerate(rules) if r.base]

    def of(kinds):
        return F.filter(spans, lambda x: x["kind"].isin(kinds))

    def digest(rows):
        return F.array_join(
            F.transform(rows, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))),
            ",",
        )

    return scanned.select(
        "doc_id",
        *[F.size(of([i])).cast("long").alias(f"n_{rules[i].kind}") for i in base],
        F.sha2(digest(of(base)), 256).alias("base_sha256"),
        digest(spans).alias("spans"),
    )


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    code = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    seeds = F.when(code % 10 == 0, F.floor(code / 10))
    found = run_detection.find_runs(docs, seeds=seeds, keep_texts=False)
    names = (*run_detection.NUMBERS, "runs_sha256", "collapsed_sha256")
    return found.select("doc_id", *[F.col("runs")[n].alias(n) for n in names])


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = F.col("leaks")
    ids = F.array_sort(F.transform(found["items"], lambda x: x.cast("string")))
    return decontaminate.scan(docs, table(spark, sf_dir, "benchmark")).select(
        "doc_id", found["n_words"].alias("n_words"), found["n_hit"].alias("n_hit"),
        F.size(found["items"]).cast("long").alias("n_items"), F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
        (found["n_hit"] > 0).alias("contaminated"),
    )


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_ngram_jaccard": op1_ngram_jaccard,
        "op2_token_store": op2_token_store,
        "op3_toxicity": op3_toxicity,
        "op4_embedding_near_dedup": op4_embedding_near_dedup,
        "op5_packing": op5_packing,
        "op6_url_filters": op6_url_filters,
        "op7_bpe": op7_bpe,
        "op8_quality_rules": op8_quality_rules,
        "op9_license_scan": op9_license_scan,
        "op10_secret_scan": op10_secret_scan,
        "op11_filter_audit": op11_filter_audit,
        "op12_periodic_runs": op12_periodic_runs,
        "op13_decontamination": op13_decontamination,
    }


def oracle() -> dict[str, str]:
    return sql.oracle(URL_RULES)
