"""The registered queries of the training-data operators, with DuckDB SQL where SQL can say it."""

from __future__ import annotations

import uuid

import corpus_pipeline
import public_tokenizers
from pyspark.sql import functions as F

from skylattice.llm import bpe, decision_list, decontaminate, fill_middle, hard_negatives, line_suffix, minhash, nbsvm, pii, secrets, toxicity, url_filter, warc
from skylattice.llm.common import crc_mod, shared_dir, table

QUERIES: dict = {}
ORACLE: dict = {}


def _query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@_query
def op1_warc_boundary_chain(spark, d):
    path = f"{shared_dir(spark)}/skylattice-warc-{uuid.uuid4().hex}"
    warc.write_warc(table(spark, d, "pages"), path)
    return warc.read_warc(spark, [path]).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@_query
def op2_near_duplicates(spark, d):
    return minhash.per_row(minhash.near_duplicates(table(spark, d, "documents")))


@_query
def op3_quality_nbsvm(spark, d):
    docs = table(spark, d, "documents")
    held_out = F.coalesce(crc_mod(F.col("doc_id"), 5) == 0, F.lit(False))
    scores = nbsvm.score(docs, nbsvm.fit(docs, table(spark, d, "labels"), ~held_out))
    return scores.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@_query
def op4_quality_rules(spark, d):
    docs = table(spark, d, "documents")
    return decision_list.verdicts(docs, decision_list.fit(docs, table(spark, d, "labels")))


@_query
def op5_secret_ownership(spark, d):
    docs = table(spark, d, "documents")
    return secrets.scan_secrets(docs, owner=F.col("source"), repository=F.col("lang"))


@_query
def op6_line_suffix_array(spark, d):
    out = line_suffix.without_copies(table(spark, d, "documents"))
    return out.select("doc_id", "text", F.col("__removed").alias("n_removed"))


@_query
def op7_pii_anchors(spark, d):
    return pii.find_pii(table(spark, d, "documents"))


@_query
def op8_bpe_tree(spark, d):
    return bpe.encode_decode(table(spark, d, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@_query
def op9_benchmark_decontamination(spark, d):
    hits = decontaminate.score_contamination(table(spark, d, "documents"), table(spark, d, "benchmark"))
    return hits.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


@_query
def op10_toxicity_gru(spark, d):
    docs = table(spark, d, "documents")
    held_out = F.coalesce(crc_mod(F.col("doc_id"), 3) == 1, F.lit(False))
    scores = toxicity.score(docs, toxicity.fit(docs, table(spark, d, "labels"), ~held_out))
    return scores.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@_query
def op11_hard_negatives(spark, d):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("bigint") + 1) % 10).otherwise(F.col("label").cast("bigint"))
    rows = hard_negatives.quantised(table(spark, d, "embeddings"), "embedding", label)
    return hard_negatives.mine(rows, F.col("vec_id") % 50 == 0)


@_query
def op12_url_filters(spark, d):
    rules = spark.createDataFrame(url_filter.RULES, "host string, path string, verdict string")
    return url_filter.judge(table(spark, d, "pages"), rules)


@_query
def op13_fill_middle(spark, d):
    made = fill_middle.restore(fill_middle.transform(table(spark, d, "documents")))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


@_query
def pipeline(spark, d):
    return corpus_pipeline.run(spark, d)


ORACLE |= {"op1_warc_boundary_chain": warc.ORACLE, "op5_secret_ownership": secrets.ORACLE, "op6_line_suffix_array": line_suffix.ORACLE, "op9_benchmark_decontamination": decontaminate.ORACLE, "op11_hard_negatives": hard_negatives.ORACLE, "op12_url_filters": url_filter.ORACLE, "op13_fill_middle": fill_middle.ORACLE}
