"""The registered queries of the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import (
    decontaminate,
    impact_index,
    label_shards,
    license_scan,
    near_dedup,
    pii_crf,
    piece_lattice,
    quality_rules,
    run_detection,
    secret_scan,
    suffix_dedup,
    token_store,
    whitening,
)
from skein.llm.common import spans_digest, table
from skein.session import shared_dir

Run = Callable[[SparkSession, str], DataFrame]


def _counts(spans: str, kinds: tuple[str, ...]) -> list:
    def count(kind: str) -> Column:
        return F.size(F.filter(spans, lambda s: s["base"] & (s["kind"] == kind))).cast("bigint")

    return [count(kind).alias(f"n_{kind}") for kind in kinds]


def _span_report(found: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    base = F.filter("spans", lambda s: s["base"])
    return found.select(
        "doc_id",
        *_counts("spans", kinds),
        F.sha2(spans_digest(base), 256).alias("base_sha256"),
        spans_digest(F.col("spans")).alias("spans"),
    )


def op1_skip_chain_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return _span_report(pii_crf.find_personal(documents, pii_crf.train(documents)), pii_crf.KINDS)


def op2_label_propagation_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = label_shards.assign_shards(table(spark, sf_dir, "documents"))
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op3_minhash_license_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.find_licenses(table(spark, sf_dir, "documents")).select(
        "doc_id",
        F.size("licenses").cast("bigint").alias("n_licenses"),
        F.array_join(F.transform("licenses", lambda x: x["license"]), ",").alias("licenses"),
        F.array_join(F.transform("licenses", lambda x: x["first_word"].cast("string")), ",").alias("first_words"),
    )


def op4_fm_index_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_contamination(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    )
    hit = F.aggregate("ranges", F.lit(0).cast("bigint"), lambda a, r: a + r["end"] - r["start"])
    return found.select(
        F.col("doc.doc_id").alias("doc_id"),
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (F.size("ranges") > 0).alias("contaminated"),
    )


def op5_piece_lattice_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    return piece_lattice.round_trip(table(spark, sf_dir, "documents"), path)


def op6_suffix_sort_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = F.aggregate("removed", F.lit(0).cast("bigint"), lambda a, r: a + r["end"] - r["start"])
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "n_bytes",
        gone.alias("n_removed"),
        F.size("removed").cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op7_prob_minhash_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_class")


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _span_report(secret_scan.find_secrets(table(spark, sf_dir, "documents")), secret_scan.BASE_KINDS)


def op9_distribution_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.measure(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
        "char_distance",
        "word_distance",
    )


def op10_elias_fano_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = f"{shared_dir(spark)}/skein-token-files-{uuid.uuid4().hex}"
    documents = table(spark, sf_dir, "documents")
    token_store.write_token_files(documents, path, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return token_store.read_token_files(spark, path)


def op11_suffix_automaton_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = run_detection.find_runs(table(spark, sf_dir, "documents"), planted=True)

    # Greatest length / period by cross products, then first start, then shortest period.
    def stronger(best: Column, run: Column) -> Column:
        gain = run["length"] * best["period"] - best["length"] * run["period"]
        return F.when(best.isNull() | (gain > 0), run).otherwise(best)

    none = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    lines = F.transform("runs", lambda r: F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]))
    best = found.withColumn("best", F.aggregate("runs", none, stronger))
    return best.select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform(lines, lambda line: F.concat(line, F.lit("\n"))), ""), 256).alias("runs_sha256"),
        "collapsed_sha256",
    )


def op12_impact_ordered_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    embeddings = table(spark, sf_dir, "embeddings")
    index = impact_index.build_index(embeddings, "vec_id", "embedding")
    asked = embeddings.filter(F.col("vec_id") % 100 == 0)
    found = impact_index.search(index, asked, "vec_id", "embedding", k=10)
    return found.withColumnRenamed("id", "vec_id")


def op13_exact_polynomial_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"), "vec_id", "embedding").withColumnRenamed("id", "vec_id")


QUERIES: dict[str, Run] = {
    f.__name__: f
    for f in (
        op1_skip_chain_crf,
        op2_label_propagation_shards,
        op3_minhash_license_windows,
        op4_fm_index_decontamination,
        op5_piece_lattice_tokens,
        op6_suffix_sort_dedup,
        op7_prob_minhash_classes,
        op8_secret_scan,
        op9_distribution_divergence,
        op10_elias_fano_token_files,
        op11_suffix_automaton_runs,
        op12_impact_ordered_topk,
        op13_exact_polynomial_whitening,
    )
}
ORACLE_SQL: dict[str, str] = {}
