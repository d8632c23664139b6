"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm import best_fit_packing, decontamination, exact_dedup, language_id, line_dedup, mixing, ngram_join, prefix_trie, quality_classifier, quality_rules, secret_scan, source_divergence, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base rules and certified cutoffs over documents."""
    out = quality_rules.quality_rules(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rejected_by")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal texts of documents; the largest doc_id stays."""
    return exact_dedup.exact_dedup(_table(spark, sf_dir, "documents"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as token pieces, packed into sequences of 4096."""
    return best_fit_packing.best_fit_packing(_table(spark, sf_dir, "documents"))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near copies among documents."""
    return ngram_join.ngram_join(_table(spark, sf_dir, "documents")).drop("class_id")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Later copies of runs of lines deleted from documents; the clean text by its digest."""
    out = line_dedup.line_dedup(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", "runs", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources of documents mixed to capped targets."""
    out = mixing.mix(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written to archives and read back."""
    return warc.page_records(_table(spark, sf_dir, "pages"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document."""
    out = language_id.language_id(_table(spark, sf_dir, "documents"))
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document by a sparse rule ensemble."""
    return quality_classifier.quality_classifier(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in documents, each distinct text scanned once."""
    return secret_scan.secret_scan(_table(spark, sf_dir, "documents"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the sources of each language differ, and the terms that each overuses."""
    return source_divergence.source_divergence(_table(spark, sf_dir, "documents"))


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages in documents."""
    return decontamination.digests(decontamination.decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tree of beginnings of conversations, rebuilt to share their starts."""
    return prefix_trie.prefix_trie(_table(spark, sf_dir, "conversations"), prefix_trie.with_shared_starts)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of the corpus pipeline over documents."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    """Query name to callable(spark, sf_dir)."""
    return {f.__name__: f for f in (op1_quality_rules, op2_exact_dedup, op3_best_fit_packing, op4_ngram_join, op5_line_dedup, op6_mixing, op7_warc, op8_language_id, op9_quality_classifier, op10_secret_scan, op11_source_divergence, op12_decontamination, op13_prefix_trie, pipeline)}


OP2_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))"""


def oracle_sql() -> dict:
    """Query name to DuckDB SQL."""
    return {"op2_exact_dedup": OP2_SQL, "op5_line_dedup": line_dedup.SQL, "op6_mixing": mixing.sql(), "op7_warc": warc.SQL, "op10_secret_scan": secret_scan.sql(), "op11_source_divergence": source_divergence.SQL, "op12_decontamination": decontamination.SQL, "op13_prefix_trie": "WITH RECURSIVE" + prefix_trie.SQL.strip().removeprefix("WITH")}
