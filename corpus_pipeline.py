"""A corpus pipeline of five stages, each a table of documents for the next.

Language identification drops documents that it rejects; exact dedup keeps the
largest doc_id of equal texts; the n-gram join keeps the document with the least
doc_id of every group of near copies; mixing repeats and leaves out documents to
reach the target weights; packing turns what remains into token pieces with their
sequences.

Rows are told apart by doc_id and text together (`row_id`), so a doc_id that is null
or repeats does not lose a text. Inside a stage columns go by position, so a column of
any name is carried along, up to the last stage, which returns pieces.

Defined cases: null and empty texts, and texts without a letter, end at the first
stage; a null doc_id comes after all others; rows that repeat both doc_id and text are
one document from the second stage on; an empty table passes through.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm import best_fit_packing, exact_dedup, language_id, mixing, ngram_join
from cairn.session import cut

#: Bits of a text's SHA-256 in its row_id, beside the 64 of doc_id in a decimal(38, 0).
DIGEST_BITS = 60


def by_position(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs with columns c0, c1, ..., and what each name has become."""
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def by_name(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs again."""
    return rows.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)))


def row_id(doc_id: Column, digest: Column) -> Column:
    """doc_id, a null one last, then the leading bits of the text's SHA-256, as one number."""
    number = F.coalesce(doc_id.cast("decimal(19,0)"), F.lit(Decimal(1 << 63)))
    low = F.conv(F.substring(digest, 1, DIGEST_BITS // 4), 16, 10).cast("decimal(19,0)")
    return (number * F.lit(Decimal(1 << DIGEST_BITS)) + low).cast("decimal(38,0)")


def digest(text: str) -> Column:
    """The SHA-256 of a text, a null one being empty."""
    return F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with enough certainty."""
    rows, at = by_position(docs)
    others = {c: F.col(c) for c in rows.columns if c != at["text"]}
    found = language_id.language_id(rows, lang=at["lang"], text=at["text"], doc_id=at["doc_id"], keys=others, with_text=True)
    return by_name(found.where("not rejected").withColumnRenamed("text", at["text"]), docs)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text."""
    rows, at = by_position(docs)
    found = exact_dedup.exact_dedup(rows, at["text"], at["doc_id"]).where("kept")
    kept = cut(found.select(row_id(F.col("doc_id"), F.col("text_sha256")).alias("id")), "kept")
    rows = rows.withColumn("id", row_id(F.col(at["doc_id"]), digest(at["text"])))
    return by_name(rows.join(kept, "id", "left_semi").dropDuplicates(["id"]), docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least doc_id of each component; a document without words is alone."""
    rows, at = by_position(docs)
    rows = rows.withColumn("id", row_id(F.col(at["doc_id"]), digest(at["text"])))
    kept = cut(ngram_join.ngram_join(rows, at["text"], F.col("id")).where("doc_id = component_id").select(F.col("doc_id").alias("id")), "kept")
    return by_name(rows.join(kept, "id", "left_semi"), docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    rows, at = by_position(docs)
    rows = rows.withColumn("id", row_id(F.col(at["doc_id"]), digest(at["text"])))
    copies = mixing.mix(rows, at["source"], at["text"], F.col("id")).where("copies > 0").groupBy(F.col("doc_id").alias("id")).agg(F.max("copies").alias("copies"))
    taken = rows.join(cut(copies, "copies"), "id")
    return by_name(taken.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))), docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces and their places in sequences of 4096."""
    return best_fit_packing.best_fit_packing(docs)


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("ngram_join", drop_near_copies),
    ("mixing", mix_sources),
    ("best_fit_packing", pack_sequences),
]

#: The first stage's language models have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
