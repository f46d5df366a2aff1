"""The queries of the corpus operators over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import automata, bpe, decontamination, hpyp, licenses, lines, neardup, quality, sql, suffixes, toxicity

TOKENIZER = "byte_bpe_50k.json"


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    out = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return out.select(*columns) if columns else out


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def crc_of(doc_id) -> F.Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary") if isinstance(doc_id, str) else doc_id.cast("string").cast("binary"))


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hpyp.score(table(spark, sf_dir, "documents", "doc_id", "text"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    judged = quality.judge(docs, table(spark, sf_dir, "labels"), keep=["doc_id"])
    return judged.select("doc_id", "quality_rules.*")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.dedup(table(spark, sf_dir, "documents", "doc_id", "text"), report=("n_lines", "n_removed"))
    return found.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op4_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(table(spark, sf_dir, "documents", "doc_id", "text"), digests=True)


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neardup.groups(table(spark, sf_dir, "documents", "doc_id", "text"), shingle=4)
    return found.withColumn("kept", F.col("doc_id") == F.col("component_id"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return automata.remove_repeats(table(spark, sf_dir, "documents", "doc_id", "text"), digests=True)


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return bpe.tokenize(docs, tokenizer_path(), keep=["doc_id"], digests=True).select("doc_id", "bpe.*")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    found = decontamination.find_contamination(docs, table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    c = found["contamination"]
    return found.select(
        "doc_id",
        c["n_words"].alias("n_words"),
        decontamination.hit_words(c).alias("n_hit"),
        F.size(c["items"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(c["items"], ","), 256).alias("items_sha256"),
        decontamination.is_contaminated(c).alias("contaminated"),
    )


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of ``source/lang/``; short documents with a license license their directory."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "source", "lang")
    files = docs.withColumn("path", F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")))
    return licenses.scan(files, keep=["doc_id", "path"])


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), may_learn=lambda i: crc_of(i) % 3 != 1)
    found = toxicity.classify(docs, model, keep=["doc_id"])
    return found.select("doc_id", (crc_of("doc_id") % 3 == 1).alias("held_out"), "toxicity.score", (F.col("toxicity.score") >= 0.7).cast("int").alias("predicted"), F.col("toxicity.threshold").alias("lang_threshold"), F.col("toxicity.flagged").alias("flagged"))


QUERIES = {f.__name__: f for f in (op1_lm_scoring, op2_quality_rules, op3_line_dedup, op4_suffix_array, op5_bpe, op6_decontamination, op7_near_dedup, op8_substring_dedup, op9_license_scan, op10_toxicity)}
ORACLES = sql.ORACLES
