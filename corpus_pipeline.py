"""From raw documents to packed sequences: five stages, each stored before the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textlake.llm import language, mixing, ngram_join, packing, suffix_dedup
from textlake.llm.blocks import free_prefix, stored
from textlake.llm.queries import remainder, tokenizer_path


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that was learned; ``lang`` becomes the predicted one.

    Texts that are null or have no letter go, and those whose cross-entropy is out of the calibrated range.
    """
    model = language.train(docs, remainder(3) != 1)
    prefix = free_prefix(docs.columns, "lang_pred", "score", "accepted")
    found = language.identify(docs, model, keep=True, prefix=prefix).where(f"`{prefix}accepted`")
    return found.select(*[F.col(f"`{prefix}lang_pred`").alias("lang") if c == "lang" else F.col(f"`{c}`") for c in docs.columns])


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group linked by five-word shingles at 0.8.

    Documents are told apart by id and text, so rows that share an id but not the text are compared like any others, as
    are rows without an id, which come last; rows equal in id and text count as one.
    """
    own = F.xxhash64(F.col("doc_id").isNull(), "doc_id", F.col("text").isNull(), "text")
    prefix = free_prefix(docs.columns, "own")
    name = f"{prefix}own"
    marked = docs.withColumn(name, own)
    found = ngram_join.jaccard_components(marked.select(F.col(f"`{name}`").alias("doc_id"), "text"), size=5, percent=80).select(F.col("doc_id").alias(name), "component_id")
    ids = marked.select(F.col(f"`{name}`"), "doc_id").distinct()
    first = (found.distinct().join(ids, name).groupBy("component_id")
             .agg(F.min_by(name, F.struct(F.col("doc_id").isNull(), "doc_id", name)).alias(name)).select(name))
    return marked.join(first, name, "left_semi").dropDuplicates([name]).select(*[F.col(f"`{c}`") for c in docs.columns])


def suffix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that an earlier document has; ``n_chars`` follows. Documents with nothing left go."""
    left = suffix_dedup.removed_spans(docs, keep=True).where("text <> ''")
    return left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else left


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn so that source, language and topic shares meet their targets."""
    prefix = free_prefix(docs.columns, *mixing.NAMES)
    return mixing.mix(docs, prefix=prefix).where(f"`{prefix}kept`").select(*[F.col(f"`{c}`") for c in docs.columns])


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document stands in the training sequences."""
    return packing.best_fit(packing.pieces(docs, tokenizer_path()))


STAGES = [("language", language_stage), ("near_duplicates", near_duplicate_stage), ("suffix_dedup", suffix_stage),
          ("mixing", mixing_stage), ("packing", packing_stage)]

#: No SQL: language models, byte-pair ids and draws by hash are beyond it; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
