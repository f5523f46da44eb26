"""Stages that grow a bank: wordings of sentences and templates from tagged sentences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlake.functions import text as X
from textlake.operators.model import RowModel, model_map
from textlake.session import by_shuffle, cut_lineage


def expand_variations(sentences: DataFrame, n: int, model: RowModel, kind: str = "variations", retries: int = 3,
                      null_phrases: list[str] | None = None, cache_path: str | None = None) -> DataFrame:
    """``(…, vid, wording)``: up to n wordings of every sentence.

    A sentence without a wording stays, with NULL in both. With ``null_phrases`` only wordings that hold one are kept. Sentences left without a
    wording are asked again, at most ``retries`` times in all; only those rows are rerun.
    """
    def ask(rows: DataFrame, attempt: int) -> DataFrame:
        note = [] if attempt == 0 else [F.lit(f"attempt {attempt + 1}")]
        prompt = F.concat_ws("\t", F.lit(kind), F.col("sentence"), F.lit(str(n)), *note)
        path = f"{cache_path}/attempt={attempt}" if cache_path else None
        answered = model_map(rows.withColumn("_prompt", prompt), "_prompt", model, "_answer", cache_path=path)
        listed = X.parse_numbered_list(F.col("_answer"), n)
        if null_phrases:
            listed = F.filter(listed, lambda s: X.holds_phrase(s, null_phrases))
        return answered.withColumn("_list", F.coalesce(listed, F.array().cast("array<string>"))).drop("_prompt", "_answer")

    done = ask(sentences, 0)
    if null_phrases:
        done = cut_lineage(done)  # a retry does not ask again what was answered
        for attempt in range(1, retries):
            missing = done.where(F.size("_list") == 0).drop("_list")
            done = done.where(F.size("_list") > 0).unionByName(cut_lineage(ask(missing, attempt)))
    return done.select(*sentences.columns, F.posexplode_outer("_list").alias("vid", "wording"))


def templates_from_sentences(sentences: DataFrame, rows: DataFrame, model: RowModel, n: int = 3) -> DataFrame:
    """Bank rows from tagged sentences.

    ``sentences``: (row_id, pos, sentence, tag, field); ``rows``: (row_id, field, value,
    field_class). A tagged sentence becomes a pattern with its value as placeholder and
    gets wordings; untagged or unresolved ones become static; ``TBD`` and word-less
    sentences are skipped. Every distinct pattern is worded and cleaned once, however many rows have it.
    """
    from textlake.operators.detect import templatize
    from textlake.operators.render import strip_tag, word_count
    body = strip_tag(F.col("sentence"))
    usable = sentences.withColumn("body", F.trim(body)).where((F.upper("body") != "TBD") & (word_count(F.col("body")) > 0))
    joined = usable.join(by_shuffle(rows), ["row_id", "field"], "left")
    pattern = templatize(F.col("body"), F.col("field"), F.col("value"))
    marked = joined.withColumn("pattern", F.coalesce(pattern, F.col("body"))).withColumn(
        "is_static", F.col("field").isNull() | (F.col("pattern") == F.col("body")))
    asked = marked.select("row_id", "pos", F.when(~F.col("is_static"), F.col("field")).alias("field"), "is_static",
                          F.when(F.col("is_static"), "STANDARD").otherwise(F.col("field_class")).alias("field_class"),
                          F.col("pattern").alias("sentence"))
    asked = cut_lineage(asked)  # patterns are made once, though they are asked and joined
    worded = expand_variations(asked.select("sentence").distinct(), n, model)
    wordings = worded.select("sentence", F.coalesce("vid", F.lit(0)).alias("vid"),
                             X.clean_malformed_variation(F.coalesce("wording", "sentence")).alias("pattern"))
    listed = wordings.groupBy("sentence").agg(F.collect_list(F.struct("vid", "pattern")).alias("_wordings"))
    return asked.join(listed, "sentence").select("row_id", "pos", "field", "is_static", "field_class", F.lit("std").alias("pool"),
                                                 F.inline("_wordings"))
