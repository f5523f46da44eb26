"""The one stage where a model runs, and a deterministic rule model for it."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textlake.vocab import IMPLICIT_NULL_PHRASES


class RowModel(Protocol):
    """Answers a batch of prompts; must be picklable."""

    def answer(self, prompts: pd.Series) -> pd.Series: ...


_ANSWERS = "prompt string, answer string, error string"


def _stored_answers(spark: SparkSession, path: str) -> DataFrame | None:
    """Answers of all earlier calls; None before the first."""
    try:
        stored = spark.read.schema(_ANSWERS).option("recursiveFileLookup", True).parquet(path)
        return stored.where("error is null").select("prompt", "answer")
    except AnalysisException:
        return None


def answer_apart(model: RowModel, prompts: pd.Series, ways: int = 3) -> pd.DataFrame:
    """``answer`` and ``error`` of each prompt, where a batch that fails is cut in ``ways`` parts until the failing prompts are alone.

    A part that was answered is not asked again, so each failing prompt costs about ``ways`` times as many calls as the
    batch can be cut. A wrong number of answers is a failure too.
    """
    answers = pd.DataFrame({"answer": None, "error": None}, index=range(len(prompts)), dtype=object)
    waiting = [(0, len(prompts))] if len(prompts) else []
    while waiting:
        start, end = waiting.pop()
        try:
            got = list(model.answer(prompts.iloc[start:end].reset_index(drop=True)))
            if len(got) != end - start:
                raise ValueError(f"{len(got)} answers to {end - start} prompts")
            answers.iloc[start:end, 0] = got
        except Exception as error:
            if end - start == 1:
                answers.iloc[start, 1] = f"{type(error).__name__}: {error}"
            else:
                step = -(-(end - start) // ways)
                waiting += [(i, min(i + step, end)) for i in range(start, end, step)]
    return answers


def model_map(df: DataFrame, prompt: str, model: RowModel, out: str = "answer",
              cache: DataFrame | None = None, cache_path: str | None = None,
              tasks: int | None = None, keep_errors: bool = False) -> DataFrame:
    """Answer ``prompt`` of every row.

    Each distinct prompt is asked once, and not at all when ``cache`` (prompt, answer)
    holds it. With ``cache_path`` the answers are stored before they are joined back, so
    that a lost executor never asks again; each call stores only prompts that are not there yet. Prompts are small but answers are slow, so they
    are spread over ``tasks`` tasks whatever their size.

    A prompt that the model raises on ends the job. With ``keep_errors`` it gets no answer and the rest goes on:
    ``<out>_status`` is ``answered``, ``failed`` or ``no prompt`` and ``<out>_error`` says why. Failures are not kept
    as answers, so a later call asks them again.
    """
    spark = df.sparkSession
    asked = df.select(F.col(prompt).alias("prompt")).where("prompt is not null").distinct()
    if cache is not None:
        asked = asked.join(cache.select("prompt"), "prompt", "left_anti")
    if cache_path and (old := _stored_answers(spark, cache_path)) is not None:
        asked = asked.join(old.select("prompt"), "prompt", "left_anti")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if keep_errors:
                found = answer_apart(model, batch["prompt"])
            else:
                found = pd.DataFrame({"answer": model.answer(batch["prompt"]), "error": None})
            yield pd.DataFrame({"prompt": batch["prompt"].array, "answer": found["answer"].array, "error": found["error"].array})

    tasks = tasks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    no_error = F.lit(None).cast("string").alias("error")
    answers = asked.repartition(tasks, "prompt").mapInPandas(run, _ANSWERS)
    if cache_path:
        call = f"{cache_path}/run-{uuid.uuid4().hex}"
        answers.write.parquet(call)
        failed = spark.read.schema(_ANSWERS).parquet(call).where("error is not null")
        answers = _stored_answers(spark, cache_path).select("*", no_error).unionByName(failed)
    if cache is not None:
        answers = answers.unionByName(cache.select("prompt", "answer", no_error))
    if cache_path or cache is not None:
        answers = answers.groupBy("prompt").agg(F.min("answer").alias("answer"), F.min("error").alias("error"))
    if not keep_errors:
        return df.join(answers.drop("error").withColumnsRenamed({"prompt": prompt, "answer": out}), prompt, "left")
    answers = answers.withColumnsRenamed({"prompt": prompt, "answer": out, "error": f"{out}_error"})
    status = F.when(F.col(prompt).isNull(), "no prompt").when(F.col(f"{out}_error").isNotNull(), "failed").otherwise("answered")
    return df.join(answers, prompt, "left").withColumn(f"{out}_status", status)


# wordings the rule model makes of a sentence: (text before, text after)
FRAMES = [("", ""), ("In this case, ", ""), ("For the record, ", ""), ("As it stands, ", ""),
          ("To be exact, ", ""), ("At present, ", ""), ("By all accounts, ", ""), ("Put simply, ", ""),
          ("On this point, ", ""), ("It turns out that ", ""), ("It is clear that ", ""),
          ("One may say that ", ""), ("We note that ", ""), ("Here, ", ""), ("Overall, ", "")]


class RuleModel:
    """Deterministic answers. A prompt is ``kind<TAB>argument<TAB>...``."""

    def answer(self, prompts: pd.Series) -> pd.Series:
        return prompts.map(self._one)

    def _one(self, prompt: str) -> str:
        kind, *args = prompt.split("\t")
        return getattr(self, f"_{kind}", self._echo)(*args)

    @staticmethod
    def _echo(*args: str) -> str:
        return args[0] if args else ""

    @staticmethod
    def _variations(sentence: str, n: str, attempt: str = "") -> str:
        """Numbered list of n wordings."""
        def word(i: int) -> str:
            before, after = FRAMES[i % len(FRAMES)]
            body = sentence if not before else sentence[:1].lower() + sentence[1:]
            return before + body + after
        return "\n".join(f"{i + 1}. {word(i)}" for i in range(int(n)))

    @staticmethod
    def _closing(phrase: str, column: str, value: str) -> str:
        return f"{phrase} the {column} contains: {value}."

    @staticmethod
    def _state(column: str, value: str) -> str:
        """A fresh sentence that states a value."""
        return f"The {column} is {value}."

    @staticmethod
    def _restate(field: str, value: str, attempt: str, reason: str, sentence: str) -> str:
        """Another sentence for one that was refused, by the reason."""
        return f"The {field} is {value}." if reason == "no field" else f"The {field} value is {value}."

    @staticmethod
    def _null_indicator(sentence: str) -> str:
        low = sentence.lower()
        return next((p for p in sorted(IMPLICIT_NULL_PHRASES, key=lambda p: (-len(p), p)) if p in low), "")

    @staticmethod
    def _scrub(sentence: str, value: str) -> str:
        """The sentence without a leaked value."""
        return " ".join(sentence.replace(value, "it").split())
