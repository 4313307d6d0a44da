"""Language-model calls as a partition operator with a pluggable client."""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.text import stripped, used_tokens, without_fence
from .diffs import LARGE_DIFF

#: A client takes a prompt and gives its answer.
Client = Callable[[str], str]
ATTEMPTS, LONGEST_WAIT = 5, 60.0
SUMMARY_INPUT = 48_000
# The status of a limit and the least of a server's faults, and words in the names of errors worth another attempt.
LIMITED, FAULT = 429, 500
RETRIED_WORDS = [
    "ratelimit", "ratelimiterror", "apierror", "apitimeout", "apiconnection", "apistatus", "internalserver", "serviceunavailable", "servererror",
    "resourceexhausted", "deadlineexceeded",
]


def _status(error: BaseException) -> int | None:
    """The status of an error, or else of its response."""
    told = getattr(error, "status_code", None)
    if told is None:
        told = getattr(getattr(error, "response", None), "status_code", None)
    try:
        return None if told is None else int(told)
    except (TypeError, ValueError):
        return None


def is_retryable(error: BaseException) -> bool:
    """Lost time or connection; else a known status decides, and without one the error's name."""
    if isinstance(error, (TimeoutError, ConnectionError)):
        return True
    status = _status(error)
    if status is not None:
        return status == LIMITED or status >= FAULT
    return any(word in type(error).__name__.lower() for word in RETRIED_WORDS)


def asked_wait(error: BaseException) -> float | None:
    """Seconds that the error's response asks to wait; its headers may be in any case."""
    headers = getattr(getattr(error, "response", None), "headers", None) or {}
    told = {str(name).lower(): value for name, value in dict(headers).items()}.get("retry-after")
    try:
        return None if told is None else float(told)
    except (TypeError, ValueError):
        return None


def with_retries(client: Client, attempts: int = ATTEMPTS, wait: Callable[[float], None] = time.sleep) -> Client:
    """client with exponential, jittered waits between attempts; a wait that the response asks for counts, up to a minute."""

    def call(prompt: str) -> str:
        for n in range(attempts):
            try:
                return client(prompt)
            except Exception as error:  # noqa: BLE001
                if n + 1 == attempts or not is_retryable(error):
                    raise
                asked = asked_wait(error)
                wait(min(LONGEST_WAIT, 2.0**n + random.uniform(0.0, 1.0) if asked is None else asked))
        raise AssertionError

    return call


def answered(prompts: DataFrame, make_client: Callable[[], Client], prompt: str = "prompt") -> DataFrame:
    """prompts with `answer` and `error`; make_client runs once a task, and a failed call is a row, not a failed job."""
    schema = StructType([*prompts.schema.fields, StructField("answer", StringType()), StructField("error", StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = None
        for batch in batches:
            client = client or with_retries(make_client())
            answers, errors = [], []
            for text in batch[prompt]:
                try:
                    answers.append(client(text or ""))
                    errors.append(None)
                except Exception as error:  # noqa: BLE001
                    answers.append(None)
                    errors.append(f"{type(error).__name__}: {error}")
            yield batch.assign(answer=pd.Series(answers, dtype=object, index=batch.index), error=pd.Series(errors, dtype=object, index=batch.index))

    return prompts.mapInPandas(run, schema)


def stub_answer(prompt: Column) -> Column:
    """A deterministic answer by what a prompt asks for; stands in for a model in tests and offline runs."""
    finding = F.lit('[{"category": "code_quality", "severity": "low", "title": "Stub finding", "confidence": 0.5}]')
    return (
        F.when(F.contains(prompt, F.lit("overall_severity")), F.lit('{"overall_severity": "info", "recommendation": "approve", "summary": "stub"}'))
        .when(F.contains(prompt, F.lit("findings")), finding)
        .when(F.contains(prompt, F.lit("Summarize")), F.concat(F.lit("Summary: "), F.left(prompt, F.lit(80))))
        .otherwise(F.lit("[]"))
    )


def summarised(diffs: DataFrame, summaries: DataFrame | None) -> DataFrame:
    """diffs (review_id, file_path, diff_text) with large ones replaced by their summary, or else cut."""
    cut = F.left("diff_text", F.lit(SUMMARY_INPUT))
    if summaries is None:
        return diffs.withColumn("diff_text", F.when(F.length("diff_text") > LARGE_DIFF, cut).otherwise(F.col("diff_text")))
    joined = diffs.join(summaries.select("review_id", "file_path", "summary"), ["review_id", "file_path"], "left")
    text = F.when(F.length("diff_text") > LARGE_DIFF, F.coalesce("summary", cut)).otherwise(F.col("diff_text"))
    return joined.withColumn("diff_text", text).drop("summary")


# The members of a judge's answer.
JUDGED = ["groundedness", "completeness", "actionability", "precision", "overall"]


def judged(answers: DataFrame) -> DataFrame:
    """answers (scenario_id, answer, error) with the judge's scores, its comment and what went wrong; an absent score is 0.

    A failed call keeps its error, an answer that is no JSON or no object gets one; either has no scores.
    """
    v = answers.withColumn("_v", F.try_parse_json(stripped(without_fence(F.col("answer")))))
    is_object = F.coalesce(F.expr("schema_of_variant(_v) like 'OBJECT%'"), F.lit(False))
    scores = {c: F.expr(f"case when variant_get(_v, '$.{c}') is null then 0.0D else try_variant_get(_v, '$.{c}', 'double') end") for c in JUDGED}
    good = is_object & F.col("error").isNull()
    for c in JUDGED:
        good = good & scores[c].isNotNull()
    note = F.when(F.col("error").isNotNull(), F.col("error")).when(F.col("_v").isNull(), "judge output was not valid JSON").when(~good, "judge output has no numbers where scores are asked")
    comment = F.coalesce(F.expr("try_variant_get(_v, '$.comment', 'string')"), F.lit(""))
    return v.select("scenario_id", *[F.when(good, scores[c]).alias(c) for c in JUDGED], F.when(good, comment).alias("comment"), note.alias("error"))


def usage(answers: DataFrame) -> DataFrame:
    """(review_id, agent, tokens) of answers (review_id, agent, answer, input_tokens, output_tokens)."""
    spent = used_tokens(F.col("answer"), F.col("input_tokens"), F.col("output_tokens"))
    return answers.groupBy("review_id", "agent").agg(F.sum(spent).alias("tokens"))
