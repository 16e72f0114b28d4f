"""Answers of a language model, by any provider, in batches inside tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quirestone.functions.text import is_blank, token_count


class LanguageModel(Protocol):
    """What a model service must offer; it is created in each task."""

    name: str

    def generate(self, system: str, prompt: str) -> str: ...


class StubModel:
    """Repeats the question; for tests and dry runs."""

    name = "stub"

    def generate(self, system: str, prompt: str) -> str:
        return f"[stub] {prompt.splitlines()[-1] if prompt else ''}"


def generated(prompts: DataFrame, *, key: str, models: list[Callable[[], LanguageModel]]) -> DataFrame:
    """``key``, ``text``, ``model``, ``attempts``, ``error`` and token counts for every prompt.

    ``prompts`` has ``system_prompt``, ``context_block`` and ``user_prompt``, and may have ``history_block``; blank ones are left
    out. An empty answer counts as a failure. Models are tried in order until one
    answers; a prompt that none answers keeps the last error and a null text, and doesn't stop the others.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        services = [m() for m in models]
        for batch in batches:
            rows = []
            for system, prompt in zip(batch.column("system").to_pylist(), batch.column("prompt").to_pylist()):
                text = name = error = None
                attempts = 0
                for service in services:
                    attempts += 1
                    try:
                        said = service.generate(system, prompt)
                        if not said or said.isspace():
                            raise ValueError("empty answer")
                        text, name, error = said, service.name, None
                        break
                    except Exception as e:  # whatever a service raises, the next one is tried
                        error = f"{type(e).__name__}: {e}"
                rows.append((text, name, attempts, error))
            columns = list(zip(*rows)) or [[]] * 4
            kinds = [pa.string(), pa.string(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(list(c), k) for c, k in zip(columns, kinds))], [*batch.schema.names, "text", "model", "attempts", "error"])

    asked = prompts.select(F.col(key).alias("key"), F.coalesce("system_prompt", F.lit("")).alias("system"), F.concat_ws("\n\n", *[F.nullif(c, F.lit("")) for c in ("history_block", "context_block") if c in prompts.columns], "user_prompt").alias("prompt"))
    schema = T.StructType([*asked.schema.fields, *(T.StructField(n, T.IntegerType() if n == "attempts" else T.StringType()) for n in ("text", "model", "attempts", "error"))])
    out = asked.mapInArrow(run, schema)
    return out.select(F.col("key").alias(key), "text", "model", "attempts", "error", (token_count(F.col("system")) + token_count(F.col("prompt"))).alias("prompt_tokens"), token_count(F.col("text")).alias("completion_tokens"))


def response_errors(responses: DataFrame, *, key: str) -> DataFrame:
    """``key`` and ``error`` of responses that can't be accepted.

    ``responses`` has ``text``, ``model``, ``finish_reason``, ``latency_ms``, ``prompt_tokens``, ``completion_tokens``, ``total_tokens`` and
    ``generated_at``. Errors: ``blank_text``, ``blank_model``, ``blank_finish_reason``, ``invalid_latency`` (null, not finite or negative),
    ``invalid_tokens`` (null, negative, or a total that isn't the sum), ``missing_time``.
    """
    tokens = [F.col(c) for c in ("prompt_tokens", "completion_tokens", "total_tokens")]
    latency = F.col("latency_ms").cast("double")
    fine = lambda c: F.coalesce(c, F.lit(False))
    rules = {
        "blank_text": is_blank(F.col("text")),
        "blank_model": is_blank(F.col("model")),
        "blank_finish_reason": is_blank(F.col("finish_reason")),
        "invalid_latency": ~fine(~F.isnan(latency) & (latency >= 0) & (latency < float("inf"))),
        "invalid_tokens": ~fine((tokens[0] >= 0) & (tokens[1] >= 0) & (tokens[0] + tokens[1] == tokens[2])),
        "missing_time": F.col("generated_at").isNull(),
    }
    broken = F.filter(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules.items()]), lambda x: x.isNotNull())
    return responses.select(key, F.explode(broken).alias("error"))


def model_registry(models: list[Callable[[], LanguageModel]]) -> dict[str, Callable[[], LanguageModel]]:
    """Models by name; blank and repeated names are refused."""
    known: dict[str, Callable[[], LanguageModel]] = {}
    for model in models:
        name = model().name
        if not name.strip() or name in known:
            raise ValueError(f"the model name {name!r} is blank or known already")
        known[name] = model
    return known
