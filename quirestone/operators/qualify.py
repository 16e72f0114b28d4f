"""Understanding questions: normal form, parameters, confidence, language."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quirestone.functions.text import WS_CLASS, normalize_ws, token_count, trim_ws

#: Longest question.
MAX_CHARS = 10_000
#: Optional parameters of a question and answer profile, and the confidence it needs.
PARAMETERS, THRESHOLD = ("document", "department", "version"), 0.75
# Scripts, in the order in which they are looked for.
SCRIPTS = {"ar": r"\x{0600}-\x{06FF}", "hi": r"\x{0900}-\x{097F}", "ru": r"\x{0400}-\x{052F}", "zh": r"\x{4E00}-\x{9FFF}", "ja": r"\x{3040}-\x{30FF}", "ko": r"\x{AC00}-\x{D7AF}"}


@F.pandas_udf(T.StringType())
def nfc(texts: pd.Series) -> pd.Series:
    """Canonical composition; Spark has no built-in for it."""
    return texts.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


def received(questions: DataFrame, *, text: str) -> DataFrame:
    """Questions that came in: stripped, with ``query_id`` (a random UUID), ``received_at`` and ``rejection``; write them before use, as ids differ at each evaluation."""
    stripped = questions.withColumn(text, trim_ws(F.col(text)))
    return stripped.withColumns({"query_id": F.uuid(), "received_at": F.current_timestamp(), "rejection": rejection(F.col(text))})


def rejection(text: Column) -> Column:
    """Why a question is refused: ``empty``, ``too_long``, ``control_character``; else null."""
    return (
        F.when(text.isNull() | (trim_ws(text) == ""), "empty")
        .when(F.length(text) > MAX_CHARS, "too_long")
        .when(text.rlike(r"[\x{00}-\x{08}\x{0b}\x{0c}\x{0e}-\x{1f}\x{7f}-\x{9f}]"), "control_character")
    )


def processed(queries: DataFrame, *, text: str) -> DataFrame:
    """Add ``normalized`` (NFC, white space collapsed) and its statistics."""
    rows = queries.withColumn("normalized", normalize_ws(nfc(F.col(text))))
    n = F.col("normalized")
    digest = F.sha2(n, 256)
    return rows.withColumns({"char_count": F.length(n), "word_count": token_count(n), "estimated_tokens": F.ceil(F.length(n) / 4), "query_hash": digest, "cache_key": F.concat(F.lit("query:"), digest)})


def language(text: Column, default: str = "en") -> Column:
    """``language`` and ``confidence``: the first script that occurs and its share of the letters.

    Without a letter the default with 0.0; without one of the scripts the default with 0.6.
    """
    letters = F.regexp_count(text, F.lit(r"\p{L}"))
    chosen = F.when(letters == 0, F.struct(F.lit(default).alias("language"), F.lit(0.0).alias("confidence")))
    for code, chars in SCRIPTS.items():
        hits = F.regexp_count(text, F.lit(f"[{chars}]"))
        chosen = chosen.when(hits > 0, F.struct(F.lit(code).alias("language"), F.bround(hits / letters, 2).alias("confidence")))
    return chosen.otherwise(F.struct(F.lit(default).alias("language"), F.lit(0.6).alias("confidence")))


def qualified(queries: DataFrame, *, text: str, parameters: tuple[str, ...] = PARAMETERS) -> DataFrame:
    """Take ``name: value`` parameters out of questions and judge how clear these are.

    Adds ``question`` (what is left), one column a parameter (its first value), and the arrays
    ``missing``, ``ambiguous`` and ``conflicting`` of names, ``confidence`` and ``needs_clarification``.
    """
    names = "|".join(parameters)
    found = rf"(?i)\b({names})\s*[:=]\s*([^,;]+)"
    t = F.coalesce(F.col(text), F.lit(""))
    keys = F.transform(F.regexp_extract_all(t, F.lit(found), F.lit(1)), F.lower)
    values = F.transform(F.regexp_extract_all(t, F.lit(found), F.lit(2)), trim_ws)
    rows = queries.withColumn("__pairs", F.arrays_zip(keys.alias("k"), values.alias("v")))
    left = F.regexp_replace(t, found, "")
    rows = rows.withColumn("question", F.regexp_replace(F.regexp_replace(left, f"({WS_CLASS}|[,;])+$", ""), f"^({WS_CLASS}|[,;])+", ""))
    of = lambda p: F.transform(F.filter("__pairs", lambda x: x["k"] == p), lambda x: x["v"])
    pick = lambda test: F.filter(F.array(*[F.when(test(p), F.lit(p)) for p in parameters]), lambda x: x.isNotNull())
    rows = rows.withColumns({p: F.try_element_at(of(p), F.lit(1)) for p in parameters})
    rows = rows.withColumns(
        {
            "missing": F.when(F.col("question") == "", F.array(F.lit("question"))).otherwise(F.array().cast("array<string>")),
            "ambiguous": pick(lambda p: F.exists(of(p), lambda v: v.rlike(r"(?i)\s(or|and/or)\s|/"))),
            "conflicting": pick(lambda p: F.size(F.array_distinct(of(p))) > 1),
        }
    )
    # a missing parameter also counts as an error of its validation
    score = F.lit(1.0) - F.size("missing") * 0.45 - F.size("ambiguous") * 0.20 - F.size("conflicting") * 0.25
    rows = rows.withColumn("confidence", F.greatest(F.lit(0.0), F.round(score, 2)))
    unclear = (F.size("missing") + F.size("ambiguous") + F.size("conflicting") > 0) | (F.col("confidence") < THRESHOLD)
    return rows.withColumn("needs_clarification", unclear).drop("__pairs")


def with_profile(queries: DataFrame, *, text: str, profiles: dict[str, str], default: str | None = None) -> DataFrame:
    """Add ``profile``: the first one whose pattern occurs in the question, in any case, else ``default``."""
    chosen = F.lit(default).cast("string")
    for name, pattern in reversed(profiles.items()):
        chosen = F.when(F.col(text).rlike(f"(?i){pattern}"), name).otherwise(chosen)
    return queries.withColumn("profile", chosen)


def rule_errors(queries: DataFrame, *, key: str, rules: dict[str, str]) -> DataFrame:
    """``key`` and ``parameter`` of values that don't match the whole of their rule; nulls aren't checked."""
    broken = F.filter(F.array(*[F.when(F.col(p).isNotNull() & ~F.col(p).rlike(rf"\A(?:{r})\z"), F.lit(p)) for p, r in rules.items()]), lambda p: p.isNotNull())
    return queries.select(key, F.explode(broken).alias("parameter"))


def clarifications(qualified_queries: DataFrame, key: str) -> DataFrame:
    """One row for each thing to ask back: ``kind`` and ``parameter``, in the order ``ord``."""
    kinds = ("missing", "ambiguous", "conflicting")
    of = lambda kind: F.transform(kind, lambda p: F.struct(F.lit(kind).alias("kind"), p.alias("parameter")))
    asked = F.concat(*map(of, kinds))
    return qualified_queries.select(key, F.posexplode(asked).alias("ord", "x")).select(key, "ord", "x.kind", "x.parameter")


def with_defaults(qualified_queries: DataFrame, defaults: dict[str, str]) -> DataFrame:
    """Parameters that a question doesn't give have their default; ``given`` names those that it gives, in the order of ``defaults``."""
    given = F.filter(F.array(*[F.when(F.col(p).isNotNull(), F.lit(p)) for p in defaults]), lambda p: p.isNotNull())
    return qualified_queries.withColumn("given", given).withColumns({p: F.coalesce(F.col(p), F.lit(v)) for p, v in defaults.items()})


def retrieval_requests(
    qualified_queries: DataFrame, key: str, *, parameters: tuple[str, ...] = PARAMETERS, top_k: int = 5, budget: int = 20, threshold: float = 0.0, max_latency_ms: int = 1000, max_context_tokens: int = 4000, overrides: str | None = None
) -> DataFrame:
    """What is searched for: the question, the filters that were given, and the limits.

    ``overrides`` is a column of maps from the name of a limit to its value as text; where ``top_k`` is raised above the candidate
    budget, so is that. What a request may not be is for ``request_errors`` to say.
    """
    if not 0 < top_k <= budget or not 0 <= threshold <= 1 or max_latency_ms <= 0 or max_context_tokens <= 0:
        raise ValueError("0 < top_k <= budget, 0 <= threshold <= 1 and positive budgets are required")
    given = F.map_filter(F.create_map(*[x for p in parameters for x in (F.lit(p), F.col(p))]), lambda _, v: v.isNotNull())
    limits = {"top_k": ("int", top_k), "candidate_budget": ("int", budget), "score_threshold": ("double", threshold), "max_latency_ms": ("int", max_latency_ms), "max_context_tokens": ("int", max_context_tokens)}
    limit = lambda name, kind, value: F.coalesce(F.try_element_at(overrides, F.lit(name)).try_cast(kind), F.lit(value)) if overrides else F.lit(value)
    rows = qualified_queries.select(key, "question", given.alias("filters"), *[limit(n, k, v).alias(n) for n, (k, v) in limits.items()])
    return rows.withColumn("candidate_budget", F.greatest("candidate_budget", "top_k"))


def request_errors(requests: DataFrame, key: str) -> DataFrame:
    """``key`` and ``error`` of requests with impossible limits: ``top_k``, ``candidate_budget``, ``score_threshold``, ``max_latency_ms``, ``max_context_tokens``."""
    rules = {
        "top_k": F.col("top_k") < 1,
        "candidate_budget": F.col("candidate_budget") < F.col("top_k"),
        "score_threshold": F.isnan("score_threshold") | (F.col("score_threshold") < 0) | (F.col("score_threshold") > 1),
        "max_latency_ms": F.col("max_latency_ms") < 1,
        "max_context_tokens": F.col("max_context_tokens") < 1,
    }
    broken = F.filter(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules.items()]), lambda x: x.isNotNull())
    return requests.select(key, F.explode(broken).alias("error"))
