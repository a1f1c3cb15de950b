"""Model answers: parsing, last node, heuristic fallback, cache and inference hook."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierglass.functions import answers as A
from tierglass.functions.text import strip
from tierglass.lexicon import DEBUG_CHARS

ANSWER_FIELDS = ("label", "score", "reasoning")


def parse_responses(responses: DataFrame) -> DataFrame:
    """Add ``label, score, reasoning, blank, parse_error`` to raw responses.

    ``blank`` marks answers without any text; their label columns are null, as
    they are where ``parse_error`` tells why a field cannot be read.
    """
    response = F.col("_response")
    fields = {
        "_label": A.LABEL_KEYS,
        "_confidence": A.CONFIDENCE_KEYS,
        "_reasoning": A.REASONING_KEYS,
    }
    df = responses.withColumn(
        "_response", strip(F.coalesce(F.col("raw_response"), F.lit("")))
    ).withColumn("_data", A.json_data(response))
    df = df.withColumns(
        {
            f"_{key}_field": A.json_field(F.col("_data"), key)
            for keys in fields.values()
            for key in keys
        }
    )
    df = df.withColumns(
        {
            name: A.first_truthy([F.col(f"_{key}_field") for key in keys])
            for name, keys in fields.items()
        }
    )
    error = A.field_error(F.col("_label"), F.col("_confidence"), F.col("_reasoning"))
    df = df.withColumns({"blank": response == "", "parse_error": error})
    usable = ~F.col("blank") & F.col("parse_error").isNull()
    parsed = df.withColumns(
        {
            "label": F.when(usable, A.answer_label(F.col("_label"), response)),
            "score": F.when(usable, A.answer_score(F.col("_confidence"), response)),
            "reasoning": F.when(usable, A.answer_reasoning(F.col("_reasoning"), response)),
        }
    )
    return parsed.drop(
        "_response", "_data", *fields, *[f"_{k}_field" for ks in fields.values() for k in ks]
    )


def _answer(reason: Column, backend: Column, *extra: str) -> Column:
    return F.struct(
        "model", "label", "score", "reasoning", "blank", reason.alias("reason"), backend.alias("backend"), *extra
    )


def _backend(answers: DataFrame) -> Column:
    return F.col("backend") if "backend" in answers.columns else F.lit("model")


def _reason() -> Column:
    return F.coalesce("error", "parse_error")


ROLES = ("primary", "secondary")


def _last_of_roles(answers: DataFrame, key: str, answer: Column) -> DataFrame:
    """The last answer of both roles side by side; null where a role has none."""

    def last(role: str) -> Column:
        in_role = F.col("role") == role
        return F.max_by(F.when(in_role, answer), F.when(in_role, F.col("node_ord"))).alias(role)

    return answers.groupBy(key).agg(*[last(role) for role in ROLES])


def last_responses(responses: DataFrame, key: str = "doc_id", last_node: int | None = None) -> DataFrame:
    """Raw responses of the last prompt node per document and role.

    With ``last_node``, the number of the tree's last node, this is a filter. Otherwise the last node
    that answered is looked for, which moves one raw response per document and role.
    """
    if last_node is not None:
        return responses.filter(F.col("node_ord") == last_node)
    raw = F.struct("model", "raw_response", "error", "node_ord")
    sides = F.array(*[F.struct(F.lit(role).alias("role"), F.col(role).alias("a")) for role in ROLES])
    return (
        _last_of_roles(responses, key, raw)
        .select(key, F.inline(sides))
        .filter(F.col("a").isNotNull())
        .select(key, "role", "a.*")
    )


def last_answer(responses: DataFrame, key: str = "doc_id", last_node: int | None = None) -> DataFrame:
    """The answer of the last prompt node per document and role, with its ``reason``.

    Only that one response is parsed.
    """
    answers = parse_responses(last_responses(responses, key, last_node))
    return answers.select(key, "role", _answer(_reason(), _backend(answers), "node_ord").alias("a")).select(
        key, "role", "a.*"
    )


def pair_answers(
    answers: DataFrame, key: str = "doc_id", last_node: int | None = None, parsed: bool = False
) -> DataFrame:
    """Last primary and last secondary answer side by side.

    Structs are null where a document has no answer in that role. Raw answers are parsed after the last
    one is known; ``parsed`` marks answers that have their label already, as the cache replays them.
    """
    if not parsed:
        answers = parse_responses(last_responses(answers, key, last_node))
    return _last_of_roles(answers, key, _answer(_reason(), _backend(answers)))


def fall_back(answer: Column, heuristic: Column, missing_reason: str | None) -> Column:
    """Complete one answer with the keyword class where it gave no label.

    A blank response takes the keyword class but does not count as fallback; an
    error, an unreadable answer or a missing one does.
    """
    present = answer.isNotNull()
    failed = answer["reason"].isNotNull()
    usable = present & ~failed & ~answer["blank"]
    chosen = {
        name: F.when(usable, answer[name]).otherwise(heuristic[name]).alias(name)
        for name in ANSWER_FIELDS
    }
    reason = F.when(present, answer["reason"]).otherwise(F.lit(missing_reason))
    return F.struct(
        answer["model"].alias("model"),
        *chosen.values(),
        (~present | failed).alias("fallback"),
        reason.cast("string").alias("reason"),
        F.when(present, answer["backend"]).otherwise("heuristic").alias("backend"),
    )


def with_fallback(
    parsed: DataFrame, docs: DataFrame, key: str = "doc_id", heuristic: str = "keyword"
) -> DataFrame:
    """Answers as given by :func:`last_answer`, completed by the keyword class.

    ``docs`` is narrow: the key and the keyword-class struct. A document without
    answer rows keeps one row with reason ``engine_unavailable``.
    """
    joined = docs.select(key, heuristic).join(parsed, key, "left")
    answered = F.col("role").isNotNull()
    answer = F.when(answered, _answer(F.col("reason"), F.col("backend")))
    return (
        joined.withColumn("f", fall_back(answer, F.col(heuristic), "engine_unavailable"))
        .select(key, "role", "node_ord", "f.*")
    )


def debug_struct(answer: Column, chars: int = DEBUG_CHARS) -> Column:
    """Debug view of one completed answer, with the start of its reasoning."""
    return F.struct(
        answer["model"].alias("model"),
        answer["backend"].alias("backend"),
        answer["fallback"].alias("fallback"),
        answer["reason"].alias("reason"),
        answer["score"].alias("last_confidence"),
        F.substring(answer["reasoning"], 1, chars).alias("last_reasoning"),
    )


# --- cache -------------------------------------------------------------------

CACHE_KEY = ("model", "prompt_hash")
CACHE_VALUES = ("label", "score", "reasoning", "raw_response")


def content_digest(text: Column, metadata_json: Column) -> Column:
    """Digest of a document's content, computed once per document."""
    return F.sha2(
        F.concat(
            F.sha2(F.coalesce(text, F.lit("")), 256),
            F.sha2(F.coalesce(metadata_json, F.lit("")), 256),
        ),
        256,
    )


def cache_key(digest: Column, prompt: Column) -> Column:
    """Key of one (document, prompt) request; equal content gives equal keys."""
    return F.sha2(F.concat(digest, prompt), 256)


def cache_split(requests: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requests with a stored answer, and requests still to run.

    The cache holds one row per key, so a request never multiplies. Copies of a
    document share a key; adaptive skew joins split such keys on the request side.
    """
    stored = cache.select(*CACHE_KEY, *CACHE_VALUES)
    hits = requests.join(stored, list(CACHE_KEY), "inner")
    misses = requests.join(cache.select(*CACHE_KEY), list(CACHE_KEY), "left_anti")
    return hits, misses


def cache_upsert(cache: DataFrame, new: DataFrame, cache_fallbacks: bool = True) -> DataFrame:
    """Last write per key wins; aggregated map-side, so repeated keys stay cheap.

    Heuristic fallbacks are stored like real answers unless ``cache_fallbacks``
    is false. Equal timestamps are decided by the stored values.
    """
    if not cache_fallbacks:
        new = new.filter(~F.coalesce(F.col("fallback"), F.lit(False)))
    columns = [*CACHE_KEY, *CACHE_VALUES, "updated_at"]
    entry = F.struct("updated_at", *CACHE_VALUES)
    return (
        cache.select(*columns)
        .unionByName(new.select(*columns))
        .groupBy(*CACHE_KEY)
        .agg(F.max(entry).alias("e"))
        .select(*CACHE_KEY, *[F.col("e")[c].alias(c) for c in CACHE_VALUES], "e.updated_at")
    )


def cached_answers(hits: DataFrame) -> DataFrame:
    """Cache hits replayed as answers that are not fallbacks."""
    return hits.withColumns(
        {
            "backend": F.lit("cache"),
            "blank": F.lit(False),
            "error": F.lit(None).cast("string"),
            "parse_error": F.lit(None).cast("string"),
        }
    )


# --- inference hook ----------------------------------------------------------


def infer(
    prompts: DataFrame, run: Callable, prompt: str = "full_prompt", batched: bool = False
) -> DataFrame:
    """Call ``run(model, prompt)`` for every row; an exception becomes ``error``.

    With ``batched`` it is ``run(model, prompts)`` for the rows of one model in a batch, and gives a
    list; an exception is then the error of all of them, and so is a list of another length, as nobody
    knows whose answers are missing.

    Rows are streamed in Arrow batches. ``prompts`` keeps its own partitioning,
    so no model or document gathers its rows in one task.
    """
    kept = [c for c in prompts.columns if c != prompt]
    schema = prompts.select(*kept).schema.add("raw_response", "string").add("error", "string")

    def answer(model: str, text: str) -> tuple[str | None, str | None]:
        try:
            return run(model, text), None
        except Exception as problem:  # the caller's function may raise anything
            return None, str(problem) or type(problem).__name__

    def answers(models: list[str], texts: list[str]) -> list[tuple[str | None, str | None]]:
        if not batched:
            return [answer(m, p) for m, p in zip(models, texts)]
        out: list[tuple[str | None, str | None]] = [(None, None)] * len(models)
        for model in dict.fromkeys(models):
            own = [i for i, m in enumerate(models) if m == model]
            said, problem = answer(model, [texts[i] for i in own])
            if problem is None and (count := len(said) if isinstance(said, (list, tuple)) else 0) != len(own):
                problem = f"{count} answers to {len(own)} prompts"
            for i, one in zip(own, said if problem is None else [None] * len(own)):
                out[i] = (one, problem)
        return out

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            pairs = answers(frame["model"].tolist(), frame[prompt].tolist())
            out = frame[kept].copy()
            out["raw_response"] = [p[0] for p in pairs]
            out["error"] = [p[1] for p in pairs]
            yield out

    return prompts.mapInPandas(batches, schema)
