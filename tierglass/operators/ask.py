"""Asking models: cache lookup, inference of what is missing, and storing the answers."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierglass.functions.labels import keyword_class
from tierglass.functions.membership import filter_of, probable
from tierglass.lexicon import PROMPT_TEXT_CHARS
from tierglass.operators import answers as A
from tierglass.operators.evidence import RULES, scan_text
from tierglass.operators.prompts import Node, compose_prompt, expand_prompts
from tierglass.session import cut_lineage
from tierglass.sources.answer_cache import store_answers, stored_answers

ANSWERS = (
    "role", "model", "node_ord", "label", "score", "reasoning", "raw_response", "blank", "error",
    "parse_error", "backend",
)


def requests(docs: DataFrame, nodes: Sequence[Node], models: Mapping[str, str], key: str, metadata: Column) -> DataFrame:
    """One narrow row per document, node and role, with the key of its answer in the cache."""
    digest = A.content_digest(F.col("text"), metadata)
    roles = F.array(*[F.struct(F.lit(r).alias("role"), F.lit(m).alias("model")) for r, m in models.items()])
    asked = expand_prompts(docs.select(key, digest.alias("_digest")), nodes)
    return asked.select(
        key, "node_ord", "prompt", A.cache_key(F.col("_digest"), F.col("prompt")).alias("prompt_hash"), F.inline(roles)
    )


def ask(
    docs: DataFrame,
    nodes: Sequence[Node],
    cache: DataFrame,
    run: Callable[[str, str], str],
    models: Mapping[str, str],
    key: str = "doc_id",
    metadata_json: Column | None = None,
    image_summary: Column | None = None,
    max_chars: int | None = PROMPT_TEXT_CHARS,
    cache_fallbacks: bool = True,
    now: Column | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Answers of every node and role, and the cache with the new ones.

    ``models`` names the model of each role. What the cache has is replayed; every other request is run
    once per distinct content, however many copies of a document ask it, and its answer is stored, the
    keyword class of a failed one too unless ``cache_fallbacks`` is false. The answers go to
    ``classify(..., parsed=True)``. Requests meet the cache in one left join without texts; texts
    are moved only for documents with something to ask.
    """
    metadata = F.lit(None).cast("string") if metadata_json is None else metadata_json
    wanted = requests(docs, nodes, models, key, metadata)
    answers, kept = _answers(docs, wanted, cache, run, key, metadata, image_summary, max_chars, now)
    return answers, A.cache_upsert(cache, kept, cache_fallbacks)


def ask_stored(
    docs: DataFrame,
    nodes: Sequence[Node],
    path: str,
    run: Callable[[str, str], str],
    models: Mapping[str, str],
    key: str = "doc_id",
    metadata_json: Column | None = None,
    image_summary: Column | None = None,
    max_chars: int | None = PROMPT_TEXT_CHARS,
    cache_fallbacks: bool = True,
    now: Column | None = None,
) -> DataFrame:
    """Answers as :func:`ask` gives them, from the cache stored under ``path``, which is brought up to date.

    Only entries that the requests ask for leave the scan of the cache, and only the folders of new
    entries are rewritten. The answers are kept before the cache changes, so they stay what they were.
    """
    metadata = F.lit(None).cast("string") if metadata_json is None else metadata_json
    wanted = cut_lineage(requests(docs, nodes, models, key, metadata))
    cache = stored_answers(docs.sparkSession, path, wanted)
    answers, kept = _answers(docs, wanted, cache, run, key, metadata, image_summary, max_chars, now)
    answers = cut_lineage(answers)
    store_answers(kept, path, cache_fallbacks)
    return answers


def _answers(
    docs: DataFrame,
    wanted: DataFrame,
    cache: DataFrame,
    run: Callable[[str, str], str],
    key: str,
    metadata: Column,
    image_summary: Column | None,
    max_chars: int | None,
    now: Column | None,
) -> tuple[DataFrame, DataFrame]:
    """Answers to all requests, and what is new for the cache."""
    summary = F.lit("") if image_summary is None else image_summary
    stored = cache.select(*A.CACHE_KEY, F.struct(*A.CACHE_VALUES).alias("_stored"))
    asked = cut_lineage(wanted.join(stored, list(A.CACHE_KEY), "left"))
    missing = (
        asked.filter(F.col("_stored").isNull())
        .groupBy(*A.CACHE_KEY)
        .agg(F.min(F.struct(key, "role", "node_ord", "prompt")).alias("_first"))
        .groupBy(F.col(f"_first.{key}").alias(key))
        .agg(F.collect_list(F.struct(*A.CACHE_KEY, "_first.prompt")).alias("_asked"))
    )
    # Documents with nothing to ask are dropped where they are scanned, as far as the filter can tell.
    bodies = probable(
        docs.select(key, "text", metadata.alias("_meta"), summary.alias("_images")), filter_of(missing, [key]), [key]
    )
    heard = scan_text(bodies, RULES).withColumn("_keyword", keyword_class(F.col("hits")))
    prompts = heard.join(missing, key).select("text", "_meta", "_images", "_keyword", F.inline("_asked"))
    full = compose_prompt(F.col("prompt"), F.col("text"), F.col("_meta"), F.col("_images"), max_chars=max_chars)
    # Inference is dear and need not repeat itself, so what it says is kept before anything reads it.
    said = cut_lineage(
        A.infer(
            prompts.select(
                *A.CACHE_KEY,
                F.col("_keyword.label").alias("kw_label"),
                F.col("_keyword.score").alias("kw_score"),
                F.col("_keyword.reasoning").alias("kw_reasoning"),
                full.alias("full_prompt"),
            ),
            run,
        )
    )
    parsed = A.parse_responses(said).withColumn("backend", F.lit("model"))
    failed = F.coalesce("error", "parse_error").isNotNull()
    usable = ~failed & ~F.col("blank")
    kept = parsed.select(
        *A.CACHE_KEY,
        *[F.when(usable, F.col(c)).otherwise(F.col(f"kw_{c}")).alias(c) for c in A.ANSWER_FIELDS],
        F.coalesce("raw_response", F.lit("")).alias("raw_response"),
        failed.alias("fallback"),
        (F.current_timestamp() if now is None else now).alias("updated_at"),
    )
    fresh = asked.filter(F.col("_stored").isNull()).drop("_stored", "prompt")
    fresh = fresh.join(parsed.drop("kw_label", "kw_score", "kw_reasoning"), list(A.CACHE_KEY))
    hits = asked.filter(F.col("_stored").isNotNull()).select(key, "role", "node_ord", *A.CACHE_KEY, "_stored.*")
    answers = fresh.select(key, *ANSWERS).unionByName(A.cached_answers(hits).select(key, *ANSWERS))
    return answers, kept
