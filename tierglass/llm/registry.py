"""Queries of this subpackage and the SQL that checks those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tierglass.llm import block_search, decontamination, prefix_trie, quality_rules, substring_dedup
from tierglass.llm.block_search import op9_block_search
from tierglass.llm.class_model import op6_class_model
from tierglass.llm.decontamination import op11_benchmark_decontamination
from tierglass.llm.html_text import op2_html_extraction
from tierglass.llm.language_id import op3_language_id
from tierglass.llm.packing import op4_best_fit_packing
from tierglass.llm.periodic_runs import op13_periodic_runs
from tierglass.llm.piece_tokens import op10_piece_tokens
from tierglass.llm.prefix_trie import op12_prefix_trie
from tierglass.llm.quality_classifier import op7_quality_classifier
from tierglass.llm.quality_rules import op1_quality_rules
from tierglass.llm.simhash import op8_simhash_near_dedup
from tierglass.llm.substring_dedup import op5_substring_dedup

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_quality_rules,
        op2_html_extraction,
        op3_language_id,
        op4_best_fit_packing,
        op5_substring_dedup,
        op6_class_model,
        op7_quality_classifier,
        op8_simhash_near_dedup,
        op9_block_search,
        op10_piece_tokens,
        op11_benchmark_decontamination,
        op12_prefix_trie,
        op13_periodic_runs,
    )
}

SQL: dict[str, str] = {
    "op1_quality_rules": quality_rules.SQL,
    "op5_substring_dedup": substring_dedup.SQL,
    "op9_block_search": block_search.SQL,
    "op11_benchmark_decontamination": decontamination.SQL,
    "op12_prefix_trie": prefix_trie.SQL,
}
