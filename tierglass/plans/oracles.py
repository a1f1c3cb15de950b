"""DuckDB SQL that checks the registered queries, one statement per query."""

from __future__ import annotations

from tierglass import lexicon as X
from tierglass.lexicon import NO_TEXT_PLACEHOLDER
from tierglass.operators import prompts as pm
from tierglass.plans.oracle_parts import (
    any_of,
    keyword_list,
    label_of,
    rank,
    snippet,
    strip,
    text,
    with_parts,
)
from tierglass.plans import seeds
from tierglass.plans.queries import NODES
from tierglass.sources.documents import suffixes

ORACLES: dict[str, str] = {}


def _add(name: str, sql: str, instead: dict[str, str] | None = None) -> None:
    ORACLES[name] = with_parts(sql, instead)


def _values(words) -> str:
    return ", ".join(text(w) for w in words)


PAGE_PATH = """concat('/in/page', page_id, ['.txt', '.PDF', '.png', '.bin', '', '.html.gz'][length(url) % 6 + 1])"""
MIME = f"""CASE WHEN x IN ({_values(suffixes('text'))}) THEN 'text' WHEN x = 'pdf' THEN 'pdf'
  WHEN x IN ({_values(suffixes('image'))}) THEN 'image' END"""
ROUTED = f"""(SELECT *, {MIME} AS mime FROM (SELECT page_id, html,
  lower(regexp_extract({PAGE_PATH}, '(?i)[^/]\\.([^./]+?)(?:\\.(?:gz|bz2|xz|br|z))?$', 1)) AS x FROM pages))"""

_add("s1_text_source", "SELECT doc_id, source, length(text) AS text_length, md5(text) AS digest FROM documents")
_add("s2_type_routing", f"SELECT page_id, coalesce(mime, 'other') AS mime_class FROM {ROUTED}")
_add(
    "s3_unsupported_type",
    f"""SELECT page_id, mime IS NOT NULL AS supported,
    CASE WHEN mime IS NULL THEN 0 ELSE length(html) END AS text_length,
    CASE WHEN mime IS NULL THEN 0 ELSE len(string_split(html, chr(12))) END AS page_count FROM {ROUTED}""",
)
NAMED = """(SELECT doc_id, lang, CASE lang WHEN 'en' THEN concat('memo.', doc_id, '.md') WHEN 'fr' THEN ''
  WHEN 'es' THEN 'notes' END AS name FROM documents)"""
INLINE_NAME = "coalesce(nullif(name, ''), concat('inline-', doc_id, '.txt'))"
INLINE_PATH = "concat(doc_id, CASE WHEN lang = 'en' THEN '.md' ELSE '.txt' END)"
_add("s4_inline_documents", f"SELECT doc_id, {INLINE_NAME} AS filename, {INLINE_PATH} AS source FROM {NAMED}")
_add(
    "s4_uploaded_documents",
    f"""SELECT doc_id, coalesce(nullif(name, ''), 'document') AS filename,
    concat(doc_id, CASE WHEN lang = 'en' THEN '.md' ELSE '.bin' END) AS source FROM {NAMED}""",
)
_add(
    "p10_metadata_defaults",
    f"""SELECT doc_id, {INLINE_NAME} AS filename,
    CASE WHEN lang = 'de' THEN '/kept/source' ELSE {INLINE_PATH} END AS source FROM {NAMED}""",
)
FIRST_CITE = "(SELECT doc_id, arg_min(snippet, ord) AS snippet, arg_min(signal, ord) AS signal, " \
    "arg_min(confidence, ord) AS confidence, count(*) AS n FROM cites GROUP BY doc_id)"
_add(
    "s5_report_json",
    f"""SELECT f.doc_id, f.label, 'true' AS verifier_agreement, c.snippet AS citations_snippet,
    c.signal AS citations_metadata_signal, f.doc_id::VARCHAR AS classification_id,
    'engine_unavailable' AS debug_info_primary_reason, f.raw_score AS score
    FROM f8 f JOIN {FIRST_CITE} c USING (doc_id)""",
)
_add(
    "s5_engine_report_json",
    """SELECT doc_id, label AS category, agreement::VARCHAR AS agreement, source AS citations_source,
    round(engine_score, 6) AS confidence FROM f9""",
)
CATEGORY = "CASE label WHEN 'Public' THEN 'Public' WHEN 'Confidential' THEN 'Confidential' ELSE 'Sensitive' END"
SAFETY = f"CASE WHEN label = 'Unsafe' OR n_flags > 0 THEN {text(X.NOT_SAFE_TEXT)} ELSE {text(X.SAFE_TEXT)} END"
SHORT = "CASE WHEN length(snippet) > 260 THEN substr(snippet, 1, 257) || '...' ELSE snippet END"


def _clean(snip: str) -> str:
    from tierglass.plans.oracle_parts import collapse

    return collapse(strip(snip))


CITED = f"""(SELECT doc_id, ord, 'text' AS type, page,
  CASE WHEN snippet = '' THEN '{{"label": "' || label || '", "signal": "' || signal || '"}}' ELSE {SHORT} END AS content,
  signal AS description, label FROM (SELECT * REPLACE ({_clean('snippet')} AS snippet) FROM cites))"""
COUNTED = f"(SELECT doc_id, count(*) AS n FROM {CITED} GROUP BY doc_id)"


def _chunks(counts: str) -> str:
    """Text chunks that bring each document to three entries."""
    return f"""(SELECT doc_id, n + row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS pos, content, page
      FROM (SELECT z.doc_id, z.n, z.i, {strip('substr(st, s + 1, size)')} AS content, p.page
        FROM (SELECT *, least(length(st), i * size)::BIGINT AS s FROM (
          SELECT k.doc_id, k.st, c.n, 3 - c.n AS needed,
          greatest(180, length(k.st) // (4 - c.n))::BIGINT AS size,
          unnest(range(0, 2 * (3 - c.n))) AS i
          FROM keyword k JOIN {counts} c USING (doc_id) WHERE c.n < 3 AND k.st <> '')) z
        LEFT JOIN page_spans p ON p.doc_id = z.doc_id AND p.p_start <= z.s AND z.s < p.p_end)
      WHERE content <> '' QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY i) <= 3 - n)"""


ENTRIES = f"""(SELECT doc_id, ord - 1 AS pos, type, page, content, description, label FROM {CITED}
  UNION ALL SELECT doc_id, pos, 'text', page, content, NULL, NULL FROM {_chunks(COUNTED)})"""
_add(
    "s5_download_json",
    f"""SELECT f.doc_id::VARCHAR AS document_id, f.label, '2024-01-01T00:00:00' AS generated_at,
    concat(f.doc_id, '.txt') AS document_name, {CATEGORY.replace('label', 'f.label', 1)} AS category,
    CASE WHEN text = '' THEN '0' ELSE len(string_split(text, chr(12)))::VARCHAR END AS page_count,
    {SAFETY.replace('label', 'f.label', 1)} AS content_safety, e.content AS evidence_content,
    'false' AS single_prompt_mode
    FROM f8 f JOIN {ENTRIES} e ON e.doc_id = f.doc_id AND e.pos = 0""",
)
_add(
    "s5_written_reports",
    "SELECT f.doc_id, s.origin AS task_id, f.label, f.raw_score AS score FROM f8 f JOIN seeded s USING (doc_id)",
)
CONTENT_TYPE = """CASE WHEN has_text AND image_count > 0 THEN 'mixed' WHEN image_count > 0 THEN 'image'
  WHEN has_text THEN 'text' ELSE 'unknown' END"""
_add(
    "s6_bundle_json",
    f"""SELECT doc_id, md5(s.text) AS text_digest, m.source AS metadata_source,
    word_count::VARCHAR AS metadata_word_count, {CONTENT_TYPE} AS metadata_content_type,
    CASE WHEN image_count > 0 THEN '1' END AS images_page FROM meta m JOIN seeded s USING (doc_id)""",
)
HISTORY = """SELECT f.classification_id, r.document_path, r.classification AS predicted_label, r.score,
  f.decision, f.suggested_label, f.comments, round(f.quality_score, 6) AS quality_score,
  strftime(f.created_at, '%Y-%m-%dT%H:%M:%S') AS created_at
  FROM feedback f JOIN records r ON r.id = f.classification_id"""
_add("s8_history_export", HISTORY)
_add("h6_feedback_history", HISTORY)
_add("s10_record_ids", """SELECT row_number() OVER (ORDER BY doc_id) AS id, doc_id, label AS classification,
  raw_score AS score FROM f8""")
_add("s10_appended_records", """SELECT run, n, 1 + n * (run = 'second')::INT AS low,
  n + n * (run = 'second')::INT AS high, n AS distinct_ids
  FROM (SELECT count(*) AS n FROM seeded), (VALUES ('first'), ('second')) t(run)""")


def _nodes(nodes) -> str:
    rows = ", ".join(
        f"({n.node_ord}::BIGINT, {text(n.name)}, {text(n.prompt)}, {n.depth}::BIGINT, {text(n.parent or '')})" for n in nodes
    )
    return f"(VALUES {rows}) AS t(node_ord, name, prompt, depth, parent)"


_add("s11_prompt_trace", f"""SELECT doc_id, node_ord, concat('[', name, ']', chr(10), prompt, chr(10), chr(10)) AS entry
  FROM documents, {_nodes(NODES)}""")
_add("m1_prompt_nodes", f"SELECT doc_id, node_ord, name, depth, parent FROM documents, {_nodes(NODES)}")
_add("m2_prompt_expansion", f"SELECT doc_id, node_ord, prompt FROM documents, {_nodes(NODES)}")
_add("m6_single_prompt", f"SELECT doc_id, name, prompt, true AS single_prompt FROM documents, {_nodes(pm.SINGLE_PROMPT)}")
_add("s13_text_or_fallback", "SELECT doc_id, md5(CASE WHEN lang = 'fr' THEN text ELSE source END) AS digest FROM documents")

_add("p1_form_feed_pages", 'SELECT doc_id, page, p_start AS start, p_end AS "end" FROM page_spans')


def _whole(sep: str) -> str:
    return f"(SELECT conv_id, string_agg(text, {sep} ORDER BY turn) AS t, count(*) AS n FROM conversations GROUP BY conv_id)"


PAGES = """SELECT conv_id, turn // 2 AS part, row_number() OVER w AS page,
  (sum(length(text) + 2) OVER w - length(text) - 2)::BIGINT AS start,
  (sum(length(text) + 2) OVER w - 2)::BIGINT AS "end"
  FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)"""
_add("p2_assemble_pages", f"SELECT conv_id, md5(t) AS digest, n AS page_count FROM {_whole('chr(10) || chr(10)')}")
_add("p2_page_spans", f'SELECT conv_id, page, start, "end" FROM ({PAGES})')
_add("p2_page_spans_in_parts", f'SELECT conv_id, page, start, "end" FROM ({PAGES})')
_add("s13_joined_pages", f"SELECT conv_id, md5(t) AS digest FROM {_whole('chr(10)')}")
_add("p3_metadata", """SELECT doc_id, source, has_text, text_length, text_length AS character_count, word_count,
  image_count > 0 AS has_images, image_count, page_count FROM meta""")
_add("p4_content_type", f"SELECT doc_id, {CONTENT_TYPE} AS content_type FROM meta")
_add("p5_image_rollup", "SELECT doc_id, image_count, pages FROM meta")
DETECTED = f"(SELECT *, CASE {CONTENT_TYPE} WHEN 'unknown' THEN CASE WHEN text_length > 0 THEN 'text' ELSE 'text' END " \
    f"ELSE {CONTENT_TYPE} END AS content_type FROM meta)"
_add("p6_detect_content_type", f"SELECT doc_id, content_type FROM {DETECTED}")
_add("p7_page_count", """SELECT doc_id, coalesce(CASE WHEN word_count % 3 = 0 AND page_count > 0 THEN page_count END,
  last_page, CASE WHEN has_text THEN 1 ELSE 0 END) AS page_count FROM meta""")
_add("p8_image_count", "SELECT doc_id, CASE WHEN word_count % 3 = 0 THEN 5 ELSE image_count END AS image_count FROM meta")
_add("p9_offset_page", """SELECT s.doc_id, s.o AS "offset", p.page FROM
  (SELECT doc_id, unnest([0, 99, 100, 101, length(text)]) AS o FROM seeded) s
  LEFT JOIN page_spans p ON p.doc_id = s.doc_id AND p.p_start <= s.o AND s.o < p.p_end""")
_add("p11_image_relevance", "SELECT doc_id, image_idx, true AS relevant FROM images")
_add("p12_bounding_box", """SELECT vec_id,
  CASE WHEN label % 2 = 0 THEN round(greatest(0, least(1, embedding[1]::DOUBLE * 5)), 6) ELSE 0.02 END AS x,
  CASE WHEN label % 2 = 0 THEN round(greatest(0, least(1, embedding[2]::DOUBLE * 5)), 6) ELSE 0.02 END AS y,
  CASE WHEN label % 2 = 0 THEN round(greatest(0.05, least(1, embedding[3]::DOUBLE * 5)), 6) ELSE 0.96 END AS width,
  CASE WHEN label % 2 = 0 THEN round(greatest(0.05, least(1, embedding[4]::DOUBLE * 5)), 6) ELSE 0.96 END AS height
  FROM embeddings""")
DATA_URL = "concat('data:image/png;base64,', base64(encode(content)))"
_add("p13_data_url", f"SELECT doc_id, image_idx, {DATA_URL} AS url FROM images")
_add("p14_image_summary", f"""SELECT s.doc_id, coalesce(i.summary, {text(X.NO_IMAGES_TEXT)}) AS summary FROM seeded s
  LEFT JOIN (SELECT doc_id, '[' || string_agg(concat('{{"index":', image_idx + 1,
    CASE WHEN page IS NOT NULL THEN concat(',"page":', page) ELSE '' END, ',"metadata":{{',
    CASE WHEN image_idx <> 1 THEN '"score":"0.5"'
         WHEN doc_id % 8 < 4 THEN concat('"Label":"figure ', doc_id, '","note":"', repeat('n', 200), '"')
         ELSE concat('"label":"figure ', doc_id, '","note":"short"') END, '}}}}'), ',' ORDER BY image_idx) || ']' AS summary
    FROM images GROUP BY doc_id) i USING (doc_id)""")

for _name, _low, _high in (
    ("e1_ssn_signals", 0, 0), ("e2_passport_signals", 1, 1), ("e3_card_signals", 2, 2),
    ("e4_bank_signals", 3, 3), ("e5_email_signals", 4, 4), ("e6_confidential_keywords", 5, 13),
    ("e7_unsafe_keywords", 14, 23), ("e9_uncapped_signals", 0, 23),
):
    _add(_name, f"""SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY rule_ord, match_ord) - 1 AS signal_ord,
      label, snippet, description, page, confidence FROM all_signals WHERE rule_ord BETWEEN {_low} AND {_high}""")
_add("e8_snippet", f"SELECT doc_id, {snippet('text', 'length(text) // 2', 'length(text) // 2 + 5')} AS snippet FROM seeded")
_add("e9_capped_signals", """SELECT n.doc_id, count(s.doc_id) AS n_signals,
  coalesce(string_agg(s.description, '|' ORDER BY s.signal_ord), '') AS descriptions
  FROM norm n LEFT JOIN signals s USING (doc_id) GROUP BY n.doc_id""")
_add("e10_signals_table", """SELECT n.doc_id, s.signal_ord, s.label, s.snippet, s.description, s.page, s.confidence,
  CASE WHEN s.doc_id IS NOT NULL THEN 'text' END AS source_type FROM norm n LEFT JOIN signals s USING (doc_id)""")

_add("c1_keyword_class", "SELECT doc_id, kw_label AS label, kw_score AS score FROM keyword")
_reasons = " ".join(
    f"WHEN {any_of('lo', r.keywords)} THEN 'Heuristic detection of keywords ' || "
    f"(SELECT string_agg(w, ', ' ORDER BY w) FROM (VALUES {keyword_list(r.keywords)}) t(w) WHERE contains(lo, w)) "
    f"|| ' indicating {r.label}.'"
    for r in X.KEYWORD_RULES
)
_add("c2_keyword_reasoning", f"SELECT doc_id, CASE {_reasons} ELSE {text(X.NO_KEYWORDS_REASON)} END AS reasoning FROM keyword")
_add("c3_label_rank", f"SELECT doc_id, {rank('kw_label')}::BIGINT AS severity, kw_label AS label FROM keyword")
_add("c4_escalation", "SELECT doc_id, kw_label AS initial, label FROM f8")
_add("c5_safety_flags", f"""SELECT n.doc_id, coalesce(f.flags, '') AS flags, coalesce(g.flags, '') AS configured
  FROM norm n LEFT JOIN flags f USING (doc_id) LEFT JOIN (
    SELECT doc_id, string_agg(flag, '|' ORDER BY flag) AS flags FROM (
      SELECT doc_id, w AS flag FROM norm JOIN (VALUES {keyword_list(X.CONFIGURED_SAFETY_KEYWORDS)}) t(w) ON contains(lo, w)
      UNION SELECT doc_id, description FROM signals WHERE label = 'Unsafe') GROUP BY doc_id) g USING (doc_id)""")
ODD = """(SELECT doc_id, [' PUBLIC ', 'Very Confidential', 'Highly Sensitive', 'high', 'Unsafe', '', 'Sensitive']
  [n_chars % 8 + 1] AS label FROM documents)"""
_add("c6_api_category", f"""SELECT doc_id, CASE WHEN lower(trim(coalesce(label, ''))) = 'public' THEN 'Public'
  WHEN contains(lower(coalesce(label, '')), 'confidential') THEN 'Confidential' ELSE 'Sensitive' END AS category FROM {ODD}""")
_add("c7_bucket", f"""SELECT doc_id, CASE WHEN contains(lower(coalesce(label, '')), 'high') THEN 'Highly Sensitive'
  WHEN contains(lower(coalesce(label, '')), 'confidential') THEN 'Confidential' ELSE 'Public' END AS bucket FROM {ODD}""")
_add("c8_content_safety", f"SELECT doc_id, {SAFETY} AS content_safety FROM f8")

TYPED = f"""(SELECT m.*, s.lang, CASE WHEN s.lang = 'fr' THEN concat('Titre ', s.doc_id) END AS title,
  CASE WHEN s.lang <> 'de' THEN concat(s.doc_id, '.txt') END AS filename FROM {DETECTED} m JOIN seeded s USING (doc_id))"""
_tc2, _tc4 = pm.CONDITIONAL_NODES
_add("m3_conditional_nodes", f"""SELECT doc_id, content_type, {text(_tc2.name)} AS name FROM {TYPED} WHERE content_type IN ('text', 'mixed')
  UNION ALL SELECT doc_id, content_type, {text(_tc4.name)} FROM {TYPED} WHERE content_type IN ('image', 'mixed')""")


def _filled(prompt: str, slots: dict[str, str]) -> str:
    sql = text(prompt)
    for slot, value in slots.items():
        sql = f"replace({sql}, {text(slot)}, {value})"
    return sql


TC2 = _filled(_tc2.prompt, {
    "{{ doc.title | default('Unknown document') }}": "coalesce(title, 'Unknown document')",
    "{{ doc.filename | default('unavailable') }}": "coalesce(filename, 'unavailable')",
})
TC4 = _filled(_tc4.prompt, {
    "{{ doc.image_count | default(0) }}": "image_count::VARCHAR",
    "{{ doc.pages_with_images | default('unknown') }}":
        "CASE WHEN pages = '' THEN 'unknown' ELSE '[' || replace(pages, ',', ', ') || ']' END",
})
_add("m4_rendered_prompts", f"""SELECT doc_id, {text(_tc2.name)} AS name, {TC2} AS prompt FROM {TYPED} WHERE content_type IN ('text', 'mixed')
  UNION ALL SELECT doc_id, {text(_tc4.name)}, {TC4} FROM {TYPED} WHERE content_type IN ('image', 'mixed')""")
_tree_lines = "\n".join("  " * n.depth + f"- ({n.name}) {n.prompt}" for n in NODES)
_add("m5_prompt_text", f"""SELECT doc_id, md5(t) AS digest, length(t) AS n FROM (SELECT doc_id, concat({text(_tree_lines)},
  CASE WHEN content_type IN ('text', 'mixed') THEN chr(10) || '  - ({_tc2.name}) ' || {TC2} ELSE '' END,
  CASE WHEN content_type IN ('image', 'mixed') THEN chr(10) || '  - ({_tc4.name}) ' || {TC4} ELSE '' END) AS t FROM {TYPED})""")
_add("m7_composed_prompt", f"""SELECT doc_id, md5(p) AS digest, length(p) AS n FROM (SELECT doc_id, concat_ws(chr(10) || chr(10),
  'Instruction.', 'Task Prompt:' || chr(10) || 'Task.',
  CASE WHEN lang <> 'none' THEN concat('Metadata:', chr(10), '{{"lang":"', lang, '"}}') END,
  'Image Summary:' || chr(10) || 'no images',
  'Document Text:' || chr(10) || CASE WHEN st = '' THEN {text(X.NO_TEXT_PLACEHOLDER)} ELSE substr(st, 1, 8000) END) AS p FROM norm)""")
HASHED = f"""(SELECT doc_id, node_ord, sha256(sha256(sha256(s.text) || sha256(concat('{{"lang":"', s.lang, '"}}'))) || t.prompt) AS prompt_hash
  FROM seeded s, {_nodes(NODES)})"""
_add("m8_cache_key", f"SELECT doc_id, node_ord, prompt_hash FROM {HASHED}")
CACHED = f"(SELECT DISTINCT h.prompt_hash FROM {HASHED} h JOIN labels USING (doc_id))"
_add("m9_cache_hits", f"SELECT doc_id, node_ord, 0.51::DOUBLE AS score, 'cache' AS backend FROM {HASHED} JOIN {CACHED} USING (prompt_hash)")
_add("m9_cache_misses", f"SELECT doc_id, node_ord, 'alpha' AS model FROM {HASHED} WHERE prompt_hash NOT IN (FROM {CACHED})")
REPLAYED = f"""(SELECT h.doc_id, x.label FROM {HASHED} h JOIN (
  SELECT prompt_hash, CASE WHEN bool_or(toxic = 1) THEN 'Unsafe' ELSE 'Public' END AS label
  FROM {HASHED} JOIN labels USING (doc_id) GROUP BY prompt_hash) x USING (prompt_hash) WHERE h.node_ord = 3)"""
_add("m9_replayed_answers", f"""SELECT a.doc_id,
  CASE WHEN coalesce(s.top, 0) > {rank('a.l')} THEN {label_of('s.top')} ELSE a.l END AS label,
  a.raw_score, a.backend, a.fallback FROM (
    SELECT k.doc_id, coalesce(c.label, k.kw_label) AS l, CASE WHEN c.label IS NULL THEN k.kw_score ELSE 0.51 END AS raw_score,
    CASE WHEN c.label IS NULL THEN 'heuristic' ELSE 'cache' END AS backend, c.label IS NULL AS fallback
    FROM keyword k LEFT JOIN {REPLAYED} c USING (doc_id)) a LEFT JOIN strongest s USING (doc_id)""")
_add("m10_cache_upsert", f"SELECT 'alpha' AS model, 'stored 2' AS reasoning, 0.52::DOUBLE AS score, count(*) AS n FROM {CACHED}")
_add("m10_cache_without_fallbacks", f"""SELECT 'alpha' AS model, CASE WHEN keep THEN 'stored 2' ELSE 'stored 1' END AS reasoning, count(*) AS n
  FROM (SELECT prompt_hash, bool_or(toxic <> 1) AS keep FROM {HASHED} JOIN labels USING (doc_id) GROUP BY prompt_hash) GROUP BY ALL""")
_add("m11_json_block", "SELECT doc_id, role, node_ord, block FROM blocks")
_add("m12_json_fields", """SELECT doc_id, role, node_ord, jl AS label, try_cast(jc AS DOUBLE) AS confidence, jr AS reasoning FROM chosen""")
_add("m13_label_in_text", """SELECT doc_id, role, node_ord, CASE WHEN contains(lower(raw_response), 'public') THEN 'Public'
  WHEN contains(lower(raw_response), 'confidential') THEN 'Confidential'
  WHEN contains(lower(raw_response), 'highly sensitive') THEN 'Highly Sensitive'
  WHEN contains(lower(raw_response), 'unsafe') THEN 'Unsafe' END AS label FROM responses""")
_add("m14_m15_closest_label", f"""SELECT doc_id, CASE WHEN label = 'Unsafe' THEN 'Unsafe' WHEN label = 'Highly Sensitive' THEN label
  WHEN label = 'Very Confidential' OR label IS NULL THEN 'Confidential' ELSE 'Public' END AS label FROM {ODD}""")
_add("m16_confidence", "SELECT doc_id, role, node_ord, score FROM parsed")
_add("m17_reasoning", "SELECT doc_id, role, node_ord, label, reasoning, blank, parse_error FROM parsed")
_add("m18_fallback", "SELECT doc_id, role, label, score, fallback, reason FROM completed")
_add("m19_last_node", "SELECT doc_id, role, node_ord, label, score FROM last_answers")
_add("m20_debug", """SELECT doc_id, p_model AS model, p_fallback AS fallback, p_reason AS reason,
  p_score AS last_confidence FROM paired""")
_body = "lower(st)"
_add("u1_inference", f"""SELECT doc_id,
  CASE WHEN contains({_body}, 'malware') THEN NULL WHEN contains({_body}, 'nda') THEN 'Confidential' ELSE 'Public' END AS label,
  CASE WHEN contains({_body}, 'malware') THEN NULL WHEN contains({_body}, 'nda') THEN 0.7 ELSE 0.6 END::DOUBLE AS score,
  CASE WHEN contains({_body}, 'malware') THEN 'refused' END AS error FROM norm""")

_add("f1_pairing", "SELECT doc_id, p_label AS primary_label, s_label AS secondary_label, agreement FROM fused")
_add("f2_more_severe", "SELECT doc_id, fused_label AS label FROM fused")
_add("f3_classifier_score", "SELECT doc_id, round(mean_score, 6) AS score FROM fused")
_add("f4_engine_score", "SELECT doc_id, round(engine_score, 6) AS score FROM fused")
_add("f5_model_outputs", """SELECT doc_id, coalesce(p_model, 'heuristic') AS model, p_label AS category, p_score AS confidence
  FROM paired WHERE NOT has_secondary OR p_model <> s_model
  UNION ALL SELECT doc_id, s_model, s_label, s_score FROM paired WHERE has_secondary""")
_add("f6_f7_citations", """SELECT c.doc_id, c.ord, f.source, c.page, c.snippet, c.confidence, c.label, c.signal
  FROM cites c JOIN f8 f USING (doc_id)""")
_add("f8_classify", """SELECT doc_id, label, raw_score, n_signals, first_signal, flags AS safety_flags,
  greatest(n_signals, 1) AS n_citations FROM f8""")
_add("f8_classify_with_answers", """SELECT doc_id, label, round(mean_score, 6) AS raw_score, agreement AS verifier_agreement,
  flags AS safety_flags FROM f9""")
_add("f9_engine", """SELECT f.doc_id, f.label AS category, round(f.engine_score, 6) AS confidence, f.agreement,
  greatest(f.n_signals, 1) AS n_citations,
  coalesce(s.confidence, CASE WHEN f.label = 'Public' THEN 0.6 ELSE 0.85 END) AS first_confidence
  FROM f9 f LEFT JOIN signals s ON s.doc_id = f.doc_id AND s.signal_ord = 0""")
_add("f10_api_results", f"""SELECT f.doc_id::VARCHAR AS document_id, label, raw_score AS score, flags AS safety_flags,
  true AS verifier_agreement, f.doc_id AS classification_id, greatest(n_signals, 1) AS n_citations,
  concat('/reports/task/', f.doc_id, '/report.json') AS report, {CATEGORY} AS category,
  CASE WHEN text = '' THEN 0 ELSE len(string_split(text, chr(12))) END AS page_count, 0::BIGINT AS image_count,
  e.n AS n_evidence, {SAFETY} AS content_safety, false AS single_prompt
  FROM f8 f JOIN (SELECT doc_id, least(count(*), 10) AS n FROM {ENTRIES} GROUP BY doc_id) e USING (doc_id)""")

_add("v1_evidence_entries", f"SELECT doc_id, pos, type, page, content, description, label FROM {ENTRIES} WHERE pos < 10")
RELEVANT = "(SELECT * FROM images QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY image_idx) <= 2)"
SHOWN = f"""(SELECT doc_id, ord - 1 AS pos, type, page, content FROM {CITED} UNION ALL
  SELECT i.doc_id, c.n + i.image_idx, 'image', i.page, {DATA_URL} FROM {RELEVANT} i JOIN {COUNTED} c USING (doc_id))"""
_add("v1_evidence_with_images", f"""SELECT doc_id, pos, type, page, md5(content) AS digest FROM (
  SELECT doc_id, pos, type, page, content FROM {SHOWN} UNION ALL
  SELECT doc_id, pos, 'text', page, content FROM {_chunks(f'(SELECT doc_id, count(*) AS n FROM {SHOWN} GROUP BY doc_id)')}) WHERE pos < 10""")
_add("v2_fallback_chunks", f"""SELECT doc_id, pos, page, content FROM {_chunks('(SELECT doc_id, 0 AS n FROM keyword)')}""")
_add("v3_image_evidence", f"""SELECT doc_id, image_idx, page, {DATA_URL} AS content,
  CASE WHEN image_idx = 1 AND doc_id % 8 >= 4 THEN concat('figure ', doc_id) ELSE 'Image snippet' END AS description,
  0.96::DOUBLE AS height FROM {RELEVANT}""")
RESULTS = f"""(SELECT f.doc_id AS id, s.origin, f.label, {CATEGORY.replace('label', 'f.label', 1)} AS category, f.raw_score AS score,
  {SAFETY.replace('label', 'f.label', 1)} AS content_safety, concat(f.doc_id, '.txt') AS document_name,
  TIMESTAMP '2024-01-01' + INTERVAL 1 MINUTE * f.doc_id AS ts,
  CASE WHEN f.label = 'Confidential' THEN 'Confidential' ELSE 'Public' END AS category_bucket
  FROM f8 f JOIN seeded s USING (doc_id))"""
_add("v4_history", f"SELECT id, label, category_bucket FROM {RESULTS} ORDER BY ts DESC, id LIMIT 25")
_add("v4_history_by_source", f"""SELECT origin, id, category_bucket FROM {RESULTS}
  QUALIFY row_number() OVER (PARTITION BY origin ORDER BY ts DESC, id) <= 25""")
_add("v5_history_table", f"""SELECT document_name AS document, category_bucket AS category, printf('%.2f', score) AS score,
  content_safety AS safety, CASE WHEN origin = 'src3' THEN 'Single Prompt' ELSE 'Prompt Tree' END AS mode,
  strftime(ts, '%Y-%m-%d %H:%M') AS run_at FROM {RESULTS} ORDER BY ts DESC, id LIMIT 10""")
_add("v6_label_distribution", f"SELECT category_bucket AS bucket, count(*) AS n FROM {RESULTS} GROUP BY 1")
_add("v7_head_metrics", f"""SELECT count(*) AS total_docs, arg_max(category_bucket, ts) AS last_bucket,
  count(*) FILTER (WHERE lower(category_bucket) LIKE 'high%') AS high_risk FROM {RESULTS}""")
_add("v8_timestamp", """SELECT event_id, CASE WHEN event_type <> 'error' THEN strftime(ts, '%Y-%m-%d %H:%M:%S') END AS at,
  true AS known FROM events""")
_add("v10_highlight_spans", """SELECT c.doc_id, c.ord AS citation, strpos(f.text, c.snippet) - 1 AS start,
  strpos(f.text, c.snippet) - 1 + length(c.snippet) AS "end", (c.ord - 1) % 5 AS colour
  FROM cites c JOIN f8 f USING (doc_id) WHERE trim(c.snippet) <> '' AND contains(f.text, c.snippet)""")

DEFAULTED = "coalesce(nullif(reviewer, ''), 'Analyst') AS reviewer, coalesce(nullif(decision, ''), 'accept') AS decision"
_add("h1_feedback_accepted", f"""SELECT id, classification_id, {DEFAULTED} FROM feedback
  WHERE classification_id IN (SELECT id FROM records)""")
_add("h1_feedback_rejected", f"""SELECT id, {DEFAULTED}, concat('Classification ', classification_id, ' not found') AS error
  FROM feedback WHERE classification_id NOT IN (SELECT id FROM records)""")
_add("h2_list_feedback", "SELECT id, classification_id, comments FROM feedback")
_add("h2_list_feedback_of_one", "SELECT id, classification_id, comments FROM feedback WHERE classification_id = 4")
_add("h3_misclassifications", """SELECT f.id, f.classification_id,
  coalesce(nullif(f.suggested_label, ''), r.classification) AS expected_label, f.comments AS reviewer_notes
  FROM feedback f JOIN records r ON r.id = f.classification_id
  WHERE lower(trim(f.decision)) IN ('override', 'reclassify') OR coalesce(f.suggested_label, '') <> ''""")
_add("h4_label_statistics", "SELECT label, total, overrides, round(avg_quality, 6) AS avg_quality FROM stats")
_add("h5_recalibration", "SELECT doc_id, label, raw_score, round(score, 6) AS score FROM recal")
THRESHOLDS = """(SELECT lower(replace(classification, ' ', '_')) AS key, classification AS label,
  avg(score) AS value FROM records GROUP BY classification)"""
UPDATED = f"""(SELECT t.key, CASE WHEN s.total IS NULL THEN t.value ELSE
  round(greatest(0.05, least(0.99, t.value + (0.2 - s.overrides / s.total) * 0.02)), 4) END AS value
  FROM {THRESHOLDS} t LEFT JOIN stats s USING (label))"""
_add("h7_thresholds", f"SELECT key, round(value, 6) AS value FROM {UPDATED}")
NOTES = f"""(SELECT concat({text(X.HITL_HEADING)}, string_agg(concat(chr(10), '- ', label, ': overrides ',
  printf('%.0f', round_even(overrides / total * 100, 0)), '%, avg quality ', printf('%.2f', round_even(avg_quality, 2))), '' ORDER BY label)) FROM stats)"""
_add("h8_prompt_annotation", f"SELECT doc_id, concat(source, {text(X.HITL_MARKER)}, {NOTES}) AS prompt FROM documents")
_add("h9_refine", f"""SELECT doc_id, md5(concat(source, {text(X.HITL_MARKER)}, {NOTES})) AS digest,
  (SELECT string_agg(printf('%s=%.6f', key, value), ',' ORDER BY key) FROM {UPDATED}) AS thresholds FROM documents""")
_add("h10_old_feedback", """SELECT decision, 2 * count(*) AS n, count(suggested_label) AS n_suggested,
  round(sum(quality_score), 6) AS quality FROM feedback GROUP BY decision""")

_add("q1_case_report", """SELECT case_id AS id, expected_label, predicted_label, score, latency_ms,
  CASE WHEN answered THEN true END AS verifier_agreement, flags AS safety_flags, answered FROM case_rows""")
METRICS = {
    "total_cases": "greatest(count(*), 1)",
    "accuracy": "round(count(*) FILTER (WHERE predicted_label = expected_label) / greatest(count(*), 1), 6)",
    "latency_average": "round(coalesce(avg(latency_ms), 0), 6)",
    "latency_max": "coalesce(max(latency_ms), 0)",
    "latency_min": "coalesce(min(latency_ms), 0)",
    "flagged_cases": "count(*) FILTER (WHERE n_flags > 0)",
    "flagged_rate": "round(count(*) FILTER (WHERE n_flags > 0) / greatest(count(*), 1), 6)",
    "critical_cases": "count(*) FILTER (WHERE critical)",
    "critical_detection_rate":
        "round(coalesce(count(*) FILTER (WHERE critical AND n_flags > 0) / nullif(count(*) FILTER (WHERE critical), 0), 1), 6)",
    "expected_flag_match_rate":
        "round(coalesce(count(*) FILTER (WHERE wants_flags AND list_has_all(string_split(flags, '|'), ['malware', 'breach'])) "
        "/ nullif(count(*) FILTER (WHERE wants_flags), 0), 1), 6)",
    "missing_results": "count(*) FILTER (WHERE NOT answered)",
}


def _metrics(*names: str) -> str:
    return "SELECT " + ", ".join(f"{METRICS[n]} AS {n}" for n in names) + " FROM case_rows"


_add("q2_accuracy", _metrics("accuracy"))
_add("q3_latency", _metrics("latency_average", "latency_max", "latency_min"))
_add("q4_flagged", _metrics("flagged_cases", "flagged_rate"))
_add("q5_critical_detection", _metrics("critical_cases", "critical_detection_rate"))
_add("q6_expected_flags", _metrics("expected_flag_match_rate"))
_add("q7_benchmark", _metrics(*METRICS))
REPORTED = _metrics("total_cases", "missing_results", "accuracy", "latency_average", "latency_max", "flagged_cases",
                    "critical_detection_rate")
_add("s9_evaluation_report", f"""SELECT case_id AS id, expected_label, predicted_label, round(score, 6) AS score,
  flags AS safety_flags, m.* FROM case_rows, ({REPORTED}) m""")

REQUESTED = """(SELECT conv_id AS task_id, turn, CASE WHEN role = 'assistant' THEN turn - 100 ELSE conv_id END AS doc FROM conversations)"""
_add("j1_job_validation", f"""SELECT task_id, CASE WHEN error = '' THEN 'queued' ELSE 'rejected' END AS status, error FROM (
  SELECT task_id, CASE WHEN task_id % 10 = 3 THEN 'Provide either document IDs or raw text, not both.'
    WHEN count(*) FILTER (WHERE d.doc_id IS NULL) > 0 THEN 'Unknown documents: ' ||
      string_agg(doc::VARCHAR, ', ' ORDER BY turn) FILTER (WHERE d.doc_id IS NULL) ELSE '' END AS error
  FROM {REQUESTED} q LEFT JOIN documents d ON d.doc_id = q.doc GROUP BY task_id)""")
COUNTS = """(SELECT t.task_id, count(o.doc_id) AS total, count(*) FILTER (WHERE outcome = 'done') AS done,
  count(*) FILTER (WHERE outcome = 'failed') AS failures,
  arg_min(error, (ts, event_id)) FILTER (WHERE outcome = 'failed') AS first_error
  FROM (SELECT c_custkey AS task_id FROM customer UNION SELECT task_id FROM outcomes) t
  LEFT JOIN outcomes o USING (task_id) GROUP BY t.task_id)"""
_add("j2_task_status", f"""SELECT task_id, CASE WHEN total = 0 OR failures > 0 THEN 'failed' WHEN done = total THEN 'completed'
  WHEN done = 0 THEN 'queued' ELSE 'processing' END AS status,
  CASE WHEN total = 0 OR failures > 0 THEN 0.0 ELSE round(done / total, 6) END AS progress,
  CASE WHEN total = 0 THEN 'No documents submitted' ELSE first_error END AS error FROM {COUNTS}""")
_add("j3_task_results", """SELECT task_id, doc_id FROM outcomes o WHERE outcome = 'done' AND NOT EXISTS (
  SELECT 1 FROM outcomes x WHERE x.task_id = o.task_id AND x.outcome = 'failed' AND (x.ts, x.event_id) < (o.ts, o.event_id))""")
_add("j4_streamed_classification", "SELECT doc_id, label, raw_score, flags AS safety_flags FROM f8")
_add("j5_streamed_statistics", "SELECT label, total, overrides, round(avg_quality, 6) AS avg_quality FROM stats")
_add("j6_streamed_recalibration", "SELECT doc_id, label, raw_score, round(score, 6) AS score FROM recal")

TURNS = f"(SELECT conv_id, turn, coalesce({seeds.SEEDED_TURN}, '') AS t FROM conversations)"
ASSEMBLED = {
    "seeded": f"SELECT conv_id AS doc_id, 'conversation' AS source, string_agg(t, chr(10) || chr(10) ORDER BY turn, t) AS text "
    f"FROM {TURNS} GROUP BY conv_id",
    "page_spans": "SELECT doc_id, page, p_start, p_start + n AS p_end FROM (SELECT conv_id AS doc_id, length(t) AS n, "
    "row_number() OVER w AS page, coalesce(sum(length(t) + 2) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"
    f"::BIGINT AS p_start FROM {TURNS} WINDOW w AS (PARTITION BY conv_id ORDER BY turn, t))",
}
_add("f8_classify_assembled", """SELECT f8.doc_id AS conv_id, label, n_signals, flags AS safety_flags, coalesce(pages, '') AS pages
  FROM f8 LEFT JOIN (SELECT doc_id, string_agg(coalesce(page::VARCHAR, '-'), '|' ORDER BY signal_ord) AS pages
  FROM signals GROUP BY doc_id) p ON p.doc_id = f8.doc_id""", ASSEMBLED)
_add("f8_classify_uncapped", "SELECT doc_id, label, n_signals, flags AS safety_flags FROM f8",
     {"signals": "SELECT * FROM all_signals"})
_add("m7_composed_prompt_whole", f"""SELECT doc_id, md5(p) AS digest, length(p) AS n FROM (SELECT doc_id,
  concat_ws(chr(10) || chr(10), 'Instruction.', 'Task Prompt:' || chr(10) || 'Task.', 'Image Summary:' || chr(10) || 'no images',
  'Document Text:' || chr(10) || CASE WHEN st = '' THEN {text(NO_TEXT_PLACEHOLDER)} ELSE st END) AS p FROM norm)""")
SAID = """(SELECT k.*, t.top, contains(lo, 'malware') AS refused, CASE WHEN contains(lo, 'malware') THEN kw_label
  WHEN contains(lo, 'nda') THEN 'Confidential' ELSE 'Public' END AS said,
  CASE WHEN contains(lo, 'malware') THEN kw_score WHEN contains(lo, 'nda') THEN 0.7 ELSE 0.6 END::DOUBLE AS said_score
  FROM keyword k LEFT JOIN strongest t USING (doc_id))"""
_add("m9_m10_ask", f"""SELECT doc_id, node_ord, CASE WHEN NOT refused THEN said END AS label,
  CASE WHEN NOT refused THEN said_score END AS score, CASE WHEN refused THEN 'refused' END AS error, 'model' AS backend,
  said AS stored_label, 'cache' AS "then", NULL::VARCHAR AS later_error FROM {SAID}, range({len(NODES)}) n(node_ord)""")
_add("f8_classify_single_prompt", f"""SELECT doc_id, CASE WHEN coalesce(top, 0) > {rank('said')} THEN {label_of('top')} ELSE said END AS label,
  said_score AS raw_score, refused AS fallback FROM {SAID}""")
_add("j7_job_run", f"""SELECT task_id, CASE WHEN e = '' THEN 'completed' ELSE 'failed' END AS status,
  CASE WHEN e = '' THEN 1.0 ELSE 0.0 END::DOUBLE AS progress, e AS error,
  CASE WHEN e = '' THEN n END AS n, CASE WHEN e = '' THEN last_label END AS last_label FROM (
  SELECT task_id, CASE WHEN task_id % 10 = 3 THEN 'Provide either document IDs or raw text, not both.'
    WHEN count(*) FILTER (WHERE f.doc_id IS NULL) > 0 THEN 'Unknown documents: ' ||
      string_agg(doc::VARCHAR, ', ' ORDER BY turn) FILTER (WHERE f.doc_id IS NULL) ELSE '' END AS e,
  count(DISTINCT doc) AS n, max(label) AS last_label
  FROM {REQUESTED} q LEFT JOIN f8 f ON f.doc_id = q.doc GROUP BY task_id)""")
_add("h1_appended_feedback", f"""SELECT run, id, classification_id, reviewer, decision, expected_label, strftime(t, '%Y-%m-%dT%H:%M:%S') AS created_at FROM (
  SELECT *, CASE run WHEN 'first' THEN 0 ELSE max(CASE WHEN run = 'first' THEN place ELSE 0 END) OVER () END + place AS id FROM (
  SELECT CASE WHEN f.id % 2 = 0 THEN 'first' ELSE 'second' END AS run,
  row_number() OVER (PARTITION BY f.id % 2 = 0 ORDER BY f.id) AS place, classification_id,
  coalesce(nullif(reviewer, ''), 'Analyst') AS reviewer, coalesce(nullif(decision, ''), 'accept') AS decision,
  CASE WHEN lower({strip('decision')}) IN ('override', 'reclassify') OR coalesce(suggested_label, '') <> ''
    THEN coalesce(nullif(suggested_label, ''), r.classification) END AS expected_label, r.created_at AS t
  FROM feedback f JOIN records r ON r.id = f.classification_id))""")
_add("s10_appended_records", """SELECT run, document_path, n + CASE run WHEN 'first' THEN 0 ELSE count(*) OVER (PARTITION BY run) END AS id,
  classification FROM (SELECT source AS document_path, label AS classification,
  row_number() OVER (ORDER BY doc_id) AS n FROM f8), (VALUES ('first'), ('second')) t(run)""")
_add("s1_read_files", """SELECT doc_id, length(text) + 1 AS text_length, md5(concat(text, chr(10))) AS digest FROM documents
  UNION ALL SELECT NULL, 0, md5('')""")
_add("s11_written_trace", f"""SELECT line, count(*) AS n FROM (SELECT unnest(string_split(concat('[', name, ']', chr(10), prompt, chr(10)), chr(10))) AS line
  FROM documents, {_nodes(NODES)}) GROUP BY line""")
_add("m10_cache_entries", f"SELECT 'alpha' AS model, prompt_hash, 'stored 2' AS reasoning, 0.52::DOUBLE AS score FROM {CACHED}")
_add("p12_image_boxes", """SELECT doc_id, image_idx, CASE WHEN image_idx = 0 THEN 0.0 ELSE 0.02 END::DOUBLE AS x,
  CASE WHEN image_idx = 0 THEN 0.25 ELSE 0.02 END::DOUBLE AS y, CASE WHEN image_idx = 0 THEN 1.0 ELSE 0.96 END::DOUBLE AS width,
  CASE WHEN image_idx = 0 THEN greatest(0.05, (doc_id % 3) / 4) ELSE 0.96 END::DOUBLE AS height FROM images""")
_add("f10_api_results_with_images", f"""SELECT f.doc_id::VARCHAR AS document_id, label,
  CASE WHEN f.doc_id % 5 = 0 THEN 7 ELSE coalesce(i.image_count, 0) END AS image_count,
  coalesce(e.n, 0) AS n_images FROM f8 f LEFT JOIN image_stats i USING (doc_id)
  LEFT JOIN (SELECT doc_id, count(*) FILTER (WHERE type = 'image' AND pos < 10) AS n FROM {SHOWN} GROUP BY doc_id) e USING (doc_id)""")
_add("m10_stored_cache", f"""SELECT 'alpha' AS model, prompt_hash, CASE WHEN toxic THEN 'Unsafe' ELSE 'Public' END AS label,
  CASE WHEN toxic THEN 'stored 2' ELSE 'stored 1' END AS reasoning, CASE WHEN toxic THEN 0.52 ELSE 0.51 END::DOUBLE AS score
  FROM (SELECT prompt_hash, bool_or(toxic = 1) AS toxic FROM {HASHED} JOIN labels USING (doc_id) GROUP BY prompt_hash)""")
_add("m9_stored_lookup", f"""SELECT doc_id, node_ord, CASE WHEN c.prompt_hash IS NOT NULL THEN 0.51 END::DOUBLE AS score,
  CASE WHEN c.prompt_hash IS NULL THEN 'model' ELSE 'cache' END AS backend FROM {HASHED} h LEFT JOIN {CACHED} c USING (prompt_hash)""")
ORACLES["m9_m10_ask_stored"] = ORACLES["m9_m10_ask"]
_add("q1_missing_results", """SELECT id, predicted_label, answered, safety_flags, count(*) OVER () AS total_cases, count(*) FILTER (WHERE NOT answered) OVER () AS missing_results,
  (count(*) FILTER (WHERE right_) OVER () / count(*) OVER ())::DOUBLE AS accuracy,
  coalesce(count(*) FILTER (WHERE critical AND safety_flags <> '') OVER () / nullif(count(*) FILTER (WHERE critical) OVER (), 0), 1)::DOUBLE
    AS critical_detection_rate
  FROM (SELECT case_id AS id, predicted_label, answered, flags AS safety_flags, critical, predicted_label IS NOT DISTINCT FROM expected_label AS right_
    FROM case_rows UNION ALL
    SELECT concat('unknown-', case_id), NULL, false, '', critical, false FROM cases)""")
ORACLES["p9_offset_table"] = ORACLES["p9_offset_page"]
_add("f10_followed_reports", """SELECT f.doc_id, concat('/task/', f.doc_id, '/report.json') AS "name", f.label, c.snippet AS citations_snippet,
  raw_score AS score FROM f8 f JOIN cites c ON c.doc_id = f.doc_id AND c.ord = 1""")
