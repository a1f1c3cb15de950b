"""Named pieces of DuckDB SQL that the checks of the registered queries share."""

from __future__ import annotations

import re

from tierglass import lexicon as X
from tierglass.functions.text import WHITESPACE, WHITESPACE_CLASS
from tierglass.plans import seeds

# RE2 spelling of the published pattern rules; test texts have blanks around seeded tokens.
RE2_PATTERNS = {
    "ssn": r"\b\d{3}-\d{2}-\d{4}\b",
    "passport": r"\b[A-Z]{1,2}\d{6,9}\b",
    "credit_card": r"\b(?:\d{4}[- ]?){3}\d{4}\b",
    "bank_account": r"\b\d{9,12}\b",
    "email": r"(?i)[a-z0-9_.+-]+@[a-z0-9-]+\.[a-z0-9-.]+",
}


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def strip(sql: str) -> str:
    return f"trim({sql}, {text(WHITESPACE)})"


def collapse(sql: str) -> str:
    return f"regexp_replace({sql}, {text(WHITESPACE_CLASS + '+')}, ' ', 'g')"


def snippet(body: str, start: str, end: str, radius: int = X.SNIPPET_RADIUS) -> str:
    left = f"greatest({start} - {radius}, 0)"
    right = f"least({end} + {radius}, length({body}))"
    return collapse(strip(f"substr({body}, ({left} + 1)::BIGINT, ({right} - {left})::BIGINT)"))


def rank(label: str) -> str:
    whens = " ".join(f"WHEN {text(n)} THEN {i}" for i, n in enumerate(X.LABELS))
    return f"(CASE {label} {whens} ELSE 0 END)"


def label_of(severity: str) -> str:
    whens = " ".join(f"WHEN {i} THEN {text(n)}" for i, n in enumerate(X.LABELS))
    return f"(CASE {severity} {whens} END)"


def any_of(column: str, words: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({column}, {text(w)})" for w in words) + ")"


def keyword_case(column: str, values: list[object]) -> str:
    whens = " ".join(
        f"WHEN {any_of(column, r.keywords)} THEN {v}" for r, v in zip(X.KEYWORD_RULES, values)
    )
    return f"CASE {whens} ELSE {values[-1]} END"


def _keyword_rows() -> str:
    rows = []
    ordinal = len(X.PATTERN_RULES)
    for words, label, template, confidence in (
        (X.CONFIDENTIAL_EVIDENCE, X.LABELS[1], X.CONFIDENTIAL_DESCRIPTION, X.CONFIDENTIAL_EVIDENCE_CONFIDENCE),
        (X.UNSAFE_EVIDENCE, X.LABELS[3], X.UNSAFE_DESCRIPTION, X.UNSAFE_EVIDENCE_CONFIDENCE),
    ):
        for word in words:
            rows.append(
                f"({ordinal}, {text(word)}, {text(label)}, {text(template.format(word))}, {confidence}::DOUBLE)"
            )
            ordinal += 1
    return ", ".join(rows)


def _pattern_rows() -> str:
    return ", ".join(
        f"({i}, NULL, {text(r.label)}, {text(r.description)}, {r.confidence}::DOUBLE)"
        for i, r in enumerate(X.PATTERN_RULES)
    )


def _pattern_spots() -> str:
    return " UNION ALL ".join(
        f"SELECT doc_id, st, {i} AS rule_ord, regexp_extract_all(st, {text(p)}) AS m, "
        f"string_split_regex(st, {text(p)}) AS g FROM norm"
        for i, p in ((i, RE2_PATTERNS[r.name]) for i, r in enumerate(X.PATTERN_RULES))
    )


def columns(spec: dict[str, str]) -> str:
    return ", ".join(seeds.select(spec))


def keyword_list(words: tuple[str, ...]) -> str:
    return ", ".join(f"({text(w)})" for w in words)


CTES = {
    "seeded": f"SELECT {columns(seeds.SEEDED_DOCUMENT)} FROM documents "
    f"UNION ALL SELECT {columns(seeds.SEEDED_BLANK)} FROM labels",
    "norm": f"SELECT *, {strip('text')} AS st, lower({strip('text')}) AS lo FROM seeded",
    "page_list": "SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS page FROM "
    "(SELECT doc_id, string_split(text, chr(12)) AS p FROM seeded WHERE text <> '')",
    "page_spans": "SELECT doc_id, page, p_start, p_start + length(p[page]) AS p_end FROM "
    "(SELECT doc_id, page, p, coalesce(list_sum(list_transform(p[1:page - 1], "
    "lambda x: length(x) + 1)), 0)::BIGINT AS p_start FROM page_list)",
    "rules": f"SELECT * FROM (VALUES {_pattern_rows()}, {_keyword_rows()}) "
    "AS t(rule_ord, word, label, description, confidence)",
    "found": f"SELECT doc_id, rule_ord, m, g, unnest(range(1, len(m) + 1)) AS match_ord FROM ({_pattern_spots()})",
    "spots": """SELECT doc_id, rule_ord, match_ord,
      (list_sum(list_transform(g[1:match_ord], lambda x: length(x)))
       + coalesce(list_sum(list_transform(m[1:match_ord - 1], lambda x: length(x))), 0))::BIGINT AS s,
      length(m[match_ord]) AS n FROM found
      UNION ALL
      SELECT doc_id, rule_ord, 1, strpos(lo, word) - 1, length(word)
      FROM norm JOIN rules ON word IS NOT NULL AND contains(lo, word)""",
    "all_signals": f"""SELECT k.doc_id, k.rule_ord, k.match_ord, k.s AS start, k.s + k.n AS stop,
      r.label, r.description, r.confidence, {snippet('d.st', 'k.s', 'k.s + k.n')} AS snippet,
      p.page, row_number() OVER (PARTITION BY k.doc_id ORDER BY k.rule_ord, k.match_ord) - 1 AS signal_ord
      FROM spots k JOIN rules r USING (rule_ord) JOIN norm d ON d.doc_id = k.doc_id
      LEFT JOIN page_spans p ON p.doc_id = k.doc_id AND p.p_start <= k.s AND k.s < p.p_end""",
    "signals": f"SELECT * FROM all_signals WHERE signal_ord < {X.SIGNAL_LIMIT}",
    "strongest": f"SELECT doc_id, max({rank('label')}) AS top, count(*) AS n_signals, "
    "arg_min(description, signal_ord) AS first_signal FROM signals GROUP BY doc_id",
    "keyword": f"""SELECT doc_id, source, text, st, lo,
      {keyword_case('lo', [text(r.label) for r in X.KEYWORD_RULES] + [text(X.DEFAULT_LABEL)])} AS kw_label,
      {keyword_case('lo', [r.score for r in X.KEYWORD_RULES] + [X.DEFAULT_SCORE])}::DOUBLE AS kw_score
      FROM norm""",
    "flag_rows": f"""SELECT doc_id, w AS flag FROM norm JOIN (VALUES {keyword_list(X.DEFAULT_SAFETY_KEYWORDS)}) t(w)
      ON contains(lo, w)
      UNION SELECT doc_id, description FROM signals WHERE label = 'Unsafe'""",
    "flags": "SELECT doc_id, string_agg(flag, '|' ORDER BY flag) AS flags, count(*) AS n_flags "
    "FROM flag_rows GROUP BY doc_id",
    "f8": f"""SELECT k.doc_id, k.source, k.text, k.st, k.kw_label, k.kw_score AS raw_score,
      CASE WHEN coalesce(s.top, 0) > {rank('k.kw_label')} THEN {label_of('s.top')} ELSE k.kw_label END AS label,
      coalesce(s.n_signals, 0) AS n_signals, s.first_signal,
      coalesce(f.flags, '') AS flags, coalesce(f.n_flags, 0) AS n_flags
      FROM keyword k LEFT JOIN strongest s USING (doc_id) LEFT JOIN flags f USING (doc_id)""",
    "cites": """SELECT doc_id, signal_ord + 1 AS ord, page, snippet, confidence, label, description AS signal
      FROM signals UNION ALL
      SELECT doc_id, 1, 1, substr(text, 1, 280), CASE WHEN label = 'Public' THEN 0.6 ELSE 0.8 END::DOUBLE,
      label, 'fallback-snippet' FROM f8 WHERE n_signals = 0""",
    "asked": """SELECT doc_id, lang, CASE WHEN k < 3 THEN 'primary' ELSE 'secondary' END AS role,
      k % 3 AS node_ord FROM documents, range(6) t(k)
      WHERE k < 3 OR lang <> 'de'""",
    "responses": f"""SELECT doc_id, role,
      CASE WHEN role = 'primary' OR lang = 'es' THEN 'alpha' ELSE 'beta' END AS model, node_ord,
      {seeds.RESPONSE_TEXT} AS raw_response, {seeds.RESPONSE_ERROR} AS error FROM asked""",
    "blocks": f"""SELECT *, nullif(regexp_extract(r, '(?s)\\{{.*\\}}'), '') AS block FROM
      (SELECT *, {strip("coalesce(raw_response, '')")} AS r FROM responses)""",
    "fields": """SELECT *, json_type(j, '$.label') AS k1, json_extract_string(j, '$.label') AS v1,
      json_type(j, '$.category') AS k2, json_extract_string(j, '$.category') AS v2,
      json_type(j, '$.risk_level') AS k3, json_extract_string(j, '$.risk_level') AS v3,
      json_type(j, '$.confidence') AS k4, json_extract_string(j, '$.confidence') AS v4,
      json_type(j, '$.score') AS k5, json_extract_string(j, '$.score') AS v5,
      json_type(j, '$.reasoning') AS k6, json_extract_string(j, '$.reasoning') AS v6,
      json_type(j, '$.rationale') AS k7, json_extract_string(j, '$.rationale') AS v7
      FROM (SELECT *, CASE WHEN json_valid(plain) THEN plain::JSON END AS j FROM
      (SELECT *, replace(replace(block, '"label":"Public","label"', '"label"'), ':NaN', ':"NaN"') AS plain FROM blocks))""",
    "chosen": """SELECT *, coalesce(nullif(v1, ''), nullif(v2, ''), nullif(v3, '')) AS jl,
      CASE WHEN coalesce(nullif(v1, ''), '') <> '' THEN k1 WHEN coalesce(v2, '') <> '' THEN k2 ELSE k3 END AS jl_kind,
      CASE WHEN coalesce(try_cast(v4 AS DOUBLE), 0) <> 0 THEN v4 ELSE v5 END AS jc,
      CASE WHEN coalesce(v6, '') NOT IN ('', '[]', '{}') THEN v6 ELSE v7 END AS jr,
      CASE WHEN coalesce(v6, '') NOT IN ('', '[]', '{}') THEN k6 ELSE k7 END AS jr_kind FROM fields""",
    "labelled": """SELECT *, r = '' AS blank,
      CASE WHEN jl IS NOT NULL AND jl_kind <> 'VARCHAR' THEN 'label is a ' || lower(jl_kind)
           WHEN jc IS NOT NULL AND try_cast(jc AS DOUBLE) IS NULL THEN 'confidence is not a number'
           WHEN jr IS NOT NULL AND jr_kind <> 'VARCHAR'
             THEN 'reasoning is a ' || CASE jr_kind WHEN 'ARRAY' THEN 'list' ELSE lower(jr_kind) END
      END AS parse_error,
      CASE WHEN contains(lower(r), 'public') THEN 'Public' WHEN contains(lower(r), 'confidential') THEN 'Confidential'
           WHEN contains(lower(r), 'highly sensitive') THEN 'Highly Sensitive'
           WHEN contains(lower(r), 'unsafe') THEN 'Unsafe' END AS text_label,
      try_cast(nullif(regexp_extract(r, '(?i)confidence\\s*[:=]\\s*(0?\\.\\d+|1\\.0)', 1), '') AS DOUBLE) AS text_score
      FROM chosen""",
    "named": "SELECT *, lower(replace(trim(coalesce(jl, text_label, 'Public')), '_', ' ')) AS low FROM labelled",
    "parsed": """SELECT doc_id, role, model, node_ord, raw_response, error, blank, parse_error,
      CASE WHEN NOT blank AND parse_error IS NULL THEN
        CASE WHEN contains(low, 'unsafe') THEN 'Unsafe'
             WHEN contains(low, 'high') AND contains(low, 'sensitive') THEN 'Highly Sensitive'
             WHEN contains(low, 'confidential') OR contains(low, 'nda') THEN 'Confidential'
             ELSE 'Public' END END AS label,
      CASE WHEN NOT blank AND parse_error IS NULL THEN
        greatest(0, least(1, coalesce(try_cast(jc AS DOUBLE), text_score, 0.6))) END::DOUBLE AS score,
      CASE WHEN NOT blank AND parse_error IS NULL THEN trim(coalesce(jr, r)) END AS reasoning FROM named""",
    "last_answers": """SELECT * FROM parsed
      QUALIFY row_number() OVER (PARTITION BY doc_id, role ORDER BY node_ord DESC) = 1""",
    "completed": f"""SELECT k.doc_id, a.role, a.model,
      a.label IS NULL OR a.error IS NOT NULL AS heuristic,
      a.doc_id IS NULL OR coalesce(a.error, a.parse_error) IS NOT NULL AS fallback,
      CASE WHEN a.doc_id IS NULL THEN 'engine_unavailable' ELSE coalesce(a.error, a.parse_error) END AS reason,
      CASE WHEN a.label IS NULL OR a.error IS NOT NULL THEN k.kw_label ELSE a.label END AS label,
      CASE WHEN a.label IS NULL OR a.error IS NOT NULL THEN k.kw_score ELSE a.score END AS score
      FROM keyword k LEFT JOIN last_answers a ON a.doc_id = k.doc_id""",
    "paired": """SELECT k.doc_id, p.model AS p_model, p.label AS p_label, p.score AS p_score,
      p.fallback AS p_fallback, p.reason AS p_reason,
      s.model AS s_model, coalesce(s.label, p.label) AS s_label, coalesce(s.score, p.score) AS s_score,
      s.doc_id IS NOT NULL AS has_secondary
      FROM keyword k
      JOIN (SELECT * FROM completed WHERE role = 'primary' OR role IS NULL) p ON p.doc_id = k.doc_id
      LEFT JOIN (SELECT * FROM completed WHERE role = 'secondary') s ON s.doc_id = k.doc_id""",
    "fused": f"""SELECT *, p_label = s_label AS agreement,
      CASE WHEN {rank('p_label')} > {rank('s_label')} THEN p_label ELSE s_label END AS fused_label,
      (p_score + s_score) / 2 AS mean_score,
      CASE WHEN p_label = s_label THEN (p_score + s_score) / 2 ELSE least(p_score, s_score) END AS engine_score
      FROM paired""",
    "f9": f"""SELECT u.*, k.source, k.text,
      CASE WHEN coalesce(s.top, 0) > {rank('u.fused_label')} THEN {label_of('s.top')} ELSE u.fused_label END AS label,
      coalesce(s.n_signals, 0) AS n_signals, coalesce(f.flags, '') AS flags
      FROM fused u JOIN keyword k USING (doc_id) LEFT JOIN strongest s USING (doc_id)
      LEFT JOIN flags f USING (doc_id)""",
    "records": f"SELECT doc_id AS id, source AS document_path, label AS classification, raw_score AS score, "
    f"{seeds.RECORD_TIME} AS created_at FROM f8",
    "feedback": f"SELECT {columns(seeds.FEEDBACK)} FROM labels UNION ALL "
    f"SELECT {columns(seeds.ORPHAN_FEEDBACK)} FROM labels WHERE toxic = 1",
    "stats": """SELECT classification AS label, count(*) AS total,
      count(*) FILTER (WHERE lower(decision) IN ('override', 'reclassify')) AS overrides,
      avg(quality_score) AS avg_quality
      FROM feedback f JOIN records r ON r.id = f.classification_id GROUP BY classification""",
    "recal": """SELECT f.*, CASE WHEN s.total IS NULL THEN raw_score ELSE
      greatest(0, least(1, raw_score * (1 - least(0.3, s.overrides / s.total * 0.3))
      + greatest(-0.1, least(0.1, (s.avg_quality - 0.5) * 0.2)))) END::DOUBLE AS score
      FROM f8 f LEFT JOIN stats s ON s.label = f.label""",
    "cases": f"SELECT {columns(seeds.CASES)} FROM labels",
    "outcomes": f"SELECT {columns(seeds.OUTCOMES)} FROM events",
    "case_rows": """SELECT c.*, r.label AS predicted_label, r.raw_score AS score, coalesce(r.flags, '') AS flags,
      coalesce(r.n_flags, 0) AS n_flags, r.doc_id IS NOT NULL AS answered,
      CASE WHEN r.doc_id IS NOT NULL THEN o.latency_ms END AS latency_ms FROM cases c
      LEFT JOIN f8 r ON r.doc_id = c.doc_id
      LEFT JOIN outcomes o ON o.doc_id = c.doc_id""",
    "image_rows": "SELECT doc_id, unnest(range(0, doc_id % 4)) AS image_idx FROM documents",
    "images": """SELECT doc_id, image_idx, CASE WHEN image_idx < 2 THEN image_idx + 1 END AS page,
      concat('png', doc_id, '-', image_idx) AS content FROM image_rows""",
    "image_stats": """SELECT doc_id, count(*) AS image_count,
      string_agg(DISTINCT page::VARCHAR, ',' ORDER BY page::VARCHAR) AS pages, max(page) AS last_page
      FROM images GROUP BY doc_id""",
    "meta": f"""SELECT n.doc_id, n.source, st <> '' AS has_text, length(text) AS text_length,
      CASE WHEN st = '' THEN 0 ELSE len(string_split_regex(st, {text(WHITESPACE_CLASS + '+')})) END AS word_count,
      CASE WHEN text = '' THEN 0 ELSE len(string_split(text, chr(12))) END AS page_count,
      coalesce(i.image_count, 0) AS image_count, coalesce(i.pages, '') AS pages, i.last_page
      FROM norm n LEFT JOIN image_stats i USING (doc_id)""",
}
_NAMES = re.compile(r"\b(" + "|".join(CTES) + r")\b")


def with_parts(sql: str, instead: dict[str, str] | None = None) -> str:
    """The query preceded by the pieces it refers to, in order of definition.

    ``instead`` replaces pieces by others of the same name.
    """
    pieces = {**CTES, **(instead or {})}
    needed: set[str] = set()
    todo = set(_NAMES.findall(sql))
    while todo:
        name = todo.pop()
        needed.add(name)
        todo |= set(_NAMES.findall(pieces[name])) - needed
    parts = ", ".join(f"{n} AS MATERIALIZED ({pieces[n]})" for n in pieces if n in needed)
    return f"WITH {parts} {sql}" if parts else sql
