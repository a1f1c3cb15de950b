"""Quality rules with risk-controlled cutoffs, in Spark's own functions only.

Base rules are fixed. Further rules compare a share of the text with a cutoff that labelled documents
justify. The labelled documents of a stratum are halved by a hash of their id. On one half each rule gets
the laxest cutoff that has ``MOST_PERCENT`` of the largest gain, the bad documents rejected net of
``penalty`` times the good ones, and rules that gain are put in order of their gain. On the other half, held out from that choice, the
first rule, the first two, and so on are tested as they would be used, together: k of the n good
documents would be rejected by any of them, and they are admissible if the exact binomial
(Clopper-Pearson) upper bound of that rate is at most ``risk``. The bound is at most ``risk`` just where
P(Binomial(n, risk) <= k) is at most the error level. Testing stops at the first failure (fixed
sequence), so no level is lost on the number of rules; ``delta`` is split over the strata (Bonferroni).
With 1 - ``delta``, what the verdict rejects beyond the base rules is at most ``risk`` of the good
documents in every stratum at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierglass.functions.membership import filter_of, probable
from tierglass.functions.once import with_once
from tierglass.llm.common import cut, table

RISK = 0.02
DELTA = 0.05
PENALTY = 50
MOST_PERCENT = 90
CUTOFFS = (0.95, 0.8, 0.65, 0.5, 0.4, 0.3, 0.2, 0.15, 0.1, 0.05)
MIN_WORDS = 50
REPEAT_PERCENT = 50
BROADCAST_STRATA = 1000
_SPACE = r"[ \\t\\n\\x0B\\f\\r]+"

#: Shares of a text, each in 0 to 1 and null where there is nothing to measure.
RULES = {
    "symbols": "least(n_symbols / n_words, 1.0)",
    "marks": "least(n_marks / n_words, 1.0)",
    "capitals": "n_capitals / word_chars",
    "repeats": "n_repeat_words / n_words",
    "one_word": "1 - n_distinct_words / n_words",
    "dup_lines": "n_dup_lines / n_lines",
}


def signals(docs: DataFrame) -> DataFrame:
    """All columns of ``docs`` but ``text``, plus counts of every whole text.

    A null text has no words. Repeated triples are found by sorting 33-bit hashes with their places
    and comparing the words only of places whose hash occurs twice, so the counts are exact and a very
    long text costs n log n.
    """
    taken = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_marks", "n_capitals"]
    taken += ["n_distinct_words", "n_lines", "base_failed", "_words", "_joined", "_keys", "_same"]
    docs = docs.select(*[c for c in docs.columns if c.lower() not in taken])
    words = F.expr(f"array_remove(split(coalesce(text, ''), '{_SPACE}'), '')")
    lines = F.expr(f"filter(split(coalesce(text, ''), '\\n'), l -> length(regexp_replace(l, '{_SPACE}', '')) > 0)")
    df = with_once(docs, {"_words": words, "_lines": lines})
    df = with_once(
        df,
        {
            "_joined": F.array_join("_words", ""),
            "_keys": F.expr(
                "CASE WHEN size(_words) > 3 THEN sort_array(transform(sequence(0, size(_words) - 3), i ->"
                " (xxhash64(_words[i], _words[i + 1], _words[i + 2]) & -2147483648L) | i)) ELSE array() END"
            ),
        },
    )
    df = with_once(
        df,
        {
            "_same": F.expr(
                "sort_array(transform(filter(_keys, (x, i) ->"
                " shiftright(get(_keys, i - 1), 31) <=> shiftright(x, 31)"
                " OR shiftright(get(_keys, i + 1), 31) <=> shiftright(x, 31)),"
                " x -> struct(concat_ws(' ', _words[int(x & 2147483647L)], _words[int(x & 2147483647L) + 1],"
                " _words[int(x & 2147483647L) + 2]) AS w, x & 2147483647L AS i)))"
            )
        },
    )
    counted = {
        "n_words": F.size("_words").cast("long"),
        "word_chars": F.length("_joined").cast("long"),
        "n_symbols": (F.length("_joined") - F.length(F.regexp_replace("_joined", "[#*$%&|<>]", ""))).cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_repeat_words": F.expr(
            "CAST(size(array_distinct(flatten(transform(filter(_same, (x, i) ->"
            " get(_same, i - 1).w <=> x.w OR get(_same, i + 1).w <=> x.w), x -> array(x.i, x.i + 1, x.i + 2))))) AS LONG)"
        ),
        "n_marks": (F.length("_joined") - F.length(F.regexp_replace("_joined", "!", ""))).cast("long"),
        "n_capitals": (F.length("_joined") - F.length(F.regexp_replace("_joined", r"\p{Lu}", ""))).cast("long"),
        "n_distinct_words": F.size(F.array_distinct("_words")).cast("long"),
        "n_lines": F.size("_lines").cast("long"),
    }
    kept = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    df = with_once(df, counted).select(*kept, *counted)
    return df.withColumn(
        "base_failed",
        (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words")),
    )


def share(rule: str) -> Column:
    return F.coalesce(F.expr(f"CASE WHEN n_words > 0 THEN {RULES[rule]} END"), F.lit(0.0))


def admissible(k: Column, n: Column, risk: float, level: float) -> Column:
    """Whether P(Binomial(n, risk) <= k) is at most ``level``; terms are summed from logarithms.

    Where k reaches the mean the probability is about a half or more, so nothing is summed.
    """
    odds = risk / (1 - risk)
    terms = F.aggregate(
        F.sequence(F.lit(1).cast("long"), F.greatest(k, F.lit(1).cast("long"))),
        F.struct(
            (n * F.log1p(F.lit(-risk))).alias("term"), F.exp(n * F.log1p(F.lit(-risk))).alias("sum")
        ),
        lambda state, i: F.struct(
            (state["term"] + F.log((n - i + 1) / i * odds)).alias("term"),
            (state["sum"] + F.when(i <= k, F.exp(state["term"] + F.log((n - i + 1) / i * odds))).otherwise(0.0)).alias("sum"),
        ),
    )
    return F.when((n > 0) & (k < n * risk), terms["sum"] <= level).otherwise(False)


def _tuning(key: Column) -> Column:
    """Half of the documents, by a hash that other engines have."""
    return F.substring(F.md5(key.cast("string")), 1, 1) < "8"


def calibrate(
    measured: DataFrame, labels: DataFrame, stratum: str, risk: float = RISK, delta: float = DELTA, penalty: int = PENALTY
) -> DataFrame:
    """Chosen cutoffs: one row per stratum with a column ``cut_<rule>`` each, null where none is used.

    ``measured`` comes from ``signals``. Documents that fail the base rules, that have labels of both
    kinds, a null label or a null id do not count. A null stratum is a stratum of its own.
    """
    agreed = (
        labels.where("doc_id is not null and quality in (0, 1)")
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"), F.max("quality").alias("other"))
        .where("quality = other")
        .select("doc_id", "quality")
    )
    shares = [share(r).alias(f"share_{r}") for r in RULES]
    known = measured.where("not base_failed").select("doc_id", F.col(stratum).alias("stratum"), *shares).join(agreed, "doc_id")
    known = known.withColumn("tuning", _tuning(F.col("doc_id")))
    counts = []
    for r in RULES:
        for j, c in enumerate(CUTOFFS):
            for q, side in ((1, "good"), (0, "bad")):
                counts.append(F.count_if(F.col("tuning") & (F.col("quality") == q) & (F.col(f"share_{r}") > c)).alias(f"{r}_{j}_{side}"))

    def best(number: int, rule: str) -> Column:
        """The laxest cutoff that has most of the largest gain; null where none gains."""
        tried = F.array(
            *[
                F.struct(
                    (F.col(f"{rule}_{j}_bad") - penalty * F.col(f"{rule}_{j}_good")).alias("gain"),
                    F.lit(-number).alias("first"),
                    F.lit(rule).alias("rule"),
                    F.lit(float(c)).alias("cutoff"),
                )
                for j, c in enumerate(CUTOFFS)
            ]
        )
        most = F.array_max(F.transform(tried, lambda t: t["gain"]))
        return F.get(F.filter(tried, lambda t: (t["gain"] > 0) & (100 * t["gain"] >= MOST_PERCENT * most)), 0)

    # Best gain first; the rules' own order decides between equals.
    by_gain = F.reverse(F.array_sort(F.array_compact(F.array(*[best(k, r) for k, r in enumerate(RULES)]))))
    # A row per stratum, also where there is nothing to tune by.
    tuned = known.groupBy("stratum").agg(*counts).select("stratum", by_gain.alias("ordered"))
    tuned = tuned.select(
        F.col("stratum").alias("_stratum"),
        *[F.expr(f"get(filter(ordered, t -> t.rule = '{r}'), 0).cutoff").alias(f"cut_{r}") for r in RULES],
        *[F.expr(f"array_position(transform(ordered, t -> t.rule), '{r}')").alias(f"place_{r}") for r in RULES],
    )
    tuned = cut(tuned)
    strata = tuned.count()
    side = F.broadcast(tuned) if strata <= BROADCAST_STRATA else tuned
    held = known.where("not tuning and quality = 1").join(side, F.col("stratum").eqNullSafe(F.col("_stratum")))
    first = F.least(
        F.lit(len(RULES) + 1),
        *[F.when(F.col(f"share_{r}") > F.col(f"cut_{r}"), F.col(f"place_{r}")).cast("int") for r in RULES],
    )
    rejected = [F.count_if(F.col("first") <= m).alias(f"k_{m}") for m in range(1, len(RULES) + 1)]
    tested = (
        held.withColumn("first", first).groupBy(F.col("_stratum").alias("_held")).agg(F.count("*").alias("n"), *rejected)
    )
    level = delta / max(1, strata)
    stop = F.least(
        F.lit(len(RULES) + 1),
        *[F.when(~admissible(F.col(f"k_{m}"), F.col("n"), risk, level), F.lit(m)) for m in range(1, len(RULES) + 1)],
    )
    # Without held-out good documents nothing is proven.
    proven = tested.select("_held", stop.alias("stop"))
    return tuned.join(proven, F.col("_stratum").eqNullSafe(F.col("_held")), "left").select(
        F.col("_stratum").alias("stratum"),
        *[F.when(F.col(f"place_{r}") < F.col("stop"), F.col(f"cut_{r}")).alias(f"cut_{r}") for r in RULES],
    )


def judge(measured: DataFrame, cutoffs: DataFrame, stratum: str) -> DataFrame:
    """Adds rejected_by (rules that fire) and kept to rows of ``signals``.

    A stratum without cutoffs rejects by the base rules alone. The cutoff table has a row per stratum;
    it is broadcast only after its size is checked.
    """
    cutoffs = cutoffs.withColumnRenamed("stratum", "_stratum")
    if cutoffs.count() <= BROADCAST_STRATA:
        cutoffs = F.broadcast(cutoffs)
    fired = F.array_compact(F.array(*[F.when(share(r) > F.col(f"cut_{r}"), F.lit(r)) for r in RULES]))
    joined = measured.join(cutoffs, F.col(stratum).eqNullSafe(F.col("_stratum")), "left").withColumn("rejected_by", fired)
    return joined.withColumn("kept", ~F.col("base_failed") & (F.size("rejected_by") == 0)).drop(
        "_stratum", *[f"cut_{r}" for r in RULES]
    )


def quality_rules(docs: DataFrame, labels: DataFrame, stratum: str = "lang") -> DataFrame:
    """Signals and verdict of every row of ``docs`` (doc_id, text, the stratum column).

    Columns beside these are not handed on. Repeated rows get a row each.
    """
    measured = cut(signals(docs.select("doc_id", "text", stratum)))
    return judge(measured, cut(calibrate(measured, labels, stratum)), stratum)


def filter_documents(docs: DataFrame, labels: DataFrame, stratum: str = "lang") -> DataFrame:
    """Rows of ``docs`` that pass, with their own columns.

    Texts are not shuffled. To calibrate, only documents are measured that a Bloom filter of the labelled
    ids holds, which has at most 2^20 cells.
    """
    narrow = docs.select("doc_id", "text", stratum)
    measured = cut(signals(probable(narrow, filter_of(labels.select("doc_id"), ["doc_id"]), ["doc_id"])))
    cutoffs = cut(calibrate(measured, labels, stratum))
    whole = docs.select(F.struct("*").alias("_row"), "doc_id", "text", stratum)
    return judge(signals(whole), cutoffs, stratum).where("kept").select("_row.*")


def op1_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document."""
    out = quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "n_marks", "n_capitals", "n_distinct_words", "n_lines",
    )


WORD = r"[^\x20\x09-\x0D]+"
_SHARES = ", ".join(f"coalesce(CASE WHEN n_words > 0 THEN {RULES[r]} END, 0)::DOUBLE AS share_{r}" for r in RULES)
_LONG = " UNION ALL ".join(f"SELECT rid, doc_id, lang, base_failed, '{r}' AS rule, share_{r} AS share FROM measured" for r in RULES)
_CUTOFFS = ", ".join(f"({j}, {c}::DOUBLE)" for j, c in enumerate(CUTOFFS))
#: The same in DuckDB, the binomial sum from log factorials.
SQL = f"""
WITH texts AS (
  SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
triples AS (
  SELECT rid, i, concat_ws(' ', w[i], w[i + 1], w[i + 2]) AS s
  FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM texts)),
again AS (
  SELECT rid, count(DISTINCT i + k) AS n_repeat_words
  FROM (SELECT rid, i FROM triples QUALIFY count(*) OVER (PARTITION BY rid, s) > 1), range(3) r(k) GROUP BY rid),
counted AS (
  SELECT rid, doc_id, lang, len(w)::BIGINT AS n_words, length(j)::BIGINT AS word_chars,
    (length(j) - length(regexp_replace(j, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
    (length(j) - length(replace(j, '!', '')))::BIGINT AS n_marks,
    (length(j) - length(regexp_replace(j, '\\p{{Lu}}', '', 'g')))::BIGINT AS n_capitals,
    len(list_distinct(w))::BIGINT AS n_distinct_words, len(l)::BIGINT AS n_lines
  FROM (SELECT *, array_to_string(w, '') AS j,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS l FROM texts)
  LEFT JOIN again USING (rid)),
measured AS (
  SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words AS base_failed, {_SHARES} FROM counted),
long AS ({_LONG}),
agreed AS (
  SELECT doc_id, min(quality) AS quality FROM labels WHERE doc_id IS NOT NULL AND quality IN (0, 1)
  GROUP BY doc_id HAVING min(quality) = max(quality)),
known AS (
  SELECT l.*, quality, substr(md5(doc_id::VARCHAR), 1, 1) < '8' AS tuning FROM long l JOIN agreed USING (doc_id) WHERE NOT base_failed),
tuned AS (
  SELECT lang, rule, cutoff, ord, count(*) FILTER (WHERE quality = 0 AND share > cutoff)
    - {PENALTY} * count(*) FILTER (WHERE quality = 1 AND share > cutoff) AS gain
  FROM known, (VALUES {_CUTOFFS}) c(ord, cutoff) WHERE tuning GROUP BY ALL),
best AS (
  SELECT * FROM (SELECT *, max(gain) OVER (PARTITION BY lang, rule) AS most FROM tuned)
  WHERE gain > 0 AND 100 * gain >= {MOST_PERCENT} * most QUALIFY row_number() OVER (PARTITION BY lang, rule ORDER BY ord) = 1),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY gain DESC, list_position({list(RULES)}, rule)) AS place FROM best),
firsts AS (
  SELECT k.lang, k.rid, min(CASE WHEN share > cutoff THEN place END) AS first
  FROM known k LEFT JOIN placed p ON p.rule = k.rule AND p.lang IS NOT DISTINCT FROM k.lang
  WHERE NOT tuning AND quality = 1 GROUP BY ALL),
tested AS (
  SELECT lang, m, count(*) AS n, count(*) FILTER (WHERE first <= m) AS k FROM firsts, range(1, {len(RULES) + 1}) t(m) GROUP BY ALL),
bounded AS (
  SELECT *, CASE WHEN n > 0 AND k < n * {RISK} THEN list_sum(list_transform(range(k + 1), lambda i:
      exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({RISK}) + (n - i) * ln(1 - {RISK}))))
    <= {DELTA} / (SELECT count(*) FROM (SELECT DISTINCT lang FROM known)) ELSE false END AS ok FROM tested),
proven AS (
  SELECT lang, coalesce(min(CASE WHEN NOT ok THEN m END), {len(RULES) + 1}) AS stop FROM bounded GROUP BY lang),
chosen AS (
  SELECT p.lang, rule, cutoff FROM placed p JOIN proven q ON q.lang IS NOT DISTINCT FROM p.lang WHERE place < stop),
fired AS (
  SELECT DISTINCT rid FROM long l JOIN chosen c ON l.rule = c.rule AND l.lang IS NOT DISTINCT FROM c.lang AND share > cutoff)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND f.rid IS NULL AS kept, n_marks, n_capitals, n_distinct_words, n_lines
FROM measured LEFT JOIN fired f USING (rid)
"""
