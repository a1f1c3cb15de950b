"""Quality rules and classifier, language, class model, pieces and packing."""

from __future__ import annotations

import collections
import math
import re
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from llm.conftest import ordered, pairs
from pyspark.sql import functions as F

from tierglass.llm import words as W
from tierglass.llm import class_model, language_id, packing, piece_tokens, quality_classifier, quality_rules
from tierglass.llm.registry import QUERIES
from tierglass.session import work_folder

SF = "/root/testdata/sf0.001"
WORD = r"[^\x20\x09-\x0D]+"


def rest(doc_id, n):
    return -1 if doc_id is None else zlib.crc32(str(doc_id).encode()) % n


def base_signals(text):
    w = re.findall(WORD, text or "")
    triples = collections.Counter(zip(w, w[1:], w[2:]))
    again = {j for i in range(len(w) - 2) if triples[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if re.search(WORD, x)]
    failed = len(w) < 50 or 100 * len(again) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", "".join(w))), len(lines) - len(set(lines)), len(again), failed


SIGNALS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def test_rule_counts_match_brute_force(spark, odd_docs, no_docs):
    for docs in (spark.read.parquet(f"{SF}/documents.parquet"), odd_docs):
        got = quality_rules.signals(docs.select("doc_id", "text")).select("doc_id", *SIGNALS).collect()
        assert ordered(got) == ordered((d, *base_signals(t)) for d, t in pairs(docs))
    assert quality_rules.signals(no_docs).count() == 0


def test_binomial_bound_is_exact(spark):
    rows = [(k, n) for n in (0, 1, 20, 300, 900) for k in (0, 1, 2, 5, 9, 17)]
    df = spark.createDataFrame(rows, "k long, n long")
    got = df.select("k", "n", quality_rules.admissible(F.col("k"), F.col("n"), 0.02, 0.01).alias("ok")).collect()
    p = Fraction(1, 50)
    for k, n, ok in got:
        below = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
        assert ok == (n > 0 and below <= Fraction(1, 100)), (k, n)


def labelled(spark, n=3000):
    """Good texts, and bad ones full of symbols; one stratum has too few labels for any cutoff."""
    rows, labels = [], []
    for i in range(n):
        bad = i % 10 == 0
        words = [f"w{(i * 31 + j * j) % 4001}{'#*' if bad and j % 2 else ''}" for j in range(60)]
        rows.append((i, " ".join(words), "small" if i % 100 < 2 else "big", "s", 1))
        labels.append((i, 0 if bad else 1, 0))
    return (
        spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"),
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int"),
    )


def test_cutoffs_reject_bad_texts_and_keep_good_ones(spark):
    docs, labels = labelled(spark)
    rows = quality_rules.quality_rules(docs, labels).join(labels, "doc_id").collect()
    assert all(r["kept"] for r in rows if r["quality"] == 1)
    assert not any(r["kept"] for r in rows if r["quality"] == 0 and r["lang"] == "big")
    assert all(r["kept"] for r in rows if r["lang"] == "small")  # too few labels prove nothing
    kept = quality_rules.filter_documents(docs, labels)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in rows if r["kept"]}


def test_verdict_rejects_few_good_documents_in_nearly_all_draws(spark):
    """Strata whose good documents are hit by every rule a little: what all rules reject together stays within the risk."""
    rng = np.random.default_rng(11)
    strata, n, good, population, rows = 150, 1600, 0.8, {}, []
    shares = {"symbols": "n_symbols", "marks": "n_marks", "capitals": "n_capitals", "dup_lines": "n_dup_lines"}
    doc = 0
    for s in range(strata):
        rate = rng.uniform(0, 0.02, len(shares))  # of good documents that a rule hits, each on its own
        population[f"s{s}"] = rate
        for _ in range(n):
            is_good = rng.random() < good
            hit = rng.random(len(shares)) < (rate if is_good else 0.5)
            rows.append((doc, f"s{s}", int(is_good), *[1000 if h else 0 for h in hit]))
            doc += 1
    made = spark.createDataFrame(pa.table([pa.array(c) for c in zip(*rows)], ["doc_id", "stratum", "quality", *shares.values()]))
    fixed = {"n_words": 1000, "word_chars": 1000, "n_repeat_words": 0, "n_distinct_words": 1000, "n_lines": 1000}
    measured = made.withColumns({**{k: F.lit(v) for k, v in fixed.items()}, "base_failed": F.lit(False)})
    chosen = quality_rules.calibrate(measured, made.select("doc_id", "quality"), "stratum").collect()
    wrong, used = 0, 0
    for r in chosen:
        on = [k for k, rule in enumerate(shares) if r[f"cut_{rule}"] is not None]
        used += bool(on)
        wrong += 1 - np.prod(1 - population[r["stratum"]][on]) > quality_rules.RISK
    assert len(chosen) == strata and wrong <= 0.05 * strata and used > 5


def test_rules_take_odd_labels_and_empty_tables(spark, odd_docs, no_docs, no_labels):
    odd = spark.createDataFrame([(1, 0), (1, 1), (2, None), (None, 1), (6, 1), (6, 1)], "doc_id long, quality int")
    for labels in (odd, no_labels):
        got = quality_rules.quality_rules(odd_docs, labels).select("doc_id", "kept", "base_failed").collect()
        assert len(got) == odd_docs.count() and all(r["kept"] == (not r["base_failed"]) for r in got)
    assert quality_rules.quality_rules(no_docs, odd).count() == 0


def test_rules_run_without_python(spark):
    plan = quality_rules.signals(spark.read.parquet(f"{SF}/documents.parquet"))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_quality_of_held_out_texts(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality")
    rows = QUERIES["op7_quality_classifier"](spark, sf).join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r["predicted"] == r["quality"] for r in rows]) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)


def test_votes_match_plain_cosines():
    rng = np.random.default_rng(1)
    model = {"vectors": np.eye(6, dtype=np.float32), "labels": np.array([0, 1, 0, 1, 1, 0], np.float32), "share": 0.8}
    width = quality_classifier.WIDTH + 3
    model |= {"idf": np.ones(quality_classifier.WIDTH, np.float32), "basis": rng.normal(size=(width, 6)).astype(np.float32)}
    texts = pa.array(["some text", "other words here", "", None, "a a a a"])
    x = quality_classifier._unit(quality_classifier._weighted(quality_classifier.terms(texts), model["idf"]) @ model["basis"])
    for vector, got in zip(x, quality_classifier.votes(model, texts, 3)):
        near = sorted(range(6), key=lambda i: -vector[i])[:3]
        weight = [max(float(vector[i]), 0) for i in near]
        want = sum(w * model["labels"][i] for w, i in zip(weight, near)) / sum(weight) if sum(weight) > 0 else 0.8
        assert got == pytest.approx(want, abs=1e-5)


def test_votes_weigh_classes_as_the_labels_do(spark):
    """Of many labels of one kind few are sampled; each then stands for more. Ties of cosines go to the earlier vector."""
    rows = [(i, "good words of a text" if i % 10 else "bad words of a text") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "CAST(doc_id % 10 <> 0 AS INT) AS quality")
    model = quality_classifier.fit(docs, labels, per_class=20)
    of = dict(zip(model["labels"].tolist(), model["stands"].tolist()))
    assert of == {0.0: 1.0, 1.0: 9.0} and len(model["labels"]) == 40
    even = {**model, "vectors": np.tile(model["vectors"][:1], (40, 1))}
    text = pa.array(["good words of a text"])
    some = quality_classifier.votes(even, text, 40)[0]
    assert some == pytest.approx(20 * 9 / (20 * 9 + 20 * 1))


def test_latent_space_matches_a_plain_decomposition(spark):
    texts = ["one two three", "two three four", "a b c d", "b c d e", "x!x!x!", "two two two"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "CAST(doc_id % 2 AS INT) AS quality")
    model = quality_classifier.fit(docs, labels, rank=3)
    x = quality_classifier._weighted(quality_classifier.terms(pa.array(texts)), model["idf"]).astype(np.float64)
    _, _, right = np.linalg.svd(x, full_matrices=False)
    plain = x @ right[:3].T
    plain /= np.linalg.norm(plain, axis=1, keepdims=True)
    assert model["vectors"] @ model["vectors"].T == pytest.approx(plain @ plain.T, abs=1e-4)


def test_quality_takes_odd_rows(spark, odd_docs, no_docs, no_labels):
    model = quality_classifier.fit(odd_docs, no_labels)
    got = quality_classifier.score(odd_docs, model)
    assert set(got.columns) == set(odd_docs.columns) and got.where("score = 0.5").count() == odd_docs.count()
    labels = spark.createDataFrame([(1, 1), (6, 0), (8, 0), (2, 1)], "doc_id long, quality int")
    assert quality_classifier.score(odd_docs, quality_classifier.fit(odd_docs, labels)).count() == odd_docs.count()
    assert quality_classifier.score(no_docs, model).count() == 0


def test_language_of_held_out_texts(spark):
    sf = "/root/testdata/sf0.01"
    lang = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    rows = QUERIES["op3_language_id"](spark, sf).join(lang, "doc_id").where("held_out").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.95


def test_language_takes_odd_rows(spark, odd_docs, no_docs):
    model = language_id.fit(odd_docs)
    got = {(r["doc_id"], r["lang_pred"]) for r in language_id.identify(odd_docs, model).collect()}
    assert {(3, "und"), (4, "und"), (5, "und"), (8, "und"), (None, "und")} <= got
    assert all(p in ("en", "de", "fr", "und") for _, p in got)
    assert {r["lang_pred"] for r in language_id.identify(odd_docs, language_id.fit(no_docs)).collect()} == {"und"}


def test_language_scores_match_plain_ridge_regression(spark):
    from tierglass.llm import grams

    texts = {"en": ["the cat sat", "a dog ran off", "the end of it"], "de": ["die katze saß", "ein hund lief"], "fr": ["le chat dort ici"]}
    rows = [(i, t, lang) for i, (t, lang) in enumerate((t, lang) for lang in texts for t in texts[lang])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(docs, per_language=100)
    assert model["languages"] == ["de", "en", "fr"] and len(model["marks"]) == 6
    asked = [t for _, t, _ in rows] + ["the dog", "xyz", "Ünd"]
    sets = [{int(k) for k in np.flatnonzero(r)} for r in grams.presence(pa.array(asked), language_id.SIZES, language_id.WIDTH)]
    kernel = np.array([[len(a & b) / max(1, len(a) * len(b)) ** 0.5 for b in sets[:6]] for a in sets])
    values, vectors = np.linalg.eigh(kernel[:6])
    x = np.hstack([kernel @ vectors / np.sqrt(values), np.ones((len(sets), 1))])
    y = np.array([[lang == m for m in model["languages"]] for _, _, lang in rows], float)
    weight = (y / y.sum(0)).sum(1)
    ridge = language_id.RIDGE * np.eye(7) / 7
    ridge[-1, -1] = 1e-9
    solved = np.linalg.solve((x[:6].T * weight) @ x[:6] + ridge, (x[:6].T * weight) @ y)
    want = x @ solved
    names, score = language_id.classify(model, pa.array(asked))
    assert names == [model["languages"][i] for i in want.argmax(1)]
    assert score == pytest.approx(np.clip(want.max(1), 0, 1), abs=2e-3)


def test_every_language_is_learned(spark):
    rows = [(i, f"{chr(97 + i // 26)}{chr(97 + i % 26)} " * 3, f"l{i:03d}") for i in range(300)]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), per_language=2, landmarks=1)
    assert len(model["languages"]) == 300


def test_kernel_counts_common_grams():
    from tierglass.llm import grams

    a, b = grams.presence(pa.array(["abcab", "bca"]), (1, 2), 1 << 14)
    assert a.sum() == 3 + 3 and b.sum() == 3 + 2 and (a & b).sum() == 3 + 2


def test_class_model_base_matches_brute_force(spark, odd_docs):
    for docs in (spark.read.parquet(f"{SF}/documents.parquet"), odd_docs):
        train = docs.where(F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 != 1, F.lit(True)))
        model, counts = class_model.fit(train)
        got = class_model.score(docs, model, counts).select("doc_id", "n_tokens", "n_known", "train_tokens", "base_score")

        def tokens(text):
            return re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + [None]

        seen = collections.Counter(t for d, text in pairs(docs) if rest(d, 5) != 1 for t in tokens(text))
        n, v = sum(seen.values()), len(seen)
        want = []
        for d, text in pairs(docs):
            t = tokens(text)
            base = sum(math.log10((seen[x] + 0.5) / (n + 0.5 * (v + 1))) for x in t)
            want.append((d, len(t), sum(seen[x] > 0 for x in t), n, base))
        for g, w in zip(ordered(got.collect()), ordered(want)):
            assert g[:4] == w[:4] and g[4] == pytest.approx(w[4], rel=1e-9)


def test_class_model_is_a_distribution_and_beats_single_words(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    train = docs.where("crc32(cast(doc_id as string)) % 5 <> 1")
    model, counts = class_model.fit(train)
    k, n_classes = len(model["unit_words"]), class_model.CLASSES + 1
    rows = counts.toPandas()
    unit = class_model._units(model["unit_words"], rows["h"].to_numpy(), rows["ending"].to_numpy(np.int64))
    of = model["classes"][unit]
    mass = np.bincount(of, rows["n"] + 0.5, n_classes) + 0.5  # and one share for unseen words
    mass[-1] += model["texts"] + 0.5
    assert (10.0 ** model["step"] * mass).sum(1) == pytest.approx(np.ones(n_classes), rel=1e-9)
    held = class_model.score(docs, model, counts).where("crc32(cast(doc_id as string)) % 5 = 1")
    assert held.agg(F.sum("score") > F.sum("base_score")).first()[0] and k == class_model.UNITS


def test_class_model_does_not_depend_on_broadcast_words(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = ordered(QUERIES["op6_class_model"](spark, SF).select("doc_id", "n_known", F.round("score", 6)).collect())
    monkeypatch.setattr(class_model, "HEAD", 700)
    got = ordered(QUERIES["op6_class_model"](spark, SF).select("doc_id", "n_known", F.round("score", 6)).collect())
    assert got == want and len(got) == docs.count()


@pytest.mark.parametrize("head", [1 << 18, 60])
def test_every_repeated_word_has_the_class_of_its_contexts(spark, monkeypatch, head):
    """Words beyond the most frequent ones, alike in their ending, are told apart by what stands around them."""
    monkeypatch.setattr(class_model, "HEAD", head)
    monkeypatch.setattr(class_model, "UNITS", 40)
    rng = np.random.default_rng(4)
    left, right = ([f"{side}{i}" for i in range(10)] for side in ("l", "r"))
    inner = [(f"p{i}zz", f"q{i}zz") for i in range(60)]  # the first ten of each kind are frequent
    lines = []
    for i in range(1500):
        p, q = inner[i % 10 if i % 3 else 10 + i // 3 % 50]
        lines.append(" ".join([left[rng.integers(10)], p, right[rng.integers(10)], q] * 2))
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    model, counts = class_model.fit(docs)
    of = {r["h"]: r["c"] for r in counts.collect()}
    h = {w: class_model.tokens(pa.array([w]))[0][0] for pair in inner for w in pair}
    first, second = ({of[h[pair[k]]] for pair in inner} for k in (0, 1))
    assert not first & second and None not in first | second


def small_corpus(spark, seed, n=200):
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(60)] + [f"rare{i}" for i in range(2000)]
    texts = [" ".join(words[int(i)] for i in np.minimum(rng.zipf(1.3, rng.integers(0, 30)) - 1, len(words) - 1)) for _ in range(n)]
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), texts


def neighbours(texts):
    """(word before, word) of all texts, None for the text end."""
    return [p for t in texts for p in zip([None, *t.split()], [*t.split(), None])]


@pytest.mark.parametrize("head", [1 << 20, 30, 0])
def test_contexts_pairs_and_moves_match_brute_force(spark, monkeypatch, head):
    monkeypatch.setattr(class_model, "HEAD", head)
    docs, texts = small_corpus(spark, 1)
    counts = class_model.word_counts(docs)
    frame = class_model._head(counts)
    hashes = {w: int(class_model.tokens(pa.array([w]))[0][0]) for t in texts for w in t.split()}
    ends = {w: int(class_model.tokens(pa.array([w]))[1][0]) for w in hashes}
    seen = collections.Counter(w for t in texts for w in t.split())
    rng = np.random.default_rng(2)
    endings = rng.integers(0, class_model.CLASSES, class_model.ENDINGS)
    of = {w: int(rng.integers(class_model.CLASSES)) if seen[w] > 1 else int(endings[ends[w]]) for w in hashes} | {None: class_model.END}
    by_hash = {hashes[w]: w for w in hashes}
    own = np.array([of[by_hash[h]] for h in frame.words.tolist()], np.int64)
    classes = spark.createDataFrame([(hashes[w], of[w]) for w in hashes if seen[w] > 1], "h long, c int")
    coded = class_model._coded(docs, frame, work_folder(spark))
    state = class_model._Round(docs, coded, frame, own.astype(np.int8), endings, classes, counts)
    size = class_model.END + 1
    pairs, want = np.zeros((size, size)), collections.defaultdict(collections.Counter)
    for b, a in neighbours(texts):
        pairs[of[b], of[a]] += 1
        for w, k in ((a, of[b]), (b, of[a] + size)):
            if w is not None and seen[w] > 1:
                want[w][k] += 1
    assert (state.pairs() == pairs).all()
    rows = state.contexts().orderBy("h").toArrow().to_batches()
    if not head:
        assert len(frame.words) == 0
    got = collections.defaultdict(collections.Counter)
    for h, c, row, k, n in class_model._summed(iter(rows)):
        assert [of[by_hash[x]] for x in h.tolist()] == c.tolist()
        for r, x, m in zip(row.tolist(), k.tolist(), n.tolist()):
            got[by_hash[int(h[r])]][x] += m
    assert got == want

    def likelihood(table):
        x = lambda v: float(sum(t * math.log(t) for t in np.ravel(v) if t > 0))
        return x(table) - x(table.sum(0)) - x(table.sum(1))

    moved = {}
    for b in class_model._moves(pairs)(iter(rows)):
        moved |= dict(zip(b.column("h").to_pylist(), b.column("c").to_pylist()))
    for w, near in want.items():

        def with_class(c):  # neighbours held: each side's counts go to another column or row
            total = 0.0
            for table, axis in ((pairs[:, :-1], 0), (pairs.T[:, :-1], size)):
                table, margin = table.copy(), table.sum(0)
                here = np.zeros(size)
                for k, n in near.items():
                    if axis <= k < axis + size:
                        here[k - axis] = n
                table[:, of[w]] -= here
                table[:, c] += here
                margin[of[w]] -= here.sum()
                margin[c] += here.sum()
                x = lambda v: float(sum(t * math.log(t) for t in np.ravel(v) if t > 0))
                total += x(table) - x(margin)
            return total

        gains = [with_class(c) for c in range(class_model.CLASSES)]
        assert gains[moved[hashes[w]]] == pytest.approx(max(gains), abs=1e-4)


def test_class_scores_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(class_model, "UNITS", 20)
    docs, texts = small_corpus(spark, 3)
    train = docs.where("doc_id % 3 > 0")
    model, counts = class_model.fit(train)
    known = {r["h"]: (r["n"], r["c"]) for r in counts.collect()}
    size = class_model.END + 1

    def of(word):
        h, ending, _ = class_model.tokens(pa.array([word]))
        n, c = known.get(int(h[0]), (0, None))
        return n, int(model["endings"][ending[0]]) if c is None else c

    pairs, tokens_of, words_of = np.zeros((size, size)), np.zeros(size), np.zeros(size)
    learned = [t for i, t in enumerate(texts) if i % 3]
    for b, a in neighbours(learned):
        pairs[class_model.END if b is None else of(b)[1], class_model.END if a is None else of(a)[1]] += 1
    for word, n in collections.Counter(w for t in learned for w in [*t.split(), None]).items():
        c = class_model.END if word is None else of(word)[1]
        tokens_of[c] += n
        words_of[c] += 1
    share = (pairs.sum(0) + 0.5) / (pairs.sum() + 0.5 * size)
    move = (pairs + class_model.PRIOR * share) / (pairs.sum(1, keepdims=True) + class_model.PRIOR)
    got = {r["doc_id"]: r["score"] for r in class_model.score(docs, model, counts).collect()}
    for i, text in enumerate(texts):
        want = 0.0
        for b, a in neighbours([text]):
            n, c = (len(learned), class_model.END) if a is None else of(a)
            before = class_model.END if b is None else of(b)[1]
            want += math.log10(move[before, c] * (n + 0.5) / (tokens_of[c] + 0.5 * (words_of[c] + 1)))
        assert got[i] == pytest.approx(want, rel=1e-9)


def test_lookup_finds_every_word_and_no_other():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 5000):
        words = np.unique(np.append(rng.integers(-(2**63), 2**63 - 1, n), np.arange(n // 10)))
        found = class_model.Lookup(words)
        assert found.find(words).tolist() == list(range(len(words)))
        assert (found.find(rng.integers(-(2**63), 2**63 - 1, 1000)) == -1).all()


def test_class_model_of_no_texts(spark, odd_docs, no_docs):
    model, counts = class_model.fit(no_docs)
    for r in class_model.score(odd_docs, model, counts).collect():
        assert (r["base_score"], r["n_known"]) == (0, 0)
        assert r["score"] == pytest.approx(-r["n_tokens"] * math.log10(class_model.CLASSES + 1))
    assert class_model.score(no_docs, model, counts).count() == 0


def test_exchange_finds_alternating_classes():
    n, rng = 40, np.random.default_rng(0)
    bigrams = np.zeros((n + 1, n + 1))
    for i in range(n):
        for j in range(n):
            bigrams[i, j] = rng.poisson(20 if i % 2 != j % 2 else 0.01)
    of = class_model.exchange(bigrams, 2)
    assert len({(i % 2, of[i]) for i in range(n)}) == 2 and of[n] == 2


def hf_tokenizer():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.vocabulary_path())
    tokenizer.encode_special_tokens = True
    return tokenizer


def odd_texts():
    import random

    rng = random.Random(1)
    letters = "ab Z1's ll\n\t  \r\x0b\x1c  　é中!?  <|endoftext|>▁ "
    return ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(1500)] + ["", None, " ", "a "]


def test_packing_ids_are_the_tokenizer_s():
    texts, tokenizer = odd_texts(), hf_tokenizer()
    ids, offsets = packing.Encoder(packing.vocabulary_path()).encode(pa.array(texts))
    for text, a, b in zip(texts, offsets, offsets[1:]):
        assert ids[a:b].tolist() == tokenizer.encode(text or "", add_special_tokens=False).ids


def check_packed(rows, docs, capacity=packing.CAPACITY):
    tokenizer, by_doc = hf_tokenizer(), collections.Counter()
    want = collections.Counter()
    for d, text in docs:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        first = (len(ids) - 1) % capacity + 1
        cuts = [0, *range(first, len(ids) + 1, capacity)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[d, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    sequences = collections.defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]] += 1
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert by_doc == want
    for places in sequences.values():
        places.sort()
        assert places[0][0] == 0 and all(a[0] + a[1] == b[0] for a, b in zip(places, places[1:]))
        assert places[-1][0] + places[-1][1] <= capacity
    return len(sequences), -(-sum(r["length"] for r in rows) // capacity)


def test_packing_query_is_whole_and_tight(spark):
    rows = QUERIES["op4_best_fit_packing"](spark, SF).collect()
    used, least = check_packed(rows, pairs(spark.read.parquet(f"{SF}/documents.parquet")))
    assert used <= least + 1


def test_packing_takes_odd_rows_and_shards(spark, odd_docs, no_docs):
    assert check_packed(packing.pack(packing.pieces(odd_docs)).collect(), pairs(odd_docs))[0] > 0
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    used, least = check_packed(packing.pack(packing.pieces(docs), shard_pieces=40).collect(), pairs(docs))
    assert used <= least + 3
    assert packing.pack(packing.pieces(no_docs)).count() == 0


def test_local_search_saves_bins():
    sizes = np.random.default_rng(5).integers(600, 900, 3000)
    start = packing._best_fit(sizes, 2048)
    bins = packing.pack_sizes(sizes)
    assert bins.max() < start.max() and np.bincount(bins, weights=sizes).max() <= 2048
    before = np.square(np.bincount(start, weights=sizes)).sum()
    assert np.square(np.bincount(bins, weights=sizes)).sum() > before


def test_more_effort_never_gives_more_bins():
    for seed in range(4):
        sizes = np.random.default_rng(seed).integers(300, 1500, 400)
        bins = [
            packing.pack_sizes(sizes, effort=e).max()
            for e in (packing.Effort(1, 0, 0), packing.Effort(8, 4, 8), packing.Effort(), packing.Effort(1000, 64, 1000))
        ]
        assert bins == sorted(bins, reverse=True)


def test_pieces_without_dropout_are_the_model_s():
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=piece_tokens.model_path())
    texts = [t for t in odd_texts() if t and piece_tokens.BLANK not in t]
    own = piece_tokens.Pieces(piece_tokens.model_path(), 0.0, 1)
    ids, offsets = own.encode(pa.array(texts), np.zeros(len(texts), np.uint64))
    for text, a, b in zip(texts, offsets, offsets[1:]):
        assert ids[a:b].tolist() == model.encode(text)


def test_dropout_varies_repeats_and_comes_back(spark, odd_docs, no_docs):
    words = spark.createDataFrame([(i, "tokenization of international documents " * 5) for i in range(30)], "doc_id long, text string")
    for docs in (words, odd_docs):
        made = piece_tokens.encode(docs)
        assert ordered(made.collect()) == ordered(piece_tokens.encode(docs.repartition(5)).collect())
        assert ordered(piece_tokens.decode(made).collect()) == ordered((d, t or "") for d, t in pairs(docs))
    plain = {tuple(r["ids"]) for r in piece_tokens.encode(words, rate=0.0).collect()}
    varied = {tuple(r["ids"]) for r in piece_tokens.encode(words).collect()}
    assert len(plain) == 1 and len(varied) > 20
    assert piece_tokens.encode(no_docs).count() == 0


def test_every_occurrence_draws_for_itself():
    """One candidate merge is skipped at the rate, and a long chunk has many more than four segmentations."""
    own = piece_tokens.Pieces(piece_tokens.model_path(), 0.1, 1)
    word = "a"
    for text, least in ((word, 2), ("internationalization", 20)):
        ids, offsets = own.encode(pa.array([text] * 4000), W.mix(np.arange(4000, dtype=np.uint64)))
        made = [tuple(ids[a:b].tolist()) for a, b in zip(offsets, offsets[1:])]
        assert len(set(made)) >= least and all(own.decode(list(m)) == text for m in set(made))
    plain, met = own.chunk_ids((" " + word).encode())
    ids, offsets = own.encode(pa.array([word] * 4000), W.mix(np.arange(4000, dtype=np.uint64)))
    kept = sum(ids[a:b].tolist() == plain for a, b in zip(offsets, offsets[1:])) / 4000
    assert len(met) == 1 and abs(kept - 0.9) < 0.02


def plain_agenda(own, chunk, draw):
    """Ids of one chunk: the best pair that no draw has ruled out is merged, one after the other."""
    mix = lambda x: int(W.mix(np.array([x % 2**64], np.uint64))[0])
    symbols = [(i, c) for i, c in enumerate(chunk.replace(" ", piece_tokens.BLANK))]
    skipped = set()
    while True:
        pairs = [(own.ranks.get(a[1] + b[1]), a[0], k) for k, (a, b) in enumerate(zip(symbols, symbols[1:]))]
        pairs = [p for p in pairs if p[0] is not None and p[:2] not in skipped]
        if not pairs:
            break
        rank, place, k = min(pairs)
        if mix(draw + mix((rank << 32 | place) + 1)) >> 32 < own.threshold:
            skipped.add((rank, place))
        else:
            symbols[k : k + 2] = [(place, symbols[k][1] + symbols[k + 1][1])]
    return [i for _, s in symbols for i in ([own.ids[s]] if s in own.ids else own.bytes[list(s.encode())].tolist())]


@pytest.mark.parametrize("rate", [0.1, 0.9])
def test_dropout_is_a_plain_agenda_that_draws_as_it_pops(rate):
    """Runs of one letter give many candidates of equal score, which go by place."""
    own = piece_tokens.Pieces(piece_tokens.model_path(), rate, 5)
    chunks = ["a" * k for k in range(1, 40)] + ["ab" * 20, "internationalization", "Übergrößenträger", "中文字", "x" * 70, "\x00é!?", "tttttheee"]
    texts = [" ".join(chunks[k:]) for k in range(len(chunks))]
    keys = W.mix(np.arange(len(texts), dtype=np.uint64))
    ids, offsets = own.encode(pa.array(texts), keys)
    for k, text in enumerate(texts):
        want, at = [], 0
        for chunk in text.split(" "):
            draw = int(W.mix(np.array([(int(keys[k]) + at * 0x9E3779B97F4A7C15 + 5) % 2**64], np.uint64))[0])
            want += plain_agenda(own, " " + chunk, draw)
            at += len(chunk.encode()) + 1
        assert ids[offsets[k] : offsets[k + 1]].tolist() == want


def test_pairs_of_symbols_are_found_and_others_are_not():
    own = piece_tokens.Pieces(piece_tokens.model_path(), 0.1, 5)
    symbols = {s: c for c, s in own.pairs.symbols.items()}
    rng = np.random.default_rng(0)
    left, right = (rng.integers(0, own.pairs.size + 50, 20_000, dtype=np.int32) for _ in range(2))
    pieces = [p for p in list(own.ranks)[:4000] if len(p) > 1]
    left = np.append(left, [own.pairs.symbols[p[:1]] for p in pieces]).astype(np.int32)
    right = np.append(right, [own.pairs.symbols.get(p[1:], own.pairs.size) for p in pieces]).astype(np.int32)
    want = [own.ranks.get(symbols[a] + symbols[b], -1) if a in symbols and b in symbols else -1 for a, b in zip(left.tolist(), right.tolist())]
    assert own.pairs.rank(left, right).tolist() == want and max(want) > 0


def test_piece_query_is_lossless(spark):
    rows = QUERIES["op10_piece_tokens"](spark, SF).collect()
    assert all(r["lossless"] for r in rows) and len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
