"""Benchmark decontamination, the prefix trie of conversations and periodic runs against brute force."""

from __future__ import annotations

import random

import numpy as np
import pytest
from compare import connect, difference
from llm.conftest import ordered, pairs
from pyspark.sql import functions as F

from tierglass.llm import decontamination, periodic_runs, prefix_trie
from tierglass.llm import words as W
from tierglass.llm.registry import QUERIES, SQL

SF = "/root/testdata/sf0.001"
ITEMS = "item_id long, text string"


@pytest.mark.parametrize("name", ["op11_benchmark_decontamination", "op12_prefix_trie"])
def test_query_matches_sql(spark, name):
    assert difference(spark, connect(SF), SF, QUERIES[name], SQL[name]) is None


# --- benchmark decontamination


def shared_texts(seed):
    rng = random.Random(seed)
    vocabulary = [f"v{i}" for i in range(40)]
    items = [[rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 2, 4, 5, 9, 10, 11, 30]))] for _ in range(30)]
    items += items[:3]
    docs = []
    for _ in range(120):
        words = []
        for _ in range(rng.randint(0, 4)):
            item = rng.choice(items)
            a = rng.randint(0, max(0, len(item) - 1))
            words += [rng.choice(vocabulary) for _ in range(rng.randint(0, 5))] + item[a : a + rng.randint(5, 30)]
        docs.append(rng.choice([" ", ", ", "\n"]).join(w.upper() if rng.random() < 0.1 else w for w in words))
    items = [(i if i % 9 else None, "-".join(w)) for i, w in enumerate(items)]
    return list(enumerate(docs)), [*items, items[4], (5, None), (6, "?!")]


def digests(df):
    return ordered(
        df.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", F.expr("n_hit > 0")).collect()
    )


@pytest.mark.parametrize("seed", [1, 2])
def test_contamination_matches_brute_force(spark, seed):
    docs, items = shared_texts(seed)
    got = decontamination.contamination(
        spark.createDataFrame(docs, "doc_id long, text string").repartition(5), spark.createDataFrame(items, ITEMS)
    )
    want = decontamination.brute_force(docs, items)
    assert digests(got) == ordered(want) and any(r[5] for r in want) and not all(r[5] for r in want)
    for row in got.collect():
        spans = [(s["first"], s["end"]) for s in row["spans"]]
        assert sum(b - a for a, b in spans) == row["n_hit"] and all(x[1] < y[0] for x, y in zip(spans, spans[1:]))
        assert len(row["items"]) == row["n_items"] and row["items"] == sorted(row["items"])


@pytest.mark.parametrize("gram", [1, 7, 10])
def test_contamination_is_the_same_with_a_full_filter_and_other_grams(spark, monkeypatch, gram):
    monkeypatch.setattr(decontamination, "MAX_BITS", 1 << 6)
    docs, items = shared_texts(3)
    found = decontamination.contamination(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, ITEMS), gram=gram
    )
    assert digests(found) == ordered(decontamination.brute_force(docs, items))


def test_contamination_of_odd_rows(spark, odd_docs, no_docs):
    items = [(1, " ".join(f"s{i}" for i in range(12, 30))), (2, "TAIL"), (None, "gamma"), (3, None), (4, "中文")]
    items = spark.createDataFrame([(*r, 1, "x") for r in items], f"{ITEMS}, h long, doc_id string")
    want = decontamination.brute_force(pairs(odd_docs), [(r["item_id"], r["text"]) for r in items.collect()])
    assert digests(decontamination.contamination(odd_docs, items)) == ordered(want)
    none = digests(decontamination.contamination(odd_docs, items.where("false")))
    assert len(none) == odd_docs.count() and not any(r[2] for r in none)
    assert decontamination.contamination(no_docs, items).count() == 0


def test_every_shared_window_shares_a_fingerprint():
    h = W.mix(np.arange(1, 500, dtype=np.uint64))
    whole, part = decontamination._least_grams(h, 10, 5), decontamination._least_grams(h[100:110], 10, 5)
    assert part.tolist() == whole[100:101].tolist()


# --- prefix trie


def talks(seed, n=150):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(n * 2), n):
        for turn in range(rng.choice([0, 1, 2, 3, 5, 12])):
            text = "hello there all" if turn == 0 and rng.random() < 0.5 else rng.choice(["a b", "c", "", None, "d e f"])
            rows.append((c, turn if rng.random() < 0.95 else -1, rng.choice(["user", None]), text))
    copies = [(c, t, r, x) for c in range(5000, 5040) for _, t, r, x in [y for y in rows if y[0] == rows[0][0]]]
    rows = {(c, t): (c, t, r, x) for c, t, r, x in rows + copies}
    return list(rows.values())


def trie(df):
    columns = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()
    return ordered(df.select(*columns).collect())


@pytest.mark.parametrize("turns", [4, 40, 1 << 16])
def test_trie_is_the_same_in_any_number_of_ranges(spark, turns):
    rows = talks(7)
    table = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    rebuilt = prefix_trie.with_shared_heads(prefix_trie.paths(table))
    assert trie(prefix_trie.prefix_trie(rebuilt, turns=turns)) == ordered(prefix_trie.brute_force(rows))


def test_trie_of_odd_rows(spark):
    long = [(40, t, "user", f"turn {t}") for t in range(300)] + [(41, t, "user", f"turn {t}") for t in range(299)]
    rows = [
        *long,
        (20, None, "user", "opens"),
        (20, 0, None, None),
        (33, 5, "user", "a\tb  c"),
        (34, 5, "user", "a\tb  c"),
        (None, 0, "user", "nobody's"),
        (7, 0, "", ""),
        (8, 0, None, None),
    ]
    schema = "conv_id long, turn int, role string, text string, path string, depth long, a long, block string"
    table = spark.createDataFrame([(*r, "x", 1, 2, "y") for r in rows], schema)
    for turns in (8, 1 << 16):
        rebuilt = prefix_trie.with_shared_heads(prefix_trie.paths(table))
        assert trie(prefix_trie.prefix_trie(rebuilt, turns=turns)) == ordered(prefix_trie.brute_force(rows))
    empty = prefix_trie.prefix_trie(prefix_trie.with_shared_heads(prefix_trie.paths(table.where("false"))))
    assert empty.count() == 0


def test_ids_of_one_end_are_read_in_order_over_many_blocks(spark):
    rows = [(c, 0, "user", "same") for c in range(1, 30_000, 7) if c % 20]
    table = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    assert trie(prefix_trie.prefix_trie(prefix_trie.paths(table))) == ordered(prefix_trie.brute_force(rows, heads=1))


# --- periodic runs


def periodic_words(rng):
    out = []
    for _ in range(rng.randint(0, 5)):
        if rng.random() < 0.3:
            out += [rng.choice("abcdefgh"[: rng.randint(1, 8)]) for _ in range(rng.randint(0, 80))]
        else:
            q = rng.choice([1, 2, 3, 5, 7, 8, 9, 15, 16, 17, 31, 32, 33, 50, 64, 70])
            base = [rng.choice("ab" if rng.random() < 0.5 else "abcdefghij") for _ in range(q)]
            n = rng.randint(q, 5 * q + 30)
            out += (base * (n // q + 1))[:n]
    return out


@pytest.mark.parametrize("seed", range(4))
def test_runs_match_brute_force(seed):
    rng = random.Random(seed)
    for _ in range(60):
        texts = [periodic_words(rng) for _ in range(rng.randint(1, 6))]
        offsets = np.cumsum([0, *map(len, texts)])
        h = W.mix(np.array([ord(w) for t in texts for w in t], np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        got = [[] for _ in texts]
        for a, b, q in zip(*(x.tolist() for x in periodic_runs.find_runs(h, offsets))):
            t = int(np.searchsorted(offsets, a, "right")) - 1
            got[t].append((a - offsets[t], b - a, q))
        assert got == [periodic_runs.brute_force_runs(t) for t in texts]


def test_runs_query_matches_brute_force(spark):
    got = QUERIES["op13_periodic_runs"](spark, SF).collect()
    rows = [r for r in pairs(spark.read.parquet(f"{SF}/documents.parquet"))]
    assert ordered(got) == ordered(periodic_runs.brute_force(rows))


def test_runs_of_odd_rows(spark, odd_docs, no_docs):
    flat = spark.createDataFrame([(50, "x " * 100_000), (51, "x y " * 12), (52, "x " * 23)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in periodic_runs.periodic_runs(flat).collect()}
    assert [tuple(r) for r in got[50]["runs"]] == [(0, 100_000, 1)] and got[50]["collapsed_text"] == "x"
    assert [tuple(r) for r in got[51]["runs"]] == [(0, 24, 2)] and got[51]["collapsed_text"] == "x y"
    assert got[52]["runs"] == [] and got[52]["strongest"] is None and got[52]["n_words"] == 23
    found = periodic_runs.periodic_runs(odd_docs).collect()
    assert len(found) == odd_docs.count() and not any(r["runs"] for r in found if r["doc_id"] in (3, 4, 5, None))
    assert periodic_runs.periodic_runs(no_docs).count() == 0


def test_strongest_run_breaks_ties_by_start_and_is_exact(spark):
    text = " ".join(["a"] * 24 + ["z"] + ["b"] * 24 + ["z"] + ["c", "d"] * 24)
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    row = periodic_runs.periodic_runs(docs).first()
    assert [r["period"] for r in row["runs"]] == [1, 1, 2] and tuple(row["strongest"]) == (0, 24, 1)
