"""Substring dedup and SimHash near-dedup against brute force."""

from __future__ import annotations

import random

import numpy as np
import pytest
from llm.conftest import ordered, pairs

from tierglass.llm import simhash, substring_dedup
from tierglass.llm.components import components
from tierglass.llm.registry import QUERIES

SF = "/root/testdata/sf0.001"


def mixed(spark, seed=3, n=60):
    """Texts that share passages of many lengths, some with repeats inside."""
    rng = random.Random(seed)
    passages = [[f"p{k}x{i}" for i in range(rng.randint(5, 60))] for k in range(8)]
    rows = []
    for i in range(n):
        words = []
        for _ in range(rng.randint(0, 4)):
            words += rng.choice(passages)[: rng.randint(1, 60)] + [f"u{rng.randint(0, 500)}"]
        rows.append((i, " \n".join(words)))
    return spark.createDataFrame(rows, "doc_id long, text string")


def digests(df):
    from pyspark.sql import functions as F

    return ordered(df.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256)).collect())


def test_substring_query_matches_brute_force(spark):
    got = QUERIES["op5_substring_dedup"](spark, SF).collect()
    assert ordered(got) == ordered(substring_dedup.brute_force(pairs(spark.read.parquet(f"{SF}/documents.parquet"))))


def test_substring_mixed_and_odd_rows(spark, odd_docs):
    for docs in (mixed(spark), odd_docs):
        assert digests(substring_dedup.remove_repeats(docs)) == ordered(substring_dedup.brute_force(pairs(docs)))


def test_substring_intervals_are_maximal(spark):
    for row in substring_dedup.remove_repeats(mixed(spark)).collect():
        spans = [(s["first"], s["end"]) for s in row["removed"]]
        assert sum(b - a for a, b in spans) == row["n_removed"]
        assert all(a[1] < b[0] for a, b in zip(spans, spans[1:])) and all(b - a >= 13 for a, b in spans)


def test_substring_hot_passage_is_spread_and_rows_without_id_stay_out(spark):
    from pyspark.sql import functions as F

    hot = " ".join(f"hot{i}" for i in range(30))
    text = F.concat(F.when(F.col("id") % 3 == 0, hot + " ").otherwise(""), F.lit("own"), F.col("id").cast("string"))
    docs = spark.range(3000, numPartitions=4).select(
        F.when(F.col("id") % 50 != 0, F.pmod(F.col("id") * 7919, F.lit(3001))).alias("doc_id"), text.alias("text")
    )
    assert digests(substring_dedup.remove_repeats(docs)) == ordered(substring_dedup.brute_force(pairs(docs)))


@pytest.mark.parametrize("smaller", [False, True])
@pytest.mark.parametrize("limit", [0, 1, 1000])
def test_decided_rows_do_not_change_the_answer(smaller, limit):
    import pyarrow as pa

    rng = np.random.default_rng(limit)
    decided, sent, asked = substring_dedup._Decided(smaller, limit), [], set()
    for _ in range(30):
        docs = rng.integers(-50, 50, 40)
        text, values = rng.integers(0, 40, 200), rng.integers(1, 30, 200) ** 2 * 2
        asked |= {(int(v), int(docs[t])) for v, t in zip(values, text)}
        rows = decided.rows(pa.array(docs), text, values)
        sent += zip(rows.column("h").to_pylist(), rows.column("doc_id").to_pylist())
    salts = {d: int(substring_dedup._salts(np.array([d]))[0]) for _, d in sent}
    counted = [(h, d) for h, d in sent if h % 2 == 0]
    of = {h: [d for g, d in counted if g == h] for h, _ in counted}
    found = {((h ^ salts[d]) & -2, d) for h, d in sent if h % 2}
    found |= {(h, d) for h, d in counted if (min(of[h]) < d if smaller else len(set(of[h])) > 1)}
    all_of = {h: {d for g, d in asked if g == h} for h, _ in asked}
    assert found == {(h, d) for h, d in asked if (min(all_of[h]) < d if smaller else len(all_of[h]) > 1)}
    if limit == 1000:
        assert max(map(len, of.values())) <= (30 if smaller else 4)


def test_substring_carries_columns_and_takes_empty_tables(spark, odd_docs, no_docs):
    carried = substring_dedup.remove_repeats(odd_docs, carry=("text", "lang", "source"))
    assert carried.columns[:4] == ["doc_id", "text", "lang", "source"] and carried.count() == odd_docs.count()
    assert substring_dedup.remove_repeats(no_docs).count() == 0


def test_substring_shares_its_exchanges(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = substring_dedup.remove_repeats(spark.read.parquet(f"{SF}/documents.parquet"))
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString().split("+- == Initial Plan ==")[0]
        assert plan.count("FileScan parquet") - plan.count("ReusedExchange") <= 2
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_simhash_query_matches_brute_force(spark):
    got = QUERIES["op8_simhash_near_dedup"](spark, SF).collect()
    assert ordered(got) == ordered(simhash.brute_force(pairs(spark.read.parquet(f"{SF}/documents.parquet"))))


@pytest.mark.parametrize("bucket", [1, 3, 128])
def test_simhash_odd_rows_and_small_buckets(spark, odd_docs, bucket):
    got = simhash.near_duplicates(odd_docs, bucket=bucket).collect()
    assert ordered(got) == ordered(simhash.brute_force(pairs(odd_docs)))


def test_simhash_takes_an_empty_table(spark, no_docs):
    assert simhash.near_duplicates(no_docs).count() == 0


def clustered(seed, n):
    rng = random.Random(seed)
    centres = [rng.getrandbits(64) for _ in range(12)]
    out = set()
    while len(out) < n:
        x = rng.choice(centres)
        for _ in range(rng.randint(0, 5)):
            x ^= 1 << rng.randrange(64)
        out.add(x)
    return sorted(out)


@pytest.mark.parametrize("parts", [None, [(list(range(64)), 2)], [(list(range(40)), 1), (list(range(40, 64)), 0)]])
@pytest.mark.parametrize("bucket", [2, 128])
def test_links_join_the_components_of_all_pairs(spark, parts, bucket):
    fps = clustered(5, 300)
    signed = np.array(fps, np.uint64).view(np.int64)
    parts = parts or simhash.plan(signed, len(fps))
    edges = simhash.links(spark.createDataFrame([(int(x),) for x in signed], "fp long"), parts, bucket=bucket)
    assert all((a ^ b).bit_count() <= 4 for a, b in ((r["a"] % 2**64, r["b"] % 2**64) for r in edges.collect()))
    got = {r["node"]: r["root"] for r in components(edges).collect()}
    want = {}
    left = set(fps)
    while left:
        group, todo = set(), [left.pop()]
        while todo:
            group.add(x := todo.pop())
            near = {y for y in left if (x ^ y).bit_count() <= 2}
            left -= near
            todo += near
        if len(group) > 1:
            members = np.array(sorted(group), np.uint64).view(np.int64).tolist()
            want.update(dict.fromkeys(members, min(members)))
    assert got == want


def test_thresholds_add_up_for_every_plan():
    for n in (10, 10**6, 10**9, 10**12):
        sample = np.random.default_rng(n).integers(-(2**63), 2**63, 500)
        parts = simhash.plan(sample, n)
        used = [b for g, _ in parts for b in g]
        assert len(used) == len(set(used)) and parts
        assert all(0 <= e <= 2 for _, e in parts)


def test_components_of_a_chain_and_a_star(spark):
    rows = [(i, i + 1) for i in range(50)] + [(1000, 1000 + i) for i in range(1, 200)] + [(7, 7)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(rows, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(51)}, **{i: 1000 for i in range(1000, 1200)}}
