"""Stored tables: cache, statistics, reports, ids, commits, trace; and joins that move little."""

from __future__ import annotations

import bz2
import gzip
import os
import random
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from tierglass.functions import membership
from tierglass.functions import pages as P
from tierglass.operators import answers as ans
from tierglass.operators import ask as asking
from tierglass.operators import prepare as pr
from tierglass.operators import views as vw
from tierglass.operators.fusion import classify
from tierglass.plans import queries
from tierglass.sources import answer_cache as store
from tierglass.sources import files, report_files, sinks, trees
from tierglass.sources.documents import read_documents
from tierglass.streaming import continuous as st

SF = "/root/testdata/sf0.001"


def entries(spark, keys, minute, label="Public"):
    return spark.createDataFrame([(k,) for k in keys], "k string").select(
        F.lit("m").alias("model"),
        F.sha2("k", 256).alias("prompt_hash"),
        F.lit(label).alias("label"),
        F.lit(0.5).alias("score"),
        F.concat("k", F.lit(f" {minute}")).alias("reasoning"),
        F.lit("{}").alias("raw_response"),
        F.expr(f"TIMESTAMP '2024-01-01 00:{minute:02d}:00'").alias("updated_at"),
        F.lit(False).alias("fallback"),
    )


def stamps(folder):
    return {
        os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns
        for d, _, names in os.walk(folder)
        for f in names
        if f.endswith(".parquet")
    }


def table_of(df):
    return sorted(tuple(r) for r in df.select("model", "prompt_hash", "label", "reasoning", "updated_at").collect())


def test_stored_cache_rewrites_only_folders_that_get_entries(spark, tmp_path):
    path, old = str(tmp_path), [f"k{i}" for i in range(400)]
    store.store_answers(entries(spark, old, 1), path)
    before = stamps(f"{path}/entries")
    new = entries(spark, ["k3", "k5", "fresh1", "fresh2"], 2, "Unsafe")
    touched = store.store_answers(new, path)
    after = stamps(f"{path}/entries")
    assert 1 <= len(touched) <= 4
    kept = {f for f in before if not any(f"prefix={p}/" in f for p in touched)}
    assert kept and all(after.get(f) == before[f] for f in kept)
    assert all(f not in after for f in before if f not in kept)
    want = ans.cache_upsert(entries(spark, old, 1), new)
    assert table_of(store.stored_answers(spark, path)) == table_of(want)
    assert files.names(spark, f"{path}/pending") == []


def test_stopped_upsert_is_finished_or_not_there(spark, tmp_path, monkeypatch):
    path = str(tmp_path)
    store.store_answers(entries(spark, [f"k{i}" for i in range(50)], 1), path)
    new = entries(spark, [f"k{i}" for i in range(0, 50, 10)], 2)
    want = table_of(ans.cache_upsert(store.stored_answers(spark, path), new))
    overwrite = store._overwrite

    def stop(rows, folder):
        if folder.endswith("/entries"):
            for name in files.names(spark, folder)[:3]:
                files.delete(spark, f"{folder}/{name}")  # some folders gone, none written yet
            raise RuntimeError("stopped")
        overwrite(rows, folder)

    monkeypatch.setattr(store, "_overwrite", stop)
    touched = {r[0] for r in new.select(F.substring("prompt_hash", 1, 2)).collect()}
    for name in files.names(spark, f"{path}/entries"):
        if name.partition("=")[2] not in touched and name.startswith("prefix="):
            break
    with pytest.raises(RuntimeError, match="stopped"):
        monkeypatch.setattr(files, "names", only(files.names, touched))
        store.store_answers(new, path)
    monkeypatch.undo()
    assert table_of(store.stored_answers(spark, path)) == want
    store.store_answers(new, path)
    assert table_of(store.stored_answers(spark, path)) == want
    os.makedirs(f"{path}/pending/half/prefix=00")
    assert table_of(store.stored_answers(spark, path)) == want
    assert files.names(spark, f"{path}/pending") == []


def only(names, touched):
    def listed(spark, folder):
        found = names(spark, folder)
        return [n for n in found if n.partition("=")[2] in touched] if folder.endswith("/entries") else found

    return listed


def test_lookup_drops_entries_that_nobody_asks_for(spark, tmp_path):
    path = str(tmp_path)
    store.store_answers(entries(spark, [f"k{i}" for i in range(2000)], 1), path)
    asked = entries(spark, ["k7", "k8", "unknown"], 1).select("model", "prompt_hash")
    found = store.stored_answers(spark, path, asked)
    assert found.count() <= 20
    hits, misses = ans.cache_split(asked, found)
    assert hits.count() == 2 and misses.count() == 1
    assert store.stored_answers(spark, path, asked.where("false")).count() == 0
    assert store.stored_answers(spark, str(tmp_path / "none"), asked).count() == 0
    assert store.store_answers(entries(spark, [], 1), path) == []


@pytest.mark.parametrize("cells", [1, 3, 1 << 20])
def test_filter_holds_every_member(spark, cells):
    rows = spark.range(2000).withColumn("k", F.expr("IF(id % 50 = 0, NULL, concat('x', id))"))
    some = rows.where("id % 3 = 0")
    members = membership.filter_of(some.select("k"), ["k"], cells)
    assert members.count() <= cells
    passed = membership.probable(rows, members, ["k"], cells)
    assert some.join(passed, "id", "left_anti").count() == 0
    marked = membership.with_probable(rows, members, ["k"], "may", cells)
    assert marked.count() == 2000 and marked.where("may").count() == passed.count()
    if cells > 3:
        assert passed.count() < 800


def test_statistics_survive_restarts_and_a_new_checkpoint(spark, tmp_path):
    records = spark.createDataFrame([(1, "Unsafe"), (2, "Public")], "id long, classification string")
    schema = "classification_id long, decision string, quality_score double"

    def arrive(n, rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "all" / f"p={n}"))
        os.makedirs(tmp_path / "in", exist_ok=True)
        for f in os.listdir(tmp_path / "all" / f"p={n}"):
            if f.endswith(".parquet"):
                os.link(tmp_path / "all" / f"p={n}" / f, tmp_path / "in" / f"{n}-{f}")

    def run(checkpoint):
        arriving = st.arriving(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema, 1)
        st.keep_statistics(arriving, records, str(tmp_path / "out"), str(tmp_path / checkpoint), once=True).awaitTermination()
        rows = st.latest_statistics(spark, str(tmp_path / "out")).collect()
        return {r.label: (r.total, r.overrides, r.avg_quality) for r in rows}

    assert st.latest_statistics(spark, str(tmp_path / "nothing")).count() == 0
    for n in range(6):
        arrive(n, [(1, "override", 1.0), (1, "accept", None), (9, "override", 0.0)])
    assert run("a") == {"Unsafe": (12, 6, 1.0)}
    arrive(6, [(2, "Override", 0.5)])
    assert run("a") == {"Unsafe": (12, 6, 1.0), "Public": (1, 1, 0.5)}
    # A new checkpoint reads everything again, from batch 0, and is what counts from then on.
    assert run("b") == {"Unsafe": (12, 6, 1.0), "Public": (1, 1, 0.5)}
    arrive(7, [(2, "accept", 1.0)])
    assert run("b")["Public"] == (2, 1, 0.75)
    for query in (tmp_path / "out").glob("query=*"):
        assert len(list(query.glob("batch=*"))) <= st.SLOTS


def test_report_files_are_where_results_say(spark, tmp_path):
    names = ["plain", "a/b", "..", ".", "x y", "50%", "ü", "c\\d"]
    docs = spark.createDataFrame([(n, "/in", f"text of {n} is confidential") for n in names], "doc_id string, source string, text string")
    results = classify(docs).withColumns({"task_id": F.lit("t/1"), "classification_id": F.lit(1)})
    folder = str(tmp_path / "reports")
    written = report_files.write_report_files(results, folder)
    paths = {r.doc_id: r.reports for r in written.collect()}
    assert set(paths) == set(names) and all(list(p) == ["json"] for p in paths.values())
    for p in paths.values():
        assert os.path.realpath(p["json"]).startswith(os.path.realpath(folder)) and os.path.isfile(p["json"])
    told = results.select("doc_id", vw.report_paths(folder, F.col("task_id"), F.col("doc_id")).alias("r"))
    assert {r.doc_id: r.r for r in told.collect()} == paths
    assert len({p["json"] for p in paths.values()}) == len(names)
    again = results.withColumn("label", F.lit("Unsafe")).where("doc_id = 'plain'")
    report_files.write_report_files(again, folder)
    with open(paths["plain"]["json"]) as f:
        assert '"label":"Unsafe"' in f.read()
    read = {r.name: r.content for r in report_files.read_report_files(spark, folder).collect()}
    assert len(read) == len(names) and sum('"label":"Unsafe"' in c for c in read.values()) == 1
    assert {f"{folder}/{n}" for n in read} == {p["json"] for p in paths.values()}
    assert report_files.write_report_files(results.where("false"), folder).count() == 0


def results_of(spark, n, name):
    return spark.range(n).select(
        F.concat(F.lit(name), F.format_string("%05d", "id")).alias("doc_id"),
        F.lit("/in").alias("source"),
        F.lit("Public").alias("label"),
        F.lit(0.6).alias("raw_score"),
    )


def test_runs_appended_at_once_get_ids_of_their_own(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "records")
    sinks.append_records(results_of(spark, 5, "z"), path, "before")
    monkeypatch.setattr(sinks, "_stored_last", lambda *_: pytest.fail("the stored table was read"))
    runs = [f"run/{k}" for k in range(4)]
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda r: sinks.append_records(results_of(spark, 30, r), path, r), runs))
    stored = [r.id for r in spark.read.parquet(path).collect()]
    assert sorted(stored) == list(range(1, 126))
    ids = {r.document_path: r.id for r in spark.read.parquet(path).where("run = 'before'").collect()}
    sinks.append_records(results_of(spark, 5, "z"), path, "before")
    sinks.append_records(results_of(spark, 3, "z"), path, "run/2")
    assert {r.document_path: r.id for r in spark.read.parquet(path).where("run = 'before'").collect()} == ids
    assert spark.read.parquet(path).count() == 98
    sinks.append_records(results_of(spark, 31, "z"), path, "run/2")
    assert spark.read.parquet(path).agg(F.min("id"), F.max("id"), F.countDistinct("id")).first()[1:] == (156, 126)


def test_ids_go_on_behind_a_table_without_ledger(spark, tmp_path):
    path = str(tmp_path / "old")
    sinks.write_run(spark.range(7, 10).withColumn("document_path", F.lit("x")), path, "old")
    assert sinks.claim_ids(spark, path, "new", 4) == 10 and sinks.claim_ids(spark, path, "newer", 1) == 14


def test_feedback_and_misclassifications_are_seen_together(spark, tmp_path, monkeypatch):
    path = str(tmp_path)
    records = spark.createDataFrame([(1, "Public"), (2, "Unsafe")], "id long, classification string")
    given = spark.createDataFrame(
        [(1, 1, "r", "override", "c", "Unsafe", 0.5), (2, 2, "r", "accept", "c", None, 0.9), (3, 5, "r", "accept", "c", None, 0.9)],
        "key long, classification_id long, reviewer string, decision string, comments string, suggested_label string, quality_score double",
    )

    def seen():
        return sinks.stored_feedback(spark, path).count(), sinks.stored_misclassifications(spark, path).count()

    write = sinks._write_attempt
    stop = lambda rows, folder, *a: pytest.fail("stopped") if folder.endswith("/misclassifications") else write(rows, folder, *a)
    sinks.append_feedback(given.where("key = 2"), records, path, "first", "key")
    assert seen() == (1, 0)
    monkeypatch.setattr(sinks, "_write_attempt", stop)
    with pytest.raises(BaseException, match="stopped"):
        sinks.append_feedback(given, records, path, "second", "key")
    assert seen() == (1, 0)
    monkeypatch.setattr(sinks, "_write_attempt", write)
    monkeypatch.setattr(sinks, "_commit", lambda *_: pytest.fail("stopped"))
    with pytest.raises(BaseException, match="stopped"):
        sinks.append_feedback(given, records, path, "second", "key")
    assert seen() == (1, 0)
    monkeypatch.undo()
    for _ in range(2):
        rejects = sinks.append_feedback(given, records, path, "second", "key")
        assert seen() == (3, 1) and rejects.count() == 1
    stored = sinks.stored_feedback(spark, path)
    assert stored.select("id").distinct().count() == 3
    assert len(list((tmp_path / "feedback" / "run=second").glob("attempt=*"))) <= 2


def exchanged_bytes(df):
    """Bytes that all shuffles of an executed query have written."""
    df.collect()
    total, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
        elif "QueryStage" in name:
            todo.append(node.plan())
        if name == "Exchange":
            total += node.metrics().get("dataSize").get().value()
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return total


def test_texts_without_images_stay_out_of_the_join(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        docs = spark.range(200).select(
            F.col("id").alias("doc_id"), F.lit("/in").alias("source"), F.repeat(F.lit("plain words "), 3000).alias("text")
        )

        def results_of(docs):
            return classify(pr.split_pages(docs), keep=("text", "page_spans", "page_count"), spans="page_spans")

        schema = "doc_id long, image_idx int, page int, metadata map<string,string>, content binary"
        images = spark.createDataFrame([(5, 0, 1, {"label": "figure"}, bytearray(b"x"))], schema)
        shown = vw.evidence_by_images(docs, images, results_of).select("doc_id", "evidence")
        assert exchanged_bytes(shown) < 200 * 36_000 * 0.1
        with_image = {r.doc_id: [e.type for e in r.evidence] for r in shown.collect()}
        plain = {r.doc_id: r.evidence for r in vw.evidence_entries(results_of(docs)).select("doc_id", "evidence").collect()}
        assert with_image.pop(5) == ["text", "image", "text"]
        assert all(with_image[k] == [e.type for e in plain[k]] for k in with_image)
        same = {r.doc_id: r.evidence for r in shown.collect()}
        assert all(same[k] == plain[k] for k in plain if k != 5)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("bin_chars", [1, 7, 1 << 16])
def test_offsets_of_a_table_get_the_page_of_the_row_form(spark, bin_chars):
    rng = random.Random(4)
    spans, asked = [], []
    for doc in range(30):
        at, own = 0, []
        for page in range(rng.randint(0, 40)):
            n = rng.choice([0, 1, 3, 50])
            own.append((page + 1, at, at + n))
            at += n + rng.choice([0, 2])
        spans.append((doc, own))
        asked += [(doc, rng.randint(-2, at + 3)) for _ in range(40)] + [(doc, None), (doc, 0), (doc, 0)]
    asked += [(99, 5), (None, 1)]
    wide = spark.createDataFrame(spans, f"doc_id long, page_spans {P.SPAN_TYPE}")
    offsets = spark.createDataFrame([(*a, "x") for a in asked], "doc_id long, offset int, page_name string")
    got = pr.pages_of_offsets(offsets, wide.select("doc_id", F.inline("page_spans")), bin_chars=bin_chars)
    rows = offsets.join(wide, "doc_id", "left")
    want = rows.select("doc_id", "offset", "page_name", P.page_of(F.col("page_spans"), F.col("offset")).alias("page"))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.select(got.columns).collect()))


def test_offsets_of_a_long_document_are_many_tasks(spark):
    spans = spark.range(100_000).selectExpr("1L AS doc_id", "CAST(id + 1 AS INT) AS page", "CAST(id * 80 AS INT) AS start", "CAST(id * 80 + 79 AS INT) AS `end`")
    offsets = spark.range(50_000).selectExpr("1L AS doc_id", "id * 160 + id % 80 AS offset").unionAll(
        spark.range(50_000).selectExpr("1L", "17L")
    )
    found = pr.pages_of_offsets(offsets, spans)
    row = found.agg(F.count("*"), F.count("page"), F.max("page")).first()
    assert tuple(row) == (100_000, 50_000 + 50_000 - 625, 99_997)


def test_repeated_trace_holds_its_lines_once(spark, tmp_path):
    from tierglass.operators import prompts as pm
    from tierglass.plans.queries import NODES

    docs = spark.range(50).select(F.col("id").alias("doc_id"))
    path = str(tmp_path / "trace")

    def lines():
        return [r.value for r in spark.read.text(path).select("value").collect()]

    sinks.write_trace(pm.expand_prompts(docs, NODES), path, "one")
    once = lines()
    sinks.write_trace(pm.expand_prompts(docs, NODES).orderBy(F.desc("node_ord")), path, "one")
    assert sorted(lines()) == sorted(once)
    sinks.write_trace(pm.expand_prompts(docs.repartition(3), NODES), path, "two")
    assert len(lines()) == 2 * len(once)
    for part in (tmp_path / "trace" / "run=two").glob("*.txt"):
        named = [x for x in part.read_text().split("\n") if x.startswith("[")]
        assert named == [f"[{n.name}]" for n in NODES] * (len(named) // len(NODES))


@pytest.mark.parametrize("said", [[], ["Public"], ["Public"] * 9, None, "Public"])
def test_a_wrong_number_of_batched_answers_is_an_error_of_all(spark, said):
    docs = spark.createDataFrame([(i, "primary", m, 0, "p") for i, m in enumerate(["a", "a", "b", "a"])], "doc_id long, role string, model string, node_ord int, full_prompt string")
    given = ans.infer(docs.coalesce(1), lambda model, prompts: said if model == "a" else ["Unsafe"] * len(prompts), batched=True)
    rows = {r.doc_id: r for r in given.collect()}
    assert rows[2].raw_response == "Unsafe" and rows[2].error is None
    assert all(rows[i].raw_response is None and "answers to 3 prompts" in rows[i].error for i in (0, 1, 3))
    keyword = classify(spark.range(4).selectExpr("id AS doc_id", "'/in' AS source", "'text' AS text"), given)
    shown = {r.doc_id: r.debug_info.primary for r in keyword.select("doc_id", "debug_info").collect()}
    assert all(shown[i].fallback and "answers to 3 prompts" in shown[i].reason for i in (0, 1, 3))


def listed_by_spark(spark, path):
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    texts = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True)
    return (
        {r.path for r in files.select("path").collect()},
        {(r.at, r.hex) for r in texts.select(F.col("_metadata.file_path").alias("at"), F.hex("value").alias("hex")).collect()},
    )


def test_folders_are_listed_and_read_by_tasks(spark, tmp_path):
    """As Spark's readers list and read them, but the driver plans with none of the files."""
    names = [
        "a.txt", "b c/d%20.txt", "ü/é ß.txt", "k=v/_x=1/q.txt", "t.html.gz", "u.txt.bz2", "deep/er/est/z.csv", "plus+&;,'()!.txt",
        "x.bin", "empty.txt", "_hidden/a.txt", ".dot/a.txt", "_SUCCESS", "y._COPYING_", "~#\"<>|^`.txt", "ende  .txt",
    ]
    for i, name in enumerate(names):
        place = tmp_path / "in" / name
        place.parent.mkdir(parents=True, exist_ok=True)
        body = b"" if "empty" in name else f"Text {i}\nüber".encode() + (b"\xff" if i == 0 else b"")
        place.write_bytes(gzip.compress(body) if name.endswith(".gz") else bz2.compress(body) if name.endswith(".bz2") else body)
    (tmp_path / "in" / "none").mkdir()
    paths, texts = listed_by_spark(spark, str(tmp_path / "in"))
    for path in (str(tmp_path / "in"), f"{tmp_path}/in/", f"file:{tmp_path}/in", f"file://{tmp_path}/in"):
        found = trees.tree(spark, path)
        assert {f"file:{r.path}" for r in found.collect()} == paths
        assert {(r.uri, r.hex) for r in trees.contents(found).select("uri", F.hex("value").alias("hex")).collect()} == texts
    assert not report_files.read_report_files(spark, str(tmp_path / "in")).inputFiles()


def test_rows_of_one_name_are_one_file(spark, tmp_path):
    rows = [("b/1.txt", "x\n"), ("b/1.txt", "y\n"), ("a/2.txt", ""), ("a/3.txt", "ü")]
    trees.write_texts(spark.createDataFrame(rows, "name string, content string").coalesce(1), str(tmp_path / "out"))
    got = {str(p.relative_to(tmp_path / "out")): p.read_text() for p in (tmp_path / "out").rglob("*.txt")}
    assert got == {"b/1.txt": "x\ny\n", "a/2.txt": "", "a/3.txt": "ü"}
    read = read_documents(spark, str(tmp_path / "out"))
    assert {r.source.rsplit("/out/", 1)[1]: r.text for r in read.collect()} == {"b/1.txt": "x\ny\n", "a/3.txt": "ü"}
    assert not read.inputFiles()  # the driver holds no list of them


def test_records_of_several_runs_are_classified_once(spark, monkeypatch):
    given, append = [], sinks.append_records
    monkeypatch.setattr(queries.sinks, "append_records", lambda results, *a: (given.append(results), append(results, *a)))
    assert queries.QUERIES["s10_appended_records"](spark, SF).count() > 0
    assert len(given) == 3 and not any(r.inputFiles() for r in given)


def test_a_folder_of_the_cache_gets_few_files(spark, tmp_path):
    path = str(tmp_path / "cache")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        store.store_answers(entries(spark, [f"k{i}" for i in range(4000)], 1), path)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    folders = [*(tmp_path / "cache" / "entries").glob("prefix=*")]
    assert len(folders) == 256 and all(len([*f.glob("part-*.parquet")]) == 1 for f in folders)
    assert store.stored_answers(spark, path).count() == 4000


def test_documents_with_nothing_to_ask_are_not_scanned(spark, tmp_path, monkeypatch):
    seen, scan = spark.sparkContext.accumulator(0), asking.scan_text

    @F.udf("string")
    def counted(text):
        seen.add(1)
        return text

    monkeypatch.setattr(asking, "scan_text", lambda rows, rules: scan(rows.withColumn("text", counted("text")), rules))
    docs = spark.createDataFrame([(i, f"text {i % 30}") for i in range(60)], "doc_id long, text string")

    def ask(rows):
        before = seen.value
        answers = asking.ask_stored(rows, queries.NODES, str(tmp_path / "cache"), queries.stub_model, {"primary": "m"}, max_chars=None)
        return seen.value - before, answers.groupBy("backend").count().collect()

    scanned, answers = ask(docs)
    assert 30 <= scanned < 60 and answers == [("model", 240)]
    scanned, answers = ask(docs)
    assert scanned == 0 and answers == [("cache", 240)]


@pytest.mark.parametrize("name, folder", [("j4_streamed_classification", "in"), ("j6_streamed_recalibration", "results")])
def test_files_that_arrive_are_bounded(spark, tmp_path, monkeypatch, name, folder):
    monkeypatch.setattr(queries, "work_folder", lambda _: str(tmp_path / "work"))
    want = sorted(queries.QUERIES[name](spark, SF).collect())
    assert len([*(tmp_path / "work" / folder).glob("part-*.parquet")]) == 4
    monkeypatch.setattr(queries, "work_folder", lambda _: str(tmp_path / "small"))
    monkeypatch.setattr(queries, "ARRIVING_BYTES", queries.size_of(queries.seeds.seeded(spark, SF)) // 7)
    assert sorted(queries.QUERIES[name](spark, SF).collect()) == want
    assert len([*(tmp_path / "small" / folder).glob("part-*.parquet")]) >= 7
