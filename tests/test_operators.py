import math
import os
import zipfile

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tallyloom.operators import aggregate, dedup, evaluate, joins, reliability, sample, topics, windows
from tallyloom.plans import coverage, extraction, labelling, literature, selection
from tallyloom.runtime import salted_join
from tallyloom.sources import files, pages


def test_salted_join_is_a_join(spark):
    left = spark.range(6000).select("id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"))
    right = left.groupBy("k").agg(F.count("*").alias("n"))
    got = salted_join(left, right, ["k"], "n", "id", 6000)
    assert got.count() == 6000 and got.where("k = 0").agg(F.max("n")).collect()[0][0] == 2000


def test_dedup(spark):
    b = spark.createDataFrame(
        [(1, "d1", "t1", False), (2, "d1", "t1", True), (3, None, "t1", None), (4, None, None, None), (5, None, None, None), (6, "d2", "t2", False)], "ord int, doi string, title_normalized string, is_globalsouth boolean"
    )
    assert sorted(r["ord"] for r in literature.dedup_naive(b).collect()) == [2, 4, 6]
    once = literature.dedup_naive(b)
    assert sorted(r["ord"] for r in literature.dedup_naive(once).collect()) == [2, 4, 6]  # again changes nothing
    assert rows(dedup.duplicate_report(b, "title_normalized")) == [("t1", 3)]
    a, c = dedup.fingerprint(b, "ord", "doi").collect(), dedup.fingerprint(b.orderBy(F.desc("ord")), "ord", "doi").collect()
    assert a == c and a != dedup.fingerprint(b.where("ord > 1"), "ord", "doi").collect()
    kept = dedup.keep_first(b, ["doi"], [F.desc("ord")], null_keys="keep")
    assert sorted(r["ord"] for r in kept.collect()) == [2, 3, 4, 5, 6]


def test_pool_and_gaps(spark):
    a = spark.createDataFrame([("x", 1), ("x", 2), ("y", 3), (None, 9)], "title string, ord int")
    b = spark.createDataFrame([("y", 4), ("z", 5)], "title string, ord int")
    got = {r["title"]: (r["ord"], r["source"]) for r in joins.pooled_union(a, b, "title", "ord").collect()}
    assert got == {"x": (2, "s1_only"), "y": (3, "both"), "z": (5, "s2_only")}
    g = spark.createDataFrame([(2020, 1), (2020, 4), (2021, 1)], "year int, n int")
    assert rows(joins.gaps(g, "year", "n")) == [(2020, 2), (2020, 3)]


def test_parents(spark):
    docs = [("c1", "2001", ["rente", "alter"]), ("c2", "1999", ["rente", "alter"]), ("c3", "2001", ["haus"])]
    par = [("p1", "2000", ["rente", "alter"]), ("p2", "2000", ["rente", "alter", "neu"]), ("p0", "2000", ["rente", "alter"])]
    s = "id string, d string, stems array<string>"
    got = rows(joins.ranked_parents(spark.createDataFrame(docs, s), spark.createDataFrame(par, s), "stems", "d", 0.85))
    assert got == [("c1", "p0", 1.0, 1.0)]


def test_aggregates(spark):
    x = spark.createDataFrame([(1.0,), (2.0,), (float("nan"),), (None,), (4.0,)], "v double")
    assert rows(aggregate.describe(x, "v")) == [(3, 1.0, 4.0, 7 / 3, 2.0)]
    h = aggregate.histogram(x.where("v < 10"), "v", 3).collect()
    assert [r["n"] for r in sorted(h, key=lambda r: r["bin"])] == [1, 1, 1]
    assert aggregate.histogram(x.limit(0), "v", 3).count() == 0
    p = spark.createDataFrame([("m", "a", 1.0), ("m", "a", 2.0)], "r string, c string, v double")
    with pytest.raises(Exception, match="two values"):
        aggregate.pivot_unique(p, "r", "c", "v", ["a"]).collect()
    m = spark.createDataFrame([(0, 1, 0.5), (1, 1, None), (1, 0, 1.0)], "a int, b int, f double")
    got = {(r["dim"], r["value"]): r["f"] for r in aggregate.marginal_means(m, ["a", "b"], ["f"]).collect()}
    assert got == {("a", "0"): 0.5, ("a", "1"): 1.0, ("b", "1"): 0.5, ("b", "0"): 1.0}


def test_scores(spark):
    s = "id int, model string, gs array<string>, ps array<string>, g int, p int"
    d = spark.createDataFrame([(1, "m", ["a"], ["a", "b"], 1, 1), (2, "m", ["b"], ["a"], 0, 0), (3, "m", ["a"], None, 1, None)], s)
    got = {r["label"]: (r["tp"], r["fp"], r["fn"]) for r in evaluate.multilabel_scores(d, ["model"], "id", "gs", "ps").collect()}
    assert got == {"a": (1, 1, 0), "b": (0, 1, 1)}
    assert evaluate.binary_scores(d.where("g = 0"), ["model"], "g", "p").collect()[0]["f1"] == 0.0
    c = evaluate.confusion(spark.createDataFrame([("a", "b")], "x string, y string"), "x", "y", ["a", "b"])
    assert rows(c) == [("a", "a", 0), ("a", "b", 1), ("b", "a", 0), ("b", "b", 0)]
    t = spark.createDataFrame([("m", "v2", 0.50004), ("m", "v10", 0.5), ("n", "v1", None)], "model string, p string, f double")
    assert [r["p"] for r in evaluate.best_run(t, ["model"], "f", "p").collect()] == ["v2"]
    assert [r["p"] for r in evaluate.best_run(t, ["model"], "f", "p", 3).collect()] == ["v10"]


def test_reliability(spark):
    s = "variable string, unit int, coder string, value string"
    same = spark.createDataFrame([("v", i, c, x) for i, x in ((1, "a"), (2, "b"), (3, "a")) for c in "pq"], s)
    assert rows(reliability.alpha(same))[0][2] == 1.0
    flat = spark.createDataFrame([("v", i, c, "a") for i in (1, 2) for c in "pq"], s)
    assert rows(reliability.alpha(flat))[0][2] is None and rows(reliability.alpha(flat, "one"))[0][2] == 1.0
    assert rows(reliability.kappa(flat))[0][4] == 1.0
    lone = spark.createDataFrame([("v", 1, "p", "a")], s)
    assert reliability.alpha(lone).count() == 0
    mixed = spark.createDataFrame([("v", 1, "p", "a"), ("v", 1, "q", "b"), ("v", 2, "p", "a"), ("v", 2, "q", None)], s)
    assert rows(reliability.agreement(mixed)) == [("v", 1, 0.0)]
    assert ("v", "q", 2, 0, 1) in rows(reliability.missing_counts(mixed))


def test_windows(spark):
    d = spark.createDataFrame([(1, i, s) for i, s in enumerate(["ok", "not_found", "error", "error", "not_found", "ok", "error"], 1)], "y int, n int, s string")
    got = [(r["miss_run"], r["error_run"]) for r in windows.miss_runs(d, "y", "n", "s", "ok", "error").orderBy("n").collect()]
    assert got == [(0, 0), (1, 0), (1, 1), (1, 2), (2, 0), (0, 0), (0, 1)]
    t = spark.createDataFrame([("u", "2020-01-01 00:00:00"), ("u", "2020-01-01 00:01:00"), ("u", "2020-01-01 00:02:01")], "u string, t string").withColumn("t", F.col("t").cast("timestamp"))
    assert [r["n"] for r in windows.sliding_count(t, ["u"], "t", 60, "n").orderBy("t").collect()] == [1, 2, 1]


def test_samples(spark):
    d = spark.range(105).repartition(3)
    a, b = rows(sample.share_sample(d, "id", 0.1, 42)), rows(sample.share_sample(d.repartition(7), "id", 0.1, 42))
    assert a == b and len(a) == 10  # 10.5 goes to the even number


def test_topics(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0], 0), (2, [2.0, 0.1], 0), (3, [0.0, 1.0], 1), (4, [0.0, 0.0], 1), (5, None, 1)], "id int, v array<double>, t int")
    s = {r["id"]: (r["similarity"], r["nearest"]) for r in topics.max_similarity(v, "id", "v", v.where("id IN (1, 3)"), "id", "v").collect()}
    assert s[1] == (1.0, 1) and s[4][0] == 0.0 and s[5] == (None, None)
    assert topics.centroids(v.where("id < 4"), "t", "v").count() == 2
    pts = [(i, [math.cos(a), math.sin(a)]) for i, a in enumerate([0.01 * k for k in range(12)] + [2 + 0.01 * k for k in range(12)] + [4.0])]
    d = topics.density_clusters(spark.createDataFrame(pts, "id int, v array<double>"), "id", "v", least=0.99, core=3, smallest=5, planes=2)
    c = {r["id"]: r["cluster"] for r in d.collect()}
    assert c[24] == -1 and len({c[i] for i in range(12)}) == 1 and len({c[i] for i in range(12, 24)}) == 1 and c[0] != c[12]


def test_extraction(spark):
    d = spark.createDataFrame([("a", "x", 1, "w1 w2 w3", "w1 w2"), ("a", "y", 2, "w1 w2 w3", "w1 w2"), ("b", "x", 1, "w1 w2", "w1"), ("b", "y", 2, "w1 w2", "w1 w2"), ("c", "x", 1, "", "z")], "doc string, engine string, engine_no int, baseline_text string, md_text string")
    assert {r["doc"]: r["engine"] for r in extraction.best_engine(d).collect()} == {"a": "x", "b": "y", "c": "x"}
    p = spark.createDataFrame([("d", 1, "anlage", "A"), ("d", 2, "Regelungstext", "R")], "doc string, part_no int, name string, text string")
    assert extraction.merge_parts(p).collect()[0]["text"] == "R\n\n## anlage\n\nA"
    q = spark.createDataFrame([(1, "kurz", 3, "5")], "id int, t string, pages int, number string")
    assert extraction.quality_flags(q, "id", "t", "pages", "number").collect()[0]["flags"] == ["short", "few_characters_per_page"]


def test_labelling(spark):
    now = [0.0]
    lim = labelling.RateLimiter(2, None, clock=lambda: now[0], sleep=lambda s: now.__setitem__(0, now[0] + s))
    assert [lim.wait() for _ in range(3)] == [0.0, 0.0, 60.5]
    calls, waits = [], []

    def call():
        calls.append(1)
        if len(calls) < 3:
            raise TimeoutError
        return "ok"

    assert labelling.with_backoff(call, {TimeoutError: 30}, sleep=waits.append, rng=lambda: 0.0) == "ok" and waits == [30, 60]
    pr = labelling.prompts(spark, {"batch": "B", "single": "S"}, "D", "J", "E")
    assert pr.count() == 16 and pr.select("prompt_key").distinct().count() == 16
    e = spark.createDataFrame([("1", None, None, "x")], "id string, title string, date string, text string")
    bad = labelling.classify_run(e, spark.createDataFrame([("m",)], "model string"), pr.limit(1), lambda s, u: 1 / 0, "id", "title", "date", "text", "2020").collect()[0]
    assert bad["llm_labels"] is None and "ZeroDivisionError" in bad["llm_error"]
    old = spark.createDataFrame([("1", "f", "a", "x", "d1"), ("2", "f", "a", "x", "d1")], "id string, field string, value string, coder string, date string")
    new = spark.createDataFrame([("1", "f", "a", "y", "d2"), ("2", "f", "b", "y", "d2"), ("3", "f", "c", "y", "d2")], old.schema)
    assert rows(labelling.annotate_merge(old, new, ["id", "field"])) == [("1", "f", "a", "x", "d1"), ("2", "f", "b", "y", "d2"), ("3", "f", "c", "y", "d2")]
    assert labelling.output_schema({"a": ["x"], "b": None})["required"] == ["a", "b"]


def test_selection(spark):
    log = spark.createDataFrame([("t", "1", "n", 1), ("t", "1", "y", 2)], "triage_id string, key string, decision string, decided_at int")
    assert selection.decisions_now(log).collect()[0]["decision"] == "y"
    u = spark.createDataFrame([("a", None)], "title string, decision string")
    with pytest.raises(Exception, match="no decision"):
        selection.require_decided(u, "decision").collect()


def test_sources(spark, tmp_path):
    (tmp_path / "m__v1_batch__2026-01.json").write_text('{"run_metadata": {"model": "m", "prompt_key": "v1_batch", "date": "2026-01", "system_fingerprints": "na"}, "entries": [{"id": "1", "llm_labels": {"a": {"value": "x", "coder": "m", "date": "d"}}}]}')
    (tmp_path / "m__v1_batch__2026-02_partial.json").write_text('{"run_metadata": {"model": "m", "prompt_key": "v1_batch"}, "entries": []}')
    (tmp_path / "n__v1_batch__2026-02_partial.json").write_text('{"run_metadata": {"model": "n", "prompt_key": "v1_batch", "system_fingerprints": ["f"]}, "entries": [{"id": "2"}]}')
    runs, entries = files.read_runs(spark, str(tmp_path))
    assert rows(runs.select("model", "system_fingerprints")) == [("m", []), ("n", ["f"])]
    assert rows(entries.select("model", "id")) == [("m", "1"), ("n", "2")]
    assert files.latest_file(spark, str(tmp_path), r"(\d{4}-\d{2})").endswith("2026-02_partial.json")
    csv = tmp_path / "a.csv"
    csv.write_text('Title,Year,Extra\n"A, ""b""",2001,z\n')
    assert rows(files.read_csv(spark, str(csv), ["title", "doi", "year"])) == [('A, "b"', "2001")]
    ref = tmp_path / "r.txt"
    ref.write_text("Smith, J.\nA title\n(2001) Journal\nhttps://x.example?eid=2-s2.0-1&x\nAuthor Keywords: k1; k2\nSmith, J.\nNo year line\nDocument Type: Article\n")
    assert rows(files.read_tagged_text(spark, str(ref), "Smith, J\\.")) == [("A title", 2001, "2-s2.0-1", "k1; k2", None)]
    out = str(tmp_path / "o")
    assert files.write_once(spark.range(3), out) and not files.write_once(spark.range(3), out)
    files.write_json(spark.range(2), str(tmp_path / "j"), gzip=True)
    assert files.read_json(spark, str(tmp_path / "j"), "id bigint").count() == 2
    df, o = files.observed(spark.range(5), "m", n=F.count(F.lit(1)))
    df.collect()
    assert o.get["n"] == 5
    assert "| n | 5 |" in files.render_log("run", {"a": 1}, {"n": 5}, {"top": [("x", 1)]})


def test_archives_and_pages(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        for n in ("Öl.pdf", "x/öl.PDF", "note.txt"):
            z.writestr(n, n)
    got = rows(pages.read_archives(spark, str(tmp_path / "a.zip")).select("slug", "is_pdf"))
    assert got == [("note", False), ("oel", True), ("oel_2", True)]
    html = "<html><h1>Ein Gesetz</h1><p>VBl. I 2023 Nr. 12a</p><p>FNA:</p><p>860-5, 860-5 und 8-1</p><a href='b.pdf#x'>b</a><a href='a.zip'>z</a></html>"
    d = spark.createDataFrame([(1, html), (2, None), (3, "<p>nichts</p>")], "id int, h string")
    r = {x["id"]: x for x in pages.parse_pages(d, "id", "h").collect()}
    assert r[1]["title"] == "Ein Gesetz" and r[1]["number"] == "12a" and r[1]["codes"] == ["860-5", "8-1"] and r[1]["pdf_links"] == ["b.pdf"]
    assert r[2]["status"] == "not_found" and r[3]["status"] == "unparsed"
    g = spark.createDataFrame([(1, [("a", 0.0, 1.0), ("b", 3.0, 4.0), ("c", 6.0, 7.0)]), (2, [("a", 0.0, 1.0), ("b", 1.1, 2.0)])], "line int, glyphs array<struct<c: string, x0: double, x1: double>>")
    assert rows(pages.letter_gaps(g).select("line", "spaced")) == [(1, True), (2, False)]


def test_coverage(spark):
    log = spark.createDataFrame([(2020, "1", 1, "error", None), (2020, "1", 2, "ok", None), (2020, "3", 1, "ok", None), (2020, "4", 1, "not_found", None)], "year int, number string, attempt int, status string, loaded_at timestamp")
    st = coverage.fetch_state(log)
    assert {r["number"]: r["recovered"] for r in st.collect()} == {"1": True, "3": False, "4": False}
    assert rows(coverage.coverage_report(st).select("n", "reason", "place")) == [(2, None, "gap"), (4, "not_found", "tail")]


def test_streaming(spark, tmp_path):
    from tallyloom.streaming import events as S

    src = str(tmp_path / "in")
    ts = F.timestamp_seconds(F.col("id") * 10 + 1_000_000_000)
    spark.range(10).select((F.col("id") % 2).alias("u"), ts.alias("ts"), "id").coalesce(1).write.parquet(src)
    schema = spark.read.parquet(src).schema
    S.upsert_latest(S.replay(spark, src, schema), ["u"], ["id"], str(tmp_path / "s"), str(tmp_path / "c")).awaitTermination()
    assert rows(S.read_latest(spark, str(tmp_path / "s")).select("u", "id")) == [(0, 8), (1, 9)]
    q = S.rate_limited(S.replay(spark, src, schema), "u", "ts", 2, 100).writeStream.format("memory").queryName("lim").option("checkpointLocation", str(tmp_path / "k")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("lim").where("allowed").count() == 6 and spark.table("lim").count() == 10
    assert os.path.isdir(tmp_path / "k")


def test_sets_and_registry(spark, tmp_path):
    from tallyloom.operators import sets
    from tallyloom.sources import registry

    a = spark.createDataFrame([("x",), ("x",), (None,), ("y",)], "k string")
    b = spark.createDataFrame([("y",), ("z",)], "k string")
    assert rows(sets.union_keys([a, b], "k")) == [("x",), ("y",), ("z",), (None,)] or len(rows(sets.union_keys([a, b], "k"))) == 4
    assert rows(sets.common_keys(a, b, "k")) == [("y",)]
    assert sorted(map(str, rows(sets.missing_keys(a, b, "k")))) == ["('x',)", "(None,)"]
    assert sets.multiset_difference(a, a.distinct()).count() == 1
    assert {r["part"] for r in sets.split(a, {"is_x": F.col("k") == "x"}).collect()} == {"is_x", "rest"}
    (tmp_path / "g.json").write_text('[{"id": "1", "gs_labels": {"a": {"value": "x"}}}, {"id": "2"}]')
    have, open_ = registry.load(spark, "gold_json", str(tmp_path / "g.json"))
    assert have.count() == 1 and rows(open_) == [("2",)]
    with pytest.raises(ValueError, match="no loader"):
        registry.load(spark, "xml", "x")
