"""Operators for training data: against brute force, round trips and made-up cases, with the odd inputs of each."""

import random

import numpy as np
import pytest
from conftest import rows
from hypothesis import example, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyloom.llm import consensus, encode, formatting_copies, language, pack, pair_defects, scan_repair, subjects
from tallyloom.llm import queries as q

VOCAB = f"{encode.TOKENIZERS}/byte_bpe_50k.tiktoken"


# --- copies hidden by formatting ------------------------------------------------------------------

COPIES = [
    (1, "A Title: one", "10.5555/ab.1", "run_a", "x"), (2, " a title  ONE.", "https://doi.example/10.5555/AB.1", "Run A", None), (3, "doi:10.5555/ab.1", "run-a", "A title: one", "x"),
    (4, "A title two", "10.5555/ab.1", "run_a", "x"), (5, None, None, "run_a", "x"), (6, None, None, "run_a", "x"), (7, "A title: one", None, "run_a", "x"), (8, "a title one", None, "run a", "x"),
    (9, "", None, "run_a", "x"), (10, None, "10.5555/ab.1", "run_a", "x"), (None, "A title: one", "10.5555/ab.1", "run_a", "x"),
]
COPY_SCHEMA = "ord bigint, title string, doi string, search_run string, n_records string"


def test_copies(spark):
    df = spark.createDataFrame(COPIES, COPY_SCHEMA)
    cols = ["title", "doi", "search_run"]
    assert rows(formatting_copies.find_copies(df, "ord", cols, ["title", "doi"])) == [(1, 2), (1, 3), (7, 8)]
    one = {r["ord"]: r["n_copies"] for r in formatting_copies.collapse_copies(df, "ord", cols, ["title", "doi"]).collect()}
    assert one[1] == 2 and one[7] == 1 and one[4] == 0 and 2 not in one and one[None] == 0 and len(one) == 8
    assert formatting_copies.find_copies(df.limit(0), "ord", cols, ["title", "doi"]).count() == 0


def test_copies_hot_group(spark):
    df = spark.range(3000).select(F.col("id").alias("ord"), F.when(F.col("id") % 3 == 0, "Same!").otherwise(F.concat(F.lit("t"), F.col("id"))).alias("title"), F.lit(None).cast("string").alias("doi"), F.lit("r").alias("search_run"))
    got = formatting_copies.find_copies(df, "ord", ["title", "doi", "search_run"], ["title", "doi"])
    assert got.count() == 999 and got.select("first_ord").distinct().count() == 1


@given(st.lists(st.tuples(st.text("abAB .", max_size=4), st.text("cC-", max_size=2)), max_size=12))
@settings(max_examples=15, deadline=None)
def test_bare_values_are_the_key(spark, recs):
    import re

    df = spark.createDataFrame([(i, a, b, "r") for i, (a, b) in enumerate(recs)], "ord bigint, title string, doi string, search_run string")
    groups = {}
    for i, (a, b) in enumerate(recs):
        k = tuple(sorted(re.sub("[^a-z]", "", x.lower()) for x in (a, b)))
        if any(k):
            groups.setdefault(k, []).append(i)
    want = sorted(((g[0], i) for g in groups.values() for i in g[1:]), key=str)
    assert rows(formatting_copies.find_copies(df, "ord", ["title", "doi", "search_run"], ["title", "doi"])) == want


# --- encoding -------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def reference():
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(VOCAB, "rb"))}
    return tiktoken.Encoding("own", pat_str=encode.PATTERN, mergeable_ranks=ranks, special_tokens={})


@given(st.lists(st.text(max_size=80), max_size=6))
@settings(max_examples=60, deadline=None)
def test_encoding_equals_reference(reference, texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    got = [x.tolist() for x in encode.Encoder(VOCAB).encode(texts)]
    assert got == [reference.encode_ordinary(t) for t in texts]


@given(st.lists(st.text(alphabet="abcdeé-= ", min_size=1, max_size=400), min_size=1, max_size=4))
@settings(max_examples=60, deadline=None)
def test_pieces_of_every_length(reference, pieces):
    """Pieces that the pattern would cut are encoded as one, with merges that overlap."""
    got = encode.encode_pieces([p.encode() for p in pieces], encode.vocabulary(VOCAB))
    whole = tiktoken_whole(reference)
    assert [x.tolist() for x in got] == [whole.encode_ordinary(p) for p in pieces]


def tiktoken_whole(reference):
    import tiktoken

    return tiktoken.Encoding("whole", pat_str=r"[\s\S]+", mergeable_ranks=reference._mergeable_ranks, special_tokens={})


def test_encoding_odd_texts(spark, reference):
    rng = random.Random(1)
    texts = ["", " ", "\n\n", "-" * 500, "a" * 3000, "".join(rng.choice("abcé日🎉") for _ in range(4000)), "Wort " * 20000, "<|endoftext|>", "x", "x"]
    df = spark.createDataFrame([(i, t, "ids") for i, t in enumerate(texts)] + [(98, None, "x"), (None, "x", "x")], "doc_id bigint, text string, ids string")
    got = {r["doc_id"]: r["ids"] for r in encode.encode_corpus(df, "doc_id", "text").collect()}
    assert all(got[i] == reference.encode_ordinary(t) for i, t in enumerate(texts))
    assert got[98] == [] and got[0] == [] and len(got[None]) == 1
    n = {r["doc_id"]: r["n_tokens"] for r in encode.token_counts(df, "doc_id", "text").collect()}
    assert all(n[k] == len(v) for k, v in got.items())
    assert encode.encode_corpus(df.limit(0), "doc_id", "text").count() == 0


# --- containers -----------------------------------------------------------------------------------


def best_fit_decreasing(hist, cap):
    """Containers that best fit decreasing opens, item by item."""
    rooms = []
    for s in sorted(hist, reverse=True):
        for _ in range(hist[s]):
            fits = [r for r in rooms if r >= s]
            if fits:
                rooms.remove(min(fits))
            rooms.append((min(fits) if fits else cap) - s)
    return len(rooms)


@given(st.dictionaries(st.integers(1, 40), st.integers(1, 30), max_size=12), st.integers(1, 40))
@example({13: 13}, 25)
@settings(max_examples=300, deadline=None)
def test_plan_places_everything(hist, cap):
    hist = {s: c for s, c in hist.items() if s <= cap}
    patterns, n = pack.plan(hist, cap)
    placed = {}
    for times, use in patterns:
        assert times > 0 and sum(s * k for s, k in use.items()) <= cap
        for s, k in use.items():
            placed[s] = placed.get(s, 0) + times * k
    assert placed == hist and n == sum(t for t, _ in patterns)
    assert n == best_fit_decreasing(hist, cap)


def test_pack(spark):
    rng = random.Random(3)
    sizes = [(i, rng.choice([0, 1, 5, 7, 7, 7, 50, 99, 100, 101, 250, 333])) for i in range(2000)] + [(5, 7), (None, 3), (2001, None)]
    df = spark.createDataFrame(sizes, "id bigint, n bigint").withColumn("k", F.lit("clash"))
    out = pack.pack_items(df, "id", "n", 100).cache()
    fill = {r["container_no"]: r["t"] for r in out.groupBy("container_no").agg(F.sum("n_tokens").alias("t")).collect()}
    assert max(fill.values()) <= 100 and min(fill) == 1
    assert sum(fill.values()) == sum(n or 0 for _, n in sizes)
    per = {r["id"]: (r["t"], r["p"], r["np"]) for r in out.groupBy("id").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("p"), F.max("n_parts").alias("np")).collect()}
    for i, n in sizes[:2000]:
        if i != 5:
            assert per[i] == (n, max(1, -(-n // 100)), max(1, -(-n // 100)))
    assert per[5][1] == 2 + (dict(sizes[:2000])[5] > 100) * 0 or per[5][1] >= 2
    assert out.where("n_parts = 1 AND n_tokens > 100").count() == 0
    f = pack.container_fill(out, 100).collect()[0]
    assert f["fill"] > 0.95 and f["n_containers"] >= f["least_possible"]
    assert pack.pack_items(df.limit(0), "id", "n", 100).count() == 0


# --- consensus ------------------------------------------------------------------------------------


def made_ratings(spark, n=400, seed=2):
    rng = random.Random(seed)
    skill = {"good": 0.95, "fair": 0.8, "poor": 0.45, "liar": 0.1, "ok": 0.75}
    truth, out = {}, []
    for i in range(n):
        truth[i] = rng.choice("abc")
        for c, s in skill.items():
            if rng.random() < 0.8:
                out.append(("v", str(i), c, truth[i] if rng.random() < s else rng.choice([x for x in "abc" if x != truth[i]])))
    return truth, out


def test_consensus_finds_truth_and_liars(spark):
    truth, data = made_ratings(spark)
    odd = [("v", "x", "good", "zzz"), ("v", None, "good", "a"), ("v", "y", None, "a"), ("v", "z", "good", None), ("w", "q", "good", "a")]
    df = spark.createDataFrame(data + odd, "variable string, item string, coder string, label string").withColumn("n", F.lit("clash"))
    items, coders, n_rounds, change = consensus.fit_consensus(df, {"v": ["a", "b", "c"]})
    assert n_rounds < 500 and change < 1e-3
    got = {r["item"]: r for r in items.collect()}
    right = sum(got[str(i)]["label"] == t for i, t in truth.items() if str(i) in got)
    assert right / len(truth) > 0.9 and "x" not in got and "q" not in got
    rel = {r["coder"]: r for r in coders.collect()}
    assert rel["good"]["reliability"] > rel["fair"]["reliability"] > rel["poor"]["reliability"] > rel["liar"]["reliability"]
    assert all(r["low"] < r["reliability"] < r["high"] for r in rel.values())
    empty_items, empty_coders, *_ = consensus.fit_consensus(df.limit(0), {"v": ["a", "b"]}, rounds=2)
    assert empty_items.count() == 0 and empty_coders.count() == 0


def test_consensus_of_many_coders_stays_distributed(spark):
    """Beyond the bound of the broadcast the fit is the same."""
    _, data = made_ratings(spark, 60)
    df = spark.createDataFrame(data, "variable string, item string, coder string, label string")
    a, b = (consensus.fit_consensus(df, {"v": ["a", "b", "c"]}, rounds=3, broadcast_rows=n) for n in (10_000, 0))
    for x, y, keys in ((a.items, b.items, ["item"]), (a.coders, b.coders, ["coder"])):
        x, y = (z.orderBy(*keys).toPandas() for z in (x, y))
        assert all(np.allclose(x[c], y[c]) if x[c].dtype == float else (x[c] == y[c]).all() for c in x.columns)
    assert a.rounds == b.rounds and a.change == pytest.approx(b.change)


def test_reliability_is_weighted_by_class(spark):
    """A coder who always says the frequent class is right as often as that class comes up, not more."""
    data = [("v", str(i), c, "a" if i % 10 or c == "lazy" else "b") for i in range(400) for c in ("one", "two", "lazy")]
    got = {r["coder"]: r for r in consensus.fit_consensus(spark.createDataFrame(data, "variable string, item string, coder string, label string"), {"v": ["a", "b"]}).coders.collect()}
    assert got["lazy"]["reliability"] == pytest.approx(0.9, abs=0.02) and got["one"]["reliability"] > 0.97


def test_beta_interval():
    # quantiles of beta(2, 3) and of beta(0.5, 0.5), known in closed form
    assert np.allclose(consensus.beta_interval(0.4, 0.04), (0.0676, 0.8059), atol=2e-4)
    assert np.allclose(consensus.beta_interval(0.5, 0.125), (np.sin(np.pi * 0.0125) ** 2, np.sin(np.pi * 0.4875) ** 2), atol=1e-4)


def test_digamma():
    assert np.allclose(consensus.digamma(np.array([1.0, 0.5, 10.0])), [-0.5772156649, -1.9635100260, 2.2517525890], atol=1e-8)


def test_krippendorff_against_pairs(spark):
    _, data = made_ratings(spark, 60)
    by = {}
    for _, i, _, x in data:
        by.setdefault(i, []).append(x)
    units = [v for v in by.values() if len(v) > 1]
    n = sum(map(len, units))
    seen = sum(sum(a != b for j, a in enumerate(v) for k, b in enumerate(v) if j != k) / (len(v) - 1) for v in units)
    flat = [x for v in units for x in v]
    chance = sum(a != b for a in flat for b in flat) / (n - 1)
    got = consensus.krippendorff(spark.createDataFrame(data, "variable string, item string, coder string, label string")).collect()[0]
    assert got["alpha"] == pytest.approx(1 - seen / chance) and got["n_items"] == len(units)


# --- languages ------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def machines(spark, data):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    return language.train(docs, "doc_id", "text", "lang")


def test_sentences():
    assert language.sentences("Am 2. November gilt es. Im Jahr 1999. Dann nicht.\nEnde") == ["Am 2. November gilt es.", "Im Jahr 1999.", "Dann nicht.", "Ende"]
    assert language.sentences(None) == [] and language.sentences(" \n12 - 3") == []


def test_languages(spark, machines):
    de, en, fr = "Die Behörde entscheidet über den Antrag der Versicherten.", "The authority decides on the claim of the insured person.", "La caisse peut accorder un délai supplémentaire aux assurés."
    data = [
        (1, de, "de"), (2, de, "en"), (3, en, None), (4, f"{de} {de} {fr} {en} {en}", "de"), (5, None, "de"), (6, "", "en"), (7, " \n", None), (8, "12 / 3", "de"), (9, de * 500, "DE"), (2, de, "en"), (None, de, "fr"),
        (10, "The Kurzarbeitergeld scheme is often taken as a benchmark for comparison.", "en"),
    ]
    df = spark.createDataFrame(data, "doc_id bigint, text string, lang string").withColumn("k", F.lit(1)).withColumn("seg_no", F.lit("x"))
    got = rows(language.wrong_or_mixed(df, "doc_id", "text", "lang", machines).select("doc_id", "seg_no", "lang"))
    assert [r for r in got if r[0] == 4] == [(4, 1, "de"), (4, 2, "fr"), (4, 3, "en")]
    assert (3, 1, "en") in got and (9, 1, "de") in got and (2, 1, "de") in got
    assert not any(r[0] in (1, 5, 6, 7, 8, 10, None) for r in got)
    # repeated keys are told one by one, each by its own label
    assert got.count((2, 1, "de")) == 2
    twice = spark.createDataFrame([(1, f"{de} {de} {fr}", "de"), (1, f"{de} {de} {fr}", "fr"), (1, de, "de"), (1, de, None)], df.select("doc_id", "text", "lang").schema)
    again = rows(language.wrong_or_mixed(twice, "doc_id", "text", "lang", machines))
    assert sorted(again) == [(1, 1, "de")] * 3 + [(1, 2, "fr")] * 2
    conf = language.detect(df, "doc_id", "text", machines).select("confidence", "doc_confidence").collect()
    assert all(0 <= r[0] <= 1 and 0 <= r[1] <= 1 for r in conf)
    assert language.detect(df.limit(0), "doc_id", "text", machines).count() == 0


def test_only_the_chosen_family_is_asked(machines):
    """A language of another family scores its family's margin, which is negative; the best one is of the family chosen."""
    de, pt = machines.margins(["Die Behörde entscheidet über den Antrag.", "A autoridade decide sobre o pedido do segurado."])
    at = machines.langs.index
    assert machines.family_of[machines.langs[de.argmax()]] == "germanic" and machines.family_of[machines.langs[pt.argmax()]] == "romance"
    assert len({round(de[at(x)], 9) for x in ("es", "fr", "it", "pt")}) == 1 and de[at("fr")] < 0
    assert len({round(pt[at(x)], 9) for x in ("de", "en", "nl")}) == 1 and pt[at("de")] < 0


def test_held_out_accuracy(spark, machines):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("length(text) > 80 AND lang IN ('de', 'en', 'fr', 'es', 'it', 'nl', 'pt')")
    found = language.detect(docs, "doc_id", "text", machines).where("n_segments = 1").join(docs.select("doc_id", F.col("lang").alias("label")), "doc_id")
    ok = found.agg(F.avg((F.col("lang") == F.col("label")).cast("int"))).collect()[0][0]
    assert ok > 0.85  # some labels are wrong by design


# --- subjects -------------------------------------------------------------------------------------


def test_subjects(spark):
    tax = ["Der Grundfreibetrag der Einkommensteuer wird angehoben.", "Der Lohnsteuerabzug erfolgt nach der Tabelle.", "Das Finanzamt erhebt Vorauszahlungen der Steuer."]
    old = ["Die Altersrente wird jährlich angepasst.", "Der Rentenwert der Altersrente steigt.", "Die Regelaltersgrenze der Rente wird angehoben."]
    rng = random.Random(5)
    docs = [(f"t{i}", "Gesetz über Einkommensteuer", " ".join(rng.sample(tax, 3))) for i in range(12)] + [(f"o{i}", "Gesetz über Altersrente", " ".join(rng.sample(old, 3))) for i in range(12)]
    docs += [("mix", "Gesetz über Einkommensteuer", " ".join(tax[:2] + old[:2])), ("blank", "Gesetz über Altersrente", "  "), ("null", None, None), ("odd", "x", "12 34"), ("t0", "again", " ".join(tax)), (None, "x", tax[0])]
    df = spark.createDataFrame(docs, "id string, title string, full_text string").withColumn("s", F.lit(1)).withColumn("terms", F.lit("x"))
    seeds = spark.createDataFrame([("tax", 0, "Gesetz über Einkommensteuer"), ("old", 0, "Gesetz über Altersrente"), ("none", 0, "Gesetz über Schifffahrt"), (None, 1, "x")], "domain string, pos int, seed string")
    hand = spark.createDataFrame([("t1", "tax", "na"), ("o1", "old", None), ("o2", "unknown", None)], "id string, f1 string, f2 string")
    factors, coded = subjects.fit(df, seeds, hand, "id", "title", "full_text", rounds=4, free=1)
    got = {}
    for k, s in rows(subjects.assign(factors, coded, "none", "id")):
        got.setdefault(k, set()).add(s)
    assert got["t3"] == {"tax"} and got["o3"] == {"old"} and got["mix"] == {"tax", "old"} and got["odd"] == {"none"}
    assert "blank" not in got and "null" not in got and None not in got
    w = {r["k"]: r["w"] for r in subjects.mixtures(factors, coded).groupBy("k").agg(F.sum("weight").alias("w")).collect()}
    assert all(0.9 < x <= 1.0001 for k, x in w.items() if k != "t0") and 1.8 < w["t0"] <= 2.0001
    # without candidates from the mixtures there are no subjects, whatever the sentences say
    assert {s for _, s in rows(subjects.assign(factors, coded, "none", "id", candidate=1.1))} == {"none"}
    f0, c0 = subjects.fit(df.limit(0), seeds, hand, "id", "title", "full_text")
    assert subjects.assign(f0, c0, "none", "id").count() == 0


def test_subjects_agree_with_people(spark, data):
    d = "/root/testdata/sf0.01"
    found = q.p3_found(spark, d)
    hand = spark.read.parquet(f"{d}/policy_fields.parquet").select("id", F.col("social_policy_field_1").alias("subject"))
    hit = hand.join(found, ["id", "subject"], "left_semi").count()
    assert hit / hand.where("subject IS NOT NULL").count() > 0.8  # some assignments are wrong by design


# --- pairs ----------------------------------------------------------------------------------------


def test_pair_parts():
    assert all(pair_defects.is_empty(x) for x in (None, "", " ", "​", "n/a", "None", "{}", '""', "—", "TBD", "..."))
    assert not any(pair_defects.is_empty(x) for x in ("0", "no", "na so", "1990-01"))
    assert pair_defects.clauses('"A b. C d!"') == ["A b.", "C d!"] or pair_defects.clauses('"A b. C d!"') == ["A b.", "C d!"]
    assert pair_defects.frame("The act sets 12 months.") == "the act … 00 months"


def test_pair_defects(spark, data):
    d = "/root/testdata/sf0.01"
    pairs = q._pairs(spark, d)
    add = [
        (-1, "summary", "Give a summary.", "TITLE: Gesetz\nTEXT: Die Rente steigt.", None), (-2, "summary", "What does the following text regulate?", "TITLE: A\nTEXT: Die Rente steigt.", "What does the following text regulate?"),
        (-3, "summary", "Give a summary.", "TITLE: A\nTEXT: B", "I'm sorry, but I cannot help with that."), (-4, "summary", "Give a summary.", "TITLE: A\nTEXT: B", "La ley cambia la cuantía de las prestaciones para los trabajadores."),
        (-5, "summary", "Give a summary.", "TITLE: A\nTEXT: B", "The act restructures old-age pensions and gives the comp"), (-6, "crisis_ref", "Code 1 or 0.", "TITLE: A\nTEXT: B", "0.0"), (-7, "legally_effective", "Which month?", "TITLE: A\nTEXT: B", "05/1999"),
        (-8, "legally_effective", "Which month?", "TITLE: A\nTEXT: B", "März 1999"), (-9, "summary", "Give a summary.", "TITLE: A\nTEXT: B", "Adjusts child benefits. " * 3000), (-6, "crisis_ref", "Code 1 or 0.", "TITLE: A\nTEXT: B", "0.0"),
        (-10, "summary", "Give a summary.", "TITLE: A\nTEXT: B", "The act lets the authority decline to answer late requests concerning child benefits and requires a written notice."),
    ]
    # refusals in wordings that neither the made-up ones nor the corpus have, and one among sentences that answer
    held_out = [
        "I regret that I'm not in a position to give an answer here.", "Sorry, but as a language model I am unable to comment on legislation.", "I won't answer this, since I am not allowed to give legal opinions.",
        "Je regrette, mais je ne peux pas répondre à votre question.", "Es tut mir leid, das kann ich nicht beantworten.",
    ]
    add += [(-20 - i, "summary", "Give a summary.", "TITLE: A\nTEXT: B", v) for i, v in enumerate(held_out)]
    add += [(-30, "summary", "Give a summary.", "TITLE: A\nTEXT: B", "The act raises child benefits for families with three children. It changes the rates for the year 2009. I cannot help. It clarifies who may apply for the benefits.")]
    extra = spark.createDataFrame([(a, c, t, b, v) for a, b, c, t, v in add], "k bigint, question string, given string, variable string, value string")
    got = {r["entry_id"]: r["defect"] for r in pair_defects.pair_defects(pairs.unionByName(extra), "entry_id").where("entry_id < 0").collect()}
    print({k: v for k, v in got.items() if k <= -20})
    assert sum(got.pop(-20 - i, None) == "refusal" for i in range(len(held_out))) >= len(held_out) - 1
    assert got == {-1: "empty", -2: "echo", -3: "refusal", -4: "language", -5: "truncated", -8: "language"}
    assert pair_defects.pair_defects(pairs.limit(0), "entry_id").count() == 0


def test_pair_rows_of_unknown_prompts(spark):
    """Under a prompt key that names no variable the variables of the map are taken, so no entry is lost."""
    value = "struct<value: string, coder: string, date: string>"
    data = [(1, "ask TITLE: t", "v1_odd", {"summary": ("x", "m", "d")}, None), (2, "ask TITLE: t", None, None, None), (3, None, "single_b", None, None), (4, "q", "single_b", None, "failed"), (None, "q", "single_b", None, None)]
    df = spark.createDataFrame(data, f"entry_id bigint, prompt string, prompt_key string, m map<string, {value}>, err string")
    got = pair_defects.pair_rows(df, "entry_id", "prompt", "prompt_key", "m", "err", {"single_a": ["summary"], "single_b": ["flag", "summary"]}, "TITLE:")
    assert rows(got.select("k", "variable", "question", "value")) == sorted([(1, "summary", "ask ", "x"), (3, "flag", "", None), (3, "summary", "", None)])


def test_field_learns_its_training_set():
    rng = random.Random(1)
    rows_ = [("summary", "Give a summary. Be brief.", f"TITLE: Gesetz {i}\nTEXT: Die Beträge werden um {i} Euro erhöht.", f"The act raises the amounts by {i} euros for {rng.choice(['families', 'workers', 'pensioners'])}.") for i in range(400)]
    frames = {pair_defects.frame(c) for *_, v in rows_ for c in pair_defects.clauses(v)}
    xs, ys, _ = pair_defects.training_set(rows_, frames)
    m = pair_defects.Field()
    m.fit(xs, ys)
    right = sum((np.array(m.tag(x)) == y).sum() for x, y in zip(xs, ys))
    assert right / sum(map(len, ys)) > 0.93


# --- scanned text ---------------------------------------------------------------------------------


def brute(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, d[0] = d[0], i
        for j, y in enumerate(b, 1):
            prev, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, prev + (x != y))
    return d[-1]


@given(st.lists(st.text("abc", min_size=1, max_size=6), min_size=1, max_size=20, unique=True), st.text("abc", max_size=6), st.integers(1, 3))
@settings(max_examples=150, deadline=None)
def test_automaton_finds_all(words, w, most):
    got = sorted(scan_repair.Trie(words).within(w, most))
    assert got == sorted((v, brute(w, v)) for v in words if 0 < brute(w, v) <= most)


def test_changes():
    assert scan_repair.changes("Elterriteil", "Elternteil") == [(5, "ri", "n")]
    assert scan_repair.changes("bericlitet", "berichtet") == [(5, "li", "h")] or scan_repair.changes("bericlitet", "berichtet")
    assert [c[1:] for c in scan_repair.changes("Ge6iete0", "Gebieten")] == [("6", "b"), ("0", "n")]


def test_line_marks():
    assert all(scan_repair.is_page_number(x) for x in ("12", "- 12 -", "[333 ]", "   S. 7", "Seite l2"))
    assert not any(scan_repair.is_page_number(x) for x in ("2009.", "(3)", "§ 9", "12 Euro", ""))
    lines = ["Das Gesetz regelt Renten und Kin-", "dergeld für Aus- und", "Fortbildung der Bund-", "Länder-Kommission."]
    hyphens, tokens = scan_repair.walk(lines, ["text"] * 4)
    assert hyphens == [0] and "Kindergeld" in [t[0] for t in tokens]


def test_scan_repair(spark, data):
    d = "/root/testdata/sf0.01"
    base = spark.read.parquet(f"{d}/final_policy_set.parquet").select("id", "full_text")
    page = "Der Anspruch ruht während einer Sperrzeit von 12 Wochen, wenn das Beschäf-\n- 12 -\ntigungsverhältnis ohne wichtigen Grund gelöst wurdc. Die Kosten einer\nUmschulung werden übernommen, solange die betroffene Person ohne\nErwerb ist und die Teilnahme geeignet erscheint."
    odd = [("scan", page), ("null", None), ("empty", ""), ("blank", " \n "), ("long", "Das Nähere regelt das zuständige Ministerium. " * 3000), (None, page)]
    df = base.unionByName(spark.createDataFrame(odd, "id string, full_text string")).withColumn("k", F.lit(1)).withColumn("line_no", F.lit("x"))
    got = [r for r in rows(scan_repair.damaged_lines(df, "id", "full_text")) if r[0] in ("scan", "null", "empty", "blank", "long", None)]
    assert got == [("scan", 1, "hyphen"), ("scan", 2, "page_no"), ("scan", 3, "char")]
    text = {r["id"]: r["text"] for r in scan_repair.repair(df, "id", "full_text").where("id IN ('scan', 'empty', 'long')").collect()}
    assert "Beschäftigungsverhältnis ohne wichtigen Grund gelöst wurde. Die Kosten einer Umschulung" in text["scan"] and "12 -" not in text["scan"] and "\n" not in text["scan"]
    assert text["empty"] == "" and text["long"] == odd[4][1]
    assert scan_repair.damaged_lines(df.limit(0), "id", "full_text").count() == 0
