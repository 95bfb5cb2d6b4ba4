"""Queries and operators do the whole job, on small tables of their own."""

import math

import numpy as np

from tallyloom import queries as core
from tallyloom.operators import reliability, topics


def test_corrections_take_the_topic_of_their_parent(spark, tmp_path):
    docs = [
        ("v-2001-1-1", "Gesetz zur Sicherung der Renten und Beiträge", "2001-01-01"), ("v-2001-1-9", "Verordnung über die Mietzuschüsse", "2001-02-01"), ("v-2001-2-3", "Berichtigung: Gesetz zur Sicherung der Renten und Beiträge", "2001-03-01"),
        ("v-2001-2-4", "Anlage zur Verordnung über die Mietzuschüsse", "2001-03-02"), ("v-2001-2-5", "Berichtigung des Gesetzes zur Sicherung der Renten und Beiträge", "2000-12-31"),
    ]
    spark.createDataFrame(docs, "id string, title string, date_published string").write.parquet(f"{tmp_path}/final_policy_set.parquet")
    got = {r["id"]: r for r in core.Q["children_attached"](spark, str(tmp_path)).collect()}
    assert {i: (r["topic_source"], r["parent_id"]) for i, r in got.items()} == {
        "v-2001-1-1": ("cluster", None), "v-2001-1-9": ("cluster", None), "v-2001-2-3": ("parent", "v-2001-1-1"), "v-2001-2-4": ("parent", "v-2001-1-9"), "v-2001-2-5": ("transform", None),
    }
    assert got["v-2001-2-3"]["topic_id"] == got["v-2001-1-1"]["topic_id"] and got["v-2001-2-4"]["topic_id"] == got["v-2001-1-9"]["topic_id"]


def _brute_clusters(v, least, core_n, smallest):
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    near = u @ u.T >= least
    np.fill_diagonal(near, False)
    core_of = near.sum(axis=1) >= core_n
    label = np.where(core_of, np.arange(len(v)), -1)
    moved = True
    while moved:
        new = np.array([min([label[i], *label[near[i] & core_of]]) if core_of[i] else -1 for i in range(len(v))])
        moved, label = (new != label).any(), new
    for i in np.flatnonzero(~core_of & (near & core_of).any(axis=1)):
        j = np.flatnonzero(near[i] & core_of)
        label[i] = label[j[(u[j] @ u[i]).argmax()]]
    size = {c: (label == c).sum() for c in set(label)}
    return [int(c) if c >= 0 and size[c] >= smallest else -1 for c in label]


def test_density_clusters_miss_no_neighbour(spark):
    # cosines about the threshold of 0.55, at which a search in cells of planes loses many pairs
    rng = np.random.default_rng(5)
    centre = rng.standard_normal((4, 16))
    v = np.vstack([centre[i % 4] + 0.85 * rng.standard_normal(16) for i in range(160)])
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    want = {(i, j) for i, j in zip(*np.nonzero(u @ u.T >= 0.55)) if i != j}
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id int, v array<double>")
    near = topics.near_pairs(df.selectExpr("id AS k", "v"), 0.55, block=50)
    assert {(r["x"], r["y"]) for r in near.collect()} == want and near.count() == len(want)
    got = {r["id"]: r["cluster"] for r in topics.density_clusters(df, "id", "v", least=0.55, core=12, smallest=5).collect()}
    assert [got[i] for i in range(160)] == _brute_clusters(v, 0.55, 12, 5)


def test_density_clusters_take_zero_and_null_vectors(spark):
    df = spark.createDataFrame([(i, [1.0, 0.01 * i]) for i in range(6)] + [(6, [0.0, 0.0]), (7, None)], "id int, v array<double>")
    got = {r["id"]: r["cluster"] for r in topics.density_clusters(df, "id", "v", least=0.9, core=3, smallest=5, block=2).collect()}
    assert got == {**dict.fromkeys(range(6), 0), 6: -1}


def test_references_over_the_matrix_bound_are_compared_in_blocks(spark):
    v = [(i, [math.cos(i), math.sin(i)]) for i in range(40)] + [(40, [0.0, 0.0]), (41, None), (3, [1.0, 1.0])]
    df = spark.createDataFrame(v, "id int, v array<double>")
    refs = df.where("id % 5 = 0 AND id < 40")
    one = topics.max_similarity(df, "id", "v", refs, "id", "v")
    many = topics.max_similarity(df, "id", "v", refs, "id", "v", most=64)
    show = lambda x: sorted((r["id"], None if r["similarity"] is None else round(r["similarity"], 9), r["nearest"]) for r in x.collect() if r["id"] != 41)
    assert show(one) == show(many) and one.count() == many.count() == 43


def test_triage_reads_the_whole_table(spark, tmp_path):
    v = [(i, [1.0, 0.0] if i < 150 else [0.0, 1.0]) for i in range(300)]
    spark.createDataFrame(v, "vec_id int, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert core.Q["similarity_triage_whole"](spark, str(tmp_path)).where("bucket = 'auto'").count() == 300
    assert core.Q["triage_applied_whole"](spark, str(tmp_path)).count() == 300


def test_confusion_has_every_model_with_its_best_prompt(spark, data):
    got = core.Q["confusion_by_model"](spark, data).collect()
    runs = {(r["model"], r["prompt_key"]) for r in got}
    scored = core._macro(spark, data).where("macro_f1 IS NOT NULL").collect()
    assert {m for m, _ in runs} == {r["model"] for r in scored} and len(runs) == len({m for m, _ in runs}) > 1
    assert runs == {(r["model"], r["prompt_key"]) for r in core.Q["best_prompt"](spark, data).collect()}


def test_agreement_of_every_pair_of_coders(spark):
    r = spark.createDataFrame([("v", u, c, x) for u, c, x in [(1, "a", "1"), (1, "b", "1"), (2, "a", "1"), (2, "b", "0"), (2, "c", "0"), (3, "c", "1"), (3, "a", None)]], "variable string, unit int, coder string, value string")
    assert sorted(tuple(x) for x in reliability.pair_agreement(r).collect()) == [("v", "a", "b", 2, 0.5), ("v", "a", "c", 1, 0.0), ("v", "b", "c", 1, 1.0)]
