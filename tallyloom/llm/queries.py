"""Queries of the operators for training data, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions.labels import FIELDS
from tallyloom.llm import subjects
from tallyloom.llm.consensus import collapse_ratings, fit_consensus, krippendorff
from tallyloom.llm.encode import encode_corpus
from tallyloom.llm.formatting_copies import collapse_copies, find_copies
from tallyloom.llm.language import detect, train, wrong_or_mixed
from tallyloom.llm.pair_defects import pair_defects, pair_rows
from tallyloom.llm.scan_repair import damaged_lines, repair
from tallyloom.llm.pack import container_fill, pack_corpus


Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# --- problem 6: duplicates hidden by formatting ----------------------------------------------------

_BARE_SQL = r"""regexp_replace(regexp_replace(lower({c}), '^[\s\p{{Z}}]*(?:(?:https?://)?(?:dx\.)?doi\.[a-z]+/|doi[\s\p{{Z}}]*:?[\s\p{{Z}}]*|info:doi/)(10\.[0-9])', '\1'), '[^\p{{L}}\p{{N}}\p{{M}}]+', '', 'g')"""
_P6_KEYS_SQL = f"""
WITH bare AS (SELECT ord, {_BARE_SQL.format(c="title")} AS t, {_BARE_SQL.format(c="doi")} AS i, {_BARE_SQL.format(c="search_run")} AS s FROM biblio),
keyed AS (SELECT ord, list_sort([coalesce('+' || t, '-'), coalesce('+' || i, '-'), coalesce('+' || s, '-')]) AS k FROM bare
  WHERE coalesce(t, '') <> '' OR coalesce(i, '') <> ''),
grouped AS (SELECT ord, min(ord) OVER (PARTITION BY k) AS first_ord, count(*) OVER (PARTITION BY k) AS n FROM keyed)
"""


@query("p6_found", _P6_KEYS_SQL + "SELECT first_ord, ord AS copy_ord FROM grouped WHERE ord > first_ord")
def p6_found(spark, d):
    return find_copies(table(spark, d, "biblio"), "ord", ["title", "doi", "search_run"], ["title", "doi"])


@query(
    "p6_records",
    _P6_KEYS_SQL
    + """SELECT b.ord, b.title, b.doi, b.search_run, coalesce(n - 1, 0)::BIGINT AS n_copies FROM biblio b LEFT JOIN grouped g USING (ord)
  WHERE g.first_ord IS NULL OR g.first_ord = b.ord""",
)
def p6_records(spark, d):
    """The table with its copies collapsed, and how many each record had."""
    return collapse_copies(table(spark, d, "biblio"), "ord", ["title", "doi", "search_run"], ["title", "doi"]).select("ord", "title", "doi", "search_run", "n_copies")


# --- problem 7: the corpus as token ids -----------------------------------------------------------


@query("p7_ids")
def p7_ids(spark, d):
    return encode_corpus(table(spark, d, "documents"), "doc_id", "text")


# --- problem 8: containers of fixed capacity ------------------------------------------------------


@query("p8_containers")
def p8_containers(spark, d):
    return pack_corpus(table(spark, d, "documents"), "doc_id", "text", 2048)


@query("p8_fill")
def p8_fill(spark, d):
    return container_fill(pack_corpus(table(spark, d, "documents"), "doc_id", "text", 2048), 2048)


# --- problem 5: consensus of annotators -----------------------------------------------------------

# fixed values: spellings of yes and no
YES = ["1", "1.0", "true", "yes", "y", "t", "ja", "wahr", "oui", "sí", "si", "sì", "sim", "vrai"]
NO = ["0", "0.0", "false", "no", "n", "f", "nein", "falsch", "non", "nee", "não", "faux"]


def spelled_label(variable, value):
    """The class that a value names in any spelling, else null."""
    tidy = F.regexp_replace(F.regexp_replace(F.lower(value), r"[\s\p{Z}\p{C}]+", " "), r"^[ \"'.]+|[ \"'.]+$", "")
    field = F.regexp_replace(tidy, r" ?/ ?", "/")
    flag = F.when(tidy.isin(YES), "1").when(tidy.isin(NO), "0")
    return F.when(variable == "crisis_ref", flag).when(field.isin(FIELDS), field)


def ratings(spark, d):
    variables = ["social_policy_field_1", "crisis_ref"]
    people = collapse_ratings(table(spark, d, "gold"), "id", "gold_row", "gs_labels", variables, True)
    models = collapse_ratings(table(spark, d, "run_entries"), "id", "entry_id", "llm_labels", variables, False)
    both = people.unionByName(models)
    return both.select("variable", "item", "coder", spelled_label(F.col("variable"), F.col("value")).alias("label"))


_CLASSES = {"social_policy_field_1": FIELDS, "crisis_ref": ["0", "1"]}


@query("p5_found")
def p5_found(spark, d):
    return fit_consensus(ratings(spark, d), _CLASSES).items.where("n_coders >= 2").select(F.col("item").alias("id"), "variable", "label")


@query("p5_reliability")
def p5_reliability(spark, d):
    return fit_consensus(ratings(spark, d), _CLASSES).coders


_YES_SQL = ", ".join(f"'{x}'" for x in YES)
_NO_SQL = ", ".join(f"'{x}'" for x in NO)
_FIELDS_SQL = ", ".join(f"'{x}'" for x in FIELDS)
_RATINGS_SQL = f"""
WITH people AS (SELECT DISTINCT id AS item, gs_labels AS m FROM gold WHERE gs_labels IS NOT NULL),
maps AS (SELECT item, m FROM people UNION ALL SELECT id, llm_labels FROM run_entries WHERE llm_labels IS NOT NULL),
long AS (SELECT 'social_policy_field_1' AS variable, item, m['social_policy_field_1'] AS x FROM maps
  UNION ALL SELECT 'crisis_ref', item, m['crisis_ref'] FROM maps),
tidy AS (SELECT variable, item, x.coder AS coder, regexp_replace(regexp_replace(lower(x.value), '[\\s\\p{{Z}}\\p{{C}}]+', ' ', 'g'), '^[ "''.]+|[ "''.]+$', '', 'g') AS v FROM long WHERE x.value IS NOT NULL),
ratings AS (SELECT variable, item, coder, CASE WHEN variable = 'crisis_ref' THEN CASE WHEN v IN ({_YES_SQL}) THEN '1' WHEN v IN ({_NO_SQL}) THEN '0' END
  WHEN regexp_replace(v, ' ?/ ?', '/', 'g') IN ({_FIELDS_SQL}) THEN regexp_replace(v, ' ?/ ?', '/', 'g') END AS label FROM tidy)
"""


@query(
    "p5_agreement",
    _RATINGS_SQL
    + """, t AS (SELECT variable, item, label, count(*)::DOUBLE AS n FROM ratings WHERE label IS NOT NULL AND coder IS NOT NULL AND item IS NOT NULL GROUP BY ALL),
i AS (SELECT variable, item, sum(n) AS m, sum(n * n) AS same FROM t GROUP BY ALL HAVING sum(n) > 1),
seen AS (SELECT variable, count(*)::BIGINT AS n_items, sum(m) AS n, sum((m * m - same) / (m - 1)) AS d FROM i GROUP BY ALL),
c AS (SELECT variable, label, sum(n) AS c FROM t SEMI JOIN i USING (variable, item) GROUP BY ALL),
cc AS (SELECT variable, sum(c * c) AS cc FROM c GROUP BY ALL)
SELECT variable, n_items, n::BIGINT AS n_labels, round(1 - d / ((n * n - cc) / (n - 1)), 6) AS alpha FROM seen JOIN cc USING (variable)""",
)
def p5_agreement(spark, d):
    return krippendorff(ratings(spark, d)).withColumn("alpha", F.round("alpha", 6))


# --- problem 9: document languages ----------------------------------------------------------------


def _machines(docs):
    return train(docs, "doc_id", "text", "lang")


@query("p9_found")
def p9_found(spark, d):
    docs = table(spark, d, "documents")
    return wrong_or_mixed(docs, "doc_id", "text", "lang", _machines(docs))


@query("p9_segments")
def p9_segments(spark, d):
    """Language and confidence of every segment of every document, and of the document."""
    docs = table(spark, d, "documents")
    return detect(docs, "doc_id", "text", _machines(docs))


# --- problem 3: subject areas ---------------------------------------------------------------------


def _subjects(spark, d):
    policies = table(spark, d, "final_policy_set")
    return subjects.fit(policies, table(spark, d, "seeds"), table(spark, d, "policy_fields"), "id", "title", "full_text")


@query("p3_found")
def p3_found(spark, d):
    return subjects.assign(*_subjects(spark, d), "none", "id")


@query("p3_mixture")
def p3_mixture(spark, d):
    """The subject mixture of every policy: rows of W."""
    return subjects.mixtures(*_subjects(spark, d)).select(F.col("k").alias("id"), "subject", F.round("weight", 4).alias("weight"))


@query("p3_composition")
def p3_composition(spark, d):
    """How much of the corpus each subject has: policies and their share."""
    found = subjects.assign(*_subjects(spark, d), "none", "id")
    per = found.groupBy("subject").agg(F.count("*").alias("n_policies"))
    total = found.agg(F.count_distinct("id").alias("n"))
    return per.join(F.broadcast(total)).select("subject", "n_policies", F.round(F.col("n_policies") / F.col("n"), 6).alias("share"))


# --- problem 1: broken prompt and response pairs --------------------------------------------------

_ASKED = {
    "batch": ["summary", "legally_effective", "crisis_ref"],
    "single_summary": ["summary"],
    "single_effective": ["legally_effective"],
    "single_crisis": ["crisis_ref"],
}


def _pairs(spark, d):
    return pair_rows(table(spark, d, "run_entries"), "entry_id", "prompt", "prompt_key", "llm_labels", "llm_error", _ASKED, "TITLE:")


@query("p1_found")
def p1_found(spark, d):
    return pair_defects(_pairs(spark, d), "entry_id")


@query("p1_by_model")
def p1_by_model(spark, d):
    """Defects by model: how many of each type, and their share of the asked answers."""
    runs = table(spark, d, "run_entries").select("entry_id", "model")
    asked = _pairs(spark, d).join(runs, F.col("k") == F.col("entry_id")).groupBy("model").agg(F.count("*").alias("n_asked"))
    found = pair_defects(_pairs(spark, d), "entry_id").join(runs, "entry_id").groupBy("model", "defect").agg(F.count("*").alias("n_defects"))
    return found.join(asked, "model").select("model", "defect", "n_defects", "n_asked", F.round(F.col("n_defects") / F.col("n_asked"), 6).alias("share"))


# --- problem 2: text from scanned pages -----------------------------------------------------------


@query("p2_found")
def p2_found(spark, d):
    return damaged_lines(table(spark, d, "final_policy_set"), "id", "full_text")


@query("p2_text")
def p2_text(spark, d):
    """The texts as continuous paragraphs."""
    return repair(table(spark, d, "final_policy_set"), "id", "full_text")
