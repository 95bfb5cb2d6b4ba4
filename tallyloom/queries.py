"""Queries of the core operators over the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions import dates, vectors
from tallyloom.functions import labels as L
from tallyloom.functions import text as T
from tallyloom.operators import aggregate, dedup, evaluate, joins, reliability, sample, sets, topics, windows
from tallyloom.operators.aggregate import value_counts
from tallyloom.operators.joins import pooled_union
from tallyloom.operators.unpack import unpack_fields
from tallyloom.plans import coverage, extraction, labelling, literature, selection
from tallyloom.sources import files

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


# --- problem 4: several values packed in one field ------------------------------------------------

_VALUES_SQL = r"""
regexp_extract_all(regexp_replace(s, '([0-9][a-z]?) (?:und|sowie|u\.|&) ([0-9]+-)', '\1; \2', 'g'),
  '"[0-9]{1,4}(?:-[0-9]+)+[a-z]? [\p{L}§][^"]*(?:""[^"]*)*"|''[0-9]{1,4}(?:-[0-9]+)+[a-z]? [\p{L}§][^'']*''|[„“«»][0-9]{1,4}(?:-[0-9]+)+[a-z]? [\p{L}§][^„“”«»]*[“”»«]|[0-9]{1,4}(?:-[0-9]+)+[a-z]?')
"""

_P4_SQL = rf"""
WITH parts AS (
  SELECT page_row, 'fna_raw' AS field_name, 1::BIGINT AS ord, fna_raw AS s FROM page_metadata
  UNION ALL
  SELECT page_row, 'fna_codes', i, fna_codes[i] FROM page_metadata, unnest(range(1, coalesce(len(fna_codes), 0) + 1)) t(i)
), vals AS (SELECT page_row, field_name, ord, {_VALUES_SQL} AS v FROM parts WHERE s IS NOT NULL),
flat AS (SELECT page_row, field_name, ord, i, v[i] AS raw FROM vals, unnest(range(1, len(v) + 1)) t(i))
SELECT page_row, field_name, row_number() OVER (PARTITION BY page_row, field_name ORDER BY ord, i)::BIGINT AS pos,
  replace(regexp_replace(regexp_replace(raw, '^["''„“”«»]', ''), '["''„“”«»]$', ''), '""', '"') AS value
FROM flat
"""


@query("p4_found", _P4_SQL)
def p4_found(spark, d):
    return unpack_fields(table(spark, d, "page_metadata"), "page_row", ["fna_raw", "fna_codes"])


@query(
    "p4_values_per_row",
    rf"""SELECT field_name, n_values, count(*)::BIGINT AS n_rows FROM (
      SELECT page_row, field_name, max(pos) AS n_values FROM ({_P4_SQL}) GROUP BY ALL) GROUP BY ALL""",
)
def p4_values_per_row(spark, d):
    """How many values the fields hold: rows by number of values."""
    found = unpack_fields(table(spark, d, "page_metadata"), "page_row", ["fna_raw", "fna_codes"])
    return found.groupBy("page_row", "field_name").agg(F.max("pos").alias("n_values")).groupBy("field_name", "n_values").agg(F.count("*").alias("n_rows"))


# --- sources, projections, text functions -----------------------------------------------------------


@query("title_keys", "SELECT ord, lower(regexp_replace(title, '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g')) AS key FROM biblio")
def title_keys(spark, d):
    return table(spark, d, "biblio").select("ord", T.normal_key(F.col("title")).alias("key"))


@query("page_split", "SELECT ord, nullif(pagestart || '-' || pageend, '-') AS pages, split_part(pagestart || '-' || pageend, '-', 1) AS first_page, nullif(split_part(pagestart || '-' || pageend, '-', 2), '') AS last_page FROM biblio WHERE pagestart IS NOT NULL AND pageend IS NOT NULL")
def page_split(spark, d):
    b = table(spark, d, "biblio").where("pagestart IS NOT NULL AND pageend IS NOT NULL").select("ord", F.concat_ws("-", "pagestart", "pageend").alias("pages"))
    s = literature.split_pages(b, "pages")
    return s.select("ord", F.nullif("pages", F.lit("-")).alias("pages"), F.col("pagestart").alias("first_page"), F.nullif(F.col("pageend"), F.lit("")).alias("last_page"))


@query("concat_texts", "SELECT ord, coalesce(title, '') || ' ' || coalesce(abstract, '') AS text FROM biblio")
def concat_texts(spark, d):
    return table(spark, d, "biblio").select("ord", T.concat_texts(F.col("title"), F.col("abstract")).alias("text"))


@query("document_types", "SELECT id, CASE WHEN contains(lower(title), 'gesetz') THEN 'law' WHEN contains(lower(title), 'verordnung') THEN 'ordinance' WHEN contains(lower(title), 'bekanntmachung') THEN 'notice' ELSE 'other' END AS kind FROM final_policy_set")
def document_types(spark, d):
    return table(spark, d, "final_policy_set").select("id", T.by_keyword(F.col("title"), [("gesetz", "law"), ("verordnung", "ordinance"), ("bekanntmachung", "notice")], "other").alias("kind"))


@query("dates_normalised", "SELECT page_row, coalesce(strftime(try_strptime(date_law, '%d.%m.%Y'), '%Y-%m-%d'), date_law) AS iso, substr(date_published, 1, 10) || 'T00:00:00Z' AS published_z FROM page_metadata")
def dates_normalised(spark, d):
    return table(spark, d, "page_metadata").select("page_row", dates.german_date(F.col("date_law")).alias("iso"), dates.iso_z(F.col("date_published")).alias("published_z"))


@query("years_of_dates", "SELECT id, year(try_strptime(substr(date_published, 1, 10), '%Y-%m-%d'))::INT AS y, coalesce(regexp_matches(date_published, '^[0-9]{4}-(0[1-9]|1[0-2])$'), false) AS is_month FROM final_policy_set")
def years_of_dates(spark, d):
    return table(spark, d, "final_policy_set").select("id", dates.year_of(F.col("date_published")).alias("y"), dates.is_month(F.col("date_published")).alias("is_month"))


@query("area_codes", "SELECT page_row, list_distinct_ordered AS codes FROM (SELECT page_row, list_filter(c, lambda x, i: list_position(c, x) = i) AS list_distinct_ordered FROM (SELECT page_row, regexp_extract_all(fna_raw, '([0-9]{1,4}(?:-[0-9]+)+[a-z]?)', 1) AS c FROM page_metadata WHERE fna_raw IS NOT NULL))")
def area_codes(spark, d):
    return table(spark, d, "page_metadata").where("fna_raw IS NOT NULL").select("page_row", T.area_codes(F.col("fna_raw")).alias("codes"))


@query("code_matches", "SELECT page_row, CASE WHEN coalesce(len(fna_codes), 0) = 0 THEN false ELSE coalesce(len(list_filter(fna_codes, lambda c: starts_with(c, '8') OR split_part(c, '-', 1) IN ('610', '611'))) > 0, false) END AS is_match FROM page_metadata")
def code_matches(spark, d):
    return table(spark, d, "page_metadata").select("page_row", T.matches_code(F.col("fna_codes"), "8", ["610", "611"]).alias("is_match"))


@query("issue_numbers", "SELECT page_row, CASE WHEN regexp_matches(issue_number, '^[0-9]{1,2}[a-zA-Z]?$') THEN lpad(regexp_extract(issue_number, '^([0-9]+)', 1), 3, '0') || regexp_extract(issue_number, '([a-zA-Z]?)$', 1) ELSE issue_number END AS padded, coalesce(try_cast(regexp_extract(issue_number, '^([0-9]+)', 1) AS INT), 0) AS n FROM page_metadata")
def issue_numbers(spark, d):
    p = table(spark, d, "page_metadata")
    return p.select("page_row", T.padded_number(F.col("issue_number")).alias("padded"), T.split_key(F.concat_ws("/", F.col("year").cast("string"), "issue_number"))["n"].alias("n"))


@query("word_counts", "SELECT doc_id, len(list_filter(regexp_split_to_array(text, '[\\s\\p{Z}]+'), lambda w: w <> ''))::INT AS words FROM documents WHERE text IS NOT NULL")
def word_counts(spark, d):
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", T.word_count(F.col("text")).alias("words"))


@query("token_counts", "SELECT token, count(*)::BIGINT AS n FROM (SELECT unnest(regexp_extract_all(regexp_replace(text, '(?i)<br\\s*/?>', ' ', 'g'), '([\\p{L}\\p{N}_]+)', 1)) AS token FROM documents) GROUP BY token")
def token_counts(spark, d):
    t = table(spark, d, "documents").select(F.explode(T.tokens(F.col("text"))).alias("token"))
    return value_counts(t, "token")


@query("file_slugs", "SELECT id, coalesce(nullif(regexp_replace(regexp_replace(replace(replace(replace(replace(lower(title), 'ä', 'ae'), 'ö', 'oe'), 'ü', 'ue'), 'ß', 'ss'), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), ''), 'document') AS slug FROM final_policy_set WHERE title IS NOT NULL")
def file_slugs(spark, d):
    return table(spark, d, "final_policy_set").where("title IS NOT NULL").select("id", T.file_slug(F.col("title")).alias("slug"))


@query("short_titles", "SELECT id, CASE WHEN length(t) <= 40 THEN t ELSE substr(t, 1, 39) || '…' END AS short FROM (SELECT id, regexp_replace(regexp_replace(title, '[\\s\\p{Z}]+', ' ', 'g'), '^ | $', '', 'g') AS t FROM final_policy_set)")
def short_titles(spark, d):
    return table(spark, d, "final_policy_set").select("id", T.shorten(F.col("title"), 40).alias("short"))


@query("filled_templates", "SELECT id, 'TITLE: ' || coalesce(title, '') || ' (' || coalesce(substr(date_published, 1, 10), '') || ')' AS prompt FROM final_policy_set")
def filled_templates(spark, d):
    p = table(spark, d, "final_policy_set")
    return p.select("id", T.fill_template(F.lit("TITLE: {title} ({date})"), {"title": F.col("title"), "date": dates.day(F.col("date_published"))}).alias("prompt"))


@query("titles_cleaned")
def titles_cleaned(spark, d):
    p = table(spark, d, "final_policy_set")
    return p.select("id", T.clean_title(F.col("title")).alias("clean"), T.document_class(F.col("title")).alias("doc_class"), T.referenced_title(F.col("title")).alias("referenced"))


@query("topic_texts")
def topic_texts(spark, d):
    return selection.prepare_topic_text(table(spark, d, "final_policy_set"), "id", "title", "full_text")


@query("unicode_report", "SELECT id, coalesce(regexp_matches(full_text, '[äöüßÄÖÜ]'), false) AS has_umlaut, coalesce(nfc_normalize(full_text) <> full_text, false) AS nfc_changes, coalesce(contains(full_text, '�'), false) AS has_replacement FROM final_policy_set")
def unicode_report(spark, d):
    r = table(spark, d, "final_policy_set").select("id", T.unicode_report(F.col("full_text")).alias("r"))
    return r.select("id", "r.has_umlaut", "r.nfc_changes", "r.has_replacement")


@query("policy_entries", """SELECT 'vbl1-' || year || coalesce('-' || issue_number, '') || '-1' AS id, year, issue_number, 1 AS order_in_issue, regexp_replace(title, '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g') AS title, doc_type,
  substr(date_published, 1, 10) || 'T00:00:00Z' AS date_published, substr(date_law, 1, 10) || 'T00:00:00Z' AS date_law, url_web, url_pdfs[1] AS url_pdf, 'pages' AS system_sources FROM page_metadata WHERE year IS NOT NULL""")
def policy_entries(spark, d):
    return extraction.to_policy_entry(table(spark, d, "page_metadata").where("year IS NOT NULL"))


# --- deduplication ------------------------------------------------------------------------------------


@query("dedup_naive", """WITH a AS (SELECT ord, doi, title_normalized, coalesce(is_globalsouth, false) AS p FROM biblio),
one AS (SELECT * FROM (SELECT ord, doi, title_normalized, p::INT AS p, row_number() OVER (PARTITION BY doi ORDER BY p DESC, ord) AS r FROM a WHERE doi IS NOT NULL) WHERE r = 1),
b AS (SELECT ord, doi, title_normalized, CASE WHEN p = 1 THEN 0 ELSE 1 END AS q FROM one UNION ALL SELECT ord, NULL, title_normalized, 2 FROM a WHERE doi IS NULL)
SELECT ord, doi, title_normalized FROM (SELECT *, row_number() OVER (PARTITION BY title_normalized ORDER BY doi IS NULL, q, ord) AS r FROM b) WHERE r = 1""")
def dedup_naive(spark, d):
    return literature.dedup_naive(table(spark, d, "biblio").select("ord", "doi", "title_normalized", "is_globalsouth")).select("ord", "doi", "title_normalized")


@query("dedup_assembly", """WITH a AS (SELECT ord, doi, title_normalized, coalesce(starts_with(search_run, 'manual'), false) AS m FROM biblio),
one AS (SELECT ord, doi, title_normalized, m FROM (SELECT *, row_number() OVER (PARTITION BY doi ORDER BY m, ord) AS r FROM a WHERE doi IS NOT NULL) WHERE r = 1),
b AS (SELECT * FROM one UNION ALL SELECT * FROM a WHERE doi IS NULL)
SELECT ord, doi, title_normalized FROM (SELECT *, row_number() OVER (PARTITION BY title_normalized ORDER BY doi IS NULL, m, ord) AS r FROM b) WHERE r = 1""")
def dedup_assembly(spark, d):
    return literature.dedup_assembly(table(spark, d, "biblio").select("ord", "doi", "title_normalized", "search_run")).select("ord", "doi", "title_normalized")


@query("duplicate_titles", "SELECT title_normalized, count(*)::BIGINT AS n FROM biblio WHERE title_normalized IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def duplicate_titles(spark, d):
    return dedup.duplicate_report(table(spark, d, "biblio"), "title_normalized")


@query("last_per_title", "SELECT title, max(id) AS id FROM final_policy_set WHERE title IS NOT NULL GROUP BY title")
def last_per_title(spark, d):
    return dedup.keep_best(table(spark, d, "final_policy_set").where("title IS NOT NULL").select("title", "id"), ["title"], F.col("id"), last=True)


@query("first_per_issue", "SELECT year, issue_number, min(page_row) AS page_row FROM page_metadata GROUP BY 1, 2")
def first_per_issue(spark, d):
    return dedup.keep_best(table(spark, d, "page_metadata").select("year", "issue_number", "page_row"), ["year", "issue_number"], F.col("page_row"))


@query("fingerprints")
def fingerprints(spark, d):
    return dedup.fingerprint(table(spark, d, "documents"), "doc_id", "text")


# --- joins and set operations ---------------------------------------------------------------------------

_S1 = "similarity_score >= 0.6"
_S2 = "num_pages >= 3"
_POOL_SQL = f"""WITH s1 AS (SELECT title AS t, max(id) AS id FROM final_policy_set WHERE {_S1} AND title IS NOT NULL GROUP BY 1), s2 AS (SELECT title AS t, max(id) AS id FROM final_policy_set WHERE {_S2} AND title IS NOT NULL GROUP BY 1),
u AS (SELECT coalesce(s1.t, s2.t) AS title, coalesce(s1.id, s2.id) AS id, CASE WHEN s1.t IS NULL THEN 's2_only' WHEN s2.t IS NULL THEN 's1_only' ELSE 'both' END AS source FROM s1 FULL JOIN s2 ON s1.t = s2.t)"""


def _pool(spark, d):
    p = table(spark, d, "final_policy_set").select("id", "title", "year", "similarity_score", "num_pages")
    return pooled_union(p.where(_S1), p.where(_S2), "title", "id")


@query("pooled_union", _POOL_SQL + " SELECT title, id, source FROM u")
def q_pooled_union(spark, d):
    return _pool(spark, d).select("title", "id", "source")


@query("pooled_shares", _POOL_SQL + " SELECT coalesce(source, 'total') AS source, count(*)::BIGINT AS n, round(count(*) * 100.0 / (SELECT count(*) FROM u), 6) AS percent FROM u GROUP BY ROLLUP (source)")
def pooled_shares(spark, d):
    return aggregate.shares(_pool(spark, d), "source").withColumn("percent", F.round("percent", 6))


@query("source_by_year", _POOL_SQL + """ SELECT coalesce(p.year::VARCHAR, 'All') AS year, (count(*) FILTER (source = 'both'))::BIGINT AS both, (count(*) FILTER (source = 's1_only'))::BIGINT AS s1_only, (count(*) FILTER (source = 's2_only'))::BIGINT AS s2_only, count(*)::BIGINT AS "All"
FROM u JOIN (SELECT id, any_value(year) AS year FROM final_policy_set GROUP BY id) p USING (id) WHERE p.year IS NOT NULL GROUP BY ROLLUP (p.year)""")
def source_by_year(spark, d):
    return aggregate.crosstab_margins(_pool(spark, d), "year", "source", ["both", "s1_only", "s2_only"])


@query("gold_without_runs", "SELECT DISTINCT id FROM gold WHERE id NOT IN (SELECT id FROM run_entries WHERE model = 'flint-base' AND id IS NOT NULL)")
def gold_without_runs(spark, d):
    return joins.orphans(table(spark, d, "gold").select("id").distinct(), table(spark, d, "run_entries").where("model = 'flint-base'"), ["id"])


@query("gold_with_runs", "SELECT gold_row FROM gold WHERE id IN (SELECT id FROM run_entries WHERE model = 'flint-base')")
def gold_with_runs(spark, d):
    return joins.only_in(table(spark, d, "gold"), table(spark, d, "run_entries").where("model = 'flint-base'"), ["id"]).select("gold_row")


@query("issue_gaps", """WITH p AS (SELECT year, try_cast(issue_number AS INT) AS n FROM page_metadata), g AS (SELECT year, max(n) AS top FROM p WHERE n IS NOT NULL GROUP BY year)
SELECT year, i::INT AS n FROM g, unnest(range(1, top + 1)) t(i) WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.year = g.year AND p.n = i)""")
def issue_gaps(spark, d):
    p = table(spark, d, "page_metadata").select("year", F.col("issue_number").try_cast("int").alias("n")).where("n IS NOT NULL AND year IS NOT NULL")
    return joins.gaps(p, "year", "n")


@query("coder_overlap", "WITH n AS (SELECT count(DISTINCT file_name) AS n_groups FROM gold) SELECT id, count(DISTINCT file_name)::BIGINT AS n_in, any_value(n_groups)::BIGINT AS n_groups, count(DISTINCT file_name) = any_value(n_groups) AS in_all FROM gold, n GROUP BY id")
def coder_overlap(spark, d):
    return joins.in_all(table(spark, d, "gold"), "id", "file_name")


_STEM_SQL = r"""SELECT id, date_published AS pd, list_distinct(list_transform(list_filter(regexp_extract_all(regexp_replace(lower(title), '[0-9]{1,2}\. ?\p{L}+ [0-9]{4}', ' ', 'g'), '([\p{L}\p{N}]+)', 1), lambda w: NOT list_contains(string_split('der die das den dem des und oder zur zum von vom für über mit nach ein eine einer eines auf im in an am bei', ' '), w)), lambda w: coalesce(nullif(regexp_replace(w, '(es|en|er|em|e|s|n)$', ''), ''), w))) AS stems FROM (SELECT id, min(date_published) AS date_published, min(title) AS title FROM final_policy_set WHERE title IS NOT NULL AND date_published IS NOT NULL GROUP BY id)"""


# corrections and annexes by their titles; the words that stand for them are those of the title they name
_NAMED_SQL = r"""coalesce(nullif(regexp_extract(title, '(?is)^\s*(?:Berichtigung|Anlage(?:nband)?)\s+(?:de[rs]|zu[mr]?)\s+(.+?)\s*$', 1), ''), regexp_replace(title, '(?i)^\s*(?:Berichtigung|Anlage(?:nband)?)\b[\s:–-]*', ''))"""
_CHILD_SQL = r"""regexp_matches(title, '(?i)^\s*(Berichtigung\b|Anlage(nband)?\b)')"""
_PARENTS_SQL = f"""t AS (SELECT id, min(date_published) AS date_published, min(title) AS title FROM final_policy_set WHERE title IS NOT NULL AND date_published IS NOT NULL GROUP BY id),
s AS ({_STEM_SQL.split(' FROM (SELECT')[0].replace('lower(title)', f'lower({_NAMED_SQL})')}, {_CHILD_SQL} AS is_child FROM t),
ce AS (SELECT id, pd, len(stems) AS n, unnest(stems) AS st FROM s WHERE is_child), pe AS (SELECT id, pd, len(stems) AS n, unnest(stems) AS st FROM s WHERE NOT is_child),
h AS (SELECT ce.id AS child, pe.id AS parent, any_value(ce.n) AS cn, any_value(pe.n) AS pn, any_value(pe.pd) AS pd, count(*) AS k FROM ce JOIN pe USING (st) WHERE pe.pd <= ce.pd GROUP BY 1, 2),
r AS (SELECT *, k / cn AS o, k / (cn + pn - k) AS j FROM h WHERE k / cn >= 0.85), w AS (SELECT *, row_number() OVER (PARTITION BY child ORDER BY o DESC, j DESC, pd DESC, parent) AS x FROM r)"""


def _titled(spark, d):
    p = table(spark, d, "final_policy_set").where("title IS NOT NULL AND date_published IS NOT NULL").groupBy("id").agg(F.min("title").alias("title"), F.min("date_published").alias("date_published"))
    return p.select("id", "date_published", T.document_class(F.col("title")).alias("doc_class"), T.stems(T.named_title(F.col("title"))).alias("stems"))


@query("parent_match", f"WITH {_PARENTS_SQL} SELECT child, parent, round(o, 6) AS overlap, round(j, 6) AS jaccard FROM w WHERE x = 1")
def parent_match(spark, d):
    s = _titled(spark, d)
    out = joins.ranked_parents(s.where("doc_class <> 'regular'"), s.where("doc_class = 'regular'"), "stems", "date_published", 0.85)
    return out.select("child", "parent", F.round("overlap", 6).alias("overlap"), F.round("jaccard", 6).alias("jaccard"))


@query("term_partition", """SELECT ord, CASE WHEN a AND b THEN 'both' WHEN a THEN 'only_a' WHEN b THEN 'only_b' ELSE 'neither' END AS part FROM (SELECT ord, coalesce(regexp_matches(title, '(?i)crisis|krise'), false) AS a,
  coalesce(regexp_matches(title, '(?i)pension|alterssicherung'), false) OR coalesce(contains(lower(title), 'welfare') AND contains(lower(title), 'health'), false) AS b FROM biblio)""")
def term_partition(spark, d):
    return literature.partition_by_terms(table(spark, d, "biblio").select("ord", "title"), F.col("title"), "crisis|krise", "pension|alterssicherung", [["welfare", "health"]]).select("ord", "part")


# --- aggregates -------------------------------------------------------------------------------------------


@query("events_by_type", "SELECT event_type, count(*)::BIGINT AS n FROM events WHERE event_type IS NOT NULL GROUP BY 1")
def events_by_type(spark, d):
    return value_counts(table(spark, d, "events"), "event_type")


@query("policy_counts", "SELECT year, count(*)::BIGINT AS n, (count(*) FILTER (coalesce(full_text, '') <> ''))::BIGINT AS with_text, (count(*) FILTER (similarity_score >= 0.6))::BIGINT AS matched FROM final_policy_set GROUP BY year")
def policy_counts(spark, d):
    p = table(spark, d, "final_policy_set")
    return p.groupBy("year").agg(F.count("*").alias("n"), F.count_if(F.coalesce("full_text", F.lit("")) != "").alias("with_text"), F.count_if(F.col("similarity_score") >= 0.6).alias("matched"))


@query("null_report", "SELECT count(*)::BIGINT AS n_rows, (count(*) - count(doi))::BIGINT AS null_doi, (count(*) - count(abstract))::BIGINT AS null_abstract, (count(*) - count(title))::BIGINT AS null_title FROM biblio")
def null_report(spark, d):
    return aggregate.null_counts(table(spark, d, "biblio"), ["doi", "abstract", "title"])


@query("score_summary", "SELECT count(similarity_score)::BIGINT AS n, round(min(similarity_score), 6) AS min, round(max(similarity_score), 6) AS max, round(avg(similarity_score), 6) AS mean, round(median(similarity_score), 6) AS median FROM final_policy_set")
def score_summary(spark, d):
    s = aggregate.describe(table(spark, d, "final_policy_set"), "similarity_score")
    return s.select("n", *[F.round(c, 6).alias(c) for c in ("min", "max", "mean", "median")])


@query("score_histogram", """WITH x AS (SELECT similarity_score AS x FROM final_policy_set WHERE similarity_score IS NOT NULL), e AS (SELECT min(x) AS a, max(x) AS b FROM x),
n AS (SELECT least(floor((x - a) / (b - a) * 50)::INT + 1, 50) AS bin, count(*) AS n FROM x, e GROUP BY 1)
SELECT i::INT AS bin, round(a + (b - a) / 50 * (i - 1), 6) AS low, round(a + (b - a) / 50 * i, 6) AS high, coalesce(n, 0)::BIGINT AS n FROM e, unnest(range(1, 51)) t(i) LEFT JOIN n ON n.bin = i""")
def score_histogram(spark, d):
    h = aggregate.histogram(table(spark, d, "final_policy_set"), "similarity_score", 50)
    return h.select("bin", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), "n")


@query("defined_order_counts", "SELECT v.place::INT AS place, v.kind, coalesce(c, 0)::BIGINT AS n FROM (VALUES (0, 'law text'), (1, 'abstract'), (2, 'notice'), (3, 'speech')) v(place, kind) LEFT JOIN (SELECT doc_kind AS kind, count(*) AS c FROM documents GROUP BY 1) t ON t.kind = v.kind")
def defined_order_counts(spark, d):
    n = value_counts(table(spark, d, "documents").select(F.col("doc_kind").alias("kind")), "kind")
    return aggregate.reindexed(n, "kind", ["law text", "abstract", "notice", "speech"])


@query("keyword_top", """WITH e AS (SELECT ord, i, trim(string_split(keywords, ';')[i]) AS item FROM biblio, unnest(range(1, coalesce(len(string_split(keywords, ';')), 0) + 1)) t(i) WHERE keywords IS NOT NULL)
SELECT item, count(*)::BIGINT AS n FROM e GROUP BY item ORDER BY n DESC, min(ord * 1000 + i) LIMIT 20""")
def keyword_top(spark, d):
    b = table(spark, d, "biblio").where("keywords IS NOT NULL")
    return aggregate.top_values(b, F.transform(F.split("keywords", ";"), lambda x: F.trim(x)), "ord", 20)


@query("tfidf_keywords")
def tfidf_keywords(spark, d):
    return literature.tfidf_keywords(table(spark, d, "biblio").select("ord", "title", "abstract"), "ord", T.concat_texts(F.col("title"), F.col("abstract")))


@query("tfidf_frequency")
def tfidf_frequency(spark, d):
    return literature.keyword_frequency(tfidf_keywords(spark, d), "ord", 50)


@query("token_loss", r"""WITH a AS (SELECT id, unnest(regexp_extract_all(title, '([\p{L}\p{N}_]+)', 1)) AS t FROM (SELECT id, any_value(title) AS title, any_value(clean) AS clean FROM (SELECT id, min(title) AS title, regexp_replace(min(title), 'Gesetz|Verordnung', '', 'g') AS clean FROM final_policy_set GROUP BY id) GROUP BY id)),
b AS (SELECT id, unnest(regexp_extract_all(regexp_replace(title, 'Gesetz|Verordnung', '', 'g'), '([\p{L}\p{N}_]+)', 1)) AS t FROM (SELECT id, min(title) AS title FROM final_policy_set GROUP BY id)),
ca AS (SELECT id, t, count(*) AS n FROM a GROUP BY 1, 2), cb AS (SELECT id, t, count(*) AS m FROM b GROUP BY 1, 2),
s AS (SELECT id, sum(n) AS n_base, sum(greatest(n - coalesce(m, 0), 0)) AS n_lost FROM ca LEFT JOIN cb USING (id, t) GROUP BY id)
SELECT id, coalesce(n_base, 0)::BIGINT AS n_base, coalesce(n_lost, 0)::BIGINT AS n_lost, round(coalesce(n_lost, 0) / greatest(coalesce(n_base, 0), 1), 6) AS loss FROM (SELECT DISTINCT id FROM final_policy_set) LEFT JOIN s USING (id)""")
def token_loss(spark, d):
    p = table(spark, d, "final_policy_set").groupBy("id").agg(F.min("title").alias("title"))
    t = aggregate.token_loss(p, "id", F.col("title"), F.regexp_replace("title", "Gesetz|Verordnung", ""), T.tokens)
    return t.withColumn("loss", F.round("loss", 6))


@query("sorted_sets", "SELECT year, list_sort(list(DISTINCT doc_type)) AS kinds, count(DISTINCT issue_number)::BIGINT AS n_issues FROM final_policy_set WHERE doc_type IS NOT NULL GROUP BY year")
def sorted_sets(spark, d):
    return table(spark, d, "final_policy_set").where("doc_type IS NOT NULL").groupBy("year").agg(F.array_sort(F.collect_set("doc_type")).alias("kinds"), F.count_distinct("issue_number").alias("n_issues"))


@query("corpus_profile", "SELECT doc_kind, count(w)::BIGINT AS n, min(w) AS min, max(w) AS max, round(avg(w), 6) AS mean, median(w) AS median FROM (SELECT doc_kind, len(list_filter(regexp_split_to_array(text, '[\\s\\p{Z}]+'), lambda x: x <> ''))::DOUBLE AS w FROM documents WHERE text IS NOT NULL) GROUP BY doc_kind")
def corpus_profile(spark, d):
    words, _, _ = coverage.corpus_profile(table(spark, d, "documents").where("text IS NOT NULL"), F.col("text"), "doc_kind")
    return words.withColumn("mean", F.round("mean", 6))


# --- labels: gold, runs, scores ---------------------------------------------------------------------------

# one gold label per policy: the most frequent first field and flag of the coders, of equals the least
_GOLD_SQL = """gl AS (SELECT id, gs_labels['social_policy_field_1'].value AS f1, gs_labels['social_policy_field_2'].value AS f2, CASE lower(trim(gs_labels['crisis_ref'].value)) WHEN '1' THEN 1 WHEN 'true' THEN 1 WHEN '0' THEN 0 WHEN 'false' THEN 0 END AS crisis, gold_row FROM gold WHERE gs_labels IS NOT NULL),
g AS (SELECT id, f1, f2, crisis FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY gold_row) AS r FROM gl) WHERE r = 1)"""
_CLS = ", ".join(f"'{c}'" for c in L.FIELDS)
_RUNS_SQL = f"""complete AS (SELECT DISTINCT model, prompt_key FROM run_entries WHERE NOT is_partial), kept AS (SELECT * FROM run_entries r WHERE NOT is_partial OR NOT EXISTS (SELECT 1 FROM complete c WHERE c.model = r.model AND c.prompt_key = r.prompt_key)),
r1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY model, prompt_key, id ORDER BY entry_id) AS x FROM kept WHERE prompt_key LIKE '%batch%') WHERE x = 1),
p AS (SELECT model, prompt_key, id, llm_labels AS m, llm_labels['social_policy_field_1'].value AS f1, llm_labels['social_policy_field_2'].value AS f2, CASE lower(trim(llm_labels['crisis_ref'].value)) WHEN '1' THEN 1 WHEN 'true' THEN 1 WHEN '0' THEN 0 WHEN 'false' THEN 0 END AS crisis FROM r1),
runs AS (SELECT DISTINCT model, prompt_key FROM p),
al AS (SELECT g.id, runs.model, runs.prompt_key, g.f1 AS gf1, g.f2 AS gf2, g.crisis AS gc, p.m, p.f1, p.f2, p.crisis,
  CASE WHEN g.f1 IN ({_CLS}) THEN list_distinct(list_filter([g.f1, g.f2], lambda x: x IN ({_CLS}))) END AS gs, CASE WHEN p.f1 IN ({_CLS}) THEN list_distinct(list_filter([p.f1, p.f2], lambda x: x IN ({_CLS}))) END AS ps,
  coalesce(len(list_intersect(map_keys(p.m), ['summary', 'legally_effective', 'crisis_ref', 'social_policy_field_1', 'social_policy_field_2'])) = 5 AND p.f1 IN ({_CLS}) AND p.f2 IN ({_CLS}, 'na') AND p.crisis IS NOT NULL, false) AS valid
  FROM g CROSS JOIN runs LEFT JOIN p ON p.id = g.id AND p.model = runs.model AND p.prompt_key = runs.prompt_key)"""
_REQUIRED = ["summary", "legally_effective", "crisis_ref", "social_policy_field_1", "social_policy_field_2"]
_RUN = ["model", "prompt_key"]


def _aligned(spark, d):
    g = table(spark, d, "gold").where("gs_labels IS NOT NULL")
    g = dedup.keep_best(g.select("id", "gold_row", "gs_labels"), ["id"], F.col("gold_row"))
    gold = g.select("id", L.label_set(L.unwrap(F.col("gs_labels"), "social_policy_field_1"), L.unwrap(F.col("gs_labels"), "social_policy_field_2")).alias("gs"), L.unwrap(F.col("gs_labels"), "social_policy_field_1").alias("gf1"), L.flag(L.unwrap(F.col("gs_labels"), "crisis_ref")).alias("gc"))
    kept = files.best_run_files(table(spark, d, "run_entries")).where("prompt_key LIKE '%batch%'")
    one = dedup.keep_best(kept.select("model", "prompt_key", "id", "entry_id", "llm_labels"), ["model", "prompt_key", "id"], F.col("entry_id"))
    m = F.col("llm_labels")
    runs = one.select("id", "model", "prompt_key", "llm_labels", L.label_set(L.unwrap(m, "social_policy_field_1"), L.unwrap(m, "social_policy_field_2")).alias("ps"), L.unwrap(m, "social_policy_field_1").alias("f1"), L.flag(L.unwrap(m, "crisis_ref")).alias("crisis"))
    rows = evaluate.aligned(gold, runs, "id", _RUN)
    return rows.withColumn("valid", L.compliant(F.col("llm_labels"), F.array(*[F.lit(x) for x in _REQUIRED]), F.lit(True)))


@query("run_compliance", f"WITH {_GOLD_SQL}, {_RUNS_SQL} SELECT model, prompt_key, count(*)::BIGINT AS n_gold, round(avg(valid::INT), 6) AS compliance FROM al GROUP BY 1, 2")
def run_compliance(spark, d):
    return evaluate.compliance(_aligned(spark, d), _RUN, F.col("valid")).withColumn("compliance", F.round("compliance", 6))


@query("compliance_by_model", f"WITH {_GOLD_SQL}, {_RUNS_SQL}, c AS (SELECT model, prompt_key, avg(valid::INT) AS c FROM al GROUP BY 1, 2) SELECT model, round(avg(c), 6) AS mean, round(min(c), 6) AS min, round(max(c), 6) AS max FROM c GROUP BY 1")
def compliance_by_model(spark, d):
    c = evaluate.compliance(_aligned(spark, d), _RUN, F.col("valid"))
    return c.groupBy("model").agg(F.round(F.avg("compliance"), 6).alias("mean"), F.round(F.min("compliance"), 6).alias("min"), F.round(F.max("compliance"), 6).alias("max"))


@query("failure_rates", f"""WITH {_GOLD_SQL}, {_RUNS_SQL} SELECT model, prompt_key, round(avg((NOT coalesce(len(list_intersect(map_keys(m), ['summary', 'legally_effective', 'crisis_ref', 'social_policy_field_1', 'social_policy_field_2'])) = 5, false))::INT), 6) AS keys,
round(avg((NOT coalesce(f1 IN ({_CLS}), false))::INT), 6) AS field_1, round(avg((crisis IS NULL)::INT), 6) AS crisis FROM al GROUP BY 1, 2""")
def failure_rates(spark, d):
    keys = F.forall(F.array(*[F.lit(x) for x in _REQUIRED]), lambda k: F.map_contains_key("llm_labels", k))
    r = evaluate.failure_rates(_aligned(spark, d), _RUN, {"keys": keys, "field_1": F.col("f1").isin(L.FIELDS), "crisis": F.col("crisis").isNotNull()})
    return r.select(*_RUN, *[F.round(c, 6).alias(c) for c in ("keys", "field_1", "crisis")])


_ML_SQL = f"""WITH {_GOLD_SQL}, {_RUNS_SQL}, e AS (SELECT model, prompt_key, gs, ps, unnest(list_distinct(list_concat(gs, ps))) AS label FROM al WHERE gs IS NOT NULL AND ps IS NOT NULL),
s AS (SELECT model, prompt_key, label, (count(*) FILTER (list_contains(gs, label) AND list_contains(ps, label)))::BIGINT AS tp, (count(*) FILTER (NOT list_contains(gs, label)))::BIGINT AS fp, (count(*) FILTER (NOT list_contains(ps, label)))::BIGINT AS fn FROM e GROUP BY 1, 2, 3),
sc AS (SELECT *, tp / nullif(tp + fp, 0) AS pr, tp / nullif(tp + fn, 0) AS re, 2 * tp / nullif(2 * tp + fp + fn, 0) AS f FROM s),
mf AS (SELECT model, prompt_key, avg(pr) AS mp, avg(re) AS mr, avg(f) AS mf FROM sc GROUP BY 1, 2)"""


@query("field_scores", _ML_SQL + ' SELECT model, prompt_key, label, tp, fp, fn, round(pr, 6) AS "precision", round(re, 6) AS recall, round(f, 6) AS f1 FROM sc')
def field_scores(spark, d):
    s = evaluate.multilabel_scores(_aligned(spark, d), _RUN, "id", "gs", "ps")
    return s.select(*_RUN, "label", "tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


def _macro(spark, d):
    return evaluate.macro(evaluate.multilabel_scores(_aligned(spark, d), _RUN, "id", "gs", "ps"), _RUN)


@query("field_macro", _ML_SQL + " SELECT model, prompt_key, round(mp, 6) AS macro_precision, round(mr, 6) AS macro_recall, round(mf, 6) AS macro_f1 FROM mf")
def field_macro(spark, d):
    return _macro(spark, d).select(*_RUN, *[F.round(c, 6).alias(c) for c in ("macro_precision", "macro_recall", "macro_f1")])


@query("field_macro_gated", _ML_SQL + ", c AS (SELECT model, prompt_key, avg(valid::INT) AS c FROM al GROUP BY 1, 2) SELECT model, prompt_key, CASE WHEN c >= 0.8 THEN round(mf, 6) END AS macro_f1 FROM mf JOIN c USING (model, prompt_key)")
def field_macro_gated(spark, d):
    rates = evaluate.compliance(_aligned(spark, d), _RUN, F.col("valid"))
    return evaluate.gated(_macro(spark, d), rates, _RUN, ["macro_f1"]).select(*_RUN, F.round("macro_f1", 6).alias("macro_f1"))


@query("best_prompt", _ML_SQL + " SELECT model, prompt_key, round(mf, 6) AS macro_f1 FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY round_even(mf, 3) DESC, prompt_key) AS r FROM mf WHERE mf IS NOT NULL) WHERE r = 1")
def best_prompt(spark, d):
    return evaluate.best_run(_macro(spark, d), ["model"], "macro_f1", "prompt_key", 3).select(*_RUN, F.round("macro_f1", 6).alias("macro_f1"))


@query("macro_pivot", _ML_SQL + " SELECT model, round(max(mf) FILTER (prompt_key = 'v1_batch'), 6) AS v1_batch, round(max(mf) FILTER (prompt_key = 'v2_batch_few'), 6) AS v2_batch_few, round(max(mf) FILTER (prompt_key = 'v3_batch_def'), 6) AS v3_batch_def FROM mf GROUP BY 1")
def macro_pivot(spark, d):
    p = aggregate.pivot_unique(_macro(spark, d), "model", "prompt_key", "macro_f1", ["v1_batch", "v2_batch_few", "v3_batch_def"])
    return p.select("model", *[F.round(c, 6).alias(c) for c in ("v1_batch", "v2_batch_few", "v3_batch_def")])


@query("factorial_means", _ML_SQL + """, f AS (SELECT mf, contains(prompt_key, 'few')::INT AS shot, contains(prompt_key, 'def')::INT AS d, contains(prompt_key, 'jus')::INT AS j FROM mf)
SELECT 'shot' AS dim, shot::VARCHAR AS value, round(avg(mf), 6) AS macro_f1 FROM f GROUP BY shot UNION ALL SELECT 'def', d::VARCHAR, round(avg(mf), 6) FROM f GROUP BY d UNION ALL SELECT 'jus', j::VARCHAR, round(avg(mf), 6) FROM f GROUP BY j""")
def factorial_means(spark, d):
    x = L.prompt_factors(F.col("prompt_key"))
    m = _macro(spark, d).select("macro_f1", x["shot"].alias("shot"), x["def"].alias("def"), x["jus"].alias("jus"))
    return aggregate.marginal_means(m, ["shot", "def", "jus"], ["macro_f1"]).withColumn("macro_f1", F.round("macro_f1", 6))


@query("crisis_scores", f"""WITH {_GOLD_SQL}, {_RUNS_SQL}, s AS (SELECT model, prompt_key, (count(*) FILTER (gc = 1 AND crisis = 1))::BIGINT AS tp, (count(*) FILTER (gc = 0 AND crisis = 1))::BIGINT AS fp, (count(*) FILTER (gc = 1 AND crisis = 0))::BIGINT AS fn FROM al WHERE gc IS NOT NULL AND crisis IS NOT NULL GROUP BY 1, 2)
SELECT *, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS "precision", round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1 FROM s""")
def crisis_scores(spark, d):
    s = evaluate.binary_scores(_aligned(spark, d), _RUN, "gc", "crisis")
    return s.select(*_RUN, "tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query("jaccard_table", f"""WITH {_GOLD_SQL}, {_RUNS_SQL}, j AS (SELECT model, prompt_key, len(list_intersect(gs, ps)) / len(list_distinct(list_concat(gs, ps))) AS j FROM al WHERE gs IS NOT NULL AND ps IS NOT NULL)
SELECT model, prompt_key, count(*)::BIGINT AS n, round(avg(j), 6) AS mean_jaccard, (count(*) FILTER (j < 1/6))::BIGINT AS n_0, (count(*) FILTER (j > 0.2 AND j < 0.4))::BIGINT AS n_third, (count(*) FILTER (j > 0.45 AND j < 0.7))::BIGINT AS n_half, (count(*) FILTER (j > 0.8))::BIGINT AS n_1 FROM j GROUP BY 1, 2""")
def jaccard_table(spark, d):
    return evaluate.jaccard_table(_aligned(spark, d), _RUN, "gs", "ps").withColumn("mean_jaccard", F.round("mean_jaccard", 6))


@query("confusion_grid", f"""WITH {_GOLD_SQL}, {_RUNS_SQL}, c AS (SELECT unnest([{_CLS}]) AS c) SELECT a.c AS gf1, b.c AS f1, (SELECT count(*) FROM al WHERE al.gf1 = a.c AND al.f1 = b.c AND model = 'cyan-large')::BIGINT AS n FROM c a CROSS JOIN c b""")
def confusion_grid(spark, d):
    return evaluate.confusion(_aligned(spark, d).where("model = 'cyan-large'"), "gf1", "f1", L.FIELDS)


@query("confusion_by_model")
def confusion_by_model(spark, d):
    """As confusion_grid, for every model with the prompt that best_prompt names."""
    a = _aligned(spark, d)
    best = best_prompt(spark, d).select(*_RUN)
    pairs = a.join(F.broadcast(best), _RUN).groupBy(*_RUN, "gf1", "f1").agg(F.count("*").alias("n"))
    one = F.array(*[F.lit(c) for c in L.FIELDS])
    grid = best.withColumn("gf1", F.explode(one)).withColumn("f1", F.explode(one))
    return grid.join(pairs, [*_RUN, "gf1", "f1"], "left").select(*_RUN, "gf1", "f1", F.coalesce("n", F.lit(0)).alias("n"))


_RATE_SQL = """r AS (SELECT v AS variable, id AS unit, file_name AS coder, CASE WHEN has THEN CASE WHEN x IS NULL OR lower(trim(x)) IN ('', 'none', 'null') THEN 'na' ELSE lower(trim(x)) END END AS value FROM
 (SELECT v, id, file_name, list_contains(map_keys(gs_labels), v) AS has, gs_labels[v].value AS x FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id, file_name ORDER BY gold_row) AS q FROM gold WHERE gs_labels IS NOT NULL) WHERE q = 1) g, (VALUES ('social_policy_field_1'), ('crisis_ref')) t(v)))"""


def _ratings(spark, d):
    g = table(spark, d, "gold").where("gs_labels IS NOT NULL").select("id", "file_name", "gold_row", "gs_labels")
    g = dedup.keep_best(g, ["id", "file_name"], F.col("gold_row"))
    rows = g.withColumn("variable", F.explode(F.array(F.lit("social_policy_field_1"), F.lit("crisis_ref"))))
    present = F.map_contains_key("gs_labels", F.col("variable"))
    value = L.normal_label(F.element_at("gs_labels", F.col("variable"))["value"], present)
    return rows.select("variable", F.col("id").alias("unit"), F.col("file_name").alias("coder"), value.alias("value"))


@query("coder_alpha", f"""WITH {_RATE_SQL}, n AS (SELECT variable, unit, value, count(*)::DOUBLE AS n FROM r WHERE value IS NOT NULL GROUP BY ALL), u AS (SELECT variable, unit, sum(n) AS m, sum(n * n) AS sq FROM n GROUP BY ALL HAVING sum(n) > 1),
s AS (SELECT variable, count(*)::BIGINT AS n_units, sum(m) AS t, sum((m * m - sq) / (m - 1)) AS d FROM u GROUP BY 1), c AS (SELECT variable, value, sum(n) AS c FROM n SEMI JOIN u USING (variable, unit) GROUP BY ALL), cc AS (SELECT variable, sum(c * c) AS cc FROM c GROUP BY 1)
SELECT variable, n_units, round(1 - d / ((t * t - cc) / (t - 1)), 6) AS alpha FROM s JOIN cc USING (variable)""")
def coder_alpha(spark, d):
    return reliability.alpha(_ratings(spark, d)).withColumn("alpha", F.round("alpha", 6))


@query("coder_kappa", f"""WITH {_RATE_SQL}, p AS (SELECT a.variable, a.coder AS coder_a, b.coder AS coder_b, a.value AS x, b.value AS y FROM r a JOIN r b USING (variable, unit) WHERE a.coder < b.coder AND a.value IS NOT NULL AND b.value IS NOT NULL),
t AS (SELECT variable, coder_a, coder_b, count(*)::BIGINT AS n, avg((x = y)::INT) AS po FROM p GROUP BY ALL), ma AS (SELECT variable, coder_a, coder_b, x AS v, count(*) AS na FROM p GROUP BY ALL), mb AS (SELECT variable, coder_a, coder_b, y AS v, count(*) AS nb FROM p GROUP BY ALL),
e AS (SELECT variable, coder_a, coder_b, sum(na * nb) AS e FROM ma JOIN mb USING (variable, coder_a, coder_b, v) GROUP BY ALL), j AS (SELECT *, coalesce(e, 0) / (n * n) AS pe FROM t LEFT JOIN e USING (variable, coder_a, coder_b))
SELECT variable, coder_a, coder_b, n, round(CASE WHEN n < 2 THEN NULL WHEN pe = 1 THEN 1.0 ELSE (po - pe) / (1 - pe) END, 6) AS kappa FROM j""")
def coder_kappa(spark, d):
    return reliability.kappa(_ratings(spark, d)).withColumn("kappa", F.round("kappa", 6))


@query("coder_missing", f"WITH {_RATE_SQL} SELECT variable, coder, count(*)::BIGINT AS n, (count(*) FILTER (value = 'na'))::BIGINT AS n_na, (count(*) - count(value))::BIGINT AS n_missing FROM r GROUP BY 1, 2")
def coder_missing(spark, d):
    return reliability.missing_counts(_ratings(spark, d))


@query("coder_agreement", f"""WITH {_RATE_SQL}, x AS (SELECT * FROM r WHERE coder IN ('gold_hc01.json', 'gold_hc02.json')), u AS (SELECT variable, unit, count(DISTINCT coder) AS k, count(DISTINCT value) AS v FROM x WHERE value IS NOT NULL GROUP BY ALL HAVING count(DISTINCT coder) = 2)
SELECT variable, count(*)::BIGINT AS n_units, round(avg((v = 1)::INT), 6) AS agreement FROM u GROUP BY 1""")
def coder_agreement(spark, d):
    two = _ratings(spark, d).where(F.col("coder").isin("gold_hc01.json", "gold_hc02.json"))
    return reliability.agreement(two).withColumn("agreement", F.round("agreement", 6))


@query("coder_agreement_pairs", f"""WITH {_RATE_SQL} SELECT a.variable, a.coder AS coder_a, b.coder AS coder_b, count(*)::BIGINT AS n_units, round(avg((a.value = b.value)::INT), 6) AS agreement
FROM r a JOIN r b USING (variable, unit) WHERE a.coder < b.coder AND a.value IS NOT NULL AND b.value IS NOT NULL GROUP BY ALL""")
def coder_agreement_pairs(spark, d):
    """As coder_agreement, for every pair of coders instead of two named ones."""
    return reliability.pair_agreement(_ratings(spark, d)).withColumn("agreement", F.round("agreement", 6))


@query("labels_long", "SELECT gold_row, e.key AS field, e.value.value AS value, e.value.coder AS coder, e.value.date AS date FROM (SELECT gold_row, unnest(map_entries(gs_labels)) AS e FROM gold WHERE gs_labels IS NOT NULL)")
def labels_long(spark, d):
    g = table(spark, d, "gold").where("gs_labels IS NOT NULL").select("gold_row", F.explode("gs_labels").alias("field", "x"))
    return g.select("gold_row", "field", "x.value", "x.coder", "x.date")


@query("best_run_files", "SELECT entry_id FROM run_entries r WHERE NOT is_partial OR NOT EXISTS (SELECT 1 FROM run_entries c WHERE NOT c.is_partial AND c.model = r.model AND c.prompt_key = r.prompt_key)")
def best_run_files(spark, d):
    return files.best_run_files(table(spark, d, "run_entries").select("entry_id", "model", "prompt_key", "is_partial")).select("entry_id")


@query("pending_entries", "SELECT DISTINCT id FROM final_policy_set WHERE id NOT IN (SELECT id FROM run_entries WHERE model = 'flint-base' AND llm_labels IS NOT NULL AND id IS NOT NULL)")
def pending_entries(spark, d):
    done = table(spark, d, "run_entries").where("model = 'flint-base'").select("id", "llm_labels")
    return files.pending(table(spark, d, "final_policy_set").select("id").distinct(), done, "id", "llm_labels")


@query("label_map_wrapped", "SELECT id, map_from_entries([('doc_type', {'value': doc_type, 'coder': 'import', 'date': '2026-01-01'})])['doc_type'].value AS value FROM final_policy_set")
def label_map_wrapped(spark, d):
    m = L.wrap(F.create_map(F.lit("doc_type"), F.col("doc_type")), F.lit("import"), F.lit("2026-01-01"))
    return table(spark, d, "final_policy_set").select("id", m.alias("m")).select("id", L.unwrap(F.col("m"), "doc_type").alias("value"))


@query("event_props", "SELECT event_id, (props->>'$.k')::INT AS k FROM events")
def event_props(spark, d):
    return table(spark, d, "events").select("event_id", F.try_variant_get(F.try_parse_json(L.first_object(F.concat(F.lit("Answer: "), "props"))), "$.k", "int").alias("k"))


@query("classified")
def classified(spark, d):
    p = table(spark, d, "final_policy_set").select("id", "title", "date_published", "full_text")
    prompts = labelling.prompts(spark, {"batch": "Code all fields.", "single": "Code one field."}, "Fields are defined as usual.", "Say why.", "Example: none.")
    models = spark.createDataFrame([("stub-a",), ("stub-b",)], "model string")
    return labelling.classify_run(p, models, prompts.where("shot = 0 AND jus = 0"), labelling.stub_client, "id", "title", "date_published", "full_text", "2026-01-01")


# --- windows, logs, coverage -------------------------------------------------------------------------------


_STATE_SQL = """st AS (SELECT year, number, max(struct_pack(attempt, loaded_at, status)) AS s, count(*)::BIGINT AS n_attempts, count(*) FILTER (status <> 'ok') AS nf FROM fetch_log GROUP BY 1, 2)"""


@query("fetch_state", f"WITH {_STATE_SQL} SELECT year, number, s.attempt AS attempt, s.status AS status, n_attempts, s.status = 'ok' AND nf > 0 AS recovered FROM st")
def fetch_state(spark, d):
    return coverage.fetch_state(table(spark, d, "fetch_log")).select("year", "number", "attempt", "status", "n_attempts", "recovered")


@query("coverage_report", f"""WITH {_STATE_SQL}, x AS (SELECT year, try_cast(number AS INT) AS n, s.status AS status FROM st WHERE regexp_matches(number, '^[0-9]+$')), t AS (SELECT year, max(n) FILTER (status = 'ok') AS top, max(n) AS last FROM x GROUP BY 1)
SELECT t.year, i::INT AS n, x.status AS reason, CASE WHEN i > coalesce(top, 0) THEN 'tail' ELSE 'gap' END AS place FROM t, unnest(range(1, last + 1)) u(i) LEFT JOIN x ON x.year = t.year AND x.n = i WHERE coalesce(x.status, '') <> 'ok'""")
def coverage_report(spark, d):
    return coverage.coverage_report(coverage.fetch_state(table(spark, d, "fetch_log"))).select("year", "n", "reason", "place")


@query("miss_runs", f"""WITH {_STATE_SQL}, x AS (SELECT year, try_cast(number AS INT) AS n, s.status AS status FROM st WHERE regexp_matches(number, '^[0-9]+$')),
a AS (SELECT *, sum((status = 'ok')::INT) OVER w AS mi, sum((status <> 'error')::INT) OVER w AS ei FROM x WINDOW w AS (PARTITION BY year ORDER BY n ROWS UNBOUNDED PRECEDING))
SELECT year, n, status, (sum((status NOT IN ('ok', 'error'))::INT) OVER (PARTITION BY year, mi ORDER BY n ROWS UNBOUNDED PRECEDING))::BIGINT AS miss_run, (sum((status = 'error')::INT) OVER (PARTITION BY year, ei ORDER BY n ROWS UNBOUNDED PRECEDING))::BIGINT AS error_run FROM a""")
def miss_runs(spark, d):
    s = coverage.fetch_state(table(spark, d, "fetch_log")).where(F.col("number").rlike("^[0-9]+$")).select("year", F.col("number").try_cast("int").alias("n"), "status")
    return windows.miss_runs(s, "year", "n", "status", "ok", "error")


@query("sliding_rates", """SELECT event_id, (count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 60000000 PRECEDING AND CURRENT ROW))::BIGINT AS in_minute,
(count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW))::BIGINT AS in_hour FROM events""")
def sliding_rates(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", "ts")
    e = windows.sliding_count(windows.sliding_count(e, ["user_id"], "ts", 60, "in_minute"), ["user_id"], "ts", 3600, "in_hour")
    return e.select("event_id", "in_minute", "in_hour")


@query("running_ok", "SELECT gold_row, (sum((gs_labels IS NOT NULL)::INT) OVER (PARTITION BY file_name ORDER BY gold_row ROWS UNBOUNDED PRECEDING))::BIGINT AS done FROM gold")
def running_ok(spark, d):
    return windows.running_count(table(spark, d, "gold"), ["file_name"], ["gold_row"], F.col("gs_labels").isNotNull(), "done").select("gold_row", "done")


@query("resume_point", "SELECT min(gold_row) FILTER (gs_labels IS NULL) AS resume_at FROM gold")
def resume_point(spark, d):
    return windows.first_open(table(spark, d, "gold"), "gold_row", "gs_labels")


@query("collision_numbers", "SELECT page_row, (row_number() OVER (PARTITION BY id ORDER BY page_row))::INT AS copy FROM page_metadata")
def collision_numbers(spark, d):
    return windows.numbered(table(spark, d, "page_metadata"), ["id"], ["page_row"], "copy").select("page_row", "copy")


@query("longest_texts", "SELECT id, length(full_text)::INT AS n FROM final_policy_set WHERE full_text IS NOT NULL ORDER BY n DESC, id LIMIT 10")
def longest_texts(spark, d):
    return table(spark, d, "final_policy_set").where("full_text IS NOT NULL").select("id", F.length("full_text").alias("n")).orderBy(F.desc("n"), "id").limit(10)


# --- vectors, topics, selection -----------------------------------------------------------------------------

_DOT = "list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"


@query("similarity_triage", """WITH s AS (SELECT a.vec_id, max(round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6)) AS similarity FROM embeddings a, embeddings b WHERE b.vec_id < 20 GROUP BY 1)
SELECT vec_id, similarity, CASE WHEN similarity >= 0.6 THEN 'auto' WHEN similarity >= 0.3 THEN 'borderline' ELSE 'below' END AS bucket FROM s""")
def similarity_triage(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    s = topics.max_similarity(e, "vec_id", "embedding", e.where("vec_id < 20"), "vec_id", "embedding")
    s = s.select("vec_id", F.round("similarity", 6).alias("similarity"))
    return s.withColumn("bucket", topics.bucket(F.col("similarity"), 0.6, 0.3))


_WHOLE_TRIAGE_SQL = """WITH s AS (SELECT a.vec_id, max(round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6)) AS similarity FROM embeddings a, embeddings b WHERE b.vec_id % 50 = 0 GROUP BY 1),
t AS (SELECT vec_id, similarity, CASE WHEN similarity >= 0.6 THEN 'auto' WHEN similarity >= 0.3 THEN 'borderline' ELSE 'below' END AS bucket FROM s)"""


@query("similarity_triage_whole", _WHOLE_TRIAGE_SQL + " SELECT * FROM t")
def similarity_triage_whole(spark, d):
    """As similarity_triage, with every vector whose id is divisible by 50 as a reference, however many they are."""
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    s = topics.max_similarity(e, "vec_id", "embedding", e.where("vec_id % 50 = 0"), "vec_id", "embedding")
    s = s.select("vec_id", F.round("similarity", 6).alias("similarity"))
    return s.withColumn("bucket", topics.bucket(F.col("similarity"), 0.6, 0.3))


@query("pair_cosines", f"SELECT a.vec_id, b.vec_id AS other, round({_DOT} / (sqrt(list_inner_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_inner_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]))), 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def pair_cosines(spark, d):
    e = table(spark, d, "embeddings")
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("vec_id").alias("other"), F.col("embedding").alias("e2"))
    return e.join(b, "vec_id").select("vec_id", "other", F.round(vectors.cosine(F.col("embedding"), F.col("e2")), 6).alias("cosine"))


_CENT_SQL = """u AS (SELECT vec_id, label, embedding::DOUBLE[] AS v, sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings), p AS (SELECT label, i, avg(v[i] / n) AS m FROM u, unnest(range(1, 65)) t(i) GROUP BY 1, 2),
l AS (SELECT label, sqrt(sum(m * m)) AS len FROM p GROUP BY 1), c AS (SELECT label, list(m / len ORDER BY i) AS centroid FROM p JOIN l USING (label) GROUP BY 1)"""


@query("topic_centroids", f"WITH {_CENT_SQL} SELECT label, list_transform(centroid, lambda x: round(x, 6)) AS centroid FROM c")
def topic_centroids(spark, d):
    c = topics.centroids(table(spark, d, "embeddings"), "label", "embedding")
    return c.select("label", F.transform("centroid", lambda x: F.round(x, 6)).alias("centroid"))


@query("representatives", f"WITH {_CENT_SQL}, s AS (SELECT label, vec_id, round(list_inner_product(v, centroid) / n, 6) AS s FROM u JOIN c USING (label)) SELECT label, vec_id, r::INT AS place FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY s DESC, vec_id) AS r FROM s) WHERE r <= 10")
def representatives(spark, d):
    e = table(spark, d, "embeddings")
    near = e.join(topics.centroids(e, "label", "embedding"), "label").withColumn("s", F.round(vectors.cosine(F.col("embedding"), F.col("centroid")), 6))
    return windows.top_per_group(near, ["label"], [F.desc("s"), "vec_id"], 10).select("label", "vec_id", "place")


@query("nearest_topics", f"WITH {_CENT_SQL}, s AS (SELECT vec_id, c.label, round(list_inner_product(v, centroid) / n, 6) AS s FROM u, c) SELECT vec_id, CASE WHEN max(s) >= 0.2 THEN arg_min(label, (-s, label)) ELSE -1 END AS label, max(s) AS similarity FROM s GROUP BY 1")
def nearest_topics(spark, d):
    e = table(spark, d, "embeddings")
    n = topics.nearest_centroid(e.select("vec_id", "embedding"), "vec_id", "embedding", topics.centroids(e, "label", "embedding"), "label", 0.2)
    return n.withColumn("similarity", F.round("similarity", 6))


_CT_SQL = r"""t AS (SELECT doc_kind AS topic, unnest(regexp_extract_all(lower(text), '(\p{L}{4,})', 1)) AS token FROM documents WHERE doc_kind IS NOT NULL), tf AS (SELECT topic, token, count(*) AS n FROM t GROUP BY 1, 2), f AS (SELECT token, sum(n) AS f FROM tf GROUP BY 1), w AS (SELECT topic, sum(n) AS w FROM tf GROUP BY 1), a AS (SELECT floor(avg(w)) AS a FROM w)"""


@query("class_tfidf", f"WITH {_CT_SQL} SELECT topic, token, n::BIGINT AS n, round(sqrt(n / w) * ln(1 + a / f), 6) AS weight FROM tf JOIN f USING (token) JOIN w USING (topic), a")
def class_tfidf(spark, d):
    docs = table(spark, d, "documents").where("doc_kind IS NOT NULL")
    tok = docs.select(F.col("doc_kind").alias("topic"), F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}{4,})"), F.lit(1))).alias("token"))
    return topics.class_tfidf(tok, "topic", "token").withColumn("weight", F.round("weight", 6))


@query("diverse_words")
def diverse_words(spark, d):
    e = table(spark, d, "embeddings")
    scored = e.join(topics.centroids(e, "label", "embedding"), "label").withColumn("score", F.round(vectors.cosine(F.col("embedding"), F.col("centroid")), 6)).withColumn("word", F.col("vec_id").cast("string"))
    return topics.diverse_top(scored.select("label", "word", "score", "embedding"), "label", "word", "score", "embedding", 5)


@query("density_clusters")
def density_clusters(spark, d):
    return topics.density_clusters(table(spark, d, "embeddings"), "vec_id", "embedding", least=0.55, core=3, smallest=5)


@query("topic_summary")
def topic_summary(spark, d):
    e = table(spark, d, "embeddings").join(table(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), "text"), "vec_id")
    tok = F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}{4,})"), F.lit(1))
    return selection.topic_summary(e, "vec_id", "label", "embedding", tok)


@query("topic_triage", "SELECT vec_id AS id, label AS topic_id, CASE WHEN label = 0 THEN 'noise' WHEN label IN (1, 2) THEN 'candidate' WHEN label = 3 THEN CASE WHEN vec_id % 3 = 0 THEN 'candidate' ELSE 'mixed_review' END ELSE 'other' END AS outcome FROM (SELECT vec_id, CASE WHEN label = 0 THEN 0 ELSE label END AS label FROM embeddings)")
def topic_triage(spark, d):
    a = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.when(F.col("label") == 0, -1).otherwise(F.col("label")).alias("topic_id"))
    log = files.literal(spark, [("t", "1", "n", 1), ("t", "1", "y", 2), ("t", "2", "y", 1), ("t", "3", "m", 1)], "triage_id string, key string, decision string, decided_at int")
    now = selection.decisions_now(log).select(F.col("key").cast("int").alias("topic_id"), "decision")
    docs = a.select("id", F.when(F.col("id") % 3 == 0, "y").alias("decision")).where("decision IS NOT NULL")
    out = selection.topic_triage(a, now, docs)
    return out.select("id", F.when(F.col("topic_id") == -1, 0).otherwise(F.col("topic_id")).alias("topic_id"), "outcome")


@query("triage_applied", "SELECT DISTINCT vec_id FROM embeddings WHERE vec_id < 50 OR (vec_id BETWEEN 50 AND 99 AND vec_id % 2 = 0)")
def triage_applied(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.lit("2020-01-01").alias("date"))
    dec = e.select(F.col("vec_id").alias("key"), F.when(F.col("vec_id") % 2 == 0, "y").otherwise("n").alias("decision"))
    return selection.triage_apply(e.where("vec_id < 50"), e.where("vec_id BETWEEN 50 AND 99"), dec, "vec_id", "date").select("vec_id")


@query("triage_applied_whole", _WHOLE_TRIAGE_SQL + " SELECT vec_id FROM t WHERE bucket = 'auto' OR (bucket = 'borderline' AND vec_id % 2 = 0)")
def triage_applied_whole(spark, d):
    """As triage_applied, fed from the buckets of the whole table."""
    s = similarity_triage_whole(spark, d).withColumn("date", F.lit("2020-01-01"))
    dec = s.select(F.col("vec_id").alias("key"), F.when(F.col("vec_id") % 2 == 0, "y").otherwise("n").alias("decision"))
    return selection.triage_apply(s.where("bucket = 'auto'"), s.where("bucket = 'borderline'"), dec, "vec_id", "date").select("vec_id")


@query("final_selection", _POOL_SQL + ", x AS (SELECT u.*, year(try_strptime(substr(id, 6, 4), '%Y'))::INT % 10 AS topic_id FROM u) SELECT title, id FROM x WHERE source = 'both' OR starts_with(title, 'Erste') OR topic_id = 3 OR id = (SELECT min(id) FROM u)")
def final_selection(spark, d):
    u = _pool(spark, d).withColumn("topic_id", F.substring("id", 6, 4).try_cast("int") % 10)
    dec = u.select(F.col("title").alias("key"), F.when(F.startswith("title", F.lit("Erste")), "y").otherwise("n").alias("decision"))
    picks = u.orderBy("id").limit(1)
    return selection.final_set(selection.require_decided(u, "source"), "title", dec, files.literal(spark, [(3,)], "topic_id int"), picks).select("title", "id")


@query("children_attached", f"""WITH {_PARENTS_SQL}, b AS (SELECT child, parent FROM w WHERE x = 1), k AS (SELECT id, (len(title) % 7)::INT AS topic FROM t)
SELECT s.id, coalesce(pk.topic, k.topic) AS topic_id, CASE WHEN NOT is_child THEN 'cluster' WHEN pk.topic IS NOT NULL THEN 'parent' ELSE 'transform' END AS topic_source, b.parent AS parent_id FROM s JOIN k USING (id) LEFT JOIN b ON b.child = s.id LEFT JOIN k pk ON pk.id = b.parent""")
def children_attached(spark, d):
    topic_of = table(spark, d, "final_policy_set").where("title IS NOT NULL AND date_published IS NOT NULL").groupBy("id").agg((F.length(F.min("title")) % 7).alias("topic_id"))
    return selection.attach_children(_titled(spark, d), topic_of, "date_published")


@query("gold_sample", "SELECT id FROM (SELECT DISTINCT id FROM final_policy_set) ORDER BY md5('42|' || id), id LIMIT (SELECT round_even(count(DISTINCT id) * 0.10, 0)::BIGINT FROM final_policy_set)")
def gold_sample(spark, d):
    return labelling.gs_sample(table(spark, d, "final_policy_set").select("id").distinct(), "id")


@query("per_topic_sample", "SELECT label, vec_id FROM (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY md5('7|' || label || '|' || vec_id), vec_id) AS r FROM embeddings WHERE vec_id >= 20) WHERE r <= 4")
def per_topic_sample(spark, d):
    e = table(spark, d, "embeddings").select("label", "vec_id")
    return sample.per_group_sample(e, "label", "vec_id", 4, 7, e.where("vec_id < 20"))


@query("annotations_merged", """WITH o AS (SELECT id, 'crisis_ref' AS field, gs_labels['crisis_ref'].value AS value, gs_labels['crisis_ref'].coder AS coder, gs_labels['crisis_ref'].date AS date FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY gold_row) AS r FROM gold WHERE gs_labels IS NOT NULL) WHERE r = 1))
SELECT id, field, CASE WHEN value IS DISTINCT FROM '1' THEN '1' ELSE value END AS value, CASE WHEN value IS DISTINCT FROM '1' THEN 'new' ELSE coder END AS coder, CASE WHEN value IS DISTINCT FROM '1' THEN '2026-11-01' ELSE date END AS date FROM o""")
def annotations_merged(spark, d):
    g = dedup.keep_best(table(spark, d, "gold").where("gs_labels IS NOT NULL").select("id", "gold_row", "gs_labels"), ["id"], F.col("gold_row"))
    x = F.element_at("gs_labels", F.lit("crisis_ref"))
    old = g.select("id", F.lit("crisis_ref").alias("field"), x["value"].alias("value"), x["coder"].alias("coder"), x["date"].alias("date"))
    new = g.select("id", F.lit("crisis_ref").alias("field"), F.lit("1").alias("value"), F.lit("new").alias("coder"), F.lit("2026-11-01").alias("date"))
    return labelling.annotate_merge(old, new, ["id", "field"])


@query("annotation_progress", "SELECT id, count(DISTINCT field) FILTER (value IS NOT NULL)::BIGINT AS n_done, count(DISTINCT field) FILTER (value IS NOT NULL) = 4 AS complete FROM (SELECT id, e.key AS field, e.value.value AS value FROM (SELECT id, unnest(map_entries(gs_labels)) AS e FROM gold WHERE gs_labels IS NOT NULL)) WHERE field IN ('social_policy_field_1', 'social_policy_field_2', 'crisis_ref', 'legally_effective') GROUP BY id")
def annotation_progress(spark, d):
    g = table(spark, d, "gold").where("gs_labels IS NOT NULL").select("id", F.explode("gs_labels").alias("field", "x")).select("id", "field", F.col("x.value").alias("value"))
    return labelling.completeness(g, "id", ["social_policy_field_1", "social_policy_field_2", "crisis_ref", "legally_effective"])


@query("label_shares", """WITH l AS (SELECT p.year, coalesce(p.year >= 2008, false) AS recent, f.social_policy_field_1 AS label FROM policy_fields f JOIN (SELECT id, any_value(year) AS year FROM final_policy_set GROUP BY id) p USING (id) WHERE p.year BETWEEN 1995 AND 2020 AND NOT coalesce(label = 'none', false)),
n AS (SELECT CASE WHEN recent THEN 'late' ELSE 'early' END AS crisis, label, count(*)::BIGINT AS n FROM l GROUP BY 1, 2) SELECT crisis, label, n, round(n / sum(n) OVER (PARTITION BY crisis), 6) AS share FROM n""")
def label_shares(spark, d):
    p = table(spark, d, "final_policy_set").groupBy("id").agg(F.first("year").alias("year"))
    l = table(spark, d, "policy_fields").join(p, "id").select("year", F.when(F.col("year") >= 2008, "late").otherwise("early").alias("crisis"), F.col("social_policy_field_1").alias("label"))
    return coverage.label_distribution(l, "crisis", "year", 1995, 2020, F.col("label") == "none").withColumn("share", F.round("share", 6))


@query("prompt_length", "SELECT prompt_key, round(avg(len(list_filter(regexp_split_to_array(prompt, '[\\s\\p{Z}]+'), lambda w: w <> ''))), 6) AS mean_words, count(*)::BIGINT AS n FROM run_entries GROUP BY 1")
def prompt_length(spark, d):
    return table(spark, d, "run_entries").groupBy("prompt_key").agg(F.round(F.avg(T.word_count(F.col("prompt"))), 6).alias("mean_words"), F.count("*").alias("n"))


@query("source_errors")
def source_errors(spark, d):
    rows = [("A", "https://a.example", "DE", "law", ["x"], [2000, 2010]), ("", "ftp://b", "XX", "law", [], [2010, 2000]), (None, None, None, None, None, None)]
    return coverage.validate_sources(files.literal(spark, rows, "title string, url string, scope string, kind string, topics array<string>, timeframe array<int>"), ["DE", "FR"], ["law", "report"])


@query("uncovered_nations", "SELECT n_name FROM nation WHERE n_name NOT IN (SELECT n_name FROM nation JOIN supplier ON s_nationkey = n_nationkey WHERE s_acctbal > 9000)")
def uncovered_nations(spark, d):
    n = table(spark, d, "nation")
    rich = table(spark, d, "supplier").where("s_acctbal > 9000").join(n, F.col("s_nationkey") == F.col("n_nationkey"))
    return coverage.uncovered(n.select("n_name"), rich, "n_name", "n_name")


@query("best_engines")
def best_engines(spark, d):
    t = table(spark, d, "final_policy_set").where("full_text IS NOT NULL").groupBy("id").agg(F.min("full_text").alias("t"))
    one = lambda n, name, c: t.select(F.col("id").alias("doc"), F.lit(name).alias("engine"), F.lit(n).alias("engine_no"), F.col("t").alias("baseline_text"), c.alias("md_text"))
    return extraction.best_engine(one(1, "layout", F.regexp_replace("t", r"\d+", "")).unionByName(one(2, "legacy", F.regexp_replace("t", "Euro", ""))))


@query("quality_flags")
def quality_flags(spark, d):
    p = table(spark, d, "final_policy_set").groupBy("id").agg(F.min("full_text").alias("t"), F.min("num_pages").alias("pages"), F.min("issue_number").alias("number"))
    return extraction.quality_flags(p, "id", "t", "pages", "number")


@query("clean_line_counts")
def clean_line_counts(spark, d):
    p = table(spark, d, "final_policy_set").where("full_text IS NOT NULL").groupBy("id").agg(F.min("full_text").alias("t"))
    return extraction.clean_lines(p, "id", "t").select("id", F.size("lines").alias("n"))


@query("merged_parts")
def merged_parts(spark, d):
    p = table(spark, d, "page_metadata").select(F.col("id").alias("doc"), F.col("page_row").alias("part_no"), F.concat_ws("_", F.when(F.col("page_row") % 2 == 0, "regelungstext").otherwise("anlage"), "issue_number").alias("name"), F.coalesce("title", F.lit("")).alias("text"))
    return extraction.merge_parts(p)


# --- star schema: the plain joins and aggregates at size ------------------------------------------------------


@query("revenue_by_nation", """SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*)::BIGINT AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey
WHERE o_orderdate >= TIMESTAMP '1996-01-01' GROUP BY n_name""")
def revenue_by_nation(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("v"))
    o = table(spark, d, "orders").where("o_orderdate >= TIMESTAMP '1996-01-01'").select("o_orderkey", "o_custkey")
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    per = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_custkey").agg(F.sum("v").alias("v"), F.count("*").alias("n"))
    j = per.join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey").agg(F.sum("v").alias("v"), F.sum("n").alias("n"))
    return j.join(F.broadcast(table(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey")).select("n_name", F.round("v", 2).alias("revenue"), "n")


@query("pricing_summary", """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(avg(l_discount), 6) AS avg_disc, count(*)::BIGINT AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2""")
def pricing_summary(spark, d):
    li = table(spark, d, "lineitem").where("l_shipdate <= TIMESTAMP '1998-09-02'")
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"))


@query("orders_without_items", "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def orders_without_items(spark, d):
    return table(spark, d, "orders").select("o_orderkey").join(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_anti")


@query("customers_with_orders", "SELECT c_custkey, count(o_orderkey)::BIGINT AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def customers_with_orders(spark, d):
    n = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return table(spark, d, "customer").select("c_custkey").join(n, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"))


@query("top_parts_by_brand", "SELECT p_brand, p_partkey, r::INT AS place FROM (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS r FROM part) WHERE r <= 3")
def top_parts_by_brand(spark, d):
    return windows.top_per_group(table(spark, d, "part"), ["p_brand"], [F.desc("p_retailprice"), "p_partkey"], 3).select("p_brand", "p_partkey", "place")


# --- sources and streams over the driver's files ---------------------------------------------------------------


@query("paged_service")
def paged_service(spark, d):
    from tallyloom.sources import pages

    spark.dataSource.register(pages.PagedSource)
    return spark.read.format("tallyloom_paged").option("from", "2019").option("to", "2022").option("fetcher", "fixture").load()


@query("probe_log")
def probe_log(spark, d):
    from tallyloom.sources import pages

    return pages.probe(table(spark, d, "page_metadata").select("year"), lambda y, n: "ok" if n <= y % 10 + 3 and n != 2 else "error" if n == 2 else "not_found")


@query("pages_parsed")
def pages_parsed(spark, d):
    from tallyloom.sources import pages

    p = table(spark, d, "page_metadata")
    esc = lambda c: F.coalesce(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(""))
    html = F.concat(F.lit("<html><body><h1>"), esc(F.col("title")), F.lit("</h1><p>VBl. I 2023 Nr. "), F.col("issue_number"), F.lit("</p><p>FNA: "), esc(F.col("fna_raw")), F.lit('</p><a href="x/a.pdf#1">pdf</a><a href="a.zip">zip</a></body></html>'))
    return pages.parse_pages(p.select("page_row", html.alias("html")), "page_row", "html")


@query("event_windows", "SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS \"end\", count(*)::BIGINT AS n FROM events GROUP BY 1, 2")
def event_windows(spark, d):
    """The streaming window count, run to its end over the table as a stream of one batch."""
    from tallyloom.streaming import events as S

    return S.windowed_counts(table(spark, d, "events"), "ts", ["event_type"], "1 hour", None, "2 hours")


@query("events_replayed", "SELECT event_type, count(*)::BIGINT AS n FROM events GROUP BY 1")
def events_replayed(spark, d):
    """The table replayed through a stream with checkpoint into a latest-state table by event, then counted."""
    import os
    import uuid

    from tallyloom.runtime import ensure_checkpoint_dir
    from tallyloom.streaming import events as S

    base = f"{ensure_checkpoint_dir(spark)}/replay-{uuid.uuid4().hex}"
    src = table(spark, d, "events")
    path = f"{d}/events.parquet"
    stream = S.replay(spark, path if not os.path.isfile(path) else d, src.schema) if not os.path.isfile(path) else spark.readStream.schema(src.schema).option("pathGlobFilter", "events.parquet").parquet(d)
    S.upsert_latest(stream, ["event_id"], ["ts", "event_id"], f"{base}/state", f"{base}/checkpoint").awaitTermination()
    return value_counts(S.read_latest(spark, f"{base}/state"), "event_type")


# --- sets, caches, further reports --------------------------------------------------------------------------


@query("common_ids", "SELECT DISTINCT id FROM gold WHERE id IN (SELECT id FROM policy_fields)")
def common_ids(spark, d):
    return sets.common_keys(table(spark, d, "gold"), table(spark, d, "policy_fields"), "id")


@query("ids_of_all_tables", "SELECT id FROM gold UNION SELECT id FROM policy_fields UNION SELECT id FROM run_entries")
def ids_of_all_tables(spark, d):
    return sets.union_keys([table(spark, d, n) for n in ("gold", "policy_fields", "run_entries")], "id")


@query("unassigned_ids", "SELECT DISTINCT id FROM final_policy_set WHERE id NOT IN (SELECT id FROM policy_fields WHERE id IS NOT NULL)")
def unassigned_ids(spark, d):
    return sets.missing_keys(table(spark, d, "final_policy_set"), table(spark, d, "policy_fields"), "id")


@query("repeated_log_rows", "SELECT year, number, attempt, status FROM fetch_log EXCEPT ALL SELECT DISTINCT year, number, attempt, status FROM fetch_log")
def repeated_log_rows(spark, d):
    f = table(spark, d, "fetch_log").select("year", "number", "attempt", "status")
    return sets.multiset_difference(f, f.distinct())


@query("score_parts", "SELECT id, CASE WHEN similarity_score > 0.73 THEN 'above' WHEN similarity_score > 0.5 AND similarity_score < 0.73 THEN 'probe' ELSE 'rest' END AS part FROM final_policy_set")
def score_parts(spark, d):
    s = F.col("similarity_score")
    return sets.split(table(spark, d, "final_policy_set").select("id", "similarity_score"), {"above": s > 0.73, "probe": (s > 0.5) & (s < 0.73)}).select("id", "part")


@query("cached_texts", "WITH c AS (SELECT DISTINCT coalesce(text, '') AS t FROM documents WHERE doc_id % 3 = 0) SELECT doc_id, coalesce(text, '') IN (SELECT t FROM c) AS is_cached FROM documents")
def cached_texts(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    key = sets.content_key("m", 512, F.col("text"))
    cache = docs.where("doc_id % 3 = 0").select(key.alias("cache_key"), F.length("text").alias("value"))
    return sets.cache_lookup(docs, cache, key, "value").select("doc_id", "is_cached")


@query("prompt_length_vs_f1", _ML_SQL + ", w AS (SELECT prompt_key, avg(len(list_filter(regexp_split_to_array(prompt, '[\\s\\p{Z}]+'), lambda w: w <> ''))) AS words FROM run_entries GROUP BY 1) SELECT model, prompt_key, round(words, 6) AS mean_words, round(mf, 6) AS macro_f1 FROM mf JOIN w USING (prompt_key)")
def prompt_length_vs_f1(spark, d):
    w = table(spark, d, "run_entries").groupBy("prompt_key").agg(F.avg(T.word_count(F.col("prompt"))).alias("words"))
    return joins.lookup(_macro(spark, d), w, ["prompt_key"]).select(*_RUN, F.round("words", 6).alias("mean_words"), F.round("macro_f1", 6).alias("macro_f1"))


@query("f1_with_alpha", _ML_SQL + """, n AS (SELECT model, prompt_key, id, unnest([gf1, f1]) AS v FROM al WHERE gf1 IN (""" + _CLS + """) AND f1 IN (""" + _CLS + """)), k AS (SELECT model, prompt_key, id, v, count(*)::DOUBLE AS n FROM n GROUP BY ALL),
u AS (SELECT model, prompt_key, id, sum(n * n) AS sq FROM k GROUP BY ALL), sx AS (SELECT model, prompt_key, 2.0 * count(*) AS t, sum(4 - sq) AS d FROM u GROUP BY ALL), c AS (SELECT model, prompt_key, v, sum(n) AS c FROM k GROUP BY ALL), cc AS (SELECT model, prompt_key, sum(c * c) AS cc FROM c GROUP BY ALL)
SELECT model, prompt_key, round(mf, 6) AS macro_f1, CASE WHEN (t * t - cc) / (t - 1) > 0 THEN round(1 - d / ((t * t - cc) / (t - 1)), 6) END AS alpha FROM sx JOIN cc USING (model, prompt_key) JOIN mf USING (model, prompt_key)""")
def f1_with_alpha(spark, d):
    rows = _aligned(spark, d).where(F.col("gf1").isin(L.FIELDS) & F.col("f1").isin(L.FIELDS))
    long = rows.select(F.concat_ws("|", *_RUN).alias("variable"), F.col("id").alias("unit"), F.explode(F.array(F.struct(F.lit("gold").alias("coder"), F.col("gf1").alias("value")), F.struct(F.lit("model").alias("coder"), F.col("f1").alias("value")))).alias("r"))
    a = reliability.alpha(long.select("variable", "unit", "r.coder", "r.value"))
    m = _macro(spark, d).withColumn("variable", F.concat_ws("|", *_RUN))
    return m.join(a, "variable").select(*_RUN, F.round("macro_f1", 6).alias("macro_f1"), F.round("alpha", 6).alias("alpha"))


# the rest of the queries register themselves
from tallyloom import queries_sources, queries_text  # noqa: E402, F401
