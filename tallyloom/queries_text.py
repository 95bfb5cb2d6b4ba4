"""Further queries of functions and small operators over the driver's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.functions import dates
from tallyloom.functions import labels as L
from tallyloom.functions import text as T
from tallyloom.operators import sample, windows
from tallyloom.queries import SQL, query, table


def _re2(pattern: str) -> str:
    """A pattern of the Unicode kind for an engine whose classes are ASCII."""
    return pattern.replace(r"\s", r"[\s\p{Z}]").replace(r"\w", r"[\p{L}\p{N}_]").replace(r"\d", r"\p{Nd}").replace("'", "''")


def _replaced(expr: str, pattern: str, to: str) -> str:
    return f"regexp_replace({expr}, '{pattern}', '{to}', 'g')"


def _clean_title_sql(c: str) -> str:
    t = _replaced(c, r"[\x{80}-\x{9f}]", " ")
    for p in T.TITLE_NOISE:
        t = _replaced(t, "(?i)" + _re2(p), " ")
    short = r"len(list_filter(regexp_split_to_array(k, '[-/–.]'), lambda p: p <> '' AND NOT regexp_matches(p, '^(?:\p{Nd}+|\p{Lu}.{0,2}|\p{Lu}.*[\p{Lu}\p{Nd}].*)$'))) = 0"
    kept = rf"list_filter(regexp_split_to_array(regexp_replace(x, '^\(|\)$', '', 'g'), '[\s\p{{Z}}]+'), lambda k: k <> '' AND NOT ({short}))"
    inner = f"CASE WHEN len({kept}) > 0 THEN '(' || array_to_string({kept}, ' ') || ')' ELSE '' END"
    t = rf"array_to_string(list_transform(regexp_extract_all({t}, '\([^()]*\)|[^()]+|[()]'), lambda x: CASE WHEN regexp_matches(x, '^\([^()]*\)$') THEN {inner} ELSE x END), '')"
    # an ordinal before "Buch" is kept by a mark that is taken off again
    t = _replaced(t, rf"(?i)({_re2(T.ORDINAL)})([\s\p{{Z}}]+Buch)", r"QQQ\1\2")
    t = f"replace({_replaced(t, '(?i)' + _re2(T.ORDINAL), '')}, 'QQQ', '')"
    t = _replaced(_replaced(_replaced(t, r"\([\s\p{Z}]+", "("), r"[\s\p{Z}]+\)", ")"), r"\(\)", " ")
    t = _replaced(_replaced(t, r"[\s\p{Z}]+", " "), r"^[ ,;:\-–]+|[ ,;:\-–]+$", "")
    return f"coalesce(nullif({t}, ''), {c})"


_CLASS_SQL = "CASE WHEN regexp_matches(title, '(?i)^[\\s\\p{Z}]*Berichtigung\\b') THEN 'correction' WHEN regexp_matches(title, '(?i)^[\\s\\p{Z}]*Anlage(nband)?\\b') THEN 'annex' ELSE 'regular' END"
_REFERENCED_SQL = r"regexp_extract(title, '(?is)^\s*(?:Berichtigung|Anlage(?:nband)?)\s+(?:de[rs]|zu[mr]?)\s+(.+?)\s*$', 1)"
SQL["titles_cleaned"] = f"SELECT id, {_clean_title_sql('title')} AS clean, {_CLASS_SQL} AS doc_class, {_REFERENCED_SQL} AS referenced FROM final_policy_set"

_BODY_SQL = rf"""p AS (SELECT row_number() OVER () AS n, id, title, full_text AS x, {_clean_title_sql('title')} AS clean, {_CLASS_SQL} AS doc_class, nullif({_REFERENCED_SQL}, '') AS referenced FROM final_policy_set),
b AS (SELECT *, lower(regexp_replace(coalesce(x, ''), '[^\p{{L}}\p{{N}}]', '', 'g')) AS bare, left(lower(regexp_replace(coalesce(title, ''), '[^\p{{L}}\p{{N}}]', '', 'g')), {T.TITLE_LETTERS}) AS want FROM p),
s AS (SELECT *, CASE WHEN want <> '' AND contains(bare, want) THEN list_filter(range(1, len(x) + 1), lambda i: regexp_matches(x[i], '[\p{{L}}\p{{N}}]'))[strpos(bare, want)] ELSE 1 END AS start FROM b),
d AS (SELECT *, substr(x, start) AS y, regexp_extract(substr(x, start), '(?m)^\s*Vom\s+\d{{1,2}}\.\s*(?:{T.MONTHS})\s+\d{{4}}\s*$') AS line FROM s),
e AS (SELECT *, CASE WHEN line <> '' AND strpos(y, line) <= {T.DATE_LINE_WITHIN} THEN substr(y, strpos(y, line) + len(line)) ELSE y END AS z FROM d),
f AS (SELECT *, regexp_replace(regexp_replace(left(z, 3000), '(?m)^.*Bundesgesetzblatt\s+Jahrgang\s+\d{{4}}\s+Teil\s+I\s+Nr\..*$', ' ', 'g'), '([\p{{L}}\p{{N}}_])-\n[\s\p{{Z}}]*([a-zäöüß])', '\1\2', 'g') AS w FROM e),
g AS (SELECT *, coalesce(left(trim(regexp_replace(trim(regexp_replace(w, '[\s\p{{Z}}]+', ' ', 'g')), 'Der Bundestag hat (?:mit Zustimmung des Bundesrates )?das folgende Gesetz beschlos(?:sen:|-)\s*', '', 'g')), 1000), '') AS body FROM f)"""
SQL["topic_texts"] = f"WITH {_BODY_SQL} SELECT id, doc_class, clean AS clean_title, referenced, CASE WHEN body = '' THEN clean WHEN clean IS NULL THEN body ELSE clean || '. ' || body END AS embed_text FROM g"


# --- small text functions ------------------------------------------------------------------------------------


@query("plain_lines", r"SELECT ord, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace('## <b>' || title || '</b> | *' || coalesce(journal, '') || '*', '<[^>]+>', ' ', 'g'), '^#+\s*', ''), '[*_`]+', '', 'g'), '\|', ' ', 'g'), '[\s\p{Z}]+', ' ', 'g'), ' ') AS line FROM biblio")
def plain_lines(spark, d):
    md = F.concat(F.lit("## <b>"), F.col("title"), F.lit("</b> | *"), F.coalesce("journal", F.lit("")), F.lit("*"))
    return table(spark, d, "biblio").select("ord", T.plain_markdown(md).alias("line"))


@query("text_shapes", r"""SELECT doc_id, coalesce(regexp_matches(text, '(?m)^\|[-:| ]+\|$'), false) AS has_table, floor(len(text) / 4)::BIGINT AS tokens, replace(source, '/', '-') AS file_part FROM documents""")
def text_shapes(spark, d):
    return table(spark, d, "documents").select("doc_id", F.coalesce(T.has_table(F.col("text")), F.lit(False)).alias("has_table"), T.token_estimate(F.col("text")).alias("tokens"), T.safe_name(F.col("source")).alias("file_part"))


@query("template_sections", "SELECT DISTINCT prompt_key, 'Read ' || prompt_key AS system, 'Code ' || prompt_key || chr(10) || 'now' AS user, 'Read ' || prompt_key || chr(10) || chr(10) || 'Code ' || prompt_key AS both FROM run_entries")
def template_sections(spark, d):
    """A markdown template with two headings taken apart, and sections joined without the empty ones."""
    k = table(spark, d, "run_entries").select("prompt_key").distinct()
    md = F.concat(F.lit("# System\n\nRead "), F.col("prompt_key"), F.lit("\n\n## User\nCode "), F.col("prompt_key"), F.lit("\nnow\n"))
    a, b = T.two_sections(md, "System", "User")
    return k.select("prompt_key", a.alias("system"), b.alias("user"), T.join_sections(a, F.lit(""), F.regexp_replace(b, "\nnow$", "")).alias("both"))


@query("page_links", r"SELECT page_row, split_part(url_eli, '#', 1) AS plain, regexp_extract(url_web, '^([a-z][a-z0-9+.-]*://[^/]+)', 1) || '/x/a.pdf' AS rooted, url_zip AS full FROM page_metadata WHERE url_web LIKE '%://%' AND url_zip LIKE '%://%'")
def page_links(spark, d):
    p = table(spark, d, "page_metadata").where("url_web LIKE '%://%' AND url_zip LIKE '%://%'")
    return p.select("page_row", T.without_fragment(F.col("url_eli")).alias("plain"), T.join_url(F.col("url_web"), F.lit("/x/a.pdf")).alias("rooted"), T.join_url(F.col("url_web"), F.col("url_zip")).alias("full"))


@query("page_fields", "SELECT page_row, nullif(trim(regexp_replace(lead_ministry, '[\\s\\p{Z}]+', ' ', 'g')), '') AS ministry, nullif(trim(regexp_replace(coalesce(sachgebiet, '') || ' more', '[\\s\\p{Z}]+', ' ', 'g')), '') AS area, 'gap' AS place FROM page_metadata WHERE NOT coalesce(regexp_matches(lead_ministry || sachgebiet, '(?i)^[\\s\\p{Z}]*(ministry|area|place):'), false)")
def page_fields(spark, d):
    """Values behind labels in lines: on the same line, on several up to the next label, and on the next line."""
    p = table(spark, d, "page_metadata").where("NOT coalesce(lead_ministry || sachgebiet rlike '(?i)^[\\\\s\\\\p{Z}]*(ministry|area|place):', false)")
    tidy = lambda c: T.collapse(F.coalesce(c, F.lit("")))
    lines = F.array(F.concat(F.lit("Ministry: "), tidy(F.col("lead_ministry"))), F.lit("Area:"), tidy(F.col("sachgebiet")), F.lit(" more"), F.lit("PLACE:"), F.lit("gap"))
    value = lambda n: F.nullif(T.labelled_values(lines, n, ["ministry", "area", "place"]), F.lit(""))
    return p.select("page_row", value("ministry").alias("ministry"), value("area").alias("area"), T.labelled_field(lines, "place").alias("place"))


@query("date_labels", "SELECT entry_id, split_part(lower(x), 't', 1) AS day, coalesce(regexp_matches(x, '^[0-9]{4}-(0[1-9]|1[0-2])$'), false) AS is_month, coalesce(x, '') <= coalesce(id, '') AS not_later, coalesce(regexp_matches(x, '^[0-9]+[a-zA-Z]?$'), false) AS is_article FROM (SELECT entry_id, id, llm_labels['legally_effective'].value AS x FROM run_entries)")
def date_labels(spark, d):
    x = L.unwrap(F.col("llm_labels"), "legally_effective")
    return table(spark, d, "run_entries").select("entry_id", dates.without_time(x).alias("day"), dates.is_month(x).alias("is_month"), dates.not_later(x, F.col("id")).alias("not_later"), L.is_article(x).alias("is_article"))


@query("flags_by_type", "SELECT entry_id, CASE WHEN v IN ('0', '1') THEN v::INT WHEN v IN ('true', 'false') THEN (v = 'true')::INT END AS typed, CASE WHEN v = '1' THEN 1 WHEN v = '0' THEN 0 END AS quoted FROM (SELECT entry_id, llm_labels['crisis_ref'].value AS v FROM run_entries)")
def flags_by_type(spark, d):
    """0/1 read by type: a bare value as JSON (1.0 is none), and the same between quotes."""
    v = L.unwrap(F.col("llm_labels"), "crisis_ref")
    quoted = F.to_json(F.struct(v.alias("v")))
    return table(spark, d, "run_entries").select(
        "entry_id", L.variant_flag(F.try_parse_json(v)).alias("typed"), L.variant_flag(F.try_variant_get(F.try_parse_json(quoted), "$.v", "variant")).alias("quoted")
    )


@query("objects_found", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN json_extract(props, '$.k')::INT WHEN 1 THEN json_extract(props, '$.k')::INT WHEN 2 THEN json_extract(props, '$.k')::INT END AS k FROM events")
def objects_found(spark, d):
    """The object in an answer: nested and with a brace in the tail, behind a stray brace in a fenced block, with a brace in a string, and none."""
    p, n = F.col("props"), F.col("event_id") % 4
    raw = F.when(n == 0, F.concat(F.lit('Here: {"a": {"b": {"c": "}"}}, "v": '), p, F.lit("} and {that}"))).when(n == 1, F.concat(F.lit('A { brace, then\n```json\n{"v": '), p, F.lit("}\n```"))).when(n == 2, F.concat(F.lit('{"v": '), p, F.lit(', "s": "x } y"} tail'))).otherwise(F.lit("[1, 2]"))
    return table(spark, d, "events").select("event_id", F.try_variant_get(F.try_parse_json(L.first_object(raw)), "$.v.k", "int").alias("k"))


# --- small operators -----------------------------------------------------------------------------------------


@query("dates_in_order", "SELECT id, row_number() OVER (ORDER BY coalesce(date_published, ''), id)::INT AS place FROM (SELECT id, min(date_published) AS date_published FROM final_policy_set GROUP BY id) ORDER BY coalesce(date_published, ''), id LIMIT 100")
def dates_in_order(spark, d):
    """The hundred earliest by the text of the date, missing ones first."""
    p = table(spark, d, "final_policy_set").groupBy("id").agg(F.min("date_published").alias("date"))
    return windows.first_in_order(p, dates.date_order(F.col("date"), F.col("id")), 100).select("id", "place")


@query("issues_in_order", "SELECT key, row_number() OVER (ORDER BY year NULLS FIRST, n, number NULLS FIRST)::INT AS place FROM (SELECT DISTINCT year || '/' || number AS key, year, coalesce(try_cast(regexp_extract(number, '^([0-9]+)', 1) AS INT), 0) AS n, number FROM fetch_log WHERE year IS NOT NULL AND number IS NOT NULL) ORDER BY 2 LIMIT 200")
def issues_in_order(spark, d):
    f = table(spark, d, "fetch_log").where("year IS NOT NULL AND number IS NOT NULL").select(F.concat_ws("/", "year", "number").alias("key")).distinct()
    return windows.first_in_order(f, T.issue_order(F.col("key")), 200).select("key", "place")


@query("spot_check", "SELECT id FROM (SELECT DISTINCT id FROM final_policy_set) ORDER BY md5('3|' || id), id LIMIT 25")
def spot_check(spark, d):
    return sample.spot_check(table(spark, d, "final_policy_set").select("id").distinct(), "id", 25, seed=3)


@query("category_codes", "SELECT page_row, (dense_rank() OVER (ORDER BY doc_type) - 1)::INT AS code FROM page_metadata WHERE doc_type IS NOT NULL UNION ALL SELECT page_row, -1 FROM page_metadata WHERE doc_type IS NULL")
def category_codes(spark, d):
    return windows.category_codes(table(spark, d, "page_metadata").select("page_row", "doc_type"), "doc_type", "code").select("page_row", "code")


@query("display_labels", "SELECT id, CASE social_policy_field_1 WHEN 'taxes' THEN 'Taxes' WHEN 'none' THEN 'No social policy' END AS label FROM policy_fields")
def display_labels(spark, d):
    return table(spark, d, "policy_fields").select("id", L.recode(F.col("social_policy_field_1"), {"taxes": "Taxes", "none": "No social policy"}).alias("label"))


@query("label_by_alias", "SELECT gold_row, coalesce(gs_labels['effective'].value, gs_labels['legally_effective'].value) AS value, coalesce(array_length(map_keys(gs_labels)) > 0 AND list_has_any(map_keys(gs_labels), ['effective', 'legally_effective']), false) AS is_present FROM gold")
def label_by_alias(spark, d):
    value, present = L.by_alias(F.col("gs_labels"), ["effective", "legally_effective"])
    return table(spark, d, "gold").select("gold_row", value.alias("value"), present.alias("is_present"))


@query("integer_keys", "SELECT entry_id, ['1', '2', '10'] AS keys, [coalesce(id, ''), prompt_key, model] AS vals FROM run_entries")
def integer_keys(spark, d):
    m = F.create_map(F.lit("10"), F.col("model"), F.lit("2"), F.col("prompt_key"), F.lit("1"), F.coalesce("id", F.lit("")))
    e = T.by_integer_key(m)
    return table(spark, d, "run_entries").select("entry_id", T.first_of_pairs(e, "key").alias("keys"), T.first_of_pairs(e, "value").alias("vals"))


@query("seed_list", "SELECT row_number() OVER (ORDER BY domain, pos)::INT - 1 AS place, domain, seed FROM seeds WHERE domain IS NOT NULL")
def seed_list(spark, d):
    """A map of lists in one list, in order of the keys."""
    per = table(spark, d, "seeds").where("domain IS NOT NULL").groupBy("domain").agg(F.array_sort(F.collect_list(F.struct("pos", "seed"))).alias("l"))
    one = per.agg(F.array_sort(F.collect_list(F.struct("domain", "l"))).alias("all"))
    flat = F.flatten(F.transform("all", lambda x: F.transform(x["l"], lambda s: F.struct(x["domain"].alias("domain"), s["seed"].alias("seed")))))
    return one.select(F.posexplode(flat).alias("place", "x")).select("place", "x.domain", "x.seed")


@query("dataset_tags", "SELECT DISTINCT 'ger_' || array_to_string(regexp_extract_all(file_name || ' 2008-2015 2019-2022', '[0-9]{4}-[0-9]{4}'), '_') AS tag FROM run_entries")
def dataset_tags(spark, d):
    return table(spark, d, "run_entries").select(T.dataset_tag(F.lit("Germany"), F.concat("file_name", F.lit(" 2008-2015 2019-2022"))).alias("tag")).distinct()


@query("merged_records", "SELECT id, 'x' AS title, year, similarity_score, 1 AS extra FROM final_policy_set")
def merged_records(spark, d):
    """Record spread: fields of the right side win."""
    p = table(spark, d, "final_policy_set").select(F.struct("id", "title", "year").alias("a"), F.struct(F.lit("x").alias("title"), "similarity_score", F.lit(1).alias("extra")).alias("b"))
    return p.select(T.merged(p, "a", "b").alias("m")).select("m.*")


@query("missing_words", "SELECT word, n FROM (SELECT word, count(*)::BIGINT AS n FROM (SELECT unnest(regexp_extract_all(regexp_replace(full_text, '(?i)<br\\s*/?>', ' ', 'g'), '[\\p{L}\\p{N}_]+')) AS word FROM final_policy_set) WHERE regexp_matches(word, '^[0-9]+$') GROUP BY 1) ORDER BY n DESC, word LIMIT 8")
def missing_words(spark, d):
    """The words most often lost by an extraction, for its warnings."""
    from tallyloom.operators.aggregate import missing_words as lost

    p = table(spark, d, "final_policy_set").select("id", "full_text")
    return lost(p, "id", F.col("full_text"), F.regexp_replace("full_text", r"(?<![\p{L}\p{N}_])[0-9]+(?![\p{L}\p{N}_])", " "), T.tokens, 8)


@query("topic_terms", """WITH w AS (SELECT id, regexp_extract_all(lower(title), '[\\p{L}\\p{N}]+') AS w FROM final_policy_set WHERE title IS NOT NULL), g AS (SELECT id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM w WHERE len(w) > 0)
SELECT term, count(*)::BIGINT AS n FROM g GROUP BY 1 HAVING count(*) >= 3""")
def topic_terms(spark, d):
    """Runs of one and two words of the titles; the hook for a language model left empty."""
    words = T.lemmas(F.col("title"), lambda w: w, stop=[])
    return table(spark, d, "final_policy_set").select(F.explode(T.ngrams(words, 2)).alias("term")).groupBy("term").agg(F.count("*").alias("n")).where("n >= 3")


@query("glyph_gaps", "SELECT doc_id % 100 AS line, 3.0::DOUBLE AS median_gap, 3.0 > (1 + doc_id % 100) / 2.0 AS spaced FROM (SELECT DISTINCT doc_id % 100 AS doc_id FROM documents)")
def glyph_gaps(spark, d):
    """Gaps between the glyphs of a line: four glyphs, each as wide as the line's number and one, three apart."""
    from tallyloom.sources import pages

    w = F.col("line") + 1.0
    lines = table(spark, d, "documents").select((F.col("doc_id") % 100).alias("line")).distinct()
    glyphs = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.struct(F.lit("x").alias("c"), (i * (w + 3)).alias("x0"), (i * (w + 3) + w).alias("x1")))
    return pages.letter_gaps(lines.select("line", glyphs.alias("glyphs")))


# --- SQL of queries that stand elsewhere ---------------------------------------------------------------------

SQL["paged_service"] = "SELECT y::INT AS year, y || '-' || p || '-' || i AS id, 'Act ' || i || ' of ' || y AS title, 'Text ' || i AS text FROM range(2019, 2023) a(y), range(1, 3) b(p), range(1, 3) c(i)"
SQL["probe_log"] = """WITH y AS (SELECT DISTINCT year FROM page_metadata WHERE year IS NOT NULL), n AS (SELECT year, n, CASE WHEN n <= year % 10 + 3 AND n <> 2 THEN 'ok' WHEN n = 2 THEN 'error' ELSE 'not_found' END AS status FROM y, range(1, 30) t(n))
SELECT year, n::INT AS number, status FROM n WHERE n <= year % 10 + 8"""
_WORDS_SQL = "tok AS (SELECT ord, unnest(regexp_extract_all(lower(coalesce(title, '') || ' ' || coalesce(abstract, '')), '\\p{L}{4,}')) AS kw FROM biblio), tf AS (SELECT ord, kw, count(*) AS n FROM tok GROUP BY 1, 2), df AS (SELECT kw, count(*) AS df FROM tf GROUP BY 1), s AS (SELECT ord, kw, round(n * ln((SELECT count(*) FROM biblio)::DOUBLE / df), 6) AS score FROM tf JOIN df USING (kw)), r AS (SELECT *, row_number() OVER (PARTITION BY ord ORDER BY score DESC, kw) AS place FROM s)"
SQL["tfidf_frequency"] = f"WITH {_WORDS_SQL} SELECT kw AS item, count(*)::BIGINT AS n FROM r WHERE place <= 5 GROUP BY 1 ORDER BY n DESC, min(struct_pack(ord, place)) LIMIT 50"
_ONE_TEXT_SQL = "p AS (SELECT id, min(full_text) AS t, min(num_pages) AS pages, min(issue_number) AS number FROM final_policy_set GROUP BY id)"
SQL["quality_flags"] = rf"""WITH {_ONE_TEXT_SQL}, c AS (SELECT id, coalesce(t, '') AS t, pages, number, regexp_extract(coalesce(t, ''), '(?i)^.{{0,400}}?\bnr\. (\p{{N}}+\p{{L}}?)', 1) AS cited FROM p)
SELECT id, list_filter([CASE WHEN len(t) < 200 THEN 'short' END, CASE WHEN pages > 0 AND len(t) / pages < 300 THEN 'few_characters_per_page' END, CASE WHEN cited <> '' AND cited <> number THEN 'number_mismatch' END,
  CASE WHEN regexp_matches(t, '(?im)^\s*(amtliches verkündungsblatt|jahrgang \p{{N}}+|nr\. \p{{N}}+)') THEN 'masthead_left' END, CASE WHEN regexp_matches(t, '(?:\p{{L}} ){{4,}}\p{{L}}(?:[^\p{{L}}\p{{N}}_]|$)') THEN 'letter_spacing_left' END], lambda x: x IS NOT NULL) AS flags FROM c"""
SQL["merged_parts"] = """WITH p AS (SELECT id AS doc, page_row AS part_no, (CASE WHEN page_row % 2 = 0 THEN 'regelungstext' ELSE 'anlage' END) || coalesce('_' || issue_number, '') AS name, coalesce(title, '') AS text, page_row % 2 = 0 AS m FROM page_metadata),
o AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY NOT m, part_no) AS i FROM p)
SELECT doc, string_agg(CASE WHEN m OR i = 1 THEN text ELSE '## ' || name || chr(10) || chr(10) || text END, chr(10) || chr(10) ORDER BY i) AS text, (count(*) FILTER (m))::BIGINT AS n_main, count(*)::BIGINT AS n_parts FROM o GROUP BY doc"""
SQL["fingerprints"] = """WITH h AS (SELECT sha256(doc_id || chr(31) || coalesce(text, chr(0))) AS h FROM documents), s AS (SELECT count(*) AS n, sum(('0x' || substr(h, 1, 12))::BIGINT::HUGEINT) AS a, sum(('0x' || substr(h, 13, 12))::BIGINT::HUGEINT) AS b, sum(('0x' || substr(h, 25, 12))::BIGINT::HUGEINT) AS c, sum(('0x' || substr(h, 37, 12))::BIGINT::HUGEINT) AS d FROM h)
SELECT n::BIGINT AS n, sha256(n || ',' || a || ',' || b || ',' || c || ',' || d) AS sha256 FROM s"""
SQL["best_engines"] = r"""WITH t AS (SELECT id AS doc, min(full_text) AS t FROM final_policy_set WHERE full_text IS NOT NULL GROUP BY id), e AS (SELECT doc, 'layout' AS engine, 1 AS engine_no, t AS a, regexp_replace(t, '\d+', '', 'g') AS b FROM t UNION ALL SELECT doc, 'legacy', 2, t, regexp_replace(t, 'Euro', '', 'g') FROM t),
x AS (SELECT doc, engine, engine_no, unnest(regexp_extract_all(regexp_replace(a, '(?i)<br\s*/?>', ' ', 'g'), '[\p{L}\p{N}_]+')) AS w, 1 AS n, 0 AS m FROM e UNION ALL SELECT doc, engine, engine_no, unnest(regexp_extract_all(regexp_replace(b, '(?i)<br\s*/?>', ' ', 'g'), '[\p{L}\p{N}_]+')), 0, 1 FROM e),
c AS (SELECT doc, engine, engine_no, sum(n) AS n, greatest(sum(n) - sum(m), 0) AS l FROM x GROUP BY doc, engine, engine_no, w), s AS (SELECT doc, engine, engine_no, sum(l)::DOUBLE / greatest(sum(n), 1) AS loss FROM c GROUP BY 1, 2, 3),
f AS (SELECT e.doc, e.engine, e.engine_no, coalesce(loss, 0) AS loss FROM e LEFT JOIN s USING (doc, engine_no)), r AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY loss > 0.002, CASE WHEN loss > 0.002 THEN loss ELSE 0 END, engine_no) AS r FROM f)
SELECT doc, engine, loss, loss > 0.01 AS warn FROM r WHERE r = 1"""
SQL["clean_line_counts"] = r"""WITH p AS (SELECT id, min(full_text) AS t FROM final_policy_set WHERE full_text IS NOT NULL GROUP BY id),
l AS (SELECT id, list_filter(regexp_split_to_array(t, '\r?\n'), lambda x: NOT regexp_matches(x, '(?:^\s*Ein Service (des|der) )|(?:^\s*Seite \p{N}+ von \p{N}+\s*$)|(?:^\s*www\.\S+\s*$)')) AS l FROM p),
f AS (SELECT id, l, list_position(list_transform(l, lambda x: NOT regexp_matches(x, '(?i)^\s*(amtliches verkündungsblatt|jahrgang \p{N}+|nr\. \p{N}+)') AND trim(x) <> ''), true) AS first FROM l)
SELECT id, CASE WHEN first > 0 THEN len(l) - first + 1 ELSE 0 END::INT AS n FROM f"""
