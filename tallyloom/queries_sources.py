"""Queries of sources, sinks and model calls: round trips over the driver's tables, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tallyloom.functions import text as T
from tallyloom.plans import labelling, literature, selection
from tallyloom.queries import query, table
from tallyloom.runtime import ensure_checkpoint_dir
from tallyloom.sources import files, pages


def _place(spark, name: str) -> str:
    """A folder of its own in the shared folder of the session."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("json_round_trip", "SELECT id, year, title, similarity_score FROM final_policy_set")
def json_round_trip(spark, d):
    p, out = table(spark, d, "final_policy_set").select("id", "year", "title", "similarity_score"), _place(spark, "json")
    files.write_json(p, out)
    return files.read_json(spark, out, p.schema, lines=True)


@query("gzip_round_trip", "SELECT doc_id, text FROM documents")
def gzip_round_trip(spark, d):
    p, out = table(spark, d, "documents").select("doc_id", "text"), _place(spark, "gzip")
    files.write_json(p, out, gzip=True)
    return files.read_json(spark, out, p.schema, lines=True)


@query("csv_round_trip", "SELECT ord::VARCHAR AS ord, title, doi, 'export' AS database FROM biblio WHERE title <> '' OR title IS NULL")
def csv_round_trip(spark, d):
    """Written as CSV, read back as text with the columns that are there and a constant tag; the file's name gives its format."""
    out = _place(spark, "csv")
    files.write_csv(table(spark, d, "biblio").where("title <> '' OR title IS NULL").select("ord", "title", "doi", "journal"), out)
    read = files.read_csv(spark, out, ["ord", "TITLE", "doi", "nowhere"])
    return files.with_file_name(read, r"\.([a-z]+)$", "kind", "database", "export").where("kind = 'csv'").select("ord", F.col("TITLE").alias("title"), "doi", "database")


@query("exports_unified", """SELECT 'a' AS database, title, year, doi, split_part(pagestart || '-' || pageend, '-', 1) AS pagestart, CASE WHEN title IS NOT NULL THEN lower(trim(regexp_replace(title, '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g'))) END AS title_normalized FROM biblio WHERE ord % 2 = 0
UNION ALL SELECT 'b', title, year, NULL, NULL, lower(trim(regexp_replace(title, '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g'))) FROM biblio WHERE ord % 2 = 1""")
def exports_unified(spark, d):
    """Two exports with other names and other columns in one schema."""
    b = table(spark, d, "biblio")
    one = b.where("ord % 2 = 0").select(F.col("title").alias("Document Title"), F.col("year").alias("Year"), F.col("doi").alias("DOI"), F.expr("pagestart || '-' || pageend").alias("Pages"))
    two = b.where("ord % 2 = 1").select(F.col("title").alias("TI"), F.col("year").alias("PY"))
    both = literature.unify({"a": (one, {"document title": "title"}), "b": (two, {"ti": "title", "py": "year"})})
    return both.select("database", "title", "year", "doi", "pagestart", "title_normalized")


@query("json_map", "SELECT id AS key, title, year FROM (SELECT id, min(title) AS title, min(year) AS year FROM final_policy_set WHERE id IS NOT NULL GROUP BY id)")
def json_map(spark, d):
    """A file that is one object of records by key: written line by line, read record by record."""
    out = _place(spark, "map")
    p = table(spark, d, "final_policy_set").where("id IS NOT NULL").groupBy("id").agg(F.min("title").alias("title"), F.min("year").alias("year"))
    p.select(F.to_json(F.create_map("id", F.struct("title", "year"))).alias("value")).write.text(out)
    lines = spark.read.text(out).select(F.explode(F.from_json("value", "map<string, struct<title: string, year: int>>")).alias("key", "record"))
    return lines.select("key", "record.title", "record.year")


@query("tagged_records", "SELECT title, year, eid, keywords, doctype FROM (SELECT trim(regexp_replace(title, '[\\s\\p{Z}\\p{C}]+', ' ', 'g')) AS title, year, '2-s2.0-' || ord AS eid, 'a; b' AS keywords, 'Article' AS doctype FROM biblio WHERE year BETWEEN 1000 AND 9999) WHERE title <> ''")
def tagged_records(spark, d):
    """Bibliographic records of tagged text, one file with several of them for each task; records without a title are skipped."""
    out = _place(spark, "tagged")
    b = table(spark, d, "biblio").where("year BETWEEN 1000 AND 9999")
    title = F.trim(F.regexp_replace(F.coalesce("title", F.lit("")), r"[\s\p{Z}\p{C}]+", " "))
    body = F.concat(F.lit("Authors of\n"), title, F.lit("\n("), F.col("year").cast("string"), F.lit(") Journal\nhttps://x?eid=2-s2.0-"), F.col("ord").cast("string"), F.lit("&p=1\nAUTHOR KEYWORDS: a; b\nDOCUMENT TYPE: Article\n"))
    b.select(body.alias("value")).write.text(out)
    return files.read_tagged_text(spark, out, "Authors of")


@query("gold_read", "SELECT id, 'labelled' AS part FROM gold WHERE gs_labels IS NOT NULL UNION ALL SELECT id, 'open' FROM gold WHERE gs_labels IS NULL")
def gold_read(spark, d):
    out = _place(spark, "gold")
    files.write_json(table(spark, d, "gold").select("id", "gs_labels"), out)
    labelled, open_ = files.read_gold(spark, out, lines=True)
    return labelled.select("id", F.lit("labelled").alias("part")).unionByName(open_.select("id", F.lit("open").alias("part")))


@query("guarded_output", "SELECT 'first' AS step, true AS written, (SELECT count(*) FROM seeds)::BIGINT AS n UNION ALL SELECT 'again', false, (SELECT count(*) FROM seeds) UNION ALL SELECT 'test', true, (SELECT count(*) FROM seeds WHERE pos = 1)")
def guarded_output(spark, d):
    """An output is written once; a test tag goes elsewhere and does not touch it; a replacement takes its place whole."""
    out, s = _place(spark, "guard"), table(spark, d, "seeds")
    steps = [("first", files.write_once(s, out)), ("again", files.write_once(s.limit(0), out))]
    files.replace_atomically(spark.read.parquet(out), out + "-new")
    tagged = files.write_tagged(s.where("pos = 1"), out, "test1")
    counts = [spark.read.parquet(out).count(), spark.read.parquet(out + "-new").count(), spark.read.parquet(tagged).count()]
    return files.literal(spark, [(n, w, c) for (n, w), c in zip([*steps, ("test", True)], counts)], "step string, written boolean, n bigint")


@query("latest_output", "SELECT domain, pos FROM seeds WHERE pos = 2")
def latest_output(spark, d):
    """The newest of several outputs by the date in their names."""
    out, s = _place(spark, "latest"), table(spark, d, "seeds").select("domain", "pos")
    for day, n in (("2024-01-31", 1), ("2025-03-01", 2), ("2024-12-01", 3)):
        s.where(F.col("pos") == n).write.parquet(f"{out}/run_{day}")
    return spark.read.parquet(files.latest_file(spark, out, r"_(\d{4}-\d{2}-\d{2})$"))


@query("user_sessions", """WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*)::BIGINT AS n FROM s GROUP BY user_id, k""")
def user_sessions(spark, d):
    from tallyloom.streaming import events as S

    return S.sessions(table(spark, d, "events").select("user_id", "ts"), "ts", "user_id", "30 minutes", "2 hours")


@query("requests_allowed")
def requests_allowed(spark, d):
    """Requests within both sliding windows of their key, by custom state over the table as a stream (no SQL: each answer depends on those before)."""
    import os

    from tallyloom.streaming import events as S

    out, schema = _place(spark, "limit"), table(spark, d, "events").schema
    path = f"{d}/events.parquet"
    stream = spark.readStream.schema(schema).parquet(path) if os.path.isdir(path) else spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    done = S.rate_limited(stream.select("event_type", "ts"), "event_type", "ts", 10, 200)
    done.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(done.schema).parquet(f"{out}/rows")


@query("details_fetched", "SELECT id, CASE WHEN right(id, 1) = '7' THEN '' ELSE 'Part 1 of ' || id || chr(10) || chr(10) || 'Part 2' END AS text, right(id, 1) = '7' AS failed, right(id, 1) = '3' AS is_cached FROM (SELECT DISTINCT id FROM final_policy_set WHERE id IS NOT NULL)")
def details_fetched(spark, d):
    """Second pass over all ids with a stand-in service; ids that end in 3 are in the cache, those in 7 fail."""

    def fetch(key: str) -> list[str]:
        if key.endswith("7"):
            raise pages.HttpStatus(404)
        return [f"Part 1 of {key}", "Part 2"]

    ids = table(spark, d, "final_policy_set").select("id")
    cache = ids.where("id LIKE '%3'").distinct().select("id", F.concat(F.lit("Part 1 of "), "id", F.lit("\n\nPart 2")).alias("text"), F.lit(False).alias("failed"))
    return pages.fetch_details(ids, cache, "id", fetch)


@query("request_status", "SELECT page_row, CASE page_row % 4 WHEN 0 THEN 'not_found' WHEN 1 THEN 'error' ELSE CASE WHEN issue_number IS NULL THEN 'unparsed' ELSE 'ok' END END AS status, CASE page_row % 4 WHEN 0 THEN NULL WHEN 1 THEN 'HTTP 503' ELSE CASE WHEN issue_number IS NULL THEN title END END AS detail FROM page_metadata")
def request_status(spark, d):
    code = F.when(F.col("page_row") % 4 == 0, 404).when(F.col("page_row") % 4 == 1, 503).otherwise(200)
    return table(spark, d, "page_metadata").select("page_row", pages.request_status(code, F.col("issue_number"), F.col("title")).alias("s")).select("page_row", "s.status", "s.detail")


@query("state_upgraded", """SELECT year, number, '{"pages":' || '{"' || number || '":' || attempt || '}' || ',"misses":{}}' AS state FROM fetch_log""")
def state_upgraded(spark, d):
    """A flat state and one of the new form give the same."""
    flat = F.concat(F.lit('{"'), F.col("number"), F.lit('":'), F.col("attempt").cast("string"), F.lit("}"))
    new = F.concat(F.lit('{"pages":'), flat, F.lit(',"misses":{}}'))
    return table(spark, d, "fetch_log").select("year", "number", pages.upgraded_state(F.when(F.col("attempt") % 2 == 0, flat).otherwise(new)).alias("state"))


@query("engines_cached", """WITH t AS (SELECT id, min(full_text) AS t FROM final_policy_set WHERE full_text IS NOT NULL GROUP BY id) SELECT id AS doc, e AS engine, (i - 1)::INT AS engine_no, (CASE WHEN e = 'layout' AND right(id, 1) = '3' THEN -1 WHEN e = 'layout' THEN len(t) ELSE len(upper(t)) END)::BIGINT AS n_chars, e = 'layout' AND right(id, 1) = '3' AS is_cached FROM t, (VALUES ('layout', 1), ('legacy', 2)) x(e, i)""")
def engines_cached(spark, d):
    """Every text through two engines, but for what the cache has (ids that end in 3, first engine)."""
    t = table(spark, d, "final_policy_set").where("full_text IS NOT NULL").groupBy(F.col("id").alias("doc")).agg(F.min("full_text").alias("t"))
    cache = t.where("doc LIKE '%3'").select("doc", F.lit("layout").alias("engine"), F.lit(None).cast("string").alias("md_text"), F.lit(1).cast("bigint").alias("n_pages"))
    engines = {"layout": lambda c: (c.decode(), 1), "legacy": lambda c: (c.decode(), 2)}
    out = pages.extract_cached(t.select("doc", F.encode("t", "UTF-8").alias("content")), cache, engines)
    return out.select("doc", "engine", "engine_no", F.coalesce(F.length("md_text"), F.lit(-1)).cast("bigint").alias("n_chars"), "is_cached")


@query("summaries", "SELECT ord, CASE WHEN abstract IS NOT NULL AND trim(regexp_replace(abstract, '[\\s\\p{Z}]+', ' ', 'g')) <> '' AND ord % 5 <> 0 THEN 'S' || len(abstract) END AS summary FROM biblio")
def summaries(spark, d):
    """One request for each abstract, with a stand-in client that fails at every fifth."""
    b = table(spark, d, "biblio").select("ord", F.when(F.col("ord") % 5 == 0, F.when(T.strip(F.col("abstract")) != "", "fail")).otherwise(F.col("abstract")).alias("t"))

    def client(system: str, user: str) -> str:
        if user == "fail":
            raise TimeoutError(user)
        return '{"summary": "S%d"}' % len(user)

    return labelling.summarise(b, "ord", "t", client)


@query("reduced_vectors", "SELECT vec_id, 5 AS dims FROM embeddings")
def reduced_vectors(spark, d):
    from tallyloom.operators import topics

    return topics.reduced(table(spark, d, "embeddings"), "vec_id", "embedding", 5).select("vec_id", F.size("reduced").alias("dims"))


@query("topics_fitted")
def topics_fitted(spark, d):
    """Clusters of the vectors and their terms (no SQL: clusters spread step by step)."""
    e = table(spark, d, "embeddings").withColumn("words", F.array(F.concat(F.lit("topic"), F.translate(F.col("label").cast("string"), "0123456789", "abcdefghij")), F.lit("word")))
    found, terms = selection.fit_topics(e, "vec_id", "embedding", F.col("words"), least=0.55, core=3, smallest=5, max_share=1.0)
    return found.groupBy("topic").agg(F.count("*").alias("n")).join(terms.groupBy("topic").agg(F.max_by("token", F.struct("weight", "token")).alias("best")), "topic", "left")
