"""Pages, archives and paged services."""

from __future__ import annotations

import io
import re
import time
import zipfile
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

PAGE = "title string, number string, published string, area string, codes array<string>, zip_link string, pdf_links array<string>, status string"


class _Lines(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines, self.links, self.skip = [], [], 0

    def handle_starttag(self, tag, attrs):
        self.skip += tag in ("script", "style")
        if tag == "a":
            self.links += [v for k, v in attrs if k == "href" and v]

    def handle_endtag(self, tag):
        self.skip -= tag in ("script", "style")

    def handle_data(self, data):
        if not self.skip:
            self.lines += [x.strip() for x in data.split("\n") if x.strip()]


def _field(lines: list[str], label: str) -> str | None:
    for i, x in enumerate(lines):
        if x.lower().startswith(label.lower() + ":"):
            rest = x.split(":", 1)[1].strip()
            return rest or (lines[i + 1] if i + 1 < len(lines) else None)
    return None


def parse_pages(df: DataFrame, key: str, html: str, citation: str = r"\b(?:I|II) \d{4} Nr\. \d+[a-z]?\b") -> DataFrame:
    """``(key, title, number, published, area, codes, zip_link, pdf_links, status)`` of HTML pages (Python, Arrow batches).

    Title is the line before the one that cites the issue. A null page is ``not_found``, one without a number ``unparsed`` (its
    title is kept), else ``ok``. PDF links are a sorted set.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for k, h in zip(b["k"], b["h"]):
                if h is None:
                    out.append((k, None, None, None, None, None, None, None, "not_found"))
                    continue
                p = _Lines()
                p.feed(h)
                at = next((i for i, x in enumerate(p.lines) if re.search(citation, x)), None)
                title = p.lines[at - 1] if at else (p.lines[0] if p.lines else None)
                number = _field(p.lines, "Nummer") or (re.search(r"Nr\. (\d+[a-z]?)", p.lines[at]).group(1) if at is not None and re.search(r"Nr\. (\d+[a-z]?)", p.lines[at]) else None)
                codes = re.findall(r"(?<![\w-])\d{1,4}(?:-\d+)+[a-z]?(?![\w-])", _field(p.lines, "FNA") or "")
                zips = [x for x in p.links if x.lower().split("#")[0].endswith(".zip")]
                pdfs = sorted({x.split("#")[0] for x in p.links if x.lower().split("#")[0].endswith(".pdf")})
                out.append((k, title, number, _field(p.lines, "Veröffentlicht"), _field(p.lines, "Sachgebiet"), list(dict.fromkeys(codes)), zips[0] if zips else None, pdfs, "ok" if number else "unparsed"))
            yield pd.DataFrame(out, columns=["k", "title", "number", "published", "area", "codes", "zip_link", "pdf_links", "status"])

    return df.select(F.col(key).alias("k"), F.col(html).alias("h")).mapInPandas(run, f"k {kind}, {PAGE}").withColumnRenamed("k", key)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """``(archive, member, slug, is_pdf, size, content)``: one row per member of zip archives; slugs that collide get ``_2``, ``_3``…"""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p, c in zip(b["path"], b["content"]):
                out, seen = [], {}
                with zipfile.ZipFile(io.BytesIO(c)) as z:
                    for name in z.namelist():
                        if name.endswith("/"):
                            continue
                        data = z.read(name)
                        stem = re.sub(r"[^a-z0-9]+", "_", name.rsplit("/", 1)[-1].rsplit(".", 1)[0].lower().translate(str.maketrans({"ä": "ae", "ö": "oe", "ü": "ue", "ß": "ss"}))).strip("_") or "document"
                        seen[stem] = seen.get(stem, 0) + 1
                        out.append((p, name, stem if seen[stem] == 1 else f"{stem}_{seen[stem]}", name.lower().endswith(".pdf"), len(data), data))
                yield pd.DataFrame(out, columns=["archive", "member", "slug", "is_pdf", "size", "content"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, "archive string, member string, slug string, is_pdf boolean, size bigint, content binary")


def letter_gaps(lines: DataFrame) -> DataFrame:
    """``(line, median_gap, spaced)`` of glyph lines ``(line, glyphs array<struct<c, x0, x1>>)``: the median distance between neighbours and whether it is over half their width."""
    # neighbours are met inside the line's own array
    n = F.size("glyphs")
    pairs = F.when(n > 1, F.arrays_zip(F.slice("glyphs", F.lit(1), n - 1).alias("g"), F.slice("glyphs", F.lit(2), n - 1).alias("h")))
    g = lines.select("line", F.explode(pairs).alias("p")).select("line", (F.col("p.h.x0") - F.col("p.g.x1")).alias("gap"), (F.col("p.g.x1") - F.col("p.g.x0")).alias("w"))
    return g.groupBy("line").agg(F.percentile("gap", F.lit(0.5)).alias("median_gap"), F.percentile("w", F.lit(0.5)).alias("mw")).select("line", "median_gap", (F.col("median_gap") > F.col("mw") / 2).alias("spaced"))


class _YearPartition(InputPartition):
    def __init__(self, year: int):
        self.year = year


class PagedReader(DataSourceReader):
    def __init__(self, options):
        self.options = options

    def partitions(self):
        return [_YearPartition(y) for y in range(int(self.options["from"]), int(self.options["to"]) + 1)]

    def read(self, partition):
        """Pages of one year, following ``next`` until there is none."""
        fetch = _FETCHERS[self.options["fetcher"]]
        nxt = f"{partition.year}?page=1"
        while nxt:
            page = _retry(lambda n=nxt: fetch(n))
            for r in page["items"]:
                yield (partition.year, r.get("id"), r.get("title"), r.get("text"))
            nxt = page.get("next")


class PagedSource(DataSource):
    """Paged service as a Python data source, one partition per year. The fetcher is registered by name (there is no network here)."""

    @classmethod
    def name(cls):
        return "tallyloom_paged"

    def schema(self):
        return "year int, id string, title string, text string"

    def reader(self, schema):
        return PagedReader(self.options)


_FETCHERS: dict[str, Callable[[str], dict]] = {}


def register_fetcher(name: str, fetch: Callable[[str], dict]) -> None:
    _FETCHERS[name] = fetch


def fixture_fetcher(url: str) -> dict:
    """A stand-in service: two pages of two records for every year."""
    year, page = re.match(r"(\d+)\?page=(\d+)", url).groups()
    items = [{"id": f"{year}-{page}-{i}", "title": f"Act {i} of {year}", "text": f"Text {i}"} for i in (1, 2)]
    return {"items": items, "next": f"{year}?page=2" if page == "1" else None}


register_fetcher("fixture", fixture_fetcher)


# fixed values: answers after which a request is made again, how often, and the factor of the pauses
RETRY_STATUS, RETRIES, BACKOFF = (429, 500, 502, 503, 504), 3, 2.0


class HttpStatus(Exception):
    """An answer that is no page."""

    def __init__(self, code: int):
        super().__init__(f"HTTP {code}")
        self.code = code


class Busy(HttpStatus):
    """The service asks to wait."""

    def __init__(self):
        super().__init__(429)


def _retry(call: Callable[[], dict], tries: int = RETRIES + 1, base: float = BACKOFF, sleep=time.sleep, method: str = "GET") -> dict:
    """Call with exponential backoff; other methods than GET, other answers, and the last error are raised at once."""
    for n in range(tries):
        try:
            return call()
        except (HttpStatus, TimeoutError) as e:
            if n == tries - 1 or method != "GET" or (isinstance(e, HttpStatus) and e.code not in RETRY_STATUS):
                raise
            sleep(base * 2**n)


def request_status(code: Column, number: Column, title: Column) -> Column:
    """``(status, detail)`` of a detail request: 404 is ``not_found``, another failure ``error``, a page without the number ``unparsed`` with its title, else ``ok``."""
    status = F.when(code == 404, "not_found").when((code >= 400) | code.isNull(), "error").when(number.isNull(), "unparsed").otherwise("ok")
    detail = F.when(status == "unparsed", title).when(status == "error", F.concat(F.lit("HTTP "), F.coalesce(code.cast("string"), F.lit("failed"))))
    return F.struct(status.alias("status"), detail.alias("detail"))


def fetch_details(ids: DataFrame, cache: DataFrame, key: str, fetch: Callable[[str], list[str]]) -> DataFrame:
    """``(key, text, failed, is_cached)``: second pass, one request for every id that ``cache`` (key, text, failed) has not.

    The parts of a document are joined by a blank line. A failure gives the empty text, is flagged, and is cached like any
    other, so it is not asked for again.
    """
    kind = ids.schema[key].dataType.simpleString()
    known = cache.select(F.col(key).alias("k"), "text", "failed").dropDuplicates(["k"])
    wanted = ids.where(F.col(key).isNotNull()).select(F.col(key).alias("k")).distinct()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts, failed = [], []
            for k in b["k"]:
                try:
                    texts.append("\n\n".join(_retry(lambda k=k: fetch(k))))
                    failed.append(False)
                except (HttpStatus, TimeoutError, OSError):
                    texts.append("")
                    failed.append(True)
            yield pd.DataFrame({"k": b["k"], "text": texts, "failed": failed})

    new = wanted.join(known.select("k"), "k", "left_anti").mapInPandas(run, f"k {kind}, text string, failed boolean").withColumn("is_cached", F.lit(False))
    old = known.join(wanted, "k", "left_semi").withColumn("is_cached", F.lit(True))
    return new.unionByName(old).withColumnRenamed("k", key)


def download_json(spark: SparkSession, fetch: Callable[[], object], path: str) -> DataFrame:
    """One document of a service, stored as it is with indents and read as one row ``(value)`` of text."""
    import json

    from tallyloom.sources.files import write_log

    write_log(spark, json.dumps(_retry(fetch), indent=2, ensure_ascii=False), path)
    return spark.read.text(path, wholetext=True)


def upgraded_state(state: Column) -> Column:
    """State of a fetch run as JSON with ``pages`` and ``misses``; an older flat one becomes the pages, null an empty state."""
    empty = '{"pages":{},"misses":{}}'
    new = F.get_json_object(state, "$.pages").isNotNull() & F.get_json_object(state, "$.misses").isNotNull()
    return F.when(state.isNull(), F.lit(empty)).when(new, state).otherwise(F.concat(F.lit('{"pages":'), state, F.lit(',"misses":{}}')))


def extract_cached(docs: DataFrame, cache: DataFrame, engines: dict[str, Callable[[bytes], tuple[str, int]]], force: bool = False) -> DataFrame:
    """``(doc, engine, engine_no, md_text, n_pages, is_cached)``: every document through every engine, unless ``cache`` (doc, engine, md_text, n_pages) has it.

    ``docs`` has ``doc`` and ``content``. ``force`` runs all engines again. A document that an engine cannot read has null
    text. The engines are functions of bytes, in their order of preference; a library for a format is plugged in here.
    """
    names = list(engines)
    every = docs.select("doc", "content", F.posexplode(F.array(*[F.lit(n) for n in names])).alias("engine_no", "engine"))
    held = cache.where(F.col("engine").isin(names)).select("doc", "engine", "md_text", "n_pages").dropDuplicates(["doc", "engine"])
    todo = every if force else every.join(held.select("doc", "engine"), ["doc", "engine"], "left_anti")
    kind = docs.schema["doc"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for c, e in zip(b["content"], b["engine"]):
                try:
                    out.append(engines[e](c) if c is not None else (None, None))
                except Exception:  # noqa: BLE001
                    out.append((None, None))
            yield pd.DataFrame({"doc": b["doc"], "engine": b["engine"], "engine_no": b["engine_no"], "md_text": [x[0] for x in out], "n_pages": pd.array([x[1] for x in out], "Int64")})

    new = todo.select("doc", "engine", "engine_no", "content").mapInPandas(run, f"doc {kind}, engine string, engine_no int, md_text string, n_pages bigint").withColumn("is_cached", F.lit(False))
    if force:
        return new
    old = every.drop("content").join(held, ["doc", "engine"]).withColumn("is_cached", F.lit(True))
    return new.unionByName(old.select(*new.columns))


def probe(groups: DataFrame, fetch: Callable[[int, int], str], stop: int = 5, highest: int = 2000) -> DataFrame:
    """``(year, number, status)``: numbers asked one after the other in each year until ``stop`` misses or errors in a row.

    One year is one task's work, as each answer decides on the next request.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for y in b["year"]:
                out, miss, err = [], 0, 0
                for n in range(1, highest + 1):
                    s = fetch(int(y), n)
                    out.append((int(y), n, s))
                    if s == "error":
                        err += 1
                    else:
                        err, miss = 0, 0 if s == "ok" else miss + 1
                    if miss >= stop or err >= stop:
                        break
                yield pd.DataFrame(out, columns=["year", "number", "status"])

    return groups.select("year").distinct().mapInPandas(run, "year int, number int, status string")
