"""Bibliographic exports: one schema, duplicates, keywords, subsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions import text as T
from tallyloom.operators.aggregate import top_values
from tallyloom.operators.dedup import assembly_dedup, naive_dedup
from tallyloom.operators.windows import top_per_group
from tallyloom.sources.files import rename, union_exports

# fixed values: the standard columns
STANDARD = ["title", "abstract", "eid", "authors", "journal", "issue", "volume", "keywords", "doctype", "year", "doi", "pagestart", "pageend"]


def unify(exports: dict[str, tuple[DataFrame, dict[str, str]]]) -> DataFrame:
    """Exports ``database -> (frame, renames)`` in the standard columns with ``database`` and normalised keys."""
    frames = []
    for name, (df, mapping) in exports.items():
        r = rename(df, mapping)
        r = split_pages(r, "pages") if "pages" in r.columns else r
        frames.append(r.select(*[c for c in STANDARD if c in r.columns]).withColumn("database", F.lit(name)))
    both = union_exports(frames)
    return both.withColumn("title_normalized", T.normal_key(F.col("title"))).withColumn("abs_normalized", T.normal_key(F.col("abstract")) if "abstract" in both.columns else F.lit(None).cast("string"))


def split_pages(df: DataFrame, pages: str) -> DataFrame:
    """``pagestart`` and ``pageend`` from ``12-34``; other shapes give what they have."""
    p = F.split(pages, "-")
    return df.withColumn("pagestart", F.try_element_at(p, F.lit(1))).withColumn("pageend", F.try_element_at(p, F.lit(2)))


def merge_parsed(export: DataFrame, parsed: DataFrame, title: str) -> DataFrame:
    """Export with the fields of parsed records by title; a title parsed more than once counts once (least eid)."""
    from tallyloom.operators.dedup import keep_best

    one = keep_best(parsed, [title], F.struct("eid", "year"))
    return export.join(one, title, "left")


def dedup_naive(df: DataFrame, ord_col: str = "ord") -> DataFrame:
    return naive_dedup(df, "doi", "title_normalized", F.startswith("search_run", F.lit("globalsouth_")) if "is_globalsouth" not in df.columns else F.col("is_globalsouth"), ord_col)


def dedup_assembly(df: DataFrame, ord_col: str = "ord") -> DataFrame:
    return assembly_dedup(df, "doi", "title_normalized", F.startswith("search_run", F.lit("manual")), ord_col)


def tfidf_keywords(df: DataFrame, key: str, text: Column, k: int = 5) -> DataFrame:
    """``(key, keywords array<struct<kw, score>>)``: the best ``k`` words of each text by TF-IDF over the table, higher is better; blank texts have none."""
    tok = df.select(key, F.explode(F.regexp_extract_all(F.lower(text), F.lit(r"(\p{L}{4,})"), F.lit(1))).alias("kw"))
    tf = tok.groupBy(key, "kw").agg(F.count("*").alias("n"))
    dfreq = tf.groupBy("kw").agg(F.count("*").alias("df"))
    n = df.agg(F.count("*").alias("nd"))
    s = tf.join(dfreq, "kw").join(F.broadcast(n)).withColumn("score", F.round(F.col("n") * F.ln(F.col("nd") / F.col("df")), 6))
    best = top_per_group(s, [key], [F.desc("score"), "kw"], k)
    arr = best.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "kw", "score"))), lambda x: F.struct(x["kw"].alias("kw"), x["score"].alias("score"))).alias("keywords"))
    return df.select(key).join(arr, key, "left").withColumn("keywords", F.coalesce("keywords", F.array().cast("array<struct<kw: string, score: double>>")))


def keyword_frequency(keywords: DataFrame, key: str, k: int) -> DataFrame:
    return top_values(keywords, F.transform("keywords", lambda x: x["kw"]), key, k)


def partition_by_terms(df: DataFrame, text: Column, a: str, b: str, b_all: list[list[str]] = ()) -> DataFrame:
    """``part``: both, only_a, only_b or neither by two regular expressions (``b_all``: sets of parts that together count as b); null text is neither."""
    low = F.lower(text)
    has = lambda p: F.coalesce(text.rlike(f"(?iu){p}"), F.lit(False))
    hb = has(b)
    for parts in b_all:
        together = F.lit(True)
        for p in parts:
            together = together & F.contains(low, F.lit(p))
        hb = hb | F.coalesce(together, F.lit(False))
    ha = has(a)
    return df.withColumn("part", F.when(ha & hb, "both").when(ha, "only_a").when(hb, "only_b").otherwise("neither"))
