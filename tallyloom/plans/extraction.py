"""Full texts from alternative extractions: best engine, merged parts, quality flags."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyloom.functions import dates, text as T
from tallyloom.operators.aggregate import token_loss

#: Share of the plain text's words that a good extraction may lose, and the share that calls for a warning.
GOOD, WARN = 0.002, 0.01
BOILERPLATE = [r"^\s*Ein Service (des|der) ", r"^\s*Seite \p{N}+ von \p{N}+\s*$", r"^\s*www\.\S+\s*$"]
MASTHEAD = r"(?iu)^\s*(amtliches verkündungsblatt|jahrgang \p{N}+|nr\. \p{N}+)"


def clean_lines(df: DataFrame, key: str, md: str) -> DataFrame:
    """``(key, lines)``: boilerplate lines out, leading masthead lines out, letter-spaced words closed."""
    lines = F.filter(F.split(F.col(md), r"\r?\n"), lambda x: ~F.coalesce(x.rlike("|".join(f"(?:{b})" for b in BOILERPLATE)), F.lit(False)))
    first = F.array_position(F.transform(lines, lambda x: ~x.rlike(MASTHEAD) & (F.trim(x) != "")), True).cast("int")
    body = F.when(first > 0, F.slice(lines, first, F.greatest(F.size(lines) - first + 1, F.lit(0)))).otherwise(F.array().cast("array<string>"))
    return df.select(key, F.transform(body, lambda x: T.close_spacing(x)).alias("lines"))


def best_engine(df: DataFrame) -> DataFrame:
    """``(doc, engine, loss, warn)`` from ``(doc, engine, engine_no, baseline_text, md_text)``: the first engine with little loss, else the least loss, of equals the earlier."""
    keyed = df.withColumn("__k", F.struct("doc", "engine", "engine_no"))
    loss = token_loss(keyed, "__k", F.col("baseline_text"), F.col("md_text"), T.tokens).select("__k.*", "loss")
    w = W.partitionBy("doc").orderBy(F.col("loss") > GOOD, F.when(F.col("loss") > GOOD, F.col("loss")).otherwise(F.lit(0.0)), "engine_no")
    return loss.withColumn("r", F.row_number().over(w)).where("r = 1").select("doc", "engine", "loss", (F.col("loss") > WARN).alias("warn"))


def merge_parts(parts: DataFrame, main_mark: str = "regelungstext") -> DataFrame:
    """``(doc, text, n_main, n_parts)`` from ``(doc, part_no, name, text)``: main parts first, the others under a heading each.

    Without a main part the first one is taken for it.
    """
    is_main = F.contains(F.lower("name"), F.lit(main_mark))
    agg = parts.withColumn("m", is_main).groupBy("doc").agg(F.array_sort(F.collect_list(F.struct((~F.col("m")).alias("o"), "part_no", "name", "text"))).alias("p"), F.count_if("m").alias("n_main"), F.count("*").alias("n_parts"))
    one = F.transform("p", lambda x, i: F.when(~x["o"] | (i == 0), x["text"]).otherwise(F.concat(F.lit("## "), x["name"], F.lit("\n\n"), x["text"])))
    return agg.select("doc", F.array_join(one, "\n\n").alias("text"), "n_main", "n_parts")


def quality_flags(df: DataFrame, key: str, text: str, pages: str, number: str) -> DataFrame:
    """``(key, flags)``: short text, few characters per page, another number in the masthead, masthead left, letter-spacing left."""
    t = F.coalesce(F.col(text), F.lit(""))
    cited = F.regexp_extract(t, r"(?iu)^.{0,400}?\bnr\. (\p{N}+\p{L}?)", 1)
    flags = [
        (F.length(t) < 200, "short"),
        ((F.col(pages) > 0) & (F.length(t) / F.col(pages) < 300), "few_characters_per_page"),
        ((cited != "") & (cited != F.col(number)), "number_mismatch"),
        (t.rlike(MASTHEAD.replace("(?iu)", "(?ium)")), "masthead_left"),
        (F.size(T.letter_spacing(t)) > 0, "letter_spacing_left"),
    ]
    return df.select(key, F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for c, n in flags])).alias("flags"))


def to_policy_entry(pages: DataFrame) -> DataFrame:
    """Page metadata in the columns of the final policy set."""
    return pages.select(
        F.concat_ws("-", F.lit("vbl1"), F.col("year").cast("string"), F.col("issue_number"), F.lit("1")).alias("id"), "year", "issue_number", F.lit(1).alias("order_in_issue"), T.strip(F.col("title")).alias("title"), "doc_type",
        dates.iso_z(F.col("date_published")).alias("date_published"), dates.iso_z(F.col("date_law")).alias("date_law"), "url_web", F.try_element_at("url_pdfs", F.lit(1)).alias("url_pdf"), F.lit("pages").alias("system_sources"),
    )
