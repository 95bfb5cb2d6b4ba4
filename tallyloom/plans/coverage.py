"""Reports: what was fetched, what is missing, how a corpus and its labels are spread."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions import labels as L
from tallyloom.functions import text as T
from tallyloom.operators.aggregate import describe, histogram, value_counts
from tallyloom.operators.joins import coverage
from tallyloom.operators.windows import latest_state


def fetch_state(log: DataFrame) -> DataFrame:
    """Latest attempt per ``(year, number)`` of an attempt log (``attempt``, then ``loaded_at``, then ``status`` decide), with ``n_attempts`` and ``recovered``."""
    n = log.groupBy("year", "number").agg(F.count("*").alias("n_attempts"), F.count_if(F.col("status") != "ok").alias("n_failed"))
    last = latest_state(log, ["year", "number"], ["attempt", "loaded_at", "status"])
    return last.join(n, ["year", "number"]).withColumn("recovered", (F.col("status") == "ok") & (F.col("n_failed") > 0))


def coverage_report(state: DataFrame) -> DataFrame:
    """Missing whole numbers per year with the reason of their latest miss, in a gap or in the tail."""
    n = state.withColumn("n", F.regexp_extract("number", r"^(\p{N}+)$", 1).try_cast("int")).where("n IS NOT NULL")
    return coverage(n.where("status = 'ok'").select("year", "n"), n.where("status <> 'ok'").select("year", "n", F.col("status").alias("reason")), "year", "n")


def validate_sources(df: DataFrame, scopes: list[str], kinds: list[str]) -> DataFrame:
    """``(row, errors)`` of a source catalogue ``(title, url, scope, kind, topics, timeframe)``."""
    checks = [
        (F.length(F.trim("title")) > 0, "title is missing"), (F.col("url").rlike(r"^https?://"), "url is no web address"), (F.col("scope").isin(scopes), "scope is unknown"), (F.col("kind").isin(kinds), "kind is unknown"),
        (F.size("topics") > 0, "no topic"), (F.size("timeframe") == 2, "timeframe needs two years"), (F.try_element_at("timeframe", F.lit(1)) <= F.try_element_at("timeframe", F.lit(2)), "timeframe is reversed"),
    ]
    return df.withColumn("errors", L.problems(*checks))


def uncovered(names: DataFrame, sources: DataFrame, name: str, scope: str) -> DataFrame:
    return names.join(sources.select(F.col(scope).alias(name)).distinct(), name, "left_anti")


def corpus_profile(df: DataFrame, text: Column, kind: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(word counts described by kind, rows by kind, histogram of word counts in 8 bins)."""
    w = df.select(kind, T.word_count(text).alias("words"))
    return describe(w, "words", kind), value_counts(df, kind), histogram(w, "words", 8)


def label_distribution(long: DataFrame, crisis: str, year: str, first: int, last: int, drop: Column | None = None) -> DataFrame:
    """Counts and shares of labels per crisis over a closed range of years; ``drop`` rows are left out first."""
    rows = long.where(F.col(year).between(first, last))
    rows = rows.where(~F.coalesce(drop, F.lit(False))) if drop is not None else rows
    n = rows.groupBy(crisis, "label").agg(F.count("*").alias("n"))
    t = n.groupBy(crisis).agg(F.sum("n").alias("t"))
    return n.join(t, crisis).select(crisis, "label", "n", (F.col("n") / F.col("t")).alias("share"))
