"""Loaders by format: each gives (labelled entries, ids without labels) of a data set."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallyloom.sources import files

Loader = Callable[[SparkSession, str], tuple[DataFrame, DataFrame]]
LOADERS: dict[str, Loader] = {}


def loader(name: str) -> Callable[[Loader], Loader]:
    def add(f: Loader) -> Loader:
        LOADERS[name] = f
        return f

    return add


@loader("gold_json")
def _gold(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return files.read_gold(spark, path)


@loader("run_json")
def _run(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    _, entries = files.read_runs(spark, path)
    return entries.where("llm_labels IS NOT NULL"), entries.where("llm_labels IS NULL").select("id")


def load(spark: SparkSession, form: str, path: str) -> tuple[DataFrame, DataFrame]:
    if form not in LOADERS:
        raise ValueError(f"no loader for {form}; there are {sorted(LOADERS)}")
    return LOADERS[form](spark, path)
