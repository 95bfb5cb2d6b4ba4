"""File sources and sinks. Schemas are given, never inferred, where the caller knows them."""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RUN_FILE = r"^(?P<model>[^/]+?)__(?P<prompt>[^/]+?)__(?P<date>\d{4}-\d{2}(?:-\d{2})?)(?P<partial>_partial)?\.json(?:\.gz)?$"
VALUE = "struct<value: string, coder: string, date: string>"
RUN_SCHEMA = f"run_metadata struct<date: string, model: string, prompt_key: string, temperature: double, seed: bigint, top_p: double, input_file: string, system_fingerprints: string>, entries array<struct<id: string, llm_labels: map<string, {VALUE}>, llm_error: string>>"


def read_json(spark: SparkSession, path: str, schema: str | T.StructType, lines: bool = False) -> DataFrame:
    """A JSON array or an object per file, or with ``lines`` an object per line; plain or gzipped."""
    return spark.read.schema(schema).option("multiLine", not lines).json(path)


def read_json_map(spark: SparkSession, path: str, value_schema: str) -> DataFrame:
    """A JSON object of records: one row ``(key, record)`` per entry."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", f"map<string, {value_schema}>")).alias("key", "record"))


def read_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """The ``columns`` that a CSV with header has, all as text, in their order."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    have = {c.lower(): c for c in df.columns}
    return df.select(*[F.col(f"`{have[c.lower()]}`").alias(c) for c in columns if c.lower() in have])


def with_file_name(df: DataFrame, pattern: str, name: str, tag: str | None = None, tag_value: str | None = None) -> DataFrame:
    """Part of the file's name as a column, and a constant tag."""
    out = df.withColumn(name, F.regexp_extract(F.col("_metadata.file_name"), pattern, 1))
    return out.withColumn(tag, F.lit(tag_value)) if tag else out


def union_exports(frames: list[DataFrame]) -> DataFrame:
    """Union by name; a missing column is null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def rename(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Columns renamed by a mapping in any case; all other names in lower case."""
    low = {k.lower(): v for k, v in mapping.items()}
    return df.toDF(*[low.get(c.lower(), c.lower()) for c in df.columns])


def list_files(spark: SparkSession, folder: str, pattern: str) -> list[str]:
    """Paths of a folder whose names match, through Hadoop's file system (any store)."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(str(s.getPath()) for s in fs.listStatus(path) if re.search(pattern, s.getPath().getName())) if fs.exists(path) else []


def latest_file(spark: SparkSession, folder: str, pattern: str) -> str | None:
    """The file whose first group of ``pattern`` (a date, say) is greatest, of equals the greatest name."""
    found = [(re.search(pattern, os.path.basename(p)).group(1), p) for p in list_files(spark, folder, pattern)]
    return max(found)[1] if found else None


def read_runs(spark: SparkSession, folder: str, blacklist: list[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(runs, entries) of run files: a partial file counts only where there is no complete one for its model and prompt.

    The names are listed first and only the files that count are read.
    """
    best: dict[tuple[str, str], tuple] = {}
    for p in list_files(spark, folder, RUN_FILE):
        m = re.match(RUN_FILE, os.path.basename(p))
        key = (m["model"], m["prompt"])
        if m["model"] in blacklist:
            continue
        rank = (m["partial"] is None, m["date"], p)
        if key not in best or rank > best[key]:
            best[key] = rank
    paths = [r[2] for r in best.values()]
    df = read_json(spark, paths, RUN_SCHEMA) if paths else spark.createDataFrame([], RUN_SCHEMA)
    named = df.withColumn("file_name", F.col("_metadata.file_name")) if paths else df.withColumn("file_name", F.lit(None).cast("string"))
    prints = F.coalesce(F.from_json(F.col("run_metadata.system_fingerprints"), "array<string>"), F.array().cast("array<string>"))
    runs = named.select("file_name", "run_metadata.date", "run_metadata.model", "run_metadata.prompt_key", "run_metadata.temperature", "run_metadata.seed", "run_metadata.top_p", "run_metadata.input_file", prints.alias("system_fingerprints"))
    entries = named.select("file_name", F.col("run_metadata.model").alias("model"), F.col("run_metadata.prompt_key").alias("prompt_key"), F.explode("entries").alias("e")).select("file_name", "model", "prompt_key", "e.*")
    return runs, entries


def best_run_files(entries: DataFrame, blacklist: list[str] = ()) -> DataFrame:
    """Entries of complete files, and of partial ones where their model and prompt have no complete file."""
    kept = entries.where(~F.col("model").isin(list(blacklist))) if blacklist else entries
    complete = kept.where(~F.col("is_partial")).select("model", "prompt_key").distinct()
    return kept.where(~F.col("is_partial")).unionByName(kept.where("is_partial").join(complete, ["model", "prompt_key"], "left_anti"))


def read_gold(spark: SparkSession, path: str, lines: bool = False) -> tuple[DataFrame, DataFrame]:
    """(labelled entries, ids of entries without labels)."""
    df = read_json(spark, path, f"id string, gs_labels map<string, {VALUE}>", lines)
    return df.where("gs_labels IS NOT NULL"), df.where("gs_labels IS NULL").select("id")


def read_tagged_text(spark: SparkSession, path: str, anchor: str) -> DataFrame:
    """Bibliographic records of a text: split before each ``anchor``; a record without a ``(yyyy)`` line is skipped.

    Title is the line before the year's; keywords, doctype and eid come from their tags, each by itself.
    """
    rec = spark.read.text(path, wholetext=True).select(F.explode(F.split("value", rf"(?m)(?=^{anchor})")).alias("r"))
    tag = lambda t: F.nullif(F.trim(F.regexp_extract("r", rf"(?im)^{t}:\s*(.+)$", 1)), F.lit(""))
    title = F.nullif(F.trim(F.regexp_extract("r", r"(?m)^(.+)\r?\n\(\d{4}\)", 1)), F.lit(""))
    eid = F.nullif(F.regexp_extract("r", r"eid=([0-9A-Za-z.\-]+)", 1), F.lit(""))
    return rec.select(title.alias("title"), F.regexp_extract("r", r"(?m)^\((\d{4})\)", 1).try_cast("int").alias("year"), eid.alias("eid"), tag("(?:author )?keywords").alias("keywords"), tag("document type").alias("doctype")).where("title IS NOT NULL")


def read_jdbc(spark: SparkSession, url: str, table: str, key: str, low: int, high: int, parts: int, **options: str) -> DataFrame:
    """A database table read in ``parts`` ranges of a numeric key."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, partitionColumn=key, lowerBound=low, upperBound=high, numPartitions=parts, **options).load()


def literal(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


# --- sinks ----------------------------------------------------------------------------------------


def write_json(df: DataFrame, path: str, gzip: bool = False) -> None:
    """One JSON object per line, UTF-8; replaces what is there when it commits."""
    w = df.write.mode("overwrite")
    (w.option("compression", "gzip") if gzip else w).json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def write_once(df: DataFrame, path: str) -> bool:
    """Write unless an output is there; says whether it was written."""
    jvm = df.sparkSession.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return False
    df.write.mode("errorifexists").parquet(path)
    return True


def write_tagged(df: DataFrame, path: str, test: str | None = None) -> str:
    """Write; a test tag goes to a path of its own, so that real output is never replaced."""
    out = f"{path.rstrip('/')}_{test}" if test else path
    df.write.mode("overwrite").parquet(out)
    return out


def pending(entries: DataFrame, done: DataFrame, key: str, labels: str) -> DataFrame:
    """Entries whose key has no labels among ``done`` yet (failed ones are asked again)."""
    return entries.join(done.where(F.col(labels).isNotNull()).select(key).distinct(), key, "left_anti")


def render_log(title: str, parameters: dict, counts: dict, tables: dict[str, list[tuple]]) -> str:
    """A run log in markdown from bounded values that the caller has (observed metrics, top-k rows)."""
    out = [f"# {title}", "", "| parameter | value |", "|---|---|", *[f"| {k} | {v} |" for k, v in parameters.items()], "", "| count | value |", "|---|---|", *[f"| {k} | {v} |" for k, v in counts.items()]]
    for name, rows in tables.items():
        out += ["", f"## {name}", "", *["| " + " | ".join(map(str, r)) + " |" for r in rows]]
    return "\n".join(out) + "\n"


def observed(df: DataFrame, name: str, **metrics):
    """The frame with metrics that are there after its first action, without a second pass."""
    from pyspark.sql import Observation

    o = Observation(name)
    return df.observe(o, *[c.alias(n) for n, c in metrics.items()]), o


def replace_atomically(df: DataFrame, path: str) -> None:
    """Write beside ``path`` and put the new output in its place by a rename, so that a reader never meets half of it."""
    jvm = df.sparkSession.sparkContext._jvm
    p, part = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(path.rstrip("/") + ".part")
    fs = p.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration())
    df.write.mode("overwrite").parquet(part.toString())
    fs.delete(p, True)
    if not fs.rename(part, p):
        raise OSError(f"{part} could not take the place of {path}")


def write_log(spark: SparkSession, text: str, path: str) -> None:
    """A run log in a file that only may be read."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = fs.create(p, True)
    out.write(bytearray(text.encode()))
    out.close()
    fs.setPermission(p, jvm.org.apache.hadoop.fs.permission.FsPermission("444"))
