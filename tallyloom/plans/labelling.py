"""Labelling runs: prompts, model calls through an injected client, samples and annotations."""

from __future__ import annotations

import random
import time
from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions import labels as L
from tallyloom.functions import text as T
from tallyloom.operators.sample import share_sample


class RateLimiter:
    """At most ``per_minute`` and ``per_hour`` requests, by sliding windows over the caller's own requests."""

    def __init__(self, per_minute: int | None, per_hour: int | None = None, clock: Callable[[], float] = time.time, sleep: Callable[[float], None] = time.sleep):
        self.limits = [(60.0, per_minute, 0.5), (3600.0, per_hour, 1.0)]
        self.clock, self.sleep, self.past = clock, sleep, deque()

    def wait(self) -> float:
        waited = 0.0
        for span, most, extra in self.limits:
            if most is None:
                continue
            while True:
                now = self.clock()
                while self.past and self.past[0] < now - 3600.0:
                    self.past.popleft()
                inside = [t for t in self.past if t >= now - span]
                if len(inside) < most:
                    break
                pause = inside[0] + span - now + extra
                self.sleep(pause)
                waited += pause
        self.past.append(self.clock())
        return waited


def with_backoff(call: Callable[[], str], retry: dict[type, float], tries: int = 5, sleep: Callable[[float], None] = time.sleep, rng: Callable[[], float] = random.random) -> str:
    """Call again after the errors named in ``retry`` (error type -> base seconds), doubled each time with up to 25 % on top."""
    for n in range(tries):
        try:
            return call()
        except tuple(retry) as e:
            if n == tries - 1:
                raise
            base = next(b for k, b in retry.items() if isinstance(e, k))
            sleep(base * 2**n * (1 + 0.25 * rng()))
    raise AssertionError("unreachable")


def prompts(spark: SparkSession, instructions: dict[str, str], definitions: str, justification: str, examples: str) -> DataFrame:
    """``(prompt_key, system, user, shot, scope, def, jus)``: the 16 variants of four two-valued dimensions, generated as a product.

    The text is examples, instruction, definitions, justification and the placeholders of the document, empty parts left out.
    """
    dims = spark.range(16).select(*[((F.col("id") / 2**i).cast("int") % 2).alias(n) for i, n in enumerate(("shot", "scope", "def", "jus"))])
    key = F.concat_ws("_", F.when(F.col("scope") == 1, "single").otherwise("batch"), F.when(F.col("shot") == 1, "few"), F.when(F.col("def") == 1, "def"), F.when(F.col("jus") == 1, "jus"))
    body = T.join_sections(
        F.when(F.col("shot") == 1, examples).otherwise(""), F.when(F.col("scope") == 1, instructions["single"]).otherwise(instructions["batch"]), F.when(F.col("def") == 1, definitions).otherwise(""),
        F.when(F.col("jus") == 1, justification).otherwise(""), F.lit("TITLE: {title}\nDATE: {date}\nTEXT: {text}"),
    )
    numbered = dims.withColumn("n", F.col("shot") + 2 * F.col("scope") + 4 * F.col("def") + 8 * F.col("jus") + 1)
    return numbered.select(F.concat(F.lit("v"), F.col("n"), F.lit("_"), key).alias("prompt_key"), F.lit("You code legal texts.").alias("system"), body.alias("user"), "shot", "scope", "def", "jus")


def output_schema(fields: dict[str, list[str] | None], strict: bool = True) -> dict:
    """JSON schema of an answer: text fields, or enumerations where a field has classes."""
    props = {k: {"type": "string", "enum": v} if v else {"type": "string"} for k, v in fields.items()}
    return {"type": "object", "properties": props, "required": list(fields), "additionalProperties": not strict}


def stub_client(system: str, user: str) -> str:
    """Deterministic stand-in for a model: a label by a checksum of the prompt, now and then wrapped or broken."""
    n = sum(user.encode()) % 97
    body = '{"social_policy_field_1": "%s", "social_policy_field_2": "na", "crisis_ref": %d}' % (L.FIELDS[n % 10], n % 2)
    return "not json" if n % 13 == 0 else f"Here it is:\n```json\n{body}\n```" if n % 5 == 0 else body


def classify_run(entries: DataFrame, models: DataFrame, prompt_table: DataFrame, client: Callable[[str, str], str], key: str, title: str, date: str, text: str, coded_on: str) -> DataFrame:
    """``(key, model, prompt_key, llm_labels, llm_error)``: every entry with every model and prompt (two tiny tables) through the client.

    Null fields of an entry fill the template as empty. An answer without an object, or a failing call, gives null labels and
    the error. ``models`` has ``model``.
    """
    tasks = entries.crossJoin(F.broadcast(models.select("model"))).crossJoin(F.broadcast(prompt_table.select("prompt_key", "system", "user")))
    filled = T.fill_template(F.col("user"), {"title": F.col(title), "date": F.substring(F.col(date), 1, 10), "text": F.col(text)})
    kind = entries.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            raw, err = [], []
            for s, u in zip(b["system"], b["u"]):
                try:
                    raw.append(client(s, u))
                    err.append(None)
                except Exception as e:  # noqa: BLE001
                    raw.append(None)
                    err.append(f"{type(e).__name__}: {e}")
            yield pd.DataFrame({"k": b["k"], "model": b["model"], "prompt_key": b["prompt_key"], "raw": raw, "llm_error": err})

    asked = tasks.select(F.col(key).alias("k"), "model", "prompt_key", "system", filled.alias("u")).mapInPandas(run, f"k {kind}, model string, prompt_key string, raw string, llm_error string")
    parsed = asked.withColumn("m", F.from_json(L.first_object(F.col("raw")), "map<string, string>"))
    labels = F.when(F.col("m").isNotNull(), L.wrap(F.col("m"), F.col("model"), F.lit(coded_on)))
    error = F.coalesce("llm_error", F.when(F.col("m").isNull(), F.lit("no object in the answer")))
    return parsed.select(F.col("k").alias(key), "model", "prompt_key", labels.alias("llm_labels"), error.alias("llm_error"))


def summarise(df: DataFrame, key: str, text: str, client: Callable[[str, str], str], system: str = "Summarise the abstract.") -> DataFrame:
    """``(key, summary)``: one request for every non-empty text; the client answers a JSON object with ``summary``; any error gives null."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for t in b["t"]:
                try:
                    out.append(client(system, t) if t is not None and t.strip() else None)
                except Exception:  # noqa: BLE001
                    out.append(None)
            yield pd.DataFrame({"k": b["k"], "raw": out})

    asked = df.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInPandas(run, f"k {kind}, raw string")
    return asked.select(F.col("k").alias(key), F.get_json_object(L.first_object(F.col("raw")), "$.summary").alias("summary"))


def gs_sample(policies: DataFrame, key: str, share: float = 0.10, seed: int = 42) -> DataFrame:
    return share_sample(policies, key, share, seed)


def annotate_merge(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Long labels ``(keys, value, coder, date)``: a new value replaces value, coder and date only where it differs; null new values change nothing."""
    n = new.where("value IS NOT NULL").select(*keys, *[F.col(c).alias(f"n_{c}") for c in ("value", "coder", "date")])
    j = old.join(n, keys, "full_outer")
    keep = F.col("n_value").isNull() | F.col("value").eqNullSafe(F.col("n_value"))
    return j.select(*keys, *[F.when(keep, F.col(c)).otherwise(F.col(f"n_{c}")).alias(c) for c in ("value", "coder", "date")])


def completeness(labels: DataFrame, item: str, fields: list[str]) -> DataFrame:
    """``(item, n_done, complete)``."""
    per = labels.groupBy(item).agg(F.count_distinct(F.when(F.col("value").isNotNull() & F.col("field").isin(fields), F.col("field"))).alias("n_done"))
    return per.withColumn("complete", F.col("n_done") == len(fields))
