"""Selecting relevant documents: similarity, topics, human decisions, pooled union."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions import text as T
from tallyloom.operators import topics
from tallyloom.operators.joins import pooled_union, ranked_parents
from tallyloom.operators.windows import latest_state


def similarity_filter(docs: DataFrame, key: str, vec: str, seeds: DataFrame, seed_key: str, seed_vec: str, auto: float, low: float) -> DataFrame:
    """``(key, similarity, nearest, bucket)``: greatest similarity to the seeds, in three half-open buckets."""
    s = topics.max_similarity(docs, key, vec, seeds, seed_key, seed_vec)
    return s.withColumn("bucket", topics.bucket(F.col("similarity"), auto, low))


def decisions_now(log: DataFrame) -> DataFrame:
    """The latest decision per ``(triage_id, key)`` of an append-only log ``(triage_id, key, decision, decided_at)``."""
    return latest_state(log, ["triage_id", "key"], ["decided_at", "decision"])


def triage_apply(accepted: DataFrame, borderline: DataFrame, decisions: DataFrame, key: str, date: str) -> DataFrame:
    """Accepted rows and the borderline ones decided ``y``; :func:`tallyloom.functions.dates.date_order` sorts them."""
    yes = borderline.join(decisions.where("decision = 'y'").select(F.col("key").alias(key)).distinct(), key, "left_semi")
    return accepted.unionByName(yes)


def topic_triage(assigned: DataFrame, topic_decisions: DataFrame, doc_decisions: DataFrame) -> DataFrame:
    """``assigned`` (id, topic_id) with ``outcome``: candidate, noise, mixed_review or other.

    Topics are decided y, n or m; documents of an m topic by themselves, undecided ones count as n. Topic -1 is noise.
    """
    j = assigned.join(topic_decisions.select("topic_id", F.col("decision").alias("td")), "topic_id", "left").join(doc_decisions.select("id", F.col("decision").alias("dd")), "id", "left")
    out = F.when(F.col("topic_id") == -1, "noise").when(F.col("td") == "y", "candidate").when((F.col("td") == "m") & (F.coalesce("dd", F.lit("n")) == "y"), "candidate").when(F.col("td") == "m", "mixed_review").otherwise("other")
    return j.withColumn("outcome", out).drop("td", "dd")


def require_decided(df: DataFrame, decision: str) -> DataFrame:
    """Raises, when computed, at the first row without a decision."""
    return df.where(F.when(F.col(decision).isNull(), F.raise_error(F.lit("a row has no decision"))).otherwise(F.lit(True)))


def final_set(union: DataFrame, key: str, title_decisions: DataFrame, kept_topics: DataFrame, picks: DataFrame) -> DataFrame:
    """Rows of the pooled union to keep: selected by both systems, decided by title, in a kept topic (``topic_id``), or picked."""
    both = union.where("source = 'both'").select(key)
    by_title = title_decisions.where("decision = 'y'").select(F.col("key").alias(key))
    by_topic = union.join(kept_topics.select("topic_id").distinct(), "topic_id", "left_semi").select(key)
    keep = both.unionByName(by_title).unionByName(by_topic).unionByName(picks.select(key)).distinct()
    return union.join(keep, key, "left_semi")


def prepare_topic_text(docs: DataFrame, key: str, title: str, text: str) -> DataFrame:
    """``(key, doc_class, clean_title, referenced, embed_text)``: what an encoder gets of each document."""
    t = F.col(title)
    base = docs.select(key, T.document_class(t).alias("doc_class"), T.clean_title(t).alias("clean_title"), F.nullif(T.referenced_title(t), F.lit("")).alias("referenced"), T.title_opening(t, F.col(text)).alias("__body"))
    whole = F.when(F.col("__body") == "", F.col("clean_title")).otherwise(F.concat_ws(". ", "clean_title", "__body"))
    return base.select(key, "doc_class", "clean_title", "referenced", whole.alias("embed_text"))


def attach_children(docs: DataFrame, topic_of: DataFrame, date: str, least: float = 0.85) -> DataFrame:
    """``(id, topic_id, topic_source, parent_id)``: corrections and annexes take their parent's topic, others keep theirs.

    ``docs`` has ``id, doc_class, stems`` and a date; ``topic_of`` (id, topic_id) covers regular documents and, by transform,
    children without a parent.
    """
    children, regular = docs.where("doc_class <> 'regular'"), docs.where("doc_class = 'regular'")
    best = ranked_parents(children, regular, "stems", date, least).select(F.col("child").alias("id"), F.col("parent").alias("parent_id"))
    own = docs.select("id", "doc_class").join(best, "id", "left").join(topic_of, "id", "left")
    parents = topic_of.select(F.col("id").alias("parent_id"), F.col("topic_id").alias("parent_topic"))
    j = own.join(parents, "parent_id", "left")
    source = F.when(F.col("doc_class") == "regular", "cluster").when(F.col("parent_topic").isNotNull(), "parent").otherwise("transform")
    return j.select("id", F.coalesce("parent_topic", "topic_id", F.lit(-1)).alias("topic_id"), source.alias("topic_source"), "parent_id")


def fit_topics(docs: DataFrame, key: str, vec: str, words: Column, dims: int | None = None, least: float = 0.8, core: int = 5, smallest: int = 10, max_share: float = 0.3) -> tuple[DataFrame, DataFrame]:
    """(``(key, topic)``, ``(topic, token, n, weight)``): density clusters of the vectors, -1 for noise, and the weights of their terms.

    ``dims`` brings the vectors to so many principal components first. ``words`` is an array of the lemmas of each document;
    terms are runs of one and two words of three letters and more, those in more than ``max_share`` of the topics left out.
    """
    base = topics.reduced(docs, key, vec, dims) if dims else docs.select(key, F.col(vec).alias("reduced"))
    found = topics.density_clusters(base, key, "reduced", least=least, core=core, smallest=smallest).withColumnRenamed("cluster", "topic")
    terms = F.explode(T.ngrams(F.filter(words, lambda w: w.rlike(r"^\p{L}{3,}$")), 2))
    tokens = docs.select(key, terms.alias("token")).join(found.where("topic <> -1"), key)
    return found, topics.class_tfidf(tokens, "topic", "token", max_share=max_share)


def topic_summary(members: DataFrame, key: str, topic: str, vec: str, tokens: Column, k_words: int = 8, k_docs: int = 10) -> DataFrame:
    """``(topic, n, top_words, representatives)``: size, best words by class TF-IDF and the documents nearest to the centroid."""
    from pyspark.sql import Window as W

    words = topics.class_tfidf(members.select(topic, F.explode(tokens).alias("token")), topic, "token")
    ww = W.partitionBy(topic).orderBy(F.desc("weight"), "token")
    top = words.withColumn("r", F.row_number().over(ww)).where(F.col("r") <= k_words).groupBy(topic).agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "token"))), lambda s: s["token"]).alias("top_words"))
    cents = topics.centroids(members, topic, vec)
    from tallyloom.functions.vectors import cosine

    near = members.join(cents, topic).withColumn("s", F.round(cosine(F.col(vec), F.col("centroid")), 10))
    nw = W.partitionBy(topic).orderBy(F.desc("s"), key)
    rep = near.withColumn("r", F.row_number().over(nw)).where(F.col("r") <= k_docs).groupBy(topic).agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("r", key))), lambda s: s[key]).alias("representatives"))
    return rep.join(top, topic, "left").select(topic, "n", "top_words", "representatives")


__all__ = ["similarity_filter", "decisions_now", "triage_apply", "topic_triage", "require_decided", "final_set", "prepare_topic_text", "attach_children", "topic_summary", "pooled_union"]
