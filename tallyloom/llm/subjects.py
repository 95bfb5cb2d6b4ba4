"""Subject areas of documents: a seeded non-negative factorisation of the document-term matrix.

X (documents x terms) is approximated by W H with one component per subject and a few free ones for wording that all
subjects share. Terms are words hashed to a fixed number of columns, so that neither the vocabulary nor H grows with the
corpus, and no word is left out. H starts from anchors: documents whose title names a subject in the words of the seed
descriptions, or that people assigned, give each subject the terms they hold more often than others. Alternating
multiplicative updates follow: each document's row of W is solved by the task that holds the document, with H broadcast;
the update of H is a sum over documents, taken by partial sums per task and a group-by over terms. The anchors stay in H as
prior counts, so a component keeps its subject. The rows of W are the mixtures, and a document's subjects are those that
its mixture holds; of these, one that only one sentence (projected on H) belongs to is a mention and no subject.

A document is one row from its text to its subjects: it is coded as numbers of terms by sentence once, and no later step
moves it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.runtime import cut_lineage, not_blank, spread

FREE_COMPONENTS = 4
ROUNDS = 8
#: Updates of each row of W in a round.
ROW_STEPS = 12
#: Columns that words are hashed to. H has at most this many columns: 30 MB with 14 components.
COLUMNS = 1 << 18
#: Share of a document's mixture from which a subject is one of its candidates.
CANDIDATE = 0.1

_JOIN = regex.compile(r"(?<=\p{Ll})[-­¬‐‑=][ \t]*\r?\n\s*(?=\p{Ll})")
_SENTENCE = regex.compile(r"(?<=[\p{Ll}\)“\"][.!?])\s+(?=[\p{Lu}(§„\"])")
_WORD = regex.compile(r"\p{L}{4,}")
_TITLE_WORD = regex.compile(r"\p{L}{5,}")


class Columns(dict):
    """Column of every word met, by a hash that all tasks share."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        got = self[word] = zlib.crc32(word.encode("utf-8", "surrogatepass")) % COLUMNS
        return got


def sentence_columns(text: str, columns: Columns) -> list[list[int]]:
    """Columns of the distinct words of four letters and more of each sentence; words broken over lines are joined."""
    out = []
    for s in _SENTENCE.split(_JOIN.sub("", text)):
        got = {columns[w] for w in _WORD.findall(s.lower())}
        if got:
            out.append(sorted(got))
    return out


def solve_rows(counts: np.ndarray, terms: np.ndarray, row: np.ndarray, n: int, h: np.ndarray, steps: int) -> np.ndarray:
    """W (n x components, rows sum to 1) for entries (row, term, count), by multiplicative updates with H fixed."""
    k = h.shape[0]
    w = np.full((n, k), 1.0 / k, np.float32)
    ht = np.ascontiguousarray(h[:, terms].T, np.float32)
    counts = counts.astype(np.float32)
    starts = np.r_[0, np.flatnonzero(np.diff(row)) + 1]
    own = row[starts]
    for _ in range(steps):
        ratio = counts / np.maximum(np.einsum("ij,ij->i", w[row], ht), 1e-12)
        w[own] *= np.add.reduceat(ht * ratio[:, None], starts, axis=0)
        w /= np.maximum(w.sum(axis=1, keepdims=True), 1e-12)
    return w


class Factors:
    """Subjects, weight of every used column, H over the used columns, and where each column stands in H (-1: unused)."""

    def __init__(self, subjects: list[str], used: np.ndarray, idf: np.ndarray, h: np.ndarray):
        self.subjects, self.idf, self.h = subjects, idf, h
        self.at = np.full(COLUMNS, -1, np.int32)
        self.at[used] = np.arange(len(used))

    def entries(self, term: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, ...]:
        """(row, term of H, weighted count) of columns and the rows they stand in, in row order."""
        term = self.at[term]
        keep = term >= 0
        key, count = np.unique(owner[keep].astype(np.int64) * max(self.h.shape[1], 1) + term[keep], return_counts=True)
        row, term = key // max(self.h.shape[1], 1), key % max(self.h.shape[1], 1)
        return row, term, count * self.idf[term]


def _flat(b: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(columns of all documents on end, the document of each, the sentence of each), sentences numbered through."""
    sizes = [np.asarray(x, np.int64) for x in b["sizes"]]
    term = np.concatenate([np.asarray(x, np.int64) for x in b["term"]]) if len(b) else np.zeros(0, np.int64)
    per_doc = np.array([x.sum() for x in sizes], np.int64)
    flat = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
    return term, np.repeat(np.arange(len(b)), per_doc), np.repeat(np.arange(len(flat)), flat)


def _parts(batches: Iterator[pd.DataFrame], rows: int = 500) -> Iterator[pd.DataFrame]:
    for b in batches:
        for lo in range(0, len(b), rows):
            yield b.iloc[lo : lo + rows]


def fit(docs: DataFrame, seeds: DataFrame, assigned: DataFrame, key: str, title: str, text: str, rounds: int = ROUNDS, free: int = FREE_COMPONENTS) -> tuple[Factors, DataFrame]:
    """Factors, and the documents they were fitted on, coded as numbers of terms by sentence (checkpointed).

    ``seeds`` has ``domain, seed``, ``assigned`` ``id`` and up to two field columns; unknown or missing fields are ignored.
    Documents with a null key or a null or blank text are left out.
    """
    spark = docs.sparkSession
    subjects = [r[0] for r in seeds.select("domain").where("domain IS NOT NULL").distinct().orderBy("domain").collect()]
    n_sub, k = len(subjects), len(subjects) + free
    number = {s: i for i, s in enumerate(subjects)}
    # title words that only one subject's seeds have; the seeds are a fixed table
    of_word: dict[str, set[int]] = {}
    for r in seeds.where("domain IS NOT NULL AND seed IS NOT NULL").select("domain", "seed").collect():
        for w in _TITLE_WORD.findall(r["seed"].lower()):
            of_word.setdefault(w, set()).add(number[r["domain"]])
    telling = {w: next(iter(d)) for w, d in of_word.items() if len(d) == 1}
    fields = [c for c in assigned.columns if c not in ("id", "coder", "date")]
    by_hand = assigned.select(F.col("id").alias("k"), F.explode(F.array(*fields)).alias("d")).where(F.col("d").isin(subjects)).groupBy("k").agg(F.collect_set("d").alias("d"))
    kind = docs.schema[key].dataType.simpleString()
    base = docs.where(F.col(key).isNotNull() & not_blank(F.col(text))).select(F.col(key).alias("k"), F.col(title).alias("h"), F.col(text).alias("t"))

    def code(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = Columns()
        for b in _parts(batches):
            anchors, sizes, terms = [], [], []
            for h, t, d in zip(b["h"], b["t"], b["d"]):
                own = {number[x] for x in d} if d is not None else set()
                own |= {telling[w] for w in _TITLE_WORD.findall(h.lower()) if w in telling} if h else set()
                s = sentence_columns(t, columns)
                anchors.append(sorted(own))
                sizes.append([len(x) for x in s])
                terms.append([c for x in s for c in x])
            yield pd.DataFrame({"k": b["k"], "anchors": anchors, "sizes": sizes, "term": terms})

    joined = spread(base).join(by_hand, "k", "left")
    coded = cut_lineage(joined.mapInPandas(code, f"k {kind}, anchors array<int>, sizes array<int>, term array<int>"))

    def frequencies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Documents of every column: all, and those of each subject's anchors; column -1 counts the documents."""
        acc = np.zeros((n_sub + 1, COLUMNS + 1))
        for b in _parts(batches):
            term, doc, _ = _flat(b)
            once = np.unique(doc * COLUMNS + term)
            doc, term = once // COLUMNS, once % COLUMNS
            mark = np.zeros((len(b), n_sub + 1), bool)
            mark[:, 0] = True
            for i, a in enumerate(b["anchors"]):
                mark[i, np.asarray(a, int) + 1] = True
            worded = np.isin(np.arange(len(b)), doc)
            acc[:, COLUMNS] += mark[worded].sum(axis=0)
            for c in range(n_sub + 1):
                acc[c, :COLUMNS] += np.bincount(term[mark[doc, c]], minlength=COLUMNS)
        used = np.flatnonzero(acc[0])
        if len(used):
            yield pd.DataFrame({"term": used, "v": list(acc[:, used].T)})

    def total(make, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(columns, sums) of what the tasks give; at most COLUMNS + 1 rows."""
        got = coded.mapInPandas(make, "term bigint, v array<double>").groupBy("term").agg(F.array(*[F.sum(F.get("v", F.lit(c))) for c in range(width)]).alias("v")).toArrow()
        term = got["term"].to_numpy()
        v = got["v"].combine_chunks().flatten().to_numpy().reshape(len(term), width)
        order = np.argsort(term)
        return term[order], v[order]

    used, seen = total(frequencies, n_sub + 1)
    if not len(used) or not subjects:
        return Factors(subjects, np.zeros(0, int), np.zeros(0), np.zeros((k, 0))), coded  # nothing to tell apart
    n_docs, size = seen[-1, 0], np.maximum(seen[-1, 1:], 1)
    has_anchor = seen[-1, 1:] > 0
    used, freq, seen = used[:-1], seen[:-1, 0], seen[:-1, 1:].T
    # a word met once or twice says little of its subject
    idf = np.log1p(n_docs / freq) * freq / (freq + 2)
    share = (seen + 0.05) / (size[:, None] + 1)
    # what a subject's documents hold beyond the average subject
    excess = np.maximum(share - 1.5 * np.median(share, axis=0), 0) * (share / share.sum(axis=0)) ** 2
    anchors = excess + 1e-6
    anchors /= anchors.sum(axis=1, keepdims=True)
    rng = np.random.default_rng(7)
    common = freq / freq.sum() * (1 - (share / share.sum(axis=0)).max(axis=0)) + 1e-7
    base_rows = np.stack([common * rng.uniform(0.7, 1.3, len(used)) for _ in range(free)]) if free else np.zeros((0, len(used)))
    h = np.vstack([anchors, base_rows / base_rows.sum(axis=1, keepdims=True)]) if free else anchors
    # a subject that no document is an anchor of is not learned: it would drift to another's terms
    bare = np.flatnonzero(~has_anchor)
    h[bare] = 1.0 / len(used)
    prior_mass = 0.25 * n_docs / max(1, n_sub)
    for _ in range(rounds):
        model = spark.sparkContext.broadcast(Factors(subjects, used, idf, h))

        def sums(batches: Iterator[pd.DataFrame], model=model) -> Iterator[pd.DataFrame]:
            m = model.value
            acc = np.zeros(m.h.shape)
            for b in _parts(batches, 1000):
                term, doc, _ = _flat(b)
                row, term, cnt = m.entries(term, doc, len(b))
                if not len(row):
                    continue
                w = solve_rows(cnt, term, row, len(b), m.h, ROW_STEPS)
                part = w[row] * m.h[:, term].T
                part *= (cnt / np.maximum(part.sum(axis=1), 1e-12))[:, None]
                for c in range(acc.shape[0]):
                    acc[c] += np.bincount(term, part[:, c], acc.shape[1])
            hit = np.flatnonzero(acc.sum(axis=0) > 0)
            if len(hit):
                yield pd.DataFrame({"term": hit, "v": list(acc[:, hit].T)})

        hit, v = total(sums, k)
        up = np.zeros_like(h)
        up[:, hit] = v.T
        up[:n_sub] += prior_mass * anchors
        up += 1e-4
        h = up / up.sum(axis=1, keepdims=True)
        h[bare] = 1.0 / len(used)
        model.unpersist()
    return Factors(subjects, used, idf, h), coded


def _mixture(m: Factors, term: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(shares of the subjects in each document, which documents have any known word)."""
    row, at, cnt = m.entries(term, doc, n)
    if not len(row):
        return np.zeros((n, len(m.subjects))), np.zeros(n, bool)
    w = solve_rows(cnt, at, row, n, m.h, 30)[:, : len(m.subjects)]
    return w / np.maximum(w.sum(axis=1, keepdims=True), 1e-9), np.isin(np.arange(n), row)


def mixtures(factors: Factors, coded: DataFrame) -> DataFrame:
    """``(k, subject, weight)``: each document's shares of the subjects, free components left out; they sum to 1.

    Rows that repeat a key give a mixture each. Texts without any known word give no row.
    """
    shared = coded.sparkSession.sparkContext.broadcast(factors)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for b in _parts(batches):
            term, doc, _ = _flat(b)
            w, has = _mixture(m, term, doc, len(b))
            keys = b["k"].to_numpy()[has]
            if not len(keys):
                continue
            yield pd.DataFrame({"k": np.repeat(keys, len(m.subjects)), "subject": np.tile(m.subjects, len(keys)), "weight": w[has].ravel()})

    return coded.mapInPandas(run, f"k {coded.schema['k'].dataType.simpleString()}, subject string, weight double").where("weight > 0.005")


def sentence_counts(m: Factors, b: pd.DataFrame, sure: float, topical: float) -> tuple[np.ndarray, np.ndarray]:
    """(mixture, sentences of every subject) of the documents of ``b``.

    A sentence belongs to a subject if the subject components explain at least ``topical`` of it, one of them at least
    ``sure`` of that.
    """
    term, doc, sent = _flat(b)
    mix, _ = _mixture(m, term, doc, len(b))
    counts = np.zeros((len(b), len(m.subjects)), np.int64)
    n_sent = np.array([len(x) for x in b["sizes"]], np.int64)
    row, at, cnt = m.entries(term, sent, int(n_sent.sum()))
    if len(row):
        w = solve_rows(cnt, at, row, int(n_sent.sum()), m.h, 15)[:, : len(m.subjects)]
        every = w.sum(axis=1)
        ok = np.isin(np.arange(len(w)), row) & (every >= topical) & (w.max(axis=1) >= sure * every)
        np.add.at(counts, (np.repeat(np.arange(len(b)), n_sent)[ok], w.argmax(axis=1)[ok]), 1)
    return mix, counts


def assign(factors: Factors, coded: DataFrame, none: str, key: str, min_sentences: int = 2, candidate: float = CANDIDATE, sure: float = 0.6, topical: float = 0.4) -> DataFrame:
    """``(key, subject)``: the subjects of each document of ``coded``.

    Candidates are the subjects with at least ``candidate`` of the document's row of W. A candidate needs ``min_sentences``
    sentences, or all the sentences with a subject if there are fewer. ``none`` stands for texts of no other subject and is
    given where no other subject holds, also to texts without any known word. Ties need no rule, as all subjects that
    qualify are given; rows that repeat a key give the subjects of all of them once.
    """
    shared = coded.sparkSession.sparkContext.broadcast(factors)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        social = np.array([s != none for s in m.subjects], bool)
        names = np.array(m.subjects, object)
        for b in _parts(batches):
            mix, n = sentence_counts(m, b, sure, topical)
            good = social & (mix >= candidate) & (n > 0) & ((n >= min_sentences) | (n == n.sum(axis=1, keepdims=True)))
            yield pd.DataFrame({"k": b["k"], "subjects": [list(names[g]) for g in good]})

    found = coded.mapInPandas(run, f"k {coded.schema['k'].dataType.simpleString()}, subjects array<string>")
    per = found.groupBy("k").agg(F.array_distinct(F.flatten(F.collect_set("subjects"))).alias("s"))
    return per.select(F.col("k").alias(key), F.explode(F.when(F.size("s") > 0, F.col("s")).otherwise(F.array(F.lit(none)))).alias("subject"))
