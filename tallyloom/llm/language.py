"""Language of each document and of each segment of a mixed document, told apart in two steps.

Step one is a linear machine between language families, step two one-versus-one linear support vector machines between the
languages of the family it has chosen; no others are asked. A language of the family scores its worst duel. Features are
hashed character n-grams with word boundaries. A document is cut into sentences, every sentence gets the margins of all machines, and short or doubtful
sentences take the language of their surroundings by a shortest path with a price for every change. The machines are
trained here, on a bounded sample of sentences of documents that carry a valid label, in two rounds: sentences that the first machine
assigns to another language than their label (mixed documents, wrong labels) are left out of the second.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.runtime import spread

# fixed values: the languages by family
FAMILIES = {"germanic": ["de", "en", "nl"], "romance": ["es", "fr", "it", "pt"]}
#: Bounds of the training sample: documents per language, sentences per document and distinct sentences per language.
TRAIN_DOCS, TRAIN_PER_DOC, TRAIN_SENTENCES = 400, 20, 800
BITS = 15
NGRAMS = (1, 2, 3, 4, 5)

_WORD = regex.compile(r"\p{L}")
_NOISE = regex.compile(r"[^\p{L}\p{M}'’]+")
#: A sentence ends at a line break, or at . ! ? before a blank and a capital, digit or quote. A one- to three-digit number
#: with a full stop before a capital is an ordinal.
_END = regex.compile(r"(?:\r?\n)+|(?<=[\p{L}\p{M})\]»”\"'%][.!?…]|[0-9]{4}[.!?]|[0-9][!?])[\s\p{Z}]+(?=[\p{Lu}\p{Lt}¿¡«„“\"(\[])")
_ABBREV = regex.compile(r"(?:^|[\s\p{Z}(])(?:\p{Lu}|bzw|Nr|Abs|Art|vgl|ca|z\.\s?B|d\.\s?h|u\.\s?a|art|no|núm|pág|etc|vs|dr|Dr|Prof|St|Mr|Mrs|p|pp|cf|ex|env|sog|evtl|inkl|ggf)\.$")


def sentences(text: str | None) -> list[str]:
    """Sentences with at least one letter, in order."""
    if not text:
        return []
    out, start = [], 0
    for m in _END.finditer(text):
        piece = text[start : m.start()]
        if "\n" not in m.group() and _ABBREV.search(piece):
            continue
        out.append(piece)
        start = m.end()
    out.append(text[start:])
    return [s for s in out if _WORD.search(s)]


def tidied(text: str) -> str:
    """Lower-case letters with single spaces around the words: all that the features see of a sentence."""
    return f" {_NOISE.sub(' ', text.lower()).strip()} "


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, hashed feature, weight) of all n-grams of tidied texts; every row has length 1."""
    if len(texts) > 2000:  # the n-grams of a part are in memory at a time
        parts = [features(texts[i : i + 2000]) for i in range(0, len(texts), 2000)]
        return np.concatenate([r + 2000 * i for i, (r, _, _) in enumerate(parts)]), *(np.concatenate([p[j] for p in parts]) for j in (1, 2))
    tidy = [tidied(t) for t in texts]
    cps = np.frombuffer("".join(tidy).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(tidy)), [len(t) for t in tidy])
    rows, cols = [], []
    for n in NGRAMS:
        m = len(cps) - n + 1
        if m <= 0:
            continue
        h = np.full(m, n, np.uint64)
        for k in range(n):
            h = (h ^ cps[k : k + m]) * np.uint64(0x100000001B3)
            h ^= h >> np.uint64(29)
        same = owner[:m] == owner[n - 1 :]
        rows.append(owner[:m][same])
        cols.append(((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)).astype(np.int64)[same])
    row, col = np.concatenate(rows), np.concatenate(cols)
    key, count = np.unique((row << BITS) | col, return_counts=True)
    row, col = key >> BITS, key & ((1 << BITS) - 1)
    w = np.log1p(count)
    norm = np.sqrt(np.bincount(row, w * w, len(texts)))
    return row, col, w / np.maximum(norm[row], 1e-9)


class Machines:
    """One family machine and one machine per pair of languages of a family: weights (features, machines) and offsets."""

    def __init__(self, families: dict[str, list[str]]):
        self.families = families
        self.names = list(families)
        self.langs = [x for ls in families.values() for x in ls]
        self.family_of = {x: f for f, ls in families.items() for x in ls}
        self.duels: list[tuple[list[str], list[str]]] = [(families[a], families[b]) for a, b in combinations(self.names, 2)]
        self.n_family = len(self.duels)
        for ls in families.values():
            self.duels += [([a], [b]) for a, b in combinations(ls, 2)]
        self.w = np.zeros((1 << BITS, len(self.duels)), np.float32)
        self.b = np.zeros(len(self.duels))

    def fit(self, texts: list[str], labels: list[str], weights: list[float], steps: int = 60, reg: float = 1e-5) -> None:
        """Squared-hinge machines, each by accelerated gradient steps over the sentences of its languages, balanced by language.

        The step is halved, and the momentum dropped, whenever the loss has risen.
        """
        row, col, val = features(texts)
        val = val.astype(np.float32)
        lab, wt = np.array(labels), np.array(weights, float)
        dim = 1 << BITS
        for j, (a, b) in enumerate(self.duels):
            own = np.isin(lab, a + b)
            y = np.where(np.isin(lab, a), 1.0, -1.0) * own
            share = np.zeros(len(lab))
            for side in (a, b):
                for x in side:
                    n = wt[lab == x].sum()
                    share[lab == x] = wt[lab == x] / (n * len(side)) if n else 0.0
            if not own.any():
                continue
            pick = own[row]
            r, c, v = row[pick], col[pick], val[pick]
            # sums by sentence run over the entries as they lie, sums by feature over a copy in order of the features
            at = np.r_[0, np.flatnonzero(np.diff(r)) + 1]
            by = np.argsort(c, kind="stable")
            rc, vc, to = r[by], v[by], np.r_[0, np.flatnonzero(np.diff(c[by])) + 1]
            rows, cols, y = r[at], c[by][to], y.astype(np.float32)
            score, gw = np.zeros(len(lab), np.float32), np.zeros(dim, np.float32)
            w, vw, b0, vb, rate, best = np.zeros(dim, np.float32), np.zeros(dim, np.float32), 0.0, 0.0, 4.0, np.inf
            for _ in range(steps):
                lw, lb = w + np.float32(0.9) * vw, b0 + 0.9 * vb
                score[rows] = np.add.reduceat(lw[c] * v, at)
                gap = np.maximum(0, 1 - y * (score + lb))
                loss = float((gap * gap * share).sum())
                if loss > 1.5 * best:
                    rate, vw, vb, best = rate / 2, vw * 0, 0.0, np.inf
                    continue
                best = min(best, loss)
                slack = (gap * share * -y).astype(np.float32)
                gw[cols] = np.add.reduceat(slack[rc] * vc, to)
                vw, vb = (0.9 * vw - rate * (gw + reg * lw)).astype(np.float32), 0.9 * vb - 0.2 * rate * slack.sum()
                w, b0 = w + vw, b0 + vb
            self.w[:, j], self.b[j] = w, b0

    def margins(self, texts: list[str]) -> np.ndarray:
        """Score of every language for every text.

        The family machines come first: a family's margin is its worst duel. Only the languages of the family with the
        greatest margin meet in duels of their own; each scores the least of its duels and the family's margin. The
        languages of other families score their family's margin, which is negative.
        """
        row, col, val = features(texts)
        val = val.astype(np.float32)
        n, nf = len(texts), self.n_family
        starts = np.r_[0, np.flatnonzero(np.diff(row)) + 1]
        out = np.full((n, len(self.langs)), 4.0)
        s = np.zeros((n, nf))
        s[row[starts]] = np.add.reduceat(self.w[col, :nf] * val[:, None], starts, axis=0)
        self._meet(out, np.arange(n), s + self.b[:nf], range(nf))
        chosen = np.array([self.names.index(self.family_of[x]) for x in self.langs])[out.argmax(axis=1)]
        for f, name in enumerate(self.names):
            own = [j for j in range(nf, len(self.duels)) if self.family_of[self.duels[j][0][0]] == name]
            pick = chosen[row] == f
            if not own or not pick.any():
                continue
            r, c, v = row[pick], col[pick], val[pick]
            at = np.r_[0, np.flatnonzero(np.diff(r)) + 1]
            self._meet(out, r[at], np.add.reduceat(self.w[:, own][c] * v[:, None], at, axis=0) + self.b[own], own)
        return out

    def _meet(self, out: np.ndarray, rows: np.ndarray, score: np.ndarray, duels) -> None:
        """Lower the scores of the languages on both sides of every duel to the duel's margin."""
        for i, j in enumerate(duels):
            for side, sign in zip(self.duels[j], (1, -1)):
                for x in side:
                    k = self.langs.index(x)
                    out[rows, k] = np.minimum(out[rows, k], sign * score[:, i])


def train(docs: DataFrame, key: str, text: str, lang: str, families: dict[str, list[str]] = FAMILIES, per_language: int = TRAIN_DOCS, per_document: int = TRAIN_PER_DOC) -> Machines:
    """Machines from at most ``per_language`` labelled documents of each language (in order of a hash of the key).

    Of each, at most ``per_document`` sentences are taken, wherever they stand in the text (in order of a hash). The texts
    are cut where they lie; only these sentences come to the driver.
    """
    langs = [x for ls in families.values() for x in ls]
    pool = docs.where(F.col(lang).isin(langs) & F.col(text).isNotNull()).select(F.col(lang).alias("l"), F.col(text).alias("t"), F.xxhash64(F.col(key), F.lit(7)).alias("h"))
    # keep about twice the bound by a hash threshold, then the bound: no sort of the whole table
    share = pool.groupBy("l").agg(F.count("*").alias("n")).select("l", F.least(F.lit(1.0), F.lit(2.0 * per_language) / F.col("n")).alias("p"))
    kept = pool.join(F.broadcast(share), "l").where(F.pmod("h", F.lit(1_000_003)) < F.col("p") * 1_000_003)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            some = [sorted(set(sentences(t)), key=lambda s: (zlib.crc32(s.encode("utf-8", "surrogatepass")), s))[:per_document] for t in b["t"]]
            yield pd.DataFrame({"l": b["l"], "h": b["h"], "s": some})

    rows = kept.mapInPandas(cut, "l string, h bigint, s array<string>").where(F.size("s") > 0).orderBy("l", "h").limit(2 * per_language * len(langs) * 2).collect()
    # distinct sentences, each with the label that most documents with it carry
    docs_of, votes, form = dict.fromkeys(langs, 0), {}, {}
    for r in rows:
        if docs_of[r["l"]] < per_language:
            docs_of[r["l"]] += 1
            for s in r["s"]:
                t = tidied(s)
                form.setdefault(t, s)
                votes.setdefault(t, Counter())[r["l"]] += 1
    texts, labels, weights, held = [], [], [], Counter()
    for t, v in sorted(votes.items(), key=lambda x: (-x[1].total(), x[0])):
        x = max(langs, key=lambda y: v[y])
        if held[x] < TRAIN_SENTENCES:
            held[x] += 1
            words = form[t].split()
            # the sentence and its beginning, so that short pieces are known as well
            texts += [form[t], " ".join(words[: 3 + len(words) % 4])]
            labels += [x] * 2
            weights += [v.total() ** 0.5] * 2
    m = Machines(families)
    if not texts:
        return m
    m.fit(texts, labels, weights, steps=25)
    guess = m.margins(texts).argmax(axis=1)
    keep = [i for i in range(len(texts)) if m.langs[guess[i]] == labels[i]]
    m.fit([texts[i] for i in keep], [labels[i] for i in keep], [weights[i] for i in keep], steps=60)
    return m


#: Sentences whose margins one task keeps.
KNOWN_SENTENCES = 200_000
#: Price of a change of language between two sentences, in units of margin.
CHANGE = 0.9


def segment(margins: np.ndarray, letters: np.ndarray, change: float = CHANGE) -> np.ndarray:
    """Language index of every sentence: the path of least loss, where a sentence with few letters has little say."""
    n, k = margins.shape
    say = np.minimum(1.0, letters / 25.0)[:, None]
    gain = np.clip(margins, -1.5, 1.5) * say
    best = np.zeros((n, k))
    back = np.zeros((n, k), np.int64)
    best[0] = gain[0]
    for i in range(1, n):
        j = best[i - 1].argmax()
        stay = best[i - 1]
        switch = best[i - 1][j] - change
        back[i] = np.where(stay >= switch, np.arange(k), j)
        best[i] = np.maximum(stay, switch) + gain[i]
    path = np.zeros(n, np.int64)
    path[-1] = best[-1].argmax()
    for i in range(n - 1, 0, -1):
        path[i - 1] = back[i, path[i]]
    return path


def detect(df: DataFrame, key: str, text: str, machines: Machines, label: str | None = None) -> DataFrame:
    """``(key, n_segments, seg_no, lang, confidence, n_chars, doc_lang, doc_confidence)``: one row per segment of every text with words.

    Segments are maximal runs of sentences in one language, numbered from 1. ``confidence`` is a logistic value of the
    margin to the next best language, weighted by letters. ``doc_lang`` is the language with most letters (of equals the
    first in the order of the families). Null, empty and blank texts and texts without letters give no row; repeated rows
    are handled one by one; whole texts are read, however long; extra columns are not read, but for ``label``, which each
    segment gets as ``label``.
    """
    kind = df.schema[key].dataType.simpleString()
    shared = df.sparkSession.sparkContext.broadcast(machines)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        known: dict[str, np.ndarray] = {}
        for batch in batches:
            for lo in range(0, len(batch), 256):
                b = batch.iloc[lo : lo + 256]
                cut = [sentences(t) for t in b["t"]]
                flat = [s for c in cut for s in c]
                if not flat:
                    continue
                tidy = [tidied(s) for s in flat]
                fresh = [t for t in dict.fromkeys(tidy) if t not in known]
                for i in range(0, len(fresh), 2000):
                    known.update(zip(fresh[i : i + 2000], m.margins(fresh[i : i + 2000])))
                margins = np.array([known[t] for t in tidy])
                if len(known) > KNOWN_SENTENCES:
                    known.clear()
                letters = np.array([sum(map(len, regex.findall(r"\p{L}+", s))) for s in flat], float)
                out, at = [], 0
                for k, tag, c in zip(b["k"], b["label"], cut):
                    if not c:
                        continue
                    mg, le = margins[at : at + len(c)], letters[at : at + len(c)]
                    at += len(c)
                    path = segment(mg, le)
                    bounds = np.r_[0, np.flatnonzero(np.diff(path)) + 1, len(path)]
                    total = np.bincount(path, le, len(m.langs))
                    top = int(total.argmax())
                    segs = []
                    for a, e in zip(bounds[:-1], bounds[1:]):
                        x = path[a]
                        mean = np.average(mg[a:e], axis=0, weights=le[a:e])
                        gap = mean[x] - np.delete(mean, x).max()
                        segs.append((m.langs[x], 1 / (1 + np.exp(-2.5 * gap)), sum(map(len, c[a:e])), le[a:e].sum()))
                    own = [(s[1], s[3]) for s in segs if s[0] == m.langs[top]]
                    conf = sum(a * b for a, b in own) / sum(b for _, b in own) * total[top] / total.sum()
                    out += [(k, len(segs), i + 1, s[0], s[1], s[2], m.langs[top], conf, tag) for i, s in enumerate(segs)]
                if out:
                    yield pd.DataFrame(out, columns=["k", "n_segments", "seg_no", "lang", "confidence", "n_chars", "doc_lang", "doc_confidence", "label"])

    tag = F.col(label).cast("string") if label else F.lit(None).cast("string")
    slim = spread(df.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("t"), tag.alias("label")))
    schema = f"k {kind}, n_segments bigint, seg_no bigint, lang string, confidence double, n_chars bigint, doc_lang string, doc_confidence double, label string"
    out = slim.mapInPandas(run, schema)
    return (out if label else out.drop("label")).withColumnRenamed("k", key)


def wrong_or_mixed(df: DataFrame, key: str, text: str, lang: str, machines: Machines) -> DataFrame:
    """Segments ``(key, seg_no, lang)`` of documents in several languages, and of documents whose label is not exactly their code.

    One narrow stage: the label goes along with the text. Rows that repeat a key are told one by one.
    """
    found = detect(df, key, text, machines, lang)
    return found.where((F.col("n_segments") > 1) | ~F.col("lang").eqNullSafe(F.col("label"))).select(key, "seg_no", "lang")
