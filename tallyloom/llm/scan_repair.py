"""Repair of text from scanned pages: page furniture, words broken over lines, misread characters, reflow.

Four steps, all over the whole corpus. (1) Texts whose lines end with sentences are taken as clean; their words and word
pairs are counted, and the words of lines that break into the middle of a word are counted as page furniture. (2) Every
line is told apart: page number, running header or footer (by the odds of its words), or text; words broken at a mark are
joined. (3) Every distinct word that no clean text has is looked up in a trie of the clean vocabulary by a Levenshtein
automaton, which finds all words within the distance. The trie is split into shards of bounded size; a task builds one of
them and the unknown words stream past it. Which shapes are read for which is learned from the unknown words themselves.
(4) The candidates are ranked by the shapes changed, their frequency and the words beside them, once for each word with its
neighbours, and the places of that word between these neighbours take the best.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from statistics import NormalDist

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyloom.runtime import cut_lineage, salted_join, spread

#: Words of the clean vocabulary in one shard of the trie.
SHARD_WORDS = 50_000
#: Most frequent clean words that tasks know beforehand, which saves work only; the rest is met by a join.
CORE_WORDS = 50_000
#: A shape is known to be misread if it has this share of the words with one nearest candidate, taken together with
#: PRIOR_WORDS words in which each of SHAPES has one in a hundred and no other has any.
KNOWN_SHARE, PRIOR_WORDS = 0.004, 1000
#: Chance, over all words tested, at which a word is taken as one of page furniture.
SIGNIFICANT = 0.001
#: Words of page furniture that a broadcast may hold.
MAX_FURNITURE = 500_000
#: Corrections up to which their table is broadcast.
BROADCAST_ROWS = 300_000

# fixed values: marks at which words are broken, and shapes that scanning confuses (read -> printed)
BREAKS = "-­¬‐‑="
SHAPES = [
    ("0", "o"), ("0", "O"), ("1", "l"), ("1", "i"), ("1", "I"), ("5", "s"), ("5", "S"), ("6", "b"), ("8", "B"), ("9", "g"), ("I", "l"), ("l", "I"), ("l", "i"), ("i", "l"), (";", "i"), ("!", "i"), ("|", "l"),
    ("ſ", "s"), ("f", "ſ"), ("c", "e"), ("e", "c"), ("n", "u"), ("u", "n"), ("rn", "m"), ("m", "rn"), ("in", "m"), ("ri", "n"), ("li", "h"), ("h", "li"), ("ii", "ü"), ("ii", "ä"), ("ii", "u"), ("ti", "ü"), ("cl", "d"), ("d", "cl"), ("vv", "w"), ("B", "ß"), ("b", "h"), ("h", "b"), ("t", "l"), ("l", "t"), ("f", "t"), ("t", "f"), ("a", "o"), ("o", "a"), ("ö", "ä"), ("a", "ä"), ("u", "ü"), ("o", "ö"), ("D", "O"), ("Z", "2"), ("2", "z"), ("s", "f"), ("f", "s"),
    ("", "i"), ("6", "ö"), ("0", "ö"), ("ii", "ö"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("I)", "D"), ("l)", "D"), ("\\/", "V"), ("q", "g"), ("g", "q"), ("C", "G"), ("F", "E"), ("E", "F"),
]
_EDGE = regex.compile(r"^[^\p{L}\p{N}\\|!;]+|[^\p{L}\p{N}]+$")
_LETTER = regex.compile(r"\p{L}")
_NUMBERING = regex.compile(r"^[\p{N}.,/:]+\p{L}?$")
_FIGURES = regex.compile(r"(?:(?<=^)|(?<=-))\p{N}+(?=-|$)")
_ENDS = regex.compile(r"[.:;!?…][“\"»)]*\s*$")
_PAGE = regex.compile(r"(?i)^[\s\-–—_|•·*=~<>\[\]]*(?:(?:seite|page|blatt|pag|bl|s|p)\b\.?)?[\s\-–—_|•·*=~<>\[\]]*[0-9OolIſSsBbZ]{1,5}[\s\-–—_|•·*=~<>\[\]]*$")
_SPACED = regex.compile(r"^(?:\S ){3,}")
_LOOKS = str.maketrans("015689;ſ", "olsbbgis")
_JOINER = {"und", "oder", "bzw", "bzw.", "sowie", "beziehungsweise", "noch", "wie"}


def is_wrapped(lines: list[str]) -> bool:
    """Whether the lines are those of a page and not whole paragraphs."""
    full = [x for x in lines if x.strip()]
    open_ = sum(not _ENDS.search(x) for x in full)
    return len(full) > 1 and open_ > 0.15 * len(full)


_WORDS: dict[str, str] = {}
_FURNITURE: dict[str, tuple] = {}


def word_of(token: str) -> str:
    """The token without marks at its ends, figures between hyphens as 0; empty if it is no word."""
    w = _WORDS.get(token)
    if w is None:
        if len(_WORDS) > 300_000:
            _WORDS.clear()
        w = _WORDS[token] = _word_of(token)
    return w


def _word_of(token: str) -> str:
    w = _FIGURES.sub("0", _EDGE.sub("", token))
    return "" if len(_LETTER.findall(w)) < 2 or _NUMBERING.match(w) else w


def furniture_words(line: str) -> list[str]:
    """Lower-case words of a line for the header odds; letter-spaced words are closed up."""
    s = line.strip()
    if _SPACED.match(s) or sum(len(t) == 1 for t in s.split()) > 0.6 * len(s.split()) > 2:
        s = regex.sub(r"(?<=\S) (?=\S(?:\s|$))", "", regex.sub(r"\s{2,}", "\t", s)).replace("\t", " ")
    toks = s.split()
    if toks and toks[-1][-1] in BREAKS and len(toks[-1]) > 1 and toks[-1][-2].isalpha():
        toks.pop()  # a broken word is none
    out: list[str] = []
    for t in toks:
        got = _FURNITURE.get(t)
        if got is None:
            if len(_FURNITURE) > 300_000:
                _FURNITURE.clear()
            parts = regex.findall(r"[\p{L}\p{M}\p{N};ſ]+", t.lower())
            got = _FURNITURE[t] = tuple(regex.sub(r"[^\p{L}]", "", x.translate(_LOOKS)) for x in parts if len(_LETTER.findall(x)) > 1)
        out += got
    return out


def is_page_number(line: str) -> bool:
    return any(c in "0123456789" for c in line) and bool(_PAGE.match(line))


def is_broken(line: str) -> bool:
    """Whether the line ends at a mark right after a letter or digit."""
    r = line.rstrip()
    return len(r) > 1 and r[-1] in BREAKS and r[-2].isalnum()


class Automaton:
    """Levenshtein automaton of one word, its states numbered and made when first met.

    A state is the number of characters read and the distances to the prefixes of the word that are at most ``most`` shorter
    or longer than that, so a step costs the same for a word of any length. Characters that the word has not all lead to the
    same state.
    """

    OTHER = "\0"

    def __init__(self, word: str, most: int):
        self.word, self.most, self.letters = word, most, set(word)
        self.rows: list[tuple] = []
        self.number: dict[tuple, int] = {}
        self.next: list[dict[str, int]] = []  # by state: where a character leads, -1 for nowhere
        self.far: list[int] = []  # by state: distance of what was read to the whole word, most + 1 if greater than most
        self.add((0, tuple(d if 0 <= d <= len(word) else most + 1 for d in range(-most, most + 1))))

    def add(self, state: tuple) -> int:
        got = self.number.get(state)
        if got is None:
            got = self.number[state] = len(self.rows)
            self.rows.append(state)
            self.next.append({})
            o = len(self.word) - state[0] + self.most
            self.far.append(state[1][o] if 0 <= o <= 2 * self.most else self.most + 1)
        return got

    def step(self, at: int, ch: str) -> int:
        n, old = self.rows[at]
        most, word, row = self.most, self.word, []
        for o in range(2 * most + 1):
            i = n + 1 + o - most
            x = most + 1
            if 0 <= i <= len(word):
                if i:
                    x = min(x, old[o] + (word[i - 1] != ch))
                    if o:
                        x = min(x, row[o - 1] + 1)
                if o < 2 * most:
                    x = min(x, old[o + 1] + 1)
            row.append(x)
        got = self.next[at][ch] = self.add((n + 1, tuple(row))) if min(row) <= most else -1
        return got


class Trie:
    def __init__(self, words: list[str]):
        self.root: dict = {}
        for w in words:
            node = self.root
            for ch in w:
                node = node.setdefault(ch, {})
            node[""] = w

    def within(self, word: str, most: int) -> list[tuple[str, int]]:
        """All words of the trie at a distance of 1 to ``most`` from ``word``: the trie walked along the automaton."""
        a = Automaton(word, most)
        letters, lead, far, other = a.letters, a.next, a.far, a.OTHER
        out, stack = [], [(self.root, 0)]
        while stack:
            node, state = stack.pop()
            row = lead[state]
            for ch, child in node.items():
                if ch == "":
                    if 0 < far[state] <= most:
                        out.append((child, far[state]))
                    continue
                if ch not in letters:
                    ch = other
                nxt = row.get(ch)
                if nxt is None:
                    nxt = a.step(state, ch)
                if nxt >= 0:
                    stack.append((child, nxt))
        return out


class LevelTrie:
    """A trie whose nodes know the highest level of frequency (power of two) of the words below them."""

    def __init__(self, counts: dict[str, int]):
        self.root: dict = {}
        # commonest first: the word that makes a node is of its highest level, and children stand by falling level
        for n, w in sorted(((n.bit_length() - 1, w) for w, n in counts.items()), reverse=True):
            node = self.root
            for ch in w:
                got = node.get(ch)
                if got is None:
                    got = node[ch] = (n, {})
                node = got[1]
            node[""] = (n, None)

    def top(self, word: str, most: int) -> int:
        """Highest level of all words at a distance of 1 to ``most`` from ``word``, -1 if there is none.

        Only what cannot raise the level is left unwalked.
        """
        a = Automaton(word, most)
        letters, lead, far, other = a.letters, a.next, a.far, a.OTHER
        best, stack = -1, [(0, self.root, 0)]
        while stack:
            n, node, state = stack.pop()
            if n <= best:
                continue
            row = lead[state]
            for ch, (n, child) in reversed(node.items()):
                if n <= best:
                    continue
                if ch == "":
                    if 0 < far[state] <= most:
                        best = n
                    continue
                if ch not in letters:
                    ch = other
                nxt = row.get(ch)
                if nxt is None:
                    nxt = a.step(state, ch)
                if nxt >= 0:
                    stack.append((n, child, nxt))
        return best


def reach(word: str) -> int:
    return 1 if len(word) < 3 else 2 if len(word) < 8 else 3


def changes(read: str, true: str) -> list[tuple[int, str, str]]:
    """Chunks (place in ``read``, read, printed) in which two words differ, by a least-edit alignment."""
    pre = 0
    while pre < min(len(read), len(true)) and read[pre] == true[pre]:
        pre += 1
    post = 0
    while post < min(len(read), len(true)) - pre and read[-1 - post] == true[-1 - post]:
        post += 1
    a, b = read[pre : len(read) - post], true[pre : len(true) - post]
    if len(a) <= 2 and len(b) <= 2:
        return [(pre, a, b)]
    read, true = a, b
    n, m = len(read), len(true)
    d = [list(range(m + 1))]
    for i, x in enumerate(read, 1):
        up, row = d[-1], [i]
        for j, y in enumerate(true, 1):
            row.append(min(up[j] + 1, row[j - 1] + 1, up[j - 1] + (x != y)))
        d.append(row)
    i, j, ops = n, m, []
    while i or j:
        if i and j and read[i - 1] == true[j - 1] and d[i][j] == d[i - 1][j - 1]:
            i, j = i - 1, j - 1
            ops.append(None)
        elif i and j and d[i][j] == d[i - 1][j - 1] + 1:
            i, j = i - 1, j - 1
            ops.append((i, read[i], true[j]))
        elif i and d[i][j] == d[i - 1][j] + 1:
            i -= 1
            ops.append((i, read[i], ""))
        else:
            j -= 1
            ops.append((i, "", true[j]))
    out: list[tuple[int, str, str]] = []
    run = False
    ops = [op and (op[0] + pre, op[1], op[2]) for op in ops]
    for op in reversed(ops):
        if op is None:
            run = False
        elif run:
            p, a, b = out[-1]
            out[-1] = (p, a + op[1], b + op[2])
        else:
            out.append(op)
            run = True
    return out


class Furniture:
    """Odds of words to stand in a header, misread ones included.

    ``near`` are the clean words that lie near a sure one, of the whole clean vocabulary: they are no misread ones.
    ``core`` are clean words that need no look at the trie to know as much.
    """

    SURE = 5.0

    def __init__(self, odds: dict[str, float], core: set[str], near: set[str] = frozenset()):
        self.odds, self.clean = odds, {c.lower() for c in core} | near
        self.trie = Trie([w for w, s in odds.items() if s > self.SURE and len(w) > 4])
        self.seen: dict[str, float] = {}

    def around(self, w: str) -> list[str]:
        return [x for x, _ in self.trie.within(w, 2 if len(w) > 7 else 1)]

    def of(self, w: str) -> float:
        s = self.odds.get(w)
        if s is not None:
            return s
        if w in self.clean or len(w) < 5:
            return -3.0
        if w not in self.seen:
            if len(self.seen) > 200_000:
                self.seen.clear()
            self.seen[w] = max((self.odds[x] for x in self.around(w)), default=-3.0)
        return self.seen[w]

    def is_header(self, line: str) -> bool:
        words = furniture_words(line)
        # where most words are those of clean text, the others need no look at the trie
        plain = sum(self.odds.get(t, -3.0 if t in self.clean or len(t) < 5 else 1.0) <= 0 for t in words)
        if 2 * plain > len(words):
            return False
        score = [self.of(t) for t in words]
        return bool(score) and max(score) > self.SURE and sum(score) > 0 and 2 * sum(s > 0 for s in score) >= len(score)


def sort_lines(lines: list[str], furniture: Furniture) -> list[str]:
    """Kind of every line: blank, page_no, header or text."""
    return ["blank" if not x.strip() else "page_no" if is_page_number(x) else "header" if furniture.is_header(x) else "text" for x in lines]


def walk(lines: list[str], kinds: list[str]) -> tuple[list[int], list[tuple]]:
    """(text lines that end in a broken word, tokens). A token is (word, line, second line or -1, characters on the first line)."""
    text = [i for i, k in enumerate(kinds) if k == "text"]
    hyphens, tokens, carry = [], [], None
    for n, i in enumerate(text):
        toks = [(t, i, -1, 0) for t in lines[i].split()]
        if carry is not None and toks:
            head, at = carry
            toks[0] = (head + toks[0][0], at, i, len(_EDGE.sub("", head)))
            carry = None
        if n + 1 < len(text) and toks and is_broken(lines[i]):
            nxt = lines[text[n + 1]].split()
            last = lines[i].split()[-1]
            if nxt and _breaks_word(last, nxt[0]):
                hyphens.append(i)
                carry = (toks[-1][0][:-1], toks[-1][1])
                toks = toks[:-1]
        tokens += toks
    if carry is not None:
        tokens.append((carry[0], carry[1], -1, 0))
    return hyphens, tokens


def _breaks_word(last: str, follower: str) -> bool:
    """Whether the mark at the end of ``last`` is the line's and not the word's, given the next line's first token."""
    if last[-1] != "-":
        return last[-1] in BREAKS
    if follower.strip(".,;:").lower() in _JOINER or not _LETTER.search(last):
        return False
    if follower[0].islower() or follower[0] in "ſ;!|":
        return not last[:-1].isupper() or len(last) < 3
    return follower[0] in "015689I" and follower[1:2].islower()


def _counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        clean: dict[tuple, int] = {}
        for text in b["t"]:
            lines = text.split("\n")
            if not is_wrapped(lines):
                clean[("d", "")] = clean.get(("d", ""), 0) + 1
                for x in lines:
                    prev = ""
                    for tok in x.split():
                        w = word_of(tok)
                        clean[("w", w)] = clean.get(("w", w), 0) + 1
                        if prev and w:
                            clean[("p", prev + " " + w)] = clean.get(("p", prev + " " + w), 0) + 1
                        prev = w
                    for f in furniture_words(x):
                        clean[("b", f)] = clean.get(("b", f), 0) + 1
                continue
            full = [i for i, x in enumerate(lines) if x.strip()]
            for n, i in enumerate(full[:-2]):
                # a word breaks off, something stands between, and goes on in lower case within four lines
                if not is_broken(lines[i]) or lines[full[n + 1]].lstrip()[:1].islower():
                    continue
                for gap in range(1, 4):
                    if n + gap + 1 < len(full) and lines[full[n + gap + 1]].lstrip()[:1].islower():
                        for f in (w for k in range(1, gap + 1) for w in furniture_words(lines[full[n + k]])):
                            clean[("f", f)] = clean.get(("f", f), 0) + 1
                        break
        if clean:
            yield pd.DataFrame([(k, v, n) for (k, v), n in clean.items()], columns=["kind", "v", "n"])


def analyse(df: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame, Furniture]:
    """(marks, fixes, furniture). marks: ``(k, line_no, kind)`` of hyphen, header and page_no lines; fixes: ``(k, line_no, word, fix)``."""
    spark = df.sparkSession
    kind = df.schema[key].dataType.simpleString()
    slim = spread(df.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("t")))
    counts = cut_lineage(slim.select("t").mapInPandas(_counts, "kind string, v string, n bigint").groupBy("kind", "v").agg(F.sum("n").alias("n")))
    totals = {r["kind"]: r["n"] for r in counts.groupBy("kind").agg(F.sum("n").alias("n")).collect()}

    # furniture odds: every word that is significantly more frequent there than in clean text, however rare, and the frequent ones
    f_all, b_all = max(totals.get("f", 0), 1), max(totals.get("b", 0), 1)
    body = counts.where("kind = 'b'").select("v", F.col("n").alias("b"))
    seen = counts.where("kind = 'f'").select("v", F.col("n").alias("f")).join(body, "v", "left").withColumn("b", F.coalesce("b", F.lit(0)))
    n, share = F.col("f") + F.col("b"), f_all / (f_all + b_all)
    part = lambda x, p: F.when(x > 0, x * F.ln(x / (n * p))).otherwise(0.0)
    ratio = 2 * (part(F.col("f"), share) + part(F.col("b"), 1 - share))
    # the quantile of the log-likelihood ratio, for as many tests as there are words
    least = NormalDist().inv_cdf(SIGNIFICANT / max(counts.where("kind = 'f'").count(), 1) / 2) ** 2
    kept = cut_lineage(seen.where(((ratio > least) & (F.col("f") > n * share)) | (F.col("f") >= max(3, f_all // 400))))
    if kept.count() > MAX_FURNITURE:
        raise ValueError("too many words of page furniture to broadcast")
    odds = {r["v"]: math.log((r["f"] / f_all) / ((r["b"] or 0.5) / b_all)) for r in kept.collect()}
    words = counts.where("kind = 'w' AND v <> ''").select("v", "n")
    core = {r["v"] for r in words.orderBy(F.desc("n"), "v").limit(CORE_WORDS).collect()}
    sure = spark.sparkContext.broadcast(Furniture(odds, core))

    def near_sure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        f = sure.value
        for b in batches:
            hit = [w for w in b["v"] if w not in f.odds and f.around(w)]
            if hit:
                yield pd.DataFrame({"v": hit})

    near = {r["v"] for r in body.where("length(v) > 4").select("v").mapInPandas(near_sure, "v string").collect()}
    furniture = Furniture(odds, core, near)
    shared = spark.sparkContext.broadcast((furniture, core))

    def lines_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        furniture, core = shared.value
        for b in batches:
            out = []
            for k, t in zip(b["k"], b["t"]):
                lines = t.split("\n")
                kinds = sort_lines(lines, furniture)
                out += [(k, i + 1, x, None, None, None, -1, 0) for i, x in enumerate(kinds) if x in ("header", "page_no")]
                if not is_wrapped(lines):
                    continue
                hyphens, tokens = walk(lines, kinds)
                out += [(k, i + 1, "hyphen", None, None, None, -1, 0) for i in hyphens]
                ws = [word_of(x[0]) for x in tokens]
                for j, (w, (_, i, second, cut)) in enumerate(zip(ws, tokens)):
                    if w and w not in core:
                        out.append((k, i + 1, "word", w, ws[j - 1] if j else "", ws[j + 1] if j + 1 < len(ws) else "", second + 1 if second >= 0 else -1, cut))
            if out:
                yield pd.DataFrame(out, columns=["k", "line_no", "kind", "word", "before", "after", "second", "cut"])

    schema = f"k {kind}, line_no bigint, kind string, word string, before string, after string, second bigint, cut int"
    rows = cut_lineage(slim.mapInPandas(lines_of, schema))
    marks = rows.where("kind <> 'word'").select("k", "line_no", "kind")
    places = rows.where("kind = 'word'").drop("kind")

    # distinct words that no clean text has, against all clean words, however rare
    unknown = places.select("word").distinct().join(words.select(F.col("v").alias("word")), "word", "left_anti")
    cand = cut_lineage(_trusted(unknown, words))
    # how often each shape is read for another, over distinct words with one nearest candidate
    nearest = cand.withColumn("r", F.rank().over(W.partitionBy("word").orderBy("distance"))).where("r = 1")
    single = nearest.groupBy("word").agg(F.count("*").alias("c"), F.first("shapes").alias("shapes")).where("c = 1")
    counted = single.select(F.explode("shapes").alias("s")).groupBy("s").agg(F.count("*").alias("n"))
    n_single = single.count() + PRIOR_WORDS
    prior = {f"{a}>{b}": 0.01 * PRIOR_WORDS for a, b in SHAPES}
    # a shape that is known has at least KNOWN_SHARE, so there are at most 1 / KNOWN_SHARE beside the fixed ones
    known = {r["s"]: r["n"] for r in counted.where(F.col("n") + PRIOR_WORDS * 0.01 * F.col("s").isin(list(prior)).cast("int") >= KNOWN_SHARE * n_single).collect()}
    weights = {x: math.log((known.get(x, 0) + prior.get(x, 0)) / n_single) for x in {*known, *prior}}
    weight = F.create_map(*[x for s, v in sorted(weights.items()) for x in (F.lit(s), F.lit(v))])
    # a shape that is not known weighs little, by its length
    unseen = lambda x: F.lit(math.log(KNOWN_SHARE / 40)) * F.greatest(F.length(x) - 2, F.lit(1))
    scored = cand.withColumn("channel", F.aggregate(F.transform("shapes", lambda x: F.coalesce(F.try_element_at(weight, x), unseen(x))), F.lit(0.0), lambda a, b: a + b))
    scored = scored.withColumn("known", F.forall("shapes", lambda x: F.try_element_at(weight, x).isNotNull())).select("word", "cand", "channel", "known", "n", "at")

    # every word with its neighbours once, however often it stands there; context: the pairs of clean text on both sides
    spots = cut_lineage(places.groupBy("word", "before", "after").agg(F.count("*").alias("n_places")))
    pairs = counts.where("kind = 'p'").select("v", F.col("n").alias("pn"))
    at = spots.join(F.broadcast(scored) if scored.count() <= BROADCAST_ROWS else scored, "word")
    at = at.withColumn("left_pair", F.concat_ws(" ", "before", "cand")).withColumn("right_pair", F.concat_ws(" ", "cand", "after"))
    at = at.join(pairs.select(F.col("v").alias("left_pair"), F.col("pn").alias("ln")), "left_pair", "left").join(pairs.select(F.col("v").alias("right_pair"), F.col("pn").alias("rn")), "right_pair", "left")
    # a candidate by shapes that are not known counts only where a neighbour calls for it: clean text has it between the two,
    # and at least every second time beside one of them (a name stands in a place of names, none of which is called for)
    for side, pair in (("before", "ln"), ("after", "rn")):
        at = at.join(words.select(F.col("v").alias(side), F.col("n").alias(f"n_{side}")), side, "left").withColumn(f"c_{side}", F.coalesce(2 * F.col(pair) >= F.col(f"n_{side}"), F.lit(False)))
    at = at.where(F.col("known") | (F.col("ln").isNotNull() & F.col("rn").isNotNull() & (F.col("c_before") | F.col("c_after"))))
    score = F.col("channel") + F.ln("n") * 0.5 + F.ln(1 + F.coalesce("ln", F.lit(0))) + F.ln(1 + F.coalesce("rn", F.lit(0)))
    top = at.groupBy("word", "before", "after").agg(F.max("n_places").alias("n_places"), F.min_by(F.struct("cand", "at"), F.struct(-score, "cand")).alias("best"))
    top = cut_lineage(top.select("word", "before", "after", "n_places", F.col("best.cand").alias("cand"), F.col("best.at").alias("at")))
    total = spots.agg(F.coalesce(F.sum("n_places"), F.lit(0))).collect()[0][0]
    hits = salted_join(places, top, ["word", "before", "after"], "n_places", "k", total)
    # the damaged line of a word broken over two
    on_first = F.exists("at", lambda p: p < F.col("cut"))
    on_second = F.exists("at", lambda p: p >= F.col("cut"))
    hit = F.when(F.col("second") < 0, F.array("line_no")).otherwise(F.array_compact(F.array(F.when(on_first, F.col("line_no")), F.when(on_second, F.col("second")))))
    fixes = hits.select("k", F.col("line_no").alias("first_line"), F.explode(hit).alias("line_no"), "word", F.col("cand").alias("fix"))
    return marks, fixes, furniture


def _trusted(unknown: DataFrame, words: DataFrame) -> DataFrame:
    """The candidates among all clean words of those unknown words whose commonest candidate tells more than chance.

    A name that no clean text has lies near other names and is not misread. How often that happens by chance is measured on
    all of the rarest clean words (those seen once), which are not misread either: at each level of frequency (powers of two) the share of
    them with a best candidate of that level, against the share of the unknown words. A level counts if at most half of its
    finds are expected by chance. No count of a word and no size of the corpus enters. The level of the best candidate of
    every word comes first; the candidates themselves are looked up for the words of a level that counts.
    """
    rarest = words.agg(F.min("n")).collect()[0][0]
    decoys = words.where(F.col("n") == F.lit(rarest)).select(F.col("v").alias("word"), F.lit(True).alias("decoy"))
    every = cut_lineage(unknown.select("word", F.lit(False).alias("decoy")).unionByName(decoys))
    top = cut_lineage(_top_levels(every.select("word"), words).groupBy("word").agg(F.max("level").alias("level")).join(every, "word"))
    size = {r["decoy"]: r["n"] for r in every.groupBy("decoy").agg(F.count("*").alias("n")).collect()}
    hits = {(r["decoy"], r["level"]): r["n"] for r in top.groupBy("decoy", "level").agg(F.count("*").alias("n")).collect()}
    levels = trusted_levels({k: n for (d, k), n in hits.items() if not d}, size.get(False, 0), {k: n for (d, k), n in hits.items() if d}, size.get(True, 0))
    return _candidates(top.where(~F.col("decoy") & F.col("level").isin(levels)).select("word"), words)


def trusted_levels(seen: dict[int, int], n_seen: int, chance: dict[int, int], n_chance: int) -> list[int]:
    """Levels of frequency at which at most half of the words ``seen`` are expected by ``chance``."""
    q = {k: n / n_seen for k, n in seen.items()} | {-1: 1 - sum(seen.values()) / max(n_seen, 1)}
    r = {k: n / max(n_chance, 1) for k, n in chance.items()} | {-1: 1 - sum(chance.values()) / max(n_chance, 1)}
    # the share of the unknown words that are not misread is at most what the outcome (-1: no candidate) most common by chance allows
    usual = max(sorted(r), key=r.get)
    honest = min(1.0, q.get(usual, 0.0) / r[usual]) if n_chance else 0.0
    return sorted(k for k in seen if honest * r.get(k, 0.0) <= 0.5 * q[k])


def _sharded(unknown: DataFrame, vocab: DataFrame) -> DataFrame:
    """``(word, n, kind)``: the words of ``vocab`` (kind 0) and the unknown ones (kind 1), set out for look-up.

    Every partition holds one shard of the vocabulary and a part of the unknown words. The vocabulary comes first, is made a
    trie once, and the unknown words stream past it. There are about two partitions a core, so a shard is copied at most as
    often, however many words are unknown.
    """
    cores = unknown.sparkSession.sparkContext.defaultParallelism
    shards = max(1, -(-vocab.count() // SHARD_WORDS))
    chunks = max(1, -(-2 * cores // shards))
    part = F.col("shard") * chunks + F.col("chunk")
    left = unknown.select("word", F.lit(None).cast("bigint").alias("n"), F.lit(1).alias("kind"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.pmod(F.xxhash64("word"), F.lit(chunks)).cast("int").alias("chunk"))
    right = vocab.select(F.col("v").alias("word"), "n", F.lit(0).alias("kind"), F.pmod(F.xxhash64("v", F.lit(3)), F.lit(shards)).cast("int").alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"))
    return left.unionByName(right).withColumn("part", part.cast("int")).repartitionById(shards * chunks, "part").sortWithinPartitions("kind").select("word", "n", "kind")


def _top_levels(unknown: DataFrame, vocab: DataFrame) -> DataFrame:
    """``(word, level)``: by shard, the highest level of frequency of all words of ``vocab`` within reach; no row where none is."""

    def look_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n: dict[str, int] = {}
        trie = None
        for b in batches:
            own = b["kind"] == 0
            n.update(zip(b["word"][own], b["n"][own].astype("int64").tolist()))
            out = []
            for w in b["word"][~own]:
                if trie is None:
                    trie = LevelTrie(n)
                level = trie.top(w, reach(w))
                if level >= 0:
                    out.append((w, level))
            if out:
                yield pd.DataFrame(out, columns=["word", "level"])

    return _sharded(unknown, vocab).mapInPandas(look_up, "word string, level int")


def _candidates(unknown: DataFrame, vocab: DataFrame) -> DataFrame:
    """``(word, cand, n, distance, shapes, at)``: all words of ``vocab`` within reach of every unknown word, with the changed shapes."""

    def look_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n: dict[str, int] = {}
        trie = None
        for b in batches:
            own = b["kind"] == 0
            n.update(zip(b["word"][own], b["n"][own].astype("int64")))
            out = []
            for w in b["word"][~own]:
                if trie is None:
                    trie = Trie(list(n))
                for c, d in trie.within(w, reach(w)):
                    ch = changes(w, c)
                    out.append((w, c, n[c], d, [f"{x}>{y}" for _, x, y in ch], [p for p, _, _ in ch]))
            if out:
                yield pd.DataFrame(out, columns=["word", "cand", "n", "distance", "shapes", "at"])

    return _sharded(unknown, vocab).mapInPandas(look_up, "word string, cand string, n bigint, distance int, shapes array<string>, at array<int>")


def damaged_lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, line_no, kind)``: one row per damaged line and kind (``hyphen``, ``char``, ``header``, ``page_no``).

    Null, empty and blank texts give no row. Rows that repeat a key are told together; extra columns are not read.
    """
    marks, fixes, _ = analyse(df, key, text)
    char = fixes.select("k", "line_no", F.lit("char").alias("kind"))
    return marks.unionByName(char).distinct().withColumnRenamed("k", key)


def repair(df: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, text)``: every non-null text as continuous paragraphs, without page furniture, with misread words put right.

    Clean texts come out as they are. Where ``key`` repeats, each row is repaired by itself with the fixes of all.
    """
    kind = df.schema[key].dataType.simpleString()
    _, fixes, furniture = analyse(df, key, text)
    per_doc = fixes.groupBy("k").agg(F.collect_set(F.struct("first_line", "word", "fix")).alias("fixes"))
    docs = df.where(F.col(text).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("t")).join(per_doc, "k", "left")
    shared = df.sparkSession.sparkContext.broadcast(furniture)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        furniture = shared.value
        for b in batches:
            out = []
            for t, fx in zip(b["t"], b["fixes"]):
                known = {(r["first_line"], r["word"]): r["fix"] for r in fx} if fx is not None else {}
                out.append(reflow(t, furniture, known))
            yield pd.DataFrame({"k": b["k"], "text": out})

    return docs.mapInPandas(run, f"k {kind}, text string").withColumnRenamed("k", key)


def reflow(text: str, furniture: Furniture, fixes: dict[tuple[int, str], str]) -> str:
    lines = text.split("\n")
    if not is_wrapped(lines):
        return text
    kinds = sort_lines(lines, furniture)
    _, tokens = walk(lines, kinds)
    out, para, last = [], [], -1
    for tok, i, second, _ in tokens:
        if para and last >= 0 and i != last and any(k == "blank" for k in kinds[last:i]) and _ENDS.search(para[-1]):
            out.append(" ".join(para))
            para = []
        w = word_of(tok)
        fix = fixes.get((i + 1, w)) if w else None
        para.append(tok.replace(_EDGE.sub("", tok), with_figures(fix, _EDGE.sub("", tok))) if fix else tok)
        last = second if second >= 0 else i
    if para:
        out.append(" ".join(para))
    return "\n\n".join(out)


def with_figures(fix: str, token: str) -> str:
    """``fix`` with the figures of ``token`` where words have 0 for them; the token where their numbers differ."""
    own = _FIGURES.findall(token)
    if len(own) != len(_FIGURES.findall(fix)):
        return token
    return _FIGURES.sub(lambda m, it=iter(own): next(it), fix)
