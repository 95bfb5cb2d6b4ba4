"""Text functions. Everything stays in the JVM unless a docstring says otherwise; null in gives null out unless stated."""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types

WS = r"[\s\p{Z}]"


def strip(c: Column) -> Column:
    """Blanks of every kind off both ends (``trim`` takes spaces only)."""
    return F.regexp_replace(c, rf"^{WS}+|{WS}+$", "")


def collapse(c: Column) -> Column:
    """Runs of blanks to one space, none at the ends."""
    return strip(F.regexp_replace(c, rf"{WS}+", " "))


def shorten(c: Column, n: int) -> Column:
    """Collapsed text of at most ``n`` characters, the last an ellipsis where something was cut."""
    t = collapse(c)
    return F.when(F.length(t) <= n, t).otherwise(F.concat(F.substring(t, 1, n - 1), F.lit("…")))


def normal_key(c: Column) -> Column:
    """Lower case without blanks at the ends; null stays null."""
    return strip(F.lower(c))


def concat_texts(*cols: Column) -> Column:
    """Texts with a space between, null as empty."""
    return F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in cols])


def by_keyword(c: Column, rules: list[tuple[str, str]], other: str) -> Column:
    """First rule ``(part, class)`` whose part the lower-case text holds; order matters; null gives ``other``."""
    out = F.lit(other)
    for part, name in reversed(rules):
        out = F.when(F.contains(F.lower(c), F.lit(part)), F.lit(name)).otherwise(out)
    return out


def drop_controls(c: Column) -> Column:
    """C1 control characters to spaces."""
    return F.regexp_replace(c, r"[\x{80}-\x{9f}]", " ")


# fixed values: the months, the parts of number words, and what a law's title carries besides its subject, in order of removal
MONTHS = "Januar|Februar|März|April|Mai|Juni|Juli|August|September|Oktober|November|Dezember"
NUMBER_WORD = "(?:ein|zwei|drei|vier|fünf|sechs|sech|sieben|sieb|acht|neun|zehn|elf|zwölf|zwanzig|dreißig|vierzig|fünfzig|sechzig|siebzig|achtzig|neunzig|hundert|tausend|und)"
ORDINAL = rf"\b(?:erst|dritt|siebt|acht|{NUMBER_WORD}+s?t)(?:e|er|es|en|em)\b"
TITLE_NOISE = [
    r"^(?:Bekanntmachung\s+der\s+)?Neufassung\s+(?:der|des)\s+",
    r"\b(?:Gesetz|Verordnung|Anordnung)\s+zur\s+(?:Änderung|Aufhebung|Ergänzung|Neufassung)(?:\s+und\s+(?:Aufhebung|Ergänzung))?\s+(?:der|des|von)\s+",
    r"\b(?:und|sowie)\s+(?:zur\s+)?Änderung\s+(?:weiterer|anderer|sonstiger)\s+(?:\w+\s+)?(?:Vorschriften|Gesetze|Verordnungen)\b",
    r"\bund\s+anderer\s+(?:\w+\s+)?(?:Gesetze|Vorschriften|Verordnungen)\b",
    rf"\b(?:vom|zum|am|bis\s+zum)\s+\d{{1,2}}\.\s*(?:{MONTHS})\s+\d{{4}}",
    r"§§?\s*\d+[a-z]?",
    r"\b(?:Absatz|Abs\.|Satz|Nummer|Nr\.|Artikel|Art\.)\s*\d+[a-z]?",
    r"\b\d+[a-z]?\b\.?",
]


def drop_abbreviations(c: Column) -> Column:
    """Abbreviations out of every innermost pair of parentheses, the pair itself if nothing is left in it.

    A token is an abbreviation if each of its parts between ``-``, ``/``, ``–`` and ``.`` is a number, or begins with a
    capital and has at most three characters or a further capital or digit.
    """
    part = r"(?s)^(?:\p{Nd}+|\p{Lu}.{0,2}|\p{Lu}.*[\p{Lu}\p{Nd}].*)$"

    def short(token: Column) -> Column:
        return F.forall(F.filter(F.split(token, r"[-/–.]"), lambda x: x != ""), lambda x: x.rlike(part))

    def inner(piece: Column) -> Column:
        kept = F.filter(F.split(F.regexp_replace(piece, r"^\(|\)$", ""), rf"{WS}+"), lambda t: (t != "") & ~short(t))
        return F.when(F.size(kept) > 0, F.concat(F.lit("("), F.array_join(kept, " "), F.lit(")"))).otherwise(F.lit(""))

    pieces = F.split(c, r"(?=\([^()]*\))|(?<=\))")
    return F.array_join(F.transform(pieces, lambda x: F.when(x.rlike(r"^\([^()]*\)$"), inner(x)).otherwise(x)), "")


def clean_title(c: Column) -> Column:
    """Title without controls, standard phrases, numbers, abbreviations in parentheses and ordinals (kept before "Buch").

    Blanks are collapsed and marks at the ends removed; the title itself if nothing is left.
    """
    t = drop_controls(c)
    for p in TITLE_NOISE:
        t = F.regexp_replace(t, "(?iU)" + p, " ")
    t = F.regexp_replace(drop_abbreviations(t), rf"(?iU){ORDINAL}(?!\s+Buch)", "")
    t = F.regexp_replace(F.regexp_replace(F.regexp_replace(t, rf"\({WS}+", "("), rf"{WS}+\)", ")"), r"\(\)", " ")
    t = F.regexp_replace(F.regexp_replace(t, rf"{WS}+", " "), r"^[ ,;:\-–]+|[ ,;:\-–]+$", "")
    return F.coalesce(F.nullif(t, F.lit("")), c)


def referenced_title(c: Column) -> Column:
    """The title that a correction or annex names; empty if the text is neither."""
    return F.regexp_extract(c, r"(?is)^\s*(?:Berichtigung|Anlage(?:nband)?)\s+(?:de[rs]|zu[mr]?)\s+(.+?)\s*$", 1)


def document_class(c: Column) -> Column:
    return F.when(c.rlike(r"(?i)^\s*Berichtigung\b"), "correction").when(c.rlike(r"(?i)^\s*Anlage(nband)?\b"), "annex").otherwise("regular")


def named_title(c: Column) -> Column:
    """The title whose words stand for a document: of a correction or annex the one it names, also after a colon; else its own."""
    rest = F.regexp_replace(c, r"(?i)^\s*(?:Berichtigung|Anlage(?:nband)?)\b[\s:–-]*", "")
    return F.coalesce(F.nullif(referenced_title(c), F.lit("")), rest)


# fixed values: words that are no stems, and the endings cut off
ENDINGS = r"(es|en|er|em|e|s|n)$"
FUNCTION_WORDS = "der die das den dem des und oder zur zum von vom für über mit nach ein eine einer eines auf im in an am bei".split()


def stems(c: Column) -> Column:
    """Set of crude stems: dates and function words off, one ending off, the word itself if nothing is left."""
    t = F.regexp_replace(F.lower(c), r"\p{N}{1,2}\. ?\p{L}+ \p{N}{4}", " ")
    words = F.filter(F.regexp_extract_all(t, F.lit(r"([\p{L}\p{N}]+)"), F.lit(1)), lambda w: ~w.isin(FUNCTION_WORDS))
    return F.array_distinct(F.transform(words, _cut_ending))


def _cut_ending(w: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_replace(w, ENDINGS, ""), F.lit("")), w)


def plain_markdown(c: Column) -> Column:
    """A markdown line without tags, heading marks, emphasis and table bars."""
    t = F.regexp_replace(c, r"<[^>]+>", " ")
    t = F.regexp_replace(t, r"^#+\s*", "")
    t = F.regexp_replace(t, r"[*_`]+", "")
    return collapse(F.regexp_replace(t, r"\|", " "))


def file_slug(c: Column) -> Column:
    """Lower-case ASCII slug with umlauts spelled out; ``document`` if nothing is left."""
    t = F.lower(c)
    # fixed values: umlauts spelled out
    for a, b in (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss")):
        t = F.replace(t, F.lit(a), F.lit(b))
    t = F.regexp_replace(F.regexp_replace(t, r"[^a-z0-9]+", "_"), r"^_+|_+$", "")
    return F.coalesce(F.nullif(t, F.lit("")), F.lit("document"))


def safe_name(c: Column) -> Column:
    return F.replace(c, F.lit("/"), F.lit("-"))


def letter_spacing(c: Column) -> Column:
    """Letter-spaced words left in a text."""
    return F.regexp_extract_all(c, F.lit(r"((?:\p{L} ){4,}\p{L})\b"), F.lit(1))


def close_spacing(c: Column) -> Column:
    """Letter-spaced words closed up."""
    return F.regexp_replace(c, r"(?<=\b\p{L}) (?=\p{L}\b)", "")


def has_table(c: Column) -> Column:
    return c.rlike(r"(?m)^\|[-:| ]+\|$")


def word_count(c: Column) -> Column:
    """Words between blanks; empty gives 0."""
    return F.size(F.filter(F.split(c, rf"{WS}+"), lambda w: w != ""))


def tokens(c: Column) -> Column:
    """Letter-digit-underscore tokens of the Unicode kind, line-break tags taken as blanks."""
    return F.regexp_extract_all(F.regexp_replace(c, r"(?i)<br\s*/?>", " "), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))


def fill_template(template: Column, values: dict[str, Column]) -> Column:
    """Placeholders ``{name}`` replaced one after the other in the order given; null as empty."""
    for name, v in values.items():
        template = F.replace(template, F.lit("{" + name + "}"), F.coalesce(v.cast("string"), F.lit("")))
    return template


def join_sections(*cols: Column) -> Column:
    """Non-empty sections with a blank line between."""
    return F.concat_ws("\n\n", *[F.nullif(c, F.lit("")) for c in cols])


def two_sections(c: Column, first: str, second: str) -> tuple[Column, Column]:
    """The parts of a markdown template under two headings."""
    a = F.regexp_extract(c, rf"(?s)#+\s*{first}\s*\n(.*?)(?=\n#+\s*{second}|\z)", 1)
    b = F.regexp_extract(c, rf"(?s)#+\s*{second}\s*\n(.*)\z", 1)
    return strip(a), strip(b)


def token_estimate(c: Column) -> Column:
    return F.floor(F.length(c) / 4)


AREA_CODE = r"(?<![\p{L}\p{N}_-])(\p{N}{1,4}(?:-\p{N}+)+(?:[a-z])?)(?![\p{L}\p{N}_-])"


def area_codes(c: Column) -> Column:
    """Codes bounded by neither word characters nor hyphens, first-seen order, each once."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit(AREA_CODE), F.lit(1)))


def matches_code(codes: Column, prefix: str, parts: list[str], empty: bool = False) -> Column:
    """Any code starts with ``prefix`` or has its part before the first hyphen in ``parts``; no code gives ``empty``."""
    hit = F.exists(codes, lambda c: F.startswith(c, F.lit(prefix)) | F.substring_index(c, "-", 1).isin(parts))
    return F.when(F.coalesce(F.size(codes), F.lit(0)) <= 0, F.lit(empty)).otherwise(F.coalesce(hit, F.lit(False)))


def labelled_field(lines: Column, label: str) -> Column:
    """The value after ``label:`` in an array of lines: on the same line, else the next line; null if there is none."""
    at = F.array_position(F.transform(lines, lambda x: F.startswith(F.lower(strip(x)), F.lit(label.lower() + ":"))), True).cast("int")
    same = strip(F.regexp_replace(F.try_element_at(lines, at), r"^[^:]*:", ""))
    after = strip(F.try_element_at(lines, at + 1))
    return F.when(at > 0, F.coalesce(F.nullif(same, F.lit("")), after))


def without_fragment(url: Column) -> Column:
    return F.substring_index(url, "#", 1)


def join_url(base: Column, ref: Column) -> Column:
    """Absolute form of ``ref`` against ``base``: full, host-rooted or relative to the folder."""
    root = F.regexp_extract(base, r"^([a-z][a-z0-9+.-]*://[^/]+)", 1)
    folder = F.regexp_replace(F.substring_index(base, "?", 1), r"[^/]*$", "")
    return F.when(ref.rlike(r"^[a-z][a-z0-9+.-]*://"), ref).when(F.startswith(ref, F.lit("/")), F.concat(root, ref)).otherwise(F.concat(folder, ref))


def split_key(c: Column) -> Column:
    """``2023/12a`` -> struct(year 2023, n 12, number 12a); no digits give n 0."""
    number = F.try_element_at(F.split(c, "/"), F.lit(2))
    n = F.coalesce(F.regexp_extract(number, r"^(\p{N}+)", 1).try_cast("int"), F.lit(0))
    return F.struct(F.substring_index(c, "/", 1).try_cast("int").alias("year"), n.alias("n"), number.alias("number"))


def padded_number(c: Column) -> Column:
    """``7`` -> ``007``, ``12a`` -> ``012a``; longer numbers and other texts as they are."""
    digits = F.regexp_extract(c, r"^(\p{N}+)\p{L}?$", 1)
    return F.when((F.length(digits) > 0) & (F.length(digits) < 3), F.concat(F.lpad(digits, 3, "0"), F.regexp_extract(c, r"(\p{L}?)$", 1))).otherwise(c)


@F.pandas_udf(types.StringType())
def nfc(s: pd.Series) -> pd.Series:
    """Unicode normal form C (Python, Arrow batches)."""
    return s.map(lambda x: unicodedata.normalize("NFC", x), na_action="ignore")


@F.pandas_udf(types.StructType([types.StructField(n, types.BooleanType()) for n in ("nfc_changes", "has_entity")]))
def _normal_forms(s: pd.Series) -> pd.DataFrame:
    t = s.fillna("")
    return pd.DataFrame({"nfc_changes": t.map(lambda x: unicodedata.normalize("NFC", x) != x), "has_entity": t.map(lambda x: html.unescape(x) != x)})


def unicode_report(c: Column) -> Column:
    """Diagnostics of a text; null gives all false. Normal form and entities are told in Python on Arrow batches, the rest in the JVM."""
    forms = _normal_forms(c)
    flag = lambda x: F.coalesce(x, F.lit(False))
    return F.struct(flag(c.rlike("[äöüßÄÖÜ]")).alias("has_umlaut"), forms["nfc_changes"].alias("nfc_changes"), forms["has_entity"].alias("has_entity"), flag(F.contains(c, F.lit("\ufffd"))).alias("has_replacement"))


# fixed values: lines and phrases between a law's heading and its body
PAGE_HEADER = re.compile(r"^.*Bundesgesetzblatt\s+Jahrgang\s+\d{4}\s+Teil\s+I\s+Nr\..*$", re.M)
DATE_LINE = re.compile(rf"^\s*Vom\s+\d{{1,2}}\.\s*(?:{MONTHS})\s+\d{{4}}\s*$", re.M)
FORMULA = re.compile(r"Der Bundestag hat (?:mit Zustimmung des Bundesrates )?das folgende Gesetz beschlos(?:sen:|-)\s*")
#: Characters between the heading and the date line that belongs to it; letters and digits of a title that are looked for.
DATE_LINE_WITHIN, TITLE_LETTERS = 1500, 40


@F.pandas_udf(types.StringType())
def title_opening(title: pd.Series, text: pd.Series) -> pd.Series:
    """The first 1,000 characters of the body that begins at the document's heading (Python, Arrow batches).

    The heading is where the title's first 40 letters and digits stand among those of the text; without it the text's own
    beginning counts. A date line soon after the heading is skipped with all before it. Page headers and the enactment
    formula are taken out, words broken over lines joined, blanks collapsed. Null gives the empty text.
    """
    most = 1000

    def one(t, x):
        if not x:
            return ""
        want = "".join(c for c in (t or "") if c.isalnum()).lower()[:TITLE_LETTERS]
        places = [i for i, c in enumerate(x) if c.isalnum()]
        at = "".join(x[i].lower()[:1] for i in places).find(want) if want else -1
        start = places[at] if at >= 0 else 0
        line = DATE_LINE.search(x, start)
        if line and line.start() < start + DATE_LINE_WITHIN:
            start = line.end()
        body = PAGE_HEADER.sub(" ", x[start : start + 3 * most])
        body = " ".join(re.sub(r"(?<=\w)-\n\s*(?=[a-zäöüß])", "", body).split())
        return FORMULA.sub("", body).strip()[:most]

    return pd.Series([one(a, b) for a, b in zip(title, text)])


def stop_words(language: str = "german") -> list[str]:
    """The list that Spark ships for a language."""
    from pyspark.ml.feature import StopWordsRemover

    return StopWordsRemover.loadDefaultStopWords(language)


def lemmas(c: Column, lemmatise: Callable[[Column], Column] | None = None, stop: list[str] | None = None) -> Column:
    """Lower-case words of a text without stop words, each by ``lemmatise`` (any function of an array of words, such as a
    pandas UDF around a language model); without one the crude endings of :func:`stems` are cut. Order and repeats stay."""
    listed = F.array(*[F.lit(w) for w in (stop_words() if stop is None else stop)]) if stop != [] else F.array().cast("array<string>")
    plain = F.filter(F.regexp_extract_all(F.lower(c), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1)), lambda w: ~F.array_contains(listed, w))
    return lemmatise(plain) if lemmatise else F.transform(plain, _cut_ending)


def ngrams(words: Column, most: int = 2) -> Column:
    """All runs of 1 to ``most`` words, joined by a blank, by length and then by place."""
    def runs(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.size(words) - (n - 1))
        return F.when(F.size(words) >= n, F.transform(starts, lambda i: F.array_join(F.slice(words, i, n), " "))).otherwise(F.array().cast("array<string>"))

    parts = [runs(n) for n in range(1, most + 1)]
    return F.flatten(F.array(*parts))


def issue_order(key: Column) -> list[Column]:
    """Sort expressions of ``yyyy/number`` keys: year, leading digits of the number, then the whole number."""
    k = split_key(key)
    return [k["year"].asc_nulls_first(), k["n"].asc(), k["number"].asc_nulls_first()]


def first_of_pairs(pairs: Column, field: str) -> Column:
    """One member of every struct of an array."""
    return F.transform(pairs, lambda x: x[field])


def by_integer_key(m: Column) -> Column:
    """Entries of a map with numbers as texts for keys, in order of the numbers; other keys last, by text."""
    return F.transform(F.array_sort(F.transform(F.map_entries(m), lambda e: F.struct(e["key"].try_cast("bigint").isNull().alias("a"), e["key"].try_cast("bigint").alias("n"), e["key"].alias("key"), e["value"].alias("value")))), lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value")))


def labelled_values(lines: Column, label: str, labels: list[str]) -> Column:
    """The value of ``label:`` in an array of lines: the rest of its line and all lines up to the next of ``labels``, blank ones left out; null without it."""
    is_label = lambda x, names: F.exists(F.array(*[F.lit(n.lower() + ":") for n in names]), lambda n: F.startswith(F.lower(strip(x)), n))
    at = F.array_position(F.transform(lines, lambda x: is_label(x, [label])), True).cast("int")
    rest = F.slice(lines, at + 1, F.size(lines))
    end = F.array_position(F.transform(rest, lambda x: is_label(x, labels)), True).cast("int")
    own = F.when(end > 0, F.slice(rest, 1, F.greatest(end - 1, F.lit(0)))).otherwise(rest)
    got = F.filter(F.concat(F.array(F.regexp_replace(F.try_element_at(lines, at), r"^[^:]*:", "")), own), lambda x: strip(x) != "")
    return F.when(at > 0, F.array_join(F.transform(got, strip), " "))


def dataset_tag(country: Column, name: Column) -> Column:
    """First three letters of the country and all ``dddd-dddd`` parts of a file's name, joined by underscores."""
    spans = F.regexp_extract_all(name, F.lit(r"(\p{Nd}{4}-\p{Nd}{4})"), F.lit(1))
    return F.concat_ws("_", F.lower(F.substring(country, 1, 3)), F.array_join(spans, "_"))


def merged(df: DataFrame, left: str, right: str) -> Column:
    """One struct of the fields of two struct columns; of fields with one name the right one counts."""
    a, b = (df.schema[c].dataType.fieldNames() for c in (left, right))
    return F.struct(*[F.col(right if n in b else left)[n].alias(n) for n in dict.fromkeys([*a, *b])])
