"""The repair of scanned text loses nothing to shares of the corpus."""

import random

from conftest import rows
from pyspark.sql import functions as F

from tallyloom.llm import scan_repair

FILL = "Die Behörde prüft den Antrag und teilt das Ergebnis schriftlich mit."
PAGE = "Die Behörde prüft den Antrag auf Zulassung und teilt das Ergebnis mit der\nBescheinigung über die Pflegeversicherunq schriftlich mit, sobald der\nAntrag auf Zulassung geprüft ist und das Ergebnis der Behörde mit allen\nAngaben vorliegt."


def _damaged(spark, n_clean):
    clean = [FILL] * n_clean + ["Die Zulassung und die Bescheinigung, sobald auf allen Angaben über der ist mit vorliegt geprüft. Die Pflegeversicherung teilt das Ergebnis mit."] * 5
    df = spark.createDataFrame([("p", PAGE), *[(f"c{i}", t) for i, t in enumerate(clean)]], "id string, t string")
    return rows(scan_repair.damaged_lines(df, "id", "t"))


def test_word_is_repaired_alike_in_a_larger_corpus(spark):
    small, large = _damaged(spark, 100), _damaged(spark, 9000)
    assert small == large == [("p", 2, "char")]


def test_trusted_levels():
    # names near names: as many by chance as seen
    assert scan_repair.trusted_levels({0: 40, 7: 50}, 100, {0: 45, 7: 1}, 50) == [7]
    # rare words that chance does not meet are trusted
    assert scan_repair.trusted_levels({0: 30, 7: 50}, 100, {0: 5}, 100) == [0, 7]
    assert scan_repair.trusted_levels({0: 1}, 1, {}, 0) == [0] and scan_repair.trusted_levels({}, 0, {}, 0) == []


def test_word_seen_once_is_a_candidate(spark):
    words = spark.createDataFrame([("Pflegeversicherung", 1), ("Behörde", 5000), ("Zulassung", 800)], "v string, n bigint")
    unknown = spark.createDataFrame([("Pflegeversicherunq",), ("Behördc",)], "word string")
    assert {(r["word"], r["cand"]) for r in scan_repair._trusted(unknown, words).collect()} == {("Pflegeversicherunq", "Pflegeversicherung"), ("Behördc", "Behörde")}


def test_rare_running_headers_are_found(spark):
    # 500 headers of their own, each with about 1/500 of the furniture words and so under any share of 1/400
    names = ["".join("bdfgklmnprstvz"[(i * 7 + k * k * (i // 14 + 1)) % 14] + "aeiou"[(i // 5 ** k) % 5] for k in range(5)) + "blatt" for i in range(500)]
    assert len(set(names)) == 500
    page = "Die Behörde prüft den Antrag und teilt das Ergeb-\n{h}\nnis schriftlich mit. Die Behörde prüft den An-\n{h}\ntrag und teilt das Ergebnis schriftlich mit, so\nsie den Antrag prüft. Die Behörde teilt das Ergeb-\n{h}\nnis mit."
    text = [("c%d" % i, FILL) for i in range(6000)] + [("h%d" % i, "\n".join([page.format(h=h.capitalize())] * 2)) for i, h in enumerate(names)]
    got = scan_repair.damaged_lines(spark.createDataFrame(text, "id string, t string"), "id", "t").where("kind = 'header'")
    assert got.count() == 3000 and {r["line_no"] for r in got.select("line_no").distinct().collect()} == {2, 4, 7, 10, 12, 15}


def test_doubled_corpus_loses_no_line(spark):
    """Every line told in the corpus is told when each text stands there twice, in both copies alike."""
    one = spark.read.parquet("/root/testdata/sf0.001/final_policy_set.parquet").select("id", "full_text")
    both = one.unionByName(one.select(F.concat("id", F.lit("'")).alias("id"), "full_text"))
    want = rows(scan_repair.damaged_lines(one, "id", "full_text"))
    got = rows(scan_repair.damaged_lines(both, "id", "full_text"))
    assert want and set(want) <= set(got)
    assert {(i[:-1], n, k) for i, n, k in got if i.endswith("'")} == {x for x in got if not x[0].endswith("'")}


def test_shape_never_seen_counts_where_a_neighbour_calls_for_the_word(spark):
    clean = ["Der Antrag auf Erteilung der Erlaubnis ist schriftlich zu stellen."] * 40 + ["Das Abkommen mit dem Staat Kabistan gilt fort."] * 3 + ["Das Abkommen mit dem Staat Norwegen gilt fort."] * 9
    page = "Der Antrag auf Erteiluxg der Erlaubnis ist schriftlich zu stellen, sobald\nder Antrag auf Erteilung der Erlaubnis ist, und das Abkommen mit dem\nStaat Kamistan gilt fort, sobald der Antrag gilt und schriftlich zu\nstellen ist."
    df = spark.createDataFrame([("p", page), *[(f"c{i}", t) for i, t in enumerate(clean)]], "id string, t string")
    assert rows(scan_repair.damaged_lines(df, "id", "t")) == [("p", 1, "char")]


def test_words_of_any_length_are_looked_up():
    long = "Donaudampfschifffahrtsgesellschaft" * 20
    trie = scan_repair.Trie([long, "Haus"])
    assert trie.within(long[:300] + "x" + long[301:], 3) == [(long, 1)] and trie.within(long, 3) == []
    assert scan_repair.word_of(long + ".") == long


def test_figures_survive_a_fix():
    assert scan_repair.with_figures("COVID-0-Pandemie", "COVII)-19-Pandemie") == "COVID-19-Pandemie"
    assert scan_repair.with_figures("Haus", "Hau5-1") == "Hau5-1"


def test_clean_words_near_a_header_word_are_no_misread_ones():
    odds = {"bundesblatt": 9.0}
    assert scan_repair.Furniture(odds, set()).of("bundesplatt") == 9.0
    assert scan_repair.Furniture(odds, set(), {"bundesplatt"}).of("bundesplatt") == -3.0


def test_chance_is_measured_on_all_rarest_words(spark):
    """4,000 clean words seen once lie near a frequent one, all of them before the 4,500 others by hash."""
    abc, base = "abcdefghijklmnopqrstuvwxyz", "behörden"
    near = [base[:i] + x + base[i + 1 : j] + y + base[j + 1 :] for i in range(8) for j in range(i + 1, 8) for x in abc for y in abc if x != base[i] and y != base[j]]
    draw = random.Random(1)
    far = ["".join(draw.choices(abc, k=7)) for _ in range(10_000)]
    hashed = lambda ws: spark.createDataFrame([(w,) for w in ws], "v string").distinct().withColumn("h", F.xxhash64("v"))
    low, high = hashed(near).where("h < 0").orderBy("h", "v").select("v").limit(4000), hashed(far).where("h >= 0").orderBy("h", "v").select("v").limit(4500)
    words = low.unionByName(high).withColumn("n", F.lit(1)).unionByName(spark.createDataFrame([("behörden", 5000)], "v string, n int"))
    assert words.count() == 8501
    # four in five unknown words lie near the frequent word, of the rarest words only 47 in a hundred
    misread = ["be" + x + "örden" for x in "0123456789ABCDEFGHIJ"]
    unknown = spark.createDataFrame([(w,) for w in misread + ["QQQQQQQQ%d" % i for i in range(5)]], "word string")
    got = scan_repair._trusted(unknown, words).where("cand = 'behörden'")
    assert {r["word"] for r in got.collect()} == set(misread)


def test_level_of_the_best_candidate_is_that_of_all_candidates():
    draw = random.Random(3)
    counts = {"".join(draw.choices("abc", k=draw.randint(1, 9))): draw.randint(1, 300) for _ in range(400)}
    plain, ranked = scan_repair.Trie(list(counts)), scan_repair.LevelTrie(counts)
    for w in [*list(counts)[:80], "x", "abxcab", "xyzxyzxyz"]:
        most = scan_repair.reach(w)
        assert ranked.top(w, most) == max((counts[c].bit_length() - 1 for c, _ in plain.within(w, most)), default=-1)
