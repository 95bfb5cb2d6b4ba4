import re

import pyarrow as pa
from conftest import rows
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyloom.operators.unpack import split_strings, unpack_batch, unpack_field, unpack_fields


def values(strings):
    owner, v = unpack_batch(pa.array(strings, pa.string()))
    return list(zip(owner.tolist(), v.to_pylist()))


def test_delimiters_quotes_labels():
    got = values(["660-5; 9958-60,1-2/3-4|5-6 und 7-8 sowie 9-1", '„409-11 Ordnung / Anlage“, 31-29', '"32-3 Gesetz ""Neue Wege"", Anlage 3"', "FNA: 1-2", "['764-60-29', '38-30a']", '"219-59 / 2786-10 und 3-4"'])
    assert [v for o, v in got if o == 0] == ["660-5", "9958-60", "1-2", "3-4", "5-6", "7-8", "9-1"]
    assert [v for o, v in got if o == 1] == ["409-11 Ordnung / Anlage", "31-29"]
    assert [v for o, v in got if o == 2] == ['32-3 Gesetz "Neue Wege", Anlage 3']
    assert [v for o, v in got if o == 3] == ["1-2"]
    assert [v for o, v in got if o == 4] == ["764-60-29", "38-30a"]
    assert [v for o, v in got if o == 5] == ["219-59", "2786-10", "3-4"]


def test_no_values():
    assert values([None, "", "  ", "keine", "-", "[]", "12", "''"]) == []
    assert values([]) == []


def test_stray_quote_and_apostrophe():
    assert values(["„1-2; 3-4", "5-6; \"7-8 d'Or; x\""]) == [(0, "1-2"), (0, "3-4"), (1, "5-6"), (1, "7-8 d'Or; x")]


def test_very_long():
    s = "; ".join(f"{i}-1" for i in range(1, 5000))
    assert len(values([s])) == 4999


@given(st.lists(st.lists(st.tuples(st.integers(1, 9999), st.integers(0, 99)), max_size=6), max_size=8), st.sampled_from([", ", ";", " | ", "\n", " und ", "，", " "]))
@settings(max_examples=40, deadline=None)
def test_round_trip(lists, sep):
    texts = [sep.join(f"{a}-{b}" for a, b in x) for x in lists]
    got = values(texts)
    assert got == [(i, f"{a}-{b}") for i, x in enumerate(lists) for a, b in x]


@given(st.text(max_size=60))
@settings(max_examples=80, deadline=None)
def test_pieces_come_from_the_text(s):
    s = s.encode("utf-8", "ignore").decode()
    _, pieces, _ = split_strings(pa.array([s]))
    at = 0
    for p in pieces.to_pylist():
        at = s.index(p, at) + len(p)


def test_frame_edges(spark):
    schema = "page_row bigint, raw string, codes array<string>, value string, pos string"
    data = [(1, "1-2, 1-2", ["3-4", None, "5-6;7-8"], "x", "y"), (2, None, None, None, None), (3, "", [], "x", "y"), (None, "9-9", ["1-1"], "x", "y"), (1, "1-2, 1-2", [""], "x", "y")]
    df = spark.createDataFrame(data, schema)
    got = rows(unpack_fields(df, "page_row", ["raw", "codes"]))
    assert (1, "codes", 2, "5-6") in got and (1, "codes", 3, "7-8") in got
    assert sum(r[:2] == (1, "raw") for r in got) == 4  # the repeated row is handled by itself
    assert (None, "raw", 1, "9-9") in got
    assert unpack_field(df.limit(0), "page_row", "raw").count() == 0
    assert all(re.match(r"\d+-\d+$", r[3]) for r in got)
