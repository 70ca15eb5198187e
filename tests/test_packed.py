"""Problem 4: the parser of packed cells."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from citaria.operators.packed import packed_found, packed_values, unpack


def good(cell, fields=1):
    return [v for k, v, _ in unpack(cell, fields) if k]


@pytest.mark.parametrize(
    "cell,want",
    [
        ("1;2", "1 2"), ("1 - 2", "1 2"), ("1+2", "1 2"), ("1 / 2", "1 2"), ("1 e 2", "1 2"), ("1::2", "1 2"), ("1\t2", "1 2"), ("1 2", "1 2"), ("[1; 2]", "1 2"), ("['1', '2']", "1 2"), ('"1"|"2"', "1 2"),
        ('"1" e "2"', "1 2"), ("1:-", "1"), ("1;", "1"), ("-", ""), ("", ""), (None, ""), ("  ", ""), ("1;;-;2", "1 2"), ("1;1;1", "1 1 1"), ('"1;2', "1 2"), ("[1;2", "1 2"), ('1"2', ""), ("'1','2", "1 2"), ("1-2", "1 2"), ("(1)(2)", "1 2"),
    ],
)
def test_ids(cell, want):
    assert good(cell) == want.split()


@pytest.mark.parametrize(
    "cell,want",
    [
        ("1,2,real,5,0.3|3,4,real,6,-", ["1,2,real,5", "3,4,real,6"]),
        ('"1,2,real,5,0.3","3,4,real,6,-"', ["1,2,real,5", "3,4,real,6"]),
        ("'1, 2, real, 5, 0.3'\n'3,4,real,6,-'", ["1,2,real,5", "3,4,real,6"]),
        ('1,2,real,"5|6","0,4"; 3,4,inventada,-,-', ["1,2,real,5|6", "3,4,inventada,-"]),
        ('"1, 2, real, ""5;6"", 0.3"|3,4,real,6,-', ["1,2,real,5;6", "3,4,real,6"]),
        ('1,2,incompleta,"-",0.6||-||3,4,real,6,-\r\n', ["1,2,incompleta,-", "3,4,real,6"]),
        ("1,2,real,5,-,3,4,real,6,-", ["1,2,real,5", "3,4,real,6"]),
        ("1,2,real,5", []),
        ('"1,2,real,5,0.3|3,4,real,6,-', ["1,2,real,5", "3,4,real,6"]),
        ("-", []), (None, []), (" ", []),
    ],
)
def test_records(cell, want):
    assert good(cell, 5) == want


def test_error_flags():
    assert unpack("1;x2") == [(1, "1", None), (0, "x2", "valor")]
    assert unpack('"1;2')[0] == (1, "1", "aspas")
    assert unpack("1,2,real,5", 5) == [(0, "1,2,real,5", "campos")]


IDS = st.lists(st.integers(0, 10**11).map(str), min_size=1, max_size=8)


@settings(max_examples=200, deadline=None)
@given(IDS, st.sampled_from([";", ",", " | ", " e ", "\n", "::", " / ", "+"]), st.sampled_from(["", '"', "'"]), st.booleans())
def test_round_trip(ids, sep, quote, bracket):
    cell = sep.join(quote + i + quote for i in ids)
    assert good(f"[{cell}]" if bracket else cell) == ids


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("1,;|\"'[] e-\n"), max_size=60))
def test_never_fails(cell):
    for fields in (1, 5):
        positions = [k for k, _, _ in unpack(cell, fields) if k]
        assert positions == list(range(1, len(positions) + 1))


def test_backtracking_is_linear():
    import time

    began = time.time()
    unpack("\"1' " * 50_000)
    unpack("'1,2" * 50_000, 5)
    assert time.time() - began < 20


def test_tables(spark):
    sub = spark.createDataFrame([(1, "1,2,real,5,-|3,4,real,6,-", "x"), (2, None, None), (3, "1,2,real,5,-", "x")], "linha_id bigint, citacoes string, valor string")
    gold = spark.createDataFrame([(1, "7;8;8"), (2, "-"), (3, None)], "linha_id bigint, id_canonico string")
    got = sorted(tuple(r) for r in packed_found(sub, gold).collect())
    assert got == [("goldenset", 1, 1, "7"), ("goldenset", 1, 2, "8"), ("goldenset", 1, 3, "8"), ("submission", 1, 1, "1,2,real,5"), ("submission", 1, 2, "3,4,real,6")]
    assert packed_values(sub, gold).count() == 6
    assert packed_found(sub.limit(0), gold.limit(0)).count() == 0


def test_brackets_do_not_recurse():
    assert unpack("[" * 3000) == [] and unpack("[" * 3000 + "7") == [(1, "7", "colchete")]
    assert [v for _, v, _ in unpack("[" * 2000 + "1]" * 2000)] == ["1"] * 2000
    assert unpack("[[1],[2]]") == [(1, "1", None), (2, "2", None)] and unpack("(1;2") == [(1, "1", None), (2, "2", "colchete")]


def test_malformed_quotes_and_brackets_in_records():
    assert unpack('1,5,real,"12,0.9|6,9,real,13,0.8', 5) == [(1, "1,5,real,12", "aspas"), (2, "6,9,real,13", None)]
    assert unpack("1,5,real,[12;13],0.9|6,9,real,(14),0.8", 5) == [(1, "1,5,real,12;13", None), (2, "6,9,real,14", None)]
    assert unpack("1,5,real,[12,0.9|6,9,real,14,0.8", 5) == [(1, "1,5,real,[12", None), (2, "6,9,real,14", None)]
    assert unpack("[1,5,real,12,0.9|6,9,real,14,0.8]", 5) == [(1, "1,5,real,12", None), (2, "6,9,real,14", None)]
