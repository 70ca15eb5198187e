"""Windows: golden vectors, and invariants on random texts against a plain loop."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from citaria.operators import windows as W


def spans(spark, texts, budget, overlap):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [None if r[0] is None else [tuple(x) for x in r[0]] for r in df.orderBy("i").select(W.window_spans(F.col("t"), budget, overlap)).collect()]


def test_golden(spark):
    texts = ["", "x" * 12, "abcdefghij" * 3, "aaaa bbbb cccc dddd eeee ffff", "aaaa bb\nccc dddd eeee", None]
    assert spans(spark, texts, 12, 4) == [
        [(0, 0)], [(0, 12)], [(0, 12), (8, 20), (16, 28), (24, 30)], [(0, 9), (5, 14), (10, 19), (15, 24), (20, 29)], [(0, 7), (3, 11), (7, 16), (12, 21)], None,
    ]


def test_budget_must_exceed_overlap():
    with pytest.raises(ValueError):
        W.window_spans(F.lit("x"), 10, 10)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab \n😀"), max_size=60), min_size=1, max_size=20), st.integers(2, 20), st.integers(0, 10))
def test_cover_and_overlap(spark, texts, budget, overlap):
    if budget <= overlap:
        return
    for t, got in zip(texts, spans(spark, texts, budget, overlap)):
        assert got[0][0] == 0 and got[-1][1] == len(t)
        for (a, b), (c, d) in zip(got, got[1:]):
            assert b - a <= budget and c == max(b - overlap, a + 1) and d > b
            if b < len(t) and b - a < budget:  # a cut before the budget is at a separator
                assert t[b] in " \n"


def test_edges(spark):
    df = spark.createDataFrame([(5, 9, 0, 20, 40), (16, 19, 0, 20, 40), (21, 25, 20, 40, 40), (30, 39, 20, 40, 40)], "a int, b int, w0 int, w1 int, n int")
    c = [F.col(x) for x in ("a", "b", "w0", "w1", "n")]
    assert [r[0] for r in df.select(W.at_edge(*c, overlap=4)).collect()] == [False, True, True, False]


def test_rows_keep_keys_and_skip_null(spark):
    df = spark.createDataFrame([(1, "aaaa bbbb"), (2, None), (3, "")], "id int, text string")
    rows = {(r.id, r.janela): r.texto for r in W.windows(df, ["id"], "text", 6, 2).collect()}
    assert rows[(3, 0)] == "" and (1, 0) in rows and not any(k[0] == 2 for k in rows)
