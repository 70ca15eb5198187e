"""The metric: golden vectors and a brute-force comparison on random spans."""

import random

import pytest
from pyspark.sql import functions as F

from citaria.operators import codec, score

GOLD = "d string, nivel int, gi int, inicio int, fim int, classe string, ids array<string>"
PRED = "d string, pi int, inicio int, fim int, classe string, id_canonico string, confianca double"


def frames(spark, golds, preds):
    g = spark.createDataFrame([("a", 1, i, a, b, c, ids) for i, (a, b, c, ids) in enumerate(golds)], GOLD)
    p = spark.createDataFrame([("a", i, a, b, c, id_, conf) for i, (a, b, c, id_, conf) in enumerate(preds)], PRED)
    return g, p


def test_level_score(spark):
    g, p = frames(spark, [(0, 10, "real", ["1"]), (20, 30, "inventada", [])], [(0, 10, "real", "1", 0.9), (20, 30, "real", "2", 0.8)])
    r = score.score_levels(score.events(g, p, ["d"]), []).first()
    assert r.f1_real == pytest.approx(2 / 3) and r.f1_inventada == 0 and r.f1_incompleta is None
    assert r.macro_f1 == pytest.approx(1 / 3) and r.tau == 1 and r.s == pytest.approx(1 / 6)
    assert r.b == pytest.approx(0.0675) and round(r.score, 6) == 0.177917


def test_tie_goes_to_the_first_golden_span(spark):
    g, p = frames(spark, [(0, 10, "real", ["1"]), (10, 20, "real", ["2"])], [(0, 20, "real", "1", None)])
    assert [(r.gi, r.pi) for r in score.match(g, p, ["d"]).collect()] == [(0, 0)]


def test_extra_only_inside_a_match(spark):
    g, p = frames(spark, [(0, 20, "real", ["1"])], [(0, 20, "real", "1", None), (2, 6, "real", "1", None)])
    assert sorted(r.caso for r in score.events(g, p, ["d"]).collect()) == ["extra", "par"]
    g, p = frames(spark, [(0, 20, "real", ["1"])], [(2, 6, "real", "1", None)])
    assert sorted(r.caso for r in score.events(g, p, ["d"]).collect()) == ["espuria", "perdida"]
    g, p = frames(spark, [(0, 20, "real", ["1"])], [(0, 10, "real", "1", None), (10, 20, "real", "1", None)])
    assert sorted(r.caso for r in score.events(g, p, ["d"]).collect()) == ["extra", "par"]


def test_wrong_link_costs_precision_only(spark):
    g, p = frames(spark, [(0, 10, "real", ["1"])], [(0, 10, "real", "2", None)])
    r = score.confusion(score.events(g, p, ["d"]), []).first()
    assert (r.tp, r.fp, r.fn, r.suporte) == (0, 1, 0, 1)


def test_level_weights(spark):
    df = spark.createDataFrame([(1, 0.729683536276002), (2, 0.5375877088778015)], "nivel int, score double")
    assert score.score_final(df, []).first()[0] == pytest.approx(0.6016196513438684, abs=1e-12)


def brute_pairs(golds, preds):
    c = []
    for gi, g in enumerate(golds):
        for pi, p in enumerate(preds):
            i = max(0, min(g[1], p[1]) - max(g[0], p[0]))
            if i and 2 * i >= (g[1] - g[0]) + (p[1] - p[0]) - i:
                c.append((-i / ((g[1] - g[0]) + (p[1] - p[0]) - i), gi, pi))
    out, a, b = [], set(), set()
    for _, gi, pi in sorted(c):
        if gi not in a and pi not in b:
            a.add(gi), b.add(pi), out.append((gi, pi))
    return sorted(out)


def test_matching_against_brute_force(spark):
    rng = random.Random(1)
    g_rows, p_rows, want = [], [], {}
    for d in range(60):
        at, golds = 0, []
        for _ in range(rng.randint(0, 6)):
            at += rng.randint(0, 5)
            golds.append((at, at + rng.randint(1, 8)))
            at = golds[-1][1]
        preds = [(a, a + rng.randint(1, 12)) for a in (rng.randint(0, 40) for _ in range(rng.randint(0, 8)))]
        g_rows += [(str(d), 1, i, a, b, "real", ["1"]) for i, (a, b) in enumerate(golds)]
        p_rows += [(str(d), i, a, b, "real", "1", None) for i, (a, b) in enumerate(preds)]
        want[str(d)] = brute_pairs(golds, preds)
    got = score.match(spark.createDataFrame(g_rows, GOLD), spark.createDataFrame(p_rows, PRED), ["d"]).collect()
    for d, pairs in want.items():
        assert sorted((r.gi, r.pi) for r in got if r.d == d) == pairs


def test_counts_add_up(spark):
    g, p = frames(spark, [(0, 10, "real", ["1"]), (20, 30, "incompleta", [])], [(0, 10, "incompleta", None, None), (50, 60, "real", "3", 0.5)])
    ev = score.events(g, p, ["d"])
    total = score.confusion(ev, []).agg(F.sum("suporte"), F.sum(F.col("tp") + F.col("fn"))).first()
    assert total[0] == 2 and total[1] == 2


def test_empty_sides(spark):
    g, p = frames(spark, [(0, 10, "real", ["1"])], [])
    assert [r.caso for r in score.events(g, p, ["d"]).collect()] == ["perdida"]
    g, p = frames(spark, [], [(0, 10, "real", "1", None)])
    assert score.events(g, p, ["d"]).count() == 0
    assert score.score_levels(score.events(g, p, ["d"]), []).count() == 0


def test_encode(spark):
    kind = "array<struct<inicio:int,fim:int,classificacao:string,confianca:double,id_canonico:string>>"
    df = spark.createDataFrame([(0, [(1, 5, "real", 0.9, "9")]), (1, []), (2, None), (3, [(1, 2, "incompleta", None, " ")])], f"i int, c {kind}")
    assert [r[0] for r in df.orderBy("i").select(codec.encode_cell(F.col("c"))).collect()] == ["1,5,real,9,0.9000", "-", "-", "1,2,incompleta,-,-"]


@pytest.mark.parametrize(
    "cell,error",
    [("1,2,real,5", "campos"), ("x,2,real,5,-", "inicio"), ("1,,real,5,-", "fim"), ("5,5,real,5,-", "span"), ("1,2,falsa,-,-", "classe"), ("1,2,real,-,-", "id_ausente"), ("1,2,real,12a,-", "id_digitos"), ("1,2,real,5,1.5", "confianca_faixa"), ("1,2,real,5,x", "confianca"), ("0,10,real,5,-|1,10,real,5,-", "duplicata"), ("1,2,REAL,005,0.5| |3,4,inventada,-,", None), ("-", None), ("", None), (None, None)],
)
def test_submission_errors(spark, cell, error):
    df = spark.createDataFrame([(1, cell)], "k int, c string")
    r = codec.decode_submission(df, ["k"], "c").first()
    assert r.erro == error
    if error is None and cell and len(cell) > 1:
        assert [c.id_canonico for c in r.citacoes] == ["5", None]


def test_strict_decoding_raises(spark):
    with pytest.raises(Exception, match="invalid submission cell"):
        codec.decode_submission(spark.createDataFrame([(1, "a,b")], "k int, c string"), ["k"], "c", strict=True).collect()


def test_golden_cells(spark):
    df = spark.createDataFrame([(1, "0,5,real,7:008|9,12,inventada,-"), (2, "0,5,real,-"), (3, "0,5,inventada,-|3,9,inventada,-")], "k int, c string")
    rows = {r.k: r for r in codec.decode_golden(df, ["k"], "c").collect()}
    assert rows[1].erro is None and rows[1].citacoes[0].ids == ["7", "8"]
    assert rows[2].erro == "real_sem_ids" and rows[3].erro == "sobreposicao"


def test_missing_and_first_rows(spark):
    sol = spark.createDataFrame([("a",), ("b",)], "d string")
    sub = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y")], "d string, n int, citacoes string")
    first = score.first_rows(sub, ["d"], "n")
    assert sorted((r.d, r.citacoes) for r in score.filled(sol, first, ["d"]).collect()) == [("a", "x"), ("b", "-")]
    with pytest.raises(ValueError):
        score.required_columns(sub, {"d", "nivel"}, "submission")
