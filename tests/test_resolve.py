"""Resolution: golden vectors, ties, routing, no corpus."""

import pytest

from citaria.operators import resolve as R

CORPUS = "id string, natureza string, tribunal string, relator string, texto string, texto_len int"


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [
        ("10", "sumula", "STJ", None, "Súmula 7", None),
        ("11", "sumula", "STF", None, "Súmula Vinculante nº 10", None),
        ("12", "sumula", "TST", None, "Súmula 99", None), ("13", "sumula", "STF", None, "Súmula 99", None),
        ("20", "dispositivo", None, None, "Art. 186. Aquele que comete ato ilícito", None),
        ("21", "dispositivo", None, None, "sem número", None),
        ("30", "acordao", "STF", "Min. Ana Prado", "RE 123.456 primeira turma agravo", 100),
        ("31", "acordao", "STF", "Min. Rui Lobo", "RE 777.888 tributario imposto", 100),
        ("32", "acordao", "STF", "Min. Eva Mello", "RE 777.888 penal", 10),
        ("33", "acordao", "STF", "Min. Eva Mello", "RE 999.888 x", 100), ("34", "acordao", "STF", "Min. Ivo Serra", "RE 999.888 y", 99),
        ("35", "acordao", "STF", "Min. Eva Mello", "RE 555.444 z", 100), ("36", "acordao", "STF", "Min. Ivo Serra", "RE 555.444 w", 9),
    ]
    return spark.createDataFrame(rows, CORPUS)


def resolved(spark, corpus, rows):
    df = spark.createDataFrame([(i, t, c, "real") for i, (t, c) in enumerate(rows)], "k int, trecho string, contexto string, classificacao string")
    return [(r.classificacao, r.id_canonico) for r in R.resolve(df, corpus, ["k"]).orderBy("k").collect()]


def test_golden(spark, corpus):
    texts = ["Súmula 7 do STJ", "5úmula nº 007/STJ", "Súmula 7 do STF", "Súmula Vinculante nº 7", "súmula do STJ", "art. 186 do Código Civil", "artigo 999 do Código Civil", "art. 12 da Lei nº 1.234/2000", "Lei n. 13.105/2015", "art. 5º", "Súmula 99", None, ""]
    want = [("real", "10"), ("real", "10"), ("inventada", None), ("inventada", None), ("incompleta", None), ("real", "20"), ("inventada", None), ("inventada", None), ("incompleta", None), ("incompleta", None), ("incompleta", None), ("incompleta", None), ("incompleta", None)]
    assert resolved(spark, corpus, [(t, "") for t in texts]) == want


def test_ties_of_rulings(spark, corpus):
    rows = [("RE 123.456", ""), ("RE 111.222", ""), ("RE 777.888", "debate tributario sobre imposto"), ("RE 777.888", "nada"), ("RE 777.888", "voto de Lobo e outros, rel. LOBO"), ("RE 999.888", ""), ("RE 555.444", "conforme Mello"), ("RE 555.444", "Mello e Serra")]
    want = [("real", "30"), ("inventada", None), ("real", "31"), ("incompleta", None), ("real", "31"), ("real", "33"), ("real", "35"), ("incompleta", None)]
    assert resolved(spark, corpus, rows) == want


def test_law_wins_over_sumula(spark, corpus):
    assert resolved(spark, corpus, [("Súmula 7 do STJ e art. 186 do Código Civil", "")]) == [("real", "20")]


def test_without_corpus(spark):
    df = spark.createDataFrame([(1, "x", "", "real"), (2, "lei", "", "inventada"), (3, None, None, None)], "k int, trecho string, contexto string, classificacao string")
    got = [(r.k, r.tipo, r.classificacao, r.id_canonico) for r in R.resolve(df, None, ["k"]).orderBy("k").collect()]
    assert got == [(1, "jurisprudencia", "incompleta", None), (2, "lei", "inventada", None), (3, "jurisprudencia", None, None)]


def test_empty_tables(spark, corpus):
    empty = spark.createDataFrame([], "k int, trecho string, contexto string, classificacao string")
    assert R.resolve(empty, corpus, ["k"]).count() == 0
    one = spark.createDataFrame([(1, "Súmula 7 do STJ", "", None)], empty.schema)
    assert R.resolve(one, corpus.limit(0), ["k"]).first().classificacao == "inventada"


def test_strategies():
    assert R.strategy(" Regex ") is R.resolve
    with pytest.raises(ValueError):
        R.strategy("magic")
