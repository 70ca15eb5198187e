"""The registered score queries take the whole golden set for every run."""

import pytest

import __spark_entry__ as entry
from citaria.operators import score
from citaria.plans import views as V

GOLD = "documento_id string, parte int, nivel int, gi int, inicio int, fim int, classe string, ids array<string>"
PRED = "run string, documento_id string, parte int, pi int, inicio int, fim int, classe string, id_canonico string, confianca double"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Two golden texts; run r1 answers one of them, r2 returned nothing at all."""
    d = tmp_path_factory.mktemp("runs")
    gold = [(1, "a", 0, 1, 0, 10, "real", "1"), (2, "b", 0, 1, 0, 10, "real", "2"), (3, "b", 0, 1, 20, 30, "inventada", None)]
    spark.createDataFrame(gold, "linha_id bigint, documento_id string, parte int, nivel int, inicio int, fim int, classificacao string, id_canonico string").write.parquet(f"{d}/goldenset.parquet")
    pred = [(1, "r1", "a", 0, 0, 10, "real", 0.0, ("1",))]
    spark.createDataFrame(pred, "citacao_id bigint, run string, documento_id string, parte int, inicio int, fim int, classificacao string, confianca double, resolucao struct<id_canonico:string>").write.parquet(f"{d}/extract_citacoes.parquet")
    spark.createDataFrame([("r1", "m"), ("r2", "m")], "run string, name string").selectExpr("run", "name", "'x' role", "'y' family", "'8b' parameters").write.parquet(f"{d}/execucoes.parquet")
    return str(d)


def test_golden_texts_without_predictions_are_misses(spark):
    g = spark.createDataFrame([("a", 0, 1, 0, 0, 10, "real", ["1"]), ("b", 0, 1, 0, 0, 10, "real", ["2"])], GOLD)
    p = spark.createDataFrame([("r1", "a", 0, 0, 0, 10, "real", "1", None)], PRED)
    ev = score.events(V.golden_by_run(g, p), p, V.RUN_KEYS).collect()
    assert sorted((r.documento_id, r.caso) for r in ev) == [("a", "par"), ("b", "perdida")]


@pytest.mark.parametrize("most", [10_000, 1])
def test_counts_of_all_runs(spark, folder, monkeypatch, most):
    monkeypatch.setattr(V, "MAX_RUNS", most)
    rows = {(r.run, r.classe): (r.tp, r.fp, r.fn, r.suporte) for r in entry.queries()["confusion_counts"](spark, folder).collect()}
    assert rows == {("r1", "real"): (1, 0, 1, 2), ("r1", "inventada"): (0, 0, 1, 1), ("r2", "real"): (0, 0, 2, 2), ("r2", "inventada"): (0, 0, 1, 1)}


def test_scores_of_all_runs(spark, folder):
    q = entry.queries()
    levels = {r.run: (r.f1_real, r.macro_f1) for r in q["score_levels"](spark, folder).collect()}
    assert levels == {"r1": (0.666667, 0.333333), "r2": (0.0, 0.0)}
    assert {r.run: r.score_final for r in q["score_final"](spark, folder).collect()} == {"r1": 0.333333, "r2": 0.0}
    assert {(r.run, r.inventadas) for r in q["severe_error_tau"](spark, folder).collect()} == {("r1", 1), ("r2", 1)}
    assert {(r.run, r.score_final) for r in q["results_by_model"](spark, folder).collect()} == {("r1", 0.333333), ("r2", 0.0)}
