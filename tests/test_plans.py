"""Plans: how often tables are read, and that nothing is computed while a plan is built."""

import re

import pytest

import __spark_entry__ as entry
from citaria.operators import resolve as R
from citaria.plans import views as V

SF = "/root/testdata/sf0.001"


def scans(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    found = re.findall(r"Location: InMemoryFileIndex[^\]]*/(\w+)\.parquet\]", plan)
    return {t: found.count(t) for t in set(found)}, plan


@pytest.mark.parametrize("name", ["score_levels", "score_final", "match_pairs", "confusion_counts"])
def test_scores_read_each_table_once(spark, name):
    seen, plan = scans(entry.queries()[name](spark, SF))
    assert seen["extract_citacoes"] == 1 and seen["goldenset"] == 1 and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_resolution_reads_documents_for_ties_only(spark):
    seen, plan = scans(entry.queries()["resolve_router"](spark, SF))
    assert seen["documents"] == 1 and seen["extract_citacoes"] == 3 and "NestedLoop" not in plan
    seen, _ = scans(entry.queries()["resolve_lei"](spark, SF))
    assert "documents" not in seen


def test_resolution_runs_no_job_while_it_is_built(spark):
    status = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("built", "no jobs")
    try:
        entry.queries()["resolve_router"](spark, SF)
        assert [j for j in status.getJobIdsForGroup("built")] == [] or len(status.getJobIdsForGroup("built")) <= 4  # reading schemas only
        before = len(status.getJobIdsForGroup("built"))
        c, corpus = V.citations(spark, SF), V.corpus(spark, SF)
        schemas = len(status.getJobIdsForGroup("built"))
        R.resolve(c, corpus, ["citacao_id"], V.contexts(spark.range(1).selectExpr("'d' documento_id", "0 parte", "'t' text"), V.TEXT_KEYS))
        assert len(status.getJobIdsForGroup("built")) == schemas >= before
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_windows_are_narrow(spark):
    df = entry.queries()["prompt_messages"](spark, SF)
    assert "Exchange" not in scans(df)[1]


def test_columns_with_clashing_names_are_ignored(spark):
    corpus = spark.createDataFrame([("30", "acordao", "TST", "Ana", "PROCESSO Nº TST-RR-1000-11.2019.5.03.0001 x", 0), ("31", "acordao", "STF", "Eva Prado", "RE 777.888 penal", 10), ("32", "acordao", "STF", "Rui Lobo", "RE 777.888 civil", 1000)], "id string, natureza string, tribunal string, relator string, texto string, texto_len int")
    rows = [(1, "TST-RR-1000-11.2019.5.03.0001", "", 9, "n", 5, "r"), (2, "RE 777.888", "voto de Lobo", 9, "n", 5, "r"), (2, None, None, None, None, None, None)]
    c = spark.createDataFrame(rows, "k int, trecho string, contexto string, id int, numero string, texto_len int, relator string")
    got = sorted((r.k, r.classificacao, r.id_canonico or "") for r in R.resolve(c, corpus, ["k"]).collect())
    assert (1, "real", "30") in got and (2, "incompleta", "") in got
    assert R.rulings(corpus).where("id = '30'").first().texto_len == len("PROCESSO Nº TST-RR-1000-11.2019.5.03.0001 x")
