"""The registered queries take the predicted spans as given; rivals come from the data alone."""

import pytest

import __spark_entry__ as entry

TEXT = "Veja-se o REsp 1.234/SP e o art. 5 da CF, com HC 111.222/SP. " * 4
#: Ids divisible by 3, 5, 7 and 11 among them; the last two overlap by half and more.
GIVEN = [(3, 10, 23), (7, 28, 40), (11, 46, 59), (13, 71, 84), (77, 89, 101), (1155, 107, 120), (15, 107, 119)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("given")
    spark.createDataFrame([(1, "d", 0, TEXT)], "doc_id bigint, documento_id string, parte int, text string").write.parquet(f"{d}/documents.parquet")
    rows = [(c, "r", "d", 0, a, b, "real", 0.5, ("1",)) for c, a, b in [*GIVEN, (9999, 10, 23)]]
    spark.createDataFrame(rows, "citacao_id bigint, run string, documento_id string, parte int, inicio int, fim int, classificacao string, confianca double, resolucao struct<id_canonico:string>").write.parquet(f"{d}/extract_citacoes.parquet")
    gold = [(1, "d", 0, 1, 107, 120, "real", "1"), (2, "d", 0, 1, 10, 23, "real", "1")]
    spark.createDataFrame(gold, "linha_id bigint, documento_id string, parte int, nivel int, inicio int, fim int, classificacao string, id_canonico string").write.parquet(f"{d}/goldenset.parquet")
    spark.createDataFrame([("r",)], "run string").write.parquet(f"{d}/execucoes.parquet")
    return str(d)


def test_spans_as_given(spark, folder):
    q = entry.queries()
    kept = sorted((a, b) for c, a, b in GIVEN if c != 1155)
    assert sorted((r.inicio, r.fim) for r in q["nms_window"](spark, folder).collect()) == kept
    assert sorted((r.inicio, r.fim) for r in q["valid_spans"](spark, folder).collect()) == kept
    # two rivals for the golden span at 107: the larger overlap wins
    assert sorted((r.gi, r.pi) for r in q["match_pairs"](spark, folder).collect()) == [(0, 0), (1, 6)]


def test_silver_marks_are_the_given_spans(spark, folder, tmp_path):
    for t in ("documents", "extract_citacoes"):
        df = spark.read.parquet(f"{folder}/{t}.parquet")
        (df if t == "documents" else df.where("citacao_id <> 15")).write.parquet(f"{tmp_path}/{t}.parquet")
    spark.createDataFrame([("other",)], "documento_id string").write.parquet(f"{tmp_path}/goldenset.parquet")
    marked = entry.queries()["silver_examples"](spark, str(tmp_path)).first().messages[2].content
    assert [p.split("<end>")[0] for p in marked.split("<start>")[1:]] == ["REsp 1.234/SP", "art. 5 da CF", "HC 111.222/SP"] * 2
