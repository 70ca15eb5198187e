"""Augmentation, silver examples, filters, masks, extraction."""

import pytest
from pyspark.sql import functions as F

from citaria.functions import chat
from citaria.operators import augment, extract, train_data

TEXT = (
    "Autor: JOAQUIM PEREIRA NETO\n\nCumpre destacar que o art. 5 da CF vale. Processo 1234567-89.2020.8.26.0100, fls. 10/20, R$ 1.234,56.\n\n"
    "Em 3 de março de 2019, na cidade de São Paulo, decidiu-se o que segue nesta longa frase de mais de quarenta letras. Decido.\n\nUm parágrafo livre.\n\nOutro parágrafo livre."
)


@pytest.fixture(scope="module")
def docs(spark):
    at = TEXT.index("art. 5 da CF")
    return spark.createDataFrame([(1, TEXT, [(at, at + 12)]), (2, "", []), (3, "curto", [])], "k int, texto string, spans array<struct<inicio:int,fim:int>>")


def test_all_operations_keep_citations(spark, docs):
    rows = augment.variants(docs, ["k"]).collect()
    assert len(rows) == 30 and all(r.perdidas == 0 for r in rows)
    v = {r.operacao: r.variante for r in rows if r.k == 1}
    assert all("art. 5 da CF" in t for t in v.values())
    assert "Importa sublinhar" in v["sinonimos"] and "Passo a decidir." in v["sinonimos"]
    assert "JOAQUIM" not in v["troca_nomes"] and "1234567-89" not in v["troca_protocolo"] and "R$ 1.234,56" not in v["troca_protocolo"] and "fls. " in v["troca_protocolo"]
    assert "São Paulo" not in v["troca_data"] and "2019" not in v["troca_data"]
    assert "Nada mais havendo" in v["expande"] and v["ocr"] != TEXT
    assert sorted(v["reordena"].split("\n\n")) == sorted(TEXT.split("\n\n")) and v["reordena"].split("\n\n")[1] == TEXT.split("\n\n")[1]
    assert any(s in v["insere"] for s in augment.SENTENCES) and len(v["remove_frase"]) < len(TEXT)


def test_variants_do_not_depend_on_partitions(spark, docs):
    a = {(r.k, r.operacao): r.variante for r in augment.variants(docs, ["k"]).collect()}
    assert a == {(r.k, r.operacao): r.variante for r in augment.variants(docs.repartition(7), ["k"]).collect()}


def test_samples_and_requests(spark):
    ids = spark.range(50).withColumnRenamed("id", "k")
    assert augment.sampled(ids, "k", 5).collect() == augment.sampled(ids.repartition(3), "k", 5).collect()
    r = augment.requests(3, spark).collect()
    assert len(r) == 3 and r[0].pedido.startswith("Escreva um ")


def test_retry_until_accepted(spark):
    ids = spark.range(6).withColumnRenamed("id", "indice")
    done = augment.until_accepted(ids, lambda left, k: left.where(F.col("indice") % 3 < k).withColumn("rodada", F.lit(k)))
    assert done.count() == 6 and done.where("rodada = 3").count() == 2
    with pytest.raises(RuntimeError):
        augment.until_accepted(ids, lambda left, k: left.where("indice < 2"), rounds=2)


def test_silver(spark):
    w = spark.createDataFrame([("d", 0, 10, "a REsp 1 b"), ("d", 6, 16, "1 b REsp 2"), ("e", 0, 3, "abc")], "d string, inicio int, fim int, texto string")
    c = spark.createDataFrame([("d", 2, 8), ("d", 10, 16), ("d", 2, 8)], "d string, inicio int, fim int")
    rows = {(r.d, r.inicio): r for r in train_data.silver_examples(w, c, ["d"], "sys").collect()}
    assert {k: r.n_spans for k, r in rows.items()} == {("d", 0): 1, ("d", 6): 1, ("e", 0): 0}
    assert [m.role for m in rows["d", 0].messages] == ["system", "user", "assistant"]
    assert rows["d", 0].messages[2].content == "a <start>REsp 1<end> b"


@pytest.mark.parametrize("raw,ok", [("x" * 900 + "<start>a<end>" * 4, True), ("```text\n" + "x" * 900 + "<start>a<end>" * 4 + "\n```", True), ("x" * 900 + "<start>a<end>" * 3, False), ("x" * 700 + "<start>a<end>" * 4, False), ("x" * 900 + "<start>a<start>b<end><end>" * 4, False), ("x" * 900 + "<end>a<start>" * 4, False), ("x" * 900, False), (None, False), ("", False)])
def test_cleaning(spark, raw, ok):
    r = spark.createDataFrame([(raw,)], "r string").select(train_data.cleaned(F.col("r")).alias("c")).first().c
    assert (r is not None) == ok
    if ok:
        assert "<start>" not in r.plano and r.marcado.count("<start>") == 4 and not r.marcado.startswith("```")


def test_label_mask(spark):
    df = spark.createDataFrame([([1, 2, 3, 4], [0, 2, 4, 6], 4), ([1, 2], [0, 2], 9)], "i array<int>, s array<int>, at int")
    a, b = [r.m for r in df.select(train_data.masked(F.col("i"), F.col("s"), F.col("at"), 3).alias("m")).collect()]
    assert a.input_ids == [2, 3, 4] and a.labels == [-100, 3, 4] and a.attention_mask == [1, 1, 1] and b is None


def test_leakage_filter(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "d string, n int")
    assert sorted(r.n for r in train_data.without(df, spark.createDataFrame([("a",), (None,)], "d string"), "d").collect()) == [2, 3]


def test_extraction_strategies(spark):
    docs = spark.createDataFrame([("d", "Veja-se o REsp 1.234/SP e o art. 5 da CF.")], "d string, text string")
    got = extract.extract(docs, ["d"], "text", extract.rule_marked).first()
    assert [c.trecho for c in got.citacoes] == ["REsp 1.234/SP", "art. 5 da CF"]
    answers = spark.createDataFrame([("d", 0, "x <start>art. 5<end>")], "d string, janela int, raw string")
    assert [c.trecho for c in extract.extract(docs, ["d"], "text", lambda w: extract.replayed(w, answers, ["d"])).first().citacoes] == ["art. 5"]

    def load():
        return lambda texts: [t.replace("REsp", "<start>REsp<end>") for t in texts]

    assert [c.trecho for c in extract.extract(docs, ["d"], "text", lambda w: extract.model_marked(w, load, 2)).first().citacoes] == ["REsp"]
    with pytest.raises(ValueError):
        extract.model_marked(docs, load, 0)


def test_budgets():
    prompt = "x" * 3042
    assert chat.reserved_tokens(prompt) == 1809 and chat.answer_tokens(prompt) == 1372 and chat.text_budget(prompt) == 1830


def test_models_are_closed_and_lost_citations_stop_a_strict_run(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame([("d", "um REsp 1 aqui")], "d string, texto string")
    mark = str(tmp_path / "closed")

    class Model:
        def __call__(self, texts):
            return [t.upper() for t in texts]

        def close(self):
            open(mark, "w").close()

    assert extract.model_marked(docs, Model, 2).first().raw == "UM RESP 1 AQUI" and (tmp_path / "closed").exists()
    kind = "d string, texto string, spans array<struct<inicio:int,fim:int>>"
    good = spark.createDataFrame([("d", "Decido. REsp 1", [(8, 14)])], kind)
    assert augment.variants(good, ["d"], operations=("sinonimos",), strict=True).first().perdidas == 0
    monkeypatch.setitem(augment.CHANGES, "sinonimos", lambda parts, seed: F.filter(parts, lambda p: p["tipo"] == "livre"))
    assert augment.variants(good, ["d"], operations=("sinonimos",)).first().perdidas == 1
    with pytest.raises(Exception, match="citations lost"):
        augment.variants(good, ["d"], operations=("sinonimos",), strict=True).collect()


def test_sampling_and_temperatures():
    from citaria.functions import chat

    assert chat.sampling("x" * 3042) == {"temperature": 0.0, "seed": 42, "max_tokens": 1372}
    assert [augment.temperature(k) for k in (1, 2, 3, 4)] == [0.8, 0.9, 1.0, 1.1]
