"""Readers and writers in temporary folders, and the folder stream."""

import json
import sqlite3
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from citaria.plans.file_queries import QUERIES
from citaria.sources import files
from citaria.streaming.texts import late_counts, window_stream

CONTRACT = files.CONTRACT
DATA = Path("/root/testdata/sf0.001")


def test_texts(spark, tmp_path):
    (tmp_path / "a_1.txt").write_text("ação\nlinha", encoding="utf-8")
    (tmp_path / "b.c.txt").write_text("", encoding="utf-8")
    (tmp_path / "x.md").write_text("no")
    got = {r.documento_id: r.texto for r in files.read_texts(spark, str(tmp_path)).collect()}
    assert got == {"a_1": "ação\nlinha", "b.c": ""}
    assert files.write_texts(files.read_texts(spark, str(tmp_path)), str(tmp_path / "again")) == 2
    assert {r.documento_id: r.texto for r in files.read_texts(spark, str(tmp_path / "again")).collect()} == got


def test_golden_csv_with_mark(spark, tmp_path):
    p = tmp_path / "g.csv"
    p.write_text('documento_id,nivel,id_canonico\nd1,1,"1\n2"\nd1,1,3\n', encoding="utf-8-sig")
    df = files.read_golden_csv(spark, str(p))
    assert df.columns[0] == "documento_id" and df.count() == 2
    assert [r[0] for r in files.golden_ids(spark, str(p)).collect()] == ["d1"]
    assert files.golden_ids(spark, str(tmp_path / "none.csv")).count() == 0
    files.write_held_out(df, spark.createDataFrame([("d1",)], "documento_id string"), str(tmp_path / "held"))
    assert files.read_golden_csv(spark, str(tmp_path / "held")).count() == 0


def test_contracts_round_trip(spark, tmp_path):
    rows = [("d1", [(0, 5, "art. 1", "lei", "real", 0.5, ("7",)), (6, 9, "x", "jurisprudencia", "incompleta", None, None)]), ("d2", [])]
    df = spark.createDataFrame(rows, CONTRACT)
    old = files.write_contracts(df.limit(1), str(tmp_path), "20250101T000000", "m_a")
    new = files.write_contracts(df, str(tmp_path), "20260101T000000", "m_b")
    with open(f"{new}/meta.json", "w") as f:
        json.dump({"name": "m/b"}, f)
    got = files.read_contracts(spark, [old, new])
    assert got.count() == 3 and {r.slug for r in files.latest(got).collect()} == {"m_b"}
    cells = {r.documento_id: r.citacoes for r in files.submission(files.latest(got)).collect()}
    assert cells == {"d1": "0,5,real,7,0.5000|6,9,incompleta,-,-", "d2": "-"}
    files.write_submission(files.latest(got), str(tmp_path / "sub"))
    assert spark.read.option("header", True).csv(str(tmp_path / "sub")).columns == ["documento_id", "citacoes"]


def test_contract_without_id_has_its_stem(spark, tmp_path):
    run = tmp_path / "20260101T000000_m"
    run.mkdir()
    (run / "doc_9.json").write_text(json.dumps({"citacoes": []}, indent=2))
    (run / "resumo.json").write_text("{}")
    assert [tuple(r)[:3] for r in files.read_contracts(spark, str(run)).collect()] == [("20260101T000000", "m", "doc_9")]


def test_metadata_falls_back(spark):
    runs = spark.createDataFrame([("a_b",), ("c_d",), ("zz",)], "slug string")
    meta = spark.createDataFrame([("a_b", "a/b", "student", "f", "1B")], "slug string, name string, role string, family string, parameters string")
    cat = spark.createDataFrame([("c/d", "teacher", "g", "2B")], "name string, role string, family string, parameters string")
    got = {r.slug: (r.name, r.role) for r in files.with_metadata(runs, meta, cat).collect()}
    assert got == {"a_b": ("a/b", "student"), "c_d": ("c/d", "teacher"), "zz": ("zz", None)}


def test_jsonl_and_manifest(spark, tmp_path):
    p = str(tmp_path / "m")
    df = spark.createDataFrame([("x_aug01.txt", "data/x.txt", "ocr"), ("y.txt", None, "o")], files.MANIFEST)
    files.write_jsonl(df, p)
    files.write_jsonl(df, p, append=True)
    back = files.read_jsonl(spark, p, files.MANIFEST)
    assert back.count() == 4 and [r[0] for r in files.manifest_origins(back).collect()] == ["x"]
    empty = tmp_path / "e"
    empty.mkdir()
    (empty / "e.json").write_text("\n\n")
    with pytest.raises(ValueError):
        files.read_jsonl(spark, str(empty))


def test_evaluation(spark, tmp_path):
    levels = spark.createDataFrame([("m", 2, 0.5, 0.5, None, 0.5, 0.0, 0.5, 0.0, 0.5), ("m", 1, 0.5, 0.5, 0.5, 0.5, 0.0, 0.5, 0.0, 0.5)], "run string, nivel int, macro_f1 double, f1_real double, f1_inventada double, f1_incompleta double, tau double, s double, b double, score double")
    assert [r.nivel for r in files.evaluation_report(levels, ["run"]).collect()] == [1, 2]
    files.write_evaluation(levels, spark.createDataFrame([("m", 0.5)], "run string, score_final double"), "run", str(tmp_path / "ev"))
    row = json.loads(spark.read.text(str(tmp_path / "ev")).first()[0])
    assert row["avaliacao"]["niveis"]["2"]["score"] == 0.5 and "inventada" not in row["avaliacao"]["niveis"]["2"]["f1_por_classe"]


def test_sqlite(spark, tmp_path):
    path = str(tmp_path / "c.db")
    con = sqlite3.connect(path)
    con.execute("CREATE TABLE documentos (id, natureza, tribunal, relator, texto, texto_len)")
    con.executemany("INSERT INTO documentos VALUES (?,?,?,?,?,?)", [(i, "sumula" if i % 2 else "acordao", "STJ", None, f"Súmula {i}", 9) for i in range(20)])
    con.execute("INSERT INTO documentos VALUES (99, 'sumula', NULL, NULL, CAST(x'53FF' AS TEXT), NULL)")
    con.commit()
    spark.dataSource.register(files.SqliteCorpus)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    all_ = spark.read.format("sqlite_corpus").option("path", path).option("columns", "id,natureza,tribunal").load()
    assert all_.columns == ["id", "natureza", "tribunal"] and all_.count() == 21
    assert all_.where("natureza = 'sumula' and tribunal is not null and id > '1'").count() == 9
    assert all_.where("natureza in ('acordao', 'x') and tribunal = 'STJ'").count() == 10 and all_.where("tribunal is null").count() == 1
    reader = files.SqliteCorpus({"path": path}).reader(None)
    left = list(reader.pushFilters([files.EqualTo(("natureza",), "sumula"), files.EqualTo(("id",), "3"), files.IsNotNull(("tribunal",))]))
    assert left == [files.EqualTo(("id",), "3")] and reader.where == [("natureza = ?", ("sumula",)), ("tribunal IS NOT NULL", ())]
    df = spark.read.format("sqlite_corpus").option("path", path).option("natureza", "sumula").option("parts", "3").load()
    rows = {r.id: r.texto for r in df.collect()}
    assert len(rows) == 11 and rows["99"] == "S�" and rows["1"] == "Súmula 1"


@pytest.mark.parametrize("pushdown", ["false", "true"])
def test_sqlite_in_any_session(spark, tmp_path, pushdown):
    path = str(tmp_path / "c.db")
    con = sqlite3.connect(path)
    con.execute("CREATE TABLE documentos (id, natureza, tribunal, relator, texto, texto_len)")
    con.executemany("INSERT INTO documentos VALUES (?,?,?,?,?,?)", [(i, "acordao" if i % 2 else "sumula", None if i == 3 else "STJ", None, f"t{i}", 2) for i in range(8)])
    con.commit()
    before = spark.conf.get("spark.sql.python.filterPushdown.enabled")
    spark.conf.set("spark.sql.python.filterPushdown.enabled", pushdown)
    try:
        got = files.read_corpus(spark, path, "id,tribunal", natureza="acordao").where("tribunal is not null")
        assert sorted(r.id for r in got.collect()) == ["1", "5", "7"]
        assert files.read_corpus(spark, path).where("natureza = 'sumula' and tribunal = 'STJ'").count() == 4
        if DATA.is_dir():
            assert QUERIES["sqlite_corpus"](spark, str(DATA)).count() > 0
    finally:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", before)


def test_stream_of_texts(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "d.txt").write_text("aaaa bbbb cccc dddd")
    q = window_stream(spark, str(src), 10, 3).writeStream.format("memory").queryName("w").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("w").count() >= 2


def test_stream_counts(spark, tmp_path):
    src = str(tmp_path / "c")
    df = spark.sql("SELECT timestamp_ntz'2026-01-01 10:00:00' AS gravado_em, 'lei' AS tipo").withColumn("gravado_em", F.col("gravado_em").cast("timestamp"))
    df.write.parquet(src)
    s = spark.readStream.schema(df.schema).parquet(src)
    q = late_counts(s).writeStream.format("memory").outputMode("complete").queryName("c").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [(r.tipo, r.n) for r in spark.table("c").collect()] == [("lei", 1)]


def test_stamp():
    from datetime import datetime

    assert files.run_stamp(datetime(2026, 1, 2, 3, 4, 5)) == "20260102T030405"
