"""Queries of the file sources and sinks, with their SQL: tables are written out and read back.

The files go to a new folder in the one that all executors share.
"""

from __future__ import annotations

import sqlite3

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citaria.operators import score
from citaria.plans import score_queries as S
from citaria.plans import views as V
from citaria.session import shared_folder, ship_package, table
from citaria.sources import files


def text_folder(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as .txt files, read again; null and empty texts are empty files."""
    ship_package(spark)
    folder = shared_folder(spark, "texts")
    files.write_texts(table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("documento_id"), F.col("text").alias("texto")), folder)
    read = files.read_texts(spark, folder)
    return read.select("documento_id", F.length("texto").alias("n"), F.md5("texto").alias("md5")).orderBy("documento_id")


def _document(*keys: str):
    return F.concat_ws("_", *(F.col(k).cast("string") for k in keys)).alias("documento_id")


def _contracts(spark: SparkSession, sf: str) -> DataFrame:
    """(run, documento_id, citacoes) of each section in each run, as contracts hold them."""
    e = table(spark, sf, "extract_citacoes").where("run is not null and documento_id is not null and parte is not null")
    fields = ["inicio", "fim", "trecho", "tipo", "classificacao", "confianca", "resolucao"]
    kept = score.gathered(e.select(*V.RUN_KEYS, "citacao_id", *fields), V.RUN_KEYS, ["inicio", "fim", "citacao_id"], fields, "citacoes")
    return kept.select("run", _document("documento_id", "parte"), "citacoes")


def _stamped(df: DataFrame) -> DataFrame:
    return df.withColumns({"run_ts": F.substring_index("run", "_", 1), "slug": F.regexp_replace("run", "^[^_]*_", "")})


def contract_files(spark: SparkSession, sf: str) -> DataFrame:
    """Contracts as a JSON file a section in the folders of their runs, with the runs' metadata beside them; a row a citation."""
    ship_package(spark)
    folder = shared_folder(spark, "contracts")
    files.write_runs(_stamped(_contracts(spark, sf)), folder)
    files.write_metadata(table(spark, sf, "execucoes"), folder)
    read = files.read_contracts(spark, f"{folder}/*")
    rows = read.select("run_ts", "slug", "documento_id", F.posexplode("citacoes").alias("posicao", "c"))
    return rows.select("run_ts", "slug", "documento_id", "posicao", "c.inicio", "c.fim", "c.trecho", "c.tipo", "c.classificacao", "c.confianca", F.col("c.resolucao.id_canonico").alias("id_canonico"))


def latest_contracts(spark: SparkSession, sf: str) -> DataFrame:
    """The contracts of the newest runs among run folders, with the number of their citations."""
    ship_package(spark)
    folder = shared_folder(spark, "latest")
    files.write_runs(_stamped(_contracts(spark, sf)), folder)
    read = files.latest(files.read_contracts(spark, f"{folder}/*"))
    return read.select("run_ts", "slug", "documento_id", F.size("citacoes").alias("n"))


def metadata_files(spark: SparkSession, sf: str) -> DataFrame:
    ship_package(spark)
    folder = shared_folder(spark, "meta")
    files.write_metadata(table(spark, sf, "execucoes"), folder)
    return files.read_metadata(spark, f"{folder}/*")


def submission_file(spark: SparkSession, sf: str) -> DataFrame:
    """Submission CSV of all contracts, a row a section of a run, read again."""
    c = _contracts(spark, sf)
    lower = F.transform("citacoes", lambda x: x.withField("classificacao", F.lower(F.trim(x["classificacao"]))))
    path = shared_folder(spark, "submission")
    files.write_submission(c.select(F.concat_ws("/", "run", "documento_id").alias("documento_id"), lower.alias("citacoes")), path)
    return spark.read.options(**files.PLAIN_CSV, multiLine=True).csv(path).select("documento_id", "citacoes")


def golden_file(spark: SparkSession, sf: str) -> DataFrame:
    """The golden set as CSV without the documents of training examples, read again: all columns are text."""
    path = shared_folder(spark, "golden")
    blocked = table(spark, sf, "prata").select("documento_id")
    files.write_held_out(table(spark, sf, "goldenset"), blocked, path)
    return files.read_golden_csv(spark, path).select("linha_id", "documento_id", "parte", "nivel", "inicio", "fim", F.coalesce("classificacao", F.lit("")).alias("classificacao"), F.coalesce("id_canonico", F.lit("")).alias("id_canonico"))


def golden_file_ids(spark: SparkSession, sf: str) -> DataFrame:
    path = shared_folder(spark, "golden-ids")
    table(spark, sf, "goldenset").write.options(**files.PLAIN_CSV).csv(path)
    return files.golden_ids(spark, path)


def jsonl_examples(spark: SparkSession, sf: str) -> DataFrame:
    """Chat examples as JSON lines, read again: a row a message."""
    path = shared_folder(spark, "jsonl")
    files.write_jsonl(table(spark, sf, "gemma").select("documento_id", "inicio", "messages"), path)
    rows = files.read_jsonl(spark, path).select("documento_id", "inicio", F.posexplode("messages").alias("k", "m"))
    return rows.select("documento_id", "inicio", "k", "m.role", "m.content")


def manifest_file(spark: SparkSession, sf: str) -> DataFrame:
    """A manifest that is appended to; the documents that training texts were made from."""
    path = shared_folder(spark, "manifest")
    rows = table(spark, sf, "prata").select(F.concat(F.col("exemplo_id").cast("string"), F.lit(".txt")).alias("arquivo"), F.concat(F.lit("data/train/"), F.col("documento_id"), F.lit(".txt")).alias("origem"), F.col("divisao").alias("operacao"))
    files.write_jsonl(rows.where("operacao = 'treino'"), path)
    files.write_jsonl(rows.where("operacao is null or operacao <> 'treino'"), path, append=True)
    return files.manifest_origins(files.read_jsonl(spark, path, files.MANIFEST))


def evaluation_file(spark: SparkSession, sf: str) -> DataFrame:
    """The evaluation of each run as JSON, read again: a row a level."""
    path = shared_folder(spark, "evaluation")
    levels = score.score_levels(S._events(spark, sf), ["run"])
    files.write_evaluation(levels, score.score_final(levels, ["run"]), "run", path)
    detail = "macro_f1 double, f1_por_classe map<string,double>, tau double, s double, b double, score double"
    read = spark.read.schema(f"run string, avaliacao struct<score_final:double,niveis:map<string,struct<{detail.replace(' double', ':double').replace(' map', ':map')}>>>").json(path)
    rows = read.select("run", F.round("avaliacao.score_final", 6).alias("score_final"), F.explode("avaliacao.niveis").alias("nivel", "d"))
    return rows.select("run", "score_final", "nivel", *(F.round(f"d.{c}", 6).alias(c) for c in ("macro_f1", "tau", "s", "b", "score")), *(F.round(F.col("d.f1_por_classe")[c], 6).alias(f"f1_{c}") for c in ("real", "inventada", "incompleta")))


def sqlite_corpus(spark: SparkSession, sf: str) -> DataFrame:
    """The corpus in an SQLite file, read with its kind and columns selected there."""
    fs, path = files.file_system(shared_folder(spark, "corpus"))
    fs.create_dir(path, recursive=True)
    con = sqlite3.connect(f"{path}/corpus.db")
    con.execute("CREATE TABLE documentos (id, natureza, tribunal, relator, texto, texto_len)")
    con.executemany("INSERT INTO documentos VALUES (?, ?, ?, ?, ?, ?)", (tuple(r) for r in V.corpus(spark, sf).select("id", "natureza", "tribunal", "relator", "texto", "texto_len").toLocalIterator()))
    con.commit()
    con.close()
    ship_package(spark)
    read = files.read_corpus(spark, f"{path}/corpus.db", "id,tribunal,texto", natureza="acordao")
    return read.where("tribunal is not null").select("id", "tribunal", F.md5("texto").alias("md5"))


QUERIES = {f.__name__: f for f in (text_folder, contract_files, latest_contracts, metadata_files, submission_file, golden_file, golden_file_ids, jsonl_examples, manifest_file, evaluation_file, sqlite_corpus)}

_FIRST = "first_ AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run, documento_id, parte, inicio, fim ORDER BY citacao_id) AS rn FROM extract_citacoes WHERE run IS NOT NULL AND documento_id IS NOT NULL AND parte IS NOT NULL) WHERE rn = 1)"
_SLUG = "regexp_replace(run, '^[^_]*_', '')"
ORACLE = {
    "text_folder": "SELECT doc_id::VARCHAR AS documento_id, length(coalesce(text, ''))::INT AS n, md5(coalesce(text, '')) AS md5 FROM documents",
    "contract_files": f"WITH {_FIRST} SELECT split_part(run, '_', 1) AS run_ts, {_SLUG} AS slug, documento_id || '_' || parte AS documento_id, (row_number() OVER (PARTITION BY run, documento_id, parte ORDER BY inicio, fim, citacao_id) - 1)::INT AS posicao, inicio, fim, trecho, tipo, classificacao, confianca, resolucao.id_canonico AS id_canonico FROM first_",
    "latest_contracts": f"WITH {_FIRST} SELECT split_part(run, '_', 1) AS run_ts, {_SLUG} AS slug, documento_id || '_' || parte AS documento_id, count(*)::INT AS n FROM first_ WHERE split_part(run, '_', 1) = (SELECT max(split_part(run, '_', 1)) FROM first_) GROUP BY run, first_.documento_id, parte",
    "metadata_files": "SELECT run, name, role, family, parameters, slug, batch_size, lora FROM execucoes",
    "submission_file": f"WITH {_FIRST}, c AS (SELECT *, coalesce(nullif(trim(coalesce(resolucao.id_canonico, '')), ''), '-') AS id FROM first_) SELECT run || '/' || documento_id || '_' || parte AS documento_id, string_agg(inicio || ',' || fim || ',' || lower(trim(classificacao)) || ',' || id || ',' || coalesce(printf('%.4f', confianca), '-'), '|' ORDER BY inicio, fim, citacao_id) AS citacoes FROM c GROUP BY run, c.documento_id, parte",
    "golden_file": "SELECT linha_id::VARCHAR AS linha_id, documento_id, parte::VARCHAR AS parte, nivel::VARCHAR AS nivel, inicio::VARCHAR AS inicio, fim::VARCHAR AS fim, coalesce(classificacao, '') AS classificacao, coalesce(id_canonico, '') AS id_canonico FROM goldenset g WHERE NOT EXISTS (SELECT 1 FROM prata p WHERE p.documento_id = g.documento_id)",
    "golden_file_ids": "SELECT DISTINCT documento_id FROM goldenset",
    "jsonl_examples": "SELECT documento_id, inicio, (unnest(range(len(messages))))::INT AS k, unnest(messages).role AS role, unnest(messages).content AS content FROM gemma",
    "manifest_file": "SELECT DISTINCT documento_id FROM prata WHERE documento_id IS NOT NULL",
    "evaluation_file": V.SCORED_SQL + f"SELECT run, f.score_final, nivel::VARCHAR AS nivel, {', '.join(f'round({c}, 6) AS {c}' for c in ('macro_f1', 'tau', 's', 'b', 'score', 'f1_real', 'f1_inventada', 'f1_incompleta'))} FROM final JOIN ({S._FINAL}) f USING (run)",
    "sqlite_corpus": f"WITH {V.CORPUS_SQL} SELECT id, tribunal, md5(texto) AS md5 FROM corpus WHERE natureza = 'acordao' AND tribunal IS NOT NULL",
}
