"""Queries of scoring, cells and runs, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citaria.operators import codec, score
from citaria.plans import views as V
from citaria.session import table
from citaria.sources import files

RUN_LEVEL = ["run", "nivel"]
#: Runs before this have lost their metadata in `run_metadata`, so that the catalogue has to stand in.
METADATA_SINCE = "20260201"


def _rounded(df: DataFrame, *keep: str) -> DataFrame:
    return df.select(*keep, *(F.round(c, 6).alias(c) for c in df.columns if c not in keep))


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return score.events_of_texts(V.scored_texts(spark, sf), V.RUN_KEYS)


def match_pairs(spark: SparkSession, sf: str) -> DataFrame:
    texts = V.scored_texts(spark, sf).where("pred is not null")
    return score.match_texts(texts, V.RUN_KEYS).select(*V.RUN_KEYS, F.col("gi").cast("bigint").alias("gi"), F.col("pi").cast("bigint").alias("pi"))


def confusion_counts(spark: SparkSession, sf: str) -> DataFrame:
    return score.confusion(_events(spark, sf), RUN_LEVEL)


def severe_error_tau(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(score.tau(_events(spark, sf), RUN_LEVEL), *RUN_LEVEL, "graves", "inventadas")


def brier_bonus(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(score.brier(_events(spark, sf), RUN_LEVEL), *RUN_LEVEL, "n_conf")


def spurious(spark: SparkSession, sf: str) -> DataFrame:
    """How the golden and predicted spans of a run came out: paired, missed, spurious, or inside a match."""
    return _events(spark, sf).groupBy("run", "nivel", "caso").agg(F.count(F.lit(1)).alias("n"))


def score_levels(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(score.score_levels(_events(spark, sf), ["run"]), *RUN_LEVEL)


def score_final(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(score.score_final(score.score_levels(_events(spark, sf), ["run"]), ["run"]), "run")


def results_by_model(spark: SparkSession, sf: str) -> DataFrame:
    """Final score of every run with its model's metadata."""
    runs = table(spark, sf, "execucoes").select("run", "name", "role", "family", "parameters")
    return _rounded(score.score_final(score.score_levels(_events(spark, sf), ["run"]), ["run"]), "run").join(runs, "run", "left")


def _contracts(spark: SparkSession, sf: str) -> DataFrame:
    """(run, documento_id, parte, citacoes): the citations of a section in a run, retries dropped."""
    e = table(spark, sf, "extract_citacoes").where("run is not null and documento_id is not null")
    kind = F.lower(F.trim("classificacao"))
    e = e.select(*V.RUN_KEYS, "inicio", "fim", "citacao_id", kind.alias("classificacao"), "confianca", F.when(kind == "real", F.col("resolucao.id_canonico")).alias("id_canonico"))
    return score.gathered(e, V.RUN_KEYS, ["inicio", "fim", "citacao_id"], ["inicio", "fim", "classificacao", "confianca", "id_canonico"], "citacoes")


def codec_encode(spark: SparkSession, sf: str) -> DataFrame:
    return _contracts(spark, sf).select(*V.RUN_KEYS, codec.encode_cell(F.col("citacoes")).alias("celula"))


def codec_errors(spark: SparkSession, sf: str) -> DataFrame:
    """Cells of the submission under the strict format: most are written otherwise, and say which rule they break."""
    return codec.decode_submission(table(spark, sf, "submission"), ["linha_id"], "citacoes").select("linha_id", "erro", F.size(F.coalesce("citacoes", F.array().cast("array<struct<inicio:int,fim:int,classe:string,id_canonico:string,confianca:double>>"))).alias("n"))


def codec_decode(spark: SparkSession, sf: str) -> DataFrame:
    """Encoded cells decoded again, a row a citation."""
    d = codec.decode_submission(codec_encode(spark, sf), V.RUN_KEYS, "celula")
    return d.select(*V.RUN_KEYS, F.posexplode("citacoes").alias("posicao", "c")).select(*V.RUN_KEYS, "posicao", "c.inicio", "c.fim", "c.classe", "c.id_canonico", "c.confianca")


def gold_group_cells(spark: SparkSession, sf: str) -> DataFrame:
    g = V.golden(spark, sf).withColumnRenamed("classe", "classificacao").withColumn("ids", F.sort_array("ids"))
    return codec.golden_cells(g, V.TEXT_KEYS, "gi")


def gold_decode(spark: SparkSession, sf: str) -> DataFrame:
    d = codec.decode_golden(gold_group_cells(spark, sf), V.TEXT_KEYS, "citacoes")
    n = F.coalesce(F.aggregate("citacoes", F.lit(0), lambda a, c: a + F.size(c["ids"])), F.lit(0))
    return d.select(*V.TEXT_KEYS, "erro", F.coalesce(F.size("citacoes"), F.lit(-1)).alias("n"), n.alias("n_ids"))


def _solution(spark: SparkSession, sf: str) -> DataFrame:
    return V.golden(spark, sf).select(*V.TEXT_KEYS).distinct()


def dedup_first(spark: SparkSession, sf: str) -> DataFrame:
    return score.first_rows(table(spark, sf, "submission"), V.TEXT_KEYS, "linha_id").select(*V.TEXT_KEYS, "linha_id")


def missing_docs(spark: SparkSession, sf: str) -> DataFrame:
    return score.missing_rows(_solution(spark, sf), dedup_first(spark, sf), V.TEXT_KEYS)


def missing_docs_fill(spark: SparkSession, sf: str) -> DataFrame:
    sub = score.first_rows(table(spark, sf, "submission"), V.TEXT_KEYS, "linha_id")
    return score.filled(_solution(spark, sf), sub, V.TEXT_KEYS)


def latest_run(spark: SparkSession, sf: str) -> DataFrame:
    runs = table(spark, sf, "execucoes").select("run", F.substring_index("run", "_", 1).alias("run_ts"))
    newest = files.latest(runs)
    e = table(spark, sf, "extract_citacoes").select("run", "citacao_id")
    return e.join(F.broadcast(newest), "run").select("run_ts", "run", "citacao_id")


def run_metadata(spark: SparkSession, sf: str) -> DataFrame:
    """Metadata of the runs' models: their own where they have kept it, else the catalogue's."""
    runs = table(spark, sf, "execucoes")
    kept = runs.where(F.col("run") >= METADATA_SINCE).dropDuplicates(["slug"])
    catalogue = runs.groupBy("name").agg(*(F.max(c).alias(c) for c in ("role", "family", "parameters")))
    return files.with_metadata(runs, kept, catalogue)


def counters(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "extract_citacoes")
    return e.groupBy("run").agg(F.count(F.lit(1)).alias("linhas"), F.count_if(F.col("tipo") == "lei").alias("leis"), F.count_if(F.col("confianca").isNull()).alias("sem_confianca"), F.count_if(F.col("trecho").isNull()).alias("sem_trecho"))


def report_lines(spark: SparkSession, sf: str) -> DataFrame:
    return files.evaluation_report(score.score_levels(_events(spark, sf), ["run"]), ["run"])


QUERIES = {
    "score_levels": score_levels,
    "score_final": score_final,
    "match_pairs": match_pairs,
    "confusion_counts": confusion_counts,
    "severe_error_tau": severe_error_tau,
    "brier_bonus": brier_bonus,
    "spurious_fp": spurious,
    "results_by_model": results_by_model,
    "report_lines": report_lines,
    "codec_encode": codec_encode,
    "codec_decode": codec_decode,
    "codec_errors": codec_errors,
    "gold_group_cells": gold_group_cells,
    "gold_decode": gold_decode,
    "dedup_first": dedup_first,
    "missing_docs": missing_docs,
    "missing_docs_fill": missing_docs_fill,
    "latest_run": latest_run,
    "run_metadata": run_metadata,
    "counters": counters,
}

_FIRST = "first_ AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run, documento_id, parte, inicio, fim ORDER BY citacao_id) AS rn FROM extract_citacoes WHERE run IS NOT NULL AND documento_id IS NOT NULL) WHERE rn = 1)"
_ID = "coalesce(nullif(trim(CASE WHEN lower(trim(classificacao)) = 'real' THEN coalesce(resolucao.id_canonico, '') ELSE '' END), ''), '-')"
_R6 = "round({0}, 6) AS {0}".format
_GOLD_CELL = """golden_cells AS (SELECT documento_id, parte, arg_max(nivel, gi) AS nivel,
  string_agg(inicio || ',' || fim || ',' || classe || ',' || CASE WHEN classe = 'real' AND len(ids) > 0 THEN array_to_string(list_sort(ids), ':') ELSE '-' END, '|' ORDER BY gi) AS citacoes FROM golden GROUP BY ALL)"""
_SUB_FIRST = "sub_ AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY documento_id, parte ORDER BY linha_id) AS rn FROM submission) WHERE rn = 1)"
_T = r"regexp_replace({0}, '^[\s\x{{85}}\x{{A0}}\x{{2000}}-\x{{200A}}\x{{3000}}]+|[\s\x{{85}}\x{{A0}}\x{{2000}}-\x{{200A}}\x{{3000}}]+$', '', 'g')".format
_ERRORS = rf"""
WITH c AS (SELECT linha_id, list_filter(list_transform(string_split(CASE WHEN trim(coalesce(citacoes, '')) = '-' THEN '' ELSE trim(coalesce(citacoes, '')) END, '|'), lambda p: {_T('p')}), lambda p: p <> '') AS l FROM submission),
f AS (SELECT linha_id, unnest(range(1, len(l) + 1)) AS k, list_transform(string_split(unnest(l), ','), lambda x: {_T('x')}) AS f FROM c),
p AS (SELECT linha_id, k, f, lower(f[3]) AS kind, f[4] AS id, f[5] AS conf,
  CASE WHEN regexp_matches(f[1], '^[+-]?[0-9]+(_[0-9]+)*$') THEN try_cast(replace(f[1], '_', '') AS BIGINT) END AS a, CASE WHEN regexp_matches(f[2], '^[+-]?[0-9]+(_[0-9]+)*$') THEN try_cast(replace(f[2], '_', '') AS BIGINT) END AS b,
  CASE WHEN regexp_matches(f[5], '^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$') THEN try_cast(f[5] AS DOUBLE) END AS v FROM f),
e AS (SELECT *, CASE WHEN len(f) <> 5 THEN 'campos' WHEN a IS NULL THEN 'inicio' WHEN b IS NULL THEN 'fim' WHEN a < 0 OR b <= a THEN 'span' WHEN kind NOT IN ('real', 'inventada', 'incompleta') THEN 'classe'
  WHEN kind = 'real' AND id IN ('', '-') THEN 'id_ausente' WHEN kind = 'real' AND NOT regexp_matches(id, '^[0-9]+$') THEN 'id_digitos'
  WHEN conf NOT IN ('', '-') AND v IS NULL THEN 'confianca' WHEN conf NOT IN ('', '-') AND NOT v BETWEEN 0 AND 1 THEN 'confianca_faixa' END AS erro FROM p),
t AS (SELECT linha_id, arg_min(erro, k) FILTER (erro IS NOT NULL) AS erro, count(*)::INT AS n FROM e GROUP BY ALL),
d AS (SELECT DISTINCT x.linha_id FROM e x JOIN e y ON x.linha_id = y.linha_id AND x.k < y.k WHERE least(x.b, y.b) > greatest(x.a, y.a)
  AND 2 * (least(x.b, y.b) - greatest(x.a, y.a)) >= (x.b - x.a) + (y.b - y.a) - (least(x.b, y.b) - greatest(x.a, y.a))),
r AS (SELECT s.linha_id, coalesce(t.erro, CASE WHEN d.linha_id IS NOT NULL THEN 'duplicata' END) AS erro, coalesce(t.n, 0) AS n FROM submission s LEFT JOIN t ON t.linha_id = s.linha_id LEFT JOIN d ON d.linha_id = s.linha_id)
SELECT linha_id, erro, CASE WHEN erro IS NULL THEN n ELSE 0 END AS n FROM r
"""
_FINAL = "SELECT run, round(sum(CASE nivel WHEN 1 THEN 1.0::DOUBLE WHEN 2 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END * score) / sum(CASE nivel WHEN 1 THEN 1.0::DOUBLE WHEN 2 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END), 6) AS score_final FROM final GROUP BY run"
ORACLE = {
    "score_levels": V.SCORED_SQL + "SELECT run, nivel, " + ", ".join(map(_R6, ("macro_f1", "f1_real", "f1_inventada", "f1_incompleta", "tau", "s", "b", "score"))) + " FROM final",
    "score_final": V.SCORED_SQL + _FINAL,
    "match_pairs": V.SCORED_SQL + "SELECT run, documento_id, parte, gi, pi FROM pairs",
    "confusion_counts": V.SCORED_SQL + "SELECT run, nivel, classe, tp, fp, fn, suporte FROM conf",
    "severe_error_tau": V.SCORED_SQL + "SELECT run, nivel, graves, inventadas, round(CASE WHEN inventadas > 0 THEN graves::DOUBLE / inventadas ELSE 0 END, 6) AS tau FROM taus",
    "brier_bonus": V.SCORED_SQL + "SELECT run, nivel, n_conf, round(brier, 6) AS brier, round(coalesce(greatest(0::DOUBLE, least(0.1::DOUBLE, 0.1::DOUBLE * (1 - brier))), 0), 6) AS b FROM briers",
    "spurious_fp": V.SCORED_SQL + "SELECT run, nivel, caso, count(*) AS n FROM ev GROUP BY ALL",
    "report_lines": V.SCORED_SQL + "SELECT run, nivel::INT AS nivel, printf('nivel %s: score=%.4f macro_f1=%.4f tau=%.3f bonus=%.4f f1=%s/%s/%s', nivel::VARCHAR, score, macro_f1, tau, b, coalesce(round(f1_real, 3)::VARCHAR, 'null'), coalesce(round(f1_inventada, 3)::VARCHAR, 'null'), coalesce(round(f1_incompleta, 3)::VARCHAR, 'null')) AS linha FROM final",
    "results_by_model": V.SCORED_SQL + f"SELECT s.*, name, role, family, parameters FROM ({_FINAL}) s LEFT JOIN execucoes USING (run)",
    "codec_encode": f"WITH {_FIRST} SELECT run, documento_id, parte, string_agg(inicio || ',' || fim || ',' || lower(trim(classificacao)) || ',' || {_ID} || ',' || coalesce(printf('%.4f', confianca), '-'), '|' ORDER BY inicio, fim, citacao_id) AS celula FROM first_ GROUP BY ALL",
    "codec_errors": _ERRORS,
    "gold_group_cells": f"WITH {V.GOLDEN_SQL}, {_GOLD_CELL} SELECT * FROM golden_cells",
    "dedup_first": f"WITH {_SUB_FIRST} SELECT documento_id, parte, linha_id FROM sub_",
    "missing_docs": f"WITH {V.GOLDEN_SQL} SELECT DISTINCT documento_id, parte FROM golden g WHERE NOT EXISTS (SELECT 1 FROM submission s WHERE s.documento_id = g.documento_id AND s.parte = g.parte)",
    "missing_docs_fill": f"WITH {V.GOLDEN_SQL}, {_SUB_FIRST} SELECT documento_id, parte, citacoes FROM sub_ UNION ALL (SELECT DISTINCT documento_id, parte, '-' FROM golden g WHERE NOT EXISTS (SELECT 1 FROM submission s WHERE s.documento_id = g.documento_id AND s.parte = g.parte))",
    "latest_run": "SELECT split_part(run, '_', 1) AS run_ts, run, citacao_id FROM extract_citacoes WHERE split_part(run, '_', 1) = (SELECT max(split_part(run, '_', 1)) FROM execucoes)",
    "run_metadata": "SELECT DISTINCT slug, name, role, family, parameters FROM execucoes",
    "counters": "SELECT run, count(*) AS linhas, count(*) FILTER (tipo = 'lei') AS leis, count(*) FILTER (confianca IS NULL) AS sem_confianca, count(*) FILTER (trecho IS NULL) AS sem_trecho FROM extract_citacoes GROUP BY run",
    "gold_decode": f"""WITH {V.GOLDEN_SQL}, bad AS (SELECT documento_id, parte, bool_or(classe = 'real' AND len(ids) = 0) AS bare, count(*)::INT AS n, sum(CASE WHEN classe = 'real' THEN len(ids) ELSE 0 END)::INT AS n_ids FROM golden GROUP BY ALL),
      cross_ AS (SELECT DISTINCT a.documento_id, a.parte FROM golden a JOIN golden b ON a.documento_id = b.documento_id AND a.parte = b.parte AND a.gi < b.gi AND least(a.fim, b.fim) > greatest(a.inicio, b.inicio))
      SELECT documento_id, parte, erro, CASE WHEN erro IS NULL THEN n ELSE -1 END AS n, CASE WHEN erro IS NULL THEN n_ids ELSE 0 END AS n_ids FROM (
      SELECT bad.*, CASE WHEN bare THEN 'real_sem_ids' WHEN cross_.documento_id IS NOT NULL THEN 'sobreposicao' END AS erro FROM bad LEFT JOIN cross_ USING (documento_id, parte))""",
    "codec_decode": f"""WITH {_FIRST}, c AS (SELECT *, {_ID} AS id, row_number() OVER (PARTITION BY run, documento_id, parte ORDER BY inicio, fim, citacao_id) - 1 AS k FROM first_),
      bad AS (SELECT DISTINCT run, documento_id, parte FROM c WHERE inicio < 0 OR fim <= inicio OR lower(trim(classificacao)) NOT IN ('real', 'inventada', 'incompleta') OR (lower(trim(classificacao)) = 'real' AND NOT regexp_matches(id, '^[0-9]+$'))
        UNION SELECT DISTINCT x.run, x.documento_id, x.parte FROM c x JOIN c y ON x.run = y.run AND x.documento_id = y.documento_id AND x.parte = y.parte AND x.k < y.k WHERE 3 * (least(x.fim, y.fim) - greatest(x.inicio, y.inicio)) >= (x.fim - x.inicio) + (y.fim - y.inicio))
      SELECT run, documento_id, parte, k::INT AS posicao, inicio, fim, lower(trim(classificacao)) AS classe, CASE WHEN id <> '-' THEN CASE WHEN ltrim(id, '0') = '' THEN '0' ELSE ltrim(id, '0') END END AS id_canonico, printf('%.4f', confianca)::DOUBLE AS confianca
      FROM c WHERE NOT EXISTS (SELECT 1 FROM bad b WHERE b.run = c.run AND b.documento_id = c.documento_id AND b.parte = c.parte)""",
}
