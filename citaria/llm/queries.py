"""Queries of the llm problems and their SQL; __spark_entry__ adds them where this package is present."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citaria.llm import canon, crosssplit, garble, mixing, neardup, pieces, tokens
from citaria.session import ship_package, table


def _t(spark: SparkSession, sf: str, *names: str) -> list[DataFrame]:
    ship_package(spark)
    return [table(spark, sf, n) for n in names]


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    mapped = canon.map_mentions(*_t(spark, sf, "extract_citacoes", "canonicos"))
    return mapped.where(r"trecho is not null and not trecho rlike '(?U)^\\s*$'").select("citacao_id", "id_canonico")


def p1_mapped(spark: SparkSession, sf: str) -> DataFrame:
    return canon.map_mentions(*_t(spark, sf, "extract_citacoes", "canonicos"))


def p1_unmatched(spark: SparkSession, sf: str) -> DataFrame:
    return canon.unmatched(canon.map_mentions(*_t(spark, sf, "extract_citacoes", "canonicos")))


def p1_labels(spark: SparkSession, sf: str) -> DataFrame:
    """The list's own labels and long forms, which must come out as their entries (of rulings of one number, the smaller id)."""
    (c,) = _t(spark, sf, "canonicos")
    texts = c.select("id_canonico", F.explode(F.array("rotulo", "descricao")).alias("trecho")).where("trecho is not null")
    rows = texts.select(F.concat_ws("|", "id_canonico", "trecho").alias("citacao_id"), "trecho", F.struct(F.lit(None).cast("string").alias("id_canonico")).alias("resolucao"))
    return canon.map_mentions(rows, c).select("citacao_id", "trecho", "id_canonico")


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return pieces.split_items(*_t(spark, sf, "janela", "execucoes")).where("posicao = 1 and n_pecas > 1").select("janela_id")


def p2_pieces(spark: SparkSession, sf: str) -> DataFrame:
    return pieces.split_items(*_t(spark, sf, "janela", "execucoes"))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return crosssplit.cross_split_pairs(*_t(spark, sf, "prata")).select("exemplo_id_a", "exemplo_id_b")


def p3_report(spark: SparkSession, sf: str) -> DataFrame:
    return crosssplit.leak_report(*_t(spark, sf, "prata"))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return neardup.group_pairs(*_t(spark, sf, "gemma"))


def p5_groups(spark: SparkSession, sf: str) -> DataFrame:
    return neardup.groups(*_t(spark, sf, "gemma"))


def p6_ids(spark: SparkSession, sf: str) -> DataFrame:
    return tokens.encode(*_t(spark, sf, "documents"))


def p7_mix(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix_documents(*_t(spark, sf, "documents", "mistura"))


def p7_shares(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.shares(*_t(spark, sf, "documents", "mistura"))


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return garble.garbled(*_t(spark, sf, "documents")).select("doc_id")


def p8_repaired(spark: SparkSession, sf: str) -> DataFrame:
    return garble.garbled(*_t(spark, sf, "documents")).select("doc_id", F.array_join("camadas", " ").alias("camadas"), "restaurado", "texto")


QUERIES = {f.__name__: f for f in (p1_found, p1_mapped, p1_unmatched, p1_labels, p2_found, p2_pieces, p3_found, p3_report, p5_found, p5_groups, p6_ids, p7_mix, p7_shares, p8_found, p8_repaired)}

#: Only p2_found, the labels of problem 1 and the pairwise definitions of problems 3 and 5 can be said in SQL; the latter
#: take the brute-force way over all pairs that share a sequence, on whole tables.
_SETS = """
WITH msg AS (SELECT {key} AS k, {cols} list_filter(messages, lambda m: m.role = 'user' AND m.content IS NOT NULL)[1].content AS c FROM {table}),
txt AS (SELECT * EXCLUDE (c), CASE WHEN strpos(c, chr(10)) > 0 THEN substring(c, strpos(c, chr(10)) + 1) END AS t FROM msg),
wrd AS (SELECT * EXCLUDE (t), regexp_extract_all(strip_accents(lower(t)), '[a-z0-9]+') AS w FROM txt WHERE t IS NOT NULL),
seq AS (SELECT DISTINCT * EXCLUDE (w), unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS s FROM wrd WHERE len(w) >= 3),
num AS (SELECT k, count(*) AS n FROM seq GROUP BY k)
"""
_P3 = _SETS.format(key="exemplo_id", cols="divisao,", table="prata") + """
, both_ AS (SELECT a.k AS x, b.k AS y, count(*) AS m FROM seq a JOIN seq b ON a.s = b.s WHERE a.divisao = 'treino' AND b.divisao IN ('validacao', 'teste') GROUP BY 1, 2)
SELECT least(x, y) AS exemplo_id_a, greatest(x, y) AS exemplo_id_b FROM both_ JOIN num p ON p.k = x JOIN num q ON q.k = y WHERE m >= 0.6::DOUBLE * (p.n + q.n - m)
"""
_P3_REPORT = _SETS.format(key="exemplo_id", cols="divisao,", table="prata").replace("SELECT * EXCLUDE (t),", "SELECT * EXCLUDE (t), md5(t) AS d,") + """
, both_ AS (SELECT a.k AS x, b.k AS y, any_value(a.d) AS d, count(*) AS m FROM seq a JOIN seq b ON a.s = b.s WHERE a.divisao = 'treino' AND b.divisao IN ('validacao', 'teste') GROUP BY 1, 2)
, links AS (SELECT y, count(DISTINCT d) AS n FROM both_ JOIN num p ON p.k = x JOIN num q ON q.k = y WHERE m >= 0.6::DOUBLE * (p.n + q.n - m) GROUP BY y)
SELECT divisao, origem, count(*) AS exemplos, count(l.n) AS vazados, coalesce(sum(l.n), 0)::BIGINT AS pares_de_textos FROM prata LEFT JOIN links l ON l.y = exemplo_id WHERE divisao IN ('validacao', 'teste') GROUP BY divisao, origem
"""
_P5 = _SETS.format(key="documento_id", cols="", table="gemma").replace("WITH msg", "WITH RECURSIVE msg") + """
, link AS (SELECT a.k AS x, b.k AS y, count(*) AS m FROM seq a JOIN seq b ON a.s = b.s AND a.k <> b.k GROUP BY 1, 2),
near AS MATERIALIZED (SELECT x, y FROM link JOIN num p ON p.k = x JOIN num q ON q.k = y WHERE m >= 0.6::DOUBLE * (p.n + q.n - m)),
reach AS (SELECT x, y FROM near UNION SELECT r.x, n.y FROM reach r JOIN near n ON n.x = r.y)
SELECT DISTINCT x AS documento_id_a, y AS documento_id_b FROM reach WHERE x < y
"""
_P5_GROUPS = _P5[: _P5.rindex("SELECT DISTINCT")] + """
, grp AS (SELECT k AS documento_id, least(k, coalesce(min(y), k)) AS grupo FROM num LEFT JOIN reach ON x = k GROUP BY k)
SELECT documento_id, grupo, count(*) OVER (PARTITION BY grupo) AS tamanho FROM grp
"""
ORACLE = {
    "p1_labels": """WITH c AS (SELECT *, CASE WHEN natureza = 'acordao' THEN ltrim(regexp_replace(rotulo, '[^0-9]', '', 'g'), '0') ELSE id_canonico END AS name FROM canonicos WHERE id_canonico IS NOT NULL AND rotulo IS NOT NULL),
f AS (SELECT *, arg_min(id_canonico, {'a': length(id_canonico), 'b': id_canonico}) OVER (PARTITION BY natureza, name) AS first_id FROM c),
t AS (SELECT id_canonico, first_id, unnest([rotulo, descricao]) AS trecho FROM f) SELECT id_canonico || '|' || trecho AS citacao_id, trecho, first_id AS id_canonico FROM t WHERE trecho IS NOT NULL""",
    "p2_found": "SELECT janela_id FROM janela JOIN execucoes USING (run) WHERE orcamento > 0 AND length(text) > orcamento",
    "p3_found": _P3,
    "p3_report": _P3_REPORT,
    "p5_found": _P5,
    "p5_groups": _P5_GROUPS,
}
